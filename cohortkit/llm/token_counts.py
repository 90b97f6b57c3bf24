"""Operator 7, token counts: rank-synchronous merging of ragged numpy arrays.

A piece model (BPE with byte fallback) is read into a table of pairs: two
neighbouring symbols merge when their joined string is a piece, better pieces
first, the leftmost pair first among equals.  Texts are cut into pre-tokens at
places that no piece can cross, the pre-tokens that are new to the worker are
laid out as one ragged array of symbols, and in every round each sequence
applies its own lowest-rank pair.  What survives is counted; characters that
are no piece count their UTF-8 bytes.

Edge cases: null and empty texts have 0 tokens; strings that look like special
tokens are ordinary text; repeated rows are counted row by row; extra columns
are not read.  A text is cut into parts of about a million characters, so that
a very long one needs no more memory than its own string.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.llm.common import read
from cohortkit.llm.registry import query

MARK = "▁"
NO_RANK = np.int64(1) << 30
#: Counts that a worker keeps; beyond it starts anew (only speed depends on it).
CACHE_ENTRIES = 500_000
PART_CHARS = 1_000_000


class PieceCounter:
    """Counts the tokens that a piece model gives, without running its library on the text."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                pieces[sp.id_to_piece(i)] = sp.get_score(i)
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds a word mark after other characters; words cannot be cut apart")
        names = list(pieces) + sorted({c for p in pieces for c in p} - pieces.keys())
        self.ids = {p: i for i, p in enumerate(names)}
        ranks = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        left, right, to, rank = [], [], [], []
        for p, score in pieces.items():
            for k in range(1, len(p)):
                if p[:k] in self.ids and p[k:] in self.ids:
                    left.append(self.ids[p[:k]])
                    right.append(self.ids[p[k:]])
                    to.append(self.ids[p])
                    rank.append(ranks[score])
        key = np.array(left, np.int64) << 20 | np.array(right, np.int64)
        order = np.argsort(key)
        self.key = key[order]
        self.to = np.array(to, np.int64)[order]
        self.rank = np.array(rank, np.int64)[order]
        # Tokens of a symbol that stays: 1 for a piece, its bytes for any other character.
        self.cost = np.array([1 if p in pieces else len(p.encode()) for p in names], np.int64)
        self.alone = {c for c in names if len(c) == 1}
        self.inner = {p[k:k + 2] for p in pieces for k in range(len(p) - 1)}
        self.cache: dict[str, int] = {}
        self.cut = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n" if "\n" not in self.alone
                              else f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def _pieces_of(self, word: str) -> list[str]:
        """Parts of a long pre-token, cut where no piece holds the two neighbours."""
        cuts = [0, *(i for i in range(1, len(word)) if word[i - 1:i + 1] not in self.inner), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    def merge_counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token, all merged together, one pair per sequence and round."""
        fixed = np.zeros(len(words), np.int64)
        sym, seq = [], []
        for i, w in enumerate(words):
            for c in w:
                s = self.ids.get(c)
                if s is None:  # never merges: its bytes are tokens
                    fixed[i] += len(c.encode())
                    sym.append(-1)
                else:
                    sym.append(s)
                seq.append(i)
        out = fixed
        s, q = np.array(sym, np.int64), np.array(seq, np.int64)
        while len(s):
            key = s[:-1] << 20 | s[1:]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = (self.key[at] == key) & (q[:-1] == q[1:]) & (s[:-1] >= 0) & (s[1:] >= 0)
            rank = np.where(ok, self.rank[at], NO_RANK)
            rank = np.append(rank, NO_RANK)
            starts = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(s)), starts)
            live = (best >> 32) < NO_RANK
            done = np.repeat(~live, np.diff(np.append(starts, len(s))))
            if done.any():
                fin = done & (s >= 0)
                out += np.bincount(q[fin], self.cost[s[fin]], len(words)).astype(np.int64)
            place = best[live] & 0xFFFFFFFF
            s[place] = self.to[at[place]]
            keep = ~done
            keep[place + 1] = False
            s, q = s[keep], q[keep]
        return out

    def _learn(self, words: set[str]) -> None:
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        todo = list(words - self.cache.keys())
        long = [w for w in todo if len(w) > 64]
        short = [w for w in todo if len(w) <= 64]
        for a in range(0, len(short), 50_000):
            part = short[a:a + 50_000]
            self.cache.update(zip(part, self.merge_counts(part).tolist()))
        for w in long:
            self.cache[w] = int(self.merge_counts(self._pieces_of(w)).sum())

    def _parts(self, text: str) -> Iterator[str]:
        """The marked text in parts that begin at a word mark after another character."""
        text = MARK + text.replace(" ", MARK)
        a = 0
        while len(text) - a > PART_CHARS:
            b = a + PART_CHARS
            while (b := text.find(MARK, b)) > 0 and text[b - 1] == MARK:
                b += 1
            if b < 0:
                break
            yield text[a:b]
            a = b
        yield text[a:]

    def count(self, text: str | None) -> int:
        return self.count_all([text])[0]

    def count_all(self, texts: list[str | None]) -> list[int]:
        """Token counts of a batch; its new pre-tokens are merged together."""
        out, held, chars = [0] * len(texts), [], 0
        for i, t in enumerate(texts):
            for part in self._parts(t) if t else ():
                held.append((i, self.cut.findall(part)))
                chars += len(part)
                if chars >= PART_CHARS:
                    self._settle(held, out)
                    held, chars = [], 0
        self._settle(held, out)
        return out

    def _settle(self, held: list[tuple[int, list[str]]], out: list[int]) -> None:
        self._learn(set().union(*(words for _, words in held)))
        for i, words in held:
            out[i] += sum(map(self.cache.__getitem__, words))


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; a narrow pass without a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model_path)
        for b in batches:
            counts = counter.count_all(b.column(2).to_pylist())
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), n, pa.array([c > limit for c in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    idt = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"),
                      F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
                      F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"doc_id {idt}, n_bytes long, n_tokens long, over_limit boolean")


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
