r"""Operator 4, chat formatting: token-level assembly.

Every turn becomes ``TURN_START role ROLE_END content TURN_END``.  The role and
the content are encoded separately as ordinary text, and the three control
marks are spliced in as reserved ids above the vocabulary, so no text can ever
produce them.  The loss mask is derived from the prefix sums of the segment
lengths.  The same turns are rendered as text, with control strings that occur
in a role or content broken by a backslash after their first character and
backslashes doubled; ``unescape`` reverses that exactly.

A conversation is never gathered into memory: turns are encoded where they are
read, dealt out by conversation, sorted by turn and read back as a stream.

Edge cases: null texts and roles are empty; null conversation ids form one
conversation; a null turn comes first; rows with equal turns are ordered by
role, then text; repeated rows are all kept; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.llm.common import read
from cohortkit.llm.registry import query

TURN_START, ROLE_END, TURN_END = "### ", ":\n", "</turn>\n"
#: Strings broken up inside texts: the marks, without the line ends that rendering adds.
CONTROL = re.compile(r"\\|#(?=##)|:(?=\n)|<(?=/turn>)")
#: Reserved ids, counted from the size of the vocabulary.
START_ID, ROLE_ID, END_ID = 0, 1, 2


def escape(text: str) -> str:
    r"""Doubles backslashes and puts one after the first character of a control string."""
    return CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    """The inverse of :func:`escape`: drops the character after each escape that was put in."""
    out, i = [], 0
    for m in re.finditer(r"\\", text):
        if m.start() < i:
            continue
        # a backslash stands for itself when doubled; otherwise it only broke a control string
        out.append(text[i:m.start()])
        i = m.start() + 1
        if text[i:i + 1] == "\\":
            out.append("\\")
            i += 1
    out.append(text[i:])
    return "".join(out)


class Formatter:
    """Encodes segments and assembles ids and loss masks."""

    def __init__(self, rank_path: str, pattern: str, loss_roles: tuple[str, ...] = ("assistant",)):
        import base64

        import tiktoken

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.enc = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.base = max(ranks.values()) + 1
        self.loss_roles = frozenset(loss_roles)

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of one turn: mask is 1 on the content's ids of a loss role."""
        r, c = (self.enc.encode_ordinary(escape(x)) for x in (role, text))
        segments = [[self.base + START_ID], r, [self.base + ROLE_ID], c, [self.base + END_ID]]
        ends = np.cumsum([len(x) for x in segments])
        edge = np.zeros(ends[-1] + 1, np.int8)
        if role in self.loss_roles:
            edge[ends[2]] += 1
            edge[ends[3]] -= 1
        return np.concatenate([np.array(x, np.int32) for x in segments]), np.cumsum(edge[:-1]).astype(np.int8)

    def read_back(self, ids: np.ndarray, mask: np.ndarray) -> Iterator[tuple[str, str, str, str]]:
        """(role, text, text under the mask, rendered) of each turn found in the ids."""
        starts = np.flatnonzero(ids == self.base + START_ID)
        mids = np.flatnonzero(ids == self.base + ROLE_ID)
        stops = np.flatnonzero(ids == self.base + END_ID)
        for a, m, e in zip(starts.tolist(), mids.tolist(), stops.tolist()):
            role, text = (self.enc.decode(x.tolist()) for x in (ids[a + 1:m], ids[m + 1:e]))
            under = self.enc.decode(ids[a:e][mask[a:e] == 1].tolist())
            yield unescape(role), unescape(text), unescape(under), f"{TURN_START}{role}{ROLE_END}{text}{TURN_END}"


def format_turns(turns: DataFrame, rank_path: str, pattern: str,
                 loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, turn, role, text, input_ids, loss_mask), a narrow pass; conversations are the
    turns' arrays one after another."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fmt = Formatter(rank_path, pattern, loss_roles)
        for b in batches:
            pairs = [fmt.turn(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([p[0] for p in pairs], pa.list_(pa.int32())),
                 pa.array([p[1] for p in pairs], pa.list_(pa.int8()))],
                names=["conv_id", "turn", "role", "text", "input_ids", "loss_mask"])

    src = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    return src.mapInArrow(run, "conv_id long, turn long, role string, text string, "
                               "input_ids array<int>, loss_mask array<tinyint>")


def digest_conversations(formatted: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """One row per conversation, read back from the ids and masks alone, turn by turn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fmt = Formatter(rank_path, pattern)

        def rows():
            for b in batches:
                yield from zip(*(b.column(i).to_pylist() for i in range(3)))

        def digests():
            for conv, group in itertools.groupby(rows(), key=lambda r: r[0]):
                turns = loss = chars = tokens = 0
                all_sha, loss_sha = hashlib.sha256(), hashlib.sha256()
                for _, ids, mask in group:
                    tokens += len(ids)
                    for role, text, under, shown in fmt.read_back(np.array(ids), np.array(mask)):
                        turns += 1
                        all_sha.update(f"{role}\n{text}\n".encode())
                        loss_sha.update(under.encode())
                        loss += len(under)
                        chars += len(shown)
                yield conv, turns, all_sha.hexdigest(), loss, loss_sha.hexdigest(), chars, tokens

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for chunk in itertools.batched(digests(), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*chunk), types)], names=names)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "input_ids", "loss_mask").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
             "formatted_chars long, n_tokens long")


#: The contract's extra conversation.
PROBE = r"\### Assistant: </turn> ok"


def _escaped(c: str) -> str:
    """Length of the escaped text: one more for each control string and backslash."""
    extra = [f"(length({c}) - length(replace({c}, '{x}', ''))) // {n}" for x, n in (("\\", 1), ("</turn>", 7))]
    extra.append(f"(length({c}) - length(replace({c}, ':' || chr(10), ''))) // 2")
    extra.append(f"coalesce(list_sum(list_transform(regexp_extract_all({c}, '#{{3,}}'), lambda x: length(x) - 2)), 0)")
    return f"length({c}) + " + " + ".join(extra)


OP4_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + {_escaped('role')} + 2 + {_escaped('text')} + 8) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


@query("op4_chat_format", OP4_SQL)
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(PROBE).alias("text"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    args = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    return digest_conversations(format_turns(turns, *args), *args).drop("n_tokens")
