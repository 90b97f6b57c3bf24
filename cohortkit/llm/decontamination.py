"""Operator 3, benchmark decontamination: q-gram lemma filtering and banded alignment.

Benchmark items and documents are normalised (lower case, runs of white
space as one space) and compared as UTF-8 bytes.  Items are cut into
overlapping pieces; a piece of m bytes has an edit budget of ``budget`` of its
length.  A region within e edits of a piece shares at least m - q + 1 - q e of
its q-grams, on diagonals that differ by e at most.  Shared q-grams are counted
per piece in diagonal bands twice as wide as that, each overlapping the next by
half, so one band holds all of a true region.  Regions that reach the bound
are verified by an alignment of the piece within the band.

What is found is a whole piece: items of up to 128 bytes whole, of longer ones
pieces of 128 bytes at a stride of 64.  So an excerpt of a longer item is sure
to be found from 191 bytes on, between 128 and 190 bytes only where it holds a
whole piece, and a shorter one never.

The q-grams of the benchmark are sent to the tasks in blocks of bounded size;
documents are scanned once per block and never shuffled.

Edge cases: null or empty texts match nothing; items of fewer than ``least``
bytes are no passages and match nothing, and pieces too short for the lemma get
the largest budget for which it still holds; a piece that is the same in
several items reports each; repeated rows are scanned one by one; extra
columns pass through :func:`decontaminate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.llm.common import read
from cohortkit.llm.ragged import FOLD, IS_SPACE, batches_of, text_buffer
from cohortkit.llm.registry import query

Q = 8
#: Bytes of benchmark text whose q-grams make one block of the broadcast index.
BLOCK_BYTES = 8 << 20
PART_BYTES = 1 << 18
FILTER_BITS = 22


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with single spaces, a zero byte after each text, and the texts' new offsets."""
    space = IS_SPACE[data]
    lead = np.zeros(len(data), bool)
    lead[1:] = space[:-1]
    lead[offsets[:-1][offsets[:-1] < len(data)]] = False
    keep = ~(space & lead)
    clean = np.where(space, np.uint8(32), FOLD[data])[keep]
    ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
    n = len(offsets) - 1
    out = np.zeros(len(clean) + n, np.uint8)
    out[np.arange(len(clean)) + np.repeat(np.arange(n), np.diff(ends))] = clean
    return out, ends + np.arange(n + 1)


def grams(text: np.ndarray) -> np.ndarray:
    """Every q-gram of eight bytes as one number."""
    if len(text) < Q:
        return np.zeros(0, np.uint64)
    x = text.astype(np.uint64)
    x = x[:-1] | x[1:] << np.uint64(8)
    x = x[:-2] | x[2:] << np.uint64(16)
    return x[:-4] | x[4:] << np.uint64(32)


def _slot(g: np.ndarray) -> np.ndarray:
    return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def allowed(m: int, budget: float) -> int:
    """Edits allowed in a piece of m bytes; at most as many as the lemma has a positive bound for."""
    return max(0, min(int(m * budget), (m - Q) // Q))


@dataclass
class Index:
    """Pieces of one block of the benchmark and their q-grams, sorted."""

    pieces: list[np.ndarray]
    items: list
    grams: np.ndarray
    piece_of: np.ndarray
    place: np.ndarray
    edits: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple], piece: int, budget: float, least: int) -> Index:
        pieces, items = [], []
        for item, text in rows:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            clean = normalise(raw, np.array([0, len(raw)]))[0][:-1]
            clean = clean[clean != 0]
            while len(clean) and clean[-1] == 32:
                clean = clean[:-1]
            clean = clean[1:] if len(clean) and clean[0] == 32 else clean
            if len(clean) < max(least, Q):
                continue
            for a in range(0, max(len(clean) - piece, 0) + piece // 2, piece // 2):
                a = min(a, max(len(clean) - piece, 0))
                pieces.append(clean[a:a + piece])
                items.append(item)
                if a + piece >= len(clean):
                    break
        each = [grams(p) for p in pieces]
        g = np.concatenate(each) if each else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(each)), [len(x) for x in each]) if each else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(x)) for x in each]) if each else np.zeros(0, np.int64)
        order = np.argsort(g, kind="stable")
        return cls(pieces, items, g[order], owner[order].astype(np.int64), place[order].astype(np.int64),
                   np.array([allowed(len(p), budget) for p in pieces], np.int64))

    def prepare(self) -> None:
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[_slot(self.grams)] = True
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)
        self.bound = self.sizes - Q + 1 - Q * self.edits
        self.bytes = np.zeros((len(self.pieces), int(self.sizes.max())), np.uint8)
        for i, p in enumerate(self.pieces):
            self.bytes[i, :len(p)] = p

    def regions(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, first start) of the bands of ``text`` that reach the bound."""
        g = grams(text)
        at = np.flatnonzero(self.filter[_slot(g)])
        lo = np.searchsorted(self.grams, g[at], "left")
        n = np.searchsorted(self.grams, g[at], "right") - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        entry = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        piece, top = self.piece_of[entry], int(self.sizes.max())
        diagonal = np.repeat(at, n) - self.place[entry] + top  # never negative
        band = diagonal // (self.edits[piece] + 1)
        key = np.sort(np.concatenate([piece << 40 | band + 1, piece << 40 | band]))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        hit = np.diff(np.append(first, len(key))) >= self.bound[key[first] >> 40]
        key = key[first[hit]]
        piece, band = key >> 40, key & ((1 << 40) - 1)
        return piece, (band - 1) * (self.edits[piece] + 1) - top

    def align(self, piece: np.ndarray, begin: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edits, end) of the best place of each piece that starts within its band.

        All candidates step through their pieces together.  Column k of a row
        is the place ``begin + k`` on the diagonal of the row; a piece may
        start anywhere in the band and is used whole.
        """
        order = np.argsort(-self.sizes[piece], kind="stable")
        piece, begin = piece[order], begin[order]
        size, width = self.sizes[piece], 4 * int(self.edits[piece].max()) + 2
        padded = np.concatenate([text, np.zeros(int(size.max()) + width + 1, np.uint8)])
        step = np.arange(width, dtype=np.int16)
        row = np.zeros((len(piece), width), np.int16)
        for i in range(int(size[0])):
            n = int(np.searchsorted(-size, -i, "left"))  # pieces that still have a byte i
            cell = (begin[:n] + i)[:, None] + step
            near = np.where(cell >= 0, padded[np.maximum(cell, 0)], 0)
            new = row[:n] + (near != self.bytes[piece[:n], i][:, None])
            np.minimum(new[:, :-1], row[:n, 1:] + 1, out=new[:, :-1])
            row[:n] = np.minimum.accumulate(new - step, axis=1) + step
        best = np.argmin(row, axis=1)
        back = np.argsort(order)
        return row[np.arange(len(row)), best][back].astype(np.int64), (begin + size + best)[back]

    def matches(self, text: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(piece, first byte, end, edits) of the verified regions."""
        found = {}
        reach = int(self.sizes.max()) + 4 * int(self.edits.max()) + 8 if self.pieces else 0
        for a in range(0, max(len(text) - Q, 0) + 1, PART_BYTES):
            piece, first = self.regions(text[a:a + PART_BYTES + reach])
            if not len(piece):
                continue
            edits, end = self.align(piece, a + first - self.edits[piece], text)
            ok = edits <= self.edits[piece]
            for p, e, n in zip(piece[ok].tolist(), end[ok].tolist(), edits[ok].tolist()):
                if n < found.get((p, e), (0, 0, 0, n + 1))[3]:
                    found[p, e] = (p, max(0, e - int(self.sizes[p])), e, n)
        return list(found.values())


def _blocks(benchmark: DataFrame, piece: int, budget: float, least: int) -> Iterator[Index]:
    """The benchmark as indexes of bounded size, read to the driver row by row."""
    rows, size = [], 0
    for r in benchmark.select("item_id", F.lower("text")).toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1] or "")
        if size >= BLOCK_BYTES:
            yield Index.build(rows, piece, budget, least)
            rows, size = [], 0
    yield Index.build(rows, piece, budget, least)


def find_matches(docs: DataFrame, benchmark: DataFrame, piece: int = 128, budget: float = 0.1, least: int = 32,
                 id_col: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, start, end, edits): verified pieces, as places in the normalised document."""
    idt, itt = (d.schema[c].dataType.simpleString() for d, c in ((docs, id_col), (benchmark, "item_id")))
    arrow_item = {"bigint": pa.int64(), "int": pa.int32()}.get(itt, pa.string())
    out = None
    for index in _blocks(benchmark, piece, budget, least):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ix = sent.value
            if not ix.pieces:
                return
            ix.prepare()
            for whole in batches:
                for b in batches_of(whole, 1):
                    text, offsets = normalise(*text_buffer(b.column(1)))
                    found = sorted(ix.matches(text), key=lambda m: m[2])
                    if not found:
                        continue
                    p, begin, end, edits = (np.array(x, np.int64) for x in zip(*found))
                    row = np.searchsorted(offsets, end - 1, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(row)), pa.array([ix.items[i] for i in p.tolist()], arrow_item),
                         pa.array(np.maximum(begin - offsets[row], 0)), pa.array(end - offsets[row]), pa.array(edits)],
                        names=["doc_id", "item_id", "start", "end", "edits"])

        part = docs.select(id_col, F.lower("text").alias("text")).mapInArrow(run, f"doc_id {idt}, item_id {itt}, start long, end long, edits long")
        out = part if out is None else out.unionByName(part)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, **args) -> DataFrame:
    """One row per contaminated document and item: places found, least edits, first and last place."""
    return find_matches(docs, benchmark, **args).groupBy("doc_id", "item_id").agg(
        F.count("*").alias("n_matches"), F.min("edits").alias("edits"), F.min("start").alias("start"), F.max("end").alias("end"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **args) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark."""
    row = F.to_json(F.struct("doc_id", F.xxhash64("text").alias("t")))
    bad = find_matches(docs.select(row.alias("_op3_key"), "text"), benchmark, id_col="_op3_key", **args).select(F.col("doc_id").alias("_op3_bad")).distinct()
    return docs.withColumn("_op3_key", row).join(bad, F.col("_op3_key") == F.col("_op3_bad"), "left_anti").drop("_op3_key")


@query("op3_decontaminate")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
