"""Operator 6, line dedup: sharded cuckoo filters backed by exact reference-count tables.

The state is two tables: ``refs`` has each line key with the number of
documents that hold it, ``filters`` one cuckoo filter per shard over the keys
that have reached the threshold.  Inserting documents adds to the counts,
deleting them subtracts, and keys that cross the threshold are put into or
taken out of their shard's filter, so that the state after a deletion is that
of never having seen the document.  To dedup, lines are probed against the
filters where they are read; the few that pass are confirmed by the exact
counts, so a false positive of a filter never drops a line.

A key is the line without ASCII white space at its ends and with A-Z
lower-cased, held as 128 bits of hash.  Counts are aggregated before they are
shuffled, so a line that every document holds costs one row per task.

Edge cases: a null or empty text is one empty line; empty keys are never
dropped; a line repeated within a document counts once; repeated rows are
documents of their own; null ids are kept; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortkit.llm.common import SPACE, read, stage
from cohortkit.llm.ragged import batches_of, text_buffer
from cohortkit.llm.registry import query

WHITE = SPACE.encode()
SLOTS = 4
MAX_KICKS = 500
#: Keys that a shard's filter is laid out for, and the filters' size up to which they are broadcast.
SHARD_KEYS = 50_000
BROADCAST_BYTES = 64 << 20
FILTER_SCHEMA = "shard int, buckets int, cells binary"


def _places(k1: np.ndarray, k2: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint (never 0) and the two buckets of each key."""
    fp = ((k2.view(np.uint64) >> np.uint64(48)).astype(np.int64)) | 1
    b1 = (k1.view(np.uint64) >> np.uint64(8)).astype(np.int64) & mask
    return fp, b1, b1 ^ (fp * 0x5BD1E995 & mask)


class CuckooFilter:
    """Partial-key cuckoo filter: 16-bit fingerprints, four to a bucket."""

    def __init__(self, buckets: int, cells: bytes | None = None):
        self.buckets = buckets
        self.cells = (np.zeros((buckets, SLOTS), np.uint16) if cells is None
                      else np.frombuffer(cells, np.uint16).reshape(buckets, SLOTS).copy())

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        return cls(1 << max(4, int(np.ceil(np.log2(max(n, 1) / (0.8 * SLOTS))))))

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """False when a key found no place; the filter is then to be built anew, larger."""
        rng = np.random.default_rng(1)
        for f, a, b in zip(*(x.tolist() for x in _places(k1, k2, self.buckets - 1))):
            for _ in range(MAX_KICKS):
                for p in (a, b):
                    free = np.flatnonzero(self.cells[p] == 0)
                    if len(free):
                        self.cells[p, free[0]] = f
                        break
                else:
                    slot = int(rng.integers(SLOTS))
                    f, self.cells[b, slot] = int(self.cells[b, slot]), f
                    a, b = b, b ^ (f * 0x5BD1E995 & (self.buckets - 1))
                    continue
                break
            else:
                return False
        return True

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Takes out one fingerprint of each key; only keys that were inserted may be deleted."""
        for f, a, b in zip(*(x.tolist() for x in _places(k1, k2, self.buckets - 1))):
            for p in (a, b):
                found = np.flatnonzero(self.cells[p] == f)
                if len(found):
                    self.cells[p, found[0]] = 0
                    break

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        fp, b1, b2 = _places(k1, k2, self.buckets - 1)
        f = fp[:, None]
        return (self.cells[b1] == f).any(axis=1) | (self.cells[b2] == f).any(axis=1)


@dataclass
class LineState:
    refs: DataFrame      # k1, k2, n
    filters: DataFrame   # shard, buckets, cells
    shards: int
    min_docs: int


def _keys(text: bytes) -> list[bytes]:
    """The key of every line, empty for a line without one; 128 bits of hash otherwise."""
    keys = (line.strip(WHITE).lower() for line in text.split(b"\n"))
    return [hashlib.blake2b(k, digest_size=16).digest() if k else b"" for k in keys]


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    data, offsets = text_buffer(batch.column(column))
    raw = data.tobytes()
    return (raw[a:b] for a, b in zip(offsets.tolist(), offsets[1:].tolist()))


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _shard(k1: Column, shards: int) -> Column:
    return F.pmod(k1, F.lit(shards)).cast("int")


def _counts(docs: DataFrame, sign: int) -> DataFrame:
    """(k1, k2, n): documents that hold each key, counted in the batch, then in the task, then over all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in batches_of(whole, 0, 4 << 20):
                count = Counter(k for text in _texts(b, 0) for k in set(_keys(text)) if k)
                k1, k2 = _halves(list(count))
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(list(count.values()), pa.int64())], names=["k1", "k2", "n"])

    return docs.select("text").mapInArrow(run, "k1 long, k2 long, n long").groupBy("k1", "k2").agg((F.sum("n") * sign).alias("n"))


def _build(refs: DataFrame, min_docs: int, shards: int) -> DataFrame:
    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        while not (f := CuckooFilter.for_keys(max(2 * n, 64))).insert(pdf.k1.to_numpy(), pdf.k2.to_numpy()):
            n *= 2
        return pd.DataFrame({"shard": [key[0]], "buckets": [f.buckets], "cells": [f.cells.tobytes()]})

    hot = refs.filter(F.col("n") >= min_docs).withColumn("shard", _shard(F.col("k1"), shards))
    return hot.groupBy("shard").applyInPandas(build, FILTER_SCHEMA)


def empty_state(spark: SparkSession, min_docs: int = 10, shards: int = 1) -> LineState:
    return LineState(spark.createDataFrame([], "k1 long, k2 long, n long"), spark.createDataFrame([], FILTER_SCHEMA), shards, min_docs)


def _apply(state: LineState, docs: DataFrame, sign: int) -> LineState:
    """Counts of the batch are added to the table; keys that cross the threshold change their shard's filter."""
    delta = _counts(docs, sign).withColumn("d", F.col("n"))
    if state.refs.isEmpty():
        refs = stage(delta.filter("n > 0").select("k1", "k2", "n"), "op6-refs")
        hot = refs.filter(F.col("n") >= state.min_docs).count()
        shards = max(state.shards, -(-hot // SHARD_KEYS))
        return LineState(refs, stage(_build(refs, state.min_docs, shards), "op6-filters"), shards, state.min_docs)
    merged = stage(state.refs.withColumn("d", F.lit(0).cast("long")).unionByName(delta).groupBy("k1", "k2")
                   .agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "op6-refs")
    refs = merged.filter("n > 0").select("k1", "k2", "n")
    was, now = F.col("n") - F.col("d") >= state.min_docs, F.col("n") >= state.min_docs
    crossed = (merged.filter(was != now).select(_shard(F.col("k1"), state.shards).alias("shard"), "k1", "k2", now.alias("up")))

    def update(key: tuple, old: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        f = (CuckooFilter(int(old.buckets[0]), old.cells[0]) if len(old) else CuckooFilter.for_keys(max(2 * len(pdf), 64)))
        up, down = pdf[pdf.up], pdf[~pdf.up]
        f.delete(down.k1.to_numpy(), down.k2.to_numpy())
        ok = f.insert(up.k1.to_numpy(), up.k2.to_numpy())
        return pd.DataFrame({"shard": [key[0]], "buckets": [f.buckets], "cells": [f.cells.tobytes() if ok else b""]})

    filters = stage(state.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(update, FILTER_SCHEMA), "op6-filters")
    shards = state.shards
    if not filters.filter(F.length("cells") == 0).isEmpty():  # a filter is full: lay all out anew from the exact counts
        shards = max(2 * shards, -(-refs.filter(F.col("n") >= state.min_docs).count() // SHARD_KEYS))
        filters = stage(_build(refs, state.min_docs, shards), "op6-filters")
    return LineState(refs, filters, shards, state.min_docs)


def insert_documents(state: LineState, docs: DataFrame) -> LineState:
    return _apply(state, docs, 1)


def delete_documents(state: LineState, docs: DataFrame) -> LineState:
    """``docs`` must have been inserted before, with the same texts."""
    return _apply(state, docs, -1)


def _candidates(state: LineState, docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2) of the keys that pass the filters; all keys where the filters are too large to send."""
    size = state.filters.agg(F.coalesce(F.sum(F.length("cells")), F.lit(0))).first()[0]
    held = None
    if size <= BROADCAST_BYTES:
        held = {r["shard"]: (r["buckets"], bytes(r["cells"])) for r in state.filters.toLocalIterator()}
    sent, shards = docs.sparkSession.sparkContext.broadcast(held), state.shards

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {s: CuckooFilter(*f) for s, f in (sent.value or {}).items()}
        for whole in batches:
            for b in batches_of(whole, 1):
                keys = [[k for k in set(_keys(text)) if k] for text in _texts(b, 1)]
                k1, k2 = _halves([k for ks in keys for k in ks])
                hit = np.full(len(k1), sent.value is None)
                for s, f in filters.items():
                    here = np.flatnonzero(np.mod(k1, shards) == s)
                    hit[here] = f.contains(k1[here], k2[here])
                rows = np.repeat(np.arange(b.num_rows), [len(ks) for ks in keys])[hit]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(k1[hit]), pa.array(k2[hit])],
                                                 names=["doc_id", "k1", "k2"])

    idt = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {idt}, k1 long, k2 long")


def drop_lines(state: LineState, docs: DataFrame, counts: bool = False) -> DataFrame:
    """``docs`` without the lines whose key the state counts in ``min_docs`` documents or more.

    All columns stay; ``counts`` returns (doc_id, text, n_lines, n_dropped) instead.
    """
    hot = state.refs.filter(F.col("n") >= state.min_docs).select(F.col("k1").alias("h1"), F.col("k2").alias("h2"))
    sure = _candidates(state, docs).join(hot, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left_semi")
    per_doc = sure.groupBy(F.col("doc_id").alias("_op6_id")).agg(F.collect_set(F.struct("k1", "k2")).alias("_op6_hot"))
    if counts:
        docs = docs.select("doc_id", "text")
    joined = docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_op6_id")), "left").drop("_op6_id")
    names, at = docs.columns, docs.columns.index("text")
    added = ["n_lines", "n_dropped"] if counts else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in batches_of(whole, at):
                text, lines, gone = b.column(at).to_pylist(), [], []
                hot_of = b.column(len(names))
                for i, raw in enumerate(_texts(b, at)):
                    parts, drop = raw.split(b"\n"), 0
                    if hot_of[i].is_valid:
                        hot = {np.array([h["k1"], h["k2"]], np.int64).tobytes() for h in hot_of[i].as_py()}
                        kept = [p for p, k in zip(parts, _keys(raw)) if k not in hot]
                        drop = len(parts) - len(kept)
                        text[i] = b"\n".join(kept).decode()
                    lines.append(len(parts))
                    gone.append(drop)
                columns = [b.column(i) for i in range(len(names))]
                columns[at] = pa.array(text, b.column(at).type)
                if counts:
                    columns += [pa.array(lines, pa.int64()), pa.array(gone, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in added)])
    return joined.select(*names, "_op6_hot").mapInArrow(run, schema)


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
hot AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hot.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hot.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN hot USING (k) GROUP BY doc_id
"""


@query("op6_line_dedup", OP6_SQL)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    state = insert_documents(empty_state(spark, min_docs=10), docs)
    return drop_lines(state, docs, counts=True).select("doc_id", "n_lines", "n_dropped",
                                          F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
