"""Operator 1, exact substring dedup with a run-length index.

A byte goes when it lies in a string of ``WINDOW`` bytes that also starts at
another place of the corpus.  Every window of that length belongs to the
smallest hash among its ``GRAM``-byte grams, so equal windows meet under one
key, and runs of windows with one key are one segment of text.  Keys that occur
once cannot hold a repeated window and are dropped by a count; where all
segments of a key are the same string, all their windows repeat.  The other
keys' segments, each distinct segment once with its number of occurrences, are
dealt out by key.  Each task lays its segments end to end, sorts the suffixes,
and keeps of the Burrows-Wheeler transform its runs, with the suffix array
sampled at the runs' first and last rows.  At a run's ends the common prefix
with the neighbouring suffix is measured; everywhere else it is one less than
at the text position before, so one stream over the text gives the matching
statistic of every position against the rest of the index: the longest match
that starts there and elsewhere.  Windows whose statistic reaches ``WINDOW``
are marked.  A segment that occurs more than once is marked whole.

Texts are told apart by 128 bits of hash: documents with one text share their
spans, so a group of copies costs one text.

Edge cases: a null text is empty; texts shorter than the window lose nothing
and still match nothing; overlapping repeats within a document count; repeated
rows are documents of their own; null ids are kept; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.llm.common import ids_to_send, is_sent, read, stage
from cohortkit.llm.decontamination import grams
from cohortkit.llm.ragged import batches_of, mix64, text_buffer
from cohortkit.llm.registry import query

WINDOW, GRAM = 400, 128
#: Bytes of text that are hashed at a time, and the longest run of windows in a segment.
PART_BYTES, MAX_RUN = 1 << 19, 2048
#: Bytes of segments that one task indexes, on average.
SHARD_BYTES = 4 << 20
#: Bits of a place in an index; a task lays out its segments in indexes of that size, each key in one of them.
PLACE_BITS = 17
#: Texts up to which the list of wanted ones is sent to the tasks (8 bytes each).
SEND_TEXTS = 4_000_000
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of every w neighbours, by prefix and suffix minima of blocks of w."""
    n = len(x)
    block = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    block[:n] = x
    block = block.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - w + 1], ahead[w - 1:n])


def anchor_runs(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """(text, start in the text, windows, key, several) of the runs of windows with one key.

    ``several``: the key's gram occurs more than once in the run, so that it may hold a window twice.
    """
    out = []
    for a in range(0, max(len(data) - window, -1) + 1, PART_BYTES):
        x = data[a:a + PART_BYTES + window - 1]
        g = grams(x)
        for size in range(3, gram.bit_length() - 1):  # grams of 8, 16, ... bytes, two of them to one of the next
            both = g[:-(1 << size)] * _MULT[0]
            both += g[1 << size:] * _MULT[1]
            both ^= both >> np.uint64(31)
            g = both
        h = mix64(g)
        least = _sliding_min(h, window - gram + 1)
        n = len(least)
        # The texts of this part: where their windows begin here, and where the last whole one ends.
        first, last = np.searchsorted(offsets, [a, a + n - 1], "right") - 1
        begin = np.clip(offsets[first:last + 1] - a, 0, n)
        stop = np.clip(offsets[first + 1:last + 2] - window + 1 - a, 0, n)
        new = np.append(True, least[1:] != least[:-1])
        new[::MAX_RUN] = True
        new[begin[begin < n]] = True
        edges = np.flatnonzero(new)
        own = np.searchsorted(begin, edges, "right") - 1
        ends = np.minimum(np.append(edges[1:], n), stop[own])
        edges, own, ends = (z[ends > edges] for z in (edges, own, ends))
        if not len(edges):
            continue
        text = own + first
        keys = least[edges]
        # Places of the keys' grams: a table of their top bits first, then exact.
        table = np.zeros(1 << 20, bool)
        table[keys >> np.uint64(44)] = True
        places = np.flatnonzero(table[h >> np.uint64(44)])
        known = np.unique(keys)
        rank = np.minimum(np.searchsorted(known, h[places]), len(known) - 1)
        same = known[rank] == h[places]
        spot = np.sort(rank[same].astype(np.int64) << 32 | places[same])
        slot = np.searchsorted(known, keys).astype(np.int64) << 32
        count = (np.searchsorted(spot, slot | ends - 1 + window - gram, "right") - np.searchsorted(spot, slot | edges, "left"))
        out.append((text, edges + a - offsets[text], ends - edges, keys, count > 1))
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    return tuple(np.concatenate(x) for x in zip(*out))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling; only suffixes that still share their rank are sorted again.

    Below 2**17 bytes two ranks and a place fit in one number, and numbers are
    sorted several times faster than places by number; a small index also stays in
    the processor's cache.
    """
    n = len(text)
    code = grams(np.concatenate([text, np.zeros(7, np.uint8)])).byteswap()
    small, mask, place = n < 1 << PLACE_BITS, np.uint64((1 << PLACE_BITS) - 1), np.arange(n, dtype=np.uint64)

    def ordered(high: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, sort keys) in the order of the keys."""
        if small:
            both = np.sort(high << np.uint64(PLACE_BITS) | i)
            return (both & mask).astype(np.int64), both >> np.uint64(PLACE_BITS)
        order = np.argsort(high)
        return i[order].astype(np.int64), high[order]

    h = 5 if small else 8
    sa, key = ordered(code >> np.uint64(24) if small else code, place)
    new = np.append(True, key[1:] != key[:-1])
    rank = np.zeros(n + 1, np.uint64)
    first = np.flatnonzero(new)
    rank[sa] = np.repeat(first, np.diff(np.append(first, n))).astype(np.uint64) + np.uint64(1)
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
    shift = np.uint64(PLACE_BITS + 1 if small else 32)
    while len(open_):
        i = sa[open_]
        i, key = ordered(rank[i] << shift | rank[np.minimum(i + h, n)], i.astype(np.uint64))
        sa[open_] = i
        # Ranks of one old group are consecutive rows, so a row's place in open_ is its place in the array.
        new = np.append(True, key[1:] != key[:-1])
        first = np.flatnonzero(new)
        rank[i] = open_[np.repeat(first, np.diff(np.append(first, len(i))))].astype(np.uint64) + np.uint64(1)
        open_ = open_[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


class RunIndex:
    """Run-compressed Burrows-Wheeler transform with the suffix array at both ends of every run."""

    def __init__(self, text: np.ndarray):
        self.text = text
        sa = suffix_array(text)
        bwt = text[sa - 1].astype(np.int16)
        bwt[sa == 0] = -1
        head = np.flatnonzero(np.append(True, bwt[1:] != bwt[:-1]))
        tail = np.append(head[1:], len(sa)) - 1
        self.symbols, self.lengths = bwt[head], np.diff(np.append(head, len(sa)))
        self.first, self.last = sa[head], sa[tail]

    def _common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at i and j."""
        g = grams(np.concatenate([self.text, np.zeros(15, np.uint8)]))
        out, live = np.zeros(len(i), np.int64), np.arange(len(i))
        n = len(self.text)
        while len(live):
            x = g[np.minimum(i[live] + out[live], n)] ^ g[np.minimum(j[live] + out[live], n)]
            over = np.maximum(i[live], j[live]) + out[live] >= n
            ends = (x != 0) | over
            low = x & (~x + np.uint64(1))
            step = np.where(x != 0, np.log2(np.where(low > 0, low, 1).astype(np.float64)).astype(np.int64) // 8, np.where(over, 0, 8))
            out[live] += step
            live = live[~ends]
        return np.minimum(out, n - np.maximum(i, j))

    def statistics(self) -> np.ndarray:
        """For every position, the longest match that starts there and at another position."""
        n = len(self.text)
        best, place = np.zeros(n, np.int64), np.arange(n)
        before, after = self.last[:-1], self.first[1:]
        lcp = self._common(before, after)
        # A run's first row against the row before it, and a run's last row against the row after it.
        for at, edge in ((after, self.first[0]), (before, self.last[-1])):
            sample = np.full(n, -1, np.int64)
            sample[at] = lcp
            sample[edge] = 0
            known = np.maximum.accumulate(np.where(sample >= 0, place, 0))
            best = np.maximum(best, sample[known] - (place - known))
        return best


def mark(segments: list[bytes], weights: list[int], several: list[bool], keys: list[int], window: int = WINDOW) -> list[np.ndarray]:
    """Of each distinct segment, a flag for every window: does it start anywhere else?"""
    out = [np.full(len(s) - window + 1, w > 1) for s, w in zip(segments, weights)]
    size: dict[int, int] = {}
    for k in keys:
        size[k] = size.get(k, 0) + 1
    chosen = sorted((i for i, k in enumerate(keys) if size[k] > 1 or (several[i] and weights[i] == 1)), key=lambda i: keys[i])
    for group in _indexes(chosen, segments, keys):
        text = np.frombuffer(b"\xff".join(segments[i] for i in group) + b"\xff", np.uint8)
        found = RunIndex(text).statistics() >= window
        a = 0
        for i in group:
            out[i] |= found[a:a + len(out[i])]
            a += len(segments[i]) + 1
    return out


def _indexes(chosen: list[int], segments: list[bytes], keys: list[int]) -> Iterator[list[int]]:
    """The chosen segments in groups of whole keys, below 2**17 bytes where a key allows it."""
    group, size = [], 0
    for _, own in itertools.groupby(chosen, key=lambda i: keys[i]):
        own = list(own)
        n = sum(len(segments[i]) + 1 for i in own)
        if group and size + n >= 1 << PLACE_BITS:
            yield group
            group, size = [], 0
        group += own
        size += n
    if group:
        yield group


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def _runs(texts: DataFrame, window: int) -> DataFrame:
    """Runs of windows of every row (t1, t2, text); ``digest`` is 64 bits of the segment's hash, beside the key's 64."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in batches_of(whole, 2):
                data, offsets = text_buffer(b.column(2))
                row, start, n, key, several = anchor_runs(data, offsets, window=window)
                raw, at = memoryview(data), offsets[row] + start
                digests = [hashlib.blake2b(raw[i:e], digest_size=8).digest() for i, e in zip(at.tolist(), (at + n + window - 1).tolist())]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(start, pa.int64()), pa.array(n, pa.int32()),
                     pa.array(key.view(np.int64)), pa.array(np.frombuffer(b"".join(digests), np.int64)), pa.array(several)],
                    names=["t1", "t2", "start", "n", "key", "digest", "several"])

    return texts.select("t1", "t2", "text").mapInArrow(
        run, "t1 long, t2 long, start long, n int, key long, digest long, several boolean")


def _cut(window: int):
    """Segments of the texts (text, list of (key, digest, start, n)): (key, digest, segment)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text, rows = b.column(0)[i].as_buffer(), b.column(1)[i].as_py()
                cut = [text[r["start"]:r["start"] + r["n"] + window - 1].to_pybytes() for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["key"] for r in rows], pa.int64()), pa.array([r["digest"] for r in rows], pa.int64()), pa.array(cut, pa.binary())],
                    names=["key", "digest", "segment"])
    return run


def _only(texts: DataFrame, sent) -> DataFrame:
    """Rows (t1, t2, text) of the texts that were sent, before anything is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(is_sent(sent, b.column(0).to_numpy())))

    return texts.select("t1", "t2", "text").mapInArrow(run, "t1 long, t2 long, text binary")


def _index_shard(window: int):
    """Marks of one task's segments: (key, digest, first marked window, end)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = list(batches)
        if not sum(b.num_rows for b in table):
            return
        key, digest, w, several, segment = (list(itertools.chain.from_iterable(b.column(i).to_pylist() for b in table)) for i in range(5))
        marks = mark(segment, w, several, key, window)
        rows = [(k, d, a, e) for k, d, m in zip(key, digest, marks) for a, e in _spans(m)]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*rows)],
                names=["key", "digest", "a", "e"])
    return run


def _kept(text: memoryview, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    """(removed bytes, maximal removed runs, digest of the rest)."""
    sha, at, gone, n = hashlib.sha256(), 0, 0, 0
    for a, e in sorted(spans):
        if a > at or not n:
            sha.update(text[at:a])
            n += 1
            gone += e - a
        else:
            gone += max(0, e - at)
        at = max(at, e)
    sha.update(text[at:])
    return gone, n, sha.hexdigest()


def _untouched(sent):
    """(doc_id, t1, t2, n_bytes, text, digest): the digest of texts without spans, the text of the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = is_sent(sent, b.column(1).to_numpy())
            texts = [v.as_buffer() for v in b.column(3)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([len(t) for t in texts], pa.int64()),
                 pc.if_else(pa.array(hit), b.column(3), pa.scalar(None, pa.binary())),
                 pa.array([None if h else hashlib.sha256(t).hexdigest() for t, h in zip(texts, hit)], pa.string())],
                names=["doc_id", "t1", "t2", "n_bytes", "text", "sha"])
    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_bytes, text, digest, spans) to the digest of what is left."""
    for b in batches:
        out = []
        for sha, text, spans in zip(b.column(3).to_pylist(), b.column(2), b.column(4)):
            if sha is not None:
                out.append((0, 0, sha))
            else:
                out.append(_kept(memoryview(text.as_buffer()), [(s["a"], s["e"]) for s in spans.as_py() or ()]))
        gone, n, sha = zip(*out) if out else ((),) * 3
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in (gone, n)), pa.array(sha, pa.string())],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(t1, t2, spans): for each text with repeats the byte spans [a, e) that repeated windows cover."""
    texts = _named(docs)
    runs = stage(_runs(texts, window), "op1-runs")
    keys = (runs.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("c"), F.min("digest").alias("d0"), F.max("digest").alias("d1"), F.max("several").alias("s"))
            .filter((F.col("c") > 1) | F.col("s")).select("k", ((F.col("d0") != F.col("d1")) | F.col("s")).alias("mixed")))
    # Copies of a text have the same runs: one row per text, with the number of its copies.
    met = stage(runs.join(keys, F.col("key") == F.col("k")).groupBy("t1", "t2", "key", "digest", "start", "n", "several", "mixed")
                .agg(F.count("*").alias("w")), "op1-met")
    mixed = met.filter("mixed")
    distinct = (mixed.groupBy("key", "digest").agg(F.sum("w").alias("w"), F.max("several").alias("several"),
                                                   F.min(F.struct("t1", "t2", "start", "n")).alias("at")))
    distinct = stage(distinct, "op1-distinct")
    holders = distinct.groupBy(F.col("at.t1").alias("h1"), F.col("at.t2").alias("h2")).agg(
        F.collect_list(F.struct("key", "digest", F.col("at.start").alias("start"), F.col("at.n").alias("n"))).alias("rows"))
    sent = ids_to_send(distinct.select("at.t1").distinct(), SEND_TEXTS)
    held = (_only(texts, sent).dropDuplicates(["t1", "t2"]).join(holders, (F.col("t1") == F.col("h1")) & (F.col("t2") == F.col("h2"))))
    cuts = held.select("text", "rows").mapInArrow(_cut(window), "key long, digest long, segment binary")
    numbers = distinct.select(F.col("key").alias("k"), F.col("digest").alias("d"), "w", "several")
    segments = stage(cuts.join(numbers, (F.col("key") == F.col("k")) & (F.col("digest") == F.col("d")))
                     .select("key", "digest", "w", "several", "segment"), "op1-segments")
    size = segments.agg(F.coalesce(F.sum(F.length("segment")), F.lit(0))).first()[0]
    marks = (segments.repartition(max(1, -(-size // SHARD_BYTES)), "key")
             .mapInArrow(_index_shard(window), "key long, digest long, a long, e long")
             .select(F.col("key").alias("k"), F.col("digest").alias("d"), "a", "e"))
    found = mixed.join(marks, (F.col("key") == F.col("k")) & (F.col("digest") == F.col("d"))).select("t1", "t2", "start", "a", "e")
    same = met.filter(~F.col("mixed")).select("t1", "t2", "start", F.lit(0).cast("long").alias("a"), F.col("n").cast("long").alias("e"))
    return stage(found.unionByName(same).groupBy("t1", "t2").agg(F.collect_list(F.struct(
        (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("e") + (window - 1)).alias("e"))).alias("spans")), "op1-spans")


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, text as bytes); the two hashes name the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), F.encode(text, "UTF-8").alias("text"))


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    spans, texts = repeated_spans(docs, window), _named(docs)
    idt = docs.schema["doc_id"].dataType.simpleString()
    sent = ids_to_send(spans.select("t1").distinct(), SEND_TEXTS)
    rows = texts.mapInArrow(_untouched(sent), f"doc_id {idt}, t1 long, t2 long, n_bytes long, text binary, sha string")
    spans = spans.select(F.col("t1").alias("s1"), F.col("t2").alias("s2"), "spans")
    joined = rows.join(spans, (F.col("t1") == F.col("s1")) & (F.col("t2") == F.col("s2")), "left")
    return joined.select("doc_id", "n_bytes", "text", "sha", "spans").mapInArrow(
        _remove, f"doc_id {idt}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


@query("op1_substring_index")
def op1_substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
