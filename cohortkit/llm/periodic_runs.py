"""Operator 13, periodic run detection: the branching-tandem test on an enhanced suffix array.

A run is a stretch of words with smallest period q (words q apart are
identical) that is long enough and that no neighbouring word extends.  Every
maximal repetition ends in exactly one branching square: two equal stretches of
d words at i and i + d whose suffixes share exactly d words.  A task lays the
words of some texts out as one array and builds its suffix array by prefix
doubling, where only suffixes that still tie are sorted again.  Ranks of all
doublings answer both "how many words do these suffixes share" (the LCP array)
and "how many words before these places are equal".  LCP intervals and their
children are index ranges of that array, found by binary lifting over its range
minima; no tree is made.  Of each interval at depth d all suffixes but those of
its largest child look up the ranks of i + d and i - d: a place in the same
interval but another child gives a branching square.  All squares are rotated
to the left together as far as the words allow, which gives the run, and of
runs over the same stretch the least period stays.

Edge cases: null and empty texts, and those of white space, have no words and
no runs; rows that repeat an id are judged one by one; a null id stays null;
extra columns are not read.  A text is handled whole; texts share a task's
arrays up to ``limit`` bytes, a longer one has arrays of its own, of about 8
bytes a word and doubling.  Words are compared as they are, not by a hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.llm.common import SPACE, let, read
from cohortkit.llm.ragged import batches_of
from cohortkit.llm.registry import query

SCHEMA = ("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
          "collapsed_sha256 string, n_words long, n_kept long")


def suffix_ranks(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks by doubling) of the words ``ids``; ``ends`` is where each word's text ends.

    Texts share no ids.  Rank k of two places is equal exactly if the 2^k words from there are.
    """
    n = len(ids)
    sa = np.argsort(ids, kind="stable").astype(np.int32)
    new = np.append(True, ids[sa][1:] != ids[sa][:-1])
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, h = [rank], 1
    while True:
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, n))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            return sa, levels
        at, rank = sa[tied], levels[-1]
        # The 2^k words behind the shared ones; a suffix that ends there comes first.
        behind = np.where(at + h < ends[at], rank[np.minimum(at + h, n - 1)].astype(np.int64) + 1, 0)
        key = rank[at].astype(np.int64) * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        sa[tied], key = at[order], key[order]
        cut = np.append(True, key[1:] != key[:-1])
        new[tied] = cut
        rank = rank.copy()
        rank[sa[tied]] = np.maximum.accumulate(np.where(cut, tied, 0))
        if len(np.unique(rank[sa[tied]])) == len(tied):
            return sa, levels + [rank]
        levels.append(rank)
        h *= 2


def shared_words(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """LCP array: the number of words that the suffixes at places k - 1 and k of the suffix array share; 0 first."""
    n = len(sa)
    out = np.zeros(n, np.int32)
    pair = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    a, b, got = sa[pair - 1].astype(np.int64), sa[pair].astype(np.int64), np.zeros(len(pair), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.maximum(a, b) + got < n
        i = np.flatnonzero(inside)
        i = i[levels[k][a[i] + got[i]] == levels[k][b[i] + got[i]]]
        got[i] += 1 << k
    out[pair] = got
    return out


def _minima(lcp: np.ndarray) -> list[np.ndarray]:
    """Least value of every window of 2^k entries, by its first entry."""
    out, k = [lcp], 1
    while 2 * k <= len(lcp):
        out.append(np.minimum(out[-1][:-k], out[-1][k:]))
        k *= 2
    return out


def _reach(minima: list[np.ndarray], at: np.ndarray, least: np.ndarray, right: bool) -> np.ndarray:
    """From place ``at`` on (or before it) the first entry below ``least``; the end (or 0) if there is none."""
    n, p = len(minima[0]), at.copy()
    for k in range(len(minima) - 1, -1, -1):
        first = p if right else p - (1 << k)
        ok = (first >= 0) & (first + (1 << k) <= n)
        i = np.flatnonzero(ok)
        i = i[minima[k][first[i]] >= least[i]]
        p[i] += (1 << k) if right else -(1 << k)
    return p if right else np.maximum(p - 1, 0)


def smaller_children(lcp: np.ndarray) -> tuple[np.ndarray, ...]:
    """(depth, interval from, to, child from, to) of all children but the largest of each LCP interval."""
    edge = np.flatnonzero(lcp)
    if not len(edge):
        return (edge,) * 5
    minima, depth = _minima(lcp), lcp[edge]
    lo, hi = _reach(minima, edge, depth, False), _reach(minima, edge + 1, depth, True)
    before, behind = _reach(minima, edge, depth + 1, False), _reach(minima, edge + 1, depth + 1, True)
    # Every edge between children has a child before it; the last one also a child behind it.
    last = behind == hi
    depth, lo, hi, a, b = (np.concatenate([x, y[last]]) for x, y in ((depth, depth), (lo, lo), (hi, hi), (before, edge), (edge, behind)))
    # Depth and first place name an interval.
    order = np.lexsort((a, a - b, depth, lo))
    depth, lo, hi, a, b = (x[order] for x in (depth, lo, hi, a, b))
    rest = np.append(False, (lo[1:] == lo[:-1]) & (depth[1:] == depth[:-1]))
    return tuple(x[rest] for x in (depth, lo, hi, a, b))


def branching_squares(sa: np.ndarray, lcp: np.ndarray, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of every square whose two halves' suffixes share exactly the period."""
    n = len(sa)
    isa = np.empty(n, np.int64)
    isa[sa] = np.arange(n)
    depth, lo, hi, a, b = smaller_children(lcp)
    places, periods = [], []
    # Slices of about ``chunk`` suffixes.
    done = np.append(0, np.cumsum(b - a))
    s = 0
    while s < len(a):
        e = max(s + 1, int(np.searchsorted(done, done[s] + chunk, "right")) - 1)
        size = (b - a)[s:e]
        row = np.repeat(np.arange(s, e), size)
        i = sa[a[row] + np.arange(len(row)) - np.repeat(done[s:e] - done[s], size)].astype(np.int64)
        for step in (1, -1):
            j = i + step * depth[row]
            ok = np.flatnonzero((j >= 0) & (j < n))
            r, at = row[ok], isa[j[ok]]
            ok = ok[(at >= lo[r]) & (at < hi[r]) & ((at < a[r]) | (at >= b[r]))]
            places.append(np.minimum(i[ok], j[ok]))
            periods.append(depth[row[ok]].astype(np.int64))
        s = e
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def find_runs(ids: np.ndarray, ends: np.ndarray, min_words: int = 6, min_times: int = 4) -> np.ndarray:
    """Rows (start, length, period) of the runs of at least ``min_words`` words and ``min_times`` (2 or more) periods."""
    if not len(ids):
        return np.zeros((0, 3), np.int64)
    sa, levels = suffix_ranks(ids, ends)
    i, d = branching_squares(sa, shared_words(sa, levels))
    # All squares are rotated to the left together, as long as the word before equals the one a period later.
    turned = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        at = i - turned - (1 << k)
        ok = np.flatnonzero(at >= 0)
        ok = ok[levels[k][at[ok]] == levels[k][at[ok] + d[ok]]]
        turned[ok] += 1 << k
    runs = np.column_stack([i - turned, 2 * d + turned, d])
    runs = runs[runs[:, 1] >= np.maximum(min_words, min_times * d)]
    # The same stretch under multiples of its period: the least stays.
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    runs = runs[np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))[:len(runs)]]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _row(words: list[bytes], runs: np.ndarray) -> tuple:
    if not len(runs):
        return 0, None, None, None, None, _sha(b""), _sha(b" ".join(words)), len(words), len(words)
    best = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
    drop = np.zeros(len(words) + 1, np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
    kept = [words[k] for k in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist())
    return len(runs), *best, 1000 * best[1] // best[2], _sha(listed.encode()), _sha(b" ".join(kept)), len(words), len(kept)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 6, min_times: int = 4,
                  limit: int = 1 << 20) -> DataFrame:
    """A row per row of ``docs``: its runs, the longest of them, and digests of the list and of the text without repeats.

    Columns: doc_id, those of the longest run (ties: least start, then period), ``runs_sha256`` of every run's
    ``start,length,period`` and a newline by start and period, ``collapsed_sha256`` of the words that stay when each
    run keeps its first period, n_words and n_kept.  A narrow pass.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in batches_of(whole, 1, limit):
                texts = [(t or b"").split() for t in b.column(1).to_pylist()]  # bytes: at ASCII white space only
                size = np.array([len(t) for t in texts])
                doc = np.repeat(np.arange(len(texts)), size)
                words = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
                known = max(1, len(words.dictionary))
                ids = doc * known + words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(size)
                runs = find_runs(ids, ends[doc], min_words, min_times)
                cut = np.searchsorted(runs[:, 0], np.append(0, ends))
                rows = [_row(t, runs[cut[k]:cut[k + 1]] - [int(ends[k]) - len(t), 0, 0]) for k, t in enumerate(texts)]
                cols = list(zip(*rows))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))],
                                                 names=["doc_id", *(f.split()[0] for f in SCHEMA.split(", "))])

    idt = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"doc_id {idt}, {SCHEMA}")


def planted(text: Column, doc_id: Column) -> Column:
    """The contract's text: a tenth of the ids, by their hash, repeat a stretch of words until the end."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeat(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), 1, n - a)
        return F.array_join(F.concat(F.slice(words, 1, a), tail), " ")

    return F.when((h % 10 == 0) & (body != ""), let(F.split(body, r"[\x20\x09-\x0D]+"), repeat)).otherwise(text)


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return periodic_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")))
