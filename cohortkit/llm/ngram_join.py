"""Operator 10, n-gram Jaccard join: adaptive multi-match prefixes.

A document's set is its distinct five-word shingles.  Equal sets are one node
of the graph.  Under a global order of shingles, two sets that link share at
least ``l`` shingles among their first ``n - ceil(0.8 n) + l`` ones, for every
``l``.  A first pass counts the shingles among every document's first ones in
hash order; the frequent ones (the most frequent four million of them at most)
come last in the global order, by their counts.  Each node picks the ``l`` with
the least estimated cost (postings read plus candidates expected from the
counts), and the longer its
prefix, the more shared prefix shingles a pair must have to be verified: what
both prefixes hold is counted, what lies behind them is at most the shorter
rest, and the sum must reach the overlap that the pair's sizes ask for.

Every posting also carries a parity bitmap of its whole set: a bit says whether
an odd number of shingles fell on it.  The bits in which two bitmaps differ are
at most the shingles that only one of the sets has, and a link allows
(n + m) (100 - 80) / (100 + 80) of those.  The test is part of the join
condition of candidates and pivots, so that near misses around a shared passage
never become rows, and it loses no link.  Sets of more than 64 shingles have a
wider bitmap besides.

Components need no pair within them: first every posting list links its nodes
to one pivot, the verified stars are contracted, and what is left are pairs
between different components, which all go through the filter.  While those
are too many and pivots still remove a good part of them, more are tried first: every posting list is then dealt at
random into parts with a pivot each, so that a node meets as many of a large
component's members as it has prefix shingles.  So a large group of near copies
costs its size, not its square, and no link that joins different components
is lost.

Edge cases: without words a document has an empty set and is linked with
nothing; with fewer than five its whole sequence is the only shingle; null ids
are kept with the component of the other ids that they link with, null if there
are none; rows that repeat an id are documents of their own; extra columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.llm.common import WORD, ids_to_send, is_sent, read, stage, unstage
from cohortkit.llm.components import components
from cohortkit.llm.ragged import batches_of, shingles, word_hashes
from cohortkit.llm.registry import query

#: Documents from which a shingle counts as frequent, and the longest multiple match that is tried.
FREQUENT, MAX_MATCH = 3, 6
#: Bits of the bitmap that every set has, and of the second one of sets with more shingles than ``WIDE_FROM``.
BITS, WIDE_BITS, WIDE_FROM = 256, 1024, 64
PARITY = [f"s{i}" for i in range(BITS // 64)] + ["wide"]
#: Nodes up to which the list of wanted sets is sent to the tasks (8 bytes each).
SEND_NODES = 4_000_000
#: The same for prefix shingles that several nodes hold, and for frequent ones with their counts.
SEND_TOKENS = 4_000_000
#: More pivots are tried while the pairs left are this many times the posting rows (to test that many on their bitmaps costs
#: about what a round costs), the last ones linked this share of the pairs they were tried on and removed this share of the
#: pairs left before them, but not without end.
MANY_PAIRS, FRUITFUL, REMOVED, MAX_PIVOT_ROUNDS = 256, 0.2, 0.1, 5
#: After the first round, a posting list has a pivot for so many of its nodes.
PER_PIVOT = 32


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for whole in batches:
        for b in batches_of(whole, whole.num_columns - 1):
            words, at = word_hashes(b.column(b.num_columns - 1))
            yield b, [np.unique(shingles(words[at[i]:at[i + 1]])) for i in range(b.num_rows)]


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _nodes(digests: list[bytes]) -> np.ndarray:
    """The first eight bytes of each digest as a signed number; only a full digest names a set."""
    return np.frombuffer(b"".join(digests), ">i8")[::2].astype(np.int64)


def _scan(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, t, n, digest, prefix) of every document: hash of its text, its set, its first shingles in hash order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _sets(batches):
            # Somewhat more than a prefix: where frequent shingles are put last, others move up into it.
            first = [s[:(len(s) - needed(len(s), percent) + 1) * 3 // 2] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()),
                 pa.array([f.view(np.int64) for f in first], pa.list_(pa.int64()))], names=["doc_id", "t", "n", "digest", "prefix"])

    idt = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(
        run, f"doc_id {idt}, t long, n long, digest binary, prefix array<long>")


def _frequent(scan: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles, sorted, and their counts; of too many the more frequent ones."""
    counts = stage(scan.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
                   .filter(F.col("df") >= FREQUENT), "op10-frequent")
    least = FREQUENT
    while counts.filter(F.col("df") >= least).count() > SEND_TOKENS:
        least *= 2
    found = counts.filter(F.col("df") >= least).toArrow()
    unstage(counts)
    token, df = (found.column(i).to_numpy().astype(np.int64) for i in range(2))
    order = np.argsort(token)
    return token[order], df[order]


def _counts(sets: list[np.ndarray], token: np.ndarray, df: np.ndarray) -> list[np.ndarray]:
    """The known counts of each set's shingles, 0 for the others."""
    flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
    if not len(token):
        return [np.zeros(len(s), np.int64) for s in sets]
    at = np.minimum(np.searchsorted(token, flat), len(token) - 1)
    return np.split(np.where(token[at] == flat, df[at], 0), np.cumsum([len(s) for s in sets])[:-1])


def parity(s: np.ndarray, bits: int) -> np.ndarray:
    """Per bit whether an odd number of the set's shingles falls on it, as signed 64-bit numbers."""
    odd = (np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _may_link(x: str, y: str, percent: int) -> Column:
    """Do the bitmaps of two rows (prefixes of their columns) allow a link?"""
    differ = sum((F.bit_count(F.col(f"{x}s{i}").bitwiseXOR(F.col(f"{y}s{i}"))) for i in range(BITS // 64)), F.lit(0))
    xor = F.zip_with(f"{x}wide", f"{y}wide", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    wide = F.aggregate(xor, F.lit(0), lambda a, b: a + b)
    limit = (100 - percent) * (F.col(f"{x}n").cast("long") + F.col(f"{y}n"))
    return ((100 + percent) * differ <= limit) & F.coalesce((100 + percent) * wide <= limit, F.lit(True))


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of size n with any set that it links with."""
    return -(-n * percent // 100)


def plan_prefix(s: np.ndarray, df: np.ndarray, percent: int) -> tuple[np.ndarray, int, int]:
    """(prefix, l, heat) of a sorted set; ``df`` holds each shingle's count, 0 for rare ones."""
    n, base = len(s), len(s) - needed(len(s), percent)
    order = np.lexsort((s, df))
    heat = int((df > 0).sum())
    top = min(MAX_MATCH, n - base)
    d = df[order[:base + top]].astype(np.float64)
    read_cost = np.cumsum(d + 1)[base:]
    # Expected candidates: with l matches wanted, each needs l of the postings read.
    matches = np.arange(1, top + 1)
    l = int(np.argmin(read_cost + 20 * np.cumsum(d)[base:] / matches ** 2)) + 1
    return s[order[:base + l]], l, heat


def _prefixes(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> DataFrame:
    """(node, n, heat, last, parity bitmaps, prefix) of every set; ``last`` is the prefix's end in the global order."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches):
            sets = [s for s in sets if len(s)]
            if not sets:
                continue
            plans = [plan_prefix(s, df, percent) for s, df in zip(sets, _counts(sets, *sent.value))]
            ends = np.array([p[0][-1] for p in plans], np.uint64)
            # The end in the global order, as far as one number holds it: count, then upper bits of the hash.
            df = np.minimum(np.concatenate(_counts([e[None] for e in ends], *sent.value)), (1 << 23) - 1)
            last = df << 40 | np.where(df == (1 << 23) - 1, 0, (ends >> np.uint64(24)).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(_nodes([_digest(s) for s in sets])), pa.array([len(s) for s in sets], pa.int32()),
                 pa.array([p[2] for p in plans], pa.int32()), pa.array(last), *(pa.array(c) for c in np.array([parity(s, BITS) for s in sets]).T.copy()),
                 pa.array([parity(s, WIDE_BITS) if len(s) > WIDE_FROM else None for s in sets], pa.list_(pa.int64())),
                 pa.array([p[0].view(np.int64) for p in plans], pa.list_(pa.int64()))],
                names=["node", "n", "heat", "last", *PARITY, "prefix"])

    longs = ", ".join(f"{c} long" for c in PARITY[:-1])
    return docs.select("text").mapInArrow(run, f"node long, n int, heat int, last long, {longs}, wide array<long>, prefix array<long>")


def _posts(plans: DataFrame) -> DataFrame:
    """(token, node, pos, n, p, heat, last, bitmaps): the prefix shingles that two nodes or more hold."""
    tokens = plans.select("node", F.posexplode("prefix").alias("pos", "token"))
    # Copies of a set are one node, so a shingle is shared when its least and its largest node differ.
    shared = stage(tokens.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b").select("token"), "op10-shared")
    sent = ids_to_send(shared, SEND_TOKENS)
    if sent is not None:  # the rest never leaves its task
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                off, token = b.column(1).offsets.to_numpy(), b.column(1).flatten().to_numpy()
                row = np.repeat(np.arange(b.num_rows), np.diff(off))
                hit = is_sent(sent, token)
                pos = np.arange(len(token)) - (off - off[0])[row]
                yield pa.RecordBatch.from_arrays([pa.array(token[hit]), b.column(0).take(pa.array(row[hit])), pa.array(pos[hit], pa.int32())],
                                                 names=["token", "node", "pos"])

        held = plans.select("node", "prefix").mapInArrow(run, "token long, node long, pos int")
    else:
        held = tokens.join(shared, "token", "left_semi").select("token", "node", "pos")
    # Sets with one 64-bit node name but other bitmaps stay apart.
    sizes = plans.select(F.col("node").alias("_n"), "n", "heat", "last", F.size("prefix").alias("p"), *PARITY).dropDuplicates(["_n", "n", "last", *PARITY])
    out = stage(held.distinct().join(sizes, F.col("node") == F.col("_n")).select("token", "node", "pos", "n", "p", "heat", "last", *PARITY), "op10-posts")
    unstage(plans, shared)
    return out


def _wanted_sets(docs: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, digest, set, half) of the wanted nodes, one row per digest; ``half`` has the shingles' upper halves.

    Only the texts of wanted sets become shingles again; all others stay out before that.
    """
    asked = stage(members.filter("n > 0").join(nodes, _node_of(F.col("digest")) == F.col("a"), "left_semi").select("t").distinct(), "op10-wanted")
    sent = ids_to_send(asked, SEND_NODES)
    unstage(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            held = whole.filter(pa.array(is_sent(sent, whole.column(0).to_numpy())))
            if not held.num_rows:
                continue
            for _, sets in _sets([held]):
                sets = [s for s in sets if len(s)]
                digests = [_digest(s) for s in sets]
                half = [np.unique((s >> np.uint64(32)).astype(np.uint32)).view(np.int32) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_nodes(digests)), pa.array(digests, pa.binary()),
                     pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(half, pa.list_(pa.int32()))],
                    names=["node", "digest", "set", "half"])

    out = docs.select(F.xxhash64("text").alias("t"), "text").mapInArrow(
        run, "node long, digest binary, set array<long>, half array<int>").dropDuplicates(["digest"])
    return out if sent is not None else out.join(nodes.withColumnRenamed("a", "node"), "node", "left_semi")


def _verified(docs: DataFrame, members: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between digests of the staged candidate pairs (a, b) of nodes; these are removed."""
    nodes = pairs.select("a").union(pairs.select("b"))
    sets = stage(_wanted_sets(docs, members, nodes), "op10-sets")
    # First on half hashes: what they have in common, and those that fell together, bound the overlap from above.
    n = F.size("set").alias("n")
    one = sets.select(F.col("node").alias("a"), F.col("digest").alias("u"), F.col("half").alias("ha"), n).withColumnRenamed("n", "na")
    two = sets.select(F.col("node").alias("b"), F.col("digest").alias("v"), F.col("half").alias("hb"), n).withColumnRenamed("n", "nb")
    most = (F.size(F.array_intersect("ha", "hb")) + F.col("na") - F.size("ha")).cast("long")
    near = stage(pairs.join(one, "a").join(two, "b").filter(100 * most >= percent * (F.col("na") + F.col("nb") - most)).select("u", "v"), "op10-near")
    one = sets.select(F.col("digest").alias("u"), F.col("set").alias("sa"))
    two = sets.select(F.col("digest").alias("v"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    links = stage(near.join(one, "u").join(two, "v").filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both))
                  .select("u", "v"), "op10-links")
    unstage(sets, near, pairs)
    return links


def _between(posts: DataFrame, done: DataFrame) -> tuple[DataFrame, int, int]:
    """The posting lists that still hold several components; their pairs between components, and their rows."""
    labels = done.select(_node_of(F.col("node")).alias("_n"), _node_of(F.col("component")).alias("comp"))
    # Two digests with one 64-bit node would share a label: such nodes stay unlabelled and are compared again.
    labels = labels.groupBy("_n").agg(F.count("*").alias("k"), F.first("comp").alias("comp")).filter("k = 1").drop("k")
    named = posts.join(labels, F.col("node") == F.col("_n"), "left").drop("_n").withColumn("comp", F.coalesce("comp", "node"))
    mixed = (named.groupBy(F.col("token").alias("t")).agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("held"))
             .filter("c0 <> c1").select("t", "held"))
    live = stage(named.join(mixed, F.col("token") == F.col("t")).drop("t"), "op10-live")
    sizes = live.groupBy("token", "comp").agg(F.count("*").cast("double").alias("m")).groupBy("token").agg(
        ((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))) / 2).alias("p"), F.sum("m").alias("m"))
    left = sizes.agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("p"), F.coalesce(F.sum("m"), F.lit(0.0)).alias("m")).first()
    return live, int(left.p), int(left.m)


def _candidates(live: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes in different components that can still reach their overlap.

    A pair of sizes n and m that shares o shingles shares one among the first n - o + 1 and m - o + 1 of them; for
    equal sizes that is about half of a prefix, and only postings there make rows.  ``c`` of them are shared, and
    what else is shared lies behind the last of these in both sets.
    """
    x, y = live.alias("x"), live.alias("y")
    # One shared shingle at places i and j leaves the lesser place before it and the shorter rest behind it.
    i, j, n, m = F.col("x.pos"), F.col("y.pos"), F.col("x.n"), F.col("y.n")
    most = F.least(i, j) + F.least(n - i, m - j)
    early = ((100 + percent) * (n - i) >= percent * (n + m)) & ((100 + percent) * (m - j) >= percent * (n + m))
    pairs = (x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") < F.col("y.comp")) & early
                    & _long_enough(n, m, percent) & ((100 + percent) * most >= percent * (n + m)) & _may_link("x.", "y.", percent))
             .groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
             .agg(F.count("*").alias("c"), F.max("x.pos").alias("i"), F.max("y.pos").alias("j"), F.first("x.n").alias("n"), F.first("y.n").alias("m")))
    rest = F.least(F.col("n") - F.col("i") - 1, F.col("m") - F.col("j") - 1)
    return pairs.filter((100 + percent) * (F.col("c") + rest) >= percent * (F.col("n") + F.col("m"))).select("a", "b")


def _reaching(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose shared prefix shingles and the rest behind them can reach their overlap."""
    rest = F.least(F.col("x_n") - F.when(F.col("x_last") < F.col("y_last"), F.col("x_p")).otherwise(F.col("i") + 1),
                   F.col("y_n") - F.when(F.col("y_last") < F.col("x_last"), F.col("y_p")).otherwise(F.col("j") + 1))
    return pairs.filter((100 + percent) * (F.col("c") + rest) >= percent * (F.col("x_n") + F.col("y_n"))).select("a", "b")


def _counted(pairs: DataFrame, posts: DataFrame, percent: int) -> DataFrame:
    """Given pairs that can reach their overlap, from all prefix shingles that they share."""
    x = posts.select(F.col("node").alias("a"), "token", *(F.col(c).alias(f"x_{c}") for c in ("pos", "n", "p", "last")))
    y = posts.select(F.col("node").alias("b"), "token", *(F.col(c).alias(f"y_{c}") for c in ("pos", "n", "p", "last")))
    both = pairs.join(x, "a").join(y, ["b", "token"]).groupBy("a", "b").agg(
        F.count("*").alias("c"), F.max("x_pos").alias("i"), F.max("y_pos").alias("j"),
        *(F.first(f"{s}_{c}").alias(f"{s}_{c}") for s in "xy" for c in ("n", "p", "last")))
    return _reaching(both, percent)


def _long_enough(x: Column, y: Column, percent: int) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _contracted(found: list[DataFrame], before: DataFrame | None) -> DataFrame:
    """The components of all links found; those ``before`` are removed."""
    done = components(reduce(DataFrame.union, found))
    if before is not None:
        unstage(before)
    return done


def _labelled(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, t, n, component) of every row of ``docs``; the component is named by a set's digest."""
    scan = stage(_scan(docs, percent), "op10-scan")
    members = stage(scan.select("doc_id", "t", "n", "digest"), "op10-members")
    frequent = _frequent(scan)
    unstage(scan)
    posts = _posts(stage(_prefixes(docs, frequent, percent), "op10-plans"))
    found, done, pairs_before = [], None, float("inf")
    for turn in range(MAX_PIVOT_ROUNDS + 1):
        live = posts.withColumn("comp", F.col("node"))
        if done is not None:
            live, pairs_left, rows_left = _between(posts, done)
            if pairs_left == 0:
                unstage(live)
                break
            few = pairs_left <= MANY_PAIRS * rows_left or pairs_left > (1 - REMOVED) * pairs_before
            pairs_before = pairs_left
            if few or turn == MAX_PIVOT_ROUNDS or new.count() < FRUITFUL * n_tried:
                pairs = stage(_candidates(live, percent), "op10-pairs")
                unstage(live)
                found.append(_verified(docs, members, pairs, percent))
                if not found[-1].isEmpty():
                    done = _contracted(found, done)
                break
        # The hottest node of a posting list first (the least edited copy of a large group), then a random one of each of its parts.
        rank = F.struct("heat", "node") if turn == 0 else F.struct(F.xxhash64(F.lit(turn), "comp", "node").alias("h"), F.col("node"))
        part = F.lit(0) if turn == 0 else F.pmod(F.xxhash64(F.lit(turn), "token", "node"), F.ceil(F.col("held") / PER_PIVOT))
        dealt = live.withColumn("part", part.cast("long"))
        pivot = (dealt.groupBy(F.col("token").alias("t"), F.col("part").alias("tp"))
                 .agg(F.max(F.struct(rank.alias("r"), F.col("n"), F.col("comp").alias("pc"), *PARITY)).alias("q")))
        x, y = dealt.alias("x"), pivot.select("t", "tp", "q.*").alias("y")
        star = (x.join(y, (F.col("x.token") == F.col("y.t")) & (F.col("x.part") == F.col("y.tp")) & (F.col("x.comp") != F.col("y.pc"))
                       & _long_enough(F.col("x.n"), F.col("y.n"), percent)
                       & _may_link("x.", "y.", percent))
                .select(F.col("x.node").alias("a"), F.col("y.r.node").alias("b")).distinct())
        tried = stage(_counted(star, posts, percent), "op10-pairs")
        if done is not None:
            unstage(live)
        n_tried = tried.count()
        new = _verified(docs, members, tried, percent)
        found.append(new)
        done = _contracted(found, done)
    named = members.join(done.select(F.col("node").alias("digest"), "component"), "digest", "left")
    named = stage(named.select("doc_id", "t", "n", F.coalesce("component", "digest").alias("component")), "op10-named")
    unstage(members, posts, done, *found)
    return named


def similar_components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    named = _labelled(docs, percent)
    least = named.filter("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return (named.join(least, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def keep_one_per_group(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of linked documents: the row with the least id.

    Documents without words stay.  Among rows with that id, or if all ids are
    null, the one with the least hash of its text stays; of equal rows one.
    """
    named = _labelled(docs, percent).filter("n > 0")
    one = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("t"))
    kept = named.groupBy(F.col("component").alias("c")).agg(F.min(one).alias("kept"))
    gone = (named.join(kept, F.col("component") == F.col("c")).filter(~one.eqNullSafe(F.col("kept")))
            .select(F.col("doc_id").alias("_op10_id"), F.col("t").alias("_op10_t")).distinct())
    out = docs.withColumn("_op10_text", F.xxhash64("text")).join(
        gone, F.col("doc_id").eqNullSafe(F.col("_op10_id")) & (F.col("_op10_text") == F.col("_op10_t")), "left_anti")
    twice = named.groupBy("doc_id", "t").agg(F.count("*").alias("n")).filter("n > 1")
    if not twice.isEmpty():
        out = out.withColumn("_op10_row", F.when(F.regexp_like("text", F.lit(WORD)), F.lit(0)).otherwise(F.monotonically_increasing_id() + 1))
        out = out.dropDuplicates(["doc_id", "_op10_text", "_op10_row"]).drop("_op10_row")
    return out.drop("_op10_text")


def _node_of(digest: Column) -> Column:
    """The SQL form of :func:`_nodes`."""
    return F.conv(F.substring(F.hex(digest), 1, 16), 16, -10).cast("long")


@query("op10_ngram_join")
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(read(spark, sf_dir, "documents"))
