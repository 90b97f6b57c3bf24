r"""Operator 12, source divergence audit: Gustavson row accumulation over a term-major index.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased.
A language keeps the terms that ``min_docs`` of its documents or more hold.
Every (language, source) group and every language gets a smoothed share
p = 1 + floor(10^9 (count + 2) / (N + 2 V)) for each of the V kept terms, and two
shares differ by f(p, q) = floor((p - q)^2 / (p + q)).  Per group the result has
the sum of f against every other source of its language (part ``pair``) and the
terms that it uses most beyond its language (part ``term``).

Most shares are a group's zero share z, for a term that it doesn't hold.  So

    sum f = H(A, B) + H(B, A) + C(A, B) + (V - |A| - |B| + |A and B|) f(zA, zB),

where H(A, B) is the sum of f(pA, zB) over A's terms, and C that of
f(pA, pB) - f(pA, zB) - f(zA, pB) over terms of both.  The index, whose rows are
terms with the groups that hold them, is cut into blocks of terms and of groups
(rows).  In a task every row group scatters its terms through the index into
dense accumulators of C and |A and B| with a place per peer, and adds H for all
peers at once, value by value of A's shares; only the accumulators leave it.  A block
has about as many postings as there are pairs of sources, 65,536 at least, so
the accumulators never outnumber the index, and a frequent language or source
is spread over more blocks.  All numbers are integers: shares come from
DECIMAL(38), sums are below 2^53.

Edge cases: null text, language and source count as ''; a group without terms,
or a language without kept terms, has pairs (of value 0 where V = 0) and no
terms; a language with one source has no pairs; rows that repeat an id count
each; an empty table gives no rows; columns other than the three are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortkit.llm.common import LOWER, UPPER, read, stage
from cohortkit.llm.ragged import batches_of
from cohortkit.llm.registry import query

UNIT, ADDED = 1_000_000_000, 2
#: Postings of an index block at least, accumulators of a block of groups at most, and counts that a task holds
#: before it sends them on.
BLOCK_POSTINGS, BLOCK_CELLS, HELD_COUNTS = 1 << 16, 1 << 22, 1 << 19
#: Every byte that is part of a term as its lower case, all others as a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _merged(parts: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(parts).groupby(["lang", "source", "term"], sort=False, observed=True).sum().reset_index()


def _batch_counts(b: pa.RecordBatch) -> pd.DataFrame:
    """(lang, source, term, n, docs) of a batch (lang, source, text as bytes)."""
    groups = pd.MultiIndex.from_arrays([b.column(0).to_pandas(), b.column(1).to_pandas()])
    group, names = pd.factorize(groups)
    texts = [t.translate(TERM_BYTES).split() for t in b.column(2).to_pylist()]
    size = [len(t) for t in texts]
    words = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    known = max(1, len(words.dictionary))
    # Per document and term first, then per group and term.
    held, n = np.unique(np.repeat(np.arange(len(texts)), size) * known + code, return_counts=True)
    key, back = np.unique(group[held // known] * known + held % known, return_inverse=True)
    at = names.take(key // known)
    return pd.DataFrame({"lang": at.get_level_values(0), "source": at.get_level_values(1),
                         "term": words.dictionary.take(pa.array(key % known)).cast(pa.string()).to_numpy(zero_copy_only=False),
                         "n": np.bincount(back, n, len(key)).astype(np.int64), "docs": np.bincount(back, minlength=len(key))})


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pandas(_merged(held), schema=schema, preserve_index=False)

        for whole in batches:
            for b in batches_of(whole, 2):
                held.append(_batch_counts(b))
                rows += len(held[-1])
                if rows > HELD_COUNTS:
                    merged = _merged(held)
                    held, rows = [merged], len(merged)
                    if rows > HELD_COUNTS // 2:
                        yield out()
                        held, rows = [], 0
        if rows:
            yield out()

    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    part = _groups(docs, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).mapInArrow(
        run, "lang string, source string, term string, n long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _groups(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")), *more)


def _share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (n + 2 v)), exactly; null where both n and v are 0."""
    top = (count + ADDED).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    below = (n + ADDED * v).cast("decimal(20,0)")
    return F.call_function("div", top, F.when(below > 0, below)) + 1


def _difference(p, q):
    return (p - q) * (p - q) // (p + q)


def _spread(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _accumulate(terms: np.ndarray, peers: np.ndarray, p: np.ndarray, zero: np.ndarray, wanted: range,
                chunk: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(a, H(a, peers), C(a, peers), |a and peers|) of the row groups ``wanted``; postings (term, peer, p) are sorted by term."""
    start = np.append(np.flatnonzero(np.append(True, terms[1:] != terms[:-1])), len(terms))
    length = np.diff(start)
    of = np.repeat(np.arange(len(length)), length)  # the index row of each posting
    order = np.argsort(peers, kind="stable")
    cut = np.searchsorted(peers[order], np.arange(len(zero) + 1))
    for a in wanted:
        mine = order[cut[a]:cut[a + 1]]  # the group's own postings: its row
        value, both = np.zeros(len(zero)), np.zeros(len(zero))
        done = np.append(0, np.cumsum(length[of[mine]]))
        s = 0
        while s < len(mine):
            e = max(s + 1, int(np.searchsorted(done, done[s] + chunk, "right")) - 1)
            k = length[of[mine[s:e]]]
            at = np.repeat(start[of[mine[s:e]]] - (done[s:e] - done[s]), k) + np.arange(int(k.sum()))
            pa_, b, pb = np.repeat(p[mine[s:e]], k), peers[at], p[at]
            gain = _difference(pa_, pb) - _difference(pa_, zero[b]) - _difference(zero[a], pb)
            value += np.bincount(b, gain, len(zero))
            both += np.bincount(b, minlength=len(zero))
            s = e
        alone, (share, times) = np.zeros(len(zero), np.int64), np.unique(p[mine], return_counts=True)
        step = max(1, chunk // len(zero))
        for s in range(0, len(share), step):
            alone += times[s:s + step] @ _difference(share[s:s + step, None], zero)
        yield a, alone, value.astype(np.int64), both.astype(np.int64)


def _pairs(index: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value, both): H(a, b) + H(b, a) + C(a, b) and shared terms of a and b (numbers of sources within the language)."""
    # Blocks: as many postings as accumulators, and accumulators that a task can hold.
    sizes = groups.groupBy("lang").agg(F.count("*").alias("s"), F.sum("held").alias("held"), F.collect_list(F.struct("g", "z")).alias("zero"))
    sizes = sizes.filter("held > 0").select(
        "lang", "s", F.ceil(F.col("held") / F.greatest(F.lit(BLOCK_POSTINGS), F.col("s") * F.col("s"))).alias("t_blocks"),
        F.ceil(F.col("s") * F.col("s") / BLOCK_CELLS).alias("r_blocks"), F.transform(F.sort_array("zero"), lambda x: x["z"]).alias("zero"))
    block = F.pmod(F.xxhash64("term"), F.col("t_blocks"))
    cut = index.join(sizes.drop("zero"), "lang").select(
        "lang", block.alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("r_blocks") - 1)).alias("r"), "term", "g", "p")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        zero = right.column("zero")[0].values.to_numpy().astype(np.int64) if right.num_rows else np.zeros(0, np.int64)
        out = []
        if left.num_rows and len(zero):
            _, term = np.unique(left.column("term").to_numpy(), return_inverse=True)
            order = np.argsort(term, kind="stable")
            g, p = (left.column(c).to_numpy()[order].astype(np.int64) for c in ("g", "p"))
            s, r, blocks = len(zero), key[2].as_py(), right.column("r_blocks")[0].as_py()
            wanted = range(s * r // blocks, s * (r + 1) // blocks)
            out = list(_accumulate(term[order], g, p, zero, wanted))
        lists = {c: pa.array([x[k] for x in out], pa.list_(pa.int64())) for k, c in enumerate(("h", "c", "both"), 1)}
        return pa.table({"lang": pa.array([key[0].as_py()] * len(out), pa.string()), "a": pa.array([x[0] for x in out], pa.int64()), **lists})

    blocks = sizes.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t_blocks") - 1)).alias("t"), "r_blocks", "zero").select(
        "lang", "t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("r_blocks") - 1)).alias("r"), "r_blocks", "zero")
    rows = cut.groupBy("lang", "t", "r").cogroup(blocks.groupBy("lang", "t", "r")).applyInArrow(
        run, "lang string, a long, h array<long>, c array<long>, both array<long>")
    each = rows.select("lang", "a", F.posexplode(F.arrays_zip("h", "c", "both")).alias("b", "x")).withColumn("b", F.col("b").cast("long"))
    there = F.struct("a", "b", (F.col("x.h") + F.col("x.c")).alias("value"), F.col("x.both").alias("both"))
    back = F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("x.h").alias("value"), F.lit(0).cast("long").alias("both"))
    return (each.select("lang", F.inline(F.array(there, back))).groupBy("lang", "a", "b")
            .agg(F.sum("value").alias("value"), F.sum("both").alias("both")))


def divergence(docs: DataFrame, min_docs: int = 10, top_terms: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of ``docs``; see the contract in the module's docstring."""
    counts = stage(term_counts(docs), "op12-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).filter(F.col("docs") >= min_docs).drop("docs")
    held = stage(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang"), "op12-held")
    totals = held.groupBy("lang", "term").agg(F.first("n_lang").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("n_all"))
    own = held.groupBy("lang", "source").agg(F.sum("n").alias("n_own"), F.count("*").alias("held"))
    none = F.lit(0).cast("long")
    groups = (_groups(docs).distinct().join(own, ["lang", "source"], "left").join(totals, "lang", "left")
              .select("lang", "source", *(F.coalesce(F.col(c), none).alias(c) for c in ("n_own", "held", "v", "n_all"))))
    groups = stage(groups.withColumn("z", F.coalesce(_share(none, F.col("n_own"), F.col("v")), F.lit(1).cast("long")))
                   .withColumn("g", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")), "op12-groups")
    index = stage(held.join(groups.select("lang", "source", "g", "n_own", "v", "n_all", "z"), ["lang", "source"]).select(
        "lang", "source", "term", "g", "n", _share(F.col("n"), F.col("n_own"), F.col("v")).alias("p"),
        _share(F.col("n_lang"), F.col("n_all"), F.col("v")).alias("q")), "op12-index")

    one = groups.select("lang", "source", F.col("g").alias("a"), F.col("held").alias("held_a"), F.col("z").alias("za"), "v")
    two = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("b"), F.col("held").alias("held_b"), F.col("z").alias("zb"))
    met = _pairs(index, groups).withColumnRenamed("value", "of_terms")
    both = one.join(two, "lang").filter("a <> b").join(met, ["lang", "a", "b"], "left")
    shared = F.coalesce(F.col("both"), none)
    value = F.coalesce(F.col("of_terms"), none) + (F.col("v") - F.col("held_a") - F.col("held_b") + shared) * _spread(F.col("za"), F.col("zb"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = both.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(by))
    term = (index.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _spread(F.col("p"), F.col("q")).alias("value"))
            .withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top_terms))
    return pair.unionByName(term)


_P = "CAST(1 + (CAST({u} AS HUGEINT) * ({c} + {k})) // ({n} + {k} * v) AS BIGINT)"
_F = "(({p} - {q}) * ({p} - {q})) // ({p} + {q})"

OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, term, sum(c) AS n, count(*) AS docs FROM (
        SELECT r, lang, source, term, count(*) AS c FROM (SELECT r, lang, source, unnest(w) AS term FROM d) u GROUP BY ALL) x GROUP BY ALL),
k AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS nl FROM t GROUP BY lang, term HAVING sum(docs) >= 10),
l AS (SELECT lang, count(*) AS v, CAST(sum(nl) AS BIGINT) AS n_all FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, k.nl, coalesce(CAST(t.n AS BIGINT), 0) AS n
      FROM g JOIN k USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term),
s AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS n_own FROM c GROUP BY lang, source),
p AS (SELECT c.lang, c.source, term, n, {_P.format(u=UNIT, c='n', k=ADDED, n='n_own')} AS p, {_P.format(u=UNIT, c='nl', k=ADDED, n='n_all')} AS q
      FROM c JOIN s USING (lang, source) JOIN l USING (lang)),
pv AS (SELECT a.lang, a.source, b.source AS item, CAST(sum({_F.format(p='a.p', q='b.p')}) AS BIGINT) AS value
       FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source
      UNION ALL SELECT lang, source, 'term', term, CAST({_F.format(p='p', q='q')} AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u) z
WHERE part = 'pair' OR rank <= 10
"""


@query("op12_source_divergence", OP12_SQL)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))
