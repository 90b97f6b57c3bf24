"""Operator 5, quality rules with risk-controlled thresholds, in DataFrame functions alone.

Base rules reject documents that are too short or repeat themselves.  Beyond
them, each rule scores a document by a ratio and rejects it above a cutoff.
Cutoffs come from labelled holdouts: a (stratum, rule, cutoff) is certified
when, of the n good documents of the stratum, so few are above the cutoff that
under a true false-rejection rate of ``alpha`` the exact binomial probability
of so few is at most ``delta`` divided by all (stratum, rule, cutoff) that were
tried (Bonferroni).  ``alpha`` is ``risk`` over the number of rules, so with
probability 1 - ``delta`` no stratum loses more than ``risk`` of its good
documents to the method.  Of the certified cutoffs the one with the best gain
is used: rejected bad documents less ``price`` times rejected good ones; a rule
without gain stays off in its stratum.  The grid is fixed beforehand, the
holdout is used for certification only.

Edge cases: null or empty texts have no words and fail the base rules; a null
language is a stratum of its own; a stratum without enough labels gets no
cutoffs and keeps what the base rules keep; a document with several labels
counts as bad if any is; null labels are left out; repeated rows are judged
one by one; extra columns pass through :func:`quality_filter`.  Windows of five words are
compared by a 64-bit hash within one document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortkit.llm.common import SPACE, let, read, stage
from cohortkit.llm.registry import query

SYMBOLS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Strata up to which the cutoffs are broadcast.
MAX_STRATA = 100_000


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


#: Rules: score of a document, cutoffs from strict to loose.  A document above the cutoff is rejected.
RULES: dict[str, tuple] = {
    "symbols_per_word": (lambda: _ratio(F.col("n_symbols"), F.col("n_words")), [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 1.0]),
    "duplicate_lines": (lambda: _ratio(F.col("n_dup_lines") * 10.0, F.col("n_words")), [0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 1.0]),
    "long_words": (lambda: _ratio(F.col("word_chars"), F.col("n_words")), [7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0]),
    "short_words": (lambda: _ratio(F.col("n_words"), F.col("word_chars")), [1 / 4, 1 / 3.5, 1 / 3, 1 / 2.5, 1 / 2, 1 / 1.5]),
    "repeated_words": (lambda: _ratio(F.col("n_repeat_words"), F.col("n_words")), [0.02, 0.05, 0.08, 0.11, 0.14, 0.17]),
}


def _covered(words: Column) -> Column:
    """Words in windows of five that occur twice or more among the document's windows."""
    def count(starts: Column) -> Column:
        ahead = F.transform(starts, lambda s, i: F.least(F.lit(5), F.coalesce(F.get(starts, i + 1) - s, F.lit(5))))
        return F.aggregate(ahead, F.lit(0).cast("long"), lambda a, x: a + x)

    def of_sorted(s: Column) -> Column:
        def same(i: Column, j: Column) -> Column:
            return F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        twice = F.filter(s, lambda x, i: same(i, i - 1) | same(i, i + 1))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), count)

    def of_hashes(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(F.sort_array(pairs), of_sorted))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 5),
                         lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(5))))
    return F.when(F.size(words) < 6, F.lit(0).cast("long")).otherwise(let(hashes, of_hashes))


def with_stats(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts of :data:`STATS` and ``base_failed``; a narrow projection."""
    text = F.coalesce(F.col("text"), F.lit(""))
    body = F.btrim(text, F.lit(SPACE))
    words = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    out = (docs.withColumn("_w", let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _covered(w).alias("r"))))
           .withColumn("n_words", F.col("_w.n"))
           .withColumn("word_chars", F.length(F.translate(text, SPACE, "")).cast("long"))
           .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
           .withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
           .withColumn("n_repeat_words", F.col("_w.r")).drop("_w"))
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _tail_limit(n: Column, alpha: float, level: Column) -> Column:
    """The largest k with P(Binomial(n, alpha) <= k) <= level; -1 if there is none."""
    def step(a: Column, i: Column) -> Column:
        logp = F.when(i == 0, n * math.log1p(-alpha)).otherwise(
            a["logp"] + F.log((n - i + 1) / i) + (math.log(alpha) - math.log1p(-alpha)))
        cdf = a["cdf"] + F.exp(logp)
        return F.struct(logp.alias("logp"), cdf.alias("cdf"), F.when(cdf <= level, i).otherwise(a["k"]).alias("k"))

    start = F.struct(F.lit(0.0).alias("logp"), F.lit(0.0).alias("cdf"), F.lit(-1).cast("long").alias("k"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.ceil(n * alpha)), start, step, lambda a: a["k"])


def fit_cutoffs(stats: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, price: float = 20.0,
                stratum: str = "lang") -> DataFrame:
    """(stratum, cutoffs): per stratum an array with each rule's certified cutoff or null, in the order of RULES.

    ``stats`` needs doc_id, the stratum and the columns of :func:`with_stats`; ``labels`` doc_id and quality.
    """
    alpha = risk / len(RULES)
    tried = sum(len(c) for _, c in RULES.values())
    marks = (labels.filter(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("quality")))
    # How many of its cutoffs each rule's score exceeds, counted per stratum before anything is shuffled.
    over = [sum(((score() > c).cast("int") for c in cuts), F.lit(0)) for score, cuts in RULES.values()]
    held = (stats.filter(~F.col("base_failed")).join(marks, F.col("doc_id") == F.col("_id"))
            .select(F.col(stratum).alias("stratum"), (F.col("quality") > 0).alias("good"), F.posexplode(F.array(*over)).alias("rule", "above")))
    counts = held.groupBy("stratum", "rule", "above").agg(F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(~F.col("good"), 1)).alias("bad"))
    per_rule = counts.groupBy("stratum", "rule").agg(F.collect_list(F.struct("above", "good", "bad")).alias("c"), F.sum("good").alias("n"))
    strata = F.size(F.collect_set(F.coalesce(F.col("stratum"), F.lit("\0"))).over(Window.partitionBy()))
    leveled = per_rule.withColumn("k_max", _tail_limit(F.col("n"), alpha, F.lit(delta) / (strata * tried)))
    grid = F.element_at(F.array(*(F.array(*(F.lit(float(c)) for c in cuts)) for _, cuts in RULES.values())), F.col("rule") + 1)

    def total(j: Column, what: str) -> Column:
        return F.aggregate(F.col("c"), F.lit(0).cast("long"), lambda a, x: a + F.when(x["above"] > j, x[what]).otherwise(0))

    options = F.transform(F.col("grid"), lambda c, j: F.struct(
        (total(j, "bad") - F.lit(price) * total(j, "good")).alias("gain"), c.alias("cutoff"), total(j, "good").alias("k")))
    best = F.array_max(F.filter(F.col("options"), lambda o: (o["k"] <= F.col("k_max")) & (o["gain"] > 0)))["cutoff"]
    chosen = leveled.withColumn("grid", grid).withColumn("options", options).select("stratum", "rule", best.alias("cutoff"))
    at = [F.max(F.when(F.col("rule") == r, F.col("cutoff"))) for r in range(len(RULES))]
    return chosen.groupBy("stratum").agg(F.array(*at).alias("cutoffs"))


def judge(stats: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Adds ``kept`` to rows that have the columns of :func:`with_stats`."""
    cut = stage(cutoffs, "op5-cutoffs")
    if cut.count() <= MAX_STRATA:
        cut = F.broadcast(cut)
    joined = stats.join(cut, F.col(stratum).eqNullSafe(F.col("stratum")), "left")
    rejected = F.lit(False)
    for r, (score, _) in enumerate(RULES.values()):
        rejected = rejected | F.coalesce(score() > F.get("cutoffs", F.lit(r)), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("stratum", "cutoffs")


def quality_filter(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the base rules and the certified cutoffs keep."""
    # The fit needs the labelled rows only; all rows are counted once, when they are judged.
    marked = labels.filter(F.col("quality").isNotNull()).select(F.col("doc_id").alias("_id")).distinct()
    held = docs.select("doc_id", stratum, "text").join(marked, F.col("doc_id") == F.col("_id"), "left_semi")
    slim = stage(with_stats(held).drop("text"), "op5-stats")
    own = docs.select(*(F.col(c).alias(f"_doc_{c}") for c in docs.columns), F.col(stratum), F.col("text"))
    judged = judge(with_stats(own), fit_cutoffs(slim, labels, stratum=stratum), stratum)
    # One test of both columns: as a conjunction its first half would be moved below the join and count the words there again.
    kept = judged.filter(F.greatest(F.col("base_failed").cast("int"), (~F.col("kept")).cast("int")) == 0)
    return kept.select(*(F.col(f"_doc_{c}").alias(c) for c in docs.columns))


#: The rules' scores in SQL, in the order of RULES.
_SCORES = ["n_symbols / n_words", "n_dup_lines * 10.0 / n_words", "word_chars / n_words", "n_words / word_chars", "n_repeat_words / n_words"]
_CASES = "[" + ", ".join(f"CASE WHEN n_words > 0 THEN CAST({s.split(' / ')[0]} AS DOUBLE) / {s.split(' / ')[1]} ELSE 0.0 END" for s in _SCORES) + "]"
_CUTS = "[" + ", ".join(str([float(c) for c in cuts]) for _, cuts in RULES.values()) + "]"
_TRIED, _ALPHA = sum(len(c) for _, c in RULES.values()), 0.05 / len(RULES)

OP5_SQL = rf"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, words[i:i + 4] AS five
        FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1))) AS i FROM w WHERE len(words) >= 5) x),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
        FROM (SELECT doc_id, i, unnest(range(0, 5)) AS k FROM (
                SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS c FROM win) y WHERE c > 1) z GROUP BY doc_id),
lin AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) l
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
s AS (SELECT w.doc_id, w.lang, CAST(len(words) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lin USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {_CASES} AS scores FROM s),
m AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
o AS (SELECT lang, quality > 0 AS good, r, c, scores[r] > cuts[r][c] AS hit
      FROM (SELECT lang, quality, scores, cuts, r, unnest(range(1, len(cuts[r]) + 1)) AS c
            FROM (SELECT lang, quality, scores, {_CUTS} AS cuts, unnest(range(1, {len(RULES)} + 1)) AS r
                  FROM b JOIN m USING (doc_id) WHERE NOT base_failed) p) q),
g AS (SELECT lang, r, c, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE good AND hit) AS k,
             count(*) FILTER (WHERE NOT good AND hit) AS bad, (SELECT count(DISTINCT coalesce(lang, chr(0))) FROM o) AS strata
      FROM o GROUP BY lang, r, c),
ok AS (SELECT lang, r, c, bad - 20 * k AS gain FROM g WHERE bad > 20 * k AND list_sum(list_transform(range(0, k + 1),
         lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_ALPHA}) + (n - i) * ln(1 - {_ALPHA})))) <= 0.05 / (strata * {_TRIED})),
cut AS (SELECT lang, r, ({_CUTS})[r][c] AS cutoff FROM (
          SELECT *, row_number() OVER (PARTITION BY lang, r ORDER BY gain DESC, c DESC) AS best FROM ok) z WHERE best = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM cut WHERE cut.lang IS NOT DISTINCT FROM b.lang AND b.scores[cut.r] > cut.cutoff) AS kept, lang
FROM b
"""


@query("op5_quality_rules", OP5_SQL)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    stats = stage(with_stats(docs).drop("text"), "op5-stats")
    out = judge(stats, fit_cutoffs(stats, read(spark, sf_dir, "labels")))
    return out.select("doc_id", *STATS, "base_failed", "kept", "lang")
