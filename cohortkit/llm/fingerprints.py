r"""Operator 11, document fingerprints, in DataFrame functions alone: a threshold-scaled sketch.

A sketch keeps every shingle hash of a text below a fixed fraction of all
hashes (1 / ``SCALE``), so its size follows the text and not a parameter, and
the sketch of several texts is what their sketches keep together.  Of two
sketches the shared hashes over those of one, or of both, estimate containment
and resemblance without bias however unequal the documents are.  Shingles are
five words (a shorter text is one shingle), A-Z lower-cased, one space between
words; a hash is the first 16 hex digits of its MD5.  Where no hash is below
the threshold the least one is kept alone, so that short texts compare as equal
or not; such a hash is recognised by its value and goes when sketches with
hashes below the threshold are merged in.  A fingerprint is the sorted hashes,
one after the other.

Each document meets the next one by descending id in one shuffle of the texts:
ids are cut into ranges at quantiles, a range is sorted, and the first row of
each range is handed to the range before it.  Sketches are made before that
shuffle, so that every text is hashed once, and once edited.

Edge cases: a null text is empty; a text without words has an empty sketch, of
likeness 1 to another empty one and 0 to all others; null ids come last, equal
ids (which share a range) in the order of their texts, rows that repeat are each other's next; a
single row is its own next; an empty table gives no rows; extra columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortkit.llm.common import LOWER, SPACE, UPPER, let, lower_ascii, read
from cohortkit.llm.registry import query

WORDS, SCALE, DIGITS = 5, 8, 16
#: A hash is kept if it is less than this.
THRESHOLD = f"{16 ** DIGITS // SCALE:0{DIGITS}x}"
#: Rows of a range of ids, and ranges at most (their cuts are the only numbers that come to the driver).
RANGE_ROWS, MAX_RANGES = 2_000, 50_000


def _scaled(hashes: Column) -> Column:
    """Sorted hashes that a sketch keeps: those below the threshold, or else the least one."""
    low = F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < THRESHOLD)))
    return F.when(F.size(low) > 0, low).otherwise(F.slice(F.array_sort(hashes), 1, 1))


def sketch(text: Column) -> Column:
    """Kept hashes of a text, sorted."""
    body = lower_ascii(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE)))

    def of(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (WORDS - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.substring(F.md5(F.array_join(F.slice(words, i, WORDS), " ").cast("binary")), 1, DIGITS))

    hashes = let(F.split(body, r"[\x20\x09-\x0D]+"), of)
    return F.when(body == "", F.array().cast("array<string>")).otherwise(let(hashes, _scaled))


def fingerprint(kept: Column) -> Column:
    return F.array_join(kept, "")


def parse(print_: Column) -> Column:
    """The hashes of a fingerprint."""
    return _unpacked(F.unhex(print_))


def _packed(kept: Column) -> Column:
    """The hashes as bytes, for a shuffle."""
    return F.unhex(fingerprint(kept))


def _unpacked(packed: Column) -> Column:
    """The hashes again; places in bytes are found at once, those in a string only by reading it from its start."""
    size = DIGITS // 2
    each = F.transform(F.sequence(F.lit(0), (F.octet_length(packed) / size).cast("int") - 1),
                       lambda i: F.lower(F.hex(F.substr(packed, i * size + 1, F.lit(size)))))
    return F.when(F.octet_length(packed) == 0, F.array().cast("array<string>")).otherwise(each)


def merge(a: Column, b: Column) -> Column:
    """The sketch of all shingles of two sketches' texts."""
    return let(F.array_union(a, b), _scaled)


def resemblance(a: Column, b: Column) -> Column:
    """Shared hashes over the hashes of both (0 to 1); two empty sketches are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(a) + F.size(b) - both), F.lit(1.0))


def containment(a: Column, b: Column) -> Column:
    """Share of a's hashes that b has; an empty sketch is contained in all."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(a)), F.lit(1.0))


def _range_of(docs: DataFrame) -> Column:
    """The range of a row's id, counted down from the largest ids; null ids have one of their own, the last."""
    n = docs.count()
    k = max(1, min(MAX_RANGES, -(-n // RANGE_ROWS)))
    at = [F.lit(i / k) for i in range(1, k)]
    cuts = docs.agg(F.percentile_approx("doc_id", F.array(*at), 10 * k).alias("c")).first()["c"] if at else []
    cuts = sorted({c for c in cuts or []})
    if not cuts:
        return F.when(F.col("doc_id").isNull(), 1).otherwise(0)
    sent = F.lit(cuts)
    # Binary search: how many cuts lie below the id.
    steps = F.sequence(F.lit(len(cuts).bit_length() - 1), F.lit(0), F.lit(-1))

    def step(below: Column, j: Column) -> Column:
        more = below + F.call_function("shiftleft", F.lit(1), j)
        return F.when((more <= len(cuts)) & (F.get(sent, more - 1) < F.col("doc_id")), more).otherwise(below)

    below = F.aggregate(steps, F.lit(0), step)
    return F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(len(cuts) - below)


def with_next(rows: DataFrame) -> DataFrame:
    """(doc_id, text, kept) with the text and sketch of the next row by descending id; the last one's next is the first."""
    order = [F.desc_nulls_last("doc_id"), F.col("text")]
    ranged = rows.select("doc_id", "text", _packed(F.col("kept")).alias("kept"), _range_of(rows.select("doc_id")).alias("range"))
    # The first row of every range, for the last row of the range before it; only range numbers are ordered.
    first = (ranged.select("range", "doc_id", "text").groupBy("range").agg(F.min(F.struct((-F.col("doc_id")).alias("_down"), "text")).alias("_m"))
             .select("range", "_m.text").withColumn("kept", _packed(sketch(F.col("text")))))
    before = F.lag("_r").over(Window.orderBy("_r"))
    last = F.max("_r").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    order_of = ranged.select(F.col("range").alias("_r")).distinct().select("_r", F.coalesce(before, last).alias("_range"))
    heads = first.join(order_of, F.col("range") == F.col("_r")).select("_range", F.struct("text", "kept").alias("_head"))
    ahead = F.lead(F.struct("text", "kept")).over(Window.partitionBy("range").orderBy(*order))
    out = ranged.withColumn("_next", ahead).join(heads, F.col("range") == F.col("_range"), "left").withColumn("_next", F.coalesce("_next", "_head"))
    return out.select("doc_id", "text", _unpacked(F.col("kept")).alias("kept"), F.col("_next.text").alias("next_text"), _unpacked(F.col("_next.kept")).alias("next_kept"))


def edited(text: Column, next_text: Column) -> Column:
    """``text`` whose last third of code points is replaced by as many of the next text's first ones."""
    m = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - m), F.substr(next_text, F.lit(1), m))


def compare_edited(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprints, likeness) of every row of ``docs`` and its edited text."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("kept", sketch(F.col("text"))))
    rows = rows.withColumn("edit", edited(F.col("text"), F.col("next_text"))).withColumn("edit_kept", sketch(F.col("edit")))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edit", 256).alias("edited_sha256"),
        fingerprint(F.col("kept")).alias("fingerprint"), fingerprint(F.col("edit_kept")).alias("edited_fingerprint"),
        resemblance(F.col("kept"), F.col("edit_kept")).alias("near_edited"), resemblance(F.col("kept"), F.col("next_kept")).alias("near_next"),
        containment(F.col("kept"), F.col("edit_kept")).alias("contained_in_edited"), containment(F.col("kept"), F.col("next_kept")).alias("contained_in_next"))


_SKETCH = rf"""SELECT r, list_sort(list(h)) AS low, min(least) AS least FROM (
  SELECT r, CASE WHEN h < '{THRESHOLD}' THEN h END AS h, h AS least FROM (
    SELECT DISTINCT r, substr(md5(array_to_string(w[i:i + {WORDS - 1}], ' ')), 1, {DIGITS}) AS h
    FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {WORDS - 2}, 2))) AS i
          FROM (SELECT r, regexp_extract_all(translate({{text}}, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM e) x WHERE len(w) > 0) y) z) k GROUP BY r"""
_KEPT = "CASE WHEN low IS NULL AND least IS NULL THEN [] WHEN len(list_filter(low, lambda x: x IS NOT NULL)) > 0 THEN list_filter(low, lambda x: x IS NOT NULL) ELSE [least] END"


def _like(a: str, b: str, over: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN {over.format(s=shared, a=a, b=b)} = 0 THEN 1.0 ELSE CAST({shared} AS DOUBLE) / ({over.format(s=shared, a=a, b=b)}) END"


_ANY, _OWN = "len({a}) + len({b}) - {s}", "len({a})"
OP11_SQL = rf"""
WITH t AS (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS r, doc_id, coalesce(text, '') AS text FROM documents),
nx AS (SELECT r, doc_id, text, coalesce(lead(r) OVER (ORDER BY r), 1) AS nr FROM t),
e AS (SELECT a.r, a.nr, a.doc_id, a.text, substr(a.text, 1, length(a.text) - length(a.text) // 3) || substr(b.text, 1, length(a.text) // 3) AS edit
      FROM nx a JOIN t b ON b.r = a.nr),
s1 AS ({_SKETCH.format(text='text')}), s2 AS ({_SKETCH.format(text='edit')}),
k1 AS (SELECT e.r, {_KEPT} AS k FROM e LEFT JOIN s1 USING (r)), k2 AS (SELECT e.r, {_KEPT} AS k FROM e LEFT JOIN s2 USING (r)),
j AS (SELECT e.*, a.k AS a, b.k AS b, c.k AS c FROM e JOIN k1 a ON a.r = e.r JOIN k2 b ON b.r = e.r JOIN k1 c ON c.r = e.nr)
SELECT doc_id, length(text) AS n_chars, sha256(edit) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
       {_like('a', 'b', _ANY)} AS near_edited, {_like('a', 'c', _ANY)} AS near_next,
       {_like('a', 'b', _OWN)} AS contained_in_edited, {_like('a', 'c', _OWN)} AS contained_in_next
FROM j
"""


@query("op11_fingerprints", OP11_SQL)
def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(read(spark, sf_dir, "documents").select("doc_id", "text"))
