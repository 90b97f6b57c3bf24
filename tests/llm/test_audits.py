"""Operators 11 to 13 against brute force on fixtures with nulls, ties, copies and long texts."""
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortkit.llm import fingerprints as FP
from cohortkit.llm import periodic_runs as PR
from cohortkit.llm import source_divergence as SD

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FRAMES = ["docs", "clashing", "empty"]


def key(rows):
    return sorted(rows, key=str)


# --- 11 ---------------------------------------------------------------------

def kept(text):
    w = WHITE.findall((text or "").translate(FOLD))
    h = {hashlib.md5(" ".join(w[i:i + 5]).encode()).hexdigest()[:16] for i in range(max(1, len(w) - 4))} if w else set()
    low = {x for x in h if int(x, 16) < 2 ** 64 // 8}
    return sorted(low or sorted(h)[:1])


def alike(a, b):
    u = set(a) | set(b)
    return len(set(a) & set(b)) / len(u) if u else 1.0


@pytest.mark.parametrize("name", FRAMES)
def test_fingerprints(request, name, monkeypatch):
    df = request.getfixturevalue(name)
    monkeypatch.setattr(FP, "RANGE_ROWS", 3)
    rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        m = len(t) // 3
        e = t[:len(t) - m] + nxt[:m]
        a, b, c = kept(t), kept(e), kept(nxt)
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), "".join(a), "".join(b), alike(a, b), alike(a, c)))
    got = FP.compare_edited(df)
    assert key(tuple(r)[:7] for r in got.collect()) == key(want)


def test_ranges_of_ids_join_up(spark, monkeypatch):
    """The next text is right whatever the ranges are: one, many, with gaps, with one id throughout."""
    for ids in (range(57), [i * i for i in range(40)], [7] * 9 + [3, 11], [None, None, 5], [1]):
        rows = [(i, f"t{k:03}") for k, i in enumerate(ids)]
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", FP.sketch(F.col("text")))
        rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        want = sorted(t + rows[(k + 1) % len(rows)][1] for k, (_, t) in enumerate(rows))
        for size in (1, 5, 1000):
            monkeypatch.setattr(FP, "RANGE_ROWS", size)
            out = FP.with_next(df).select(F.concat("text", "next_text"), F.sort_array("next_kept") == FP.sketch(F.col("next_text"))).collect()
            assert sorted(r[0] for r in out) == want and all(r[1] for r in out)


def test_sketches_merge_and_parse(spark):
    """Merging sketches gives the sketch of all shingles, in any order, and a fingerprint holds its hashes."""
    rnd = random.Random(3)
    rows = [tuple(" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, n))) for _ in range(3)) for n in (2, 6, 40, 400) for _ in range(10)]
    df = spark.createDataFrame(rows, "a string, b string, c string").select(*(FP.sketch(F.col(x)).alias(x) for x in "abc"))
    got = df.select(FP.merge(FP.merge(F.col("a"), F.col("b")), F.col("c")).alias("l"), FP.merge(F.col("a"), FP.merge(F.col("c"), F.col("b"))).alias("r"),
                    F.col("a"), FP.parse(FP.fingerprint(F.col("a"))).alias("p")).collect()
    for r, texts in zip(got, rows):
        hashes = {h for t in texts for w in [t.split()] if w
                  for h in {hashlib.md5(" ".join(w[i:i + 5]).encode()).hexdigest()[:16] for i in range(max(1, len(w) - 4))}}
        low = sorted(h for h in hashes if h < FP.THRESHOLD)
        assert r.l == r.r == (low or sorted(hashes)[:1]) and r.a == r.p


def test_containment_of_unequal_texts(spark):
    """A text of 2,000 words in one of 40,000: its containment is estimated though resemblance is small."""
    words = [f"w{i}" for i in range(40_000)]
    df = spark.createDataFrame([(" ".join(words[5000:7000]), " ".join(words))], "a string, b string").select(
        *(FP.sketch(F.col(c)).alias(c) for c in "ab"))
    r = df.select(FP.containment(F.col("a"), F.col("b")).alias("c"), FP.containment(F.col("b"), F.col("a")).alias("d"),
                  FP.resemblance(F.col("a"), F.col("b")).alias("j")).first()
    assert r.c == 1.0 and abs(r.d - 0.05) < 0.02 and abs(r.j - 0.05) < 0.02


def test_fingerprints_are_native(spark, sf):
    plan = FP.op11_fingerprints(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|RDD", plan) and plan.count("Window") > 0


# --- 12 ---------------------------------------------------------------------

def divergence(rows, min_docs=10, top=10):
    counts, docs, groups = Counter(), Counter(), {}
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.setdefault(lang, set()).add(source)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
        for w in words:
            counts[lang, source, w] += 1
        for w in set(words):
            docs[lang, w] += 1
    out = []
    for lang, sources in groups.items():
        terms = [w for (g, w), n in docs.items() if g == lang and n >= min_docs]
        v = len(terms)

        def shares(of):
            n = sum(of.values())
            return {w: 1 + 10 ** 9 * (of[w] + 2) // (n + 2 * v) for w in terms}

        own = {s: {w: counts[lang, s, w] for w in terms} for s in sources}
        p = {s: shares(own[s]) for s in sources}
        q = shares({w: sum(own[s][w] for s in sources) for w in terms})
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(o, sum(f(p[s][w], p[o][w]) for w in terms)) for o in sources if o != s]
            term = [(w, f(p[s][w], q[w])) for w in terms if own[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", pair), ("term", term)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, x, k) for k, (i, x) in enumerate(ranked if part == "pair" else ranked[:top], 1)]
    return out


@pytest.mark.parametrize("name", FRAMES)
@pytest.mark.parametrize("min_docs", [1, 3, 1000])
def test_divergence(request, name, min_docs):
    df = request.getfixturevalue(name)
    want = divergence([(r.text, r.lang, r.source) for r in df.select("text", "lang", "source").collect()], min_docs)
    assert key(map(tuple, SD.divergence(df, min_docs).collect())) == key(want)


def test_divergence_in_small_blocks(spark, monkeypatch):
    """Blocks of terms and of groups, and counts sent early, change nothing; one source holds a third of all rows."""
    rnd = random.Random(4)
    vocabulary = [f"t{chr(97 + i // 26)}{chr(97 + i % 26)}É" for i in range(300)]
    rows = [(" ".join(rnd.choices(vocabulary[:rnd.randint(1, 300)], k=rnd.randint(0, 40))), rnd.choice(["x", "y", None]),
             "hot" if rnd.random() < 0.33 else f"s{rnd.randrange(25)}") for _ in range(600)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    want = key(divergence(rows, 5))
    assert key(map(tuple, SD.divergence(df, 5).collect())) == want
    for name, value in (("BLOCK_POSTINGS", 50), ("BLOCK_CELLS", 60), ("HELD_COUNTS", 40)):
        monkeypatch.setattr(SD, name, value)
    assert key(map(tuple, SD.divergence(df, 5).collect())) == want


def test_shares_are_exact(spark):
    """Counts whose product with 10^9 needs more than 64 bits."""
    rows = [(c, n, v) for c in (0, 7, 10 ** 13 + 3) for n in (10 ** 13 + 7, 4 * 10 ** 13) for v in (1, 10 ** 8)] + [(0, 0, 3), (0, 0, 0)]
    got = spark.createDataFrame(rows, "c long, n long, v long").select(SD._share(F.col("c"), F.col("n"), F.col("v"))).collect()
    assert [r[0] for r in got] == [1 + 10 ** 9 * (c + 2) // (n + 2 * v) if n + 2 * v else None for c, n, v in rows]


# --- 13 ---------------------------------------------------------------------

def runs_of(w, least=6, times=4):
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, times * q):
                out.setdefault((s, i + q - s), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def run_row(words):
    runs, drop = runs_of(words), set()
    for s, n, q in runs:
        drop.update(range(s + q, s + n))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *(best + (1000 * best[1] // best[2],) if best else (None,) * 4), sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(x for i, x in enumerate(words) if i not in drop)))


def test_find_runs_equals_all_periods():
    rnd = random.Random(0)
    for _ in range(800):
        docs = []
        for _ in range(rnd.randint(0, 4)):
            n, k = rnd.randint(0, 60), rnd.randint(1, 3)
            w = [rnd.randrange(k) for _ in range(n)]
            if n and rnd.random() < 0.5:
                a = rnd.randrange(n)
                p = 1 + (n - a) // (3 + rnd.randrange(8))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        size = np.array([len(w) for w in docs], np.int64)
        ends = np.cumsum(size)
        ids = np.array([d * 10 + x for d, w in enumerate(docs) for x in w], np.int64)
        got = [tuple(r) for r in PR.find_runs(ids, np.repeat(ends, size)).tolist()]
        assert got == [(s + int(ends[d]) - len(w), n, q) for d, w in enumerate(docs) for s, n, q in runs_of(w)]


@pytest.mark.parametrize("name", FRAMES)
def test_periodic_runs(request, name):
    df = request.getfixturevalue(name)
    # The very long text has no repeat within four words; all its periods would take hours by brute force.
    df = df.filter(F.col("text").isNull() | (F.length("text") < 5000))
    want = [(r.doc_id, *run_row(WHITE.findall(r.text or ""))) for r in df.select("doc_id", "text").collect()]
    for limit in (1, 1 << 20):
        assert key(tuple(r)[:8] for r in PR.periodic_runs(df, limit=limit).collect()) == key(want)


def test_long_texts(spark):
    """A run over a long text, nested runs, a text without any."""
    texts = ["a " * 50_000, "x " + "a a a a a a b " * 3000, " ".join(f"w{i}" for i in range(50_000)), "\x0ba b " * 7]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in PR.periodic_runs(df).collect()}
    assert (got[0].n_runs, got[0].start, got[0].length, got[0].period, got[0].exponent_milli, got[0].n_kept) == (1, 0, 50_000, 1, 50_000_000, 1)
    assert (got[1].n_runs, got[1].start, got[1].length, got[1].period, got[1].n_kept) == (3001, 1, 21_000, 7, 3)
    assert got[2].n_runs == 0 and got[2].start is None and got[2].n_kept == 50_000
    assert (got[3].n_runs, got[3].length, got[3].n_words) == (1, 7, 7)


def test_planted_repeats_and_whole_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for d, t in rows:
        w = WHITE.findall(t or "")
        h, n = zlib.crc32(str(d).encode()), len(WHITE.findall(t or ""))
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        want.append((d, *run_row(w)))
    assert sum(x[1] > 0 for x in want) > 5
    assert key(tuple(r)[:8] for r in PR.op13_periodic_runs(spark, sf).collect()) == key(want)


def test_planted_edges(spark, docs):
    got = docs.select("doc_id", "text", PR.planted(F.col("text"), F.col("doc_id")).alias("p")).collect()
    assert all(r.p == r.text for r in got if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10)
    assert all(len(WHITE.findall(r.p or "")) == len(WHITE.findall(r.text or "")) for r in got)
