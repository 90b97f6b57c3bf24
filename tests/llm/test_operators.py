"""Every operator against brute force on a fixture with nulls, ties, copies and long texts, and on sf0.001."""
import glob
import hashlib
import random
import re
import sys
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import words
from pyspark.sql import functions as F

from cohortkit.llm import chat_format, common, compact_windows, decontamination, license_scan, line_dedup, mixing, ngram_join, quality_rules
from cohortkit.llm import ragged, substring_index, token_counts
from cohortkit.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WHITE = " \t\n\x0b\f\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def key(rows):
    return sorted(rows, key=str)


# --- 1 ----------------------------------------------------------------------

def removed(texts, window):
    seen = Counter(t[i:i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        m = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if seen[t[i:i + window]] > 1:
                m[i:i + window] = True
        spans = int((np.diff(np.concatenate([[0], m.view(np.int8), [0]])) == 1).sum())
        out.append((len(t), int(m.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~m].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("name", ["docs", "clashing", "empty"])
def test_substring_dedup(request, name):
    df = request.getfixturevalue(name)
    rows = df.select("doc_id", "text").collect()
    want = [(r[0], *x) for r, x in zip(rows, removed([(r[1] or "").encode() for r in rows], 400))]
    assert key(map(tuple, substring_index.substring_dedup(df).collect())) == key(want)


def test_substring_dedup_whole_table(corpus):
    rows = corpus.select("doc_id", "text").collect()
    want = [(r[0], *x) for r, x in zip(rows, removed([(r[1] or "").encode() for r in rows], 400))]
    assert key(map(tuple, substring_index.substring_dedup(corpus).collect())) == key(want)


def test_run_index_statistics():
    rnd = random.Random(1)
    for _ in range(100):
        b = bytes(rnd.choice(b"ab\xff") for _ in range(rnd.randint(1, 120)))
        sa = substring_index.suffix_array(np.frombuffer(b, np.uint8)).tolist()
        assert sa == sorted(range(len(b)), key=lambda i: b[i:])
        common = [[next((k for k in range(len(b)) if max(i, j) + k == len(b) or b[i + k] != b[j + k]), 0) for j in range(len(b)) if j != i] for i in range(len(b))]
        assert substring_index.RunIndex(np.frombuffer(b, np.uint8)).statistics().tolist() == [max(c, default=0) for c in common]


def test_periodic_text_is_repeated_within_one_document(spark):
    df = spark.createDataFrame([(1, "ab" * 300), (2, "x" * 401), (3, "y" * 400)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_index.substring_dedup(df).collect()}
    assert got == {1: 600, 2: 401, 3: 0}


# --- 2 ----------------------------------------------------------------------

def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[-1], last[j + 1]))
    return row[-1]


def test_license_places_beside_each_other_by_brute_force():
    """Edited copies in a row, or some words apart: as many places as disjoint windows that hold the template, each on its copy."""
    r = random.Random(5)
    for trial in range(60):
        template = [r.randrange(40) for _ in range(r.choice((12, 30, 57)))]
        text, copies = [], []
        for _ in range(r.randrange(1, 5)):
            text += [r.choice((-1, r.randrange(40))) for _ in range(r.choice((0, 0, 3, 20)))]
            copy = list(template)
            edits = r.randrange(len(template) // 10 + 1)
            for i in [*range(edits)] if r.random() < 0.5 else r.sample(range(len(copy)), edits):
                copy[i] = -1
            copies.append((len(text), len(text) + len(copy)))
            text += copy
        need = -(-len(template) * 8 // 10)
        # Windows of the template's length, greedily from the left: every one that holds enough is a copy.
        ends, at = [], 0
        while at + len(template) <= len(text):
            hit = _lcs(text[at:at + len(template)], template) >= need
            ends += [at] * hit
            at += len(template) if hit else 1
        found = license_scan.scan_words(text, template, 0.8)
        assert len(found) >= max(len(ends), len(copies)), (trial, found, copies)
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))
        for a, b in copies:
            assert any(min(b, e) - max(a, s) >= 0.7 * (b - a) for s, e, _ in found), (trial, found, copies)
        for s, e, n in found:
            assert n >= need and _lcs(text[s:e], template) >= n


def test_license_first_of_two_copies():
    template = [*range(60)]
    for first, second in ((3, 0), (0, 3), (3, 3), (6, 6)):
        text = [-1] * first + template[first:] + [-1] * second + template[second:]
        assert license_scan.scan_words(text, template, 0.8) == [(first, 60, 60 - first), (60 + second, 120, 60 - second)]


def test_license_scan(spark, docs, clashing, empty):
    apache = dict(license_scan.TEMPLATES)["Apache-2.0"]
    edited = apache.replace("applicable law", "any law at all").replace("governing", "about")
    rows = [(1, f"{words(50)} ALL RIGHTS\nreserved, {words(9)}"), (2, f"{words(500)} {edited} {words(20)}"), (3, "all rights were reserved"), (4, None), (5, ""),
            (6, "All rights reserved. " * 3), (None, "released under the MIT license!")]
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.license, r.start, r.end))
    assert by[1] == [("reserved", 50, 53)] and ("reserved", 0, 4) in by[3] and len(by[6]) == 3 and by[None][0][0] == "MIT-notice"
    cover = {r.license: r.coverage for r in got if r.doc_id == 2}
    assert 0.9 < cover["Apache-2.0"] < 1
    assert license_scan.license_scan(docs).count() == license_scan.license_scan(clashing).count() == license_scan.license_scan(empty).count() == 0


def test_patience_is_a_common_subsequence():
    rnd = random.Random(3)
    for _ in range(300):
        a, b = ([rnd.randint(0, 12) for _ in range(rnd.randint(0, 30))] for _ in range(2))
        pairs = license_scan.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    assert len(license_scan.patience([1, 2, 3, 4], [1, 9, 3, 4])) == 3


# --- 3 ----------------------------------------------------------------------

def edits(piece, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(piece, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_decontamination_against_alignment_of_all(spark):
    rnd = random.Random(5)
    letters = "abcdefghij "
    item = "".join(rnd.choice(letters) for _ in range(120)).strip()
    clean = " ".join(item.split())
    docs, want = [], set()
    for i in range(40):
        part = list(clean)
        for _ in range(rnd.randint(0, 24)):
            p = rnd.randrange(len(part))
            part[p:p + 1] = rnd.choice([[], ["z"], [part[p], "y"]])
        text = "".join(rnd.choice(letters) for _ in range(200)) + "".join(part) + "".join(rnd.choice(letters) for _ in range(90))
        docs.append((i, text))
        if edits(clean, " ".join(text.split(" "))) <= decontamination.allowed(len(clean), 0.1):
            want.add(i)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short")], "item_id long, text string")
    got = {r.doc_id for r in decontamination.contaminated(df, bench).collect()}
    spaced = {i for i, t in docs if edits(clean, " ".join(t.split())) <= decontamination.allowed(len(clean), 0.1)}
    assert want <= got | spaced and got == spaced and 0 < len(got) < 40


def test_decontaminate_edges(spark, docs, clashing, empty):
    bench = spark.createDataFrame([(1, words(25, 5000)), (2, words(25, 10_020_000).upper()), (None, words(30, 123_456_789))], "item_id long, text string")
    for df in (docs, clashing):
        kept = decontamination.decontaminate(df, bench)
        assert kept.columns == df.columns and kept.count() == df.count() - 3
        gone = {r.doc_id for r in decontamination.contaminated(df, bench).collect()}
        assert gone == {8, 9, 12}
    assert decontamination.decontaminate(empty, bench).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == docs.count()


# --- 4 ----------------------------------------------------------------------

def test_escape_round_trip():
    rnd = random.Random(0)
    for _ in range(20_000):
        s = "".join(rnd.choice(["\\", "#", "##", " ", "a", ":", "\n", "<", "/turn>", "</turn>"]) for _ in range(rnd.randint(0, 9)))
        e = chat_format.escape(s)
        assert chat_format.unescape(e) == s and not any(c in e for c in ("### ", ":\n", "</turn>"))


def test_chat_format(spark, sf):
    import public_tokenizers as P
    rows = [(1, 0, "user", "### Assistant: hi </turn>\n"), (1, 1, "assistant", "<|endoftext|> \\ é😀"), (1, 2, None, None), (1, 2, "assistant", ""),
            (2, None, "assistant", "x" * 50_000), (None, 1, "a:\nb", "y"), (3, 5, "assistant", "late"), (3, 1, "user", "early"), (3, 1, "user", "early")]
    extra = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("input_ids", F.lit(1))
    args = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    table = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    for df in (extra, table, table.limit(0)):
        groups = defaultdict(list)
        for r in df.collect():
            groups[r.conv_id].append((-1 if r.turn is None else r.turn, r.role or "", r.text or ""))
        want = set()
        for c, turns in groups.items():
            turns.sort()
            loss = "".join(t for _, r, t in turns if r == "assistant")
            want.add((c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss),
                      hashlib.sha256(loss.encode()).hexdigest()))
        got = chat_format.digest_conversations(chat_format.format_turns(df, *args), *args).collect()
        assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)


# --- 5 ----------------------------------------------------------------------

def stats(text):
    t = text or ""
    w = WORD.findall(t)
    c = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if c[tuple(w[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered)


def test_quality_stats(docs, corpus):
    for df in (docs, corpus):
        got = quality_rules.with_stats(df).select("text", *quality_rules.STATS, "base_failed").collect()
        for r in got:
            s = stats(r.text)
            assert tuple(r)[1:6] == s and r.base_failed == (s[0] < 10 or 100 * s[4] > 20 * s[0])


def test_certified_cutoffs(spark):
    """A rule is used only where the exact binomial bound holds: many labels with few false rejections."""
    def rows(lang, good, bad, start):
        ok = [(start + i, words(40, i * 50), lang) for i in range(good)]
        junk = [(start + good + i, " ".join(f"|{x}" for x in words(40, i * 50).split()), lang) for i in range(bad)]
        return ok + junk, [(d, 1) for d, _, _ in ok] + [(d, 0) for d, _, _ in junk]
    big, l1 = rows("en", 1500, 60, 0)
    few, l2 = rows("fr", 30, 30, 10_000)
    docs = spark.createDataFrame(big + few + [(99_999, words(40), None), (99_998, None, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame(l1 + l2 + [(5, None)], "doc_id long, quality int").withColumn("kept", F.lit(0))
    out = quality_rules.judge(s := quality_rules.with_stats(docs), quality_rules.fit_cutoffs(s, labels)).select("doc_id", "kept").collect()
    kept = {r.doc_id: r.kept for r in out}
    assert all(kept[d] for d in range(1500)) and not any(kept[d] for d in range(1500, 1560))
    assert all(kept[10_000 + i] for i in range(60)) and kept[99_999] and not kept[99_998]


def test_tail_limit_is_exact(spark):
    from math import comb
    for n, alpha, level in ((0, 0.1, 0.01), (30, 0.1, 0.2), (500, 0.01, 0.05), (2000, 0.02, 1e-4)):
        got = spark.range(1).select(quality_rules._tail_limit(F.lit(n).cast("long"), alpha, F.lit(level))).first()[0]
        total, want = 0.0, -1
        for k in range(n + 1):
            total += comb(n, k) * alpha ** k * (1 - alpha) ** (n - k)
            if total > level:
                break
            want = k
        assert got == want


def test_quality_filter_keeps_columns(docs, clashing, empty, spark):
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    a, b = quality_rules.quality_filter(docs, labels), quality_rules.quality_filter(clashing, labels)
    assert a.columns == docs.columns and b.columns == clashing.columns and a.count() == b.count() > 0
    assert quality_rules.quality_filter(empty, labels).count() == 0 == quality_rules.quality_filter(docs.limit(0), labels.limit(0)).count()


# --- 6 ----------------------------------------------------------------------

def lines_kept(rows, least):
    def k(x):
        return x.strip(WHITE).translate(FOLD)
    refs = Counter(x for t in rows for x in {k(y) for y in (t or "").split("\n")} if x)
    out = []
    for t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if refs.get(k(x), 0) < least]
        out.append((len(parts), len(parts) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("name", ["docs", "clashing", "empty", "corpus"])
def test_line_dedup(request, spark, name):
    df = request.getfixturevalue(name)
    rows = df.select("doc_id", "text").collect()
    want = [(r.doc_id, *x) for r, x in zip(rows, lines_kept([r.text for r in rows], 10))]
    state = line_dedup.insert_documents(line_dedup.empty_state(spark), df)
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in line_dedup.drop_lines(state, df, counts=True).collect()]
    assert key(got) == key(want)
    whole = line_dedup.drop_lines(state, df)
    assert whole.columns == df.columns and key(r.text or "" for r in whole.collect()) == key(w[3] for w in want)


def test_line_state_is_reversible(spark, corpus):
    a, b = corpus.filter("doc_id % 3 > 0"), corpus.filter("doc_id % 3 = 0")
    only = line_dedup.insert_documents(line_dedup.empty_state(spark, 3), a)
    both = line_dedup.insert_documents(only, b)
    back = line_dedup.delete_documents(both, b)
    assert key(map(tuple, back.refs.collect())) == key(map(tuple, only.refs.collect()))
    want = key(map(tuple, line_dedup.drop_lines(only, a).collect()))
    assert key(map(tuple, line_dedup.drop_lines(back, a).collect())) == want
    hot = back.refs.filter("n >= 3").toPandas()
    filters = {r.shard: line_dedup.CuckooFilter(r.buckets, bytes(r.cells)) for r in back.filters.collect()}
    for s, part in hot.groupby(np.mod(hot.k1, back.shards)):
        assert filters[s].contains(part.k1.to_numpy(), part.k2.to_numpy()).all()


def test_cuckoo_filter():
    rng = np.random.default_rng(2)
    k = rng.integers(-2**63, 2**63 - 1, (2, 5000))
    f = line_dedup.CuckooFilter.for_keys(4000)
    assert f.insert(k[0, :4000], k[1, :4000]) and f.contains(k[0, :4000], k[1, :4000]).all()
    assert f.contains(k[0, 4000:], k[1, 4000:]).mean() < 0.01
    f.delete(k[0, :2000], k[1, :2000])
    assert f.contains(k[0, 2000:4000], k[1, 2000:4000]).all() and f.contains(k[0, :2000], k[1, :2000]).mean() < 0.05
    assert not line_dedup.CuckooFilter(16).insert(k[0, :200], k[1, :200])


# --- 7 ----------------------------------------------------------------------

def test_token_counts(docs, clashing, corpus, empty):
    import public_tokenizers
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for df in (docs, clashing, corpus, empty):
        want = [(r.doc_id, len((r.text or "").encode()), n := len(sp.encode(r.text or "")), n > 4096) for r in df.select("doc_id", "text").collect()]
        assert key(map(tuple, token_counts.token_counts(df, path).collect())) == key(want)


def test_token_counts_of_odd_strings():
    import public_tokenizers
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    c, sp, rnd = token_counts.PieceCounter(path), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(4)
    parts = ["a", "b", " ", "  ", "the", "\n", "\t", "é", "漢", "字", "\u2581", "<s>", "<0x0A>", "\x00", "ing", "😀", "aaaa", "\u0301"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 150))) for _ in range(1500)] + ["a" * 600, " " * 400 + "x", "漢字" * 3000]
    assert c.count_all(texts) == [len(x) for x in sp.encode(texts)]


# --- 8 ----------------------------------------------------------------------

def water(sizes, weights, share, cap):
    goal, live, rest = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while live:
        w = sum(weights[i] for i in live)
        over = [i for i in live if rest * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in live:
                goal[i] = rest * weights[i] / w
            break
        for i in over:
            goal[i] = cap * sizes[i]
            live.discard(i)
            rest -= goal[i]
    return goal


@pytest.mark.parametrize("name", ["docs", "clashing", "corpus"])
def test_mix(request, name):
    df = request.getfixturevalue(name)
    out = mixing.mix(df).collect()
    sizes = defaultdict(int)
    for r in df.select("source", "text").collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, water([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5, 2)))
    taken, largest = defaultdict(int), defaultdict(int)
    assert len(out) == df.count()
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source]) and len(r.draws) <= 2
        taken[r.source] += r["size"] * len(r.draws)
        largest[r.source] = max(largest[r.source], r["size"])
        assert [d.copy for d in r.draws] == list(range(len(r.draws)))
    for s in order:
        assert abs(taken[s] - goal[s]) <= largest[s]
    again = mixing.mix(df.repartition(5)).collect()
    assert key((r.doc_id, r["size"], str(r.draws)) for r in again) == key((r.doc_id, r["size"], str(r.draws)) for r in out)


def test_mix_of_more_sources_than_a_tree_takes(spark, corpus, monkeypatch):
    more = corpus.withColumn("source", F.when(F.col("doc_id") % 9 > 0, F.concat("source", (F.col("doc_id") % 13).cast("string"))))
    plain = {r.doc_id: r for r in mixing.mix(more, shards=4).collect()}
    monkeypatch.setattr(mixing, "MAX_SOURCES", 20)
    many = {r.doc_id: r for r in mixing.mix(more, shards=4).collect()}
    assert len({r.source for r in plain.values()}) > 40
    assert {k: (r.size, r.source_size, r.target, len(r.draws)) for k, r in plain.items()} == {k: (r.size, r.source_size, r.target, len(r.draws)) for k, r in many.items()}
    shards = Counter(d.shard for r in many.values() for d in r.draws)
    assert sorted(shards) == [0, 1, 2, 3] and max(shards.values()) < 1.3 * min(shards.values())


def test_mix_edges(docs, clashing, empty):
    assert mixing.mix(empty).count() == 0 == mixing.mixed_rows(empty).count()
    assert mixing.mix(docs.filter("text is null")).count() == 2
    n = sum(len(r.draws) for r in mixing.mix(docs).collect())
    assert mixing.mixed_rows(docs).count() == n
    out = mixing.mixed_rows(clashing)
    assert out.columns == clashing.columns and out.count() == n and out.filter("copy <> 'own copy'").count() == 0


def test_splitting_tree():
    q = np.array([1000, 0, 37, 5])
    t = mixing.split_quotas(q, 7, 3)
    assert (t.sum(axis=1) == q).all() and (t >= 0).all() and np.ptp(t.sum(axis=0)) <= 3
    assert (t == mixing.split_quotas(q, 7, 3)).all()


# --- 9 ----------------------------------------------------------------------

def test_compact_windows_cover_all_subsequences():
    rng = np.random.default_rng(0)
    for n in (5, 9, 40):
        v = rng.integers(0, 2**63, n).astype(np.uint64)
        lo, c, hi = compact_windows.compact_windows(v, np.array([0]), np.array([n]), 4)
        for i in range(n):
            for j in range(i + 3, n):
                own = [int(k) for a, k, b in zip(lo, c, hi) if a <= i <= k <= j <= b]
                assert own == [i + int(np.argmin(v[i:j + 1] >> np.uint64(32)))]


def test_passages(spark, docs, clashing, empty):
    rnd = random.Random(8)
    text = lambda n: " ".join(f"t{rnd.randrange(10**9)}" for _ in range(n))
    passages = [text(rnd.randint(55, 200)) for _ in range(30)]
    rows, want = [], set()
    for p, x in enumerate(passages):
        for c in range(3):
            near = " ".join(w if (rnd.random() > 0.012 or c == 0) else "zz" for w in x.split())
            rows.append((p * 10 + c, f"{text(rnd.randint(0, 300))} {near.upper() if c == 2 else near} {text(rnd.randint(0, 300))}"))
            want.add(p * 10 + c)
    rows += [(1000 + i, text(400)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = compact_windows.near_duplicate_passages(df).collect()
    by = {d: [w.lower() for w in WORD.findall(t)] for d, t in rows}
    for r in got:
        a, b = by[r.doc_id][r.start:r.end], by[r.rep_doc_id][r.rep_start:r.rep_end]
        x, y = ({tuple(s[i:i + 5]) for i in range(len(s) - 4)} for s in (a, b))
        assert min(len(a), len(b)) >= 50 and r.similarity == pytest.approx(len(x & y) / len(x | y)) and r.similarity >= 0.8
        assert r.doc_id // 10 == r.rep_doc_id // 10
    found = {r.doc_id for r in got} | {r.rep_doc_id for r in got}
    assert found <= want and len(found) >= 0.9 * len(want)
    x, y = (compact_windows.near_duplicate_passages(d) for d in (docs, clashing))
    assert key((r.doc_id, r.start, r.end) for r in x.collect()) == key((r.doc_id, r.start, r.end) for r in y.collect()) != []
    assert compact_windows.near_duplicate_passages(empty).count() == 0


def test_passages_behind_strangers(spark):
    """Two documents share a passage; parts of it shorter than a passage stand in many others."""
    rnd = random.Random(5)
    text = lambda n: " ".join(f"t{rnd.randrange(10**9)}" for _ in range(n))
    rows = []
    for p in range(20):
        x = text(60)
        rows += [(1000 * p + c, f"{text(80)} {x} {text(80)}") for c in range(2)]
        rows += [(1000 * p + 10 + i, f"{text(90)} {' '.join(x.split()[i % 3 * 12:][:36])} {text(90)}") for i in range(24)]
    got = compact_windows.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(min(r.doc_id, r.rep_doc_id), max(r.doc_id, r.rep_doc_id)) for r in got} == {(1000 * p, 1000 * p + 1) for p in range(20)}


def test_outline_bounds_what_passages_share():
    """The filter before the verification: its least count holds for every window, and it loses no pair that has a passage."""
    from cohortkit.llm.compact_windows import outline, verify
    rng, least, kept = np.random.default_rng(5), 46, 0
    for k in range(300):
        a = rng.integers(0, (8, 60, 1 << 60)[k % 3], int(rng.integers(least, 150))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        b = a.copy()
        b[rng.integers(0, len(b), k % 40)] = rng.integers(0, 1 << 60, k % 40).astype(np.uint64)
        (n, few, half), (m, less, other) = outline(a, least), outline(b, least)
        assert few <= min(len(np.unique(a[i:i + least])) for i in range(len(a) - least + 1))
        common = len(np.intersect1d(half, other)) + min(n - len(half), m - len(other))
        assert common >= len(np.intersect1d(a, b))
        if verify(a, b, least, 80):
            kept += 1
            assert 100 * common >= 80 * max(few, less)
    assert kept > 50
    assert outline(np.zeros(60, np.uint64), least)[:2] == (1, 1)


def test_verify_follows_every_shift():
    """A passage whose parts stand earlier in the other text, beside four larger ones."""
    rnd = np.random.default_rng(3)
    new = lambda n: rnd.integers(0, 2**63, n).astype(np.uint64)
    x, large = new(60), [new(90) for _ in range(4)]
    a = np.concatenate([v for g in large for v in (g, new(30))] + [x])
    b = np.concatenate([x[:20], new(50), x[20:40], new(50), x[40:], new(50)] + [v for i, g in enumerate(large) for v in (new(37 * (i + 1)), g)] + [new(40), x])
    got = compact_windows.verify(a, b, 46, 80)
    assert (len(a) - 60, len(a) - 1, len(b) - 60, len(b) - 1) in {g[:4] for g in got}
    # A hit that overlaps two groups counts in both.
    hits = np.array([(0, 0, 60, 0, 60), (1, 0, 60, 100, 160), (2, 10, 60, 20, 140)])
    assert len(compact_windows.sweep(hits, 2, 46)) == 2


def test_passages_in_runs(spark, monkeypatch):
    """Joins made in several runs give the rows of one run, and no run holds all hits."""
    rnd = random.Random(6)
    text = lambda n: " ".join(f"t{rnd.randrange(10**9)}" for _ in range(n))
    rows = []
    for p in range(8):
        x = text(70)
        rows += [(100 * p + c, f"{text(60)} {x} {text(60)}") for c in range(3)]
        rows += [(100 * p + 10 + i, f"{text(60)} {x[:x.index(x.split()[40])]} {text(60)}") for i in range(9)]
    df, tables, real = spark.createDataFrame(rows, "doc_id long, text string"), [], compact_windows.stage

    def staged(table, tag):
        tables.append((tag, real(table, tag)))
        return tables[-1][1]

    once = key(map(tuple, compact_windows.near_duplicate_passages(df).collect()))
    monkeypatch.setattr(compact_windows, "stage", staged)
    monkeypatch.setattr(compact_windows, "_slices", lambda size, share: 3)
    assert key(map(tuple, compact_windows.near_duplicate_passages(df).collect())) == once and len(once) >= 16
    # Two rounds of stars and the last one; the runs of a join are tables of their own.
    assert [sum(t == tag for t, _ in tables) for tag in ("op9-pairs", "op9-near", "op9-verified")] == [5, 9, 9]


def test_runs_follow_the_rows():
    assert [compact_windows._slices(*x) for x in ((0, 0), (None, None), (10, 10), (11, 10), (95, 10), (7, 0))] == [1, 1, 1, 2, 10, 7]


def test_candidates_across_batches():
    """Sorted hits cut into batches anywhere give the candidates of every pair on its own."""
    import pyarrow as pa
    rng, rows = np.random.default_rng(4), []
    for r in range(12):
        for rep in range(int(rng.integers(1, 5))):
            for _ in range(int(rng.integers(1, 9))):
                lo, at = rng.integers(0, 40, 4), []
                at = [(int(v) << 32) + int(v) + int(rng.integers(46, 90)) for v in lo]
                rows += [(r, rep, int(rng.integers(0, 2)) | 2 << 8, *at)] * int(rng.integers(1, 3))
    want = []
    for pair in dict.fromkeys(x[:2] for x in rows):
        hits = sorted({h for x in rows if x[:2] == pair for i in (0, 1)
                       for h in [(x[2] >> 8 * i & 255, x[3 + 2 * i] >> 32, x[3 + 2 * i] & 0xFFFFFFFF, x[4 + 2 * i] >> 32, x[4 + 2 * i] & 0xFFFFFFFF)]},
                      key=lambda h: (h[1], h[2], h[0], h[3], h[4]))
        want += [(*pair, *c) for c in compact_windows.sweep(np.array(hits), 2, 46)]
    whole = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=list("abcdefg"))
    for n in (1, 2, 7, len(rows)):
        got = [tuple(x.values()) for b in compact_windows._candidates(2, 46)(whole.slice(i, n) for i in range(0, len(rows), n)) for x in b.to_pylist()]
        assert sorted(got) == sorted(want) and want


# --- 10 ---------------------------------------------------------------------

def link_components(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(FOLD))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    least = list(range(len(rows)))
    posts = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            posts[x].add(i)
    todo = True
    links = {(i, j) for i, s in enumerate(sets) for j in {j for x in s for j in posts[x]} if j > i and 100 * len(s & sets[j]) >= 80 * len(s | sets[j])}
    while todo:
        todo = False
        for i, j in links:
            if least[i] != least[j]:
                least[i] = least[j] = min(least[i], least[j])
                todo = True
    ids = defaultdict(list)
    for i, c in enumerate(least):
        if rows[i][0] is not None:
            ids[c].append(rows[i][0])
    return [(rows[i][0], len(s), min(ids[c]) if s and ids[c] else rows[i][0]) for i, (s, c) in enumerate(zip(sets, least))]


@pytest.mark.parametrize("name", ["docs", "clashing", "empty", "corpus", "near"])
def test_ngram_join(request, spark, name):
    if name == "near":  # one large group of near copies, and a passage that most documents share
        rnd = random.Random(6)
        base, common = words(150), words(60, 900_000)
        rows = [(i, " ".join(w if rnd.random() > 0.02 else f"e{rnd.randrange(10**6)}" for w in base.split())) for i in range(150)]
        rows += [(1000 + i, f"{common} {words(rnd.randint(5, 120), 10**6 + 1000 * i)}") for i in range(150)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
    else:
        df = request.getfixturevalue(name)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert key(map(tuple, ngram_join.similar_components(df).collect())) == key(link_components(rows))


def test_keep_one_per_group(docs, clashing, empty):
    kept = ngram_join.keep_one_per_group(clashing)
    assert kept.columns == clashing.columns
    rows = ngram_join.keep_one_per_group(docs).collect()
    # 4, 5, 6 and the row without an id are one group, 8 and 9 another; id 7 has two texts of its own
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [0, 1, 2, 3, 4, 7, 7, 8, *range(10, 24)]
    assert [r.text for r in rows if r.doc_id is None] == [None] and kept.count() == len(rows)
    assert ngram_join.keep_one_per_group(empty).count() == 0


def test_prefixes_share_enough():
    rng = np.random.default_rng(1)
    for _ in range(300):
        pool = rng.integers(0, 2**63, 80).astype(np.uint64)
        x = np.unique(rng.choice(pool, rng.integers(1, 60)))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.1], rng.choice(pool, 2)]))
        both = len(np.intersect1d(x, y))
        if 100 * both < 80 * (len(x) + len(y) - both):
            continue
        df = rng.integers(0, 3, 80) * 7
        at = {int(v): int(d) for v, d in zip(pool, df)}
        (p, l, _), (q, m, _) = (ngram_join.plan_prefix(s, np.array([at[int(v)] for v in s]), 80) for s in (x, y))
        assert len(np.intersect1d(p, q)) >= min(l, m)


def test_parity_bitmaps_lose_no_link(spark):
    """The bitmaps differ in at most the shingles that one set alone has, for small and wide sets, and pass every link."""
    rng = np.random.default_rng(8)
    rows, truth = [], []
    for _ in range(300):
        n = int(rng.choice([1, 3, 40, 250, 262, 900, 3000]))
        a = np.unique(rng.integers(0, 2 ** 64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.choice([0.5, 0.85, 0.95, 1.0])], rng.integers(0, 2 ** 64, int(rng.integers(0, 1 + n // 8)), dtype=np.uint64)]))
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        truth.append((100 * both >= 80 * (len(a) + len(b) - both), len(a) + len(b) - 2 * both))
        rows.append(tuple(x for s in (a, b) for x in (len(s), *ngram_join.parity(s, 256).tolist(), ngram_join.parity(s, 1024).tolist() if len(s) > 256 else None)))
    cols = [f"{p}{c}" for p in "xy" for c in ("n", *ngram_join.PARITY)]
    kinds = ", ".join(f"{c} {'array<long>' if c.endswith('wide') else 'int' if c.endswith('n') else 'long'}" for c in cols)
    df = spark.createDataFrame(rows, kinds)
    differ = sum((F.bit_count(F.col(f"xs{i}").bitwiseXOR(F.col(f"ys{i}"))) for i in range(4)), F.lit(0))
    got = df.select(ngram_join._may_link("x", "y", 80).alias("ok"), differ.alias("d")).collect()
    assert all(g.ok for g, (link, _) in zip(got, truth) if link) and all(g.d <= alone for g, (_, alone) in zip(got, truth))
    assert sum(not g.ok for g in got) > 50


def test_ngram_join_without_lists_sent(spark, corpus, monkeypatch):
    """More nodes and shingles than are sent to the tasks: the same rows by joins."""
    want = key(map(tuple, ngram_join.similar_components(corpus).collect()))
    monkeypatch.setattr(ngram_join, "SEND_NODES", 0)
    monkeypatch.setattr(ngram_join, "SEND_TOKENS", 0)
    assert key(map(tuple, ngram_join.similar_components(corpus).collect())) == want


def test_near_misses_make_no_rows(spark):
    """Texts of 148 shingles that share three quarters of them: next to no pair passes the bitmaps."""
    rows = [(i, f"{words(130)} {words(22, 10**6 + 1000 * i)}") for i in range(60)]
    p = ngram_join._prefixes(spark.createDataFrame(rows, "doc_id long, text string"), (np.zeros(0, np.int64),) * 2, 80)
    p = p.select("node", "n", *ngram_join.PARITY).cache()
    x, y = p.alias("x"), p.alias("y")
    assert x.join(y, (F.col("x.node") < F.col("y.node")) & ngram_join._may_link("x.", "y.", 80)).count() <= 18  # of 1770
    p.unpersist()


def test_ngram_join_by_pivots_of_parts(spark, monkeypatch):
    """Rounds of pivots until none is left: the same components as brute force, and no staged table left but the result's."""
    rnd = random.Random(11)
    rows = [(i, " ".join(w if rnd.random() > 0.03 else f"e{rnd.randrange(10**6)}" for w in words(150).split())) for i in range(120)]
    monkeypatch.setattr(ngram_join, "MANY_PAIRS", 0)
    monkeypatch.setattr(ngram_join, "FRUITFUL", 0)
    monkeypatch.setattr(ngram_join, "PER_PIVOT", 8)
    made, gone = [], []
    for module in (ngram_join, sys.modules[components.__module__]):
        monkeypatch.setattr(module, "stage", lambda df, tag: made.append(common.stage(df, tag)) or made[-1])
        monkeypatch.setattr(module, "unstage", lambda *tables: gone.extend(t._staged_at for t in tables) or common.unstage(*tables))
    got = key(map(tuple, ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == key(link_components(rows))
    assert [m._staged_at for m in made if m._staged_at not in gone and "op10-scan" not in m._staged_at] == [made[-1]._staged_at]


def test_ngram_join_sets_of_wanted_texts(spark):
    """Only the texts of wanted sets become shingles again; a copy in other letters has the same set."""
    rows = [(i, words(40, 1000 * i)) for i in range(20)] + [(20, words(40, 3000).upper()), (21, None), (22, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    members = ngram_join._scan(docs, 80).select("doc_id", "t", "n", "digest")
    node = {r.doc_id: r.node for r in members.select("doc_id", ngram_join._node_of(F.col("digest")).alias("node")).collect()}
    nodes = spark.createDataFrame([(node[3],), (node[5],), (node[5],)], "a long")
    got = ngram_join._wanted_sets(docs, members, nodes).collect()
    assert sorted(r.node for r in got) == sorted([node[3], node[5]]) and node[3] == node[20]
    assert {len(r.set) for r in got} == {36} and {len(r.half) for r in got} == {36}


def test_ngram_join_stops_pivots_that_remove_little(spark, monkeypatch):
    """Rounds that no longer remove a tenth of the pairs are the last ones: fewer rounds, the same components."""
    rnd = random.Random(12)
    rows = [(i, " ".join(w if rnd.random() > 0.06 else f"e{rnd.randrange(10**6)}" for w in words(120).split())) for i in range(80)]
    monkeypatch.setattr(ngram_join, "MANY_PAIRS", 0)
    monkeypatch.setattr(ngram_join, "FRUITFUL", 0)
    tags = []
    monkeypatch.setattr(ngram_join, "stage", lambda df, tag: tags.append(tag) or common.stage(df, tag))
    monkeypatch.setattr(ngram_join, "_between", lambda posts, done: (common.stage(posts.withColumn("comp", F.col("node")).withColumn("held", F.lit(80)), "live"), 1000, 1))
    got = key(map(tuple, ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == key(link_components(rows))
    assert tags.count("op10-pairs") == 3  # two rounds, then the pairs that are left


def test_components_of_a_star_take_one_step(spark, monkeypatch):
    made, module = [], sys.modules[components.__module__]
    monkeypatch.setattr(module, "stage", lambda df, tag: made.append(common.stage(df, tag)) or made[-1])
    links = spark.createDataFrame([(i, 0) for i in range(1, 30)] + [(5, 0), (3, 3)], "u long, v long")
    assert {r.node: r.component for r in components(links).collect()} == {i: 0 for i in range(30)}
    assert len(made) == 1


def test_stage_removes_shuffles(spark):
    before = set(shuffle_files(spark))
    df = spark.range(10_000).withColumn("k", F.col("id") % 100).groupBy("k").count()
    df = common.stage(df.join(spark.range(100).repartition(3), F.col("k") == F.col("id")), "test-shuffles")
    for _ in range(50):  # removed by a message to the block manager
        if not set(shuffle_files(spark)) - before:
            break
        time.sleep(0.1)
    assert not set(shuffle_files(spark)) - before and df.count() == 100


def shuffle_files(spark):
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return [p for d in folder for p in glob.glob(f"{d}/*/shuffle_*.data")]


def test_components(spark):
    rnd = random.Random(9)
    links = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    least = {x: x for p in links for x in p if p[0] != p[1]}
    for _ in range(100):
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert got == least
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- helpers ----------------------------------------------------------------

def test_word_hashes():
    texts = [None, "", "  a B\tc ", "x" * 5000, "A b", "é É", words(20_000)] * 3
    h, at = ragged.word_hashes(pa.array(texts))
    seen = {}
    for t, a, b in zip(texts, at[:-1], at[1:]):
        own = WORD.findall((t or "").translate(FOLD))
        assert len(own) == b - a
        for w, x in zip(own, h[a:b].tolist()):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
