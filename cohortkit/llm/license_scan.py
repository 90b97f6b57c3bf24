"""Operator 2, license scans: patience alignment of texts with license templates.

Words are compared by their lower-cased hash, punctuation at word ends aside.
A window of the text can reach a coverage only if it holds that many of the
template's words, counted with repeats; this bound over the whole text, then
over windows of twice the template's length, leaves few places.  A place is
aligned, in windows of the template's length and a quarter more first, so that
the next copy's words do not take part, then in the wide one: equal words at both ends are matched, words that are unique in both
the window and the template become anchors, the longest increasing subsequence
of anchors is kept, and the gaps between them are aligned the same way.
Matched words over the template's words is the coverage.

Edge cases: null and empty texts match nothing; a template without words is
an error; every place in a text is reported, places of one template do not
overlap; equal templates under two names are both reported; repeated rows are
scanned one by one; extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.llm.common import read
from cohortkit.llm.ragged import batches_of, word_hashes
from cohortkit.llm.registry import query

# Notices and headers of public licenses.
TEMPLATES: list[tuple[str, str]] = [
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("MIT-notice", "Released under the MIT License."),
    ("reserved", "All rights reserved."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
                   "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                   "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
                   "governing permissions and limitations under the License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
            "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
            "included in all copies or substantial portions of the Software."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                     "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
                     "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
                     "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program "
                "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
                "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
            "that the above copyright notice and this permission notice appear in all copies."),
]


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Matched places (i, j) of two sequences, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        one_a, one_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {b[j]: j for j in range(b0, b1)}
        anchors = [(i, at[a[i]]) for i in range(a0, a1) if one_a[a[i]] == 1 and one_b.get(a[i]) == 1]
        # Longest increasing subsequence: piles by their top, with a link to the pile before.
        tops: list[int] = []
        ends: list[int] = []
        back = [-1] * len(anchors)
        for k, (_, j) in enumerate(anchors):
            p = bisect_left(tops, j)
            back[k] = ends[p - 1] if p else -1
            tops[p:p + 1], ends[p:p + 1] = [j], [k]
        chain, k = [], ends[-1] if ends else -1
        while k >= 0:
            chain.append(anchors[k])
            k = back[k]
        if not chain:
            continue
        chain.reverse()
        out += chain
        todo += [(i0 + 1, i1, j0 + 1, j1) for (i0, j0), (i1, j1) in
                 zip([(a0 - 1, b0 - 1), *chain], [*chain, (a1, b1)])]
    return sorted(out)


def _place(words: Sequence[int], template: Sequence[int], start: int, widths: Sequence[int], need: int) -> tuple[int, int, int] | None:
    """The aligned place in the first of the windows that holds as many words as needed."""
    for width in widths:
        pairs = patience(words[start:start + width], template)
        if len(pairs) >= need:
            return start + pairs[0][0], start + pairs[-1][0] + 1, len(pairs)
    return None


def scan_words(words: Sequence[int], template: Sequence[int], coverage: float) -> list[tuple[int, int, int]]:
    """(first word, end, matched words) of the places where the template is covered."""
    own, need = Counter(template), -(-int(round(coverage * len(template) * 1000)) // 1000)
    hits = [i for i, w in enumerate(words) if w in own]
    width, near = 2 * len(template), (len(template), len(template) + -(-len(template) // 4))
    out, have, held, right, k = [], 0, Counter(), 0, 0
    while k < len(hits):
        while right < len(hits) and hits[right] < hits[k] + width:
            w = words[hits[right]]
            held[w] += 1
            have += held[w] <= own[w]
            right += 1
        skip = k + 1
        if have >= need:
            place = _place(words, template, hits[k], near, need)
            if place is None and (place := _place(words, template, hits[k], [hits[right - 1] + 1 - hits[k]], need)):
                # The wide window may have aligned a later copy, or parts of two: the first that stands alone counts.
                later = hits[k + 1:bisect_left(hits, place[1])]
                place = next((p for h in later if (p := _place(words, template, h, near, need))), place)
            if place:
                out.append(place)
                skip = bisect_left(hits, place[1])
        for x in range(k, min(skip, right)):
            w = words[hits[x]]
            have -= held[w] <= own[w]
            held[w] -= 1
        right, k = max(right, skip), skip
    return out


def _plain(text):
    """Punctuation beside white space or a text's ends does not count."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[\p{Punct}]+(?=[\x20\x09-\x0D]|$)", " "), r"(^|[\x20\x09-\x0D])[\p{Punct}]+", " ")


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, coverage: float = 0.8) -> DataFrame:
    """(doc_id, license, start, end, matched, coverage): places are words that hold a letter or digit."""
    spark = docs.sparkSession
    named = spark.createDataFrame(templates or TEMPLATES, "name string, text string")
    names, texts = zip(*[(r[0], r[1]) for r in named.select("name", _plain(F.col("text"))).collect()])
    hashes, at = word_hashes(pa.array(texts))
    plain = [hashes[a:b] for a, b in zip(at[:-1], at[1:])]
    if not all(map(len, plain)):
        raise ValueError("a template has no words")
    sent = spark.sparkContext.broadcast((names, plain))
    idt = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, plain = sent.value
        vocab = np.unique(np.concatenate(plain))
        as_ids = [np.searchsorted(vocab, t) for t in plain]
        counts = np.stack([np.bincount(t, minlength=len(vocab)) for t in as_ids])
        need = np.ceil(coverage * counts.sum(axis=1) - 1e-9)
        for whole in batches:
            for b in batches_of(whole, 1):
                words, at = word_hashes(b.column(1))
                ids = np.minimum(np.searchsorted(vocab, words), len(vocab) - 1)
                ids = np.where(vocab[ids] == words, ids, -1)
                row = np.repeat(np.arange(b.num_rows), np.diff(at))
                known = ids >= 0
                held = np.bincount(row[known] * len(vocab) + ids[known], minlength=b.num_rows * len(vocab)).reshape(b.num_rows, -1)
                found = []
                for t, name in enumerate(names):
                    used = np.flatnonzero(counts[t])
                    bound = np.minimum(held[:, used], counts[t][used]).sum(axis=1)
                    for i in np.flatnonzero(bound >= need[t]).tolist():
                        own = ids[at[i]:at[i + 1]].tolist()
                        found += [(i, name, s, e, n, n / len(plain[t])) for s, e, n in scan_words(own, as_ids[t].tolist(), coverage)]
                if found:
                    i, *rest = zip(*found)
                    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), *(pa.array(c, t) for c, t in zip(rest, types))],
                                                     names=["doc_id", "license", "start", "end", "matched", "coverage"])

    return docs.select("doc_id", _plain(F.col("text")).alias("text")).mapInArrow(
        run, f"doc_id {idt}, license string, start long, end long, matched long, coverage double")


@query("op2_license_scan")
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))
