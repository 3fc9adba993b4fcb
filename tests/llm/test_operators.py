"""Every operator against a brute-force version on small texts with nulls, empties, repeats and ties."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlight.llm import fingerprints, license_scan, line_dedup, lm_scoring, mixing, ngram_join, packing, quality_rules, substring_dedup, suffix_dedup
from wardlight.llm.queries import ORACLE as QUERY_SQL
from wardlight.llm.queries import QUERIES, tokenizer_path
from wardlight.llm.shared import merge_intervals

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefgé") for _ in range(draw.randint(2, 6)))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    shared = line(120)
    texts = [None, "", "   \n\t", "one", "one two three four", "one two three four"]
    for i in range(22):
        own = "\n".join(line(draw.randint(4, 40)) for _ in range(draw.randint(1, 6)))
        texts.append(own if i % 3 else own + "\n" + shared)
    texts += [texts[8], texts[9], texts[9] + " more", texts[10].replace(" ", "  ", 1), "x " * 300, "ab" * 700, ("ab" * 700)[1:], "Licensed under the Apache License, Version 2.0.\n" + line(60)]
    words = texts[12].split(" ")
    words[len(words) // 2] = "changed"
    texts.append(" ".join(words))
    lines = texts[13].split("\n")
    texts.append("\n".join([lines[0][:-3] + "q."] + lines[1:]))
    return [(i * 3, t, "en", f"src{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return (text or "").encode().split()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def shingle_set(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_merge_intervals():
    a, z = merge_intervals(np.array([5, 0, 3]), np.array([7, 3, 4]))
    assert (a.tolist(), z.tolist()) == ([0, 5], [4, 7])


def expected_classes():
    links, parent = Counter(), {r[0]: r[0] for r in ROWS}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {r[0]: shingle_set(r[1]) for r in ROWS}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (root(i), links[i]) for i in sets}


@pytest.mark.parametrize("find", [ngram_join.near_duplicates, fingerprints.near_duplicates])
def test_near_duplicates(docs, find):
    got = {i: (r.class_id, r.n_links) for i, r in by_id(find(docs)).items()}
    assert got == expected_classes()


def test_prefixes_shorten_as_far_as_the_pairs_found_ask():
    least = ngram_join.shallowest(0.8, 0.998, 12, 8)
    assert ngram_join.reach(0.8, least, 12) >= 0.998 > ngram_join.reach(0.8, least + 1, 12)
    after = lambda depth, pairs: ngram_join.shortened(depth, pairs, 0.8, 0.998, 12, least)
    assert after(8, {98: 10**6}) is None  # whole labels find all of these
    assert after(8, {98: 10**6, 86: 1}) == 6  # too few of those
    assert after(6, {98: 10**6, 86: 2, 84: 1}) == 5
    assert after(8, {98: 10**6, 80: 1}) == least
    assert after(8, {98: 3}) == after(8, {}) == least  # too little is known
    assert after(least, {80: 5}) is None


def test_nodes_of_the_forest(spark):
    draw = random.Random(4)
    marks = [[draw.randint(0, 2) for _ in range(8)] for _ in range(300)]
    rows = [(k, np.asarray(m, "<u2").tobytes()) for k, m in enumerate(marks)]
    for part in (1, 3):
        texts = spark.createDataFrame(rows, "rep long, marks binary").repartition(part)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        got = ngram_join.forest(texts, 2, 4, 2).collect()
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
        label = lambda r, t, d: tuple(marks[r][4 * t : 4 * t + d])
        for d in (2, 3, 4):
            sizes = Counter((t, label(r, t, d)) for r in range(300) for t in (0, 1))
            met = [r for r in got if r.depth >= d]
            assert {(r.rep, r.tree) for r in met} == {(r, t) for r in range(300) for t in (0, 1) if sizes[t, label(r, t, d)] > 1}
            assert len({(r.tree, r.nodes[d - 2]) for r in met}) == len({(r.tree, label(r.rep, r.tree, d)) for r in met}) == len({(r.tree, r.nodes[d - 2], label(r.rep, r.tree, d)) for r in met})


def test_one_of_each_keeps_columns_and_one_per_class(docs):
    out = ngram_join.one_of_each(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {i for i, (c, _) in expected_classes().items() if c == i}


def test_fingerprints(docs):
    got = by_id(fingerprints.fingerprints(docs))
    for k, (i, t, *_) in enumerate(ROWS):
        t, after = t or "", ROWS[(k + 1) % len(ROWS)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingle_set(t), shingle_set(edited)
        likeness = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(r.near_edited - likeness) < 0.2 and 0 <= r.near_next <= 1
    same = Counter(r.fingerprint for i, r in got.items() if (ROWS[i // 3][1] or "") == ROWS[8][1])
    assert list(same.values()) == [2]


def test_single_document_is_its_own_next(spark):
    r = fingerprints.fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1.0


def test_language_model_probabilities_add_up_and_base_matches(spark, docs):
    got = by_id(lm_scoring.train_and_score(docs))
    counts, held = Counter(), {}
    for i, t, *_ in ROWS:
        tokens = [w for w in (t or "").encode().lower().split()] + [None]
        held[i] = zlib.crc32(str(i).encode()) % 7 == 2
        if not held[i]:
            counts.update(tokens)
    total, types = sum(counts.values()), len(counts)
    for i, t, *_ in ROWS:
        tokens = [w for w in (t or "").encode().lower().split()] + [None]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (total + types + 1)) for w in tokens))
        assert r.score < 0
    expected = kneser_ney([t for i, t, *_ in ROWS if not held[i]])
    for i, t, *_ in ROWS:
        assert got[i].score == pytest.approx(expected(t), rel=1e-9)


@pytest.mark.parametrize("share", [1, 40])
def test_language_model_of_order_3(spark, docs, monkeypatch, share):
    """Against the definition; with a share of 40 many contexts are spread over the buckets."""
    monkeypatch.setattr(lm_scoring, "SHARE", share)
    got = by_id(lm_scoring.train_and_score(docs, order=3))
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in ROWS}
    expected = kneser_ney_3([t for i, t, *_ in ROWS if not held[i]])
    for i, t, *_ in ROWS:
        assert got[i].score == pytest.approx(expected(t), rel=1e-9)


def discounts(counts):
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    if 0 in n:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return [x if 0 < x <= k + 1 else (0.5, 1.0, 1.5)[k] for k, x in enumerate(d)]


def kneser_ney_3(texts):
    """log10 probability of a text by an interpolated modified Kneser-Ney model of triples, from its definition."""
    tokens = lambda t: [w for w in (t or "").encode().lower().split()] + ["</s>"]

    def grams(t):
        all_tokens = ["<s>", *tokens(t)]
        return [tuple(all_tokens[max(0, i - 2) : i + 1]) for i in range(1, len(all_tokens))]

    top = Counter(g for t in texts for g in grams(t))
    pairs = Counter({g: c for g, c in top.items() if len(g) == 2}) + Counter(g[1:] for g in top if len(g) == 3)
    before = Counter(w for _, w in pairs)
    triples = {g: c for g, c in top.items() if len(g) == 3}
    levels = [({g: c for g, c in pairs.items()}, discounts(pairs.values())), (triples, discounts(triples.values()))]
    f = discounts(before.values())
    less = lambda c, by: c - by[min(c, 3) - 1] if c else 0.0
    left = sum(f[min(n, 3) - 1] for n in before.values()) / len(pairs)
    types = len({w for _, w in pairs})
    followers = {}
    for counts, _ in levels:
        for g, c in counts.items():
            followers.setdefault(g[:-1], []).append(c)

    def p(g):
        if len(g) == 1:
            return less(before[g[0]], f) / len(pairs) + left / (types + 1)
        lower, n = p(g[1:]), followers.get(g[:-1])
        if not n:
            return lower
        counts, d = levels[len(g) - 2]
        return less(counts.get(g, 0), d) / sum(n) + sum(d[min(c, 3) - 1] for c in n) / sum(n) * lower

    return lambda t: sum(np.log10(p(g)) for g in grams(t))


def kneser_ney(texts):
    """log10 probability of a text by an interpolated modified Kneser-Ney bigram model, from its definition."""
    tokens = lambda t: [w for w in (t or "").encode().lower().split()] + ["</s>"]
    pairs = Counter(p for t in texts for p in zip(["<s>", *tokens(t)], tokens(t)))
    types = {w for _, w in pairs}
    before = Counter(w for _, w in pairs)
    d, f = discounts(pairs.values()), discounts(before.values())
    total, after = Counter(), {}
    for (u, w), c in pairs.items():
        total[u] += c
        after.setdefault(u, []).append(c)
    less = lambda c, by: c - by[min(c, 3) - 1] if c else 0.0
    left = sum(f[min(n, 3) - 1] for n in before.values()) / len(pairs)

    def p(u, w):
        lower = less(before[w], f) / len(pairs) + left / (len(types) + 1)
        if u not in total:
            return lower
        free = sum(d[min(c, 3) - 1] for c in after[u]) / total[u]
        return less(pairs[u, w], d) / total[u] + free * lower

    some = next(iter(total))
    assert sum(p(some, w) for w in [*types, "never seen"]) == pytest.approx(1)
    return lambda t: sum(np.log10(p(u, w)) for u, w in zip(["<s>", *tokens(t)], tokens(t)))


def test_line_dedup(docs):
    def near(a, b, most=2):
        if abs(len(a) - len(b)) > most:
            return False
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1] <= most

    seen, kept = [], {}
    for i, t, *_ in ROWS:
        out, removed = [], 0
        for line in (t or "").split("\n"):
            bare = line.strip(" \t\n\x0b\x0c\r")
            if len(bare) >= 20:
                if any(near(bare, s) for s in seen):
                    removed += 1
                else:
                    out.append(line)
                seen.append(bare)
            else:
                out.append(line)
        kept[i] = ("\n".join(out), removed)
    got = by_id(line_dedup.dedup_digests(docs))
    assert {i: (r.kept_sha256, r.n_removed) for i, r in got.items()} == {i: (hashlib.sha256(t.encode()).hexdigest(), n) for i, (t, n) in kept.items()}
    clean = line_dedup.dedup_lines(docs)
    assert clean.columns == docs.columns
    assert {r.doc_id: r.text for r in clean.collect()} == {i: t for i, (t, n) in kept.items() if not n or t.split()}


@pytest.mark.parametrize("name", ["op4_line_dedup", "pipeline"])
def test_registered_line_dedup_removes_short_repeats(spark, tmp_path, name):
    import corpus_pipeline
    from wardlight.llm import queries

    texts = ["Un.\n天気がいい。\n  \na long line that stands here once", "Un. \nUn,\n天気がいい。", None, "x\n\nx\na long line that stands here 0nce", "y"]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    kept = [texts[0], "Un,", "", "x\n", "y"]
    if name == "pipeline":
        docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
        got = {r.doc_id: r.text or "" for r in dict(corpus_pipeline.STAGES)["line dedup"](spark, docs, str(tmp_path)).collect()}
        assert got == dict(enumerate(kept))
    else:
        got = by_id(queries.op4_line_dedup(spark, str(tmp_path)))
        assert {i: (r.kept_sha256, r.n_removed) for i, r in got.items()} == {i: (hashlib.sha256(t.encode()).hexdigest(), n) for i, (t, n) in enumerate(zip(kept, (0, 2, 0, 2, 0)))}


def test_segments_find_every_pair_within_the_distance():
    draw = random.Random(3)
    for _ in range(400):
        a = "".join(draw.choice("ab") for _ in range(draw.randint(8, 14)))
        b = list(a)
        for _ in range(draw.randint(0, 2)):
            k = draw.randrange(len(b))
            b[k : k + 1] = draw.choice([[], ["a"], ["b"], [b[k], "a"]])
        b = "".join(b)
        text = np.frombuffer((a + b).encode("utf-32-le"), np.uint32)
        sums = line_dedup.prefix_sums(text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        line, key, own = line_dedup.segment_keys(sums, np.array([0, len(a)]), np.array([len(a), len(a) + len(b)]), 2)
        keys = [{(int(k), bool(o)) for n, k, o in zip(line, key, own) if n == x} for x in (0, 1)]
        assert any((k, True) in keys[0] | keys[1] for k in {k for k, _ in keys[0]} & {k for k, _ in keys[1]}), (a, b)


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    by_source = {}
    for r in rows:
        assert r.times in (0, 1, 2) and r.size == len(words_of(ROWS[r.doc_id // 3][1]))
        by_source.setdefault(r.source, []).append(r)
    names = sorted((s for s in by_source if s), key=lambda s: [ord(c) for c in s]) + [None]
    expected = targets([by_source[s][0].source_size for s in names])
    for s, t in zip(names, expected):
        assert by_source[s][0].target == pytest.approx(t)
        sums = {0}
        for r in by_source[s]:
            base = int(t // r.source_size)
            sums = {x + n * r.size for x in sums for n in ((base,) if t % r.source_size == 0 else (base, base + 1))}
        assert abs(sum(r.times * r.size for r in by_source[s]) - t) == pytest.approx(min(abs(x - t) for x in sums))
    again = {r.doc_id: r.times for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.times for r in rows}


def targets(sizes, weights=(5, 2, 1)):
    """Shares of 150 % by weight, one source after the other stopped at twice its size."""
    stopped, weight = {}, [weights[k % 3] for k in range(len(sizes))]
    while True:
        rest, free = 1.5 * sum(sizes) - sum(stopped.values()), [k for k in range(len(sizes)) if k not in stopped]
        out = {k: rest * weight[k] / sum(weight[j] for j in free) for k in free}
        above = [k for k in free if out[k] > 2 * sizes[k]]
        if not above:
            return [{**stopped, **out}[k] for k in range(len(sizes))]
        stopped |= {k: 2 * sizes[k] for k in above}


@pytest.mark.parametrize("sizes", [[10, 1000, 1000], [5], [0, 7], [0, 0], [10**k for k in range(9)], [3] * 200])
def test_targets_stop_at_twice_a_source(spark, sizes):
    from wardlight.llm.shared import Steps

    names = [f"s{k:05}" for k in range(len(sizes) - 1)] + [None]
    frame = spark.createDataFrame(list(zip(names, sizes)), "source string, s long").repartition(3)
    got = {r.source: r for r in mixing.with_targets(frame, Steps(spark)).collect()}
    assert [got[n].source_index for n in names] == list(range(len(names)))
    assert [got[n].target for n in names] == pytest.approx(targets(sizes) if sum(sizes) else [0] * len(sizes))


def test_landing_ends_near_the_target():
    draw = np.random.default_rng(8)
    for _ in range(50):
        sizes = np.sort(np.concatenate((draw.integers(1, 20_000, 30), 2 ** np.arange(14))))[::-1]
        p = draw.integers(0, 2, len(sizes)).astype(float)
        p[[3, 7]] = 0.4, 0.7
        taken = lambda q: float((q * sizes).sum())
        missing = draw.integers(-5000, 20_000)
        due = taken(np.where((p > 0) & (p < 1), 0, p)) + missing
        q = mixing.landing(p, sizes, missing)
        assert set(q) <= {0.0, 1.0} and abs(taken(q) - due) <= 40


@pytest.mark.parametrize("few", [20_000, 0])
def test_takes_stay_near_the_targets_of_many_sources(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    draw = random.Random(3)
    rows = [(k, "w " * int(2 ** (draw.random() * 10)), f"s{min(draw.randint(0, 60), 30)}") for k in range(6000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by_source = {}
    for r in out:
        by_source.setdefault(r.source, []).append(r)
    assert len(out) == len(rows)
    for some in by_source.values():
        assert abs(sum(r.times * r.size for r in some) - some[0].target) <= max(2, 0.002 * some[0].target)


def test_flight_keeps_both_totals():
    draw = np.random.default_rng(1)
    p, sizes = draw.random(500), draw.integers(1, 100, 500)
    q = mixing.flight(p, sizes, draw.random(500))
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert q.sum() == pytest.approx(p.sum()) and (q * sizes).sum() == pytest.approx((p * sizes).sum())


def test_licenses(spark):
    texts = ["Released under the MIT License.", "All rights reserved.\nLicensed under CC BY-NC 4.0.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files: x. The software is provided \"as is\", without warranty of any kind, express or implied.", "mit license", None]
    got = [(r.license, r.license_kind) for r in license_scan.license_columns(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [("MIT", "notice"), ("CC-BY-NC-4.0", "notice"), ("MIT", "full"), (None, None), (None, None)]


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
%s
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED."""
BSD3 = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at https://mozilla.org/MPL/2.0/."""


ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""
BSL = """Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/"""
LICENSED = [(APACHE, "Apache-2.0", "full"), (MIT, "MIT", "full"), (BSD2 % "", "BSD-2-Clause", "full"), (BSD2 % BSD3, "BSD-3-Clause", "full"), (ISC, "ISC", "full"), (GPL, "GPL", "full"), (LGPL, "LGPL", "full")]
LICENSED += [(GPL.replace("GNU General", "GNU Affero General"), "AGPL-3.0", "full"), (ZLIB, "Zlib", "full"), (BSL, "BSL-1.0", "full"), (EPL, "EPL-2.0", "notice"), (MPL, "MPL-2.0", "notice")]
LICENSED += [(f"SPDX-License-Identifier: {n}", n, "notice") for n in ("Apache-2.0", "MIT", "BSD-3-Clause", "BSD-2-Clause", "ISC", "MPL-2.0", "GPL-3.0", "CC0-1.0", "Unlicense")]


def test_licenses_in_wrapped_and_commented_texts(spark):
    forms = [lambda t: t, lambda t: "Copyright 2020 A\n" + t, lambda t: "# " + t.replace("\n", "\n# "), lambda t: "/*\n * " + t.replace("\n", "\n * "), lambda t: "dnl " + t.replace("\n", "\r\ndnl "), lambda t: " ".join(t.split())]
    rows = [(form(t), n, k) for t, n, k in LICENSED for form in forms]
    rows += [("Copyright 2020 A\nReleased under the MIT License", "MIT", "notice"), ("It is not released under the MIT License.", None, None), ("Released under the MIT Licenses", None, None), ("#" * 100_000 + " software " + "." * 100_000, None, None)]
    out = license_scan.license_columns(spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "doc_id long, text string"))
    got = [(r.license, r.license_kind) for r in out.orderBy("doc_id").collect()]
    assert got == [r[1:] for r in rows]


def test_every_known_sentence_has_a_hint():
    for sentence in [*license_scan.SENTENCES.values(), *(v for _, v in license_scan.VARIANTS)]:
        assert any(h in sentence for h in license_scan.HINT)


def test_suffix_dedup(docs):
    texts = {i: (t or "").encode() for i, t, *_ in ROWS}
    n = 100
    count = Counter(t[k : k + n] for t in texts.values() for k in range(len(t) - n + 1))
    got = by_id(suffix_dedup.removal_digests(docs, n))
    for i, t in texts.items():
        gone = bytearray(len(t))
        for k in range(len(t) - n + 1):
            if count[t[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        kept = bytes(x for x, g in zip(t, gone) if not g)
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_suffix_dedup_of_planted_passages(spark):
    draw = random.Random(7)
    words = lambda n: " ".join("".join(draw.choices("abcdefghij", k=6)) for _ in range(n))
    n, common, rare, short = suffix_dedup.LENGTH, words(70), words(70), words(52)
    planted = [common] * (suffix_dedup.HOT + 44) + [rare] * 2 + [short] * 2 + [""] * 40
    texts = {i: f"{words(30 + i % 50)} {p} {words(30)}".encode() for i, p in enumerate(planted)}
    assert len(short) < n < len(rare)
    count = Counter(t[k : k + n] for t in texts.values() for k in range(len(t) - n + 1))
    got = by_id(suffix_dedup.removal_digests(spark.createDataFrame([(i, t.decode()) for i, t in texts.items()], "doc_id long, text string")))
    for i, t in texts.items():
        gone = bytearray(len(t))
        for k in range(len(t) - n + 1):
            if count[t[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        kept = bytes(x for x, g in zip(t, gone) if not g)
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(t), sum(gone), hashlib.sha256(kept).hexdigest())
        assert (r.n_removed > 0) == (len(planted[i]) >= n)


@pytest.mark.parametrize("length", [5, 8, 70, 130])
def test_interval_expansion_against_sorted_suffixes(length):
    draw = random.Random(length)
    base = bytes(draw.choice(b"ab") for _ in range(60))
    text = bytes(draw.choice(b"ab") for _ in range(300)) + base * 6 + bytes(draw.choice(b"a\0c") for _ in range(200))
    symbols = np.append(np.frombuffer(text, np.uint8).astype(np.uint16) + 1, np.uint16(0))
    order, open_ = suffix_dedup.open_prefixes(symbols, length)
    group, windows = np.cumsum(~open_), {}
    for i, k in enumerate(order):
        if k + length <= len(text):
            windows.setdefault(int(group[i]), set()).add(text[k : k + length])
    assert all(len(w) == 1 for w in windows.values())
    assert len(windows) == len({text[k : k + length] for k in range(len(text) - length + 1)})


def test_substring_dedup(docs):
    seen, n = set(), 20
    got = by_id(substring_dedup.removal_digests(docs))
    for i, t, *_ in ROWS:
        w, gone = words_of(t), set()
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if key in seen:
                gone.update(range(k, k + n))
            seen.add(key)
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())


def test_packing(docs):
    from tokenizers import Tokenizer

    rows = packing.packed_documents(docs, tokenizer_path(), 64).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    whole, bins = {}, {}
    for r in rows:
        whole.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    for i, t, *_ in ROWS:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for k, r in enumerate(sorted(whole[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes())
            assert k == 0 or r.length == 64
            at += r.length
        assert at == len(ids) and (len(whole[i]) == 1) == (len(ids) <= 64)
    for pieces in bins.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == list(np.cumsum([0] + [r.length for r in pieces])[:-1]) and sum(r.length for r in pieces) <= 64
    assert len(bins) >= packing.lower_bound(np.array([r.length for r in rows]), 64)


@pytest.mark.parametrize("seed", [1, 2])
def test_packing_in_many_partitions_ends_near_the_bound(spark, monkeypatch, seed):
    monkeypatch.setattr(packing, "PARTITION", 200)
    draw = random.Random(seed)
    sizes = [draw.choice([draw.randint(1, 1024), draw.randint(300, 520)]) for _ in range(5000)]
    rows = spark.createDataFrame([(k, k, 0, 0, n, 0) for k, n in enumerate(sizes)], "doc_id long, copy long, piece int, start long, length long, ids_crc32 long")
    bins = {}
    got = packing.pack(rows).collect()
    assert sorted((r.doc_id, r.length) for r in got) == list(enumerate(sizes))
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        pieces.sort()
        assert [a for a, _ in pieces] == list(np.cumsum([0] + [n for _, n in pieces])[:-1]) and sum(n for _, n in pieces) <= 1024
    # 25 partitions of their own would leave a bin open in each.
    whole = len(packing.best_fit_decreasing(np.array(sizes), 1024)[2])
    assert packing.lower_bound(np.array(sizes), 1024) <= len(bins) <= whole + 8


def test_bins_given_back():
    back = lambda left, gap: packing.given_back(np.array(left), gap, 10).tolist()
    assert back([0, 3, 6], 0) == [False, False, True] and back([0, 3, 5], 0) == [False] * 3
    assert back([0, 1, 2, 3], 1) == [False, True, True, True]
    assert back([9] * 5 + [1] * 4, 1) == [True] * 5 + [False] * 4


def test_lower_bound_counts_large_items():
    assert packing.lower_bound(np.array([600] * 7), 1024) == 7
    assert packing.lower_bound(np.array([512] * 7), 1024) == 4


def test_encoder_agrees_with_the_tokenizer():
    from tokenizers import Tokenizer

    encoder, tokenizer = packing.Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    draw = random.Random(2)
    texts = ["", " ", "a  b", " a", "a ", "<|endoftext|> x", "日本 🎉 a", "\t\ta b\t c"] + ["".join(draw.choice("ab é\n\t 1.,'s日\x1d") for _ in range(40)) for _ in range(300)]
    for t in texts:
        assert encoder.encode(t) == np.asarray(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_encoder_agrees_on_every_word_of_the_documents():
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    encoder, tokenizer = packing.Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    words = sorted({w for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist() for w in (t or "").split()})
    for text, ids in zip(words, tokenizer.encode_batch([" " + w for w in words], add_special_tokens=False)):
        assert encoder._ids(" " + text) == np.asarray(ids.ids, "<u4").tobytes(), text


@pytest.mark.parametrize("name", sorted(QUERY_SQL))
def test_queries_against_their_sql(spark, tmp_path, name):
    import duckdb

    path = str(tmp_path / "documents.parquet")
    texts = [t for t, _, _ in LICENSED]
    rows = ROWS + [(1000 + k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    got = QUERIES[name](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = db.execute(QUERY_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda r: r[columns.index("doc_id")]
    assert sorted(map(tuple, got.select(columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_quality_columns(docs):
    got = by_id(quality_rules.quality_columns(docs))
    for i, t, *_ in ROWS:
        t = t or ""
        w = [x.decode() for x in t.encode().split()]
        at = {}
        for k in range(len(w) - 2):
            at.setdefault(tuple(w[k : k + 3]), []).append(k)
        covered = {j for v in at.values() if len(v) > 1 for k in v for j in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    kept = quality_rules.quality_filter(docs)
    assert kept.columns == docs.columns and {r.doc_id: (r.text, r.n_chars) for r in kept.collect()} == {i: (r.clean_text, len(r.clean_text)) for i, r in got.items() if r.kept}


def test_failing_lines_go_and_others_stay_as_they_are(spark):
    good = "\n".join(" ".join(f"{w}{k}" for k in range(9)) + "." for w in "abcdefgh") + "\n \n\n"
    texts = [good, "Home | About | Contact\n" + good + "click here to read on\nEnd of it.", good.replace("\n", "\r\n")]
    rows = [(k, t, 7) for k, t in enumerate(texts)]
    out = quality_rules.quality_filter(spark.createDataFrame(rows, "doc_id long, text string, n_chars int"))
    want = [good, good + "End of it.", texts[2]]
    assert out.dtypes == [("doc_id", "bigint"), ("text", "string"), ("n_chars", "int")]
    assert sorted(map(tuple, out.collect())) == [(k, t, len(t)) for k, t in enumerate(want)]


def test_final_punctuation_before_long_line_ends(spark):
    lines = ["Three words here…" + " " * 9, "Drei Wörter hier。" + "\t\r" * 20, "Three words here…" + "\"'”’»)]" * 3 + " " * 9, "Three words here！", "Three words here " + '"' * 9, "Three … words here"]
    got = by_id(quality_rules.quality_columns(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")))
    assert [got[i].n_failed_lines for i in range(len(lines))] == [0, 0, 0, 0, 1, 1]


@pytest.mark.parametrize(
    "run",
    [
        ngram_join.near_duplicates,
        ngram_join.one_of_each,
        fingerprints.fingerprints,
        fingerprints.near_duplicates,
        lm_scoring.train_and_score,
        lambda d: lm_scoring.train_and_score(d, order=3),
        line_dedup.dedup_digests,
        line_dedup.dedup_lines,
        mixing.mix,
        mixing.mixed_documents,
        license_scan.license_columns,
        suffix_dedup.removal_digests,
        suffix_dedup.remove_repeats,
        lambda d: packing.packed_documents(d, tokenizer_path()),
        quality_rules.quality_columns,
        quality_rules.quality_filter,
        substring_dedup.removal_digests,
        substring_dedup.remove_repeats,
    ],
)
def test_empty_tables(empty, run):
    assert run(empty).count() == 0


ODD = [(None, None), (None, "a b c d e f"), (1, "same words here again and again"), (1, "same words here again and again"), (1, "other words for the same number"), (2, ""), (3, "y" * 300_000), (4, "long text " * 30_000), (5, "One line\nOne line\n" + "A line of prose that stands alone. " * 20)]
NAMES = ("kept", "n_words", "rest", "th", "kind", "size", "bucket", "times", "unit", "row", "key", "first", "rep", "label", "e", "p", "x", "due", "class", "marks", "National-ID", "a.b", "clean_text", "license", "target", "piece", "copy", "starts")


@pytest.mark.parametrize(
    "run",
    [
        ngram_join.near_duplicates,
        ngram_join.one_of_each,
        fingerprints.fingerprints,
        fingerprints.near_duplicates,
        lm_scoring.train_and_score,
        lambda d: lm_scoring.train_and_score(d, order=3),
        line_dedup.dedup_digests,
        line_dedup.dedup_lines,
        mixing.mix,
        mixing.mixed_documents,
        license_scan.license_columns,
        suffix_dedup.removal_digests,
        suffix_dedup.remove_repeats,
        lambda d: packing.packed_documents(d, tokenizer_path()),
        quality_rules.quality_columns,
        quality_rules.quality_filter,
        substring_dedup.removal_digests,
        substring_dedup.remove_repeats,
    ],
)
def test_nulls_repeats_long_texts_and_clashing_columns(spark, run):
    plain = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("source", F.lit(None).cast("string")).coalesce(1)
    odd = plain.withColumns({c: F.lit(k) for k, c in enumerate(NAMES)})
    want, got = run(plain), run(odd)
    columns = [f"`{c}`" for c in want.columns if c != "copy"]
    rows = lambda df: sorted(map(repr, df.select(columns).collect()))
    assert rows(want) == rows(got)
    extra = [f"`{c}`" for c in got.columns if c not in want.columns]
    if extra:
        assert {tuple(r) for r in got.select(extra).collect()} <= {tuple(k for k, c in enumerate(NAMES) if f"`{c}`" in extra)}
    if run not in (ngram_join.one_of_each, mixing.mixed_documents, quality_rules.quality_filter):
        assert len(rows(got)) >= len(ODD) - 1


def test_one_row_of_repeated_documents_stays(spark):
    out = ngram_join.one_of_each(spark.createDataFrame(ODD, "doc_id long, text string"))
    got = sorted((r.doc_id or -1, (r.text or "")[:20]) for r in out.collect())
    assert got == [(-1, ""), (-1, "a b c d e f"), (1, "other words for the "), (1, "same words here agai"), (2, ""), (3, "y" * 20), (4, "long text long text "), (5, "One line\nOne line\nA ")]


def test_training_reads_the_texts_a_few_times(spark):
    """Once each for size, words, triples and number, whatever the number of turns."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame(ROWS, SCHEMA).select("text").mapInArrow(counted, "text string")
    lm_scoring.train(docs, 3)
    assert 2 * len(ROWS) <= read.value <= 4 * len(ROWS)


@pytest.mark.parametrize("n", [5, 1 << 22])
def test_triples_are_counted_whatever_the_number_of_words(n):
    draw = np.random.default_rng(2)
    u, v, w = (draw.choice([0, 1, n - 1], 200) for _ in range(3))
    want = Counter(zip(v.tolist(), w.tolist(), u.tolist()))
    got = lm_scoring._sorted_triples(u, v, w, n)
    assert list(zip(*(x.tolist() for x in (got[1], got[2], got[0], got[3])))) == [(*k, c) for k, c in sorted(want.items())]


def test_a_table_keeps_its_first_shards_mapped(tmp_path, monkeypatch):
    from wardlight.llm import shards

    monkeypatch.setattr(shards, "OPEN_SHARDS", 3)
    opened = []
    monkeypatch.setattr(shards, "map_shard", lambda uri, f=shards.map_shard: opened.append(uri) or f(uri))
    keys = np.arange(8, dtype=np.uint64) << np.uint64(61)
    for b in range(8):
        shards.write_shard(f"{tmp_path}/t-{b}", {"keys": keys[b : b + 1], **shards.counts_column("count", np.array([b + 250]))})
    table = shards.Table(str(tmp_path), "t", 3)
    for _ in range(3):
        assert table.get(keys, "count")[0].tolist() == list(range(250, 258))
    assert len(opened) == 8 + 5 + 5


def test_shuffle_files_go_when_a_table_is_written(spark):
    from wardlight.llm.shared import materialize

    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in (str(blocks.getAllFiles().apply(i)) for i in range(blocks.getAllFiles().size())) if "shuffle_" in f}
    before, setting = shuffles(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    table = materialize(spark.range(1000).repartition(4, "id"))
    assert not shuffles() - before
    assert table.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
