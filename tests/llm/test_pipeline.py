"""The pipeline, stage by stage, against brute-force versions on whole documents of the smallest table."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import shingle_set, targets, words_of
from wardlight.llm.packing import lower_bound
from wardlight.llm.quality_rules import BOILERPLATE
from wardlight.llm.queries import tokenizer_path

BLANKS = " \t\n\x0b\x0c\r"


def fails(line):
    words = re.findall(r"[^\x20\x09-\x0D]+", line)
    n = len(words)
    if sum(bool(re.fullmatch(r"[|>»·•/\\~-]+", w)) for w in words) > 0.2 * n:
        return True
    if sum(bool(re.search(r"([#*$%&<>]{2,}[.,]?|!!+)$", w)) for w in words) > 0.3 * n or any(p in line.lower() for p in BOILERPLATE):
        return True
    if n >= 5 and any(c.isupper() for c in line) and not any(c.islower() for c in line):
        return True
    return n < 8 and not re.search("[.,;:!?]", line) and not re.search("[.!?…:;。！？][\"'”’»)\\]]*[\\x20\\x09-\\x0D]*$", line)


def cleaned(text):
    """The text without failing lines, or None."""
    words = words_of(text)
    at = {}
    for k in range(len(words) - 2):
        at.setdefault(tuple(words[k : k + 3]), []).append(k)
    repeated = {j for v in at.values() if len(v) > 1 for k in v for j in (k, k + 1, k + 2)}
    if len(words) < 50 or 100 * len(repeated) > 50 * len(words):
        return None
    lines = (text or "").split("\n")
    gone = [x for x in lines if words_of(x) and fails(x)]
    if sum(len(words_of(x)) for x in gone) > 0.5 * len(words):
        return None
    return "\n".join(x for x in lines if not words_of(x) or not fails(x))


def near(a, b, most=2):
    if abs(len(a) - len(b)) > most:
        return False
    far = most + 1
    row = {j: j for j in range(most + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            new[j] = min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (j == 0 or x != b[j - 1]))
        row = new
        if min(row.values()) > most:
            return False
    return row.get(len(b), far) <= most


def without_repeats(texts):
    seen, exact, out = {}, set(), {}
    for i, text in sorted(texts.items()):
        kept = []
        for line in text.split("\n"):
            bare = line.strip(BLANKS)
            likes = [s for n in range(len(bare) - 2, len(bare) + 3) for s in seen.get(n, ())] if len(bare) >= 20 else []
            if not bare or (bare not in exact and not any(near(bare, s) for s in likes)):
                kept.append(line)
            if bare and bare not in exact:
                exact.add(bare)
                if len(bare) >= 20:
                    seen.setdefault(len(bare), []).append(bare)
        if len(kept) == len(text.split("\n")) or words_of("\n".join(kept)):
            out[i] = "\n".join(kept)
    return out


def one_of_each(texts):
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = {i: shingle_set(t) for i, t in texts.items()}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: t for i, t in texts.items() if root(i) == i}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 120")
    extra = docs.filter("doc_id in (3, 5, 8)").withColumn("doc_id", F.col("doc_id") + 1000)
    odd = spark.createDataFrame([(2000, None, "en", None, None), (2001, "", "en", "s", 0)], docs.schema)
    docs.unionByName(extra).unionByName(odd).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages_against_brute_force(spark, folder):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, outs = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        outs.append(out.collect())
        assert k == 4 or out.columns == names
        if k < 4:
            out.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    quality = {i: c for i, t in texts.items() if (c := cleaned(t)) is not None}
    assert {r.doc_id: r.text for r in outs[0]} == quality and 0 < len(quality) < len(texts)
    assert any(quality[i] != texts[i] for i in quality)
    dedup = without_repeats(quality)
    assert {r.doc_id: r.text for r in outs[1]} == dedup and dedup != quality
    assert all(r.n_chars == len(r.text) for r in outs[0] + outs[1])
    singles = one_of_each(dedup)
    assert {r.doc_id: r.text for r in outs[2]} == singles
    sizes = {}
    for r in outs[2]:
        sizes.setdefault(r.source, {})[r.doc_id] = len(words_of(r.text))
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    times = Counter(r.doc_id for r in outs[3])
    assert {r.doc_id: r.text for r in outs[3]}.items() <= singles.items()
    for source, target in zip(order, targets([sum(sizes[s].values()) for s in order])):
        taken = sum(times[i] * n for i, n in sizes[source].items())
        assert abs(taken - target) <= max(sizes[source].values()) / 2 and max(times[i] for i in sizes[source]) <= 2
    tokenizer = Tokenizer.from_file(tokenizer_path())
    length = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in singles.items()}
    packed = Counter()
    for r in outs[4]:
        packed[r.doc_id] += r.length
    assert packed == {i: n * length[i] for i, n in times.items()}
    used = Counter()
    for r in outs[4]:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024
    import numpy as np

    assert len(used) <= lower_bound(np.array([r.length for r in outs[4]]), 1024) + 1
    whole = corpus_pipeline.run(spark, folder).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, outs[4]))


def test_empty_and_clashing(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    more = docs.filter("doc_id < 40").withColumns({c: F.lit(1) for c in ("kept", "times", "row", "rest", "first", "a.b", "th")})
    plain = docs.filter("doc_id < 40")
    for name, stage in corpus_pipeline.STAGES[:4]:
        a, b = stage(spark, plain, str(tmp_path)), stage(spark, more, str(tmp_path))
        assert b.columns == more.columns
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect())), name
