"""Exact, vector, passage and n-gram dedup against brute force."""

import hashlib
import random
import re
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.llm import exact_dedup, ngram_join, suffix_dedup, vector_dedup
from frameloom.llm.common import connected_components
from tests.llm import cases


@pytest.mark.parametrize("counters", [1024, 3])
def test_exact(spark, counters):
    df = cases.documents(spark)
    got = exact_dedup.mark_duplicates(df, counters=counters).collect()
    groups = {}
    for i, t in cases.pairs(df):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i))
    expected = []
    for norm, members in groups.items():
        members.sort()
        for n, (_, i) in enumerate(members):
            expected.append((i, members[0][1], len(members), n == 0, hashlib.sha256(norm.encode()).hexdigest()))
    assert sorted(map(tuple, got)) == sorted(expected)
    assert exact_dedup.mark_duplicates(cases.empty(spark)).count() == 0
    kept = exact_dedup.drop_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(e[0] for e in expected if e[3])


def test_misra_gries_keeps_heavy_digests():
    rng = random.Random(1)
    counts = {}
    for _ in range(3000):
        k = 0 if rng.random() < 0.4 else rng.randint(1, 500)
        counts[k] = counts.get(k, 0) + 1
    assert 0 in exact_dedup.trim_summary(counts, 4) and len(exact_dedup.trim_summary(counts, 4)) <= 4


def test_vectors(spark):
    rng = np.random.default_rng(3)
    rows, at = [], 0
    for label in (0, 1, None):
        for _ in range(60):
            rows.append((at, rng.normal(size=16).tolist(), label))
            at += 1
        centre = rng.normal(size=16)
        for _ in range(40):
            rows.append((at, (centre + rng.normal(size=16) * 0.12).tolist(), label))
            at += 1
    rows += [(at, rows[0][1], 0), (at + 1, [2 * x for x in rows[0][1]], 0), (at + 2, None, 0), (at + 3, [0.0] * 16, 0), (at + 4, [float("nan")] + [1.0] * 15, 0), (at + 5, [], 0), (at + 6, [1.0, None], 0), (at + 7, [1.0] * 8, 0)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, uid string")
    got = {r.vec_id: r for r in vector_dedup.link_vectors(df).collect()}
    unit = {i: vector_dedup.unit(v) for i, v, _ in rows}
    label = {i: x for i, _, x in rows}
    ok = [i for i in unit if unit[i] is not None and label[i] is not None]
    links = {(a, b) for a in ok for b in ok if a < b and label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98 - 1e-15}
    counts = {i: sum(i in p for p in links) for i in unit}
    found, total = sum(got[i].n_links for i in unit), sum(counts.values())
    assert total > 200 and found >= 0.97 * total and all(got[i].n_links <= counts[i] for i in unit)
    component = cases.roots(unit, links)
    assert sum(got[i].component_id != component[i] for i in unit) == 0
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert vector_dedup.link_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("slice_rows", [1 << 17, 64, 7])
def test_suffix_order_and_prefixes(monkeypatch, slice_rows):
    monkeypatch.setattr(suffix_dedup, "SLICE_ROWS", slice_rows)
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(50, 80))) for _ in range(40)] + [b"a" * 55, b"a" * 60, b"a" * 60]
    with tempfile.TemporaryDirectory() as folder:
        ext = suffix_dedup.sort_collection(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]), folder)
        before, common = ext.columns()
    owner, start = suffix_dedup.owners_of(before, np.array([len(s) for s in strings]))
    suffixes = [strings[o][s:] for o, s in zip(owner, start, strict=True)]
    assert suffixes == sorted(s[i:] for s in strings for i in range(len(s) + 1))
    for i in range(1, len(suffixes)):
        a, b = suffixes[i - 1], suffixes[i]
        n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert common[i] == n
    assert all(x == (strings[o][s - 1] + 1 if s else 0) for x, o, s in zip(before, owner, start, strict=True))


def removed(df):
    rows = [(i, t.encode()) for i, t in cases.pairs(df)]
    least = {}
    for i, t in rows:
        for k in range(len(t) - 49):
            least[t[k : k + 50]] = min(i, least.get(t[k : k + 50], i))
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if least[t[k : k + 50]] < i:
                gone[k : k + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def test_passages(spark):
    df = cases.documents(spark)
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(df.repartition(3)))
    assert sorted(map(tuple, got.collect())) == removed(df)
    assert suffix_dedup.remove_repeats(cases.empty(spark)).count() == 0
    cleaned = suffix_dedup.without_repeats(df)
    assert cleaned.columns == df.columns and cleaned.count() == df.count()
    assert {(r.source, r.digest, r.n, r.lang) for r in cleaned.collect()} == {("s", "clash", 7, None)}
    assert all(r.n_chars == len(r.text) for r in cleaned.collect())


def test_passages_keep_other_columns_as_they_are(spark):
    df = cases.documents(spark).selectExpr(
        "doc_id", "text", "timestamp'2024-05-06 07:08:09.123456' as seen", "array(named_struct('a', doc_id, 'b', null)) as nested", "cast(null as decimal(20,3)) as d", "cast('x' as binary) as kept")
    cleaned = suffix_dedup.without_repeats(df, chars_col=None)
    assert cleaned.schema.simpleString() == df.schema.simpleString()
    rest = ["doc_id", "date_format(seen, 'HH:mm:ss.SSSSSS') t", "nested", "d", "kept"]
    assert sorted(map(repr, cleaned.selectExpr(*rest).collect())) == sorted(map(repr, df.selectExpr(*rest).collect()))


def test_runs_cover_every_window(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STEP_BYTES", 200)
    rng = np.random.default_rng(1)
    length = np.array([0, 49, 50, 51, 700, 3])
    data = rng.integers(97, 99, length.sum()).astype(np.uint8)
    begin = np.cumsum(length) - length
    doc, first, windows, _ = suffix_dedup.runs(data, begin, length)
    seen = sorted((d, f + k) for d, f, n in zip(doc, first, windows, strict=True) for k in range(n))
    assert seen == [(d, begin[d] + k) for d in range(len(length)) for k in range(max(0, length[d] - 49))]
    assert windows.max() <= suffix_dedup.SPAN


@pytest.mark.parametrize("block, small", [(1 << 20, 8), (700, 1)])
def test_ngram_components(spark, monkeypatch, block, small):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", small)
    df = cases.documents(spark).repartition(3)
    rows = cases.pairs(df)
    got = sorted(map(tuple, ngram_join.cluster(df).collect()))
    sets = [(i, cases.shingles(t)) for i, t in rows]
    links = [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[:n] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    root = cases.roots({i for i, _ in rows}, links)
    assert got == sorted((i, len(x), i if not x else root[i]) for i, x in sets)
    assert ngram_join.cluster(cases.empty(spark)).count() == 0
    kept = ngram_join.keep_one_of_each(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, x in sets if not x or root[i] == i}


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for size in [*range(1, 40), 60, 100, 250, 800]:
        for _ in range(60 if size < 100 else 12):
            x = rng.integers(0, 1 << 63, size).astype(np.uint64)
            d = int(rng.integers(0, size // 4 + 1))
            y = np.unique(np.concatenate([x[d:], rng.integers(0, 1 << 63, int(rng.integers(0, 3))).astype(np.uint64)]))
            x = np.unique(x)
            both = len(np.intersect1d(x, y))
            if len(y) and 100 * both >= 80 * (len(x) + len(y) - both):
                (sx, px), (sy, py) = ngram_join.signatures(x), ngram_join.signatures(y)
                assert np.intersect1d(sx[px], sy).size or np.intersect1d(sx, sy[py]).size
                bits = int(np.bitwise_count((ngram_join.sketch_of(x) ^ ngram_join.sketch_of(y)).view(np.uint64)).sum())
                assert bits <= len(x) + len(y) - 2 * both


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for e in edges for x in e if e[0] != e[1]}
    assert got == {n: r for n, r in cases.roots({x for e in edges for x in e}, edges).items() if n in touched}
