import hashlib
import math
from collections import Counter, defaultdict

import pytest
from conftest import words
from pyspark.sql import functions as F

from scoreline.llm import mixing


def water(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by resharing the excess until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        above = {s for s in open_ if level * w[s] >= most * sizes[s]}
        if not above:
            target |= {s: level * w[s] for s in open_}
            break
        for s in above:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def expected(rows, quality, seed="mix"):
    """rows: (id, text, source) with unique ids -> {id: taken}."""
    size = {i: len(words(t)) for i, t, _ in rows}
    by = defaultdict(list)
    for i, _, s in rows:
        by[s].append(i)
    total = {s: sum(size[i] for i in ids) for s, ids in by.items()}
    target, out = water(total), {}
    for s, ids in by.items():
        epochs = math.floor(target[s] / total[s]) if total[s] else 0
        rest = math.floor(target[s] - epochs * total[s])
        key = lambda i: -math.log((int(hashlib.md5(f"{seed}{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / quality.get(i, 1.0)
        for i in sorted(ids, key=key):
            part = min(size[i], rest)
            rest -= part
            out[i] = epochs * size[i] + part
    return target, out


@pytest.mark.parametrize("buckets", [4096, 4])
def test_against_plain_python(spark, monkeypatch, buckets):
    monkeypatch.setattr(mixing, "BUCKETS", buckets)
    rows = [(i, " ".join(["w"] * (i * 37 % 90 + (3000 if i == 7 else 0))), [None, "b", "a", "Z", "ä"][i % 5] if i > 40 else "a") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 200, 3)] + [(3, 0), (None, 1), (6, None)], "doc_id long, quality int")
    quality = {r.doc_id: r.quality_weight for r in mixing.label_weights(labels).collect()}
    assert quality[3] == pytest.approx(1.25) and quality[9] == 2.0 and quality[12] == 0.5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.take(df, quality=mixing.label_weights(labels)).collect()
    target, taken = expected(rows, quality)
    assert {r.doc_id: r.taken for r in got} == taken
    assert all(r.target == pytest.approx(target[r.source]) and r.taken <= 2 * r.size for r in got)
    again = mixing.take(df.repartition(2), quality=mixing.label_weights(labels)).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in got}
    by = Counter()
    for r in got:
        by[r.source] += r.taken
    assert all(abs(by[s] - target[s]) <= 1 for s in target)


def test_good_documents_come_first(spark):
    df = spark.createDataFrame([(i, "w w w w", "a") for i in range(2000)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, quality int")
    got = mixing.take(df, share=0.5, quality=mixing.label_weights(labels)).groupBy((F.col("doc_id") % 2).alias("good")).agg(F.sum("taken").alias("t")).collect()
    t = {r.good: r.t for r in got}
    assert t[1] > 1.8 * t[0]


def test_the_mix_itself(spark):
    rows = [(i, f"a{i} b  c\td", "x" if i % 4 else "y", i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, part long")
    plan = mixing.take(df)
    out = mixing.mixed(df, plan)
    assert out.columns == df.columns
    n = Counter()
    for r in out.collect():
        n[r.doc_id] += len(words(r.text))
    assert {i: k for i, k in n.items() if k} == {r.doc_id: r.taken for r in plan.collect() if r.taken}


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.drop("key", "size")
    plan = mixing.take(docs)
    assert plan.count() == odd_docs.count() and mixing.take(no_docs).count() == 0
    assert {r.doc_id: r.size for r in plan.collect() if r.doc_id in (0, 1, 2, 8)} == {0: 0, 1: 0, 2: 0, 8: 5000}
    assert mixing.mixed(odd_docs, mixing.take(odd_docs)).columns == odd_docs.columns
