import numpy as np
import pytest

from scoreline.llm import mips

COLS = "vec_id long, embedding array<float>"


def table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(range(len(x)) if ids is None else ids, x, strict=True)], COLS)


def recall(rows, x, k=20):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q, found in got.items():
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -s))[:k]
        hits += len(set(best.tolist()) & {v for _, v, _ in found})
        total += len(best)
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(found) + 1))
        assert all(abs(s[v] - score) < 1e-9 for _, v, score in found)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
    return hits / total


@pytest.mark.parametrize(("fewest", "most", "leaf"), [(4096, 65_536, 200), (60, 300, 200), (60, 70, 700)])
def test_recall_and_exact_scores(spark, monkeypatch, fewest, most, leaf):
    for name, value in (("FEWEST_ROWS", fewest), ("MOST_ROWS", most), ("LEAF_ROWS", leaf)):
        monkeypatch.setattr(mips, name, value)
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(1500, 24)) * rng.uniform(0.5, 2, (1500, 1))).astype(np.float32)
    df = table(spark, x).repartition(3)
    rows = mips.search(df, df.where("vec_id % 20 = 0")).collect()
    assert len(rows) == 75 * 20
    assert recall(rows, x) >= 0.9


def test_clusters_need_few_leaves():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 3
    x = np.concatenate([c + rng.normal(size=(100, 16)) * 0.05 for c in centres]).astype(np.float32)
    assert mips.leaves_needed(mips.Quantiser(x, 20), x, 20, 0.98) <= 8


def test_parallel_error_costs_more():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    m = mips.Quantiser(x, 1)
    whole, left = m._cut(x), m._cut(x - m.centres[0])
    scored = m._assign(left, whole)
    plain = ((left[:, :, None] - m.books[None]) ** 2).sum(axis=3).argmin(axis=2)
    along = lambda c: np.abs(((left - m.books[np.arange(m.blocks)[None], c]) * whole).sum(axis=(1, 2))).mean()
    assert m.eta > 1 or along(scored) <= along(plain)
    assert along(scored) <= along(plain) * 1.0001


def test_ties_and_copies_of_one_vector(spark):
    x = np.tile(np.array([[1.0, 0.0, 0.0, 0.0]]), (60, 1))
    rows = mips.search(table(spark, x), table(spark, x).where("vec_id in (0, 40)")).collect()
    assert sorted(r.vec_id for r in rows if r.query_id == 40) == list(range(20))
    assert sorted(r.vec_id for r in rows if r.query_id == 0) == list(range(1, 21))


def test_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, [2.0, 1.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [None, 1.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [1.0], 1), (None, [1.0, 1.0], 1), (8, [], 1)]
    df = spark.createDataFrame(rows, COLS + ", leaf int")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in mips.search(df, df).collect()]
    assert sorted(got) == [(0, 1, 1, 4.0), (1, 1, 0, 4.0)]
    assert mips.search(df.where("false"), df.where("false")).count() == 0


def test_leaves_fill_groups_in_order():
    base, parts = mips._dealt({0: 50, 1: 60, 2: 250, 3: 10, 4: 10}, 6, 100)
    assert base.tolist() == [0, 1, 2, 5, 5, 5] and parts.tolist() == [1, 1, 3, 1, 1, 1]


def test_repeated_queries_each_get_all_their_neighbours(spark):
    x = np.random.default_rng(3).normal(size=(50, 8)).astype(np.float32)
    df = table(spark, x)
    twice = df.where("vec_id in (3, 7)").unionByName(df.where("vec_id = 7"))
    rows = [(r.query_id, r["rank"], r.vec_id) for r in mips.search(df, twice).collect()]
    once = [(r.query_id, r["rank"], r.vec_id) for r in mips.search(df, df.where("vec_id in (3, 7)")).collect()]
    assert sorted(rows) == sorted(once + [r for r in once if r[0] == 7]) and len(once) == 40
    assert len({v for q, _, v in once if q == 7}) == 20


def test_double_columns_keep_their_precision(spark):
    rows = [(i, [0.17 + i * 1e-12, 1e-300]) for i in range(30)] + [(100, [1.0, 0.0]), (101, [1e200, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id, r.score) for r in mips.search(df, df.where("vec_id = 100")).collect()]
    want = sorted(((-v[0], i) for i, v in rows if i != 100))[:20]
    assert sorted(got)[0] == (1, 101, 1e200)
    assert [(v, s) for _, v, s in sorted(got)] == [(i, -s) for s, i in want]


@pytest.mark.parametrize("kind", ["outlier", "copies", "heavy"])
def test_recall_on_odd_rows(spark, kind):
    # before: one row of huge values left 0.04 of the nearest, a large group of copies 0.28 (6,000 rows, 64 dimensions)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 32))
    if kind == "outlier":
        x[-1] = 1e30
    elif kind == "copies":
        x[rng.random(1500) < 0.7] = 1.0
    else:
        x *= np.exp(rng.normal(size=(1500, 1)) * 2)
    x = x.astype(np.float32)
    df = table(spark, x)
    got = {}
    for r in mips.search(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 1500, 20):
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(1500), -s))[:20].tolist()) & got[q])
        assert len(got[q]) == 20
    assert hits / (75 * 20) >= 0.95
