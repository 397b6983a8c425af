"""As-of by blocks, containment by grams, exact KS p-values."""

import itertools
import math
import random
from datetime import datetime, timedelta

import pytest

from scoreline.operators import drift, lines

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("split", [True, False])
def test_latest_quote_equals_brute_force_with_a_hot_key(spark, split):
    rng = random.Random(1)
    key = lambda: rng.choice(["hot", "hot", "hot", "b", None])
    at = lambda: rng.choice([None, *[T0 + timedelta(seconds=rng.randrange(9000))] * 9])
    quotes = [(key(), at(), rng.choice([None, float(rng.randrange(50))])) for _ in range(300)]
    asked = [(key(), at(), i) for i in range(400)]
    if not split:
        quotes = [q for q in quotes if q[0] == "b"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", not split)
    try:
        got = {r.request_id: r.line for r in lines.latest_quote(spark.createDataFrame(asked, "k string, at timestamp_ntz, request_id long"), spark.createDataFrame(quotes, "k string, at timestamp_ntz, line double"), ["k"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 400
    for k, t, i in asked:
        own = [(q[1], q[2] is None, q[2] or 0, q) for q in quotes if q[0] == k and q[1] is not None and t is not None and q[1] <= t]
        best = max(own, key=lambda x: x[:3])[3] if own else None
        want = best[2] if best and (t - best[1]).total_seconds() <= 900 else None
        assert got[i] == want, (k, t, i)


def test_fuzzy_match_equals_brute_force(spark):
    rng = random.Random(2)
    cities = ["Los Angeles", "LA", "New York", "York", "a", "", "Émile", "São Paulo", "Bo"]
    name = lambda: rng.choice([None, "", "x", *[rng.choice(cities) + rng.choice(["", " Lakers", " lakers", " Clippers", "é"])] * 9])
    asked = [(name(), name(), i) for i in range(120)]
    board = [(i, name(), name(), float(i)) for i in range(60)]
    got = {r.rid: (r.line, r.board_seq) for r in lines.fuzzy_match(spark.createDataFrame(asked, "home_team string, away_team string, rid long"), spark.createDataFrame(board, "seq long, board_home string, board_away string, line double")).collect()}
    alike = lambda x, y: x is not None and y is not None and (x.lower() in y.lower() or y.lower() in x.lower())
    for h, a, i in asked:
        hit = next((b for b in board if alike(h, b[1]) and alike(a, b[2])), None)
        assert got[i] == ((hit[3], hit[0]) if hit else (None, None)), (h, a)
    plan = lines.contained(spark.createDataFrame([("a",)], "part string"), spark.createDataFrame([("ab",)], "whole string"))
    assert [tuple(r) for r in plan.collect()] == [("a", "ab")]
    assert "NestedLoop" not in plan._jdf.queryExecution().toString()


def test_exact_ks_equals_all_orders():
    for n, m in ((1, 1), (2, 3), (4, 4), (3, 7), (5, 6)):
        gaps = []
        for places in itertools.combinations(range(n + m), n):
            i = j = top = 0
            for k in range(n + m):
                i, j = (i + 1, j) if k in places else (i, j + 1)
                top = max(top, abs(i * m - j * n))
            gaps.append(top)
        for gap in range(0, n * m + 1):
            want = sum(g >= gap for g in gaps) / math.comb(n + m, n)
            assert abs(drift.exact_ks(n, m, gap) - want) < 1e-12 and drift.exact_ks(m, n, gap) == drift.exact_ks(n, m, gap)
    # large samples come near the limit law; the largest exact ones take moments
    assert abs(drift.exact_ks(5000, 5000, round(0.0272 * 5000 * 5000)) - 0.0494) < 0.002


def test_ks_of_small_samples_is_exact_and_of_large_ones_near(spark, monkeypatch):
    rng = random.Random(3)
    rows = [("f", rng.gauss(0, 1), False) for _ in range(60)] + [("f", rng.gauss(0.4, 1), True) for _ in range(40)] + [("only", 1.0, True)]
    df = spark.createDataFrame(rows, "feature string, value double, current boolean")
    exact = drift.ks(df).collect()
    assert [r.feature for r in exact] == ["f"] and exact[0].ks_pvalue == drift.exact_ks(40, 60, round(exact[0].ks_stat * 2400))
    monkeypatch.setattr(drift, "EXACT_ROWS", 10)
    near = drift.ks(df).first()
    assert near.ks_stat == exact[0].ks_stat and abs(near.ks_pvalue - exact[0].ks_pvalue) < 0.03
    assert "ks_pvalue" in drift.detect(df).columns


def test_a_quote_later_in_the_same_second_is_not_seen(spark):
    at = lambda us: datetime(2024, 1, 1, 12, 0, 5, us)
    quotes = [("a", at(100), 1.0), ("a", at(900), 2.0), ("b", at(500), 3.0)]
    asked = [("a", at(500), 1), ("a", at(900), 2), ("b", at(499), 3), ("b", at(999_999) + timedelta(seconds=900), 4), ("b", at(0) + timedelta(seconds=901), 5)]
    out = lines.latest_quote(spark.createDataFrame(asked, "k string, at timestamp_ntz, request_id long"), spark.createDataFrame(quotes, "k string, at timestamp_ntz, line double"), ["k"])
    assert {r.request_id: r.line for r in out.collect()} == {1: 1.0, 2: 2.0, 3: None, 4: 3.0, 5: None}
