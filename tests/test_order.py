"""Positions, running values and exponential means over ids of any type, null dates, ids and keys, and hot days."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scoreline.functions import keys
from scoreline.operators import metrics, rolling

T0 = datetime(2024, 1, 1)


def rows_of(seed, n=120):
    """Text ids, null dates, ids and sports, repeated dates; a third of all on one day."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        date = rng.choice([None, T0, T0, T0 + timedelta(hours=rng.randrange(500))])
        out.append((rng.choice(["nba", "nfl", None]), None if i == 7 else f"nba_2024_{i:04d}", date, float(rng.randrange(-50, 60)), rng.choice([0, 1, None])))
    return out


SCHEMA = "sport string, game_id string, game_date timestamp, flat_pnl double, result_over int"


def ordered(rows):
    first = lambda v: (v is not None, v)
    return sorted(rows, key=lambda r: (first(r[0]), (r[2] is not None, r[2] or T0), first(r[1]) if r[1] else (False, "")))


@pytest.mark.parametrize("seed", range(2))
def test_positions_and_splits_keep_every_row(spark, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want, at, size = {}, {}, {}
    for r in ordered(rows):
        want[r[1]] = at[r[0]] = at.get(r[0], -1) + 1
        size[r[0]] = size.get(r[0], 0) + 1
    got = keys.with_position(df, ["sport"]).collect()
    assert {r.game_id: r.position for r in got} == want and len(got) == len(rows)
    assert all(r["rows"] == size[r.sport] for r in got)
    assert rolling.time_split(df, ["sport"]).count() == rolling.recent_split(df, ["sport"], 20, 5).count() == len(rows)
    rates = {r.game_id: r.league_over_rate for r in rolling.league_over_rate(df, 4).collect()}
    past = {}
    for r in ordered(rows):
        known = [x for x in past.get(r[0], [])[-4:] if x is not None]
        assert (rates[r[1]] is None) == (not known) and (not known or abs(rates[r[1]] - sum(known) / len(known)) < 1e-9)
        past.setdefault(r[0], []).append(r[4])


def test_blocks_split_one_hot_day(spark):
    df = spark.range(4000).select(F.lit("nba").alias("sport"), F.concat(F.lit("g"), F.lpad("id", 5, "0")).alias("game_id"), F.lit(T0).alias("game_date"))
    sizes = [r["count"] for r in keys.in_blocks(df, ["sport"]).groupBy("_block").count().collect()]
    assert sum(sizes) == 4000 and (len(sizes) == 1 or max(sizes) < 2500)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        sizes = [r["count"] for r in keys.in_blocks(df, ["sport"]).groupBy("_block").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 2 and max(sizes) < 2000


def test_equity_over_text_ids_and_nulls(spark):
    rows = rows_of(3)
    got = {r.game_id: r for r in metrics.equity(spark.createDataFrame(rows, SCHEMA).repartition(4), ["sport"]).collect()}
    assert len(got) == len(rows)
    state = {}
    for sport, i, _, pnl, _ in ordered(rows):
        total, peak = state.get(sport, (0.0, float("-inf")))
        total += pnl
        peak = max(peak, total)
        state[sport] = (total, peak)
        assert abs(got[i].cumulative - total) < 1e-9 and abs(got[i].peak - peak) < 1e-9


@pytest.mark.parametrize("size", [1, 3, 512])
def test_exponential_means_by_blocks(spark, size):
    rng = random.Random(size)
    rows = []
    for i in range(400):
        value = rng.choice([None, float(rng.randrange(100)), 1e9, -3.5])
        rows.append(("nba", f"g{i:04d}", T0 + timedelta(days=i // 3), rng.choice(["a", "a", "a", "b", None]), value if not 100 < i < 260 else None, float(i)))
    df = spark.createDataFrame(rows, "sport string, game_id string, game_date timestamp, home_team string, home_x double, home_y double").repartition(3)
    got = {r.game_id: r for r in rolling.exponential(df, "home", ["x", "y"], (0.3, 0.5, 0.9), size).collect()}
    assert len(got) == 400
    state = {}
    for _, i, _, team, x, y in rows:
        for stat, v in (("x", x), ("y", y)):
            for a in (0.3, 0.5, 0.9):
                now, have = state.get((team, stat, a)), got[i][f"home_{stat}_ema{int(a * 10)}"]
                assert (have is None) == (now is None), (i, stat, a)
                assert now is None or abs(have - now) <= 1e-9 * max(1.0, abs(now)), (i, stat, a, have, now)
                if v is not None:
                    state[team, stat, a] = v if now is None else a * v + (1 - a) * now


def test_exponential_means_without_rows_or_stats(spark):
    df = spark.createDataFrame([], "sport string, game_id string, game_date timestamp, home_team string, home_x double")
    assert rolling.exponential(df, "home", ["x"]).count() == 0
    assert rolling.exponential(df, "home", []).columns == df.columns


def test_a_pairs_earlier_games_are_a_running_frame(spark):
    """A frame that slides is summed anew for each day, however long the pair's history."""
    from scoreline.operators import matchup

    rows = [(i, "nba", 86_400 * (i % 17), i % 2, 2 + i % 3, i % 7, i % 11) for i in range(300)]
    g = spark.createDataFrame(rows, "game_id long, sport string, t long, home_team long, away_team long, result_over long, total long")
    g = g.withColumn("game_date", F.expr("timestampadd(SECOND, t, TIMESTAMP_NTZ'2024-01-01 00:00:00')")).withColumn("total_line", F.lit(5.5))
    out = matchup.head_to_head(g)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame, unboundedpreceding$(), -1" in plan and "-4611686018427387904" not in plan
    for r in out.collect():
        past = [x for x in rows if (x[3], x[4]) == (r.home_team, r.away_team) and x[2] < r.t]
        assert r.h2h_over_rate == pytest.approx(sum(x[5] for x in past) / len(past) if len(past) >= 2 else 0.5)
        assert r.h2h_avg_total == pytest.approx(sum(x[6] for x in past) / len(past) if len(past) >= 2 else 5.5)


def test_games_are_computed_once_for_both_sides(spark):
    from scoreline.functions.keys import appearances
    from scoreline.operators import schedule

    g = spark.createDataFrame([("nba", 1, 1, "A", "B", 3, 4)], "sport string, game_id long, day int, home_team string, away_team string, home_score long, away_score long")
    g = g.selectExpr("* except (day)", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(day) AS game_date")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan(appearances(g))
    assert sorted(map(tuple, appearances(g, "home_team").drop("game_date").collect())) == [("nba", 1, "away", "B", "A", 4, 3, "A"), ("nba", 1, "home", "A", "B", 3, 4, "A")]
    places = spark.createDataFrame([("A", 0.0, 0.0)], "team string, lat double, lon double")
    assert plan(schedule.travel(g, places)).count("Join") == 2


def test_last_rows_of_a_key_are_told_by_counts(spark):
    from scoreline.operators import lines

    rows = [("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("a", 2, 4), ("a", 3, 5), ("b", 1, 6), ("b", None, 7), ("b", None, 8), (None, 5, 9), (None, 4, 10), (None, 3, 11), ("c", 9, 12)]
    got = lines.last_per_key(spark.createDataFrame(rows, "k string, day int, id int"), ["k"], 2, ["day", "id"])
    assert got.columns == ["k", "day", "id"] and sorted(r.id for r in got.collect()) == [4, 5, 6, 8, 9, 10, 12]


def test_a_side_is_rolled_without_the_other_columns(spark):
    g = spark.createDataFrame([("nba", i, T0 + timedelta(days=i), "AB"[i % 2], "BA"[i % 2], float(i * 7 % 11), float(i), "x") for i in range(30)], "sport string, game_id long, game_date timestamp_ntz, home_team string, away_team string, home_p double, away_p double, venue string")
    whole = rolling.rolling(g, ["p"], (3, 5))
    for side in ("home", "away"):
        slim = rolling.rolling_side(g, side, ["p"], (3, 5))
        assert slim.columns == ["sport", "game_id", *(c for c in whole.columns if c.startswith(f"{side}_p_"))]
        assert sorted(map(str, slim.collect())) == sorted(map(str, whole.select(*slim.columns).collect()))
