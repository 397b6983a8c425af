"""The feature cache after appends, changes and removals equals a full rebuild, and computes only what was touched."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scoreline.plans import feature_cache, features
from scoreline.sources import store

SCHEMA = "game_id string, sport string, season int, game_date timestamp, home_team string, away_team string, home_score long, away_score long, total long, total_line double, result_over int, home_pace double, away_pace double"
STATS = ["pace"]


def season(rng, year, n=40, teams="abcdefgh"):
    out = []
    for i in range(n):
        h, a = rng.sample(teams, 2)
        x, y = rng.randrange(80, 120), rng.randrange(80, 120)
        out.append((f"nba_{year}_{i:04d}", "nba", year, datetime(year, 1, 1) + timedelta(days=i // 2), h, a, x, y, x + y, 200.5, int(x + y > 200.5), float(rng.randrange(50)), rng.choice([None, float(rng.randrange(50))])))
    return out


def values(df):
    cols = sorted(df.columns)
    show = lambda v: round(v, 7) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(show(r[c]) for c in cols) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def cached(spark):
    rng = random.Random(1)
    rows = season(rng, 2022) + season(rng, 2023)
    folder = store.shared_path(spark)
    frame = lambda r: store.stored(spark.createDataFrame(r, SCHEMA))
    done = feature_cache.refresh(frame(rows), folder, STATS)
    assert done.computed == done.games == 80 and done.partitions == 2
    assert feature_cache.refresh(frame(rows), folder, STATS).hit
    return rows, folder, frame


def same(spark, rows, folder, frame):
    games = frame(rows)
    got = values(feature_cache.matrix(games, folder, "nba", STATS))
    assert got == values(features.build_features(games, "nba", STATS))
    assert len(got) == len(rows)


def test_refreshes_equal_a_rebuild(spark, cached):
    rows, folder, frame = cached
    # two games of a new season: the league's old seasons aren't computed
    new = season(random.Random(2), 2024, 2)
    done = feature_cache.refresh(frame(rows + new), folder, STATS)
    assert done.computed == 2 and done.partitions == 1
    same(spark, rows + new, folder, frame)
    # a changed score: its teams from that day on
    late = list(rows[70])
    late[6] += 30
    rows2 = rows[:70] + [tuple(late)] + rows[71:] + new
    done = feature_cache.refresh(frame(rows2), folder, STATS)
    teams, day = {late[4], late[5]}, late[3]
    assert done.computed == sum(r[3] >= day and bool(teams & {r[4], r[5]}) for r in rows2) < 30
    same(spark, rows2, folder, frame)
    # a team renamed, a game gone, a null date; then a whole season gone
    odd = list(rows2[50])
    odd[4] = "z"
    null = ("nba_x", "nba", 2023, None, "a", "b", 1, 2, 3, None, None, 1.0, 2.0)
    rows3 = rows2[:50] + [tuple(odd)] + rows2[52:] + [null]
    feature_cache.refresh(frame(rows3), folder, STATS)
    same(spark, rows3, folder, frame)
    rows4 = [r for r in rows3 if r[2] != 2024]
    feature_cache.refresh(frame(rows4), folder, STATS)
    same(spark, rows4, folder, frame)
    assert feature_cache.refresh(frame(rows4), folder, STATS).hit


def test_feeds_own_ids_go_through_to_features_and_splits(spark):
    from scoreline.operators import rolling
    from scoreline.sources import tables

    rng = random.Random(3)
    history, batch = season(rng, 2022), season(rng, 2023)
    frame = lambda r: spark.createDataFrame(r, SCHEMA)
    games = store.stored(tables.append(frame(history), frame(batch + history[:5])))
    split = rolling.time_split(features.build_features(games, "nba", STATS), ["sport"])
    assert {r.part: r["count"] for r in split.groupBy("part").count().collect()} == {"train": 57, "validation": 11, "holdout": 12}
    assert "home_pace_ema3" in split.columns and split.where(F.col("part") == "holdout").agg(F.min("game_date")).first()[0].year == 2023


def test_features_are_written_once_and_counted_by_running_frames(spark, monkeypatch):
    from scoreline.operators import schedule

    rng, folder = random.Random(5), store.shared_path(spark)
    rows = season(rng, 2022) + [("nba_n1", "nba", 2022, None, "a", "b", 1, 2, 3, None, None, 1.0, 2.0), ("nba_n2", "nba", 2022, None, "a", "c", 1, 2, 3, None, None, 1.0, 2.0)]
    frame = lambda r: store.stored(spark.createDataFrame(r, SCHEMA))
    widest, stored = [], store.stored
    monkeypatch.setattr(feature_cache, "stored", lambda df: widest.append(len(df.columns)) or stored(df))
    feature_cache.refresh(frame(rows), folder, STATS)
    feature_cache.refresh(frame(rows + season(rng, 2023, 4)), folder, STATS)
    # only games are stored on the way, no features
    assert max(widest) <= len(SCHEMA.split(","))
    games = frame(rows)
    for df in (schedule.games_within(games), schedule.density(games)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "RangeFrame, -" not in plan
    # a row without a date counts those without one, as a range frame does; others count by time
    for r in schedule.games_within(games).collect():
        same_team = [x for x in rows if x[4] == r.home_team]
        want = sum(x[3] is None for x in same_team) if r.game_date is None else sum(x[3] is not None and r.game_date - timedelta(days=7) <= x[3] < r.game_date for x in same_team)
        assert r.home_games_7d == want
