"""Queries of scans, feeds, table maintenance, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import composites, injuries, matchup
from ..sources import adapt, feeds, store, tables
from . import feature_cache
from .base import G, query, r6, rounded, s6
from .features import DROPPED

_ALL = "game_id, sport, season, game_date, home_team, away_team, home_score, away_score, total, home_plays, away_plays, total_line, result_over"


@query("a1_load_games", f"{G}SELECT * FROM games")
def a1(spark, sf):
    path = store.shared_path(spark)
    adapt.games(spark, sf).write.parquet(path)
    return spark.read.parquet(path)


@query("a2_load_labelled", f"{G}SELECT {_ALL} FROM games WHERE CASE WHEN game_id % 11 <> 0 THEN result_over END IS NOT NULL")
def a2(spark, sf):
    g = adapt.games(spark, sf).withColumn("result_over", F.when(F.col("game_id") % 11 != 0, F.col("result_over")))
    return tables.labelled(g)


@query("a3_projected_scan", "SELECT o_orderkey, o_orderdate FROM orders")
def a3(spark, sf):
    return adapt.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")


def _as_json(df, *columns):
    return df.select(F.to_json(F.struct(*columns)).alias("json"))


def _s(c):
    return F.col(c).cast("string")


def _sides(text: str, sides=("home", "away")) -> str:
    """text for both sides: {s} is the side, {o} the other."""
    return ",\n".join(text.replace("{s}", s).replace("{o}", o) for s, o in (sides, sides[::-1]))


_CLOCK = "({s}_plays + (game_id % 60) / 60.0::DOUBLE)"
_NFL_SIDE = f"""CAST({{s}}_score * 3 AS DOUBLE) AS "{{s}}_passingYards", CAST({{s}}_score * 2 AS DOUBLE) AS "{{s}}_rushingYards", CAST({{s}}_score * 5 AS DOUBLE) AS "{{s}}_receivingYards", CAST({{s}}_plays % 4 AS DOUBLE) AS {{s}}_turnovers, CAST({{s}}_plays % 5 AS DOUBLE) AS {{s}}_sacks,
{s6("coalesce(({s}_plays % 6) / CAST(nullif({s}_plays, 0) AS DOUBLE), 0)", '"{s}_thirdDownConversion"')}, {s6("({s}_score % 3) / 4.0::DOUBLE", '"{s}_redZoneEfficiency"')}, {s6(_CLOCK, '"{s}_timeOfPossession"')}, 4.5::DOUBLE AS "{{s}}_yardsPerPlay", 0.0::DOUBLE AS "{{s}}_fourthDownConversion",
CAST({{s}}_score AS DOUBLE) AS "{{s}}_penaltyYards", {s6("({s}_plays % 5) / CAST(greatest(1, {s}_plays) AS DOUBLE)", '"{s}_pressureRate"')}, {s6(_CLOCK + " * 60 / 61.0::DOUBLE", '"{s}_secondsPerPlay"')}, {s6("({s}_score % 3) / 4.0::DOUBLE", '"{s}_redZoneConvRate"')},
CAST({{s}}_score AS DOUBLE) AS "{{s}}_pointsScored", CAST({{o}}_score AS DOUBLE) AS "{{s}}_pointsAllowed", CAST(CASE WHEN {{s}}_plays % 3 = 0 THEN 2 ELSE 0 END AS DOUBLE) AS {{s}}_key_players_out"""


@query("a4_flatten_nfl_events", f"""{G}SELECT CAST(game_id AS VARCHAR) AS game_id, game_date, CAST(home_team AS VARCHAR) AS home_team, CAST(away_team AS VARCHAR) AS away_team, home_score, away_score, total, concat('v', home_team) AS venue, {_sides(_NFL_SIDE)},
CASE WHEN home_team % 5 = 0 THEN 0.0::DOUBLE ELSE CAST(game_id % 30 AS DOUBLE) END AS wind_speed_mph, CASE WHEN game_id % 4 = 0 THEN CASE WHEN home_team % 5 = 0 THEN 72.0::DOUBLE ELSE 55.0::DOUBLE END ELSE CAST(70 + game_id % 20 AS DOUBLE) END AS temperature_f,
CASE WHEN home_team % 5 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_dome, CASE WHEN home_team = 7 THEN 5280.0::DOUBLE ELSE 0.0::DOUBLE END AS altitude_feet FROM games WHERE sport = 'nfl' AND game_id % 9 <> 0""")
def a4(spark, sf):
    g = adapt.games(spark, sf).where("sport = 'nfl'")
    i, null = F.col("game_id"), F.lit(None).cast("string")

    def stats(s):
        score, plays = F.col(f"{s}_score"), F.col(f"{s}_plays")
        text = lambda *parts: F.concat(*(x.cast("string") if hasattr(x, "cast") else F.lit(x) for x in parts))
        values = {
            "Passing": text(score * 3), "Rushing": text(score * 2), "Total Yards": text(score * 5), "Turnovers": text(plays % 4), "Sacks-Yards Lost": text(plays % 5, "-14"), "3rd down efficiency": text(plays % 6, "-", plays),
            "Red Zone (Made-Att)": text(score % 3, "-4"), "Possession": text(plays, ":", F.lpad((i % 60).cast("string"), 2, "0")), "Yards per Play": F.lit("4.5"), "4th down efficiency": F.lit("0-0"), "Penalties": text("3-", score), "Total Plays": F.lit("61"), "Comp/Att": text("10/", plays),
        }
        # names or labels, as the source mixes them
        rows = [F.struct((F.lit(k) if n % 2 else null).alias("label"), (null if n % 2 else F.lit(k)).alias("name"), v.alias("displayValue")) for n, (k, v) in enumerate(values.items())]
        return F.struct(F.struct(F.when(i % 7 == 0, "?").otherwise(_s(f"{s}_team")).alias("abbreviation")).alias("team"), F.array(*rows).alias("statistics"))

    hurt = lambda s: F.when(F.col(f"{s}_plays") % 3 == 0, F.array(*(F.struct(F.lit(x).alias("status"), F.struct(F.lit(y).alias("name")).alias("type")) for x, y in (("Out", ""), ("", "DOUBTFUL"), ("Questionable", "x")))))
    rival = lambda s: F.struct(F.lit(s).alias("homeAway"), F.struct(_s(f"{s}_team").alias("abbreviation")).alias("team"), _s(f"{s}_score").alias("score"), hurt(s).alias("injuries"))
    weather = F.struct(F.when(i % 4 != 0, (70 + i % 20).cast("string")).alias("temperature"), F.when(i % 2 == 0, (i % 30).cast("string")).alias("windSpeed"), F.concat(F.lit("63° F, Wind "), (i % 30).cast("string"), F.lit(" mph")).alias("displayValue"))
    status = F.struct(F.struct(F.when(i % 9 == 0, "STATUS_POSTPONED").otherwise("STATUS_FINAL").alias("name")).alias("type"))
    match = F.struct(status.alias("status"), F.struct(F.concat(F.lit("v"), _s("home_team")).alias("fullName")).alias("venue"), weather.alias("weather"), F.array(rival("away"), rival("home")).alias("competitors"))
    event = F.struct(i.cast("string").alias("id"), F.date_format("game_date", "yyyy-MM-dd'T'HH:mm'Z'").alias("date"), F.array(match).alias("competitions"))
    summary = F.struct(F.struct(F.array(stats("home"), stats("away")).alias("teams")).alias("boxscore"))
    return rounded(feeds.nfl_events(_as_json(g, event.alias("event"), summary.alias("summary")), tuple(map(str, range(0, 25, 5))), {"nfl": {"7": 5280.0}}))


_MLB_SIDE = f"""CAST(CASE WHEN m THEN 0 ELSE {{s}}_score END AS DOUBLE) AS "{{s}}_runsScored", CAST(CASE WHEN m THEN 0 ELSE {{o}}_score END AS DOUBLE) AS "{{s}}_runsAllowed", CAST(CASE WHEN m THEN 0 ELSE {{s}}_plays END AS DOUBLE) AS {{s}}_hits, CAST(CASE WHEN m THEN 0 ELSE {{s}}_plays % 5 END AS DOUBLE) AS {{s}}_walks,
CAST(CASE WHEN m THEN 0 ELSE {{s}}_plays % 7 END AS DOUBLE) AS {{s}}_strikeouts, CASE WHEN m THEN 0.0::DOUBLE ELSE 3.75::DOUBLE END AS {{s}}_era, CASE WHEN m THEN 0.0::DOUBLE ELSE 1.25::DOUBLE END AS {{s}}_whip, CASE WHEN m THEN 0.0::DOUBLE ELSE 0.25::DOUBLE END AS "{{s}}_battingAvg", 0.0::DOUBLE AS "{{s}}_onBasePct",
CASE WHEN m THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS "{{s}}_sluggingPct", CASE WHEN m THEN 0.0::DOUBLE ELSE 0.75::DOUBLE END AS {{s}}_ops, CAST(CASE WHEN m THEN 0 ELSE {{s}}_score % 4 END AS DOUBLE) AS "{{s}}_homeRuns", CAST(CASE WHEN m THEN 0 ELSE 2 END AS DOUBLE) AS {{s}}_errors,
{s6("CASE WHEN m THEN 0 ELSE {s}_score / CAST(greatest(1, {s}_plays) AS DOUBLE) END", '"{s}_kBbRatio"')}, {s6("CASE WHEN m THEN 0 ELSE {s}_plays / CAST(greatest(1, {s}_plays + {s}_score) AS DOUBLE) END", '"{s}_groundBallRate"')}, {s6("CASE WHEN m THEN 0 ELSE {s}_score / CAST(greatest(1, {s}_plays + {s}_score) AS DOUBLE) END", '"{s}_flyBallRate"')},
CAST(CASE WHEN m THEN 0 WHEN game_id % 2 = 0 THEN 2 ELSE 1 END AS DOUBLE) AS {{s}}_key_players_out"""


@query("a5_flatten_mlb_games", f"""{G}, b AS (SELECT *, game_id % 3 = 0 AS m, CASE WHEN home_team % 4 = 3 THEN concat('T', home_team) ELSE concat('N', home_team) END AS h, CASE WHEN away_team % 4 = 3 THEN concat('T', away_team) ELSE concat('N', away_team) END AS a FROM games WHERE sport = 'mlb' AND game_id % 8 <> 0)
SELECT CAST(game_id AS VARCHAR) AS game_id, game_date, h AS home_team, a AS away_team, home_score, away_score, total, {_sides(_MLB_SIDE)}, CASE WHEN h = 'N5' THEN 0.0::DOUBLE ELSE CAST(game_id % 30 AS DOUBLE) END AS wind_speed_mph,
CASE WHEN game_id % 5 = 0 THEN 70.0::DOUBLE ELSE CAST(50 + game_id % 40 AS DOUBLE) END AS temperature_f, CASE WHEN h = 'N5' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_dome, CASE WHEN h = 'N6' THEN 5280.0::DOUBLE ELSE 0.0::DOUBLE END AS altitude_feet FROM b""")
def a5(spark, sf):
    g = adapt.games(spark, sf).where("sport = 'mlb'")
    i, n = F.col("game_id"), F.col("n_nationkey")
    day = F.date_format("game_date", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    team = lambda s: F.struct(F.struct(F.col(f"{s}_team").alias("id")).alias("team"), F.col(f"{s}_score").alias("score"))
    weather = F.struct(F.when(i % 5 != 0, (50 + i % 40).cast("string")).alias("temp"), F.concat((i % 30).cast("string"), F.lit(" mph, Out To CF")).alias("wind"))
    game = F.struct(i.alias("gamePk"), day.alias("gameDate"), F.struct(F.when(i % 8 == 0, "Postponed").otherwise("Final").alias("detailedState")).alias("status"), F.struct(team("home").alias("home"), team("away").alias("away")).alias("teams"), weather.alias("weather"))
    schedule = _as_json(g, F.array(F.struct(_s("season").alias("date"), F.array(game).alias("games"))).alias("dates"))

    def box(s, o):
        score, plays, other = F.col(f"{s}_score"), F.col(f"{s}_plays"), F.col(f"{o}_score")
        batting = F.struct(score.alias("runs"), plays.alias("hits"), (score % 4).alias("homeRuns"), (plays % 7).alias("strikeOuts"), (plays % 5).alias("baseOnBalls"), F.lit(".250").alias("avg"), F.lit("-.--").alias("obp"), F.lit("0.500").alias("slg"), F.lit(".750").alias("ops"))
        pitching = F.struct(other.alias("runs"), score.alias("strikeOuts"), plays.alias("baseOnBalls"), F.lit("3.75").alias("era"), F.lit("1.25").alias("whip"), score.alias("flyOuts"), plays.alias("groundOuts"))
        player = lambda code: F.struct(F.struct(code.alias("code")).alias("status"))
        players = F.struct(player(F.lit("A")).alias("ID1"), player(F.lit("D10-dl")).alias("ID2"), player(F.when(i % 2 == 0, "10-day il").otherwise("RM")).alias("ID3"))
        return F.struct(F.struct(batting.alias("batting"), pitching.alias("pitching")).alias("teamStats"), F.lit(2).alias("errors"), players.alias("players"))

    boxes = _as_json(g.where(i % 3 != 0), i.alias("gamePk"), F.struct(box("home", "away").alias("home"), box("away", "home").alias("away")).alias("teams"))
    teams = adapt.table(spark, sf, "nation").where(n % 4 != 3).select(n.cast("long").alias("id"), F.concat(F.lit("N"), n.cast("string")).alias("abbr"))
    return rounded(feeds.mlb_games(schedule, boxes, teams, ("N5",), {"mlb": {"N6": 5280.0}}))


@query("a6_pair_team_logs", f"{G}SELECT game_id, home_team, home_score AS home_points, home_plays AS home_plays, away_team, away_score AS away_points, away_plays AS away_plays FROM games WHERE game_id % 10 <> 0")
def a6(spark, sf):
    g = adapt.games(spark, sf)
    half = lambda s, word: F.struct(F.concat(_s(f"{s}_team"), F.lit(word), F.lit("x")).alias("matchup"), F.col(f"{s}_team").alias("team"), F.col(f"{s}_score").alias("points"), F.col(f"{s}_plays").alias("plays"))
    home, away = half("home", " vs. "), half("away", " @ ")
    return feeds.pair_logs(g.select("game_id", F.inline(F.when(F.col("game_id") % 10 != 0, F.array(home, away)).otherwise(F.array(home)))))


_NBA_FROM = """SELECT *, CAST(home_plays + 60 AS DOUBLE) AS home_shots, CAST(away_plays + 60 AS DOUBLE) AS away_shots, CAST(home_score AS DOUBLE) AS home_pts, CAST(away_score AS DOUBLE) AS away_pts, greatest(1.0::DOUBLE, home_plays + 60 - 10 + home_plays % 20 + 0.44::DOUBLE * 22) AS home_poss, greatest(1.0::DOUBLE, away_plays + 60 - 10 + away_plays % 20 + 0.44::DOUBLE * 22) AS away_poss FROM games WHERE sport = 'nba' AND game_id % 4 <> 0"""
_NBA_GIVEN = {"fieldGoalAttempts": "{s}_shots", "points": "{s}_pts", "turnovers": "CAST({s}_plays % 20 AS DOUBLE)", "fieldGoalPct": "0.5::DOUBLE", "assists": "CAST({s}_plays AS DOUBLE)"}
_NBA_RATES = {
    "possessions": "{s}_poss", "pointsPerPossession": "{s}_pts / {s}_poss", "trueShooting": "{s}_pts / greatest(1, 2 * ({s}_shots + 0.44::DOUBLE * 22))", "offensiveRating": "100 * {s}_pts / {s}_poss", "defensiveRating": "100 * {o}_pts / {s}_poss", "pace": "{s}_poss",
    "assistRate": "{s}_plays / {s}_poss", "drebRate": "34 / 44.0::DOUBLE", "ftRate": "22 / {s}_shots", "threePointRate": "33 / {s}_shots", "netRating": "{s}_pts - {o}_pts",
}
_NBA_SIDE = ", ".join(
    [s6(_NBA_GIVEN.get(v, "0.0::DOUBLE"), f'"{{s}}_{v}"') for v in feeds.NBA_STATS.values()] + [s6(v, f'"{{s}}_{k}"') for k, v in _NBA_RATES.items()]
    + ["CASE WHEN {s}_plays % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {s}_key_players_out, CASE WHEN {s}_plays % 2 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS {s}_players_out"]
)


@query("a7_flatten_nba_boxscore", f"""{G}, n AS ({_NBA_FROM})
SELECT concat(CASE WHEN game_id % 5 = 0 THEN '00424' ELSE '00223' END, game_id) AS game_id, game_date, CAST(home_team AS VARCHAR) AS home_team, CAST(away_team AS VARCHAR) AS away_team, home_score, away_score, total, concat(home_team, '_arena') AS venue, {_sides(_NBA_SIDE)},
1.0::DOUBLE AS is_dome, 72.0::DOUBLE AS temperature_f, 0.0::DOUBLE AS wind_speed_mph, CASE WHEN home_team = 3 THEN 4300.0::DOUBLE ELSE 0.0::DOUBLE END AS altitude_feet, CASE WHEN game_id % 5 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_playoff FROM n""")
def a7(spark, sf):
    g = adapt.games(spark, sf).where("sport = 'nba'")

    def team(s, o):
        score, plays = F.col(f"{s}_score"), F.col(f"{s}_plays")
        stats = F.struct((plays + 60).alias("fieldGoalsAttempted"), score.alias("points"), (plays % 20).alias("turnovers"), F.lit(0.5).alias("fieldGoalsPercentage"), plays.alias("assists"), (score - F.col(f"{o}_score")).alias("plusMinusPoints"))
        player = lambda comment: F.struct(F.lit("A").alias("firstName"), F.lit("B").alias("familyName"), comment.alias("comment"))
        players = F.array(player(F.lit("DNP - Coach's Decision")), player(F.lit("NWT - Left Ankle")), player(F.when(plays % 2 == 0, "DND - Injury/Illness").otherwise("")))
        return F.struct(_s(f"{s}_team").alias("teamTricode"), stats.alias("statistics"), players.alias("players"))

    i = F.col("game_id")
    number = F.concat(F.when(i % 5 == 0, "00424").otherwise("00223"), i.cast("string"))
    status = F.when(i % 4 == 0, 2).otherwise(3)
    rows = _as_json(g, number.alias("gameId"), status.alias("gameStatus"), F.date_format("game_date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("gameTimeUTC"), team("home", "away").alias("homeTeam"), team("away", "home").alias("awayTeam"))
    return rounded(feeds.nba_boxes(rows, {"nba": {"3": 4300.0}}))


@query("a8_flatten_odds", f"""WITH {adapt.QUOTES_SQL}, q AS (SELECT game_id, book, max_by(point, (seq, point, spread, price)) AS point, max_by(spread, (seq, point, spread, price)) AS spread, max_by(price, (seq, point, spread, price)) AS price FROM quotes GROUP BY game_id, book)
SELECT CAST(game_id AS VARCHAR) AS id, concat('Team', game_id % 25) AS home_team, concat('team', (game_id + 7) % 25) AS away_team, '2024-01-01T00:00:00Z' AS commence_time, CAST(book AS VARCHAR) AS book, point AS total, spread, price AS home_price, -price AS away_price FROM q""")
def a8(spark, sf):
    q = adapt.quotes(spark, sf)
    last = q.groupBy("game_id", "book").agg(*(F.max_by(c, F.struct("seq", "point", "spread", "price")).alias(c) for c in ("point", "spread", "price")))
    home, away = F.concat(F.lit("Team"), (F.col("game_id") % 25).cast("string")), F.concat(F.lit("team"), ((F.col("game_id") + 7) % 25).cast("string"))
    o = lambda name, point, price: F.struct(name.alias("name"), point.cast("double").alias("point"), price.cast("double").alias("price"))
    none = F.lit(None)
    markets = F.array(
        F.struct(F.lit("totals").alias("key"), F.array(o(F.lit("Under"), F.col("point"), none), o(F.lit("OVER"), F.col("point"), none)).alias("outcomes")),
        F.struct(F.lit("spreads").alias("key"), F.array(o(F.upper(home), F.col("spread"), none), o(away, -F.col("spread"), none)).alias("outcomes")),
        F.struct(F.lit("h2h").alias("key"), F.array(o(F.lower(home), none, F.col("price")), o(away, none, -F.col("price"))).alias("outcomes")))
    books = last.groupBy("game_id").agg(F.collect_list(F.struct(F.col("book").cast("string").alias("key"), markets.alias("markets"))).alias("bookmakers"))
    return feeds.odds(_as_json(books, _s("game_id").alias("id"), home.alias("home_team"), away.alias("away_team"), F.lit("2024-01-01T00:00:00Z").alias("commence_time"), "bookmakers"))


@query("a9_flatten_board", f"""WITH {adapt.QUOTES_SQL}, k AS (SELECT game_id, seq, book, max(point) AS line, seq % 2 = 0 AS g FROM quotes WHERE seq <> 3 GROUP BY game_id, seq, book)
SELECT concat(game_id, '-', seq, '-', book) AS id, CASE WHEN g THEN CASE WHEN seq % 4 = 0 THEN 'Run Line' ELSE 'Total Points' END ELSE 'Points' END AS stat_type, line, CASE WHEN g THEN 'game_line' ELSE 'player_prop' END AS kind, CAST(game_id AS VARCHAR) AS game_id, concat('H', game_id % 25) AS home_team, 'A' AS away_team,
TIMESTAMP '2024-02-02 10:00:00' AS start_time, CASE WHEN g THEN NULL WHEN book = 0 THEN 'someone' ELSE concat('Player ', book) END AS name, CASE WHEN g THEN NULL WHEN book = 0 THEN 'someone' ELSE concat('T', book) END AS team, CASE WHEN g THEN NULL WHEN book = 0 THEN '' ELSE 'QB' END AS position,
'pre_game' AS status, book = 1 AS is_promo, CASE WHEN book = 2 THEN 'demon' ELSE 'standard' END AS odds_type, 'Single Stat' AS projection_type FROM k""")
def a9(spark, sf):
    q = adapt.quotes(spark, sf).groupBy("game_id", "seq", "book").agg(F.max("point").alias("point"))
    b, seq = F.col("book").cast("string"), F.col("seq")
    to = lambda name, id_: F.struct(F.struct(id_.alias("id")).alias("data")).alias(name)
    attributes = F.struct(
        F.when(seq % 4 == 0, "Run Line").when(seq % 2 == 0, "Total Points").otherwise("Points").alias("stat_type"), F.when(seq == 3, "n/a").otherwise(_s("point")).alias("line_score"), (F.col("book") == 1).alias("is_promo"), F.when(F.col("book") == 2, "demon").alias("odds_type"),
        F.lit("Single Stat").alias("projection_type"), F.lit("team").alias("event_type"), F.lit("someone").alias("description"))
    row = F.struct(F.lit("projection").alias("type"), F.concat(_s("game_id"), F.lit("-"), _s("seq"), F.lit("-"), b).alias("id"), attributes.alias("attributes"), F.struct(to("new_player", b), to("game", _s("game_id"))).alias("relationships"))
    # a player's attributes and a game's are of different kinds, so each is made as text
    player = F.to_json(F.struct(F.lit("new_player").alias("type"), b.alias("id"), F.struct(F.concat(F.lit("Player "), b).alias("display_name"), F.concat(F.lit("T"), b).alias("team"), F.lit("QB").alias("position")).alias("attributes")))
    home = F.struct(F.concat(F.lit("H"), (F.col("game_id") % 25).cast("string")).alias("abbreviation"))
    info = F.struct(F.struct(F.struct(home.alias("home"), F.struct(F.lit("A").alias("abbreviation")).alias("away")).alias("teams")).alias("game_info"))
    game = F.to_json(F.struct(F.lit("game").alias("type"), _s("game_id").alias("id"), F.struct(info.alias("metadata"), F.lit("2024-02-02T10:00:00Z").alias("start_time")).alias("attributes")))
    page = q.groupBy("game_id").agg(F.to_json(F.collect_list(row)).alias("data"), F.concat_ws(",", F.collect_set(F.when(F.col("book") != 0, player)), F.first(game)).alias("included"))
    return feeds.board(page.select(F.concat(F.lit('{"data":'), "data", F.lit(',"included":['), "included", F.lit("]}")).alias("json")))


@query("a10_flatten_team_log", G + " UNION ALL ".join(f"SELECT CAST(game_id AS VARCHAR) AS game_id, game_date, CAST({s}_team AS VARCHAR) AS team_id, concat('Team ', {s}_team) AS team_name, '{s}' AS home_away, {s}_score AS score, CAST({s}_plays AS DOUBLE) AS rebounds, CAST({s}_score * 2 AS DOUBLE) AS assists, 0.0::DOUBLE AS steals FROM games" for s in ("home", "away")))
def a10(spark, sf):
    stat = lambda name, v: F.struct(F.lit(name).alias("name"), v.cast("string").alias("displayValue"))
    side = lambda s: F.struct(
        F.lit(s).alias("homeAway"), F.struct(_s(f"{s}_team").alias("id"), F.concat(F.lit("Team "), _s(f"{s}_team")).alias("displayName")).alias("team"), _s(f"{s}_score").alias("score"), F.array(stat("rebounds", F.col(f"{s}_plays")), stat("assists", F.col(f"{s}_score") * 2)).alias("statistics"))
    event = F.struct(_s("game_id").alias("id"), F.date_format("game_date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), F.array(F.struct(F.array(side("home"), side("away")).alias("competitors"))).alias("competitions"))
    logs = adapt.games(spark, sf).groupBy("home_team", "season").agg(F.collect_list(event).alias("events"))
    return feeds.team_logs(_as_json(logs, "events"), ["rebounds", "assists", "steals"])


@query("a11_flatten_rosters", "SELECT CAST(c_nationkey AS VARCHAR) AS team, c_mktsegment AS position, CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CASE c_custkey % 4 WHEN 0 THEN 'Out' ELSE 'Questionable' END AS status, c_custkey % 4 = 0 AS is_key FROM customer WHERE c_custkey % 4 IN (0, 1)")
def a11(spark, sf):
    c, k = adapt.table(spark, sf, "customer"), F.col("c_custkey")
    status = F.when(k % 4 == 0, "Out").when(k % 4 == 1, "Questionable").when(k % 4 == 2, "Active")
    player = F.struct(k.cast("string").alias("id"), F.col("c_name").alias("displayName"), F.struct(F.col("c_mktsegment").alias("abbreviation")).alias("position"), F.when(status.isNotNull(), F.struct(status.alias("name"))).alias("status"))
    # one team's athletes are listed by group, another's one by one
    groups = c.groupBy("c_nationkey", "c_mktsegment").agg(F.collect_list(player).alias("items"))
    team = groups.groupBy("c_nationkey").agg(F.collect_list("items").alias("athletes"))
    listed, single = team.where("c_nationkey % 2 = 0"), team.where("c_nationkey % 2 = 1").select("c_nationkey", F.flatten("athletes").alias("athletes"))
    return feeds.rosters(_as_json(listed, _s("c_nationkey").alias("team"), "athletes").unionByName(_as_json(single, _s("c_nationkey").alias("team"), "athletes")))


@query("a12_json_schema", f"{G}SELECT game_id, sport, home_score, total_line FROM games")
def a12(spark, sf):
    path = store.shared_path(spark)
    adapt.games(spark, sf).select("game_id", "sport", "home_score", "total_line").write.json(path)
    return spark.read.schema("game_id long, sport string, home_score long, total_line double").json(path)


@query("a12_quarantine", f"{G}SELECT game_id, game_id % 10 = 0 AS bad FROM games")
def a12_quarantine(spark, sf):
    """Every tenth document breaks off or has text for a number; good and quarantined ones are all there were."""
    line = F.to_json(F.struct("game_id", "sport", "home_score", "total_line"))
    broken = F.when(F.col("game_id") % 20 == 0, F.substring(line, 1, 20)).when(F.col("game_id") % 10 == 0, F.regexp_replace(line, '"home_score":', '"home_score":"many","points":')).otherwise(line)
    path = store.shared_path(spark)
    good = feeds.quarantine(adapt.games(spark, sf).select("game_id", broken.alias("json")), "struct<game_id bigint, sport string, home_score bigint, total_line double>", path)
    bad = spark.read.schema("game_id long, json string, seen_at timestamp").parquet(path)
    return good.select("game_id", F.lit(False).alias("bad")).unionByName(bad.select("game_id", F.lit(True).alias("bad")))


@query("a13_recent_window", f"{G}SELECT game_id, game_date FROM games WHERE game_date >= TIMESTAMP '1998-01-01' - INTERVAL 90 DAY")
def a13(spark, sf):
    return tables.recent(adapt.games(spark, sf), F.expr("TIMESTAMP_NTZ'1998-01-01 00:00:00'"), 90).select("game_id", "game_date")


@query("a14_range_scan", f"{G}SELECT game_id, game_date FROM games WHERE sport = 'nba' AND game_date BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' ORDER BY game_date, game_id")
def a14(spark, sf):
    d = lambda s: F.expr(f"TIMESTAMP_NTZ'{s} 00:00:00'")
    return tables.between(adapt.games(spark, sf), "nba", d("1995-01-01"), d("1996-12-31")).select("game_id", "game_date").orderBy("game_date", "game_id")


# ------------------------------------------------------------------ tables
@query("b1_write_features", f"{G}SELECT game_id, total, sport, season FROM games")
def b1(spark, sf):
    path = store.shared_path(spark)
    tables.write_features(adapt.games(spark, sf).select("game_id", "total", "sport", "season"), path)
    return spark.read.schema("game_id long, total long, sport string, season int").parquet(path)


@query("b2_register_table", f"{G}SELECT sport, count(*) AS n FROM games GROUP BY sport")
def b2(spark, sf):
    path = store.shared_path(spark)
    adapt.games(spark, sf).select("game_id", "sport").write.parquet(path)
    name = "games_" + path.rsplit("/", 1)[1]
    tables.register(spark, name, path)
    return spark.table(name).groupBy("sport").agg(F.count("*").alias("n"))


def _history(g):
    return g.where("game_id % 3 <> 0").drop("away_plays")


def _batch(g):
    return g.where("game_id % 3 = 0 OR game_id % 10 = 0")


@query("b3_append_new_games", f"{G}SELECT game_id, total, CASE WHEN game_id % 3 = 0 THEN away_plays END AS away_plays FROM games")
def b3(spark, sf):
    g = store.stored(adapt.games(spark, sf))
    return tables.append(_history(g), _batch(g)).select("game_id", "total", "away_plays")


@query("b4_dedupe_games", f"{G}SELECT game_id, game_date, total FROM games")
def b4(spark, sf):
    g = adapt.games(spark, sf)
    again = g.where("game_id % 5 = 0").withColumn("game_date", F.col("game_date") + F.expr("INTERVAL 3 DAYS"))
    return tables.first_per_key(g.unionByName(again), "game_id", "game_date").select("game_id", "game_date", "total")


_REPORTS = "reports AS (SELECT c_custkey AS player_id, 'nba' AS sport, CAST(c_nationkey AS BIGINT) AS team, CASE c_custkey % 5 WHEN 0 THEN 'out' WHEN 1 THEN 'doubtful' WHEN 2 THEN 'questionable' WHEN 3 THEN 'probable' ELSE 'active' END AS status FROM customer)"


def _reports(spark, sf):
    k = F.col("c_custkey")
    status = F.element_at(F.array(*map(F.lit, ("out", "doubtful", "questionable", "probable", "active"))), (k % 5 + 1).cast("int"))
    return adapt.table(spark, sf, "customer").select(k.alias("player_id"), F.lit("nba").alias("sport"), F.col("c_nationkey").cast("long").alias("team"), status.alias("status"))


@query("b5_upsert_injuries", f"WITH {_REPORTS} SELECT player_id, sport, team, CASE WHEN player_id % 3 = 0 THEN 'out' ELSE status END AS status, CASE WHEN player_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM reports WHERE player_id % 2 = 0 OR player_id % 3 = 0")
def b5(spark, sf):
    r = _reports(spark, sf)
    old = r.where("player_id % 2 = 0").withColumn("version", F.lit(1))
    new = r.where("player_id % 3 = 0").withColumn("status", F.lit("out")).withColumn("version", F.lit(2))
    return injuries.upsert(old, new, ["player_id", "sport"], "version").select("player_id", "sport", "team", "status", "version")


@query("b6_append_reports", f"{G}SELECT sport, season, count(*) AS n FROM games GROUP BY sport, season")
def b6(spark, sf):
    path, g = store.shared_path(spark), adapt.games(spark, sf)
    for part in ("season % 2 = 0", "season % 2 = 1"):
        g.where(part).groupBy("sport", "season").agg(F.count("*").alias("n")).write.mode("append").parquet(path)
    return spark.read.schema("sport string, season int, n long").parquet(path)


@query("b7_cluster_by_date", f"{G}SELECT game_id, game_date FROM games")
def b7(spark, sf):
    path = store.shared_path(spark)
    tables.write_clustered(adapt.games(spark, sf).select("game_id", "game_date"), path)
    return spark.read.schema("game_id long, game_date timestamp_ntz").parquet(path)


@query("b8_stale_features", f"{G}SELECT DISTINCT sport FROM games WHERE sport = 'nfl'")
def b8(spark, sf):
    g = store.stored(adapt.games(spark, sf))
    changed = g.withColumn("total", F.when((F.col("sport") == "nfl") & (F.col("game_id") % 100 == 0), F.col("total") + 1).otherwise(F.col("total")))
    return tables.stale(tables.signature(g), tables.signature(changed))


_PLAYS = [(s, n) for s in ("home", "away") for n in (3, 5, 10, 20)]


@query("b8_feature_cache", f"{G}SELECT game_id, " + ", ".join(s6(f"avg({s}_plays) OVER {s[0]}{n}", f"{s}_plays_roll{n}_mean") for s, n in _PLAYS) + " FROM games WINDOW " + ", ".join(f"{s[0]}{n} AS (PARTITION BY sport, {s}_team ORDER BY game_date, game_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for s, n in _PLAYS))
def b8_cache(spark, sf):
    """The cache as of a day, then brought up to all games, one of which was corrected meanwhile."""
    games, folder = store.stored(adapt.games(spark, sf)), store.shared_path(spark)
    first = F.col("game_id") == games.agg(F.min("game_id")).first()[0]
    before = games.where("game_date < TIMESTAMP_NTZ'1998-07-01 00:00:00'").withColumn("home_plays", F.when(first, F.col("home_plays") + 1).otherwise(F.col("home_plays")))
    for state in (store.stored(before), games):
        feature_cache.refresh(state, folder, ["plays"], alphas=())
    return rounded(feature_cache.read(spark, folder).select("game_id", *(f"{s}_plays_roll{n}_mean" for s, n in _PLAYS)))


@query("b9_append_stats", f"{G}SELECT game_id, home_score AS points FROM games UNION ALL SELECT game_id, away_score FROM games")
def b9(spark, sf):
    path, g = store.shared_path(spark), adapt.games(spark, sf)
    for s in ("home", "away"):
        g.select("game_id", F.col(f"{s}_score").alias("points")).write.mode("append").parquet(path)
    return spark.read.schema("game_id long, points long").parquet(path)


@query("b10_injuries_from_boxes", """WITH r AS (SELECT c_nationkey AS team, c_custkey AS seq, c_name AS name, c_custkey % 2 = 0 AS key FROM customer WHERE c_custkey % 4 <> 0), f AS (SELECT team, min(seq) AS seq FROM r GROUP BY team)
SELECT left(lower(concat('nfl_', team, '_', replace(name, ' ', '_'))), 50) AS player_id, 'nfl' AS sport, CAST(team AS BIGINT) AS team, name AS player_name, CASE WHEN key THEN 'out' ELSE 'questionable' END AS status, CASE WHEN key THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END AS impact FROM r JOIN f USING (team, seq)""")
def b10(spark, sf):
    k = F.col("c_custkey")
    player = F.array(F.struct(F.col("c_name").alias("name"), (k % 2 == 0).alias("key")))
    rows = adapt.table(spark, sf, "customer").select(F.lit("nfl").alias("sport"), F.col("c_nationkey").cast("long").alias("team"), k.alias("seq"), F.when(k % 4 == 0, F.slice(player, 1, 0)).otherwise(player).alias("players"))
    return injuries.from_box_scores(rows)


# ------------------------------------------------------------------ projections, predicates, scalars
_BOX = {"fga": "home_score + 10", "oreb": "home_plays", "tov": "away_plays", "fta": "home_score % 20", "pts": "home_score", "ast": "home_plays * 2", "dreb": "away_plays * 3", "tpa": "home_score % 30", "fgm": "home_score % 40"}
_POSS = "greatest(1.0::DOUBLE, fga - oreb + tov + 0.44::DOUBLE * fta)"


@query("p1_box_ratios", f"{G}, b AS (SELECT game_id, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in _BOX.items())} FROM games) SELECT game_id, " + ", ".join([
    s6(_POSS, "possessions"), s6(f"pts / {_POSS}", "points_per_possession"), s6("pts / greatest(1, 2 * (fga + 0.44::DOUBLE * fta))", "true_shooting"), s6(f"100 * pts / {_POSS}", "offensive_rating"), s6("ast / greatest(1, fgm)", "assist_rate"),
    s6("dreb / greatest(1, dreb + oreb)", "dreb_rate"), s6("fta / greatest(1, fga)", "ft_rate"), s6("tpa / greatest(1, fga)", "three_rate")]) + " FROM b")
def p1(spark, sf):
    g = adapt.games(spark, sf).select("game_id", *(F.expr(e).alias(f"h_{n}") for n, e in _BOX.items()))
    return g.select("game_id", *(r6(c, n) for n, c in S.box_ratios("h").items()))


@query("p2_mlb_ratios", f"{G}SELECT game_id, {s6('home_score / CAST(greatest(1, home_plays) AS DOUBLE)', 'k_bb')}, {s6('away_plays / CAST(greatest(1, away_score) AS DOUBLE)', 'ground_ball')} FROM games WHERE sport = 'mlb'")
def p2(spark, sf):
    per = lambda a, b: F.col(a).cast("double") / F.greatest(F.lit(1.0), F.col(b).cast("double"))
    return adapt.games(spark, sf).where("sport = 'mlb'").select("game_id", r6(per("home_score", "home_plays"), "k_bb"), r6(per("away_plays", "away_score"), "ground_ball"))


@query("p3_nfl_rates", f"{G}SELECT game_id, {s6('30.25::DOUBLE * 60 / greatest(1, home_plays)', 'seconds_per_play')}, {s6('(away_score % 7) / CAST(greatest(1, away_plays) AS DOUBLE)', 'pressure')} FROM games WHERE sport = 'nfl'")
def p3(spark, sf):
    one = F.lit(1.0)
    return adapt.games(spark, sf).where("sport = 'nfl'").select("game_id", r6(S.clock_minutes(F.lit("30:15")) * 60 / F.greatest(one, F.col("home_plays")), "seconds_per_play"), r6((F.col("away_score") % 7) / F.greatest(one, F.col("away_plays")), "pressure"))


@query("p4_season_bucket", f"{G}SELECT game_id, CAST(CASE WHEN month(game_date) >= 10 THEN year(game_date) ELSE year(game_date) - 1 END AS INT) AS nba_season, CAST(CASE WHEN month(game_date) >= 9 THEN year(game_date) ELSE year(game_date) - 1 END AS INT) AS nfl_season, CAST(least(18, datediff('day', make_date(year(game_date), 1, 1), CAST(game_date AS DATE)) // 7 + 1) AS INT) AS week FROM games")
def p4(spark, sf):
    d = F.col("game_date")
    return adapt.games(spark, sf).select("game_id", S.season_of(d, 10).alias("nba_season"), S.season_of(d, 9).alias("nfl_season"), S.nfl_week(d, F.make_date(F.year(d), F.lit(1), F.lit(1))).alias("week"))


@query("p5_label", f"{G}SELECT game_id, CASE WHEN total > total_line THEN 1 ELSE 0 END AS result_over, total = total_line AS is_push FROM games")
def p5(spark, sf):
    return adapt.games(spark, sf).select("game_id", (F.col("total") > F.col("total_line")).cast("int").alias("result_over"), (F.col("total") == F.col("total_line")).alias("is_push"))


@query("p6_validation", f"""{G}SELECT game_id, concat('T', home_team) AS home_team, concat('T', away_team) AS away_team, concat_ws(',', CASE WHEN sport = 'mlb' AND game_id % 2 = 0 THEN 'sport' END, CASE WHEN total_line - 60 <= 0 THEN 'total_line' END, CASE WHEN home_plays * 5 > 14 THEN 'home_rest_days' END) AS problems FROM games""")
def p6(spark, sf):
    g = adapt.games(spark, sf).select(
        "game_id", F.when((F.col("sport") == "mlb") & (F.col("game_id") % 2 == 0), "xxx").otherwise(F.col("sport")).alias("sport"), F.concat(F.lit(" t"), _s("home_team"), F.lit(" ")).alias("home_team"), F.concat(F.lit("t"), _s("away_team")).alias("away_team"),
        (F.col("total_line") - 60).alias("total_line"), (F.col("home_plays") * 5).alias("home_rest_days"), F.lit(1).alias("away_rest_days"))
    return tables.violations(g).select("game_id", "home_team", "away_team", F.array_join("problems", ",").alias("problems"))


_SIT = {"altitude_feet": "home_team * 200", "is_dome": "home_team % 2", "wind_speed_mph": "game_id % 40", "temperature_f": "game_id % 110", "sharp_over_pct": "game_id % 90", "public_over_pct": "game_id % 80", "line_movement": "game_id % 7 - 3", "home_key_players_out": "game_id % 4", "away_key_players_out": "game_id % 3"}


@query("p7_situational", f"{G}, b AS (SELECT game_id, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in _SIT.items())} FROM games) SELECT game_id, {s6('altitude_feet / 5280', 'altitude_boost')}, is_dome AS dome_flag, CASE WHEN wind_speed_mph > 15 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS wind_under_signal, {s6('wind_speed_mph / 30', 'wind_severity')}, CASE WHEN temperature_f < 40 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cold_game, CASE WHEN temperature_f > 85 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hot_game, sharp_over_pct - public_over_pct AS sharp_vs_public, abs(line_movement) AS line_move_magnitude, CAST(sign(line_movement) AS DOUBLE) AS line_move_direction, (home_key_players_out - away_key_players_out) * -3 + 0.0 AS injury_pts_impact FROM b")
def p7(spark, sf):
    g = adapt.games(spark, sf).select("game_id", *(F.expr(e).cast("double").alias(n) for n, e in _SIT.items()))
    return rounded(composites.situational(g).drop(*_SIT))


@query("p8_division_flag", f"{G}, d AS (SELECT CAST(n_nationkey AS BIGINT) AS t, n_regionkey AS r FROM nation WHERE n_nationkey <> 3) SELECT game_id, CASE WHEN a.r = b.r THEN 1 ELSE 0 END AS is_division_game FROM games LEFT JOIN d a ON a.t = home_team LEFT JOIN d b ON b.t = away_team")
def p8(spark, sf):
    d = adapt.table(spark, sf, "nation").where("n_nationkey <> 3").select(F.col("n_nationkey").cast("long").alias("team"), F.col("n_regionkey").alias("division"))
    return matchup.division_flag(adapt.games(spark, sf), d).select("game_id", "is_division_game")


@query("p9_board_filter", f"WITH {adapt.QUOTES_SQL} SELECT game_id, book, seq, point FROM quotes WHERE seq <> 1 AND book IN (1, 2)")
def p9(spark, sf):
    q = adapt.quotes(spark, sf).withColumn("is_promo", F.col("seq") == 1).withColumn("status", F.when(F.col("book") == 1, "pre_game").when(F.col("book") == 2, "normal").otherwise("live"))
    return board_filter(q, "pre_game").select("game_id", "book", "seq", "point")


def board_filter(rows, status=None, promos=False):
    """Drops promotions unless asked for; pre_game also takes normal."""
    kept = rows if promos else rows.where(~F.col("is_promo"))
    return kept if status is None else kept.where(F.col("status").isin("pre_game", "normal") if status == "pre_game" else F.col("status") == status)


@query("p10_matchup_filter", f"{G}SELECT game_id FROM games WHERE contains(concat('TEAM', home_team), 'M2') OR contains(concat('TEAM', away_team), 'M2')")
def p10(spark, sf):
    name = lambda c: F.upper(F.concat(F.lit("team"), _s(c)))
    want = F.upper(F.lit("m2"))
    return adapt.games(spark, sf).where(name("home_team").contains(want) | name("away_team").contains(want)).select("game_id")


@query("p11_feature_columns", f"{G}SELECT game_id, home_plays, away_plays, total_line FROM games")
def p11(spark, sf):
    g = adapt.games(spark, sf)
    return g.select("game_id", *tables.feature_columns(g, DROPPED))


@query("p12_drop_raw", f"{G}SELECT game_id, sport, total_line FROM games")
def p12(spark, sf):
    g = adapt.games(spark, sf)
    return g.drop(*(c for c in g.columns if c.startswith(("home_", "away_"))), "season", "game_date", "total", "result_over")


@query("p13_zero_fill", f"{G}SELECT game_id, coalesce(CASE WHEN game_id % 4 <> 0 THEN total END, 0) AS total FROM games")
def p13(spark, sf):
    return adapt.games(spark, sf).select("game_id", F.when(F.col("game_id") % 4 != 0, F.col("total")).alias("total")).fillna(0, ["total"])


@query("p14_median_fill", f"{G}, m AS (SELECT sport, round(quantile_cont(CAST(home_score AS DOUBLE), 0.5), 6) AS m FROM games GROUP BY sport) SELECT game_id, coalesce(CASE WHEN game_id % 4 <> 0 THEN CAST(home_score AS DOUBLE) END, m) AS home_score, 0.0::DOUBLE AS absent FROM games JOIN m USING (sport)")
def p14(spark, sf):
    from ..operators import monitor, training

    g = adapt.games(spark, sf).select("game_id", "sport", F.col("home_score").cast("double").alias("home_score"))
    medians = monitor.medians(g, ["home_score"], ["sport"]).withColumn("absent", F.lit(None).cast("double"))
    holes = g.withColumn("home_score", F.when(F.col("game_id") % 4 != 0, F.col("home_score")))
    return training.impute(holes, medians, ["home_score", "absent"]).select("game_id", "home_score", "absent")


@query("p15_unresolved", f"{G}SELECT game_id FROM games WHERE game_id % 6 = 0 AND total_line IS NOT NULL")
def p15(spark, sf):
    g = adapt.games(spark, sf).withColumn("status", F.lit("final")).withColumn("result_over", F.when(F.col("game_id") % 6 != 0, F.col("result_over")))
    return g.where("status = 'final' AND total_line IS NOT NULL AND result_over IS NULL").select("game_id")


@query("p16_skew_check", "SELECT DISTINCT p_brand AS name FROM part EXCEPT SELECT p_brand FROM part WHERE p_size > 2")
def p16(spark, sf):
    p = adapt.table(spark, sf, "part").select(F.col("p_brand").alias("name"), "p_size")
    return tables.missing_features(p.select("name").distinct(), p.where("p_size > 2").distinct()).distinct()


@query("p17_active_injuries", f"WITH {_REPORTS} SELECT player_id, team, status FROM reports WHERE status IN ('out', 'doubtful', 'questionable')")
def p17(spark, sf):
    return injuries.active_injuries(_reports(spark, sf)).select("player_id", "team", "status")


_TEXT = "CASE game_id % 4 WHEN 0 THEN concat(' ', home_score, ' ') WHEN 1 THEN concat(home_score, '.5') WHEN 2 THEN 'n/a' END"


@query("f1_safe_int", f"{G}, t AS (SELECT game_id, {_TEXT} AS s FROM games) SELECT game_id, CASE WHEN regexp_full_match(trim(s), '[+-]?[0-9]+') THEN CAST(trim(s) AS BIGINT) ELSE -1 END AS v FROM t")
def f1(spark, sf):
    return adapt.games(spark, sf).select("game_id", S.safe_int(F.expr(_TEXT), -1).alias("v"))


@query("f2_safe_float", f"{G}, t AS (SELECT game_id, {_TEXT} AS s FROM games) SELECT game_id, coalesce(try_cast(trim(s) AS DOUBLE), -1) AS v FROM t")
def f2(spark, sf):
    return adapt.games(spark, sf).select("game_id", S.safe_float(F.expr(_TEXT), -1.0).alias("v"))


@query("f3_stat_clean", f"{G}SELECT game_id, CASE game_id % 3 WHEN 0 THEN home_score + 0.5::DOUBLE WHEN 1 THEN CAST(concat(home_score, '.15') AS DOUBLE) ELSE 0 END AS v FROM games")
def f3(spark, sf):
    t = F.expr("CASE game_id % 3 WHEN 0 THEN concat(home_score, '.5%') WHEN 1 THEN concat(home_score, ':15') ELSE 'dnp' END")
    return adapt.games(spark, sf).select("game_id", S.stat_clean(t).alias("v"))


@query("f4_fraction", f"{G}SELECT game_id, {s6('coalesce(home_score / CAST(nullif(away_score, 0) AS DOUBLE), 0.5)', 'v')} FROM games")
def f4(spark, sf):
    return adapt.games(spark, sf).select("game_id", r6(S.fraction(F.expr("concat(home_score, '-', away_score)"), 0.5), "v"))


@query("f5_split_pair", f"{G}SELECT game_id, CAST(home_score AS DOUBLE) AS a, CASE WHEN game_id % 2 = 0 THEN CAST(total AS DOUBLE) ELSE -1 END AS b FROM games")
def f5(spark, sf):
    t = F.expr("CASE WHEN game_id % 2 = 0 THEN concat(home_score, '-', total) ELSE concat(home_score, '-x') END")
    return adapt.games(spark, sf).select("game_id", S.first_of(t).alias("a"), S.second_of(t, -1.0).alias("b"))


@query("f6_clock", f"{G}SELECT game_id, {s6('CASE WHEN game_id % 5 = 0 THEN 30 ELSE home_plays + away_plays / 60.0::DOUBLE END', 'v')} FROM games")
def f6(spark, sf):
    return adapt.games(spark, sf).select("game_id", r6(S.clock_minutes(F.expr("CASE WHEN game_id % 5 = 0 THEN 'late' ELSE concat(home_plays, ':', away_plays) END")), "v"))


@query("f7_stat_lookup", f"{G}SELECT game_id, CAST(home_score AS VARCHAR) AS by_label, CAST(away_score AS VARCHAR) AS by_name, CAST(NULL AS VARCHAR) AS missing FROM games")
def f7(spark, sf):
    row = lambda label, name, c: F.struct(F.lit(label).alias("label"), F.lit(name).alias("name"), _s(c).alias("displayValue"))
    stats = F.array(row("Home", "h", "home_score"), row("Away", "a", "away_score"))
    return adapt.games(spark, sf).select("game_id", feeds.stat_of(stats, "Home").alias("by_label"), feeds.stat_of(stats, "a").alias("by_name"), feeds.stat_of(stats, "z").alias("missing"))


@query("f8_wind", f"{G}SELECT game_id, CASE game_id % 3 WHEN 2 THEN 0.0::DOUBLE ELSE CAST(home_plays AS DOUBLE) END AS v FROM games")
def f8(spark, sf):
    return adapt.games(spark, sf).select("game_id", S.wind_mph(F.expr("CASE game_id % 3 WHEN 0 THEN concat('NW ', home_plays, ' MPH') WHEN 1 THEN concat(home_plays, ' out to left') ELSE 'calm' END")).alias("v"))


@query("f9_iso_time", f"{G}SELECT game_id, CASE WHEN game_id % 4 <> 3 THEN CAST(epoch(game_date) AS BIGINT) + 45000 END AS v FROM games")
def f9(spark, sf):
    t = F.expr("CASE game_id % 4 WHEN 0 THEN concat(date_format(game_date, 'yyyy-MM-dd'), 'T12:30:00Z') WHEN 1 THEN concat(date_format(game_date, 'yyyy-MM-dd'), 'T12:30:00') WHEN 2 THEN concat(date_format(game_date, 'yyyy-MM-dd'), 'T14:30:00+02:00') ELSE 'soon' END")
    return adapt.games(spark, sf).select("game_id", F.unix_seconds(S.iso_time(t)).alias("v"))


_COMMENT = "CASE event_id % 5 WHEN 0 THEN 'DNP - Coach''s Decision' WHEN 1 THEN 'DND - Injury/Illness' WHEN 2 THEN 'NWT - Left Ankle' WHEN 3 THEN 'Rest' ELSE '' END"
_KIND = "CASE event_id % 5 WHEN 1 THEN 'key' WHEN 2 THEN 'injury' WHEN 3 THEN 'key' ELSE 'none' END"


@query("f10_injury_kind", f"SELECT event_id, {_KIND} AS kind FROM events")
def f10(spark, sf):
    return adapt.table(spark, sf, "events").select("event_id", S.injury_kind(_comment()).alias("kind"))


def _comment():
    return F.element_at(F.array(*map(F.lit, ("DNP - Coach's Decision", "DND - Injury/Illness", "NWT - Left Ankle", "Rest", ""))), (F.col("event_id") % 5 + 1).cast("int"))


@query("f11_status_impact", f"WITH {_REPORTS} SELECT player_id, CASE status WHEN 'out' THEN 1.0::DOUBLE WHEN 'doubtful' THEN 0.75::DOUBLE WHEN 'questionable' THEN 0.4::DOUBLE WHEN 'probable' THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS impact, CASE player_id % 6 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.6::DOUBLE WHEN 2 THEN 0.5::DOUBLE WHEN 3 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS position_impact FROM reports")
def f11(spark, sf):
    place = lambda k: F.element_at(F.array(*map(F.lit, k)), (F.col("player_id") % 6 + 1).cast("int"))
    sport, position = place(("nfl", "NBA", "mlb", "nfl", "nba", "nhl")), place(("QB", "c", "C", "S", "QB", "C"))
    return _reports(spark, sf).select("player_id", S.status_impact(F.initcap("status")).alias("impact"), S.position_impact(sport, position).alias("position_impact"))


@query("f12_haversine", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(2 * 6371 * asin(sqrt(pow(sin((radians((b.n_nationkey * 7 % 90)) - radians((a.n_nationkey * 7 % 90))) / 2), 2) + cos(radians((a.n_nationkey * 7 % 90))) * cos(radians((b.n_nationkey * 7 % 90))) * pow(sin((radians((b.n_nationkey * 13 % 180)) - radians((a.n_nationkey * 13 % 180))) / 2), 2))), 3) + 0.0 AS km FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 1) % 25")
def f12(spark, sf):
    n = adapt.table(spark, sf, "nation").select("n_nationkey")
    a, b = n.select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") + 1) % 25).alias("b")), n.select(F.col("n_nationkey").alias("b"))
    lat, lon = (lambda c: (F.col(c) * 7 % 90).cast("double")), (lambda c: (F.col(c) * 13 % 180).cast("double"))
    return a.join(b, "b").select("a", "b", (F.round(S.haversine_km(lat("a"), lon("a"), lat("b"), lon("b")), 3) + F.lit(0.0)).alias("km"))


@query("f13_player_id", "SELECT c_custkey, left(lower(concat('nba_', c_mktsegment, '_', replace(c_name, '#', ' '))).replace(' ', '_'), 50) AS player_id FROM customer")
def f13(spark, sf):
    return adapt.table(spark, sf, "customer").select("c_custkey", S.player_id(F.lit("nba"), F.col("c_mktsegment"), F.replace("c_name", F.lit("#"), F.lit(" "))).alias("player_id"))


@query("f14_half_points", f"{G}SELECT game_id, greatest(28.0::DOUBLE, least(80.0::DOUBLE, round_even(total_line / 4::DOUBLE * 2, 0) / 2)) AS v FROM games")
def f14(spark, sf):
    return adapt.games(spark, sf).select("game_id", S.half_points(F.col("total_line") / 4.0, 28.0, 80.0).alias("v"))


@query("f15_confidence", f"WITH {adapt.PREDICTIONS_SQL} SELECT prediction_id, {s6('2 * abs(prob_over - 0.5::DOUBLE)', 'confidence')}, {s6('abs(prob_over - 0.5::DOUBLE)', 'edge')}, CASE WHEN prob_over >= 0.5::DOUBLE THEN 'over' ELSE 'under' END AS direction FROM predictions")
def f15(spark, sf):
    p = F.col("prob_over")
    return adapt.predictions(spark, sf).select("prediction_id", r6(S.confidence(p), "confidence"), r6(S.edge(p), "edge"), S.direction(p).alias("direction"))
