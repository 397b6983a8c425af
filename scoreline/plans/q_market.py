"""Queries of joins, injuries, lines and boards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.keys import appearances
from ..operators import injuries, lines, matchup, settle
from ..sources import adapt, store, tables
from . import q_sources
from .base import G, P, query, rounded, s6

_REPORTS, _reports = q_sources._REPORTS, q_sources._reports


@query("j1_home_away_join", f"{G}SELECT game_id, home_team, home_score, away_team, away_score FROM games")
def j1(spark, sf):
    g = adapt.games(spark, sf)
    half = lambda s: g.select("game_id", f"{s}_team", f"{s}_score")
    return half("home").join(half("away"), "game_id")


@query("j2_anti_join", f"{G}SELECT game_id FROM games WHERE game_id % 3 = 0")
def j2(spark, sf):
    g = adapt.games(spark, sf)
    return tables.new_rows(g.where("game_id % 3 <> 0"), g).select("game_id")


@query("j3_dimension_default", f"{G}SELECT game_id, coalesce(n_name, 'unknown') AS venue FROM games LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 5) n ON n_nationkey = home_team")
def j3(spark, sf):
    n = adapt.table(spark, sf, "nation").where("n_nationkey <> 5").select(F.col("n_nationkey").cast("long").alias("home_team"), "n_name")
    return adapt.games(spark, sf).join(F.broadcast(n), "home_team", "left").select("game_id", F.coalesce("n_name", F.lit("unknown")).alias("venue"))


_BOARD = """board AS (SELECT CAST(home_team % 9 AS VARCHAR) AS board_home, CAST(away_team % 9 AS VARCHAR) AS board_away, min(game_id) AS seq, min_by(total_line, game_id) AS line FROM games GROUP BY 1, 2)"""


@query("j4_fuzzy_match", f"""{G}, {_BOARD}, q AS (SELECT DISTINCT CAST(home_team AS VARCHAR) AS h, CAST(away_team AS VARCHAR) AS a FROM games),
m AS (SELECT h, a, min(seq) AS board_seq, min_by(line, seq) AS line FROM q JOIN board ON (contains(h, board_home) OR contains(board_home, h)) AND (contains(a, board_away) OR contains(board_away, a)) GROUP BY h, a)
SELECT game_id, board_seq, line FROM games LEFT JOIN m ON h = CAST(home_team AS VARCHAR) AND a = CAST(away_team AS VARCHAR)""")
def j4(spark, sf):
    g = store.stored(adapt.games(spark, sf))
    code = lambda c: (F.col(c) % 9).cast("string")
    board = g.select(F.col("game_id").alias("seq"), code("home_team").alias("board_home"), code("away_team").alias("board_away"), F.col("total_line").alias("line"))
    asked = g.select("game_id", F.col("home_team").cast("string").alias("home_team"), F.col("away_team").cast("string").alias("away_team"))
    return lines.fuzzy_match(asked, board).select("game_id", "board_seq", "line")


@query("j5_pair_history", f"{G}SELECT a.game_id, count(b.game_id) AS meetings FROM games a LEFT JOIN games b ON a.sport = b.sport AND least(a.home_team, a.away_team) = least(b.home_team, b.away_team) AND greatest(a.home_team, a.away_team) = greatest(b.home_team, b.away_team) AND b.game_date < a.game_date GROUP BY a.game_id")
def j5(spark, sf):
    from ..functions.keys import epoch, pair_window

    w = pair_window().orderBy(epoch()).rangeBetween(Window.unboundedPreceding, -1)
    return adapt.games(spark, sf).select("game_id", F.count("*").over(w).alias("meetings"))


def _results(spark, sf):
    return adapt.predictions(spark, sf).select("game_id", F.col("total").cast("double").alias("actual"), F.col("closing_line").alias("close"))


_SETTLED = """s AS (SELECT prediction_id, sport, game_date, model_version, prob_over, CAST(total AS DOUBLE) AS actual, closing_line AS "close", total > closing_line AS over, (total > closing_line) = (prob_over >= 0.5::DOUBLE) AS is_correct,
round(CASE WHEN prob_over >= 0.5::DOUBLE THEN closing_line - total_line ELSE total_line - closing_line END, 2) + 0.0 AS clv, total = closing_line AS is_push FROM predictions WHERE is_settled)"""


def settled(spark, sf):
    p = adapt.predictions(spark, sf)
    open_ = p.where("is_settled").select("prediction_id", "game_id", "sport", "game_date", "model_version", "prob_over", F.col("total_line").alias("bet_line"))
    return settle.settle(open_, _results(spark, sf))


@query("j6_settle_join", f"{P}SELECT prediction_id, total > total_line AS over FROM predictions WHERE NOT is_settled")
def j6(spark, sf):
    p = adapt.predictions(spark, sf)
    return settle.auto_settle(p.where("NOT is_settled"), adapt.games(spark, sf)).select("prediction_id", "over")


@query("j7_bet_line", f"{P}SELECT prediction_id, CASE WHEN game_id % 4 = 0 THEN closing_line ELSE total_line END AS bet_line FROM predictions")
def j7(spark, sf):
    g = adapt.games(spark, sf).withColumn("total_line", F.when(F.col("game_id") % 8 == 0, 0.0).when(F.col("game_id") % 8 != 4, F.col("total_line")))
    return settle.bet_line(adapt.predictions(spark, sf).drop("total_line"), g).select("prediction_id", "bet_line")


_COMMENTS = "c AS (SELECT event_id % 15000 AS game_id, user_id % 25 AS team, event_id % 5 AS k FROM events)"


def _comments(spark, sf):
    return adapt.table(spark, sf, "events").select((F.col("event_id") % 15000).alias("game_id"), (F.col("user_id") % 25).alias("team"), q_sources._comment().alias("comment"))


@query("j8_injury_counts", f"{G}, {_COMMENTS}, n AS (SELECT game_id, team, count(*) AS n FROM c WHERE k IN (1, 3) GROUP BY game_id, team) SELECT games.game_id, coalesce(h.n, 0) AS home_key_players_out, coalesce(a.n, 0) AS away_key_players_out FROM games LEFT JOIN n h ON h.game_id = games.game_id AND h.team = home_team LEFT JOIN n a ON a.game_id = games.game_id AND a.team = away_team")
def j8(spark, sf):
    return injuries.counts_on_games(adapt.games(spark, sf), injuries.injury_counts(_comments(spark, sf))).select("game_id", "home_key_players_out", "away_key_players_out")


_FORM = f"""app AS (SELECT sport, game_id, game_date, home_team AS team, home_score AS scored, away_score AS allowed FROM games UNION ALL SELECT sport, game_id, game_date, away_team, away_score, home_score FROM games),
r AS (SELECT *, row_number() OVER (PARTITION BY sport, team ORDER BY game_date DESC, game_id DESC) AS r FROM app), form AS (SELECT sport, team, count(*) AS games, avg(scored) AS ms, avg(allowed) AS ma FROM r WHERE r <= 20 GROUP BY sport, team)"""


@query("j9_form_lookup", f"{G}, {_FORM} SELECT game_id, {s6('coalesce(h.ms, 50)', 'home_scored')}, {s6('coalesce(h.ma, 48)', 'home_allowed')}, {s6('coalesce(a.ms, 50)', 'away_scored')}, {s6('coalesce(a.ma, 48)', 'away_allowed')} FROM games LEFT JOIN form h ON h.sport = games.sport AND h.team = home_team AND h.team <> 4 LEFT JOIN form a ON a.sport = games.sport AND a.team = away_team AND a.team <> 4")
def j9(spark, sf):
    g = adapt.games(spark, sf)
    out = lines.form_for(g, lines.recent_form(g).where("team <> 4"), 50.0, 48.0)
    return rounded(out.select("game_id", "home_scored", "home_allowed", "away_scored", "away_allowed"))


@query("j10_latest_quote", """WITH q AS (SELECT user_id, ts, event_id, value FROM events WHERE event_id % 2 = 0), a AS (SELECT user_id, ts, event_id FROM events WHERE event_id % 2 = 1)
SELECT a.user_id, a.event_id AS request_id, CASE WHEN floor(epoch(a.ts)) - floor(epoch(q.ts)) <= 86400 THEN q.value END AS line FROM a ASOF LEFT JOIN q ON a.user_id = q.user_id AND a.ts >= q.ts""")
def j10(spark, sf):
    e = adapt.table(spark, sf, "events")
    quotes = e.where("event_id % 2 = 0").select("user_id", F.col("ts").alias("at"), F.col("value").alias("line"))
    asked = e.where("event_id % 2 = 1").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("request_id"))
    return lines.latest_quote(asked, quotes, ["user_id"], 86_400)


@query("g1_league_average", f"{G}SELECT sport, {s6('(sum(home_score) + sum(away_score)) / CAST(count(home_score) + count(away_score) AS DOUBLE)', 'avg_score')} FROM games GROUP BY sport")
def g1(spark, sf):
    return rounded(matchup.league_average(adapt.games(spark, sf), ["score"]))


@query("g2_recent_form", f"{G}, {_FORM} SELECT sport, team, games, {s6('ms', 'mean_scored')}, {s6('ma', 'mean_allowed')} FROM form")
def g2(spark, sf):
    return rounded(lines.recent_form(adapt.games(spark, sf)))


@query("g3_injury_count", f"WITH {_COMMENTS} SELECT game_id, team, count(*) AS players_out FROM c WHERE k IN (1, 2, 3) GROUP BY game_id, team")
def g3(spark, sf):
    return injuries.injury_counts(_comments(spark, sf), key_only=False)


@query("g4_status_counts", "SELECT c_nationkey, count(*) FILTER (WHERE c_custkey % 4 = 0) AS listed FROM customer GROUP BY c_nationkey")
def g4(spark, sf):
    k = F.col("c_custkey")
    players = adapt.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct(k, F.when(k % 4 == 0, "10-Day IL").otherwise("Active")))).alias("players"))
    return players.select("c_nationkey", F.size(F.filter(F.map_values("players"), lambda v: v.contains("IL"))).cast("long").alias("listed"))


@query("g5_team_impact", f"WITH {_REPORTS}, i AS (SELECT team, CASE status WHEN 'out' THEN 1.0::DOUBLE WHEN 'doubtful' THEN 0.75::DOUBLE WHEN 'questionable' THEN 0.4::DOUBLE WHEN 'probable' THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS i FROM reports) SELECT team, {s6('least(sum(i), 1)', 'impact')} FROM i GROUP BY team")
def g5(spark, sf):
    return rounded(injuries.team_impact(_reports(spark, sf)).select("team", "impact"))


@query("g6_players_out", f"WITH {_REPORTS} SELECT team, count(*) FILTER (WHERE status IN ('out', 'doubtful')) AS key_out, count(*) FILTER (WHERE status IN ('out', 'doubtful', 'questionable')) AS total_out FROM reports GROUP BY team")
def g6(spark, sf):
    return injuries.team_impact(_reports(spark, sf)).select("team", "key_out", "total_out")


_LAST = "last AS (SELECT game_id, book, max_by(point, (seq, point, spread, price)) AS point, max_by(spread, (seq, point, spread, price)) AS spread, max_by(price, (seq, point, spread, price)) AS price FROM quotes GROUP BY game_id, book)"


@query("g7_consensus", f"WITH {adapt.QUOTES_SQL}, {_LAST} SELECT game_id, median(point) AS total, median(spread) AS spread, CAST(trunc(median(price)) AS INT) AS moneyline, count(*) AS books, string_agg(CAST(book AS VARCHAR), ',' ORDER BY book) AS sources FROM last GROUP BY game_id")
def g7(spark, sf):
    return lines.consensus(adapt.quotes(spark, sf))


def _board_rows(spark, sf):
    q = adapt.quotes(spark, sf)
    rows = q.where("book <> 4").select("game_id", F.col("quoted_at").alias("start_time"), F.when(F.col("book") % 2 == 0, "total").otherwise("spread").alias("stat_type"), F.col("point").alias("line"), (F.col("seq") * 1000 + F.col("point")).alias("seq"))
    props = q.where("book = 4").select("game_id", F.col("quoted_at").alias("start_time"))
    return rows, props


@query("g8_board_summary", f"""WITH {adapt.QUOTES_SQL}, l AS (SELECT game_id, max_by(CASE WHEN book % 2 = 0 THEN point END, CASE WHEN book % 2 = 0 THEN seq * 1000 + point END) AS total_line, max_by(CASE WHEN book % 2 = 1 THEN point END, CASE WHEN book % 2 = 1 THEN seq * 1000 + point END) AS spread, count(*) AS lines, min(quoted_at) AS a FROM quotes WHERE book <> 4 GROUP BY game_id),
p AS (SELECT game_id, count(*) AS props, min(quoted_at) AS b FROM quotes WHERE book = 4 GROUP BY game_id) SELECT game_id, coalesce(a, b) AS start_time, total_line, spread, coalesce(lines, 0) AS lines, coalesce(props, 0) AS props FROM l FULL JOIN p USING (game_id)""")
def g8(spark, sf):
    return lines.board_summary(*_board_rows(spark, sf))


@query("g9_projected_total", f"""WITH {adapt.QUOTES_SQL}, m AS (SELECT game_id % 500 AS game_id, book * 10 + seq AS player, median(point) AS line FROM quotes WHERE spread >= 0 GROUP BY 1, 2)
SELECT game_id, count(*) AS players, CASE WHEN count(*) >= 6 THEN round(sum(line), 1) END AS projected_total FROM m GROUP BY game_id""")
def g9(spark, sf):
    props = adapt.quotes(spark, sf).select((F.col("game_id") % 500).alias("game_id"), (F.col("book") * 10 + F.col("seq")).alias("player"), F.col("point").alias("line"), F.lit("Points").alias("stat_type"), F.when(F.col("spread") >= 0, "standard").otherwise("demon").alias("odds_type"))
    return lines.projected_totals(props, "Points")


@query("s4_last_per_key", f"{G}, {_FORM} SELECT sport, team, game_id FROM r WHERE r <= 20")
def s4(spark, sf):
    return lines.last_per_key(appearances(adapt.games(spark, sf)), ["sport", "team"], 20, ["game_date", "game_id"]).select("sport", "team", "game_id")


@query("s6_union_by_name", f"{G}SELECT game_id, total, CASE WHEN game_id % 2 = 0 THEN season END AS season FROM games")
def s6_(spark, sf):
    g = adapt.games(spark, sf)
    return g.where("game_id % 2 = 0").select("game_id", "total", "season").unionByName(g.where("game_id % 2 = 1").select("total", "game_id"), allowMissingColumns=True)


@query("s7_appearances", f"{G}, {_FORM} SELECT sport, game_id, team, scored, allowed FROM app")
def s7(spark, sf):
    return appearances(adapt.games(spark, sf)).select("sport", "game_id", "team", "scored", "allowed")


@query("s8_board_games", f"WITH {adapt.QUOTES_SQL} SELECT game_id, min(quoted_at) AS start_time FROM quotes GROUP BY game_id")
def s8(spark, sf):
    rows, props = _board_rows(spark, sf)
    return rows.select("game_id", "start_time").unionByName(props).groupBy("game_id").agg(F.min("start_time").alias("start_time"))


