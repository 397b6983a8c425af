"""Betting lines: proxy lines, team form, consensus, boards and as-of quotes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import SIDES, appearances, beside, cut, same, team_window
from ..functions.scalars import half_points

# Fixed values by sport: clip bounds and the averages of a team without history.
PROXY = {"nba": (180.0, 280.0, 113.0, 111.0), "nfl": (28.0, 80.0, 23.0, 21.0), "mlb": (4.0, 25.0, 4.5, 4.5)}


def proxy_line(games: DataFrame, low: float, high: float, scored: float, allowed: float, window: int = 20, home_advantage: float = 0.0, noise: float = 0.0) -> DataFrame:
    """games with proxy_line, proxy_over and proxy_push from both teams' last games on either side.

    noise > 0 adds a normal deviate drawn from a hash of the game id, so reruns agree.
    """
    f = team_window().rowsBetween(-window, -1)
    rows = appearances(games).withColumn("off", F.coalesce(F.avg("scored").over(f), F.lit(scored))).withColumn("def", F.coalesce(F.avg("allowed").over(f), F.lit(allowed)))
    both = beside(games, rows, ["off", "def"])
    expected = (F.col("home_off") + F.col("away_def")) / 2.0 + (F.col("away_off") + F.col("home_def")) / 2.0 + home_advantage
    if noise:
        u = lambda k: (F.pmod(F.xxhash64("game_id", F.lit(k)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
        expected = expected + noise * F.sqrt(-2 * F.log(u(1))) * F.cos(2 * F.pi() * u(2))
    out = both.withColumn("proxy_line", half_points(expected, low, high))
    return out.select(*games.columns, "proxy_line", (F.col("total") > F.col("proxy_line")).cast("int").alias("proxy_over"), (F.col("total") == F.col("proxy_line")).alias("proxy_push"))


def recent_form(games: DataFrame, n: int = 20) -> DataFrame:
    """(sport, team, games, mean_scored, mean_allowed) over each team's last n appearances."""
    rows = last_per_key(appearances(games), ["sport", "team"], n, ["game_date", "game_id"])
    return rows.groupBy("sport", "team").agg(F.count("*").alias("games"), F.avg("scored").alias("mean_scored"), F.avg("allowed").alias("mean_allowed"))


def last_per_key(df: DataFrame, keys: list[str], n: int, order: list[str]) -> DataFrame:
    """The n last rows of each key, newest first by the columns of order, nulls last.

    Rows are counted by the first of these columns, which gives each key the value from which on it has n rows; only
    those from there on are sorted. Keys are few: a row of each goes to all tasks.
    """
    first, k = order[0], [F.col(c).alias(f"_{c}") for c in keys]
    counts = df.groupBy(*keys, first).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(F.desc(first)))
    edges = counts.withColumn("_upto", upto).groupBy(*k).agg(F.max(F.when(F.col("_upto") >= n, F.col(first))).alias("_edge"))
    late = df.join(F.broadcast(edges), same(df, edges, keys)).where(F.col("_edge").isNull() | (F.col(first) >= F.col("_edge"))).select(*df.columns)
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return late.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def form_for(new_games: DataFrame, form: DataFrame, scored: float, allowed: float) -> DataFrame:
    """new_games with both teams' form, constants where a team has none."""
    out = new_games
    for s in SIDES:
        f = form.select("sport", F.col("team").alias(f"{s}_team"), F.col("mean_scored").alias(f"{s}_scored"), F.col("mean_allowed").alias(f"{s}_allowed"))
        out = out.join(f, ["sport", f"{s}_team"], "left")
    return out.fillna(scored, ["home_scored", "away_scored"]).fillna(allowed, ["home_allowed", "away_allowed"])


def consensus(quotes: DataFrame) -> DataFrame:
    """(game_id, total, spread, moneyline, books, sources): medians over each book's last quote."""
    last = quotes.groupBy("game_id", "book").agg(*(F.max_by(c, F.struct("seq", "point", "spread", "price")).alias(c) for c in ("point", "spread", "price")))
    return last.groupBy("game_id").agg(
        F.median("point").alias("total"), F.median("spread").alias("spread"), F.median("price").cast("int").alias("moneyline"),
        F.count("*").alias("books"), F.array_join(F.array_sort(F.collect_list(F.col("book").cast("string"))), ",").alias("sources"))


def board_summary(lines: DataFrame, props: DataFrame) -> DataFrame:
    """Per game: last total line and spread, counts of lines and props; games of either side appear.

    lines: (game_id, start_time, stat_type, line, seq); props: (game_id, start_time).
    """
    pick = lambda kind: F.max_by(F.when(F.col("stat_type") == kind, F.col("line")), F.when(F.col("stat_type") == kind, F.struct("seq", "line")))
    a = lines.groupBy("game_id").agg(pick("total").alias("total_line"), pick("spread").alias("spread"), F.count("*").alias("lines"), F.min("start_time").alias("line_start"))
    b = props.groupBy("game_id").agg(F.count("*").alias("props"), F.min("start_time").alias("prop_start"))
    out = a.join(b, "game_id", "full_outer")
    return out.select("game_id", F.coalesce("line_start", "prop_start").alias("start_time"), "total_line", "spread", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("props", F.lit(0)).alias("props"))


def projected_totals(props: DataFrame, stat: str, least: int = 6) -> DataFrame:
    """(game_id, projected_total): players' median lines of the sport's stat, standard odds only, summed with `least` players."""
    players = props.where((F.col("odds_type") == "standard") & (F.col("stat_type") == stat)).groupBy("game_id", "player").agg(F.median("line").alias("line"))
    return players.groupBy("game_id").agg(F.sum("line").alias("s"), F.count("*").alias("players")).select("game_id", "players", F.when(F.col("players") >= least, F.round("s", 1)).alias("projected_total"))


GRAM = 3


def _grams(name: Column) -> Column:
    """All runs of one to GRAM characters of a name, and the empty one."""

    def runs(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - n + 1, F.lit(1))), lambda i: F.substring(name, i, F.lit(n)))

    return F.array_distinct(F.concat(F.array(F.lit("")), *(runs(n) for n in range(1, GRAM + 1))))


def contained(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(part, whole): each distinct lower-case name of parts with each of wholes that it stands in.

    A q-gram index of the wholes: a part has all its grams in a whole that holds it, so it is looked up by
    the rarest of its longest grams alone, and only what shares that one is compared.
    """
    index = wholes.select("whole", F.explode(_grams(F.col("whole"))).alias("gram"))
    found = index.groupBy("gram").agg(F.count("*").alias("n"))
    size = F.least(F.length("part"), F.lit(GRAM))
    own = parts.select("part", F.explode(F.filter(_grams(F.col("part")), lambda g: F.length(g) == size)).alias("gram"))
    # a gram that no whole has rules its part out; it counts 0
    rarest = own.join(found, "gram", "left").groupBy("part").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return rarest.join(index, "gram").where(F.col("whole").contains(F.col("part"))).select("part", "whole")


def fuzzy_match(requests: DataFrame, board: DataFrame) -> DataFrame:
    """requests with the first board row whose teams both contain, or are contained in, theirs.

    Distinct names are compared, by shared grams (contained), so requests meet the board by equal names
    and no name meets all others. board: (seq, board_home, board_away, line).
    """
    distinct = lambda df, *cols: reduce(lambda a, b: a.union(b), [df.select(F.col(c).alias("name")) for c in cols]).where("name is not null").distinct()
    names, listed = distinct(requests, "home_team", "away_team"), distinct(board, "board_home", "board_away").withColumnRenamed("name", "listed")
    a, b = names.select(F.lower("name").alias("a")).distinct(), listed.select(F.lower("listed").alias("b")).distinct()
    inner = contained(b.select(F.col("b").alias("part")), a.select(F.col("a").alias("whole"))).select(F.col("whole").alias("a"), F.col("part").alias("b"))
    outer = contained(a.select(F.col("a").alias("part")), b.select(F.col("b").alias("whole"))).select(F.col("part").alias("a"), F.col("whole").alias("b"))
    low = inner.unionByName(outer).distinct()
    alike = low.join(names.withColumn("a", F.lower("name")), "a").join(listed.withColumn("b", F.lower("listed")), "b")
    home = alike.select(F.col("name").alias("home_team"), F.col("listed").alias("board_home"))
    away = alike.select(F.col("name").alias("away_team"), F.col("listed").alias("board_away"))
    # the first row of each pair of listed names is all that can win
    first = board.groupBy("board_home", "board_away").agg(F.min_by("line", "seq").alias("line"), F.min("seq").alias("seq"))
    pairs = requests.select("home_team", "away_team").distinct().join(home, "home_team").join(away, "away_team").join(first, ["board_home", "board_away"])
    best = pairs.groupBy("home_team", "away_team").agg(F.min_by("line", "seq").alias("line"), F.min("seq").alias("board_seq"))
    return requests.join(best, ["home_team", "away_team"], "left")


def latest_quote(asked: DataFrame, quotes: DataFrame, keys: list[str], seconds: int = 900) -> DataFrame:
    """asked (keys, at, request_id) with the last quote at or before `at`, at most `seconds` old by whole seconds.

    Quotes are (keys, at, line); equal times go to the quote. As-of by blocks: quotes and requests are
    cut along (keys, time), each block's last quote is carried to the blocks of its key behind it (a row
    per block), and only inside a block are rows ordered. So a hot key is many tasks.
    """
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', at)")  # a quote later in the same second is not known yet
    q = quotes.select(*keys, t.alias("t"), F.lit(0).alias("kind"), F.col("line").alias("q_line"), F.lit(None).cast("long").alias("request_id"))
    r = asked.select(*keys, t.alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("q_line"), F.col("request_id").cast("long"))
    order = [F.col("t").asc_nulls_first(), F.col("kind").asc(), F.col("q_line").asc_nulls_last(), F.col("request_id").asc_nulls_first()]
    rows = cut(q.unionByName(r), [*(F.col(k).asc_nulls_first() for k in keys), *order])
    own = [*keys, "_block"]
    quote = F.when(F.col("kind") == 0, F.struct("t", "q_line"))
    inside = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("last", F.last(quote, ignorenulls=True).over(inside)).where("kind = 1")
    # the last in order: the latest time, of equal times a null line, else the largest
    ends = rows.groupBy(*own).agg(F.max_by(F.struct("t", "q_line"), F.when(F.col("kind") == 0, F.struct("t", F.col("q_line").isNull().alias("e"), "q_line"))).alias("end"))
    along = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*(F.col(c).alias(f"_{c}") for c in own), F.last("end", ignorenulls=True).over(along).alias("carried"))
    out = local.join(ends, same(local, ends, own)).withColumn("last", F.coalesce("last", "carried"))
    second = lambda c: F.floor((c - F.pmod(c, F.lit(1_000_000))) / 1_000_000)
    fresh = second(F.col("t")) - second(F.col("last.t")) <= seconds
    return out.select(*keys, "request_id", F.when(fresh, F.col("last.q_line")).alias("line"))
