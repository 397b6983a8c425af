"""Nested JSON feeds, in the shapes their sources give, flattened to rows by explicit schemas.

A null or malformed document gives no row; a field that is missing gives the default its function names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clock_minutes, first_of, fraction, injury_kind, iso_time, possessions, safe_float, safe_int, second_of, wind_mph
from .store import stored

ODDS = "struct<id string, home_team string, away_team string, commence_time string, bookmakers array<struct<key string, markets array<struct<key string, outcomes array<struct<name string, point double, price double>>>>>>>"
STATISTICS = "array<struct<label string, name string, displayValue string>>"
_TEAM = "struct<id string, abbreviation string, displayName string>"
NFL = (
    f"struct<event struct<id string, date string, competitions array<struct<status struct<type struct<name string>>, venue struct<fullName string>, weather struct<temperature string, windSpeed string, displayValue string>, "
    f"competitors array<struct<homeAway string, team {_TEAM}, score string, injuries array<struct<status string, type struct<name string>>>>>>>>, "
    f"summary struct<boxscore struct<teams array<struct<team {_TEAM}, statistics {STATISTICS}>>>>>"
)
_MLB_SIDE = "struct<team struct<id bigint>, score string>"
MLB_SCHEDULE = (
    "struct<dates array<struct<date string, games array<struct<gamePk bigint, gameDate string, officialDate string, status struct<detailedState string>, "
    f"teams struct<home {_MLB_SIDE}, away {_MLB_SIDE}>, weather struct<temp string, wind string>>>>>>"
)
_MLB_BOX_SIDE = "struct<teamStats struct<batting map<string, string>, pitching map<string, string>>, errors string, players map<string, struct<status struct<code string>>>>"
MLB_BOX = f"struct<gamePk bigint, teams struct<home {_MLB_BOX_SIDE}, away {_MLB_BOX_SIDE}>>"
_NBA_SIDE = "struct<teamTricode string, statistics map<string, double>, players array<struct<firstName string, familyName string, comment string>>>"
NBA_BOX = f"struct<gameId string, gameStatus int, gameTimeUTC string, homeTeam {_NBA_SIDE}, awayTeam {_NBA_SIDE}>"
_LINKED = "struct<data struct<id string>>"
BOARD = (
    "struct<data array<struct<type string, id string, attributes struct<stat_type string, stat_display_name string, line_score string, line string, status string, is_promo boolean, odds_type string, projection_type string, "
    f"event_type string, description string, start_time string, board_time string>, relationships struct<new_player {_LINKED}, player {_LINKED}, game {_LINKED}, new_game {_LINKED}>>>, "
    "included array<struct<type string, id string, attributes struct<display_name string, name string, team string, position string, start_time string, status string, "
    "metadata struct<game_info struct<teams struct<home struct<abbreviation string>, away struct<abbreviation string>>>>>>>>"
)
TEAM_LOG = f"struct<events array<struct<id string, date string, competitions array<struct<competitors array<struct<homeAway string, team {_TEAM}, score string, statistics {STATISTICS}>>>>>>>"
_ATHLETE = "struct<id string, displayName string, position struct<abbreviation string>, status struct<name string>>"
ROSTER = "struct<team string, athletes array<string>>"

# Line kinds of a board that belong to a game, injury statuses, and the homes of the sources' teams.
GAME_LEVEL = ("1st Half Total", "Game Spread", "Game Total Points", "Moneyline", "Puck Line", "Run Line", "Spread", "Total Goals", "Total Points", "Total Runs")
KEY_STATUS = ("Out", "Injured Reserve", "Injured List", "10-Day IL", "15-Day IL", "60-Day IL", "Doubtful")
OTHER_STATUS = ("Questionable", "Day-To-Day", "PUP", "Non-Football Injury", "Physically Unable to Perform")
ON_LIST = "IL|INJURED LIST|DISABLED LIST|DL"
NFL_DOMES = ("ARI", "ATL", "DAL", "DET", "HOU", "IND", "LAC", "LAR", "LV", "MIN", "NO")
MLB_DOMES = ("ARI", "HOU", "MIA", "MIL", "MIN", "SEA", "TB", "TOR")
ALTITUDES = {"nfl": {"DEN": 5280.0}, "mlb": {"COL": 5280.0}, "nba": {"COL": 5280.0, "DEN": 5280.0, "UTA": 4300.0}}
NBA_PLAYOFF = ("00424", "00425")
# Label of each football statistic in a box score and how its text is read.
NFL_STATS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "passingYards": ("Passing", safe_int),
    "rushingYards": ("Rushing", safe_int),
    "receivingYards": ("Total Yards", safe_int),
    "turnovers": ("Turnovers", safe_int),
    "sacks": ("Sacks-Yards Lost", first_of),
    "thirdDownConversion": ("3rd down efficiency", fraction),
    "redZoneEfficiency": ("Red Zone (Made-Att)", fraction),
    "timeOfPossession": ("Possession", clock_minutes),
    "yardsPerPlay": ("Yards per Play", safe_float),
    "fourthDownConversion": ("4th down efficiency", fraction),
    "penaltyYards": ("Penalties", second_of),
}
NFL_LABELS = [*(label for label, _ in NFL_STATS.values()), "Comp/Att", "Total Plays"]
# Part and name of each baseball statistic in a box score, and whether it is a whole number.
MLB_STATS = {
    "runsScored": ("batting", "runs", True),
    "runsAllowed": ("pitching", "runs", True),
    "hits": ("batting", "hits", True),
    "walks": ("batting", "baseOnBalls", True),
    "strikeouts": ("batting", "strikeOuts", True),
    "era": ("pitching", "era", False),
    "whip": ("pitching", "whip", False),
    "battingAvg": ("batting", "avg", False),
    "onBasePct": ("batting", "obp", False),
    "sluggingPct": ("batting", "slg", False),
    "ops": ("batting", "ops", False),
    "homeRuns": ("batting", "homeRuns", True),
}
# Basketball statistics by their names in the feed.
NBA_STATS = {
    "assists": "assists",
    "blocks": "blocks",
    "fieldGoalsAttempted": "fieldGoalAttempts",
    "fieldGoalsMade": "fieldGoalsMade",
    "fieldGoalsPercentage": "fieldGoalPct",
    "foulsPersonal": "personalFouls",
    "freeThrowsAttempted": "freeThrowAttempts",
    "freeThrowsMade": "freeThrowsMade",
    "freeThrowsPercentage": "freeThrowPct",
    "points": "points",
    "reboundsDefensive": "defensiveRebounds",
    "reboundsOffensive": "offensiveRebounds",
    "reboundsTotal": "rebounds",
    "steals": "steals",
    "threePointersAttempted": "threePointAttempts",
    "threePointersMade": "threesMade",
    "threePointersPercentage": "threePointPct",
    "turnovers": "turnovers",
}
#: What a missing count stands for where rates are taken of it.
NBA_USUAL = {"fieldGoalsAttempted": 85.0, "freeThrowsAttempted": 22.0, "reboundsOffensive": 10.0, "reboundsDefensive": 34.0, "turnovers": 14.0, "threePointersAttempted": 33.0, "assists": 25.0}


def _parsed(df: DataFrame, schema: str, column: str = "json") -> DataFrame:
    """j of each document, parsed once: Spark copies a projection into what filters or reads its column, but no generator."""
    return df.select(F.explode(F.array(F.from_json(column, schema))).alias("j")).where("j is not null")


def rescued(df: DataFrame, schema: str, column: str = "json") -> DataFrame:
    """df with `bad`, by a schema in the form struct<...>: the documents that don't parse by the schema, as they came; null for good ones and for nulls.

    A document is bad where it is no JSON or a field has another type; fields that the schema lacks don't matter.
    The feeds below leave bad documents out, so quarantine() them beside.
    """
    parsed = F.from_json(column, f"{schema[:-1]}, _bad: string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return df.withColumn("bad", parsed["_bad"])


def quarantine(df: DataFrame, schema: str, path: str, column: str = "json") -> DataFrame:
    """The good rows of df, whose bad ones are appended to a table at path with the time; good and bad are all rows."""
    marked = stored(rescued(df, schema, column))
    marked.where("bad is not null").select(*(c for c in df.columns), F.current_timestamp().alias("seen_at")).write.mode("append").parquet(path)
    return marked.where("bad is null").select(*df.columns)


def _altitude(sport: str, team: Column, altitudes: dict[str, dict[str, float]]) -> Column:
    pairs = [F.when(team == t, F.lit(v)) for t, v in altitudes.get(sport, {}).items()]
    return F.coalesce(*pairs, F.lit(0.0))


def odds(df: DataFrame) -> DataFrame:
    """One row per event and bookmaker: Over point, home spread, moneylines (teams match in any case)."""
    rows = _parsed(df, ODDS).select("j.*").select("id", "home_team", "away_team", "commence_time", F.explode_outer("bookmakers").alias("b"))

    def pick(market: str, match, field: str) -> Column:
        found = F.filter("b.markets", lambda m: m["key"] == market)[0]["outcomes"]
        return F.filter(found, match)[0][field]

    side = lambda c: lambda o: F.lower(o["name"]) == F.lower(F.col(c))
    return rows.select(
        "id", "home_team", "away_team", "commence_time", F.col("b.key").alias("book"), pick("totals", lambda o: F.lower(o["name"]) == "over", "point").alias("total"),
        pick("spreads", side("home_team"), "point").alias("spread"), pick("h2h", side("home_team"), "price").alias("home_price"), pick("h2h", side("away_team"), "price").alias("away_price"))


def stat_of(stats: Column, label: str) -> Column:
    """The value under a label or a name in an array of statistics."""
    return F.get(F.filter(stats, lambda s: (s["label"] == label) | (s["name"] == label)), F.lit(0))["displayValue"]


def nfl_values(stats: Column) -> Column:
    """A side's values by what NFL_STATS and the rates name, as a struct s0, s1, ...: each is looked up once, however often it is read."""
    return F.struct(*(stat_of(stats, label).alias(f"s{i}") for i, label in enumerate(NFL_LABELS)))


def nfl_statistics(values: str) -> dict[str, Column]:
    """A side's statistics from its column of nfl_values, with those derived of them; missing ones are 0 (possession: 30 minutes)."""
    value = lambda label: F.col(f"{values}.s{NFL_LABELS.index(label)}")
    out = {name: read(value(label)).cast("double") for name, (label, read) in NFL_STATS.items()}
    attempts = F.greatest(F.lit(1), safe_int(F.split_part(value("Comp/Att"), F.lit("/"), F.lit(2)), 1))
    plays = F.greatest(F.lit(1), safe_int(value("Total Plays"), 60))
    return out | {"pressureRate": out["sacks"] / attempts, "secondsPerPlay": out["timeOfPossession"] * 60.0 / plays, "redZoneConvRate": out["redZoneEfficiency"]}


def nfl_events(df: DataFrame, domes: tuple[str, ...] = NFL_DOMES, altitudes: dict[str, dict[str, float]] = ALTITUDES) -> DataFrame:
    """Final games of (event, summary): scores, all statistics by side, players out, weather, dome, altitude.

    A side missing from the box score is taken by place, home first. domes are the teams that play at
    home under a roof: no wind there, and 72 degrees where none are given (elsewhere 55).
    """
    rows = _parsed(df, NFL).select("j.event.id", "j.event.date", F.get("j.event.competitions", F.lit(0)).alias("c"), F.col("j.summary.boxscore.teams").alias("teams"))
    rows = rows.where((F.col("c.status.type.name") == "STATUS_FINAL") & (F.size("c.competitors") >= 2))
    side = lambda s, k: F.coalesce(F.get(F.filter("c.competitors", lambda x: x["homeAway"] == s), F.lit(0)), F.get("c.competitors", F.lit(k)))
    rows = rows.select("id", "date", "c.venue", "c.weather", side("home", 0).alias("h"), side("away", 1).alias("a"), "teams")
    name = lambda s: F.coalesce(F.col(f"{s}.team.abbreviation"), F.lit("UNK"))
    stats = lambda s, k: F.coalesce(F.get(F.filter("teams", lambda t: t["team"]["abbreviation"] == name(s)), F.lit(0)), F.get("teams", F.lit(k)))["statistics"]
    rows = rows.withColumns({"home_team": name("h"), "away_team": name("a"), "home_score": safe_int(F.col("h.score")), "away_score": safe_int(F.col("a.score")), "hs": nfl_values(stats("h", 0)), "as": nfl_values(stats("a", 1))})
    out = [F.col("id").alias("game_id"), iso_time(F.col("date")).alias("game_date"), "home_team", "away_team", "home_score", "away_score", (F.col("home_score") + F.col("away_score")).alias("total"),
           F.coalesce("venue.fullName", F.concat("home_team", F.lit("_stadium"))).alias("venue")]
    hurt = lambda s: F.coalesce(F.size(F.filter(f"{s}.injuries", lambda x: F.upper(F.coalesce(F.nullif(x["status"], F.lit("")), x["type"]["name"])).isin("OUT", "DOUBTFUL"))), F.lit(0))
    for s, c, o in (("home", "h", "away"), ("away", "a", "home")):
        out += [v.alias(f"{s}_{k}") for k, v in nfl_statistics(f"{c}s").items()]
        out += [F.col(f"{s}_score").cast("double").alias(f"{s}_pointsScored"), F.col(f"{o}_score").cast("double").alias(f"{s}_pointsAllowed"), hurt(c).cast("double").alias(f"{s}_key_players_out")]
    dome = F.col("home_team").isin(*domes) if domes else F.lit(False)
    given = F.nullif(safe_float(F.col("weather.temperature")), F.lit(0.0))
    wind = F.coalesce(F.nullif(safe_float(F.col("weather.windSpeed")), F.lit(0.0)), F.when(F.lower("weather.displayValue").rlike(r"\d\s*mph"), wind_mph(F.col("weather.displayValue"))), F.lit(0.0))
    return rows.select(*out, F.when(dome, 0.0).otherwise(wind).alias("wind_speed_mph"), F.coalesce(F.when(dome & (given == 55.0), 72.0).otherwise(given), F.when(dome, 72.0).otherwise(55.0)).alias("temperature_f"),
                       dome.cast("double").alias("is_dome"), _altitude("nfl", F.col("home_team"), altitudes).alias("altitude_feet"))


def mlb_statistics(side: str) -> dict[str, Column]:
    """A side's statistics from its box score, with those derived of them; missing ones are 0."""
    text = lambda part, name: F.try_element_at(f"{side}.teamStats.{part}", F.lit(name))
    out = {name: (safe_int(text(part, key)).cast("double") if whole else safe_float(text(part, key))) for name, (part, key, whole) in MLB_STATS.items()}
    pitched = lambda key: safe_int(text("pitching", key))
    outs = F.greatest(F.lit(1), pitched("flyOuts") + pitched("groundOuts"))
    ratio = pitched("strikeOuts") / F.greatest(F.lit(1), pitched("baseOnBalls"))
    return out | {"errors": safe_int(F.col(f"{side}.errors")).cast("double"), "kBbRatio": ratio, "groundBallRate": pitched("groundOuts") / outs, "flyBallRate": pitched("flyOuts") / outs}


def mlb_games(schedule: DataFrame, boxes: DataFrame, teams: DataFrame, domes: tuple[str, ...] = MLB_DOMES, altitudes: dict[str, dict[str, float]] = ALTITUDES) -> DataFrame:
    """Final games of a schedule with their box scores; team ids become abbreviations, else T<id>. teams: (id, abbr), a dimension."""
    g = _parsed(schedule, MLB_SCHEDULE).select(F.explode("j.dates").alias("d")).select(F.inline("d.games")).where("status.detailedState = 'Final'")
    b = _parsed(boxes, MLB_BOX).select("j.gamePk", F.col("j.teams.home").alias("hb"), F.col("j.teams.away").alias("ab"))
    out = g.join(b, "gamePk", "left")
    for s in ("home", "away"):
        t = F.broadcast(teams.select(F.col("id").alias(f"_{s}"), F.col("abbr").alias(f"{s}_team")))
        out = out.withColumn(f"_{s}", F.coalesce(F.col(f"teams.{s}.team.id"), F.lit(0))).join(t, f"_{s}", "left").withColumn(f"{s}_team", F.coalesce(f"{s}_team", F.concat(F.lit("T"), F.col(f"_{s}").cast("string"))))
        out = out.withColumn(f"{s}_score", safe_int(F.col(f"teams.{s}.score")))
    listed = lambda x: F.coalesce(F.size(F.filter(F.map_values(f"{x}.players"), lambda v: F.upper(v["status"]["code"]).rlike(ON_LIST))), F.lit(0)).cast("double")
    sides = [v.alias(f"{s}_{k}") for s, x in (("home", "hb"), ("away", "ab")) for k, v in (mlb_statistics(x) | {"key_players_out": listed(x)}).items()]
    dome = F.col("home_team").isin(*domes) if domes else F.lit(False)
    lead = F.nullif(F.regexp_extract("weather.wind", r"^(\d+)", 1), F.lit("")).try_cast("double")
    heat = safe_float(F.col("weather.temp"), 70.0)
    return out.select(F.col("gamePk").cast("string").alias("game_id"), iso_time(F.coalesce("gameDate", "officialDate")).alias("game_date"), "home_team", "away_team", "home_score", "away_score", (F.col("home_score") + F.col("away_score")).alias("total"),
                      *sides, F.when(dome, 0.0).otherwise(F.coalesce(lead, F.lit(0.0))).alias("wind_speed_mph"), F.when(heat > 0, heat).otherwise(70.0).alias("temperature_f"), dome.cast("double").alias("is_dome"), _altitude("mlb", F.col("home_team"), altitudes).alias("altitude_feet"))


def nba_boxes(df: DataFrame, altitudes: dict[str, dict[str, float]] = ALTITUDES) -> DataFrame:
    """Finished games (status 3): all statistics and rates by side, players out by their comments, situation.

    A missing statistic is 0, but a usual count (NBA_USUAL) where a rate is taken of it.
    """
    rows = _parsed(df, NBA_BOX).select("j.*").where("gameStatus = 3")
    stat = lambda s, k, default=0.0: F.coalesce(F.try_element_at(f"{s}Team.statistics", F.lit(k)), F.lit(default))
    usual = lambda s, k: stat(s, k, NBA_USUAL[k])
    points = lambda s: stat(s, "points").cast("bigint")
    poss = lambda s: possessions(usual(s, "fieldGoalsAttempted"), usual(s, "reboundsOffensive"), usual(s, "turnovers"), usual(s, "freeThrowsAttempted"))
    least = lambda x: F.greatest(F.lit(1.0), x)
    out = [F.col("gameId").alias("game_id"), iso_time(F.col("gameTimeUTC")).alias("game_date"), F.col("homeTeam.teamTricode").alias("home_team"), F.col("awayTeam.teamTricode").alias("away_team"),
           points("home").alias("home_score"), points("away").alias("away_score"), (points("home") + points("away")).alias("total"), F.concat("homeTeam.teamTricode", F.lit("_arena")).alias("venue")]
    for s, o in (("home", "away"), ("away", "home")):
        shots, free, threes, boards = (usual(s, k) for k in ("fieldGoalsAttempted", "freeThrowsAttempted", "threePointersAttempted", "reboundsDefensive"))
        rates = {
            "possessions": poss(s), "pointsPerPossession": points(s) / poss(s), "trueShooting": points(s) / least(2 * (shots + 0.44 * free)), "offensiveRating": 100.0 * points(s) / poss(s), "defensiveRating": 100.0 * points(o) / poss(s),
            "pace": poss(s), "assistRate": usual(s, "assists") / poss(s), "drebRate": boards / least(boards + usual(o, "reboundsOffensive")), "ftRate": free / least(shots), "threePointRate": threes / least(shots), "netRating": stat(s, "plusMinusPoints"),
        }
        kinds = F.transform(f"{s}Team.players", lambda p: injury_kind(p["comment"]))
        count = lambda keep, kinds=kinds: F.coalesce(F.size(F.filter(kinds, keep)), F.lit(0)).cast("double")
        out += [*(stat(s, k).alias(f"{s}_{v}") for k, v in NBA_STATS.items()), *(v.alias(f"{s}_{k}") for k, v in rates.items())]
        out += [count(lambda k: k == "key").alias(f"{s}_key_players_out"), count(lambda k: k != "none").alias(f"{s}_players_out")]
    # an id begins with the kind of game and the season; further on the same digits are a regular game's number
    playoff = F.array_contains(F.transform(F.array(*map(F.lit, NBA_PLAYOFF)), lambda p: F.startswith(F.col("gameId"), p)), True)
    return rows.select(*out, F.lit(1.0).alias("is_dome"), F.lit(72.0).alias("temperature_f"), F.lit(0.0).alias("wind_speed_mph"), _altitude("nba", F.col("homeTeam.teamTricode"), altitudes).alias("altitude_feet"), playoff.cast("double").alias("is_playoff"))


def board(df: DataFrame) -> DataFrame:
    """Projections of JSON:API pages with their side-loaded players and games; lines that aren't numbers are dropped.

    kind is game_line for statistics of GAME_LEVEL and events of kind game, else player_prop. A player
    without a name is called by the description, else Unknown; a team's own projection takes its team from it.
    """
    of_kind = lambda kind: F.filter("j.included", lambda i: i["type"] == kind)
    pages = _parsed(df, BOARD).select("j.data", of_kind("new_player").alias("players"), of_kind("game").alias("games"))
    of = lambda d, *names: F.coalesce(*(d["relationships"][n]["data"]["id"] for n in names))
    player_id, game_id = lambda d: of(d, "new_player", "player"), lambda d: F.coalesce(of(d, "game", "new_game"), F.lit(""))
    # a page holds what its rows refer to, so they meet inside it
    met = lambda d: F.struct(d.alias("d"), F.filter("players", lambda i: i["id"] == player_id(d))["attributes"].alias("players"), F.filter("games", lambda i: i["id"] == game_id(d))["attributes"].alias("games"))
    p = pages.select(F.inline(F.transform(F.filter("data", lambda d: d["type"] == "projection"), met)))
    p = p.select("d.id", "d.attributes.*", game_id(F.col("d")).alias("game_id"), "players", "games")
    p = p.withColumn("line", F.coalesce("line_score", "line", F.lit("0")).try_cast("double")).where("line is not null")
    p = p.withColumn("stat_type", F.coalesce(F.nullif("stat_type", F.lit("")), "stat_display_name", F.lit("")))
    p = p.select("*", F.explode_outer("players").alias("of_player")).select("*", F.explode_outer("games").alias("of_game"))
    sides = {f"{s}_team": F.coalesce(F.col(f"of_game.metadata.game_info.teams.{s}.abbreviation"), F.when(F.col("of_game").isNotNull(), "")) for s in ("home", "away")}
    named = {"player": F.coalesce(F.nullif("of_player.display_name", F.lit("")), F.nullif("of_player.name", F.lit(""))), "own_team": F.nullif("of_player.team", F.lit("")), "position": F.col("of_player.position"), "game_start": F.col("of_game.start_time")}
    out = p.withColumns(sides | named)
    event = F.coalesce("event_type", F.lit("player"))
    is_game = F.col("stat_type").isin(*GAME_LEVEL) | (event == "game")
    prop = lambda c: F.when(~is_game, c)
    return out.select(
        "id", "stat_type", "line", F.when(is_game, "game_line").otherwise("player_prop").alias("kind"), "game_id", F.coalesce("home_team", "description", F.lit("")).alias("home_team"), F.coalesce("away_team", F.lit("")).alias("away_team"),
        iso_time(F.coalesce("start_time", "board_time", "game_start")).alias("start_time"), prop(F.coalesce("player", F.nullif("description", F.lit("")), F.lit("Unknown"))).alias("name"),
        prop(F.coalesce("own_team", F.when(event == "team", F.col("description")), F.lit(""))).alias("team"), prop(F.coalesce("position", F.lit(""))).alias("position"), F.coalesce("status", F.lit("pre_game")).alias("status"),
        F.coalesce("is_promo", F.lit(False)).alias("is_promo"), F.coalesce(F.nullif("odds_type", F.lit("")), F.lit("standard")).alias("odds_type"), F.coalesce(F.nullif("projection_type", F.lit("")), F.lit("standard")).alias("projection_type"))


def team_logs(df: DataFrame, stats: list[str]) -> DataFrame:
    """One row per competitor of each event's first competition, with the listed statistics as columns, 0 where missing."""
    rows = _parsed(df, TEAM_LOG).select(F.explode("j.events").alias("e")).select("e.id", "e.date", F.inline(F.get("e.competitions", F.lit(0))["competitors"]))
    value = lambda s: safe_float(F.get(F.filter("statistics", lambda x: x["name"] == s), F.lit(0))["displayValue"])
    return rows.select(F.col("id").alias("game_id"), iso_time(F.col("date")).alias("game_date"), F.col("team.id").alias("team_id"), F.col("team.displayName").alias("team_name"), F.coalesce("homeAway", F.lit("home")).alias("home_away"), safe_int(F.col("score")).alias("score"), *(value(s).alias(s) for s in stats))


def rosters(df: DataFrame) -> DataFrame:
    """Players of (team, athletes) with an injury status; key ones are those sure to miss the game.

    athletes holds players, or lists of them.
    """
    groups = _parsed(df, ROSTER).select("j.team", F.explode("j.athletes").alias("a"))
    many = F.from_json("a", f"array<{_ATHLETE}>")
    one = F.when(F.startswith(F.ltrim("a"), F.lit("[")), many).otherwise(F.array(F.from_json("a", _ATHLETE)))
    rows = groups.select("team", F.explode(one).alias("p")).withColumn("status", F.coalesce("p.status.name", F.lit("Active")))
    return rows.where(F.col("status").isin(*KEY_STATUS, *OTHER_STATUS)).select("team", F.col("p.position.abbreviation").alias("position"), F.col("p.id").alias("id"), F.coalesce("p.displayName", F.lit("Unknown")).alias("name"), "status", F.col("status").isin(*KEY_STATUS).alias("is_key"))


def pair_logs(logs: DataFrame) -> DataFrame:
    """Team-game rows (game_id, matchup, team, points, ...) to one row per game; home plays 'vs.'."""
    home = F.col("matchup").contains(" vs. ")
    values = [c for c in logs.columns if c not in ("game_id", "matchup")]
    pick = lambda c, cond, s: F.max(F.when(cond, F.col(c))).alias(f"{s}_{c}")
    both = logs.groupBy("game_id").agg(*(pick(c, home, "home") for c in values), *(pick(c, ~home, "away") for c in values), F.count_if(home).alias("_h"), F.count_if(~home).alias("_a"))
    return both.where("_h > 0 and _a > 0").drop("_h", "_a")
