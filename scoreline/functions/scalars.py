"""Column expressions: parsing, box-score ratios, betting arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0

# Words in a player's comment that tell an injury from a coach's choice.
INJURY_WORDS = (
    "INJURY", "ILLNESS", "ILL", "SICK", "PERSONAL", "MEDICAL", "DND", "PROTOCOL", "CONCUSSION", "KNEE", "ANKLE", "HAMSTRING", "BACK",
    "WRIST", "SHOULDER", "HIP", "CALF", "QUAD", "GROIN", "FOOT", "ACHILLES", "ELBOW", "HAND", "FINGER", "REST",
)
NOT_INJURY = ("COACH'S DECISION", "COACHES DECISION")
KEY_WORDS = ("DND", "INJURY", "ILL", "REST")
STATUS_IMPACT = {"out": 1.0, "doubtful": 0.75, "questionable": 0.40, "probable": 0.10, "active": 0.0}
POSITION_IMPACT = {
    "mlb": {"1B": 0.45, "2B": 0.50, "3B": 0.55, "C": 0.50, "OF": 0.45, "RP": 0.30, "SP": 0.80, "SS": 0.60},
    "nba": {"C": 0.60, "PF": 0.65, "PG": 0.75, "SF": 0.70, "SG": 0.65},
    "nfl": {"CB": 0.35, "DE": 0.40, "LB": 0.30, "OL": 0.30, "QB": 0.90, "RB": 0.40, "S": 0.25, "TE": 0.35, "WR": 0.45},
}


def safe_int(s: Column, default: int = 0) -> Column:
    """The whole number in a trimmed string; '3.5', text and null give the default."""
    t = F.trim(s.cast("string"))
    return F.coalesce(F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint")), F.lit(default).cast("bigint"))


def safe_float(s: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.trim(s.cast("string")).try_cast("double"), F.lit(default))


def stat_clean(s: Column) -> Column:
    """'45.5%' -> 45.5, '30:15' -> 30.15, anything else that isn't a number -> 0."""
    return safe_float(F.replace(F.replace(s, F.lit("%"), F.lit("")), F.lit(":"), F.lit(".")))


def _part(s: Column, sep: str, k: int) -> Column:
    return F.trim(F.split_part(s, F.lit(sep), F.lit(k))).try_cast("double")


def fraction(s: Column, default: float = 0.0) -> Column:
    """'7-13' -> 7/13; a zero or missing denominator gives the default."""
    return F.coalesce(_part(s, "-", 1) / F.nullif(_part(s, "-", 2), F.lit(0.0)), F.lit(default))


def first_of(s: Column, default: float = 0.0) -> Column:
    return F.coalesce(_part(s, "-", 1), F.lit(default))


def second_of(s: Column, default: float = 0.0) -> Column:
    return F.coalesce(_part(s, "-", 2), F.lit(default))


def clock_minutes(s: Column, default: float = 30.0) -> Column:
    """'30:15' -> 30.25."""
    return F.coalesce(_part(s, ":", 1) + _part(s, ":", 2) / 60.0, F.lit(default))


def wind_mph(s: Column) -> Column:
    """The number before 'mph', else leading digits, else 0."""
    mph = F.regexp_extract(F.lower(s), r"(\d+)\s*mph", 1)
    lead = F.regexp_extract(s, r"^\s*(\d+)", 1)
    return F.coalesce(F.nullif(mph, F.lit("")).try_cast("double"), F.nullif(lead, F.lit("")).try_cast("double"), F.lit(0.0))


def iso_time(s: Column) -> Column:
    """An ISO-8601 text as a UTC timestamp; without a zone it is UTC, a bad one gives null."""
    s = F.regexp_replace(s, r"(T\d\d:\d\d)(Z|[+-]\d\d:?\d\d)?$", "$1:00$2")  # seconds may be missing
    zoned = F.when(s.rlike(r"(Z|[+-]\d\d:?\d\d)$"), s).otherwise(F.concat(s, F.lit("Z")))
    return F.try_to_timestamp(zoned)


def injury_kind(comment: Column) -> Column:
    """'key', 'injury' or 'none' of a comment."""
    c = F.upper(F.coalesce(comment, F.lit("")))
    has = lambda words: c.rlike("|".join(words))
    return F.when(has(NOT_INJURY), "none").when(has(KEY_WORDS), "key").when(has(INJURY_WORDS), "injury").otherwise("none")


def status_impact(status: Column) -> Column:
    pairs = [x for k, v in STATUS_IMPACT.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(status)), F.lit(0.0))


def position_impact(sport: Column, position: Column, default: float = 0.0) -> Column:
    """What a missing player of the position costs a team; unknown ones give the default."""
    pairs = [x for s, places in POSITION_IMPACT.items() for p, v in places.items() for x in (F.lit(f"{s}/{p}"), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.concat(F.lower(sport), F.lit("/"), F.upper(position))), F.lit(default))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b, c, d = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(h))


def player_id(sport: Column, team: Column, name: Column) -> Column:
    return F.substring(F.replace(F.lower(F.concat_ws("_", sport, team, name)), F.lit(" "), F.lit("_")), 1, 50)


def half_points(x: Column, low: float, high: float) -> Column:
    """Rounded to half points (ties to even) and clipped."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.rint(x * 2) / 2))


def confidence(p: Column) -> Column:
    return 2 * F.abs(p - 0.5)


def edge(p: Column) -> Column:
    return F.abs(p - 0.5)


def direction(p: Column) -> Column:
    return F.when(p >= 0.5, "over").otherwise("under")


def possessions(fga: Column, oreb: Column, tov: Column, fta: Column) -> Column:
    return F.greatest(F.lit(1.0), fga - oreb + tov + 0.44 * fta)


def box_ratios(p: str) -> dict[str, Column]:
    """Rates of one side from its counts p_fga, p_oreb, p_tov, p_fta, p_pts, p_ast, p_dreb, p_tpa, p_fgm."""
    c = lambda n: F.col(f"{p}_{n}").cast("double")
    poss, shots = possessions(c("fga"), c("oreb"), c("tov"), c("fta")), F.greatest(F.lit(1.0), c("fga"))
    return {
        "possessions": poss,
        "points_per_possession": c("pts") / poss,
        "true_shooting": c("pts") / F.greatest(F.lit(1.0), 2 * (c("fga") + 0.44 * c("fta"))),
        "offensive_rating": 100 * c("pts") / poss,
        "assist_rate": c("ast") / F.greatest(F.lit(1.0), c("fgm")),
        "dreb_rate": c("dreb") / F.greatest(F.lit(1.0), c("dreb") + c("oreb")),
        "ft_rate": c("fta") / shots,
        "three_rate": c("tpa") / shots,
    }


def season_of(ts: Column, first_month: int) -> Column:
    """The year in which the season of a date began."""
    return F.when(F.month(ts) >= first_month, F.year(ts)).otherwise(F.year(ts) - 1)


def nfl_week(ts: Column, opening: Column) -> Column:
    return F.least(F.lit(18), F.floor(F.datediff(ts, opening) / 7) + 1).cast("int")
