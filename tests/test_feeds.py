"""Feeds in the shapes their sources give."""

import json

from scoreline.sources import feeds


def rows(spark, make, *docs, **options):
    return make(spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in docs], "json string"), **options).collect()


def nfl(**change):
    side = lambda s, team, score, **more: {"homeAway": s, "team": {"abbreviation": team}, "score": score} | more
    match = {
        "status": {"type": {"name": "STATUS_FINAL"}}, "venue": {"fullName": "Arrowhead"}, "weather": {"temperature": 63, "displayValue": "63° F, Wind 8 mph"},
        "competitors": [side("home", "KC", "27", injuries=[{"status": "Out"}, {"status": "", "type": {"name": "doubtful"}}, {"status": "Questionable"}]), side("away", "BAL", "20")],
    } | change
    stats = [("Passing", "280"), ("Rushing", "95"), ("Total Yards", "375"), ("Turnovers", "1"), ("Sacks-Yards Lost", "2-14"), ("3rd down efficiency", "7-13"), ("Red Zone (Made-Att)", "3-4"), ("Possession", "32:15"), ("Yards per Play", "6.1"), ("Penalties", "5-40"), ("Total Plays", "62"), ("Comp/Att", "24/35")]
    team = lambda name, few: {"team": {"abbreviation": name}, "statistics": [{"label": k, "displayValue": v} for k, v in (stats[:2] if few else stats)]}
    return {"event": {"id": "401", "date": "2023-09-07T20:20Z", "competitions": [match]}, "summary": {"boxscore": {"teams": [team("KC", False), team("BAL", True)]}}}


def test_football(spark):
    (r,) = rows(spark, feeds.nfl_events, nfl(), nfl(status={"type": {"name": "STATUS_SCHEDULED"}}), nfl(competitors=[]), "not json", "{}")
    assert (r.home_team, r.away_team, r.home_score, r.total, r.venue) == ("KC", "BAL", 27, 47, "Arrowhead")
    assert (r.home_passingYards, r.home_receivingYards, r.home_sacks, r.home_penaltyYards, r.home_thirdDownConversion, r.home_redZoneConvRate) == (280, 375, 2, 40, 7 / 13, 0.75)
    assert (r.home_timeOfPossession, r.home_secondsPerPlay, r.home_pressureRate) == (32.25, 32.25 * 60 / 62, 2 / 35)
    assert (r.away_rushingYards, r.away_timeOfPossession, r.away_secondsPerPlay, r.away_pointsAllowed) == (95, 30, 30, 27)
    assert (r.home_key_players_out, r.away_key_players_out, r.wind_speed_mph, r.temperature_f, r.is_dome) == (2, 0, 8, 63, 0)
    assert str(r.game_date) == "2023-09-07 20:20:00"


def test_domes_have_no_wind_and_altitude_is_the_homes(spark):
    home = lambda team: [{"homeAway": "away", "team": {"abbreviation": "KC"}, "score": 3}, {"homeAway": "home", "team": {"abbreviation": team}, "score": "x"}]
    inside, high = rows(spark, feeds.nfl_events, nfl(competitors=home("DET"), weather={"windSpeed": 20}), nfl(competitors=home("DEN"), weather={"windSpeed": "20"}, venue=None))
    assert (inside.wind_speed_mph, inside.temperature_f, inside.is_dome, inside.home_score) == (0, 72, 1, 0)
    assert (high.wind_speed_mph, high.temperature_f, high.altitude_feet, high.venue) == (20, 55, 5280, "DEN_stadium")
    # neither DEN nor DET is in the box score, so the first of it stands for the home side
    assert high.home_passingYards == 280 and inside.away_passingYards == 280


def test_baseball(spark):
    batting = {"runs": 5, "hits": 9, "homeRuns": 2, "strikeOuts": 8, "baseOnBalls": 3, "avg": ".265", "obp": ".330", "slg": ".450", "ops": ".780"}
    pitching = {"runs": 3, "strikeOuts": 9, "baseOnBalls": 0, "era": "3.50", "whip": "1.20", "flyOuts": 6, "groundOuts": 10}
    players = {"ID1": {"status": {"code": "A"}}, "ID2": {"status": {"code": "D10-DL"}}, "ID3": {"status": {"code": "60-day il"}}, "ID4": {}}
    box = {"gamePk": 1, "teams": {"home": {"teamStats": {"batting": batting, "pitching": pitching}, "errors": 1, "players": players}, "away": {}}}
    game = lambda pk, state: {"gamePk": pk, "gameDate": "2023-05-01T23:10:00Z", "status": {"detailedState": state}, "teams": {"home": {"team": {"id": 115}, "score": 5}, "away": {"team": {"id": 999}, "score": 3}}, "weather": {"temp": "75", "wind": "8 mph, Out To CF"}}
    one = lambda d: spark.createDataFrame([(json.dumps(d),)], "json string")
    teams = spark.createDataFrame([(115, "COL")], "id long, abbr string")
    (r,) = feeds.mlb_games(one({"dates": [{"date": "2023-05-01", "games": [game(1, "Final"), game(2, "Postponed")]}]}), one(box), teams).collect()
    assert (r.game_id, r.home_team, r.away_team, r.total, r.altitude_feet, r.wind_speed_mph, r.temperature_f) == ("1", "COL", "T999", 8, 5280, 8, 75)
    assert (r.home_runsScored, r.home_runsAllowed, r.home_errors, r.home_kBbRatio, r.home_groundBallRate, r.home_flyBallRate, r.home_ops, r.home_key_players_out) == (5, 3, 1, 9, 0.625, 0.375, 0.78, 2)
    assert (r.away_hits, r.away_era, r.away_groundBallRate, r.away_key_players_out) == (0, 0, 0, 0)


def test_basketball(spark):
    stats = {"points": 110, "fieldGoalsAttempted": 88, "freeThrowsAttempted": 20, "reboundsOffensive": 8, "turnovers": 12, "assists": 27, "plusMinusPoints": 6, "fieldGoalsPercentage": 0.48}
    players = [{"comment": c} for c in ("DNP - Coach's Decision", "DND - Injury/Illness", "NWT - Left Ankle", None)]
    doc = lambda status: {"gameId": "0042400101", "gameStatus": status, "gameTimeUTC": "2025-04-20T00:00:00Z", "homeTeam": {"teamTricode": "DEN", "statistics": stats, "players": players}, "awayTeam": {"teamTricode": "LAL", "statistics": {"points": 104}}}
    (r,) = rows(spark, feeds.nba_boxes, doc(3), doc(2))
    poss = 88 - 8 + 12 + 0.44 * 20
    assert (r.home_score, r.total, r.home_fieldGoalPct, r.away_fieldGoalAttempts, r.altitude_feet, r.is_playoff) == (110, 214, 0.48, 0, 5280, 1)
    assert abs(r.home_possessions - poss) < 1e-9 and abs(r.home_defensiveRating - 100 * 104 / poss) < 1e-9 and abs(r.home_assistRate - 27 / poss) < 1e-9
    assert abs(r.away_possessions - (85 - 10 + 14 + 0.44 * 22)) < 1e-9 and abs(r.home_drebRate - 34 / 44) < 1e-9 and (r.home_netRating, r.home_key_players_out, r.home_players_out) == (6, 1, 2)


def test_board(spark):
    linked = lambda player, game: {"new_player": {"data": {"id": player}}, "game": {"data": {"id": game}}}
    row = lambda id_, rel=None, type_="projection", **a: {"type": type_, "id": id_, "attributes": a, "relationships": rel or {}}
    data = [row("1", linked("p1", "g1"), stat_type="Points", line_score=25.5, start_time="2024-02-02T19:00:00-05:00", odds_type="demon"), row("2", linked("p9", "g1"), stat_type="Run Line", line_score="1.5"), row("3", stat_type="Points", line_score="soon"),
            row("4", linked("p9", "g9"), stat_display_name="Runs", line=4, event_type="team", description="BOS"), row("5", linked("p9", "g1"), stat_type="Any", line_score=1, event_type="game"), row("6", type_="other", stat_type="Points", line_score=1)]
    data += [row(f"g{n}", stat_type=kind, line_score=1) for n, kind in enumerate(feeds.GAME_LEVEL)]
    included = [
        {"type": "new_player", "id": "p1", "attributes": {"display_name": "A. Player", "team": "NYK", "position": "PG"}},
        {"type": "game", "id": "g1", "attributes": {"start_time": "2024-02-02T10:00:00Z", "metadata": {"game_info": {"teams": {"home": {"abbreviation": "NYK"}, "away": {"abbreviation": "BOS"}}}}}},
    ]
    got = {r.id: r for r in rows(spark, feeds.board, {"data": data, "included": included})}
    assert set(got) == {"1", "2", "4", "5"} | {f"g{n}" for n in range(10)}
    assert (got["1"].name, got["1"].team, got["1"].position, got["1"].line, got["1"].odds_type, got["1"].kind) == ("A. Player", "NYK", "PG", 25.5, "demon", "player_prop")
    assert str(got["1"].start_time) == "2024-02-03 00:00:00" and str(got["2"].start_time) == "2024-02-02 10:00:00"
    assert (got["2"].kind, got["2"].home_team, got["2"].away_team, got["2"].name) == ("game_line", "NYK", "BOS", None)
    assert (got["4"].kind, got["4"].name, got["4"].team, got["4"].stat_type, got["4"].home_team) == ("player_prop", "BOS", "BOS", "Runs", "BOS") and got["5"].kind == "game_line"
    assert {got[f"g{n}"].kind for n in range(10)} == {"game_line"}


def test_team_log(spark):
    stats = [{"name": "rebounds", "displayValue": "44"}, {"name": "assists", "displayValue": "x"}]
    event = {"id": "1", "date": "2024-01-01T00:00Z", "competitions": [{"competitors": [{"homeAway": "away", "team": {"id": "2", "displayName": "Celtics"}, "score": "101", "statistics": stats}, {"team": {"id": "3"}}]}, {"competitors": [{"score": "9"}]}]}
    a, b = sorted(rows(spark, feeds.team_logs, {"events": [event]}, {"events": []}, stats=["rebounds", "assists"]), key=lambda r: r.team_id)
    assert (a.game_id, a.team_name, a.home_away, a.score, a.rebounds, a.assists) == ("1", "Celtics", "away", 101, 44, 0)
    assert (b.home_away, b.score, b.rebounds) == ("home", 0, 0)


def test_rosters_of_players_or_lists_of_them(spark):
    player = lambda name, status: {"displayName": name, "status": {"name": status}, "position": {"abbreviation": "QB"}}
    got = rows(spark, feeds.rosters, {"team": "KC", "athletes": [player("a", "Out"), player("b", "Active"), {"displayName": "c"}]}, {"team": "SF", "athletes": [[player("d", "PUP"), player("e", "10-Day IL")], []]})
    assert sorted((r.team, r.name, r.status, r.is_key) for r in got) == [("KC", "a", "Out", True), ("SF", "d", "PUP", False), ("SF", "e", "10-Day IL", True)]


def test_bad_documents_are_kept_apart(spark):
    from scoreline.sources import store

    docs = ['{"id": "a", "bookmakers": []}', '{"id": "b", "other": 1}', '{"id": "c", "bookm', "no json", '{"id": "d", "bookmakers": 7}', None, ""]
    df = spark.createDataFrame(list(enumerate(docs)), "n int, json string")
    bad = {r.n: r.bad for r in feeds.rescued(df, feeds.ODDS).collect()}
    assert {n for n, b in bad.items() if b is not None} == {2, 3, 4} and all(bad[n] == docs[n] for n in (2, 3, 4))
    path = store.shared_path(spark)
    for _ in range(2):
        good = feeds.quarantine(df, feeds.ODDS, path)
        assert sorted(r.n for r in good.collect()) == [0, 1, 5, 6]
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == [2, 2, 3, 3, 4, 4]
    assert {r.id for r in feeds.odds(good).collect()} == {"a", "b"}


def test_a_regular_game_numbered_like_a_playoff_season(spark):
    doc = lambda i: {"gameId": i, "gameStatus": 3, "gameTimeUTC": "2024-01-20T00:00:00Z", "homeTeam": {"teamTricode": "DEN"}, "awayTeam": {"teamTricode": "LAL"}}
    got = {r.game_id: r.is_playoff for r in rows(spark, feeds.nba_boxes, doc("0022300424"), doc("00223100425"), doc("0042400101"), doc("0042500101"))}
    assert got == {"0022300424": 0, "00223100425": 0, "0042400101": 1, "0042500101": 1}


def test_documents_are_parsed_once(spark):
    df = spark.createDataFrame([("{}",)], "json string")
    for make in (feeds.odds, feeds.board, feeds.nfl_events, feeds.nba_boxes, lambda d: feeds.team_logs(d, ["rebounds"])):
        assert make(df)._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_board_rows_meet_what_their_own_page_holds(spark):
    row = {"type": "projection", "id": "1", "attributes": {"stat_type": "Points", "line_score": 1}, "relationships": {"player": {"data": {"id": "p"}}, "new_game": {"data": {"id": "g"}}}}
    player = lambda name, type_="new_player": {"type": type_, "id": "p", "attributes": {"name": name}}
    page = lambda *included: {"data": [row], "included": list(included)}
    got = rows(spark, feeds.board, page(player("A")), page(player("B"), player("C")), page(player("D", "game")), {"data": [row]}, {"data": None})
    assert sorted(r.name for r in got) == ["A", "B", "C", "Unknown", "Unknown"]
