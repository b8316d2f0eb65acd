"""Hand-worked fixtures for the match-event engine."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pitchlake import catalog
from pitchlake.functions.pitch import IN_BOX
from pitchlake.operators.relational import average_rank, min_max, possession_changes, strict_percentile
from pitchlake.plans import match, metrics, players, season
from pitchlake.sources import ingest
from pitchlake.sources.adapter import football_events

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql_and_only_known_columns():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_entry_runs(spark):
    assert 0 < entry.entry(spark).count() <= 20


def test_average_rank_ties_and_nulls(spark):
    rank = lambda values: [
        r.p for r in spark.createDataFrame(
            [(i, v) for i, v in enumerate(values)], "i int, v double"
        ).select("i", average_rank("v").alias("p")).orderBy("i").collect()
    ]
    assert rank([1.0, 2.0, 2.0, 4.0]) == [0.25, 0.625, 0.625, 1.0]
    assert rank([1.0, 2.0, 2.0, None]) == [pytest.approx(1 / 3), pytest.approx(2.5 / 3), pytest.approx(2.5 / 3), None]


def test_min_max_and_strict_percentile(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, v double").select(
        "g", "v", min_max("v", "g").alias("s"), strict_percentile("v", "g").alias("p")
    )
    assert sorted(map(tuple, df.collect())) == [("a", 1.0, 0.0, 0.0), ("a", 3.0, 100.0, 50.0), ("b", 5.0, 0.0, 0.0)]


def test_possession_changes(spark):
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate([1, 1, None, None, 2])], "match_id int, seq int, possession_id int")
    assert [r.changed for r in possession_changes(df).orderBy("seq").collect()] == [False, True, True, True, True]


def test_box_edges(spark):
    df = spark.createDataFrame([(82.0, 50.0), (83.0, 21.0), (83.0, 20.0), (90.0, 80.0), (None, 50.0)], "location_x double, location_y double")
    assert [r.b for r in df.select(F.expr(IN_BOX).alias("b")).collect()] == [False, True, False, False, None]


def test_recovery_thirds_count_the_edge_twice(spark):
    df = spark.createDataFrame(
        [("interception", x, None) for x in (33.3, 66.6, 66.7, None)], "type_primary string, location_x double, gd_recovered_possession boolean"
    )
    row = df.agg(*match.aggregates(metrics.RECOVERIES)).first()
    assert (row.recoveries, row.recoveries_low, row.recoveries_mid, row.recoveries_high) == (4, 2, 2, 1)


def test_invariants(spark):
    ev = football_events(spark, SF).cache()
    x = match.transitions(ev).where("losses_low + losses_mid + losses_high < losses")
    assert x.count() == 0
    assert match.passes(ev).where("forward_passes + back_passes + lateral_passes <> passes").count() == 0
    assert match.possession(ev).groupBy("match_id").agg(F.sum("share").alias("s")).where("abs(s - 100) > 1e-6").count() == 0
    assert season.corners(ev).where(" + ".join(season.ZONES.values()) + " <> corners").count() == 0
    scores = players.archetype_scores(ev)
    assert scores.where("score < 0 or score > 100").count() == 0


def test_no_python_in_plans(spark):
    for name in ("match_attacks", "team_corners", "team_radar", "archetype_scores", "player_npxg_xa"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_minutes_from_lineups(spark):
    lineups = spark.createDataFrame(
        [(1, 10, [1, 2], [(3, 1, 60), (4, 3, 80)]), (2, 10, [1, 2], [(3, 1, 30), (5, 1, 50)]), (3, 10, [1], None)],
        "match_id int, team_id int, lineup array<bigint>, substitutions array<struct<player_in:bigint,player_out:bigint,minute:int>>"
    )
    length = spark.createDataFrame([(1, 95), (2, 90)], "match_id int, minutes int")
    got = {r.player_id: r.total_minutes for r in players.minutes_from_lineups(lineups, length).collect()}
    assert got == {1: 60 + 50 + 90, 2: 185, 3: 35 + 60, 4: 15, 5: 40}


def test_derived_lineups_and_table(spark):
    ev = football_events(spark, SF)
    table = players.player_table(ev)
    assert table.count() == ev.where("player_id is not null").select("player_id").distinct().count()
    assert table.where("total_minutes < 0 or total_minutes is null").count() == 0
    scores = players.archetype_scores(ev)
    inside = players.role_rows(players.qualified(ev, 90), players.roles_table(spark)).select("player_id", "role").distinct()
    outside = scores.join(inside, ["player_id", "role"], "left_anti")
    assert outside.count() > 0 and outside.where("total <> 0 or score <> 0 or place <> 0").count() == 0


def test_threat_ends_where_its_type_says(spark):
    schema = "type_primary string, pass_accurate boolean, player_id int, location_x double, location_y double, pass_end_x double, pass_end_y double, carry_end_x double, carry_end_y double"
    rows = [
        ("pass", True, 1, 10.0, 50.0, None, None, 99.0, 50.0), ("touch", None, 2, 10.0, 50.0, 99.0, 50.0, None, None),
        ("pass", True, 3, 10.0, 50.0, 99.0, 50.0, 1.0, 1.0)
    ]
    assert {r.player_id: r.xt for r in players.expected_threat(spark.createDataFrame(rows, schema)).collect()} == {3: pytest.approx(0.25)}


def test_open_play_ties_go_to_the_first_row(spark):
    schema = "match_id int, possession_id int, seq int, match_ts double, type_primary string, possession_team_name string, possession_duration_sec double"
    rows = [(1, 1, 2, 5.0, "corner", "A", 3.0), (1, 1, 1, 5.0, "pass", "A", 3.0), (1, 2, 3, 9.0, "throw_in", "A", 3.0), (1, 2, 4, 9.0, "pass", "A", 3.0)]
    assert [(r.total, r.to_10) for r in match.open_play(spark.createDataFrame(rows, schema)).collect()] == [(1, 1)]


def test_half_even_and_texts(spark):
    from pitchlake.functions import display

    df = spark.createDataFrame([(0.25,), (0.35,), (2.5,), (-0.004,), (59.999,)], "x double")
    got = [tuple(r) for r in df.select(F.expr(display.rounded("x", 1)), F.expr(display.decimals("x", 2)), F.expr(display.clock("x * 60"))).collect()]
    assert got == [(0.2, "0.25", "00:15"), (0.4, "0.35", "00:21"), (2.5, "2.50", "02:30"), (0.0, "0.00", got[3][2]), (60.0, "60.00", "59:59")]


def test_event_order_follows_files(spark, tmp_path):
    """Splits are packed into partitions by size; seq must still follow file names, then lines."""
    n = 0
    for name, size in (("a", 10), ("b", 3000), ("c", 200)):
        with open(tmp_path / f"{name}.json", "w") as f:
            for _ in range(size):
                f.write(json.dumps({"id": n, "matchId": 1}) + "\n")
                n += 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = [r.id for r in ingest.read_events(spark, str(tmp_path)).orderBy("seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(range(n))


def test_landed_entities(spark, tmp_path):
    (tmp_path / "teams.json").write_text(json.dumps({"teams": [{"wyId": 1, "name": "A"}, {"wyId": 2, "name": None}]}))
    (tmp_path / "seasons.json").write_text(json.dumps({"seasons": [{"seasonId": 5, "season": {"wyId": 5, "name": "2025"}}]}))
    (tmp_path / "players.json").write_text(json.dumps({"players": [{"wyId": 7, "shortName": "P"}], "meta": 1}))
    (tmp_path / "competitions.json").write_text("[]")
    read = lambda kind: ingest.read_entities(spark, str(tmp_path / f"{kind}.json"), kind)
    assert [(r.wyId, r.name) for r in read("teams").collect()] == [(1, "A")]
    assert [(r.seasonId, r.season_name) for r in read("seasons").collect()] == [(5, "2025")]
    assert [r.shortName for r in read("players").collect()] == ["P"] and read("competitions").count() == 0
    (tmp_path / "scan").mkdir()
    for i, text in enumerate(('{"wyId": 1, "competitionName": "Liga"}', '{"error": "no access"}', "not json")):
        (tmp_path / "scan" / f"{i}.json").write_text(text)
    assert [r.wyId for r in ingest.accessible_seasons(spark, str(tmp_path / "scan")).collect()] == [1]


def test_schedule_and_lineups(spark, tmp_path):
    game = lambda i, s, date: {
        "matchId": i, "seasonId": s, "label": "A - B, 1-0", "dateutc": date, "team1Id": 1, "team2Id": 2,
        "teamsData": {"1": {"name": "A FC", "teamId": 1}}
    }
    (tmp_path / "s.json").write_text(json.dumps({"matches": [game(1, 9, "2025-02-01 10:00:00"), game(2, 9, "2025-01-01 10:00:00"), game(3, 8, None)]}))
    got = [(r.matchId, r.home, r.away, r.score) for r in ingest.read_schedule(spark, str(tmp_path / "s.json"), 9).collect()]
    assert got == [(2, "A FC", "B", "1-0"), (1, "A FC", "B", "1-0")]
    teams = {"10": {"formation": {"lineup": [{"playerId": 1}], "substitutions": [{"playerIn": 2, "playerOut": 1, "minute": 30}]}}}
    (tmp_path / "l.json").write_text(json.dumps({"matchId": 5, "teamsData": teams}))
    [r] = ingest.read_lineups(spark, str(tmp_path / "l.json")).collect()
    assert (r.match_id, r.team_id, r.lineup, [tuple(s) for s in r.substitutions]) == (5, 10, [1], [(2, 1, 30)])


def test_tables_written_read_and_missing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    for fmt in ("csv", "parquet"):
        ingest.write_table(df, str(tmp_path / f"t.{fmt}"), fmt)
        assert sorted(map(tuple, ingest.read_table(spark, str(tmp_path / f"t.{fmt}"), "x int, y string", fmt).collect())) == [(1, "a"), (2, None)]
    with pytest.raises(FileNotFoundError, match="u.parquet"):
        ingest.load_tables(spark, str(tmp_path), ["t", "u"])
    kept = ingest.load_tables(spark, str(tmp_path), ["t"], keep=True)
    assert kept["t"].is_cached and ingest.inspect(kept)["t"][0] == [("x", "int"), ("y", "string")]
    kept["t"].unpersist()


def test_json_events_and_labels(spark, tmp_path):
    rows = [
        {
            "id": 1, "matchId": 7, "location": {"x": 50, "y": "bad"}, "shot": {"isGoal": True}, "type": {"primary": "shot", "secondary": ["a"]},
            "possession": {"duration": "12.3s"}
        },
        {"id": 2, "matchId": 7, "shot": {"isGoal": "0"}}
    ]
    (tmp_path / "e.json").write_text("\n".join(map(json.dumps, rows)))
    a, b = ingest.read_events(spark, str(tmp_path / "e.json")).orderBy("seq").collect()
    assert (a.location_x, a.location_y, a.shot_isGoal, a.possession_duration, a.type_secondary) == (50.0, None, True, 12.3, ["a"])
    assert b.shot_isGoal is False and b.location_x is None
    df = spark.createDataFrame(
        [("A - B, 2-1", None, None, None, None, "2025-01-01 10:00:00"), ("A - B - C, 1", "X", None, 3.0, 0.0, "bad"), (None, None, None, None, None, None)],
        "label string, data1 string, data2 string, score1 double, score2 double, dateutc string"
    )
    got = [(r.home, r.away, r.score, r.date is None) for r in ingest.parse_label(df).collect()]
    assert got == [("A", "B", "2-1", False), ("X", "Unknown Away", "3 - 0", True), ("Unknown Home", "Unknown Away", "? - ?", True)]
