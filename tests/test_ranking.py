"""Ranks, row numbers and running totals in pieces; roles as data; density curves."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pitchlake.operators import ranking
from pitchlake.operators.relational import best_of, united
from pitchlake.plans import charts, players
from pitchlake.sources.adapter import football_events

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def many_pieces(spark):
    """Small tables would come out of a range sort as one piece."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    out = [("hot", float(rng.randrange(40)), i) for i in range(900)]
    out += [(rng.choice(["a", None, "b"]), rng.choice([None, 1.0, 2.0, -0.5, 7.25]), i) for i in range(900, 1200)]
    return spark.createDataFrame(out, "g string, v double, id int").repartition(7).cache()


def plain_ranks(rows):
    groups = {}
    for g, v, _ in rows:
        groups.setdefault(g, []).append(v)
    out = {}
    for g, v, i in rows:
        known = [x for x in groups[g] if x is not None]
        if v is None:
            out[i] = (None, None, None)
            continue
        below = sum(x < v for x in known)
        out[i] = ((below + 1 + (known.count(v) - 1) / 2) / len(known), 100 * below / len(known), len({x for x in known if x > v}) + 1)
    return out


@pytest.mark.parametrize("most_rows", [None, 900])
def test_ranks(spark, rows, most_rows):
    got = ranking.ranked(
        rows, "v", "g", most_rows=most_rows, avg=ranking.average_share(), pct=ranking.strict_percent(), place=ranking.dense_from_top(), low=F.col("low"), high=F.col("high")
    ).collect()
    assert {r.id: (r.avg, r.pct, r.place) for r in got} == plain_ranks([tuple(r) for r in rows.collect()])
    assert {(r.low, r.high) for r in got if r.g == "hot" } == {(0.0, 39.0)} and {(r.low, r.high) for r in got if r.g == "a" and r.v is not None} == {(-0.5, 7.25)}


def test_no_task_holds_a_group(spark, rows):
    table = ranking.rank_table(rows, "v", "g")
    assert table.where("g = 'hot'").count() == 40
    pieces = ranking.in_pieces(rows.select("g", "v").distinct(), F.col("g"), F.col("v"))
    assert pieces.where("g = 'hot'").select("_piece").distinct().count() > 1  # a group goes over several tasks


def test_row_numbers_and_running_totals(spark, rows):
    got = ranking.running_totals(rows, {"before": "id"}, F.col("v").asc_nulls_last(), F.col("id")).collect()
    want = sorted(([r.v, r.id] for r in rows.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    total = 0
    by_row = {r.row: r for r in got}
    assert sorted(by_row) == list(range(len(want)))
    for i, (_, x) in enumerate(want):
        assert (by_row[i].id, by_row[i].before) == (x, total)
        total += x
    plan = ranking.numbered(rows, F.col("id"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "row_number" not in plan


def test_reverse_blocks_and_empty(spark):
    got = {r.id: r.block for r in ranking.reverse_blocks(spark.range(25), 10, F.desc("id")).collect()}
    assert got == {i: (25 - 1 - i) // 10 + 1 for i in range(25)}
    none = spark.createDataFrame([], "g string, v double")
    assert ranking.numbered(none, F.col("v")).collect() == [] and ranking.ranked(none, "v", "g", p=ranking.average_share()).collect() == []


def test_best_of(spark):
    df = spark.createDataFrame([(1.0, 1.0, None), (-1.0, -2.0, None), (None, 3.0, 4.0), (None, None, 0.0)], "a double, b double, c double")
    assert [r.x for r in df.select(best_of({"A": "a", "B": "b", "C": "c"}).alias("x")).collect()] == ["A", None, "C", "C"]


def test_united(spark):
    a, b = spark.createDataFrame([(1, 2)], "k int, x int"), spark.createDataFrame([(1, "p"), (2, None)], "k int, y string")
    got = {r.k: (r.left and tuple(r.left), r.right and tuple(r.right)) for r in united("k", left=a, right=b).collect()}
    assert got == {1: ((2,), ("p",)), 2: (None, (None,))}


def test_minutes_by_windows_are_those_of_lineups(spark):
    ev = football_events(spark, SF)
    assert sorted(map(tuple, players.played_minutes(ev).collect())) == sorted(map(tuple, players.lineup_minutes(ev).collect()))


def test_roles_from_a_table(spark, tmp_path):
    ev = football_events(spark, SF)
    players.roles_table(spark, players.ROLES).write.parquet(str(tmp_path / "roles"))
    table = spark.read.parquet(str(tmp_path / "roles"))
    scores = sorted(map(tuple, players.archetype_scores(ev).collect()))
    assert sorted(map(tuple, players.archetype_scores(ev, roles=table).collect())) == scores
    many = table.unionByName(table.withColumns({"role_id": F.col("role_id") + 6, "role": F.concat("role", F.lit(" again"))}))
    stats = players.qualified(ev, 90)
    size = lambda roles: len(players.role_rows(stats, roles, 10)._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(many) - size(table.unionByName(table))) < 600
    again = players.archetype_scores(ev, roles=many).where("role like '% again'").collect()
    assert sorted((r.player_id, r.role.removesuffix(" again"), r.total) for r in again) == [(s[0], s[1], s[4]) for s in scores]


@pytest.mark.parametrize("per_archetype", [False, True])
def test_scores_are_the_same_in_pieces_and_by_windows(spark, per_archetype):
    stats, table = players.qualified(football_events(spark, SF), 90), players.roles_table(spark)
    both = [
        sorted(map(str, players.role_scores(players.role_rows(stats, table, n), per_archetype, n).select("player_id", "role", "total", "score", "place").collect()))
        for n in (None, 1000)
    ]
    assert both[0] == both[1]


def test_density_against_the_whole_sum(spark):
    rng = random.Random(3)
    values = [rng.gauss(10, 3) for _ in range(400)] + [rng.gauss(25, 1) for _ in range(150)]
    df = spark.createDataFrame([("g", v) for v in values] + [("one", 4.0), ("same", 1.0), ("same", 1.0), ("g", None)], "g string, value double")
    got = charts.density_curves(df, "g").collect()
    assert {r.g for r in got} == {"g"} and len(got) == charts.POINTS and {r.n for r in got} == {550}
    n, mean = len(values), sum(values) / len(values)
    h = math.sqrt(sum((v - mean) ** 2 for v in values) / (n - 1)) * n**-0.2
    top = max(r.density for r in got)
    for r in got:
        want = sum(math.exp(-0.5 * ((r.x - v) / h) ** 2) for v in values) / (n * h * math.sqrt(2 * math.pi))
        assert abs(r.density - want) < 0.01 * top
    assert min(r.x for r in got) == min(values) and max(r.x for r in got) == pytest.approx(max(values))
