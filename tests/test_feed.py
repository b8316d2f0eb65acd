"""Feeds, stores and kept results on landed files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pitchlake.plans import match
from pitchlake.sources import feed, ingest
from pitchlake.sources.adapter import football_events
from pitchlake.sources.memo import Memo

SF = "/root/testdata/sf0.001"


def event(i, match_id=None, **more):
    out = {"id": i, "minute": i, "type": {"primary": "pass"}, "pass": {"accurate": "true"}, "location": {"x": 10, "y": "20"}} | more
    return out | ({"matchId": match_id} if match_id is not None else {})


@pytest.fixture
def documents(tmp_path):
    folder = tmp_path / "documents"
    folder.mkdir()
    (folder / "match_11.json").write_text(json.dumps({"events": [event(3), event(1), event(2)], "meta": {}}))
    (folder / "events-12.json").write_text(json.dumps({"matchId": 99, "events": [event(4, 12, shot={"xg": "0.5", "isGoal": 1})]}, indent=2))
    (folder / "13.json").write_text('{"events": [{"id": 5')
    (folder / "14.json").write_text(json.dumps({"events": []}))
    return str(folder)


@pytest.fixture
def lines(tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    rows = [event(3, 11), event(1, 11), event(2, 11), event(4, 99, shot={"xg": "0.5", "isGoal": 1})]
    text = [json.dumps(r) for r in rows]
    (folder / "a.json").write_text("\n".join([*text[:2], "{broken", *text[2:], '{"id": "no number", "matchId": 11}']) + "\n")
    return str(folder)


def test_documents(spark, documents):
    got = feed.read_documents(spark, documents)
    rows = got.events.orderBy("seq").collect()
    assert [(r.matchId, r.id) for r in rows] == [(99, 4), (11, 3), (11, 1), (11, 2)]
    assert rows[0].shot_xg == 0.5 and rows[0].shot_isGoal is True and rows[1].location_y == 20.0
    assert [(r.file.rpartition("/")[2], r.text) for r in got.rejected.collect()] == [("13.json", '{"events": [{"id": 5')]


def test_documents_of_a_line_each(spark, tmp_path):
    folder = tmp_path / "season_7"
    folder.mkdir()
    docs = [{"matchId": 11, "events": [event(3), event(1), event(2)]}, {"events": [event(4, 12, shot={"xg": "0.5"}), event(9)]}, {"matchId": 14, "events": []}]
    lines = [json.dumps(d) for d in docs]
    (folder / "part-77.txt").write_text("\n".join([lines[0], '{"events": [{"id": 5', *lines[1:]]) + "\n")
    (folder / "part-78.txt").write_text(json.dumps({"matchId": 15, "events": [event(6), event(5)]}))
    got = feed.read_documents(spark, str(folder), whole=False)
    rows = got.events.orderBy("seq").collect()
    assert [(r.matchId, r.id, r.seq.row) for r in rows] == [(11, 3, 0), (11, 1, 1), (11, 2, 2), (12, 4, 0), (None, 9, 1), (15, 6, 0), (15, 5, 1)]
    assert rows[3].shot_xg == 0.5 and got.events.columns == feed.read_documents(spark, str(folder)).events.columns
    assert [(r.file.rpartition("/")[2], r.text) for r in got.rejected.collect()] == [("part-77.txt", '{"events": [{"id": 5')]


@pytest.mark.parametrize("query", ["feed_documents", "feed_schedule", "feed_lineups"])
def test_landed_files_do_not_grow_with_the_matches(spark, tmp_path, monkeypatch, query):
    from pitchlake import catalog

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.unionByName(events.withColumn("event_id", F.col("event_id") + 100_000)).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(catalog, "scratch_dir", lambda _: str(tmp_path / "scratch"))
    catalog.QUERIES[query](spark, str(tmp_path)).collect()
    files = [f for _, _, found in os.walk(tmp_path / "scratch") for f in found if f.endswith(".txt")]
    assert 1 <= len(files) <= 4  # not one for each of 20 matches


def test_lines_give_the_same_events(spark, documents, lines):
    got = feed.read_lines(spark, lines)
    names = [c for c in got.events.columns if c != "seq"]
    assert names == [c for c in feed.read_documents(spark, documents).events.columns if c != "seq"]
    plain = lambda df: sorted(map(str, df.select(names).collect()))
    assert plain(got.events) == plain(feed.read_documents(spark, documents).events)
    assert [r.id for r in got.events.where("matchId = 11").orderBy("seq").collect()] == [3, 1, 2]
    assert sorted(r.text for r in got.rejected.collect()) == ["{broken", '{"id": "no number", "matchId": 11}'][::-1] and got.rejected.count() == 2
    assert ingest.read_events(spark, lines).count() == 4


def test_rejected_lines_are_in_no_count(spark, lines):
    assert ingest.read_events(spark, lines).groupBy("matchId").count().where("matchId is null").count() == 0


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "none").mkdir()
    for read in (feed.read_documents, feed.read_lines):
        got = read(spark, str(tmp_path / "none"))
        assert got.events.count() == 0 and got.rejected.count() == 0


def test_missing_matches(spark, documents):
    schedule = spark.createDataFrame([(11, "a"), (13, "b"), (14, "c"), (99, "d")], "matchId long, label string")
    got = feed.missing_matches(schedule, feed.read_documents(spark, documents).events)
    assert sorted(r.label for r in got.collect()) == ["b", "c"]


def changed(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, files in os.walk(path) for f in files if f.endswith(".parquet")}


def test_a_second_load_changes_nothing_and_a_new_match_only_its_partition(spark, documents, tmp_path):
    store = str(tmp_path / "store")
    first = feed.read_documents(spark, documents).events
    feed.append_matches(first, store)
    before, rows = changed(store), sorted(map(str, spark.read.parquet(store).collect()))
    feed.append_matches(first, store)
    assert changed(store) == before and sorted(map(str, spark.read.parquet(store).collect())) == rows
    new = first.withColumn("matchId", F.col("matchId") + 1000).where("matchId = 1011").unionByName(first.where("matchId = 99"))
    feed.append_matches(new, store)
    after = changed(store)
    assert {k: after[k] for k in before} == before
    assert all("matchId=1011" in k for k in after.keys() - before.keys()) and len(after) == len(before) + 1
    # the match's rows again, fewer of them: they take the place of the earlier ones, no other does
    feed.append_matches(first.where("matchId = 11 and id = 1"), store, replace=True)
    assert {r.matchId: r["count"] for r in spark.read.parquet(store).groupBy("matchId").count().collect()} == {11: 1, 99: 1, 1011: 3}
    with pytest.raises(ValueError):
        feed.append_matches(first.withColumn("matchId", F.lit(None).cast("long")), store)


def test_matches_that_share_folders(spark, documents, tmp_path):
    store = str(tmp_path / "store")
    counts = lambda: {r.matchId: r["count"] for r in spark.read.parquet(store).groupBy("matchId").count().collect()}
    first = feed.read_documents(spark, documents).events.drop("seq")
    feed.append_matches(first.limit(0), store, together=50)  # nothing yet
    feed.append_matches(first, store, together=50)
    before = changed(store)
    assert counts() == {11: 3, 99: 1} and sorted(k.split("/")[-2] for k in before) == ["matchId_by50=0", "matchId_by50=1"]
    feed.append_matches(first, store, together=50)
    assert changed(store) == before
    new = first.withColumn("matchId", F.col("matchId") + 1).where("matchId = 12").unionByName(first)
    feed.append_matches(new, store, together=50)
    after = changed(store)
    assert {k: after[k] for k in before} == before and len(after) == 3 and counts() == {11: 3, 12: 3, 99: 1}
    feed.append_matches(first.where("matchId = 11 and id = 1"), store, replace=True, together=50)
    assert counts() == {11: 1, 12: 3, 99: 1}
    far = {k: v for k, v in before.items() if "_by50=1" in k}
    assert {k: v for k, v in changed(store).items() if "_by50=1" in k} == far
    assert spark.read.parquet(store).where("matchId = 99").first().shot_xg == 0.5
    for other in (1, 40):
        with pytest.raises(ValueError):
            feed.append_matches(first, store, together=other)


def test_files_of_a_store_do_not_grow_with_its_matches(spark, tmp_path):
    for n in (200, 400):
        rows = spark.range(5 * n).select((F.col("id") % n).alias("matchId"), "id")
        feed.append_matches(rows, str(tmp_path / f"{n}"), together=500)
        assert len(changed(tmp_path / f"{n}")) == 1 and spark.read.parquet(str(tmp_path / f"{n}")).select("matchId", "id").distinct().count() == 5 * n


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    events = football_events(spark, SF)
    yield feed.store_by_match(events, "stored_events", 4, str(tmp_path_factory.mktemp("bucketed")))
    spark.sql("drop table stored_events")


@pytest.mark.parametrize("report", ["attacks", "possession", "duels", "general", "transitions", "tempo", "open_play"])
def test_reports_over_the_store_need_no_exchange(spark, store, report):
    plan = getattr(match, report)(store)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text.replace("ReusedExchange", "").replace("BroadcastExchange", "") and "Bucketed: true" in text
    plain = getattr(match, report)(football_events(spark, SF))
    assert sorted(map(str, plan.collect())) == sorted(map(str, plain.select(plan.columns).collect()))


def jobs(spark, group, action):
    spark.sparkContext.setJobGroup(group, group)
    action()
    spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_memo(spark, tmp_path):
    path, built = str(tmp_path / "t.parquet"), []
    spark.range(10).write.parquet(path)

    def build(least):
        built.append(least)
        return spark.read.parquet(path).where(F.col("id") >= least)

    memo = Memo(spark, most=2)
    first = memo.get("rows", build, [path], least=3)
    assert first.count() == 7
    assert jobs(spark, "memo", lambda: memo.get("rows", build, [path], least=3)) == 0 and built == [3]
    assert memo.get("rows", build, [path], least=3) is first
    spark.range(10, 12).write.mode("append").parquet(path)
    assert memo.get("rows", build, [path], least=3).count() == 9 and built == [3, 3]
    assert not first.is_cached
    memo.get("rows", build, [path], least=4)
    oldest = memo.get("rows", build, [path], least=3)
    memo.get("rows", build, [path], least=5)  # the one for 4 leaves
    assert built == [3, 3, 4, 5] and oldest.is_cached and len(memo.kept) == 2
    memo.get("rows", build, [path], least=4)
    assert built[-1] == 4
    memo.clear()
    assert not oldest.is_cached
