"""Snapshots: only touched partitions are rewritten, readers see whole snapshots, lost races fail."""

import pytest
from pyspark.sql import functions as F

from veilspark.operators import registry as R
from veilspark.sources import pointer
from veilspark.sources.snapshots import SnapshotTable


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(200).select("id", F.lit("old").alias("status"), F.col("id").cast("string").alias("note.of"))
    return SnapshotTable.create(spark, str(tmp_path / "t"), rows, "id", buckets=16)


def status(df):
    return {r.id: r.status for r in df.collect()}


def test_only_touched_partitions_are_rewritten(spark, table):
    first = table.current()[1]
    assert len(first.parts) == 16 and table.rows().count() == 200
    s = table.apply(spark.createDataFrame([(3, "new")], "id long, status string"), "one")
    assert len(s.rewritten) == 1 and s.number == 2
    assert {k: v for k, v in s.parts.items() if k not in s.rewritten} == {k: v for k, v in first.parts.items() if k not in s.rewritten}
    assert status(table.rows()) == {i: "new" if i == 3 else "old" for i in range(200)}
    assert status(table.rows(1)) == {i: "old" for i in range(200)}
    assert {r["note.of"] for r in table.rows().collect()} == {str(i) for i in range(200)}


def test_a_chain_of_jobs(spark, table):
    for k in range(3):
        table.apply(table.rows().where(F.col("id") % 40 == k).select("id", F.concat("status", F.lit(f"-{k}")).alias("status")), f"job {k}")
    assert [s.job for s in table.history()] == ["job 2", "job 1", "job 0", "create"] and all(len(s.rewritten) <= 5 for s in table.history()[:3])
    assert status(table.rows()) == {i: f"old-{i % 40}" if i % 40 < 3 else "old" for i in range(200)}


def test_readers_keep_the_snapshot_they_opened(spark, table):
    before = table.rows()
    table.apply(table.rows().select("id", F.lit("all").alias("status")), "all")
    assert set(status(before).values()) == {"old"} and set(status(table.rows()).values()) == {"all"}


def test_keys_that_the_table_lacks(spark, table):
    more = spark.createDataFrame([(500, "x"), (None, "n"), (7, "y")], "id long, status string")
    table.apply(more, "without")
    assert table.rows().count() == 200 and status(table.rows())[7] == "y"
    table.apply(more, "with", insert=True)
    got = status(table.rows())
    assert len(got) == 202 and got[500] == "x" and got[None] == "n" and table.rows().where("id = 500").first()["note.of"] is None
    table.apply(spark.createDataFrame([(None, "again")], "id long, status string"), "null key")
    assert status(table.rows())[None] == "again" and table.rows().count() == 202


def test_nothing_to_do_makes_no_snapshot(spark, table):
    assert table.apply(table.rows().limit(0).select("id", "status"), "none").number == 1
    assert len(table.history()) == 1
    with pytest.raises(ValueError, match="no snapshot 2"):
        table.rows(2)


def test_refused_changes(spark, table):
    with pytest.raises(ValueError, match="two changes"):
        table.apply(spark.createDataFrame([(1, "a"), (1, "b")], "id long, status string"), "twice")
    with pytest.raises(ValueError, match="no columns"):
        table.apply(spark.createDataFrame([(1, "a")], "id long, other string"), "other")
    assert len(table.history()) == 1


def test_an_overtaken_writer_fails(spark, table, monkeypatch):
    held = table.current()
    table.apply(spark.createDataFrame([(1, "first")], "id long, status string"), "first")
    slow = SnapshotTable(spark, table.root)
    monkeypatch.setattr(slow, "current", lambda: held)
    with pytest.raises(RuntimeError):
        slow.apply(spark.createDataFrame([(2, "second")], "id long, status string"), "second")
    assert status(table.rows())[1] == "first" and status(table.rows())[2] == "old"


def test_no_table(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        SnapshotTable(spark, str(tmp_path / "none")).rows()
    empty = SnapshotTable.create(spark, str(tmp_path / "empty"), spark.range(0), "id")
    assert empty.rows().count() == 0 and pointer.read(spark, empty.root)


def test_rollback_moves_requests_and_versions(spark, tmp_path):
    versions = SnapshotTable.create(spark, str(tmp_path / "v"), spark.createDataFrame([(1, "active"), (2, "rolled_back"), (3, "revoked"), (4, "active")], "version_id long, status string"), "version_id", 4)
    requests = SnapshotTable.create(spark, str(tmp_path / "r"), spark.createDataFrame([(10, 1), (11, 4), (12, 4)], "request_id long, version_id long"), "request_id", 4)
    R.rollback_job(versions, requests, spark.createDataFrame([(10, 2), (11, 3), (12, 1)], "request_id long, target long"))
    assert {r.version_id: r.status for r in versions.rows().collect()} == {1: "active", 2: "active", 3: "revoked", 4: "active"}
    assert {r.request_id: r.version_id for r in requests.rows().collect()} == {10: 2, 11: 4, 12: 1}
