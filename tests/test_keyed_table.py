"""The keyed table: cost of a merge, what readers see, batches that come again, failures in between."""

import os

import pytest

from adjudica.operators import sync
from adjudica.sources import keyed_table as kt
from adjudica.streaming import claims_stream as cs

KIND = "code long, value long, made string"


def table(spark, path, **how):
    return kt.KeyedTable(spark, str(path), KIND, ("code",), **how)


def rows(t, version=None):
    return sorted(map(tuple, t.read(version).collect()))


def some(spark, *values):
    return spark.createDataFrame(values, KIND)


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def many(spark, first, last, step, value):
    return spark.range(first, last, step).selectExpr("id as code", f"id * 7 + {value} as value", "concat('text of row ', id) as made")


def test_newer_rows_win_and_columns_may_be_combined_otherwise(spark, tmp_path):
    t = table(spark, tmp_path, buckets=4, combine={"made": kt.first_written, "value": kt.newest})
    assert rows(t) == []
    assert t.merge(some(spark, (1, 10, "a"), (2, 20, "a"))) == 1
    assert t.merge(some(spark, (2, None, "b"), (3, 30, "b"))) == 2
    assert rows(t) == [(1, 10, "a"), (2, None, "a"), (3, 30, "b")]
    assert rows(t, 1) == [(1, 10, "a"), (2, 20, "a")]
    assert rows(table(spark, tmp_path, buckets=99, combine=t.combine)) == rows(t)  # another reader; buckets are the table's own


def test_a_merge_costs_what_the_changes_cost(spark, tmp_path):
    t = table(spark, tmp_path, buckets=8)
    t.replace(many(spark, 0, 80_000, 1, 0))
    whole = size(tmp_path)
    t.merge(many(spark, 0, 80_000, 100, 1))  # one row in a hundred, in all buckets
    assert size(tmp_path) - whole < whole * 0.06
    assert all(len(p["folders"]) == 2 for p in t._manifest()["parts"].values())
    before = size(tmp_path)
    t.merge(many(spark, 500, 501, 1, 2))
    assert size(tmp_path) - before < 5000
    assert t.read().where("value % 7 = 1").count() == 799 and t.read().count() == 80_000 and t.read().where("value % 7 = 2").count() == 1


def test_only_buckets_with_large_deltas_are_written_anew(spark, tmp_path):
    t = table(spark, tmp_path, buckets=8)
    t.replace(many(spark, 0, 4000, 1, 0))
    hot = t._bucketed(many(spark, 0, 4000, 1, 3)).where("_bucket = 5").drop("_bucket")
    old = t._manifest()["parts"]
    t.merge(hot)
    new = t._manifest()["parts"]
    assert {b for b in new if new[b] != old[b]} == {"5"} and len(new["5"]["folders"]) == 1
    assert t.read().where("value % 7 = 3").count() == hot.count()
    plan = t.read()._jdf.queryExecution().toString()
    assert "Aggregate" not in plan  # nothing is left to merge for readers


def test_readers_keep_their_version(spark, tmp_path):
    t = table(spark, tmp_path, buckets=2)
    t.replace(many(spark, 0, 100, 1, 0))
    held = t.read()
    t.merge(many(spark, 0, 100, 1, 1))
    assert held.where("value % 7 = 0").count() == 100 and t.read().where("value % 7 = 1").count() == 100
    t.vacuum(keep=1)
    assert t.versions() == [2] and t.read().count() == 100
    assert len(os.listdir(tmp_path / "data")) == 1


def test_a_merge_that_fails_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path, buckets=2)
    t.merge(some(spark, (1, 1, "a")), "w", 0)
    monkeypatch.setattr(t, "_commit", lambda manifest: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        t.merge(some(spark, (1, 2, "b")), "w", 1)
    monkeypatch.undo()
    assert rows(t) == [(1, 1, "a")]
    assert t.merge(some(spark, (1, 2, "b")), "w", 1) == 2 and t.merge(some(spark, (1, 3, "c")), "w", 1) is None
    assert rows(t) == [(1, 2, "b")]
    t.vacuum(keep=1)  # what the failed merge wrote goes too
    assert rows(t) == [(1, 2, "b")]


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    one, two = table(spark, tmp_path, buckets=2), table(spark, tmp_path, buckets=2)
    now = two._manifest()
    one.merge(some(spark, (1, 1, "a")))
    monkeypatch.setattr(two, "_manifest", lambda version=None: now)
    with pytest.raises(kt.Conflict):
        two.merge(some(spark, (1, 2, "b")))
    assert rows(one) == [(1, 1, "a")]


def test_rows_that_are_gone(spark, tmp_path):
    t = table(spark, tmp_path, buckets=2, gone="made = 'closed'")
    t.replace(some(spark, *[(k, k, "open") for k in range(20)]))
    t.merge(some(spark, (3, 3, "closed")))
    assert [r[0] for r in rows(t)] == [k for k in range(20) if k != 3]
    t.merge(some(spark, *[(k, k, "closed") for k in range(20)]))
    assert rows(t) == [] and t._manifest()["parts"] == {}


def test_null_and_several_keys(spark, tmp_path):
    t = kt.KeyedTable(spark, str(tmp_path), "a long, b string, n long", ("a", "b"), 3)
    t.merge(spark.createDataFrame([(None, "x", 1), (None, None, 2), (1, None, 3)], "a long, b string, n long"))
    t.merge(spark.createDataFrame([(None, "x", 9)], "a long, b string, n long"))
    assert sorted(map(str, map(tuple, t.read().collect()))) == sorted(map(str, [(None, "x", 9), (None, None, 2), (1, None, 3)]))


def test_checkpoints_grow_with_the_batch(spark, tmp_path):
    sink = cs.CheckpointSink(str(tmp_path / "t"), "claim_id long, stage string, checkpoint_at string", 4)
    sink.keyed(spark).replace(spark.range(50_000).selectExpr("id as claim_id", "'rules' as stage", "'2020-01-01' as checkpoint_at"))
    before = size(tmp_path)
    batch = spark.range(100).selectExpr("id as claim_id", "'rules' as stage", "if(id < 50, '2019-01-01', '2021-01-01') as checkpoint_at")
    for number in (0, 0, 1):
        sink(batch, number)
    assert size(tmp_path) - before < before * 0.2
    assert sink.table(spark).where("checkpoint_at = '2021-01-01'").count() == 50 and sink.table(spark).count() == 50_000


def test_sync_into_a_table(spark, tmp_path):
    kind = "procedure_code long, total_rvu long, status string, updated_on date"
    source = spark.sql("select id as procedure_code, id as total_rvu, if(id < 8, 'ACTIVE', 'OLD') as status, date_add(date'2024-01-01', cast(id as int)) as updated_on from range(10)")
    t = kt.KeyedTable(spark, str(tmp_path), kind, ("procedure_code",), 2)
    log = spark.sql("select 'completed' as sync_status, date'2024-01-06' as completed_on")
    sync.incremental_into(t, source, log)
    assert sorted(r["procedure_code"] for r in t.read().collect()) == [6, 7, 8, 9]
    sync.full_into(t, source)
    assert sorted(r["procedure_code"] for r in t.read().collect()) == list(range(8))
