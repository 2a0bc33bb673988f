"""The change feed by ids: order, batches, resuming, names."""

import pytest
from pyspark.sql import functions as F

from adjudica.sources.id_feed import follow, id_feed, identifier

KIND = "claim_id long, note string"


def grow(spark, path, first, last):
    rows = spark.range(first, last).select(F.col("id").alias("claim_id"), F.concat(F.lit("n"), "id").alias("note"), F.lit(1).alias("unused"))
    rows.orderBy(F.xxhash64("claim_id")).coalesce(2).write.mode("append").parquet(f"{path}/claims")


def run(spark, path, seen, most=0, fail_at=None, **how):
    def each(batch, number):
        own = [(r["claim_id"], r["note"]) for r in batch.collect()]
        if number == fail_at:
            raise RuntimeError("sink is down")
        if own:
            seen.append(own)

    return follow(id_feed(spark, str(path), "claims", "claim_id", KIND, f"{path}/offsets", most, **how), each, f"{path}/offsets")


def test_batches_in_id_order_and_resuming(spark, tmp_path):
    seen = []
    grow(spark, tmp_path, 0, 250)
    run(spark, tmp_path, seen, 100)
    assert [len(b) for b in seen] == [100, 100, 50]
    assert [r for b in seen for r in b] == [(k, f"n{k}") for k in range(250)]  # across partitions and batches
    seen.clear()
    run(spark, tmp_path, seen, 100)
    assert seen == []
    grow(spark, tmp_path, 250, 300)
    grow(spark, tmp_path, 300, 400)
    run(spark, tmp_path, seen, 100)
    assert [r[0] for b in seen for r in b] == list(range(250, 400))


def test_a_batch_that_failed_comes_again(spark, tmp_path):
    seen = []
    grow(spark, tmp_path, 0, 90)
    with pytest.raises(Exception, match="sink is down"):
        run(spark, tmp_path, seen, 30, fail_at=1)
    assert [r[0] for b in seen for r in b] == list(range(30))
    run(spark, tmp_path, seen, 30)
    assert [r[0] for b in seen for r in b] == list(range(90))


def test_starting_id_and_rows_without_one(spark, tmp_path):
    seen = []
    spark.createDataFrame([(None, "x"), (3, "a"), (9, None)], KIND).coalesce(1).write.parquet(f"{tmp_path}/claims")
    run(spark, tmp_path, seen, starting_id=3)
    assert seen == [[(9, None)]]


def test_an_empty_table(spark, tmp_path):
    seen = []
    spark.createDataFrame([(None, "x")], KIND).limit(0).write.parquet(f"{tmp_path}/claims")
    run(spark, tmp_path, seen)
    assert seen == []


@pytest.mark.parametrize("name", ["", "1a", "a b", "a;drop table b", "a.b", "a-b", "../x", "é"])
def test_names_are_checked(spark, tmp_path, name):
    with pytest.raises(ValueError):
        identifier(name)
    with pytest.raises(ValueError):
        id_feed(spark, str(tmp_path), name, "claim_id", KIND, "c")
    with pytest.raises(ValueError):
        id_feed(spark, str(tmp_path), "claims", name, KIND, "c")
    assert identifier("claim_id2") == "claim_id2"
