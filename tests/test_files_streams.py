"""Files, archives, generated claims and streams."""

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from adjudica.model import adapter
from adjudica.model.schemas import SCHEMAS
from adjudica.sources import files, generator
from adjudica.streaming import claims_stream as cs

SCHEMA = "claim_id int, patient_account_number string, service_to_date date"


def claims(spark):
    return spark.createDataFrame([(1, "123", date(2020, 1, 1)), (2, None, date(2024, 5, 1)), (3, "9", None)], SCHEMA)


def test_archive_round_trip(spark, tmp_path):
    path = str(tmp_path / "archive")
    old, live = files.split_by_age(claims(spark), F.lit(date(2021, 1, 1)))
    assert [r[0] for r in old.collect()] == [1] and sorted(r[0] for r in live.collect()) == [2, 3]
    files.archive(old, path, "k")
    line = spark.read.text(path).first()["value"]
    assert "claim_id" not in line and (tmp_path / "archive" / "year=2020" / "month=01").exists()
    assert [tuple(r) for r in files.restore(spark, path, "k", old.schema).collect()] == [(1, "123", date(2020, 1, 1))]


def test_queue_csv_and_tables(spark, tmp_path):
    files.queue_claims(claims(spark), str(tmp_path / "q"))
    assert sorted(map(tuple, files.replay_claims(spark, str(tmp_path / "q"), claims(spark).schema).collect())) == sorted(map(tuple, claims(spark).collect()))
    (tmp_path / "t.csv").write_text("procedure_code,financial_class,primary_diagnosis,label\nABC,X,D,1\n")
    assert tuple(files.read_training_csv(spark, str(tmp_path / "t.csv")).first()) == ("ABC", "X", "D", 1)
    files.write_by_year(claims(spark), str(tmp_path / "y"))
    own = spark.read.parquet(str(tmp_path / "y"))
    assert sorted(r["claim_id"] for r in files.retained(own, F.lit(date(2025, 1, 1)), 2).collect()) == [2]
    assert "PartitionFilters: [isnotnull(service_year" in own.where("service_year >= 2023")._jdf.queryExecution().toString()
    listing = spark.createDataFrame([("claims_2001_01_01.jsonl",), ("claims_2024_01_01.jsonl",), ("other",), ("claims_2001_13_01.jsonl",)], "name string")
    assert [r[0] for r in files.purgeable(listing, F.lit(date(2025, 1, 1))).collect()] == ["claims_2001_01_01.jsonl"]


def test_generator(spark):
    made, lines, diagnoses = generator.generate_claims(spark, 3000)
    n = lines.count() / 3000
    assert made.count() == 3000 and 1.9 < n < 2.3 and 1.6 < diagnoses.count() / 3000 < 1.9
    bad = made.where("service_to_date < service_from_date or date_of_birth > service_from_date").count()
    total = lines.agg(F.sum("charge_amount")).first()[0]
    assert bad == 0 and made.agg(F.sum("total_charge_amount")).first()[0] == total > Decimal(0)
    assert lines.where("procedure_code like '99%' and (charge_amount / units < 200 or charge_amount / units > 600)").count() == 0
    assert made.exceptAll(generator.generate_claims(spark, 3000)[0]).count() == 0


def test_streams(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    claims(spark).write.parquet(source)
    run = lambda: cs.drain(cs.cdc_source(spark, source, claims(spark).schema), cs.batch_sink(sink, lambda b: b.select("claim_id")), str(tmp_path / "offsets"))
    run()
    spark.createDataFrame([(4, "x", None)], SCHEMA).write.mode("append").parquet(source)
    run()
    assert sorted(r["claim_id"] for r in spark.read.parquet(sink).collect()) == [1, 2, 3, 4]
    old = spark.createDataFrame([(1, "ml", "2020-01-01"), (1, "rules", "2020-01-01")], "claim_id int, stage string, checkpoint_at string")
    new = spark.createDataFrame([(1, "ml", "2020-01-03")], "claim_id int, stage string, checkpoint_at string")
    assert sorted(map(tuple, cs.checkpoints(old, new).collect())) == [(1, "ml", "2020-01-03"), (1, "rules", "2020-01-01")]


def test_pattern_watch(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    kind = "errors array<string>, created_at timestamp"
    make = lambda *rows: spark.createDataFrame([(list(e), datetime(2024, 1, d, h)) for e, d, h in rows], kind).coalesce(1).write.mode("append").parquet(source)

    def run():
        counts = cs.error_windows(cs.cdc_source(spark, source, spark.createDataFrame([], kind).schema), "1 day", watermark="2 days")
        query = cs.pattern_watch(counts, 2, lambda b, n: seen.extend((r["start"].day, r["error"], r["n"]) for r in b.collect()), str(tmp_path / "offsets"), "1 second")
        query.processAllAvailable()
        query.stop()

    make(("ab", 1, 3), ("a", 1, 23), ("b", 2, 0))
    run()
    assert seen == [(1, "a", 2)]
    make(("b", 2, 5), ("b", 9, 5), ("a", 1, 5))
    run()  # goes on with the counts of before; only stretches that changed are looked at
    assert sorted(seen) == [(1, "a", 2), (1, "a", 3), (2, "b", 2)]
    make(("a", 1, 6), ("b", 9, 7))
    run()  # the first day lies behind the watermark now
    assert sorted(seen) == [(1, "a", 2), (1, "a", 3), (2, "b", 2), (9, "b", 2)]


def test_orders_may_stream_in(spark, tmp_path, sf, monkeypatch):
    """Streams have no files to measure; claims made of one are joined over as many tasks as the table of orders needs."""
    orders = lambda: cs.cdc_source(spark, f"{sf}/orders.parque[t]", spark.read.parquet(f"{sf}/orders.parquet").schema)
    assert files.tasks_for(orders()) == 0
    for setting, value in (("TASK_BYTES", 100_000), ("DEALT_FROM", 0)):
        monkeypatch.setattr(files, setting, value)
    assert files.tasks_for(orders()) == 0
    plan = adapter.claims(spark, sf, orders())._jdf.queryExecution().analyzed().toString()
    n = files.tasks_for(spark.read.parquet(f"{sf}/orders.parquet"))
    assert n > 1 and "RepartitionByExpression [c_custkey" in plan and f"], {n}" in plan
    sink = cs.batch_sink(str(tmp_path / "out"), lambda b: b)
    cs.drain(adapter.claims(spark, sf, orders()), sink, str(tmp_path / "offsets"))
    assert spark.read.parquet(str(tmp_path / "out")).drop("batch").exceptAll(adapter.claims(spark, sf)).count() == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == adapter.claims(spark, sf).count() > 0


def test_schemas(spark, tmp_path):
    spark.range(1).select(F.col("id").alias("claim_id")).write.parquet(str(tmp_path / "c"))
    assert len(SCHEMAS) == 16
    for ddl in SCHEMAS.values():
        assert files.read_table(spark, str(tmp_path / "c"), ddl).count() == 1


def test_queue_stays_where_the_commit_fails(spark, tmp_path):
    queue, schema = str(tmp_path / "q"), claims(spark).schema
    files.queue_claims(claims(spark), queue)

    def broken(df):
        raise RuntimeError("database is down")

    try:
        files.drain_queue(spark, queue, schema, broken)
    except RuntimeError:
        pass
    assert files.replay_claims(spark, queue, schema).count() == 3
    files.drain_queue(spark, queue, schema, lambda df: df.write.parquet(str(tmp_path / "done")))
    assert files.replay_claims(spark, queue, schema).count() == 0 and spark.read.parquet(str(tmp_path / "done")).count() == 3


def test_checkpoint_sink_goes_on_after_a_restart(spark, tmp_path):
    kind = "claim_id int, stage string, checkpoint_at string"
    source, sink = str(tmp_path / "in"), cs.CheckpointSink(str(tmp_path / "out"), kind)
    run = lambda: cs.drain(cs.cdc_source(spark, source, spark.createDataFrame([], kind).schema), sink, str(tmp_path / "offsets"))
    for rows in ([(1, "ml", "2020-01-02"), (1, "rules", "2020-01-01")], [(1, "ml", "2020-01-01"), (2, "ml", "2020-01-05")]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        run()
    got = cs.CheckpointSink(str(tmp_path / "out"), kind).table(spark)
    assert sorted(map(tuple, got.collect())) == [(1, "ml", "2020-01-02"), (1, "rules", "2020-01-01"), (2, "ml", "2020-01-05")]


def test_tables_of_a_database(spark):
    """Over JDBC, with the database that comes with Spark, in memory."""
    own = claims(spark).withColumn("part", F.col("claim_id") * 10)
    url = {"url": "jdbc:derby:memory:claims;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    files.bulk_load(own, "claims", **url)
    files.bulk_load(own, "claims", **url)
    read = files.read_table(spark, "claims", own.schema, partitionColumn="part", lowerBound="0", upperBound="40", numPartitions="3", **url)
    assert read.rdd.getNumPartitions() == 3 and sorted(map(tuple, read.select(*own.columns).collect()), key=str) == sorted(map(tuple, [*own.collect(), *own.collect()]), key=str)


def test_archives_are_listed_by_name_and_time(spark, tmp_path):
    path = str(tmp_path / "a")
    files.write_archives(claims(spark), path, "k")
    (tmp_path / "a" / "claims_1999_05_01.jsonl").write_text("one file")
    (tmp_path / "a" / "notes.txt").write_text("not an archive")
    listing = files.list_archives(spark, path)
    assert sorted((r["name"], r["files"]) for r in listing.collect()) == [("claims_1999_05_01.jsonl", 1), ("claims_2020_01_01.jsonl", 1), ("claims_2024_05_01.jsonl", 1), ("claims_undated.jsonl", 1)]
    assert "content" not in listing._jdf.queryExecution().executedPlan().toString()
    gone = files.purge_archives(spark, path, "2026-01-01", 5)
    assert sorted(r["name"] for r in gone.collect()) == ["claims_1999_05_01.jsonl", "claims_2020_01_01.jsonl"]
    assert sorted(r["name"] for r in files.list_archives(spark, path).collect()) == ["claims_2024_05_01.jsonl", "claims_undated.jsonl"]
    assert files.purge_archives(spark, path, "2026-01-01", 5).count() == 0
