"""Feeds that are joined as they move, late rows, dead letters, runs that break off; bucketed tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from adjudica.model import adapter
from adjudica.operators import enrichment, flow, outcomes
from adjudica.plans import flow_queries
from adjudica.sources.keyed_table import KeyedTable
from adjudica.streaming import claims_stream as cs
from adjudica.streaming import claims_with_lines as cl
from adjudica.streaming import dead_letters

CLAIM = "claim_id long, note string, arrived_at timestamp"
LINE = "claim_id long, line_number int, procedure_code long, units int, charge_amount decimal(12,2), service_from_date date, service_to_date date, arrived_at timestamp"
DAY = datetime(2024, 1, 1)


def rvu(spark):
    return spark.createDataFrame([(1, 2, "ACTIVE"), (2, 3, "ACTIVE")], "procedure_code long, total_rvu int, status string").withColumn("total_rvu", F.col("total_rvu").cast("decimal(10,5)"))


def at(day):
    return DAY + timedelta(days=day)


def claim(k, day):
    return (k, f"claim {k}", at(day))


def line(k, n, day, code=1):
    return (k, n, code, 1, None, at(day).date(), at(day + 1).date(), at(day))


class Feeds:
    def __init__(self, spark, path):
        self.spark, self.path, self.got = spark, path, {}

    def add(self, claims=(), lines=(), mark=None):
        for name, rows, kind in (("claims", claims, CLAIM), ("lines", lines, LINE)):
            if rows:
                self.spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")
            if mark is not None:
                cl.heartbeat(self.spark, f"{self.path}/{name}", self.spark.createDataFrame([], kind), "arrived_at", at(mark), **({"claim_id": 0} if name == "lines" else {}))

    def run(self, fail_at=None, nested=False):
        stream = lambda name, kind: cs.cdc_source(self.spark, f"{self.path}/{name}", self.spark.createDataFrame([], kind).schema, 1)

        def each(batch, number):
            rows = [(r["claim_id"], r["n_lines"], r["first_from"], r["last_to"], None if r["revenue"] is None else float(r["revenue"]), *([r["line_items"]] if nested else [])) for r in batch.collect()]
            if number == fail_at:
                raise RuntimeError("sink is down")
            self.got[number] = rows

        return cl.process(stream("claims", CLAIM), stream("lines", LINE), rvu(self.spark), each, f"{self.path}/offsets", within="10 days", delay="1 day", nested=nested)

    def all(self):
        return sorted(row for rows in self.got.values() for row in rows)


def test_lines_wait_for_claims_and_claims_for_lines(spark, tmp_path):
    feeds = Feeds(spark, tmp_path)
    feeds.add([claim(1, 0), claim(2, 1)], [line(1, 1, 1), line(1, 2, 2, 9)])
    feeds.add([claim(3, 5)], [line(2, 1, 6, 2), line(2, 1, 6, 2)])
    feeds.add([claim(4, 30)], [line(3, 1, 30), line(4, 1, 31)])
    feeds.add(mark=400)
    query = feeds.run()
    paid = 2 * float(enrichment.FACTOR)
    assert feeds.all() == [
        (1, 2, at(1).date(), at(3).date(), paid), (2, 2, at(6).date(), at(7).date(), 3 * paid), (3, None, None, None, None), (4, 1, at(31).date(), at(32).date(), paid),
    ]
    assert len([rows for rows in feeds.got.values() if rows]) > 1
    # every row of both feeds is read once, in as many batches as there are files, and nothing stays in state but the marks
    read = [p["numInputRows"] for p in query.recentProgress]
    assert sum(read) == 4 + 6 + 2 and len([n for n in read if n]) == 4
    assert [o["numRowsTotal"] for o in query.recentProgress[-1]["stateOperators"]] == [0, 2]


def test_a_run_that_breaks_off_goes_on(spark, tmp_path):
    feeds = Feeds(spark, tmp_path)
    feeds.add([claim(k, k) for k in range(20)], [line(k, 1, k + 1) for k in range(0, 20, 2)])
    feeds.add([claim(k, k) for k in range(20, 40)], [line(k, 1, k + 1) for k in range(20, 40, 2)])
    feeds.add([claim(k, k) for k in range(40, 60)], [line(k, 1, k + 1) for k in range(40, 60, 2)])
    with pytest.raises(Exception, match="sink is down"):
        feeds.run(fail_at=2)
    held = feeds.all()
    assert max(feeds.got) == 1
    feeds.add(mark=400)
    feeds.run()
    assert held == [row for row in feeds.all() if row in held]
    assert [(r[0], r[1]) for r in feeds.all()] == [(k, 1 if k % 2 == 0 else None) for k in range(60)]


def test_nested_lines_come_with_their_claim(spark, tmp_path):
    feeds = Feeds(spark, tmp_path)
    feeds.add([claim(1, 0), claim(2, 0)], [line(1, 2, 1), line(1, 1, 1)], mark=400)
    feeds.run(nested=True)
    (_, _, _, _, _, items), (*_, none) = feeds.all()
    assert [i["line_number"] for i in items] == [1, 2] and tuple(items[0].asDict()) == enrichment.LINE and none is None


def test_waiting_rows_lie_outside_the_heap(spark, tmp_path):
    feeds = Feeds(spark, tmp_path)
    feeds.add([claim(1, 0)], [line(1, 1, 1)], mark=400)
    told = feeds.run().recentProgress[-1]["stateOperators"]
    assert len(told) == 2 and all(any("rocksdb" in name.lower() for name in o["customMetrics"]) for o in told)
    assert all(spark.conf.get(name, None) != value for name, value in cl.STATE.items())  # the session's own stay


class Files(Feeds):
    """The same feeds through process_backlog."""

    def run(self, fail_at=None, nested=False):
        stream = lambda name, kind: cs.cdc_source(self.spark, f"{self.path}/{name}", self.spark.createDataFrame([], kind).schema, 1)

        def each(batch, number):
            rows = [(r["claim_id"], r["note"], r["n_lines"], r["first_from"], r["last_to"], None if r["revenue"] is None else float(r["revenue"]), *([r["line_items"]] if nested else [])) for r in batch.collect()]
            if number == fail_at:
                raise RuntimeError("sink is down")
            self.got[number] = rows

        return cl.process_backlog(stream("claims", CLAIM), stream("lines", LINE), rvu(self.spark), each, f"{self.path}/marks", f"{self.path}/offsets", within="10 days", delay="1 day", nested=nested)

    def waiting(self, number):
        return self.spark.read.schema(cl.MARK).parquet(f"{self.path}/marks/batch={number}").where("file is not null").count()


def test_a_backlog_waits_in_its_files(spark, tmp_path):
    feeds = Files(spark, tmp_path / "a folder%20of files")
    feeds.add([claim(1, 0), claim(2, 1)], [line(1, 1, 1), line(1, 2, 2, 9)])
    feeds.add([claim(3, 5)], [line(2, 1, 6, 2), line(2, 1, 6, 2), line(2, 2, 12)])  # the last one comes too long after its claim
    feeds.add([claim(4, 30), claim(None, 30)], [line(3, 1, 30), line(4, 1, 31), line(None, 1, 30)])
    query = feeds.run()
    held = feeds.all()
    paid = 2 * float(enrichment.FACTOR)
    assert held == [(1, "claim 1", 2, at(1).date(), at(3).date(), paid), (2, "claim 2", 2, at(6).date(), at(7).date(), 3 * paid), (3, "claim 3", None, None, None, None)]
    assert [len(feeds.got.get(k, [])) for k in range(3)] == [0, 0, 3] and [feeds.waiting(k) for k in range(3)] == [2, 4, 2]
    feeds.add([claim(5, 28)], [line(4, 2, 35)])  # late: all up to day 29 had come
    feeds.add(mark=400)
    query = feeds.run()
    assert [row for row in feeds.all() if row not in held] == [(4, "claim 4", 2, at(31).date(), at(36).date(), 2 * paid)]
    assert feeds.waiting(max(feeds.got)) == 2  # the marks
    assert all(p["stateOperators"] == [] for p in query.recentProgress)


def test_a_backlog_that_breaks_off_goes_on(spark, tmp_path):
    feeds = Files(spark, tmp_path)
    for k in (0, 20, 40):
        feeds.add([claim(k, k) for k in range(k, k + 20)], [line(k, 1, k + 1) for k in range(k, k + 20, 2)])
    with pytest.raises(Exception, match="sink is down"):
        feeds.run(fail_at=2)
    held = feeds.all()
    assert max(feeds.got) == 1 and held
    feeds.add(mark=400)
    feeds.run()
    assert held == [row for row in feeds.all() if row in held]
    assert [(r[0], r[2]) for r in feeds.all()] == [(k, 1 if k % 2 == 0 else None) for k in range(60)]


def test_nested_lines_of_a_backlog(spark, tmp_path):
    feeds = Files(spark, tmp_path)
    feeds.add([claim(1, 0), claim(2, 0)], [line(1, 2, 1), line(1, 1, 1)], mark=400)
    feeds.run(nested=True)
    (*_, items), (*_, none) = feeds.all()
    assert [i["line_number"] for i in items] == [1, 2] and tuple(items[0].asDict()) == enrichment.LINE and none is None


def test_a_backlog_with_one_side_waits(spark, tmp_path):
    feeds = Files(spark, tmp_path)
    feeds.add([claim(1, 0)], [])
    feeds.add([claim(2, 300)], [])
    spark.createDataFrame([], LINE).write.parquet(f"{tmp_path}/lines")
    feeds.run()
    assert feeds.all() == []  # nothing tells how far the lines are
    feeds.add([], [line(1, 1, 5)])
    feeds.add(mark=400)
    feeds.run()
    assert [(r[0], r[2]) for r in feeds.all()] == [(1, 1), (2, None)]


def test_the_query_looks_up_no_row_in_a_state_store(spark, monkeypatch):
    told, whole = [], cl.drain
    monkeypatch.setattr(cl, "drain", lambda *args: told.append(whole(*args)))
    small = "/root/testdata/sf0.001"
    flow_queries.stream_process(spark, small)
    assert all(p["stateOperators"] == [] for p in told[0].recentProgress)
    rows = flow.pending(adapter.claims(spark, small)).count() + adapter.lines(spark, small).count()
    assert len(told[0].recentProgress) > 2 and sum(p["numInputRows"] for p in told[0].recentProgress) == rows + 2


def test_a_feed_computes_its_rows_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    rows = spark.range(30).mapInPandas(counted, "id long").withColumn("arrived_at", F.lit(DAY) + F.make_dt_interval(F.col("id").cast("int")))
    cl.write_feed(rows, str(tmp_path / "in"), [at(10), at(20)], 2)
    assert seen.value == 30 and spark.read.parquet(str(tmp_path / "in")).count() == 30
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    days = [[r["id"] // 10 for r in spark.read.parquet(str(f)).collect()] for f in files]
    assert [set(d) for d in days] == [{0}, {0}, {1}, {1}, {2}, {2}] and not (tmp_path / "in-by-period").exists()


EVENT = "event_id long, name string, at timestamp, value double"


def test_late_events_are_counted(spark, tmp_path):
    add = lambda *rows: spark.createDataFrame([(k, "m", DAY + timedelta(hours=h), 1.0) for k, h in rows], EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    hours = KeyedTable(spark, f"{tmp_path}/hours", "hour timestamp, name string, processed long, total double", ("hour", "name"), 2)
    late = KeyedTable(spark, f"{tmp_path}/late", "batch long, late_rows long", ("batch",), 1)
    run = lambda: cs.run_counted_hours(cs.cdc_source(spark, f"{tmp_path}/in", spark.createDataFrame([], EVENT).schema, 1), hours, late, f"{tmp_path}/offsets")
    add((1, 0.1), (2, 0.9), (3, 5.5), (3, 5.5))
    add((10, 5.6))
    add((4, 6.2), (5, 0.5), (6, 0.6), (7, 3.9))  # three of them late: the watermark stood at 4.5 h before the batch before
    run()
    add((8, 30.0), (9, 1.0), (3, 5.5))  # after a restart; 9 is late, 3 comes once more
    run()
    assert sorted((r["hour"].hour, r["processed"], r["total"]) for r in hours.read().collect()) == [(0, 2, 2.0), (5, 2, 2.0), (6, 1, 1.0)]
    assert late.read().agg(F.sum("late_rows")).first()[0] == 4


def letter(k, claim_id, hour):
    return (k, claim_id, "why", DAY + timedelta(hours=hour))


LETTER = "dlq_id long, claim_id long, error_reason string, inserted_at timestamp"


@pytest.mark.parametrize("broken", ["inserted", "letters"])
def test_dead_letters_are_settled_once(spark, tmp_path, monkeypatch, broken):
    sink = dead_letters.DeadLetters(spark, str(tmp_path), 3, 2)
    first = spark.createDataFrame([letter(1, 10, 4), letter(2, None, 1), letter(3, 11, 2), letter(4, 12, 3)], LETTER)
    table, calls = getattr(sink, broken), []
    whole = table.merge

    def fails(changes, writer=None, batch=None):
        if writer == sink.name and not calls:
            calls.append(batch)
            raise RuntimeError("lost")
        return whole(changes, writer, batch)

    monkeypatch.setattr(table, "merge", fails)
    with pytest.raises(RuntimeError):
        sink(first, 0)
    sink(first, 0)  # the engine runs the batch again
    sink(first, 0)
    ids = lambda rows, key="dlq_id": sorted(r[key] for r in rows.collect())
    assert ids(sink.inserted.read(), "claim_id") == [11, 12] and ids(sink.failed()) == [2] and ids(sink.waiting()) == [1]
    sink(spark.createDataFrame([letter(5, 10, 0)], LETTER), 1)
    assert sorted(map(tuple, sink.inserted.read().collect())) == [(10, 5), (11, 3), (12, 4)] and ids(sink.waiting()) == [] and ids(sink.failed()) == [2]


def test_dead_letters_as_a_stream(spark, tmp_path):
    for rows in ([letter(1, 10, 1), letter(2, None, 2)], [letter(3, 11, 3)]):
        spark.createDataFrame(rows, LETTER).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    sink = dead_letters.DeadLetters(spark, str(tmp_path / "t"), 1, 2)
    dead_letters.run(cs.cdc_source(spark, f"{tmp_path}/in", spark.createDataFrame([], LETTER).schema, 1), sink, f"{tmp_path}/offsets")
    assert [r["dlq_id"] for r in sink.waiting().collect()] == [3] and sink.failed().count() == 1 and sink.inserted.read().count() == 1
    sink.settle(2)
    assert sink.waiting().count() == 0


def test_bucketed_tables_are_joined_where_they_lie(spark, tmp_path):
    claims = spark.range(500).selectExpr("id as claim_id", "cast(id % 7 as int) as facility_id", "cast(id as string) as patient_account_number", "'pending' as processing_status", "date'2024-01-01' as service_from_date", "date'2024-01-01' as service_to_date")
    lines = spark.range(1500).selectExpr("id % 500 as claim_id", "cast(1.5 as decimal(12,2)) as charge_amount")
    own = [outcomes.save_bucketed(df, f"bucketed_{name}", str(tmp_path / name), 4) for name, df in (("claims", claims), ("lines", lines))]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = outcomes.process_shards(*own, 4)
        plan = done._jdf.queryExecution().executedPlan().toString()
        below = plan.split("SortMergeJoin")[1]
        assert "Exchange" not in below and plan.count("Exchange") == 1
        got = done.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table bucketed_claims")
        spark.sql("drop table bucketed_lines")
    assert sum(r["accepted"] for r in got) == 500 and sum(r["lines"] for r in got) == 1500 and sum(r["charges"] for r in got) == 2250.0


def test_a_run_tells_of_itself(spark, tmp_path):
    kind = "claim_id long, patient_account_number string, facility_id int, service_from_date date, total_charge_amount decimal(12,2), validation_errors array<string>, rule_errors array<string>, errors array<string>, revenue decimal(12,4), filter_number int"
    rows = [(1, "1", 1, None, None, [], [], [], None, 1), (2, "2", 1, None, None, ["x"], [], ["x"], None, None), (3, "3", 1, None, None, [], [], [], None, 2)]
    judged = spark.createDataFrame(rows, kind).withColumn("revenue", (F.col("claim_id") * 2).cast("decimal(12,4)"))
    told = flow.write(judged, str(tmp_path), 7, "k", ("claim_id",))
    assert (told["batch_id"], told["processed"], told["failed"], float(told["revenue"])) == (7, 3, 1, 8.0) and told["seconds"] > 0
    assert flow.write(judged.limit(0), str(tmp_path), 8, "k", ("claim_id",))["processed"] == 0
    assert sorted((r["batch_id"], r["processed"], r["failed"]) for r in flow.summaries(spark, str(tmp_path)).collect()) == [(7, 3, 1), (8, 0, 0)]
