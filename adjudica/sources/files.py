"""Tables, queues and archives in files; database tables through JDBC."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from adjudica.functions.scalar import decrypted, encrypted

SECRET = ("patient_account_number", "patient_name")


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names, or that was set with setCheckpointDir; a temporary one only
    where both are unset (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{(found or tempfile.mkdtemp(prefix='spark-shared-')).rstrip('/')}/{uuid.uuid4().hex}"


def read_table(spark: SparkSession, path: str, schema: StructType | str, **jdbc: str) -> DataFrame:
    """A Parquet table with a declared schema, or with `url` a database table, read in parallel over partitionColumn."""
    if "url" in jdbc:
        return spark.read.format("jdbc").options(dbtable=path, **jdbc).load()
    return spark.read.schema(schema).parquet(path)


def bulk_load(df: DataFrame, path: str, **jdbc: str) -> None:
    """Appends to a Parquet table, or with `url` to a database table in batches of 5000 rows."""
    if "url" in jdbc:
        df.write.format("jdbc").options(dbtable=path, batchsize="5000", **jdbc).mode("append").save()
    else:
        df.write.mode("append").parquet(path)


def read_training_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("procedure_code string, financial_class string, primary_diagnosis string, label int").csv(path, header=True)


def queue_claims(df: DataFrame, path: str) -> None:
    """Appends claims to a JSON-lines queue."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def replay_claims(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Queued claims."""
    return spark.read.schema(schema).json(path)


def drain_queue(spark: SparkSession, path: str, schema: StructType | str, commit: Callable[[DataFrame], None]) -> None:
    """Hands the queued claims to `commit`, and removes the files that were read once it has returned: what it fails on
    stays queued, and what is queued meanwhile is left for the next time."""
    queued = replay_claims(spark, path, schema)
    read = queued.inputFiles()
    commit(spark.read.schema(schema).json(read) if read else queued)
    remove(spark, read)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes files and folders of any store that Spark reads."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of files that one task of a dealt join or grouping should stand for, and below which nothing is dealt.
TASK_BYTES, DEALT_FROM = 4_000_000, 64_000_000


def tasks_for(df: DataFrame) -> int:
    """How many tasks should share the rows of df, by the size of the files that it reads; 0 for small ones, for rows that
    come from no files, and for streams, which do not know yet what they will read."""
    if df.isStreaming:
        return 0
    jvm, conf, size = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration(), 0
    for name in df.inputFiles():  # URLs
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
    return -(-size // TASK_BYTES) if size >= DEALT_FROM else 0


def dealt(df: DataFrame, key: str, n: int) -> DataFrame:
    """df by a key over n tasks, unless n is 0; a join by that key takes as many. The session's number of partitions, and the
    size to which small ones are put together, would let a task's rows grow with the tables."""
    return df.repartition(n, key) if n else df


def split_by_age(claims: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """Claims before the cutoff, and those that stay; a null date stays."""
    old = F.coalesce(F.col("service_to_date") < cutoff, F.lit(False))
    return claims.where(old), claims.where(~old)


def archive(claims: DataFrame, path: str, key: str) -> None:
    """Encrypted lines, in folders by year and month: secret fields are encrypted, then the whole row as JSON."""
    hidden = claims.withColumns({c: encrypted(F.col(c), key) for c in SECRET if c in claims.columns})
    lines = hidden.select(encrypted(F.to_json(F.struct(*claims.columns), {"ignoreNullFields": "false"}), key).alias("value"), F.date_format("service_to_date", "yyyy").alias("year"), F.date_format("service_to_date", "MM").alias("month"))
    lines.write.mode("append").partitionBy("year", "month").text(path)


def restore(spark: SparkSession, path: str, key: str, schema: StructType | str) -> DataFrame:
    rows = spark.read.text(path).select(F.from_json(decrypted(F.col("value"), key), schema).alias("r")).select("r.*")
    return rows.withColumns({c: decrypted(F.col(c), key) for c in SECRET if c in rows.columns})


def write_by_year(df: DataFrame, path: str, date: str = "service_to_date") -> None:
    """A folder for each year; readers that filter on service_year read only those. Years are dealt out and split by their
    size when it is known (spark.sql.adaptive.advisoryPartitionSizeInBytes), so small ones become one file."""
    df.withColumn("service_year", F.year(date)).hint("rebalance", "service_year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("service_year").parquet(path)


def retained(df: DataFrame, now: Column, years: int = 5) -> DataFrame:
    """Partitions of the last `years` years and the current one."""
    return df.where(F.col("service_year") >= F.year(now) - years)


def drop_old_years(spark: SparkSession, path: str, now: str, years: int = 5) -> None:
    """Removes the partitions that `retained` would leave out. The list holds one number a year."""
    found = [r[0] for r in spark.read.parquet(path).select("service_year").distinct().collect()]
    remove(spark, [f"{path}/service_year={y}" for y in found if y is not None and y < int(now[:4]) - years])


def archive_date(name: Column) -> Column:
    """The date in an archive's name, claims_yyyy_MM_dd.jsonl; null if there is none."""
    found = F.regexp_extract(name, r"(\d{4}_\d{2}_\d{2})\.jsonl$", 1)
    return F.try_to_date(F.when(found != "", found), "yyyy_MM_dd")


def write_archives(claims: DataFrame, path: str, key: str) -> None:
    """Encrypted lines in one archive a month of service, named after its first day: claims_yyyy_MM_01.jsonl, a folder
    of parts."""
    name = F.concat(F.lit("claims_"), F.date_format(F.trunc("service_to_date", "month"), "yyyy_MM_dd"), F.lit(".jsonl"))
    rows = claims.select(encrypted(F.to_json(F.struct(*claims.columns), {"ignoreNullFields": "false"}), key).alias("value"), F.coalesce(name, F.lit("claims_undated.jsonl")).alias("archive"))
    rows.repartition("archive").write.mode("append").partitionBy("archive").text(path)


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """name, files and modified (the newest file's) of each archive under a path: files named *.jsonl, or folders so named
    (also as a partition, archive=...). Only names and times are read, no contents."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime")
    name = F.regexp_extract("path", r"/(?:[^/=]+=)?([^/=]+\.jsonl)(?:/[^/]*)?$", 1)
    return found.withColumn("name", name).where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("files"), F.max("modificationTime").alias("modified"))


def purge_archives(spark: SparkSession, path: str, now: str, years: int = 7) -> DataFrame:
    """Removes the archives that are older than the window, and lists them as they were. One name an archive comes to the
    driver, as with any listing."""
    old = purgeable(list_archives(spark, path), F.to_date(F.lit(now)), years)
    rows = old.collect()
    remove(spark, [f"{path}/{form}{r['name']}" for r in rows for form in ("", "archive=")])
    return spark.createDataFrame(rows, old.schema)


def purgeable(listing: DataFrame, now: Column, years: int = 7) -> DataFrame:
    """Archives older than the window; names without a date stay."""
    return listing.where(archive_date(F.col("name")) < F.add_months(now, -12 * years))


def retention_job(claims: DataFrame, path: str, key: str, cutoff: str, now: str, years: int = 7) -> DataFrame:
    """Archives the claims before the cutoff, then removes the archived months that lie wholly before the window of
    `years`; gives the claims that stay live. Both dates are texts such as 2024-12-31."""
    spark = claims.sparkSession
    old, live = split_by_age(claims, F.to_date(F.lit(cutoff)))
    archive(old, path, key)
    months = [(r["year"], r["month"]) for r in spark.read.text(path).select("year", "month").distinct().collect()]  # a row a month
    oldest = (int(now[:4]) - years, int(now[5:7]))
    remove(spark, [f"{path}/year={y}/month={str(mm).zfill(2)}" for y, mm in months if str(y).isdigit() and (int(y), int(mm)) < oldest])
    return live
