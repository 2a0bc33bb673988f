"""Shared pieces: reading documents, cutting lineage in the shared folder, sizing buckets."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the controls 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def columns_of(docs: DataFrame, *names: str) -> DataFrame:
    """Only these columns; others are left out, whatever their names. doc_id becomes a long, text a string."""
    kinds = {"doc_id": "long", "text": "string", "source": "string"}
    return docs.select(*[F.col(f"`{n}`").cast(kinds[n]).alias(n) if n in kinds else F.col(f"`{n}`") for n in names])


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = context.getCheckpointDir()
        if not found:
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
            found = context.getCheckpointDir()
    return found


#: Shuffle files of a written table's job go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder (in subfolders by the column `by`), read again: lineage ends here, and
    lost executors cost only their own tasks. Nothing needs the job's shuffle files any more, so they are cleared."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/adjudica/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def discard(table: DataFrame, part: str = "") -> None:
    """Deletes a written table, or a subfolder of it, that nothing reads any more."""
    jvm, context = table.sparkSession._jvm, table.sparkSession.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(f"{table.written_to}/{part}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Rows and bytes of text."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    return row["n"], row["b"] or 0
