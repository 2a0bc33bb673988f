"""Dead letters as a standing flow over two keyed tables.

Letters arrive in micro-batches and wait in one table; each batch takes the oldest that wait, writes those with a claim's id
to the other table and settles the letters. Both writes carry the query's name and the batch's number, so a batch that
broke off between them is finished when it comes again: what was written is passed over, what was not is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from adjudica.operators.outcomes import reprocess
from adjudica.sources.keyed_table import KeyedTable, largest

from .claims_stream import drain

LETTERS = "dlq_id long, claim_id long, error_reason string, inserted_at timestamp, resolution string"
INSERTED = "claim_id long, dlq_id long"


class DeadLetters:
    """letters: what waits or has failed (inserted ones leave the table); inserted: claim ids with their last letter."""

    def __init__(self, spark: SparkSession, path: str, n: int, buckets: int = 16, name: str = "dead letters") -> None:
        self.letters = KeyedTable(spark, f"{path}/letters", LETTERS, ("dlq_id",), buckets, gone="resolution = 'inserted'")
        self.inserted = KeyedTable(spark, f"{path}/inserted", INSERTED, ("claim_id",), buckets, {"dlq_id": largest})
        self.n, self.name = n, name

    def waiting(self) -> DataFrame:
        return self.letters.read().where("resolution is null")

    def failed(self) -> DataFrame:
        return self.letters.read().where("resolution = 'failed'")

    def settle(self, number: int) -> None:
        """The n oldest letters that wait; `number` names the attempt."""
        good, bad = reprocess(self.waiting(), self.n)
        taken = good.unionByName(bad).persist()  # n rows
        try:
            self.inserted.merge(taken.where("resolution = 'inserted'"), self.name, number)
            self.letters.merge(taken, self.name, number)
        finally:
            taken.unpersist()

    def __call__(self, batch: DataFrame, number: int) -> None:
        self.letters.merge(batch.withColumn("resolution", F.lit(None).cast("string")), f"{self.name}, arrivals", number)
        self.settle(number)


def run(stream: DataFrame, sink: DeadLetters, checkpoint: str) -> StreamingQuery:
    """All letters that are there now. stream: dlq_id, claim_id, error_reason, inserted_at."""
    return drain(stream, sink, checkpoint)
