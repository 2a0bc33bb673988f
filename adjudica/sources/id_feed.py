"""A change feed by ids: the rows of a growing table with ids above the last one seen, in id order.

A Python data source for readStream. Its offsets are ids, so a query's checkpoint holds the last id and nothing else; the
files behind the table may be merged or rewritten meanwhile. A micro-batch takes at most `idsPerBatch` ids; its partitions
are consecutive ranges of ids, read in parallel by the executors and sorted each, so a batch in partition order is in id
order. The newest id comes from the row groups' statistics, not from the rows.

Options: folder, table and id (names are checked, as they end up in paths and filters), idsPerBatch (0: all there is),
checkpoint (the query's own; asked for with idsPerBatch, as the engine does not tell a source where it left off), partitions,
startingId. Rows that appear later with an id below the last one are not seen, as with any feed by ids; rows without an id
are never part of the feed. Folders are those that pyarrow opens (a path, hdfs://, s3://).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def identifier(name: str) -> str:
    """The name, if it is one: letters, digits and underscores, no digit first."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name or "", re.ASCII):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def store(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path and not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")


class IdRange(InputPartition):
    """Ids above `after`, up to `last`."""

    def __init__(self, after: int, last: int) -> None:
        self.after, self.last = after, last


class IdFeedReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.folder, self.table, self.id = options["folder"].rstrip("/"), identifier(options["table"]), identifier(options["id"])
        self.schema = schema
        self.most, self.width = int(options.get("idsperbatch", 0)), int(options.get("partitions", 4))
        self.start = int(options.get("startingid", -1))
        self.checkpoint = options.get("checkpoint")
        self.position: int | None = None

    def reached(self) -> int:
        """The last id of the newest batch in the query's checkpoint, or the id to start from."""
        system, folder = store(self.checkpoint)
        listed = system.get_file_info(pafs.FileSelector(f"{folder}/offsets", allow_not_found=True))
        numbers = sorted(int(f.base_name) for f in listed if f.base_name.isdigit())
        if not numbers:
            return self.start
        with system.open_input_stream(f"{folder}/offsets/{numbers[-1]}") as f:
            return json.loads(f.read().decode().splitlines()[-1])["id"]

    def rows(self) -> pads.Dataset:
        """The table as it is now: a file or a folder of files."""
        system, folder = store(self.folder)
        path = f"{folder}/{self.table}"
        if system.get_file_info(path).type == pafs.FileType.NotFound:
            path += ".parquet"
        return pads.dataset(path, filesystem=system, format="parquet")

    def newest(self) -> int | None:
        found = []
        for fragment in self.rows().get_fragments():
            for group in fragment.row_groups:
                stated = (group.statistics or {}).get(self.id)
                if stated is not None:
                    found.append(stated["max"])
                else:  # no statistics, or no ids
                    values = fragment.subset(row_group_ids=[group.id]).to_table(columns=[self.id]).column(0).drop_null()
                    found += [pa.compute.max(values).as_py()] if len(values) else []
        return max(found, default=None)

    def initialOffset(self) -> dict:
        return {"id": self.start}

    def latestOffset(self) -> dict:
        top = self.newest()
        if not self.most:
            return {"id": self.start if top is None else top}
        if self.position is None:
            self.position = self.reached()
        self.position = max(self.position, min(self.start if top is None else top, self.position + self.most))
        return {"id": self.position}

    def partitions(self, start: dict, end: dict) -> list[IdRange]:
        after, last = start["id"], end["id"]
        edges = [after + (last - after) * k // self.width for k in range(self.width + 1)]
        return [IdRange(a, b) for a, b in zip(edges, edges[1:]) if a < b] or [IdRange(after, last)]

    def commit(self, end: dict) -> None:
        """Nothing is held that could be let go."""

    def read(self, partition: IdRange) -> Iterator[pa.RecordBatch]:
        own = pads.field(self.id)
        found = self.rows().to_table(columns=self.schema.names, filter=(own > partition.after) & (own <= partition.last))
        yield from found.sort_by(self.id).cast(to_arrow_schema(self.schema)).combine_chunks().to_batches(max_chunksize=10_000)


class IdFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "id_feed"

    def schema(self) -> StructType:
        raise ValueError("give readStream the columns to read")

    def streamReader(self, schema: StructType) -> IdFeedReader:
        return IdFeedReader(self.options, schema)


def id_feed(spark: SparkSession, folder: str, table: str, id_col: str, schema: StructType | str, checkpoint: str, ids_per_batch: int = 0, starting_id: int = -1, partitions: int = 4) -> DataFrame:
    """The table's rows as a stream in id order, for a query with this checkpoint: from the first id above `starting_id`, or
    from where the query left off."""
    spark.dataSource.register(IdFeed)
    reader = spark.readStream.format("id_feed").schema(schema).option("folder", folder).option("table", identifier(table)).option("id", identifier(id_col))
    return reader.option("checkpoint", checkpoint).option("idsPerBatch", ids_per_batch).option("startingId", starting_id).option("partitions", partitions).load()


def follow(feed: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "0 seconds") -> StreamingQuery:
    """All batches that are there now, then stops; a query that goes on polls every `interval`."""
    query = feed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query
