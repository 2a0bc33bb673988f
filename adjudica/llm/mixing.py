"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every source gets a target share of the mix; targets are filled like water: a source stops at ``cap`` times its own
size and what it can't take is shared out again by weight. Each document's expected copies are target / source size.
Within a source the documents are put in one order (falling size, so that neighbours are alike), the expected copies
are summed along it, one offset per source is added, and a document is emitted once for every integer that its stretch
of the sum crosses. As no document expects more than ``cap`` copies, none gets more than ``cap`` rounded up.

The sums along a source run over cells (source, size band, salt), first counted, then added up over the few bands and
over the salts of a band, so that a source with a third of all rows is spread over as many tasks as it needs. Targets are
found from one row a source, which one task puts in order: sources are names of collections, not of pages.

Defined cases: null or empty text has size 0; a null source is a source of its own, last in order; a null doc_id comes
last among equals; repeated rows are separate documents; an empty table gives an empty result; if all sizes are 0 all
targets are 0 and nothing is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, columns_of, written

#: Weights of the sources in their order, repeated as often as needed.
WEIGHTS = (3, 1, 2)
#: Size of the mix in halves of the corpus, and how often a source may be taken.
HALVES, CAP = 3, 2
#: Rows of one source and size band that are ordered in one task, about.
CELL_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def band(size: Column) -> Column:
    """Sizes whose leading four binary digits agree share a band."""
    digits = F.length(F.bin(size))
    return (digits * 16 + F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0))")).cast("long")


def offset(rank: Column) -> Column:
    """One offset in [0, 1) for each source, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix"), rank.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sized: DataFrame) -> DataFrame:
    """rank, source, source_size, target for each source; one row a source, so the unpartitioned windows stay small."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy((F.lit(CAP) * F.col("source_size") / F.col("weight")), "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", F.row_number().over(by_name).cast("long"))
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    per_source = per_source.withColumn("weight", F.element_at(weights, ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int")).cast("long"))
    level = (HALVES * F.sum("source_size").over(everything) - 2 * CAP * F.coalesce(F.sum("source_size").over(before), F.lit(0))).cast("double") / (2 * (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))).cast("double")
    per_source = per_source.withColumn("level", level).withColumn("place", F.row_number().over(filling))
    fits = F.col("level") * F.col("weight") <= (CAP * F.col("source_size")).cast("double")
    final = F.min(F.when(fits, F.struct("place", "level"))).over(everything)["level"]
    return per_source.select("rank", "source", "source_size", F.least(F.col("weight") * final, (CAP * F.col("source_size")).cast("double")).alias("target"))


def stand_in(doc_id: Column, text: Column) -> Column:
    """doc_id, or a number made from the text where there is none, so that such rows are dealt out too."""
    return F.coalesce(doc_id, F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 8), 16, 10).cast("long"))


def copies(sized: DataFrame) -> DataFrame:
    """sized: doc_id, key (see stand_in), source, size, and other columns, which are carried along and break ties last.
    The same with source_size, target and copies (how often the mix has the row)."""
    others = [c for c in sized.columns if c not in ("doc_id", "key", "source", "size")]
    salts = sized.count() // CELL_ROWS + 1
    per_source = targets(sized)
    ranked = sized.join(per_source.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    ranked = ranked.withColumn("band", band(F.col("size"))).withColumn("salt", F.pmod(F.col("key"), F.lit(salts)))
    cells = ranked.groupBy("rank", "band", "salt").agg(F.count(F.lit(1)).alias("rows"))
    bands = cells.groupBy("rank", "band").agg(F.sum("rows").alias("rows"))
    earlier = lambda keys, order: F.coalesce(F.sum("rows").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bands = bands.select("rank", "band", earlier(["rank"], F.col("band").desc()).alias("band_start"))
    cells = cells.select("rank", "band", "salt", earlier(["rank", "band"], F.col("salt")).alias("cell_start"))
    inside = Window.partitionBy("rank", "band", "salt").orderBy(F.col("size").desc(), F.col("doc_id").asc_nulls_last(), "key", *others)
    placed = ranked.withColumn("place", F.row_number().over(inside)).join(cells, ["rank", "band", "salt"]).join(bands, ["rank", "band"])
    place = F.col("band_start") + F.col("cell_start") + F.col("place")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    crossed = lambda at: F.floor(share * at.cast("double") + offset(F.col("rank")))
    return placed.select("doc_id", *others, "size", "source_size", "target", (crossed(place) - crossed(place - 1)).alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """Words that the mix takes of each document."""
    own = columns_of(docs, "doc_id", "text", "source")
    sized = written(own.select("doc_id", stand_in(F.col("doc_id"), F.col("text")).alias("key"), "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    return copies(sized).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix, with their own columns: a row for each copy.

    A row is known by its doc_id and two hashes of all its columns, so the mix does not depend on how the rows are dealt
    to partitions. Rows alike in all columns are known as one, whose copies are added up."""
    row = [F.col(f"`{c}`").cast("string") for c in docs.columns]
    own = docs.withColumn("mix_id", F.col("`doc_id`").cast("long")).withColumn("mix_hash", F.xxhash64(*row)).withColumn("mix_hash_2", F.hash(*row))
    text = F.col("`text`").cast("string")
    sized = own.select(F.col("mix_id").alias("doc_id"), stand_in(F.col("mix_id"), text).alias("key"), F.col("`source`").cast("string").alias("source"), word_count(text).alias("size"), "mix_hash", "mix_hash_2")
    taken = copies(written(sized, "mix-sizes")).groupBy(F.col("doc_id").alias("id"), F.col("mix_hash").alias("h"), F.col("mix_hash_2").alias("h2")).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    taken = written(taken.where("copies > 0"), "mix-taken")
    same = F.col("mix_id").eqNullSafe(F.col("id")) & (F.col("mix_hash") == F.col("h")) & (F.col("mix_hash_2") == F.col("h2"))
    single = own.join(taken.where("rows = 1"), same)
    several = own.join(taken.where("rows > 1"), same).dropDuplicates(["mix_id", "mix_hash", "mix_hash_2"])
    return single.unionByName(several).withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = rf"""
WITH sized AS (
  SELECT doc_id, coalesce(doc_id, ('0x' || substr(md5(coalesce(text, '')), 1, 8))::BIGINT) AS key, source,
    coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::BIGINT AS weight FROM per_source),
levels AS (
  SELECT *, row_number() OVER filling AS place,
    ((3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER (filling ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
     / (2 * (sum(weight) OVER () - coalesce(sum(weight) OVER (filling ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::DOUBLE) AS level
  FROM weighted WINDOW filling AS (ORDER BY (2 * source_size)::DOUBLE / weight, rank)),
targets AS (
  SELECT rank, source, source_size, least(weight * (SELECT arg_min(level, place) FROM levels WHERE level * weight <= (2 * source_size)::DOUBLE), (2 * source_size)::DOUBLE) AS target
  FROM levels),
ranked AS (
  SELECT s.doc_id, s.size, t.rank, t.source_size, t.target,
    row_number() OVER (PARTITION BY t.rank ORDER BY length(bin(s.size)) * 16 + (s.size >> greatest(length(bin(s.size)) - 4, 0)) DESC,
      ((s.key % k.salts) + k.salts) % k.salts, s.size DESC, s.doc_id NULLS LAST, s.key) AS place,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0 END AS share,
    ('0x' || substr(md5('mix' || t.rank), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source, (SELECT count(*) // {CELL_ROWS} + 1 AS salts FROM sized) k)
SELECT doc_id, size, source_size, target,
  (size * (floor(share * place::DOUBLE + start) - floor(share * (place - 1)::DOUBLE + start)))::BIGINT AS taken FROM ranked
"""
