"""Vector codes by product quantisation, learned with active-entry Lloyd rounds.

Components become integers, floor(4096 x), so that distances are exact. A vector is cut into ``PARTS`` parts, each position
with a codebook of ``ENTRIES`` entries. A round assigns every part to its nearest entry (ties to the lower index) and moves
the entries to their parts' means, rounded down. Each vector keeps its entries and their exact distances from the round
before. Where a part's entry has not moved, its distance still holds, and so does the order among all entries that have
not moved: only the moved ones are compared with it. Parts whose entry moved are compared with all.

Vectors and what they keep are one table, written anew by each round (the one before is deleted then); a round is one
pass without a shuffle. A task sends the sums of its parts, at most PARTS x ENTRIES rows, which Spark adds up; the driver
holds the codebooks alone. Rounds end early where no entry moved, as later ones would change nothing.

Defined cases: rows whose vector is null or has a null or non-finite component are dropped; the length of vectors is that
of the first kept row (smallest vec_id, null ids last, equal ids by content), rows of other lengths are dropped too; a
length that 8 does not divide is cut into parts as equal as can be; fewer kept rows than entries give fewer entries;
repeated rows are vectors of their own; integers beyond what a long holds as a sum of squares are drawn to the nearest
that it does (for 64 components +-1.3e8, that is x = 32,767); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows of a batch that are compared at once.
ROWS = 4096
PASSED = "kind byte, vec_id long, label string, vector binary, kept binary, part int, entry int, n long, sums array<long>"


def integers(flat: np.ndarray, dim: int) -> np.ndarray:
    most = 2.0 ** ((62 - int(np.ceil(np.log2(max(dim, 1))))) // 2 - 1)
    return np.clip(np.floor(flat.astype(np.float64) * SCALE), -most, most).astype(np.int32)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector (little-endian 32-bit integers) of the rows that take part."""
    own = vectors.select(F.col("`vec_id`").cast("long").alias("vec_id"), F.col("`label`").cast("string").alias("label"), F.col("`embedding`").cast("array<double>").alias("vector"))
    own = own.where("vector is not null").where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            sizes = np.asarray(column.value_lengths())
            flat, ends = np.asarray(column.flatten()), np.cumsum(sizes)
            done = [integers(flat[e - n : e], n).astype("<i4").tobytes() for e, n in zip(ends.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(done, pa.binary())], ["vec_id", "label", "vector"])

    return own.mapInArrow(run, "vec_id long, label string, vector binary")


def bounds(dim: int) -> list[int]:
    return [p * dim // PARTS for p in range(PARTS + 1)]


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x to each entry, exact: as floating point where no sum can reach 2^53."""
    most = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if most * most * max(1, x.shape[1]) < 1 << 50:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x.astype(np.int64) - e) ** 2).sum(1) for e in entries.astype(np.int64)], axis=1)


def assign(x: np.ndarray, entries: np.ndarray, code: np.ndarray | None = None, far: np.ndarray | None = None, moved: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row and its squared distance. code and far: the same for the entries before `moved` moved."""
    if code is None:
        every = distances(x, entries)
        code = every.argmin(1)
        return code, every[np.arange(len(x)), code]
    code, far = code.copy(), far.copy()
    stale = moved[code]
    if stale.any():
        code[stale], far[stale] = assign(x[stale], entries)
    rest, active = np.flatnonzero(~stale), np.flatnonzero(moved)
    if len(rest) and len(active):
        some = distances(x[rest], entries[active])
        best = some.argmin(1)
        near, entry = some[np.arange(len(rest)), best], active[best]
        better = (near < far[rest]) | (near == far[rest]) & (entry < code[rest])
        code[rest[better]], far[rest[better]] = entry[better], near[better]
    return code, far


def matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def assign_all(vectors: pa.Array, kept: pa.Array, books: list[np.ndarray], moved: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, codes and distances (a column a part) of a batch."""
    x, cut = matrix(vectors, "<i4"), bounds(sum(b.shape[1] for b in books))
    state = matrix(kept, "<i8") if moved is not None else None
    code, far = np.empty((2, len(x), PARTS), np.int64)
    for p, book in enumerate(books):
        before = () if state is None else (state[:, p], state[:, PARTS + p], moved[p])
        code[:, p], far[:, p] = assign(x[:, cut[p] : cut[p + 1]], book, *before)
    return x, code, far


def assigned(table: DataFrame, books: list[np.ndarray], moved: list[np.ndarray] | None) -> DataFrame:
    """One round over the vectors: rows of kind 0 are the vectors with their new codes and distances, rows of kind 1 the
    number and the sums of the parts of each entry in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PASSED.split(", ")]
        kinds = [pa.int8(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        cut = bounds(sum(b.shape[1] for b in books))
        count = np.zeros((PARTS, ENTRIES), np.int64)
        sums = [np.zeros((ENTRIES, b.shape[1]), np.int64) for b in books]
        for whole in batches:
            for batch in (whole.slice(k, ROWS) for k in range(0, whole.num_rows, ROWS)):
                x, code, far = assign_all(batch.column(2), batch.column(3) if moved is not None else None, books, moved)
                for p in range(PARTS):
                    count[p] += np.bincount(code[:, p], minlength=ENTRIES)
                    for j in range(cut[p], cut[p + 1]):  # exact: 4,096 numbers of 32 bits
                        sums[p][:, j - cut[p]] += np.bincount(code[:, p], weights=x[:, j], minlength=ENTRIES).astype(np.int64)
                kept = np.concatenate([code, far], axis=1).astype("<i8")
                n = len(x)
                own = [pa.array(np.zeros(n, np.int8)), batch.column(0), batch.column(1), batch.column(2), pa.array([r.tobytes() for r in kept], pa.binary()), *[pa.nulls(n, k) for k in kinds[5:]]]
                yield pa.RecordBatch.from_arrays(own, names)
        part, entry = np.nonzero(count)
        n = len(part)
        out = [pa.array(np.ones(n, np.int8)), *[pa.nulls(n, k) for k in kinds[1:5]], pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry])]
        yield pa.RecordBatch.from_arrays([*out, pa.array([sums[p][e].tolist() for p, e in zip(part, entry)], pa.list_(pa.int64()))], names)

    columns = ["vec_id", "label", "vector"] + (["kept"] if moved is not None else [])
    return table.select(*columns).mapInArrow(run, PASSED)


def refined(books: list[np.ndarray], sums: DataFrame) -> list[np.ndarray]:
    """Every entry moved to the mean of its parts, rounded down; unused ones stay. sums: rows of kind 1."""
    new = [b.copy() for b in books]
    added = sums.select("part", "entry", "n", F.posexplode("sums").alias("at", "value")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    for r in added.collect():  # ENTRIES x length rows at most
        new[r["part"]][r["entry"], r["at"]] = r["value"] // r["n"]
    return new


def learned(vectors: DataFrame) -> tuple[DataFrame, list[np.ndarray]] | None:
    """The kept rows (vec_id, label, code, error), assigned to the final codebooks, and these; None without rows."""
    table = written(usable(vectors), "codes")
    order = (F.col("vec_id").asc_nulls_last(), "vector")
    first = table.orderBy(*order).select(F.octet_length("vector").alias("width")).first()
    if first is None:
        return None
    width = first["width"]
    table, source = table.where(F.octet_length("vector") == width), table
    smallest = table.orderBy(*order).limit(ENTRIES).collect()
    start = np.array([np.frombuffer(r["vector"], "<i4") for r in smallest], np.int64).reshape(len(smallest), width // 4)
    cut = bounds(width // 4)
    books, moved = [start[:, cut[p] : cut[p + 1]] for p in range(PARTS)], None
    for _ in range(ROUNDS):
        passed = written(assigned(table, books, moved), "codes", by="kind")
        discard(source)
        table, source = passed.where("kind = 0"), passed
        new = refined(books, passed.where("kind = 1"))
        moved = [(a != b).any(1) for a, b in zip(books, new)]
        books = new
        if not any(m.any() for m in moved):
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, ROWS) for k in range(0, whole.num_rows, ROWS)):
                _, code, far = assign_all(batch.column(2), batch.column(3), books, moved)
                codes = pa.array([r.tobytes() for r in code.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes, pa.array(far.sum(1))], ["vec_id", "label", "code", "error"])

    return table.select("vec_id", "label", "vector", "kept").mapInArrow(run, "vec_id long, label string, code binary, error long"), books


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for e in b.tolist() for v in e).encode()).hexdigest()


def decoded(code: bytes, books: list[np.ndarray]) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([b[e] for b, e in zip(books, code)]) / SCALE


def coded(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    found = learned(vectors)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    own = written(found[0], "codes-final")
    labels = own.groupBy(F.col("label").alias("name")).agg(F.try_sum("error").alias("label_error"))  # null beyond a long
    joined = own.join(labels, F.col("label").eqNullSafe(F.col("name")))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_digest(found[1])).alias("codebooks_sha256"))


def _sql() -> str:
    """DuckDB SQL: every round compares all parts with all entries."""
    steps = [f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT)) AS row, vec_id, label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT row, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS v FROM kept, range({PARTS}) r(p)),
book0 AS MATERIALIZED (SELECT p, row - 1 AS e, v FROM parts WHERE row <= {ENTRIES})"""]
    near = "min({d: list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e: b.e})"
    for k in range(ROUNDS + 1):
        steps.append(f"\nnear{k} AS MATERIALIZED (SELECT x.row, x.p, any_value(x.v) AS v, {near} AS best FROM parts x JOIN book{k} b USING (p) GROUP BY x.row, x.p)")
        if k < ROUNDS:
            steps.append(f"""
mean{k} AS (SELECT p, e, list((s - ((s % n + n) % n)) // n ORDER BY i) AS v FROM (
  SELECT p, best.e AS e, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM near{k}, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i) GROUP BY p, best.e, i) GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m ON m.p = b.p AND m.e = b.e)""")
    return "WITH " + ",".join(steps) + f""",
coded AS (SELECT row, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{ROUNDS} GROUP BY row)
SELECT k.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM book{ROUNDS}) AS codebooks_sha256
FROM kept k JOIN coded c USING (row)
"""


SQL = _sql()
