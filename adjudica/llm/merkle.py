"""Merkle manifest of a corpus by nested-interval labels.

Every document is a leaf with a rank within its source; every node carries the interval [lo, hi) of leaf ranks below it.
``FAN`` consecutive nodes of a level have one parent, whose digest is that of theirs in order; the node that covers all n
leaves is the subroot. The subroots, ordered by source, are the leaves of one more tree, whose top is the root.

* Ranks: rows are sorted by range over (source, doc_id, leaf), each piece of the order numbers its own rows, and sums
  over the pieces of a source shift them. A source with a third of all rows has as many pieces as it needs.
* Digests: one grouping a level, by the bucket lo / FAN^level; a group is one parent's children.
* Proofs, from the top down: a node joins the nodes of the level above within the same bucket whose interval contains
  its own (one, with FAN children at most, so no key is hot) and takes over that node's ancestors. What the parent's
  interval has besides its own is two intervals, and the children within these are the siblings on its left and right.

A leaf's path is then a list of (left, right): its digests, level by level, are the proof, and folding a digest through it,
H(left, digest, right), gives the root. Texts are read once, to be hashed; only digests are shuffled.

Defined cases: any column may be null; an empty text is a value of its own; a null source comes first; within a source
null doc_ids come last, equal ones by leaf digest; repeated rows are leaves of their own; a source with one leaf has it as
subroot, and a corpus with one source has its subroot as root; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, written

FAN = 16
#: Documents whose hashed id this divides are altered before they are checked.
TAMPERED = 5
PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    own = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(own).cast("string"), F.lit(":"), own), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    return digest(F.concat(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(F.col("n_chars")), field(text)))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree (the source: '' for null, else '=' and its name, which sort alike), digest, altered (the digest after
    tampering, null where there is none)."""
    own = columns_of(docs, "doc_id", "text", "source", "lang", "n_chars")
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    return own.select("doc_id", tree.alias("tree"), leaf_digest(F.col("text")).alias("digest"), F.when(chosen, leaf_digest(lowered)).alias("altered"))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with their place in their tree: lo (from 0), hi = lo + 1, and n, the tree's leaves."""
    copy = F.monotonically_increasing_id()  # parts rows that are alike, so that they need not lie in one piece
    keyed = written(rows.withColumn("copy", copy), "merkle-leaves")
    spread = keyed.repartitionByRange("tree", *order, "copy").sortWithinPartitions("tree", *order, "copy").drop("copy")
    placed = written(spread.withColumn("at", F.monotonically_increasing_id()), "merkle-order").withColumn("piece", F.shiftright("at", 33))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = placed.groupBy("tree", "piece").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    pieces = pieces.select("tree", "piece", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n"))
    lo = F.col("at") + F.col("shift")
    return placed.join(pieces, ["tree", "piece"]).withColumns({"lo": lo, "hi": lo + 1}).drop("at", "piece", "shift")


def bucket(level: int) -> Column:
    """Nodes with equal buckets of a level lie under one node of that level."""
    return F.expr(f"lo div {FAN**level}L")


def joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda x: x["digest"]), "")


def parents(nodes: DataFrame, level: int, *carried: str) -> DataFrame:
    """The nodes of a level from those of the level below: tree, n, lo, hi, digest and their children, in order. The only
    leaf of a tree stays as it is."""
    child = F.struct("lo", "hi", "digest", *carried)
    runs = nodes.groupBy("tree", "n", bucket(level).alias("bucket")).agg(F.sort_array(F.collect_list(child)).alias("children"))
    first, last = F.element_at("children", 1), F.element_at("children", -1)
    own = F.when(F.col("n") == 1, first["digest"]).otherwise(digest(joined(F.col("children"))))
    return runs.select("tree", "n", first["lo"].alias("lo"), last["hi"].alias("hi"), own.alias("digest"), "children")


def levels(placed: DataFrame, *carried: str) -> list[DataFrame]:
    """All nodes above the leaves, a written table a level."""
    found = [written(parents(placed, 1, *carried), "merkle-level")]
    widest = found[0].agg(F.max("n")).first()[0] or 0
    while FAN ** len(found) < widest:
        found.append(written(parents(found[-1].where("hi - lo < n"), len(found) + 1), "merkle-level"))
    return found


def tops(built: list[DataFrame]) -> DataFrame:
    """tree, digest of the node that covers all leaves of a tree."""
    found = [t.where("hi - lo = n").select("tree", "digest") for t in built]
    return written(found[0] if len(found) == 1 else _union(found), "merkle-tops")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def beside(children: Column, lo: Column, hi: Column) -> Column:
    """The parent's interval without [lo, hi): the children before it and those after it."""
    return F.struct(joined(F.filter(children, lambda x: x["hi"] <= lo)).alias("left"), joined(F.filter(children, lambda x: x["lo"] >= hi)).alias("right"))


def with_ancestors(built: list[DataFrame], base: DataFrame | None) -> DataFrame:
    """The lowest nodes with path, from themselves to the root, and the columns that base (tree, path, ...) has for their
    tree; without base, paths end at the tree's own top."""
    above = None
    for level in range(len(built), 0, -1):
        own = built[level - 1]
        whole = own.where("hi - lo = n")
        found = whole.withColumn("path", F.array().cast(PATH)) if base is None else whole.join(base, "tree")
        if above is not None:
            extra = [F.col(f"up.{c}") for c in above.columns if c not in (*own.columns, "path")]
            up, low = above.withColumn("bucket", bucket(level + 1)).alias("up"), own.where("hi - lo < n").withColumn("bucket", bucket(level + 1)).alias("low")
            inside = (F.col("up.lo") <= F.col("low.lo")) & (F.col("low.hi") <= F.col("up.hi"))
            under = low.join(up, (F.col("low.tree") == F.col("up.tree")) & (F.col("low.bucket") == F.col("up.bucket")) & inside)
            path = F.concat(F.array(beside(F.col("up.children"), F.col("low.lo"), F.col("low.hi"))), F.col("up.path"))
            found = found.unionByName(under.select(*[F.col(f"low.{c}") for c in own.columns], path.alias("path"), *extra))
        above = found
    return above


def leaf_paths(built: list[DataFrame], base: DataFrame | None = None) -> DataFrame:
    """tree, child (a leaf: lo, hi, digest and what it carries), path, and the columns of base."""
    runs = with_ancestors(built, base)
    own = runs.withColumn("child", F.explode("children"))
    lo, hi = F.col("child.lo"), F.col("child.hi")
    path = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.array(beside(F.col("children"), lo, hi)), F.col("path")))
    return own.withColumn("path", path).drop("children", "digest", "n", "lo", "hi")


def folded(own: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, own, lambda so_far, step: digest(F.concat(step["left"], so_far, step["right"])))


def proof_text(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def manifest(docs: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """The nodes of the sources' trees, level by level (the lowest with the documents as children), and those of the tree
    over the sources."""
    per_source = levels(ranked(leaves(docs), F.col("doc_id").asc_nulls_last(), F.col("digest")), "doc_id", "altered")
    subroots = tops(per_source).select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    return per_source, levels(ranked(subroots, F.col("source")), "source")


def proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, altered, subroot, root, path of every document."""
    per_source, over_sources = manifest(docs)
    root = tops(over_sources).first()  # one row, or none
    base = leaf_paths(over_sources).select(F.col("child.source").alias("tree"), F.col("child.digest").alias("subroot"), "path")
    found = leaf_paths(per_source, written(base, "merkle-sources"))
    return found.select("child.doc_id", F.col("child.digest").alias("leaf"), "child.altered", "subroot", F.lit(root["digest"] if root else None).cast("string").alias("root"), "path")


def verified(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    done = proofs(docs).withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("path")))
    return done.select("doc_id", "leaf", "subroot", "root", digest(proof_text(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELDS = " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
_TEXT = "sha256({0} || coalesce(strlen({1})::VARCHAR || ':' || {1}, '-'))"
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT)"""
_LOWER = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

SQL = f"""
WITH RECURSIVE hashed AS MATERIALIZED (
  SELECT doc_id, source, {_TEXT.format(_FIELDS, 'text')} AS leaf, CASE WHEN {_CRC} % {TAMPERED} = 0 THEN {_TEXT.format(_FIELDS, _LOWER)} END AS altered FROM documents),
placed AS MATERIALIZED (
  SELECT *, coalesce('=' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos FROM hashed),
nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // {FAN}, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + {FAN - 1}) // {FAN} FROM nodes WHERE n > 1 GROUP BY tree, level, pos // {FAN}),
subroots AS MATERIALIZED (SELECT tree, level, digest FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY tree) - 1 AS pos, digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // {FAN}, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + {FAN - 1}) // {FAN} FROM upper WHERE n > 1 GROUP BY level, pos // {FAN}),
everything AS MATERIALIZED (
  SELECT tree, level, pos, digest FROM nodes WHERE n > 1
  UNION ALL SELECT s.tree, s.level + u.level, u.pos, u.digest FROM subroots s, upper u WHERE u.n > 1),
shift AS MATERIALIZED (SELECT tree, level AS depth, row_number() OVER (ORDER BY tree) - 1 AS place FROM subroots),
steps AS MATERIALIZED (
  SELECT p.tree, p.pos AS leaf_pos, e.level, e.pos, e.digest,
    e.pos = CASE WHEN e.level < s.depth THEN p.pos // (pow({FAN}, e.level)::BIGINT) ELSE s.place // (pow({FAN}, e.level - s.depth)::BIGINT) END AS own
  FROM placed p JOIN shift s USING (tree) JOIN everything e ON e.tree = p.tree
    AND e.pos // {FAN} = CASE WHEN e.level < s.depth THEN p.pos // (pow({FAN}, e.level + 1)::BIGINT) ELSE s.place // (pow({FAN}, e.level - s.depth + 1)::BIGINT) END),
sided AS MATERIALIZED (
  SELECT tree, leaf_pos, level, coalesce(string_agg(digest, '' ORDER BY pos) FILTER (NOT own), '') AS others,
    coalesce(string_agg(digest, '' ORDER BY pos) FILTER (pos < mine), '') AS lefts, coalesce(string_agg(digest, '' ORDER BY pos) FILTER (pos > mine), '') AS rights
  FROM (SELECT *, max(CASE WHEN own THEN pos END) OVER (PARTITION BY tree, leaf_pos, level) AS mine FROM steps) GROUP BY ALL),
fold AS (
  SELECT tree, pos AS leaf_pos, 0 AS level, coalesce(altered, leaf) AS digest FROM placed
  UNION ALL
  SELECT f.tree, f.leaf_pos, f.level + 1, sha256(s.lefts || f.digest || s.rights) FROM fold f JOIN sided s ON s.tree = f.tree AND s.leaf_pos = f.leaf_pos AND s.level = f.level),
proof AS (SELECT tree, leaf_pos, string_agg(others, '' ORDER BY level) AS others FROM sided GROUP BY ALL),
ended AS (SELECT tree, leaf_pos, arg_max(digest, level) AS folded_root FROM fold GROUP BY ALL)
SELECT p.doc_id, p.leaf, r.digest AS subroot, (SELECT digest FROM upper WHERE n = 1) AS root, sha256(coalesce(f.others, '')) AS proof_sha256,
  e.folded_root, e.folded_root = (SELECT digest FROM upper WHERE n = 1) AS verified
FROM placed p JOIN subroots r USING (tree) LEFT JOIN proof f ON f.tree = p.tree AND f.leaf_pos = p.pos JOIN ended e ON e.tree = p.tree AND e.leaf_pos = p.pos
"""
