import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from adjudica.llm import merkle
from adjudica.llm.common import documents


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_leaf(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[2], row[3], row[4], text)))


def slow_tree(nodes):
    """The top and, for each node, the digests beside it, level by level, as (left, right)."""
    paths, level, own = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for k, at in enumerate(own):
            first = at // 16 * 16
            paths[k].append(("".join(level[first:at]), "".join(level[at + 1 : first + 16])))
            own[k] = at // 16
        level = [h("".join(level[k : k + 16])) for k in range(0, len(level), 16)]
    return level[0], paths


def slow(rows):
    """Rows: doc_id, text, source, lang, n_chars."""
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is None, r[0] or 0, slow_leaf(r, r[1]), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: slow_tree([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in order}
    root, upper = slow_tree([built[s][0] for s in order])
    out = []
    for s, above in zip(order, upper):
        for (_, _, leaf, r), path in zip(sorted(trees[s], key=lambda x: x[:3]), built[s][1]):
            path, now = path + above, leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                now = slow_leaf(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]))
            for left, right in path:
                now = h(left + now + right)
            out.append((r[0], leaf, built[s][0], root, h("".join(a + b for a, b in path)), now, now == root))
    return out


COLUMNS = "doc_id long, text string, source string, lang string, n_chars long"


def made(n, source, first=0):
    return [(first + k, f"Text {k % 7} OF {k}", source, None if k % 5 == 0 else "en", k) for k in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        made(1, "a"),
        made(1, "a") + made(1, None, 1),
        made(17, "a"),
        made(300, None) + made(16, "z", 400) + made(257, "é", 500) + made(1, "", 900) + made(40, "a|b", 950),
        [row for k in range(40) for row in made(1 + k % 3, f"s{k}", 10 * k)],  # more sources than one parent has children
        [(None, None, None, None, None)] * 20 + [(5, "", "a", "en", 0)] * 3 + [(5, None, "a", "en", 0), (None, "X", "a", None, None), (5, "W " * 40_000, "a", "en", None)],
    ],
    ids=["one", "two trees", "two levels", "several", "many sources", "nulls and repeated rows"],
)
def test_against_a_plain_tree(spark, rows):
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3).selectExpr("*", "text as digest", "source as tree", "n_chars as lo")
    assert Counter(map(tuple, merkle.verified(docs).collect())) == Counter(slow(rows))


def test_an_empty_table(spark):
    assert merkle.verified(spark.createDataFrame([], COLUMNS)).collect() == []


def test_against_sql(spark, sf):
    got = merkle.verified(documents(spark, sf))
    with duckdb.connect() as c:
        c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
        want = c.sql(merkle.SQL)
        assert want.columns == got.columns
        rows = got.collect()
        assert Counter(map(tuple, rows)) == Counter(want.fetchall())
    assert len({r["root"] for r in rows}) == 1 and {r["verified"] for r in rows} == {True, False}


def test_intervals_tile_every_level(spark):
    per_source, over_sources = merkle.manifest(spark.createDataFrame(made(300, "a") + made(70, "b", 500), COLUMNS))
    assert len(per_source) == 3 and len(over_sources) == 1
    for level, table in enumerate(per_source, 1):
        for tree, n in (("=a", 300), ("=b", 70)):
            own = sorted((r["lo"], r["hi"]) for r in table.where(f"tree = '{tree}'").collect())
            if own:
                assert own[0][0] == 0 and own[-1][1] == n and all(a[1] == b[0] and a[0] % 16**level == 0 for a, b in zip(own, own[1:]))


def test_a_hot_source_is_ranked_in_pieces(spark):
    rows = spark.range(40_000).selectExpr("id as doc_id", "'x' as text", "'hot' as source", "'en' as lang", "1L as n_chars")
    placed = merkle.ranked(merkle.leaves(rows), merkle.F.col("doc_id").asc_nulls_last(), merkle.F.col("digest"))
    got = placed.selectExpr("count(distinct lo)", "max(lo)", "bool_and(lo = doc_id)", "max(n)").first()
    assert tuple(got) == (40_000, 39_999, True, 40_000)
