import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from adjudica.llm import simhash
from adjudica.llm.common import documents


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB \t\n\xa0é", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_cells_lose_no_link():
    n, rng = 300, np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = base[rng.integers(0, 6, n)]
    for _ in range(4):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    want = slow_components([int(x) for x in fps])
    for blocks in (5, 6, 7):
        left, right = [], []
        for mask in simhash.block_masks(blocks, 3):
            i, j = simhash.cell_links(simhash.counts_in_unary(fps) & np.uint64(mask), fps, 3)
            left.append(i), right.append(j)
        assert simhash.forest(np.concatenate(left), np.concatenate(right), n).tolist() == want
    for i, j in (simhash.cell_links(np.zeros(n, np.uint64), fps, 3), simhash.close_pairs(fps, 3, 70)):
        assert simhash.forest(i, j, n).tolist() == want


@pytest.mark.parametrize("block", [8192, 40])
def test_large_cells_are_dealt_out(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(2)
    fps = np.unique(np.uint64(0x0123456789ABCDEF) ^ (np.uint64(1) << rng.integers(0, 64, (400, 5), dtype=np.uint64)).sum(1, dtype=np.uint64))
    want = slow_components([int(x) for x in fps])
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(3)
    place = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    edges = [(place[r["a"]], place[r["b"]]) for r in simhash.links(nodes).collect()]
    i, j = (np.array([e[k] for e in edges], int) for k in (0, 1))
    assert simhash.forest(i, j, len(fps)).tolist() == want


def test_groups_are_whole():
    import pyarrow as pa

    key = np.repeat([1, 2, 5, 9], [3, 10, 1, 4])
    batches = [pa.RecordBatch.from_arrays([pa.array(key[k : k + 2])], ["key"]) for k in range(0, len(key), 2)]
    got = [t.column(0).to_pylist() for t in simhash.in_groups(iter(batches), 4)]
    assert sum(got, []) == key.tolist() and all(set(a).isdisjoint(b) for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("rows", [1, 4, 7, 1000])
def test_pieces_of_a_large_group_are_passed_on(rows):
    import pyarrow as pa

    key = np.repeat([1, 2, 3, 5, 9, 11], [3, 40, 1, 4, 25, 2])
    batches = [pa.RecordBatch.from_arrays([pa.array(key[k : k + 3]), pa.array(np.arange(len(key))[k : k + 3])], ["key", "n"]) for k in range(0, len(key), 3)]
    got = list(simhash.in_pieces(iter(batches), rows))
    assert sum((t.column(1).to_pylist() for t, _ in got), []) == list(range(len(key)))
    assert all(t.num_rows < rows + 6 for t, _ in got)
    broken = {k for t, whole in got if not whole for k in t.column(0).to_pylist()}
    assert all(len(set(t.column(0).to_pylist())) == 1 for t, whole in got if not whole)
    for k in set(key.tolist()) - broken:
        assert sum(k in t.column(0).to_pylist() for t, _ in got) == 1
    assert broken.isdisjoint(k for t, whole in got if whole for k in t.column(0).to_pylist())
    groups = list(simhash.in_groups(iter(batches), rows))
    assert sum((t.column(1).to_pylist() for t in groups), []) == list(range(len(key)))
    assert sum(len(set(t.column(0).to_pylist())) for t in groups) == 6


def test_a_hot_cell_is_neither_held_nor_copied_again():
    """100,000 rows of one cell: no piece is larger than two blocks and a batch, and each row is copied once."""
    import pyarrow as pa

    batches = (pa.RecordBatch.from_arrays([pa.array(np.zeros(2000, np.int64))], ["key"]) for _ in range(50))
    pieces = [(t.num_rows, whole) for t, whole in simhash.in_pieces(batches, 2 * simhash.BLOCK)]
    assert sum(n for n, _ in pieces) == 100_000 and max(n for n, _ in pieces) <= 2 * simhash.BLOCK + 2000 and not any(whole for _, whole in pieces)


def test_large_groups_are_joined_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", 10)
    rows = spark.range(100).selectExpr("if(id < 60, 7, id) as key", "id")
    groups = rows.groupBy("key").count()
    got = simhash.joined_with(rows, groups, "key", "count")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(groups, "key").collect()))


def test_rows_without_id_link_others(spark, monkeypatch):
    prints = {"p": 0, "q": 0b111, "r": 0b111111, "far": 1 << 40 | 0xFFF00}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, width: docs.select("doc_id", "fp"))
    rows = [(1, prints["p"]), (None, prints["q"]), (2, prints["r"]), (None, prints["far"])]
    got = {r["fingerprint"]: r["component_id"] for r in simhash.grouped(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    assert got == {f"{prints['p']:016x}": 1, f"{prints['q']:016x}": 1, f"{prints['r']:016x}": 1, f"{prints['far']:016x}": None}


def test_very_long_text():
    text = " ".join(f"w{k % 5003}" for k in range(120_000))
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_against_brute_force(spark, sf):
    docs = documents(spark, sf)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.grouped(docs).collect()}
    fps = [slow_fingerprint(t) for _, t in rows]
    group = slow_components(fps)
    assert got == {d: (f"{f:016x}", rows[g][0]) for (d, _), f, g in zip(rows, fps, group)}


def test_chain_of_components(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(200, 100), (300, 200)], "a long, b long")
    assert {(r["a"], r["b"]) for r in simhash.components(chain).collect()} == {(i, 0) for i in range(1, 61)} | {(200, 100), (300, 100)}


def test_components_with_hubs(spark):
    rng = np.random.default_rng(7)
    pairs = [(k, 0) for k in range(1, 500)] + [(1000 + k, 600 + k % 3) for k in range(300)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2400, (250, 2)) if a > b] + [(1001, 499)]
    root = list(range(2400))
    for _ in range(60):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["a"]: r["b"] for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: r for k, r in enumerate(root) if r != k}


def test_nulls_empty_and_repeats(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "A b c d"), (7, None), (8, ""), (None, None), (9, " \n")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    got = sorted(((r["doc_id"], r["fingerprint"] == "0" * 16, r["component_id"]) for r in simhash.grouped(docs).collect()), key=str)
    assert got == sorted([(None, False, 5), (5, False, 5), (5, False, 5), (7, True, 7), (8, True, 7), (None, True, 7), (9, True, 7)], key=str)
    assert simhash.grouped(docs.limit(0)).collect() == []
