import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from adjudica.llm import anchors, blocks, runindex, suffixes
from adjudica.llm.common import documents


def slow(rows, window=100):
    """rows: (doc_id, bytes) in reading order."""
    seen, out = set(), {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k)):
        text = rows[k][1]
        gone = np.zeros(len(text), bool)
        for p in range(len(text) - window + 1):
            w = text[p : p + window]
            if w in seen:
                gone[p : p + window] = True
            seen.add(w)
        rest = bytes(b for b, g in zip(text, gone) if not g)
        runs = int(np.sum(np.diff(np.r_[False, gone].astype(int)) == 1))
        out.setdefault(rows[k][0], []).append((len(text), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return {d: sorted(v) for d, v in out.items()}


def result(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    return {d: sorted(v) for d, v in out.items()}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab\x00", max_size=40), min_size=1, max_size=20), st.integers(8, 20))
def test_index(strings, depth):
    data = [s.encode() for s in strings]
    seen, want = set(), []
    for s in data:
        bits = 0
        for p in range(len(s) - depth + 1):
            bits |= (s[p : p + depth] in seen) << p
            seen.add(s[p : p + depth])
        want.append(bits)
    lengths = np.array([len(s) for s in data])
    built = runindex.build(np.frombuffer(b"".join(s + b"!" for s in data), np.uint8), lengths)
    assert runindex.matches(built, lengths, depth).tolist() == want


def test_matching_statistics_come_from_the_run_ends():
    rng = np.random.default_rng(6)
    passage = rng.integers(97, 123, 130, dtype=np.uint8)
    strings = [np.r_[rng.integers(97, 123, 5, dtype=np.uint8), passage] for _ in range(30)]
    lengths = np.array([len(s) for s in strings])
    text = np.concatenate([np.r_[s, 0] for s in strings]).astype(np.uint8)
    index = runindex.build(text, lengths)
    assert len(index.head) < len(text) / 8  # runs, not rows
    other, length = runindex.statistics(index)
    order = sorted(range(len(text)), key=lambda i: (text[i : (i // 136 + 1) * 136 - 1].tobytes(), i))
    for a, b in zip(order, order[1:]):
        if text[b]:
            x, y = (text[i : (i // 136 + 1) * 136 - 1].tobytes() for i in (a, b))
            n = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
            assert length[b] == n and (n == 0 or other[b] == a)
    good = runindex.matches(index, lengths, 100)
    assert good[0] == 0 and all(good[1:])

    def outcome(index):
        try:
            return runindex.matches(index, lengths, 100).tolist()
        except IndexError:  # samples that point nowhere
            return None

    for name in ("head", "tail"):
        spoilt = runindex.build(text, lengths)
        setattr(spoilt, name, np.roll(getattr(spoilt, name), 1))
        assert outcome(spoilt) != good.tolist()


def test_fragments_cover_every_window_once():
    rng = np.random.default_rng(3)
    lengths = np.array([0, 99, 100, 5000, 101, 0, 300_000, 40])
    buf = rng.integers(97, 100, lengths.sum(), dtype=np.uint8)
    doc, start, windows, anchor, h = anchors.fragments(buf, lengths)
    got = np.concatenate([np.arange(s, s + w) for s, w in zip(start, windows)])
    ends = np.cumsum(lengths)
    assert got.tolist() == [p for e, n in zip(ends, lengths) for p in range(e - n, e - 99)]
    assert windows.max() <= anchors.MOST and (anchor >= start + windows - 1).all() and (anchor <= start + 60).all()
    assert (anchors.gram_hashes_at(buf, anchor) == h).all()


def test_against_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 100_000)
    docs = documents(spark, sf)
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]
    want = slow(rows)
    assert sum(n for v in want.values() for _, n, _, _ in v) > 10_000
    assert result(suffixes.summary(docs)) == want


def test_digests_do_not_depend_on_the_place():
    a, b = np.frombuffer(b"xyzabcdefg", np.uint8), np.frombuffer(b"abcdefgpqrstu", np.uint8)
    at = lambda buf, k: anchors.digests(buf, np.array([k]), np.array([7]), 1)[0]
    assert at(a, 3) == at(b, 0) != at(b, 1)


@pytest.mark.parametrize(("full", "group"), [(0, 1 << 22), (1500, 1 << 22), (4000, 1 << 22), (2_000_000, 0), (2_000_000, 1500), (1500, 1500)])
def test_frequent_anchors_are_cut_finer(spark, sf, monkeypatch, full, group):
    """Small bounds: all buckets, or some of them, are full of fragments and of pieces; groups are larger than allowed."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 50_000)
    monkeypatch.setattr(suffixes, "FULL", full)
    monkeypatch.setattr(suffixes, "GROUP_BYTES", group)
    docs = documents(spark, sf).where("doc_id < 300")
    assert result(suffixes.summary(docs)) == slow([(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()])


@pytest.mark.parametrize("width", [8, 1])
def test_equal_windows_meet_in_pieces_of_one_key(width):
    rng = np.random.default_rng(4)
    line = rng.integers(97, 123, 130, dtype=np.uint8)
    lengths = np.array([400] * 50)
    buf = np.concatenate([np.r_[rng.integers(97, 123, a), line, rng.integers(97, 123, 270 - a)] for a in rng.integers(0, 270, 50)]).astype(np.uint8)
    doc, start, windows, anchor, h = anchors.fragments(buf, lengths)
    of, low, high, key = suffixes.finer(buf, start, anchor - start, np.zeros_like(windows), windows, width)
    assert (high - low).max() <= width and (np.bincount(of, high - low) == windows).all()
    keys: dict[bytes, set] = {}
    for k, a, b, name in zip(of.tolist(), low.tolist(), high.tolist(), key.tolist()):
        for p in range(start[k] + a, start[k] + b):
            keys.setdefault(buf[p : p + 100].tobytes(), set()).add(name)
    assert len(keys) < windows.sum() and all(len(names) == 1 for names in keys.values())


def test_a_group_over_the_bound_is_never_indexed_whole(spark, monkeypatch):
    """2,000 texts share a line and differ beside it: no index holds more than the bound, and the rows stay right."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line = word(90)
    rows = [(k, word(60) + rng.choice("xyz") * 8 + line + rng.choice("uvw") * 8 + word(60)) for k in range(2000)]
    monkeypatch.setattr(suffixes, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(suffixes, "INDEX_BYTES", 10_000)
    table = pa.table({"doc_id": pa.array([i for i, _ in rows]), "text": [t for _, t in rows]})
    sizes = []
    build = suffixes.runindex.build
    monkeypatch.setattr(suffixes.runindex, "build", lambda text, n: sizes.append(len(text)) or build(text, n))
    made = suffixes.cut_block(table, 0, 1)
    answers = suffixes.resolve(suffixes.parts([r for r in made if r[0] == 1]))
    full = (np.zeros(1, bool),)
    matched = suffixes.index(suffixes.send(suffixes.parts(made[:1]), answers, 1, full))
    gone = suffixes.removed(suffixes.Block(made[0][3], 1, full), pa.concat_tables([answers, matched]))
    want = slow([(i, t.encode()) for i, t in rows])
    ends = np.cumsum([len(t) for _, t in rows])
    assert [int(gone[e - len(t) : e].sum()) for e, (_, t) in zip(ends, rows)] == [want[i][0][1] for i, _ in rows]
    assert gone.any() and sizes and max(sizes) <= 31_000  # a group at the bound, after less than INDEX_BYTES of others


def test_special_cases(spark, monkeypatch):
    random.seed(5)
    word = lambda n: "".join(random.choice("abcdé ") for _ in range(n))
    shared, line = word(400), word(120)
    texts = [(3, None), (4, ""), (5, "a" * 1000), (6, word(50) + shared + word(80)), (2, shared), (9, shared + shared), (9, shared), (None, word(30) + shared), (12, "\x00" * 300)]
    texts += [(100 + k, word(200) + line + word(200)) for k in range(60)]
    docs = spark.createDataFrame([(i, t, 1, "q") for i, t in texts], "doc_id long, text string, n_bytes int, kept string").coalesce(1)
    monkeypatch.setattr(suffixes, "INDEX_BYTES", 2000)
    assert result(suffixes.summary(docs)) == slow([(i, (t or "").encode()) for i, t in texts])
    assert suffixes.summary(docs.limit(0)).collect() == []


def test_a_very_long_text(spark, monkeypatch):
    """One document of many blocks' size, with a passage of its own and one of another."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 50_000)
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    texts = [(1, text[:200]), (2, text + text[1000:1300]), (3, "é" * 60 + text[5000:5120])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert result(suffixes.summary(docs)) == slow([(i, t.encode()) for i, t in texts])
