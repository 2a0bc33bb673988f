import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from adjudica.llm import packing
from adjudica.llm.common import documents


def check_rows(rows, ids):
    """Every id in one piece, sequences gapless, checksums right."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and zlib.crc32(own[r["start"] : r["start"] + r["length"]].astype("<u4").tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in (pieces, sequences):
        for parts in own.values():
            at = 0
            for start, length in sorted(parts):
                assert start == at and length > 0
                at += length
    assert set(pieces) == set(ids) and all(sum(n for _, n in pieces[d]) == len(ids[d]) for d in ids)
    sizes = [sum(n for _, n in s) for s in sequences.values()]
    assert max(sizes, default=0) <= 1024
    return sum(0 if n & (n - 1) == 0 else 1024 - n for n in sizes), sum(sizes)


def test_against_tokenizer(spark, sf):
    docs = documents(spark, sf)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r["doc_id"]: np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in docs.select("doc_id", "text").collect()}
    padding, total = check_rows(packing.packed(docs).collect(), ids)
    assert padding < 0.01 * total


def test_special_cases(spark):
    texts = {1: None, 2: "", 3: "a<|endoftext|>b", 4: "éé " * 3000, 5: "x"}
    docs = spark.createDataFrame([(i, t, 3, "z") for i, t in texts.items()], "doc_id long, text string, start int, length string")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [0]) for i, x in texts.items()}
    check_rows(packing.packed(docs).collect(), ids)
    assert packing.packed(docs.limit(0)).collect() == []
    assert sorted(r["doc_id"] or 0 for r in packing.packed(spark.createDataFrame([(None, "a"), (7, "b"), (7, "b")], "doc_id long, text string")).collect()) == [0, 7, 7]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3000), max_size=60))
def test_pack(lengths):
    seen = defaultdict(list)
    for s in packing.pack(lengths):
        n = sum(p[0] for p in s)
        assert n <= 1024 and n & (n - 1) == 0
        for length, doc, start in s:
            seen[doc].append((start, length))
    for doc, n in enumerate(lengths):
        at = 0
        for start, length in sorted(seen[doc]):
            assert start == at and length > 0
            at += length
        assert at == n


def test_step_groups_are_even():
    sizes = [1024] * 100 + [128] * 300 + [512] * 50
    load = defaultdict(int)
    for s, g in zip(sizes, packing.step_groups(sizes)):
        load[g] += s
    assert max(load.values()) - min(load.values()) <= 128
