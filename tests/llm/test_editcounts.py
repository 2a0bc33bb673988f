import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from adjudica.llm import editcounts
from adjudica.llm.common import documents
from adjudica.llm.tokens import encoder

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENCODE, CUT = encoder(), editcounts.cutter()


def slow(text):
    return len(TOKENIZER.encode(text, add_special_tokens=False).ids)


def edited(text, edits):
    for e in edits:
        at = min(max(e["start"] or 0, 0), len(text))
        text = text[:at] + (e["inserted"] or "") + text[at + max(e["removed"] or 0, 0) :]
    return text


@pytest.mark.parametrize("leaf,ahead", [(64, 256), (2, 3), (1, 1)])
def test_edits(monkeypatch, leaf, ahead):
    monkeypatch.setattr(editcounts, "LEAF", leaf)
    monkeypatch.setattr(editcounts, "AHEAD", ahead)
    monkeypatch.setattr(editcounts, "SPLIT", 4 * leaf)
    pieces = st.text(alphabet=" \n\ta1é'sl.", max_size=60)

    @settings(max_examples=300, deadline=None)
    @given(pieces, st.lists(st.tuples(st.integers(0, 70), st.integers(0, 20), st.text(alphabet=" \na1's", max_size=8)), max_size=5))
    def run(text, edits):
        tree = editcounts.CountTree(text, CUT, lambda p: len(ENCODE(p)))
        for start, removed, inserted in edits:
            tree.edit(start, removed, inserted)
            text = edited(text, [{"start": start, "removed": removed, "inserted": inserted}])
            assert "".join(p for own in tree.leaves for p in own) == text
            assert [p for own in tree.leaves for p in own] == CUT(text) and tree.text == text
            assert max(map(len, tree.leaves)) <= 4 * leaf + 2 * len(text) and [n for own in tree.counts for n in own] == [len(ENCODE(p)) for p in CUT(text)]
            tree = editcounts.CountTree(text, None, None, tree.stored())  # nothing is cut or counted again
            tree.cut, tree.count = CUT, lambda p: len(ENCODE(p))
        assert tree.total == slow(text) and tree.pretokens == len(CUT(text)) and tree.chars[1] == len(text)

    run()


def test_against_full_encoding(spark, sf):
    docs = editcounts.with_edits(documents(spark, sf))
    want = {r["doc_id"]: (slow(r["text"] or ""), slow(edited(r["text"] or "", r["edits"]))) for r in docs.collect()}
    got = editcounts.counted(docs).collect()
    assert {r["doc_id"]: (r["tokens_before"], r["tokens_after"]) for r in got} == want
    assert sum(r["recounted"] for r in got) < 0.1 * sum(r["pretokens"] for r in got)


def test_later_edits_start_from_the_stored_tree(spark, sf):
    docs = documents(spark, sf).where("doc_id < 100")
    once = editcounts.edited(editcounts.built(docs).join(editcounts.with_edits(docs).select("doc_id", "edits"), "doc_id"))
    again = editcounts.edited(once.join(editcounts.with_edits(once.select("doc_id", "text")).select("doc_id", "edits"), "doc_id")).collect()
    first = {r["doc_id"]: r for r in once.collect()}
    twice = {r["doc_id"]: edited(first[r["doc_id"]]["text"], r["edits"]) for r in editcounts.with_edits(once.select("doc_id", "text")).collect()}
    assert all(r["text"] == twice[r["doc_id"]] and r["tokens_after"] == slow(r["text"]) and r["tokens_before"] == first[r["doc_id"]]["tokens_after"] for r in again)
    assert sum(r["recounted"] for r in again) < 0.1 * sum(r["pretokens"] for r in again)


def test_leaves_split_and_long_texts(spark):
    tree = editcounts.CountTree("a b", CUT, lambda p: len(ENCODE(p)))
    for k in range(3000):
        tree.edit(1, 0, f" w{k}")
    assert max(map(len, tree.leaves)) <= editcounts.SPLIT and tree.total == slow(tree.text)
    long = "one two, three 4 " * 40_000
    docs = spark.createDataFrame([(1, long, [(10, 5, "zz"), (600_000, 3, "")])], f"doc_id long, text string, edits array<{editcounts.EDIT}>")
    row = editcounts.counted(docs).first()
    assert row["recounted"] < 100 and row["tokens_after"] == slow(edited(long, [{"start": 10, "removed": 5, "inserted": "zz"}, {"start": 600_000, "removed": 3, "inserted": ""}]))


def test_special_cases(spark):
    rows = [(1, None, [(0, 0, "new")]), (2, "abc", None), (None, "", []), (3, "x y", [(None, None, None), None, (-5, 1, "é")]), (3, "a<|endoftext|>b", [(99, 5, "!")])]
    docs = spark.createDataFrame([(*r, 4) for r in rows], f"doc_id long, text string, edits array<{editcounts.EDIT}>, tokens_after int")
    got = sorted((r["doc_id"] or 0, r["tokens_before"], r["tokens_after"]) for r in editcounts.counted(docs).collect())
    assert got == sorted([(1, 0, slow("new")), (2, slow("abc"), slow("abc")), (0, 0, 0), (3, slow("x y"), slow("é y")), (3, slow("a<|endoftext|>b"), slow("a<|endoftext|>b!"))])
    assert editcounts.counted(docs.limit(0)).collect() == []
