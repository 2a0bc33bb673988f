from collections import Counter, defaultdict

import duckdb
import pytest

from adjudica.llm import mixing, quality
from adjudica.llm.common import documents


def slow_counts(text):
    text = text or ""
    w = [x.decode() for x in text.encode().split()]
    windows = list(zip(w, w[1:], w[2:]))
    often, seen, lines = Counter(windows), set(), 0
    covered = {k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(3)}
    for line in text.split("\n"):
        if line.encode().split():
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), lines, len(covered)


def counts(r):
    return r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]


@pytest.mark.parametrize("few", [16, 0])
def test_counts(spark, sf, monkeypatch, few):
    monkeypatch.setattr(quality, "FEW", few)
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    want = {r["doc_id"]: slow_counts(r["text"]) for r in docs.collect()}
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    for r in quality.judged(docs, labels).collect():
        n, *_, repeated = want[r["doc_id"]]
        assert counts(r) == want[r["doc_id"]] and r["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
        if r["doc_id"] in marks and not r["base_failed"]:
            assert r["kept"] == bool(marks[r["doc_id"]])


def test_quality_special_cases(spark):
    texts = [None, "", " \n\t", "a b c a b c", "x\nx\n\n\ny\nx", "é|# \x85  b", "w " * 5000, "a b"]
    docs = spark.createDataFrame([(k or None, t, "z") for k, t in enumerate(texts)], "doc_id long, text string, words string")
    got = sorted((r["doc_id"] or 0, counts(r), r["kept"]) for r in quality.judged(docs, spark.createDataFrame([], "doc_id long, quality int")).collect())
    assert got == [(k, slow_counts(t), False) for k, t in enumerate(texts)]
    assert quality.judged(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")).collect() == []


def test_mix_against_sql(spark, sf):
    docs = documents(spark, sf)
    got = [tuple(r) for r in mixing.mix(docs).collect()]
    with duckdb.connect() as c:
        c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
        assert Counter(got) == Counter(c.sql(mixing.SQL).fetchall())
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    taken, target = defaultdict(int), {}
    for doc_id, size, _, t, n in got:
        taken[source[doc_id]] += n
        target[source[doc_id]] = t
        assert n <= 2 * size
    assert all(abs(taken[s] - target[s]) < 0.1 * target[s] + 2000 for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size for _, size, *_ in got))


def test_mix_special_cases(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 2)
    docs = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c d e", None), (None, None, None), (5, "", "t"), (6, "x " * 4000, "u")], "doc_id long, text string, source string").withColumn("size", mixing.F.lit("q"))
    rows = mixing.mix(docs).collect()
    assert len(rows) == 6 and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix(docs.limit(0)).collect() == []
    assert [r["taken"] for r in mixing.mix(docs.where("doc_id = 5")).collect()] == [0]
