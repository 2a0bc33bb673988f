import random

from pyspark.sql import functions as F

from adjudica.llm import quality
from adjudica.llm.common import documents


def garbled(text, rng):
    """All but the last three characters of each word replaced."""
    return " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in w[:-3]) + w[-3:] for w in text.split())


def shuffled(text, rng):
    words = text.split()
    rng.shuffle(words)
    return " ".join(words)


def test_garbled_and_shuffled_copies_score_below_clean_ones(spark, sf):
    docs, labels = documents(spark, sf).select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    rng = random.Random(4)
    good = [r for r in docs.join(labels.where("quality = 1"), "doc_id").orderBy("doc_id").collect() if len(r["text"].split()) >= 100][:60]
    assert len(good) == 60
    copies = [(10**9 * k + r["doc_id"], f(r["text"], rng)) for k, f in ((1, garbled), (2, shuffled)) for r in good]
    both = docs.unionByName(spark.createDataFrame(copies, "doc_id long, text string"))
    llr = {r["doc_id"]: r["llr"] for r in quality.judged(both, labels).where(F.col("doc_id").isNotNull()).collect()}
    for k in (1, 2):
        below = sum(llr[10**9 * k + r["doc_id"]] < llr[r["doc_id"]] - 0.01 for r in good)
        assert below >= 57, (k, below)
