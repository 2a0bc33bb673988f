from collections import Counter

import numpy as np

from adjudica.llm import toxicity


def test_bags_come_from_spark_without_rare_subwords(spark):
    texts = ["Bad day, bad dog", "good day", "bad", None, "", "day day"]
    docs = spark.createDataFrame([(k, t, k % 2) for k, t in enumerate(texts)], "doc_id long, text string, mark int")
    got = toxicity.bags_of(docs)
    assert [m for _, _, m in got] == [0, 1, 0, 1, 0, 1]
    for (buckets, counts, _), text in zip(got, texts):
        want = toxicity.bag(text)
        assert buckets.tolist() == want[0].tolist() and counts.tolist() == want[1].tolist()


def test_a_bag_by_hand():
    def place(data):
        if len(data) <= 5:
            return ((int.from_bytes(data, "little") + len(data)) * int(toxicity._MIX) % (1 << 64)) >> 46

    want = Counter(place(w[k : k + n]) for w in (b" bad ", b" bad ", b" x ") for n in toxicity.GRAMS for k in range(len(w) - n + 1))
    want.update((toxicity.zlib.crc32(w) * int(toxicity._MIX) % (1 << 64)) >> 46 for w in (b"bad", b"bad", b"x"))
    assert dict(zip(*(a.tolist() for a in toxicity.bag("Bad, x; BAD")))) == want
    assert [len(a) for a in toxicity.bag("  ... ")] == [0, 0]


def test_rare_subwords_do_not_count():
    bags = [(np.array([1, 2]), np.array([1, 1]))] * 4 + [(np.array([2, 3]), np.array([1, 5]))] * 796
    weight = toxicity.known_weights(bags)
    assert weight[1] == 0 and weight[2] == 0 and 0 < weight[3] < 0.01  # four of 800 have 1; all have 2
    assert toxicity.known_weights(bags[:8])[1] > 0


def test_training_takes_3000_documents_of_each_class_and_no_text_to_the_driver(spark, monkeypatch):
    assert toxicity.TRAIN >= 3_000
    n = 3_200
    docs = spark.range(2 * n).selectExpr("id as doc_id", "concat('plain words ', if(id % 2 = 1, concat('toxic', id, 'word'), concat('quiet', id, 'word'))) as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    seen, real = [], toxicity.trained
    monkeypatch.setattr(toxicity, "trained", lambda bags, marks: seen.append((bags, marks)) or real(bags, marks))
    monkeypatch.setattr(toxicity, "FOLDS", 10**9)  # nothing held out
    *_, slope, cut = toxicity.fit(docs, labels)
    assert [len(bags) for bags, _ in seen] == [6_000, 3_000, 3_000] and seen[0][1].sum() == 3_000 and slope > 0
    got = toxicity.scored(docs, labels).join(labels, "doc_id").where("predicted <> toxic").count()
    assert got == 0
