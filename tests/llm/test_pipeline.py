import hashlib
import zlib
from collections import Counter, defaultdict

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_neardup import slow_groups
from test_packing import check_rows
from tokenizers import Tokenizer

from adjudica.llm import mixing
from adjudica.llm.common import documents, written


def test_stages(spark, sf):
    docs = documents(spark, sf)
    before = [(r["doc_id"], r["text"]) for r in docs.collect()]
    stages = dict(cp.STAGES)
    assert list(stages) == ["quality rules", "SimHash near-dedup", "suffix-array dedup", "mixing sources to target weights", "packing"]
    # quality: labelled good documents of 50 words stay, labelled bad ones go
    docs = written(cp.quality_rules(spark, docs, sf), "t1")
    assert tuple(docs.columns) == cp.COLUMNS
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [d for d, t in before if labels.get(d) == 1 and len(t.split()) >= 60]
    assert all(d in kept for d in good) and not [d for d in kept if labels.get(d) == 0]
    # near-duplicates: the smallest id of every component
    rows = sorted(kept.items())
    root, _ = slow_groups([t for _, t in rows])
    docs = written(cp.near_dedup(spark, docs, sf), "t2")
    assert tuple(docs.columns) == cp.COLUMNS and sorted(r["doc_id"] for r in docs.collect()) == [rows[k][0] for k in sorted(set(root))]
    # suffixes: what is left of each text
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    docs = written(cp.suffix_dedup(spark, docs, sf), "t3")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()}
    seen, want = set(), {}
    for d, t in rows:
        data = t.encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            w = hashlib.blake2b(data[p : p + 100], digest_size=12).digest()
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        at, out = 0, []
        for c in t:
            n = len(c.encode())
            if not gone[at : at + n].all():
                out.append(c)
            at += n
        want[d] = ("".join(out), len(out))
    assert got == want and any(len(want[d][0]) < len(t) for d, t in rows)
    # mixing: copies as the mix decides
    rows = Counter(r["doc_id"] for r in docs.collect())
    mixed = written(cp.source_mixing(spark, docs, sf), "t4")
    assert tuple(mixed.columns) == cp.COLUMNS
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert set(copies) <= set(rows) and max(copies.values()) <= 2
    words = defaultdict(int)
    for r in mixed.collect():
        words[r["source"]] += len(r["text"].encode().split())
        assert r["text"] == want[r["doc_id"]][0]
    for r in mixing.targets(docs.select("source", mixing.word_count(docs["text"]).alias("size"))).collect():
        assert abs(words[r["source"]] - r["target"]) < 0.2 * r["target"] + 3000
    # packing: every copy whole
    packed = cp.sequence_packing(spark, mixed, sf).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r["length"] for r in packed) == sum(copies[d] * (len(t.encode(want[d][0], add_special_tokens=False).ids) + 1) for d in copies)
    once = {d for d, n in copies.items() if n == 1}
    check = {d: np.array(t.encode(want[d][0], add_special_tokens=False).ids + [0]) for d in once}
    by = [r for r in packed if r["doc_id"] in once]
    assert all(zlib.crc32(check[r["doc_id"]][r["start"] : r["start"] + r["length"]].astype("<u4").tobytes()) == r["ids_crc32"] for r in by)
    assert check_rows is not None


def test_run_and_odd_rows(spark, tmp_path):
    text = " ".join(f"word{k}" for k in range(80))
    rows = [(None, text, "en", None, 5), (1, None, None, "a", None), (2, "", "en", "a", 0), (3, text + " x", "en", "b", 7), (3, text + " x", "en", "b", 7), (4, "é" * 200_000, "fr", "a", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert {r["doc_id"] for r in cp.run(spark, str(tmp_path)).collect()} <= {None, 3}


def test_empty_tables(spark, sf):
    for _, stage in cp.STAGES:
        assert stage(spark, documents(spark, sf).limit(0), sf).count() == 0


def test_mix_does_not_depend_on_partitions(spark, sf):
    docs = documents(spark, sf).select(*cp.COLUMNS)
    odd = docs.where("doc_id < 40").withColumn("doc_id", (docs["doc_id"] * 0 + 7))
    none = docs.where("doc_id < 60").withColumn("doc_id", F.lit(None).cast("long"))
    docs = docs.unionByName(odd).unionByName(odd).unionByName(none)
    got = [Counter((r["doc_id"], r["text"]) for r in mixing.mixed(docs.repartition(n)).collect()) for n in (1, 3, 7)]
    assert got[0] == got[1] == got[2] and max(got[0].values()) <= 6
