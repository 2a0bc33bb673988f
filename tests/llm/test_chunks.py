import hashlib
import random
from itertools import groupby

import numpy as np

from adjudica.llm import chunks
from adjudica.llm.common import documents


def slow_chunks(text):
    hashes, h = [], 0
    for b in bytes(16) + text:
        h = ((h << 1) + int(chunks.GEAR[b])) & 0xFFFFFFFF
        hashes.append(h)
    hashes, reach = hashes[16:], chunks.REACH
    ends = [k + 1 for k, h in enumerate(hashes) if h > max([0, *hashes[max(0, k - reach) : k]]) and h >= max([0, *hashes[k + 1 : k + 1 + reach]])]
    out, at = [], 0
    for end in sorted({*ends, len(text)} - {0}):
        out += [text[k : min(k + chunks.MAX, end)] for k in range(at, end, chunks.MAX)]
        at = end
    return out


def slow(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        own, repeat = slow_chunks(text), []
        for c in own:
            repeat.append(c in seen)
            seen.add(c)
        gone = list(repeat)
        for flag, run in groupby(range(len(own)), key=lambda k: repeat[k]):
            run = list(run)
            if flag and not all(repeat) and sum(len(own[k]) for k in run) < chunks.LEAST:
                for k in run:
                    gone[k] = False
        rest = b"".join(c for c, g in zip(own, gone) if not g)
        out.setdefault(doc_id, []).append((len(text), len(own), sum(gone), len(text) - len(rest), hashlib.sha256(rest).hexdigest()))
    return {d: sorted(v) for d, v in out.items()}


def result(df):
    out = {}
    for r in df.collect():
        assert sum(s["length"] for s in r["spans"]) == r["n_removed"]
        out.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_chunks"], r["n_removed_chunks"], r["n_removed"], r["kept_sha256"]))
    return {d: sorted(v) for d, v in out.items()}


def test_against_brute_force(spark, sf):
    docs = documents(spark, sf)
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]
    assert result(chunks.deduplicated(docs)) == slow(rows)


def test_phrases_of_clean_documents_stay(spark, sf):
    """A document that shares no 100 bytes with an earlier one is left alone, but for a few with a phrase of over 80."""
    docs = documents(spark, sf)
    seen, clean = set(), set()
    for d, t in sorted((r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()):
        own = [t[k : k + 100] for k in range(len(t) - 99)]
        if own and not any(w in seen for w in own) and len(set(own)) == len(own):
            clean.add(d)
        seen.update(own)
    touched = {r["doc_id"] for r in chunks.deduplicated(docs).where("n_removed_chunks > 0").collect()}
    assert len(clean) > 500 and len(touched & clean) < 0.03 * len(clean)


def test_special_cases(spark):
    rows = [(3, None), (1, ""), (2, "x" * 3000), (9, "ab" * 400), (9, "ab" * 400), (None, "ab" * 400), (4, "short"), (5, "short"), (6, "é" * 40_000)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_bytes int")
    assert result(chunks.deduplicated(docs)) == slow([(i, (t or "").encode()) for i, t in rows])
    assert chunks.deduplicated(docs.limit(0)).collect() == []


def test_an_insertion_moves_few_cuts():
    random.seed(2)
    text = bytes(random.randrange(97, 123) for _ in range(50_000))
    count = lambda t: set(slow_chunks(t))
    assert len(count(text) - count(text[:20_000] + b"inserted" + text[20_000:])) <= 6
    counts, sizes = chunks.cuts(np.frombuffer(text, np.uint8), np.array([len(text)]))
    assert counts.sum() == len(sizes) and sizes.sum() == len(text)
