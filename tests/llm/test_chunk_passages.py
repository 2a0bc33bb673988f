import random

import numpy as np

from adjudica.llm import chunks
from adjudica.llm.common import documents


def inside(before, passage, after):
    """The chunks that lie within the passage, as (start, end) from its first byte."""
    text = before + passage + after
    _, sizes = chunks.cuts(np.frombuffer(text, np.uint8), np.array([len(text)]))
    ends = np.cumsum(sizes) - len(before)
    return {(int(e - n), int(e)) for e, n in zip(ends, sizes) if e - n >= 0 and e <= len(passage)}


def test_passages_of_51_words_are_found_in_any_context(spark, sf):
    texts = [r["text"].split(" ") for r in documents(spark, sf).orderBy("doc_id").collect() if r["text"]]
    texts = [w for w in texts if 120 < len(w) < 800]
    rng, found, share = random.Random(6), [], []
    while len(found) < 150:
        words = rng.choice(texts)
        at = rng.randrange(len(words) - 51)
        if len(set(words[at : at + 51])) < 20:  # one phrase over and over has no place of its own
            continue
        passage, contexts = " ".join(words[at : at + 51]).encode(), []
        for _ in range(2):
            w = rng.choice(texts)
            k = rng.randrange(1, len(w))
            contexts.append((" ".join(w[:k]).encode() + b" ", b" " + " ".join(w[k:]).encode()))
        common = set.intersection(*(inside(a, passage, b) for a, b in contexts))
        common = {x for x in common if sum(b - a for a, b in common) >= chunks.LEAST}
        found.append(bool(common))
        share.append(sum(b - a for a, b in common) / len(passage))
    assert np.mean(found) >= 0.95 and np.mean(share) > 0.7
