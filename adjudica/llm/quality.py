"""Quality rules: counts over each document's words and lines, then a hashed n-gram likelihood ratio.

The ratio compares two models over hashed n-grams: one counted on trusted documents, one on the whole corpus. Each is
three multinomials of ``BUCKETS`` buckets: every whole word, every pair of neighbouring words, and the last three
characters of every word, which stand for words too rare to be counted. A document's score is the sum over the three of
the mean of log p_trusted - log p_raw; it is kept if the counts do not reject it and the score reaches ``THRESHOLD``. The
raw counts come from every document. The trusted ones come from at most ``TRUSTED`` documents that ``labels`` marks as
good, chosen by a hash of their id, so that their ids can be broadcast. Both models have 3 ``BUCKETS`` entries at most.

Only DataFrame functions are used, and no document is exploded over the network: repeats are found inside the row by
sorting the 64-bit hashes of its 3-word windows.

Defined cases: null or empty text has no words, all counts 0, and fails the base rules; without trusted documents
every ratio is 0 and the base rules alone decide; repeated rows are judged separately, alike; a null doc_id is never
trusted; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Hash buckets of a multinomial, trusted documents at most, added to each bucket's count.
BUCKETS, TRUSTED, PRIOR = 16_384, 20_000, 0.5
#: Mean log ratio (natural) that a document has to reach.
THRESHOLD = -0.5
MIN_WORDS = 50
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
SYMBOLS = "#*$%&|<>"
#: With so many distinct repeated windows, positions are sorted rather than looked up.
FEW = 16


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _without(text: Column, chars) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _union_length(starts: Column) -> Column:
    """Positions covered by 3-word windows at these ascending starts."""
    gaps = F.transform(starts, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - p, F.lit(3))))
    return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)


def counted(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns of `keep`, words and the counts. Windows are hashed once; only texts with a repeat are sorted."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = docs.select(
        "doc_id", *keep, words(F.col("text")).alias("words"),
        F.length(_without(text, SPACES)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        F.coalesce(F.size(lines) - F.size(F.array_distinct(lines)), F.lit(0)).cast("long").alias("n_dup_lines"),
    )
    two = one.withColumn("n_words", F.size("words").cast("long")).withColumn(
        "hashes", F.when(F.col("n_words") >= 3, F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))).otherwise(F.array().cast("array<bigint>")))
    any_repeat = F.size(F.array_distinct("hashes")) < F.size("hashes")
    three = two.withColumn("sorted", F.when(any_repeat, F.sort_array("hashes")))
    four = three.withColumn("repeated", F.array_distinct(F.filter("sorted", lambda h, i: (i > 0) & (h == F.get("sorted", i - 1)))))
    looked_up = F.filter(F.transform("hashes", lambda h, i: F.when(F.array_contains("repeated", h), i)), lambda i: i.isNotNull())
    pairs = F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    five = four.withColumn("pairs", F.when(F.size("repeated") > FEW, pairs))
    beside = F.filter("pairs", lambda p, k: F.coalesce(p["h"] == F.get("pairs", k - 1)["h"], F.lit(False)) | F.coalesce(p["h"] == F.get("pairs", k + 1)["h"], F.lit(False)))
    starts = F.when(F.col("repeated").isNull(), F.array().cast("array<int>")).when(F.size("repeated") <= FEW, looked_up).otherwise(F.sort_array(F.transform(beside, lambda p: p["i"])))
    return five.withColumn("starts", starts).select("doc_id", *keep, "words", "n_words", "word_chars", "n_symbols", "n_dup_lines", _union_length(F.col("starts")).cast("long").alias("n_repeat_words"))


def bucket(kind: int, *gram: Column) -> Column:
    return (F.pmod(F.xxhash64(*gram), F.lit(BUCKETS)) + kind * BUCKETS).cast("int")


def of_words(words: Column) -> Column:
    """Two buckets a word: of its last three characters and of the whole."""
    return F.concat(F.transform(words, lambda w: bucket(0, F.substring(w, -3, 3))), F.transform(words, lambda w: bucket(1, w)))


def of_pairs(words: Column) -> Column:
    return F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: bucket(2, F.get(words, i), w))


def ratios(docs: DataFrame, labels: DataFrame) -> list[float]:
    """log p_trusted - log p_raw for each bucket of each kind, from all documents."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("good_id")).distinct()
    good = good.orderBy(F.xxhash64("good_id"), "good_id").limit(TRUSTED)
    seen = docs.join(F.broadcast(good), F.col("doc_id") == F.col("good_id"), "left").select(F.col("good_id").isNotNull().cast("long").alias("trusted"), words(F.col("text")).alias("words"))
    grams = F.concat(of_words(F.col("words")), of_pairs(F.col("words")))
    counts = seen.select("trusted", F.explode(grams).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("trusted").alias("trusted")).collect()  # 3 BUCKETS rows at most
    found = {r["bucket"]: (r["trusted"], r["raw"]) for r in counts}
    out = []
    for kind in range(3):
        own = [found.get(b, (0, 0)) for b in range(kind * BUCKETS, (kind + 1) * BUCKETS)]
        trusted, raw = (sum(x) for x in zip(*own))
        total = PRIOR * BUCKETS
        odds = math.log((raw + total) / (trusted + total))
        out += [math.log((t + PRIOR) / (r + PRIOR)) + odds if trusted else 0.0 for t, r in own]
    return out


def judged(docs: DataFrame, labels: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, the counts, base_failed, llr (sum of the mean log ratios), kept; with `carry` also row, the document's own columns."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keep = ("row",) if carry else ()
    docs = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"), *([whole] if carry else []))
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios(docs, labels))), ",").cast("array<double>")
    c = counted(docs, *keep)

    def total(buckets: Column) -> Column:
        return F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.get(table, b))

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    llr = F.when(F.col("n_words") > 0, total(of_words(F.col("words"))) / F.col("n_words") + total(of_pairs(F.col("words"))) / F.greatest(F.col("n_words") - 1, F.lit(1))).otherwise(F.lit(0.0))
    scored = c.withColumn("base_failed", failed).withColumn("llr", F.round(llr, 6))
    return scored.select("doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", (~F.col("base_failed") & (F.col("llr") >= THRESHOLD)).alias("kept"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns. The number in `_place` keeps the filter where it is: pushed below
    the projections, it would hold a copy of each for every use."""
    return judged(docs, labels, carry=True).withColumn("_place", F.monotonically_increasing_id()).where("kept and _place >= 0").select("row.*")
