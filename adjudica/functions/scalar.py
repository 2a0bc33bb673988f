"""Scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Guidance for each failure reason, and otherwise.
REMEDIES = {
    "invalid_facility": "Verify facility_id mappings in source data",
    "invalid_financial_class": "Check financial_class values",
    "invalid_dob": "Ensure patient date_of_birth is valid",
}
OTHER_REMEDY = "Investigate data quality issues"


def priority_rank(c: Column) -> Column:
    """high 3, normal 2, low 1 in any case; whole numbers stay; everything else 2."""
    text = F.lower(F.trim(c.cast("string")))
    number = F.when(text.rlike(r"^[+-]?[0-9]{1,9}$"), text).cast("int")
    return F.when(text == "high", 3).when(text == "normal", 2).when(text == "low", 1).otherwise(F.coalesce(number, F.lit(2)))


def remedy(reason: Column) -> Column:
    pairs = [F.lit(x) for kv in REMEDIES.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[reason], F.lit(OTHER_REMEDY))


def mask_account(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), c).otherwise(F.concat(F.substring(c, 1, 2), F.lit("***")))


def hidden(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit("***"))


def sanitized(c: Column) -> Column:
    """Without angle brackets."""
    return F.translate(c, "<>", "")


def sanitized_all(c: Column) -> Column:
    return F.transform(c, sanitized)


def encrypted(c: Column, key: str) -> Column:
    """AES-GCM in base64 on one line, key by SHA-256; null and empty stay."""
    return F.when(c.isNull() | (c == ""), c).otherwise(F.replace(F.base64(F.aes_encrypt(c, F.unhex(F.sha2(F.lit(key), 256)), F.lit("GCM"))), F.lit("\r\n"), F.lit("")))


def decrypted(c: Column, key: str) -> Column:
    return F.when(c.isNull() | (c == ""), c).otherwise(F.aes_decrypt(F.unbase64(c), F.unhex(F.sha2(F.lit(key), 256)), F.lit("GCM")).cast("string"))


def bucket(c: Column, n: int) -> Column:
    """A bucket by the first 32 bits of MD5, the same in every run."""
    return (F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long") % n).cast("long")


def following_codes(code: Column, k: int) -> Column:
    """The next k codes by the number at the end, as wide as before."""
    head, tail = F.regexp_extract(code, r"^(.*?)(\d+)$", 1), F.regexp_extract(code, r"^(.*?)(\d+)$", 2)
    return F.when(tail != "", F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.concat(head, F.lpad((tail.cast("long") + i).cast("string"), F.length(tail), "0"))))


def where_column(statement: Column) -> Column:
    """The first column behind WHERE, or empty."""
    return F.regexp_extract(statement, r"(?i)WHERE\s+(\w+)", 1)
