"""Masking and encryption of what identifies a patient."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adjudica.functions.scalar import decrypted, encrypted, mask_account

SECRET = ("patient_account_number", "patient_name")


def mask(df: DataFrame) -> DataFrame:
    """Account numbers keep two characters, names and birth dates none."""
    out = {"patient_account_number": mask_account(F.col("patient_account_number")), "patient_name": F.lit("***"), "date_of_birth": F.lit("***")}
    return df.withColumns({c: v for c, v in out.items() if c in df.columns})


def encrypt(df: DataFrame, key: str) -> DataFrame:
    return df.withColumns({c: encrypted(F.col(c), key) for c in SECRET if c in df.columns})


def decrypt(df: DataFrame, key: str) -> DataFrame:
    return df.withColumns({c: decrypted(F.col(c), key) for c in SECRET if c in df.columns})
