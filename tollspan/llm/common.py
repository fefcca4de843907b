"""Small helpers shared by the text and vector operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's text modulo `modulus`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(modulus))


def free_name(taken: Iterable[str], wanted: str) -> str:
    """A column name that clashes with none of `taken` (compared without case, as Spark does)."""
    used = {c.lower() for c in taken}
    while wanted.lower() in used:
        wanted += "_"
    return wanted


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a text as UTF-8, with only A-Z lowered.

    On bytes, `lower` touches ASCII letters only and `split` cuts at exactly those six characters.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
