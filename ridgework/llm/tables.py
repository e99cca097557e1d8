"""What the operators of this subpackage share: input tables, the word rules and output schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# White space of the quality and fingerprint rules: space and \x09 to \x0D.
SPACES = " \t\n\x0b\f\r"

# Fixed rule: A-Z become a-z; digits, a-z and every byte of a non-ASCII character belong to words.
WORD_BYTES = bytes(
    byte + 32 if 0x41 <= byte <= 0x5A else byte if 0x30 <= byte <= 0x39 or 0x61 <= byte <= 0x7A or byte >= 0x80 else 0x20
    for byte in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_words(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text, as UTF-8; NULL has none."""
    return (text or "").encode().translate(WORD_BYTES).split()


def column_or_null(df: DataFrame, name: str, kind: str):
    """A column by name, or NULL of ``kind`` where the table lacks it."""
    from pyspark.sql import functions as F

    return df[name].cast(kind) if name in df.columns else F.lit(None).cast(kind)
