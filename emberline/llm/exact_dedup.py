"""Exact deduplication by a 128-bit content hash with a comparison of bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import ascii_lower, digest128, text_or_empty


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", hashed=digest128) -> DataFrame:
    """One row per input row: its group of equal texts, the id that stays, and whether this row does.

    Texts are equal when identical after lower-casing A-Z. Grouping on the hash *and* the text compares bytes inside
    every hash group, so a collision of the hash separates. The map-side aggregate folds copies before the shuffle:
    each task sends a text once, however hot it is. Rows then look their group up by hash, length and SHA-256, without
    their text; large groups are split by the adaptive skew join.

    Columns: id, keep_id, group_size, kept, text_sha256, normalised length ``n_bytes``. ``keep`` is ``smallest`` or
    ``largest`` id. Null text counts as empty. A null id is never the id that stays unless its group has no other;
    its row then has keep_id null and is not kept. Rows that repeat an id with an equal text count in group_size and
    share one verdict. An empty table gives no rows; other columns are not read.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    text = df.select(F.col(f"`{id_col}`").alias("id"), ascii_lower(text_or_empty(f"`{text_col}`")).alias("t"))
    text = text.select("id", "t", hashed(F.col("t")).alias("h"))

    def sealed(*more: str | Column) -> list:
        return ["h", F.octet_length("t").alias("n_bytes"), F.sha2("t", 256).alias("sha"), *more]

    groups = text.groupBy("h", "t").agg(F.count(F.lit(1)).alias("group_size"), best("id").alias("keep_id")).select(*sealed("group_size", "keep_id"))
    return (
        text.select(*sealed("id"))
        .join(groups, ["h", "n_bytes", "sha"])
        .select(
            F.col("id").alias(id_col),
            "keep_id",
            "group_size",
            F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"),
            F.col("sha").alias("text_sha256"),
            "n_bytes",
        )
    )
