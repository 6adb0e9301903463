"""What several of the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ASCII letters and ASCII white space.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, all other characters as they are. Pure ASCII takes the engine's fast path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def replacing(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """All columns of ``df`` with ``new`` ones; an input column of the same name is replaced."""
    low = {k.lower() for k in new}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low], *[v.alias(k) for k, v in new.items()])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def digest128(c: Column) -> Column:
    """128-bit digest as 16 bytes."""
    return F.unhex(F.md5(c))
