"""Removal of lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import BLANKS, ascii_lower, digest128, free_name, replacing, text_or_empty
from emberline.plans.staging import stage


def _key(line: Column) -> Column:
    return F.btrim(ascii_lower(line), F.lit(BLANKS))


def line_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, by_text: bool = False, classes: DataFrame | None = None
) -> DataFrame:
    """All columns of ``df`` with the text less its frequent lines, and ``n_lines`` (before) and ``n_dropped``.

    Lines are exploded, keyed by a 128-bit hash of the line without outer ASCII blanks and with A-Z in lower case, and
    the distinct documents of each key counted (partial counts first, so a line that every document has is no hot
    task). Keys in at least ``min_docs`` documents form a table in the shared folder. Line positions, without text,
    join it; the adaptive join splits hot keys. Dropped positions return to their row, and the row's lines are put
    together again in order.

    Null or empty text is one empty line; the result's text is then empty. Lines whose key is shorter than
    ``min_chars`` code points always stay. Null ids count as one document. Rows are told apart by id and text, so an
    id that repeats with another text keeps its own lines; it counts as one document. ``n_lines`` and ``n_dropped`` of
    the input are replaced.

    ``by_text`` counts different texts instead of documents: rows whose non-blank line keys are all the same count once,
    so copies of one text do not make its lines frequent. ``classes`` (id, class), one row an id, counts classes of documents instead, say
    near-duplicates; only lines' hashes and ids are joined with it. An id without a class is one of its own.
    """
    row, lines, gone = (free_name(df, x) for x in ("_row", "_lines", "_gone"))
    text = text_or_empty(f"`{text_col}`")
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    doc = digest128(F.array_join(F.filter(F.transform(F.split(text, "\n"), _key), lambda k: k != ""), "\n")) if by_text else ident
    # Digests of whole texts are computed below the explode; beside it, every line would compute them again.
    keyed = df.select(doc.alias("doc"), digest128(F.concat_ws("\n", ident, text)).alias("row"), F.split(text, "\n").alias("lines"))
    keyed = keyed.select("doc", "row", F.posexplode("lines").alias("pos", "line")).select("doc", "row", "pos", _key(F.col("line")).alias("key")).filter(F.char_length("key") >= max(min_chars, 1))
    keyed = keyed.select("doc", "row", "pos", digest128(F.col("key")).alias("h"))
    counted = keyed
    if classes is not None:
        of = classes.toDF("of", "class").select(F.coalesce(F.col("of").cast("string"), F.lit("null")).alias("doc"), F.concat(F.lit("class "), F.col("class").cast("string")).alias("class"))
        counted = keyed.select("doc", "h").distinct().join(of, "doc", "left").select("h", F.coalesce("class", "doc").alias("doc"))
    frequent = stage(counted.groupBy("h").agg(F.countDistinct("doc").alias("n")).filter(F.col("n") >= min_docs).select("h"), "frequent-lines")
    dropped = keyed.join(frequent, "h", "left_semi").groupBy("row").agg(F.collect_set("pos").alias(gone)).withColumnRenamed("row", row)
    whole = df.select(
        *[F.col(f"`{c}`") for c in df.columns if c != text_col],
        digest128(F.concat_ws("\n", ident, text)).alias(row),
        F.split(text, "\n").alias(lines),
    )
    joined = whole.join(dropped, row, "left")
    n = F.size(lines)
    stays = F.array_except(F.sequence(F.lit(0), n - 1), F.col(gone))
    kept = F.when(F.col(gone).isNull(), F.array_join(lines, "\n")).otherwise(F.array_join(F.transform(stays, lambda i: F.get(F.col(lines), i)), "\n"))
    out = replacing(joined, {text_col: kept, "n_lines": n.cast("long"), "n_dropped": F.coalesce(F.size(gone), F.lit(0)).cast("long")}).drop(row, lines, gone)
    return out.select(*[f"`{c}`" for c in df.columns if c.lower() not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
