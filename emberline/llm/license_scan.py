"""Licence notices in texts: MinHash retrieval over windows, exact shingle containment to verify."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import ascii_lower, digest128, text_or_empty
from emberline.plans.staging import stage

SHINGLE = 5  # words
WINDOW, STRIDE = 4, 2  # shingles; every run of three shingles lies whole in some window

# Wordings of public licence notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0 header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0 terms", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]


def bands_for(miss: float = 1e-6) -> int:
    """Bands of one minimum each, so that a window that holds a one-shingle template (similarity 1 / window) is missed
    with at most that probability; windows of longer templates share more."""
    return math.ceil(math.log(miss) / math.log(1 - 1 / WINDOW))


def words_of(text: Column) -> Column:
    """Runs of letters and digits, A-Z in lower case."""
    return F.filter(F.split(ascii_lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shifted(a: Column, k: int) -> Column:
    """``a`` moved left by k places; right by -k, with nulls before."""
    if k < 0:
        return F.concat(F.array(*[F.lit(None).cast("long")] * -k), a)
    return F.slice(a, k + 1, F.size(a)) if k else a


def _hashes(df: DataFrame, keys: list[str], words: Column) -> DataFrame:
    """``keys`` and ``h``: 64-bit hashes of the five-word shingles, in order."""
    rows = df.select(*keys, words.alias("w")).filter(F.size("w") >= SHINGLE)
    five = F.arrays_zip(*[F.slice("w", k + 1, F.size("w") - SHINGLE + 1).alias(f"w{k}") for k in range(SHINGLE)])
    return rows.select(*keys, F.transform(five, lambda z: F.xxhash64(*[z.getField(f"w{k}") for k in range(SHINGLE)])).alias("h"))


def _bands(shingles: list[Column], bands: int) -> Column:
    """Minimum of each band's hash over a window's shingles; nulls are skipped."""
    return F.array(*[F.array_min(F.array(*[F.when(h.isNotNull(), F.xxhash64(h, F.lit(b))) for h in shingles])) for b in range(bands)])


def license_scan(df: DataFrame, templates: list[tuple[str, str]] | DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """One row per notice found: id, template, first_word, last_word, n_found, n_template.

    1. Texts become hashes of five-word shingles (letters and digits, A-Z in lower case), windows of 4 shingles every 2.
    Only windows with some template shingle can share a minimum with a template, so a join on the shingle keeps those,
    each row with its neighbours; nothing else leaves its task. 2. Each window has one MinHash per band, as has each
    window of a template (at every place). Windows that agree in a band retrieve the template; the number of bands follows from
    ``miss``, see ``bands_for``. 3. Only for the templates a text retrieved, the places of their shingles in it are parted where they no longer
    fit one notice: where the next place is further off than the template is long, or not further on in the template. Neighbouring parts
    that hold less than ``percent`` of the template's distinct shingles are joined. A part, or parts joined, that a retrieving
    window touches and that holds at least ``percent`` is a notice, so words inserted cost only the shingles they break.

    ``templates`` are (name, text) pairs or a table with those columns, of at least five words each; shorter ones cannot be found.
    A name may have several wordings; each is a template.
    Null or short texts give no rows. Rows that repeat id and text count once; a null id is kept. Other columns are not read.
    """
    spark = df.sparkSession
    if not isinstance(templates, DataFrame):
        templates = spark.createDataFrame(templates or TEMPLATES, "name string, text string")
    bands = bands_for(miss)
    # Inside, ``name`` is the digest of name and wording, so several wordings of one name are searched each.
    wordings = templates.select(F.col("name").alias("title"), text_or_empty("text").alias("text")).withColumn("name", digest128(F.concat_ws("\n", F.coalesce("title", F.lit("null")), "text")))
    known = _hashes(wordings, ["name"], words_of(F.col("text")))
    titles = wordings.groupBy("name").agg(F.first("title").alias("template"))
    known = stage(known.groupBy("name").agg(F.first("h").alias("h")), "licence-templates")
    # ``place`` in the template, null for a shingle it holds more than once; ``reach`` is the template's length in words.
    parts = known.select("name", F.posexplode("h").alias("place", "h")).groupBy("name", "h").agg(F.when(F.count(F.lit(1)) == 1, F.min("place")).alias("place"))
    sizes = parts.groupBy("name").agg(F.count(F.lit(1)).alias("n_template")).join(known.select("name", (F.size("h") + SHINGLE - 1).alias("reach")), "name")
    held = known.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("h") - WINDOW + 1, F.lit(1))), lambda i: F.slice("h", i, WINDOW))).alias("win"))
    held = held.select("name", F.posexplode(_bands([F.get("win", k) for k in range(WINDOW)], bands)).alias("band", "value")).distinct()

    ident, text = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")), text_or_empty(f"`{text_col}`")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), digest128(F.concat_ws("\n", ident, text)).alias("row"), text.alias("text"))
    hashed = _hashes(rows, ["id", "row"], words_of(F.col("text")))
    reach = range(1 - WINDOW, WINDOW)
    around = hashed.select("id", "row", F.posexplode(F.arrays_zip(*[_shifted(F.col("h"), k).alias(f"n{k + WINDOW}") for k in reach])).alias("pos", "z"))
    around = around.select("id", "row", "pos", *[F.col(f"z.n{k + WINDOW}") for k in reach]).withColumn("h", F.col(f"n{WINDOW}"))
    hits = stage(around.join(parts.select("h").distinct(), "h"), "licence-hits")

    # The two windows over a place start at the even place at or before it and STRIDE before that.
    start = F.col("pos") % STRIDE
    near = lambda shift: F.struct((F.col("pos") - shift).alias("at"), *[F.col(f"n{WINDOW - shift + k}").alias(f"h{k}") for k in range(WINDOW)])
    windows = hits.select("id", "row", F.explode(F.when(start == 0, F.array(near(0), near(2))).otherwise(F.array(near(1), near(3)))).alias("w"))
    windows = windows.select("row", "w.*").filter("at >= 0").distinct()
    banded = windows.select("row", "at", F.posexplode(_bands([F.col(f"h{k}") for k in range(WINDOW)], bands)).alias("band", "value"))
    retrieved = stage(banded.join(held, ["band", "value"]).select("row", "name", "at").distinct(), "licence-retrieved")

    # A part ends where a shingle comes again or a place goes back in the template, or where the gap is longer than the template.
    order = Window.partitionBy("row", "name").orderBy("pos")
    placed = hits.select("id", "row", "pos", "h").distinct().join(parts, "h").join(retrieved.select("row", "name").distinct(), ["row", "name"], "left_semi").join(sizes, "name")
    back = F.col("place") <= F.last("place", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    far = lambda start, end: F.col(start) - F.col(end) > F.col("reach")
    placed = placed.withColumn("before", F.lag("pos").over(order)).withColumn("new", F.coalesce((back | far("pos", "before")).cast("int"), F.lit(0))).withColumn("part", F.sum("new").over(order))
    pieces = placed.groupBy("row", "name", "part").agg(
        F.first("id").alias("id"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("h").alias("hs"), F.first("n_template").alias("n_template"), F.first("reach").alias("reach")
    )
    # Neighbouring parts too small on their own are taken together.
    order = Window.partitionBy("row", "name").orderBy("part")
    pieces = pieces.withColumn("whole", F.size("hs") * 100 >= F.col("n_template") * percent).withColumn("before", F.lag("last").over(order))
    alone = F.col("whole") | F.lag("whole").over(order) | far("first", "before")
    pieces = pieces.withColumn("part", F.sum(F.coalesce(alone.cast("int"), F.lit(0))).over(order))
    found = pieces.withColumn("h", F.explode("hs")).groupBy("row", "name", "part").agg(
        F.first("id").alias("id"), F.min("first").alias("first_word"), (F.max("last") + SHINGLE - 1).alias("last_word"), F.countDistinct("h").alias("n_found"), F.first("n_template").alias("n_template")
    )
    found = found.filter(F.col("n_found") * 100 >= F.col("n_template") * percent)
    touched = (F.col("at") <= F.col("last_word") - SHINGLE + 1) & (F.col("at") + WINDOW > F.col("first_word"))
    matches = found.join(retrieved.withColumnsRenamed({"row": "_row", "name": "_name"}), (F.col("row") == F.col("_row")) & (F.col("name") == F.col("_name")) & touched, "left_semi")
    return matches.join(titles, "name").select(F.col("id").alias(id_col), "template", "first_word", "last_word", "n_found", "n_template")
