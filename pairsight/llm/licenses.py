"""License scans: MinHash bands over overlapping windows find templates, exact shingle containment confirms them.

Templates are put into classes by their number of shingles, up to 1, 2, 4, 8 and so on. For a class of size s, a text's
shingles are cut into windows of 2 s, one every s, so a template's place in a text lies whole in some window. There it
makes up at least a quarter of the shingles, or a fifth where a fifth of the template is missing; BANDS minima, each a
band of its own, then meet the template's in at least one with a probability of 1 - 0.8 ** BANDS, 0.9999.

Windows that share no shingle with any template can contain none and are left out before any minimum is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, lower_ascii, once, row_key

WORD = "[a-z0-9]+"
SHINGLE, CONTAINED, BANDS = 5, 0.8, 42
#: Bits of the table of template shingles.
TABLE_BITS = 16
#: Rows of templates, one for each band, that are broadcast at most.
BROADCAST_ROWS = 200_000

#: Notices by which common licenses are applied to a work.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def shingles(text: Column) -> Column:
    """Hashes of all runs of SHINGLE words, in order, with repeats; none for a text of fewer words."""
    words = F.transform(F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    return let(words, lambda w: F.when(F.size(w) < SHINGLE, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - SHINGLE + 1), lambda i: F.xxhash64(F.slice(w, i, F.lit(SHINGLE))))))


def minima(window: Column, bands: int = BANDS) -> Column:
    """The smallest of each band's hashes of a set of shingles."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.array_min(F.transform(window, lambda s: F.xxhash64(s, b))))


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "license string, template string")


def scan_licenses(docs: DataFrame, templates: DataFrame, doc_id: str = "doc_id", text: str = "text", contained: float = CONTAINED) -> DataFrame:
    """A row for each row of docs and license found in it: doc_id, license, containment, first_word, n_windows.

    containment is the largest share of a template's different shingles in one window, first_word the first place of
    such a window in words, n_windows how many windows contain a template. A template of fewer than SHINGLE words can't
    be found. Null texts are empty. Rows of docs that repeat, or have null ids, are rows of their own; templates that
    repeat count once. Other columns are ignored.
    """
    t = templates.select("license", F.array_distinct(shingles(F.col("template"))).alias("set")).where(F.size("set") > 0).distinct()
    t = cut(t.withColumn("class", F.pow(F.lit(2.0), F.ceil(F.log2(F.size("set").cast("double")))).cast("int")))
    classes = sorted(r["class"] for r in t.select("class").distinct().collect())  # as many as an int has bits, at most
    slot = lambda h: h.bitwiseAND(F.lit((1 << TABLE_BITS) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot(F.col("s")) % 64).cast("int"))
    have = t.select(F.explode("set").alias("s")).select((slot(F.col("s")) / 64).cast("int").alias("i"), bit.alias("b"))
    every = docs.sparkSession.range((1 << TABLE_BITS) // 64).select(F.col("id").cast("int").alias("i"), F.lit(0).cast("long").alias("b"))
    table = have.unionByName(every).groupBy("i").agg(F.bit_or("b").alias("b")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "b"))), lambda x: x["b"]).alias("t"))
    rows = once(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), row=row_key(F.col("text")), s=shingles(F.col("text"))).drop("text")
    known = lambda s: F.call_function("shiftright", F.get("table", (slot(s) / 64).cast("int")), (slot(s) % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    places = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: known(F.get("s", i)))
    rows = once(rows.where(F.size("s") > 0).withColumn("table", table.scalar()), places=places).where(F.size("places") > 0).drop("table")
    # a window is known by its class and its place in strides; a shingle lies in two of each class
    near = lambda c: F.flatten(F.transform("places", lambda i: F.array(F.floor(i / c).cast("int"), F.floor(i / c).cast("int") - 1)))
    windows_of = lambda c: F.transform(F.filter(F.array_distinct(near(c)), lambda k: k >= 0), lambda k: F.struct(F.lit(c).alias("class"), k.alias("k")))
    windows = F.concat(*map(windows_of, classes)) if classes else F.array().cast("array<struct<class:int,k:int>>")
    w = rows.select("doc_id", "row", "s", F.explode(windows).alias("w")).select("doc_id", "row", "s", "w.class", (F.col("w.k") * F.col("w.class")).alias("at"))
    w = once(w, set=F.array_distinct(F.slice("s", F.col("at") + 1, 2 * F.col("class")))).drop("s")
    banded = w.select("*", F.posexplode(minima(F.col("set"))).alias("band", "least"))
    mine = t.select("license", F.col("set").alias("template"), "class", F.posexplode(minima(F.col("set"))).alias("band", "least"))
    found = banded.join(F.broadcast(mine) if t.count() * BANDS <= BROADCAST_ROWS else mine, ["class", "band", "least"])
    share = F.size(F.array_intersect("set", "template")) / F.size("template")
    found = once(found, share=share).where(F.col("share") >= contained).select("doc_id", "row", "license", "class", "at", "band", F.xxhash64("template").alias("template"), "share")
    # rows that repeat come here together: a band of a window finds a template once for each
    found = found.groupBy("doc_id", "row", "license", "class", "at", "band", "template").agg(F.max("share").alias("share"), F.count("*").alias("copies"))
    found = found.groupBy("doc_id", "row", "license", "class", "at").agg(F.max("share").alias("share"), F.max("copies").alias("copies"))
    best = F.min(F.struct((-F.col("share")).alias("share"), "at"))
    found = found.groupBy("doc_id", "row", "license").agg(best.alias("best"), F.count("*").alias("n_windows"), F.max("copies").alias("copies"))
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return found.select("doc_id", "license", (-F.col("best.share")).alias("containment"), F.col("best.at").cast("long").alias("first_word"), "n_windows")
