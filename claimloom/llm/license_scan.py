"""Licence scan: normalised text against licence templates by Dice coefficient over word bigrams.

Units are the lines of a text and, where it has several, the whole text. Normalised means lower case with runs of anything but
a-z and 0-9 as one space. The coefficient is 2 * shared / (a + b) over multisets of bigrams. A unit of n
bigrams can reach a threshold t only with templates of t / (2 - t) * n to (2 - t) / t * n bigrams: units
outside the bounds of all templates are dropped before any bigram is made, the rest meets only templates
inside its own bounds. Bigrams find templates through an index of template bigrams, so text is never paired
with every template.

DataFrame functions only. The template index is broadcast: ``MAX_TEMPLATES`` templates at most, each of at
most ``MAX_WORDS`` words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import load

THRESHOLD = 0.8
MAX_TEMPLATES, MAX_WORDS = 2000, 5000

# Public licence notices as they are commonly put into files.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher."),
)


def default_templates(spark) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "license_id string, template string")


def normalised(text: Column) -> Column:
    """Lower case; line ends stay, every other run of anything but a-z and 0-9 is one space."""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9\n]+", " ")


def words_of(line: Column) -> Column:
    return F.split(F.trim(line), " +")


def bigrams_of(words: Column) -> Column:
    n = F.size(words) - 1
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def _index(templates: DataFrame) -> DataFrame:
    """(bigram, license_id, template_no, size, held): one row per distinct bigram of a template."""
    flat = F.translate(normalised(F.col("template")), "\n", " ")
    rows = templates.filter("template IS NOT NULL AND license_id IS NOT NULL").select("license_id", flat.alias("flat")).distinct()
    rows = rows.select("license_id", words_of(F.col("flat")).alias("w"), F.dense_rank().over(Window.orderBy("license_id", "flat")).alias("template_no"))
    rows = rows.filter(F.size("w") > 1).withColumn("size", F.size("w") - 1)
    return rows.select("license_id", "template_no", "size", F.explode(bigrams_of(F.col("w"))).alias("bigram")).groupBy(
        "bigram", "license_id", "template_no", "size"
    ).agg(F.count("*").alias("held"))


def scan(
    docs: DataFrame, templates: DataFrame | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per unit that reaches the threshold: doc_id, unit ('line' or 'text'), line (from 1; 0 for the
    text), license_id, dice (six decimals), n_bigrams. The best template counts; ties go to the first name.

    Null, empty and one-word units match nothing; texts of any length are scanned whole. Repeated rows give
    their rows each. Ids may be null. Empty documents or templates give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    templates = default_templates(spark) if templates is None else templates.select("license_id", "template")
    if templates.limit(MAX_TEMPLATES + 1).count() > MAX_TEMPLATES or not templates.filter(F.length("template") > 20 * MAX_WORDS).isEmpty():
        raise ValueError(f"more than {MAX_TEMPLATES} templates, or one of more than {20 * MAX_WORDS} characters")
    index = _index(templates)
    least = threshold / (2 - threshold)
    bounds = index.agg(F.min("size").alias("low"), F.max("size").alias("high")).first()
    low, high = (bounds.low or 0) * least, (bounds.high or 0) / least
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.split(normalised(F.col(text_col).cast("string")), "\n").alias("lines"),
    )
    line = rows.select("row", "doc_id", F.posexplode("lines").alias("line", "s")).select(
        "row", "doc_id", F.lit("line").alias("unit"), (F.col("line") + 1).alias("line"), words_of(F.col("s")).alias("w")
    )
    text = rows.filter(F.size("lines") > 1).select(
        "row", "doc_id", F.lit("text").alias("unit"), F.lit(0).alias("line"), words_of(F.array_join("lines", " ")).alias("w")
    )
    size = F.size("w") - 1
    units = line.unionByName(text).filter((size >= low - 1e-9) & (size <= high + 1e-9) & (size > 0)).withColumn("n", size)
    grams = units.select("row", "doc_id", "unit", "line", "n", F.explode(bigrams_of(F.col("w"))).alias("bigram"))
    inside = (F.col("size") >= F.col("n") * least - 1e-9) & (F.col("size") <= F.col("n") / least + 1e-9)
    hits = grams.join(F.broadcast(index), "bigram").filter(inside)
    keys = ["row", "doc_id", "unit", "line", "n", "template_no", "license_id", "size"]
    shared = hits.groupBy(*keys, "bigram", "held").agg(F.count("*").alias("c")).groupBy(*keys).agg(F.sum(F.least("c", "held")).alias("shared"))
    dice = F.round(2 * F.col("shared") / (F.col("n") + F.col("size")), 6)
    scored = shared.withColumn("dice", dice).filter(F.col("dice") >= threshold)
    best = scored.groupBy("row", "doc_id", "unit", "line", "n").agg(F.max("dice").alias("dice"), F.min_by("license_id", F.struct(-F.col("dice"), "license_id")).alias("license_id"))
    return best.select("doc_id", "unit", "line", "license_id", "dice", F.col("n").alias("n_bigrams"))


def query(spark, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents"))


_VALUES = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in TEMPLATES)
SQL = rf"""
WITH t0(license_id, template) AS (VALUES {_VALUES}),
t1 AS (SELECT license_id, trim(regexp_replace(lower(template), '[^a-z0-9]+', ' ', 'g')) AS flat FROM t0),
t2 AS (SELECT DISTINCT license_id, flat, string_split(flat, ' ') AS w FROM t1),
tg AS (
  SELECT license_id, flat, len(w) - 1 AS size, b, count(*) AS held
  FROM (SELECT license_id, flat, w, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM t2) GROUP BY ALL
), l0 AS (
  SELECT doc_id, string_split(regexp_replace(lower(text), '[^a-z0-9\n]+', ' ', 'g'), chr(10)) AS lines FROM documents
), u0 AS (
  SELECT doc_id, 'line' AS unit, unnest(range(1, len(lines) + 1)) AS line, unnest(lines) AS s FROM l0
  UNION ALL SELECT doc_id, 'text', 0, array_to_string(lines, ' ') FROM l0 WHERE len(lines) > 1
), u1 AS (
  SELECT doc_id, unit, line, string_split(regexp_replace(trim(s), ' +', ' ', 'g'), ' ') AS w FROM u0
), ug AS (
  SELECT doc_id, unit, line, n, b, count(*) AS c FROM (
    SELECT doc_id, unit, line, len(w) - 1 AS n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b
    FROM u1 WHERE len(w) BETWEEN 2 AND 1000
  ) GROUP BY ALL
), d AS (
  SELECT doc_id, unit, line, n, license_id, round(2.0 * sum(least(c, held)) / (n + size), 6) AS dice
  FROM ug JOIN tg USING (b) GROUP BY doc_id, unit, line, n, license_id, flat, size
), r AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, unit, line ORDER BY dice DESC, license_id) AS r FROM d WHERE dice >= {THRESHOLD}
)
SELECT doc_id, unit, line::INTEGER AS line, license_id, dice, n::INTEGER AS n_bigrams FROM r WHERE r = 1
"""
