"""License scan: MinHash bands over overlapping text windows, then exact shingle containment.

Texts become keys of five-word shingles. Windows of WINDOW shingles start at every STRIDE-th
shingle of a document and at every shingle of a template longer than SHORT. A window's
signature has BANDS minima of its keys, each under another XOR mask, one a band: two windows
whose sets have the Jaccard similarity J share a band with probability 1 - (1 - J) ** BANDS.
Shared bands, or for templates of up to SHORT shingles any shared shingle, retrieve
(document, template) pairs; the distinct shared shingles of these pairs are then counted
over the whole document, wherever they stand, so a notice in pieces counts with all of them.

What is missed: a document with 3/4 of a template of more than SHORT shingles holds at least
one run of eight of them or more. The windows at hand take six of the run at worst, two of
them then, J = 1/3: both miss with 0.0016. Two such runs leave 2e-6; runs of twelve, J = 1/2
or more, 1.5e-5 alone. Unbroken stretches of WINDOW + STRIDE - 1 shingles are never missed.

Windows are row-local; only retrieved pairs and shared shingles are shuffled, and texts meet
the pairs in a join by document, salted by text. All of it is native.

Defined cases: a null, empty or shorter text matches nothing; rows of one doc_id (or of
none) report together, each template once with the shingles of all of them; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyarc.functions.binding import let

SHINGLE, SHORT, WINDOW, STRIDE, BANDS = 5, 28, 12, 8, 8
#: Rows of one doc_id are dealt to this many parts by text, so that copies of an id don't meet in one task.
SALTS = 16
#: The table of template keys goes to every task; more rows than this are an error.
MOST_KEYS = 1_000_000

#: Notices and texts of public licences, by licence and form.
TEMPLATES = {
    "apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0/header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express
        or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "bsd/text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.""",
    "cc-by-4.0/line": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0/line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0/line": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0/header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in
        the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU General Public License for more details.""",
    "isc/text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies.""",
    "mit/line": "Released under the MIT License.",
    "mit/text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.""",
    "mpl-2.0/header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}


def shingle_keys(text: Column) -> Column:
    """Keys of the shingles in text order. Words are runs of letters and digits in lower case."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return let(lambda v: F.when(F.size(v.w) >= SHINGLE, F.transform(F.sequence(F.lit(1), F.size(v.w) - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(v.w, i, SHINGLE))))
               .otherwise(F.array().cast("array<bigint>")), w=words)


def masks() -> list[int]:
    """A mask for each band: the leading bits number the bands, so each band prefers other keys; the rest is a fixed draw."""
    draw = random.Random(1)
    unsigned = [(band << 61) | draw.getrandbits(61) for band in range(BANDS)]
    return [m - (m >> 63 << 64) for m in unsigned]


def windows(shingled: DataFrame, stride: int) -> DataFrame:
    """A row for each window: start (in shingles), its first ``stride`` keys as ``own`` and the minimum of each band as ``bands``."""
    starts = F.when(F.size("shingles") > 0, F.sequence(F.lit(0), F.size("shingles") - 1, F.lit(stride)))
    # outer: else Catalyst adds a filter that works out the shingles twice
    rows = shingled.withColumn("n", F.size("shingles")).withColumn("start", F.explode_outer(starts))
    # a generator again, so that the slice is compiled and isn't put into the lambda below, where it would copy the whole text's keys
    inside = rows.withColumn("inside", F.explode(F.array(F.slice("shingles", F.col("start") + 1, WINDOW)))).drop("shingles")
    bands = F.transform(F.array(*map(F.lit, masks())), lambda m: F.array_min(F.transform("inside", lambda x: x.bitwiseXOR(m))))
    return inside.withColumns({"own": F.slice("inside", 1, stride), "bands": bands})


def template_keys(templates: DataFrame) -> DataFrame:
    """Distinct shingles of the templates (license_id, text): key, license_id, template_shingles."""
    keys = templates.select("license_id", F.explode(shingle_keys(F.col("text"))).alias("key")).distinct()
    sizes = keys.groupBy("license_id").agg(F.count("*").alias("template_shingles"))
    return keys.join(sizes, "license_id").select("key", "license_id", "template_shingles")


def window_keys(templates: DataFrame) -> DataFrame:
    """What retrieves a template: the band minima of its whole windows, or the single shingles of a short one (window_key, license_id)."""
    shingled = templates.select("license_id", shingle_keys(F.col("text")).alias("shingles"))
    keys = F.when(F.col("n") <= SHORT, F.col("own")).when(F.size("inside") == WINDOW, F.col("bands"))
    return windows(shingled, 1).select(F.explode(keys).alias("window_key"), "license_id").distinct()


def checked(keys: DataFrame) -> DataFrame:
    """``keys`` to be broadcast, if they aren't more than MOST_KEYS."""
    if (rows := keys.count()) > MOST_KEYS:
        raise ValueError(f"{rows} template keys, more than {MOST_KEYS}")
    return F.broadcast(keys)


def retrieved(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """Distinct (doc_id, license_id) of which a window shares a band, or a shingle with a short template."""
    rows = windows(docs.select("doc_id", shingle_keys(F.col("text")).alias("shingles")), STRIDE)
    keyed = rows.select("doc_id", F.explode_outer(F.concat("own", "bands")).alias("key"))
    return keyed.join(checked(window_keys(templates)), F.col("key") == F.col("window_key")).select("doc_id", "license_id").distinct()


def scan(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, least: float = 0.75) -> DataFrame:
    """doc_id, license_id, template_shingles, matched, containment: templates of which the document holds at least ``least``."""
    spark = docs.sparkSession
    if not isinstance(templates, DataFrame):
        templates = spark.createDataFrame(list((templates or TEMPLATES).items()), "license_id string, text string")
    pairs = retrieved(docs, templates).groupBy("doc_id").agg(F.collect_set("license_id").alias("licenses"))  # at most as many as there are templates
    pairs = pairs.select(F.col("doc_id").alias("found_id"), "licenses", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("found_salt"))
    texts = docs.select("doc_id", "text", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int").alias("salt"))
    met = texts.join(pairs, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("salt") == F.col("found_salt")))
    shingles = met.select("doc_id", "licenses", F.explode_outer(shingle_keys(F.col("text"))).alias("shingle"))
    shared = shingles.join(checked(template_keys(templates)), F.col("shingle") == F.col("key")).where(F.array_contains("licenses", F.col("license_id")))
    distinct = shared.select("doc_id", "license_id", "template_shingles", "key").distinct()
    found = distinct.groupBy("doc_id", "license_id", "template_shingles").agg(F.count("*").alias("matched"))
    return found.where(F.col("matched") >= least * F.col("template_shingles")).withColumn("containment", F.col("matched") / F.col("template_shingles"))


def oracle(templates: dict[str, str] | None = None, least: float = 0.75) -> str:
    """The same by brute force over all shingles of all documents."""
    values = ", ".join("('{}', '{}')".format(k, " ".join(t.split()).replace("'", "''")) for k, t in (templates or TEMPLATES).items())
    words = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
    cut = "unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))"
    return f"""
WITH t AS (SELECT DISTINCT license_id, {cut} AS s FROM (SELECT license_id, {words} AS w FROM (VALUES {values}) v(license_id, text))),
d AS (SELECT DISTINCT doc_id, {cut} AS s FROM (SELECT doc_id, {words} AS w FROM documents)),
n AS (SELECT license_id, count(*) AS template_shingles FROM t GROUP BY license_id),
m AS (SELECT doc_id, license_id, count(*) AS matched FROM d JOIN t USING (s) GROUP BY doc_id, license_id)
SELECT doc_id, license_id, template_shingles, matched, matched / template_shingles AS containment FROM m JOIN n USING (license_id)
WHERE matched >= {least} * template_shingles"""
