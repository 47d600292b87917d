"""Licence scans in DataFrame operations only: TF-IDF cosine to templates, then inheritance along directories.

A unit is a line, sentence or paragraph that speaks of licensing, its wrapped
lines joined and comment marks left out, and the whole text of a licence file.  Its cosine to every template is computed within the row, as the
vocabulary is that of the templates; the document frequencies of its terms are
counted over all units.  A file without a licence of its own takes that of the
nearest directory above it that has a licence file.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegraph.llm.shared import broadcast_if_small, written

#: Standard notices, as their publishers recommend them.
TEMPLATES = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights, CC0 1.0"),
    ("Proprietary", "All rights reserved"),
)
#: Units speak of one of these.
SPEAKS = r"(?i)licen[cs]e|copyright|redistribut|permission is hereby|all rights reserved|creative commons|\bcc0\b|\bcc[ -]by\b"
LICENCE_FILE = r"(?i)(?:^|/)(?:licen[cs]e|copying|notice)(?:\.[^/]*)?$"
#: Marks of comments before and after the words of a line.
MARKS = r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|--+|;+|%+|<!--)[ \t]*|[ \t]*(?:\*/|-->)[ \t]*$"
PARAGRAPHS = r"\n[ \t]*\n\s*"
#: No sentence ends at a single letter, as in "v. 2.0".
ENDS = r"(?<=[.!?])(?<!\b[A-Za-z]\.)\s+"
SENTENCES = rf"\n+|{ENDS}"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
LEAST = 0.6


def terms_of(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def _terms(unit: Column) -> Column:
    return F.regexp_extract_all(F.lower(unit), F.lit(TERM), F.lit(0))


def _units(path: Column, text: Column) -> Column:
    """What speaks of licensing of the lines, sentences and paragraphs, each once; in a licence file also the whole text."""
    speaks = lambda s: F.regexp_like(s, F.lit(SPEAKS))
    plain = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), MARKS, "")
    joined = F.transform(F.filter(F.split(plain, PARAGRAPHS), lambda p: F.regexp_like(F.regexp_replace(p, r"\s*\n\s*", " "), F.lit(SPEAKS))), lambda p: F.regexp_replace(p, r"\s*\n\s*", " "))
    some = F.concat(F.filter(F.split(plain, SENTENCES), speaks), joined, F.flatten(F.transform(joined, lambda p: F.filter(F.split(p, ENDS), speaks))))
    some = F.when(F.regexp_like(F.regexp_replace(text, r"\s+", " "), F.lit(SPEAKS)), some).otherwise(F.array().cast("array<string>"))
    whole = F.when(F.regexp_like(path, F.lit(LICENCE_FILE)) & (F.trim(text) != ""), F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.transform(F.concat(whole, some), F.trim))


def _weights(df: dict[str, int], units: int) -> tuple[dict[str, float], float]:
    """idf of each template term, and that of all other terms: that of a term no unit has."""
    vocabulary = {t for _, text in TEMPLATES for t in terms_of(text)}
    return {t: math.log((1 + units) / (1 + df.get(t, 0))) + 1 for t in sorted(vocabulary)}, math.log(1 + units) + 1


def _map(table: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])


def best_template(unit: Column, idf: dict[str, float], rare: float) -> Column:
    """The (cosine, -index) of the nearest template."""
    weight, vocabulary = _map(idf), sorted(idf)

    def norm(terms: Column) -> Column:
        start = F.struct(F.lit("").alias("t"), F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("sum"))

        def add(a: Column, t: Column) -> Column:  # equal terms stand together, so squares of counts grow by odd numbers
            had = F.when(a["t"] == t, a["c"]).otherwise(F.lit(0).cast("long"))
            w = F.when(t.isin(vocabulary), F.try_element_at(weight, t)).otherwise(F.lit(rare))
            return F.struct(t.alias("t"), (had + 1).alias("c"), (a["sum"] + w * w * (2 * had + 1)).alias("sum"))

        return F.sqrt(F.aggregate(F.array_sort(terms), start, add)["sum"])

    def score(terms: Column, i: int) -> Column:
        counts: dict[str, int] = {}
        for t in terms_of(TEMPLATES[i][1]):
            counts[t] = counts.get(t, 0) + 1
        length = math.sqrt(sum((c * idf[t]) ** 2 for t, c in counts.items()))
        table = _map({t: c * idf[t] ** 2 / length for t, c in counts.items()})
        return F.aggregate(terms, F.lit(0.0), lambda a, t: a + F.coalesce(F.try_element_at(table, t), F.lit(0.0)))

    def nearest(known: Column) -> Column:
        return F.array_max(F.array(*[F.struct(score(known, i).alias("s"), F.lit(-i).alias("i")) for i in range(len(TEMPLATES))]))

    def best(terms: Column) -> Column:
        # Other terms add nothing to a product, so templates pass over those of the vocabulary alone.
        top = F.transform(F.array(F.filter(terms, lambda t: t.isin(vocabulary))), nearest)
        return F.transform(F.array(norm(terms)), lambda n: F.transform(top, lambda b: F.struct(F.when(n > 0, F.round(F.least(b["s"] / n, F.lit(1.0)), 9)).otherwise(0.0).alias("s"), b["i"].alias("i")))[0])[0]

    return F.transform(F.array(_terms(unit)), best)[0]


def scan(files: DataFrame, *keep: str, least: float = LEAST) -> DataFrame:
    """The columns `keep` of `files` (path, text, ...) with license, score, origin and licensed_by.

    license is the template with the greatest cosine of any unit of the file if
    that is `least` or more (origin "own"; ties go to the template first in the
    table), else that of the licence files of the nearest directory above or at the
    file (origin "inherited", licensed_by the directory, "" the root; of several the
    greatest score, then the first by name), else null (origin "none").  A null or
    empty text has no licence of its own; a null path has no directory.
    Of equal units of one file
    one counts.  Repeated rows are scanned each; which other columns there are makes no difference.
    """
    rows = files.select(*[F.col(c).alias(f"__keep_{i}") for i, c in enumerate(keep)], F.col("path").alias("__path"), _units(F.coalesce("path", F.lit("")), F.coalesce("text", F.lit(""))).alias("__units"))
    rows = written(rows, "units")
    vocabulary = sorted({t for _, text in TEMPLATES for t in terms_of(text)})
    units = rows.select(F.explode("__units").alias("unit"))
    counted = units.select(F.explode(F.concat(F.array(F.lit("")), F.array_distinct(F.filter(_terms(F.col("unit")), lambda t: t.isin(vocabulary))))).alias("term")).groupBy("term").count().collect()
    df = {r["term"]: r["count"] for r in counted}
    idf, rare = _weights(df, df.get("", 0))
    names = F.array(*[F.lit(n) for n, _ in TEMPLATES])
    best = F.when(F.size("__units") > 0, F.array_max(F.transform("__units", lambda u: best_template(u, idf, rare))))
    own = rows.withColumn("__best", best).drop("__units").withColumn("__best", F.when(F.col("__best.s") >= least, F.col("__best")))
    own = own.withColumn("__own", F.when(F.col("__best").isNotNull(), F.get(names, -F.col("__best.i")))).withColumn("__dir", F.regexp_replace(F.col("__path"), r"/?[^/]*$", ""))
    own = written(own.withColumn("__score", F.col("__best.s")).drop("__best"), "own")

    named = own.filter(F.col("__own").isNotNull() & F.regexp_like("__path", F.lit(LICENCE_FILE)))
    by_dir = written(named.groupBy("__dir").agg(F.min(F.struct((-F.col("__score")).alias("s"), F.col("__own").alias("license"))).alias("found")).withColumnRenamed("__dir", "above"), "by_dir")
    parts = F.split("__dir", "/")
    dirs = own.filter("__dir is not null").select("__dir").distinct()
    above = dirs.select("__dir", F.explode(F.concat(F.array(F.lit("")), F.when(F.col("__dir") != "", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>")))).alias("above"))
    # Every directory looks under the root and its top directories, and one directory may hold most rows: a small side is sent to all tasks.
    nearest = written(above.join(broadcast_if_small(by_dir), "above").groupBy("__dir").agg(F.max(F.struct(F.length("above").alias("depth"), "above", "found")).alias("near")), "nearest")
    out = own.join(broadcast_if_small(nearest), "__dir", "left")
    is_own, has = F.col("__own").isNotNull(), F.col("near").isNotNull()
    return out.select(
        *[F.col(f"__keep_{i}").alias(c) for i, c in enumerate(keep)],
        F.coalesce("__own", "near.found.license").alias("license"), F.coalesce("__score", -F.col("near.found.s")).alias("score"),
        F.when(is_own, "own").when(has, "inherited").otherwise("none").alias("origin"), F.when(~is_own, F.col("near.above")).alias("licensed_by"),
    )
