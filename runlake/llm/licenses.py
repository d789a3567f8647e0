"""Licence scans: sparse TF-IDF cosine to licence templates, and inheritance from the nearest ancestor directory.

DataFrame operations only. Header lines (lines that speak of a licence) and licence files are compared with
the templates; a file without a licence of its own takes that of the nearest directory above it that holds
a licence file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# Licences without families of versions, and their usual statements.
STATEMENTS = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction."),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-1.1", "Licensed under the Apache Software License, Version 1.1."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-4-Clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement. Licensed under the BSD 4-Clause License."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("MPL-1.1", "Licensed under the Mozilla Public License, version 1.1."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("EPL-1.0", "This program is made available under the terms of the Eclipse Public License v1.0."),
    ("EPL-2.0", "This program is made available under the terms of the Eclipse Public License 2.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "This software is provided under the zlib License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Artistic-1.0", "Licensed under the Artistic License 1.0."),
    ("Artistic-2.0", "Licensed under the Artistic License 2.0."),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License, Version 1.0."),
    ("CDDL-1.0", "Licensed under the CDDL, Version 1.0."),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("WTFPL", "Licensed under the WTFPL version 2."),
]
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    " Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
# Names and versions of the licences that come in families.
GNU = [("GPL", "General", ("1", "2", "3")), ("LGPL", "Lesser General", ("2.1", "3")), ("AGPL", "Affero General", ("3",))]
CREATIVE_COMMONS = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
CREATIVE_KINDS, CREATIVE_VERSIONS = ("BY", "BY-NC", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND"), ("2.0", "3.0", "4.0")


def _families() -> list[tuple[str, str]]:
    """Statements of each version of each family, and the SPDX line of every licence."""
    out = [*STATEMENTS, ("BSD-2-Clause", _BSD), ("BSD-3-Clause", _BSD + " " + next(text for name, text in STATEMENTS if text.startswith("Neither")))]
    for short, kind, versions in GNU:
        for v in versions:
            name = f"{short}-{v if '.' in v else v + '.0'}"
            out.append((name, f"Licensed under the GNU {kind} Public License, version {v}."))
            out.append((name, f"This work is licensed under the GNU {kind} Public License, version {v}."))
            out.append((name, f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation, either version {v} of the License, or any later version."))
    for kind in CREATIVE_KINDS:
        long = "-".join(CREATIVE_COMMONS[part] for part in kind.split("-"))
        for v in CREATIVE_VERSIONS:
            out += [(f"CC-{kind}-{v}", f"Licensed under CC {kind} {v}."), (f"CC-{kind}-{v}", f"This work is licensed under a Creative Commons {long} {v} License.")]
    return out + [(name, f"SPDX-License-Identifier: {name}") for name in sorted({name for name, _ in out})]


#: (licence, statement); a statement fits a text only where all its numbers, so its version and clauses, are in the text.
TEMPLATES = _families()
# Words of licences' own names. Like numbers, those of a template must be in a text that it fits.
NAMES = "affero agpl apache artistic attribution boost bsd cc cc0 cddl commons creative development eclipse epl font general gpl isc lesser lgpl mit mozilla mpl nc nd noderivatives noncommercial ofl sa sharealike unlicense wtfpl zlib"
REQUIRED = f"[0-9]|^({NAMES.replace(' ', '|')})$"
#: Of plain words: a statement that something is not under a licence, and one that offers several. RE2 and Java read them alike.
NEGATED = "\\b(not|never|no longer|isn t|wasn t|aren t|weren t)( [a-z0-9]+){0,2} (licen[cs]ed|released|distributed|offered|covered|published|available)\\b"
SEVERAL = "\\b(either|dual|dually|choice|option|spdx)\\b.* or |^spdx.* or "
_SPDX = "spdx license identifier "
#: Words that speak of the choice, which are left out of its parts.
CHOICE = "\\b(either|dual|dually|your|choice|option|at)\\b ?"
#: Templates are broadcast; there may be so many.
MOST_TEMPLATES = 10_000
#: A line that matches is a header; RE2 and Java read it alike.
HEADER = "(?i)licen[cs]e|copyright|spdx|redistribut|permission is hereby|public domain"
#: A file of such a name speaks for its directory.
FILE_NAME = "(?i)^(licen[cs]e|copying|notice)"
#: Least cosine of a match. A file whose whole text comes so near to a template is a licence file too.
LEAST = 0.5
#: The next best licence must lie so far below the best, or none is named.
MARGIN = 0.03


def plain_words(text: Column) -> Column:
    """Words in small letters; a version is one word, and 2.0, v2 and v2.0 read like 2."""
    whole = F.regexp_replace(F.regexp_replace(F.lower(text), "\\bv([0-9])", "$1"), "([0-9])\\.0\\b", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(whole, "([0-9])\\.([0-9])", "$1p$2"), "[^a-z0-9]+", " "))


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST, margin: float = MARGIN) -> DataFrame:
    """path, licence, how ('header', 'file', 'inherited' or null), cosine, declared_by for every row of `files` (path, text).

    A statement names the licence whose template is nearest, if it has that template's numbers and name and no other
    licence is as near but for `margin`. One that says that something is not under a licence names none; one that
    offers several, of which each part names one, names them all, as in 'Apache-2.0 OR MIT'. Of several statements of a file the highest cosine counts, then the
    licence's name; a statement found in a licence file counts as 'file'. Null and empty texts have no statement but may inherit; rows with a null
    path come back without a licence. Rows that repeat a path are one file: each gets the path's result.
    """
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    spark = files.sparkSession
    known = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(templates)], "template int, licence string, text string")
    files = files.select("path", "text")
    stated = files.where(F.col("path").isNotNull() & F.col("text").isNotNull())
    with_header = stated.where(F.col("text").rlike(HEADER) | F.regexp_substr(F.element_at(F.split("path", "/"), -1), F.lit(FILE_NAME)).isNotNull())
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(HEADER))
    whole = F.array(F.struct(F.lit(True).alias("whole"), plain_words(F.col("text")).alias("words")))
    units = with_header.select("path", F.explode(F.concat(whole, F.transform(lines, lambda x: F.struct(F.lit(False).alias("whole"), plain_words(x).alias("words"))))).alias("unit"))
    units = units.select("path", "unit.whole", "unit.words", F.md5("unit.words").alias("unit")).where((F.col("words") != "") & ~F.col("words").rlike(NEGATED))
    units = written(units, "units")

    # a statement that many files share is compared once
    once = units.groupBy("unit").agg(F.first("words").alias("words"), F.count("*").alias("times"))
    spdx = F.col("words").startswith(_SPDX)
    part = F.transform(F.split("words", " or "), lambda x, i: F.when(spdx & (i > 0), F.concat(F.lit(_SPDX), x)).otherwise(x))
    parts = once.where(F.col("words").rlike(SEVERAL)).select("unit", F.explode(part).alias("words")).withColumn("words", F.trim(F.regexp_replace("words", CHOICE, ""))).where("words <> ''").withColumn("part", F.md5("words"))
    parts = written(parts, "parts")
    every = once.unionByName(parts.select(F.col("part").alias("unit"), "words", F.lit(0).cast("long").alias("times"))).groupBy("unit").agg(F.first("words").alias("words"), F.sum("times").alias("times"))
    terms = every.select("unit", "times", F.explode(F.split("words", " ")).alias("term")).groupBy("unit", "term").agg(F.count("*").alias("tf"), F.first("times").alias("times"))
    own = known.select("template", "licence", F.explode(F.split(plain_words(F.col("text")), " ")).alias("term")).groupBy("template", "licence", "term").agg(F.count("*").alias("tf"))
    df = terms.select("term", "times").unionByName(own.select("term", F.lit(1).cast("long").alias("times"))).groupBy("term").agg(F.sum("times").alias("df"))
    total = units.count() + len(templates)
    weight = (1 + F.log("tf")) * (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1)
    weighed = terms.join(df, "term").select("unit", "term", weight.alias("w"))
    own = own.join(df, "term").select("template", "licence", "term", weight.alias("v"))
    number = F.col("term").rlike(REQUIRED)
    norms = own.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), F.count_if(number).alias("numbers"))
    dots = weighed.join(F.broadcast(own), "term").groupBy("unit", "template", "licence").agg(F.sum(F.col("w") * F.col("v")).alias("dot"), F.count_if(number).alias("shared"))
    sizes = weighed.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    cosine = dots.join(F.broadcast(norms), "template").where(F.col("shared") == F.col("numbers")).join(sizes, "unit")
    cosine = cosine.groupBy("unit", "licence").agg(F.max(F.round(F.col("dot") / (F.col("norm") * F.col("size")), 6)).alias("cosine"))
    # a list holds each licence once
    ranked = cosine.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "licence"))).alias("ranked"))
    best, other = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    clear = (-best["c"] >= least) & (other.isNull() | (F.round(other["c"] - best["c"], 6) >= margin))
    found = written(ranked.where(clear).select("unit", best["licence"].alias("licence"), (-best["c"]).alias("cosine")), "found")
    offered = parts.join(found.withColumnRenamed("unit", "part"), "part").groupBy("unit").agg(F.array_sort(F.collect_set("licence")).alias("all"), F.min("cosine").alias("cosine")).where(F.size("all") > 1)
    offered = offered.select("unit", F.array_join("all", " OR ").alias("licence"), "cosine")
    found = found.join(offered, "unit", "left_anti").unionByName(offered)

    # largest cosine, then the licence that comes first: the minimum of (-cosine, licence)
    name = F.element_at(F.split("path", "/"), -1)
    speaks = F.col("whole") | (F.regexp_substr(name, F.lit(FILE_NAME)).isNotNull())
    per_path = units.join(found, "unit").groupBy("path").agg(
        F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("own"),
        F.min(F.when(speaks, F.struct((-F.col("cosine")).alias("c"), "licence"))).alias("file"),
    )
    per_path = written(per_path, "licences")
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    declared = per_path.where(F.col("file").isNotNull() & F.col("path").isNotNull()).groupBy(folder.alias("folder")).agg(F.min(F.struct("file.c", "file.licence", "path")).alias("by"))
    folders = files.where(F.col("path").isNotNull()).select(folder.alias("folder")).distinct()
    steps = F.split("folder", "/")
    above = folders.select("folder", F.explode(F.sequence(F.lit(0), F.size(steps))).alias("depth")).withColumn("above", F.array_join(F.slice(steps, F.lit(1), F.col("depth")), "/"))
    inherited = above.join(declared.withColumnRenamed("folder", "above"), "above").groupBy("folder").agg(F.max_by("by", "depth").alias("by"))
    out = files.select("path", folder.alias("folder")).join(per_path, "path", "left").join(inherited, "folder", "left")
    mine = F.col("own").isNotNull()
    return out.select(
        "path",
        F.when(mine, F.col("own.licence")).otherwise(F.col("by.licence")).alias("licence"),
        F.when(mine & F.col("file").isNotNull(), "file").when(mine, "header").when(F.col("by").isNotNull(), "inherited").alias("how"),
        F.when(mine, -F.col("own.c")).otherwise(-F.col("by.c")).alias("cosine"),
        F.when(mine, F.col("path")).otherwise(F.col("by.path")).alias("declared_by"),
    )


def oracle_sql(path: str = "concat('documents/', source, '/', lang, '/', doc_id)", templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST, margin: float = MARGIN) -> str:
    """The same in DuckDB over `documents`; `path` makes a row's path."""
    plain = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({}), '\\bv([0-9])', '\\1', 'g'), '([0-9])\\.0\\b', '\\1', 'g'), '([0-9])\\.([0-9])', '\\1p\\2', 'g'), '[^a-z0-9]+', ' ', 'g'), ' ')"
    values = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(templates))
    name = f"regexp_matches(list_last(string_split(path, '/')), '{FILE_NAME}')"
    return f"""
WITH files AS (SELECT {path} AS path, text FROM documents),
known(template, licence, text) AS (VALUES {values}),
stated AS (SELECT * FROM files WHERE path IS NOT NULL AND text IS NOT NULL AND (regexp_matches(text, '{HEADER}') OR {name})),
units AS (
  SELECT path, true AS whole, {plain.format("text")} AS words FROM stated
  UNION ALL SELECT path, false, {plain.format("line")} FROM (SELECT path, unnest(string_split(text, chr(10))) AS line FROM stated) WHERE regexp_matches(line, '{HEADER}')
), spoken AS (SELECT * FROM units WHERE words <> '' AND NOT regexp_matches(words, '{NEGATED}')),
parts AS (SELECT unit, trim(regexp_replace(CASE WHEN starts_with(unit, '{_SPDX}') AND i > 1 THEN concat('{_SPDX}', part) ELSE part END, '{CHOICE}', '', 'g')) AS part FROM (
  SELECT unit, unnest(string_split(unit, ' or ')) AS part, generate_subscripts(string_split(unit, ' or '), 1) AS i FROM (SELECT DISTINCT words AS unit FROM spoken WHERE regexp_matches(words, '{SEVERAL}')))),
once AS (SELECT unit, sum(times) AS times FROM (SELECT words AS unit, count(*) AS times FROM spoken GROUP BY words UNION ALL SELECT DISTINCT part, 0 FROM parts WHERE part <> '') GROUP BY unit),
terms AS (SELECT unit, times, term, count(*) AS tf FROM (SELECT unit, times, unnest(string_split(unit, ' ')) AS term FROM once) GROUP BY ALL),
own AS (SELECT template, licence, term, count(*) AS tf FROM (SELECT template, licence, unnest(string_split({plain.format("text")}, ' ')) AS term FROM known) GROUP BY ALL),
df AS (SELECT term, sum(times) AS df FROM (SELECT term, times FROM terms UNION ALL SELECT term, 1 FROM own) GROUP BY term),
total AS (SELECT count(*) + {len(templates)} AS total FROM spoken),
weighed AS (SELECT unit, term, (1 + ln(tf)) * (ln((1 + total) / (1 + df)) + 1) AS w FROM terms JOIN df USING (term), total),
ownw AS (SELECT template, licence, term, (1 + ln(tf)) * (ln((1 + total) / (1 + df)) + 1) AS v FROM own JOIN df USING (term), total),
norms AS (SELECT template, sqrt(sum(v * v)) AS norm, count(*) FILTER (WHERE regexp_matches(term, '{REQUIRED}')) AS numbers FROM ownw GROUP BY template),
sizes AS (SELECT unit, sqrt(sum(w * w)) AS size FROM weighed GROUP BY unit),
dots AS (SELECT unit, template, licence, sum(w * v) AS dot, count(*) FILTER (WHERE regexp_matches(term, '{REQUIRED}')) AS shared FROM weighed JOIN ownw USING (term) GROUP BY ALL),
cosines AS (SELECT unit, licence, max(round(dot / (norm * size), 6)) AS cosine FROM dots JOIN norms USING (template) JOIN sizes USING (unit) WHERE shared = numbers GROUP BY ALL),
ranked AS (SELECT unit, licence, cosine, row_number() OVER best AS r, lead(cosine) OVER best AS next FROM cosines WINDOW best AS (PARTITION BY unit ORDER BY cosine DESC, licence)),
clear AS (SELECT unit, licence, cosine FROM ranked WHERE r = 1 AND cosine >= {least} AND (next IS NULL OR round(cosine - next, 6) >= {margin})),
offered AS (SELECT parts.unit, string_agg(DISTINCT licence, ' OR ' ORDER BY licence) AS licence, min(cosine) AS cosine FROM parts JOIN clear ON parts.part = clear.unit GROUP BY parts.unit HAVING count(DISTINCT licence) > 1),
found AS (SELECT * FROM clear WHERE unit NOT IN (SELECT unit FROM offered) UNION ALL SELECT * FROM offered),
hits AS (SELECT path, whole OR {name} AS speaks, -cosine AS c, licence FROM spoken JOIN found ON words = unit),
per_path AS (SELECT path, min((c, licence)) AS own, min((c, licence)) FILTER (WHERE speaks) AS file FROM hits GROUP BY path),
declared AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS folder, min((file[1], file[2], path)) AS by_ FROM per_path WHERE file IS NOT NULL GROUP BY 1),
folders AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS folder FROM files WHERE path IS NOT NULL),
above AS (SELECT folder, depth, array_to_string(list_slice(string_split(folder, '/'), 1, depth), '/') AS above FROM (SELECT folder, unnest(generate_series(0, len(string_split(folder, '/')))) AS depth FROM folders)),
inherited AS (SELECT a.folder, arg_max(d.by_, a.depth) AS by_ FROM above a JOIN declared d ON d.folder = a.above GROUP BY a.folder)
SELECT f.path, CASE WHEN own IS NOT NULL THEN own[2] ELSE by_[2] END AS licence,
  CASE WHEN own IS NOT NULL AND file IS NOT NULL THEN 'file' WHEN own IS NOT NULL THEN 'header' WHEN by_ IS NOT NULL THEN 'inherited' END AS how,
  CASE WHEN own IS NOT NULL THEN -own[1] ELSE -by_[1] END AS cosine,
  CASE WHEN own IS NOT NULL THEN f.path ELSE by_[3] END AS declared_by
FROM files f LEFT JOIN per_path p ON f.path = p.path LEFT JOIN inherited i ON i.folder = regexp_replace(f.path, '/?[^/]*$', '')
"""
