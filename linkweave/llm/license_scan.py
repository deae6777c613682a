"""Licence scans by sparse TF-IDF cosine and directory inheritance, in DataFrame functions only.

A text that names a licence anywhere is looked at line by line. A line with a telling word of the
templates is a header line; adjacent header lines, with single other lines between two of them,
are a header block, however many they are. A block is compared in three ways: whole, sentence by
sentence and line by line; the way that gives the best score is taken, so of a notice wrapped at
any width no part is taken for a notice of its own, and of different notices in adjacent lines
each counts. A file that is called LICENSE, COPYING or NOTICE, or most of whose words are in
header blocks, is a licence file, and is compared whole where no block of it is a licence.

These units become sparse term vectors, terms are weighted by their inverse frequency over all
units of the corpus and the templates, and the cosine to each template is a sum over shared terms:
an equi-join on the term with the templates' weights, a fixed table. One shared term alone (the
German word "mit") is no licence, and versions must agree: a template's version numbers and its
telling variants ("later", "lesser", "affero", "nc", "sa") must be in the unit, and a unit that
says "later" only fits a template that does. The best template at ``threshold`` or above is the
unit's licence. A file without one of its own inherits from the licence file in its nearest
ancestor directory, found by joining its ancestor paths with the directories that hold one.

Defined cases: null and empty texts have no header and can only inherit; null paths cannot
inherit; equal scores go to the first name; several licence files of one directory give the
best score, then the first name; repeated rows each give a row; no rows give no rows; other
columns are not read. Units follow a text's lines, so a long text needs no more than its length.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkweave.llm.columns import let
from linkweave.runtime import checkpoint

THRESHOLD = 0.6
NAMES_LICENCE = r"(?i)licen[sc]e|copyright|rights[^a-z0-9]+reserved|spdx|public[^a-z0-9]+domain|creative[^a-z0-9]+commons|redistribution|permission|unencumbered"
#: Terms of a template that a unit must share: single digits, as versions have, and names of variants.
MUST_AGREE = r"^([0-9]|later|lesser|affero|nc|sa)$"
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"

#: SPDX identifiers and notices, titles and tags that stand for them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0-only", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3"),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-3.0-only", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License"),
    ("GPL-2.0-only", "GNU General Public License Version 2, June 1991"),
    ("LGPL-2.1-only", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-2.1-only", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; version 2.1 of the License"),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("LGPL-3.0-or-later", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISC", "ISC License"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0-only", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0-only", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0-only", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("LicenseRef-Proprietary", "All rights reserved"),
    *[(name, f"SPDX-License-Identifier: {name}") for name in ("Apache-2.0", "MIT", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-2.0-only", "GPL-2.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "BSD-3-Clause", "BSD-2-Clause", "ISC", "0BSD", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "Unlicense")],
]

#: Words of the templates that tell nothing by themselves.
COMMON = frozenset("a all an and any are as at be by can code do either except for form forms free in is it june january november july legal met may not of or person persons sell so the this to use v whom with without work you your under source file http www org com only that".split())


def telling_words(texts: list[tuple[str, str]]) -> list[str]:
    """Words of the templates that mark a header line: letters, three at least, and not common."""
    found = {w for _, text in texts for w in re.findall("[a-z0-9]+", text.lower())}
    return sorted(w for w in found if len(w) > 2 and w.isalpha() and w not in COMMON)


def header_line(texts: list[tuple[str, str]]) -> str:
    """The pattern of a header line, the same in Java and in DuckDB."""
    return f"(?i)(^|[^a-z0-9])({'|'.join(telling_words(texts))})([^a-z0-9]|$)"


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^a-z0-9]+"), "")


def templates(spark: SparkSession, texts: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(template, licence, term, tf) from literals."""
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(name).alias("licence"), F.lit(text).alias("text")) for i, (name, text) in enumerate(texts)])
    each = spark.range(1).select(F.explode(rows).alias("t")).select("t.template", "t.licence", F.explode(terms(F.col("t.text"))).alias("term"))
    return each.groupBy("template", "licence", "term").agg(F.count("*").alias("tf"))


#: Stands for the lines outside header blocks while a text is cut.
_OUTSIDE = "\x01"
#: How a block is compared, in the order in which equal scores are taken; a file's whole text comes last.
BLOCK, SENTENCE, LINE, WHOLE = range(4)


def _blocks(text: Column, texts: list[tuple[str, str]]) -> Column:
    """The header blocks of a text, each with its lines."""
    lines = F.split(F.translate(text, _OUTSIDE, " "), "\n")
    seen = F.transform(lines, lambda x: F.struct(x.alias("line"), x.rlike(header_line(texts)).alias("header"), x.rlike("[A-Za-z0-9]").alias("words")))
    header = lambda all_, i: F.coalesce(F.get(all_, i)["header"], F.lit(False))
    # bound first, as an array named inside a lambda would be made again for each of its elements
    kept = let(seen, lambda all_: F.transform(all_, lambda x, i: F.when(x["header"] | (x["words"] & header(all_, i - 1) & header(all_, i + 1)), x["line"]).otherwise(_OUTSIDE)))
    return F.filter(F.transform(F.split(F.array_join(kept, "\n"), _OUTSIDE), lambda b: F.regexp_replace(b, r"^\n+|\n+$", "")), lambda b: b != "")


def _units(blocks: Column) -> Column:
    """(block, way, text) of each block: whole, its sentences, its lines."""
    unit = lambda i, way: lambda x: F.struct(i.alias("block"), F.lit(way).alias("way"), x.alias("text"))

    def of(block: Column, i: Column) -> Column:
        whole, lines = F.replace(block, F.lit("\n"), F.lit(" ")), F.split(block, "\n")
        sentences = F.split(whole, r"\.( |\z)")
        several = lambda parts, way: F.when(F.size(parts) > 1, F.transform(parts, unit(i, way))).otherwise(F.array().cast("array<struct<block:int,way:int,text:string>>"))
        return F.concat(F.array(unit(i, BLOCK)(whole)), several(sentences, SENTENCE), several(lines, LINE))

    return F.flatten(F.transform(blocks, of))


def _tagged(files: DataFrame, file_id: str, path: str, text: str, texts: list[tuple[str, str]]) -> DataFrame:
    """(row, id, path, is_file, units): the units of header blocks, and the whole of a licence file."""
    none = F.array().cast("array<string>")
    rows = files.select(F.monotonically_increasing_id().alias("row"), F.col(file_id).alias("id"), F.col(path).alias("path"), F.col(text).alias("text"))
    cut = rows.withColumn("blocks", F.when(F.col("text").rlike(NAMES_LICENCE), _blocks(F.col("text"), texts)).otherwise(none))
    count = lambda t: F.size(terms(t))
    held = F.aggregate("blocks", F.lit(0), lambda n, x: n + count(x))
    is_file = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False)) | ((F.size("blocks") > 0) & (2 * held >= count(F.coalesce("text", F.lit("")))))
    whole = F.array(F.struct(F.lit(-1).alias("block"), F.lit(WHOLE).alias("way"), F.coalesce("text", F.lit("")).alias("text")))
    made = cut.withColumn("is_file", is_file).withColumn("units", F.when(F.size("blocks") > 0, _units(F.col("blocks"))).otherwise(F.array().cast("array<struct<block:int,way:int,text:string>>")))
    units = F.when(F.col("is_file"), F.concat("units", whole)).otherwise(F.col("units"))
    return made.select("row", "id", "path", "is_file", F.filter(units, lambda x: count(x["text"]) > 0).alias("units"))


def scan(files: DataFrame, *, file_id: str = "doc_id", path: str = "path", text: str = "text", threshold: float = THRESHOLD, texts: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per file: id, path, own licences and best score, licence, and the directory it comes from."""
    spark = files.sparkSession
    tagged = checkpoint(_tagged(files, file_id, path, text, texts))
    each = tagged.where(F.size("units") > 0).select("row", F.posexplode("units").alias("unit", "u")).select("row", "unit", "u.block", "u.way", terms(F.col("u.text")).alias("terms"))
    # told of a unit before its terms become rows, not of each of those rows
    told = each.withColumn("later", F.array_contains("terms", "later"))
    counts = checkpoint(told.select("row", "unit", "block", "way", "later", F.explode("terms").alias("term")).groupBy("row", "unit", "block", "way", "later", "term").agg(F.count("*").alias("tf")))
    given = templates(spark, texts)
    vocabulary = given.select("term").distinct()
    n = F.lit(float(len(texts))) + F.lit(float(each.count()))
    seen = counts.join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.count("*").alias("in_units"))
    idf = checkpoint(vocabulary.join(seen, "term", "left").join(given.groupBy("term").agg(F.countDistinct("template").alias("in_templates")), "term").select("term", (F.log((n + 1) / (F.coalesce("in_units", F.lit(0)) + F.col("in_templates") + 1)) + 1).alias("idf")))
    unseen = F.log(n + 1) + 1
    # both tables have a row for each template term: their size is fixed by TEMPLATES
    weights = given.join(idf, "term").select("template", "licence", "term", (F.col("tf") * F.col("idf")).alias("w"))
    must = F.col("term").rlike(MUST_AGREE)
    lengths = weights.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"), F.count_if(must).alias("n_must"), F.bool_or(F.col("term") == "later").alias("says_later"))
    unit_weights = counts.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", unseen))
    unit_lengths = unit_weights.groupBy("row", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("unit_length"))
    table = weights.join(lengths, "template").select("template", "licence", "term", (F.col("w") / F.col("length")).alias("share"), must.alias("must"), "n_must", "says_later")
    dots = unit_weights.join(F.broadcast(table), "term").groupBy("row", "unit", "block", "way", "later", "template", "licence", "n_must", "says_later").agg(F.sum(F.col("w") * F.col("share")).alias("dot"), F.count("*").alias("shared"), F.count_if("must").alias("met"))
    agree = (F.col("shared") >= 2) & (F.col("met") == F.col("n_must")) & (F.col("says_later") | ~F.col("later"))
    scored = dots.where(agree).join(unit_lengths, ["row", "unit"]).select("row", "unit", "block", "way", "licence", F.round(F.col("dot") / F.col("unit_length"), 6).alias("score")).where(F.col("score") >= threshold)
    best_of_unit = scored.groupBy("row", "block", "way", "unit").agg(F.min(F.struct((-F.col("score")).alias("loss"), "licence")).alias("b"))
    # a block counts in the way that fits best, a whole file only where no block does
    way = F.min(F.struct("b.loss", "way")).over(Window.partitionBy("row", "block"))["way"]
    chosen = best_of_unit.withColumn("best_way", way).withColumn("first_block", F.max("block").over(Window.partitionBy("row"))).where((F.col("way") == F.col("best_way")) & ((F.col("block") >= 0) | (F.col("first_block") < 0)))
    own = chosen.groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("b.licence")), ",").alias("own_licences"), F.min("b").alias("b")).select(F.col("row").alias("own_row"), "own_licences", F.col("b.licence").alias("own_licence"), (-F.col("b.loss")).alias("score"))
    joined = checkpoint(tagged.select("row", "id", "path", "is_file").join(own, F.col("row") == F.col("own_row"), "left"))
    held = joined.where("is_file and own_licence is not null and path is not null")
    folder = F.when(F.locate("/", F.col("path")) > 0, F.regexp_replace("path", r"/[^/]*$", "")).otherwise(F.lit(""))
    folders = held.select(folder.alias("folder"), "score", "own_licence").groupBy("folder").agg(F.min(F.struct((-F.col("score")).alias("loss"), F.col("own_licence").alias("licence"))).alias("f")).select("folder", F.col("f.licence").alias("folder_licence"))
    parts = F.split(F.col("path"), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(k.alias("depth"), F.when(k == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, F.lit(1), k), "/")).alias("folder")))
    without = joined.where("own_licence is null and path is not null").select("row", F.explode(above).alias("a")).select("row", "a.*")
    inherited = without.join(folders, "folder").groupBy("row").agg(F.max_by(F.struct("folder", "folder_licence"), "depth").alias("h")).select(F.col("row").alias("heir"), "h")
    return joined.join(inherited, F.col("row") == F.col("heir"), "left").select(
        F.col("id").alias(file_id), "path", "is_file", F.coalesce("own_licences", F.lit("")).alias("own_licences"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("own_licence", "h.folder_licence").alias("licence"), F.when(F.col("own_licence").isNull(), F.col("h.folder")).alias("inherited_from"),
    )


def licence_report(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents and pages. Documents have no path and don't inherit; a page's path is its url's host and path, its text what stands between tags."""
    url = F.regexp_extract("url", r"^[^:]*://([^?#]*)", 1)
    rows = docs.select(F.lit("document").alias("kind"), "doc_id", F.lit(None).cast("string").alias("path"), "text")
    paged = pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("doc_id"), F.nullif(url, F.lit("")).alias("path"), F.regexp_replace("html", "<[^>]*>", "\n").alias("text"))
    found = scan(rows.unionByName(paged).withColumn("file", F.struct("kind", "doc_id")), file_id="file")
    return found.select("file.kind", "file.doc_id", *[c for c in found.columns if c != "file"])
