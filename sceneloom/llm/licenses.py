"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance.

Vectors are sparse rows (unit, term, weight) joined to the templates' rows on the term.
Weights are whole numbers (tf times an idf in thousandths), so sums are exact and equal
for any partitioning. A file without a licence of its own inherits from the nearest
directory above it that declares one.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneloom.llm.common import kept

# Notices of common licences, as their publishers give them.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software."],
    "BSD": [
        "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited."],
}
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: A line with one of these words may belong to a notice.
CUE = (r"(?i)\b(licen[sc]e[ds]?|copyright|spdx|permi(?:ssion|tted)|redistribut\w*|warrant(?:y|ies)|creative commons|cc0?|public domain|"
       r"rights|apache|mit|bsd|gnu|gpl|lgpl|mozilla|mpl|isc|unlicense)\b")
#: So many distinct template words make a header of lines without a cue.
WORDING = 8
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice|unlicense)([.\-_][\w.\-]*)?$"


def _terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def idf() -> dict[str, int]:
    """Weights of the template terms in thousandths; a term that no template has weighs like the rarest."""
    texts = [set(_terms(t)) for group in TEMPLATES.values() for t in group]
    terms = set().union(*texts)
    return {t: round(1000 * math.log((1 + len(texts)) / (1 + sum(t in x for x in texts))) + 1000) for t in sorted(terms)}


def rare_idf() -> int:
    return round(1000 * math.log(1 + sum(map(len, TEMPLATES.values()))) + 1000)


def template_rows() -> list[tuple[str, int, str, int, int]]:
    """(licence, variant, term, weight, squared length of the variant)."""
    known = idf()
    out = []
    for name, group in TEMPLATES.items():
        for variant, text in enumerate(group):
            terms = _terms(text)
            weight = {t: terms.count(t) * known[t] for t in set(terms)}
            square = sum(w * w for w in weight.values())
            out += [(name, variant, t, w, square) for t, w in sorted(weight.items())]
    return out


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def notices(files: DataFrame) -> DataFrame:
    """(path, unit, body) from anywhere in the text; of a licence file the whole text too. The best unit of a file counts.

    Units are runs of adjacent lines with a cue (a one-line notice amid prose); runs of lines that
    have a cue or take half of their words or more from the templates (a wrapped header, commented
    or not), if they have a cue or WORDING template words; and all paragraphs of a text that has such a
    run. A line of comment marks only ends no header, a blank line does.
    """
    known, none = list(idf()), F.array().cast("array<string>")

    def terms(body: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.lower(body), F.lit(TERM), F.lit(0)))

    def level(x: Column) -> Column:
        surplus = F.aggregate(terms(x), F.lit(0), lambda n, t: n + F.when(t.isin(known), 1).otherwise(-1))
        return F.when(x.rlike(CUE), 2).when(x.rlike("\\S"), F.when(surplus >= 0, 1).otherwise(0)).otherwise(-1)

    def runs(least: int) -> Column:
        marked = F.zip_with("_lines", "_levels", lambda x, n: F.when(n >= least, x).otherwise(""))
        return F.filter(F.split(F.array_join(marked, "\n"), "\n\n+"), lambda x: x != "")

    def header(x: Column) -> Column:
        # a cue of two words may be wrapped, with a comment mark between them
        return F.regexp_replace(x, "[^A-Za-z0-9]+", " ").rlike(CUE) | (F.size(F.filter(terms(x), lambda t: t.isin(known))) >= WORDING)

    whole = F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_FILE) & F.col("text").isNotNull()
    lined = files.select("path", F.when(whole, F.array("text")).otherwise(none).alias("_whole"), F.split(F.coalesce("text", F.lit("")), "\n").alias("_lines"))
    levels = lined.withColumn("_levels", F.transform("_lines", level))
    found = levels.withColumn("_runs", F.concat(F.when(F.array_max("_levels") == 2, runs(2)).otherwise(none), F.when(F.array_max("_levels") > 0, F.filter(runs(1), header)).otherwise(none)))
    units = F.array_distinct(F.concat("_whole", "_runs", F.when(F.size("_runs") > 0, runs(0)).otherwise(none)))
    # the outer form, as Spark would otherwise work out the units once more to drop files without one
    return found.select("path", F.posexplode_outer(units).alias("unit", "body")).filter("body is not null")


def own_licences(files: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(path, licence, score) of the files whose best notice reaches ``threshold``; ties go to the first licence by name."""
    spark = files.sparkSession
    # the templates above, some hundreds of rows: each term's weight and its entries in the templates
    entry = F.struct("licence", "variant", "weight", "square")
    model = (spark.createDataFrame(list(idf().items()), "term string, idf long")
             .join(spark.createDataFrame(template_rows(), "licence string, variant int, term string, weight long, square long"), "term")
             .groupBy("term", "idf").agg(F.collect_list(entry).alias("entries")))
    # only the notices move, once; all sums below are over rows of one notice
    at = ["path", "unit"]
    tokens = notices(files).repartition(*at).select(*at, F.explode(F.regexp_extract_all(F.lower("body"), F.lit(TERM), F.lit(0))).alias("term"))
    vector = (tokens.groupBy(*at, "term").agg(F.count(F.lit(1)).alias("tf")).join(F.broadcast(model), "term", "left")
              .select(*at, (F.col("tf") * F.coalesce("idf", F.lit(rare_idf()))).alias("w"), "entries"))
    own = F.struct(F.lit(None).cast("string").alias("licence"), F.lit(None).cast("int").alias("variant"), F.col("w").alias("weight"), F.lit(None).cast("bigint").alias("square"))
    products = vector.select(*at, "w", F.explode(F.concat(F.array(own), F.coalesce("entries", F.array().cast("array<struct<licence:string,variant:int,weight:bigint,square:bigint>>")))).alias("e"))
    dots = products.groupBy(*at, "e.licence", "e.variant").agg(F.sum(F.col("w") * F.col("e.weight")).alias("dot"), F.first("e.square").alias("square"))
    # at most one entry for each template variant, and the notice's own squared length
    notice = dots.groupBy(*at).agg(F.max(F.when(F.col("licence").isNull(), F.col("dot"))).alias("own"), F.collect_list(F.when(
        F.col("licence").isNotNull(), F.struct("licence", "dot", "square"))).alias("d"))
    cosine = F.col("d.dot").cast("double") / F.sqrt(F.col("own").cast("double") * F.col("d.square").cast("double"))
    scored = notice.select("path", "own", F.explode("d").alias("d")).select("path", "d.licence", cosine.alias("score")).filter(F.col("score") >= threshold)
    best = scored.groupBy("path").agg(F.max("score").alias("score"), F.min_by("licence", F.struct(-F.col("score"), F.col("licence"))).alias("licence"))
    return best.select("path", "licence", "score")


def inherited(directories: DataFrame, declared: DataFrame) -> DataFrame:
    """(dir, from_dir, from_licence) of the directories at or below one that ``declared`` (dir, licence) names: the nearest counts.

    The ancestors of each distinct directory meet the declaring ones in a join on the path.
    """
    steps = F.split("dir", "/")
    up = directories.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))).alias("from_dir")).distinct()
    found = up.join(declared.select(F.col("dir").alias("from_dir"), "licence"), "from_dir")
    return found.groupBy("dir").agg(F.max_by(F.struct("from_dir", "licence"), F.length("from_dir")).alias("_n")).select(
        "dir", F.col("_n.from_dir").alias("from_dir"), F.col("_n.licence").alias("from_licence"))


def scan(files: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(path, own_licence, score, licence, from_dir) for every row of ``files`` (path, text).

    ``own_licence`` and ``score`` come from the file's own notice or are null. ``licence``
    is that, or the one of the nearest directory at or above the file whose licence file
    (LICENSE, COPYING, NOTICE ...) has one; ``from_dir`` names that directory, "" being
    the root. Of several licence files in a directory the best score declares, then the first
    licence by name. Rows of one path are one file. Null and empty texts have no notice; a null path neither
    declares nor inherits.
    """
    own = kept(own_licences(files.filter("path is not null"), threshold))
    rows = files.select("path").join(own, "path", "left").withColumn("dir", _parent(F.col("path")))
    declared = (own.filter(F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_FILE)).select(_parent(F.col("path")).alias("dir"), "licence", "score")
                .groupBy("dir").agg(F.min_by("licence", F.struct(-F.col("score"), F.col("licence"))).alias("licence")))
    directories = files.filter("path is not null").select(_parent(F.col("path")).alias("dir")).distinct()
    near = inherited(directories, declared)
    return rows.join(near, "dir", "left").select(
        "path", F.col("licence").alias("own_licence"), "score", F.coalesce("licence", "from_licence").alias("licence"),
        F.when(F.col("licence").isNull(), F.col("from_dir")).alias("from_dir"))
