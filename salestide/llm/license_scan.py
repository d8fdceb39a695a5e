"""Licences of files: cosine to templates, then inheritance from directories.

Files that talk about a licence are compared with a fixed set of templates, as sparse
TF-IDF vectors of words and word pairs. Compared are licence files as a whole and by
paragraph, blocks of comment lines, and single lines. Where a notice names a version,
a template of another version is none of its. Licence files (by name) stand for their
directory. A file without a licence of its own takes that of the nearest directory
above it that has one: every file and every directory above it is one row, and the
rows are joined on the path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salestide.llm.tables import SEPARATORS, saved

# Licence notices as they are commonly written.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "apache.org/licenses/LICENSE-2.0",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files, to deal in the Software without restriction",
    ),
    (
        "MIT",
        "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of "
        "this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
        "whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS "
        "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
        "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License, or (at your option) any later version.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License",
    ),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met: 1. Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. 2. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met: 1. Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. 2. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("proprietary", "All rights reserved."),
)
MENTION = (
    r"(?i)licen[sc]ed?\b|all rights reserved|permission is hereby granted|redistribution and use"
    r"|permission to use, copy"
)
# A licence is not a notice's if that has the second pattern and lacks the first.
DECISIVE = (
    ("GPL-2.0", r"(?i)\b(?:version|v\.?)\s*2|GPL-?2", r"(?i)\b(?:version|v\.?)\s*3|GPL-?3"),
    ("GPL-3.0", r"(?i)\b(?:version|v\.?)\s*3|GPL-?3", r"(?i)\b(?:version|v\.?)\s*2|GPL-?2"),
    ("BSD-2-Clause", r"(?!)", r"(?i)neither the names? of|BSD-?3|3-Clause"),
)
NO_LICENCE = "proprietary"  # counts where nothing else is stated
COMMENT = r"[ \t]*(?:#|//|/?\*|;|--|<!--)"
LICENCE_FILE = r"(?i)(?:^|/)(?:licen[sc]e|copying|notice|unlicense)(?:[.-][^/]*)?\z"
MIN_COSINE = 0.6


def _terms(text: Column) -> Column:
    """Words in lower case, without punctuation at their ends, and pairs of them."""
    parts = F.split(F.lower(text), f"[{SEPARATORS}]+")
    words = F.filter(
        F.transform(parts, lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\z", "")),
        lambda w: w != "",
    )
    pairs = F.when(
        F.size(words) > 1,
        F.transform(F.slice(words, 2, F.size(words) - 1), lambda w, i: F.concat_ws(" ", F.get(words, i), w)),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    """Term counts of each row's ``_notice``."""
    terms = rows.select(*keys, F.explode(_terms(F.col("_notice"))).alias("term"))
    return terms.groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def notices(files: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """Rows of ``files`` that may state a licence, with what may do so in ``_notice``:
    the whole text of a licence file and each block of comment lines (``_part`` 0), and
    each paragraph of a licence file and each line that mention one (``_part`` 1)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    named = F.coalesce(F.col(path), F.lit("")).rlike(LICENCE_FILE)
    # Lines that are no comment become empty, so that blocks of comments are paragraphs.
    comments = F.regexp_replace(whole, rf"(?m)^(?!{COMMENT}).+$", "")
    several = F.when(whole.rlike(rf"(?m)^{COMMENT}"), F.split(comments, r"\n{2,}", -1)).otherwise(F.array())

    def stating(parts: Column, part: int) -> Column:
        return F.transform(
            F.filter(parts, lambda x: x.rlike(MENTION)), lambda x: F.struct(F.lit(part).alias("p"), x.alias("n"))
        )

    lines = stating(F.split(whole, r"\n", -1), 1)
    paragraphs = stating(F.split(whole, r"\n[ \t\r]*\n", -1), 1)
    all_of_it = F.array(F.struct(F.lit(0).alias("p"), whole.alias("n")))
    found = files.where(named | whole.rlike(MENTION))
    parts = F.when(named, F.concat(all_of_it, paragraphs)).otherwise(F.concat(stating(several, 0), lines))
    taken = found.withColumn("_notice", F.explode(F.array_distinct(parts)))
    return taken.withColumn("_part", F.col("_notice.p")).withColumn("_notice", F.col("_notice.n"))


def matched(files: DataFrame, key: str, text: str = "text", path: str = "path") -> DataFrame:
    """``_key``, ``licence``, ``cosine``: the best template of each file, if its cosine
    is 0.6 or more. Whole licence files and blocks go before paragraphs and lines, and
    any licence before ``NO_LICENCE``. Ties go to the licence that sorts first.

    Distinct notices are compared, not files: a notice that a third of all files carry
    is one row. Weights come from all files' notices; terms that no template has count
    in a notice's length only.
    """
    spark = files.sparkSession
    stated = saved(
        notices(files, text, path).select(F.col(key).alias("_key"), "_notice", "_part"), "licence-notices"
    )
    distinct = stated.groupBy("_notice").agg(F.count("*").alias("files"))
    distinct = distinct.withColumn("_id", F.sha2("_notice", 256))
    total = stated.agg(F.count("*")).first()[0]

    templates = _template_rows(spark)
    # Each notice becomes many terms, so notices are dealt out before they are cut up.
    distinct = distinct.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_id")
    counted = _counted(distinct.select("_id", "files", "_notice"), "_id", "files")
    counted = saved(counted, "licence-terms")
    seen = counted.groupBy("term").agg(F.sum("files").alias("df"))
    template_terms = _counted(templates, "template", "licence")
    # Rarity: over files' notices, and each template once.
    own = template_terms.groupBy("term").agg(F.count("*").alias("own"))
    rarity = seen.join(own, "term", "full").select(
        "term",
        F.log(
            (F.lit(1.0 + total + len(TEMPLATES)))
            / (F.lit(1.0) + F.coalesce("df", F.lit(0)) + F.coalesce("own", F.lit(0)))
        ).alias("idf"),
    )
    rarity = rarity.withColumn("idf", F.col("idf") + 1)

    def weighted(terms: DataFrame) -> DataFrame:
        return terms.join(rarity, "term").withColumn("w", F.col("tf") * F.col("idf"))

    ours = weighted(counted)
    lengths = ours.groupBy("_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    theirs = saved(weighted(template_terms), "licence-templates")
    t_lengths = theirs.groupBy("template", "licence").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_length")
    )
    # The templates are the constant list above, so their terms are few.
    dots = (
        ours.select("_id", "term", "w")
        .join(F.broadcast(theirs.select("template", "licence", "term", F.col("w").alias("tw"))), "term")
        .groupBy("_id", "template", "licence")
        .agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    )
    cosine = F.round(F.col("dot") / (F.col("length") * F.col("t_length")), 9)
    scored = dots.join(F.broadcast(t_lengths), ["template", "licence"]).join(lengths, "_id")
    near = scored.select("_id", "licence", cosine.alias("cosine")).where(F.col("cosine") >= MIN_COSINE)
    best = (
        near.join(distinct.select("_id", "_notice"), "_id")
        .where(~_barred())
        .groupBy("_id")
        .agg(F.min(F.struct(*_rank(), F.col("licence").alias("l"))).alias("b"))
    )
    per_file = stated.withColumn("_id", F.sha2("_notice", 256)).join(best, "_id")
    rank = F.struct(F.col("b.late").alias("late"), "_part", F.col("b.c").alias("c"), F.col("b.l").alias("l"))
    return (
        per_file.groupBy("_key")
        .agg(F.min(rank).alias("b"))
        .select("_key", F.col("b.l").alias("licence"), (-F.col("b.c")).alias("cosine"))
    )


def _rank() -> list[Column]:
    return [(F.col("licence") == NO_LICENCE).alias("late"), (-F.col("cosine")).alias("c")]


def _barred() -> Column:
    """Does the notice name another version than the licence's?"""
    notice, out = F.col("_notice"), F.lit(False)
    for licence, own, other in DECISIVE:
        out = out | ((F.col("licence") == licence) & notice.rlike(other) & ~notice.rlike(own))
    return out


def _template_rows(spark: SparkSession) -> DataFrame:
    rows = [(i, name, text) for i, (name, text) in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, "template int, licence string, _notice string")


def directories(path: Column) -> Column:
    """All directories above a path, nearest first; the root is the empty path."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.size(parts) - 1, F.lit(0)), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )


def licensed(
    files: DataFrame, key: str = "doc_id", text: str = "text", path: str = "path"
) -> DataFrame:
    """``key``, ``licence``, ``cosine``, ``inherited_from`` and ``depth`` for each file.

    A file's own licence has cosine and no directory. Otherwise the licence comes from
    the nearest directory above that has one (``depth`` 1: its own directory). Without
    either, licence is null. A directory's licence is that of the licence files in it;
    where they disagree, the one with the largest cosine, then the first by name.

    Keys must be unique; of rows that repeat a key with the same path one stays. A null
    path stands in no directory, a null text states nothing, and an empty table gives
    no rows.
    """
    placed = files.groupBy(key, path).agg(F.first(text).alias(text)).select(
        F.col(key).alias("_key"), F.col(path).alias("_path"), F.col(text).alias("_text")
    )
    own = saved(matched(placed, "_key", "_text", "_path"), "licence-matches")
    known = placed.select("_key", "_path").join(
        own.withColumnRenamed("_key", "_k"), F.col("_key").eqNullSafe(F.col("_k")), "left"
    )
    known = saved(known.drop("_k"), "licence-files")

    stated = known.where(F.col("licence").isNotNull() & F.col("_path").rlike(LICENCE_FILE))
    of_directory = (
        stated.select(F.get(directories(F.col("_path")), F.lit(0)).alias("dir"), "licence", "cosine")
        .groupBy("dir")
        .agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("licence").alias("l"))).alias("b"))
        .select("dir", F.col("b.l").alias("from_dir"))
    )
    # Directories, not files, look upwards: a directory's files all get one answer.
    asking = known.where(F.col("licence").isNull() & F.col("_path").isNotNull()).withColumn(
        "_dir", F.get(directories(F.col("_path")), F.lit(0))
    )
    upwards = (
        asking.select("_dir")
        .distinct()
        .select("_dir", F.posexplode(directories(F.concat("_dir", F.lit("/x")))).alias("up", "dir"))
    )
    upwards = upwards.where((F.col("_dir") != "") | (F.col("up") == 0))
    nearest = (
        upwards.join(of_directory, "dir")
        .groupBy("_dir")
        .agg(F.min(F.struct("up", "dir", "from_dir")).alias("n"))
        .select("_dir", "n.up", "n.dir", "n.from_dir")
    )
    with_dir = known.withColumn("_dir", F.get(directories(F.col("_path")), F.lit(0)))
    answered = with_dir.join(saved(nearest, "licence-nearest"), "_dir", "left")
    has_own = F.col("licence").isNotNull()
    return answered.select(
        F.col("_key").alias(key),
        F.coalesce("licence", "from_dir").alias("licence"),
        "cosine",
        F.when(~has_own, F.col("dir")).alias("inherited_from"),
        F.when(~has_own & F.col("from_dir").isNotNull(), F.col("up") + 1).cast("long").alias("depth"),
    )
