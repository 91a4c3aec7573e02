"""Licence scan: TF-IDF cosine to templates, then inheritance by directory.

1. Every whole text is cut into statements: lines and sentences within them,
   blocks of consecutive lines and sentences that run over their lines, and the
   identifiers of SPDX tags, each one term. A licence file's whole text is a
   statement too. A statement with a cue word of licence language is a header;
   its terms and those of the templates are weighted by TF-IDF. Document frequencies of the
   template terms are counted over all documents; a term outside the templates
   has the weight of a term seen once, so that prose around a few licence words
   lowers the cosine.
2. A file's own licence is the template with the highest cosine among its
   headers, if at least ``threshold``; ties go to the first name.
3. A licence file speaks for its directory and all below. A file without a
   licence of its own takes that of its nearest ancestor directory with a
   licence file: its directory is expanded to its ancestors, which are joined
   to the directories spoken for, and the longest path wins. Directories
   are resolved first, one row each, and joined to files afterwards, so
   that a directory with a third of all files is expanded once.

Only DataFrame and SQL functions are used. Only headers leave their rows; what
is broadcast is the template weights, bounded by the template terms.

Defined results: null texts have no headers; each identifier of an SPDX
expression counts on its own, without its exception, and one that no template
has counts for no licence; a null path has no directory and
inherits nothing; repeated rows give repeated rows; of several licence files
in a directory the one with the highest cosine counts, then the first name;
empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmetrics.session import materialize

# Names and customary notices of licences.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2."),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Use of this source code is governed by a BSD-style license."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.",),
    "BSD-2-Clause": ("This software is provided under the Simplified BSD License.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "0BSD": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",),
    "LGPL-2.1": ("This library is licensed under the GNU Lesser General Public License, version 2.1.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("All rights reserved.",),
}
CUES = r"(?i)licen[sc]|copyright|redistribut|permission is hereby|public domain|rights reserved|creative commons|spdx"
# Titles of the licence texts, and SPDX identifiers.
TITLES = {
    "Apache-2.0": ("Apache License Version 2.0, January 2004",),
    "MIT": ("The MIT License (MIT)",),
    "GPL-3.0": ("GNU General Public License Version 3, 29 June 2007",),
    "GPL-2.0": ("GNU General Public License Version 2, June 1991",),
    "LGPL-3.0": ("GNU Lesser General Public License Version 3, 29 June 2007",),
    "AGPL-3.0": ("GNU Affero General Public License Version 3, 19 November 2007",),
    "MPL-2.0": ("Mozilla Public License Version 2.0",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License Version 2.1, February 1999",),
    "EPL-2.0": ("Eclipse Public License - v 2.0",),
}
GNU = ("GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0")
SPDX_IDS = {name: (name, *((f"{name}-only", f"{name}-or-later", f"{name}+") if name in GNU else ())) for name in TEMPLATES if name != "Proprietary"}
NOTICES = {name: (*texts, *TITLES.get(name, ()), *(f"SPDX-License-Identifier: {x}" for x in SPDX_IDS.get(name, ()))) for name, texts in TEMPLATES.items()}
# End fixed values.

THRESHOLD = 0.6
SPREAD = 16  # copies of a directory's answer


_TAG = r"spdx-license-identifier[\s:=\"'(]*"
_ID = r"[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?"
_EXPRESSION = rf"(?i){_TAG}({_ID}(?:[\x20\t()]+(?:or|and|with)[\x20\t()]+{_ID})*)"


def terms_of(text: Column) -> Column:
    """Lower-case words and numbers (``2.0`` is one term, and so is the identifier of an SPDX tag)."""
    tagged = F.regexp_replace(F.lower(text), rf"{_TAG}({_ID})", " spdx:$1 ")
    return F.regexp_extract_all(tagged, F.lit(r"spdx:[a-z0-9.+-]+|[\p{L}\p{M}]+|[0-9]+(?:\.[0-9]+)*"), F.lit(0))


def spdx_tags(text: Column) -> Column:
    """A tag of its own for each identifier of the SPDX expressions."""

    def tags(expression: Column) -> Column:
        ids = F.split(expression, r"(?i)[\x20\t()]+(?:or|and)[\x20\t()]+")
        return F.transform(ids, lambda x: F.concat(F.lit("SPDX-License-Identifier: "), F.regexp_replace(x, r"(?i)[\x20\t()]+with[\x20\t()].*", "")))

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_EXPRESSION), F.lit(1)), tags))


def statements_of(text: Column) -> Column:
    """Lines and their sentences, blocks between lines without words, the sentences of these, and SPDX tags; those with a cue."""
    cued = lambda s: s.rlike(CUES)
    lines = F.split(text, r"\n|(?<=[.!?])[\x20\t]+")
    blocks = F.filter(F.split(text, r"\n(?:[^\p{L}\p{N}\n]*\n)+"), cued)
    # A new line within a block, with the marks of a comment before it, is a space.
    joined = F.transform(blocks, lambda s: F.regexp_replace(s, r"\s*\n[^\p{L}\p{N}\n]*", " "))
    sentences = F.flatten(F.transform(joined, lambda s: F.split(s, r"(?<=[.!?])[\x20\t]+")))
    return F.array_distinct(F.filter(F.concat(lines, joined, sentences, spdx_tags(text)), cued))


def template_terms(spark) -> DataFrame:
    """(notice, license, term, tf): the terms of every template notice."""
    rows = [(f"{name} {i}", name, text) for name, texts in NOTICES.items() for i, text in enumerate(texts)]
    table = spark.createDataFrame(rows, "notice string, license string, text string")
    return table.select("notice", "license", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("notice", "license", "term").agg(F.count(F.lit(1)).alias("tf"))


def template_weights(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, float]:
    """((notice, license, term, weight, norm), weight of a term outside the templates).

    Document frequencies are those of all documents. The table has one row per
    template term, a few hundred, whatever the size of ``docs``.
    """
    spark = docs.sparkSession
    terms = template_terms(spark)
    vocabulary = sorted({r["term"] for r in terms.select("term").distinct().collect()})
    held = F.array_intersect(F.array(*map(F.lit, vocabulary)), terms_of(F.col(text_col)))
    counted = docs.select(F.explode(F.concat(F.array(F.lit("")), F.coalesce(held, F.array().cast("array<string>")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = {r["term"]: r["df"] for r in counted.collect()}  # the vocabulary and one row for the total
    total = df.pop("", 0)
    idf = lambda n: F.log(F.lit((1 + total) / (1 + n))) + 1
    weights = spark.createDataFrame([(t, df.get(t, 0)) for t in vocabulary], "term string, df long")
    weights = weights.select("term", (F.log((1 + F.lit(total)) / (F.col("df") + 1)) + 1).alias("idf"))
    rows = terms.join(weights, "term").withColumn("weight", F.col("tf") * F.col("idf"))
    norms = rows.groupBy("notice").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    outside = spark.range(1).select(idf(0).alias("w")).first()["w"]
    return materialize(rows.join(norms, "notice").select("notice", "license", "term", "idf", "weight", "norm"), "license-weights"), float(outside)


def header_licenses(statements: DataFrame, docs: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """(print, license, cosine): the best template of every statement, by its MD5, that reaches the threshold.

    ``statements`` (print, statement) may repeat; document frequencies come from ``docs``. Copies are aggregated before
    the shuffle and the distinct statements dealt by their print, once: terms, norms and
    dot products of a statement are then counted where it lies, and its terms never leave the task.
    """
    weights, outside = template_weights(docs, text_col)
    notices = F.collect_list(F.struct("notice", "license", F.col("weight").alias("template_weight"), "norm")).alias("notices")
    known = F.broadcast(weights.groupBy("term").agg(F.first("idf").alias("idf"), notices))  # bounded by the template terms
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = statements.select("print", "statement").distinct().repartition(parts, "print")
    # The terms are an array below the explode, so that nothing else is computed once per term.
    terms = dealt.select("print", terms_of(F.col("statement")).alias("terms")).select("print", F.explode("terms").alias("term"))
    terms = terms.groupBy("print", "term").agg(F.count(F.lit(1)).alias("tf"))
    weighed = terms.join(known, "term", "left").withColumn("weight", F.col("tf") * F.coalesce("idf", F.lit(outside)))
    # One row per statement: its norm over all terms, and the terms that templates have (a few hundred at most).
    by_print = weighed.groupBy("print").agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("own_norm"),
        F.collect_list(F.when(F.col("notices").isNotNull(), F.struct("weight", "notices"))).alias("shared"),
    )
    pairs = by_print.select("print", "own_norm", F.explode("shared").alias("s")).select("print", "own_norm", "s.weight", F.explode("s.notices").alias("t"))
    dots = pairs.groupBy("print", "own_norm", F.col("t.notice").alias("notice"), F.col("t.license").alias("license"), F.col("t.norm").alias("norm"))
    dots = dots.agg(F.sum(F.col("weight") * F.col("t.template_weight")).alias("dot"))
    scored = dots.withColumn("cosine", F.round(F.col("dot") / (F.col("norm") * F.col("own_norm")), 9)).where(F.col("cosine") >= threshold)
    best = scored.groupBy("print", "license").agg(F.max("cosine").alias("cosine")).groupBy("print").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("best"))
    return best.select("print", "best.license", (-F.col("best.c")).alias("cosine"))


def directory_of(path: Column) -> Column:
    """The path up to its last slash; empty at the root; null for null."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors_of(directory: Column) -> Column:
    """The directory and all above, the root as an empty string."""
    parts = F.split(directory, "/")
    return F.when(directory == "", F.array(F.lit(""))).otherwise(
        F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")), F.array(F.lit("")))
    )


def scanned_licenses(files: DataFrame, license_files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Licences of ``files`` (doc_id, path, text); ``license_files`` (path) names those that speak for their directory.

    With a column ``directory``, ``license_files`` also says for which directory each of them speaks.
    Returns doc_id, path, license, cosine, origin (``own``, ``inherited`` or null) and
    the directory inherited from.
    """
    files = files.select("doc_id", "path", "text")
    headed = files.where(F.col("text").rlike(CUES))
    whole = materialize(headed.join(license_files.select("path").distinct(), "path", "left_semi").select("doc_id", "path", "text"), "license-texts")
    key = F.struct("doc_id", "path", F.xxhash64("text").alias("print"))
    stated = headed.select(key.alias("key"), F.explode(statements_of(F.col("text"))).alias("statement"))
    stated = stated.union(whole.select(key.alias("key"), F.col("text").alias("statement")))
    # Cut and printed once; scored by their distinct texts, found again by their prints.
    stated = materialize(stated.select("key", F.md5("statement").alias("print"), "statement"), "license-statements")
    scored = materialize(header_licenses(stated, files, threshold), "header-licenses")
    found = stated.select("key", "print").join(scored, "print")
    own = found.groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("best"))
    rows = files.select(key.alias("key"), directory_of(F.col("path")).alias("directory"))
    # Keys hold nulls: compare them by their text form.
    rows = rows.withColumn("join_key", F.to_json("key"))
    own = own.select(F.to_json("key").alias("join_key"), "best.license", (-F.col("best.c")).alias("cosine"))
    marked = materialize(rows.join(own, "join_key", "left").select("key.doc_id", "key.path", "directory", "license", "cosine"), "own-licenses")

    spoken = F.col("directory") if "directory" in license_files.columns else directory_of(F.col("path"))
    spoken = license_files.select("path", spoken.alias("ancestor")).distinct()
    speakers = marked.where("license IS NOT NULL AND directory IS NOT NULL").select("path", "license", "cosine").distinct().join(spoken, "path")
    speakers = speakers.groupBy("ancestor").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("best")).select("ancestor", F.col("best.license").alias("given"))
    directories = marked.where("directory IS NOT NULL").select("directory").distinct()
    # All directories meet the few at the top: these answer in SPREAD copies, each to a share of the directories.
    speakers = speakers.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    share = F.pmod(F.xxhash64("directory"), F.lit(SPREAD)).cast("int").alias("copy")
    climbed = directories.select("directory", share, F.explode(ancestors_of(F.col("directory"))).alias("ancestor")).join(speakers, ["ancestor", "copy"])
    nearest = climbed.groupBy("directory").agg(F.max(F.struct(F.length("ancestor").alias("n"), "ancestor", "given")).alias("up"))
    nearest = materialize(nearest.select("directory", F.col("up.ancestor").alias("from_directory"), F.col("up.given").alias("given")), "directory-licenses")
    joined = marked.join(nearest, "directory", "left")
    inherited = F.col("license").isNull() & F.col("given").isNotNull()
    return joined.select(
        "doc_id",
        "path",
        F.coalesce("license", "given").alias("license"),
        "cosine",
        F.when(inherited, F.lit("inherited")).when(F.col("license").isNotNull(), F.lit("own")).alias("origin"),
        F.when(inherited, F.col("from_directory")).alias("from_directory"),
    )


def document_files(docs: DataFrame, folder: int = 100, part: int = 10) -> tuple[DataFrame, DataFrame]:
    """``documents`` as files, source/lang/doc_id div ``folder``/doc_id div ``part``/doc_id, and the licence files.

    The document with the smallest id under a directory, at any depth, is the licence
    file of that directory: of the source, the language and both levels of ids.
    """
    step = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), step(folder), step(part), F.col("doc_id").cast("string"))
    files = docs.select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), path).alias("path"))
    above = files.where("path IS NOT NULL").select("doc_id", "path", F.explode(ancestors_of(directory_of(F.col("path")))).alias("directory"))
    firsts = above.where("directory != ''").groupBy("directory").agg(F.min(F.struct("doc_id", "path")).alias("first"))
    return files, firsts.select("first.path", "directory")
