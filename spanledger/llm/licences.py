"""Licence scans: a trained paragraph classifier with DataFrame and SQL functions only.

Paragraphs are lines and blocks of lines between blank ones (a wrapped
licence text). Those that hold one of ANCHORS or of ``key_words()`` (nothing without one can be confirmed, by its
construction) are turned into word n-grams of one to three words; a multinomial logistic regression over them, fitted on TEMPLATES and variants of them
against OTHER sentences, gives the licence family or ``unknown``. Probabilities are calibrated by a temperature that
minimises the log loss on variants left out of the fit. A prediction stands only if the paragraph also covers enough
word trigrams of one of the family's templates; else it is ``unknown``. What has no anchor is listed only if confirmed.

The model is a table of n-grams (bounded by the templates) that is broadcast; scoring explodes the n-grams of the few
anchored paragraphs and sums weights per paragraph inside the task, before a small shuffle.

Edge cases: null and empty texts have no paragraphs; rows with a null id are listed with it, merged by paragraph
number; rows that repeat an id are merged when their paragraph has the same number and words (a block's first line:
when the block has), and listed apart when not; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.llm.scratch import Scratch

# Wordings by which works name their licence.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Distributed under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Licensed under the BSD 2-Clause License.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0-1.0": [
        "Licensed under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work and dedicated it to the public domain.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain under the Unlicense.",
    ],
    "proprietary": [
        "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
        "All rights reserved.",
        "All rights reserved. Unauthorised copying is prohibited.",
    ],
}
# Sentences of the same words that license nothing.
OTHER = [
    "His driving license was renewed at the office on Monday.",
    "The restaurant lost its liquor license after the inspection.",
    "She asked for permission to leave the room early.",
    "Copyright law was debated in parliament for three days.",
    "The warranty on the washing machine ran out last year.",
    "Redistribution of income was the main theme of the campaign.",
    "The fishing licence costs forty a year and is valid for one person.",
    "You need permission from the owner to copy the key.",
    "The general public was admitted to the library under version two of the rules.",
    "A licensed electrician must inspect the source of the fault.",
    "The software company moved its office, and the terms of the lease changed.",
    "They were released under the bridge by the apache helicopter crew.",
    "The old road through the forest is in the public domain of the town.",
    "The commons were open and creative people met there.",
    "The university, MIT, published a report on energy.",
    "A license plate was found without a car.",
    "Without permission nobody may enter, said the guard at the gate.",
    "The author gave a free copy to any person who asked.",
    "No warranty claim was accepted after the deadline in version four of the form.",
    "The terms and conditions of the work contract were met.",
]
UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *TEMPLATES]
ANCHORS = ("licen", "copyright", "public domain", "rights reserved", "permission", "redistribut", "warrant", "creative commons")
MAX_N = 3
MIN_COVER = 0.6
MIN_PROBABILITY = 0.5


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _joined(ws: Column, n: int):
    # by position: slice() copies the whole array for every n-gram
    return lambda k: F.concat_ws(" ", *[F.get(ws, k + (d - 1)) for d in range(n)])


def ngrams(ws: Column, sizes=range(1, MAX_N + 1)) -> Column:
    """Distinct word n-grams of the sizes."""

    def of(ws: Column) -> Column:
        each = [F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - (n - 1)), _joined(ws, n))).otherwise(F.array().cast("array<string>")) for n in sizes]
        return F.array_distinct(F.concat(*each) if len(each) > 1 else each[0])

    # the words are bound once, as a lambda's variable: an expression put in their place would be evaluated for every n-gram
    return F.transform(F.array(ws), of)[0]


def anchored(text: Column) -> Column:
    low = F.lower(text)
    out = low.contains(ANCHORS[0])
    for a in ANCHORS[1:]:
        out = out | low.contains(a)
    return out


def _literal(spark, rows: list, schema: str) -> DataFrame:
    """A small table from a literal: no Python data source behind it."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("x")).select("x.*")


def variants(spark) -> DataFrame:
    """``y``, ``text``, ``fold`` (0: calibration): templates and other sentences, whole, cut, and inside other words."""
    rows = [{"y": FAMILIES.index(f), "text": t} for f, ts in TEMPLATES.items() for t in ts] + [{"y": 0, "text": t} for t in OTHER]
    base = _literal(spark, rows, "y: int, text: string")
    ws = F.split("text", " ")
    n = F.size(ws)
    forms = F.array(
        F.col("text"),
        F.concat(F.col("text"), F.lit(" See the file for details.")),
        F.concat(F.lit("Note: "), F.col("text")),
        F.concat(F.lit("Parts of this text were written by others. "), F.col("text")),
        F.concat_ws(" ", F.slice(ws, F.lit(1), F.greatest(F.lit(4), n - 1))),
        F.concat_ws(" ", F.slice(ws, F.least(F.lit(2), n), F.greatest(n - 1, F.lit(1)))),
        F.upper("text"),
        F.concat_ws(" ", F.slice(ws, F.lit(1), F.greatest(F.lit(5), F.ceil(n * 0.7).cast("int")))),
    )
    return base.select("y", F.posexplode(forms).alias("form", "text")).withColumn("fold", F.when(F.col("form").isin(1, 4), 0).otherwise(1))


def fit(spark) -> dict:
    """``weights`` (n-gram and one weight per family), ``intercept`` and ``temperature``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer

    data = variants(spark).withColumn("grams", ngrams(words(F.col("text")))).withColumn("label", F.col("y").cast("double")).coalesce(1).persist()
    counter = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2.0).fit(data)
    train = counter.transform(data.where("fold = 1")).persist()
    model = LogisticRegression(family="multinomial", regParam=0.002, maxIter=80).fit(train)
    w = model.coefficientMatrix.toArray()
    vocabulary = counter.vocabulary
    out = {"weights": [{"gram": g, "w": [round(float(w[k, j]), 6) for k in range(len(FAMILIES))]} for j, g in enumerate(vocabulary)], "intercept": [round(float(x), 6) for x in model.interceptVector], "temperature": 1.0}
    held = logits(data.where("fold = 0").select("y", "form", "text", "grams"), out, ["y", "form", "text"])
    tries = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0]
    loss = held.select(F.explode(F.array(*[F.struct(F.lit(t).alias("t"), (-F.log(F.element_at(softmax(F.col("z"), t), F.col("y") + 1))).alias("l")) for t in tries])).alias("x")).groupBy("x.t").agg(F.round(F.avg("x.l"), 9).alias("l"))
    out["temperature"] = float(loss.orderBy("l", "t").first()["t"])
    train.unpersist()
    data.unpersist()
    return out


def softmax(z: Column, temperature: float) -> Column:
    top = F.array_max(z)
    e = F.transform(z, lambda x: F.exp((x - top) / temperature))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def logits(rows: DataFrame, model: dict, keys: list[str]) -> DataFrame:
    """Adds up the weights of each row's ``grams``: ``z`` has one number per family."""
    spark = rows.sparkSession
    table = F.broadcast(_literal(spark, model["weights"], "gram: string, w: array<double>"))
    n = len(FAMILIES)
    hit = rows.select(*keys, F.explode_outer("grams").alias("gram")).join(table, "gram", "left")
    sums = hit.groupBy(*keys).agg(*[F.sum(F.coalesce(F.col("w")[k], F.lit(0.0))).alias(f"__z{k}") for k in range(n)])
    return sums.select(*keys, F.array(*[F.col(f"__z{k}") + F.lit(model["intercept"][k]) for k in range(n)]).alias("z"))


def _template_words() -> list[list[str]]:
    return [[w for w in re.split(r"[\W_]+", t.lower()) if w] for ts in TEMPLATES.values() for t in ts]


def key_words() -> list[str]:
    """Words of which a text has one, or an anchor, if it covers MIN_COVER of any template's trigrams.

    A template gets its longest words (those that OTHER has come last), until those of its trigrams without a one-word anchor or
    a key are a smaller share than MIN_COVER: who covers more has one of the rest. Needs no look at the documents.
    """
    common = {w for t in OTHER for w in re.split(r"[\W_]+", t.lower())}
    anchors, keys = [a for a in ANCHORS if " " not in a], set()
    for ws in _template_words():
        grams = {tuple(ws[k : k + MAX_N]) for k in range(len(ws) - MAX_N + 1)}
        more = sorted({w for w in ws if not any(a in w for a in anchors)}, key=lambda w: (w in common, -len(w), w))
        while sum(not any(w in keys or any(a in w for a in anchors) for w in g) for g in grams) >= MIN_COVER * len(grams) > 0:
            keys.add(more.pop(0))
    return sorted(keys)


def keyed(text: Column) -> Column:
    """Whether the text has an anchor or one of :func:`key_words`; short ones count as whole words only."""
    keys = key_words()
    short = [k for k in keys if len(k) < 4]

    def has(low: Column) -> Column:
        out = F.lit(False)
        for k in [*ANCHORS, *(k for k in keys if len(k) >= 4)]:
            out = out | low.contains(k)
        return out | low.rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(short) + r")(?![\p{L}\p{N}])") if short else out

    return F.exists(F.array(F.lower(text)), has)  # lower-cased once, as a lambda's variable


def near_template(text: Column) -> Column:
    """Whether the text shares a word trigram with a template: every text that covers a part of one does."""
    grams = {" ".join(ws[k : k + MAX_N]) for ws in _template_words() for k in range(len(ws) - MAX_N + 1)}
    known = F.array(*[F.lit(g) for g in sorted(grams)])
    # the words are bound once, as a lambda's variable
    return F.exists(F.array(words(text)), lambda ws: F.arrays_overlap(F.when(F.size(ws) >= MAX_N, F.transform(F.sequence(F.lit(1), F.size(ws) - (MAX_N - 1)), _joined(ws, MAX_N))).otherwise(F.array().cast("array<string>")), known))


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines and blocks (two or more lines without a blank one between) that hold an anchor or a key word.

    ``id``, ``paragraph`` (the line, or a block's first one, from 0), ``body``, ``whole`` (a block), ``block`` (its
    first line), ``span`` (hash of the block), ``listed`` (an anchored line).
    """
    cut = F.split(F.col(text_col), r"(?<=\n)(?=[ \t\r\f\x0b]*\n)")  # a blank line begins the next piece; all characters stay
    pieces = F.transform(cut, lambda x, k: F.struct(k.alias("k"), x.alias("x")))
    breaks = F.transform(cut, lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))))
    docs = docs.where(keyed(F.col(text_col)))  # all that follows sees only texts that may hold a licence
    found = docs.select(F.col(id_col).alias("id"), breaks.alias("breaks"), F.explode(F.filter(pieces, lambda p: keyed(p["x"]))).alias("p"))
    first = F.aggregate(F.slice("breaks", F.lit(1), F.col("p.k")), F.lit(0), lambda a, x: a + x)
    blocks = found.select("id", F.col("p.x").alias("x"), first.alias("first"), F.xxhash64("p.x").alias("span"))
    # a piece that begins with a blank line has its block one line later
    lead = F.when(F.col("x").rlike(r"^[ \t\r\f\x0b]*\n"), 1).otherwise(0)
    blocks = blocks.withColumn("block", F.col("first") + lead)
    lines = F.transform(F.split("x", "\n"), lambda x, k: F.struct((F.col("first") + k).alias("paragraph"), x.alias("body"), F.lit(False).alias("whole")))
    several = F.size(F.filter(F.split("x", "\n"), lambda x: F.trim(x) != "")) > 1
    whole = F.array(F.struct(F.col("block").alias("paragraph"), F.col("x").alias("body"), F.lit(True).alias("whole")))
    each = F.concat(F.filter(lines, lambda p: keyed(p["body"])), F.when(several, whole).otherwise(F.slice(whole, 1, 0)))
    each = blocks.select("id", "block", "span", F.explode(each).alias("p")).select("id", "p.*", "block", "span")
    each = each.withColumn("listed", ~F.col("whole") & anchored(F.col("body")))
    return each.where(F.col("whole") | F.col("listed") | near_template(F.col("body")))


def scan(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """``id``, ``paragraph``, ``family``, ``probability``, ``cover``, ``confirmed`` of every anchored line and of all that is confirmed.

    The candidate paragraphs are a table of ``scratch`` (by default one of its own in the shared folder).
    A block counts when none of its lines is confirmed for its family; it then stands in the place of its first line.
    """
    spark = docs.sparkSession
    rows = paragraphs(docs, id_col, text_col).withColumn("body", F.array_join(words(F.col("body")), " "))
    # written once: several joins below start from these few paragraphs, and each would read all documents again
    rows = (scratch or Scratch(spark, "licences")).write(rows, "paragraphs")
    rows = rows.withColumn("grams", ngrams(F.split("body", " "))).withColumn("mark", F.xxhash64("body")).drop("body")
    keys = ["id", "paragraph", "mark", "whole", "block", "span", "listed"]
    p = logits(rows, model, keys).withColumn("p", softmax(F.col("z"), model["temperature"]))
    best = F.array_position("p", F.array_max("p")).cast("int")
    p = p.select(*keys, best.alias("at"), F.array_max("p").alias("probability"))
    names = F.array(*[F.lit(f) for f in FAMILIES])
    p = p.withColumn("predicted", F.when(F.col("probability") >= MIN_PROBABILITY, F.element_at(names, F.col("at"))).otherwise(UNKNOWN))
    # template comparison: the share of a template's trigrams that the paragraph has
    t = _literal(spark, [{"f": f, "t": k, "text": t} for f, ts in TEMPLATES.items() for k, t in enumerate(ts)], "f: string, t: int, text: string")
    t = t.withColumn("g", ngrams(words(F.col("text")), [MAX_N]))
    t = F.broadcast(t.where(F.size("g") > 0).select("f", "t", F.size("g").alias("size"), F.explode("g").alias("gram")))
    hit = rows.select(*keys, F.explode("grams").alias("gram")).join(t, "gram").groupBy(*keys, "f", "t").agg((F.count("*") / F.first("size")).alias("cover"))
    cover = hit.groupBy(*keys, F.col("f").alias("predicted")).agg(F.least(F.max("cover"), F.lit(1.0)).alias("cover"))
    same = [p[k].eqNullSafe(cover[k]) for k in keys] + [p["predicted"] == cover["predicted"]]
    out = p.join(cover, same, "left").select(*[p[k] for k in keys], p["predicted"], "probability", F.coalesce("cover", F.lit(0.0)).alias("cover"))
    sure = (F.col("predicted") != UNKNOWN) & (F.col("cover") >= MIN_COVER)
    out = out.select(*keys, F.when(sure, F.col("predicted")).otherwise(UNKNOWN).alias("family"), "predicted", F.round("probability", 6).alias("probability"), F.round("cover", 6).alias("cover"), sure.alias("confirmed")).where("listed or confirmed")
    shown = [F.max_by(c, F.struct("confirmed", ~F.col("whole"), "span")).alias(c) for c in ("family", "predicted", "probability", "cover", "confirmed")]
    at = ["id", "block", "span"]
    told = out.where("not whole and confirmed").groupBy(*at).agg(F.collect_set("family").alias("__told"))
    told = told.select(*[F.col(k).alias(f"__{k}") for k in at], "__told")
    out = out.join(told, [out[k].eqNullSafe(told[f"__{k}"]) for k in at][0] & (out["block"] == told["__block"]) & (out["span"] == told["__span"]), "left")
    out = out.where(~F.col("whole") | F.col("__told").isNull() | ~F.expr("array_contains(__told, family)"))
    # a confirmed block takes the place of its first line when that is not confirmed itself
    first = F.when(F.col("paragraph") == F.col("block"), F.col("span")).otherwise(F.col("mark"))
    return out.groupBy("id", "paragraph", first.alias("__u")).agg(*shown).drop("__u")


def op5_licence_scan(spark, sf_dir: str) -> DataFrame:
    """Family of every anchored paragraph of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs.select("doc_id", "text"), fit(spark)).withColumnRenamed("id", "doc_id")
