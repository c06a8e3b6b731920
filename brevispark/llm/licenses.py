"""License scans: an exact set-similarity join of text blocks with a table of license templates, with DataFrame operations
only.

Tokens are ordered by their frequency over all documents, rarest first. A template's prefix is its first |T| - need + 1
tokens. Blocks are windows of twice a template's words, half overlapping, so a notice always lies in one. A pair of a
template and a block is a candidate if the block holds a prefix token (prefix filter), has `need` words (length filter) and
if, behind the rarest token that both share, enough tokens are left in the template and among the block's template tokens
(positional filter). Only candidates are compared in full. The templates are one array of rows, so the plan does not grow
with them, and a document without a prefix token ends at the first test.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevispark.llm.common import named

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.9
# The phrases of the base search and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Public license notices, lower-cased words.
TEMPLATES = {
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "apache": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis " "without warranties or conditions of any kind either express or implied",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    ],
    "lgpl": ["under the terms of the gnu lesser general public license"],
    "agpl": ["under the terms of the gnu affero general public license"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from " "this software without specific prior written permission",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
    ],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"
    ],
    "bsl": [
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"
    ],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "epl": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license"
    ],
    "cc-by-nc": ["licensed under cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "cc0": [
        "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"
    ],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}


def words_of(text: Column) -> Column:
    """Lower-cased words of a text (null: none). lower() and lower-casing A-Z alone find the same phrases and counts."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK), "")


def _places(words: Column, phrase: str) -> Column:
    """Indexes, from 0, of the places where the phrase's words stand consecutively."""
    parts = phrase.split()
    here = lambda i: [F.get(words, i + k) == F.lit(p) for k, p in enumerate(parts)]
    at = F.when(
        F.size(words) >= len(parts), F.sequence(F.lit(0), F.size(words) - len(parts))
    ).otherwise(F.array().cast("array<int>"))

    def all_of(i: Column) -> Column:
        tests = here(i)
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    return F.filter(at, all_of)


def token_order(docs: DataFrame, templates: dict[str, list[str]], text_col: str = "text") -> dict[str, int]:
    """Rank of each template token by its frequency over all documents (ties by code point)."""
    vocabulary = sorted({t for texts in templates.values() for x in texts for t in x.split()})
    words = docs.select(F.explode(words_of(named(text_col))).alias("w")).where(F.col("w").isin(vocabulary))
    n = {r["w"]: r["count"] for r in words.groupBy("w").count().collect()}  # at most the vocabulary
    return {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (n.get(t, 0), t)))}


ROW = "label string, words int, need int, tokens array<string>, prefix array<string>, ranks array<int>"


def template_table(templates: dict[str, list[str]], order: dict[str, int], threshold: float) -> list[dict]:
    """A row for each template (see ROW): tokens and prefix rarest first, ranks those of the prefix in the order."""
    out = []
    for label, texts in templates.items():
        for text in texts:
            tokens = sorted(set(text.split()), key=order.__getitem__)
            need = math.ceil(threshold * len(tokens) - 1e-9)
            prefix = tokens[: len(tokens) - need + 1]
            out.append(
                {
                    "label": label,
                    "words": len(text.split()),
                    "need": need,
                    "tokens": tokens,
                    "prefix": prefix,
                    "ranks": [order[t] for t in prefix],
                }
            )
    return out


def _matches(words: Column, hits: Column, places: Column, templates: Column, vocabulary: Column) -> Column:
    """(label, share) of every template whose threshold some block of words meets.

    hits are the prefix tokens that the words hold, places where they stand: (word number, number in hits).
    """

    def shared(t: Column, start: Column) -> Column:
        """Template tokens in the block at start if it passes the filters, else 0."""
        block = F.slice(words, start + 1, 2 * t["words"])
        first = F.array_position(t["prefix"], F.get(F.array_intersect(t["prefix"], block), F.lit(0))).cast("int")
        later = F.slice(vocabulary, F.element_at(t["ranks"], first) + 2, F.size(vocabulary))
        left = F.least(F.size(t["tokens"]) - first, F.size(F.array_intersect(later, block)))
        passed = (F.size(block) >= t["need"]) & (first > 0) & (1 + left >= t["need"])
        return F.when(passed, F.size(F.array_intersect(t["tokens"], block))).otherwise(0)

    def starts(t: Column) -> Column:
        """Starts of the two blocks around each prefix token."""
        own = F.filter(places, lambda p: F.array_contains(t["prefix"], F.element_at(hits, p["hit"])))
        at = lambda p: F.floor(p["place"] / t["words"]).cast("int") * t["words"]
        both = F.flatten(F.transform(own, lambda p: F.array(at(p), at(p) - t["words"])))
        return F.filter(F.array_distinct(both), lambda s: s >= 0)

    def best(t: Column) -> Column:
        most = F.array_max(F.transform(starts(t), lambda s: shared(t, s)))
        share = F.when(most >= t["need"], most / F.size(t["tokens"]).cast("double")).otherwise(F.lit(0.0))
        return F.struct(t["label"].alias("label"), share.alias("share"))

    candidates = F.filter(templates, lambda t: (F.size(words) >= t["need"]) & F.arrays_overlap(t["prefix"], hits))
    return F.filter(F.transform(candidates, best), lambda m: m["share"] > 0)


def scan(
    docs: DataFrame,
    *,
    templates: dict[str, list[str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null texts count as empty; labels are then empty strings and word places null. Rows that share an id are judged each
    for itself, texts of any length are read whole, other columns are ignored and an empty table gives no row. The score is
    1 with a base phrase, else the largest containment that meets the threshold, else 0. The templates travel with the
    plan: up to some megabytes of them.
    """
    order = token_order(docs, templates, text_col)
    rows = template_table(templates, order, threshold)
    table = F.from_json(
        F.lit(json.dumps(rows)),
        f"array<struct<{', '.join(f'{c.split()[0]}: {c.split()[1]}' for c in ROW.split(', '))}>>",
    )
    vocabulary = F.array(*map(F.lit, sorted(order, key=order.__getitem__)))
    prefixes = F.array(*map(F.lit, sorted({t for r in rows for t in r["prefix"]})))
    lasts = F.array(*map(F.lit, sorted({p.split()[-1] for p in PHRASES})))

    out = docs.select(named(id_col).alias("doc_id"), words_of(named(text_col)).alias("w"))
    out = out.withColumn("n_words", F.size("w").cast("long")).withColumn("hits", F.array_intersect(prefixes, "w"))
    used = (F.size("hits") > 0) | F.arrays_overlap("w", lasts)
    out = out.withColumn("w", F.when(used, F.col("w")).otherwise(F.array().cast("array<string>")))
    number = lambda x, i: F.struct(i.alias("place"), F.array_position("hits", x).cast("int").alias("hit"))
    places = F.filter(F.transform("w", number), lambda p: p["hit"] > 0)
    no_place = F.array().cast("array<struct<place:int,hit:int>>")
    out = out.withColumn("places", F.when(F.size("hits") > 0, places).otherwise(no_place))
    out = out.withColumn("found", _matches(F.col("w"), F.col("hits"), F.col("places"), table, vocabulary))
    for k, phrase in enumerate(PHRASES):
        at = F.when(
            F.array_contains("w", phrase.split()[-1]), _places(F.col("w"), phrase)
        ).otherwise(F.array().cast("array<int>"))
        out = out.withColumn(f"p{k}", at)
    at = F.concat(*[F.col(f"p{k}") for k in range(len(PHRASES))])
    own = F.array_compact(
        F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())])
    )
    more = F.transform("found", lambda m: m["label"])
    share = F.coalesce(F.array_max(F.transform("found", lambda m: m["share"])), F.lit(0.0))
    return out.select(
        "doc_id",
        "n_words",
        F.size(at).cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(own)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, more)), ",").alias("labels"),
        F.when(F.size(at) > 0, F.lit(1.0)).otherwise(share).alias("score"),
    )


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql9() -> str:
    """Brute force in DuckDB: every block against every template."""
    values = ", ".join(f"('{label}', '{t}')" for label, texts in TEMPLATES.items() for t in texts)
    phrase = "\n UNION ALL ".join(
        f"SELECT rid, i, '{label}' AS label FROM d, range(len(w)) r(i) WHERE "
        + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split()))
        for p, label in PHRASES.items()
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS ({phrase}),
b AS (SELECT rid, count(*) AS n, min(i) AS lo, max(i) AS hi, list(DISTINCT label) AS own FROM p GROUP BY rid),
t AS (SELECT label, string_split(x, ' ') AS words, list_distinct(string_split(x, ' ')) AS tokens FROM (VALUES {values}) v(label, x)),
c AS (SELECT rid, label, max(len(list_intersect(tokens, w[s + 1:s + 2 * len(words)])) / len(tokens)::DOUBLE) AS share
      FROM d, t, range(0, len(w), len(words)) r(s) WHERE list_has_any(w, tokens)
      GROUP BY rid, label),
m AS (SELECT rid, list(DISTINCT label) AS more, max(share) AS share FROM c WHERE share >= {THRESHOLD} - 1e-9 GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(own), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ','), '') AS labels,
       CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN m USING (rid)
"""


SQL9 = _sql9()
