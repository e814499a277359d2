"""License scans by diagonal voting, in DataFrame functions alone.

All rolling word k-grams of every text are hashed: pairs for phrases, four words
for passages.  Those whose hash a template has (a constant of this module, some
hundreds of hashes) are joined with the template positions, words compared as
well.  Hits are counted by diagonal, the offset between place in text and place
in template.  A phrase is found where one diagonal has all its pairs.  For a
passage the diagonals from each one to ``DRIFT`` further are merged, which lets a
few words be missing or extra, and verified as a span: all their hits lie within
the passage's length and the drift; each template word counts once however many
hits cover it; ``SHARE`` of the words must be covered, and with them the words
that tell a license from its relatives (``the gnu lesser general``), exactly.

Defined cases: a null or empty text has no words and no labels; repeated rows
get equal results, one each; a null id is an id; empty tables give no rows; long
texts are read whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, translate_lower

DRIFT = 4
SHARE = 0.6
GRAM = 4


def _runs_without(*ranges: tuple[int, int]) -> str:
    """A pattern for runs of other characters; single characters make a bit table in Java's engine, ranges a chain of tests several times as slow."""
    return "[^" + "".join(f"\\x{c:02X}" for low, high in ranges for c in range(low, high + 1)) + "]+"


_WORD = _runs_without((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

#: The base: each place of a phrase counts.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
_GNU = "free software you can redistribute it and or modify it under the terms of the {} as published by the free software foundation either version {} of the license or at your option any later version"
_CC = "this work is licensed under {} creative commons {} international license"
#: Passages of well-known licenses: the words, the label that the method adds, and words that must be there as they are.
PASSAGES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", ""),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "mit", ""),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit", ""),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache", ""),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2.0", "apache license version 2"),
    ("you may not use this file except in compliance with the license", "apache", ""),
    (_GNU.format("gnu general public license", "2"), "gpl-2.0", "the gnu general public+either version 2 of"),
    (_GNU.format("gnu general public license", "3"), "gpl-3.0", "the gnu general public+either version 3 of"),
    (_GNU.format("gnu general public license", "3"), "gpl", "the gnu general public"),
    (_GNU.format("gnu lesser general public license", "3"), "lgpl", "the gnu lesser general"),
    (_GNU.format("gnu affero general public license", "3"), "agpl", "the gnu affero general"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", ""),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "bsd", ""),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-3-clause", ""),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc", ""),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl", "the mozilla public license"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "unlicense", ""),
    ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "zlib", ""),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "bsl-1.0", "person or organization obtaining"),
    (_CC.format("a", "attribution 4 0"), "cc-by", "commons attribution 4 0"),
    (_CC.format("a", "attribution sharealike 4 0"), "cc-by-sa", "commons attribution sharealike 4"),
    (_CC.format("a", "attribution noncommercial 4 0"), "cc-by-nc", "commons attribution noncommercial 4"),
)
Passage = tuple[str, str, str]


@dataclass(frozen=True)
class Template:
    """k-grams of a phrase or passage; `must`: places of grams that have to be hit."""

    words: tuple[str, ...]
    label: str
    is_phrase: bool
    must: tuple[int, ...]

    @property
    def k(self) -> int:
        return 2 if self.is_phrase else GRAM

    def grams(self) -> list[str]:
        return [" ".join(self.words[i : i + self.k]) for i in range(len(self.words) - self.k + 1)]


def _templates(phrases: dict[str, str], passages: Sequence[Passage]) -> list[Template]:
    out = [Template(tuple(t.split()), label, True, ()) for t, label in phrases.items()]
    for text, label, must in passages:
        one = Template(tuple(text.split()), label, False, ())
        grams = [g for part in must.split("+") if part for w in [part.split()] for g in [" ".join(w[i : i + GRAM]) for i in range(max(1, len(w) - GRAM + 1))]]
        out.append(replace(one, must=tuple(sorted(one.grams().index(next(x for x in one.grams() if g in x)) for g in grams))))
    return out


def templates(spark: SparkSession, phrases: dict[str, str] = PHRASES, passages: Sequence[Passage] = PASSAGES) -> DataFrame:
    """gram, k, h, template, t_at, n (words), label, is_phrase and must: one row a gram of a template."""
    rows = []
    for no, t in enumerate(_templates(phrases, passages)):
        rows += [(g, t.k, no, i, len(t.words), t.label, t.is_phrase, list(t.must)) for i, g in enumerate(t.grams())]
    known = spark.createDataFrame(rows, "gram string, k int, template int, t_at int, n int, label string, is_phrase boolean, must array<int>")
    words = F.split("gram", " ")
    return known.withColumn("h", F.when(F.col("k") == 2, F.xxhash64(words[0], words[1])).otherwise(F.xxhash64(*(words[j] for j in range(GRAM)))) if GRAM != 2 else F.xxhash64(words[0], words[1]))


def hits(docs: DataFrame, known: DataFrame) -> DataFrame:
    """rid, doc_id, n_words and found (array of at, k, h and gram) of every row: the grams whose hash a template has."""
    of_size = {k: sorted({r["h"] for r in known.filter(F.col("k") == k).select("h").collect()}) for k in (2, GRAM)}  # of the module's constants
    text = translate_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    spelt = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)).alias("words"))

    def grams(k: int) -> Column:
        rest = ", ".join(f"words[i + {j}]" for j in range(1, k))
        hashed = F.expr(f"transform(slice(words, 1, greatest(0, size(words) - {k - 1})), (w, i) -> struct(i AS at, {k} AS k, xxhash64(w, {rest}) AS h))")
        return F.filter(hashed, lambda x: x["h"].isin(of_size[k]))

    met = F.concat(grams(2), grams(GRAM)) if GRAM != 2 else grams(2)
    spelt = spelt.select("rid", "doc_id", "words", F.size("words").cast("long").alias("n_words"), met.alias("met"))
    return spelt.select("rid", "doc_id", "n_words", F.expr("transform(met, x -> struct(x.at AS at, x.k AS k, x.h AS h, array_join(slice(words, x.at + 1, x.k), ' ') AS gram))").alias("found"))


def spans(found: DataFrame, known: DataFrame) -> DataFrame:
    """rid, template, label, is_phrase, first and last (words of the text, the last not included) and share of every verified span."""
    each = found.select("rid", F.explode("found").alias("x")).select("rid", "x.*")
    met = each.join(F.broadcast(known), ["k", "h", "gram"]).withColumn("diagonal", F.col("at") - F.col("t_at"))
    votes = met.groupBy("rid", "template", "diagonal").agg(F.collect_set("t_at").alias("t"), *(F.first(c).alias(c) for c in ("n", "k", "label", "is_phrase", "must")))
    phrases = votes.filter(F.col("is_phrase") & (F.size("t") == F.col("n") - 1)).select("rid", "template", "label", "is_phrase", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("n")).alias("last"), F.lit(1.0).alias("share"))
    # the diagonals from each to DRIFT further: their hits lie within n + DRIFT words of the text
    near = Window.partitionBy("rid", "template").orderBy("diagonal").rangeBetween(0, DRIFT)
    places = F.flatten(F.transform("ts", lambda d: F.transform(d["t"], lambda t: t + d["diagonal"])))
    merged = votes.filter("NOT is_phrase").withColumn("ts", F.collect_list(F.struct("diagonal", "t")).over(near)).withColumn("union", F.array_distinct(F.flatten("ts.t")))
    covered = F.array_distinct(F.flatten(F.transform("union", lambda t: F.sequence(t, t + F.col("k") - 1))))
    merged = merged.withColumns({"share": F.size(covered) / F.col("n"), "first": F.array_min(places), "last": F.array_max(places) + F.col("k")})
    passed = merged.filter((F.col("share") >= SHARE) & (F.size(F.array_except("must", "union")) == 0))
    # neighbouring diagonals that pass are one span, the best of them
    before = Window.partitionBy("rid", "template").orderBy("diagonal")
    opened = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(before) > DRIFT, F.lit(True)).cast("int")
    passed = passed.withColumn("new", opened).withColumn("no", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    best = passed.groupBy("rid", "template", "no").agg(F.max(F.struct("share", -F.col("first"), "first", "last", "label", "is_phrase")).alias("b"))
    return phrases.unionByName(best.select("rid", "template", F.col("b.label").alias("label"), F.col("b.is_phrase").alias("is_phrase"), F.col("b.first").alias("first"), F.col("b.last").alias("last"), F.col("b.share").alias("share")))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays, sorted), score and spans (label, first, last, share, by place) of every row."""
    known = templates(docs.sparkSession)
    found = stash(hits(docs, known), "hits")
    base = F.col("is_phrase")
    per_text = spans(found, known).groupBy("rid").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set("label")).alias("labels"),
        F.max("share").alias("score"),
        F.array_sort(F.collect_set(F.struct("first", "last", "label", "share"))).alias("spans"),
    )
    none = F.array().cast("array<string>")
    return found.select("rid", "doc_id", "n_words").join(per_text, "rid", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("spans", F.array().cast("array<struct<first:int,last:int,label:string,share:double>>")).alias("spans"),
    )
