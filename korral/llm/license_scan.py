"""License scan with a positional rare-token index, in DataFrame functions only.

Templates (notice, mandatory key phrase, label) are a constant of the operator.
One scan turns each text into words and keeps, of the licence words (those of
any template), every place.  Over all documents it is then counted in how many
each licence word occurs.  The index posts, for every template, the words of its
key phrase with the highest IDF and their offsets.  A file's places of these
words are looked up, turned into starts of the phrase by their offsets, and the
starts that all posted words agree on are left; there the whole key phrase is
verified word by word.  A place of a phrase holds all its words, so no place is
missed, and which words are posted changes the work only.  A place's score is
the IDF-weighted share of the whole notice that stands around it.

Texts are read once and never move: what is kept of a document (written to the
shared checkpoint folder) are its distinct licence words and, if it has all words
of some key phrase, their places, eight bytes each.  All else is computed from
that, map-only but for the word counts (a row per licence word and map task).

Edge cases: a null text counts as empty; without words there is no place, no
label and score 0.  Each input row gives one row, other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korral.llm import _kernel as K

#: Notice, its mandatory key phrase, label; the first three are the base phrases.
TEMPLATES = (
    ("released under the mit license", "under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache license version 2", "apache-2"),
    ("licensed under cc by nc 4 0", "cc by nc", "cc-by-nc"),
    ("this work is licensed under the gnu general public license version 3", "gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gnu general public license version 2", "gpl-2"),
    ("licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3", "lgpl-3"),
    ("licensed under the gnu affero general public license version 3", "gnu affero general public license version 3", "agpl-3"),
    ("subject to the terms of the mozilla public license version 2 0", "mozilla public license version 2", "mpl-2"),
    ("redistributions of source code must retain the above copyright notice", "redistributions of source code must retain", "bsd"),
    ("licensed under cc by sa 4 0", "cc by sa", "cc-by-sa"),
    ("this is free and unencumbered software released into the public domain", "free and unencumbered software released", "unlicense"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge to any person", "mit"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "not use this file except in compliance with the license", "apache-2"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "redistribute it and or modify it under the terms of the gnu affero general public license", "agpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "and or distribute this software for any purpose with or without fee", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "subject to the terms of the mozilla public license v 2", "mpl-2"),
    ("the origin of this software must not be misrepresented you must not claim that you wrote the original software", "the origin of this software must not be misrepresented", "zlib"),
    ("distributed under the boost software license version 1 0", "boost software license version 1", "bsl-1"),
    ("the person who associated a work with this deed has dedicated the work to the public domain", "dedicated the work to the public domain", "cc0"),
)
BASE = 3
#: Words of a key phrase that the index posts.
POSTED = 3
#: What stands between words, once A-Z is in lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The one character beyond ASCII whose lower case is ASCII; it stays apart as another letter.
KELVIN, LETTER = "K", "é"


def _low(text: Column) -> Column:
    """The text in lower case; of its words, those in ASCII are as if only A-Z had been lowered."""
    return F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit(KELVIN), F.lit(LETTER)))


def _ints(values: list[int]) -> str:
    return f"array({', '.join(f'{v}L' for v in values)})"


def places_of_words(docs: DataFrame, codes: dict[str, int], phrases: list[list[str]], bits: int) -> DataFrame:
    """A row per document: doc_id, n_words, found (codes of its licence words), hits (place << bits | code, if it has all words of some phrase)."""
    out = docs.select("doc_id", F.array_remove(F.split(_low(F.col("text")), GAP, -1), "").alias("words"))
    wanted = ", ".join(f"'{w}'" for w in codes)
    out = out.select("doc_id", F.size("words").cast("bigint").alias("n_words"), "words", F.expr(f"array_remove(transform(words, (w, i) -> if(w in ({wanted}), i, -1)), -1)").alias("at"))
    vocabulary = f"array({', '.join(f"'{w}'" for w in codes)})"
    hits = F.expr(f"transform(at, i -> shiftleft(cast(i as bigint), {bits}) | (array_position({vocabulary}, words[i]) - 1))")
    out = out.select("doc_id", "n_words", hits.alias("hits"))
    out = out.select("doc_id", "n_words", "hits", F.expr(f"array_distinct(transform(hits, h -> h & {(1 << bits) - 1}L))").alias("found"))
    some = " or ".join(f"size(array_except({_ints(sorted({codes[w] for w in p}))}, found)) = 0" for p in phrases)
    return out.select("doc_id", "n_words", "found", F.when(F.expr(some), F.col("hits")).otherwise(F.array().cast("array<bigint>")).alias("hits"))


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str, str], ...] = TEMPLATES, base: int = BASE, posted: int = POSTED) -> DataFrame:
    """A row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places."""
    vocabulary = sorted({w for notice, _, _ in templates for w in notice.split()})
    codes, bits = {w: i for i, w in enumerate(vocabulary)}, len(vocabulary).bit_length()
    rows = K.cut(places_of_words(docs, codes, [p.split() for _, p, _ in templates], bits))
    df = {r.w: r["count"] for r in rows.select(F.explode(F.concat("found", F.array(F.lit(-1).cast("bigint")))).alias("w")).groupBy("w").count().collect()}
    idf = {w: math.log((df.get(-1, 0) + 1) / (df.get(i, 0) + 1)) + 1 for w, i in codes.items()}
    found = []
    for i, (notice, phrase, label) in enumerate(templates):
        ws, key = notice.split(), phrase.split()
        lead = next(j for j in range(len(ws)) if ws[j : j + len(key)] == key)
        rare = sorted({w: j for j, w in reversed(list(enumerate(key)))}.items(), key=lambda x: (-idf[x[0]], x[1]))[:posted]
        starts = [f"transform(filter(hits, h -> (h & {(1 << bits) - 1}L) = {codes[w]}L), h -> shiftright(h, {bits}) - {j})" for w, j in rare]
        agreed = starts[0]
        for x in starts[1:]:
            agreed = f"array_intersect({agreed}, {x})"
        at = lambda j, w: f"shiftleft(s + {j}, {bits}) | {codes[w]}L"
        whole = f"size(array_except(array({', '.join(at(j, w) for j, w in enumerate(key))}), hits)) = 0"
        total = sum(idf[w] for w in ws)
        score = " + ".join(f"if({f's + {j - lead} >= 0 and ' if j < lead else ''}array_contains(hits, {at(j - lead, w)}), {idf[w] / total!r}D, 0D)" for j, w in enumerate(ws))
        found.append(f"transform(filter({agreed}, s -> s >= 0 and {whole}), s -> named_struct('start', s, 'label', '{label}', 'base', {str(i < base).lower()}, 'score', {score}))")
    kind = "array<struct<start:bigint,label:string,base:boolean,score:double>>"
    out = rows.withColumn("places", F.when(F.size("hits") > 0, F.expr(f"cast(concat({', '.join(found)}) as {kind})")).otherwise(F.expr(f"cast(array() as {kind})")))
    mine = F.filter("places", lambda p: p["base"])
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    return out.select(
        "doc_id",
        "n_words",
        F.size(mine).cast("bigint").alias("n_base"),
        F.array_min(F.transform(mine, lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform(mine, lambda p: p["start"])).alias("last_word"),
        join(mine).alias("base_labels"),
        join(F.col("places")).alias("labels"),
        F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0))).alias("score"),
        "places",
    )
