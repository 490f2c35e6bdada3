"""License scans in native expressions: positional index over the licence words of templates."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places are counted, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Licence templates: label, a passage of the licence or its customary notice, key phrases of which each must stand in the file.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("mpl-2", "mozilla public license version 2 0 1 definitions 1 1 contributor means each individual or legal entity that creates contributes to the creation of or owns covered software", ("mozilla public license version 2 0",)),
    ("gpl-2", "gnu general public license version 2 june 1991 copyright c 1989 1991 free software foundation inc", ("gnu general public license version 2 june 1991",)),
    ("gpl-3", "gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation inc", ("gnu general public license version 3 29 june 2007",)),
    ("gpl-2", "terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license as published by the free software foundation", "version 2 of the license")),
    ("gpl-3", "terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license as published by the free software foundation", "version 3 of the license")),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999 copyright c 1991 1999 free software foundation inc", ("gnu lesser general public license version 2 1 february 1999",)),
    ("lgpl-3", "gnu lesser general public license version 3 29 june 2007 copyright c 2007 free software foundation inc", ("gnu lesser general public license version 3 29 june 2007",)),
    ("lgpl-2.1", "terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", ("gnu lesser general public license as published by the free software foundation", "version 2 1 of the license")),
    ("lgpl-3", "terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu lesser general public license as published by the free software foundation", "version 3 of the license")),
    ("agpl-3", "gnu affero general public license version 3 19 november 2007 copyright c 2007 free software foundation inc", ("gnu affero general public license version 3 19 november 2007",)),
    ("agpl-3", "terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu affero general public license as published by the free software foundation",)),
    ("bsd-3", "may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted", "this permission notice appear in all copies")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications", ("will the authors be held liable", "permission is granted to anyone to use this software")),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("person or organization obtaining a copy of the software",)),
    ("epl-2", "made available under the terms of the eclipse public license 2 0", ("eclipse public license 2 0",)),
    ("epl-2", "eclipse public license v 2 0 the accompanying program is provided under the terms of this eclipse public license", ("eclipse public license v 2 0",)),
    ("cc0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("cc0", "creative commons legal code cc0 1 0 universal", ("cc0 1 0 universal",)),
)
#: Words of templates that are too common in any prose to look up.
COMMON = frozenset("a an and any are by for form in is of or that the this to use with it".split())


def words_of(text: Column) -> Column:
    """The words of the contract: A-Z lower-cased, runs of what is neither ASCII punctuation nor white space."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD, -1), "")


def key_word(phrase: str) -> str:
    """The rarest-looking word of a phrase: not a common one, and the longest."""
    return max(phrase.split(), key=lambda p: (p not in COMMON, len(p)))


def places(words: Column, phrase: str, present: Column | None = None) -> Column:
    """Starts at which the phrase's words stand one after another; looked for only where its key word occurs (in ``present``, if
    the few key words of many phrases that a text holds are known)."""
    parts = phrase.split()
    hit = lambda w, i: (w == parts[0])
    firsts = F.filter(F.transform(words, lambda w, i: F.when(hit(w, i), i)), lambda i: i.isNotNull())

    def here(i: Column) -> Column:
        ok = F.lit(True)
        for k, p in enumerate(parts[1:], 1):
            ok = ok & (F.get(words, i + k) == p)
        return ok

    return F.when(F.array_contains(words if present is None else present, key_word(phrase)), F.filter(firsts, here)).otherwise(F.array().cast("array<int>"))


def inverse_frequencies(worded: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """log(N / documents holding the word), counted over all rows; what comes to the driver is one row per template word."""
    held = worded.select(F.explode(F.array_union(F.array_intersect("words", F.array(*map(F.lit, vocabulary))), F.array(F.lit("")))).alias("w"))
    counts = dict(held.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect())
    n = counts.get("", 0)
    return {w: math.log((1 + n) / (1 + counts.get(w, 0))) + 1e-3 for w in vocabulary}


def prefix_postings(words: list[str], idf: dict[str, float], least: float) -> list[tuple[str, int]]:
    """The rarest postings (word, position) of a template, as few as leave less than ``least`` of its weight in the others.

    An alignment that holds ``least`` of the weight holds one of them, so looking up these alone loses none.
    """
    posted = sorted(((idf[w], q, w) for q, w in enumerate(words) if w in idf), key=lambda x: (-x[0], x[1]))
    rest, out = sum(x[0] for x in posted), []
    bound = least * rest
    for weight, q, w in posted:
        if rest < bound - 1e-6:
            break
        out.append((w, q))
        rest -= weight
    return out


def alignment_score(words: Column, template: str, idf: dict[str, float], least: float) -> Column:
    """The greatest share of the template's weight that one begin in words holds; null if no rare posting is there.

    Rare postings propose begins (place of the word less its position in the template); each distinct begin is scored
    over all postings. Work grows with the occurrences of rare words, and nothing leaves the row.
    """
    parts = template.split()
    total = sum(idf[w] for w in parts if w in idf)
    rare: dict[str, list[int]] = {}
    for w, q in prefix_postings(parts, idf, least):
        rare.setdefault(w, []).append(q)
    offsets = F.create_map(*[x for w, qs in rare.items() for x in (F.lit(w), F.array(*map(F.lit, qs)))])
    postings = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(q).alias("q"), F.lit(idf[w] / total).alias("share")) for q, w in enumerate(parts) if w in idf])
    proposed = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(F.map_keys(offsets), w), F.transform(F.element_at(offsets, w), lambda q: i - q))), lambda x: x.isNotNull())

    def score(begin: Column) -> Column:
        return F.aggregate(postings, F.lit(0.0), lambda acc, x: acc + F.when(F.get(words, begin + x["q"]) == x["w"], x["share"]).otherwise(0.0))

    return F.round(F.array_max(F.transform(F.array_distinct(F.flatten(proposed)), score)), 6)


def scan_licenses(docs: DataFrame, templates: tuple = TEMPLATES, phrases: tuple = PHRASES, least: float = 0.6, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: id, n_words, base_places (array<int>), base_labels, found (array<struct<label,score>>).

    Base: places of the phrases. Method: in files that have all key phrases of a template, its rarest words (by inverse
    document frequency over all files) propose where it begins; the share of the template's whole weight that stands at
    such a begin, word by word and position by position, is the score, and ``least`` or more is a find. A label's score
    is that of its best template. Files are judged one by one, so identical rows get identical results and count as files
    only in the frequencies. Null text counts as empty; ids may be null. Very long texts take time in proportion.
    """
    worded = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    wanted = sorted({key_word(p) for p in (*(p for _, _, keys in templates for p in keys), *(p for p, _ in phrases))})
    vocabulary = sorted({w for _, t, _ in templates for w in t.split() if w not in COMMON and not re.fullmatch("[0-9]+", w)})
    idf = inverse_frequencies(worded, vocabulary)

    keyed = worded.withColumn("present", F.array_intersect("words", F.array(*map(F.lit, wanted)).cast("array<string>")))
    words, present, scores = F.col("words"), F.col("present"), []
    for label, t, keys in templates:
        every = F.lit(True)
        for p in keys:
            every = every & (F.size(places(words, p, present)) > 0)
        scores.append(F.struct(F.lit(label).alias("label"), F.when(every, alignment_score(words, t, idf, least)).alias("score")))
    found = F.array_sort(F.filter(F.array(*scores), lambda s: s["score"] >= least))
    best = F.filter("hits", lambda s: ~F.exists("hits", lambda o: (o["label"] == s["label"]) & (o["score"] > s["score"])))
    nothing = F.array().cast("array<struct<label:string,score:double>>")
    each = [places(words, p, present) for p, _ in phrases]
    out = keyed.select(
        "id", F.size("words").cast("long").alias("n_words"),
        F.concat(*each).alias("base_places"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(e) > 0, F.lit(label)) for e, (_, label) in zip(each, phrases)])))).alias("base_labels"),
        F.when(F.size("present") > 0, found).otherwise(nothing).alias("hits"),
    )
    return out.select(F.col("id").alias(id_col), "n_words", "base_places", "base_labels", F.array_distinct(best).alias("found"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    both = F.array_sort(F.array_union("base_labels", F.transform("found", lambda s: s["label"])))
    score = F.greatest(F.when(F.size("base_labels") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0)))
    return x.select(
        "doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"),
        F.array_min("base_places").cast("long").alias("first_word"), F.array_max("base_places").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), F.least(score, F.lit(1.0)).alias("score"),
    )
