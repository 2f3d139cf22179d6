"""License scans, by DataFrame operations only.

The units of a text are its lines and the text as a whole. A unit is normalised (lower case, runs of a-z and 0-9) and its
set of word bigrams is compared with each template's by the Dice coefficient, 2 * common / (a + b). At a threshold t, sizes
a and b can only reach it where t / (2 - t) * b <= a <= (2 - t) / t * b, which leaves few templates for a unit; before
that, a text is dropped where it has none of a few words that occur in too many bigrams of each template to be missed.
Both prunings are exact.

Where neither a line nor the whole text matches a template, windows of consecutive lines and sentences do; the licence texts
and headers of ``license_texts`` are looked for in windows only, as lines and whole texts are windows too. A window of any
length counts as long as its set is within the template's bounds. A best window begins and ends in a sentence with a bigram
of the template, and its end brings one that it had not before, so only such windows are compared; a text with fewer
of the template's bigrams than the lower bound has none. Each template found by its best window adds one to n_units.

Defined cases: null and empty texts and units of fewer than two words match nothing; of templates with the same Dice the
first by name is reported; repeated rows get equal rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text
from .license_texts import TEXTS

THRESHOLD = 0.75
# Notices by which texts state their licence.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "All-rights-reserved": "Copyright. All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0 Universal license.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction under this license.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
WORD = "[a-z0-9]+"
#: Ends of lines and of sentences.
SEGMENT_END = r"\n|(?<=[.!?;:])\s+"


def template_bigrams(text: str) -> list[str]:
    words = re.findall(WORD, text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """The sizes of sets that can reach the threshold with one of ``size``; a unit of slack each way for rounding."""
    return max(1, int(threshold / (2 - threshold) * size)), int((2 - threshold) / threshold * size) + 1


def telling_words(threshold: float = THRESHOLD, templates: dict[str, str] = TEMPLATES, long: int = 3) -> list[str]:
    """Words, one of which is in every unit that matches: for each template more bigrams hold one than may be missing.

    Words of more than ``long`` letters are taken first.
    """
    open_ = {name: template_bigrams(text) for name, text in templates.items()}
    spare = {name: len(b) - threshold / (2 - threshold) * len(b) for name, b in open_.items()}
    chosen: list[str] = []
    while any(spare[n] >= 0 for n in open_):
        gains: dict[str, int] = {}
        for name, bigrams in open_.items():
            if spare[name] >= 0:
                for bigram in bigrams:
                    for word in set(bigram.split()):
                        gains[word] = gains.get(word, 0) + 1
        best = max(sorted(gains), key=lambda w: (len(w) > long, gains[w]))
        chosen.append(best)
        for name, bigrams in open_.items():
            left = [b for b in bigrams if best not in b.split()]
            spare[name] -= len(bigrams) - len(left)
            open_[name] = left
    return chosen


def bigrams(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.concat_ws(" ", F.element_at(words, k), F.element_at(words, k + 1)))
    return F.array_distinct(pairs)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dice_of(unit: Column, wanted: Column) -> Column:
    return F.lit(2.0) * F.size(F.array_intersect(unit, wanted)) / (F.size(unit) + F.size(wanted))


def best_window(pairs: Column, wanted: Column, high: Column, need: Column, threshold: float) -> Column:
    """The greatest Dice of the windows of pairs (gram, first: begins a segment, at: its index, end: segment in which the second word is)."""

    def of_start(start: Column) -> Column:
        tail = F.slice(pairs, start["at"] + 1, F.size(pairs))
        # No window is longer than the shortest stretch that has too many bigrams; the rest of the text where none has.
        near = let(F.slice(tail, 1, high * 2), lambda part: F.when(F.size(F.array_distinct(part["gram"])) > high, part).otherwise(tail))

        def of_near(part: Column) -> Column:
            hits = F.filter(part, lambda x: F.array_contains(wanted, x["gram"]))
            nothing = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<int>").alias("ends"))
            firsts = F.aggregate(
                hits, nothing,
                lambda acc, x: F.when(F.array_contains(acc["seen"], x["gram"]), acc).otherwise(F.struct(F.array_append(acc["seen"], x["gram"]).alias("seen"), F.array_append(acc["ends"], x["end"]).alias("ends"))),
                lambda acc: F.array_distinct(acc["ends"]),
            )
            dices = F.transform(firsts, lambda end: let(F.array_distinct(F.filter(part, lambda x: x["end"] <= end)["gram"]), lambda grams: dice_of(grams, wanted)))
            return F.when(F.size(F.array_intersect(part["gram"], wanted)) >= need, F.array_max(dices))

        return let(near, of_near)

    best = F.array_max(F.transform(F.filter(pairs, lambda x: x["first"]), of_start))
    return F.when(best >= threshold, best)


def window_hits(text: Column, candidates: Column, threshold: float) -> Column:
    """order and license of the candidates (license, grams, high, need) that a window of lines and sentences matches."""
    segments = F.filter(F.transform(F.split(text, SEGMENT_END), lambda u: F.regexp_extract_all(F.lower(u), F.lit(f"({WORD})"), F.lit(1))), lambda w: F.size(w) > 0)
    tokens = F.flatten(F.transform(segments, lambda s, i: F.transform(s, lambda w, k: F.struct(w.alias("word"), i.alias("segment"), (k == 0).alias("first")))))

    def paired(all_tokens: Column) -> Column:
        following = F.slice(all_tokens, 2, F.size(all_tokens))
        both = F.zip_with(F.slice(all_tokens, 1, F.size(all_tokens) - 1), following, lambda x, y: F.struct(F.concat_ws(" ", x["word"], y["word"]).alias("gram"), x["first"].alias("first"), y["segment"].alias("end")))
        return F.transform(both, lambda x, k: F.struct(x["gram"].alias("gram"), x["first"].alias("first"), k.alias("at"), x["end"].alias("end")))

    def judged(pairs: Column) -> Column:
        found = F.transform(candidates, lambda c: F.struct((-best_window(pairs, c["grams"], c["high"], c["need"], threshold)).alias("order"), c["license"].alias("license")))
        return F.filter(found, lambda m: m["order"].isNotNull())

    return let(let(tokens, paired), judged)


def license_scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, license (the best template, else null), dice, n_units (matching units), n_licenses."""
    rows = id_and_text(docs)
    lowered = F.lower("text")
    may = F.lit(False)
    for word in telling_words(threshold, TEMPLATES | TEXTS):
        may = may | F.contains(lowered, F.lit(word))
    units = F.when(may, F.array_append(F.split("text", "\n"), F.col("text")))
    words = F.transform(F.coalesce(units, F.array().cast("array<string>")), lambda u: F.regexp_extract_all(F.lower(u), F.lit(f"({WORD})"), F.lit(1)))
    low = min(size_bounds(len(template_bigrams(t)), threshold)[0] for t in TEMPLATES.values())
    high = max(size_bounds(len(template_bigrams(t)), threshold)[1] for t in TEMPLATES.values())

    def matches(unit: Column) -> Column:
        found = []
        for name, text in sorted(TEMPLATES.items()):
            wanted = template_bigrams(text)
            lo, hi = size_bounds(len(wanted), threshold)
            dice = dice_of(unit, F.array(*map(F.lit, wanted)))
            found.append(F.when(F.size(unit).between(lo, hi) & (dice >= threshold), F.struct((-dice).alias("order"), F.lit(name).alias("license"))))
        return F.filter(F.array(*found), lambda m: m.isNotNull())

    every = {name: template_bigrams(text) for name, text in sorted((TEMPLATES | TEXTS).items())}
    known = F.array(*map(F.lit, sorted({g for grams in every.values() for g in grams})))
    # The least number of common bigrams, rounded down against errors of the division.
    wanted = F.array(*[
        F.struct(F.lit(n).alias("license"), F.array(*map(F.lit, g)).alias("grams"), F.lit(size_bounds(len(g), threshold)[1]).alias("high"), F.lit(size_bounds(len(g), threshold)[0]).alias("need"))
        for n, g in every.items()
    ])

    def scanned(lists: Column) -> Column:
        # A set of bigrams is no larger than the number of words; repeated words may make it smaller.
        sets = F.transform(F.filter(lists, lambda w: F.size(w) > max(1, low)), bigrams)
        sets = F.filter(sets, lambda b: F.size(b).between(low, high))
        whole = F.coalesce(F.element_at(lists, F.when(F.size(lists) > 0, -1)), F.array().cast("array<string>"))
        common = F.when(F.size(whole) > 1, F.array_intersect(bigrams(whole), known))
        return F.struct(F.filter(F.transform(sets, matches), lambda m: F.size(m) > 0).alias("units"), common.alias("common"))

    def with_windows(unit: Column) -> Column:
        names = F.transform(F.flatten(unit["units"]), lambda h: h["license"])
        open_ = F.filter(wanted, lambda c: (F.size(F.array_intersect(c["grams"], unit["common"])) >= c["need"]) & ~F.array_contains(names, c["license"]))
        found = let(open_, lambda c: F.when(F.size(c) > 0, window_hits(F.col("text"), c, threshold)))
        none = F.array().cast("array<struct<order: double, license: string>>")
        return F.concat(unit["units"], F.transform(F.coalesce(F.when(F.size(unit["common"]) > 0, found), none), lambda m: F.array(m)))

    rows = rows.select("doc_id", let(let(words, scanned), with_windows).alias("units")).select("doc_id", "units", F.array_sort(F.flatten("units")).alias("hits"))
    best = F.get("hits", F.lit(0))
    return rows.select("doc_id", best["license"].alias("license"), (-best["order"]).alias("dice"), F.size("units").cast("long").alias("n_units"), F.size(F.array_distinct(F.transform("hits", lambda h: h["license"]))).cast("long").alias("n_licenses"))


def oracle() -> str:
    """The same in DuckDB SQL, without the prunings."""
    templates = ", ".join(f"('{name}', '{text.lower()}')" for name, text in sorted(TEMPLATES.items()))
    grams = "list_distinct(list_transform(range(1, len({w})), lambda k: {w}[k] || ' ' || {w}[k + 1]))"
    return f"""
WITH templates AS (
  SELECT license, {grams.format(w="w")} AS t
  FROM (SELECT license, regexp_extract_all(body, '{WORD}') AS w FROM (VALUES {templates}) AS v(license, body))
), docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
units AS (
  SELECT n, doc_id, unnest(list_transform(range(1, len(u) + 1), lambda k: struct_pack(k := k, body := u[k]))) AS unit
  FROM (SELECT n, doc_id, list_append(string_split(text, chr(10)), text) AS u FROM docs)
), sets AS (
  SELECT n, doc_id, unit.k AS k, {grams.format(w="w")} AS b
  FROM (SELECT n, doc_id, unit, regexp_extract_all(lower(unit.body), '{WORD}') AS w FROM units)
), scored AS (
  SELECT n, k, license, 2.0::DOUBLE * len(list_intersect(b, t)) / (len(b) + len(t)) AS dice FROM sets, templates WHERE len(b) > 0
), hits AS (SELECT * FROM scored WHERE dice >= {THRESHOLD}),
best AS (
  SELECT n, first(license ORDER BY dice DESC, license) AS license, max(dice) AS dice, count(DISTINCT k) AS n_units, count(DISTINCT license) AS n_licenses
  FROM hits GROUP BY n
)
SELECT doc_id, license, dice, coalesce(n_units, 0) AS n_units, coalesce(n_licenses, 0) AS n_licenses FROM docs LEFT JOIN best USING (n)
"""
