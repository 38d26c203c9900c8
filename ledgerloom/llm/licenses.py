"""License scan by sentences: known sentences become identifiers, identifier sequences are matched against rules.

A text is cut into sentences at lines without letters and digits, ``! ? ; :`` and at dots that end a word, and these into lines;
they are compared after lower-casing A-Z and turning everything but letters, digits and dots inside words into single
spaces, comment leaders among it.  Consecutive lines of a sentence that together give a known one count as that, so a
wrapped license is found as well as a notice on a line of its own; of several that begin at a line the longest counts.  The
identifiers of the known sentences of a text, in text order, form its sequence; unknown sentences leave no trace.  Rules are tried in order: a
rule's identifiers must follow each other in the sequence, and what a rule has matched is not matched again, so a whole
license text is reported once and not also by its first sentence.  DataFrame functions only; rows are not shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import LOWER, UPPER

# Sentences of public licenses and notices, by identifier.
SENTENCES = {
    1: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    2: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    3: "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    4: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    5: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    6: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    7: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    8: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    9: "Licensed under the Apache License, Version 2.0 (the \"License\")",
    10: "you may not use this file except in compliance with the License.",
    11: "You may obtain a copy of the License at",
    12: "Licensed under the Apache License, Version 2.0.",
    13: "Released under the MIT License.",
    14: "This program is free software",
    15: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    16: "either version 3 of the License, or (at your option) any later version.",
    17: "either version 2 of the License, or (at your option) any later version.",
    18: "This work is licensed under the GNU General Public License, version 3.",
    19: "This work is licensed under the GNU General Public License, version 2.",
    20: "Licensed under CC BY-NC 4.0.",
    21: "Licensed under CC BY 4.0.",
    22: "Licensed under CC BY-SA 4.0.",
    23: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    24: "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    25: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    26: "All rights reserved.",
}
# Rules in the order they are tried.
RULES = (
    ("MIT", (1, 2, 3)), ("MIT", (1, 2)), ("BSD-3-Clause", (4, 5, 6, 7)), ("BSD-2-Clause", (4, 5, 6)), ("ISC", (8,)),
    ("Apache-2.0", (9, 10, 11)), ("Apache-2.0", (9, 10)), ("GPL-3.0-or-later", (14, 15, 16)),
    ("GPL-2.0-or-later", (14, 15, 17)), ("Apache-2.0", (12,)), ("Apache-2.0", (9,)), ("MIT", (13,)), ("GPL-3.0", (18,)),
    ("GPL-2.0", (19,)), ("CC-BY-NC-4.0", (20,)), ("CC-BY-NC-4.0", (23,)), ("CC-BY-SA-4.0", (22,)), ("CC-BY-4.0", (21,)),
    ("CC-BY-4.0", (24,)), ("MPL-2.0", (25,)), ("proprietary", (26,)),
)
BREAK = r"[!?;:\n\r]+|[.]+(?=[^A-Za-z0-9]|$)"
# The same breaks but for those of single lines; lines without letters and digits; what stands before a line's first word.
HARD = r"[!?;:\r]+|[.]+(?=[^A-Za-z0-9]|$)"
BLANK, LEADER = r"\n(?:[^A-Za-z0-9.\n]*\n)+", r"\n[^A-Za-z0-9.\n\r]*"
NOISE = r"[^a-z0-9.\n\r]+"


def normal(sentence: str) -> list[str]:
    """Known sentence to its normalised pieces (one, unless it has a break inside)."""
    broken = re.sub(BREAK, "\n", sentence).translate(str.maketrans(UPPER, LOWER))
    return [p for p in (re.sub(NOISE, " ", x).strip(" ") for x in broken.split("\n")) if p]


def known_sentences(sentences: dict[int, str] = SENTENCES) -> dict[str, str]:
    """Normalised sentence to its token; of a sentence with breaks inside, its first piece stands for it."""
    return {normal(text)[0]: token(n) for n, text in sentences.items()}


def token(n: int) -> str:
    return f"<{n}>"


def lines(text: Column) -> Column:
    """The normalised lines of each sentence of a text, empty ones left out."""
    joined = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), BLANK, "\r")
    broken = F.translate(F.regexp_replace(F.regexp_replace(joined, LEADER, "\n"), HARD, "\r"), UPPER, LOWER)
    cut = F.split(F.regexp_replace(broken, NOISE, " "), "\r")
    trimmed = F.transform(cut, lambda s: F.filter(F.transform(F.split(s, "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    return F.filter(trimmed, lambda s: F.size(s) > 0)


def known_runs(sentence: Column, ids: Column, known: dict[str, str]) -> Column:
    """Tokens of the known sentences among runs of consecutive lines of a sentence, none of which overlap."""
    first_words = F.array(*[F.lit(w) for w in sorted({k.split(" ")[0] for k in known})])
    most = max(len(k.split(" ")) for k in known)
    starts = F.filter(
        F.sequence(F.lit(1), F.size(sentence)),
        lambda i: F.array_contains(first_words, F.substring_index(F.element_at(sentence, i), " ", 1)),
    )

    def from_line(i: Column) -> Column:
        ends = F.sequence(i, F.least(F.size(sentence), i + most - 1))
        tried = F.transform(
            ends, lambda j: F.struct(
                i.alias("lo"), j.alias("hi"), F.try_element_at(ids, F.array_join(F.slice(sentence, i, j - i + 1), " ")).alias("id")
            ),
        )
        return F.try_element_at(F.filter(tried, lambda x: x["id"].isNotNull()), F.lit(-1))

    found = F.filter(F.transform(starts, from_line), lambda x: x.isNotNull())
    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("ids"))
    return F.aggregate(
        found, none,
        lambda acc, x: F.when(
            x["lo"] > acc["end"], F.struct(x["hi"].alias("end"), F.array_append(acc["ids"], x["id"]).alias("ids"))
        ).otherwise(acc),
        lambda acc: acc["ids"],
    )


def scan_licenses(docs: DataFrame, sentences: dict[int, str] = SENTENCES, rules=RULES) -> DataFrame:
    """(doc_id, n_sentences, n_known, sequence, licenses) for every row of ``docs``.

    ``n_sentences`` counts the lines of all sentences, ``n_known`` the known sentences, however many lines each takes.
    ``sequence`` holds the identifiers of known sentences as ``<12><13>``, ``licenses`` the names of the matched rules,
    in rule order, once each, comma-joined.  A missing or empty text has no sentences and empty strings.
    """
    known = known_sentences(sentences)
    ids = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    parts = docs.select("doc_id", lines(F.coalesce("text", F.lit(""))).alias("_lines"))
    found = parts.select(
        "doc_id",
        F.aggregate("_lines", F.lit(0).cast("long"), lambda n, s: n + F.size(s)).alias("n_sentences"),
        F.flatten(F.transform("_lines", lambda s: known_runs(s, ids, known))).alias("_ids"),
    )
    order = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(map(token, seq))).alias("seq")) for name, seq in rules])
    sequence = F.array_join("_ids", "")
    start = F.struct(sequence.alias("left"), F.array().cast("array<string>").alias("names"))
    matched = F.aggregate(
        order,
        start,
        lambda acc, rule: F.struct(
            F.replace(acc["left"], rule["seq"], F.lit("<>")).alias("left"),
            F.when(F.contains(acc["left"], rule["seq"]), F.array_append(acc["names"], rule["name"]))
            .otherwise(acc["names"]).alias("names"),
        ),
    )
    return found.select(
        "doc_id", "n_sentences", F.size("_ids").cast("long").alias("n_known"), sequence.alias("sequence"),
        F.when(F.size("_ids") == 0, F.lit("")).otherwise(F.array_join(F.array_distinct(matched["names"]), ",")).alias("licenses"),
    )
