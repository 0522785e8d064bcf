"""Licence scans by sentence rules, with built-in functions only.

A text is cut into sentences, sentences are brought into a normal form (lower case, words
only), and those that are known become identifiers. A licence is found where the identifiers
of one of its rules follow one another in the text, with at most ``MAX_GAP`` unknown
sentences between two of them. The rule of most sentences takes its identifiers first, of rules
as long the one listed first, and no other rule can use or reach over them, so a text that goes on to
a third clause is not the two-clause licence as well. Known sentences that belong to no rule found are
reported too, so that parts of a licence text do not go unnoticed.

A known sentence may be wrapped: a single line break, with comment marks around it, is white
space, while a blank line ends a sentence. It has to begin and end where a line or a sentence
does. Some standard texts have an end (colon, semicolon, blank line) inside what is known as
one sentence; ``ENDS_INSIDE`` says where. ``n_sentences`` counts lines as sentences.
Unknown lines that no end divides are one sentence for ``MAX_GAP``.

The knowledge is a fixed list of sentences and rules, and ones made from them: a tag line for each
licence that has an SPDX identifier, and statements that a project is under a licence. Other
lists can be given. The title of a full text of a GNU licence, without a notice that allows later
versions, stands for that version only.

Defined results: a null or empty text holds nothing; every row is scanned for itself, repeated
ids too; a licence that is found several times is reported once; an empty table gives no rows.
"""

from __future__ import annotations

import re
from itertools import chain, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetally.llm.common import slim

MAX_GAP = 2
UNKNOWN = "-"
FOUND = "!"

# Sentences of public licence texts and notices in normal form.
SENTENCES = {
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction including "
        "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
        "copies of the software and to permit persons to whom the software is furnished to do so subject to "
        "the following conditions"),
    "mit-notice": (
        "the above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the software"),
    "as-is": (
        "the software is provided as is without warranty of any kind express or implied including but not "
        "limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    "apache-licensed": "licensed under the apache license version 2 0",
    "apache-licensed-the": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl-redistribute": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu "
        "general public license as published by the free software foundation either version 3 of the license "
        "or at your option any later version"),
    "gpl-hope": (
        "this program is distributed in the hope that it will be useful but without any warranty without even "
        "the implied warranty of merchantability or fitness for a particular purpose"),
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "bsd-redistribute": (
        "redistribution and use in source and binary forms with or without modification are permitted provided "
        "that the following conditions are met"),
    "bsd-source": (
        "redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer"),
    "bsd-binary": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and "
        "the following disclaimer in the documentation and or other materials provided with the distribution"),
    "bsd-names": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission"),
    "isc-grant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is "
        "hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    "unlicense-released": "this is free and unencumbered software released into the public domain",
    "reserved": "all rights reserved",
    "gpl2-redistribute": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu "
        "general public license as published by the free software foundation either version 2 of the license "
        "or at your option any later version"),
    "gpl2-only": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu "
        "general public license version 2 as published by the free software foundation"),
    "lgpl21-redistribute": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu "
        "lesser general public license as published by the free software foundation either version 2 1 of the "
        "license or at your option any later version"),
    "lgpl3-redistribute": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu "
        "lesser general public license as published by the free software foundation either version 3 of the "
        "license or at your option any later version"),
    "agpl3-redistribute": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu "
        "affero general public license as published by the free software foundation either version 3 of the "
        "license or at your option any later version"),
    "library-hope": (
        "this library is distributed in the hope that it will be useful but without any warranty without even "
        "the implied warranty of merchantability or fitness for a particular purpose"),
    "mpl2-subject": (
        "this source code form is subject to the terms of the mozilla public license v 2 0"),
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-liable": (
        "in no event will the authors be held liable for any damages arising from the use of this software"),
    "zlib-grant": (
        "permission is granted to anyone to use this software for any purpose including commercial applications "
        "and to alter it and redistribute it freely subject to the following restrictions"),
    "cc0-waived": (
        "to the extent possible under law the person who associated cc0 with this work has waived all copyright "
        "and related or neighboring rights to this work"),
    "title-apache": "apache license version 2 0 january 2004",
    "title-apache-url": "apache license version 2 0 january 2004 http www apache org licenses",
    "title-gpl2": "gnu general public license version 2 june 1991",
    "title-gpl3": "gnu general public license version 3 29 june 2007",
    "title-lgpl21": "gnu lesser general public license version 2 1 february 1999",
    "title-lgpl3": "gnu lesser general public license version 3 29 june 2007",
    "title-agpl3": "gnu affero general public license version 3 19 november 2007",
    "title-mpl2": "mozilla public license version 2 0",
    "title-cc0": "cc0 1 0 universal",
    "title-boost": "boost software license version 1 0 august 17th 2003",
}

# Licences and the sentences that make them, in order.
RULES = (
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("Apache-2.0", ("apache-licensed",)),
    ("Apache-2.0", ("apache-licensed-the", "apache-comply", "apache-copy")),
    ("GPL-3.0-only", ("gpl3-work",)),
    ("GPL-3.0-or-later", ("gpl-redistribute", "gpl-hope")),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("BSD-2-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-names")),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("unlicense-released",)),
    ("LicenseRef-reserved", ("reserved",)),
    ("GPL-2.0-or-later", ("gpl2-redistribute", "gpl-hope")),
    ("GPL-2.0-only", ("gpl2-only", "gpl-hope")),
    ("LGPL-2.1-or-later", ("lgpl21-redistribute", "library-hope")),
    ("LGPL-3.0-or-later", ("lgpl3-redistribute", "library-hope")),
    ("AGPL-3.0-or-later", ("agpl3-redistribute", "gpl-hope")),
    ("MPL-2.0", ("mpl2-subject",)),
    ("Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant")),
    ("CC0-1.0", ("cc0-waived",)),
    ("Apache-2.0", ("title-apache",)),
    ("Apache-2.0", ("title-apache-url",)),
    ("GPL-2.0-only", ("title-gpl2",)),
    ("GPL-3.0-only", ("title-gpl3",)),
    ("LGPL-2.1-only", ("title-lgpl21",)),
    ("LGPL-3.0-only", ("title-lgpl3",)),
    ("AGPL-3.0-only", ("title-agpl3",)),
    ("MPL-2.0", ("title-mpl2",)),
    ("CC0-1.0", ("title-cc0",)),
    ("BSL-1.0", ("title-boost",)),
)

# The words before an end inside a known sentence, or before each of several.
ENDS_INSIDE: dict[str, str | tuple[str, ...]] = {
    "apache-copy": "you may obtain a copy of the license at",
    "gpl-redistribute": "this program is free software",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl2-redistribute": (
        "this program is free software",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu "
        "general public license as published by the free software foundation"),
    "gpl2-only": "this program is free software",
    "agpl3-redistribute": "this program is free software",
    "lgpl21-redistribute": (
        "this library is free software",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu "
        "lesser general public license as published by the free software foundation"),
    "lgpl3-redistribute": "this library is free software",
    "library-hope": "this library is distributed in the hope that it will be useful but without any warranty",
    "mpl2-subject": "this source code form is subject to the terms of the mozilla public license v",
}

# How statements name a licence, and what they say of whom.
SPOKEN = {
    "MIT": "the mit license",
    "Apache-2.0": "the apache license version 2 0",
    "GPL-2.0-only": "the gnu general public license version 2",
    "GPL-3.0-only": "the gnu general public license version 3",
    "BSD-2-Clause": "the bsd 2 clause license",
    "BSD-3-Clause": "the bsd 3 clause license",
    "MPL-2.0": "the mozilla public license version 2 0",
}
SUBJECTS = ("it", "this code", "this library", "this package", "this program", "this project", "this software", "this work")
VERBS = ("is licensed under", "is released under", "is distributed under")
TAG = "spdx license identifier"


def _made() -> None:
    """Add tag lines and statements for the licences of ``RULES``."""
    global RULES
    added = []

    def add(name: str, license_: str, sentence: str, end: str = "") -> None:
        if sentence in SENTENCES.values():
            return
        SENTENCES[name] = sentence
        added.append((license_, (name,)))
        if end:
            ENDS_INSIDE[name] = end

    for license_ in sorted({name for name, _ in RULES if not name.startswith("LicenseRef-")}):
        spelled = re.sub(r"[^a-z0-9]+", " ", license_.lower())
        add(f"tag-{spelled.replace(' ', '-')}", license_, f"{TAG} {spelled}", TAG)
    for license_, name in SPOKEN.items():
        for i, (subject, verb) in enumerate(product(SUBJECTS, VERBS)):
            add(f"says-{i}-{re.sub('[^a-z0-9]+', '-', license_.lower())}", license_, f"{subject} {verb} {name}")
    RULES += tuple(added)


_made()

END_MARK = r"[.!?;:]+(?:\s+|$)"
SENTENCE_END = END_MARK + r"|\n+"
NOT_A_WORD = r"[^\p{L}\p{N}\n]+"


def rule_pattern(ids: tuple[str, ...], max_gap: int = MAX_GAP) -> str:
    """A pattern over identifiers that each have a space before and after them."""
    gap = rf"(?: {re.escape(UNKNOWN)} ){{0,{max_gap}}}"
    # Identifiers hold letters, digits and hyphens only.
    return gap.join(f" {i} " for i in ids)


def in_order(rules: tuple[tuple[str, tuple[str, ...]], ...]) -> list[tuple[str, tuple[str, ...]]]:
    """The rules as they take identifiers: those of most sentences first, else as listed."""
    return sorted(rules, key=lambda r: -len(r[1]))


def claims(
    rules: tuple[tuple[str, tuple[str, ...]], ...], max_gap: int = MAX_GAP,
) -> list[tuple[str, str]]:
    """(pattern, licence) in the order in which they are to be replaced by ``FOUND`` and the licence."""
    out, single = [], {}
    for name, ids in in_order(rules):
        if len(ids) > 1:
            out.append((rule_pattern(ids, max_gap), name))
        else:
            single.setdefault(name, []).append(ids[0])
    return out + [(f" (?:{'|'.join(ids)}) ", name) for name, ids in single.items()]


def _literal(name: str) -> str:
    """A licence's name as the replacement of a pattern; it must not hold a space."""
    return re.sub(r"([\\$])", r"\\\1", name)


def sentence_pattern(known: dict[str, str], ends_inside: dict[str, str | tuple[str, ...]]) -> str:
    """A pattern for known sentences in text made by ``_marked``, longer ones first."""
    within = r"(?: ?\n ?| )"
    forms = []
    for name, sentence in sorted(known.items(), key=lambda k: (-len(k[1]), k)):
        heads = ends_inside.get(name, ())
        ends = {len(h.split()) for h in ([heads] if isinstance(heads, str) else heads)}
        words = [re.escape(w) for w in sentence.split()]
        forms.append(words[0] + "".join(
            (r"[ \n]+" if i in ends else within) + w for i, w in enumerate(words[1:], 1)))
    return rf"(?m)^ ?({'|'.join(forms)}) ?$" if forms else "(?!)"


def _marked(text: Column) -> Column:
    """Words in lower case; a line break stays one and the end of a sentence becomes two."""
    ended = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), END_MARK, "\n\n")
    return F.regexp_replace(ended, NOT_A_WORD, " ")


def _filled(text: Column, end: str) -> Column:
    return F.filter(F.split(text, end), lambda s: F.trim(F.translate(s, "\n", " ")) != "")


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    known: dict[str, str] | None = None, rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES,
    max_gap: int = MAX_GAP, ends_inside: dict[str, str | tuple[str, ...]] | None = None,
) -> DataFrame:
    """(id, licenses, sentence_ids, n_sentences) per row of ``docs``, the lists sorted or in text order."""
    known = SENTENCES if known is None else known
    table = F.create_map(*map(F.lit, chain.from_iterable((s, i) for i, s in known.items())))
    pattern = sentence_pattern(known, ENDS_INSIDE if ends_inside is None else ends_inside)
    rows = slim(docs, id_col, text_col).select("id", _marked(F.col("text")).alias("marked"))
    # Every second part is a known sentence; what is left of a text holds words and line breaks only.
    parts = F.split(F.regexp_replace("marked", pattern, "\x01$1\x01"), "\x01")

    def names(part: Column, place: Column) -> Column:
        name = F.try_element_at(table, F.regexp_replace(part, "[ \n]+", " "))
        unknown = F.transform(_filled(part, r"\n *\n"), lambda s: F.lit(UNKNOWN))
        return F.when(place % 2 == 1, F.array(F.coalesce(name, F.lit(UNKNOWN)))).otherwise(unknown)

    ids = F.when(F.col("marked").rlike(pattern), F.flatten(F.transform(parts, names)))
    rows = rows.select("id", F.size(_filled(F.col("marked"), "\n+")).cast("long").alias("n_sentences"),
                       F.coalesce(ids, F.array().cast("array<string>")).alias("ids"))
    own = F.filter("ids", lambda i: i != UNKNOWN)
    rows = rows.select("id", "n_sentences", own.alias("sentence_ids"),
                       F.when(F.size(own) > 0, F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" "))).alias("line"))
    line = F.col("line")
    for pattern, name in claims(rules, max_gap):
        line = F.regexp_replace(line, F.lit(pattern), F.lit(f" {FOUND}{_literal(name)} "))
    marks = F.filter(F.split(line, " "), lambda w: w.startswith(FOUND))
    hits = F.transform(marks, lambda w: F.substring(w, len(FOUND) + 1, 1 << 20))
    return rows.select(
        F.col("id").alias(id_col),
        F.coalesce(F.array_sort(F.array_distinct(hits)), F.array().cast("array<string>")).alias("licenses"),
        "sentence_ids", "n_sentences")
