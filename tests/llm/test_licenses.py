"""Sentences, gaps and rules on hand-made notices."""

import pytest

from pagetally.llm import licenses as li
from tests.llm.cases import ODD_TEXTS, documents

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
""".replace("\n", " ") + li.SENTENCES["mit-grant"].split("copy ", 1)[1] + ":"
CASES = [
    ("Released under the MIT License.", {"MIT"}, ["mit-released"]),
    ("RELEASED   under\tthe (MIT) license!\nMore text.", {"MIT"}, ["mit-released"]),
    ("Not released under the MIT License.", set(), []),
    ("Licensed under CC BY-NC 4.0.", {"CC-BY-NC-4.0"}, ["cc-by-nc"]),
    ("A.\nLicensed under the Apache License, Version 2.0.\nB. All rights reserved.",
     {"Apache-2.0", "LicenseRef-reserved"}, ["apache-licensed", "reserved"]),
    (f"{MIT}\n\n{li.SENTENCES['mit-notice']}.\n\nOne more.\n{li.SENTENCES['as-is']}.", {"MIT"},
     ["mit-grant", "mit-notice", "as-is"]),
    (f"{li.SENTENCES['mit-notice']}.\n{MIT}\n{li.SENTENCES['as-is']}.", set(), ["mit-notice", "mit-grant", "as-is"]),
    (f"{MIT}\nA. B.\n{li.SENTENCES['mit-notice']}.\n{li.SENTENCES['as-is']}.", {"MIT"},
     ["mit-grant", "mit-notice", "as-is"]),
    (f"{MIT}\nA. B. C.\n{li.SENTENCES['mit-notice']}.\n{li.SENTENCES['as-is']}.", set(),
     ["mit-grant", "mit-notice", "as-is"]),
    ("Licensed under CC BY 4.0\nLicensed under CC BY 4.0", {"CC-BY-4.0"}, ["cc-by", "cc-by"]),
]


def test_notices(spark):
    df = documents(spark, [c[0] for c in CASES])
    for r in li.scan(df).collect():
        text, names, ids = CASES[r.doc_id]
        assert (set(r.licenses), r.sentence_ids) == (names, ids), text
        assert r.licenses == sorted(r.licenses)


def test_texts_without_licences(spark):
    texts = [*ODD_TEXTS, "plain words. " * 5000 + "Released under the MIT license"]
    got = {r.doc_id: r.licenses for r in li.scan(documents(spark, texts)).collect()}
    assert got == {i: ["MIT"] if i == len(texts) - 1 else [] for i in range(len(texts))}
    assert li.scan(documents(spark, [])).isEmpty()


def test_every_rule_is_found_in_its_own_sentences(spark):
    assert all(set(ids) <= set(li.SENTENCES) for _, ids in li.RULES)
    texts = ["\n".join(li.SENTENCES[i] for i in ids) for _, ids in li.RULES]
    got = {r.doc_id: r.licenses for r in li.scan(documents(spark, texts)).collect()}
    assert got == {i: [name] for i, (name, _) in enumerate(li.RULES)}


def test_own_knowledge(spark):
    known, rules = {"x": "one two", "y": "three"}, (("L", ("x", "y")),)
    df = documents(spark, ["One; two. Three", "One, two. Three", "One two.\n\n-\nsix\nthree"])
    got = {r.doc_id: r.licenses for r in li.scan(df, known=known, rules=rules, max_gap=1).collect()}
    assert got == {0: [], 1: ["L"], 2: ["L"]}


WRAPPED = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
}


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "\r"])
def test_wrapped_standard_texts(spark, mark):
    def lines(text):
        every = ["Copyright (c) 2020 A. Body", *text.split("\n"), "", "code = 1"]
        return "\n".join(x + mark if mark == "\r" else mark + x for x in every)

    got = {r.doc_id: r for r in li.scan(documents(spark, map(lines, WRAPPED.values()))).collect()}
    for i, name in enumerate(WRAPPED):
        assert got[i].licenses == [name]
        ids = max((r for n, r in li.RULES if n == name), key=len)
        assert got[i].sentence_ids == list(ids)


def test_lines_and_ends(spark):
    grant = "Released under the\nMIT License"
    texts = [grant, "Released under the\n\nMIT License", "Not\n" + grant + "\nat all", "Released under. the MIT License",
             "One two\nthree", "Released under the\n#\n# MIT License"]
    got = {r.doc_id: (r.licenses, r.n_sentences) for r in li.scan(documents(spark, texts)).collect()}
    assert got == {0: (["MIT"], 2), 1: ([], 2), 2: (["MIT"], 4), 3: ([], 2), 4: ([], 2), 5: ([], 2)}


STANDARD = [
    ("This project is licensed under the MIT license.", ["MIT"]),
    ("This project is not licensed under the MIT license.", []),
    ("# SPDX-License-Identifier: MIT\nimport os", ["MIT"]),
    ("/* SPDX-License-Identifier: LGPL-2.1-or-later */", ["LGPL-2.1-or-later"]),
    ("// SPDX-License-Identifier: Apache-2.0\n\ncode", ["Apache-2.0"]),
    ("""                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION""", ["Apache-2.0"]),
    ("""This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""", ["GPL-2.0-or-later"]),
    ("""This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.""", ["LGPL-2.1-or-later"]),
    ("""This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""", ["MPL-2.0"]),
    ("Creative Commons Legal Code\n\nCC0 1.0 Universal\n\n    CREATIVE COMMONS CORPORATION", ["CC0-1.0"]),
    ("""This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:""", ["Zlib"]),
]


def test_standard_notices_and_tags(spark):
    got = {r.doc_id: r.licenses for r in li.scan(documents(spark, [t for t, _ in STANDARD])).collect()}
    assert got == {i: names for i, (_, names) in enumerate(STANDARD)}


def test_the_longest_rule_takes_its_sentences(spark):
    """A shorter licence is found beside a longer one, not inside it."""
    three = WRAPPED["BSD-3-Clause"]
    two = three.split("\n\n3.")[0]
    texts = [three, two, f"{three}\n\n{two}", f"{two}\n\n{three}", f"{two}\n\n{two}"]
    got = {r.doc_id: r.licenses for r in li.scan(documents(spark, texts)).collect()}
    both = ["BSD-2-Clause", "BSD-3-Clause"]
    assert got == {0: both[1:], 1: both[:1], 2: both, 3: both, 4: both[:1]}
    known, rules = {c: c for c in "abc"}, (("L$1", ("a",)), ("M\\", ("a", "b")), ("N", ("b", "c")))
    rows = li.scan(documents(spark, ["a\nb\nc", "a\nc", "b\nc\na\nb"]), known=known, rules=rules).collect()
    assert {r.doc_id: r.licenses for r in rows} == {0: ["M\\"], 1: ["L$1"], 2: ["M\\", "N"]}


def test_made_knowledge_is_bounded_and_unambiguous():
    assert len(set(li.SENTENCES.values())) == len(li.SENTENCES) < 300
    assert all(set(ids) <= set(li.SENTENCES) for _, ids in li.RULES)
