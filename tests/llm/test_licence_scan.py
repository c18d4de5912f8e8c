import textwrap

import pytest

from ledgerloom.llm import licence_scan

APACHE = """Copyright 2020 The Authors

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
GPL2 = GPL3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""
BSD3 = BSD2.format("""
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
""")
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
UNLICENSE = "This is free and unencumbered software released into the\npublic domain.\n\nAnyone is free to copy."
WHOLE = {
    "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL3, "GPL-2.0-or-later": GPL2, "MIT": MIT, "MPL-2.0": MPL,
    "BSD-3-Clause": BSD3, "BSD": BSD2.format(""), "ISC": ISC, "Unlicense": UNLICENSE,
}
LAYOUTS = {
    "wrapped": str,
    "windows": lambda t: t.replace("\n", "\r\n"),
    "one line": lambda t: " ".join(t.split()),
    "narrow": lambda t: "\n\n".join(textwrap.fill(p, 40, break_on_hyphens=False, break_long_words=False) for p in t.split("\n\n")),
    "#": lambda t: "\n".join(f"# {x}".rstrip() for x in t.split("\n")),
    "//": lambda t: "\n".join(f"// {x}".rstrip() for x in t.split("\n")),
    "*": lambda t: "/*\n" + "\n".join(f" * {x}".rstrip() for x in t.split("\n")) + "\n */",
}


def licences(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licences.split(",") for r in licence_scan.scan(rows).collect()}
    return [got[i] for i in range(len(texts))]


def test_published_texts_are_known_in_every_layout(spark):
    cases = [(name, how, f(text)) for name, text in WHOLE.items() for how, f in LAYOUTS.items()]
    got = licences(spark, [t for _, _, t in cases])
    assert [(n, h) for (n, h, _), g in zip(cases, got, strict=True) if n not in g] == []


def test_three_clauses_of_a_named_holder_are_not_taken_for_two(spark):
    named = BSD3.replace("the copyright holder", "Example Inc")
    assert licences(spark, [named]) == [["BSD"]]


def test_oracle_agrees(spark):
    duckdb = pytest.importorskip("duckdb")
    texts = [None, "", *(f(t) for t in WHOLE.values() for f in LAYOUTS.values())]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    documents = rows.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    assert sorted(map(tuple, licence_scan.scan(rows).collect())) == sorted(con.execute(licence_scan.oracle_sql()).fetchall())


NOTICES = {
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY 4.0": "CC-BY-4.0",
    "This work is licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "All rights reserved.": "All-rights-reserved",
    "ALL RIGHTS RESERVED": "All-rights-reserved",
    "(c) 2020 Someone. All rights reserved.": "All-rights-reserved",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
    "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
}


def test_every_notice_is_known_and_no_other_text(spark):
    notices = list(NOTICES)
    around = [f"Of rain and sea.\n{n}\nMore of it." for n in notices]
    none = ["Rights were reserved for all.", "He has a licence to sail.", "Licensed under CC BY-NC 3.0."]
    assert licences(spark, notices + around + none) == [[NOTICES[n]] for n in notices] * 2 + [[""]] * 3


def test_cues_cover_the_table():
    assert all(any(c in s for c in licence_scan.CUES) for s in licence_scan.SENTENCES.values())
