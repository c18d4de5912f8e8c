"""Licence recognition by sentence rules, without user functions.

Texts are cut into sentences, sentences are normalised (lower case, letters,
digits and dots only), and each is looked up in a table of known licence
sentences. The identifiers found, in text order, are then matched against
ordered rules: a rule holds if its identifiers occur in the text in its order.

Passages of licences as published are cut by the same rules when the tables are
made, so that a rule joins the pieces that a text really yields.

The tables are fixed, less than a hundred rows, and enter the plan as literals.
Only texts that contain a cue, a word that some known sentence must contain,
are cut up; the others cannot match. No shuffle: a hot source, a long text or
a line that many texts share costs one scan like any other.

Defined results
    * null or empty text: no sentence, no licence (empty strings, zero counts).
    * a sentence that occurs again counts again; ties do not arise, rules are
      reported in table order.
    * a sentence may be broken over lines: both the lines and the running text
      are tried.
    * a line of comment marks alone does not end a sentence: a notice that follows a copyright line without a
      full stop is known by its later sentences, if it has some. Marks with ';' or letters break sentences.
    * a BSD text without the known third clause is BSD, as its number of clauses is not known.
    * extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: normalised sentences of well-known licences and notices, by identifier
SENTENCES = {
    "mit.notice": "released under the mit license",
    "mit.notice2": "licensed under the mit license",
    "mit.notice3": "this project is licensed under the mit license",
    "mit.title": "the mit license",
    "mit.title2": "mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit.warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache2.notice": "licensed under the apache license version 2.0",
    "apache2.notice2": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
    "apache2.notice3": "released under the apache license version 2.0",
    "apache2.copy": "you may obtain a copy of the license at http www.apache.org licenses license 2.0",
    "apache2.warranty": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl3.notice": "this work is licensed under the gnu general public license version 3",
    "gpl3.notice2": "licensed under the gnu general public license version 3",
    "gpl2.notice": "this work is licensed under the gnu general public license version 2",
    "gpl2.notice2": "licensed under the gnu general public license version 2",
    "gpl.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl.free2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl.hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl.notice": "licensed under the gnu lesser general public license version 2.1",
    "agpl.notice": "licensed under the gnu affero general public license version 3",
    "bsd.redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd.notice": "released under the bsd license",
    "bsd3.notice": "licensed under the bsd 3 clause license",
    "bsd2.notice": "licensed under the bsd 2 clause license",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2.notice": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "mpl2.notice2": "licensed under the mozilla public license version 2.0",
    "ccby4.notice": "this work is licensed under a creative commons attribution 4.0 international license",
    "ccbysa4.notice": "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    "ccbync4.notice": "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
    "cc0.notice": "this work is dedicated to the public domain under the cc0 1.0 license",
    "unlicense.free": "this is free and unencumbered software released into the public domain",
    "ccby4.short": "licensed under cc by 4.0",
    "ccby4.short2": "this work is licensed under cc by 4.0",
    "ccby4.short3": "released under cc by 4.0",
    "ccbysa4.short": "licensed under cc by sa 4.0",
    "ccbysa4.short2": "this work is licensed under cc by sa 4.0",
    "ccbysa4.short3": "released under cc by sa 4.0",
    "ccbync4.short": "licensed under cc by nc 4.0",
    "ccbync4.short2": "this work is licensed under cc by nc 4.0",
    "ccbync4.short3": "released under cc by nc 4.0",
    "reserved.all": "all rights reserved",
    "reserved": "copyright all rights reserved no license is granted",
}

# fixed values: licence, and the sentences it needs in this order
RULES = (
    ("MIT", ("mit.grant", "mit.warranty")),
    ("MIT", ("mit.notice",)),
    ("MIT", ("mit.notice2",)),
    ("MIT", ("mit.notice3",)),
    ("MIT", ("mit.title",)),
    ("MIT", ("mit.title2",)),
    ("Apache-2.0", ("apache2.notice",)),
    ("Apache-2.0", ("apache2.notice3",)),
    ("Apache-2.0", ("apache2.notice2", "apache2.copy")),
    ("Apache-2.0", ("apache2.copy", "apache2.warranty")),
    ("GPL-3.0-only", ("gpl3.notice",)),
    ("GPL-3.0-only", ("gpl3.notice2",)),
    ("GPL-3.0-or-later", ("gpl.free", "gpl.hope")),
    ("GPL-2.0-only", ("gpl2.notice",)),
    ("GPL-2.0-only", ("gpl2.notice2",)),
    ("GPL-2.0-or-later", ("gpl.free2", "gpl.hope")),
    ("LGPL-2.1-only", ("lgpl.notice",)),
    ("AGPL-3.0-only", ("agpl.notice",)),
    ("BSD-3-Clause", ("bsd.redistribution", "bsd.names")),
    ("BSD-3-Clause", ("bsd3.notice",)),
    ("BSD-2-Clause", ("bsd2.notice",)),
    ("BSD", ("bsd.notice",)),
    ("ISC", ("isc.grant",)),
    ("MPL-2.0", ("mpl2.notice",)),
    ("MPL-2.0", ("mpl2.notice2",)),
    ("CC-BY-4.0", ("ccby4.notice",)),
    *(("CC-BY-4.0", (f"ccby4.{x}",)) for x in ("short", "short2", "short3")),
    ("CC-BY-SA-4.0", ("ccbysa4.notice",)),
    *(("CC-BY-SA-4.0", (f"ccbysa4.{x}",)) for x in ("short", "short2", "short3")),
    ("CC-BY-NC-4.0", ("ccbync4.notice",)),
    *(("CC-BY-NC-4.0", (f"ccbync4.{x}",)) for x in ("short", "short2", "short3")),
    ("CC0-1.0", ("cc0.notice",)),
    ("Unlicense", ("unlicense.free",)),
    # a notice, no licence: it is reported beside the licence of a text that has both
    ("All-rights-reserved", ("reserved.all",)),
    ("All-rights-reserved", ("reserved",)),
)

_APACHE_WARRANTY = (
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
    'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
)
_GPL = (
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
    "Free Software Foundation{} either version {} of the License, or (at your option) any later version."
)

# fixed values: passages of licences as published; an empty line is a paragraph end. Passages start behind
# what a comment block may glue to a copyright line, where a later sentence is enough to tell the licence.
TEXTS = {
    "mit.permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit.include": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit.asis": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache2.header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache2.obtain": "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0",
    "apache2.obtains": "You may obtain a copy of the License at\n\n    https://www.apache.org/licenses/LICENSE-2.0",
    "apache2.at": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "apache2.asis": _APACHE_WARRANTY,
    "apache2.run": f"You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 {_APACHE_WARRANTY}",
    "apache2.runs": f"You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0 {_APACHE_WARRANTY}",
    "gpl3.later": _GPL.format(",", 3),
    "gpl3.later2": _GPL.format(";", 3),
    "gpl2.later": _GPL.format(",", 2),
    "gpl2.later2": _GPL.format(";", 2),
    "gpl.useful": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd.endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd.asis": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "isc.use": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl2.form": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl2.copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl2.copy2": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

# fixed values: licence, and the passages it needs in this order
TEXT_RULES = (
    ("MIT", ("mit.permission", "mit.asis")),
    ("MIT", ("mit.include", "mit.asis")),
    *(("Apache-2.0", ("apache2.header", x)) for x in ("apache2.obtain", "apache2.obtains", "apache2.at", "apache2.copy")),
    *(("Apache-2.0", (x, "apache2.asis")) for x in ("apache2.obtain", "apache2.obtains", "apache2.at")),
    ("Apache-2.0", ("apache2.run",)),
    ("Apache-2.0", ("apache2.runs",)),
    ("GPL-3.0-or-later", ("gpl3.later", "gpl.useful")),
    ("GPL-3.0-or-later", ("gpl3.later2", "gpl.useful")),
    ("GPL-2.0-or-later", ("gpl2.later", "gpl.useful")),
    ("GPL-2.0-or-later", ("gpl2.later2", "gpl.useful")),
    ("BSD-3-Clause", ("bsd.source", "bsd.binary", "bsd.endorse")),
    # without a known third clause the two- and the three-clause text cannot be told apart
    ("BSD", ("bsd.source", "bsd.binary", "bsd.asis")),
    ("MPL-2.0", ("mpl2.form",)),
    ("MPL-2.0", ("mpl2.copy",)),
    ("MPL-2.0", ("mpl2.copy2",)),
)

#: Sentence ends inside running text become line ends; this marker cannot occur in an identifier.
_SENTENCE_END = r"([.!?:;])[ \t\r]+"
_PARAGRAPH_END = r"\n[ \t\r]*\n"
_DROPPED = r"[^a-z0-9.]+"
_ENDS = r"^[ .]+|[ .]+$"


def plain_pieces(text: str) -> list[str]:
    """The normalised sentences that the running reading makes of a text, for the tables."""
    flat = re.sub(_PARAGRAPH_END, ". ", text).replace("\n", " ")
    cut = re.sub(_SENTENCE_END, "\\1\n", flat).split("\n")
    return [x for p in cut if (x := re.sub(_ENDS, "", re.sub(_DROPPED, " ", p.lower())))]


def _with_texts():
    """The tables with the pieces of TEXTS; a sentence known already keeps its identifier."""
    ids, pieces = {s: k for k, s in SENTENCES.items()}, {}
    for name, text in TEXTS.items():
        cut = plain_pieces(text)
        pieces[name] = tuple(ids.setdefault(s, f"{name}.{i}" if len(cut) > 1 else name) for i, s in enumerate(cut, 1))
    more = [(k, tuple(y for x in need for y in pieces.get(x, (x,)))) for k, need in TEXT_RULES]
    rules, order = dict.fromkeys((*RULES, *more)), list(dict.fromkeys(k for k, _ in (*RULES, *more)))
    return {k: s for s, k in ids.items()}, tuple(sorted(rules, key=lambda r: order.index(r[0])))


SENTENCES, RULES = _with_texts()


# fixed values: words of too many texts to be a cue
_ORDINARY = frozenset("without distributed software source following conditions public documentation materials binary under forms".split())


def _cues(sentences) -> tuple[str, ...]:
    """Words of which every sentence contains one: the word that most of the others contain, again and again."""
    left, out = sorted(set(sentences)), []
    while left:
        words = sorted({w for s in left for w in s.split() if len(w) > 4} - _ORDINARY)
        out.append(max(words, key=lambda w: sum(w in s for s in left)))
        left = [s for s in left if out[-1] not in s]
    return tuple(out)


#: Words of which every known sentence contains one.
CUES = _cues(SENTENCES.values())


def _normalised(sentence: Column) -> Column:
    flat = F.regexp_replace(F.lower(sentence), _DROPPED, " ")
    return F.regexp_replace(flat, _ENDS, "")


def _found(pieces: Column) -> Column:
    """Identifiers of the known sentences among the pieces, in order."""
    known = F.transform(
        F.transform(pieces, _normalised),
        lambda s: F.element_at(F.create_map(*_pairs()), s),
    )
    return F.filter(known, lambda x: x.isNotNull())


def _pairs():
    for k, s in SENTENCES.items():
        yield F.lit(s)
        yield F.lit(k)


def sentence_pieces(text: Column) -> Column:
    """Lines, cut at sentence ends inside the line."""
    return F.split(F.regexp_replace(text, _SENTENCE_END, "$1\n"), "\n")


def running_pieces(text: Column) -> Column:
    """Sentences of the running text: line ends are blanks, empty lines separate."""
    flat = F.regexp_replace(text, _PARAGRAPH_END, ". ")
    return sentence_pieces(F.regexp_replace(flat, r"\n", " "))


def _like(seq: Column, ids: tuple[str, ...]) -> Column:
    return seq.like("%," + ",%,".join(ids) + ",%")


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_sentences, sentence_ids, licences, n_rules) per row; lists are joined by commas."""
    d = df.select(
        F.col(f"`{key}`").alias(key), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    lower = F.lower("text")
    cue = F.lit(False)
    for c in CUES:
        cue = cue | F.contains(lower, F.lit(c))
    d = d.select(
        key,
        F.when(cue, _found(sentence_pieces(F.col("text")))).alias("by_line"),
        F.when(cue, _found(running_pieces(F.col("text")))).alias("running"),
    )
    no = F.array().cast("array<string>")
    d = d.select(key, *(F.coalesce(c, no).alias(c) for c in ("by_line", "running")))
    # the reading that knows more sentences is the one reported
    ids = F.when(F.size("running") > F.size("by_line"), F.col("running")).otherwise(F.col("by_line"))
    d = d.withColumn("ids", ids)
    hits = []
    for name, need in RULES:
        seqs = [F.concat(F.lit(","), F.replace(F.array_join(c, ","), F.lit(","), F.lit(",,")), F.lit(",")) for c in ("by_line", "running")]
        hits.append(F.when(_like(seqs[0], need) | _like(seqs[1], need), F.lit(name)))
    d = d.withColumn("hits", F.filter(F.array(*hits), lambda x: x.isNotNull()))
    return d.select(
        key,
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(F.array_distinct("hits"), ",").alias("licences"),
        F.size("hits").cast("long").alias("n_rules"),
    )


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle_sql() -> str:
    """The same scan in DuckDB SQL, written from the same tables."""
    table = ", ".join(f"({_sql_text(s)}, {_sql_text(k)})" for k, s in SENTENCES.items())
    cues = " OR ".join(f"contains(lower(text), {_sql_text(c)})" for c in CUES)
    norm = "regexp_replace(regexp_replace(lower(piece), '[^a-z0-9.]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')"
    rules = ", ".join(
        f"CASE WHEN by_line LIKE {_sql_text('%,' + ',%,'.join(ids) + ',%')} "
        f"OR running LIKE {_sql_text('%,' + ',%,'.join(ids) + ',%')} THEN {_sql_text(name)} END"
        for name, ids in RULES
    )
    names = ", ".join(dict.fromkeys(_sql_text(n) for n, _ in RULES))
    return f"""
WITH known(sentence, id) AS (VALUES {table}),
cued AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
readings AS (
  SELECT r, 'line' AS how, string_split(regexp_replace(text, '([.!?:;])[ \\t\\r]+', '\\1\n', 'g'), '\n') AS p
  FROM cued WHERE {cues}
  UNION ALL
  SELECT r, 'run', string_split(regexp_replace(replace(regexp_replace(text, '\\n[ \\t\\r]*\\n', '. ', 'g'), '\n', ' '), '([.!?:;])[ \\t\\r]+', '\\1\n', 'g'), '\n')
  FROM cued WHERE {cues}),
pieces AS (SELECT r, how, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM readings),
found AS (SELECT r, how, i, id FROM (SELECT r, how, i, {norm} AS s FROM pieces) JOIN known ON s = sentence),
seq AS (SELECT r,
  count(*) FILTER (how = 'line') AS n_line, count(*) FILTER (how = 'run') AS n_run,
  coalesce(string_agg(id, ',' ORDER BY i) FILTER (how = 'line'), '') AS ids_line,
  coalesce(string_agg(id, ',' ORDER BY i) FILTER (how = 'run'), '') AS ids_run
  FROM found GROUP BY r),
judged AS (SELECT r, n_line, n_run, ids_line, ids_run,
  list_filter([{rules}], lambda x: x IS NOT NULL) AS hits
  FROM (SELECT *, ',' || replace(ids_line, ',', ',,') || ',' AS by_line,
               ',' || replace(ids_run, ',', ',,') || ',' AS running FROM seq))
SELECT doc_id,
  CAST(coalesce(greatest(n_line, n_run), 0) AS BIGINT) AS n_sentences,
  coalesce(CASE WHEN n_run > n_line THEN ids_run ELSE ids_line END, '') AS sentence_ids,
  coalesce(array_to_string(list_filter([{names}], lambda x: list_contains(hits, x)), ','), '') AS licences,
  CAST(coalesce(len(hits), 0) AS BIGINT) AS n_rules
FROM cued LEFT JOIN judged USING (r)
"""
