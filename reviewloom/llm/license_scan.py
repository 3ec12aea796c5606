"""Licence scans: known sentences become identifiers, identifier sequences become licences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import ascii_lower

# Sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "mit-title": "MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "mit-reference": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "apache-grant": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-reference": "Licensed under the Apache License, Version 2.0",
    "apache-use": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "gpl-free": "This program is free software",
    "gpl3-grant": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-grant": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl2-foundation": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl2-version": "either version 2 of the License, or (at your option) any later version",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl3-reference": "This work is licensed under the GNU General Public License, version 3",
    "gpl2-reference": "This work is licensed under the GNU General Public License, version 2",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-reference": "Licensed under CC BY 4.0",
    "cc-by-sa-reference": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-reference": "Licensed under CC BY-NC 4.0",
    "cc-by-nd-reference": "Licensed under CC BY-ND 4.0",
    "cc0-waiver": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "reserved": "All rights reserved",
    "apache-copy-at": "You may obtain a copy of the License at",
    "apache-address": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-address-s": "https://www.apache.org/licenses/LICENSE-2.0",
    # the end of "v." ends a sentence
    "mpl-subject-v": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "gpl2-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2",
    "gpl3-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3",
    "gpl3-version": "either version 3 of the License, or (at your option) any later version",
    "lgpl-free": "This library is free software",
    "lgpl-grant": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "lgpl21-version": "either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-grant": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3-grant": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gnu-appendix": "and each file should have at least the \"copyright\" line and a pointer to where the full notice is found",
    "gpl2-text": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl3-text": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21-text": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3-text": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3-text": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "apache-text": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "mpl-text": "Mozilla Public License Version 2.0",
    "epl1-text": "Eclipse Public License - v 1.0",
    "epl2-text": "Eclipse Public License - v 2.0",
    "cc0-text": "CC0 1.0 Universal",
    "unlicense-text": "This is free and unencumbered software released into the public domain",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
}

# What a notice names a licence by, and what may stand before the name.
NAMES = {
    "MIT": ("MIT", "MIT License", "MIT licence"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache 2.0 License", "Apache License v2.0", "Apache v2.0"),
    "BSD-2-Clause": ("BSD 2-Clause", "BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause", "BSD 3-Clause License", "3-Clause BSD License", "New BSD License"),
    "ISC": ("ISC", "ISC License"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License v2.0", "MPL 2.0", "MPL v2.0"),
    "EPL-1.0": ("Eclipse Public License, Version 1.0", "Eclipse Public License v1.0", "EPL 1.0", "EPL v1.0"),
    "EPL-2.0": ("Eclipse Public License, Version 2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL 2.0", "EPL v2.0"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License", "zlib"),
    "CC0-1.0": ("CC0 1.0", "CC0", "CC0 1.0 Universal"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
}
for _id, _long, _short, _version in (
    ("GPL-2.0", "General Public License", "GPL", "2"),
    ("GPL-3.0", "General Public License", "GPL", "3"),
    ("LGPL-2.1", "Lesser General Public License", "LGPL", "2.1"),
    ("LGPL-3.0", "Lesser General Public License", "LGPL", "3"),
    ("AGPL-3.0", "Affero General Public License", "AGPL", "3"),
):
    _numbers = [_version] if "." in _version else [_version, f"{_version}.0"]
    _names = [f"GNU {_long}{sep}{n}" for n in _numbers for sep in (", version ", " v")]
    _names += [f"{gnu}{_short}{sep}{n}" for n in _numbers for gnu in ("", "GNU ") for sep in (" v", "v", " ")]
    NAMES[f"{_id}-only"] = (*_names, f"{_id}-only")
    NAMES[f"{_id}-or-later"] = tuple(f"{n} or later" for n in (*_names, _id))
# A "+" is no letter, so that "GPLv3+" reads as "GPLv3".
SUBJECTS = ("", "This project is ", "This software is ", "This work is ")
VERBS = ("licensed under ", "released under ", "distributed under ")
ARTICLES = ("", "the ")

# Rules in the order in which they are tried; each consumes the identifiers it matches.
RULES = (
    ("gpl-3-appendix", "GPL-3.0-only", ("gnu-appendix", "gpl-free", "gpl3-grant", "gpl-warranty")),
    ("gpl-2-appendix", "GPL-2.0-only", ("gnu-appendix", "gpl-free", "gpl2-foundation", "gpl2-version", "gpl-warranty")),
    ("lgpl-2.1-appendix", "LGPL-2.1-only", ("gnu-appendix", "lgpl-free", "lgpl-grant", "lgpl21-version")),
    ("agpl-3-appendix", "AGPL-3.0-only", ("gnu-appendix", "gpl-free", "agpl3-grant", "gpl-warranty")),
    ("mit-full", "MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("bsd-3-full", "BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty")),
    ("bsd-2-full", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("apache-header", "Apache-2.0", ("apache-grant", "apache-use", "apache-copy", "apache-warranty", "apache-see")),
    ("apache-header-lines", "Apache-2.0", ("apache-grant", "apache-use", "apache-copy-at", "apache-address", "apache-warranty", "apache-see")),
    ("apache-header-lines-s", "Apache-2.0", ("apache-grant", "apache-use", "apache-copy-at", "apache-address-s", "apache-warranty", "apache-see")),
    ("gpl-3-header", "GPL-3.0-or-later", ("gpl-free", "gpl3-grant", "gpl-warranty")),
    ("gpl-2-header", "GPL-2.0-or-later", ("gpl-free", "gpl2-foundation", "gpl2-version", "gpl-warranty")),
    ("apache-short", "Apache-2.0", ("apache-grant", "apache-use")),
    ("isc-grant", "ISC", ("isc-grant",)),
    ("mpl-header", "MPL-2.0", ("mpl-subject",)),
    ("gpl-3-reference", "GPL-3.0-only", ("gpl3-reference",)),
    ("gpl-2-reference", "GPL-2.0-only", ("gpl2-reference",)),
    ("apache-reference", "Apache-2.0", ("apache-reference",)),
    ("apache-grant", "Apache-2.0", ("apache-grant",)),
    ("mit-reference", "MIT", ("mit-reference",)),
    ("mit-licensed", "MIT", ("mit-licensed",)),
    ("cc-by-nc-reference", "CC-BY-NC-4.0", ("cc-by-nc-reference",)),
    ("cc-by-sa-reference", "CC-BY-SA-4.0", ("cc-by-sa-reference",)),
    ("cc-by-nd-reference", "CC-BY-ND-4.0", ("cc-by-nd-reference",)),
    ("cc-by-reference", "CC-BY-4.0", ("cc-by-reference",)),
    ("cc0-waiver", "CC0-1.0", ("cc0-waiver",)),
    # a full text with its appendix names no choice of version; the appendix is no notice
    ("gpl-2-text", "GPL-2.0-only", ("gpl2-text",)),
    ("gpl-3-text", "GPL-3.0-only", ("gpl3-text",)),
    ("lgpl-2.1-text", "LGPL-2.1-only", ("lgpl21-text",)),
    ("lgpl-3-text", "LGPL-3.0-only", ("lgpl3-text",)),
    ("agpl-3-text", "AGPL-3.0-only", ("agpl3-text",)),
    ("apache-text", "Apache-2.0", ("apache-text",)),
    ("mpl-text", "MPL-2.0", ("mpl-text",)),
    ("mpl-header-v", "MPL-2.0", ("mpl-subject-v",)),
    ("epl-1-text", "EPL-1.0", ("epl1-text",)),
    ("epl-2-text", "EPL-2.0", ("epl2-text",)),
    ("cc0-text", "CC0-1.0", ("cc0-text",)),
    ("unlicense-text", "Unlicense", ("unlicense-text",)),
    ("zlib-full", "Zlib", ("zlib-warranty", "zlib-grant")),
    ("zlib-grant", "Zlib", ("zlib-grant",)),
    ("mit-without-liability", "MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("lgpl-2.1-grant", "LGPL-2.1-or-later", ("lgpl-grant", "lgpl21-version")),
    ("lgpl-3-grant", "LGPL-3.0-or-later", ("lgpl3-grant",)),
    ("lgpl-3-grant-split", "LGPL-3.0-or-later", ("lgpl-grant", "gpl3-version")),
    ("agpl-3-grant", "AGPL-3.0-or-later", ("agpl3-grant",)),
    ("gpl-3-grant", "GPL-3.0-or-later", ("gpl3-grant",)),
    ("gpl-3-grant-split", "GPL-3.0-or-later", ("gpl2-foundation", "gpl3-version")),
    ("gpl-2-grant", "GPL-2.0-or-later", ("gpl2-foundation", "gpl2-version")),
    ("gpl-3-only", "GPL-3.0-only", ("gpl3-only",)),
    ("gpl-2-only", "GPL-2.0-only", ("gpl2-only",)),
    *((f"notice-{name.lower()}", name, (f"notice-{name.lower()}",)) for name in NAMES),
)

# A sentence ends at closing punctuation before white space, or at an empty line.
SENTENCE_END = r"[.!?;:][\x20\x09-\x0D]+|\n[\x20\x09\x0D]*\n"
NOT_ALPHANUMERIC = "[^a-z0-9]+"
# Unknown sentences that may stand between two known ones of a rule.
MAX_GAP = 2


def normalised(sentence: Column) -> Column:
    """Lower-case letters and digits, everything else one space."""
    return F.btrim(F.regexp_replace(ascii_lower(sentence), NOT_ALPHANUMERIC, " "))


def _plain(sentence: str) -> str:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in sentence).lower()


def notice_sentences(names: dict[str, Sequence[str]]) -> dict[str, str]:
    """Identifier by normalised notice, for every subject, verb and article before every name."""
    return {
        " ".join(_plain(f"{subject}{verb}{article}{text}").split()): f"notice-{name.lower()}"
        for name, texts in names.items()
        for text in texts
        for subject in SUBJECTS
        for verb in VERBS
        for article in ((*ARTICLES, "a ") if text.startswith("Creative") else ARTICLES)
    }


def known_sentences(sentences: dict[str, str], names: dict[str, Sequence[str]] = NAMES) -> dict[str, str]:
    """Identifier by normalised sentence; a sentence of the table goes before a notice."""
    return notice_sentences(names) | {" ".join(_plain(text).split()): name for name, text in sentences.items()}


def pattern(parts: Sequence[str]) -> str:
    return "".join(f"<{p}>" for p in parts)


def scan_licenses(
    docs: DataFrame,
    sentences: dict[str, str] = SENTENCES,
    rules: Sequence[tuple[str, str, Sequence[str]]] = RULES,
    max_gap: int = MAX_GAP,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Licences recognised in each text.

    Returns ``id_col``, ``n_sentences`` (not empty after normalising),
    ``n_known`` (with an identifier), ``rules`` and ``licenses`` (comma-joined,
    in rule order, each once) and ``unmatched`` (identifiers that no rule
    consumed).  Known sentences form a run while at most ``max_gap`` unknown
    ones stand between them; a rule matches when its identifiers follow each
    other in a run.  The sentence table is fixed and small, so the look-up is a
    literal map and the scan needs no shuffle.

    A null or empty text has no sentences and no licences.  Repeated rows give
    repeated results, an empty table an empty one, null ids stay.  Other columns
    are not read.
    """
    table = known_sentences(sentences)
    # one literal; a map is searched from its start, so the set of its keys is asked first
    known = F.str_to_map(F.lit(",".join(f"{text}:{name}" for text, name in table.items())), F.lit(","), F.lit(":"))
    units = docs.select(
        F.col(id_col),
        F.filter(
            F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), SENTENCE_END), normalised),
            lambda s: s != "",
        ).alias("_units"),
    )
    named = units.select(
        id_col,
        F.size("_units").cast("long").alias("n_sentences"),
        F.filter(
            F.transform("_units", lambda s, i: F.struct(i.alias("at"), F.when(s.isin(list(table)), F.try_element_at(known, s)).alias("name"))),
            lambda x: x["name"].isNotNull(),
        ).alias("_known"),
    )
    # "<a><b>~<c>": a break where too many unknown sentences stand between
    run = F.array_join(
        F.transform(
            "_known",
            lambda x, i: F.concat(
                F.when((i > 0) & (x["at"] - F.get(F.col("_known"), i - 1)["at"] > max_gap + 1), F.lit("~")).otherwise(F.lit("")),
                F.lit("<"),
                x["name"],
                F.lit(">"),
            ),
        ),
        "",
    )
    scanned = named.select(id_col, "n_sentences", F.size("_known").cast("long").alias("n_known"), run.alias("_run"))
    # one step a rule: what is left of the run, the rules that hit and their licences so far
    table_of_rules = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(i).alias("id"), F.lit(pattern(p)).alias("parts")) for n, i, p in rules))
    none = F.array().cast("array<string>")

    def step(so_far: Column, rule: Column) -> Column:
        hit = F.contains(so_far["left"], rule["parts"])
        after = F.struct(
            F.replace(so_far["left"], rule["parts"], F.lit("~")).alias("left"),
            F.array_append(so_far["names"], rule["name"]).alias("names"),
            F.array_append(so_far["ids"], rule["id"]).alias("ids"),
        )
        return F.when(hit, after).otherwise(so_far)

    start = F.struct(F.col("_run").alias("left"), none.alias("names"), none.alias("ids"))
    tried = F.when(F.col("_run") == "", start).otherwise(F.aggregate(table_of_rules, start, step))
    return scanned.select(id_col, "n_sentences", "n_known", tried.alias("_tried")).select(
        id_col,
        "n_sentences",
        "n_known",
        F.array_join("_tried.names", ",").alias("rules"),
        F.array_join(F.array_distinct("_tried.ids"), ",").alias("licenses"),
        F.replace("_tried.left", F.lit("~"), F.lit("")).alias("unmatched"),
    )


def license_sql() -> str:
    """The scan as SQL, generated from the same tables."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in known_sentences(SENTENCES).items())
    left, names, licences = "run", [], []
    for name, license_id, parts in RULES:
        hit = f"contains({left}, {quote(pattern(parts))})"
        names.append(f"CASE WHEN {hit} THEN {quote(name)} END")
        licences.append((license_id, hit))
        left = f"replace({left}, {quote(pattern(parts))}, '~')"
    # a licence stands where its first rule that hit stands
    order = ", ".join(f"CASE WHEN {hit} THEN {quote(lic)} END" for lic, hit in licences)
    return f"""
WITH known(sentence, name) AS (VALUES {known}),
pieces AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '{SENTENCE_END}')) AS piece,
    generate_subscripts(regexp_split_to_array(coalesce(text, ''), '{SENTENCE_END}'), 1) AS pos FROM documents),
units AS (SELECT doc_id, pos, trim(regexp_replace(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) AS sentence FROM pieces),
numbered AS (SELECT doc_id, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM units WHERE sentence <> ''),
named AS (SELECT n.doc_id, n.place, k.name, n.place - lag(n.place) OVER (PARTITION BY n.doc_id ORDER BY n.place) AS step
    FROM numbered n JOIN known k USING (sentence)),
runs AS (SELECT doc_id, count(*) AS n_known,
    string_agg((CASE WHEN step > {MAX_GAP + 1} THEN '~' ELSE '' END) || '<' || name || '>', '' ORDER BY place) AS run FROM named GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n_sentences FROM numbered GROUP BY doc_id),
docs AS (SELECT d.doc_id, coalesce(c.n_sentences, 0) AS n_sentences, coalesce(r.n_known, 0) AS n_known, coalesce(r.run, '') AS run
    FROM documents d LEFT JOIN counts c USING (doc_id) LEFT JOIN runs r USING (doc_id)),
hits AS (SELECT doc_id, n_sentences, n_known, [{', '.join(names)}] AS names, [{order}] AS lics, replace({left}, '~', '') AS unmatched FROM docs)
SELECT doc_id, n_sentences, n_known,
    array_to_string(list_filter(names, lambda x: x IS NOT NULL), ',') AS rules,
    array_to_string(list_filter(lics, lambda x, i: x IS NOT NULL AND list_position(lics, x) = i), ',') AS licenses,
    unmatched
FROM hits"""
