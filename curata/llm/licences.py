"""Licence scans by sentence rules (DataFrame functions only, no shuffle).

A text is cut into sentences at full stops and the like and at blank lines; single line ends inside a sentence are wraps. Each sentence is normalised (lower
case, runs of other than letters, digits, dots, commas and hyphens to one space, none before a comma or dot) and looked up among the known sentences of the licences' published texts.
Where a sentence is not known as it stands, it is tried from each of its lines on, and each line alone, so that a heading above without a full stop does not hide it. Lines are normalised once; since each holds a
character at least, only the last lines of a piece, as many as the longest known sentence has characters, can begin one that ends with the piece, so the cost is linear in the lines. The identifiers found, in text order, are matched against ordered rules. A
rule is a sequence of identifiers that must occur in this order, other sentences between them allowed; of the rules of one family the first that fits decides.
The known sentences and rules are a small fixed table held in the plan, not data that grows.

Defined results: null and empty texts have no licence; a sentence that occurs again counts again in `sentence_ids`, once in
`licences`; texts of any length are read whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm.common import let, table, text_of

#: Identifiers and sentences of the published licence texts and notices.
PUBLISHED = (
    ("apache-2.0/notice", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0/notice", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("apache-2.0/compliance", "you may not use this file except in compliance with the License"),
    ("apache-2.0/copy", "You may obtain a copy of the License at"),
    ("apache-2.0/as-is", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("apache-2.0/limits", "See the License for the specific language governing permissions and limitations under the License"),
    ("mit/notice", "Released under the MIT License"),
    ("mit/notice", "Licensed under the MIT License"),
    ("mit/grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit/copies", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit/warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("mit/liability", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("bsd/grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd/source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd/binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd/names", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd/warranty", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"),
    ("gpl/free", "This program is free software"),
    ("lgpl/free", "This library is free software"),
    ("gpl/terms", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl/terms-version-2", "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("lgpl/terms", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl/terms", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("gpl/terms-comma-3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl/terms-comma-3", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("agpl/terms-comma-3", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gnu/version-2", "either version 2 of the License, or (at your option) any later version"),
    ("gnu/version-2.1", "either version 2.1 of the License, or (at your option) any later version"),
    ("gnu/version-3", "either version 3 of the License, or (at your option) any later version"),
    ("gpl-3.0/notice", "This work is licensed under the GNU General Public License, version 3"),
    ("mpl-2.0/notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v"),
    ("mpl-2.0/copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("mpl-2.0/copy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("isc/grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc/warranty", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"),
    ("unlicense/grant", "This is free and unencumbered software released into the public domain"),
    ("zlib/warranty", "This software is provided 'as-is', without any express or implied warranty"),
    ("zlib/grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("bsl-1.0/notice", "Distributed under the Boost Software License, Version 1.0"),
    ("cc-by-4.0/notice", "Licensed under CC BY 4.0"),
    ("cc-by-4.0/notice", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-4.0/notice", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0/notice", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa-4.0/notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0/notice", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0/notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("apache-2.0/conditions", "You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions"),
    ("apache-2.0/patent", "If You institute patent litigation against any entity (including a cross-claim or counterclaim in a lawsuit) alleging that the Work or a Contribution incorporated within the Work constitutes direct or contributory patent infringement, then any patent licenses granted to You under this License for that Work shall terminate as of the date such litigation is filed"),
    ("gpl-2.0/preamble", "The licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-2.0/scope", "Activities other than copying, distribution and modification are not covered by this License"),
    ("gpl-3.0/preamble", "The GNU General Public License is a free, copyleft license for software and other kinds of works"),
    ("gpl-3.0/practical", "The licenses for most software and other practical works are designed to take away your freedom to share and change the works"),
    ("agpl-3.0/preamble", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software"),
    ("lgpl-3.0/preamble", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below"),
    ("lgpl-2.0/terms", "you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation"),
    ("gnu/version-1", "either version 1, or (at your option) any later version"),
    ("mpl-1.1/notice", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\")"),
    ("epl-2.0/notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("epl-2.0/text", "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\")"),
    ("cc0-1.0/notice", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("artistic-2.0/text", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    ("artistic-2.0/preamble", "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed"),
    ("rights/reserved", "All rights reserved"),
)
#: Ordered rules (name, family, licence, identifiers in order).
RULES = (
    ("apache-2.0-full", "apache", "Apache-2.0", ("apache-2.0/notice", "apache-2.0/compliance")),
    ("apache-2.0-notice", "apache", "Apache-2.0", ("apache-2.0/notice",)),
    ("apache-2.0-text", "apache", "Apache-2.0", ("apache-2.0/patent", "apache-2.0/conditions")),
    ("mit-full", "mit", "MIT", ("mit/grant", "mit/warranty")),
    ("mit-notice", "mit", "MIT", ("mit/notice",)),
    ("bsd-3-clause", "bsd", "BSD-3-Clause", ("bsd/grant", "bsd/names")),
    ("bsd-2-clause", "bsd", "BSD-2-Clause", ("bsd/grant", "bsd/binary")),
    ("gpl-3.0-full", "gpl", "GPL-3.0", ("gpl/free", "gpl-3.0/notice")),
    ("gpl-3.0-notice", "gpl", "GPL-3.0", ("gpl-3.0/notice",)),
    ("gpl-3.0-or-later", "gpl", "GPL-3.0-or-later", ("gpl/terms", "gnu/version-3")),
    ("gpl-3.0-or-later-comma", "gpl", "GPL-3.0-or-later", ("gpl/terms-comma-3",)),
    ("gpl-2.0-or-later", "gpl", "GPL-2.0-or-later", ("gpl/terms", "gnu/version-2")),
    ("gpl-2.0-only", "gpl", "GPL-2.0-only", ("gpl/terms-version-2",)),
    ("gpl-1.0-or-later", "gpl", "GPL-1.0-or-later", ("gpl/terms", "gnu/version-1")),
    ("gpl-3.0-text", "gpl", "GPL-3.0", ("gpl-3.0/preamble", "gpl-3.0/practical")),
    ("gpl-2.0-text", "gpl", "GPL-2.0", ("gpl-2.0/preamble", "gpl-2.0/scope")),
    ("lgpl-3.0-text", "lgpl", "LGPL-3.0", ("lgpl-3.0/preamble",)),
    ("agpl-3.0-text", "agpl", "AGPL-3.0", ("agpl-3.0/preamble",)),
    ("lgpl-2.0-or-later", "lgpl", "LGPL-2.0-or-later", ("lgpl-2.0/terms", "gnu/version-2")),
    ("lgpl-2.1-or-later", "lgpl", "LGPL-2.1-or-later", ("lgpl/terms", "gnu/version-2.1")),
    ("lgpl-3.0-or-later", "lgpl", "LGPL-3.0-or-later", ("lgpl/terms", "gnu/version-3")),
    ("lgpl-3.0-or-later-comma", "lgpl", "LGPL-3.0-or-later", ("lgpl/terms-comma-3",)),
    ("agpl-3.0-or-later", "agpl", "AGPL-3.0-or-later", ("agpl/terms", "gnu/version-3")),
    ("agpl-3.0-or-later-comma", "agpl", "AGPL-3.0-or-later", ("agpl/terms-comma-3",)),
    ("mpl-2.0", "mpl", "MPL-2.0", ("mpl-2.0/notice", "mpl-2.0/copy")),
    ("mpl-1.1", "mpl", "MPL-1.1", ("mpl-1.1/notice",)),
    ("epl-2.0", "epl", "EPL-2.0", ("epl-2.0/notice",)),
    ("epl-2.0-text", "epl", "EPL-2.0", ("epl-2.0/text",)),
    ("cc0-1.0", "cc0", "CC0-1.0", ("cc0-1.0/notice",)),
    ("artistic-2.0", "artistic", "Artistic-2.0", ("artistic-2.0/text", "artistic-2.0/preamble")),
    ("isc", "isc", "ISC", ("isc/grant", "isc/warranty")),
    ("unlicense", "unlicense", "Unlicense", ("unlicense/grant",)),
    ("zlib", "zlib", "Zlib", ("zlib/warranty", "zlib/grant")),
    ("bsl-1.0", "bsl", "BSL-1.0", ("bsl-1.0/notice",)),
    ("cc-by-nc-4.0", "cc-by-nc", "CC-BY-NC-4.0", ("cc-by-nc-4.0/notice",)),
    ("cc-by-sa-4.0", "cc-by-sa", "CC-BY-SA-4.0", ("cc-by-sa-4.0/notice",)),
    ("cc-by-4.0", "cc-by", "CC-BY-4.0", ("cc-by-4.0/notice",)),
    ("proprietary", "proprietary", "All-Rights-Reserved", ("rights/reserved",)),
)
#: A sentence ends at . ! ? ; : before white space or the end, and at a blank line.
SENTENCE_END = r"[.!?;:]+(?=\s|$)|\r?\n[ \t]*\r?\n"
NOISE, BEFORE_MARK = r"[^\p{L}\p{N}.,-]+", r" ([.,])"
#: The known sentences as `normalise` leaves them.
SENTENCES = {re.sub(BEFORE_MARK, r"\1", re.sub(r"[^a-z0-9.,-]+", " ", text.lower())).strip(" "): name for name, text in PUBLISHED}


def normalise(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(sentence), NOISE, " "), BEFORE_MARK, "$1"))


def _starts(sentences: dict) -> str:
    """A pattern for lines that begin with the first word of some known sentence."""
    return r"(?i)^\P{L}*(?:" + "|".join(sorted({s.split(" ")[0] for s in sentences})) + r")\b"


def _fits(ids: Column, rule: tuple) -> Column:
    """Whether the rule's identifiers occur in ids in order: a fold that counts how many have been met."""
    wanted = F.array(*[F.lit(x) for x in rule])
    step = lambda n, x: F.when((n < len(rule)) & (x == F.get(wanted, n)), n + 1).otherwise(n)
    return F.aggregate(ids, F.lit(0), step) == len(rule)


def scan(docs: DataFrame, sentences: dict = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """Per row: doc_id, n_sentences (known ones), sentence_ids (in text order), licences (sorted), rule (the first that fits)."""
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    look = lambda x: F.element_at(known, x)
    longest = max(map(len, sentences), default=0)

    def in_piece(lines: Column) -> Column:
        """lines: the normalised lines of a piece, none empty. Only lines that begin as some known sentence does are looked up: with the rest of their piece, then alone."""
        rest = lambda i: F.slice(lines, i + 1, F.size(lines))
        length = lambda i: F.aggregate(rest(i), F.lit(0), lambda n, x: n + F.length(x) + 1)
        whole = lambda i: F.when(F.size(lines) - i <= longest, F.when(length(i) <= 2 * longest + 1, look(F.regexp_replace(F.array_join(rest(i), " "), BEFORE_MARK, "$1"))))
        return F.transform(lines, lambda line, i: F.when(F.rlike(line, F.lit(_starts(sentences))), F.coalesce(whole(i), look(line))))

    parts = F.filter(F.split(text_of(), SENTENCE_END), lambda s: F.rlike(s, F.lit(r"(?m)" + _starts(sentences))))
    lines_of = lambda s: F.filter(F.transform(F.split(s, r"\r?\n"), normalise), lambda x: x != "")
    ids = F.filter(F.flatten(F.transform(parts, lambda s: let(lines_of(s), in_piece))), lambda x: x.isNotNull())
    found = docs.select(F.col("doc_id"), ids.alias("sentence_ids"))
    fits, seen = [], {}
    for i, (name, family, licence, wanted) in enumerate(rules):
        fit = _fits(F.col("sentence_ids"), wanted)
        earlier = seen.setdefault(family, [])
        alone = fit
        for other in earlier:
            alone = alone & ~other
        earlier.append(fit)
        fits.append(F.when(alone, F.struct(F.lit(i).alias("i"), F.lit(name).alias("rule"), F.lit(licence).alias("licence"))))
    found = found.withColumn("hits", F.when(F.size("sentence_ids") > 0, F.filter(F.array(*fits), lambda x: x.isNotNull())))
    hits = F.coalesce(F.col("hits"), F.array().cast("array<struct<i:int,rule:string,licence:string>>"))
    return found.select("doc_id", F.size("sentence_ids").alias("n_sentences"), "sentence_ids", F.array_sort(F.array_distinct(F.transform(hits, lambda x: x["licence"]))).alias("licences"), F.try_element_at(hits, F.lit(1))["rule"].alias("rule"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_sentences", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"), "rule")


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({q(s)}, {q(i)})" for s, i in SENTENCES.items())

    def one(ids: tuple, of: str = "ids") -> str:
        if len(ids) == 1:
            return f"list_contains({of}, {q(ids[0])})"
        return f"(list_position({of}, {q(ids[0])}) IS NOT NULL AND {one(ids[1:], f'({of})[list_position({of}, {q(ids[0])}) + 1:]')})"

    hits = []
    for i, (name, family, licence, wanted) in enumerate(RULES):
        before = "".join(f" AND NOT {one(w)}" for _, f, _, w in RULES[:i] if f == family)
        hits.append((f"({one(wanted)}{before})", licence, name))
    licences = ", ".join(f"CASE WHEN {hit} THEN {q(licence)} END" for hit, licence, _ in hits)
    rule = " ".join(f"WHEN {hit} THEN {q(name)}" for hit, _, name in hits)
    norm = lambda x: rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}.,-]+', ' ', 'g'), ' ([.,])', '\1', 'g'))"
    return rf"""
WITH known(s, id) AS (VALUES {known}),
parts AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '[.!?;:]+(\s|$)', chr(10) || chr(10), 'g'), '\r?\n[ \t]*\r?\n') AS p FROM documents)),
lines AS (SELECT doc_id, i, l, unnest(l) AS line, generate_subscripts(l, 1) AS j FROM (SELECT doc_id, i, string_split_regex(s, '\r?\n') AS l FROM parts WHERE regexp_matches(s, '(?m){_starts(SENTENCES)}'))),
begun AS (SELECT doc_id, i, j, {norm("array_to_string(l[j:], ' ')")} AS whole, {norm("line")} AS line FROM lines WHERE regexp_matches(line, '{_starts(SENTENCES)}')),
hit AS (SELECT doc_id, i, j, coalesce(a.id, b.id) AS id FROM begun LEFT JOIN known a ON a.s = whole LEFT JOIN known b ON b.s = line WHERE coalesce(a.id, b.id) IS NOT NULL),
doc AS (SELECT d.doc_id, coalesce(ids, []) AS ids FROM documents d LEFT JOIN (SELECT doc_id, list(id ORDER BY i, j) AS ids FROM hit GROUP BY doc_id) USING (doc_id))
SELECT doc_id, len(ids)::INT AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
  coalesce(array_to_string(list_sort(list_distinct([{licences}])), ','), '') AS licences, CASE {rule} END AS rule
FROM doc
"""


SQL = _sql()
