"""License scans: known sentences become identifiers, identifier sequences
match ordered rules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: SPDX name -> the names that a sentence may give it; see :func:`_named`.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "MIT licence", "Expat License"),
    "MIT-0": ("MIT No Attribution License",),
    "Apache-1.1": ("Apache Software License, Version 1.1", "Apache License 1.1"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License", "Apache Software License, Version 2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2 License", "GPLv2 License"),
    "GPL-2.0-or-later": ("GNU General Public License, version 2 or later", "GNU General Public License version 2, or (at your option) any later version"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3 License", "GPLv3 License"),
    "GPL-3.0-or-later": ("GNU General Public License, version 3 or later", "GNU General Public License version 3, or (at your option) any later version"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1 License"),
    "LGPL-2.1-or-later": ("GNU Lesser General Public License, version 2.1 or later",),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3 License"),
    "LGPL-3.0-or-later": ("GNU Lesser General Public License, version 3 or later",),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3 License"),
    "AGPL-3.0-or-later": ("GNU Affero General Public License, version 3 or later",),
    "GFDL-1.3": ("GNU Free Documentation License, Version 1.3", "GNU Free Documentation License v1.3"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "FreeBSD License", "2-clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License", "Revised BSD License", "3-clause BSD License"),
    "BSD-4-Clause": ("BSD 4-Clause License", "Original BSD License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD License"),
    "ISC": ("ISC License",),
    "MPL-1.1": ("Mozilla Public License, Version 1.1", "Mozilla Public License 1.1"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"),
    "EPL-1.0": ("Eclipse Public License, Version 1.0", "Eclipse Public License 1.0"),
    "EPL-2.0": ("Eclipse Public License, Version 2.0", "Eclipse Public License 2.0"),
    "EUPL-1.2": ("European Union Public Licence 1.2", "European Union Public License 1.2", "European Union Public Licence, Version 1.2"),
    "CDDL-1.0": ("Common Development and Distribution License 1.0", "Common Development and Distribution License, Version 1.0"),
    "CPL-1.0": ("Common Public License 1.0", "Common Public License, Version 1.0"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "BUSL-1.1": ("Business Source License 1.1", "Business Source License, Version 1.1"),
    "SSPL-1.0": ("Server Side Public License, Version 1", "Server Side Public License v1"),
    "Elastic-2.0": ("Elastic License 2.0", "Elastic License, Version 2.0"),
    "Zlib": ("zlib License", "zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "WTFPL": ("Do What The F*ck You Want To Public License", "WTFPL License"),
    "Artistic-1.0": ("Artistic License 1.0", "Artistic License, Version 1.0"),
    "Artistic-2.0": ("Artistic License 2.0", "Artistic License, Version 2.0"),
    "PSF-2.0": ("Python Software Foundation License Version 2", "Python Software Foundation License"),
    "Ruby": ("Ruby License",),
    "PHP-3.01": ("PHP License, version 3.01", "PHP License 3.01"),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"),
    "NCSA": ("University of Illinois/NCSA Open Source License",),
    "OpenSSL": ("OpenSSL License",),
    "PostgreSQL": ("PostgreSQL License",),
    "X11": ("X11 License",),
    "MS-PL": ("Microsoft Public License", "Microsoft Public License (MS-PL)"),
    "MS-RL": ("Microsoft Reciprocal License", "Microsoft Reciprocal License (MS-RL)"),
    "UPL-1.0": ("Universal Permissive License, Version 1.0", "Universal Permissive License v1.0"),
    "AFL-3.0": ("Academic Free License version 3.0", "Academic Free License 3.0"),
    "OSL-3.0": ("Open Software License version 3.0", "Open Software License 3.0"),
    "ECL-2.0": ("Educational Community License, Version 2.0",),
    "LPPL-1.3c": ("LaTeX Project Public License, version 1.3c", "LaTeX Project Public License 1.3c"),
    "CECILL-2.1": ("CeCILL Free Software License Agreement v2.1", "CeCILL License 2.1"),
    "MulanPSL-2.0": ("Mulan Permissive Software License, Version 2", "Mulan PSL v2 License"),
    "ODbL-1.0": ("Open Database License", "Open Data Commons Open Database License v1.0"),
    "ODC-By-1.0": ("Open Data Commons Attribution License v1.0", "Open Data Commons Attribution License"),
    "PDDL-1.0": ("Open Data Commons Public Domain Dedication and License", "Public Domain Dedication and License"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"),
    "CC-BY-3.0": ("CC BY 3.0", "Creative Commons Attribution 3.0 Unported License"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-3.0": ("CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
}
#: A sentence is a name with one of these before it and behind it.
VERBS = ("licensed", "released", "distributed", "available", "this project is licensed", "this work is licensed", "this software is licensed", "this file is licensed", "this package is licensed", "this program is licensed", "this library is licensed", "this code is licensed", "this project is released", "this software is released")
BEFORE = ("", "the ", *(f"{v} under {x}" for v in VERBS for x in ("", "the ", "the terms of the ")), "this work is dedicated to the public domain under ")
BEHIND = ("", " the license")
#: The same as expressions, over words with one space between them.
_BEFORE, _BEHIND = f"(?:this work is dedicated to the public domain under |(?:{'|'.join(VERBS)}) under (?:the (?:terms of the )?)?|the )", " the license"


def _ident(spdx: str) -> str:
    return re.sub("[^A-Z0-9]+", "_", spdx.upper()) + "_NAME"


def _lines(spdx: str) -> tuple[str, ...]:
    """A licence's identifier lines."""
    only = "GPL" in spdx and not spdx.endswith("later")
    return tuple(f"SPDX-License-Identifier: {x}" for x in (spdx, f"{spdx}-only"))[: 1 + only]


_FREE = "{} is free software{} you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation"
#: identifier -> sentences (normalised by :func:`normal`) that mean it.
SENTENCES: dict[str, tuple[str, ...]] = {
    "MIT_GRANT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "MIT0_GRANT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    "MIT_NOTICE": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",),
    "AS_IS": ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",),
    "APACHE2_COMPLY": ("you may not use this file except in compliance with the License",),
    "APACHE2_COPY": ("You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    "APACHE2_LIMITS": ("See the License for the specific language governing permissions and limitations under the License",),
    "GPL3_FREE": tuple(f"{_FREE.format(x, ':', 'GNU General Public License')}, either version 3 of the License, or (at your option) any later version" for x in ("This program", "This file", "This software")),
    "LGPL3_FREE": tuple(f"{_FREE.format(x, ':', 'GNU Lesser General Public License')}, either version 3 of the License, or (at your option) any later version" for x in ("This library", "This program", "This software")),
    "AGPL3_FREE": tuple(f"{_FREE.format(x, ':', 'GNU Affero General Public License')}, either version 3 of the License, or (at your option) any later version" for x in ("This program", "This software")),
    "GPL_TERMS": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",),
    "GPL2_TERMS": ("you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",),
    "LGPL_TERMS": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "VERSION_2_LATER": ("either version 2 of the License, or (at your option) any later version",),
    "VERSION_21_LATER": ("either version 2.1 of the License, or (at your option) any later version",),
    "VERSION_3_LATER": ("either version 3 of the License, or (at your option) any later version",),
    "GPL_HOPE": tuple(f"{x} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY" for x in ("This program", "This library", "This software", "This file")),
    "GPL_COPY": tuple(f"You should have received a copy of the GNU {k}General Public License along with this {x}" for k in ("", "Lesser ", "Affero ") for x in ("program", "library", "software", "file")),
    "BSD_GRANT": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "BSD_SOURCE": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "BSD_BINARY": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",),
    "BSD_ADVERTISE": ("All advertising materials mentioning features or use of this software must display the following acknowledgement:",),
    "BSD_ENDORSE": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "Neither the name of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    "MPL2": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "EPL2": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0"),
    "BOOST_USE": ("Distributed under the Boost Software License, Version 1.0", "Use, modification and distribution are subject to the Boost Software License, Version 1.0"),
    "ISC_GRANT": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    "ZERO_GRANT": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "ISC_AS_IS": ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",),
    "ZLIB_AS_IS": ("This software is provided 'as-is', without any express or implied warranty",),
    "ZLIB_GRANT": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",),
    "UNLICENSE": ("This is free and unencumbered software released into the public domain",),
    "RESERVED": ("All rights reserved",),
} | {_ident(x): (*names, *_lines(x)) for x, names in NAMES.items()}

#: (rule, licence, identifiers that must occur in this order, gaps allowed), the first to try first.
RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("mit_text", "MIT", ("MIT_GRANT", "MIT_NOTICE", "AS_IS")),
    ("mit0_text", "MIT-0", ("MIT0_GRANT", "AS_IS")),
    ("apache2_header", "Apache-2.0", ("APACHE_2_0_NAME", "APACHE2_COMPLY", "APACHE2_COPY", "APACHE2_LIMITS")),
    ("agpl3_header", "AGPL-3.0-or-later", ("AGPL3_FREE", "GPL_HOPE", "GPL_COPY")),
    ("lgpl3_header", "LGPL-3.0-or-later", ("LGPL3_FREE", "GPL_HOPE", "GPL_COPY")),
    ("lgpl21_header", "LGPL-2.1-or-later", ("LGPL_TERMS", "VERSION_21_LATER", "GPL_HOPE", "GPL_COPY")),
    ("gpl3_header", "GPL-3.0-or-later", ("GPL3_FREE", "GPL_HOPE", "GPL_COPY")),
    ("gpl3_header_old", "GPL-3.0-or-later", ("GPL_TERMS", "VERSION_3_LATER", "GPL_HOPE", "GPL_COPY")),
    ("gpl2_header", "GPL-2.0-or-later", ("GPL_TERMS", "VERSION_2_LATER", "GPL_HOPE", "GPL_COPY")),
    ("gpl2_only_header", "GPL-2.0-only", ("GPL2_TERMS", "GPL_HOPE")),
    ("bsd4_text", "BSD-4-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_ADVERTISE")),
    ("bsd3_text", "BSD-3-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_ENDORSE")),
    ("bsd2_text", "BSD-2-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY")),
    ("isc_text", "ISC", ("ISC_GRANT", "ISC_AS_IS")),
    ("zero_text", "0BSD", ("ZERO_GRANT", "ISC_AS_IS")),
    ("zlib_text", "Zlib", ("ZLIB_AS_IS", "ZLIB_GRANT")),
    ("agpl3_terms", "AGPL-3.0-or-later", ("AGPL3_FREE",)),
    ("lgpl3_terms", "LGPL-3.0-or-later", ("LGPL3_FREE",)),
    ("lgpl21_terms", "LGPL-2.1-or-later", ("LGPL_TERMS", "VERSION_21_LATER")),
    ("gpl3_terms", "GPL-3.0-or-later", ("GPL3_FREE",)),
    ("gpl2_terms", "GPL-2.0-or-later", ("GPL_TERMS", "VERSION_2_LATER")),
    ("mit_grant", "MIT", ("MIT_GRANT",)),
    ("mpl2_header", "MPL-2.0", ("MPL2",)),
    ("epl2_header", "EPL-2.0", ("EPL2",)),
    ("boost_header", "BSL-1.0", ("BOOST_USE",)),
    ("unlicense_text", "Unlicense", ("UNLICENSE",)),
    *((_ident(x).lower(), x, (_ident(x),)) for x in NAMES),
    ("reserved", "LicenseRef-proprietary", ("RESERVED",)),
)

#: Ends of sentences: a line end, or a stop, semicolon, ! or ? before white
#: space. A comma after "License")" in the Apache header ends a clause as well.
BREAK = r"[.;!?]+[ \t\r]+|[.;!?]*[ \t\r]*\n[ \t\r\n]*|\"License\"\);?[ \t\r]+"
#: In lower-cased text: where a sentence must end, a stop (but that of "v. 2.0") or a line
#: without letters and digits; and where it may end as well as go on, the other
#: places of BREAK, "v. " and a colon. They become H and S.
HARD = r"(?<![^a-z0-9]v)[.;!?][ \t\r\n]|\n[^a-z0-9\n]*\n"
QUOTED, SOFT = r"\"license\"\);?[ \t\r]", r"(?<=[^a-z0-9]v)\.[ \t\r]|:[ \t\r]|\n"
#: Every known sentence holds one of these, in lower case (checked on import),
#: so a text without any of them can't match and is not split.
ANCHORS = ("licen", "permission is hereby", "notice", "warrant", "redistribut", "gnu general", "copyright holder", "cc0", "cc by", "creative commons", "permission to use", "rights reserved", "general public", "unencumbered", "advertising materials")


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip(" ")


#: What a sentence may be in full, and, for names, without what is before and behind.
PLAIN: dict[str, str] = {normal(s): k for k, many in SENTENCES.items() for s in many}
_NAME = {normal(n) for many in NAMES.values() for n in many}
#: All known sentences, spelt out.
KNOWN: dict[str, str] = {f"{a}{n}{z}": PLAIN[n] for n in _NAME for a in BEFORE for z in BEHIND} | PLAIN
_LOOSE = [s for many in SENTENCES.values() for s in many if not any(a in s.lower() for a in ANCHORS)]
_TWICE = [s for k, many in SENTENCES.items() for s in many if PLAIN[normal(s)] != k]
if _LOOSE or _TWICE:
    raise ValueError(f"sentences without an anchor: {_LOOSE}; with two identifiers: {_TWICE}")



def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row and rule that matches it: ``doc_id``, ``rule``,
    ``license``, ``n_sentences`` of the rule, and the text's ``identifiers`` in
    order, joined by spaces. Rules are tried in their order, and one that matches takes its identifiers
    away (all texts of its own, one after the other), so that later rules see only what is left:
    a full MIT text is no grant besides, but a name of another licence beside it still shows.

    Texts are lower-cased and reduced to words and (possible) ends of sentences;
    known sentences, which may be wrapped or commented out line by line, are found by one expression
    and looked up in a constant map; the identifiers in order form one short string, and each rule is one
    regular expression over what the rules before have left of it. Where an end of a sentence
    may be none, the longest known sentence wins.
    Null and empty texts match nothing; null ids and repeated rows give a row
    each; an empty table gives an empty one; other columns are ignored. All is
    one projection: nothing is shuffled, and texts without any anchor word
    (a lossless test) aren't split.
    """
    known = F.create_map(*(F.lit(x) for kv in PLAIN.items() for x in kv))
    t = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("x"))
    t = t.filter(F.col("x").rlike("(?i)" + "|".join(a.replace(" ", "[^a-z0-9]+") for a in ANCHORS)))
    marked = F.lower("x")
    for place, mark in ((HARD, "H"), (QUOTED, "SlicenseS"), (SOFT, "S"), ("[^a-z0-9HS]+", " ")):
        marked = F.regexp_replace(marked, place, mark)
    hits = F.regexp_extract_all(F.concat(F.lit("H"), marked, F.lit("H")), F.lit(_any_known()), F.lit(0))
    bare = lambda s: F.regexp_replace(F.regexp_replace(s, "^" + _BEFORE, ""), _BEHIND + "$", "")
    words = F.transform(hits, lambda s: F.regexp_replace(s, "[ S]+", " "))
    found = F.transform(words, lambda s: F.coalesce(F.try_element_at(known, s), F.try_element_at(known, bare(s))))
    t = t.select("doc_id", F.array_join(found, " ").alias("identifiers")).filter(F.col("identifiers") != "")
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(lic).alias("license"), F.lit(len(ids)).alias("n_sentences"), F.lit(f" {ids[0]} ").alias("first"), F.lit(_pattern(ids)).alias("pattern"), F.lit(_rest(ids)).alias("rest")) for r, lic, ids in RULES))
    start = F.struct(F.concat(F.lit(" "), F.regexp_replace("identifiers", " ", "  "), F.lit(" ")).alias("left"), F.array().cast("array<struct<rule:string,license:string,n_sentences:int>>").alias("hits"))

    def apply(acc, r):
        hit = F.contains(acc["left"], r["first"]) & F.rlike(acc["left"], r["pattern"])
        taken = F.struct(F.regexp_replace(acc["left"], r["pattern"], r["rest"]).alias("left"), F.concat(acc["hits"], F.array(F.struct(r["rule"], r["license"], r["n_sentences"]))).alias("hits"))
        return F.when(hit, taken).otherwise(acc)

    return t.select("doc_id", "identifiers", F.explode(F.aggregate(rules, start, apply, lambda acc: acc["hits"])).alias("h")).select("doc_id", "h.rule", "h.license", "h.n_sentences", "identifiers")


def _any_known() -> str:
    """Any known sentence between two ends, the longest first."""

    def one_of(texts) -> str:
        by: dict[str, list[str]] = {}
        for k in sorted(texts, key=len, reverse=True):
            head, _, tail = k.partition(" ")
            by.setdefault(head, []).append(f" {tail}" if tail else "")
        return "(?:" + "|".join(f"{h}(?:{'|'.join(x)})" for h, x in by.items()) + ")"

    known = f"(?:{one_of(set(PLAIN) - _NAME)}|{_BEFORE}?{one_of(_NAME)}(?:{_BEHIND})?)"
    return "(?<=[HS]|[HS] )" + known.replace(" ", "[ S]+") + "(?= ?[HS])"


def _pattern(ids: tuple[str, ...]) -> str:
    """Identifiers are each between two spaces; any number may stand between."""
    return "((?: [A-Z0-9_]+ )*?)".join(f" {i} " for i in ids)


def _rest(ids: tuple[str, ...], sign: str = "$") -> str:
    """What a match leaves: the identifiers between its own."""
    return "".join(f"{sign}{k}" for k in range(1, len(ids)))


def oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({q(k)}, {q(v)})" for k, v in KNOWN.items())
    rules = ", ".join(f"({k}, {q(r)}, {q(lic)}, {len(ids)}, {q(_pattern(ids))}, {q(_rest(ids, chr(92)))})" for k, (r, lic, ids) in enumerate(RULES))
    return f"""
WITH RECURSIVE known(sentence, ident) AS (VALUES {known}), rules(k, rule, license, n_sentences, pattern, rest) AS (VALUES {rules}),
d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
s AS (SELECT rid, doc_id, unnest(regexp_split_to_array(text, {q(BREAK)})) AS sentence, generate_subscripts(regexp_split_to_array(text, {q(BREAK)}), 1) AS pos FROM d WHERE text IS NOT NULL),
i AS (SELECT rid, doc_id, string_agg(ident, ' ' ORDER BY pos) AS identifiers
      FROM s JOIN known ON known.sentence = trim(regexp_replace(lower(s.sentence), '[^a-z0-9]+', ' ', 'g')) GROUP BY rid, doc_id),
t AS (SELECT rid, doc_id, identifiers, -1 AS k, NULL::VARCHAR AS rule, NULL::VARCHAR AS license, 0 AS n_sentences, FALSE AS hit, ' ' || replace(identifiers, ' ', '  ') || ' ' AS remain FROM i
      UNION ALL SELECT t.rid, t.doc_id, t.identifiers, r.k, r.rule, r.license, r.n_sentences, regexp_matches(t.remain, r.pattern), regexp_replace(t.remain, r.pattern, r.rest, 'g') FROM t JOIN rules r ON r.k = t.k + 1)
SELECT doc_id, rule, license, n_sentences::INT AS n_sentences, identifiers FROM t WHERE hit"""
