"""License scans by sentence rules.

A text is normalised and cut at lines and at sentence ends, and the known license sentences are looked for among its
runs of whole pieces, the longest first, so that a sentence may be wrapped over many lines, with or without comment
leaders. A sentence may have variable parts (the holder's name, say). The identifiers found, in order, are matched
against license rules, which are sequences of identifiers that follow each other with nothing else recognised between. A
rule that is part of a longer rule found at the same place gives way to it. The library of sentences and rules is a fixed
one (or a parameter), not one that follows the corpus.

Defined results: null, empty and blank texts have no sentences; case, punctuation, quotes and runs of spaces make no
difference to a sentence, nor do line breaks, blank lines and comment leaders within it (signs, or the words dnl, rem and
C before a line); repeated sentences count each time; rows of an equal doc_id are scanned each on its own; other
columns are ignored; no rows in, no rows out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapane.llm.common import text_of

#: Sentences of public licenses and notices. Identifier, sentence; <x> stands for one word or more.
TEXTS = (
    ("mit-title", "The MIT License (MIT)"),
    ("mit-title", "The MIT License"),
    ("mit-title", "MIT License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit-condition", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit-warranty", "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."),
    ("mit-liability", "In no event shall <the authors or copyright holders> be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."),
    ("apache-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-copy", "You may obtain a copy of the License at"),
    ("apache-basis", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache-see", "See the License for the specific language governing permissions and limitations under the License."),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-advertising", "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by <the organization>."),
    ("bsd-name", "Neither the name of <the holder> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-name", "The name of <the author> may not be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-warranty", "This software is provided by <the copyright holders and contributors> \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed."),
    ("bsd-liability", "In no event shall <the copyright holder or contributors> be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc-grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0bsd-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("isc-warranty", "The software is provided \"as is\" and <the author> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness."),
    ("isc-liability", "In no event shall <the author> be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."),
    ("zlib-warranty", "This software is provided 'as-is', without any express or implied warranty."),
    ("zlib-liability", "In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("boost-grant", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("unlicense-domain", "This is free and unencumbered software released into the public domain."),
    ("unlicense-grant", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("mpl2-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at <the address>."),
    ("epl2-header", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at <the address>."),
    ("epl2-header", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at <the address>."),
    ("cc0-waiver", "To the extent possible under law, <the person> has waived all copyright and related or neighboring rights to <this work>."),
    ("perl-terms", "This is free software; you can redistribute it and/or modify it under the same terms as the Perl 5 programming language system itself."),
    ("gpl-warranty", "<This program> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl-see", "See the GNU General Public License for more details."),
    ("lgpl-see", "See the GNU Lesser General Public License for more details."),
    ("agpl-see", "See the GNU Affero General Public License for more details."),
    ("all-rights", "All rights reserved."),
)
#: Licenses and the names that notices give them.
NAMES = (
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License 2.0"),
    ("Apache-2.0", "Apache 2.0 License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSL-1.0", "Boost Software License, Version 1.0"),
    ("CC0-1.0", "Creative Commons Zero v1.0 Universal License"),
    ("EPL-2.0", "Eclipse Public License 2.0"),
    ("ISC", "ISC License"),
    ("MPL-2.0", "Mozilla Public License 2.0"),
    ("MPL-2.0", "Mozilla Public License, v. 2.0"),
    ("Unlicense", "Unlicense"),
    ("Zlib", "zlib License"),
    ("GPL-2.0-only", "GNU General Public License, version 2"),
    ("GPL-3.0-only", "GNU General Public License, version 3"),
    ("GPL-3.0-only", "GNU GPLv3"),
    ("LGPL-2.1-only", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0-only", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0-only", "GNU Affero General Public License, version 3"),
)
#: What notices say with a license's name; the kinds and versions of two families.
NOTICES = ("Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "This project is licensed under the {}.", "This software is licensed under the {}.", "This work is licensed under the {}.")
COMMONS = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
COMMONS_VERSIONS = ("3.0", "4.0")
GNU = (("GPL", "", "2", "2.0"), ("GPL", "", "3", "3.0"), ("LGPL", "Lesser ", "2.1", "2.1"), ("LGPL", "Lesser ", "3", "3.0"), ("AGPL", "Affero ", "3", "3.0"))
LONGEST_LEAD = 8  # words of a part that begins a sentence and goes on over a line's end; on one line it has any number


def _notices() -> list[tuple[str, str, str]]:
    """License, identifier, sentence of the notices that name a license."""
    out = [(spdx, f"notice-{spdx}", form.format(name)) for spdx, name in NAMES for form in NOTICES]
    for kind, words in COMMONS:
        for v in COMMONS_VERSIONS:
            spdx = f"CC-{kind}-{v}"
            place = "International" if v == "4.0" else "Unported"
            out += [(spdx, f"notice-{spdx}", x) for x in (f"Licensed under CC {kind} {v}.", f"This work is licensed under CC {kind} {v}.", f"This work is licensed under a Creative Commons {words} {v} {place} License.")]
    for family, kind, v, full in GNU:
        spdx = f"{family}-{full}"
        out.append((f"{spdx}-or-later", f"later-{spdx}", f"<This program> is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."))
        out.append((f"{spdx}-only", f"only-{spdx}", f"<This program> is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License version {v} as published by the Free Software Foundation."))
    for spdx in dict.fromkeys(x[0] for x in out):
        out.append((spdx, f"spdx-{spdx}", f"SPDX-License-Identifier: {spdx}"))
    return out


def _rules() -> list[tuple[str, tuple[str, ...]]]:
    """License, its sentences in order. The first that matches a stretch, longest first, names it."""
    mit, bsd_end, isc_end = ("mit-grant", "mit-condition"), ("bsd-warranty", "bsd-liability"), ("isc-warranty", "isc-liability")
    bsd2 = ("bsd-grant", "bsd-source", "bsd-binary")
    out = [("MIT", (*head, *mit, *end)) for head in ((), ("mit-title",)) for end in ((), ("mit-warranty",), ("mit-warranty", "mit-liability"))]
    for spdx, body in (("BSD-2-Clause", bsd2), ("BSD-3-Clause", (*bsd2, "bsd-name")), ("BSD-4-Clause", (*bsd2, "bsd-advertising", "bsd-name")), ("ISC", ("isc-grant",)), ("0BSD", ("0bsd-grant",))):
        for end in ((), bsd_end if spdx.startswith("BSD") else isc_end):
            out.append((spdx, (*body, *end)))
    out += [
        ("Apache-2.0", ("apache-header", "apache-copy", "apache-basis", "apache-see")),
        ("Apache-2.0", ("apache-header",)),
        ("Zlib", ("zlib-warranty", "zlib-liability", "zlib-grant")),
        ("BSL-1.0", ("boost-grant",)),
        ("Unlicense", ("unlicense-domain", "unlicense-grant")),
        ("Unlicense", ("unlicense-domain",)),
        ("MPL-2.0", ("mpl2-header", "mpl2-copy")),
        ("MPL-2.0", ("mpl2-header",)),
        ("EPL-2.0", ("epl2-header",)),
        ("CC0-1.0", ("cc0-waiver",)),
        ("Artistic-1.0-Perl OR GPL-1.0-or-later", ("perl-terms",)),
    ]
    see = {"GPL": "gpl-see", "LGPL": "lgpl-see", "AGPL": "agpl-see"}
    for family, _, _, full in GNU:
        for form, spdx in ((f"later-{family}-{full}", f"{family}-{full}-or-later"), (f"only-{family}-{full}", f"{family}-{full}-only")):
            out += [(spdx, (form, "gpl-warranty", see[family])), (spdx, (form,))]
    used = {x[1][0] for x in out if len(x[1]) == 1}
    return out + list(dict.fromkeys((spdx, (name,)) for spdx, name, _ in _notices() if name not in used))


SENTENCES = (*TEXTS, *((name, s) for _, name, s in _notices()))
RULES = tuple(_rules())
ENDS = r"(?<=[.!?:;])[ \t]+(?=[A-Z])"
#: Comment leaders that are words; others are signs, which normalising drops.
LEADERS = r"(^|[\r\n])[ \t]*(?:dnl|rem|REM|C)[ \t]+"


def _plain(sentence: str) -> str:
    """Normalised, with * for a variable part."""
    fixed = re.sub("<[^>]*>", " \0 ", sentence.lower())
    return " ".join("".join(c if c.isascii() and c.isalnum() else " * " if c == "\0" else " " for c in fixed).split())


def known_plain(library) -> dict[str, str]:
    """Normalised sentence to identifier; of equal ones the first holds."""
    known: dict[str, str] = {}
    for name, s in library:
        if (plain := _plain(s)).strip("* "):
            known.setdefault(plain, name)
    return known


def sentence_pattern(plain: str, gap: str = r" (?:\| )?") -> str:
    """A regex for the sentence's words; gap stands between them. The fixed words are the anchors: between two of them, or after the last, a variable part is any words over any lines, as few as do. What begins a sentence has no anchor before it; so it is any words of one piece, or LONGEST_LEAD at most over pieces, or it would take in all that stands before."""
    part = "[a-z0-9][a-z0-9 |]*?"
    lead = rf"(?:[a-z0-9]+(?:{gap}[a-z0-9]+){{0,{LONGEST_LEAD - 1}}}?|[a-z0-9][a-z0-9 ]*?)"
    return gap.join((part if i else lead) if w == "*" else w for i, w in enumerate(plain.split()))


def pieces(text: Column) -> Column:
    """The normalised pieces of a text, " | " before, between and after: lines without their comment words, cut again at sentence ends followed by a capital."""
    cut = F.regexp_replace(F.regexp_replace(text, LEADERS, "$1"), ENDS, "\n")
    plain = F.regexp_replace(F.regexp_replace(F.lower(cut), r"[^a-z0-9\r\n]+", " "), r" ?[\r\n][ \r\n]*", " | ")
    return F.concat(F.lit(" | "), F.trim(plain), F.lit(" | "))


def known_sentences(docs: DataFrame, library=SENTENCES) -> DataFrame:
    """doc_id, found: the identifiers of the text's known sentences, in order. A sentence is a run of whole pieces; where several begin, the longest holds."""
    known = known_plain(library)
    fixed = {p: n for p, n in known.items() if "*" not in p}
    loose = [(p, n) for p, n in known.items() if "*" in p]
    names = F.create_map(*(F.lit(x) for p in fixed.items() for x in p)) if fixed else None
    runs = "|".join(map(sentence_pattern, sorted(known, key=lambda p: (-len(p), p))))
    # no sentence is in a text without its longest word, so only texts with one of these are normalised
    words = "|".join(sorted({max(p.split(), key=len) for p in known}))
    hits = F.regexp_extract_all(pieces(text_of()), F.lit(rf"\| ({runs})(?= \|)"), F.lit(1))

    def name_of(hit: Column) -> Column:
        hit = F.replace(hit, F.lit("| "), F.lit(""))
        tests = [F.when(hit.rlike(f"^{sentence_pattern(p, ' ')}$"), F.lit(n)) for p, n in sorted(loose, key=lambda x: (-len(x[0]), x[0]))]
        return F.coalesce(*([F.element_at(names, hit)] if fixed else []), *tests)

    found = F.transform(hits, name_of)
    return docs.select("doc_id", F.when(F.lower(text_of()).rlike(words), found).otherwise(F.array().cast("array<string>")).alias("found"))


def scan_licenses(docs: DataFrame, library=SENTENCES, rules=RULES) -> DataFrame:
    """doc_id, n_sentences, licenses (array: one for each stretch of identifiers that a rule matches, in order)."""
    rows = known_sentences(docs, library)
    longest = sorted(rules, key=lambda r: -len(r[1]))
    # each stretch becomes @<rule>; longer rules go first and what they take is no longer there for shorter ones
    text = F.concat(F.lit(" "), F.array_join("found", "  "), F.lit(" "))
    for i, (_, names) in enumerate(longest):
        text = F.replace(text, F.lit(" " + "  ".join(names) + " "), F.lit(f" @{i} "))
    hits = F.regexp_extract_all(text, F.lit(r"@(\d+)"), F.lit(1))
    named = F.array(*(F.lit(r[0]) for r in longest))
    return rows.select("doc_id", F.size("found").cast("long").alias("n_sentences"), F.when(F.size("found") > 0, F.transform(hits, lambda h: F.element_at(named, h.cast("int") + 1))).otherwise(F.array().cast("array<string>")).alias("licenses"))


def license_digest(scanned: DataFrame) -> DataFrame:
    """What the query op7 returns."""
    return scanned.select("doc_id", "n_sentences", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"))
