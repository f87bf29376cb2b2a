"""Licence scans by sentence rules, with DataFrame functions only.

A text is cut into sentences, each normalised to its words, and looked up in a table of known licence
sentences. The ids found, in order and with a mark for each unknown sentence, are matched against an ordered
list of rules; a rule is a licence and the ids that must follow each other, and takes the sentences it
matches from the rules after it. Sentences are cut once with every line end as an end, and once with only
blank lines as ends, so that texts wrapped at a column are recognised as well. A known sentence that is itself
cut has an id for each piece, and all of them must follow each other.

The table has the notices and grants of common licences word for word, and, made by rule, what names each licence
of a list: its tag, "licensed under" and the like, the notices of the GNU family and of Creative Commons.

Everything happens within the row: no shuffle. A text without any of the anchors, of which every known sentence
has one, is left alone, and rules are only tried where a known sentence is.

Defined cases: null and empty texts have no licence; of a sentence that repeats each occurrence counts; the
licences of a text are distinct and sorted; repeated rows are scanned alike; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known sentences of licences and notices, by id.
SENTENCES = {
    "agpl3_grant": "you can redistribute it and or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation either version 3 of the License or at your option any later version",
    "agpl3_program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache2_as_is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache2_reference": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache2_short": "Licensed under the Apache License, Version 2.0.",
    "apache2_use": "you may not use this file except in compliance with the License.",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd_endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd_short": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd_start": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc0_short": "This work is dedicated to the public domain under CC0 1.0.",
    "cc_by": "Licensed under CC BY 4.0.",
    "cc_by_long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc_by_nc": "Licensed under CC BY-NC 4.0.",
    "cc_by_nc_long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc_by_nd": "Licensed under CC BY-ND 4.0.",
    "cc_by_sa": "Licensed under CC BY-SA 4.0.",
    "cc_by_sa_long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl2_program": "This program is free software",
    "gpl2_terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl2_version": "either version 2 of the License, or (at your option) any later version.",
    "gpl3_program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl3_short": "This work is licensed under the GNU General Public License, version 3.",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl3_program": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit_grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit_short": "Released under the MIT License.",
    "mit_as_is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mpl11_reference": 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License")',
    "mpl11_source": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.",
    "mpl2_reference": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ofl_reference": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "postgresql_grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "reserved": "All rights reserved.",
    "boost_grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "bsd0_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "bsd_endorse_old": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cddl_reference": 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License").',
    "epl1_reference": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    "epl2_reference": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "wtfpl_grant": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "zlib_as_is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib_grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
# Rules in order; the licence, its kind, and the sentences in a row that show it.
TEXT_RULES = (
    ("Apache-2.0", "permissive", ("apache2_reference", "apache2_use")),
    ("Apache-2.0", "permissive", ("apache2_reference",)),
    ("Apache-2.0", "permissive", ("apache2_short",)),
    ("BSD-3-Clause", "permissive", ("bsd_start", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-3-Clause", "permissive", ("bsd_start", "bsd_source", "bsd_binary", "bsd_endorse_old")),
    ("BSD-2-Clause", "permissive", ("bsd_start", "bsd_source", "bsd_binary")),
    ("BSD", "permissive", ("bsd_start",)),
    ("BSD", "permissive", ("bsd_short",)),
    ("MIT", "permissive", ("mit_grant", "mit_notice", "mit_as_is")),
    ("MIT", "permissive", ("mit_grant", "mit_notice")),
    ("MIT", "permissive", ("mit_short",)),
    ("X11-like", "permissive", ("mit_grant",)),
    ("ISC", "permissive", ("isc_grant",)),
    ("0BSD", "permissive", ("bsd0_grant",)),
    ("BSL-1.0", "permissive", ("boost_grant",)),
    ("Zlib", "permissive", ("zlib_as_is", "zlib_grant")),
    ("Zlib", "permissive", ("zlib_grant",)),
    ("PostgreSQL", "permissive", ("postgresql_grant",)),
    ("WTFPL", "permissive", ("wtfpl_grant",)),
    ("OFL-1.1", "permissive", ("ofl_reference",)),
    ("CDDL-1.0", "copyleft", ("cddl_reference",)),
    ("EPL-1.0", "copyleft", ("epl1_reference",)),
    ("EPL-2.0", "copyleft", ("epl2_reference",)),
    ("MPL-1.1", "copyleft", ("mpl11_reference", "apache2_use")),
    ("MPL-1.1", "copyleft", ("mpl11_reference",)),
    ("MPL-1.1", "copyleft", ("mpl11_source",)),
    ("AGPL-3.0-or-later", "copyleft", ("agpl3_program",)),
    ("AGPL-3.0-or-later", "copyleft", ("agpl3_grant",)),
    ("LGPL-3.0-or-later", "copyleft", ("lgpl3_program",)),
    ("GPL-3.0-or-later", "copyleft", ("gpl3_program",)),
    ("GPL-2.0-or-later", "copyleft", ("gpl2_program", "gpl2_terms", "gpl2_version")),
    ("GPL-2.0", "copyleft", ("gpl2_program", "gpl2_terms")),
    ("GPL-3.0", "copyleft", ("gpl3_short",)),
    ("MPL-2.0", "copyleft", ("mpl2_reference",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc_by_sa",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc_by_sa_long",)),
    ("CC-BY-NC-4.0", "noncommercial", ("cc_by_nc",)),
    ("CC-BY-NC-4.0", "noncommercial", ("cc_by_nc_long",)),
    ("CC-BY-ND-4.0", "noderivatives", ("cc_by_nd",)),
    ("CC-BY-4.0", "permissive", ("cc_by",)),
    ("CC-BY-4.0", "permissive", ("cc_by_long",)),
    ("CC0-1.0", "permissive", ("cc0_short",)),
    ("Unlicense", "permissive", ("unlicense",)),
    ("All-rights-reserved", "reserved", ("reserved",)),
)
# Kinds from the strictest on; words of which each known sentence has one.
KINDS = ("reserved", "noncommercial", "noderivatives", "copyleft", "permissive")
# Licences by identifier, their kind, and the names that texts use for them.
NAMED = (
    ("AFL-3.0", "permissive", "Academic Free License 3.0"),
    ("Apache-2.0", "permissive", "Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License"),
    ("Artistic-2.0", "permissive", "Artistic License 2.0"),
    ("BSD-2-Clause", "permissive", "BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    ("BSD-3-Clause", "permissive", "BSD 3-Clause License", "3-Clause BSD License", "New BSD License"),
    ("BSL-1.0", "permissive", "Boost Software License 1.0", "Boost Software License, Version 1.0"),
    ("CC0-1.0", "permissive", "CC0 1.0", "CC0 1.0 Universal License"),
    ("CDDL-1.0", "copyleft", "Common Development and Distribution License 1.0"),
    ("EPL-1.0", "copyleft", "Eclipse Public License 1.0"),
    ("EPL-2.0", "copyleft", "Eclipse Public License 2.0"),
    ("EUPL-1.2", "copyleft", "European Union Public Licence 1.2", "European Union Public License 1.2"),
    ("ISC", "permissive", "ISC License"),
    ("MIT", "permissive", "MIT License", "MIT license (MIT)", "Expat License"),
    ("MPL-1.1", "copyleft", "Mozilla Public License 1.1", "Mozilla Public License, Version 1.1"),
    ("MPL-2.0", "copyleft", "Mozilla Public License 2.0", "Mozilla Public License, Version 2.0"),
    ("MS-PL", "permissive", "Microsoft Public License"),
    ("NCSA", "permissive", "University of Illinois/NCSA Open Source License"),
    ("OFL-1.1", "permissive", "SIL Open Font License 1.1", "SIL Open Font License, Version 1.1"),
    ("PostgreSQL", "permissive", "PostgreSQL License"),
    ("PSF-2.0", "permissive", "Python Software Foundation License 2.0"),
    ("Unlicense", "permissive", "Unlicense", "Unlicense License"),
    ("WTFPL", "permissive", "WTFPL License", "Do What The F*ck You Want To Public License"),
    ("Zlib", "permissive", "zlib License", "zlib/libpng License"),
)
# Names of the GNU family with their versions, Creative Commons' elements and ports by version.
GNU = (
    ("AGPL", "Affero General", ("3",)),
    ("GPL", "General", ("1", "2", "3")),
    ("LGPL", "Lesser General", ("2.1", "3")),
    ("LGPL", "Library General", ("2",)),
)
CC_KINDS = (
    ("BY", "Attribution", "permissive"),
    ("BY-SA", "Attribution-ShareAlike", "copyleft"),
    ("BY-NC", "Attribution-NonCommercial", "noncommercial"),
    ("BY-ND", "Attribution-NoDerivatives", "noderivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike", "noncommercial"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives", "noncommercial"),
)
CC_VERSIONS = (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International"))
HEADS = ("licensed", "released", "distributed", "available", "published")
ANCHORS = (
    *(f"{head} under" for head in HEADS), "warrant", "licen", "copyright", "rights reserved", "redistribut", "public domain", "free software", "permission", "version 2", "you may not use",
)
# What counts alike, in normalised sentences: "this work is licensed under the" and "released under"; free software of any sort.
SAME = (
    (rf"^(?:this [a-z]+ is )?(?:{'|'.join(HEADS)}) under (?:the |a |an )?", "under "),
    (r"^this (?:library|software|file|package|module) is free software", "this program is free software"),
)


def made_sentences() -> list[tuple[str, str, str, str]]:
    """(id, sentence, licence, kind) of what names each licence of the lists above."""
    out = []

    def add(licence: str, kind: str, *texts: str) -> None:
        out.extend((f"{licence}#{len(out) + i}", text, licence, kind) for i, text in enumerate(texts))

    def under(*names: str) -> list[str]:
        return [f"Licensed under {name}." for name in names]

    def tagged(*ids: str) -> list[str]:
        return [f"SPDX-License-Identifier: {i}" for i in ids]

    for licence, kind, *names in NAMED:
        add(licence, kind, *tagged(licence), *under(*names))
    for short, name, versions in GNU:
        full = f"GNU {name} Public License"
        for v in versions:
            number = v if "." in v else f"{v}.0"
            plain, only, later = (f"{short}-{number}{end}" for end in ("", "-only", "-or-later"))
            add(plain, "copyleft", *tagged(plain), *under(*(f"{n}{sep}{v}" for n in (full, f"GNU {short}") for sep in (", version ", " version ", " v"))))
            add(only, "copyleft", *tagged(only))
            add(later, "copyleft", *tagged(later, f"{plain}+"), *under(f"{full}, version {v} or later", f"{full} version {v} or later"))
            terms = f"you can redistribute it and/or modify it under the terms of the {full}"
            by = "as published by the Free Software Foundation"
            for colon, comma in ((":", ","), (";", ";")):
                add(later, "copyleft", f"This program is free software{colon} {terms} {by}{comma} either version {v} of the License, or (at your option) any later version.")
                add(only, "copyleft", f"This program is free software{colon} {terms}, version {v}, {by}.")
    for short, name, kind in CC_KINDS:
        for v, port in CC_VERSIONS:
            add(f"CC-{short}-{v}", kind, *tagged(f"CC-{short}-{v}"), *under(f"CC {short} {v}", f"CC-{short}-{v}", f"Creative Commons {name} {v} License"))
            add(f"CC-{short}-{v}", kind, *under(f"Creative Commons {name} {v} {port} License"))
    return out


def normal(sentence: str) -> str:
    """ASCII letters and digits of a sentence, lower-cased, one space between words, in the form that SAME asks for."""
    words = " ".join(re.findall("[a-z0-9]+", sentence.lower()))
    for pattern, form in SAME:
        words = re.sub(pattern, form, words)
    return words


def pieces_of(sentence: str) -> list[str]:
    """The normalised pieces that `_ids` cuts a sentence into, less those it leaves out."""
    joined = re.sub(r"\b([vV])\.\s+([0-9])", r"\1 \2", sentence)
    cut = [normal(s) for s in re.sub(r"([.!?;])\s+", "\\1\n", joined).split("\n")]
    return [s for s in cut if not re.fullmatch("[0-9 ]*|[a-z]", s)]


def tables(sentences: dict[str, str], rules) -> tuple[dict[str, str], list[tuple[str, str, tuple[str, ...]]]]:
    """Ids by normalised piece, and the rules in ids of pieces.

    A sentence of one piece has its own id, others have one for each piece; a piece of several sentences has the
    id of the first.
    """
    known: dict[str, str] = {}
    of: dict[str, tuple[str, ...]] = {}
    for i, sentence in sentences.items():
        cut = pieces_of(sentence)
        of[i] = tuple(known.setdefault(s, i if len(cut) == 1 else f"{i}.{n}") for n, s in enumerate(cut, 1))
    spelled = [(licence, kind, tuple(x for i in row for x in of[i])) for licence, kind, row in rules]
    return known, list(dict.fromkeys(spelled))


def default_tables() -> tuple[dict[str, str], list[tuple[str, str, tuple[str, ...]]]]:
    """Of all sentences: rules of the texts first, then those of names, longer ones before shorter ones."""
    made = made_sentences()
    known, rules = tables(SENTENCES | {i: s for i, s, _, _ in made}, [*TEXT_RULES, *((licence, kind, (i,)) for i, _, licence, kind in made)])
    return known, sorted(rules, key=lambda r: -len(r[2]))


KNOWN, RULES = default_tables()


def _ids(text: Column, known: dict[str, str]) -> Column:
    """Ids of a text's sentences, '-' for an unknown one; numbers of lists don't count."""
    joined = F.regexp_replace(text, r"\b([vV])\.[\x20\x09-\x0D]+([0-9])", "$1 $2")
    cut = F.split(F.regexp_replace(joined, r"([.!?;])[\x20\x09-\x0D]+", "$1\n"), "\n")

    def normalised(s: Column) -> Column:
        words = F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
        for pattern, form in SAME:
            words = F.regexp_replace(words, pattern, form)
        return words

    words = F.filter(F.transform(cut, normalised), lambda s: ~s.rlike(r"^(?:[0-9 ]*|[a-z])$"))
    names = F.str_to_map(F.lit("\n".join(f"{k}\t{i}" for k, i in known.items())), F.lit("\n"), F.lit("\t"))
    # the set is looked up by hash, the map only for what is in it
    return F.transform(words, lambda s: F.when(s.isin(*known), F.element_at(names, s)).otherwise(F.lit("-")))


def _licences(ids: Column, rules) -> Column:
    """Licences of the rules that match, in the order of the rules."""
    none = F.expr("cast(array() as array<string>)")
    # Each column of the rules is one literal.
    licences, firsts, rows = (F.split(F.lit("\n".join(column)), "\n") for column in zip(*((name, row[0], f",{','.join(row)},") for name, _, row in rules), strict=True))
    able = F.filter(F.sequence(F.lit(0), F.lit(len(rules) - 1)), lambda i: F.array_contains(ids, F.get(firsts, i)))
    start = F.struct(F.concat(F.lit(","), F.array_join(ids, ","), F.lit(",")).alias("left"), none.alias("found"))

    def apply(state: Column, i: Column) -> Column:
        row = F.get(rows, i)
        hit = F.instr(state["left"], row) > 0
        left = F.when(hit, F.replace(state["left"], row, F.lit(",#,"))).otherwise(state["left"])
        found = F.when(hit, F.concat(state["found"], F.array(F.get(licences, i)))).otherwise(state["found"])
        return F.struct(left.alias("left"), found.alias("found"))

    some = F.exists(ids, lambda i: i != "-")
    return F.when(some, F.aggregate(able, start, apply, lambda state: state["found"])).otherwise(none)


def scan(docs: DataFrame, known: dict[str, str] | None = None, rules=None, anchors: tuple[str, ...] = ANCHORS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id_col, licences (array), sentences (ids of known ones, in order) and kind (the strictest one, or 'none').

    known and rules: as `tables` makes them.
    """
    known, rules = known or KNOWN, rules or RULES
    for sentence in known:
        if not any(normal(a) in sentence for a in anchors) and not sentence.startswith("under "):
            raise ValueError(f"no anchor is in: {sentence}")
    # An anchor may be broken by anything that normalising removes.
    anchor = "(?i)" + "|".join("[^A-Za-z0-9]+".join(a.split()) for a in anchors)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col), F.when(text.rlike(anchor), text).alias("__text"))
    none = F.expr("cast(array() as array<string>)")
    lines = F.col("__text")
    paragraphs = F.regexp_replace(F.regexp_replace("__text", r"\n[\x20\x09\x0D]*\n", ". \n"), r"([^.!?;\n])[\x20\x09\x0D]*\n", "$1 ")
    rows = rows.select(id_col, F.when(F.col("__text").isNotNull(), F.struct(_ids(lines, known).alias("a"), _ids(paragraphs, known).alias("b"))).alias("i"))
    both = F.array_sort(F.array_union(_licences(F.col("i.a"), rules), _licences(F.col("i.b"), rules)))
    found = F.when(F.col("i").isNull(), none).otherwise(both)
    in_lines, in_paragraphs = (F.filter(f"i.{side}", lambda x: x != "-") for side in "ab")
    more = F.when(F.size(in_paragraphs) > F.size(in_lines), in_paragraphs).otherwise(in_lines)
    shown = F.when(F.col("i").isNull(), none).otherwise(more)
    kind = F.lit("none")
    for k in reversed(KINDS):
        names = sorted({licence for licence, its, _ in rules if its == k})
        if names:
            kind = F.when(F.arrays_overlap(F.col("licences"), F.array(*(F.lit(x) for x in names))), k).otherwise(kind)
    return rows.select(id_col, found.alias("licences"), shown.alias("sentences")).withColumn("kind", kind)
