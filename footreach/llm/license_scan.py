"""License scans by sentence rules.

Texts are cut into sentences at line breaks and after `.`, `!`, `?` or `;` before white space, and once more with the
single line breaks of a paragraph joined, as licence texts are often wrapped; a rule may hold in either. A sentence is normalised (lower case,
no brackets, punctuation or list marks; programs, holders, years and organisations as placeholders) and looked up in a map
from sentences to identifiers: whole, by its first words where the known sentence goes on in several ways, by the
licences and versions that it names after words such as `licensed under`, or by the expression of an SPDX line. The identifiers of a text,
in order, are matched against ordered rules: a rule holds if its identifiers stand one after the other in the
text, with no more than `gap` unknown sentences between two of them. Longer rules win over the shorter ones
inside them, for the same licence.

One pass, no shuffle, no Python: texts without one of a few anchor words are not cut at all.

Defined cases: null or empty text has no licences (empty arrays); repeated sentences count each time; rows are
independent of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footreach.llm.common import scratch

#: Words one of which every known sentence holds. Fixed values.
ANCHORS = "licen[sc]e|copyright|spdx|permission|warrant|redistribut|public\\s+domain|unlicense|liab|all\\s+rights\\s+reserved|free\\s+software|cc0|cc[ -]by|creative\\s+commons|\\smpl\\s|under\\s+(?:the\\s+)?(?:gnu|[al]?gpl|mit|expat|bsd|isc|apache)\\b"

#: Known sentences as normalised() writes them, and their identifiers. Fixed values of public licence texts.
SENTENCES: dict[str, str] = {
    "you may not use this file except in compliance with the license": "apache2-comply",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-asis",
    "it is free software": "gpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or any later version": "gpl-redistribute3",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or any later version": "gpl-redistribute2",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or any later version": "lgpl-notice",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or any later version": "lgpl-notice",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or any later version": "agpl-notice",
    "mit license": "mit-title",
    "the mit license": "mit-title",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-permit",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of any may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-name",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this software is provided as-is without any express or implied warranty": "zlib-asis",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "the gnu general public license is a free copyleft license for software and other kinds of works": "gpl3-body",
    "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software": "agpl-body",
    "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below": "lgpl-body",
    "the accompanying program is provided under the terms of this eclipse public license": "epl-body",
    "apache license version 2.0": "apache2-title",
    "apache license version 2.0 january 2004": "apache2-title",
    "mozilla public license version 2.0": "mpl2-title",
    "eclipse public license v 2.0": "epl2-title",
    "eclipse public license v 1.0": "epl1-title",
    "cc0 1.0 universal": "cc0-title",
    "copyright all rights reserved": "reserved",
    "all rights reserved": "reserved",
    "copyright": "copyright",
}

#: Creative Commons licences by the rest of their titles. Fixed values.
COMMONS: dict[str, str] = {
    "attribution": "CC-BY",
    "attribution-sharealike": "CC-BY-SA",
    "attribution-noderivatives": "CC-BY-ND",
    "attribution-noncommercial": "CC-BY-NC",
    "attribution-noncommercial-sharealike": "CC-BY-NC",
    "attribution-noncommercial-noderivatives": "CC-BY-NC",
}
for _kind, _licence in COMMONS.items():
    SENTENCES[f"creative commons {_kind} 4.0 international public license"] = f"{_licence.lower()}-title"
    SENTENCES[f"by exercising the licensed rights you accept and agree to be bound by the terms and conditions of this creative commons {_kind} 4.0 international public license"] = f"{_licence.lower()}-body"

#: SPDX short identifiers, lower-cased, and their licences. Fixed values.
SPDX: dict[str, str] = {
    "apache-2.0": "Apache-2.0",
    "mit": "MIT",
    "bsd-2-clause": "BSD-2-Clause",
    "bsd-3-clause": "BSD-3-Clause",
    "isc": "ISC",
    "zlib": "Zlib",
    "bsl-1.0": "BSL-1.0",
    "mpl-2.0": "MPL-2.0",
    "epl-1.0": "EPL-1.0",
    "epl-2.0": "EPL-2.0",
    "unlicense": "Unlicense",
    "cc0-1.0": "CC0-1.0",
    **{f"{name}-{v}{end}": licence for name, v, licence in (("gpl", "2.0", "GPL-2.0"), ("gpl", "3.0", "GPL-3.0"), ("lgpl", "2.0", "LGPL"), ("lgpl", "2.1", "LGPL"), ("lgpl", "3.0", "LGPL"), ("agpl", "3.0", "AGPL-3.0")) for end in ("", "+", "-only", "-or-later")},
    **{f"cc-{kind}-{v}": f"CC-{kind.upper()[:5]}" for kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")},
}

#: Beginnings of known sentences that go on in several ways or with an address. Fixed values of public licence texts.
HEADS: dict[str, str] = {
    "you may obtain a copy of the license at": "apache2-copy",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction": "mit-grant",
    "the software is provided as is without warranty of any kind express or implied": "mit-asis",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "bsl-grant",
    "by contrast the gnu general public license is intended to guarantee your freedom to share and change free": "gpl2-body",
    "this license the lesser general public license applies to some specially designated software": "lgpl-body",
    "if a copy of the mpl was not distributed with this file you can obtain one at": "mpl2-copy",
}

#: Names after words such as `licensed under`, as notice() writes them, with the versions that they come with. Fixed values.
NAMES: list[tuple[str, list[str], list[str]]] = [
    ("apache2-notice", ["apache", "apache public"], ["2"]),
    ("gpl3-notice", ["gnu general public", "gnu gpl", "gpl"], ["3", "v3"]),
    ("gpl2-notice", ["gnu general public", "gnu gpl", "gpl"], ["2", "v2"]),
    ("lgpl-notice", ["gnu lesser general public", "gnu lgpl", "lgpl"], ["", "2", "2.1", "3"]),
    ("agpl-notice", ["gnu affero general public", "gnu agpl", "agpl"], ["", "3"]),
    ("mpl2-notice", ["mozilla public", "mpl"], ["2"]),
    ("epl1-notice", ["eclipse public", "epl"], ["1"]),
    ("epl2-notice", ["eclipse public", "epl"], ["2"]),
    ("mit-notice", ["mit", "expat", "mit x11"], [""]),
    ("bsd-notice", ["bsd", "3-clause bsd", "2-clause bsd", "bsd 3-clause", "bsd 2-clause", "new bsd", "modified bsd", "simplified bsd", "bsd-style"], [""]),
    ("isc-notice", ["isc"], [""]),
    ("unlicense", ["unlicense"], [""]),
    ("cc0-notice", ["cc0", "creative commons zero"], ["", "1"]),
    ("cc-by-notice", ["cc-by"], ["", "2", "3", "4"]),
    ("cc-by-sa-notice", ["cc-by-sa"], ["", "2", "3", "4"]),
    ("cc-by-nd-notice", ["cc-by-nd"], ["", "2", "3", "4"]),
    ("cc-by-nc-notice", ["cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd"], ["", "2", "3", "4"]),
]
NOTICES = {f"{name} {version}".strip(): id_ for id_, names, versions in NAMES for name in names for version in versions}

#: Ordered rules: licence, kind of evidence, identifiers in order.
RULES: list[tuple[str, str, list[str]]] = [
    ("Apache-2.0", "full", ["apache2-notice", "apache2-comply", "apache2-copy", "apache2-asis"]),
    ("Apache-2.0", "notice", ["apache2-notice"]),
    ("GPL-3.0", "full", ["gpl-free", "gpl-redistribute3"]),
    ("GPL-3.0", "notice", ["gpl-redistribute3"]),
    ("GPL-3.0", "notice", ["gpl3-notice"]),
    ("GPL-2.0", "full", ["gpl-free", "gpl-redistribute2"]),
    ("GPL-2.0", "notice", ["gpl-redistribute2"]),
    ("GPL-2.0", "notice", ["gpl2-notice"]),
    ("LGPL", "notice", ["lgpl-notice"]),
    ("AGPL-3.0", "notice", ["agpl-notice"]),
    ("MPL-2.0", "full", ["mpl2-notice", "mpl2-copy"]),
    ("MPL-2.0", "notice", ["mpl2-notice"]),
    ("MIT", "full", ["mit-grant", "mit-condition", "mit-asis"]),
    ("MIT", "notice", ["mit-notice"]),
    ("MIT", "title", ["mit-title"]),
    ("BSD-3-Clause", "full", ["bsd-permit", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-2-Clause", "full", ["bsd-permit", "bsd-source", "bsd-binary"]),
    ("BSD", "notice", ["bsd-notice"]),
    ("ISC", "full", ["isc-grant"]),
    ("ISC", "notice", ["isc-notice"]),
    ("Zlib", "full", ["zlib-asis", "zlib-grant"]),
    ("BSL-1.0", "full", ["bsl-grant"]),
    ("Unlicense", "full", ["unlicense"]),
    ("CC0-1.0", "notice", ["cc0-notice"]),
    ("CC-BY-SA", "notice", ["cc-by-sa-notice"]),
    ("CC-BY-ND", "notice", ["cc-by-nd-notice"]),
    ("CC-BY-NC", "notice", ["cc-by-nc-notice"]),
    ("CC-BY", "notice", ["cc-by-notice"]),
    ("Apache-2.0", "title", ["apache2-title"]),
    ("GPL-3.0", "body", ["gpl3-body"]),
    ("GPL-2.0", "body", ["gpl2-body"]),
    ("LGPL", "body", ["lgpl-body"]),
    ("AGPL-3.0", "body", ["agpl-body"]),
    ("MPL-2.0", "title", ["mpl2-title"]),
    ("EPL", "body", ["epl-body"]),
    ("EPL-1.0", "title", ["epl1-title"]),
    ("EPL-1.0", "notice", ["epl1-notice"]),
    ("EPL-2.0", "title", ["epl2-title"]),
    ("EPL-2.0", "notice", ["epl2-notice"]),
    ("CC0-1.0", "title", ["cc0-title"]),
    *((licence, kind, [f"{licence.lower()}-{kind}"]) for licence in dict.fromkeys(COMMONS.values()) for kind in ("title", "body")),
    *((licence, "tag", [f"spdx-{licence.lower()}"]) for licence in dict.fromkeys(SPDX.values())),
    ("proprietary", "notice", ["reserved"]),
]

GAP = 2


def sentences(text: F.Column) -> F.Column:
    """The sentences of a text, in order, blank ones left out."""
    return F.filter(F.split(text, "\n|(?<=[.!?;]|met:|software:)[ \t\r]+(?!either version|[0-9]+[.][0-9])", -1), lambda x: F.length(F.trim(x)) > 0)


def joined(text: F.Column) -> F.Column:
    """The text with the single line breaks of its paragraphs as blanks. Copyright lines are paragraphs of their own, and
    lines of nothing but comment marks are empty."""
    apart = F.regexp_replace(text, "(?im)^(\\W*(?:copyright[ :]+(?:\\(c\\)|©|[0-9]{4}|by )|\\(c\\) |© ).*)$", "\n$1\n")
    empty = F.regexp_replace(apart, "(?m)^[ \t*#/;-]+$|\r", "")
    return F.regexp_replace(empty, "(?<!\n)\n(?!\n)", " ")


def _plain(sentence: F.Column) -> F.Column:
    """Lower case, without what stands in brackets, marks of lists and quotes; commas stay."""
    apart = F.regexp_replace(F.lower(sentence), "\\([^()]*\\)", " ")
    words = F.regexp_replace(F.regexp_replace(apart, "licence", "license"), "[^\\p{L}\\p{N}.,+-]+", " ")
    return F.regexp_replace(F.regexp_replace(words, "(?<![\\p{L}\\p{N}])[-.,+*]+|[-.+]+(?![\\p{L}\\p{N}.+-])(?<!\\d\\+)", " "), "^ *[0-9]+ (?=\\p{L})|^ *[a-c] (?=redist)", "")


def normalised(sentence: F.Column) -> F.Column:
    """A sentence as the map knows it: names of programs, holders, years and organisations are placeholders."""
    words = F.trim(F.regexp_replace(F.regexp_replace(_plain(sentence), ",", " "), " +", " "))
    words = F.regexp_replace(words, "^(?:c )?copyright\\b(?!ed).*?( all rights reserved)?$", "copyright$1")
    words = F.regexp_replace(words, "^.{1,80} is free software$", "it is free software")
    return F.regexp_replace(words, "^neither the name of .* may be used", "neither the name of any may be used")


def notices(sentence: F.Column) -> F.Column:
    """What a sentence says that something is licensed under: names and versions of licences, several where they are joined
    by `or` or `and`; one empty name if it says nothing of the kind."""
    under = "\\b(?:licensed|released|distributed|available|published|provided|dedicated|subject|covered|governed) (?:under|to|by|with)(?: the)?(?: terms of)?(?: (?:either|both)(?: of)?)?(?: the| an?)? (.*)$"
    name = F.trim(F.regexp_extract(F.regexp_replace(_plain(sentence), " +", " "), under, 1))
    name = F.regexp_replace(F.regexp_replace(name, ",? ?\\b(?:version|v)[. ]*(?=\\d)", " "), ",.*$| that (?:can|may) be found .*$| at your option\\b| as published by the free software foundation", "")
    name = F.regexp_replace(name, "-(?:only|or-later)\\b|(?: or| and)*(?: any)? later(?: versions?)?(?= |$)|(?<=[a-z])-(?=\\d[.])", " ")

    def one(part: F.Column) -> F.Column:
        part = F.regexp_replace(part, "^ *(?:the|an?) |\\b(?:licenses?|international|unported|generic|only)\\b|[.]0(?![0-9.])", " ")
        part = F.regexp_replace(F.regexp_replace(part, "\\bcreative commons attribution\\b|\\bcc[ -]by\\b", "cc-by"), "[ -](?:share ?alike|sa)\\b", "-sa")
        part = F.regexp_replace(F.regexp_replace(part, "[ -](?:non-?commercial|nc)\\b", "-nc"), "[ -](?:no-?deriv\\w*|nd)\\b", "-nd")
        return F.trim(F.regexp_replace(part, " +", " "))

    return F.transform(F.split(name, " (?:and/or|or|and) "), one)


def tags(sentence: F.Column) -> F.Column:
    """The identifiers of an SPDX line's expression, without its operators, brackets and exceptions."""
    expression = F.regexp_extract(sentence, "(?i)spdx-license-identifier:?\\s*([\\w.+()\\t -]*)", 1)
    names = F.split(F.regexp_replace(expression, "(?i)[()]|\\bwith\\s+\\S+", " "), "(?i)\\s+(?:and|or)\\s+")
    return F.filter(F.transform(names, lambda x: _map({k: f"spdx-{v.lower()}" for k, v in SPDX.items()})[F.lower(F.trim(x))]), lambda x: x.isNotNull())


def _map(values: dict[str, str]) -> F.Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def sentence_ids(sentences_: F.Column) -> F.Column:
    """The identifiers of sentences: null for one without an anchor word or an unknown one. First those of an SPDX line count,
    then that of the whole sentence, then that of its beginning, then those of the licences that it names, of which
    the first must be known. A sentence has several only in the first and the last case."""
    sizes = sorted({k.count(" ") + 1 for k in HEADS})
    heads = lambda own: [_map({k: v for k, v in HEADS.items() if k.count(" ") + 1 == n})[F.substring_index(own, " ", n)] for n in sizes]
    anchored = F.transform(sentences_, lambda x: F.when(x.rlike(f"(?i){ANCHORS}"), x))
    # normalised once for all look-ups
    forms = F.transform(anchored, lambda x: F.struct(F.when(x.rlike("(?i)spdx-license-identifier"), tags(x)).alias("tags"), normalised(x).alias("own"), F.transform(notices(x), lambda n: _map(NOTICES)[n]).alias("names")))

    def ids(x: F.Column) -> F.Column:
        one = F.coalesce(_map(SENTENCES)[x["own"]], *heads(x["own"]))
        several = F.when(x["names"][0].isNotNull(), F.array_distinct(F.filter(x["names"], lambda n: n.isNotNull())))
        return F.coalesce(F.when(F.size(x["tags"]) > 0, x["tags"]), F.when(one.isNotNull(), F.array(one)), several, F.array(F.lit(None).cast("string")))

    return F.flatten(F.transform(forms, ids))


def _encoded(ids: F.Column) -> F.Column:
    """Identifiers as a string in which rules can be found: `name|`, and `?|` for an unknown sentence."""
    return F.concat(F.lit("|"), F.array_join(F.transform(ids, lambda x: F.concat(F.coalesce(x, F.lit("?")), F.lit("|"))), ""))


def rule_pattern(identifiers: list[str], gap: int = GAP) -> str:
    return "\\|" + f"\\|(?:\\?\\|){{0,{gap}}}".join(identifiers) + "\\|"


def scan_licenses(docs: DataFrame, gap: int = GAP) -> DataFrame:
    """docs with sentence_ids (known ones, in order), rules (`licence:evidence`), licenses and n_licenses.

    A column of docs that has the name of a result gives way to it.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast("array<string>")
    has, lines, both, code, known, named_ = (scratch(docs, n) for n in ("has", "lines", "whole", "code", "ids", "rules"))
    held = docs.withColumn(has, text.rlike(f"(?i){ANCHORS}"))
    ids = lambda t, more: F.when(F.col(has) & more, sentence_ids(sentences(t))).otherwise(none)
    rows = held.withColumn(lines, ids(text, F.lit(True))).withColumn(both, ids(joined(text), F.contains(text, F.lit("\n"))))
    rows = rows.withColumn(code, F.concat(_encoded(F.col(lines)), F.lit("\n"), _encoded(F.col(both))))
    # those that only the joined text has come after the others
    only = F.filter(both, lambda x: ~F.coalesce(F.array_contains(lines, x), F.lit(False)))
    rows = rows.withColumn(known, F.concat(lines, only))
    hit = {k: F.col(code).rlike(rule_pattern(names, gap)) for k, (_, _, names) in enumerate(RULES)}
    inside = lambda short, long: any(long[i : i + len(short)] == short for i in range(len(long)))
    found = []
    for k, (license_, evidence, names) in enumerate(RULES):
        # what a longer rule of a licence of the same family says already isn't said again
        over = [j for j, (other, _, longer) in enumerate(RULES) if j != k and len(longer) > len(names) and inside(names, longer) and other.split("-")[0] == license_.split("-")[0]]
        own = hit[k]
        for j in over:
            own = own & ~hit[j]
        found.append(F.when(own, F.lit(f"{license_}:{evidence}")))
    rules = F.when(F.size(F.filter(known, lambda x: x.isNotNull())) > 0, F.filter(F.array(*found), lambda x: x.isNotNull())).otherwise(none)
    rules = F.array_distinct(rules)
    named = rows.withColumn(named_, rules)
    licenses = F.array_distinct(F.transform(named_, lambda x: F.substring_index(x, ":", 1)))
    new = {"sentence_ids": F.filter(known, lambda x: x.isNotNull()), "rules": F.col(named_), "licenses": licenses, "n_licenses": F.size(licenses)}
    return named.select(*(c for c in docs.columns if c not in new), *(v.alias(k) for k, v in new.items()))
