"""Public licence notices, as they stand and wrapped at 72 columns."""

import random
import textwrap

import pytest

from footreach.llm import license_scan

GPL = "{} is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
BSD = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."]
NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
TEXTS = [
    ("GPL-3.0:full", [GPL.format("This program", ":", ",", 3)]),
    ("GPL-3.0:full", [GPL.format("Foo", ":", ",", 3)]),
    ("GPL-2.0:full", [GPL.format("This program", ";", ";", 2)]),
    ("GPL-3.0:notice", ["You can redistribute" + GPL.format("x", ":", ",", 3).partition("you can redistribute")[2]]),
    ("CC-BY-SA:notice", ["Released under CC BY-SA 4.0."]),
    ("CC-BY:notice", ["The pictures are available under Creative Commons Attribution 4.0, and so are all the drawings."]),
    ("CC0-1.0:notice", ["Dedicated by CC0."]),
    ("Apache-2.0:full", ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "http://www.apache.org/licenses/LICENSE-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.']),
    ("MIT:full", ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, subject to the following conditions:', "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.']),
    ("BSD-2-Clause:full", BSD),
    ("BSD-3-Clause:full", [*BSD, NAME]),
    ("ISC:full", ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."]),
    ("MPL-2.0:full", ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."]),
    ("Zlib:full", ["This software is provided 'as-is', without any express or implied warranty.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"]),
    ("BSL-1.0:full", ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software."]),
    ("LGPL:notice", ["Distributed under the terms of the GNU Lesser General Public License v2.1 or later."]),
    ("Unlicense:full", ["This is free and unencumbered software released into the public domain."]),
]
PROSE = [
    "We saw a permission slip in cc by mistake yesterday.", "The mail went to you in cc by accident.", "A creative commons attribution exam was held.", "Our licence to drive was provided by the state.", "The work was released to the public domain experts.",
    "Redistribution of wealth is permitted provided that the people agree.", "The software is provided as it was.", "Free software is good software, and copyrighted works need a license.", "Permission is hereby granted to nobody.",
    "This is licensed under the Apache tribe's customs.", "Distributed under the gnu, by a zoo of version 3 animals.", "License fees are subject to the terms of the MIT cafeteria.",
]


def test_prose_names_no_licence(spark):
    got = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(PROSE)), "doc_id long, text string"))
    assert {PROSE[r.doc_id]: r.rules for r in got.collect() if r.rules} == {}


def plain_match(ids, names, gap=license_scan.GAP):
    """Whether the names stand in order among the ids (None: unknown), with at most `gap` unknown ones between two."""

    def at(i, k):
        if k == len(names):
            return True
        unknown = 0
        for j in range(i, len(ids)):
            if ids[j] == names[k] and at(j + 1, k + 1):
                return True
            if k and (ids[j] is not None or (unknown := unknown + 1) > gap):
                return False
        return False

    return at(0, 0)


def test_rules_are_matched_as_by_a_plain_matcher(spark):
    rng = random.Random(8)
    known = {"apache2-notice": "Licensed under the Apache License, Version 2.0;", "apache2-comply": "You may not use this file except in compliance with the License.", "apache2-copy": "You may obtain a copy of the License at http://x.org.", "mit-title": "The MIT License.", "mit-notice": "Released under MIT.", "copyright": "Copyright 2001 Foo."}
    known |= {"apache2-asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.', "reserved": "All rights reserved."}
    cases = []
    for d in range(150):
        ids = [rng.choice([*known, None, None]) for _ in range(rng.randrange(9))]
        if rng.random() < 0.5:
            ids += [x for name in ("apache2-notice", "apache2-comply", "apache2-copy", "apache2-asis") for x in (name, *[None] * rng.randrange(4))]
        cases.append((d, ids))
    rows = [(d, "\n\n".join(known.get(x, "Some words of no licence.") for x in ids)) for d, ids in cases]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, ids in cases:
        assert got[d].sentence_ids == [x for x in ids if x], ids
        hits = [(f, e, n) for f, e, n in license_scan.RULES if plain_match(ids, n)]
        want = {f"{f}:{e}" for f, e, n in hits if not any(len(m) > len(n) and o.split("-")[0] == f.split("-")[0] and any(m[i : i + len(n)] == n for i in range(len(m))) for o, _, m in hits)}
        assert set(got[d].rules) == want, ids


@pytest.mark.parametrize("head", ["", "Copyright (c) 2020 Some One\n"])
def test_public_texts(spark, head):
    rows = []
    for k, (_, paragraphs) in enumerate(TEXTS):
        wrapped = ["\n".join(textwrap.wrap(p, 72)) for p in paragraphs]
        forms = ["\n".join(paragraphs), "\n\n".join(wrapped), "\n *\n".join(" * " + w.replace("\n", "\n * ") for w in wrapped)]
        rows += [(10 * k + i, head + t) for i, t in enumerate(forms)]
    got = {r.doc_id: r.rules for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: r for d, r in got.items() if r != [TEXTS[d // 10][0]]} == {}
