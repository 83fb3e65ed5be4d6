"""SPDX expressions, several licences in one sentence, bodies of licences."""

from pyspark.sql import functions as F

from footreach.llm import license_scan

CASES = [
    ("SPDX-License-Identifier: MIT OR Apache-2.0", {"MIT:tag", "Apache-2.0:tag"}),
    ("// SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause */", {"GPL-2.0:tag", "BSD-3-Clause:tag"}),
    ("# SPDX-License-Identifier: LGPL-2.1-only", {"LGPL:tag"}),
    ("SPDX-License-Identifier: MPL-2.0", {"MPL-2.0:tag"}),
    ("SPDX-License-Identifier: BSD-2-Clause", {"BSD-2-Clause:tag"}),
    ("spdx-license-identifier: isc", {"ISC:tag"}),
    ("SPDX-License-Identifier: CC-BY-NC-SA-4.0 AND CC0-1.0", {"CC-BY-NC:tag", "CC0-1.0:tag"}),
    ("SPDX-License-Identifier: LicenseRef-Own", set()),
    ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", {"Apache-2.0:notice", "MIT:notice"}),
    ("Licensed under either of Apache License, Version 2.0 or the MIT license.", {"Apache-2.0:notice", "MIT:notice"}),
    ("This crate is dual-licensed under the MIT and Apache 2.0 licenses.", {"MIT:notice", "Apache-2.0:notice"}),
    ("Made available under the Eclipse Public License 2.0.", {"EPL-2.0:notice"}),
    ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", {"BSD:notice"}),
    ("Released under GPL-3.0-or-later.", {"GPL-3.0:notice"}),
    ("Distributed under the GNU GPL version 2 or any later version.", {"GPL-2.0:notice"}),
    ("The GNU General Public License is a free, copyleft license for software and other kinds of works.", {"GPL-3.0:body"}),
    ("By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.", {"GPL-2.0:body"}),
    ("This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation.", {"LGPL:body"}),
    ("THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (“AGREEMENT”).", {"EPL:body"}),
    ("Mozilla Public License Version 2.0", {"MPL-2.0:title"}),
    ("Creative Commons Attribution-ShareAlike 4.0 International Public License", {"CC-BY-SA:title"}),
    ("By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-NonCommercial 4.0 International Public License (\"Public License\").", {"CC-BY-NC:body"}),
    ("This is licensed under the cafeteria or the MIT license.", set()),
    ("We licensed under pressure and with MIT people.", set()),
]


def test_expressions_and_bodies(spark):
    rows = [(k, t, "own") for k, (t, _) in enumerate(CASES)]
    out = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, __has string"))
    got = {r.doc_id: r for r in out.collect()}
    assert {CASES[k][0]: set(r.rules) for k, r in got.items() if set(r.rules) != CASES[k][1]} == {}
    assert all(r["__has"] == "own" for r in got.values()) and out.where(F.col("n_licenses") != F.size("licenses")).count() == 0
