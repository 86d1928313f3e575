"""Licence sentences in their canonical wording, as authors print it."""

import textwrap
import time

import duckdb
import pytest

from lakeloom.llm import licenses

AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.'
#: A canonical text for each entry of SENTENCES.
WORDING = {
    "ApacheRef": "Licensed under the Apache License, Version 2.0.",
    "ApacheUnder": 'Licensed under the Apache License, Version 2.0 (the "License"); you may read it.',
    "ApacheComply": 'Foo (the "License"); you may not use this file except in compliance with the License.',
    "ApacheCopy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "ApacheAsIs": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "ApacheLimits": "See the License for the specific language governing permissions and limitations under the License.",
    "MitRef": "This project is licensed under the MIT License.",
    "MitGrant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use it, subject to the following conditions:',
    "MitNotice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MitAsIs": AS_IS,
    "MitLiability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.",
    "GplRef3": "Released under the terms of the GNU General Public License v3.0.",
    "GplRef2": "This tool is distributed under the GNU General Public License, version 2.",
    "GplRedistribute3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GplRedistribute2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LgplRedistribute": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AgplRedistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GplHope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "GplDetails": "See the GNU General Public License for more details.",
    "GplReceived": "You should have received a copy of the GNU General Public License along with this program.",
    "BsdRef": "This code is licensed under a BSD-style license.",
    "BsdRef3": "This code is licensed under the 3-clause BSD license.",
    "BsdRef2": "Foo is released under the BSD 2-Clause License.",
    "BsdGoverned": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BsdPermit": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BsdSource": "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BsdBinary": "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.",
    "BsdEndorse": "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BsdAsIs": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED.',
    "BsdLiability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED.",
    "CcByNcRef": "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CcBySaRef": "This work is licensed under CC BY-SA 4.0.",
    "CcByRef": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "MplTerms": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MplCopy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "IscPermit": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "UnlicenseDedicate": "This is free and unencumbered software released into the public domain.",
    "EplTerms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "BoostRef": "Distributed under the Boost Software License, Version 1.0.",
    "ZlibAsIs": "This software is provided 'as-is', without any express or implied warranty.",
    "ZlibPermit": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "Cc0Dedicate": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "Cc0Ref": "This work is released under CC0 1.0 Universal.",
    "SpdxApacheMit": "SPDX-License-Identifier: MIT OR Apache-2.0",
    "SpdxApache": "SPDX-License-Identifier: Apache-2.0",
    "SpdxMit": "SPDX-License-Identifier: MIT",
    "SpdxGpl3": "SPDX-License-Identifier: GPL-3.0-or-later",
    "SpdxGpl2": "SPDX-License-Identifier: GPL-2.0-only",
    "SpdxBsd3": "SPDX-License-Identifier: BSD-3-Clause",
    "SpdxBsd2": "SPDX-License-Identifier: BSD-2-Clause",
    "SpdxAgpl3": "SPDX-License-Identifier: AGPL-3.0-only",
    "SpdxLgpl": "SPDX-License-Identifier: LGPL-2.1-or-later",
    "SpdxMpl2": "SPDX-License-Identifier: MPL-2.0",
    "SpdxEpl2": "SPDX-License-Identifier: EPL-2.0",
    "SpdxBoost": "SPDX-License-Identifier: BSL-1.0",
    "SpdxZlib": "SPDX-License-Identifier: Zlib",
    "SpdxIsc": "SPDX-License-Identifier: ISC",
    "SpdxCc0": "SPDX-License-Identifier: CC0-1.0",
    "SpdxUnlicense": "SPDX-License-Identifier: Unlicense",
    "SpdxOfl": "SPDX-License-Identifier: OFL-1.1",
    "SpdxCcByNcSa": "SPDX-License-Identifier: CC-BY-NC-SA-4.0",
    "SpdxCcByNcNd": "SPDX-License-Identifier: CC-BY-NC-ND-4.0",
    "SpdxCcByNc": "SPDX-License-Identifier: CC-BY-NC-4.0",
    "SpdxCcByNd": "SPDX-License-Identifier: CC-BY-ND-4.0",
    "SpdxCcBySa": "SPDX-License-Identifier: CC-BY-SA-3.0",
    "SpdxCcBy": "SPDX-License-Identifier: CC-BY-4.0",
    "OflTerms": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "MitTitle": "The MIT License (MIT)\n",
    "ApacheTitle": "Apache License\nVersion 2.0, January 2004\n",
    "IscTitle": "ISC License\n",
    "UnlicenseTitle": "The Unlicense\n",
    "BoostTitle": "Boost Software License - Version 1.0 - August 17th, 2003\n",
    "AgplRef": "It is available under the GNU AGPL v3.",
    "LgplRef": "This library is licensed under the GNU Lesser General Public License v2.1.",
    "MplRef": "Licensed under the terms of the Mozilla Public License 2.0.",
    "EplRef": "Published under the Eclipse Public License, version 2.0.",
    "IscRef": "This code is licensed under the ISC license.",
    "ZlibRef": "It is distributed under the zlib License.",
    "OflRef": "The fonts are released under the SIL Open Font License 1.1.",
    "UnlicenseRef": "Foo is released under the Unlicense.",
    "CcByNcSaRef": "The text is available under CC BY-NC-SA 4.0.",
    "CcByNcNdRef": "The text is available under CC BY-NC-ND 4.0.",
    "CcByNdRef": "Released under CC BY-ND 4.0.",
}


def scan(spark, texts):
    rows = licenses.licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [(x.sentence_ids, x.licenses) for x in sorted(rows, key=lambda x: x.doc_id)]


def test_canonical_wording(spark):
    assert set(WORDING) == {*licenses.SENTENCES, *licenses.NAMES, *licenses.SPDX, "SpdxApacheMit"}
    assert {i for _, ids in licenses.RULES for i in ids} <= set(WORDING)
    texts = [f"Some words before.\n\n{t}\nSome words after." if t[-1] == "\n" else f"Some words before. {t} Some words after." if t[-1] in ".:" else f"Some words before. {t}\nSome words after." for t in WORDING.values()]
    assert dict(zip(WORDING, (ids for ids, _ in scan(spark, texts)))) == {name: f"<{name}>" for name in WORDING}


def test_notices_across_marks(spark):
    notices = {
        ("GplRedistribute3", "GplHope", "GplDetails"): "GPL-3.0-or-later",
        ("GplRedistribute2", "GplHope", "GplDetails"): "GPL-2.0-or-later",
        ("LgplRedistribute", "GplHope"): "LGPL",
        ("MplTerms", "MplCopy"): "MPL-2.0",
        ("SpdxMit",): "MIT",
    }
    got = scan(spark, [" ".join(WORDING[i] for i in ids) for ids in notices])
    assert [x for _, x in got] == list(notices.values())
    assert scan(spark, ["Note; it is: licensed under the MIT license; really", "This is it. Foo is licensed under the MIT license", "we; have: the MIT", "Roe v. Wade. Licensed under CC BY 4.0."]) == [("<MitRef>", "MIT"), ("<MitRef>", "MIT"), ("", ""), ("<CcByRef>", "CC-BY")]


FULL = {
    ("MitGrant", "MitNotice", "MitAsIs", "MitLiability"): "MIT",
    ("BsdPermit", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs", "BsdLiability"): "BSD-3-Clause",
    ("BsdPermit", "BsdSource", "BsdBinary", "BsdAsIs"): "BSD-2-Clause",
    ("IscPermit",): "ISC",
    ("ApacheUnder", "ApacheComply", "ApacheCopy", "ApacheAsIs", "ApacheLimits"): "Apache-2.0",
    ("GplRedistribute3", "GplHope", "GplDetails", "GplReceived"): "GPL-3.0-or-later",
    ("MplTerms", "MplCopy"): "MPL-2.0",
    ("AgplRedistribute", "GplHope", "GplDetails", "GplReceived"): "AGPL-3.0-or-later",
    ("ZlibAsIs", "ZlibPermit"): "Zlib",
    ("Cc0Dedicate",): "CC0-1.0",
}
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'


@pytest.mark.parametrize("width", [34, 70, 80])
@pytest.mark.parametrize("prefix", ["", "    ", "# ", " * ", "// ", "-- ", "dnl ", "REM "])
def test_wrapped_texts(spark, width, prefix):
    def wrapped(ids):
        parts = [APACHE if i == "ApacheUnder" else WORDING[i] for i in ids if i != "ApacheComply"]
        lines = [line for t in parts for line in [*textwrap.wrap(t, width, break_long_words=False, break_on_hyphens=False), ""]]
        return "\n".join(["Copyright (c) 2020 Foo", *((prefix + line).rstrip() for line in ["", *lines])])

    got = scan(spark, [t for ids in FULL for t in (wrapped(ids), wrapped(ids).replace("\n", "\r\n"))])
    assert got == [("".join(f"<{i}>" for i in ids), got[2 * k][1]) for k, ids in enumerate(FULL) for _ in (0, 1)]
    assert [x for _, x in got] == [name for name in FULL.values() for _ in (0, 1)]


def test_one_line_references(spark):
    lines = ["Some heading\nLicensed under the MIT License\nby somebody else", "Released under the\nMIT License\n", "Words\n# SPDX-License-Identifier: MIT\n# Copyright Foo", "This is a list\n\nlicensed under the\n\nMIT licenses", "Permission is hereby\n\ngranted", "Licensed under CC BY 4.0\nReleased under the MIT License"]
    assert [x for _, x in scan(spark, lines)] == ["MIT", "MIT", "MIT", "", "", "MIT,CC-BY"]


def test_titles_that_run_into_the_licence(spark):
    titled = {"MitGrant": "MIT License Copyright (c) 2020 Foo", "BsdPermit": "Copyright (c) 2021, The Foo Authors", "IscPermit": "ISC License\nCopyright 2019 Foo"}
    texts = [f"{title} {' '.join(WORDING[i] for i in next(ids for ids in FULL if ids[0] == first))}" for first, title in titled.items()]
    assert [x for _, x in scan(spark, texts)] == ["MIT", "BSD-3-Clause", "ISC"]
    assert scan(spark, ["SPDX-License-Identifier: Apache-2.0 OR MIT\n", "SPDX-License-Identifier: MIT AND Foo"]) == [("<SpdxApacheMit>", "Apache-2.0 OR MIT"), ("", "")]


@pytest.mark.parametrize(
    "text, want",
    [
        ("This project is licensed under the MIT License - see the LICENSE.md file for details.", "MIT"),
        ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "Apache-2.0,MIT"),
        ("Licensed under the Apache-2.0 license.", "Apache-2.0"),
        ("Dual licensed under the MIT and GPL-2.0 licenses.", "MIT,GPL-2.0"),
        ("Released under GPLv3.", "GPL-3.0"),
        ("SPDX-License-Identifier: MIT AND BSD-3-Clause", "MIT,BSD-3-Clause"),
        ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0 OR Apache-2.0) AND CC-BY-SA-4.0 */", "Apache-2.0,GPL-2.0,CC-BY-SA"),
        ("SPDX-License-Identifier: GPL-2.0-or-later OR MIT", "MIT,GPL-2.0"),
        ("# MIT License\n\nCopyright (c) 2020 Foo", "MIT"),
        ("a licensed driver, released under the moon", ""),
        ("Frei verwendbar, available under mit Namen", "MIT"),  # a name is a name, whatever the language around it
    ],
)
def test_references_and_expressions(spark, text, want):
    assert scan(spark, [text])[0][1] == want


def test_gaps_of_any_length(spark):
    """Works, holders and copyright lines may be as long as they like; many beginnings of one phrase take linear time."""
    long = "Foo " * 500
    texts = [f"This {long} is free software{WORDING['GplRedistribute3'].split('software', 1)[1]}", f"3. Neither the name of {long} nor the names of its contributors{WORDING['BsdEndorse'].split('contributors', 1)[1]}", f"MIT License Copyright {long} {WORDING['MitGrant']}", f"To the extent possible under law, {long} have{WORDING['Cc0Dedicate'].split('have', 1)[1]}"]
    assert [ids for ids, _ in scan(spark, texts)] == ["<GplRedistribute3>", "<BsdEndorse>", "<MitGrant>", "<Cc0Dedicate>"]
    began = time.time()
    scan(spark, [piece * (400_000 // len(piece)) + " license" for piece in ("neither the name of a\n", "licensed under the ", "this\n", "licensed under mit or ", "in no event shall ", "permission is hereby granted ", "spdx license identifier mit and ")])
    assert time.time() - began < 60


def test_same_as_sql(spark):
    """The SQL, which ends sentences at line ends, agrees on one-line texts of every wording, together and alone."""
    texts = [*(t.strip().replace("\n", " ") for n, t in WORDING.items() if n not in ("GplRedistribute2", "GplRedistribute3", "LgplRedistribute", "AgplRedistribute", "GplHope", "MplTerms", "EplTerms", "BsdPermit", "ZlibPermit", "MitGrant", "ApacheComply", "ApacheUnder") and ";" not in t and ":" not in t), None, ""]
    rows = list(enumerate([*texts, "Licensed under either of Apache License, Version 2.0 or MIT license at your option. Some words. Released under CC BY 4.0."]))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.execute(licenses.OP4_SQL).fetchall()
    got = licenses.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(bool(x.licenses) for x in got) > 25
