"""Licence texts as they are set: wrapped, in comments, with list marks."""

import re
import textwrap

import pytest

from quotemill.llm import licenses
from tests.llm.test_llm import docs
from tests.oracle import connection, same

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of Foo Bar Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
GPL = """This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{1} either version {2} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 59 Temple Place."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
WANTED = {"MIT": MIT, "Apache-2.0": APACHE, "BSD-3-Clause": BSD, "BSD-2-Clause": BSD[: BSD.index("\n3.")], "GPL-3.0": GPL.format(":", ",", 3), "GPL-2.0": GPL.format(";", ";", 2), "MPL-2.0": MPL, "ISC": ISC}


def wrapped(text, width, mark):
    lines = []
    for part in text.split("\n"):
        lines += textwrap.wrap(part, width, subsequent_indent="   " if re.match(r"\d\.", part) else "") or [""]
    return "\n".join((mark + x).rstrip() for x in lines)


FORMS = [(10**6, ""), (78, ""), (60, " * "), (72, "# "), (66, "// "), (50, "    "), (70, "-- ")]


@pytest.fixture(scope="module")
def table(spark):
    texts = [wrapped(t, *f) for t in WANTED.values() for f in FORMS]
    texts += [t.replace("\n", "\r\n") for t in texts[::5]] + ["MIT License\n\n" + MIT, "/*\n * SPDX-License-Identifier: BSD-3-Clause\n */", "# SPDX-License-Identifier: GPL-2.0-or-later", "Some line\nLicensed under the MIT License\nnext line of text", "prose. licensed under the MIT license. more prose", None, "", "x" * 50000 + " license " + "y " * 30000]
    return docs(spark, *texts)


def test_licences_as_they_are_set(table):
    got = [r["licenses"] for r in licenses.scan_licenses(table).orderBy("doc_id").collect()]
    n = len(WANTED) * len(FORMS)
    assert got[:n] == [name for name in WANTED for _ in FORMS]
    assert got[n:-8] == got[:n:5]
    assert got[-8:] == ["MIT", "BSD-3-Clause", "GPL-2.0", "MIT", "MIT", "", "", ""]


NOTICES = [
    ("Copyright (c) 2020 Foo.\nAll rights reserved.\n\n" + BSD, "BSD-3-Clause"), ("All rights reserved.", "Proprietary"), ("Licensed under the MIT License, see the LICENSE file for details.", "MIT"), ("The MIT License (MIT)", "MIT"),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "Apache-2.0,MIT"), ("// SPDX-License-Identifier: (GPL-2.0-or-later OR (BSD-3-Clause AND ISC))", "BSD-3-Clause,GPL-2.0,ISC"), ("This library is licensed under the Apache 2.0 license.", "Apache-2.0"),
    ("This code is distributed under the terms of the MIT license.", "MIT"), ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "EPL-2.0"),
    ("Eclipse Public License - v 1.0", "EPL-1.0"), ("Licensed under the EUPL, Version 1.2", "EUPL"), ("European Union Public Licence v. 1.2", "EUPL"), ("Released under the 3-clause BSD License.", ""), ("distributed under the BSD 3-Clause License", "BSD"),
    ("the MIT licensed part of a sentence", ""), ("either this OR that AND more", ""), ("SPDX-License-Identifier: CC0-1.0 OR Unlicense OR Zlib", "CC0-1.0,Unlicense,Zlib"),
]


def test_notices_and_identifiers(spark):
    d = docs(spark, *(t for t, _ in NOTICES))
    assert [r["licenses"] for r in licenses.scan_licenses(d).orderBy("doc_id").collect()] == [w for _, w in NOTICES]


def test_licences_equal_sql(spark, table):
    import tests.conftest

    table = table.unionByName(docs(spark, *(t for t, _ in NOTICES)), allowMissingColumns=True)

    con = connection(tests.conftest.SF)
    rows = table.select("doc_id", "text").toPandas()
    con.execute("drop view if exists documents")
    con.register("documents", rows)
    same(licenses.scan_licenses(table), con, licenses.oracle())
