"""Licence rules against the usual notices, wrapped and not, and the tables against what the cutter can make."""

import textwrap

import pytest

from sqltraffic.llm import license_scan

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."""
BSD2 = """Copyright (c) 2020, Some One. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
BSD3 = BSD2 + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS."""
ORGANISATION = BSD2 + "3. Neither the name of the University of California, Berkeley nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
GPL2 = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
LINUX = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License."
LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""
AGPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ZERO = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
ZLIB = "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""
UNLICENSE = "This is free and unencumbered software released into the public domain."
CC0 = "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."
EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"
GPL = """This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
NOTICES = [
    (MIT, ["MIT"]), (BSD2, ["BSD-2-Clause"]), (BSD3, ["BSD-3-Clause"]), (APACHE, ["Apache-2.0"]), (GPL.format(":", 3), ["GPL-3.0-or-later"]), (GPL.format(";", 2), ["GPL-2.0-or-later"]), (MPL, ["MPL-2.0"]),
    (ORGANISATION, ["BSD-3-Clause"]), (GPL2, ["GPL-2.0-or-later"]), (LINUX, ["GPL-2.0"]), (LGPL, ["LGPL-2.1-or-later"]), (AGPL, ["AGPL-3.0-or-later"]), (ISC, ["ISC"]), (ZERO, ["0BSD"]), (ZLIB, ["Zlib"]), (BOOST, ["BSL-1.0"]),
    (UNLICENSE, ["Unlicense"]), (CC0, ["CC0-1.0"]), (EPL, ["EPL-2.0"]),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", ["Apache-2.0", "MIT"]), ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) OR LGPL-2.1-or-later */\nint x;", ["GPL-2.0", "LGPL-2.1-or-later"]),
    ("The code is distributed under the MIT license.", ["MIT"]), ("This project is licensed under the terms of the MIT license.", ["MIT"]), ("It is not licensed under the MIT license.", []), ("We ship release v. 2.0. Soon.", []),
    ("SPDX-License-Identifier: MIT", ["MIT"]), ("x\n// SPDX-License-Identifier: GPL-2.0-or-later\n#include <a.h>", ["GPL-2.0-or-later"]),
    ("Prose without an end\nReleased under the MIT License.\nMore of it.", ["MIT"]), ("Er kommt mit! Und mit: mit. Mit", []), ("It is 2.0. Or later.", []), ("", []), (None, []),
]


def wrapped(text: str, prefix: str) -> str:
    lines = [w for line in text.split("\n") for w in (textwrap.wrap(line, 72) or [""])]
    return "\n".join(f"{prefix}{line}".rstrip() for line in lines)


@pytest.mark.parametrize("form", [lambda t: t, lambda t: wrapped(t, ""), lambda t: wrapped(t, "# "), lambda t: "/*\n" + wrapped(t, " * ") + "\n */"], ids=["plain", "wrapped", "hashed", "starred"])
def test_notices(spark, form):
    rows = [(i, t if t is None or not t.startswith(("Perm", "Copy", "Lice", "This", "To the")) else form(t), "clash") for i, (t, _) in enumerate(NOTICES)]
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, licenses string")).collect()
    got = {r["row"]["doc_id"]: r["licenses"] for r in found}
    assert got == {i: want for i, (_, want) in enumerate(NOTICES)}


def test_tables(spark):
    """Every key is a sentence that the cutter can make, and every identifier is in a rule."""
    keys = [*license_scan.SENTENCES, *license_scan.TAGS, *[b for _, b in license_scan.FOLLOWERS]]
    rows = spark.createDataFrame([(k,) for k in keys], "text string").select("text", license_scan.sentences(license_scan.F.col("text")).alias("s")).collect()
    assert all(r["s"] == [r["text"]] for r in rows)
    used = {i for _, needs in license_scan.RULES for i in needs}
    assert used == {*license_scan.SENTENCES.values(), *license_scan.TAGS.values(), *license_scan.FOLLOWERS.values()} - {license_scan.TAG_NAME}


def test_long_text(spark):
    text = "Ein Satz mit Wort. " * 60_000 + "Licensed under CC BY 4.0."
    row = license_scan.scan(spark.createDataFrame([(text,)], "text string")).first()
    assert row["licenses"] == ["CC-BY-4.0"] and row["sentence_ids"] == ["cc-by-grant"]


def test_identifiers_of_plain_prose(spark):
    """A version number, or a short word after a colon, is no licence's sentence by itself."""
    rows = [("release v. 2.0. It is: mit. either version 3 of the license or at your option any later version.",), ("Mozilla Public License v. 2.0",)]
    assert all(r["sentence_ids"] == [] for r in license_scan.scan(spark.createDataFrame(rows, "text string")).collect())
