"""Licences told apart by version, clause and family; statements that fit none, or several, name none."""

import pytest

from runlake.llm import licenses

TEXTS = {
    "Licensed under the GNU General Public License, version 2.": "GPL-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
    "Licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1",
    "Licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY 3.0.": "CC-BY-3.0",
    "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "ISC",
    "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Licensed under the BSD 2-Clause License.": "BSD-2-Clause",
    "Licensed under the BSD 3-Clause License.": "BSD-3-Clause",
    licenses._BSD: "BSD-2-Clause",
    licenses._BSD.replace(": ", ":\n").replace(". ", ".\n"): "BSD-2-Clause",
    next(t for n, t in licenses.TEMPLATES if n == "BSD-3-Clause" and t.startswith("Redis")): "BSD-3-Clause",
    "SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0",
    "SPDX-License-Identifier: MPL-2.0": "MPL-2.0",
    # no version, another version, no licence, or another kind of one
    "Licensed under the GNU General Public License.": None,
    "Licensed under CC BY 5.0.": None,
    "Licensed under the Apache License, Version 3.1.": None,
    "Copyright 2020 by the authors. All rights reserved.": None,
    "A licence to fish is sold at the harbour, to any person.": None,
    "The driving license was lost in the train to the north.": None,
    "": None,
    # versions with a v, licences that are not templates, negated statements and those of several licences
    "GNU Affero General Public License v3.0": "AGPL-3.0",
    "Licensed under the Apache License v2": "Apache-2.0",
    "Licensed under the Mozilla Public License v. 2.0": "MPL-2.0",
    "Licensed under the WTFPL version 2.": "WTFPL",
    "Licensed under the FOOPL version 2.": None,
    "Licensed under the Artistic License 2.0.": "Artistic-2.0",
    "Licensed under the SIL Open Font License, Version 1.1.": "OFL-1.1",
    "Licensed under the Common Development and Distribution License, Version 1.0": "CDDL-1.0",
    "This is not licensed under the Apache License, Version 2.0.": None,
    "the project was never released under the MIT License": None,
    "It is no longer distributed under the MIT License": None,
    "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0": "Apache-2.0",
    "Licensed under either of Apache License, Version 2.0 or MIT license": "Apache-2.0 OR MIT",
    "Dual licensed under the MIT License or the GNU General Public License, version 2.": "GPL-2.0 OR MIT",
    "SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0 OR MIT",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "GPL-3.0",
}


def test_licences_are_told_apart(spark):
    files = [(f"d{i}/x.txt", text) for i, text in enumerate(TEXTS)]
    filler = [(f"f{i}/y.txt", f"{' '.join(f'w{i}x{k}' for k in range(30))}\nsome license of number {i} in other words, see copyright page {i}") for i in range(40)]
    got = {r.path: r.licence for r in licenses.scan(spark.createDataFrame(files + filler, "path string, text string")).collect()}
    assert {text: got[f"d{i}/x.txt"] for i, text in enumerate(TEXTS)} == TEXTS
    assert all(got[p] is None for p, _ in filler)


def test_templates_are_bounded(spark):
    with pytest.raises(ValueError, match="templates"):
        licenses.scan(spark.createDataFrame([], "path string, text string"), [("a", "b")] * 10_001)


def test_a_very_long_text(spark):
    """A statement at the end of a text of 2 million words, and a line of as many."""
    long = " ".join(f"w{i % 5000}" for i in range(2_000_000))
    rows = [("a/x", f"{long}\nReleased under the MIT License."), ("b/x", f"license {long}"), ("c/x", None), ("c/x", ""), (None, "Released under the MIT License.")]
    got = {r.path: r.licence for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a/x": "MIT", "b/x": None, "c/x": None, None: None}
