"""Licence texts as they stand in files: titles, list items, comment signs; and the fixed digests against the files of a licence folder."""

import hashlib
import os
import re

import duckdb
import pandas as pd
import pytest

from stridelake.llm import licences
from stridelake.llm.oracle import ORACLES

FOLDER = "/usr/share/common-licenses"
FILES = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
HOLDER = "Copyright (c) 2024 Ada Runner\nAll rights reserved.\n\n"


def wrapped(text, width):
    return "\n".join(re.sub(rf"(.{{1,{width}}})( |$)", r"\1\n", line).rstrip() for line in text.split("\n"))


def cases():
    mit, bsd2, bsd3, zlib = (licences.TEXTS[k] for k in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "Zlib"))
    marks = lambda t, form: re.sub(r"(?m)^(\d)\. ", lambda m: form(int(m[1])), t)
    return [
        ("The MIT License (MIT)\n\n" + HOLDER + wrapped(mit, 70), "MIT"),
        ("MIT License\n\n" + HOLDER + mit, "MIT"),
        ("The Expat License\n\n" + mit, "MIT"),
        ("\n".join(f" * {x}" for x in ("The MIT License\n" + mit).split("\n")), "MIT"),
        (HOLDER + marks(bsd3, lambda k: "* "), "BSD-3-Clause"),
        ("BSD 3-Clause License\n\n" + HOLDER + marks(bsd3, lambda k: "  * "), "BSD-3-Clause"),
        ("The 3-Clause BSD License\n" + HOLDER + marks(bsd3, lambda k: f"({k}) "), "BSD-3-Clause"),
        ("BSD License\n" + HOLDER + marks(bsd2, lambda k: f"{'abc'[k - 1]}) "), "BSD-2-Clause"),
        (HOLDER + marks(bsd2, lambda k: f"# {'i' * k}. " if k > 1 else "# 1) "), "BSD-2-Clause"),
        ("zlib License\n" + marks(zlib, lambda k: f"  {k}) "), "Zlib"),
        ("SPDX-License-Identifier: GFDL-1.3-or-later", "GFDL-1.3"),
        ("GNU General Public License, version 3", "GPL-3.0"),
        ("GNU General Public License, version 2", "GPL-2.0"),
        (mit + "\nAnd one more condition.", None),
        ("The MIT License (MIT)\n\nAnother text.", None),
        ("1. \n2. ", None),
        ("", None),
        (None, None),
    ]


def test_titles_and_list_items(spark):
    table = pd.DataFrame({"doc_id": range(len(cases())), "text": [t for t, _ in cases()]})
    got = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases())], "doc_id long, text string")).collect()}
    assert [got[i].licence for i in range(len(cases()))] == [want for _, want in cases()]
    with duckdb.connect() as con:
        con.register("documents", table)
        rows = con.execute(ORACLES["op7_licences"]).fetchall()
    assert {r[0]: r[1:] for r in rows} == {i: (r.licence, r.n_lines, r.licences) for i, r in got.items()}


def test_column_form_equals_plain_form(spark):
    texts = [t for t, _ in cases() if t is not None] + ["1. a\r\n2. b  3. c\u0085 4. d", "12) x\n123) y\nxiv. z\n(c) 2020 me\nq. (a) b", "é. 1. a\n\n  -- 2. b"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", licences.canonical("t").alias("c")).collect()
    assert {r.i: r.c for r in rows} == {i: licences.canonical_text(t) for i, t in enumerate(texts)}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no licence files here")
def test_fixed_digests_are_those_of_the_licence_files():
    seen = set()
    for file, spdx in FILES.items():
        if os.path.exists(f"{FOLDER}/{file}"):
            with open(f"{FOLDER}/{file}", encoding="utf8") as f:
                text = f.read()
            assert hashlib.sha256(licences.canonical_text(text).encode()).hexdigest() == licences.FULL_DIGESTS[spdx], file
            seen.add(spdx)
    assert seen <= set(licences.FULL_DIGESTS)
