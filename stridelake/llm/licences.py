"""Licence scan: canonical digests of entire texts, joined to the digests of known licences."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Equivalent spellings.
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sub-license": "sublicense", "sub-licence": "sublicense", "non-commercial": "noncommercial", "per cent": "percent", "copyright owner": "copyright holder", "favour": "favor", "whilst": "while", "wilful": "willful", "https": "http"}
#: Lines that begin so are copyright lines.
COPYRIGHT = r"^\s*(copyright\b|\(c\)|©|all rights reserved\b).*"
COPYRIGHT_MARKS = ["copyright", "(c)", "©", "all rights reserved"]
#: Numbers and letters of list items at the start of a line, after what marks comments. (Bullets go with all other punctuation.)
LIST_MARK = r"^[ \t#*/;>%-]*\(?(?:[0-9]{1,2}|[a-z]|[ivx]{2,4})[.)][ \t]+"

#: Names of known licences with their SPDX identifiers.
NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "MPL-1.1": ["Mozilla Public License, version 1.1", "Mozilla Public License 1.1"],
    "GFDL-1.2": ["GNU Free Documentation License, version 1.2"],
    "GFDL-1.3": ["GNU Free Documentation License, version 1.3"],
    "ISC": ["ISC License"],
    "Zlib": ["zlib License"],
    "Unlicense": ["Unlicense"],
    "0BSD": ["BSD Zero Clause License"],
    "EPL-2.0": ["Eclipse Public License 2.0"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero v1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0"],
}
#: Names that are titles only.
OTHER_TITLES = {
    "MIT": ["Expat License", "MIT/X11 License"],
    "BSD-2-Clause": ["2-Clause BSD License", "BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["3-Clause BSD License", "BSD License", "Modified BSD License", "Revised BSD License"],
    "0BSD": ["Zero-Clause BSD License"],
    "Unlicense": ["Unlicense License"],
    "Apache-2.0": ["Apache License"],
}
#: How a name stands as the title above its text.
TITLES = ["{title}", "The {title}", "{title} ({spdx})", "The {title} ({spdx})", "{spdx}", "{spdx} License"]
#: Sentences that state a licence in full.
STATEMENTS = ["{}", "Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under the {}", "This work is licensed under {}", "This work is licensed under the {}", "This work is licensed under a {}", "This project is licensed under the {}", "This software is licensed under the {}", "This file is licensed under the {}", "Available under the {}"]

#: Entire licence texts.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}
TEXTS["BSD-3-Clause"] = TEXTS["BSD-2-Clause"].replace("\nTHIS SOFTWARE", "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE")
#: Canonical digests of further entire texts, as their stewards publish them (fixed values).
FULL_DIGESTS = {
    "Apache-2.0": "5aa38c82e3cf609fe9cbf1b2e38ec16cd0a5881447e1ec7ea521aac59da44fa4",
    "Artistic-1.0-Perl": "b1a9ec4dc608aa9f60e07ac63787b043bbaf8d6102bb31211bc28b37db53d680",
    "CC0-1.0": "fc3b7547cd22a69f533f8dc61ce0b9bba032990bd8d72935ddd5cf7045643f54",
    "GFDL-1.2": "cb41be315270be4de3aab4347a046343c85a15be3fa5c5fb0f59abe8d307c6d5",
    "GFDL-1.3": "6f3c80221c68938b81371b93dba56f5b155421852b2c28b2ef1e3346667cd2c3",
    "GPL-1.0": "ac910954c3184907f3947de0193b0169b8c69656ff2de7f3330438f6ba4fb746",
    "GPL-2.0": "ee5d645c4102ec1c01601b86811e81d82a2cab7e2cd2206a19487ff2a7783487",
    "GPL-3.0": "95635aaae63ecaf75c32ccc115236141e5767e8958dfed4292fe66691c4e9e84",
    "LGPL-2.0": "7f934b495d440a23de8cdb321dfda76c31219acc4bcba0288a3dbfc336dedd9a",
    "LGPL-2.1": "b92b914a2d829dd7a7d3d46ebcc569adfadbf6cb2df97d695934196353a55167",
    "LGPL-3.0": "cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45",
    "MPL-1.1": "05e230fb3903daa7bacb63df4e9f5d53481cc06aceb4e8eb1e071083eb69798a",
    "MPL-2.0": "2679d8adefa007797fdba64dfa8f0dc1d11981245c546ba2d9c2b2ea7341fd3e",
}
#: Families whose identifiers come with these endings too.
FAMILIES, ENDINGS = ("GPL-", "LGPL-", "AGPL-", "GFDL-"), ("-only", "-or-later")
#: Most known digests that a broadcast may hold.
MOST_KNOWN = 20_000

_SPELLED = [(rf"\b{re.escape(a)}\b", b) for a, b in SPELLINGS.items()]


def canonical_text(text: str) -> str:
    """The canonical form in plain Python, for the known texts (tests hold it against the column form)."""
    lines = [line for line in text.lower().split("\n") if not re.match(COPYRIGHT, line)]
    joined = re.sub(LIST_MARK, "", "\n".join(lines), flags=re.MULTILINE).replace("\n", " ")
    for a, b in _SPELLED:
        joined = re.sub(a, b, joined)
    return re.sub(r"[^a-z0-9\u0080-\U0010FFFF]+", " ", joined).strip(" ")


def _digest(canonical: str) -> str:
    return hashlib.sha256(canonical.encode()).hexdigest()


def known_digests(texts: dict[str, str] | None = None, names: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Digest to SPDX identifier, of whole texts and of every statement of every name."""
    names = NAMES if names is None else names
    found = {}
    for spdx, titles in names.items():
        for title in titles:
            for statement in STATEMENTS:
                found.setdefault(_digest(canonical_text(statement.format(title))), spdx)
        for name in [spdx, *(spdx + e for e in ENDINGS if spdx.startswith(FAMILIES))]:
            found.setdefault(_digest(canonical_text(f"SPDX-License-Identifier: {name}")), spdx)
            found.setdefault(_digest(canonical_text(f"License: {name}")), spdx)
    if texts is None:
        found.update({d: spdx for spdx, d in FULL_DIGESTS.items()})
    for spdx, text in (TEXTS if texts is None else texts).items():
        found[_digest(canonical_text(text))] = spdx
        for title in [t.format(title=name, spdx=spdx) for name in [*names.get(spdx, []), *OTHER_TITLES.get(spdx, [])] for t in TITLES]:
            found[_digest(canonical_text(f"{title}\n{text}"))] = spdx
    return found


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, no numbers of list items, one spelling, words of letters and digits with one space between them.

    Substring tests, far cheaper than the patterns, tell which texts the patterns can change at all.
    """

    def bound(value: Column, use: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(value), use)[0]

    def some(x: Column, parts: list[str]) -> Column:
        least = [p for p in parts if not any(q != p and q in p for q in parts)]
        return reduce(or_, [F.contains(x, F.lit(p)) for p in least])

    def without_copyright(x: Column) -> Column:
        lines = F.filter(F.split(x, "\n"), lambda line: ~line.rlike(COPYRIGHT))
        return F.when(some(x, COPYRIGHT_MARKS), F.array_join(lines, "\n")).otherwise(x)

    def without_list_marks(x: Column) -> Column:
        return F.replace(F.regexp_replace(x, f"(?md){LIST_MARK}", ""), F.lit("\n"), F.lit(" "))

    def spelled(x: Column) -> Column:
        out = x
        for a, b in SPELLINGS.items():
            out = F.regexp_replace(out, rf"\b{re.escape(a)}\b", b)
        return F.when(some(x, list(SPELLINGS)), out).otherwise(x)

    joined = bound(without_list_marks(bound(F.lower(text), without_copyright)), spelled)
    return F.trim(F.regexp_replace(joined, "[^a-z0-9\\x{80}-\\x{10FFFF}]+", " "))


def scan_licences(docs: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """One row per document: ``doc_id, licence`` (of the entire text, else null), ``n_lines`` (lines that state a licence in full) and
    ``licences`` (all found, sorted, comma-joined; empty if none).

    Null and empty texts have none. Every row has findings of its own, also where its id is null or repeated; an empty table gives no rows; very
    long texts are digested whole; other columns are not looked at. The known digests are a
    fixed table, broadcast after a check of its size; more than MOST_KNOWN of them are joined by shuffle.
    """
    known = known_digests() if known is None else known
    table = docs.sparkSession.createDataFrame(sorted(known.items()) or [("", "")], "__digest string, __spdx string")
    table = F.broadcast(table) if len(known) <= MOST_KNOWN else table
    # a row's units stay in its task, so its findings meet again before the shuffle and need no join back
    rows = docs.select(F.col("doc_id").alias("__id"), F.monotonically_increasing_id().alias("__doc"), "text")
    part = lambda whole, c: F.struct(F.lit(whole).alias("whole"), c.alias("part"))
    lines = F.when(F.contains("text", F.lit("\n")), F.transform(F.split("text", "\n"), lambda x: part(False, x))).otherwise(F.array(part(False, F.col("text"))))
    units = rows.select("__id", "__doc", F.explode(F.when(F.col("text").isNull(), F.array(part(True, F.lit(None).cast("string")))).otherwise(F.concat(F.array(part(True, F.col("text"))), lines))).alias("u"))
    units = units.select("__id", "__doc", "u.whole", F.sha2(canonical(F.col("u.part")), 256).alias("__unit"))
    hits = units.join(table, F.col("__unit") == F.col("__digest"), "left").filter(F.col("whole") | F.col("__spdx").isNotNull())
    found = hits.groupBy("__doc", "__id").agg(F.min(F.when(F.col("whole"), F.col("__spdx"))).alias("licence"), F.count_if(~F.col("whole")).alias("n_lines"), F.array_join(F.array_sort(F.collect_set("__spdx")), ",").alias("licences"))
    return found.select(F.col("__id").alias("doc_id"), "licence", "n_lines", "licences")
