"""Known licences by the digest of their canonical text.

A text is made canonical before it is hashed: lower case, copyright notices out,
every other character than ASCII letters and digits a space, equivalent
spellings made one, single spaces. Whole documents, and single lines of them,
are then joined by digest to a catalogue of known licences and notices.
"""

from __future__ import annotations

import hashlib
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.base import arrow_map, hint_small, slices

# Words taken as equal to the word behind them.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog",
    "categorise": "categorize", "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite",
    "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling",
    "labour": "labor", "licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing",
    "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize",
    "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize",
    "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
    "noncommercial": "non commercial", "sublicence": "sublicense", "owner": "holder", "owners": "holders",
}
#: Words that go on a sentence behind "copyright" or an item "(c)" of a licence body; what else follows is a holder or a year.
BODY_WORDS = (
    "notices? holders? owners? ownership licen[cs]es? laws? statements? interests? rights? permissions? protections? treaty treaties disclaimers? "
    "infringement materials? works? claims? status terms conditions information patents? trademarks? and or in on of to for from as is are was "
    "be been that this these those which with within you your any all each such if under must may no not it its do does have has accompany "
    r"also doctrines the\ssoftware year\sname"
)
_HOLDER = rb"(?![^a-z0-9\n\x80-\xff]*(?:(?:" + BODY_WORDS.replace(" ", "|").encode() + rb")\b|$))"
COPYRIGHT_LINE = re.compile(rb"(?m)^[^a-z0-9\n]*(?:copyright\b" + _HOLDER + rb"|\(c\)" + _HOLDER + rb"|\xc2\xa9|all rights reserved)[^\n]*$")
#: Bytes other than ASCII letters, digits and line ends become spaces.
_PLAIN = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))


def _words(data: bytes) -> bytes:
    words = data.translate(_PLAIN).split()
    return b" ".join([_SPELT.get(w, w) for w in words])


_SPELT = {a.encode(): b.encode() for a, b in SPELLINGS.items()}


def canonical(text: str | None) -> str:
    """The canonical form; empty for a null text or one without ASCII letters and digits."""
    return _words(COPYRIGHT_LINE.sub(b"", (text or "").encode().lower())).decode()


def digest(canonical_text: str) -> str:
    return hashlib.sha256(canonical_text.encode()).hexdigest()


_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
"""
# Full texts of short public licences.
TEXTS = {
    "BSD-2-Clause": _BSD_2 + _BSD_END,
    "BSD-3-Clause": _BSD_2 + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission.
""" + _BSD_END,
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR
IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR
IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License.""",
}
#: Full texts of long licences, one file each named after the licence.
TEXT_FOLDER = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")
# Where the text behind the title lines of a file begins, and where parts that are often left out begin.
PARTS = {
    "Apache-2.0": ("TERMS AND CONDITIONS FOR USE", ["END OF TERMS AND CONDITIONS", "APPENDIX: How to apply"]),
    "CC0-1.0": ("Statement of Purpose", []),
    "GPL-2.0": (None, ["END OF TERMS AND CONDITIONS", "How to Apply These Terms"]),
    "GPL-3.0": (None, ["END OF TERMS AND CONDITIONS", "How to Apply These Terms"]),
    "MPL-2.0": ("1. Definitions", []),
}
# Usual title lines of a licence text.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero Clause BSD License", "BSD Zero Clause License (0BSD)", "Zero-Clause BSD License (0BSD)", "0BSD"],
    "Zlib": ["zlib License", "The zlib License", "zlib License (Zlib)", "zlib/libpng License", "The zlib/libpng License", "zlib"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "2-Clause BSD License", "Simplified BSD License",
                     'BSD 2-Clause "Simplified" License', "FreeBSD License", "BSD-2-Clause", "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "3-Clause BSD License", "New BSD License", "Modified BSD License",
                     'BSD 3-Clause "New" or "Revised" License', "BSD-3-Clause", "BSD License"],
    "Apache-2.0": ["Apache License\nVersion 2.0, January 2004\nhttps://www.apache.org/licenses/", "Apache License\nVersion 2.0, January 2004",
                   "Apache License, Version 2.0", "Apache License 2.0"],
    "CC0-1.0": ["Creative Commons Legal Code\nCC0 1.0 Universal", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License 2.0 (MPL-2.0)"],
}
# Names by which notices refer to licences.
NAMES = {
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0"],
    "MIT": ["the MIT License", "MIT License", "the MIT license", "MIT"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU GPL v2", "GPLv2"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU GPL v3", "GPLv3"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "the GNU LGPL v3", "LGPLv3"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "the GNU AGPL v3", "AGPLv3"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-clause BSD license"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-clause BSD license"],
    "MPL-2.0": ["the Mozilla Public License, Version 2.0", "the Mozilla Public License 2.0", "MPL 2.0"],
    "CC-BY-4.0": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "the CC0 1.0 Universal Public Domain Dedication"],
}
VERBS = ["Licensed under", "Released under", "Distributed under", "Available under", "This work is licensed under", "This project is licensed under",
         "This software is released under", "This file is licensed under"]


def full_texts(folder: str = TEXT_FOLDER) -> list[tuple[str, str]]:
    """(licence, text) of the built-in texts and the files of ``folder``, with and without title lines and parts often left out."""
    bodies = list(TEXTS.items())
    bodies += [(name, re.sub(r"(?m)^\d\. ", "* ", TEXTS[name])) for name in ("BSD-2-Clause", "BSD-3-Clause")]  # bullets
    whole = []
    for file in sorted(os.listdir(folder)):
        name = file.removesuffix(".txt")
        with open(os.path.join(folder, file), encoding="utf-8") as lines:
            text = lines.read()
        begin, cuts = PARTS.get(name, (None, []))
        for part in [text, *(text[:text.index(cut)] for cut in cuts)]:
            whole.append((name, part))
            if begin:
                bodies.append((name, part[part.index(begin):]))
    return whole + bodies + [(name, f"{title}\n\n{text}") for name, text in bodies for title in TITLES.get(name, [])]


def catalogue_entries() -> list[tuple[str, str]]:
    """(licence, canonical text) of the full texts and of the notices made from verbs and names."""
    entries = [(name, canonical(text)) for name, text in full_texts()]
    entries += [(name, canonical(f"{verb} {way}.")) for name, ways in NAMES.items() for way in ways for verb in VERBS]
    entries += [(name, canonical(f"SPDX-License-Identifier: {name}")) for name in NAMES]
    return sorted(set(entries))


def catalogue(spark: SparkSession, entries: list[tuple[str, str]] | None = None) -> DataFrame:
    """``license, digest, length`` of known canonical texts; a few hundred rows unless the caller brings more.

    A text under several names has the smallest of them.
    """
    rows = [(name, digest(text), len(text)) for name, text in (entries or catalogue_entries())]
    return spark.createDataFrame(rows, "license string, digest string, length int").groupBy("digest").agg(
        F.min("license").alias("license"), F.min("length").alias("length")).select("license", "digest", "length")


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, text_digest, license, n_notices, notices``.

    ``license`` is the licence whose canonical text the whole document is;
    ``notices`` are the distinct licences of lines whose canonical text is
    known, sorted and joined by commas, ``n_notices`` the number of such lines.
    Null and empty texts have the digest of the empty text and no licence. Rows
    that repeat stay. A line is hashed only if some known text has its canonical
    length, which loses none; whole texts are always hashed.
    """
    lengths = frozenset(r["length"] for r in known.select("length").distinct().collect())  # of the catalogue, not of the corpus
    longest = max(lengths, default=0)
    unit = pa.list_(pa.string())

    def line_digests(text: str) -> list[str]:
        out = []
        for line in text.encode().lower().split(b"\n"):
            if len(line) <= 8 * longest and not COPYRIGHT_LINE.match(line):
                words = _words(line)
                if words and len(words) in lengths:
                    out.append(hashlib.sha256(words).hexdigest())
            elif longest and len(line) > 8 * longest:  # mostly signs: long, but short when canonical
                words = _words(line)
                if words and len(words) in lengths and not COPYRIGHT_LINE.match(line):
                    out.append(hashlib.sha256(words).hexdigest())
        return out

    def work(batch: pa.RecordBatch):
        texts = batch.column(2).to_pylist()
        for begin, end in slices(texts):
            part = texts[begin:end]
            yield {
                "row": batch.column(0).slice(begin, end - begin), "doc_id": batch.column(1).slice(begin, end - begin),
                "text_digest": [digest(canonical(t)) for t in part], "lines": [line_digests(t) if t else [] for t in part],
            }

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    units = arrow_map(rows, work, "row long, doc_id long, text_digest string, lines array<string>",
                      pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_digest", pa.string()), ("lines", unit)]))
    lines = units.select("row", "doc_id", "text_digest", F.explode_outer("lines").alias("line"))
    notice = known.select(F.col("digest").alias("line"), F.col("license").alias("notice"))
    whole = known.select(F.col("digest").alias("text_digest"), "license")
    found = lines.join(hint_small(notice), "line", "left").groupBy("row", "doc_id", "text_digest").agg(
        F.count("notice").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("notice")), ",").alias("notices"))
    return found.join(hint_small(whole), "text_digest", "left").select("doc_id", "text_digest", "license", "n_notices", "notices")
