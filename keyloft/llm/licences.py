"""Licence scans: sparse TF-IDF cosine to templates, then inheritance by directory.

Every line that speaks of licensing, the paragraph around it and, for licence
files, the whole text are compared to the templates as sparse vectors, as they are
and in every stretch of a template's length, so that words beside a notice do not
count against it.  Templates are headers, title pages of the long licences, whole
texts of the short ones, and identifier lines.  Some terms, such as a version
number, decide between templates that are nearly alike: a stretch must hold them.

Document frequencies are counted over all files in one pass, for the terms of the
templates by themselves and for all others by one of ``BUCKETS`` hashes, so the
table does not grow with the corpus; terms that share a bucket count as at least as
frequent as they are.

A file without a licence of its own takes that of the nearest directory at or above
it that holds a licence file: each distinct directory is joined once with all
directories on its way up, and files then look up their directory.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import _STEP, FOLD, cut, raw_texts, release_memory, word_hashes, word_spans


@dataclass(frozen=True)
class Template:
    """A notice of a licence; a stretch must hold all of ``needs`` and none of ``bars``."""

    name: str
    text: str
    needs: str = ""
    bars: str = ""


_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial portions
of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_REST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following:"""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License."""
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_SHARED = """{0} is free software: you can redistribute it and/or modify it under the terms of the {1} as published by the Free
Software Foundation, either version {2} of the License, or (at your option) any later version."""
_GNU = [
    ("GPL-2.0", "GNU General Public License", "2", "Version 2, June 1991", "lesser affero library"),
    ("GPL-3.0", "GNU General Public License", "3", "Version 3, 29 June 2007", "lesser affero library"),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1", "Version 2.1, February 1999", ""),
    ("LGPL-3.0", "GNU Lesser General Public License", "3", "Version 3, 29 June 2007", ""),
    ("AGPL-3.0", "GNU Affero General Public License", "3", "Version 3, 19 November 2007", ""),
]
_CREATIVE = [
    ("CC-BY-4.0", "Attribution", "noncommercial sharealike noderivatives noncommercial nc sa nd"),
    ("CC-BY-SA-4.0", "Attribution-ShareAlike", "noncommercial nc"),
    ("CC-BY-ND-4.0", "Attribution-NoDerivatives", "noncommercial nc"),
    ("CC-BY-NC-4.0", "Attribution-NonCommercial", "sharealike noderivatives sa nd"),
    ("CC-BY-NC-SA-4.0", "Attribution-NonCommercial-ShareAlike", ""),
    ("CC-BY-NC-ND-4.0", "Attribution-NonCommercial-NoDerivatives", ""),
]
_IDENTIFIERS = [
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "Zlib", "BSL-1.0", "Unlicense", "CC0-1.0",
    "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", *(c[0] for c in _CREATIVE),
]


def _templates() -> list[Template]:
    """Licence names and the notices by which they are known."""
    made = [
        Template("MIT", "Released under the MIT License.", "mit"),
        Template("MIT", "Licensed under the MIT license. See the LICENSE file in the project root for full license information.", "mit"),
        Template("MIT", _MIT),
        Template("MIT", f"{_MIT} {_MIT_REST}"),
        Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2 0"),
        Template("Apache-2.0", _APACHE, "apache 2 0"),
        Template("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", "apache 2 0"),
        Template("BSD-2-Clause", f"{_BSD} {_BSD_REST}", "", "endorse"),
        Template("BSD-3-Clause", f"{_BSD} {_BSD_THIRD} {_BSD_REST}", "endorse"),
        Template("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "bsd"),
        Template("BSD-2-Clause", "Licensed under the BSD 2-Clause License.", "bsd 2"),
        Template("BSD-3-Clause", "Licensed under the BSD 3-Clause License.", "bsd 3"),
        Template("ISC", _ISC),
        Template("ISC", f"{_ISC} {_ISC_REST}"),
        Template("Zlib", _ZLIB),
        Template("BSL-1.0", _BOOST),
        Template("BSL-1.0", "Distributed under the Boost Software License, Version 1.0.", "boost 1 0"),
        Template("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered"),
        Template("Unlicense", _UNLICENSE, "unencumbered"),
        Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2 0"),
        Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mozilla 2 0"),
        Template("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions", "mozilla 2 0"),
        Template("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal.", "waived"),
        Template("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal", "cc0"),
    ]
    for name, title, version, published, bars in _GNU:
        made += [
            Template(name, f"This work is licensed under the {title}, version {version}.", version, bars),
            Template(name, f"Licensed under the {name.split('-')[0]} version {version}.", f"{name.split('-')[0]} {version}"),
            Template(name, _SHARED.format("This library" if "Lesser" in title else "This program", title, version), version, bars),
            Template(name, f"{title} {published} Copyright (C) Free Software Foundation, Inc. {_VERBATIM}", version, bars),
        ]
    for name, title, bars in _CREATIVE:
        made += [
            Template(name, f"Licensed under {name.replace('CC-', 'CC ').replace('-4.0', ' 4.0')}.", name, bars),
            Template(name, f"This work is licensed under a Creative Commons {title} 4.0 International License.", f"{title} 4 0", bars),
        ]
    return made + [Template(name, f"SPDX-License-Identifier: {name}", name) for name in _IDENTIFIERS]


TEMPLATES = _templates()

#: A line must hold one of these to be compared.
CUES = re.compile(rb"licen[sc]|copyright|permission is |permission to use|redistribut|public domain|spdx|\bcc0|\bcc by|free software|mozilla public|provided 'as-is'")
TERM = re.compile(rb"[a-z0-9\x80-\xff]+")
BREAK = re.compile(rb"\n[ \t\r]*\n")
LEAST = 0.8
#: Slots in which terms that no template has are counted.
BUCKETS = 1 << 16
#: Bytes of text counted at once.
SLICE = 4_000_000
#: Weights of terms that a task remembers.
REMEMBERED = 200_000
_OUTSIDE = np.array([TERM.match(bytes([b])) is None for b in range(256)])


def terms_of(raw: bytes) -> list[bytes]:
    return TERM.findall(raw.translate(FOLD))


def vocabulary() -> list[bytes]:
    return sorted({t for made in TEMPLATES for t in terms_of(made.text.encode())})


def term_hash(term: bytes) -> int:
    """What :func:`word_hashes` gives a term."""
    wrap, h = (1 << 64) - 1, 0
    for b in reversed(term):
        h = (h * _STEP + b + 1) & wrap
    for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> 33)) * by & wrap
    return h ^ (h >> 33)


@dataclass
class Frequencies:
    """Number of files, and of those that hold each template term or a term of each bucket."""

    files: int
    terms: dict[bytes, int] = field(default_factory=dict)
    buckets: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.int64))

    def idf(self, term: bytes) -> float:
        n = self.terms.get(term)
        if n is None:
            n = int(self.buckets[term_hash(term) >> 48])
        return math.log((self.files + 1) / (n + 1)) + 1


def document_frequencies(files: DataFrame, text_col: str) -> Frequencies:
    """Counts over all files; the driver sees one number for each template term and bucket."""
    terms = vocabulary()
    hashes = np.array([term_hash(t) for t in terms], np.uint64)
    by = np.argsort(hashes)
    hashes, terms = hashes[by], [terms[i] for i in by]
    slots = len(terms) + BUCKETS

    def count(batches):
        held, n = np.zeros(slots, np.int64), 0

        def flush(texts: list[bytes]) -> None:
            buf = np.frombuffer(b" ".join([*texts, b""]).translate(FOLD), np.uint8)
            starts, ends = word_spans(buf, _OUTSIDE)
            doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
            own = word_hashes(buf, starts, ends)
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            slot = np.where(hashes[at] == own, at, len(terms) + (own >> np.uint64(48)).astype(np.int64))
            key = np.sort(doc * slots + slot)
            key = key[np.r_[True, key[1:] != key[:-1]][: len(key)]]
            held[:] += np.bincount(key % slots, minlength=slots)

        for batch in batches:
            texts, size = [], 0
            for raw in raw_texts(batch.column(0)):
                n += 1
                texts.append(raw or b"")
                size += len(texts[-1])
                if size >= SLICE:
                    flush(texts)
                    texts, size = [], 0
            flush(texts)
        release_memory()
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *seen], pa.int32()), pa.array([n, *held[seen]], pa.int64())], ["slot", "n"])

    rows = files.select(files[text_col].cast("string").alias("t")).mapInArrow(count, "slot int, n long")
    found = Frequencies(0, dict.fromkeys(terms, 0))
    for r in rows.groupBy("slot").agg(F.sum("n").alias("n")).collect():
        if r["slot"] < 0:
            found.files = r["n"]
        elif r["slot"] < len(terms):
            found.terms[terms[r["slot"]]] = r["n"]
        else:
            found.buckets[r["slot"] - len(terms)] = r["n"]
    return found


class Matcher:
    """Cosines of stretches of a text to every template."""

    def __init__(self, frequencies: Frequencies):
        self.frequencies = frequencies
        self.known: dict[bytes, float] = {}
        self.templates: list[tuple[str, int, dict[bytes, float], frozenset, frozenset]] = []
        self.postings: dict[bytes, list[tuple[int, float]]] = {}
        for i, made in enumerate(TEMPLATES):
            terms = terms_of(made.text.encode())
            weights = self._weights(terms)
            needs, bars = (frozenset(terms_of(x.encode())) for x in (made.needs, made.bars))
            self.templates.append((made.name, len(terms), weights, needs, bars))
            for t, w in weights.items():
                self.postings.setdefault(t, []).append((i, w))

    def _idf(self, term: bytes) -> float:
        found = self.known.get(term)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[term] = self.frequencies.idf(term)
        return found

    def _weights(self, terms: list[bytes]) -> dict[bytes, float]:
        raw = {t: (1 + math.log(c)) * self._idf(t) for t, c in Counter(terms).items()}
        size = math.sqrt(sum(w * w for w in raw.values())) or 1.0
        return {t: w / size for t, w in raw.items()}

    def best(self, raw: bytes) -> tuple[float, str]:
        """The greatest cosine to a template of the text or of a stretch of it, and that template's licence."""
        scores: dict[int, float] = {}
        most: dict[int, float] = {}
        terms = terms_of(raw)
        held = set(terms)
        for t, w in self._weights(terms).items():
            for i, v in self.postings.get(t, ()):
                scores[i] = scores.get(i, 0.0) + v * w
                most[i] = most.get(i, 0.0) + v * v
        for i in scores:
            _, _, _, needs, bars = self.templates[i]
            if not needs <= held:
                scores[i] = most[i] = 0.0
            elif bars & held:
                scores[i] = 0.0
        top = max(scores.values(), default=0.0)
        for i in sorted(most, key=most.get, reverse=True):
            # No stretch is nearer than the terms that it shares allow.
            if math.sqrt(most[i]) < max(top - 1e-12, 1e-12):
                break
            scores[i] = max(scores[i], self._stretch(terms, i))
            top = max(top, scores[i])
        if not top:
            return 0.0, ""
        return top, min(self.templates[i][0] for i, s in scores.items() if s >= top - 1e-12)

    def _stretch(self, terms: list[bytes], i: int) -> float:
        """The best cosine to template ``i`` of as many terms in a row as it has."""
        _, length, vector, needs, bars = self.templates[i]
        if len(terms) <= length:
            return 0.0
        held: Counter = Counter()
        dot = square = best = 0.0

        def change(t: bytes, by: int) -> tuple[float, float]:
            idf = self._idf(t)
            was = (1 + math.log(held[t])) * idf if held[t] else 0.0
            held[t] += by
            now = (1 + math.log(held[t])) * idf if held[t] else 0.0
            return (now - was) * vector.get(t, 0.0), now * now - was * was

        for at, t in enumerate(terms):
            moves = [change(t, 1)] + ([change(terms[at - length], -1)] if at >= length else [])
            dot, square = dot + sum(m[0] for m in moves), square + sum(m[1] for m in moves)
            if at >= length - 1 and dot > best * math.sqrt(square) and all(held[x] for x in needs) and not any(held[x] for x in bars):
                best = dot / math.sqrt(square)
        return min(best, 1.0)

    def scan(self, raw: bytes | None, whole: bool) -> tuple[float, str]:
        """The best score of any line or paragraph with a cue, and of the text if ``whole``."""
        if not raw or not CUES.search(low := raw.translate(FOLD)):
            return 0.0, ""
        found = [self.best(raw)] if whole else []
        for part in BREAK.split(low):
            lines = [x for x in part.split(b"\n") if CUES.search(x)]
            if lines:
                found += [self.best(x) for x in lines]
                if b"\n" in part:
                    found.append(self.best(part))
        return max(found, key=lambda f: (f[0], f[1]), default=(0.0, ""))


def scan_licences(
    files: DataFrame, *, path_col: str = "path", text_col: str = "text", keep: list[str], least: float = LEAST
) -> DataFrame:
    """The licence of every file: its own, or its nearest licensed directory's.

    A licence file is one whose name begins with LICENSE, LICENCE or COPYING, in
    either case.  Returns the columns ``keep``, ``license``, ``score`` (cosine of
    the own or inherited notice), ``origin`` (``own``, ``directory`` or ``none``)
    and ``found_in`` (the directory).

    Null and empty texts have no licence of their own.  A null path is no
    directory and inherits nothing.  Where a directory holds several licence
    files, the best score counts, then the name in code-point order.  Repeated
    rows are each kept.  An empty table gives an empty result.  Very long texts are
    read whole; a line or paragraph takes time in proportion to its length for each
    template that shares most of its terms.  A column of ``keep`` that is called as one
    of the result hides it; other columns are ignored.
    """
    kept = [F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)]
    frequencies = document_frequencies(files, text_col)
    base = files.select(*[files[c].alias(f"_keep{i}") for i, c in enumerate(keep)], files[path_col].cast("string").alias("_path"), files[text_col].cast("string").alias("_t"))
    named = F.regexp_replace("_path", "^.*/", "").rlike("(?i)^(licen[sc]e|copying)")
    base = base.withColumn("_file", F.coalesce(named, F.lit(False)))
    place = F.when(F.col("_path").isNotNull(), F.regexp_extract("_path", "^(.*)/[^/]*$", 1))

    @F.arrow_udf("struct<score:double,name:string>")
    def scan(texts: pa.Array, whole: pa.Array) -> pa.Array:
        matcher = Matcher(frequencies)
        found = [matcher.scan(raw, w) for raw, w in zip(raw_texts(texts), whole.to_pylist(), strict=True)]
        rows = [{"score": s, "name": name} for s, name in found]
        return pa.array(rows, pa.struct([("score", pa.float64()), ("name", pa.string())]))

    base = base.withColumn("_dir", place).withColumn("_own", scan("_t", "_file"))
    base = cut(base.drop("_t").withColumn("_has", F.col("_own.score") >= least))
    given = (
        base.filter("_has AND _file AND _dir IS NOT NULL")
        .groupBy(F.col("_dir").alias("_at"))
        .agg(F.min(F.struct((-F.col("_own.score")).alias("s"), F.col("_own.name").alias("name"))).alias("_g"))
    )
    dirs = base.filter("NOT _has AND _dir IS NOT NULL").select("_dir").distinct()
    steps = F.split("_dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, 1, k), "/").alias("_at")))
    way = dirs.select("_dir", F.inline(up))
    met = way.join(given, "_at").groupBy("_dir").agg(F.max(F.struct("depth", "_at", "_g")).alias("_n"))
    near = met.select(F.col("_dir").alias("_d"), F.col("_n._at").alias("_from"), F.col("_n._g.name").alias("_name"), (-F.col("_n._g.s")).alias("_score"))
    out = base.join(near, ~F.col("_has") & (F.col("_dir") == F.col("_d")), "left")
    has, got = F.col("_has"), F.col("_name").isNotNull()
    found = {
        "license": F.when(has, F.col("_own.name")).otherwise(F.col("_name")),
        "score": F.when(has, F.col("_own.score")).otherwise(F.col("_score")),
        "origin": F.when(has, F.lit("own")).when(got, F.lit("directory")).otherwise(F.lit("none")),
        "found_in": F.when(has, F.col("_dir")).otherwise(F.col("_from")),
    }
    return out.select(*kept, *[column.alias(c) for c, column in found.items() if c not in keep])
