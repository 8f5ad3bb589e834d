"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation{} either version {} of the License"
_GNU_FILE = "Copyright (C) {} Free Software Foundation, Inc. {} Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."

#: Licence notices, headers, openings of long licences and whole short ones, the public texts that files hold; fixed values.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", _MIT),
    ("MIT", _MIT + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU.format(":", "", ",", 3)),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 " + _GNU_FILE.format(2007, "<https://fsf.org/>") + " Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL-2.0", _GNU.format(";", "", ";", 2)),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 " + _GNU_FILE.format("1989, 1991", "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA") + " Preamble The licenses for most software are designed to take away your freedom to share and change it."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _GNU.format(":", "Lesser ", ",", 3)),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 " + _GNU_FILE.format(2007, "<https://fsf.org/>") + " This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _GNU.format(":", "Affero ", ",", 3)),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 " + _GNU_FILE.format(2007, "<https://fsf.org/>") + " Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", _BSD + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_WARRANTY),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0"),
)
#: Cosine from which a window or a whole text counts as a template's.
THRESHOLD = 0.75
#: Names of files that hold a licence for their directory.
COVER_NAME = r"(?i)(?:^|/)(?:(?:un)?licen[cs]e|copying|copyright)(?:[._-][^/]*)?$"
#: Everyday words, which make poor anchors; a fixed list.
FREQUENT = frozenset("a all and any are as at be by for form from in is it may more not of on or other out that the their this to under use used with work you your code file files free copy following either provided possible".split())
#: Words of which any licence text holds one and other texts seldom do; a fixed list.
KEYWORDS = ("license", "licensed", "licence", "licenced", "permission", "redistribution", "copyright", "unencumbered")
_TERM = r"[a-z0-9][a-z0-9.+-]*[a-z0-9]|[a-z0-9]"


def terms_of(text: str) -> list[str]:
    import re

    return re.findall(_TERM, text.lower())


class Vectors:
    """The templates' TF-IDF vectors and what scoring needs of them: a few hundred numbers."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        bags = []
        for name, text in templates:
            bag: dict[str, int] = {}
            for t in terms_of(text):
                bag[t] = bag.get(t, 0) + 1
            bags.append((name, bag))
        n = len(bags)
        self.threshold = threshold
        self.unknown = log(1 + n)  # idf of a term that no template has
        self.idf = {t: log((1 + n) / (1 + sum(t in b for _, b in bags))) + 0.1 for t in {t for _, b in bags for t in b}}
        self.rows = []
        for name, bag in bags:
            norm = sqrt(sum((c * self.idf[t]) ** 2 for t, c in bag.items()))
            self.rows.append((name, {t: c * self.idf[t] / norm for t, c in bag.items()}))
        own = [self._anchors(vector) for _, vector in self.rows]
        self.anchors = sorted({a for xs in own for a in xs})
        #: Where windows are laid: for each anchor the templates that it is an anchor of, with its first place in them and their
        #: lengths in terms.
        self.places: dict[str, list[tuple[int, int, int]]] = {}
        for k, (_, text) in enumerate(templates):
            ts = terms_of(text)
            for a in own[k]:
                self.places.setdefault(a, []).append((k, ts.index(a), len(ts)))

    def _anchors(self, vector: dict[str, float]) -> list[str]:
        """The template's KEYWORDS, one of which a text must hold to count as like it.

        A template without any gets terms without which its remaining weights have a norm below the threshold; by Cauchy and
        Schwarz no text can have a larger cosine with it then.
        """
        if chosen := [t for t in KEYWORDS if t in vector]:
            return chosen
        first = sorted(vector, key=lambda t: (t in FREQUENT or t.isdigit(), -vector[t] if t in FREQUENT else -len(t), t))
        while sum(w * w for u, w in vector.items() if u not in chosen) >= (self.threshold * 0.999) ** 2:
            chosen.append(first[len(chosen)])
        return chosen


def _table(v: Vectors) -> Column:
    """Each known term's idf, its templates and its weights in them, as one literal map."""

    def row(t: str) -> str:
        held = [(k, vec[t]) for k, (_, vec) in enumerate(v.rows) if t in vec]
        return f"'{t}', named_struct('idf', {v.idf[t]!r}D, 'k', array({', '.join(str(k) for k, _ in held)}), 'w', array({', '.join(f'{w!r}D' for _, w in held)}))"

    # Lookups go through a literal map from its start, so everyday words come first.
    return F.expr(f"map({', '.join(row(t) for t in sorted(v.idf, key=lambda t: (t not in FREQUENT, t)))})")


def _entry(t: Column, table: Column, v: Vectors) -> Column:
    """A term's entry in the table, null for unknown terms, which a hashed set sorts out first."""
    return F.when(t.isin(sorted(v.idf)), F.element_at(table, t))


def _weight(x: Column, k: Column) -> Column:
    """The weight in template ``k`` of a term's entry."""
    return F.coalesce(F.get(x["w"], F.array_position(x["k"], k).cast("int") - 1), F.lit(0.0))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def _cosine(window: Column, k: Column, table: Column, v: Vectors) -> Column:
    """The cosine of a list of terms and template ``k``. Sorted terms come in runs, so one pass adds up the squares of the
    list's vector: the j-th of a run adds 2j - 1."""

    def add(a: Column, t: Column) -> Column:
        x = _entry(t, table, v)
        j = F.when(t == a["t"], a["j"] + 1).otherwise(F.lit(1))
        idf = F.coalesce(x["idf"], F.lit(v.unknown))
        return F.struct(t.alias("t"), j.alias("j"), (a["s"] + (2 * j - 1) * idf * idf).alias("s"), (a["d"] + idf * _weight(x, k)).alias("d"))

    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("j"), F.lit(0.0).alias("s"), F.lit(0.0).alias("d"))
    return F.aggregate(F.sort_array(window), start, add, lambda a: F.round(a["d"] / F.sqrt(a["s"]), 9))


def reach(ts: Column, table: Column, v: Vectors) -> Column:
    """For each template the squared weights of its terms that are among ``ts``. Their root bounds the cosine of any window, by
    Cauchy and Schwarz."""
    known = F.transform(F.filter(F.array_distinct(ts), lambda t: t.isin(sorted(v.idf))), lambda t: F.element_at(table, t))
    every = F.sequence(F.lit(0), F.lit(len(v.rows) - 1))
    return F.transform(F.array(known), lambda xs: F.transform(every, lambda k: F.aggregate(xs, F.lit(0.0), lambda a, x: a + _weight(x, k) * _weight(x, k))))[0]


def windows(ts: Column, reached: Column, v: Vectors) -> Column:
    """``array<struct<start,k,n>>``: for each anchor in the terms and each template that it is one of and that the terms can
    reach, the window of the template's length that the template would fill. Line breaks and comment marks are no terms, so
    wrapped headers are windows too. The whole text is a window for each template within reach, with ``start`` -1."""
    row = lambda a: f"'{a}', array({', '.join(f"named_struct('k', {k}, 'o', {o}, 'n', {n})" for k, o, n in v.places[a])})"
    places = F.expr(f"map({', '.join(row(a) for a in sorted(v.places))})")
    at = F.filter(F.transform(ts, lambda t, i: F.struct(i.alias("p"), t.alias("t"))), lambda x: x["t"].isin(v.anchors))
    able = lambda a: F.get(reached, a["k"]) >= (v.threshold * 0.999) ** 2
    laid = F.transform(at, lambda x: F.transform(F.filter(F.element_at(places, x["t"]), able), lambda a: F.struct(F.greatest(x["p"] - a["o"], F.lit(0)).alias("start"), a["k"].alias("k"), a["n"].alias("n"))))
    whole = F.transform(F.filter(F.sequence(F.lit(0), F.lit(len(v.rows) - 1)), lambda k: able({"k": k})), lambda k: F.struct(F.lit(-1).alias("start"), k.alias("k"), F.size(ts).alias("n")))
    return F.concat(F.array_distinct(F.flatten(laid)), whole)


def detect(files: DataFrame, v: Vectors, text: str = "text", path: str = "path") -> DataFrame:
    """``(path, score, licence, whole)`` of the files that hold a licence text: the best window, and whether the file as a
    whole is one. Windows rank by cosine less two over their length, as short notices are part of longer texts; of equals the
    first counts, then the first template. Repeated paths are one file with the best of all.

    Only files with an anchor can hold any. All is done in the row: the terms of one text and some 40 bytes for each window
    must fit in a task.
    """
    anchors = "(?i)(?<![a-z0-9])(?:" + "|".join(a.replace(".", r"\.").replace("+", r"\+") for a in v.anchors) + ")(?![a-z0-9])"
    near = files.select(F.col(path).alias("path"), F.col(text).alias("t")).filter(F.col("path").isNotNull() & F.col("t").rlike(anchors))
    table = _table(v)
    near = near.withColumn("ts", terms(F.col("t"))).withColumn("r", reach(F.col("ts"), table, v)).select("path", "ts", windows(F.col("ts"), F.col("r"), v).alias("ws"))
    names = F.array(*[F.lit(n) for n, _ in v.rows])

    def scored(w: Column) -> Column:
        score = _cosine(F.slice(F.col("ts"), F.greatest(w["start"], F.lit(0)) + 1, w["n"]), w["k"], table, v)
        return F.struct(score.alias("score"), (-w["start"]).alias("at"), (-w["k"]).alias("k"), w["n"].alias("n"))

    # A generator stands between scores and what is made of them, so that none is worked out twice.
    hits = near.select("path", F.explode(F.filter(F.transform("ws", scored), lambda x: x["score"] >= v.threshold)).alias("x")).select("path", "x.*")
    rank = F.struct(F.round(F.col("score") - 2 / F.col("n"), 9).alias("rank"), "at", "k", "score", F.get(names, -F.col("k")).alias("licence"))
    found = hits.groupBy("path").agg(F.max(F.when(F.col("at") <= 0, rank)).alias("b"), F.max(F.col("at") > 0).alias("whole"))
    return found.filter("b is not null").select("path", "b.score", "b.licence", "whole")


def licences(files: DataFrame, v: Vectors | None = None, text: str = "text", path: str = "path", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, path, licence, score, origin, from_path)`` for each row of ``files``.

    A file with a licence of its own (``origin`` own) is one with a window whose TF-IDF cosine with a template is
    THRESHOLD or more. Of these, one that is a licence text as a whole, or that has a licence file's name (COVER_NAME),
    covers its directory and all below; a file without a licence of its own takes the nearest cover (``inherited``, of
    several in a directory the best, then the smallest path). Others have nulls. Null texts and paths have none; repeated
    rows repeat; whole texts are scanned; an empty table gives an empty result; other columns are ignored.
    """
    v = v or Vectors()
    own = durable(detect(files, v, text, path))
    directory = F.regexp_replace("path", "/?[^/]*$", "")
    covers = own.filter(F.col("whole") | F.col("path").rlike(COVER_NAME)).groupBy(directory.alias("dir")).agg(F.min_by(F.struct("licence", "score", "path"), F.struct(-F.col("score"), "path")).alias("cover"))
    base = files.select(F.col(id_col).alias("doc_id"), F.col(path).alias("path"))
    direct = base.join(own.select("path", "licence", "score"), "path", "left")
    # Directories, not files, look for the nearest cover: each is a row with all its ancestors.
    dirs = base.filter("path is not null").select(directory.alias("d")).distinct()
    parts = F.split("d", "/")
    above = dirs.select("d", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("dir")).distinct()
    nearest = above.join(covers, "dir").groupBy("d").agg(F.max_by("cover", F.length("dir")).alias("cover"))
    out = direct.withColumn("d", directory).join(nearest, "d", "left")
    has = F.col("licence").isNotNull()
    pick = lambda c: F.when(has, F.col(c)).otherwise(F.col(f"cover.{c}"))
    return out.select("doc_id", "path", pick("licence").alias("licence"), pick("score").alias("score"), F.when(has, F.lit("own")).when(F.col("cover").isNotNull(), F.lit("inherited")).alias("origin"), F.when(has, F.col("path")).otherwise(F.col("cover.path")).alias("from_path"))
