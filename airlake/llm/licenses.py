"""License scans by TF-IDF cosine to templates, with inheritance from the nearest directory; built-in functions only."""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlake.llm.common import empty_if_null

#: Short notices, by which licences are named in a line.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions:"
)
_MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.\n\n"
)
_BSD_REST = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free "
    "Software Foundation, either version {2} of the License, or (at your option) any later version.\n\n"
    "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
    "FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details."
)
#: Standard headers of source files.
HEADERS = [
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\n\n"
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing '
        "permissions and limitations under the License.",
    ),
    ("AGPL-3.0", _GNU.format("program", "Affero ", "3")),
    ("GPL-3.0", _GNU.format("program", "", "3")),
    ("GPL-2.0", _GNU.format("program", "", "2")),
    ("LGPL-3.0", _GNU.format("library", "Lesser ", "3")),
    ("LGPL-2.1", _GNU.format("library", "Lesser ", "2.1")),
    ("MIT", _GRANT),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
]
#: Whole licence files.
FILES = [
    ("BSD-2-Clause", _BSD + _BSD_REST),
    ("BSD-3-Clause", _BSD + _BSD_NAMES + _BSD_REST),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
        "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("MIT", _GRANT + "\n\n" + _MIT_REST),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.\n\n"
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for "
        "any purpose, commercial or non-commercial, and by any means.\n\n"
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to "
        "the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
        "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>",
    ),
    # The long ones lie beside this module, as published; a file's name is its licence's.
    *((f.stem, f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))),
]
#: Candidates are single paragraphs or whole files, so a header of several paragraphs is known by its first one, too.
TEMPLATES = NOTICES + HEADERS + [(name, text.split("\n\n")[0]) for name, text in HEADERS if "\n\n" in text] + FILES
#: A term: letters and digits, inner dots before digits as in version numbers.
TERM = r"[\p{L}\p{N}]+(?:\.\p{N}+)*"


def _terms(text):
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _made(df: DataFrame, *keep: str, **made) -> DataFrame:
    """``keep`` and the new columns. They come out of a generator, so that they are worked out once, however often they are read above it."""
    return df.select(*keep, F.explode(F.array(F.struct(*(c.alias(n) for n, c in made.items())))).alias("made")).select(*keep, "made.*")


def _starts(ordered):
    """Where each run of equal terms begins in an ordered array that is not empty."""
    return F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (ordered[i] != ordered[F.greatest(i - 1, F.lit(0))]))


def _run_lengths(ordered, starts):
    """(term, n) of each run."""
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(ordered)))
    return F.zip_with(starts, ends, lambda a, z: F.struct(ordered[a].alias("term"), (z - a).cast("double").alias("n")))


def _squares(runs):
    """Sum over the runs of n^2."""
    return F.aggregate(runs, F.lit(0.0), lambda total, r: total + r["n"] * r["n"])


def _among(name: str, terms: list[str]) -> str:
    """SQL for ``name IN (terms)``; a term has letters, digits and dots only, so quotes are safe. Parsed at once, not built literal by literal."""
    return f"{name} IN ({', '.join(repr(t) for t in terms)})" if terms else "false"


def _upper_squares(runs: str, weights: dict[str, float], rare: float, classes: int = 12):
    """Sum over the runs of (n * weight)^2, each weight rounded up to the largest one in its class."""
    groups: dict[int, list[str]] = {}
    for term, w in weights.items():
        groups.setdefault(int(classes * (w - 1) / max(rare - 1, 1e-9)), []).append(term)
    tops = sorted((max(weights[t] for t in g) ** 2, sorted(g)) for g in groups.values())
    cases = "".join(f" WHEN {_among('r.term', g)} THEN {top!r}D" for top, g in tops[:-1])
    top = f"CASE{cases} ELSE {tops[-1][0]!r}D END" if cases else f"{tops[-1][0]!r}D" if tops else "0D"
    return F.expr(f"aggregate({runs}, 0D, (total, r) -> total + r.n * r.n * {top})")


def license_scan(files: DataFrame, templates: DataFrame, least: float = 0.8) -> DataFrame:
    """One row per file: id, path, own_license, own_score, license, inherited_from.

    ``files`` has id, path and text, ``templates`` has license and text (a short fixed list, several texts for a licence;
    its terms are sent to every executor). Candidates are every line, every paragraph of several lines and the whole
    file. A candidate's vector holds the count of each of its terms, weighted by
    ln((1 + lines) / (1 + lines with the term)) + 1 over all lines that have terms; a term in no template weighs as one in no line. A candidate
    matches the template of the highest cosine (ties: the first by name) from ``least`` on. own_license is the file's best candidate. A file that matches as a whole is a
    licence file of its directory, which has the license of the best of its licence files. license is own_license, else that of
    the nearest directory at or above the file's; inherited_from names that directory.

    A candidate whose terms outside the templates weigh too much for ``least``, even if all others matched, is left before
    the cosine: first by numbers of terms alone, then by counts and weights rounded up. None is missed. A null text has no lines, a null path is
    the root directory's; rows that repeat an id are read as one file with the path that sorts first, a null id is an id.
    An empty table gives an empty result; further columns are not read.
    """
    texts = files.select("id", F.coalesce("path", F.lit("")).alias("path"), empty_if_null("text").alias("text"))
    counts = templates.select("license", F.xxhash64("text").alias("template"), F.explode(_terms(F.col("text"))).alias("term"))
    counts = counts.groupBy("license", "template", "term").agg(F.count(F.lit(1)).cast("double").alias("n"))
    vocabulary = sorted(r["term"] for r in counts.select("term").distinct().collect())

    known = F.expr(f"filter(terms, t -> {_among('t', vocabulary)})")

    # The terms come out of the generator, so that no filter above it reads a text again.
    lines = texts.select(F.explode(F.transform(F.split("text", "\n"), lambda v: F.array_distinct(_terms(v)))).alias("terms")).where(F.size("terms") > 0)
    stats = lines.select(F.explode(F.concat(known, F.array(F.lit("\n")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    seen = {r["term"]: r["df"] for r in stats.collect()}  # at most one row for each term of the templates
    spark = files.sparkSession
    total = seen.get("\n", 0)
    idf = spark.createDataFrame([(t, float(seen.get(t, 0))) for t in vocabulary], "term string, df double").select(
        "term", (F.log((1.0 + total) / (1.0 + F.col("df"))) + 1).alias("idf")
    )
    rare = math.log(1.0 + total) + 1
    upper = _upper_squares("runs", {t: math.log((1.0 + total) / (1.0 + seen.get(t, 0))) + 1 + 1e-9 for t in vocabulary}, rare)
    weights = counts.join(F.broadcast(idf), "term").select("license", "template", "term", (F.col("n") * F.col("idf")).alias("w"))
    norms = weights.groupBy("license", "template").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    weights = weights.join(F.broadcast(norms), ["license", "template"]).select("license", "template", "term", (F.col("w") / F.col("norm")).alias("u"))

    # A text is taken apart once, into lines; no term spans two. Paragraphs, of several lines without a blank one, and the whole are put together from them.
    held = _made(texts, "id", mark=F.xxhash64("text"), terms=F.transform(F.split("text", "\n"), _terms))
    n = F.size("terms")
    held = _made(
        held, "id", "mark", "terms", filled=F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.size(F.col("terms")[i]) > 0),
        inside=F.expr(f"transform(terms, l -> filter(l, t -> {_among('t', vocabulary)}))"),
        others=F.expr(f"transform(terms, l -> filter(l, t -> NOT {_among('t', vocabulary)}))"),
    ).where(F.size("filled") > 0)
    held = _made(
        held, "id", "mark", "inside", "others", "filled",
        first=F.filter("filled", lambda i: (i == 0) | (F.size(F.col("terms")[F.greatest(i - 1, F.lit(0))]) == 0)),
        last=F.filter("filled", lambda i: (i == n - 1) | (F.size(F.col("terms")[F.least(i + 1, n - 1)]) == 0)),
    )
    span = lambda i, k: F.struct(i.alias("a"), k.alias("n"))
    paragraphs = F.filter(F.zip_with("first", "last", lambda i, k: span(i, k - i + 1)), lambda x: (x["n"] > 1) & (F.size("first") > 1))
    single = F.transform(F.filter("filled", lambda i: F.size("filled") > 1), lambda i: span(i, F.lit(1)))
    spans = F.concat(F.array(span(F.lit(0), F.size("inside"))), paragraphs, single)
    joined = lambda name, x: F.flatten(F.slice(name, x["a"] + 1, x["n"])).alias(name)
    units = held.select("id", "mark", F.posexplode(F.transform(spans, lambda x: F.struct(joined("inside", x), joined("others", x)))).alias("unit", "v"))
    unit = ["id", "mark", "unit"]
    units = _made(units, *unit, inside=F.sort_array("v.inside"), others=F.col("v.others"))
    # If m occurrences are of k terms, their squared counts sum up to (m - k + 1)^2 + k - 1 at most, and to m at least.
    within, distinct, square = F.size("inside"), F.size(F.array_distinct("inside")), least * least
    most = (within - distinct + 1).cast("double") ** 2 + distinct - 1
    units = units.where((within > 0) & (most * (1 - square) >= square * F.size("others") - 1e-6))
    units = _made(units, *unit, "inside", "others", starts=_starts(F.col("inside")))
    units = _made(units, *unit, "others", runs=_run_lengths(F.col("inside"), F.col("starts")))
    units = units.where(upper * (1 - square) >= square * F.size("others") * (rare * rare) - 1e-6)
    # Few are left. Terms outside the templates count by their numbers, too.
    units = _made(units, *unit, "runs", others=F.sort_array("others"))
    units = _made(units, *unit, "runs", "others", starts=F.when(F.size("others") > 0, _starts(F.col("others"))).otherwise(F.array().cast("array<int>")))
    likely = units.select(*unit, "runs", F.when(F.size("others") > 0, _squares(_run_lengths(F.col("others"), F.col("starts")))).otherwise(0.0).alias("outside")).distinct()

    weighed = likely.select(*unit, "outside", F.explode("runs").alias("r")).select(*unit, "outside", "r.term", "r.n").join(F.broadcast(idf), "term")
    weighed = weighed.select(*unit, "outside", "term", (F.col("n") * F.col("idf")).alias("w"))
    # A bounded list each: terms of the templates.
    sizes = weighed.groupBy(*unit, "outside").agg(
        F.sqrt(F.sum(F.col("w") ** 2) + F.col("outside") * (rare * rare)).alias("norm"), F.collect_list(F.struct("term", "w")).alias("vector")
    )
    matched = (
        sizes.select(*unit, "norm", F.explode("vector").alias("t")).join(F.broadcast(weights.withColumnRenamed("term", "t_term")), F.col("t.term") == F.col("t_term"))
        .groupBy(*unit, "license", "template").agg((F.sum(F.col("t.w") * F.col("u")) / F.first("norm")).alias("cosine"))
        .where(F.round("cosine", 9) >= least)
        .groupBy(*unit).agg(F.min(F.struct((-F.round("cosine", 9)).alias("c"), "license")).alias("best"))
    )
    own = matched.groupBy("id").agg(F.min("best").alias("best"), F.min(F.when(F.col("unit") == 0, F.col("best"))).alias("whole"))
    found = texts.groupBy("id").agg(F.min("path").alias("path"))
    rows = found.alias("f").join(own.alias("o"), F.col("f.id").eqNullSafe(F.col("o.id")), "left").select(
        "f.id", "path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"),
        F.col("best.license").alias("own_license"), (-F.col("best.c")).alias("own_score"), "whole",
    )
    licence_files = (
        rows.where("whole IS NOT NULL").groupBy("dir").agg(F.min("whole").alias("best"))
        .select(F.col("dir").alias("above"), F.col("best.license").alias("given"))
    )
    dirs = rows.where("own_license IS NULL").select("dir").distinct()
    steps = F.split("dir", "/")
    ups = dirs.select(
        "dir", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.concat_ws("/", F.slice(steps, 1, k))))).alias("above")
    ).distinct()
    nearest = ups.join(licence_files, "above").groupBy("dir").agg(F.max_by(F.struct("above", "given"), F.length("above")).alias("near"))
    return rows.join(nearest, "dir", "left").select(
        "id", "path", "own_license", "own_score", F.coalesce("own_license", "near.given").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("near.above")).alias("inherited_from"),
    )
