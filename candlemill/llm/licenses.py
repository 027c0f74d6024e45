"""License scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along directories.

All in DataFrame operations. A text's units are its lines, their sentences, two and three lines in a row, and the whole
text. The short ones are compared with notices, titles and identifiers, the whole text with the texts of licences, where
they lie: a document needs no shuffle. Units that share none of a set's anchor tokens, and texts with too few of its
rarer ones, can't reach the limit (the other tokens of a template weigh too little) and are passed over. A file named like a licence, or one that is nothing but a
notice or a licence's text, licenses its directory. Files without a licence of their own take that of the nearest
directory above them which has one: the distinct directories are joined with the licensed ones on each of their
ancestors, and files with their directory.

Contract for odd input: a null or empty text has no licence of its own; a null path has no directory and inherits
nothing. Of equal similarities the licence that comes first by name wins, then the whole text, then the earlier line, then
the longer unit; of several licence files in a directory the most similar, then the first licence by name. Repeated rows
get a row each. Whole texts are read, whatever their length. Other columns may have any names but those returned.
"""

from __future__ import annotations

import math
import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlemill.llm.common import stage_table

LIMIT, SALTS = 0.7, 32
#: Identifiers of common licences, their usual notices, headers and titles, and the texts of the short ones.
IDENTIFIERS = ("AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense")
NOTICES = [
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "Licensed under CC0 1.0"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Released under the ISC License"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "Released under the Unlicense"),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License"),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    *((x, f"SPDX-License-Identifier: {x}") for x in IDENTIFIERS),
]
TEXTS = [
    ("BSD-2-Clause", (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. '
        'Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in '
        'binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other '
        'materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
        'WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT '
        'SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, '
        'BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY '
        'THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS '
        'SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
    )),
    ("BSD-3-Clause", (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. '
        'Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in '
        'binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other '
        'materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or '
        'promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND '
        'CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
        'PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, '
        'EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR '
        'BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR '
        'OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
    )),
    ("ISC", (
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above '
        'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD '
        'TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, '
        'INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE '
        'OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
    )),
    ("MIT", (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to '
        'deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or '
        'sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above '
        'copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", '
        'WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
        'NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF '
        'CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
    )),
    ("Unlicense", (
        'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute '
        'this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions '
        'that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We '
        'make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt '
        'act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT '
        'WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
        'NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR '
        'OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
    )),
]
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([.-][^/]*)?$"


#: Words that make poor anchors, as most texts hold them.
_FREQUENT = frozenset("a above all and any are as at be but by copy file following for free from if in into is it its may must name no not of on one or other out public shall terms that the this to under use version was we will with without work you".split())


class Weights:
    """TF-IDF of a set of templates (licence, text), computed once on the driver from the few templates."""

    def __init__(self, templates: list[tuple[str, str]], limit: float):
        templates, self.limit = sorted(templates), limit
        self.names = [n for n, _ in templates]
        bags = [re.findall(TOKEN, x.lower()) for _, x in templates]
        tokens = sorted({t for b in bags for t in b})
        self.idf = {t: math.log((1 + len(bags)) / (1 + sum(t in b for b in bags))) + 1.0 for t in tokens}
        self.unknown = math.log(1 + len(bags)) + 1.0
        raw = [{t: (1.0 + math.log(b.count(t))) * self.idf[t] for t in b} for b in bags]
        norms = [math.sqrt(sum(w * w for w in r.values())) for r in raw]
        self.unit = {t: [r.get(t, 0.0) / n for r, n in zip(raw, norms, strict=True)] for t in tokens}
        # Anchors: for each template its heaviest tokens, until what is left can't reach the limit.
        anchors = set()
        for i in range(len(self.names)):
            left = sorted((self.unit[t][i], t) for t in set(bags[i]) - anchors)
            while left and math.sqrt(sum(w * w for w, _ in left)) >= limit:
                at = max(range(len(left)), key=lambda k: (left[k][1] not in _FREQUENT, len(left[k][1]) > 3, left[k][0]))
                anchors.add(left.pop(at)[1])
        self.anchors = sorted(anchors)
        self.anchor_words = sorted({max(re.split("[.-]", a), key=len) for a in self.anchors})
        # A cosine is at most the root of the shared tokens' squared weights in the template. So a text needs at least so many
        # different ones of a template's rarer words, even if it has all its others.
        self.rare: list[tuple[list[str], int]] = []
        for i in range(len(self.names)):
            squares = {t: self.unit[t][i] ** 2 for t in set(bags[i])}
            rare = sorted((t for t in squares if t not in _FREQUENT and t.isalnum()), key=lambda t: (-squares[t], t))
            need, k = limit * limit - sum(w for t, w in squares.items() if t not in rare), 0
            while need > 0:
                need, k = need - squares[rare[k]], k + 1
            self.rare.append((rare, k))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _worthwhile(units: Column, w: Weights) -> Column:
    """Units (text, at, tokens) without those that can't reach the limit: known tokens must make up its square of the sum of squared
    weights. Unknown distinct tokens weigh at least as if each occurred once. The known ones' squares are their idf's times
    (1 + ln count)^2, which is concave: at most the sum of idf^2 times that of their mean count, weighted by idf^2, and the
    tokens beyond the distinct ones raise this mean most where all of them are of the greatest idf."""
    known = F.array(*(F.lit(t) for t in w.idf))
    squares = F.create_map(*(F.lit(x) for t, v in w.idf.items() for x in (t, v * v)))
    listed = F.transform(units, lambda u: F.struct(u["text"].alias("text"), u["at"].alias("at"), u["tokens"].alias("tokens"), F.size(F.array_distinct(u["tokens"])).alias("d"), F.array_intersect(u["tokens"], known).alias("known")))
    summed = F.transform(
        F.filter(listed, lambda u: F.size(u["known"]) > 0),
        lambda u: F.struct(u["text"].alias("text"), u["at"].alias("at"), u["tokens"].alias("tokens"), (F.size(u["tokens"]) - u["d"]).alias("more"), ((u["d"] - F.size(u["known"])) * w.unknown**2).alias("unknown"), F.aggregate(u["known"], F.lit(0.0), lambda a, t: a + F.element_at(squares, t)).alias("known")),
    )
    often = lambda u: 1.0 + F.log(1.0 + u["more"] * max(w.idf.values()) ** 2 / u["known"])
    least = w.limit * w.limit - 1e-6
    return F.filter(summed, lambda u: u["known"] * often(u) * often(u) * (1.0 - least) >= least * u["unknown"])


def _hits(units: Column, w: Weights) -> Column:
    """For each unit (text, at, tokens): struct(best: struct(similarity, order), back, notice); order is smaller for later templates.

    Each step fills an array that the next one reads, so that nothing is worked out twice: sorted tokens, the places where
    their runs start, each run's weight and number among the known tokens, sums of squares. The products with all
    templates are only made where known tokens bear enough of the squares, as no cosine is above the root of their share.
    """
    number = F.create_map(*(F.lit(x) for i, t in enumerate(w.idf) for x in (t, i)))
    idf = F.array(*(F.lit(v) for v in w.idf.values()))
    columns = F.array(*(F.array(*(F.lit(w.unit[t][i]) for t in w.idf)) for i in range(len(w.names))))
    sorted_ = F.transform(_worthwhile(units, w), lambda u: F.struct(u["text"].alias("text"), u["at"].alias("at"), F.array_sort(u["tokens"]).alias("tokens")))
    started = F.transform(
        sorted_, lambda u: F.struct(u["text"].alias("text"), u["at"].alias("at"), u["tokens"].alias("tokens"), F.filter(F.sequence(F.lit(0), F.size(u["tokens"]) - 1), lambda i: (i == 0) | (F.get(u["tokens"], i) != F.get(u["tokens"], i - 1))).alias("starts"))
    )

    def runs(u: Column) -> Column:
        run = lambda s, j: F.coalesce(F.get(u["starts"], j + 1), F.size(u["tokens"])) - s
        return F.transform(u["starts"], lambda s, j: F.struct(F.try_element_at(number, F.get(u["tokens"], s)).alias("known"), (1.0 + F.log(run(s, j).cast("double"))).alias("often")))

    counted = F.transform(started, lambda u: F.struct(u["text"].alias("text"), u["at"].alias("at"), runs(u).alias("runs")))
    weighed = F.transform(
        counted, lambda u: F.struct(u["text"].alias("text"), u["at"].alias("at"), F.transform(u["runs"], lambda r: F.struct(r["known"].alias("known"), (r["often"] * F.coalesce(F.get(idf, r["known"]), F.lit(w.unknown))).alias("weight"))).alias("runs"))
    )
    square = lambda rs: F.aggregate(rs, F.lit(0.0), lambda a, r: a + r["weight"] * r["weight"])
    summed = F.transform(weighed, lambda u: F.struct(u["text"].alias("text"), u["at"].alias("at"), F.filter(u["runs"], lambda r: r["known"].isNotNull()).alias("known"), square(u["runs"]).alias("square")))
    near = F.filter(summed, lambda u: square(u["known"]) >= (w.limit * w.limit - 1e-6) * u["square"])
    dot = lambda u, c: F.aggregate(u["known"], F.lit(0.0), lambda a, r: a + r["weight"] * F.get(c, r["known"]))
    return F.transform(
        near,
        lambda u: F.struct(
            F.array_max(F.transform(columns, lambda c, i: F.struct((dot(u, c) / F.sqrt(F.greatest(u["square"], F.lit(1e-300)))).alias("similarity"), (-i).alias("order")))).alias("best"),
            (-u["at"]).alias("back"), u["text"].alias("notice"),
        ),
    )


BLANKS = " \t\n\x0b\x0c\r"


def _short_units(lines: Column, tokens: Column, hit: Column, w: Weights) -> Column:
    """Lines that hit, where they hold several sentences those of these that hit, and two and three lines in a row of which one
    hits: (text, at, tokens). No token goes across lines, so that rows have the tokens of their lines."""
    unit = lambda x, at, t: F.struct(x.alias("text"), at.alias("at"), t.alias("tokens"))
    hits = lambda i, n: reduce(lambda a, b: a | b, (F.get(hit, i + k) for k in range(n)))
    places = lambda n: F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i <= F.size(lines) - n) & hits(i, n))
    rows = lambda n: F.transform(places(n), lambda i: unit(F.array_join(F.slice(lines, i + 1, F.lit(n)), " "), i, F.flatten(F.slice(tokens, i + 1, F.lit(n)))))
    split = F.filter(places(1), lambda i: F.get(lines, i).rlike(r"[.;!?]\s+\S"))
    pieces = F.flatten(F.transform(split, lambda i: F.transform(F.split(F.get(lines, i), r"[.;!?]\s+"), lambda p: unit(p, i, _tokens(p)))))
    return F.concat(rows(1), rows(2), rows(3), F.filter(pieces, lambda u: F.arrays_overlap(u["tokens"], F.array(*(F.lit(a) for a in w.anchors)))))


def scan(files: DataFrame, *, notices: list[tuple[str, str]] | None = None, texts: list[tuple[str, str]] | None = None, limit: float = LIMIT, licence_file: str = LICENCE_FILE) -> DataFrame:
    """files (path, text and any others but the names returned): the columns but text, and license, similarity, origin
    ('header', 'file', 'inherited' or null), line (its number from 1, for headers; null for whole texts), notice (the unit) and from_dir."""
    sets = [Weights(notices or NOTICES, limit), Weights(texts or TEXTS, limit)]
    returned = ("license", "similarity", "origin", "line", "notice", "from_dir")
    mark = uuid.uuid4().hex[:12]  # of columns that clash with none
    keep = [c for c in files.columns if c != "text" and c not in returned]
    columns = {c: f"c{i}_{mark}" for i, c in enumerate(keep)}
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    all_names = sorted({n for w in sets for n in w.names})
    none = F.array().cast("array<struct<text:string,at:int,tokens:array<string>>>")
    # A text's words say whether any of its units can reach a limit; its lines' tokens, which ones.
    words, lines, tokens, hit_lines = (f"{x}_{mark}" for x in ("words", "lines", "tokens", "hits"))
    literal = lambda xs: F.array(*(F.lit(x) for x in xs))
    files = files.withColumn(words, F.split(F.lower(text), "[^a-z0-9]+"))
    files = files.withColumn(lines, F.when(F.arrays_overlap(words, literal(sets[0].anchor_words)), F.split(text, "\n")))
    files = files.withColumn(tokens, F.transform(lines, _tokens))
    files = files.withColumn(hit_lines, F.transform(tokens, lambda x: F.arrays_overlap(x, literal(sets[0].anchors))))
    short = F.when(F.exists(hit_lines, lambda x: x), _short_units(F.col(lines), F.col(tokens), F.col(hit_lines), sets[0])).otherwise(none)
    shared = f"shared_{mark}"
    files = files.withColumn(shared, F.array_intersect(words, literal(sorted({t for rare, _ in sets[1].rare for t in rare}))))
    likely = reduce(lambda a, b: a | b, (F.size(F.array_intersect(shared, literal(rare))) >= k for rare, k in sets[1].rare))
    whole = F.when(likely, F.array(F.struct(text.alias("text"), F.lit(-1).alias("at"), _tokens(text).alias("tokens")))).otherwise(none)

    def hits(units: Column, w: Weights) -> Column:
        places = F.array(*(F.lit(-all_names.index(n)) for n in w.names))
        return F.transform(_hits(units, w), lambda h: F.struct(F.round(h["best"]["similarity"], 9).alias("similarity"), F.element_at(places, 1 - h["best"]["order"]).alias("order"), h["back"].alias("back"), F.length(h["notice"]).alias("length"), h["notice"].alias("notice")))

    names = F.array(*(F.lit(n) for n in all_names))
    base = F.regexp_extract(F.col("path"), r"([^/]*)$", 1)
    directory = F.when(F.col("path").isNotNull(), F.regexp_replace(F.col("path"), r"/?[^/]*$", ""))
    best = F.array_max(F.concat(hits(short, sets[0]), hits(whole, sets[1])))
    trimmed = lambda c: F.length(F.btrim(c, F.lit(BLANKS)))
    found = files.select(*(F.col(f"`{c}`").alias(n) for c, n in columns.items()), directory.alias("__dir"), base.alias("__base"), trimmed(text).alias("__n"), best.alias("__hit"))
    found = stage_table(found, "license-hits")  # small rows; the texts are read once
    hit = F.col("__hit.similarity") >= limit
    own = found.select(
        *columns.values(), "__dir",
        F.when(hit, F.element_at(names, 1 - F.col("__hit.order"))).alias("__license"), F.when(hit, F.col("__hit.similarity")).alias("__similarity"),
        F.when(hit & (F.col("__hit.back") <= 0), 1 - F.col("__hit.back")).alias("__line"), F.when(hit, F.col("__hit.notice")).alias("__notice"),
        (hit & (F.col("__base").rlike(licence_file) | (trimmed(F.col("__hit.notice")) == F.col("__n")))).alias("__grants"),
    )
    granted = own.where("__grants and __dir is not null").groupBy(F.col("__dir").alias("g_dir")).agg(F.max(F.struct("__similarity", "__license")).alias("t"), F.min(F.struct((-F.col("__similarity")).alias("s"), "__license")).alias("g")).select("g_dir", F.col("g.__license").alias("g_license"), F.col("t.__similarity").alias("g_similarity"))
    needy = own.where("__license is null and __dir is not null").select("__dir").distinct()
    parts = F.split("__dir", "/")
    ancestors = needy.select("__dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("name")))).alias("a"))
    nearest = ancestors.join(granted, F.col("a.name") == F.col("g_dir")).groupBy(F.col("__dir").alias("i_dir")).agg(F.max(F.struct(F.col("a.depth").alias("depth"), "g_dir", "g_license", "g_similarity")).alias("i"))
    # A directory may hold a third of all files: its row is repeated, and files choose one of the copies in turn.
    spread = nearest.withColumn("i_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = own.withColumn("__salt", F.monotonically_increasing_id() % SALTS)
    out = salted.join(spread, (F.col("__dir") == F.col("i_dir")) & (F.col("__salt") == F.col("i_salt")) & F.col("__license").isNull(), "left")
    origin = F.when(F.col("__license").isNotNull(), F.when(F.col("__grants"), F.lit("file")).otherwise(F.lit("header"))).when(F.col("i.g_license").isNotNull(), F.lit("inherited"))
    return out.select(
        *(F.col(n).alias(c) for c, n in columns.items()), F.coalesce("__license", "i.g_license").alias("license"), F.coalesce("__similarity", "i.g_similarity").alias("similarity"),
        origin.alias("origin"), F.col("__line").alias("line"), F.col("__notice").alias("notice"), F.col("i.g_dir").alias("from_dir"),
    )
