"""License scans: TF-IDF cosine of licence lines to templates, then inheritance.

Only DataFrame functions. Every line of every file that names a licence, a copyright
or an SPDX tag is a header line; equal lines are scored once. Lines and templates are
sparse vectors of word counts times inverse document frequency, counted over all
header lines and the templates, joined by word; a line's licence is the template of
the highest cosine, if that reaches ``least``. A file's own licence is that of its
best line, and a line with an SPDX tag has the licence it names, without "-only" or
"-or-later"; a licence file is also scored whole, without regard to keywords, against
the full texts of licences (BODIES), and takes the better score.

A licence file (by its base name) licenses its directory; "." is the root of relative
paths. A file without a licence
of its own inherits from the nearest ancestor directory that has a licensed licence
file: directories, not files, are joined with their ancestors, so one directory that
holds a third of all files is one row there.

Null text, or no such line: no licence of its own. Ties go to the first template by
name; repeated rows are files of their own; of several licence files in a directory
the best-scored counts. Texts and lines of any length work. Empty tables give empty
results. Further columns, whatever their names, are not read. Texts are read once: lines
that name a licence, and licence files, are stored and scored from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored

#: Names, notices and headings of common licences, as their projects ask to state them.
#: What follows "#" tells templates of one licence apart.
TEMPLATES = {
    "AGPL-3.0#heading": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "Apache-2.0#heading": "Apache License Version 2.0, January 2004",
    "Apache-2.0#notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "GPL-2.0#heading": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0#heading": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "GPL-3.0#notice": "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0#heading": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "MIT#heading": "The MIT License (MIT)",
    "MPL-2.0#heading": "Mozilla Public License Version 2.0",
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under Creative Commons Attribution CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under Creative Commons Attribution NonCommercial CC BY-NC 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain under the Unlicense.",
}
_BSD = '''Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
'''
_BSD_THIRD = '''3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
'''
_BSD_END = '''THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'''
#: Full texts of licences that are short enough to stand for themselves in a file.
BODIES = {
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + _BSD_THIRD + _BSD_END,
    "ISC": '''Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.''',
    "MIT": '''Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.''',
}
HEADER = r"(?i)licen[sc]e|copyright|spdx|public domain"
LICENCE_FILE = r"(?i)^(un)?licen[sc]e|^copying|^notice"
SPDX = r"SPDX-License-Identifier:\s*([A-Za-z0-9][A-Za-z0-9.+-]*)"
_WORD_GAP = "[^a-z0-9.]+"


def _words(text):
    """Lower-case words; a final full stop is no part of one."""
    found = F.transform(F.split(F.lower(text), _WORD_GAP), lambda w: F.regexp_replace(w, r"\.+\z", ""))
    return F.filter(found, lambda w: w != "")


def line_scores(lines: DataFrame, templates: dict[str, str], least: float, text_col: str = "line") -> DataFrame:
    """(line, licence, score) of the distinct lines (line, n) that reach ``least``, stored;
    their words are those of ``text_col``. Each step is stored, as one plan of all of them
    takes much of the driver's memory."""
    with scratch(lines.sparkSession) as keep:
        return keep(stored(_line_scores(stored(lines, "lines"), templates, least, text_col), "scores"))


def _line_scores(lines: DataFrame, templates: dict[str, str], least: float, text_col: str) -> DataFrame:
    spark = lines.sparkSession
    known = spark.createDataFrame(sorted(templates.items()), "licence string, text string")
    words = stored(lines.select("line", "n", F.explode(_words(F.col(text_col))).alias("w")).groupBy("line", "n", "w").agg(F.count("*").alias("tf")), "line-words")
    of_template = known.select("licence", F.explode(_words(F.col("text"))).alias("w")).groupBy("licence", "w").agg(F.count("*").alias("tf"))
    total = lines.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).select((F.col("total") + len(templates)).alias("total"))
    df = words.groupBy("w").agg(F.sum("n").alias("df")).unionByName(of_template.groupBy("w").agg(F.count("*").alias("df"))).groupBy("w").agg(F.sum("df").alias("df"))
    idf = stored(df.crossJoin(F.broadcast(total)).select("w", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("idf")), "idf")
    lv = stored(words.join(idf, "w").select("line", "w", (F.col("tf") * F.col("idf")).alias("x")), "line-vectors")
    tv = F.broadcast(stored(of_template.join(idf, "w").select("licence", "w", (F.col("tf") * F.col("idf")).alias("y")), "template-vectors"))
    ln = lv.groupBy("line").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("lx"))
    tn = F.broadcast(tv.groupBy("licence").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("ty")))
    dot = lv.join(tv, "w").groupBy("line", "licence").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    cosine = dot.join(tn, "licence").join(ln, "line").select("line", "licence", F.round(F.col("dot") / (F.col("lx") * F.col("ty")), 6).alias("score"))
    best = cosine.groupBy("line").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    return best.select("line", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score")).filter(F.col("score") >= least)


def scan(files: DataFrame, templates: dict[str, str] | None = None, least: float = 0.6, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """doc_id, path, own_licence, score, licence, via ("header", "inherited" or null)."""
    templates = templates or TEMPLATES
    own = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    base = F.regexp_extract("path", r"([^/]*)\z", 1)
    is_file = F.coalesce(base.rlike(LICENCE_FILE), F.lit(False))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x.rlike(HEADER))
    hits = own.filter(F.col("text").rlike(HEADER) | (is_file & F.col("text").isNotNull()))
    hits = stored(hits.select("doc_id", "path", lines.alias("lines"), F.when(is_file, F.md5("text")).alias("whole"), F.when(is_file, F.col("text")).alias("body")), "licence-lines")
    named = hits.select("doc_id", "path", F.explode("lines").alias("line"))
    tagged = F.col("line").rlike(SPDX)
    plain = named.filter(~tagged)
    scores = line_scores(plain.groupBy("line").agg(F.count("*").alias("n")), templates, least)
    scores = scores.withColumn("licence", F.substring_index("licence", "#", 1))
    tags = named.filter(tagged).select("doc_id", "path", "line", F.regexp_replace(F.regexp_extract("line", SPDX, 1), r"-(only|or-later)\z", "").alias("licence"), F.lit(1.0).alias("score"))
    whole = hits.filter("whole is not null").select("doc_id", "path", F.col("whole").alias("line"), "body")
    whole_scores = line_scores(whole.groupBy("line").agg(F.count("*").alias("n"), F.min("body").alias("body")), BODIES, least, "body")
    scored = plain.join(scores, "line").unionByName(whole.drop("body").join(whole_scores, "line")).unionByName(tags)
    found = scored.groupBy("doc_id", "path").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    found = stored(found.select("doc_id", "path", F.col("b.licence").alias("own_licence"), (-F.col("b.s")).alias("score")), "found")
    directory = F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^(.*)/[^/]*\z", 1)).when(F.col("path").isNotNull(), ".")
    licensed = found.filter(base.rlike(LICENCE_FILE)).groupBy(directory.alias("anc")).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("own_licence").alias("licence"))).alias("b"))
    dirs = own.select(directory.alias("dir")).distinct()
    parts = F.split("dir", "/")
    ancestors = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("anc")))).alias("a"))
    root = dirs.filter((F.col("dir") != ".") & (F.col("dir") != "") & ~F.col("dir").startswith("/")).select("dir", F.lit(0).alias("depth"), F.lit(".").alias("anc"))
    inherited = stored(ancestors.select("dir", "a.depth", "a.anc").unionByName(root).join(licensed, "anc").groupBy("dir").agg(F.max(F.struct("depth", F.col("b.licence").alias("licence"))).alias("b")).select("dir", F.col("b.licence").alias("inherited")), "inherited")
    files_ = own.select("doc_id", "path", directory.alias("dir"))
    out = files_.join(found.select(F.col("doc_id").alias("f_id"), F.col("path").alias("f_path"), "own_licence", "score"), F.col("doc_id").eqNullSafe(F.col("f_id")) & F.col("path").eqNullSafe(F.col("f_path")), "left")
    out = out.join(inherited, "dir", "left")
    via = F.when(F.col("own_licence").isNotNull(), "header").when(F.col("inherited").isNotNull(), "inherited")
    return out.select("doc_id", "path", "own_licence", "score", F.coalesce("own_licence", "inherited").alias("licence"), via.alias("via"))
