"""Licences of documents: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

DataFrame functions only. Templates are short notices, the usual headers of source files, the headings of long licences, and the whole texts of short ones. Texts that
name a licence at all (NAMES) are cut into segments: lines, sentences of lines, each two and each four neighbouring lines, blocks between blank lines, and the text as a whole;
the latter two if they aren't more than twice as long as the longest template. Segments that name a licence are compared with every template: term frequency times inverse
document frequency over the templates, a term that no template has weighs as the rarest. A document's own licence is that of its most similar template, if the
cosine is at least `least`; equal ones go to the segment of most terms (a heading with its version before the heading alone), then to the lesser template, then to the first segment.

A licence file is a document whose name says so, or whose text is little more than the notice (at most `spread`
times the words of the segment). It licenses its directory; the surest file decides, then the least doc_id. A document
without a licence of its own inherits that of the nearest directory above it: the distinct directories are joined with
their ancestors by path, and documents with their directory.

Null and empty texts have no licence of their own. Long texts are searched whole. A null path is the top directory. Rows are never merged, repeated ones included; rows without
doc_id are scanned too, and each row keeps its own. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written

# Notices, headers and texts of each licence.
NO_WARRANTY = "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEMPLATES = (
    ("AGPL-3.0", "licensed under the gnu affero general public license version 3"),
    ("AGPL-3.0", "spdx license identifier agpl 3.0"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is " + NO_WARRANTY + " See the GNU Affero General Public License for more details."),
    ("Apache-2.0", "licensed under the apache license version 2.0"),
    ("Apache-2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license"),
    ("Apache-2.0", "spdx license identifier apache 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("BSD", "released under the bsd license"),
    ("BSD-2-Clause", "released under the 2 clause bsd license"),
    ("BSD-2-Clause", BSD_TERMS),
    ("BSD-2-Clause", "BSD 2-Clause License Copyright (c) All rights reserved. " + BSD_TERMS + " " + BSD_END),
    ("BSD-3-Clause", "released under the 3 clause bsd license"),
    ("BSD-3-Clause", BSD_TERMS + " " + BSD_NAMES),
    ("BSD-3-Clause", "BSD 3-Clause License Copyright (c) All rights reserved. " + BSD_TERMS + " " + BSD_NAMES + " " + BSD_END),
    ("CC-BY-4.0", "licensed under cc by 4.0"),
    ("CC-BY-4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("CC-BY-NC-4.0", "licensed under cc by nc 4.0"),
    ("CC-BY-NC-4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
    ("CC-BY-SA-4.0", "licensed under cc by sa 4.0"),
    ("CC-BY-SA-4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("CC0-1.0", "released to the public domain under cc0 1.0 universal"),
    ("EPL-2.0", "made available under the terms of the eclipse public license version 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL", "gnu general public license"),
    ("GPL-2.0", "this work is licensed under the gnu general public license version 2"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is " + NO_WARRANTY + " See the GNU General Public License for more details."),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3"),
    ("GPL-3.0", "spdx license identifier gpl 3.0"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is " + NO_WARRANTY + " See the GNU General Public License for more details."),
    ("ISC", "released under the isc license"),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("LGPL-3.0", "this work is licensed under the gnu lesser general public license version 3"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This library is " + NO_WARRANTY + " See the GNU Lesser General Public License for more details."),
    ("MIT", "released under the mit license"),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("MIT", "spdx license identifier mit"),
    ("MIT", """MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Proprietary", "copyright all rights reserved no part may be reproduced without permission"),
    ("Unlicense", "this is free and unencumbered software released into the public domain under the unlicense"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
NAMES = r"(?i)licen[sc]e|copyright|permission is hereby|redistribution and use|public domain|spdx"
FILE_NAMES = r"(?i)^(un)?licen[sc]e|^copying|^notice"


@dataclass(frozen=True)
class Config:
    least: float = 0.6
    spread: int = 3


#: Blocks and whole texts of more characters are no notices.
LONGEST = 2 * max(len(t) for _, t in TEMPLATES)
WORD = r"[0-9]+(?:\.[0-9]+)+|[a-z0-9]+"


def _vectors() -> tuple[list[tuple], dict[str, float], float]:
    """(template, licence, term, weight) of unit vectors, the terms' idf, and the idf of all others."""
    split = [Counter(re.findall(WORD, t.lower())) for _, t in TEMPLATES]
    df = Counter(term for c in split for term in c)
    idf = {t: round(math.log((1 + len(split)) / (1 + n)) + 1, 6) for t, n in sorted(df.items())}
    rows = []
    for i, ((name, _), c) in enumerate(zip(TEMPLATES, split)):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        rows += [(i, name, t, n * idf[t] / norm) for t, n in sorted(c.items())]
    return rows, idf, round(math.log(1 + len(split)) + 1, 6)


def _terms(text: Column) -> Column:
    """Runs of a-z and 0-9, and of digits with inner dots as in 2.0."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def segments(text: Column) -> Column:
    """Array of what is compared: see above."""
    lines = F.split(text, "\n")
    run = lambda n: F.transform(lines, lambda _, i: F.array_join(F.slice(lines, i + 1, F.lit(n)), "\n"))
    short = F.filter(F.concat(F.split(text, r"\n[ \t]*\n"), F.array(text)), lambda s: F.length(s) <= LONGEST)
    return F.concat(F.split(F.regexp_replace(text, r"([.;!?])[ \t]+", "$1\n"), "\n"), run(2), run(4), short)


def own_licences(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """row, template, licence, similarity, terms (of the segment) of the rows that have one. docs: row, text."""
    spark = docs.sparkSession
    vectors, idf, rare = _vectors()
    # both tables are as large as TEMPLATES
    weights = F.broadcast(spark.createDataFrame(vectors, "template int, licence string, term string, weight double"))
    terms = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double"))
    segment = docs.where(F.col("text").rlike(NAMES)).select("row", F.posexplode(segments(F.col("text"))).alias("segment", "s")).where(F.col("s").rlike(NAMES))
    counts = segment.select("row", "segment", F.explode(_terms(F.col("s"))).alias("term")).groupBy("row", "segment", "term").agg(F.count("*").alias("tf"))
    valued = counts.join(terms, "term", "left").withColumn("v", F.col("tf") * F.coalesce("idf", F.lit(rare)))
    norm = valued.groupBy("row", "segment").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), F.sum("tf").alias("terms"))
    dot = valued.join(weights, "term").groupBy("row", "segment", "template", "licence").agg(F.sum(F.col("v") * F.col("weight")).alias("dot"))
    scored = dot.join(norm, ["row", "segment"]).withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("similarity") >= cfg.least)
    best = scored.groupBy("row").agg(F.min(F.struct((-F.col("similarity")).alias("s"), (-F.col("terms")).alias("n"), "template", "segment", "licence", "terms")).alias("b"))
    return best.select("row", F.col("b.template").alias("template"), F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("similarity"), F.col("b.terms").alias("terms"))


def licences(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row for each row of docs (doc_id, path, text): doc_id, path, own_licence, similarity, licence_file, inherited_licence, inherited_from, licence."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), "text")
    # the texts that name a licence, searched once; a row is known by what it holds, so that a task that runs again names it alike
    keyed = written(named.select("doc_id", "path", F.when(F.col("text").rlike(NAMES), F.col("text")).alias("text"), F.struct("doc_id", "path", F.xxhash64("text").alias("digest")).alias("row")), "named")
    own = own_licences(keyed.where("text is not null").dropDuplicates(["row"]), cfg)
    folder = F.coalesce(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.lit(""))
    words = F.size(_terms(F.col("text")))
    is_file = F.col("licence").isNotNull() & (F.regexp_extract("path", r"([^/]*)$", 1).rlike(FILE_NAMES) | (words <= cfg.spread * F.col("terms")))
    full = keyed.join(own, "row", "left").select("doc_id", "path", folder.alias("folder"), F.col("licence").alias("own_licence"), "similarity", F.coalesce(is_file, F.lit(False)).alias("licence_file"))
    files = full.where("licence_file").groupBy("folder").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "doc_id", "own_licence")).alias("b")).select(F.col("folder").alias("above"), F.col("b.own_licence").alias("inherited_licence"))
    parts = F.split("folder", "/")
    up = full.select("folder").distinct().withColumn("depth", F.explode(F.sequence(F.lit(0), F.when(F.col("folder") == "", 0).otherwise(F.size(parts))))).withColumn("above", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    nearest = up.join(files, "above").groupBy("folder").agg(F.max(F.struct("depth", "above", "inherited_licence")).alias("n")).select("folder", F.col("n.above").alias("inherited_from"), F.col("n.inherited_licence").alias("inherited_licence"))
    out = full.join(nearest, "folder", "left")
    mine = F.col("own_licence").isNotNull()
    return out.select("doc_id", "path", "own_licence", "similarity", "licence_file", F.when(~mine, F.col("inherited_licence")).alias("inherited_licence"), F.when(~mine, F.col("inherited_from")).alias("inherited_from"), F.coalesce("own_licence", "inherited_licence").alias("licence"))


#: where the documents of the query's table stand: by source and thousands of ids
PATH_SQL = "concat(coalesce(source, ''), '/', cast(floor(doc_id / 1000) as bigint), '/', doc_id, '.txt')"


def oracle(cfg: Config = Config()) -> str:
    quoted = lambda t: t.replace("'", "''")
    values = ", ".join(f"({i}, '{n}', '{quoted(t)}')" for i, (n, t) in enumerate(TEMPLATES))
    pattern = "[0-9]+(?:\\.[0-9]+)+|[a-z0-9]+"
    runs = ", ".join(f"list_transform(range(len(ls)), lambda i: array_to_string(ls[i + 1 : i + {n}], chr(10)))" for n in (2, 4))
    return f"""
WITH t(template, licence, text) AS (VALUES {values}),
tf AS (SELECT template, licence, term, count(*) AS n FROM (SELECT template, licence, unnest(regexp_extract_all(lower(text), '{pattern}')) AS term FROM t) GROUP BY ALL),
idfs AS (SELECT term, round(ln((1 + (SELECT count(*) FROM t)) / (1 + count(*))) + 1, 6) AS idf FROM tf GROUP BY term),
rare AS (SELECT round(ln(1 + count(*)) + 1, 6) AS idf FROM t),
weights AS (SELECT template, licence, term, n * idf / sqrt(sum((n * idf) ** 2) OVER (PARTITION BY template)) AS weight FROM tf JOIN idfs USING (term)),
d AS (SELECT doc_id, {PATH_SQL} AS path, text FROM documents),
ls AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM d WHERE regexp_matches(text, '{NAMES}')),
cuts AS (SELECT doc_id, list_concat(list_concat(list_concat(string_split(regexp_replace(text, '([.;!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)), {runs.replace("), list_transform", ")), list_transform")}),
         list_filter(list_append(regexp_split_to_array(text, '\\n[ \\t]*\\n'), text), lambda s: length(s) <= {LONGEST})) AS ss FROM ls),
seg AS (SELECT doc_id, unnest(range(len(ss))) AS segment, unnest(ss) AS s FROM cuts),
counts AS (SELECT doc_id, segment, term, count(*) AS tf FROM (SELECT doc_id, segment, unnest(regexp_extract_all(lower(s), '{pattern}')) AS term FROM seg WHERE regexp_matches(s, '{NAMES}')) GROUP BY ALL),
valued AS (SELECT c.*, tf * coalesce(idfs.idf, rare.idf) AS v FROM counts c CROSS JOIN rare LEFT JOIN idfs USING (term)),
norms AS (SELECT doc_id, segment, sqrt(sum(v * v)) AS norm, sum(tf) AS terms FROM valued GROUP BY ALL),
scored AS (SELECT doc_id, segment, template, licence, round(sum(v * weight) / any_value(norm), 6) AS similarity, any_value(terms) AS terms FROM valued JOIN weights USING (term) JOIN norms USING (doc_id, segment) GROUP BY doc_id, segment, template, licence),
own AS (SELECT * FROM scored WHERE similarity >= {cfg.least} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, terms DESC, template, segment) = 1),
full_ AS (SELECT d.doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, licence AS own_licence, similarity,
          coalesce(licence IS NOT NULL AND (regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{FILE_NAMES}') OR len(regexp_extract_all(lower(text), '{pattern}')) <= {cfg.spread} * terms), false) AS licence_file
          FROM d LEFT JOIN own USING (doc_id)),
files AS (SELECT folder AS above, own_licence AS inherited_licence FROM full_ WHERE licence_file QUALIFY row_number() OVER (PARTITION BY folder ORDER BY similarity DESC, doc_id) = 1),
up AS (SELECT folder, depth, array_to_string(string_split(folder, '/')[1:depth], '/') AS above FROM (SELECT folder, unnest(range(0, CASE WHEN folder = '' THEN 1 ELSE len(string_split(folder, '/')) + 1 END)) AS depth FROM (SELECT DISTINCT folder FROM full_))),
nearest AS (SELECT folder, above AS inherited_from, inherited_licence FROM up JOIN files USING (above) QUALIFY row_number() OVER (PARTITION BY folder ORDER BY depth DESC) = 1)
SELECT doc_id, path, own_licence, similarity, licence_file, CASE WHEN own_licence IS NULL THEN inherited_licence END AS inherited_licence,
       CASE WHEN own_licence IS NULL THEN inherited_from END AS inherited_from, coalesce(own_licence, inherited_licence) AS licence
FROM full_ LEFT JOIN nearest USING (folder)"""
