"""License scans: TF-IDF cosine to templates, then the nearest ancestor directory (native: DataFrame expressions only).

What a text says of licences is read in several units: the sentences of each line, the
paragraphs without comment marks and line breaks, and their sentences, if they speak of
a licence; and its blocks, the comment it begins with and the whole text. Each unit is a
sparse TF-IDF vector: a token's weight is its count times the inverse document frequency
among the templates (a token that no template has weighs as the rarest). Templates are
statements, headers, titles and whole short licences, and a unit's cosine to each
decides which licence it names. Equal units are scored once, however many files hold
them. A file's own licence is that of its best block, if one resembles a template in all
its clauses, else that of its best other unit. Files that are nothing but a licence (by
name, or because their whole text resembles a template) stand for their directory: a
file without a licence of its own takes that of the nearest directory above it that has
such a file, by joins of directory paths. Directories, not files, are joined with their
ancestors.

Defined results: a null or empty text names no licence; a null path lies in no
directory. Ties between templates go to the first name, between licence files of a
directory to the higher score, then the first name. Repeated rows and null ids are
judged row by row. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.runtime import written_table

#: Statements, titles and headers by which licences are named, fixed values.
STATEMENTS = (
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Licensed under the 2-Clause BSD License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the 3-Clause BSD License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "Released under CC0 1.0 Universal, public domain dedication"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("ISC", "Licensed under the ISC License"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Paragraphs of short licences, fixed values.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Whole licences, fixed values.
WHOLE = (
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_END),
    ("ISC", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
        "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")),
    ("MIT", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES "
        "OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")),
    ("Unlicense", (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
        "public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all "
        "present and future rights to this software under copyright law. For more information, please refer to http://unlicense.org/")),
)
#: Names of licences that have later versions, in whose identifiers -only or -or-later follows.
VERSIONED = ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0")
NAMES = tuple(sorted({name for name, _ in STATEMENTS + WHOLE}))
SPDX = tuple((name, f"SPDX-License-Identifier: {name}{tail}") for name in NAMES for tail in (("", "-only", "-or-later") if name in VERSIONED else ("",)))
TEMPLATES = STATEMENTS + WHOLE + SPDX
#: Lines that speak of a licence.
SPEAKS = r"(?i)licen[cs]|copyright|public domain|creative commons|permission is hereby|permission to use|redistribution and use|\bcc (by|0)|\bcc0"
SENTENCE, TOKEN = r"[.;!?]\s+", r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)(\.[a-z]+)?$"
#: Marks of comments at the start of a line; what parts paragraphs.
MARK, GAP = r"^[ \t]*(//+|#+|/\*+|\*+/?|--+|;+|<!--|%+|>+)", r"\n[ \t]*\n"
#: Least cosine of a sentence, of a whole text that stands for its directory, and of a block that decides before all sentences.
LEAST, LEAST_WHOLE, LEAST_BLOCK = 0.6, 0.5, 0.8


def _tokens(of: Column) -> Column:
    return F.regexp_extract_all(F.lower(of), F.lit(TOKEN), F.lit(0))


def _templates(spark: SparkSession) -> tuple[DataFrame, DataFrame, float]:
    """(token, name, part, weight) with norm 1 for each statement; (token, idf); the idf of tokens in no statement."""
    rows = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("part"), F.lit(name).alias("name"), F.lit(said).alias("statement")) for i, (name, said) in enumerate(TEMPLATES)])))
    tokens = rows.select("part", "name", F.explode(_tokens(F.col("statement"))).alias("token")).groupBy("part", "name", "token").agg(F.count("*").alias("tf"))
    idf = tokens.groupBy("token").agg((F.log((1 + len(TEMPLATES)) / (1 + F.count("*").cast("double"))) + 1).alias("idf"))
    weighed = tokens.join(F.broadcast(idf), "token").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("part").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unseen = math.log(1 + len(TEMPLATES)) + 1
    return weighed.join(F.broadcast(norms), "part").select("token", "name", "part", (F.col("w") / F.col("norm")).alias("weight")), idf, unseen


#: What a text is known by in joins: two hashes of 64 bits, so that no long text is ever a key.
UNIT = ("u", "w")


def _keyed(text: str) -> list[Column]:
    return [F.xxhash64(F.col(text)).alias("u"), F.xxhash64(F.lit("w"), F.col(text)).alias("w")]


def cosines(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """(u, w, name, score): the best template for each distinct text of the column unit; none if they share no token."""
    templates, idf, unseen = _templates(spark)
    keyed = texts.select(*_keyed("unit"), "unit").dropDuplicates(UNIT)
    tf = keyed.select(*UNIT, F.explode(_tokens(F.col("unit"))).alias("token")).groupBy(*UNIT, "token").agg(F.count("*").alias("tf"))
    weighed = tf.join(F.broadcast(idf), "token", "left").withColumn("w_", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    # one pass for norms and products: a token's products ride along with its row
    by_token = templates.groupBy("token").agg(F.collect_list(F.struct("name", "part", "weight")).alias("at"))  # as many as templates
    met = weighed.join(F.broadcast(by_token), "token", "left")
    norms = met.groupBy(*UNIT).agg(F.sqrt(F.sum(F.col("w_") * F.col("w_"))).alias("norm"))
    dots = met.select(*UNIT, "w_", F.explode("at").alias("t")).groupBy(*UNIT, "t.name", "t.part").agg(F.sum(F.col("w_") * F.col("t.weight")).alias("dot"))
    scored = dots.join(norms, list(UNIT)).select(*UNIT, "name", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    return scored.groupBy(*UNIT).agg(F.min(F.struct((-F.col("score")).alias("s"), "name")).alias("b")).select(*UNIT, "b.name", (-F.col("b.s")).alias("score"))


def directory(path: Column) -> Column:
    """What stands before the last slash; empty for a file at the top."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def _units(text: Column) -> tuple[Column, Column]:
    """(units, head) of a text: the sentences and paragraphs that speak of a licence, and the comment that the text begins with."""
    lines = F.split(text, "\n")
    speak = lambda found: F.filter(found, lambda x: x.rlike(SPEAKS))
    parted = lambda found: F.flatten(F.transform(found, lambda x: F.split(x, SENTENCE)))
    joined = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    bare = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, MARK, "")), "\n")
    paragraphs = speak(F.transform(F.split(bare, GAP), joined))
    units = F.array_distinct(F.concat(speak(parted(speak(lines))), paragraphs, speak(parted(paragraphs))))
    plain = F.array_position(F.transform(lines, lambda x: x.rlike(MARK)), False)
    head = F.when(plain > 1, F.slice(lines, F.lit(1), (plain - 1).cast("int"))).when(plain == 0, lines)
    return units, joined(F.array_join(F.transform(head, lambda x: F.regexp_replace(x, MARK, "")), "\n"))


def scan(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """key, licence, score (null if inherited), via (own, inherited or null), licence_dir (where it was inherited from) for every row."""
    spark = files.sparkSession
    rows = files.select(F.col(key).alias("id"), F.col(path).cast("string").alias("path"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    units, head = _units(F.col("text"))
    speaks = F.col("text").rlike(SPEAKS)
    found = rows.select("id", "path", F.when(speaks, units).otherwise(F.array().cast("array<string>")).alias("units"), F.when(speaks, head).alias("head"), "text")
    whole = F.when(F.col("path").rlike(LICENCE_FILE) | (F.size("units") > 0), F.col("text"))
    # hash of the text and id: rows of the same id are told apart
    found = written_table(found.select("id", "path", F.xxhash64("text").alias("k"), "units", "head", whole.alias("whole")))
    units = found.select("id", "k", F.explode("units").alias("unit"), F.lit(1).alias("rank"))
    blocks = found.select("id", "k", F.explode(F.array("head", "whole")).alias("unit"), F.lit(0).alias("rank")).filter("unit is not null")
    units = units.unionByName(blocks)
    texts = units.select("unit")
    scores = written_table(cosines(spark, texts))
    named = units.select("id", "k", "rank", *_keyed("unit")).join(scores.filter(F.col("score") >= LEAST), list(UNIT)).filter((F.col("rank") == 1) | (F.col("score") >= LEAST_BLOCK))
    own = written_table(named.groupBy(F.col("id").alias("o_id"), F.col("k").alias("o_k")).agg(F.min(F.struct("rank", (-F.col("score")).alias("s"), "name")).alias("own")))
    alike = found.filter("whole is not null and path is not null").select("path", *_keyed("whole")).join(scores.filter(F.col("score") >= LEAST_WHOLE), list(UNIT)).select("path", "name", "score")
    # a file that is named as a licence stands by what it says, too
    telling = found.filter(F.col("path").rlike(LICENCE_FILE)).join(own, F.col("id").eqNullSafe(F.col("o_id")) & (F.col("k") == F.col("o_k"))).select("path", "own.name", (-F.col("own.s")).alias("score"))
    by_dir = alike.unionByName(telling).groupBy(directory(F.col("path")).alias("licence_dir")).agg(F.min(F.struct((-F.col("score")).alias("s"), "name")).alias("d"))
    # each directory that files are in, with all directories above it
    dirs = found.filter("path is not null").select(directory(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    nearest = (
        dirs.select("dir", F.explode(F.array_distinct(above)).alias("licence_dir"))
        .join(by_dir, "licence_dir")
        .groupBy("dir")
        .agg(F.max_by(F.struct("licence_dir", F.col("d.name").alias("name")), F.length("licence_dir")).alias("n"))
    )
    joined = found.drop("units", "head", "whole").join(own, F.col("id").eqNullSafe(F.col("o_id")) & (F.col("k") == F.col("o_k")), "left").withColumn("dir", directory(F.col("path"))).join(nearest, "dir", "left")
    mine = F.col("own").isNotNull()
    return joined.select(
        F.col("id").alias(key),
        F.when(mine, F.col("own.name")).otherwise(F.col("n.name")).alias("licence"),
        F.when(mine, -F.col("own.s")).alias("score"),
        F.when(mine, "own").when(F.col("n.name").isNotNull(), "inherited").alias("via"),
        F.when(~mine, F.col("n.licence_dir")).alias("licence_dir"),
    )


def oracle() -> str:
    """DuckDB SQL of scan() over documents as files source/lang/doc_id."""
    said = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES))
    n = len(TEMPLATES)
    return f"""with t(part, name, statement) as (values {said}),
ttf as (select part, name, token, count(*) as tf from (select part, name, unnest(regexp_extract_all(lower(statement), '{TOKEN}')) as token from t) group by all),
idf as (select token, ln({1 + n} / (1 + count(*)::double)) + 1 as idf from ttf group by token),
tw as (select part, name, token, tf * idf as w from ttf join idf using (token)),
tn as (select part, sqrt(sum(w * w)) as norm from tw group by part),
d as (select doc_id, source || '/' || lang || '/' || doc_id as path, coalesce(text, '') as text from documents),
speaking as (select doc_id, path, text, string_split(text, chr(10)) as lines from d where regexp_matches(text, '{SPEAKS}')),
bare as (select doc_id, regexp_split_to_array(array_to_string(list_transform(lines, lambda x: regexp_replace(x, '{MARK}', '')), chr(10)), '{GAP}') as parts from speaking),
lines as (select doc_id, unnest(lines) as line from speaking),
paragraphs as (select doc_id, trim(regexp_replace(unnest(parts), '\\s+', ' ', 'g')) as line from bare),
said as (select * from lines where regexp_matches(line, '{SPEAKS}') union all select * from paragraphs where regexp_matches(line, '{SPEAKS}')),
units as (select distinct doc_id, unit from (select doc_id, unnest(regexp_split_to_array(line, '{SENTENCE}')) as unit from said union all select doc_id, line from paragraphs) where regexp_matches(unit, '{SPEAKS}')),
heads as (select doc_id, lines, list_position(list_transform(lines, lambda x: regexp_matches(x, '{MARK}')), false) as plain from speaking),
blocks as (select doc_id, text as unit from speaking where doc_id in (select doc_id from units) union all
  select doc_id, trim(regexp_replace(array_to_string(list_transform(case when plain is null or plain = 0 then lines else lines[1:plain - 1] end, lambda x: regexp_replace(x, '{MARK}', '')), chr(10)), '\\s+', ' ', 'g')) from heads where coalesce(plain, 0) <> 1),
texts as (select unit from units union select unit from blocks),
tf as (select unit, token, count(*) as tf from (select unit, unnest(regexp_extract_all(lower(unit), '{TOKEN}')) as token from texts) group by all),
w as (select unit, tf.token, tf * coalesce(idf, ln({1 + n}::double) + 1) as w from tf left join idf on idf.token = tf.token),
norms as (select unit, sqrt(sum(w * w)) as norm from w group by unit),
dots as (select unit, tw.name, tw.part, sum(w.w * tw.w / tn.norm) as dot from w join tw on tw.token = w.token join tn using (part) group by all),
best as (select unit, name, score from (select unit, name, round(dot / norm, 6) as score, row_number() over (partition by unit order by round(dot / norm, 6) desc, name) as k from dots join norms using (unit)) where k = 1),
own as (select doc_id, name, score from (select doc_id, name, score, row_number() over (partition by doc_id order by rank, score desc, name) as k
  from (select *, 1 as rank from units union all select *, 0 from blocks) join best using (unit) where score >= {LEAST} and (rank = 1 or score >= {LEAST_BLOCK})) where k = 1),
standing as (select regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, name, score from d join best on best.unit = d.text where doc_id in (select doc_id from units) and score >= {LEAST_WHOLE}),
by_dir as (select dir, name from (select dir, name, row_number() over (partition by dir order by score desc, name) as k from standing) where k = 1),
dirs as (select distinct regexp_extract(path, '^(.*)/[^/]*$', 1) as dir from d),
nearest as (select dir, licence_dir, name from (select dirs.dir, b.dir as licence_dir, b.name, row_number() over (partition by dirs.dir order by length(b.dir) desc) as k from dirs join by_dir b on dirs.dir = b.dir or b.dir = '' or starts_with(dirs.dir, b.dir || '/')) where k = 1)
select d.doc_id, coalesce(own.name, n.name) as licence, own.score, case when own.name is not null then 'own' when n.name is not null then 'inherited' end as via, case when own.name is null then n.licence_dir end as licence_dir
from d left join own using (doc_id) left join nearest n on n.dir = regexp_extract(d.path, '^(.*)/[^/]*$', 1)"""
