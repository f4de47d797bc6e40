"""License scans by diagonal voting. DataFrame functions only.

All rolling hashes of ``GRAM`` words of a text are joined to the template positions that have them (the words are compared
too, so a match is exact). A match votes for the diagonal (position in the text minus position in the template).
Diagonals at most ``BAND`` apart are merged, so that inserted or missing words do not take a notice apart. A merged group is a
hit if within it a window of the template's length and some slack has matches that cover ``COVERED`` of the template's
grams. A single diagonal always fits a window, so matches around a whole notice take nothing from it.

The templates (short notices and whole license texts, of any length) are a fixed list, so the join broadcasts them: their
number of rows is bounded by this file.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outskirt.llm.shared import ascii_lower, text_or_empty

GRAM, BAND, COVERED, SLACK = 2, 4, 0.8, 8
#: A window in fractions of a position; more than twice the longest template, so that positions keep apart.
UNIT = 1 << 20

# Phrases and their labels, as the contract of the query gives them.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
# Wording of common license notices.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("redistribute it and or modify it under the terms of the gnu general public license", "gpl-notice"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("released under the mit license", "mit-release"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
]
# Whole public license texts, without their copyright lines.
TEXTS = [
    (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
        BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
        OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "mit-full",
    ),
    (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
        AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
        AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
        DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
        TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        "isc",
    ),
    (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
        ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
        LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
        CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
        SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        "bsd-2-clause",
    ),
    (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE
        COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
        HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
        INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
        NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
        DAMAGE.""",
        "bsd-3-clause",
    ),
    (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
        for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
        purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
        is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
        original software. 3. This notice may not be removed or altered from any source distribution.""",
        "zlib",
    ),
    (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of
        this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for
        the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an
        overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE
        SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
        LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
        OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "unlicense",
    ),
]
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


#: (tid, label, whether a phrase, words) of every template.
TEMPLATES = [
    (tid, label, tid < len(PHRASES), [w for w in re.split(SEPARATORS, text.lower()) if w])
    for tid, (text, label) in enumerate(PHRASES + NOTICES + TEXTS)
]
#: Template positions are told by bits of this many BIGINT columns.
MASKS = -(-max(len(words) - 1 for *_, words in TEMPLATES) // 64)


def templates(spark: SparkSession) -> DataFrame:
    """A row per template position: tid, label, base, grams (of the template), tpos, and the gram's words t1, t2."""
    rows = [
        f"({tid}, '{label}', {str(base).lower()}, {len(words) - 1}, {i}, '{words[i]}', '{words[i + 1]}')"
        for tid, label, base, words in TEMPLATES
        for i in range(len(words) - 1)
    ]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(tid, label, base, grams, tpos, t1, t2)")


def scan(docs: DataFrame) -> DataFrame:
    """Per document doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. ``n_base`` counts the places
    where a phrase's words stand consecutively, ``first_word`` and ``last_word`` are the smallest and largest such start
    (words from 0), or null. ``labels`` adds those of notices found; both lists are distinct, sorted, joined by commas, and
    empty without a find. ``score`` is the largest share of a template that was found: 1 with any phrase in whole.

    A null text has no words. Repeated rows each get a row (rows are told apart by place), ids may be null. No rows give
    no rows; other columns are not read."""
    spark = docs.sparkSession
    words = F.array_remove(F.split(ascii_lower(text_or_empty()), SEPARATORS), "")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words.alias("words"))
    pairs = F.arrays_zip(F.col("words").alias("a"), F.expr("slice(words, 2, greatest(size(words) - 1, 0))").alias("b"))
    grams = rows.select("row", "doc_id", F.posexplode_outer(pairs).alias("pos", "g"))
    grams = grams.select("row", "doc_id", "pos", F.col("g.a").alias("w1"), F.col("g.b").alias("w2"))
    grams = grams.withColumn("h", F.xxhash64("w1", "w2"))
    known = templates(spark).withColumn("th", F.xxhash64("t1", "t2"))
    places = known.select("th", "tid", "tpos", "t1", "t2")
    on = (F.col("h") == F.col("th")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2"))
    met = grams.join(F.broadcast(places), on, "left")
    diagonals = met.groupBy("row", "doc_id", "tid", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.count("*").alias("votes"),
        F.collect_list("tpos").alias("places"),
        F.max("pos").alias("high"),
    )
    along = Window.partitionBy("row", "tid").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > BAND, F.lit(False)).cast("int")
    diagonals = diagonals.withColumn("new", apart)
    diagonals = diagonals.withColumn("island", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    about = known.select("tid", "label", "base", "grams").distinct()
    merged = diagonals.join(F.broadcast(about), "tid", "left")
    # A row per match again, in units that make every template's window equally wide.
    merged = merged.select("*", F.explode_outer("places").alias("tpos")).drop("places")
    at = F.expr(f"(diagonal + tpos) * {UNIT}L div (grams + {SLACK - 1})")
    window = Window.partitionBy("row", "tid", "island").orderBy("at").rangeBetween(0, UNIT)
    bit = "shiftleft(1L, cast(tpos % 64 as int))"
    masks = [F.bit_or(F.expr(f"if(tpos div 64 = {i}, {bit}, 0L)")).over(window) for i in range(MASKS)]
    merged = merged.withColumn("at", at).withColumn("seen", sum(F.bit_count(mask) for mask in masks))
    whole = F.col("base") & (F.col("votes") == F.col("grams")) & (F.col("tpos") == 0)
    islands = merged.groupBy("row", "doc_id", "tid", "island", "label", "base", "grams").agg(
        F.sum(F.when(whole, 1).otherwise(0)).alias("places"),
        F.min(F.when(whole, F.col("diagonal"))).alias("first"),
        F.max(F.when(whole, F.col("diagonal"))).alias("last"),
        F.max("seen").alias("seen"),
        F.max("high").alias("high"),
    )
    share = F.when(F.col("base"), (F.col("places") > 0).cast("double")).otherwise(
        F.col("seen") / F.col("grams").cast("double")
    )
    islands = islands.withColumn("share", F.coalesce(share, F.lit(0.0)))
    hit = F.when(F.col("base"), F.col("places") > 0).otherwise(F.col("share") >= COVERED)
    joined = lambda only: F.array_join(F.array_sort(F.collect_set(F.when(only, F.col("label")))), ",")
    return (
        islands.groupBy("row", "doc_id")
        .agg(
            F.coalesce(F.max("high") + 1, F.lit(0)).cast("long").alias("n_words"),
            F.coalesce(F.sum("places"), F.lit(0)).cast("long").alias("n_base"),
            F.min("first").cast("long").alias("first_word"),
            F.max("last").cast("long").alias("last_word"),
            joined(F.col("base") & (F.col("places") > 0)).alias("base_labels"),
            joined(hit).alias("labels"),
            F.max("share").alias("score"),
        )
        .drop("row")
    )
