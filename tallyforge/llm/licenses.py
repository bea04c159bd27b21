"""License scans: MinHash bands over overlapping text windows retrieve templates, shingle containment verifies them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import joined, table, without
from tallyforge.llm.decontaminate import spans

OUT = ("n_licenses", "licenses", "matches")

# Notices and texts as their licenses publish them.
AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:"""
BSD_TWO = """Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of
this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for
the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an
overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License."""
APACHE_REST = """You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version."""
GPL_REST = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You
should have received a copy of the GNU General Public License along with this program."""
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", APACHE),
    ("apache-2.0", f"{APACHE} {APACHE_REST}"),
    ("bsd", BSD),
    ("bsd", f"{BSD} {BSD_TWO} {BSD_AS_IS}"),
    ("bsd", f"{BSD} {BSD_TWO} {BSD_THIRD} {BSD_AS_IS}"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", GPL),
    ("gpl-3.0", f"{GPL} {GPL_REST}"),
    ("isc", ISC),
    ("isc", f"{ISC} {ISC_AS_IS}"),
    ("mit", "Released under the MIT License."),
    ("mit", MIT),
    (
        "mit",
        f"{MIT}, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        f"copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {AS_IS}",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("unlicense", UNLICENSE),
    ("zlib", ZLIB),
)


def shingles(df: DataFrame, text: Column, k: int) -> DataFrame:
    """Adds ``g``: hashes of all runs of k words (ASCII letters and digits in lower case); none where there are fewer."""
    found = F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))
    hashed = df.withColumn("__h", F.transform(found, lambda w: F.xxhash64(w)))
    return spans(hashed, "__h", "g", k, lambda a, b: F.xxhash64(a, b)).drop("__h")


def least_shingles(shingle_set: Column, bands: int) -> Column:
    """``bands`` bands of one MinHash each: (number, the shingle whose hash under that number is least)."""
    least = lambda i: F.array_min(F.transform(shingle_set, lambda h: F.struct(F.xxhash64(h, i).alias("rank"), h.alias("shingle"))))
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda i: F.struct(i.alias("band"), least(i)["shingle"].alias("least")))


def scan_licenses(
    spark: SparkSession,
    docs: DataFrame,
    *,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    k: int = 5,
    bands: int = 64,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with n_licenses, licenses (sorted names, comma-joined) and matches (name, first shingle, containment).

    A template of s shingles is sought in windows of 2L shingles, one every L, where L is the power of two at or above s:
    any place where it stands lies whole in one of them, at a Jaccard of at least 1/4, and at 0.8 containment of at least
    0.18, so that 64 bands of one MinHash miss it with a probability of 3e-6 at most.

    A band's MinHash is kept as the shingle that attains it. A window meets a template in a band if its own least shingle
    there is the template's; so it must hold that shingle. All shingles of all documents are joined with the templates'
    least shingles, the only ones that can decide a band, and windows around the places found are signed and joined on
    (length, band, least shingle). Documents that a band retrieves are verified by exact containment: at least
    ``threshold`` of the template's shingles stand in the document. Words inserted into a notice may spread it over two
    windows or more; each of them can retrieve it, and all count when it is verified. ``first`` is where the first window
    that retrieved it begins.

    A null or empty text, or one of fewer than k words, has no license. Rows are told apart by id and text; repeated
    rows get the same values; null ids are allowed. No templates: nothing is found. Input columns named like an output
    column are replaced.
    """
    docs = without(docs, [c for c in OUT if c not in (id_col, text_col)])
    known = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "t int, name string, text string")
    known = shingles(known, F.col("text"), k).select("t", "name", F.array_distinct("g").alias("tset")).filter(F.size("tset") > 0)
    length = F.pow(F.lit(2), F.ceil(F.log2(F.size("tset").cast("double")))).cast("int")
    known = table(spark, known.withColumn("span", length), "license-templates")
    keys = known.select("t", "span", F.explode_outer(least_shingles(F.col("tset"), bands)).alias("b")).select("t", "span", "b.band", "b.least")
    keys = table(spark, keys, "license-bands")
    deciding = table(spark, keys.select("span", F.col("least").alias("h")).distinct(), "license-least")

    me = F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__text")
    common = shingles(docs.select(*me, F.col(text_col).alias("__t")), F.col("__t"), k)
    # explode() would have Catalyst filter on the array first, which repeats all of its passes; so the outer form
    places = common.select("__id", "__text", F.posexplode_outer("g").alias("at", "h")).filter("h is not null")
    places = joined(spark, places, deciding, "h", "inner").select("__id", "__text", "span", F.floor(F.col("at") / F.col("span")).cast("int").alias("w"))
    around = F.when(F.col("w") > 0, F.array(F.col("w") - 1, "w")).otherwise(F.array("w"))
    places = places.select("__id", "__text", F.explode(F.transform(around, lambda w: F.struct("span", w.alias("w")))).alias("p"))
    places = places.groupBy(F.col("__id").alias("__sid"), F.col("__text").alias("__stext")).agg(F.collect_set("p").alias("places"))
    places = table(spark, places, "license-places")

    same = F.col("__id").eqNullSafe(F.col("__sid")) & F.col("__text").eqNullSafe(F.col("__stext"))
    chosen = joined(spark, docs.select(*me, F.col(text_col).alias("__t")), places, same, "inner", 200).dropDuplicates(["__id", "__text"])
    chosen = table(spark, shingles(chosen, F.col("__t"), k).select("__id", "__text", "places", "g"), "license-shingles")
    shingles_of = lambda p: F.array_distinct(F.slice("g", p["w"] * p["span"] + 1, 2 * p["span"]))
    window = F.transform("places", lambda p: F.struct(p["span"].alias("span"), (p["w"] * p["span"]).alias("first"), shingles_of(p).alias("wset")))
    windows = table(spark, chosen.select("__id", "__text", F.explode_outer(window).alias("w")).select("__id", "__text", "w.*"), "license-windows")
    signed = windows.select("__id", "__text", "span", "first", F.explode_outer(least_shingles(F.col("wset"), bands)).alias("b"))
    signed = signed.select("__id", "__text", "span", "first", "b.band", "b.least")
    hits = joined(spark, signed, keys, ["span", "band", "least"], "inner").groupBy("__id", "__text", "t").agg(F.min("first").alias("first"))
    hits = hits.groupBy(F.col("__id").alias("__sid"), F.col("__text").alias("__stext")).agg(F.collect_list(F.struct("t", "first")).alias("hits"))

    tried = chosen.select("__id", "__text", "g").join(hits, same)
    tried = tried.select("__sid", "__stext", F.array_distinct("g").alias("own"), F.explode("hits").alias("hit")).select("__sid", "__stext", "own", "hit.*")
    share = F.size(F.array_intersect("tset", "own")) / F.size("tset")
    verified = joined(spark, tried, known.drop("span"), "t", "inner", 2000).withColumn("containment", share).filter(F.col("containment") >= threshold)
    match = F.struct("name", "first", "containment")
    found = verified.groupBy("__sid", "__stext").agg(F.array_sort(F.collect_set("name")).alias("__names"), F.array_sort(F.collect_set(match)).alias("__matches"))
    found = table(spark, found, "licenses")
    every = joined(spark, docs.select(*docs.columns, *me), found, same, "left", 200)
    return every.select(
        *docs.columns,
        F.when(F.col("__names").isNull(), F.lit(0)).otherwise(F.size("__names")).cast("long").alias("n_licenses"),
        F.coalesce(F.array_join("__names", ","), F.lit("")).alias("licenses"),
        F.coalesce("__matches", F.array().cast("array<struct<name:string,first:int,containment:double>>")).alias("matches"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(spark, docs).select("doc_id", "n_licenses", "licenses")
