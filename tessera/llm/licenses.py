"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

DataFrame functions only. A window is two adjacent five-word shingles, one window starting at every shingle, of texts
and templates alike; of each window BANDS minima are taken under as many hashes, one to a band. Two equal windows agree
in every band; two that share one shingle agree in some band with a chance of 1 - (2/3) ** BANDS. So a quotation in which
two adjacent shingles of the template are left together is retrieved for certain, and at a containment of 0.8 that is
every one that does not have a break after each single shingle; even then it has many windows that share one. A template
of a single shingle has a window of one, and so have texts for it. What is retrieved is verified over all positions of
the text, so that inserted words cost a quotation only the shingles they break.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, durable

WORD = r"[a-z0-9]+(?:[.'-][a-z0-9]+)*+"
SHINGLE = 5
BANDS = 4

# Wordings of common license statements.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS
        IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd-2-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
        ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
        LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
        CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
        EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
        "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
        DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
        OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
        purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
        not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
        original software. 3. This notice may not be removed or altered from any source distribution.""",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You
        should have received a copy of the GNU General Public License along with this program. If not, see
        <https://www.gnu.org/licenses/>.""",
}


def shingles(text) -> F.Column:
    """Hashes of the five-word shingles of a text in order, by lower-cased words of letters and digits; none under five words."""
    return F.transform(_starts(F.size(text)), lambda i: F.xxhash64(*[F.get(text, i + j) for j in range(SHINGLE)]))


def _starts(n):
    return F.when(n >= SHINGLE, F.sequence(F.lit(0), n - SHINGLE)).otherwise(F.array().cast("array<int>"))


def words(text) -> F.Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def band_keys(h, single: bool) -> F.Column:
    """The band values of the windows of shingle hashes h; single: of the windows of one shingle too."""
    n = F.size(h)
    minima = []
    for k in range(1, BANDS + 1):
        own = F.transform(h, lambda x: F.xxhash64(x, F.lit(k)))  # noqa: B023
        # of a lone shingle the window is itself
        minima.append(F.when(n == 1, own).otherwise(F.zip_with(F.slice(own, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(own, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x, y: F.least(x, y))))
    return F.concat(*minima, *([F.transform(h, lambda x: F.xxhash64(x, F.lit(0)))] if single else []))


def _stretches() -> F.Column:
    """(last, n, before, width, s, e) of a text with positions p against template t: the stretches of scan().

    One pass over the positions keeps where each template shingle was last seen. The need-th latest of these is where
    the shortest stretch that ends here and reaches the threshold starts; the found-th latest, where the one with all.
    """
    own = F.filter(F.transform("p", lambda q: F.struct(q["i"].alias("i"), F.array_position(F.col("t"), q["x"]).alias("j"))), lambda q: q["j"] > 0)
    one = lambda x: F.lit(x).cast("int")
    start = F.struct(F.array_repeat(one(-1), F.size("t")).alias("last"), F.lit(0).cast("long").alias("n"), one(-1).alias("before"), one(2147483647).alias("width"), one(-1).alias("s"), one(-1).alias("e"))

    def step(acc, q):
        last = F.transform(acc["last"], lambda v, k: F.when(k + 1 == q["j"], q["i"]).otherwise(v))
        seen = F.transform(F.array(last), lambda v: F.struct(v.alias("last"), F.sort_array(v, False).alias("d")))
        ends = F.transform(seen, lambda v: F.struct(v["last"].alias("last"), F.get(v["d"], F.col("need") - 1).alias("enough"), F.get(v["d"], F.col("found") - 1).alias("all")))

        def after(v):
            more, closer = v["enough"] > acc["before"], (v["all"] >= 0) & (q["i"] - v["all"] < acc["width"])
            keep = lambda new, old: F.when(closer, new).otherwise(acc[old]).alias(old)
            return F.struct(v["last"].alias("last"), (acc["n"] + more.cast("long")).alias("n"), F.greatest(acc["before"], v["enough"]).alias("before"), keep(q["i"] - v["all"], "width"), keep(v["all"], "s"), keep(q["i"], "e"))

        return F.get(F.transform(ends, after), F.lit(0))

    return F.aggregate(own, start, step)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """(doc_id, license, containment, start_word, end_word, n_windows): templates that a document quotes.

    containment: share of the template's distinct shingles in the text, at least threshold; start_word and end_word
    bound the shortest stretch that holds them, the earliest of equals; n_windows counts the stretches that reach the
    threshold and hold no shorter one that does. Templates (a dict, so bounded by the caller) must have five words.
    Null, empty and short texts quote nothing; a repeated row or id gives its rows once, with the best of its texts;
    rows with a null id are documents of their own, told apart by their texts; other columns are ignored; an empty table gives an empty result. All figures are exact. Map side only, apart from
    dropping repeated rows of retrieved texts and the final grouping by document and template of what was verified.
    """
    spark = docs.sparkSession
    given = TEMPLATES if templates is None else templates
    hashed = spark.createDataFrame(list(given.items()), "license string, body string").select("license", shingles(words(F.col("body"))).alias("h"))
    known = hashed.select("license", "h", band_keys(F.col("h"), False).alias("bands"), F.transform("h", lambda x: F.xxhash64(x, F.lit(0))).alias("alone")).collect()
    sets = {r.license: sorted(set(r.h)) for r in known}
    if short := [k for k, v in sets.items() if not v]:
        raise ValueError(f"templates need {SHINGLE} words: {short}")
    if not sets:
        return spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, license string, containment double, start_word long, end_word long, n_windows long")
    keys = {r.license: sorted(set(r.alone if len(r.h) == 1 else r.bands)) for r in known}
    array = lambda xs: F.array(*map(F.lit, xs)).cast("array<bigint>")
    every, bands = (array(sorted({x for v in d.values() for x in v})) for d in (sets, keys))
    single = any(len(r.h) == 1 for r in known)
    # an explode of one element keeps the optimiser from moving the filters below and repeating the words in them
    held = lambda x, name: F.explode(F.array(x)).alias(name)
    h = docs.select("doc_id", held(words(F.col("text").cast("string")), "w")).select("doc_id", held(shingles(F.col("w")), "h")).filter(F.size("h") > 0)
    # documents without an id are told apart by their texts
    h = h.withColumn("nameless", F.when(F.col("doc_id").isNull(), F.xxhash64("h")))
    found = h.select("doc_id", "nameless", "h", held(F.array_intersect(band_keys(F.col("h"), single), bands), "k")).filter(F.size("k") > 0)
    named = F.array_compact(F.array(*[F.when(F.arrays_overlap("k", array(v)), F.lit(name)) for name, v in keys.items()]))
    own = F.array_intersect("h", every)
    hits = found.select("doc_id", "nameless", named.alias("licenses"), "h", held(own, "own"))
    at = F.filter(F.transform("h", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: F.array_contains("own", p["x"]))
    near = durable(hits.select("doc_id", "nameless", "licenses", at.alias("p")).distinct(), "license-shingles")
    least = {k: next(m for m in range(1, len(v) + 1) if m / len(v) >= threshold or m == len(v)) for k, v in sets.items()}
    sides = F.broadcast(spark.createDataFrame([(k, v, least[k]) for k, v in sets.items()], "license string, t array<bigint>, need int"))
    pairs = near.select("doc_id", "nameless", "p", F.explode("licenses").alias("license")).join(sides, "license").withColumn("found", F.size(F.array_intersect("p.x", "t")))
    pairs = pairs.withColumn("containment", F.col("found") / F.size("t").cast("double")).filter(F.col("containment") >= threshold)
    best = F.struct(-F.col("containment"), F.col("x.width"), F.col("x.s"), F.col("x.e"))
    out = pairs.withColumn("x", _stretches()).groupBy("doc_id", "nameless", "license").agg(F.min(best).alias("b"), F.sum("x.n").alias("n_windows")).select(
        "doc_id", "license", (-F.col("b.col1")).alias("containment"), F.col("b.s").cast("long").alias("start_word"), (F.col("b.e") + SHINGLE).cast("long").alias("end_word"), "n_windows"
    )
    out = durable(out, "license-found")
    discard(near)
    return out
