"""License scans by diagonal voting between texts and license templates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import cut

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that name a license, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Short forms, openings and whole texts of public license notices, and their labels.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
)


@dataclass(frozen=True)
class Scan:
    """k: words of a gram. slack: diagonals so far apart merge. min_share: of a template's words that a verified span holds."""

    k: int = 5
    slack: int = 3
    min_share: float = 0.8
    phrases: dict[str, str] = field(default_factory=lambda: dict(PHRASES))
    templates: tuple[tuple[str, str], ...] = TEMPLATES


def _lower(text: Column) -> Column:
    """Lower case for A to Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(_lower(text), F.lit(WORD), F.lit(0))


def _grams(words: Column, k: int) -> Column:
    """(pos, h) of each k-word window."""
    n = F.size(words)
    made = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get(words, i + j) for j in range(k)]).alias("h")))
    return F.when(n >= k, made)


def _posts(spark: SparkSession, how: Scan) -> DataFrame:
    """tpl, label, tn (words), tpos, h, tg (words): the template positions, one row for each gram. Their number is fixed."""
    rows = [(i, label, text) for i, (label, text) in enumerate(how.templates)]
    out = spark.createDataFrame(rows, "tpl int, label string, text string").select("tpl", "label", _words(F.col("text")).alias("tw"))
    out = out.select("tpl", "label", F.size("tw").alias("tn"), "tw", F.explode(_grams(F.col("tw"), how.k)).alias("g"))
    return out.select("tpl", "label", "tn", F.col("g.pos").alias("tpos"), F.col("g.h").alias("h"), F.slice("tw", F.col("g.pos") + 1, how.k).alias("tg"))


def _places(phrase: str, label: str) -> Column:
    """First word a of each place where the phrase's words stand consecutively, with its label."""
    parts = phrase.split(" ")

    def here(i: Column) -> Column:
        hit = F.lit(True)
        for j, part in enumerate(parts):
            hit = hit & F.get(F.col("words"), i + j).eqNullSafe(part)
        return hit

    found = F.transform(F.filter(F.sequence(F.lit(0), F.size("words") - 1), here), lambda i: F.struct(i.alias("a"), F.lit(label).alias("label")))
    held = F.lit(True)
    for part in dict.fromkeys(sorted(parts, key=len, reverse=True)):
        held = held & F.array_contains("words", part)
    return F.when(held, found).otherwise(F.array().cast("array<struct<a:int,label:string>>"))


def _rows(docs: DataFrame, how: Scan) -> DataFrame:
    """One row for each row of docs, without its text: doc_id, t (hash of the text), n_words, what the base phrases give, and met, the grams (pos, h, words) whose hash a template has.

    The template hashes are few and fixed, so they are tested where the grams are made: only grams that will find
    their partner in the join become rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    wanted = [r["h"] for r in _posts(docs.sparkSession, how).select("h").distinct().collect()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), _words(text).alias("words"))
    rows = rows.withColumn("places", F.concat(*[_places(phrase, label) for phrase, label in how.phrases.items()]))
    met = F.filter(_grams(F.col("words"), how.k), lambda g: g["h"].isin(wanted))
    met = F.transform(met, lambda g: F.struct(g["pos"].alias("pos"), g["h"].alias("h"), F.slice("words", g["pos"] + 1, how.k).alias("gram")))
    return rows.select(
        "doc_id", "t", F.size("words").cast("long").alias("n_words"),
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda x: x["a"])).cast("long").alias("first_word"),
        F.array_max(F.transform("places", lambda x: x["a"])).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.transform("places", lambda x: x["label"]))).alias("base"),
        met.alias("met"),
    )


def _spans(rows: DataFrame, how: Scan) -> DataFrame:
    k = how.k
    grams = rows.where(F.size("met") > 0).select(F.col("doc_id").alias("d"), "t", F.explode("met").alias("g")).select("d", "t", "g.*")
    hits = grams.join(F.broadcast(_posts(rows.sparkSession, how)), "h").where(F.col("gram") == F.col("tg"))
    # Rows equal in id and text bring the same hits: sets count them once.
    diagonals = hits.groupBy("d", "t", "tpl", "label", "tn", (F.col("pos") - F.col("tpos")).alias("diag")).agg(
        F.collect_set("tpos").alias("tposs"), F.min("pos").alias("first"), (F.max("pos") + (k - 1)).alias("last")
    )
    same = Window.partitionBy("d", "t", "tpl").orderBy("diag")
    before = F.lag(F.struct("diag", "first", "last")).over(same)
    # A longer stretch of other words than this leaves less than min_share of the template on both sides together.
    room = k + (1 - how.min_share) * F.col("tn")
    apart = before.isNull() | (F.col("diag") - before["diag"] > how.slack) | (F.col("first") - before["last"] > room) | (before["first"] - F.col("last") > room)
    runs = diagonals.withColumn("run", F.sum(apart.cast("int")).over(same))
    cover = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("tposs")), lambda p: F.sequence(p, p + (k - 1)))))
    found = runs.groupBy("d", "t", "tpl", "label", "tn", "run").agg(F.size(cover).alias("covered"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum(F.size("tposs")).alias("votes"))
    return found.withColumn("score", F.least(F.lit(1.0), F.col("covered") / F.col("tn")))


def spans(docs: DataFrame, how: Scan = Scan()) -> DataFrame:
    """Verified spans: d (doc_id), t (hash of the text), tpl, label, first and last word of the span, votes, score (share of the template's words in it).

    The rolling k-word grams of every text meet the templates' grams in a join by hash and are compared word by word.
    Hits vote for their diagonal (place in the text less place in the template). Diagonals at most how.slack apart, as
    inserted or missing words make them, merge into one span if their places in the text also overlap or follow each
    other with no more other words between than how.min_share leaves room for. score counts the template's words that
    the span's hits cover; from how.min_share on a span names its license.
    """
    return _spans(_rows(docs, how), how)


def scan(docs: DataFrame, how: Scan = Scan()) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    base_labels come from the phrases; labels add those of templates found by diagonal voting. score is 1 where a
    phrase stands, else the best share of a template found, and 0 where none was. A null text counts as empty.
    Equal rows each get their row. Other columns of docs are ignored. Texts are read once, in time linear in their
    length; what is found in them, without the texts, is written to the shared folder.
    """
    rows = cut(_rows(docs, how), "license_rows")
    good = F.col("score") >= how.min_share
    found = _spans(rows, how).groupBy("d", "t").agg(F.collect_set(F.when(good, F.col("label"))).alias("more"), F.max("score").alias("best"))
    out = rows.alias("l").join(found.alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.d")) & (F.col("l.t") == F.col("r.t")), "left")
    empty = F.array().cast("array<string>")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", empty))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
