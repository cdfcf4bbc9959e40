"""License scans: phrases in place, and an exact set-similarity join of text blocks with templates.

DataFrame operations only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.session import checkpoint_dir

# A word is a run of digits, letters a-z and everything from U+0080 on.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Sentences and notices that name a license, and the texts of licenses.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (
        "mit",
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
        files the software to deal in the software without restriction including without limitation the rights to use copy modify
        merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is
        furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the software the software is provided as is without warranty of any kind
        express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and
        noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability
        whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or
        other dealings in the software""",
    ),
    (
        "isc",
        """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided
        that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author
        disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no
        event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting
        from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in
        connection with the use or performance of this software""",
    ),
    (
        "bsd-3",
        """redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the
        following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and
        the following disclaimer in the documentation and or other materials provided with the distribution neither the name of the
        copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission this software is provided by the copyright holders and contributors as is and any
        express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a
        particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect
        incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or
        services loss of use data or profits or business interruption however caused and on any theory of liability whether in
        contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even
        if advised of the possibility of such damage""",
    ),
    (
        "apache-2",
        """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
        you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed
        to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of
        any kind either express or implied see the license for the specific language governing permissions and limitations under the
        license""",
    ),
    (
        "gpl-3",
        """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as
        published by the free software foundation either version 3 of the license or at your option any later version this program
        is distributed in the hope that it will be useful but without any warranty without even the implied warranty of
        merchantability or fitness for a particular purpose see the gnu general public license for more details you should have
        received a copy of the gnu general public license along with this program if not see http www gnu org licenses""",
    ),
    (
        "mpl-2",
        """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed
        with this file you can obtain one at http mozilla org mpl 2 0""",
    ),
    (
        "zlib",
        """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any
        damages arising from the use of this software permission is granted to anyone to use this software for any purpose including
        commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this
        software must not be misrepresented you must not claim that you wrote the original software if you use this software in a
        product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must
        be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or
        altered from any source distribution""",
    ),
    (
        "unlicense",
        """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile
        sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non
        commercial and by any means""",
    ),
    (
        "bsl-1",
        """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license the software to use reproduce display distribute execute and transmit the software and
        to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all
        subject to the following""",
    ),
]
THRESHOLD = 0.8


class _Template:
    """A template's distinct words, how many of them a block needs, and the words that a window spans."""

    def __init__(self, label: str, text: str, threshold: float):
        words = text.split()
        self.label, self.words, self.span = label, sorted(set(words)), len(words) * 3 // 2
        self.need = -(-round(threshold * 100) * len(self.words) // 100)


def _words(text: Column) -> Column:
    """Words of a text that has no A-Z."""
    return F.filter(F.split(text, GAP), lambda x: x != "")


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    here = lambda i: sum((F.when(F.get(words, i + k) == p, 1).otherwise(0) for k, p in enumerate(parts[1:], 1)), F.when(F.get(words, i) == parts[0], 1).otherwise(0)) == len(parts)
    return F.filter(F.sequence(F.lit(0), F.size(words)), here)


def _scanned(docs: DataFrame, id_col: str, text_col: str, templates: list[_Template]) -> DataFrame:
    """A row per input row, in a table of the shared folder, so that texts are split once.

    row, doc_id, n_words, places of each phrase, the words of templates (``t``) and where they stand
    (``p``), and the distinct words of templates in each line that holds enough for some template.
    """
    spark = docs.sparkSession
    tokens = sorted({w for t in templates for w in t.words})
    least = min((t.need for t in templates), default=1)
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    split = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), low.alias("low")).select("*", _words(F.col("low")).alias("w"))
    hits = F.filter(F.transform("w", lambda x, i: F.when(x.isin(tokens), F.struct(i.alias("p"), x.alias("t")))), lambda x: x.isNotNull())
    lines = F.filter(F.transform(F.split("low", "\n"), lambda x: F.array_distinct(F.filter(_words(x), lambda y: y.isin(tokens)))), lambda b: F.size(b) >= least)
    none = F.array().cast("array<int>")
    found = [F.when(sum((F.when(F.col("low").contains(w), 0).otherwise(1) for w in set(p.split())), F.lit(0)) == 0, _places(F.col("w"), p)).otherwise(none).alias(f"p{i}") for i, p in enumerate(PHRASES)]
    rows = split.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), *found, hits.alias("hits"), lines.alias("lines"))
    path = f"{checkpoint_dir(spark)}/license-scan-{uuid.uuid4().hex}"
    rows.select("row", "doc_id", "n_words", *[f"p{i}" for i in range(len(PHRASES))], F.col("hits.p").alias("p"), F.col("hits.t").alias("t"), "lines").write.parquet(path)
    return spark.read.parquet(path)


def _joined(blocks: DataFrame, templates: list[_Template], order: dict[str, int]) -> DataFrame:
    """(row, block, template, n) of every block (row, block, b) that holds enough of a template's words.

    Words are in the global order, rarest first.  A block that reaches the threshold holds one of
    the template's first size - needed + 1 words (prefix filter), has enough words (length filter),
    and enough of them from that word on in the common order (positional filter); what is left is
    verified on the sets.  What is broadcast is the templates' words.
    """
    spark = blocks.sparkSession
    known = [(sorted(t.words, key=order.__getitem__), t) for t in templates]
    prefix = [(w, order[w], i, t.need) for i, (words, t) in enumerate(known) for w in words[: len(words) - t.need + 1]]
    index = F.broadcast(spark.createDataFrame(prefix, "token string, at int, template int, need int"))
    sets = F.broadcast(spark.createDataFrame([(i, t.words) for i, t in enumerate(templates)], "template int, set array<string>"))
    ranked = F.array(*[F.lit(w) for w in sorted(order, key=order.__getitem__)])
    later = F.size(F.filter("b", lambda x: F.array_position(ranked, x) > F.col("at")))
    met = blocks.select("row", "block", "b", F.explode("b").alias("token")).join(index, "token").where((F.size("b") >= F.col("need")) & (later >= F.col("need")))
    full = met.join(sets, "template").select("row", "block", "template", "need", F.size(F.array_intersect("b", "set")).alias("n"))
    return full.where("n >= need").select("row", "block", "template", "n").distinct()


def _matches(rows: DataFrame, templates: list[_Template]) -> DataFrame:
    """(row, block, label, containment) of blocks; see `template_matches`."""
    spark = rows.sparkSession
    seen = {r.token: r["count"] for r in rows.select(F.explode(F.array_distinct("t")).alias("token")).groupBy("token").count().collect()}  # at most the templates' words
    tokens = sorted({w for t in templates for w in t.words}, key=lambda w: (seen.get(w, 0), w))
    order = {w: i for i, w in enumerate(tokens)}
    facts = F.broadcast(spark.createDataFrame([(i, t.label, len(t.words), t.need, t.span, t.words) for i, t in enumerate(templates)], "template int, label string, size int, need int, span int, set array<string>"))
    in_lines = _joined(rows.select("row", F.posexplode("lines").alias("block", "b")), templates, order)
    whole = _joined(rows.select("row", F.lit(None).cast("int").alias("block"), F.array_distinct("t").alias("b")), templates, order)
    tried = rows.select("row", "p", "t").join(whole.select("row", "template"), "row").join(facts, "template")
    held_once = lambda x: F.explode(F.array(x))  # noqa: E731  # a plan step of its own, so that x isn't worked out again for each use
    own = tried.select("row", "template", "need", "span", held_once(F.filter(F.arrays_zip("p", "t"), lambda x: F.array_contains("set", x.t))).alias("h"))
    inside = lambda x, i: F.size(F.array_distinct(F.transform(F.filter(F.slice("h", i + 1, F.col("span")), lambda y: y.p < x.p + F.col("span")), lambda y: y.t)))
    held = own.select("row", F.lit(None).cast("int").alias("block"), "template", "need", held_once(F.array_max(F.transform("h", inside))).alias("n")).where("n >= need").drop("need")
    return in_lines.unionByName(held).join(facts, "template").select("row", "block", "label", (F.col("n") / F.col("size")).alias("containment"))


def template_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, row, block, label, containment) of every block that holds enough of a template.

    Blocks are the lines, numbered among those that hold enough template words at all, and windows
    over all words of the text, line breaks or not, from every template word on and half as long
    again as the template; the best window of a template has a null ``block``.  Containment is the
    share of the template's distinct words that the block has.  ``row`` tells input rows apart.

    A text is joined as one block first, since it holds what its windows hold; windows of the texts
    that remain are then looked at one by one.
    """
    made = [_Template(label, text, threshold) for label, text in templates]
    rows = _scanned(docs, id_col, text_col, made)
    return rows.select("row", "doc_id").join(_matches(rows, made), "row").select("doc_id", "row", "block", "label", "containment")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base labels come from phrases whose words stand consecutively (across lines too); the template
    join adds its own.  ``score`` is 1 where a phrase stands, else the best containment found.

    Null and empty texts have no words, no labels (empty strings), null places and score 0.  Rows
    that repeat an id are scanned each by itself.  An empty table gives an empty result; other
    columns are ignored.
    """
    made = [_Template(label, text, threshold) for label, text in templates]
    rows = _scanned(docs, id_col, text_col, made)
    every = F.concat(*[F.col(f"p{i}") for i in range(len(PHRASES))])
    named = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())]))
    base = rows.select("row", "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), F.array_sort(F.array_distinct(named)).alias("base"))
    more = _matches(rows, made).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    both = base.join(more, "row", "left").withColumn("more", F.coalesce("more", F.array().cast("array<string>")))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "more")), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
