"""License scans over a positional rare-token index; DataFrame operations only.

Each text keeps the positions of its licence words, and what follows words of key phrases. Each template is looked up by the
highest-IDF words of its mandatory key phrase; where all of them agree in relative position there is a candidate alignment,
which must show the whole key phrase, function words included. As an alignment can't be verified without these words, no
other text of the template needs to be looked at."""

from __future__ import annotations

import re
from itertools import takewhile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

#: Runs of ASCII letters and digits and of anything beyond ASCII. Capitals are in it, as only kept words are folded.
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases that give a label by themselves.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Label, mandatory key phrase, and a wording of the notice that contains it.
TEMPLATES = (
    ("mit", "mit license", "Released under the MIT License."),
    ("mit", "permission is hereby granted free of charge", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("apache", "apache license", "Licensed under the Apache License, Version 2.0."),
    ("apache", "apache license", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "general public license", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "gnu general public license", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "cc by nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "cc by sa", "Licensed under CC BY-SA 4.0."),
    ("bsd", "redistribution and use in source and binary forms", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "redistribution and use in source and binary forms", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("mpl", "mozilla public license", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl", "mozilla public license", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("mit", "permission is hereby granted free of charge", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc", "permission to use copy modify and or distribute this software", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("apache", "apache license", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("lgpl", "gnu lesser general public license", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "gnu affero general public license", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("unlicense", "free and unencumbered software released into the public domain", "This is free and unencumbered software released into the public domain."),
    ("cc0", "cc0 1 0 universal", "Released under the CC0 1.0 Universal Public Domain Dedication."),
)
#: Function words, which are not indexed. A key phrase's own are verified as what follows its indexed words.
STOP = frozenset("a and any as at be by in is it may not of or that the this to use with you".split())


def _words(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def vocabulary() -> list[str]:
    """The indexed words: those of phrases and templates but for function words."""
    return sorted({w for _, key, text in TEMPLATES for w in _words(f"{text} {key}")}.union(*[p.split() for p, _ in PHRASES]) - STOP)


def key_words() -> list[str]:
    """The indexed words of the templates' key phrases."""
    return sorted({w for _, key, _ in TEMPLATES for w in _words(key)} - STOP)


def postings(spark: SparkSession) -> DataFrame:
    """(template, label, tpos, word, mandatory, then): a row for each indexed word of each template, and for those of the key
    phrase the function words that follow in it; a table of fixed size."""
    rows = []
    for t, (label, key, text) in enumerate(TEMPLATES):
        words, phrase = _words(text), _words(key)
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        for i, w in enumerate(words):
            if w not in STOP:
                inside = at <= i < at + len(phrase)
                then = " ".join(takewhile(STOP.__contains__, words[i + 1 : at + len(phrase)])) if inside else ""
                rows.append(f"({t}, '{label}', {i}, '{w}', {str(inside).lower()}, '{then}')")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(template, label, tpos, word, mandatory, then)")


def longest_run() -> int:
    """The most function words one after another in a key phrase."""
    return max(len(list(takewhile(STOP.__contains__, _words(key)[i:]))) for _, key, _ in TEMPLATES for i in range(len(_words(key))))


def lower_ascii(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def positions(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and hits, the (pos, word, after) of every indexed word of the whole text, in order; after has the words
    that follow one of a key phrase, as many as function words follow each other in one."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TOKEN), F.lit(0))
    # Longer words than any indexed one are told by their length alone.
    longest = max(map(len, vocabulary()))
    hits = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("pos"), F.when(F.length(w) <= longest, lower_ascii(w)).alias("word"))), lambda x: x["word"].isin(vocabulary()))
    after = lambda x: F.when(x["word"].isin(key_words()), F.concat(lower_ascii(F.array_join(F.slice("words", x["pos"] + 2, longest_run()), " ")), F.lit(" ")))
    hits = F.transform(hits, lambda x: F.struct(x["pos"].alias("pos"), x["word"].alias("word"), after(x).alias("after")))
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words.alias("words")).select("row", "doc_id", F.size("words").cast("long").alias("n_words"), hits.alias("hits"))


def phrase_starts(phrase: str) -> Column:
    """Positions where the phrase's words stand one after another. Its words are all indexed, so they are neighbours in hits."""
    words = phrase.split()

    def found(i: Column) -> Column:
        ok = F.get("hits", i)["word"] == words[0]
        for k, w in enumerate(words[1:], 1):
            ok = ok & (F.get("hits", i + k)["word"] == w) & (F.get("hits", i + k)["pos"] == F.get("hits", i)["pos"] + k)
        return F.coalesce(ok, F.lit(False))

    n = F.size("hits") - (len(words) - 1)
    some = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(some, found), lambda i: F.get("hits", i)["pos"].cast("long"))


def scan_licenses(docs: DataFrame, rare_words: int = 8, least: float = 0.6) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for each row of docs (doc_id, text).

    Each template is looked up by up to `rare_words` of its own key words, however many other words a text has.
    n_base counts the places of the base phrases; labels adds those of templates found by the index with at least `least`
    of their IDF weight in place; score is the best such share, 0 if none. A null text is empty: no words, null places,
    empty labels. Repeated rows each get a row; other columns are ignored; an empty table gives none."""
    spark = docs.sparkSession
    index = materialise(positions(docs), "licence-words")
    some = index.filter(F.size("hits") > 0)
    df = some.select(F.explode(F.array_distinct(F.col("hits.word"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    # At most as many rows as the templates have distinct words: bounded by TEMPLATES.
    n = index.agg(F.count(F.lit(1)).alias("n_docs"))
    posted = postings(spark).join(df, "word", "left").join(F.broadcast(n), F.lit(True), "left").withColumn("idf", F.log((F.col("n_docs") + 2) / (F.coalesce("df", F.lit(0)) + 1)))
    posted = F.broadcast(materialise(posted.select("template", "label", "tpos", "word", "mandatory", "then", "idf"), "postings"))
    order = W.partitionBy("template").orderBy(F.desc("idf"), "tpos")
    anchors = F.broadcast(posted.filter("mandatory").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rare_words).select("template", "tpos", "word", F.max("rank").over(W.partitionBy("template")).alias("needed")))
    rare = some.select("row", F.explode(F.filter("hits", lambda x: x["word"].isin(key_words()))).alias("hit")).select("row", F.col("hit.pos").alias("pos"), F.col("hit.word").alias("word"))
    aligned = rare.join(anchors, "word").select("row", "template", "needed", (F.col("pos") - F.col("tpos")).alias("offset")).groupBy("row", "template", "needed", "offset").agg(F.count(F.lit(1)).alias("agree"))
    whole = F.broadcast(posted.groupBy("template", "label").agg(F.collect_list(F.struct("tpos", "word", "mandatory", "then", "idf")).alias("wanted"), F.sum("idf").alias("total")))
    shown = aligned.filter("agree = needed").drop("agree", "needed").join(some.select("row", "hits"), "row").join(whole, "template")
    here = F.map_from_entries(F.transform("hits", lambda h: F.struct(h["pos"], F.struct(h["word"].alias("word"), h["after"].alias("after")))))
    at = lambda x: F.col("here")[x["tpos"] + F.col("offset")]
    matched = F.filter("wanted", lambda x: F.coalesce((at(x)["word"] == x["word"]) & ((x["then"] == "") | F.startswith(at(x)["after"], F.concat(x["then"], F.lit(" ")))), F.lit(False)))
    shown = shown.withColumn("here", here).withColumn("matched", matched)
    mandatory = lambda c: F.size(F.filter(c, lambda x: x["mandatory"]))
    share = F.aggregate("matched", F.lit(0.0), lambda acc, x: acc + x["idf"]) / F.greatest(F.col("total"), F.lit(1e-9))
    verified = shown.filter(mandatory(F.col("matched")) == mandatory(F.col("wanted"))).select("row", "label", F.least(share, F.lit(1.0)).alias("share")).filter(F.col("share") >= least)
    best = verified.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("share").alias("score"))
    starts = [phrase_starts(p) for p, _ in PHRASES]
    based = index.withColumn("places", F.flatten(F.array(*starts))).withColumn("base", F.array_compact(F.array(*[F.when(F.size(s) > 0, F.lit(label)) for s, (_, label) in zip(starts, PHRASES, strict=True)]))).drop("hits")
    out = based.join(best, "row", "left")
    labels = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    return out.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"), labels(F.col("base")).alias("base_labels"), labels(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
