"""License scans by diagonal voting, in DataFrame functions alone.

Every pair of neighbouring words of a text is hashed and joined to the pairs of the license templates; the words themselves are
compared in the join, so no hash collision votes. A hit at word p of the text and word t of a template lies on diagonal p - t.
Hits are summed by diagonal; diagonals of one template that are at most `SHIFT` words apart and whose hits are at most `GAP`
words apart are merged, which takes up words put in or left out; a merged span is read once more in the text's order, and only
hits that go on in the template count, each of its pairs once: it stands if these cover `COVER` of the template's pairs. A base phrase stands where one diagonal has all of its pairs: that is a place where its words stand consecutively.

Words: A-Z lower-cased, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. score: the largest part of a template that a span covers, 0 without
hits. The templates are constants, so broadcasting them is bounded. Each row has a number of its own from its place in the
scan, the same on a second attempt, and one marker row carries its counts along: texts are read once and never shuffled.

Cases: null and empty texts have no words and no labels; each input row gives one row, repeated or not; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Phrases that the base labels stand for.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: The method's own labels: opening words of licenses and notices, by label.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("mit", "released under the mit license"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc-by-nd", "licensed under cc by nd"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc0", "dedicated to the public domain under cc0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
]
SHIFT, GAP = 2, 6
COVER = 0.8
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_pairs(spark) -> DataFrame:
    """(template, label, base, pairs, t, first, second, hash) of every pair of neighbouring words of every template."""
    phrases = [(label, phrase, True) for phrase, label in BASE.items()] + [(label, phrase, False) for label, phrase in TEMPLATES]
    rows = [
        (number, label, base, len(words) - 1, t, words[t], words[t + 1])
        for number, (label, phrase, base) in enumerate(phrases)
        for words in [phrase.split()]
        for t in range(len(words) - 1)
    ]
    return spark.createDataFrame(rows, "template int, label string, base boolean, pairs int, t int, first string, second string").withColumn("hash", F.xxhash64("first", "second"))


def hits(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, doc_id, n_words, p, t, template, label, base, pairs): one marker row for each text, p and the rest null, and one row a hit."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))
    read = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words.alias("words"))
    size = F.size("words")
    marker = F.array(F.struct(F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("second")))
    pairs = F.arrays_zip(F.col("words").alias("first"), F.slice("words", F.lit(2), F.greatest(size - 1, F.lit(0))).alias("second"))
    rolled = read.select("doc_id", "row", size.cast("bigint").alias("n_words"), F.posexplode(F.concat(marker, pairs)).alias("at", "pair"))
    rolled = rolled.select("doc_id", "row", "n_words", (F.col("at") - 1).alias("p"), F.col("pair.first").alias("w1"), F.col("pair.second").alias("w2")).withColumn("h", F.xxhash64("w1", "w2"))
    known = F.broadcast(template_pairs(docs.sparkSession))
    met = rolled.join(known, (F.col("h") == F.col("hash")) & (F.col("w1") == F.col("first")) & (F.col("w2") == F.col("second")), "left")
    return met.where("p < 0 or template is not null").select("row", "doc_id", "n_words", "p", "t", "template", "label", "base", "pairs")


def spans(found: DataFrame) -> DataFrame:
    """Verified spans (row, doc_id, n_words, label, base, start, end, cover) and one row with a null label for each text.

    cover: the share of the template's pairs that stand in the span in the template's order, each counted once.
    """
    by = ["row", "doc_id", "n_words", "template", "label", "base", "pairs"]
    hit = found.withColumn("diagonal", F.col("p") - F.col("t"))
    order = Window.partitionBy("row", "template").orderBy("diagonal", "p")
    last, reach = F.lag("diagonal").over(order), F.max("p").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("base") | F.col("template").isNull() | (F.col("diagonal") - last > SHIFT) | (F.col("p") - reach > GAP)
    grouped = hit.withColumn("apart", F.when(last.isNull() | ((F.col("diagonal") != last) & new), 1).otherwise(0)).withColumn("part", F.sum("apart").over(order))
    before = F.max("t").over(Window.partitionBy("row", "template", "part").orderBy("p", "t").rowsBetween(Window.unboundedPreceding, -1))
    read = grouped.withColumn("next", (F.col("t") > F.coalesce(before, F.lit(-1))).cast("int"))
    merged = read.groupBy(*by, "part").agg(F.sum("next").alias("n"), F.min("p").alias("start"), (F.max("p") + 2).alias("end"))
    cover = F.when(F.col("template").isNotNull(), F.col("n") / F.col("pairs"))
    return merged.select("row", "doc_id", "n_words", "label", "base", "start", "end", cover.alias("cover"))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    place = F.col("base") & (F.col("cover") >= 1)
    stands = place | (~F.col("base") & (F.col("cover") >= COVER))
    names = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    return (
        spans(hits(docs, text))
        .groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.count(F.when(place, 1)).alias("n_base"),
            F.min(F.when(place, F.col("start"))).cast("bigint").alias("first_word"),
            F.max(F.when(place, F.col("start"))).cast("bigint").alias("last_word"),
            names(place).alias("base_labels"),
            names(stands).alias("labels"),
            F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
