"""License scan by diagonal voting, in DataFrame operations alone.

Every rolling word pair of every text is joined, on its hash and then its words, to the positions at which the templates
have that pair. A hit votes for the diagonal (place in the text less place in the template); neighbouring diagonals of a
text and template are merged, which lets words be added or left out; a merged span counts if it covers enough of the
template. A template found on one diagonal in full stands in the text word for word.

The templates are few and fixed (:func:`templates`), so that table is broadcast. Word pairs that hit nothing never leave
the task that read the text; hits and one row for each document are shuffled once, by row.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows stay rows of their own; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Phrases whose places are always reported, with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Openings of licenses and notices, with their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "released under the mit license": "mit",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms": "gpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license version 2 0": "mpl",
    "all rights reserved": "all-rights-reserved",
}
#: Diagonals that lie this close count as one span; the share of a template's pairs that a span must cover.
SLACK, COVER = 2, 0.75
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def templates(spark: SparkSession, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """A row for each word pair of each template: at most 62 pairs each, so that a span's votes fit one long."""
    rows = []
    for number, (text, label, exact) in enumerate([(t, x, True) for t, x in phrases.items()] + [(t, x, False) for t, x in notices.items()]):
        words = text.split()
        if not 2 <= len(words) <= 63:
            raise ValueError(f"a template needs 2 to 63 words: {text}")
        rows += [(number, label, exact, len(words) - 1, k, 1 << k, a, b) for k, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    df = spark.createDataFrame(rows, "template int, label string, exact boolean, pairs int, at int, vote long, first string, second string")
    return df.withColumn("pair", F.xxhash64("first", "second"))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAKS), "")


def spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Verified spans (``row``, ``key``, ``label``, ``exact``, ``start`` in words, ``cover``), and for every row one without label that has ``n_words``."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), words(F.col(text)).alias("words"))
    # Place -1 stands for the row itself and holds its number of words.
    places = rows.select("row", "key", "words", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("words") - 2, F.lit(-1)))).alias("place"))
    first, second = F.get("words", F.col("place")), F.get("words", F.col("place") + 1)
    pairs = places.select("row", "key", "place", F.when(F.col("place") < 0, F.size("words")).alias("n_words"), F.when(F.col("place") >= 0, first).alias("a"), F.when(F.col("place") >= 0, second).alias("b"))
    known = F.broadcast(templates(df.sparkSession))
    hits = pairs.withColumn("hash", F.when(F.col("place") >= 0, F.xxhash64("a", "b"))).join(known, (F.col("hash") == F.col("pair")) & (F.col("a") == F.col("first")) & (F.col("b") == F.col("second")), "left")
    hits = hits.where("place < 0 or template is not null").select("row", "key", "n_words", "template", "label", "exact", "pairs", "vote", (F.col("place") - F.col("at")).alias("diagonal"))
    votes = hits.repartition("row").groupBy("row", "key", "template", "label", "exact", "pairs", "diagonal").agg(F.max("n_words").alias("n_words"), F.bit_or("vote").alias("votes"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > SLACK) | F.col("exact"), F.lit(True))
    merged = votes.withColumn("span", F.sum(apart.cast("int")).over(along))
    merged = merged.groupBy("row", "key", "template", "label", "exact", "pairs", "span").agg(F.max("n_words").alias("n_words"), F.min("diagonal").alias("start"), (F.bit_count(F.bit_or("votes")) / F.first("pairs")).alias("cover"))
    return merged.where(F.col("template").isNull() | (F.col("cover") >= F.when(F.col("exact"), 1.0).otherwise(COVER)))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``df``: words, places of the phrases, labels of phrases and of all spans, and the best cover."""
    exact = F.col("template").isNotNull() & F.col("exact")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    # A row has a bounded number of distinct labels, so the sets stay small.
    return spans(df, key, text).groupBy("row", "key").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if(exact).alias("n_base"),
        F.min(F.when(exact, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(exact, F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(exact, F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
    ).drop("row").withColumnRenamed("key", key)


def oracle(phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> str:
    """The same in DuckDB's SQL, over the view documents."""
    rows = []
    for number, (text, label, exact) in enumerate([(t, x, "true") for t, x in phrases.items()] + [(t, x, "false") for t, x in notices.items()]):
        w = text.split()
        rows += [f"({number}, '{label}', {exact}, {len(w) - 1}, {k}, '{a}', '{b}')" for k, (a, b) in enumerate(zip(w, w[1:], strict=False))]
    return rf"""
WITH t(template, label, exact, pairs, k, a, b) AS (VALUES {', '.join(rows)}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT r, generate_subscripts(w, 1) - 1 AS place, unnest(w) AS a, unnest(list_concat(w[2:], [NULL])) AS b FROM d),
v AS (SELECT r, template, label, exact, pairs, place - k AS diagonal, bit_or(1::BIGINT << k) AS votes FROM p JOIN t USING (a, b) GROUP BY ALL),
m AS (SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM
  (SELECT *, CASE WHEN NOT exact AND diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= {SLACK} THEN 0 ELSE 1 END AS apart FROM v)),
s AS (SELECT r, template, label, exact, pairs, span, min(diagonal) AS start, bit_count(bit_or(votes)) / pairs AS cover FROM m GROUP BY r, template, label, exact, pairs, span),
f AS (SELECT * FROM s WHERE cover >= CASE WHEN exact THEN 1 ELSE {COVER} END)
SELECT doc_id, len(any_value(w))::BIGINT AS n_words, count(*) FILTER (exact) AS n_base,
  (min(start) FILTER (exact))::BIGINT AS first_word, (max(start) FILTER (exact))::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(cover), 0)::DOUBLE AS score
FROM d LEFT JOIN f USING (r) GROUP BY r, doc_id"""
