"""Licence scans by diagonal voting, with DataFrame operations alone.

A text's words are taken in order; every rolling k-gram of them is hashed and joined with the k-gram positions of
the templates. A hit at word i for template position j votes for the diagonal i - j, so a passage taken from a
template votes for one diagonal many times, and an inserted or lost word shifts the rest to a neighbouring one.
Votes are counted by document, template and diagonal; diagonals at most BAND apart merge to one band. A band is
verified: its hits are compared word by word (so equal hashes of different words don't count), the hit positions
must cover MIN_COVER of the template's k-grams and lie within MAX_STRETCH times the template's length.

The plain places of the phrases are counted beside it, from the same words.

The score is the largest coverage of a verified band, and 1 where a phrase stands.

Defined results: null and empty texts have no words, no labels and score 0; a very long text is one row, its words are in
memory once; null ids and repeated rows are rows of their own; an empty table gives none; a template occurring several times labels once; further columns aren't read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: The phrases looked for and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Sentences that public licences are known by, and labels.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM, BAND, MIN_COVER, MAX_STRETCH = 3, 2, 0.75, 1.5


def template_rows(templates=TEMPLATES, k: int = GRAM) -> list[tuple]:
    """(template, label, n_grams, n_words, j, k-gram): as many as the templates have words at most."""
    rows = []
    for t, (label, text) in enumerate(templates):
        words = re.findall(WORD, text)
        rows += [(t, label, len(words) - k + 1, len(words), j, " ".join(words[j : j + k])) for j in range(len(words) - k + 1)]
    return rows


def gram_hash(parts: list[Column]) -> Column:
    return F.xxhash64(*parts)


def template_positions(spark: SparkSession, templates=TEMPLATES, k: int = GRAM) -> DataFrame:
    df = spark.createDataFrame(template_rows(templates, k), "template int, label string, n_grams int, n_words int, j int, t_gram string")
    return df.withColumn("t_hash", gram_hash([F.split("t_gram", " ")[n] for n in range(k)]))


def lowered(text: str) -> Column:
    return F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrase_places(words: Column, phrases=PHRASES) -> Column:
    """Structs (start, label) of all places of the phrases. Only places of a phrase's last word are looked at closely."""
    lasts = sorted({p.split()[-1] for p, _ in phrases})
    ends = F.filter(F.transform(words, lambda w, i: F.when(w.isin(lasts), i)), lambda i: i.isNotNull())

    def found(phrase: str, label: str) -> Column:
        want = phrase.split()
        here = F.filter(ends, lambda e: (e >= len(want) - 1) & (F.slice(words, F.greatest(e - len(want) + 2, F.lit(1)), len(want)) == F.array(*map(F.lit, want))))
        return F.transform(here, lambda e: F.struct((e - len(want) + 1).cast("long").alias("start"), F.lit(label).alias("label")))

    return F.concat(*(found(p, n) for p, n in phrases))


def scan(df: DataFrame, spark: SparkSession, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES, k: int = GRAM) -> DataFrame:
    """A row for each row: n_words, the phrases' places, labels of phrases and of verified bands, and the score."""
    positions = template_positions(spark, templates, k)
    hashes = [r["t_hash"] for r in positions.select("t_hash").distinct().collect()]
    words = F.col("words")
    base = df.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0)).alias("words"))
    # all rolling k-grams are hashed; those that are no template's are left out before the join, as most are
    rolling = F.transform(words, lambda w, i: F.when(gram_hash([w, *(F.get(words, i + n) for n in range(1, k))]).isin(hashes), i))
    hits = F.transform(F.filter(rolling, lambda i: i.isNotNull()), lambda i: F.struct(i.alias("i"), F.concat_ws(" ", F.slice(words, i + 1, k)).alias("gram"), gram_hash([F.get(words, i + n) for n in range(k)]).alias("hash")))
    looked = base.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), phrase_places(words, phrases).alias("places"), hits.alias("hits"))
    looked = Scratch(df.sparkSession, "licences").write(looked, "licences")
    voted = looked.select("row", F.explode("hits").alias("hit")).select("row", "hit.*").join(F.broadcast(positions), F.col("hash") == F.col("t_hash")).where("gram = t_gram")
    keys = ["row", "template"]
    diagonals = voted.withColumn("d", F.col("i") - F.col("j")).groupBy(*keys, "label", "n_grams", "n_words", "d").agg(F.collect_set("j").alias("js"), F.min("i").alias("first"), F.max("i").alias("last"))
    along = Window.partitionBy(*keys).orderBy("d")
    apart = F.when(F.col("d") - F.lag("d").over(along) <= BAND, 0).otherwise(1)
    banded = diagonals.withColumn("apart", apart).withColumn("band", F.sum("apart").over(along))
    bands = banded.groupBy(*keys, "label", "n_grams", "n_words", "band").agg(F.size(F.array_distinct(F.flatten(F.collect_list("js")))).alias("hit"), (F.max("last") - F.min("first") + k).alias("span"))
    sure = bands.withColumn("cover", F.col("hit") / F.col("n_grams")).where((F.col("cover") >= MIN_COVER) & (F.col("span") <= MAX_STRETCH * F.col("n_words")))
    found = sure.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("cover").alias("cover"))
    starts, own = F.transform("places", lambda p: p["start"]), F.transform("places", lambda p: p["label"])
    joined = looked.drop("hits").join(found, "row", "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(own)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(own, F.coalesce("found", none)))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), spark)


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '%(word)s') AS w
  FROM documents
), t(template, label, n_grams, n_words, j, gram) AS (VALUES %(templates)s),
p(label, phrase) AS (VALUES %(phrases)s),
u AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
n AS (
  SELECT r, i, word, lead(word, 1) OVER o AS second, lead(word, 2) OVER o AS third FROM u WINDOW o AS (PARTITION BY r ORDER BY i)
), b AS (
  SELECT n.r, n.i, p.label FROM n JOIN p ON p.phrase IN (n.word || ' ' || n.second, n.word || ' ' || n.second || ' ' || n.third)
), base AS (
  SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM b GROUP BY r
), v AS (
  SELECT n.r, n.i, t.template, t.label, t.n_grams, t.n_words, t.j, n.i - t.j AS dg
  FROM n JOIN t ON t.gram = n.word || ' ' || n.second || ' ' || n.third
), g AS (
  SELECT r, template, dg, CASE WHEN dg - lag(dg) OVER (PARTITION BY r, template ORDER BY dg) <= %(band)d THEN 0 ELSE 1 END AS apart
  FROM (SELECT DISTINCT r, template, dg FROM v)
), bands AS (
  SELECT r, template, dg, sum(apart) OVER (PARTITION BY r, template ORDER BY dg) AS band FROM g
), sure AS (
  SELECT v.r, v.label, count(DISTINCT v.j) / v.n_grams AS cover
  FROM v JOIN bands USING (r, template, dg)
  GROUP BY v.r, v.template, v.label, v.n_grams, v.n_words, bands.band
  HAVING count(DISTINCT v.j) / v.n_grams >= %(cover)s AND max(v.i) - min(v.i) + %(k)d <= %(stretch)s * v.n_words
), found AS (SELECT r, list(DISTINCT label) AS labels, max(cover) AS cover FROM sure GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(base.n_base, 0) AS BIGINT) AS n_base,
  CAST(base.first_word AS BIGINT) AS first_word, CAST(base.last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
  CASE WHEN base.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(found.cover, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN found USING (r)
""" % {
    "word": WORD,
    "templates": ", ".join("(%d, '%s', %d, %d, %d, '%s')" % r for r in template_rows()),
    "phrases": ", ".join(f"('{n}', '{p}')" for p, n in PHRASES),
    "k": GRAM, "band": BAND, "cover": MIN_COVER, "stretch": MAX_STRETCH,
}
