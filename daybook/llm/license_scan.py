"""Licence phrases by diagonal voting over word pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybook.llm.common import UPPER, whole_text

#: Phrases whose every place counts, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Longer notices; a span that covers enough of one gives its label.
NOTICES = {
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-notice",
    "licensed under the apache license version 2 0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-text",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
}
#: Share of a notice's word pairs that a span must cover, and how far diagonals may lie apart to be one span.
COVER, DRIFT = 0.8, 2
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of the text: letters a-z, digits and whatever is beyond ASCII; A-Z alone turn into lower case, so no other letter turns into one of a template."""
    return F.array_remove(F.split(F.translate(text, UPPER, UPPER.lower()), SEPARATORS), "")


def _pair(first: Column, second: Column) -> Column:
    return F.xxhash64(first, second)


def templates(spark: SparkSession, base: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """Rows (template, label, is_base, phrase words, n_pairs, at, pair): a few hundred at most, from the parameters alone."""
    rows = [(k, label, k < len(base), phrase.split()) for k, (phrase, label) in enumerate([*base.items(), *notices.items()])]
    if any(len(r[3]) < 2 for r in rows) or sum(len(r[3]) for r in rows) > 100_000:
        raise ValueError("templates need two words at least, and 100,000 words in all at most")
    df = spark.createDataFrame(rows, "template int, label string, is_base boolean, phrase array<string>")
    pairs = F.transform(F.sequence(F.lit(1), F.size("phrase") - 1), lambda i: _pair(F.element_at("phrase", i), F.element_at("phrase", i + 1)))
    return df.select("template", "label", "is_base", "phrase", (F.size("phrase") - 1).alias("n_pairs"), F.posexplode(pairs).alias("at", "pair"))


def license_scan(docs: DataFrame, base: dict[str, str] | None = None, notices: dict[str, str] | None = None, cover: float = COVER, drift: int = DRIFT) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    All rolling word pairs of all texts are joined with the template pairs, hits are counted by document, template and
    diagonal (place in the text less place in the template), neighbouring diagonals are merged, and the spans that cover
    enough of their template are compared word by word with the text. A base phrase counts at every place where all its
    words stand consecutively. score is the largest share of a template that was found, 0 without any. spans lists label,
    first word and cover of each notice found. The template table is broadcast: templates() bounds its size.

    A null text counts as empty: no words, nothing found. Rows that repeat a doc_id, or have none, are told apart by a hash of their texts, and
    rows alike in both give equal rows. Of equal shares the score is that share. Texts are worked on whole: a text's words are an array, and its hits rows of
    their own. Other columns are ignored. No rows give no rows.
    """
    found = templates(docs.sparkSession, BASE if base is None else base, NOTICES if notices is None else notices)
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("whole")).alias("key"), whole_text().alias("text"))
    pairs = rows.select("key", words_of(F.col("text")).alias("w")).select("key", F.posexplode(F.transform("w", lambda x, i: _pair(x, F.get("w", i + 1)))).alias("pos", "pair"))
    hits = pairs.join(F.broadcast(found.select("template", "at", "pair")), "pair").select("key", "template", "at", "pos", (F.col("pos") - F.col("at")).alias("diagonal")).distinct()
    votes = hits.groupBy("key", "template", "diagonal").agg(F.count_distinct("at").alias("votes"), F.collect_set("at").alias("ats"), F.min("pos").alias("first"))
    along = Window.partitionBy("key", "template").orderBy("diagonal")
    # a diagonal starts a new span when it lies further than `drift` from the one before
    runs = votes.withColumn("apart", (F.col("diagonal") - F.lag("diagonal", 1).over(along) > drift).cast("int")).withColumn("run", F.sum(F.coalesce("apart", F.lit(0))).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    about = found.select("template", "label", "is_base", "phrase", "n_pairs").distinct()
    merged = (
        runs.groupBy("key", "template", "run")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("covered"), F.min("first").alias("first"), F.collect_list(F.struct("diagonal", "votes")).alias("diagonals"))
        .join(F.broadcast(about), "template")
        .withColumn("full", F.expr("transform(filter(diagonals, d -> d.votes = n_pairs), d -> d.diagonal)"))
        .filter((F.col("is_base") & (F.size("full") > 0)) | (~F.col("is_base") & (F.col("covered") >= cover * F.col("n_pairs"))))
    )
    spans = merged.groupBy("key").agg(
        F.flatten(F.collect_list(F.when(F.col("is_base"), F.transform("full", lambda d: F.struct(d.cast("long").alias("at"), F.col("label"), F.col("phrase")))))).alias("base_spans"),
        F.collect_list(F.when(~F.col("is_base"), F.struct(F.col("first").cast("long").alias("at"), "label", "phrase", (F.col("covered") / F.col("n_pairs")).alias("cover"), F.transform("diagonals", lambda d: d["diagonal"]).alias("along")))).alias("notice_spans"),
    )
    told = rows.join(spans, "key", "left").select("key.doc_id", words_of(F.col("text")).alias("w"), "base_spans", "notice_spans")
    # the words themselves decide: all words of a base phrase; of a notice enough of its words, each where a diagonal of the span has it
    checked = told.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.expr("filter(coalesce(base_spans, array()), s -> slice(w, cast(s.at + 1 AS int), size(s.phrase)) = s.phrase)").alias("b"),
        F.expr(f"filter(coalesce(notice_spans, array()), s -> size(filter(sequence(0, size(s.phrase) - 1), i -> exists(s.along, d -> get(w, cast(d + i AS int)) = get(s.phrase, i)))) >= {cover} * size(s.phrase))").alias("s"),
    )
    return checked.select(
        "doc_id",
        "n_words",
        F.size("b").cast("long").alias("n_base"),
        F.expr("array_min(transform(b, x -> x.at))").alias("first_word"),
        F.expr("array_max(transform(b, x -> x.at))").alias("last_word"),
        F.expr("array_join(array_sort(array_distinct(transform(b, x -> x.label))), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(concat(transform(b, x -> x.label), transform(s, x -> x.label)))), ',')").alias("labels"),
        F.expr("CASE WHEN size(b) > 0 THEN 1.0D ELSE coalesce(array_max(transform(s, x -> x.cover)), 0.0D) END").alias("score"),
        F.expr("array_join(array_sort(transform(s, x -> concat(x.label, '@', x.at, ':', round(x.cover, 3)))), ' ')").alias("spans"),
    )
