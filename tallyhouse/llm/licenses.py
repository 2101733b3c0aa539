"""License scans by diagonal voting, in DataFrame functions throughout.

Hashes of all k-grams of words are joined to their positions in templates; matches are counted by diagonal (document
position minus template position); neighbouring diagonals are merged into spans; matches are verified word by word, and
each merged span is held against its template: words that alter or name a license must stand where the template has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import projected

#: Phrases that name a license on their own.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Openings of well-known license texts and notices.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the "
    "rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
    "with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required "
    "by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that "
    "the following conditions are met redistributions of source code must retain the above copyright notice this list "
    "of conditions and the following disclaimer",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
    "public license as published by the free software foundation either version 3 of the license or at your option any "
    "later version",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
}

GRAM = 4
#: Diagonals up to this far apart, as after a few words put in or left out, are one span.
MAX_SHIFT = 3
#: Share of a template's words that a span must show to give its label.
MIN_SCORE = 0.6

#: Spellings, of one or two words, that count as one word when a span is held against its template.
SPELLINGS = {
    "nc": "noncommercial",
    "non commercial": "noncommercial",
    "sa": "sharealike",
    "share alike": "sharealike",
    "nd": "noderivatives",
    "noderivs": "noderivatives",
    "no derivs": "noderivatives",
    "no derivatives": "noderivatives",
}
#: Words that alter what a license grants; a span shows them where its template does, and nowhere else.
ALTERING = (
    "not", "no", "non", "never", "nor", "neither", "cannot", "without", "except", "unless",
    "prohibited", "forbidden", "denied", "revoked", "noncommercial", "sharealike", "noderivatives",
)
#: Further such words of one template, as those that name a relative or another version of it.
TELLING = {
    "apache-2": ("2",),
    "gpl": ("lesser", "library", "affero"),
    "mit": ("only",),
    "bsd": ("only",),
}
_NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _normal(text: Column) -> Column:
    """Words with one blank before and after each; none: one blank. A-Z in lower case only."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _NOT_WORD, " ")), F.lit(" "))


def _words(normal: Column) -> Column:
    return F.filter(F.split(F.trim(normal), " "), lambda w: w != "")


def _places(normal: Column, phrase: str) -> Column:
    """Starts, in words, of all places of a phrase; texts without it are not cut into words."""
    parts = phrase.split()
    words = _words(normal)

    def starts(word_array: Column) -> Column:
        def here(w: Column, i: Column) -> Column:
            hit = w == parts[0]
            for k, part in enumerate(parts[1:], start=1):
                hit = hit & (F.get(word_array, i + k) == part)
            return F.when(hit, i.cast("bigint"))

        return F.filter(F.transform(word_array, here), lambda x: x.isNotNull())

    return F.when(F.contains(normal, F.lit(f" {phrase} ")), starts(words)).otherwise(
        F.array().cast("array<bigint>")
    )


def base_scan(documents: DataFrame, phrases: dict[str, str] = PHRASES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, text_key, n_words, n_base, first_word, last_word, base`` for every row; ``base`` is the set of labels."""
    given = projected(documents, doc_id=id_column, text=text_column)
    normal = given.select("doc_id", _key(F.col("text")).alias("text_key"), _normal(F.col("text")).alias("normal"))
    found = normal.select(
        "doc_id",
        "text_key",
        # Each word stands between two blanks.
        F.when(F.col("normal") == "  ", F.lit(0)).otherwise(F.length("normal") - F.length(F.replace("normal", F.lit(" "), F.lit(""))) - 1).cast("bigint").alias("n_words"),
        *(_places(F.col("normal"), p).alias(f"p{i}") for i, p in enumerate(phrases)),
    )
    arrays = [F.col(f"p{i}") for i in range(len(phrases))]
    every = F.concat(*arrays)
    labels = F.array_compact(F.array(*(F.when(F.size(a) > 0, F.lit(x)) for a, x in zip(arrays, phrases.values()))))
    return found.select(
        "doc_id",
        "text_key",
        "n_words",
        F.size(every).cast("bigint").alias("n_base"),
        F.array_min(every).alias("first_word"),
        F.array_max(every).alias("last_word"),
        F.array_distinct(labels).alias("base"),
    )


def _key(text: Column) -> Column:
    """Rows with equal id and text share their result; a digest, as two different texts must not."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def template_grams(spark: SparkSession, templates: dict[str, str] = TEMPLATES, gram: int = GRAM) -> DataFrame:
    """``gram_hash, gram_words, template, size, at``: as many rows as the templates have words."""
    rows = F.array(
        *(F.struct(F.lit(k).alias("template"), F.split(F.lit(v), " ").alias("body")) for k, v in templates.items())
    )
    bodies = spark.range(1, numPartitions=1).select(F.inline(rows)).withColumn("size", F.size("body")).where(F.col("size") >= gram)
    places = bodies.select("template", "size", "body", F.explode(F.sequence(F.lit(0), F.col("size") - gram)).alias("at"))
    run = [F.get("body", F.col("at") + k) for k in range(gram)]
    return places.select("template", "size", "at", F.array(*run).alias("gram_words"), F.xxhash64(*run).alias("gram_hash"))


def spans(
    documents: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    gram: int = GRAM,
    max_shift: int = MAX_SHIFT,
    min_score: float = MIN_SCORE,
    id_column: str = "doc_id",
    text_column: str = "text",
    altering: tuple[str, ...] = ALTERING,
    telling: dict[str, tuple[str, ...]] = TELLING,
) -> DataFrame:
    """``doc_id, text_key, template, first, last, score``: all verified spans of each template in each text.

    The hashes of all grams of all texts meet those of the template grams; templates are a parameter, so their rows are
    broadcast, and only matches are shuffled. Matches are verified by their words. Votes of a diagonal are its distinct
    template positions; diagonals at most ``max_shift`` apart are one span. Its score is the share of the template's words
    that lie in a verified gram. Spans that :func:`_altered` finds changed in a word that matters are dropped.
    """
    given = projected(documents, doc_id=id_column, text=text_column)
    words = given.select("doc_id", _key(F.col("text")).alias("text_key"), F.split(F.trim(_normal(F.col("text"))), " ").alias("words"))
    # The outer form, as Spark would else cut the text into words once more to filter those without grams.
    starts = F.when(F.size("words") >= gram, F.sequence(F.lit(0), F.size("words") - gram))
    grams = words.select("doc_id", "text_key", "words", F.explode_outer(starts).alias("place"))
    run = [F.get("words", F.col("place") + k) for k in range(gram)]
    table = template_grams(documents.sparkSession, templates, gram)
    alike = F.col("gram_hash") == F.xxhash64(*run)
    for k, word in enumerate(run):
        alike = alike & (F.get("gram_words", F.lit(k)) == word)
    hit = grams.join(F.broadcast(table), alike)
    begin = F.greatest(F.col("place") - F.col("at"), F.lit(0))
    key = ["doc_id", "text_key", "template"]
    # Identical rows, and grams that repeat, give one vote for each place and template position.
    diagonals = (
        hit.withColumn("diagonal", F.col("place") - F.col("at"))
        # The words below the whole template on this diagonal, and one more: the same for all its matches.
        .withColumn("below", F.slice("words", begin + 1, F.col("size") + 1))
        .groupBy(*key, "diagonal")
        .agg(
            F.collect_set("at").alias("ats"),  # at most the template's length
            F.first("below").alias("below"),
            F.min("place").alias("first"),
            F.max("place").alias("last"),
            F.max("size").alias("size"),
        )
    )
    telltale = {t: sorted({*altering, *telling.get(t, ())}) for t in templates}
    marked = diagonals.withColumn("marks", _marks(telltale)).drop("below")
    found = _merged(marked, key, gram, max_shift).where(F.col("score") >= min_score)
    return found.where(~_altered(templates, telltale, gram)).select(*key, "first", "last", "score")


def _spelled(words: Column) -> Column:
    """Words with the ``SPELLINGS`` of one word replaced, those of two words in the place of the first."""

    def canonical(word: Column, i: Column) -> Column:
        pair = F.concat_ws(" ", word, F.get(words, i + 1))
        result = word
        for spelling, whole in SPELLINGS.items():
            result = F.when((pair if " " in spelling else word) == spelling, F.lit(whole)).otherwise(result)
        return result

    return F.transform(words, canonical)


def _marks(telltale: dict[str, list[str]]) -> Column:
    """``place, word`` of all telltale words below the template on a diagonal."""
    begin = F.greatest(F.col("diagonal"), F.lit(0))
    placed = F.transform(_spelled(F.col("below")), lambda w, i: F.struct((begin + i).alias("place"), w.alias("word")))
    inside = F.col("diagonal") + F.col("size")

    def telling(mark: Column) -> Column:
        hit = F.lit(False)
        for template, words in telltale.items():
            hit = hit | ((F.col("template") == template) & mark["word"].isin(words))
        return hit & (mark["place"] < inside)

    return F.filter(placed, telling)


def _altered(templates: dict[str, str], telltale: dict[str, list[str]], gram: int) -> Column:
    """Whether a span and its template differ in a telltale word.

    Such a word of the text, from where the template would start to where it would end, must stand in the template on one
    of the diagonals from the span's first to its last; one of the template from a gram before the span's first verified
    word to a gram after its last must stand in the text likewise. So a part of a license passes, one with such a word put in, left out or
    replaced does not.
    """
    entries = []
    for template, words in telltale.items():
        body = templates[template].split(" ")
        at = [F.struct(F.lit(i).alias("at"), F.lit(w).alias("word")) for i, w in enumerate(body) if w in words]
        entries += [F.lit(template), F.array(*at) if at else F.array().cast("array<struct<at:int,word:string>>")]
    own = F.element_at(F.create_map(*entries), F.col("template"))

    def meets(mark: Column, tell: Column) -> Column:
        return (mark["word"] == tell["word"]) & (mark["place"] - tell["at"]).between(F.col("low"), F.col("high"))

    added = F.exists("marks", lambda m: ~F.exists(own, lambda t: meets(m, t)))

    def wanted(tell: Column) -> Column:
        return tell["at"].between(F.col("first_at") - gram, F.col("last_at") + gram)

    lost = F.exists(own, lambda t: wanted(t) & ~F.exists("marks", lambda m: meets(m, t)))
    return added | lost


def _merged(diagonals: DataFrame, key: list[str], gram: int, max_shift: int) -> DataFrame:
    """Neighbouring diagonals, from ``low`` to ``high``, as one span with its telltale words."""
    order = Window.partitionBy(*key).orderBy("diagonal")
    split = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > max_shift).cast("int"), F.lit(0))
    numbered = diagonals.withColumn("starts", split).withColumn("span", F.sum("starts").over(order))
    covered = F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + (gram - 1)))))
    whole = numbered.withColumn("covered", covered).groupBy(*key, "span").agg(
        # Unions of positions within the template: bounded by the diagonals of one text within the shift.
        F.array_distinct(F.flatten(F.collect_list("covered"))).alias("covered"),
        F.array_distinct(F.flatten(F.collect_list("marks"))).alias("marks"),
        F.min("first").alias("first"),
        (F.max("last") + gram - 1).alias("last"),
        F.max("size").alias("size"),
        F.min("diagonal").alias("low"),
        F.max("diagonal").alias("high"),
    )
    return whole.select(
        *key,
        "first",
        "last",
        F.round(F.size("covered") / F.col("size"), 6).alias("score"),
        "marks",
        "low",
        "high",
        F.array_min("covered").alias("first_at"),
        F.array_max("covered").alias("last_at"),
    )


def scanned(
    documents: DataFrame,
    phrases: dict[str, str] = PHRASES,
    templates: dict[str, str] = TEMPLATES,
    id_column: str = "doc_id",
    text_column: str = "text",
    **options,
) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row.

    Labels of phrases stay; templates with a span that reaches the score add theirs. ``score`` is 1 with a phrase, else
    the best span's, else 0. Null and empty texts have no words. Repeated rows are all returned. A null id is kept. Other
    columns are ignored; an empty table gives no rows.
    """
    base = base_scan(documents, phrases, id_column, text_column)
    found = (
        spans(documents, templates, id_column=id_column, text_column=text_column, **options)
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set("template").alias("more"), F.max("score").alias("best"))
        .select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key"), "more", "best")
    )
    joined = base.join(
        found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_key") == F.col("found_key")), "left"
    )
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
