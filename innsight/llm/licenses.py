"""License scans by diagonal voting (DataFrame functions only).

Rolling word k-gram hashes of every text are joined to the positions at which
the templates hold the same k-gram. A match votes for the diagonal "place in
the text minus place in the template"; neighbouring diagonals are merged, and
the merged span is verified by the words themselves.

Two sorts of templates: a phrase must be there in full, word by word; a
notice (a sentence of a license text) may miss or gain a few words, so its
neighbouring diagonals are merged, however few votes each of them has, and
``coverage`` of its k-grams must hold in the best stretch of the merged run
that is not much longer than the notice.

Defined results
* Null text is empty text (no words). Empty text has no words and no labels. An
  empty table gives an empty result. Very long texts are scanned whole.
* Ties: of stretches that cover the same number of k-grams the first counts.
* A template has at most 64 words (its k-grams are the bits of one number);
  longer ones are an error, sentences of a text are templates of their own.
* Repeated rows give repeated results; a null doc_id is a value like others.
* Input columns other than doc_id and text are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight.llm.columns import ascii_lower

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 2
MASK_BITS = 63
STRETCH = 1000

# fixed values: base phrases and their labels
PHRASES = [("mit", "mit license"), ("apache", "apache license"),
           ("gpl", "general public license")]

# fixed values: sentences of well-known license texts and notices
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies "
            "or substantial portions of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms "
            "of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or "
            "without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("proprietary", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def templates(phrases=PHRASES, notices=NOTICES, slack: int = 3, coverage: float = 0.8,
              min_share: float = 0.3) -> list[dict]:
    """Template table: base phrases are exact; notices allow ``slack`` words of drift."""
    out = []
    for base, pairs in ((True, phrases), (False, notices)):
        for label, phrase in pairs:
            words = phrase.split()
            grams = len(words) - K + 1
            if grams > MASK_BITS:
                raise ValueError(f"a template has at most {MASK_BITS + K - 1} words; split {phrase[:40]!r}")
            short = base or grams <= 6   # a short notice has no room for a lost word
            out.append(dict(
                tpl=len(out), label=label, base=base, words=words, grams=grams,
                slack=0 if short else slack,
                votes=grams if short else max(2, -(-int(grams * min_share * 100) // 100)),
                need=1.0 if short else coverage))
    return out


def _positions(spark, tpls: list[dict]) -> DataFrame:
    """One row per k-gram of a template: bounded by the template list, so it is broadcast."""
    rows = ", ".join(f"({t['tpl']}, {i}, '{t['words'][i]}', '{t['words'][i + 1]}')"
                     for t in tpls for i in range(t["grams"]))
    return (spark.sql(f"SELECT * FROM VALUES {rows} AS t(tpl, tpos, tw1, tw2)")
            .withColumn("gram", F.xxhash64("tw1", "tw2")))


def _info(spark, tpls: list[dict]) -> DataFrame:
    rows = ", ".join(f"({t['tpl']}, '{t['label']}', {t['base']}, {t['grams']}, {t['slack']}, "
                     f"{t['votes']}, {t['need']}D)" for t in tpls)
    return spark.sql("SELECT * FROM VALUES " + rows
                     + " AS t(tpl, label, base, grams, slack, votes, need)")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def scan(docs: DataFrame, tpls: list[dict] | None = None, doc_id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """Verified spans and the word count of every document.

    Columns: doc_id, n_words, copies (rows with this id and text), spans
    (array of tpl, label, base, first, last, coverage; words counted from 0).

    The text never leaves its row: k-gram hashes are made in place, those that
    no template has are dropped there, and only matches are exploded. What is
    shuffled is one header per document and its few matches.
    """
    spark = docs.sparkSession
    tpls = tpls or templates()
    pos = _positions(spark, tpls)
    known = [r[0] for r in pos.select("gram").distinct().collect()]   # bounded by the templates

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("tid"),
                       words_of(F.col(text)).alias("words"))
    rows = rows.select(
        "doc_id", "tid", F.size("words").cast("long").alias("n_words"), "words",
        F.zip_with("words", F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))),
                   lambda a, b: F.xxhash64(a, b)).alias("grams"))
    hits = F.filter(F.transform("grams", lambda h, i: F.when(h.isin(known), F.struct(
        h.alias("gram"), i.cast("int").alias("at"), F.get("words", i).alias("w1"),
        F.get("words", i + 1).alias("w2")))), lambda x: x.isNotNull())
    head = F.struct(F.lit(None).cast("long").alias("gram"), F.lit(-1).alias("at"),
                    F.lit("").alias("w1"), F.lit("").alias("w2"))
    flat = rows.select("doc_id", "tid", "n_words",
                       F.explode(F.concat(F.array(head), hits)).alias("x")).select(
        "doc_id", "tid", "n_words", "x.*")
    # the words are compared too: a hash collision can't vote
    votes = flat.join(F.broadcast(pos), (flat["gram"] == pos["gram"]) & (F.col("w1") == F.col("tw1"))
                      & (F.col("w2") == F.col("tw2")), "left").drop(pos["gram"])
    # the template positions of a diagonal are the bits of one number, so votes combine before the shuffle
    diagonals = votes.filter((F.col("at") < 0) | F.col("tpl").isNotNull()).groupBy(
        "doc_id", "tid", "n_words", "tpl", (F.col("at") - F.col("tpos")).alias("diag")).agg(
        F.count("*").alias("n"), F.bit_or(F.expr("shiftleft(1L, tpos)")).alias("tposs"))
    info = F.broadcast(_info(spark, tpls))
    # one diagonal must hold a template without slack; the others are merged before anything is dropped
    d = diagonals.join(info, "tpl", "left").filter(
        F.col("tpl").isNull() | (F.col("slack") > 0) | (F.bit_count("tposs") >= F.col("votes")))
    w = Window.partitionBy("doc_id", "tid", "tpl").orderBy("diag")
    d = d.withColumn("jump", F.coalesce(
        (F.col("diag") - F.lag("diag").over(w) > F.col("slack")).cast("int"), F.lit(0)))
    d = d.withColumn("run", F.sum("jump").over(w))
    # runs whose diagonals together lack the coverage end here, however often they repeat a pair of
    # words; of the others, the stretch of the notice's length that covers most counts
    run = Window.partitionBy("doc_id", "tid", "tpl", "run")
    d = d.withColumn("reach", F.bit_or("tposs").over(run)).filter(
        F.col("tpl").isNull() | (F.bit_count("reach") >= F.col("need") * F.col("grams")))
    held = F.filter(F.sequence(F.lit(0), F.col("grams") - 1), lambda i: F.getbit(F.col("tposs"), i) == 1)
    v = d.select("doc_id", "tid", "n_words", "tpl", "run", "n", "label", "base", "grams", "slack", "need",
                 "diag", F.explode_outer(held).alias("tpos")).withColumn(
        "at", F.col("diag") + F.col("tpos"))
    # places are stretched so that one frame fits the length of every template
    longest = max(t["grams"] + 2 * t["slack"] for t in tpls)
    place = F.floor(F.col("at") * F.lit(STRETCH * longest) / (F.col("grams") + 2 * F.col("slack")))
    ahead = run.orderBy("place").rangeBetween(0, STRETCH * longest - STRETCH // 2)
    v = v.withColumn("place", place).withColumns({
        "covered": F.bit_count(F.bit_or(F.expr("shiftleft(1L, tpos)")).over(ahead)),
        "end": F.max("at").over(ahead)})
    # the stretch that covers most, then the first one
    best = F.struct("covered", (-F.col("at")).alias("from"), (F.col("end") + (K - 1)).alias("last"))
    merged = v.groupBy("doc_id", "tid", "n_words", "tpl", "run").agg(
        F.max("n").alias("n"), F.first("label").alias("label"), F.first("base").alias("base"),
        F.max("grams").alias("grams"), F.max("need").alias("need"), F.max(best).alias("best")).select(
        "*", "best.covered", (-F.col("best.from")).alias("first"), "best.last")
    ok = F.col("covered") >= F.col("need") * F.col("grams")   # enough of the template
    span = F.when(F.col("tpl").isNotNull() & ok, F.struct(
        "tpl", "label", "base", F.col("first").cast("long").alias("first"),
        F.col("last").cast("long").alias("last"),
        (F.col("covered") / F.col("grams")).alias("coverage")))
    return merged.groupBy("doc_id", "tid").agg(
        F.max("n_words").alias("n_words"),
        F.max(F.when(F.col("tpl").isNull(), F.col("n"))).alias("copies"),
        F.sort_array(F.collect_list(span)).alias("spans")).drop("tid")


def label_documents(docs: DataFrame, tpls: list[dict] | None = None, **kw) -> DataFrame:
    """Labels and a score per document; the score is the best verified coverage, 0 without a span."""
    s = scan(docs, tpls, **kw)
    base = F.filter("spans", lambda x: x["base"])
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(
        F.transform(a, lambda x: x["label"]))), ",")
    return s.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["first"])).alias("last_word"),
        labels(base).alias("base_labels"), labels("spans").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda x: x["coverage"])), F.lit(0.0))
        .alias("score"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")
