"""License scan by diagonal voting.

Rolling word k-grams of every text are joined to the positions of the same k-grams in license templates. A hit at word p of
the text and word t of the template votes for the diagonal p - t; votes are summed per diagonal, diagonals at most `slack`
apart are merged (inserted or dropped words shift a diagonal), and a merged span counts if it covers enough of the template's
positions, each counted once, within a bounded stretch of text. Fixed phrases are found by the same join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, batch
from .words import ALNUM_LOWER, phrase_hash, rolling, signed, slices, words_of

# Phrases that decide a label by themselves.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# Notices of public licenses, as their publishers word them.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
)


_BITS = 62


def _positions(templates, k: int) -> list[tuple]:
    out = []
    for t, (label, text) in enumerate(templates):
        w = text.split()
        out += [(phrase_hash(w[i : i + k]), t, i, label, len(w) - k + 1, False) for i in range(len(w) - k + 1)]
    return out


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, k: int = 3, slack: int = 3, cover: float = 0.7, stretch: float = 1.5) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Texts are taken whole; null or empty texts have no words, no label and score 0. Repeated rows are answered once each; a
    null id stays null. Other columns are ignored. score is 1 for a phrase, else the best covered share of a template.
    The templates are a fixed list of some hundred positions, so their side of the join is broadcast.
    """
    spark = docs.sparkSession
    rows = _positions(templates, k) + [(phrase_hash(p.split()), -1 - i, 0, label, 1, True) for i, (label, p) in enumerate(phrases)]
    known = spark.createDataFrame(rows, "gram long, template int, tpos int, label string, grams int, phrase boolean")
    sizes = sorted({k} | {len(p.split()) for _, p in phrases})
    wanted = {n: np.unique(np.array([r[0] for r in rows], np.int64)) for n in sizes}

    def hits(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rid, did = b.column("rid").to_numpy(zero_copy_only=False), b.column("doc_id")
            for s in slices(b.column("text")):
                w = words_of(s, ALNUM_LOWER)
                doc, pos, gram = [np.arange(s.n)], [np.full(s.n, -1)], [np.diff(w.first)]
                for n in sizes:
                    g, ok = rolling(w, n)
                    g = signed(g)
                    at = np.searchsorted(wanted[n], g)
                    at[at == len(wanted[n])] = 0
                    i = np.flatnonzero(ok & (wanted[n][at] == g))
                    doc.append(w.doc[i]), pos.append(i - w.first[w.doc[i]]), gram.append(g[i])
                d = np.concatenate(doc) + s.row
                yield batch(rid=rid[d], doc_id=did.take(pa.array(d)), pos=np.concatenate(pos).astype(np.int64), gram=np.concatenate(gram).astype(np.int64))

    found = arrow_map(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), F.col("text")), hits, "rid long, doc_id long, pos long, gram long")
    # a row for the text itself carries its word count in place of a gram
    own = F.col("pos") < 0
    voted = found.withColumn("key", F.when(~own, F.col("gram"))).join(F.broadcast(known.withColumnRenamed("gram", "key")), "key", "left")
    held = [f"held{j}" for j in range(-(-max(r[4] for r in rows) // _BITS))]
    votes = voted.groupBy("rid", "doc_id", "template", "label", "grams", "phrase", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.count("tpos").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.max(F.when(own, F.col("gram"))).alias("n_words"),
        *[F.bit_or(F.when(F.floor(F.col("tpos") / _BITS) == j, F.expr(f"shiftleft(1L, tpos % {_BITS})"))).alias(h) for j, h in enumerate(held)],
    )
    line = Window.partitionBy("rid", "template").orderBy("diagonal")
    apart = F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(line) > slack)
    span = votes.withColumn("cut", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("span", F.sum("cut").over(line))
    spans = span.groupBy("rid", "doc_id", "template", "label", "grams", "phrase", "span").agg(
        F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("n_words").alias("n_words"),
        *[F.bit_or(h).alias(h) for h in held],
    )
    # a template position counts once, however many diagonals of the span hit it
    share = sum((F.bit_count(F.coalesce(h, F.lit(0).cast("long"))) for h in held), F.lit(0)) / F.col("grams")
    verified = ~F.col("phrase") & (share >= cover) & (F.col("hi") - F.col("lo") + 1 <= F.ceil(F.col("grams") * stretch))
    base = F.col("phrase")
    text = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    return spans.groupBy("rid", "doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.coalesce(F.sum(F.when(base, F.col("votes"))), F.lit(0)).alias("n_base"),
        F.min(F.when(base, F.col("lo"))).alias("first_word"),
        F.max(F.when(base, F.col("hi"))).alias("last_word"),
        text(F.when(base, F.col("label"))).alias("base_labels"),
        text(F.when(base | verified, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(base, F.lit(1.0)).when(F.col("phrase") == False, share)), F.lit(0.0)).alias("score"),  # noqa: E712
    ).drop("rid")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import documents

    return scan(documents(spark, sf_dir))
