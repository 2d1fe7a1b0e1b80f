"""License scans by diagonal voting (operator 1).

All rolling k-gram hashes of the words of all texts are joined with the k-grams of the license templates. A hit at word p
of a text and word t of a template votes for the diagonal p - t. Votes are counted by diagonal, neighbouring diagonals are
merged into spans of bounded drift, so that a few words put in or left out do no harm and k-grams strewn over a text add
up to nothing, and a span stands if the k-grams that it holds, compared as text, cover enough of the template.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import short_batches, table
from .wordhash import Words, chunks

K = 3
#: Diagonals at most so far apart belong to one span, and a span's diagonals lie in one cell of CELL; cells overlap by half.
DRIFT = 2
CELL = 16


class Template(NamedTuple):
    label: str
    text: str
    #: Share of the template's k-grams that a span must hold; 1 asks for all of them on one diagonal.
    least: float = 0.75


#: Phrases whose every place counts.
PHRASES = (
    Template("mit", "under the mit license", 1.0),
    Template("apache-2", "apache license version 2", 1.0),
    Template("cc-by-nc", "cc by nc", 1.0),
)
#: Openings of well-known licenses and notices.
TEXTS = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("gpl", "licensed under the gnu general public license version 3"),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", 0.95),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    # all of it, as most of it stands in the notices of its kin
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", 0.9),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    Template("lgpl", "licensed under the gnu lesser general public license version 3", 0.7),
    Template("agpl", "licensed under the gnu affero general public license version 3", 0.7),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    Template("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)


def _grams_of(texts: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray]:
    words = Words(texts)
    return words, *words.grams(K, words.hashes())


def template_table(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """``hash, gram, template int, t int``, and one row with template -1 for what isn't a k-gram (hash null is -1)."""
    rows = [(-1, None, -1, 0)]
    for i, template in enumerate(templates):
        words, at, hashes = _grams_of([template.text.encode()])
        rows += [(int(h), g, i, int(p)) for h, g, p in zip(hashes.view(np.int64), words.spans(at, at + K - 1).to_pylist(), at, strict=True)]
    return spark.createDataFrame(rows, "hash long, gram string, template int, t int")


def rolling_grams(docs: DataFrame) -> DataFrame:
    """All k-grams of all texts: ``doc_id, th, n_words, p int, hash, gram``; and a row with p -1, hash -1 for each text."""

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in chunks(batch.column("text")):
                words, at, hashes = _grams_of(texts)
                n = len(texts)
                doc = np.concatenate((np.arange(n), words.doc[at]))
                place = np.concatenate((np.full(n, -1), at - words.first[words.doc[at]])).astype(np.int32)
                code = np.concatenate((np.full(n, -1), hashes.view(np.int64)))
                grams = pa.concat_arrays([pa.nulls(n, pa.string()), words.spans(at, at + K - 1)])
                rows = pa.array(begin + doc)
                counts = pa.array(words.counts[doc].astype(np.int64))
                whole = pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("th").take(rows), counts, pa.array(place), pa.array(code), grams], ["doc_id", "th", "n_words", "p", "hash", "gram"])
                for i in range(0, whole.num_rows, 50_000):
                    yield whole.slice(i, 50_000)

    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return short_batches(taken).mapInArrow(roll, "doc_id long, th long, n_words long, p int, hash long, gram string")


def scan(docs: DataFrame, phrases: tuple[Template, ...] = PHRASES, texts: tuple[Template, ...] = TEXTS) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` of each row of ``docs``.

    n_base: places of the phrases, first_word and last_word: the smallest and largest of their starts (null without any).
    score: the largest share of a template found, 1 for a phrase, 0 for nothing. spans: label, first word, share.
    A null text has no words. Rows with the same doc_id and text get the same result, each its own row.
    """
    spark = docs.sparkSession
    templates = (*phrases, *texts)
    sizes = [len(t.text.split()) - K + 1 for t in templates]
    known = template_table(spark, templates)  # a few hundred rows, by the constants above
    facts = F.broadcast(spark.createDataFrame([(i, t.label, n, float(t.least), i < len(phrases)) for i, (t, n) in enumerate(zip(templates, sizes, strict=True))], "template int, label string, size int, least double, base boolean"))
    grams = rolling_grams(docs)
    hits = grams.join(F.broadcast(known.withColumnRenamed("gram", "own")), "hash").where(F.col("gram").eqNullSafe(F.col("own")))
    key = ["doc_id", "th", "template"]
    votes = hits.groupBy(*key, (F.col("p") - F.col("t")).alias("diagonal")).agg(F.collect_set("t").alias("ts"), F.count("*").alias("n"), F.min("p").alias("p"), F.max("n_words").alias("n_words"))
    # a phrase has one diagonal a place; the votes of other templates stand in both cells that hold their diagonal
    half = F.floor(F.col("diagonal") / (CELL // 2))
    cells = F.when(F.coalesce(F.col("base"), F.lit(True)), F.array(F.lit(0).cast("long"))).otherwise(F.array(half - 1, half))
    votes = votes.join(facts, "template", "left").withColumn("cell", F.explode(cells))
    key.append("cell")
    along = W.partitionBy(*key).orderBy("diagonal")
    marked = votes.withColumn("apart", F.coalesce(F.col("base"), F.lit(True)) | (F.col("diagonal") - F.lag("diagonal").over(along) > DRIFT) | F.lag("diagonal").over(along).isNull())
    spans = (
        marked.withColumn("span", F.sum(F.col("apart").cast("int")).over(along))
        .groupBy(*key, "span")
        .agg(F.first("label").alias("label"), F.first("base").alias("base"), F.first("least").alias("least"), F.first("size").alias("size"), F.array_distinct(F.flatten(F.collect_list("ts"))).alias("ts"), F.min("p").alias("p"), F.max("n_words").alias("n_words"), F.max(F.when(F.col("template") == -1, F.col("n"))).alias("copies"))
        .withColumn("share", F.when(F.col("template") >= 0, F.size("ts") / F.col("size")))
        .where("template = -1 or share >= least")
    )
    found = F.col("template") >= 0
    place = F.when(found & F.col("base"), F.col("p").cast("long"))
    each = spans.groupBy("doc_id", "th").agg(
        F.max("n_words").alias("n_words"),
        F.count(place).alias("n_base"),
        F.min(place).alias("first_word"),
        F.max(place).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(found & F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(found, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_set(F.when(found, F.struct("label", F.col("p").alias("first_word"), "share")))).alias("spans"),
        F.max("copies").alias("copies"),
    )
    return each.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("th", "copies", "copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")

