"""License scan by diagonal voting: word k-grams of texts meet those of templates in a Spark join and vote for offsets.

A vote is a gram of the text at a place of a template; votes of one template at one offset (text place less template
place) lie on a diagonal. Neighbouring diagonals are one find with words left out or put in between. The join compares
the words of a gram besides its hash, so every word that a find counts stands in the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import map_texts
from quarrylight.llm.incidence import offsets, runs
from quarrylight.llm.shingles import BYTE, mix, tables

#: Words of a gram: two for phrases, four for longer templates.
PHRASE_GRAM, TEXT_GRAM = 2, 4
#: Share of a longer template's words that a find must have, and words that one find may leave out or put in at a place.
LEAST_SHARE, SLACK = 0.7, 4
#: Bytes of text that one numpy pass takes, unless a single text is longer.
PASS_BYTES = 256 << 10
#: Bytes of words, A-Z as a-z: digits, letters, and all bytes of characters outside ASCII; others part words.
WORD = np.zeros(256, np.uint8)
WORD[48:58], WORD[97:123], WORD[65:91], WORD[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)


class Template(NamedTuple):
    label: str
    words: str
    base: bool = False


#: The base phrases, then public licenses' notices and core sentences.
TEMPLATES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    Template("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    Template("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    Template("boost", "Distributed under the Boost Software License, Version 1.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    Template("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
)


class Words(NamedTuple):
    """The words of several texts: their bytes with one space between, where each begins and ends, and the first of each text."""

    data: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray
    hashes: np.ndarray


def words_of(texts: list[str]) -> Words:
    raw = np.frombuffer(("\0".join(texts) + "\0").encode(), np.uint8)
    data = WORD[raw]
    inside = data != 0
    after = np.concatenate([[False], inside[:-1]])
    begin, parted = inside & ~after, ~inside & after
    data = np.where(parted, 32, data)[inside | parted]
    place = np.cumsum(inside | parted)
    begins, ends = place[begin] - 1, place[parted] - 1
    stops = np.flatnonzero(raw == 0)
    if len(stops) != len(texts):  # a text holds U+0000 itself
        stops = np.cumsum([len(t.encode()) + 1 for t in texts]) - 1
    firsts = np.concatenate([[0], np.cumsum(begin)[stops]])
    step, back = tables(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTE[data] * step[: len(data)], dtype=np.uint64)])
    return Words(data, begins, ends, firsts, mix((sums[ends] - sums[begins]) * back[begins]))


def grams(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(text, place of its first word, hash, words) of every run of ``size`` words: a rolling hash over those of the words."""
    count = np.diff(words.firsts)
    text = np.repeat(np.arange(len(count)), np.maximum(count - size + 1, 0))
    place = np.arange(len(text)) - np.repeat(offsets(np.maximum(count - size + 1, 0))[:-1], np.maximum(count - size + 1, 0))
    at = words.firsts[text] + place
    step, back = tables(len(words.hashes) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words.hashes * step[: len(words.hashes)], dtype=np.uint64)])
    hashes = mix((sums[at + size] - sums[at]) * back[at] + np.uint64(size))
    lengths = words.ends[at + size - 1] - words.begins[at] if len(at) else np.zeros(0, np.int64)
    spelled = runs(words.data, words.begins[at], lengths) if len(at) else np.zeros(0, np.uint8)
    spelled = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets(lengths).astype(np.int32).tobytes()), pa.py_buffer(spelled.tobytes()))
    return text, place, hashes.view(np.int64), spelled


def template_places(spark: SparkSession) -> DataFrame:
    """Every place of every template with its gram: a table that no input can lengthen, of some hundred rows."""
    rows = []
    for number, t in enumerate(TEMPLATES):
        words = words_of([t.words])
        size, count = PHRASE_GRAM if t.base else TEXT_GRAM, len(words.begins)
        for _, place, code, spelled in zip(*(x.tolist() for x in grams(words, size)), strict=True):
            rows.append((code, spelled, number, t.label, t.base, count, size, 0 if t.base else SLACK, 1.0 if t.base else LEAST_SHARE, place))
    return spark.createDataFrame(rows, "gram long, spelled string, template int, label string, base boolean, template_words int, size int, slack int, least double, place int")


GRAM_ROWS = "doc_id {}, text_key long, n_words long, at int, gram long, spelled string"


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        ends, first = np.cumsum([len(t) for t in texts]), 0
        while first < len(texts):
            end = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PASS_BYTES, side="right")))
            words, keys = words_of(texts[first:end]), batch.slice(first, end - first).select(["doc_id", "text_key"]).columns
            n = end - first
            none = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(np.diff(words.firsts)), *none], names=["doc_id", "text_key", "n_words", "at", "gram", "spelled"])
            for size in (PHRASE_GRAM, TEXT_GRAM):
                text, place, hashes, spelled = grams(words, size)
                own = [k.take(pa.array(text)) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.nulls(len(text), pa.int64()), pa.array(place, pa.int32()), pa.array(hashes), spelled], names=["doc_id", "text_key", "n_words", "at", "gram", "spelled"])
            first = end


def license_finds(docs: DataFrame) -> DataFrame:
    """Finds and texts: (doc_id, text_key, n_words, copies, label, base, start, share).

    Each distinct (doc_id, text) has one row without a label that holds its number of words and of copies, and a row
    for each find: its label, the place of its first word and the share of its template's words. Only rows that meet a
    template, and one row a text, are shuffled; a text's rows meet by document.
    """
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    rows = map_texts(keyed, _gram_rows, GRAM_ROWS.format(docs.schema["doc_id"].dataType.simpleString()))
    met = rows.join(F.broadcast(template_places(docs.sparkSession)), ["gram", "spelled"], "left").where("template IS NOT NULL OR n_words IS NOT NULL")
    text = ["doc_id", "text_key"]
    template = ["template", "label", "base", "template_words", "size", "slack", "least"]
    met = met.select(*text, "n_words", *template, "place", (F.col("at") - F.col("place")).alias("diagonal")).repartition(*text)
    diagonals = met.groupBy(*text, *template, "diagonal").agg(F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"), F.collect_set("place").alias("places"))
    along = Window.partitionBy(*text, *template).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > F.col("slack"), F.lit(True))
    numbered = diagonals.withColumn("apart", apart.cast("int")).withColumn("find", F.sum("apart").over(along))
    first = F.min(F.col("diagonal") + F.array_min("places"))
    finds = numbered.groupBy(*text, *template, "find").agg(F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), first.alias("start"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("size") - 1)))))
    share = (covered / F.col("template_words")).alias("share")
    return finds.select(*text, "n_words", "copies", "label", "base", "start", "least", share).where("label IS NULL OR share >= least").drop("least")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The base labels are those of phrases, found wherever their words stand consecutively; ``labels`` has those of longer
    templates too. The score is the greatest share of a template's words among the finds, 0 without one. A null text
    counts as empty. Repeated rows get a row each; extra columns are ignored; an empty table gives an empty result.
    """
    base = F.col("base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = license_finds(docs).groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"), F.max("copies").cast("int").alias("copies"), F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"), joined(F.when(base, F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("label").isNotNull(), F.col("share"))), F.lit(0.0)).alias("score"),
    )
    return found.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("copy", "copies", "text_key")
