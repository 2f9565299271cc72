"""License scans by diagonal voting of word k-grams against license templates."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tissuelake.llm.common import mix, string_bytes, word_hashes, written

#: Words of a k-gram.
K = 3
#: Diagonals this far apart merge; words of context that a verified span may reach beyond its votes.
GAP, CONTEXT = 3, 12
#: Share of a template's words that a span must have in order: of short statements and of long notices.
SHORT_SHARE, LONG_SHARE, LONG_WORDS = 0.8, 0.6, 20

# Phrases of the base scan with their labels, and public license statements and notices by label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("agpl-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("bsd-2-clause", "licensed under the BSD 2-Clause License"),
    ("bsd-3-clause", "licensed under the BSD 3-Clause License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("cc-by-4.0", "licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-nd-4.0", "licensed under CC BY-NC-ND 4.0"),
    ("cc-by-nc-sa-4.0", "licensed under CC BY-NC-SA 4.0"),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("mit", "Released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TABLE = np.frombuffer(_FOLD, np.uint8)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, one after the other, and the number of words of each text."""
    return word_hashes(_TABLE[data], offsets)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix(out * _ODD + hashes[i : i + n])
    return out


def words_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words(data, np.array([0, len(data)]))[0]


def _span_schema() -> str:
    return "row long, spans array<struct<template:int,first:long,last:long,share:double>>"


def scan(docs: DataFrame, k: int = K, base: tuple = BASE, templates: tuple = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    A null text is empty. Words are runs of letters, digits and non-ASCII characters of the text with A-Z lower-cased.
    Base: all places where a phrase's words stand consecutively; first_word and last_word are null without one, and
    labels are empty strings without any. score is 1 with a base phrase, else the largest share of a template's words
    that a verified span has, else 0. Texts are read whole, however long. Rows that repeat an id are rows of their
    own. Other columns don't matter. An empty table gives an empty result.

    Executors hash all rolling word k-grams of all texts and keep the places of those that templates have (that set
    has a fixed size). Spark joins these to the template positions, which are as few, and counts votes by diagonal
    (place in the text less place in the template). Neighbouring diagonals of a template merge to spans, which an
    alignment of their words verifies.
    """
    spark = docs.sparkSession
    own = [words_of(t) for _, t in templates]
    places = [(int(g.view(np.int64)), t, p) for t, w in enumerate(own) for p, g in enumerate(grams(w, k))]
    wanted = np.unique(np.array([p[0] for p in places], np.int64))
    phrases = [(words_of(p), label) for p, label in base]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                hashes, counts = words(*string_bytes(batch["text"]))
                ends = np.cumsum(counts)
                doc = np.repeat(np.arange(len(counts)), counts)
                found: dict[int, list[tuple[int, str]]] = {}
                for phrase, label in phrases:
                    m = len(phrase)
                    n = len(hashes) - m + 1
                    if n <= 0:
                        continue
                    hit = doc[:n] == doc[m - 1 :]
                    for i in range(m):
                        hit &= hashes[i : i + n] == phrase[i]
                    for p in np.nonzero(hit)[0].tolist():
                        found.setdefault(int(doc[p]), []).append((p - int(ends[doc[p]] - counts[doc[p]]), label))
                g = grams(hashes, k).view(np.int64)
                near = np.minimum(np.searchsorted(wanted, g), len(wanted) - 1)
                hits = np.nonzero((wanted[near] == g) & (doc[: len(g)] == doc[k - 1 :][: len(g)]))[0] if len(g) else np.empty(0, np.int64)
                by: dict[int, list[int]] = {}
                for p in hits.tolist():
                    by.setdefault(int(doc[p]), []).append(p)
                rows = []
                for d, (identifier, n) in enumerate(zip(batch["doc"].to_pylist(), counts.tolist(), strict=True)):
                    start = int(ends[d]) - n
                    places = found.get(d, [])
                    mine = [{"gram": int(g[p]), "pos": p - start} for p in by.get(d, ())]
                    near = [{"pos": p, "word": int(x)} for p, x in _context(hashes[start : start + n], [h["pos"] for h in mine], k)] if mine else []
                    rows.append((identifier, n, len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), sorted({x for _, x in places}), mine, near))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("gram", pa.int64()), ("pos", pa.int64())])), pa.list_(pa.struct([("pos", pa.int64()), ("word", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "hits", "near"])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, hits array<struct<gram:long,pos:long>>, near array<struct<pos:long,word:long>>"
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(find, schema).withColumn("row", F.monotonically_increasing_id())
    scanned = written(rows, "license-hits")

    positions = spark.createDataFrame(places, "gram long, template int, at int")
    hits = scanned.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.gram", "h.pos")
    votes = hits.join(F.broadcast(positions), "gram").withColumn("diagonal", F.col("pos") - F.col("at")).groupBy("row", "template", "diagonal").agg(F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    gathered = votes.groupBy("row").agg(F.collect_list(F.struct("template", "diagonal", "votes", "first", "last")).alias("votes"))
    names = [label for label, _ in templates]
    template_words = [w.view(np.int64).tolist() for w in own]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for votes, near in zip(batch["votes"].to_pylist(), batch["near"].to_pylist(), strict=True):
                at = {x["pos"]: x["word"] for x in near}
                out.append(_best([s for s in (_verified(span, at, template_words, k) for span in _merged(votes)) if s], names))
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(out, pa.list_(pa.struct([("template", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())])))], names=["row", "spans"])

    spans = scanned.where(F.size("hits") > 0).select("row", "near").join(gathered, "row").select("row", "votes", "near").mapInArrow(verify, _span_schema())
    labels = F.array(*(F.lit(label) for label, _ in templates))
    named = F.transform("spans", lambda s: F.struct(F.get(labels, s["template"]).alias("label"), s["first"].alias("first"), s["last"].alias("last"), s["share"].alias("share")))
    joined = scanned.drop("hits", "near").join(spans, "row", "left").withColumn("spans", F.coalesce(named, F.array().cast("array<struct<label:string,first:bigint,last:bigint,share:double>>")))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.transform("spans", lambda s: s["label"])))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0))).alias("score"),
        F.to_json(F.array_sort("spans")).alias("spans"),
    )


def _context(hashes: np.ndarray, positions: list[int], k: int) -> list[tuple[int, int]]:
    """The words around places with votes."""
    keep = np.zeros(len(hashes), bool)
    for p in positions:
        keep[max(0, p - CONTEXT) : p + k + CONTEXT] = True
    at = np.nonzero(keep)[0]
    return list(zip(at.tolist(), hashes[at].view(np.int64).tolist(), strict=True))


def _merged(votes: list[dict]) -> list[dict]:
    """Spans from votes: neighbouring diagonals of a template."""
    spans: list[dict] = []
    for v in sorted(votes, key=lambda v: (v["template"], v["diagonal"])):
        s = spans[-1] if spans else None
        if s and s["template"] == v["template"] and v["diagonal"] - s["to"] <= GAP:
            s |= {"to": v["diagonal"], "votes": s["votes"] + v["votes"], "first": min(s["first"], v["first"]), "last": max(s["last"], v["last"])}
        else:
            spans.append(dict(v) | {"to": v["diagonal"]})
    return spans


def _verified(span: dict, at: dict[int, int], templates: list[list[int]], k: int) -> dict | None:
    """The span's places and the share of the template's words that it has in order; None if too small."""
    template = templates[span["template"]]
    low, high = max(span["first"] - CONTEXT, span["diagonal"]), min(span["last"] + k + CONTEXT, span["to"] + len(template))
    places = [p for p in range(low, high) if p in at]
    blocks = [b for b in SequenceMatcher(None, [at[p] for p in places], template, autojunk=False).get_matching_blocks() if b.size]
    share = sum(b.size for b in blocks) / len(template)
    if not blocks or share < (LONG_SHARE if len(template) >= LONG_WORDS else SHORT_SHARE):
        return None
    return {"template": span["template"], "first": places[blocks[0].a], "last": places[blocks[-1].a + blocks[-1].size - 1], "share": share, "matched": sum(b.size for b in blocks)}


def _best(spans: list[dict], names: list[str]) -> list[dict]:
    """Of overlapping spans those with most words in order (ties: the larger share, then the first label).

    The spans kept so far don't overlap and lie in order, so that a new one is held against its neighbours only.
    """
    firsts: list[int] = []
    kept: dict[int, dict] = {}
    for s in sorted(spans, key=lambda s: (-s["matched"], -s["share"], names[s["template"]], s["first"])):
        k = bisect_right(firsts, s["last"])
        if not k or kept[firsts[k - 1]]["last"] < s["first"]:
            firsts.insert(k, s["first"])
            kept[s["first"]] = s
    return [kept[f] for f in firsts]
