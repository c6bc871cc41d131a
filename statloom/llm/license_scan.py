"""License scans in DataFrame functions only.

Every line of a text and the whole text are units; where none of them is a notice, so is every span of its words.
A unit is normalised (lower case; everything but a-z and 0-9 is one space) and compared with each licence template by
the Dice coefficient over distinct word bigrams. A unit of b bigrams can reach a coefficient of t with a template of m
bigrams only if t m / (2 - t) <= b <= m (2 - t) / t; other templates are not intersected.

Spans run over line ends and are of any length. Only those that begin and end with a bigram of the template and hold their
first bigram once are tried, all of them; others have no higher coefficient. They are also compared with the full
licence texts and further headers in ``texts()``, and only where the text has the t m / (2 - t) bigrams that any span needs.
A beginning is passed over if all template bigrams from there on cannot give more than the best span so far.

The best template of a text is the one of highest coefficient, the first in the list among equals, for spans the
longest. Nothing is shuffled.

Defined results: null, empty and licence-free texts have no licence, a coefficient of 0 and no matching line;
repeated rows are scanned each for itself; null ids and other columns are carried through or ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: (licence, text) of notices as they are commonly written; several per licence.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]


#: (licence, text) of headers that are told from those above by a few words.
HEADERS = [
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
]


def texts() -> list[tuple[str, str]]:
    """HEADERS and the full licence texts in the folder ``licenses``, by name; only the driver reads them."""
    return HEADERS + [(p.name, p.read_text()) for p in sorted((Path(__file__).parent / "licenses").iterdir())]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def template_bigrams(text: str) -> list[tuple[str, str]]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted(set(zip(words, words[1:])))  # noqa: B905


def _word_pairs(unit: Column) -> Column:
    """Hashes of the word bigrams of a unit, in their order."""
    words = F.array_remove(F.split(F.lower(unit), r"[^a-z0-9]+"), "")

    def pairs(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.xxhash64(a, b))

    return _let(words, pairs)


def _bigrams(unit: Column) -> Column:
    """Hashes of the distinct word bigrams of a unit."""
    return F.array_distinct(_word_pairs(unit))


def _hashes(spark: SparkSession, templates: list[tuple[str, str]]) -> list[np.ndarray]:
    """The bigrams of each template, hashed by Spark in one small job: whole arrays as literals keep plans short."""
    rows = [(k, a, b) for k, (_, t) in enumerate(templates) for a, b in template_bigrams(t)]
    if not rows:
        return []
    got = spark.createDataFrame(rows, "k int, a string, b string").select("k", F.xxhash64("a", "b").alias("h")).toArrow()
    at, h = got.column("k").to_numpy(), got.column("h").to_numpy()
    return [h[at == k] for k in range(len(templates))]


def _span_score(g: Column, hashed: list[np.ndarray], threshold: float) -> Column:
    """(coefficient, - template number) of the best span of word pairs g, as in _score."""

    def against(k: int, own: Column) -> Column:
        known, m = F.lit(hashed[k]), len(hashed[k])
        need, most = max(1, math.ceil(threshold * m / (2 - threshold) - 1e-9)), math.floor(m * (2 - threshold) / threshold + 1e-9)

        def best(codes: Column, some: Column) -> Column:
            def reach(p: Column, length: Column) -> Column:
                """The different bigrams of so many places from p on, and the best coefficient of the spans that end at a hit."""

                def dice(new: Column) -> Column:
                    sizes = F.array_compact(F.transform(new, lambda c, j: F.when(c.bitwiseAND(1) == 1, j + 1)))
                    return F.struct(F.size(new).alias("size"), F.array_max(F.transform(sizes, lambda s, r: (2.0 * (r + 1)) / (s + m))).alias("dice"))

                return _let(F.array_distinct(F.slice(codes, p + 1, length)), dice)

            def one(p: Column) -> Column:
                # Beyond ``most`` different bigrams no span reaches the threshold; nearly always 2 * most places hold them.
                again = F.array_position(F.slice(codes, p + 2, F.size(codes)), F.get(codes, p))
                whole = F.when(again > 0, again.cast("int")).otherwise(F.size(codes) - p)
                return _let(reach(p, F.lit(2 * most)), lambda v: F.when((v["size"] <= most) & (p + 2 * most < F.size(codes)), F.greatest(v["dice"], reach(p, whole)["dice"])).otherwise(v["dice"]))

            def step(acc: Column, p: Column) -> Column:
                able = (acc["left"] >= need) & ((2.0 * F.least(acc["left"], some)) / (F.least(acc["left"], some) + m) > acc["dice"])
                return F.struct(F.when(able, F.greatest(acc["dice"], one(p))).otherwise(acc["dice"]).alias("dice"), (acc["left"] - 1).alias("left"))

            hits = F.array_compact(F.transform(codes, lambda c, i: F.when(c.bitwiseAND(1) == 1, i)))
            return _let(hits, lambda at: F.aggregate(at, F.struct(F.lit(0.0).alias("dice"), F.size(at).alias("left")), step, lambda acc: acc["dice"]))

        # 63 bits of each hash, and 1 for a bigram of the template.
        codes = F.transform(g, lambda x: x.bitwiseAND(-2).bitwiseOR(F.array_contains(known, x).cast("long")))
        some = F.when(F.size(own) >= need, F.size(F.array_intersect(own, known))).otherwise(0)
        d = _let(some, lambda n: F.when(n >= need, _let(codes, lambda c: best(c, n))).otherwise(0.0))
        return _let(d, lambda v: F.struct(F.when(v >= threshold, v).otherwise(0.0).alias("dice"), F.lit(-k).alias("k")))

    return _let(F.array_distinct(g), lambda own: F.array_max(F.array(*[against(k, own) for k, h in enumerate(hashed) if len(h)])))


def _score(bigrams: Column, templates: list[tuple[str, str]], threshold: float) -> Column:
    """(coefficient, - template number) of the best template, coefficients below the threshold being 0."""

    def against(k: int, text: str) -> Column:
        own = template_bigrams(text)
        m = len(own)
        low, high = threshold * m / (2 - threshold), m * (2 - threshold) / threshold
        known = F.array(*[F.xxhash64(F.lit(a), F.lit(b)) for a, b in own])
        n = F.size(bigrams)
        dice = (2.0 * F.size(F.array_intersect(bigrams, known))) / (n + m)
        pruned = F.when((n >= low) & (n <= high), dice).otherwise(0.0)
        return F.struct(F.when(pruned >= threshold, pruned).otherwise(0.0).alias("dice"), F.lit(-k).alias("k"))

    return F.array_max(F.array(*[against(k, t) for k, (_, t) in enumerate(templates)]))


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, more: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice, matches (array of line number, licence, dice of all matching lines) per row of docs.

    Lines and whole texts are compared with ``templates``, spans also with ``more`` (default: ``texts()``).
    """
    every = sorted(templates + (texts() if more is None else more), key=lambda x: -len(template_bigrams(x[1])))
    hashed = _hashes(docs.sparkSession, every)
    names, span_names = (F.array(*[F.lit(n) for n, _ in x]) for x in (templates, every))
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), t.alias("t"))
    best = lambda unit: _let(_bigrams(unit), lambda b: _score(b, templates, threshold))
    named = lambda s, among: F.struct(F.when(s["dice"] > 0, F.get(among, -s["k"])).alias("license"), s["dice"].alias("dice"))

    def judged(lines: Column) -> Column:
        """lines and the verdict of the text; spans are looked at only where no line and no whole text is a notice."""
        top = F.greatest(F.array_max(lines), best(F.col("t")))
        spans = lambda: _let(_span_score(_word_pairs(F.col("t")), hashed, threshold), lambda s: named(s, span_names))
        return _let(top, lambda s: F.struct(lines.alias("lines"), F.when(s["dice"] > 0, named(s, names)).otherwise(spans()).alias("top")))

    rows = rows.select("doc_id", _let(F.transform(F.split("t", "\n"), best), judged).alias("v"))
    found = F.transform("v.lines", lambda s, i: F.struct(i.alias("line"), F.get(names, -s["k"]).alias("license"), s["dice"].alias("dice")))
    return rows.select("doc_id", F.col("v.top.license").alias("license"), F.col("v.top.dice").alias("dice"), F.filter(found, lambda s: s["dice"] > 0).alias("matches"))
