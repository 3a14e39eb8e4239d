"""License notices found by patience alignment of documents with templates.

Words that occur once in both text and template are anchors; the longest
increasing subsequence of anchors fixes the alignment, equal words next to
anchors join it, and the gaps between are aligned the same way.  The coverage
is the share of the template's words that the alignment holds.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.stage import read_table
from quarry.llm.textops import chunks, find_words, hash_list, hash_words

#: Short notices and headers, as their owners publish them.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-header": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
COVERAGE = 0.8


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence, of pairs in order of the first place, whose second places increase (patience piles)."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        if pile == len(tops):
            tops.append(b)
            at.append(i)
        else:
            tops[pile], at[pile] = b, i
        before[i] = at[pile - 1] if pile else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def patience(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Aligned (text place, template place) pairs of equal words, increasing in both.

    Gaps without a word unique to both sides keep only what equals at their
    two ends.
    """
    out: list[tuple[int, int]] = []
    stack = [(0, len(text), 0, len(template))]
    while stack:
        a, a_end, b, b_end = stack.pop()
        while a < a_end and b < b_end and text[a] == template[b]:
            out.append((a, b))
            a, b = a + 1, b + 1
        while a < a_end and b < b_end and text[a_end - 1] == template[b_end - 1]:
            a_end, b_end = a_end - 1, b_end - 1
            out.append((a_end, b_end))
        if a == a_end or b == b_end:
            continue
        ours, theirs = Counter(text[a:a_end]), Counter(template[b:b_end])
        place = {w: i for i, w in enumerate(template[b:b_end], b) if theirs[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(text[a:a_end], a) if ours[w] == 1 and w in place]
        for i, j in _increasing(anchors):
            stack.append((a, i, b, j))
            out.append((i, j))
            a, b = i + 1, j + 1
        if anchors:
            stack.append((a, a_end, b, b_end))
    return sorted(out)


def _ends(words: list[int], template: list[int], a: int, need: int) -> list[tuple[int, int]]:
    """(bound, past the last word) of the stretches from ``a`` that may hold ``need`` aligned words: the longest common subsequence bounds them; highest bound first, then shortest."""
    masks: dict[int, int] = {}
    for i, w in enumerate(template):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(template)) - 1
    row, out = full, []
    for b in range(a, min(len(words), a + 2 * len(template))):
        mask = masks.get(words[b])
        if mask:
            both = row & mask
            row = ((row + both) | (row - both)) & full
            bound = len(template) - row.bit_count()
            if bound >= need:
                out.append((bound, b + 1))
    return sorted(out, key=lambda x: (-x[0], x[1]))


def notices(words: list[int], templates: list[tuple[str, list[int]]], least: float = COVERAGE, starts: list[list[int]] | None = None) -> list[tuple[str, float, int, int]]:
    """(template, coverage, first word, past the last) of every notice in a text, from the left; each word is used once.

    Every stretch of at most twice the template's words that its alignment
    begins and ends is tried, the one with the most aligned words first, then
    the highest coverage, the first template, the shortest, the leftmost.
    ``starts`` lists for each template the only words at which one can begin.
    """
    out = []
    used = bytearray(len(words))
    needs = [_need(least, t) for _, t in templates]
    queue: list[tuple] = []  # one stretch of each start not yet aligned, and aligned ones (k < 0)

    def put(i, a, k):
        t = templates[i][1]
        ends = _ends(words, t, a, needs[i])
        if k < len(ends):
            n, b = ends[k]
            heappush(queue, (-n, -n / len(t), i, b - a, a, k))

    for i, (_, t) in enumerate(templates):
        own = set(t)
        for a in range(len(words)) if starts is None else starts[i]:
            if words[a] in own:
                put(i, a, 0)
    while queue:
        n, c, i, size, a, k = heappop(queue)
        name, t = templates[i]
        if used.find(1, a, a + needs[i]) >= 0:
            continue
        free = used.find(1, a, a + size) < 0
        if free and k < 0:
            out.append((name, -c, a, a + size))
            used[a : a + size] = b"\1" * size
        if k >= 0:
            if free:
                pairs = patience(words[a : a + size], t)
                if len(pairs) >= needs[i] and pairs[0][0] == 0 and pairs[-1][0] == size - 1:
                    heappush(queue, (-len(pairs), -len(pairs) / len(t), i, size, a, -1))
            put(i, a, k + 1)
    return sorted(out, key=lambda x: x[2])


def _need(least: float, template: list[int]) -> int:
    """The fewest aligned words that cover the template."""
    n = len(template)
    return max(1, next(k for k in range(n + 2) if k > n or k / n >= least))


def _starts(at: np.ndarray, ids: np.ndarray, template: list[int], need: int) -> np.ndarray:
    """Places (of ``at``, ascending) from which twice the template's words hold ``need`` of its words, each as often as there."""
    size = 2 * len(template)
    own = np.flatnonzero(np.isin(ids, template))
    if len(own) < need:
        return at[:0]
    place = at[own]
    dense = np.flatnonzero(place[need - 1 :] - place[: len(own) - need + 1] < size)
    if not len(dense):
        return at[:0]
    first = place[dense]
    before = np.searchsorted(first, place, side="right") - 1
    near = (before >= 0) & (place - first[np.maximum(before, 0)] < size)
    place, ids = place[near], ids[own][near]
    held = np.zeros(len(first), np.int64)
    for w, most in Counter(template).items():
        p = place[ids == w]
        held += np.minimum(most, np.searchsorted(p, first + size) - np.searchsorted(p, first))
    return first[held >= need]


def _scan(templates: dict[str, str], least: float):
    def run(batches):
        hashed = [(name, hash_list([w for w in [t]], "alnum").tolist()) for name, t in templates.items()]
        vocabulary = np.array(sorted({w for _, t in hashed for w in t}), np.uint64)
        numbered = [(name, np.searchsorted(vocabulary, np.array(t, np.uint64)).tolist()) for name, t in hashed]
        apart = 2 * max((len(t) for _, t in numbered), default=0)
        for batch in batches:
            n_words, found = [], []
            for lo, hi, data, bounds in chunks(batch.column("text")):
                starts, ends, first = find_words(data, bounds, "alnum")
                h = hash_words(data, starts, ends)
                ids = np.minimum(np.searchsorted(vocabulary, h), max(0, len(vocabulary) - 1))
                at = np.flatnonzero(vocabulary[ids] == h) if len(vocabulary) else np.zeros(0, np.int64)
                doc = np.searchsorted(first, at, side="right") - 1
                per: dict[int, list] = {}
                begin: dict[int, list[list[int]]] = {}
                for i, (_, t) in enumerate(numbered):
                    if not t:
                        continue
                    wide = _starts(at + doc * apart, ids[at], t, _need(least, t))  # no window reaches the next document
                    k = np.searchsorted(at + doc * apart, wide)
                    for d, a in zip(doc[k].tolist(), at[k].tolist(), strict=True):
                        begin.setdefault(d, [[] for _ in numbered])[i].append(a - int(first[d]))
                for d, own in begin.items():
                    base, end = int(first[d]), int(first[d + 1])
                    run_ids = np.where(vocabulary[ids[base:end]] == h[base:end], ids[base:end], -1).tolist()
                    per[d] = [{"license": name, "coverage": c, "start": x, "end": y} for name, c, x, y in notices(run_ids, numbered, least, own)]
                for d in range(hi - lo):
                    n_words.append(int(first[d + 1] - first[d]))
                    found.append(per.get(d, []))
            kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(n_words, pa.int64()), pa.array(found, kind)], names=[*names, "n_words", "notices"])

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = COVERAGE) -> DataFrame:
    """Other columns of ``docs`` plus n_words and notices (license, coverage, start, end in words).

    A notice is a stretch of words, no longer than twice its template, whose
    alignment covers at least ``least`` of the template and begins and ends
    it; where stretches overlap, the one with more aligned words wins, then the
    higher coverage, the first template listed, the shorter, the one further left.  Null and empty texts have none; repeated notices
    are listed each.
    """
    clash = {"n_words", "notices"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    schema = ", ".join([*kept, "n_words long, notices array<struct<license: string, coverage: double, start: bigint, end: bigint>>"])
    return docs.mapInArrow(_scan(templates, least), schema)


def query(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform("notices", lambda n: n["license"])))
    spans = F.array_join(F.transform("notices", lambda n: F.concat_ws(":", n["license"], n["start"], n["end"])), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("notices").cast("long").alias("n_notices"),
        F.array_join(names, ",").alias("licenses"),
        F.round(F.array_max(F.transform("notices", lambda n: n["coverage"])), 6).alias("best_coverage"),
        spans.alias("spans"),
    )
