"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line, or a window of consecutive words over line breaks that is as wide as the
template asks for; its tokens are its distinct lower-case words. A block
matches a template when it holds at least the share ``threshold`` of the template's
distinct tokens. The join is exact and compares few blocks:

* tokens are ordered by how many documents hold them, rarest first (counted over the whole
  corpus; only tokens of templates can matter);
* prefix filter: a matching block holds one of the template's first t - need + 1 tokens;
* length filter: it has at least ``need`` tokens of templates;
* positional filter: going through the block in global order, the tokens still ahead of the
  current place, in both, must suffice for the rest.

Phrases are found as well, as runs of consecutive words over the whole text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import extended, raw_texts, slices, with_columns

# Phrases that mark a license wherever their words stand together.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices of well-known licenses, as words, with their labels.
TEMPLATES = [
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]

#: Bytes to word characters: A-Z lower-cased, ASCII other than letters and digits a blank, line feeds kept.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 or b == 10 else 32 for b in range(256))


class Templates:
    """Templates with their tokens in global order, and an index of their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float, counts: dict[bytes, int]):
        sets = [frozenset(t.encode().split()) for t, _ in templates]
        order = sorted(set().union(*sets), key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.labels = [label for _, label in templates]
        self.tokens = [sorted(self.rank[w] for w in s) for s in sets]
        self.need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in sets]
        self.widths = [math.ceil(len(t.split()) / threshold) for t, _ in templates]
        self.prefix: dict[int, list[int]] = {}
        for k, (t, need) in enumerate(zip(self.tokens, self.need, strict=True)):
            for token in t[: len(t) - need + 1]:
                self.prefix.setdefault(token, []).append(k)
        self.first_words = frozenset(order[token] for token in self.prefix)

    def contained(self, block: list[int], k: int) -> int:
        """How many of template k's tokens the block (ranks, ascending) holds; 0 once too few can follow."""
        template, need, i, j, hits = self.tokens[k], self.need[k], 0, 0, 0
        while i < len(template) and j < len(block):
            if hits + min(len(template) - i, len(block) - j) < need:
                return 0
            if template[i] == block[j]:
                i, j, hits = i + 1, j + 1, hits + 1
            elif template[i] < block[j]:
                i += 1
            else:
                j += 1
        return hits if hits >= need else 0

    def search(self, line: list[bytes]) -> list[tuple[int, float]]:
        """(template, containment) of each template that the line matches."""
        block = sorted({r for w in line if (r := self.rank.get(w)) is not None})
        some = {k for r in block for k in self.prefix.get(r, ()) if len(block) >= self.need[k]}
        return [(k, hits / len(self.tokens[k])) for k in sorted(some) if (hits := self.contained(block, k))]

    def windows(self, words: list[bytes], seen: set[bytes]) -> list[tuple[int, int, int, float, bool]]:
        """(first word, last word, template, containment, best) of each place where consecutive words match a template.

        A window is as wide as the template's words divided by the threshold, whatever the line
        breaks. best: no other template has a higher containment in a window that overlaps.
        """
        present = {r for w in seen if (r := self.rank.get(w)) is not None}
        some = [k for k in sorted({k for r in present for k in self.prefix.get(r, ())}) if len(present.intersection(self.tokens[k])) >= self.need[k]]
        if not some:
            return []
        ranked = [(i, r) for i, w in enumerate(words) if (r := self.rank.get(w)) is not None]
        found: list[tuple[int, int, int, float]] = []
        for k in some:
            own, held, start, hits = set(self.tokens[k]), Counter(), 0, []
            at = [x for x in ranked if x[1] in own]
            for i, r in at:
                held[r] += 1
                while i - at[start][0] >= self.widths[k] or held[at[start][1]] > 1:
                    held[at[start][1]] -= 1
                    if not held[at[start][1]]:
                        del held[at[start][1]]
                    start += 1
                if len(held) >= self.need[k]:
                    new = (at[start][0], i, k, len(held) / len(own))
                    if hits and new[0] <= hits[-1][1]:
                        hits[-1] = max(hits[-1], new, key=lambda h: (h[3], h[0] - h[1]))
                    else:
                        hits.append(new)
            found += hits
        return [(*h, not any(g[3] > h[3] and g[0] <= h[1] and h[0] <= g[1] for g in found)) for h in sorted(found)]


def places(joined: bytes, phrase: bytes) -> list[int]:
    """The word numbers where the phrase begins; ``joined``: words with a blank around each."""
    out, at = [], joined.find(b" " + phrase + b" ")
    while at >= 0:
        out.append(joined.count(b" ", 0, at))
        at = joined.find(b" " + phrase + b" ", at + 1)
    return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = 0.8, text: str = "text") -> DataFrame:
    """The rows with what marks a license in them.

    n_words; n_base, the places of all phrases; first_word and last_word, their smallest and
    largest start (words from 0; null without any); base_labels, the phrases' labels, and
    labels, those of the templates that each matching line, or window that no better match
    overlaps, holds most of too (both distinct, sorted, comma-joined); spans, a list of (line, label, score) for
    every line and template that match, and every window over line breaks by its first line; score: 1 with a phrase, else the
    highest containment of a matching line or window, else 0. Words are runs of ASCII letters and
    digits and of characters beyond ASCII, A-Z lower-cased. A null text counts as empty:
    no words, no labels (''), score 0. Present columns of these names are replaced. Every
    row comes back in its partition; only counts of template tokens are shuffled.
    """
    sc = docs.sparkSession.sparkContext
    wanted = frozenset(w for t, _ in templates for w in t.encode().split())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for raw in raw_texts(batch.column("text")):
                total.update(wanted.intersection(raw.translate(TO_WORDS).split()))
        yield pa.RecordBatch.from_pydict({"word": pa.array(total.keys(), pa.binary()), "c": pa.array(total.values(), pa.int64())})

    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c"))
    shared = sc.broadcast(Templates(templates, threshold, {bytes(w): c for w, c in counted.collect()}))
    marks = [(p.encode(), label) for p, label in phrases.items()]
    span = T.ArrayType(T.StructType([T.StructField("line", T.LongType()), T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())]))
    kinds = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("spans", span), ("score", T.DoubleType())]
    schema = extended(docs.schema, *kinds)
    arrow = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.struct([("line", pa.int64()), ("label", pa.string()), ("score", pa.float64())])), pa.float64()]

    def one(raw: bytes, known: Templates) -> tuple:
        flat = raw.translate(TO_WORDS)
        words = flat.split()
        starts, base, spans = [], set(), []
        seen, best = set(words), set()
        if any(seen.issuperset(p.split()) for p, _ in marks):
            joined = b" " + b" ".join(words) + b" "
            for phrase, label in marks:
                if at := places(joined, phrase):
                    starts += at
                    base.add(label)
        if not known.first_words.isdisjoint(seen):
            for number, line in enumerate(flat.split(b"\n")):
                own = line.split()
                if not known.first_words.isdisjoint(own):
                    found = known.search(own)
                    spans += [{"line": number, "label": known.labels[k], "score": share} for k, share in found]
                    best |= {known.labels[k] for k, share in found if share == max(s for _, s in found)}
            if over := known.windows(words, seen):
                line_of = [number for number, line in enumerate(flat.split(b"\n")) for _ in line.split()]
                # Windows within a line have their spans already, but not the labels of a second notice there.
                spans += [{"line": line_of[first], "label": known.labels[k], "score": share} for first, last, k, share, _ in over if line_of[first] != line_of[last]]
                best |= {known.labels[k] for _, _, k, _, top in over if top}
        score = 1.0 if starts else max((s["score"] for s in spans), default=0.0)
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | best)), spans, score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for batch in slices(whole, text):
                rows = list(zip(*(one(raw, known) for raw in raw_texts(batch.column(text))), strict=True))
                columns = with_columns(batch, {name: pa.array(rows[i] if rows else [], kind) for i, ((name, _), kind) in enumerate(zip(kinds, arrow, strict=True))})
                yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema.fields], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)
