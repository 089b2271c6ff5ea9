"""License scans: phrase places, and an exact set-similarity join of text blocks with templates.

A block is one line of a text, or a run of consecutive words over any number of lines, as long
as a template's words divided by `threshold` (at most to the end of the text), so that a notice
is found however it is wrapped. Blocks and templates are sets of words. A block matches a
template when it holds at least `threshold` of the template's distinct words. Tokens are
ordered by their frequency over the whole corpus, rarest first. A matching block must share a
token of the template's prefix (prefix filter), hold enough tokens (length filter), and have
enough tokens left in both orders from the shared one on (positional filter); what passes is
counted exactly, so no match is lost. Runs are cut down to one template's tokens first; for
those, the positional filter says no more than the other two.

Defined cases: a null text has no words and no labels; repeated rows get equal results; an
empty table gives no rows; other columns of the input are ignored. Templates are a parameter
of a few short texts; only they and one count for each of their words travel to executors.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm._text import Words, find, result, slices, word_hashes

#: Phrases whose places are counted, with their labels: fixed values.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Opening sentences of public license notices, with their labels: fixed values.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
THRESHOLD = 0.8


def _split(text: str) -> list[bytes]:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    words = Words(data, np.array([0, len(data)]), hashed=False)
    return [words.word(i) for i in range(len(words))]


class Templates:
    """Templates as sets of ranks in the global order, with their prefixes."""

    def __init__(self, templates: Sequence[tuple[str, str]], counts: Mapping[bytes, int], threshold: float):
        texts = [_split(text) for _, text in templates]
        sets = [set(text) for text in texts]
        self.span = [ceil(len(text) / threshold - 1e-9) for text in texts]
        order = sorted(set().union(*sets), key=lambda w: (counts.get(w, 0), w))
        rank = {w: i for i, w in enumerate(order)}
        self.size = len(order)
        hashes = word_hashes(order)
        self.by_hash = np.argsort(hashes)
        self.hashes = hashes[self.by_hash]
        self.labels = [label for label, _ in templates]
        self.tokens = [sorted(rank[w] for w in s) for s in sets]
        self.needed = [ceil(threshold * len(t) - 1e-9) for t in self.tokens]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, (tokens, needed) in enumerate(zip(self.tokens, self.needed, strict=True)):
            for at, token in enumerate(tokens[: len(tokens) - needed + 1]):
                self.prefix.setdefault(token, []).append((k, at))
        self.in_prefix = np.zeros(self.size + 1, dtype=bool)
        self.in_prefix[list(self.prefix)] = True
        self.holds = np.zeros((len(sets), self.size), dtype=bool)
        self.begins = np.zeros((len(sets), self.size), dtype=bool)
        for k, (tokens, needed) in enumerate(zip(self.tokens, self.needed, strict=True)):
            self.holds[k, tokens] = True
            self.begins[k, tokens[: len(tokens) - needed + 1]] = True

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        at = find(self.hashes, hashes)
        return np.where(at >= 0, self.by_hash[at], -1)

    def matches(self, words: Words, data: np.ndarray) -> Iterator[tuple[int, str, float]]:
        """(text, label, containment) for each matching block and template; of runs, each text's best."""
        ranks = self.ranks(words.hashes)
        known = np.flatnonzero(ranks >= 0)
        if not len(known):
            return
        doc = words.of_doc()[known]
        yield from self.runs(known, ranks[known], words.bounds[doc + 1], doc)
        block = np.cumsum(data == 10)[words.starts[known]] + doc  # grows with the line and with the text
        pairs, first = np.unique(block * self.size + ranks[known], return_index=True)
        doc = doc[first]
        block, token = np.divmod(pairs, self.size)
        begins = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        ends = np.append(begins[1:], len(block))
        hit = np.unique(np.searchsorted(begins, np.flatnonzero(self.in_prefix[token]), side="right") - 1)
        for b in hit:
            held = token[begins[b] : ends[b]].tolist()
            seen: set[int] = set()
            for at, t in enumerate(held):
                for k, place in self.prefix.get(t, ()):
                    tokens, needed = self.tokens[k], self.needed[k]
                    if k in seen or len(held) < needed or min(len(tokens) - place, len(held) - at) < needed:
                        continue
                    seen.add(k)
                    shared = len(set(held).intersection(tokens))
                    if shared >= needed:
                        yield int(doc[begins[b]]), self.labels[k], shared / len(tokens)

    def runs(self, places: np.ndarray, ranks: np.ndarray, text_ends: np.ndarray, docs: np.ndarray) -> Iterator[tuple[int, str, float]]:
        """(text, label, containment) of each text's best run of words that matches a template.

        A run that begins at a token of the template holds as many as any; a token counts where it stands first in the run.
        """
        for k, (span, needed) in enumerate(zip(self.span, self.needed, strict=True)):
            mine = np.flatnonzero(self.holds[k, ranks])
            at, token = places[mine], ranks[mine]
            ends = np.searchsorted(at, np.minimum(at + span, text_ends[mine]))
            starts = np.arange(len(at))
            rare = np.concatenate([[0], np.cumsum(self.begins[k, token])])
            starts = starts[(ends - starts >= needed) & (rare[ends] > rare[starts])]
            if not len(starts):
                continue
            ends = ends[starts]
            order = np.argsort(token, kind="stable")
            earlier = np.full(len(at), -1)
            again = np.flatnonzero(token[order[1:]] == token[order[:-1]])
            earlier[order[again + 1]] = order[again]
            shared = np.zeros(len(starts), dtype=np.int64)
            for step in range(int((ends - starts).max())):
                here = np.minimum(starts + step, len(at) - 1)
                shared += (starts + step < ends) & (earlier[here] < starts)
            good = shared >= needed
            found, first = np.unique(docs[mine[starts[good]]], return_index=True)
            for d, best in zip(found.tolist(), np.maximum.reduceat(shared[good], first).tolist() if len(found) else (), strict=True):
                yield d, self.labels[k], best / len(self.tokens[k])


def phrase_places(words: Words, phrase: list[bytes]) -> np.ndarray:
    """Word numbers at which the phrase's words stand consecutively within one text."""
    hashes, m = word_hashes(phrase), len(phrase)
    if len(words) < m:
        return np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(words.hashes[: len(words) - m + 1] == hashes[0])
    for k in range(1, m):
        at = at[words.hashes[at + k] == hashes[k]]
    text = np.searchsorted(words.bounds, at, side="right")
    at = at[words.bounds[text] >= at + m] if len(at) else at
    return np.array([i for i in at if all(words.word(i + k) == w for k, w in enumerate(phrase))], dtype=np.int64)


def token_counts(docs: DataFrame, tokens: list[bytes]) -> dict[bytes, int]:
    """How often each of these words occurs in all texts; the result is as long as `tokens` at most."""
    tokens = sorted(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes(tokens)
        order = np.argsort(hashes)
        total = np.zeros(len(tokens), dtype=np.int64)
        for batch in batches:
            for _, data, bounds in slices(batch, "text"):
                at = find(hashes[order], Words(data, bounds).hashes)
                total += np.bincount(order[at[at >= 0]], minlength=len(tokens))
        yield pa.RecordBatch.from_pydict({"token": pa.array(range(len(tokens)), pa.int32()), "n": total})

    rows = docs.select("text").mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {tokens[r.token]: r.n for r in rows}


SCAN = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
])
SCAN_DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: its phrases, its labels, and the best containment (1 with a phrase)."""
    vocabulary = set().union(*(_split(text) for _, text in templates))
    counts = token_counts(docs, list(vocabulary))
    wanted = [(_split(phrase), label) for phrase, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = Templates(templates, counts, threshold)
        for batch in batches:
            for rows, data, bounds in slices(batch, "text"):
                words = Words(data, bounds)
                n = rows.num_rows
                base: list[set] = [set() for _ in range(n)]
                added: list[set] = [set() for _ in range(n)]
                places: list[list[int]] = [[] for _ in range(n)]
                score = np.zeros(n)
                for phrase, label in wanted:
                    for at in phrase_places(words, phrase).tolist():
                        d = int(np.searchsorted(words.bounds, at, side="right")) - 1
                        base[d].add(label)
                        places[d].append(at - int(words.bounds[d]))
                        score[d] = 1.0
                for d, label, share in joined.matches(words, data):
                    added[d].add(label)
                    score[d] = max(score[d], share)
                yield result(SCAN, {
                    "doc_id": rows.column("doc_id").cast(pa.int64()), "n_words": np.diff(words.bounds), "n_base": [len(p) for p in places],
                    "first_word": [min(p, default=None) for p in places], "last_word": [max(p, default=None) for p in places],
                    "base_labels": [",".join(sorted(b)) for b in base], "labels": [",".join(sorted(b | a)) for b, a in zip(base, added, strict=True)], "score": score,
                })

    return docs.select("doc_id", "text").mapInArrow(run, SCAN_DDL)
