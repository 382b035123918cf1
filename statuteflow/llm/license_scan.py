"""License scans by conditional compression.

The words around each anchor, over the ends of lines, are cut into blocks. Each block is compressed alone and with every
license template as a raw zstandard dictionary; the templates by which it shrinks are its candidates. An exact comparison of
words confirms where they are, and of confirmed templates for the same words the one that saves most bytes is reported.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query
from .words import text_slices

# Usual wordings of license statements, by the license's short identifier.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD License.",
    ),
    "CC-BY-4.0": ("This work is licensed under the Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}
# Fixed value: words of which every license statement has one.
ANCHOR = re.compile(rb"licen[cs]e|licensed|permission|redistribut|\bCC BY|copyleft", re.I)
LONGEST_LINE, AROUND = 600, 300  # bytes: of longer lines, the parts around a statement are given
LEVEL = 19  # of compression: lower ones leave out some short matches
DIFFERENT = 0.2  # share of the template's words that may differ
WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_OF_WORDS = [bool(WORDS.match(bytes([b]))) for b in range(256)]


def regions(text: bytes, width: int):
    """Places of the words up to ``width`` words before and behind each anchor; what overlaps or touches is one region."""
    region: list[tuple[int, int]] = []
    for found in ANCHOR.finditer(text):
        begin, reach = found.start(), region[-1][1] if region else 0
        while begin > reach and _OF_WORDS[text[begin - 1]]:
            begin -= 1
        if begin >= reach:
            size = 16 * width
            while True:
                low = max(reach, begin - size)
                before = [m.span() for m in WORDS.finditer(text, low, begin)]
                if low > reach and before and before[0][0] == low and _OF_WORDS[text[low - 1]]:
                    del before[0]  # not whole
                if low == reach or len(before) >= width:
                    break
                size *= 4
            if region and (low > reach or len(before) > width):
                yield region
                region = []
            region += before[-width:] if width else []
            reach = begin
        for m in islice(WORDS.finditer(text, begin), width + 1):
            if m.start() >= reach:
                region.append(m.span())
    if region:
        yield region


def occurrences(template: np.ndarray, words: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(changes, first word, end) for each end of a part of the words that ``most`` changed words at most make the template.

    Words are inserted, deleted or replaced; of parts with equally few changes the shortest counts.
    """
    base = len(words) + 1  # a cell is changes * base - first word
    columns = np.arange(base)
    row, lift = -columns, columns * base
    for word in template:
        step = row + base
        step[1:] = np.minimum(step[1:], row[:-1] + base * (words != word))
        row = np.minimum.accumulate(step - lift) + lift
    changes = -(-row // base)
    ends = np.flatnonzero(changes <= most)
    return [(int(c), int(c * base - r), int(e)) for c, r, e in zip(changes[ends], row[ends], ends)]


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]]):
        import zstandard as z

        self.plain = z.ZstdCompressor(level=LEVEL)
        self.models, self.numbers = [], {}
        for name in sorted(templates):
            for wording in templates[name]:
                spelled = [w.lower() for w in WORDS.findall(wording.encode())]
                raw = z.ZstdCompressionDict(b" ".join(spelled), dict_type=z.DICT_TYPE_RAWCONTENT)
                raw.precompute_compress(level=LEVEL)
                with_it = z.ZstdCompressor(level=LEVEL, dict_data=raw)
                words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in spelled]
                self.models.append((name, with_it, np.array(words, dtype=np.int64), int(DIFFERENT * len(words))))
        self.widths: dict[int, list[int]] = {}  # templates by the most words that a statement of theirs has
        for i, (_, _, words, most) in enumerate(self.models):
            self.widths.setdefault(len(words) + most, []).append(i)
        self.width = max(self.widths, default=0)
        self.counts = np.array([np.bincount(words, minlength=len(self.numbers) + 1) for _, _, words, _ in self.models])
        self.least = np.array([len(words) - most for _, _, words, most in self.models], dtype=np.int64)
        self.seen: dict[tuple[int, bytes], list] = {}

    def saved(self, words: list[bytes], which) -> list[int]:
        """By how many bytes each of the templates shrinks the words: in lower case, a blank between them."""
        block = b" ".join(words)
        alone = len(self.plain.compress(block))
        return [alone - len(self.models[i][1].compress(block)) for i in which]

    def confirmed(self, words: list[bytes], width: int) -> list[tuple[int, int, int, int, int]]:
        """(bytes saved, changes, template, first word, end) of the parts of a block that are near a candidate of that width."""
        key = width, b" ".join(words)
        if key not in self.seen:
            if len(self.seen) > 100_000:
                self.seen.clear()
            which = self.widths[width]
            candidates = [i for i, gain in zip(which, self.saved(words, which)) if gain > 0]
            numbers = np.fromiter((self.numbers.get(w, 0) for w in words), dtype=np.int32, count=len(words))
            # each change takes one word of the template at most, so the others must be there
            there = np.minimum(np.bincount(numbers, minlength=len(self.numbers) + 1), self.counts)[:, 1:].sum(axis=1)
            found = []
            for i in candidates:
                if there[i] < self.least[i]:
                    continue
                taken = np.zeros(len(words), dtype=bool)
                for changes, first, end in sorted(occurrences(self.models[i][2], numbers, self.models[i][3]), key=lambda x: (x[0], x[2] - x[1], x[1])):
                    if not taken[first:end].any():
                        taken[first:end] = True
                        found.append((self.saved(words[first:end], (i,))[0], changes, i, first, end))
            self.seen[key] = found
        return self.seen[key]

    def find(self, text: bytes) -> list[tuple]:
        """(first byte of the block, license, words that differ, bytes saved, block) of each statement, in their order."""
        out = []
        for region in regions(text, self.width) if self.models else ():
            words, ranked = [text[a:b].lower() for a, b in region], set()
            for width in self.widths:
                step = max(1, width // 2)
                for low in range(0, max(1, len(words) - width), step):  # each statement is whole in a block
                    for gain, changes, i, first, end in self.confirmed(words[low : low + width + step], width):
                        ranked.add((-gain, changes, i, low + first, low + end))
            taken, hits = np.zeros(len(region), dtype=bool), []
            for less, changes, i, first, end in sorted(ranked):
                if not taken[first:end].any():
                    taken[first:end] = True
                    begin, stop = around(text, region[first][0], region[end - 1][1])
                    hits.append((first, (begin, self.models[i][0], changes, -less, text[begin:stop])))
            out += [hit for _, hit in sorted(hits)]
        return out


def around(text: bytes, first: int, end: int) -> tuple[int, int]:
    """Bounds of the lines of a statement; of long ones the parts around it."""
    begin, stop = text.rfind(b"\n", 0, first) + 1, text.find(b"\n", end)
    stop = len(text) if stop < 0 else stop
    return (begin, stop) if stop - begin <= LONGEST_LINE else (max(begin, first - AROUND), min(stop, end + AROUND))


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """doc_id, at_byte, license, n_changes, saved_bytes, block: one row for each statement in each row of ``docs``.

    ``docs``: doc_id, text; other columns are not read. Null and empty texts, and an empty table, give no rows; null ids
    stay null; repeated rows are scanned each. A statement is words within DIFFERENT of a template, on one line or over
    several, near an anchor, in a block that the template shrinks. Words that are near several templates count for the one
    that saves most bytes on them, then the one with fewest changes, then the first by name. ``block`` is the statement's
    lines, or what is around it. Whole texts of any length are searched; memory holds one slice of texts. Row-local: no shuffle.
    """
    given = TEMPLATES if templates is None else templates

    def run(batches):
        scanner = Scanner(given)
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                at, found = [], []
                for i, text in enumerate(texts):
                    for *hit, block in scanner.find(text or b""):
                        at.append(first + i)
                        found.append((*hit, block.decode("utf-8", "replace")))
                if found:
                    columns = list(zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at)), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.string())],
                        ["doc_id", "at_byte", "license", "n_changes", "saved_bytes", "block"],
                    )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, at_byte long, license string, n_changes long, saved_bytes long, block string")


@query("op9_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License statements of every whole document."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
