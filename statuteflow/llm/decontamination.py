"""Benchmark decontamination with the CGK embedding.

A window is read by a random walk: each step writes the word under a pointer, and a random bit of that word and step says
whether the pointer moves on. Two windows that differ by few edits fall into step again, so edit distance becomes Hamming
distance of what is written. Hash tables sample steps of the whole of several walks (bit sampling); their number follows
from the wanted recall, measured on made passages of each length. Windows of an item's size begin at every word of a text.
Two exact tests say which cannot be near an item and are not walked: of an item cut into one piece more than its allowed
edits, one piece must be there unchanged and at most that many words from its place; and what a window holds of the items'
words, weighed by rarity, must not be less than the edits leave. Candidates are verified by the exact edit distance of words.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query
from .words import STEP, mix, span_keys, split_words, text_slices

EDITS = 0.2  # edits of words that a hit may have, as a share of the item's words
LEAST_WORDS = 8  # shorter items are no evidence
RECALL, SAMPLED = 0.99, 3  # wanted recall of the measured passages; steps in a table
TABLES_PER_WALK = 3
CLASS = 1.1  # items share their sampled steps with items up to so many times as long
TRIALS = 300  # passages of each kind on which the number of walks is measured
ITEMS_AT_ONCE = 20_000  # items in one broadcast; more are taken in turns
PLACES_AT_ONCE = 20_000


def length_class(n: int) -> tuple[int, int]:
    """Shortest and longest length of the items that share sampled steps with items of n words."""
    low = LEAST_WORDS
    while int(low * CLASS) < n:
        low = int(low * CLASS) + 1
    return low, int(low * CLASS)


def sampled_steps(low: int, walks: int) -> np.ndarray:
    """Steps (walks x tables x SAMPLED) over the whole walk of ``low`` words, which ends after two steps a word, about."""
    rng = np.random.default_rng(11 + low)
    last = int(2 * low - math.sqrt(2 * low))
    return np.stack([[np.sort(rng.choice(last, SAMPLED, replace=False)) for _ in range(TABLES_PER_WALK)] for _ in range(walks)])


def table_keys(words: np.ndarray, begin: np.ndarray, end: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Keys (walks x tables x places) of the windows from begin; words from end on are no words."""
    walks, padded = len(steps), np.append(words, np.uint64(0))
    number = np.arange(walks)
    at, out = np.repeat(begin[None, :], walks, axis=0), np.zeros((walks, TABLES_PER_WALK, len(begin)), dtype=np.uint64)
    for step in range(int(steps.max()) + 1):
        word = np.where(at < end, padded[np.minimum(at, len(words))], np.uint64(0))
        for walk, table in zip(*np.nonzero((steps == step).any(axis=2))):
            out[walk, table] = mix(out[walk, table] ^ word[walk]) + np.uint64(1 + walk * TABLES_PER_WALK + table)
        stamp = (number.astype(np.uint64) * np.uint64(100_003) + np.uint64(step + 1)) * np.uint64(0x9E3779B97F4A7C15)
        at += (mix(word ^ stamp[:, None]) & np.uint64(1)).astype(np.int64)
    return out


def edited(rng: np.random.Generator, words: np.ndarray, edits: int, low: int, high: int) -> np.ndarray:
    """The words with ``edits`` words replaced, deleted or inserted at places from low to high."""
    own = words.tolist()
    for p in sorted(rng.choice(np.arange(low, high), min(edits, high - low), replace=False).tolist(), reverse=True):
        how = rng.integers(3)
        own[p : p + (how > 0)] = [] if how == 2 else rng.integers(1, 2**63, 1).tolist()
    return np.array(own, dtype=np.uint64)


@lru_cache(maxsize=None)
def walk_count(low: int, high: int, recall: float = RECALL) -> int:
    """Walks that find at least ``recall`` of passages with all allowed edits, be they all over, in the first or second half."""
    rng, walks = np.random.default_rng(7), 16
    pairs = []
    for n in sorted({low, high}):
        for first, last in ((1, n), (1, (n + 1) // 2), (n // 2, n)):
            for _ in range(TRIALS):
                item, behind = (rng.integers(1, 2**63, k).astype(np.uint64) for k in (n, 2 * n))
                pairs.append((item, np.concatenate([edited(rng, item, int(EDITS * n), first, last), behind])))

    def keys(side, steps):
        ends = np.cumsum([len(p[side]) for p in pairs])
        return table_keys(np.concatenate([p[side] for p in pairs]), np.append(0, ends[:-1]), ends, steps)

    while True:
        steps = sampled_steps(low, walks)
        met = np.logical_or.accumulate((keys(0, steps) == keys(1, steps)).any(axis=1), axis=0)
        worst = met.reshape(walks, -1, TRIALS).mean(axis=2).min(axis=1)
        if worst[-1] >= recall:
            return 1 + int(np.argmax(worst >= recall))
        walks *= 2


class Items:
    """The items of a benchmark and their hash tables. walks: of each class of lengths, measured here if not given."""

    def __init__(self, texts: list[bytes], walks: dict[tuple[int, int], int] | None = None):
        words = split_words(texts, lower=True)
        cuts = np.searchsorted(words.doc, np.arange(len(texts) + 1))
        self.words = [words.key[cuts[i] : cuts[i + 1]] for i in range(len(texts))]
        self.usable = [i for i, w in enumerate(self.words) if len(w) >= LEAST_WORDS]
        self.vocabulary = np.unique(np.concatenate([self.words[i] for i in self.usable])) if self.usable else np.zeros(0, dtype=np.uint64)
        times = np.unique(np.concatenate([self.words[i] for i in self.usable]), return_counts=True)[1] if self.usable else np.zeros(0, dtype=np.int64)
        self.weights = 1 + np.round(16 * np.log2(times.sum() / times)).astype(np.int64) if self.usable else times
        classes: dict[tuple[int, int], list[int]] = {}
        for i in self.usable:
            classes.setdefault(length_class(len(self.words[i])), []).append(i)
        self.walks = {c: walk_count(*c) for c in classes} if walks is None else walks
        self.classes = []
        for low, high in sorted(classes):
            own = classes[low, high]
            steps = sampled_steps(low, self.walks[low, high])
            flat = np.concatenate([self.words[i] for i in own])
            begin = np.cumsum([0] + [len(self.words[i]) for i in own])
            keys = table_keys(flat, begin[:-1], begin[1:], steps).reshape(-1, len(own))
            order = np.argsort(keys.reshape(-1), kind="stable")
            self.classes.append((steps, keys.reshape(-1)[order], np.tile(np.array(own), len(keys))[order], self._least(own)))
        self.pieces = self._pieces([classes[c] for c in sorted(classes)])

    def _pieces(self, classes: list[list[int]]) -> dict[int, tuple[np.ndarray, ...]]:
        """By length in words: sorted keys of pieces, their class, and how far before the piece a passage begins."""
        found: dict[int, set] = {}
        for number, own in enumerate(classes):
            for i in own:
                n = len(self.words[i])
                edits = int(EDITS * n)
                cuts = n * np.arange(edits + 2) // (edits + 1)
                for key, a, b in zip(span_keys(self.words[i], cuts[:-1], cuts[1:], STEP).tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                    found.setdefault(b - a, set()).add((key, number, max(0, a - edits), a + edits))
        return {length: tuple(np.array(x, dtype=kind) for x, kind in zip(zip(*sorted(rows)), (np.uint64, np.int64, np.int64, np.int64))) for length, rows in found.items()}

    def _near_pieces(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Classes x places: where a passage near an item of the class may begin, by the pieces that are there unchanged."""
        n = len(words)
        change = np.zeros((len(self.classes), n + 1), dtype=np.int32)
        for length, (keys, number, nearest, farthest) in self.pieces.items():
            at = np.arange(max(0, n - length + 1))
            at = at[at + length <= ends[at]]
            own = span_keys(words, at, at + length, STEP)
            spot = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = np.flatnonzero(keys[spot] == own)
            low, high = spot[hit], np.searchsorted(keys, own[hit], "right")
            for first in range(0, len(hit), PLACES_AT_ONCE):
                some = slice(first, first + PLACES_AT_ONCE)
                many = high[some] - low[some]
                for turn in range(int(many.max())):
                    here = many > turn
                    piece, place = low[some][here] + turn, at[hit[some][here]]
                    np.add.at(change, (number[piece], np.maximum(0, place - farthest[piece])), 1)
                    np.add.at(change, (number[piece], np.maximum(0, place - nearest[piece]) + 1), -1)
        return np.cumsum(change[:, :-1], axis=1, dtype=np.int32) > 0

    def _least(self, items: list[int]) -> list[tuple[int, int]]:
        """Bounds (words of a passage, weight) of which each passage near one of the items meets one at least.

        An edit takes one word of the item at most, and each word by which the passage is longer is an edit that takes
        none; what is left weighs no less than the item without its heaviest words.
        """
        out: dict[int, int] = {}
        for i in items:
            weights = np.sort(self.weights[np.searchsorted(self.vocabulary, self.words[i])])
            edits = int(EDITS * len(weights))
            for longer, shorter in ((0, 0), (edits // 2, 1), (edits, edits // 2 + 1)):  # passages longer by shorter..longer
                taken = max(0, edits - shorter)
                width, least = len(weights) + longer, int(weights[: len(weights) - taken].sum())
                out[width] = min(out.get(width, least), least)
        return sorted(out.items())

    def candidates(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, item) of windows that share a key with an item. ends: of each word's text."""
        if not self.usable or not len(words):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        spot = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        known = self.vocabulary[spot] == words
        sums = np.concatenate([[0], np.cumsum(np.where(known, self.weights[spot], 0))])
        possible = self._near_pieces(words, ends)
        found = []
        for own_places, (steps, table, items, bounds) in zip(possible, self.classes):
            at = np.flatnonzero(own_places & known)
            wanted = np.zeros(len(at), dtype=bool)
            for width, least in bounds:
                wanted |= sums[np.minimum(at + width, ends[at])] - sums[at] >= least
            chosen = at[wanted]
            for first in range(0, len(chosen), PLACES_AT_ONCE):
                places = chosen[first : first + PLACES_AT_ONCE]
                own = table_keys(words, places, ends[places], steps).reshape(-1, len(places))
                low, high = np.searchsorted(table, own, "left"), np.searchsorted(table, own, "right")
                row, col = np.nonzero(high > low)
                for r, c in zip(row.tolist(), col.tolist()):
                    found.extend((places[c], item) for item in set(items[low[r, c] : high[r, c]].tolist()))
        pairs = np.array(sorted(set(found)), dtype=np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]

    def verified(self, words: np.ndarray, ends: np.ndarray, places: np.ndarray, items: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(place, item, edits, words) of the candidates within EDITS: the best window that begins at the place."""
        out = []
        for item in np.unique(items).tolist():
            own, mine = self.words[item], places[items == item]
            most = int(EDITS * len(own))
            width = len(own) + most
            spots = mine[:, None] + np.arange(width)
            window = np.where(spots < ends[mine][:, None], np.append(words, np.uint64(0))[np.minimum(spots, len(words))], np.uint64(0))
            room = np.minimum(ends[mine] - mine, width)
            columns = np.arange(width + 1)
            row = np.broadcast_to(columns, (len(mine), width + 1)).copy()
            for i, word in enumerate(own, 1):
                next_row = np.empty_like(row)
                next_row[:, 0] = i
                next_row[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (window != word))
                row = np.minimum.accumulate(next_row - columns, axis=1) + columns
            row = np.where(columns <= room[:, None], row, len(own) + width)
            best = row.argmin(axis=1)
            edits = row[np.arange(len(mine)), best]
            out += [(int(p), item, int(e), int(n)) for p, e, n in zip(mine, edits, best) if e <= most]
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, first_word, n_words: the best hit of each item in each row of ``docs``.

    ``docs``: doc_id, text; ``benchmark``: item_id, text; other columns are not read. Words are compared with A-Z in
    lower case. Null and empty texts have no hits; items that are null or shorter than LEAST_WORDS words hit nothing;
    null ids stay null; repeated rows and items are judged each; of hits with equally few edits the first counts. Empty
    tables give an empty result. The items travel by broadcast, ITEMS_AT_ONCE at a time; the search is row-local.
    """
    spark = docs.sparkSession
    given = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    blocks = 1 + given.count() // ITEMS_AT_ONCE
    found = None
    for block in range(blocks):
        own = given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").toArrow()
        lengths = np.unique(np.bincount(split_words([t.encode() for t in own.column("text").to_pylist()]).doc))
        walks = {c: walk_count(*c) for c in sorted({length_class(n) for n in lengths.tolist() if n >= LEAST_WORDS})}
        part = rows.mapInArrow(_search(spark.sparkContext.broadcast((own, walks)), own.schema.field("item_id").type), f"doc_id {kinds[0]}, item_id {kinds[1]}, edits long, first_word long, n_words long")
        found = part if found is None else found.union(part)
    return found


def _search(sent, id_type):
    def run(batches):
        given, walks = sent.value
        ids = given.column("item_id").combine_chunks()
        items = Items([t.encode() for t in given.column("text").to_pylist()], walks)
        for batch in batches:
            for at, texts in text_slices(batch.column(1)):
                words = split_words(texts, lower=True)
                cuts = np.searchsorted(words.doc, np.arange(len(texts) + 1))
                ends = cuts[words.doc + 1] if len(words.doc) else words.doc
                best: dict[tuple[int, int], tuple] = {}
                for place, item, edits, n in items.verified(words.key, ends, *items.candidates(words.key, ends)):
                    doc = int(words.doc[place])
                    hit = (edits, place - int(cuts[doc]), n)
                    if (doc, item) not in best or hit < best[doc, item]:
                        best[doc, item] = hit
                if best:
                    docs, hits = zip(*best)
                    columns = list(zip(*best.values()))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([at + d for d in docs])), ids.take(pa.array(hits)), *(pa.array(c, pa.int64()) for c in columns)],
                        ["doc_id", "item_id", "edits", "first_word", "n_words"],
                    )

    return run


@query("op2_decontaminate")
def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the benchmark in every whole document."""
    return contaminated(*(spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark")))
