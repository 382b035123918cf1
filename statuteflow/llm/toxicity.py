"""Toxicity of texts that may be disguised.

Reading is a noisy channel: a writer may have swapped letters for look-alike signs, repeated letters or spaced them out.
Every word that such a change may have touched becomes a lattice of possible letters, and a Viterbi search under a
character model of the corpus picks the likeliest reading. The restored words, and their beginnings (toxic stems take many
endings), are then weighed by how much more often they occur in documents labelled toxic.
"""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query
from .words import Words, distinct_words, mix, span_keys, split_words, text_slices

# Letters that a sign may stand for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c",
}
SWAP, DROP, ONE_OF_RUN = 2.0, 1.0, 0.5  # costs (natural logarithms) of a swapped sign, a dropped sign, a shortened run
SYMBOLS = 28  # a-z, the edge of a word, anything else
EDGE, OTHER = 26, 27
STEMS = (4, 5, 6)  # lengths of word beginnings that are features beside whole words
#: At most about so many labelled documents teach the weights; at most so many features are kept.
FIT_DOCUMENTS, FEATURES = 200_000, 50_000
SEEN_LEAST, WEIGHT_LEAST = 5, 2.5  # toxic documents with a feature; its smallest weight
CONFIDENCE = 1.64  # standard deviations
KNOWN_WORDS, SLICE = 150_000, 1 << 20  # readings that a task remembers; bytes of texts that it reads at once
_EDGES = re.compile(r"^[^\w@$€£|+(!]+|[^\w@$€£|+]+$")
_RUNS = re.compile(r"(.)\1{2,}")
_SIGNS = re.compile(f"[{re.escape(''.join(LOOK_ALIKES))}]")
_GAPS = re.compile(r"[^\w@$€£|+(!]|_")


def symbol(char: str) -> int:
    base = unicodedata.normalize("NFD", char)[0]
    return ord(base) - 97 if "a" <= base <= "z" else OTHER


class Restorer:
    """Reads words under a character model: costs[a, b, c] of symbol c after a and b."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()

    def lattice(self, word: str) -> list[list[tuple[str, float]]] | None:
        """For each place the possible readings and their costs; None if there is one reading only."""
        letters = sum(c.isalpha() for c in word)
        mixed = letters > 0 and any(c in LOOK_ALIKES for c in word)
        places, open_choice, i = [], False, 0
        while i < len(word):
            char, run = word[i], 1
            while i + run < len(word) and word[i + run] == char:
                run += 1
            i += run
            choices = [(char, 0.0)]
            if mixed and char in LOOK_ALIKES:
                choices = [(letter, SWAP) for letter in LOOK_ALIKES[char]] + [(char, SWAP)]
                choices += [] if char.isdigit() else [("", DROP)]
            if run >= 3:
                choices = [(c * k, cost + ONE_OF_RUN) for c, cost in choices for k in ((1, 2) if c else (1,))]
                places.append(choices)
            else:
                places += [choices] * run
            open_choice |= len(choices) > 1
        return places if open_choice else None

    def read(self, word: str) -> str:
        """The likeliest reading of a lower-case word."""
        if not _RUNS.search(word) and not (_SIGNS.search(word) and any(map(str.isalpha, word))):
            return word  # no place has a choice
        places = self.lattice(word)
        if places is None:
            return word
        best = {(EDGE, EDGE): (0.0, None)}  # last two symbols -> cost, chain of readings
        for choices in places:
            step: dict = {}
            for (a, b), (cost, chain) in best.items():
                for text, extra in choices:
                    x, y, total = a, b, cost + extra
                    for char in text:
                        s = symbol(char)
                        total += self.costs[x][y][s]
                        x, y = y, s
                    if (x, y) not in step or total < step[x, y][0]:
                        step[x, y] = (total, (text, chain))
            best = step
        _, chain = min((cost + self.costs[a][b][EDGE], chain) for (a, b), (cost, chain) in best.items())
        parts = []
        while chain is not None:
            parts.append(chain[0])
            chain = chain[1]
        return "".join(reversed(parts))

    def restore(self, word: bytes) -> str:
        text = word.decode("utf-8", "replace").lower()
        if text.isalpha() and not _RUNS.search(text):
            return text
        bare = _EDGES.sub("", text)
        if _GAPS.search(bare):
            pieces = _GAPS.split(bare)
            if len(pieces) >= 3 and all(len(p) <= 1 for p in pieces):
                bare = "".join(pieces)  # a.b.c
        return self.read(bare)


def joined_letters(words: Words) -> Words:
    """Words in which three or more neighbouring one-letter words of a text are one word, without the gaps."""
    single = words.end - words.start == 1
    if not single.any():
        return words
    linked = np.zeros(len(single), dtype=bool)  # word i continues the run of word i-1
    linked[1:] = single[1:] & single[:-1] & (words.doc[1:] == words.doc[:-1])
    head = np.flatnonzero(~linked)
    length = np.diff(np.append(head, len(single)))
    runs = np.flatnonzero(length >= 3)
    if not len(runs):
        return words
    raw, extra, spans, at = words.data, [], [], len(words.data)
    for first, n in zip(head[runs].tolist(), length[runs].tolist()):
        extra.append(raw[words.start[first : first + n]])
        spans.append((at, at + n))
        at += n
    keep = ~np.isin(np.arange(len(single)), np.concatenate([np.arange(f, f + n) for f, n in zip(head[runs], length[runs])]))
    data = np.concatenate([raw, *extra])
    start, end = (np.concatenate([old[keep], np.array([s[k] for s in spans])]) for k, old in ((0, words.start), (1, words.end)))
    doc = np.concatenate([words.doc[keep], words.doc[head[runs]]])
    key = np.concatenate([words.key[keep], span_keys(data, start[keep.sum():], end[keep.sum():])])
    return Words(data, start, end, doc, key)


def feature_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, key) of each word's features: itself and its beginnings."""
    raw = [word.encode("utf-8", "replace") for word in words]
    data = np.frombuffer(b"\x00".join([*raw, b""]), dtype=np.uint8)
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    end = np.cumsum(sizes + 1)  # with the zero that ends a whole word
    start = end - sizes - 1
    letters = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of characters
    first = np.searchsorted(letters, start)
    length = np.searchsorted(letters, end - 1) - first
    some = np.flatnonzero(sizes)
    owners, ends = [some], [end[some]]
    for n in STEMS:
        some = np.flatnonzero(length > n)
        owners.append(some)
        ends.append(letters[first[some] + n])
    owner = np.concatenate(owners)
    return owner, span_keys(data, start[owner], np.concatenate(ends))


def sign_weights(words: list[str], keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each word the largest weight of its features, 0 without one; ``keys`` are sorted."""
    each = np.zeros(len(words))
    owner, mine = feature_keys(words)
    if len(keys) and len(mine):
        place = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
        np.maximum.at(each, owner, np.where(keys[place] == mine, weights[place], 0.0))
    return each


def character_costs(docs: DataFrame) -> np.ndarray:
    """Costs of symbols after two others, from the purely alphabetic words of all texts; 28 * 28 * 28 numbers."""

    def run(batches):
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in batches:
            for _, texts in text_slices(batch.column(0), SLICE):
                _, distinct, times = distinct_words(split_words(texts))
                kept = [(w, n) for w, n in zip((w.decode("utf-8", "replace").lower().strip(".,;:") for w in distinct), times.tolist()) if w.isalpha()]
                known = {c: symbol(c) for c in set("".join(w for w, _ in kept))}
                marks = np.fromiter((s for w, _ in kept for s in (EDGE, EDGE, *map(known.__getitem__, w), EDGE)), dtype=np.int64)
                weight = np.repeat([n for _, n in kept], [len(w) + 3 for w, _ in kept])
                if len(marks):
                    code = (marks[:-2] * SYMBOLS + marks[1:-1]) * SYMBOLS + marks[2:]
                    # a word begins with two edges; what reaches over its end is no prediction
                    inside = ~((marks[1:-1] == EDGE) & (marks[2:] == EDGE) | (marks[:-2] != EDGE) & (marks[1:-1] == EDGE))
                    total += np.bincount(code[inside], weights=weight[2:][inside], minlength=SYMBOLS**3).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["code", "c"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "code long, c long").groupBy("code").agg(F.sum("c").alias("c")).collect()
    counts = np.full((SYMBOLS, SYMBOLS, SYMBOLS), 0.1)
    for code, c in rows:
        counts[code // SYMBOLS**2, code // SYMBOLS % SYMBOLS, code % SYMBOLS] += c
    return -np.log(counts / counts.sum(axis=2, keepdims=True))


def _restored(texts: list[bytes], restorer: Restorer, known: dict[bytes, str]) -> tuple[Words, np.ndarray, list[str]]:
    words = joined_letters(split_words(texts))
    codes, distinct, _ = distinct_words(words)
    if len(known) > KNOWN_WORDS:
        known.clear()
    return words, codes, [known[w] if w in known else known.setdefault(w, restorer.restore(w)) for w in distinct]


def restore_texts(docs: DataFrame, costs: np.ndarray) -> DataFrame:
    """doc_id, restored: the words of every text as they are read, joined by spaces; null stays null.

    Words of joined single letters come after the others of their text.
    """
    model = docs.sparkSession.sparkContext.broadcast(costs)

    def run(batches):
        restorer, known = Restorer(model.value), {}
        for batch in batches:
            for at, texts in text_slices(batch.column(1), SLICE):
                words, codes, read = _restored(texts, restorer, known)
                out: list[list[str]] = [[] for _ in texts]
                for doc, code in zip(words.doc.tolist(), codes.tolist()):
                    out[doc].append(read[code])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([None if t is None else " ".join(o) for t, o in zip(texts, out)], pa.string())], ["doc_id", "restored"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, restored string")


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCUMENTS) -> DataFrame:
    """text, toxic (0 or 1) of at most about ``most`` labelled rows; of equal texts one, toxic if any is labelled so."""
    clear = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, most / max(1, clear.count()))
    chosen = clear.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    one = texts.select("doc_id", F.xxhash64("text").alias("h")).join(F.broadcast(chosen), "doc_id")  # bounded by ``most``
    one = one.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    return texts.join(F.broadcast(one), "doc_id").select("text", "toxic")


def feature_weights(sample: DataFrame, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(sorted feature keys, their weights, prior log-odds); features by document counts in both classes.

    A feature also needs SEEN_LEAST different words before it in toxic documents (counted in 64 bits, so at least), else
    the words of one passage that toxic documents copy from each other would pass for signs.
    """
    model = sample.sparkSession.sparkContext.broadcast(costs)

    def run(batches):
        restorer, known = Restorer(model.value), {}
        for batch in batches:
            toxic_of = batch.column(1).to_numpy(zero_copy_only=False)
            for at, texts in text_slices(batch.column(0), SLICE):
                words, codes, read = _restored(texts, restorer, known)
                owner, keys = feature_keys(read)
                unique, number = np.unique(keys, return_inverse=True)
                by_word = np.argsort(owner, kind="stable")
                first = np.searchsorted(owner[by_word], np.arange(len(read) + 1))
                pairs = np.unique(words.doc.astype(np.int64) * max(1, len(read)) + codes)
                doc, word = pairs // max(1, len(read)), pairs % max(1, len(read))
                many = (first[1:] - first[:-1])[word]
                place = np.repeat(first[:-1][word] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(word) else np.zeros(0, dtype=np.int64)
                seen = np.unique(np.repeat(doc, many) * max(1, len(unique)) + number[by_word][place])
                toxic = toxic_of[at : at + len(texts)][seen // max(1, len(unique))] > 0
                counts = [np.bincount(seen[some] % max(1, len(unique)), minlength=len(unique)) for some in (toxic, ~toxic)]
                before = np.zeros(len(codes), dtype=np.uint64)
                before[1:] = np.where(words.doc[1:] == words.doc[:-1], words.key[:-1], 0)
                bits = np.zeros(len(read), dtype=np.int64)
                told = toxic_of[at : at + len(texts)][words.doc] > 0 if len(codes) else np.zeros(0, dtype=bool)
                np.bitwise_or.at(bits, codes[told], np.int64(1) << (mix(before[told]) & np.uint64(63)).astype(np.int64))
                contexts = np.zeros(len(unique), dtype=np.int64)
                np.bitwise_or.at(contexts, number, bits[owner])
                yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), *map(pa.array, counts), pa.array(contexts)], ["feature", "t", "c", "contexts"])

    classes = {bool(r[0]): r[1] for r in sample.groupBy((F.col("toxic") > 0).alias("y")).count().collect()}
    toxic, clean = classes.get(True, 0), classes.get(False, 0)
    counted = sample.select("text", "toxic").mapInArrow(run, "feature long, t long, c long, contexts long")
    counted = counted.groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.bit_count(F.bit_or("contexts")).alias("contexts"))
    weight = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    weight -= CONFIDENCE * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))  # the lower end of its interval
    kept = counted.where((F.col("t") >= SEEN_LEAST) & (F.col("contexts") >= SEEN_LEAST)).withColumn("w", weight).where(F.col("w") >= WEIGHT_LEAST)
    rows = kept.orderBy((F.col("w") * F.col("t")).desc(), "feature").limit(FEATURES).select("feature", "w").toPandas()
    keys = rows["feature"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows["w"].to_numpy(dtype=np.float64)[order], math.log((toxic + 1) / (clean + 1))


def score_toxicity(docs: DataFrame, labelled: DataFrame, labels: DataFrame, most: int = FIT_DOCUMENTS) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= 0.5), n_signs (distinct words that speak for toxic) of every row.

    ``docs``: doc_id, text to score; ``labelled``: doc_id, text to learn from, with ``labels``: doc_id, toxic. Other
    columns are not read. Null and empty texts have the score of a text without signs; null ids and repeated rows are
    rows like others; labels that contradict each other count as toxic; null labels are left out. Without any label the
    score is 1/2 less a little. The models are bounded (28**3 costs, FEATURES weights) and broadcast; scoring is
    row-local.
    """
    costs = character_costs(docs)
    sample = labelled_sample(labelled, labels, most)
    keys, weights, prior = feature_weights(sample, costs)
    model = docs.sparkSession.sparkContext.broadcast((costs, keys, weights, min(prior, -0.01)))

    def run(batches):
        costs, keys, weights, prior = model.value
        restorer, known = Restorer(costs), {}  # what a word weighs, once it was read
        for batch in batches:
            for at, texts in text_slices(batch.column(1), SLICE):
                words = joined_letters(split_words(texts))
                codes, distinct, _ = distinct_words(words)
                if len(known) > KNOWN_WORDS:
                    known.clear()
                new = [w for w in distinct if w not in known]
                known.update(zip(new, sign_weights([restorer.restore(w) for w in new], keys, weights).tolist()))
                each = np.fromiter(map(known.__getitem__, distinct), dtype=np.float64, count=len(distinct))
                signs = each[codes] > 0 if len(codes) else np.zeros(0, dtype=bool)
                pairs = np.unique(words.doc[signs].astype(np.int64) * max(1, len(distinct)) + codes[signs])
                doc, word = pairs // max(1, len(distinct)), pairs % max(1, len(distinct))
                odds = prior + np.bincount(doc, weights=each[word], minlength=len(texts))
                score = 1 / (1 + np.exp(-np.minimum(odds, 40)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(np.bincount(doc, minlength=len(texts)).astype(np.int64))], ["doc_id", "score", "predicted", "n_signs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int, n_signs long")


@query("op5_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every whole document, learned from the labels of four folds of five."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    scored = score_toxicity(docs, docs.where(fold != 0), labels)
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted", "n_signs")
