"""Token counts by a linear longest-match automaton over a word-piece vocabulary.

The automaton is a trie of the pieces with failure links. A node that cannot continue pops the longest piece at its
front; how many pieces a failure link pops is computed once, so a word's number of greedy longest-match pieces is found
in one pass over its characters, and no piece is ever built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query
from .words import distinct_words, split_words, text_slices

#: The tokenizer file whose pieces the query takes, and the mark that begins a word in it.
PIECES, WORD_MARK = "/opt/tokenizers/piece_bpe_32k.model", "▁"


class PieceCounter:
    """Number of greedy longest-match pieces of a word; -1 where no sequence of longest matches covers it.

    ``first`` pieces may begin a word, ``inner`` pieces continue it. An empty piece in ``first`` is the bare mark: one
    piece before inner pieces, where no longer one begins the word.
    """

    def __init__(self, first: Iterable[str], inner: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]  # node 0: begin of a word, node 1: inside a word
        first = set(first)
        ends = {self._add(0, piece) for piece in first if piece} | {self._add(1, piece) for piece in inner if piece}
        n = len(self.next)
        self.fail, self.pops = [-1] * n, [0] * n
        if "" in first:
            self.fail[0], self.pops[0] = 1, 1
        parents: deque[int] = deque((0, 1))
        while parents:
            at = parents.popleft()
            for char, to in self.next[at].items():
                parents.append(to)
                if to in ends:
                    self.fail[to], self.pops[to] = 1, 1
                    continue
                link, popped = self.fail[at], self.pops[at]
                while link >= 0 and char not in self.next[link]:
                    popped += self.pops[link]
                    link = self.fail[link]
                if link >= 0:
                    self.fail[to], self.pops[to] = self.next[link][char], popped

    def _add(self, at: int, piece: str) -> int:
        for char in piece:
            to = self.next[at].get(char)
            if to is None:
                to = self.next[at][char] = len(self.next)
                self.next.append({})
            at = to
        return at

    def count(self, word: str) -> int:
        at, total, steps, fail, pops = 0, 0, self.next, self.fail, self.pops
        for char in word:
            while char not in steps[at]:
                total += pops[at]
                at = fail[at]
                if at < 0:
                    return -1
            at = steps[at][char]
        while at != 1:
            if fail[at] < 0:
                return -1
            total += pops[at]
            at = fail[at]
        return total


def load_pieces(path: str) -> tuple[list[str], list[str]]:
    """Pieces that begin a word (without the mark; the bare mark is '') and pieces inside a word, of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [p[1:] for p in kept if p.startswith(WORD_MARK)], [p for p in kept if not p.startswith(WORD_MARK)]


def count_tokens(docs: DataFrame, first: list[str], inner: list[str], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, n_words, n_tokens, n_unknown (long) for every row of ``docs``; other columns are not read.

    A word that the pieces do not cover is one unknown token. A null or empty text has 0 words; a null id stays null;
    repeated rows are counted each; bytes that are not UTF-8 are replaced. The vocabulary travels as a broadcast of the
    size of the tokenizer file. Row-local: no shuffle.
    """
    pieces = docs.sparkSession.sparkContext.broadcast((first, inner))

    def run(batches):
        counter, known = PieceCounter(*pieces.value), {}
        for batch in batches:
            for at, texts in text_slices(batch.column(1)):
                words = split_words(texts)
                codes, distinct, _ = distinct_words(words)
                if len(known) > 300_000:
                    known.clear()
                counts = np.zeros(len(distinct), dtype=np.int64)
                for i, word in enumerate(distinct):
                    n = known.get(word)
                    if n is None:
                        n = known[word] = counter.count(word.decode("utf-8", "replace"))
                    counts[i] = n
                each = counts[codes] if len(codes) else np.zeros(0, dtype=np.int64)
                total = lambda x: pa.array(np.bincount(words.doc, weights=x, minlength=len(texts)).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), total(np.ones(len(each))), total(np.abs(each)), total(each < 0)],
                    ["id", "n_words", "n_tokens", "n_unknown"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_words long, n_tokens long, n_unknown long").withColumnRenamed("id", id_column)


@query("op3_token_counts")
def token_counts(spark: SparkSession, sf_dir: str, pieces: str = PIECES) -> DataFrame:
    """Words and word pieces of every whole document."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), *load_pieces(pieces))
