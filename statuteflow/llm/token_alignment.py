"""Alignment of two tokenizers of the same text by lockstep merging.

Both token sequences of a text cover the same bytes, so aligning them is a merge of two ascending lists of byte ends. All
documents of a batch merge at once: one numpy vector holds a pointer into A and one into B for each of them, each step
links the tokens under the pointers, moves the pointer whose token ends first, or both at a cut, and drops what is done.
Long documents enter as several lanes, divided where tokens of both end.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage_table
from .registry import query

#: Tokenizer files of the query.
BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
CHUNK_BYTES, WINDOW_BYTES = 4 << 20, 1 << 20  # of texts whose pairs are counted together; of texts that merge at once
LANE = 256  # tokens of A after which a lane may end


#: Fixed value: how byte-level BPE of this family cuts a text before it merges.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoders:
    """Both tokenizers, and the bytes of each token.

    ``byte_bpe`` is a tokenizers file; its vocabulary and merges are run by tiktoken, whose ranks are ids, so the ids of the
    file must follow the order of its merges.
    """

    def __init__(self, byte_bpe: str, piece_bpe: str):
        import sentencepiece
        import tiktoken

        with open(byte_bpe, encoding="utf-8") as file:
            known = json.load(file)
        vocabulary, special = known["model"]["vocab"], {t["id"] for t in known["added_tokens"]}
        made = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in known["model"]["merges"]]
        if made != sorted(made):
            raise ValueError(f"the ids of {byte_bpe} do not follow its merges")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level BPE writes as themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if i not in special}
        self.a = tiktoken.Encoding("byte-level", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        self.bytes_a = [b""] * (1 + max(ranks.values()))
        for token, i in ranks.items():
            self.bytes_a[i] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.tables = [(np.frombuffer(b"".join(t), dtype=np.uint8), np.cumsum([0, *map(len, t)])) for t in (self.bytes_a, self.bytes_b)]

    def tokens(self, texts: list[bytes]):
        """For both sides (ids, bounds of the texts in them, byte ends), and which texts both cover; the others have none."""
        plain = [t.decode("utf-8", "replace") for t in texts]
        sides = [[self.a.encode_to_numpy(" " + t).astype(np.int32) for t in plain], [np.array(ids, dtype=np.int32) for ids in self.b.encode(plain, num_threads=1)]]
        raw = np.frombuffer(b"".join(b" " + t for t in texts), dtype=np.uint8)
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        covered = np.ones(len(texts), dtype=bool)
        for ids, (data, at) in zip(sides, self.tables):
            flat, doc = np.concatenate(ids), np.repeat(np.arange(len(ids)), [len(x) for x in ids])
            sizes = at[flat + 1] - at[flat]
            covered &= np.bincount(doc, weights=sizes, minlength=len(ids)) == np.diff(begin)
            kept = covered[doc]
            flat, sizes = flat[kept], sizes[kept]
            own = data[np.repeat(at[flat] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]  # bytes of the tokens
            of = np.repeat(np.arange(len(texts)), np.diff(begin))
            differ = own != raw[covered[of]]
            covered[of[covered[of]][differ]] = False
        found = []
        for ids, (_, at) in zip(sides, self.tables):
            own = [x if c else x[:0] for x, c in zip(ids, covered.tolist())]
            flat = np.concatenate(own)
            found.append((flat, np.cumsum([0, *map(len, own)]), np.cumsum(at[flat + 1] - at[flat])))
        return *found, covered


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of its distinct key for each, first place of each distinct key)."""
    import pandas as pd

    codes, unique = pd.factorize(keys)
    first = np.zeros(len(unique), dtype=np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, first


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct values in their order, how often each is there)."""
    values = np.sort(values)
    first = np.flatnonzero(np.diff(values, prepend=values[0] - 1)) if len(values) else np.zeros(0, dtype=np.int64)
    return values[first], np.diff(first, append=len(values))


def lanes(end_a: np.ndarray, end_b: np.ndarray, bounds_a: np.ndarray) -> np.ndarray:
    """Tokens of A with which lanes begin: the first of each document, and others behind a common end every LANE tokens or so."""
    starts = [bounds_a[:-1][np.diff(bounds_a) > 0]]
    doc = np.searchsorted(bounds_a, np.arange(LANE - 1, len(end_a), LANE), side="right") - 1
    at, last = np.arange(LANE - 1, len(end_a), LANE), bounds_a[doc + 1] - 1
    last = np.minimum(last, at + LANE - 1)
    while len(at):
        inside = at < last
        at, last = at[inside], last[inside]
        common = end_b[np.searchsorted(end_b, end_a[at])] == end_a[at]
        starts.append(at[common] + 1)
        at, last = at[~common] + 1, last[~common]
    return np.sort(np.concatenate(starts))


def lockstep(end_a: np.ndarray, end_b: np.ndarray, bounds_a: np.ndarray, bounds_b: np.ndarray):
    """(tokens of A and of B of each link by document and place, flags of the tokens of A and of B that end a group)."""
    cut_a, cut_b = np.zeros(len(end_a), dtype=bool), np.zeros(len(end_b), dtype=bool)
    i = lanes(end_a, end_b, bounds_a)
    if not len(i):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), cut_a, cut_b
    stop = np.append(i[1:], len(end_a))
    j = np.searchsorted(end_b, np.where(i > 0, end_a[i - 1], 0), side="right")
    slot = i + j  # a lane has fewer links than tokens, so its links have their places
    link_a, link_b = np.full(len(end_a) + len(end_b), -1), np.full(len(end_a) + len(end_b), -1)
    while len(i):
        link_a[slot], link_b[slot] = i, j
        a, b = end_a[i], end_b[j]
        both = a == b
        cut_a[i[both]] = cut_b[j[both]] = True
        i, j, slot = i + (a <= b), j + (b <= a), slot + 1
        if both.any():  # a lane ends at a cut
            live = i < stop
            i, j, slot, stop = i[live], j[live], slot[live], stop[live]
    linked = link_a >= 0
    return link_a[linked], link_b[linked], cut_a, cut_b


def written(ids_a, ids_b, cut_a, cut_b, bounds_a, bounds_b) -> tuple[bytes, np.ndarray]:
    """Groups of all documents as text, ids in decimal, and the bounds of the documents in it; each ends with a ';'."""
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    n_a, n_b = np.bincount(group_a, minlength=1), np.bincount(group_b, minlength=1)
    place_a = np.arange(len(ids_a)) + (np.cumsum(n_b) - n_b)[group_a]
    place_b = np.arange(len(ids_b)) + np.cumsum(n_a)[group_b]
    ids, sign = np.empty(len(ids_a) + len(ids_b), dtype=np.int64), np.empty(len(ids_a) + len(ids_b), dtype=np.uint8)
    ids[place_a], ids[place_b] = ids_a, ids_b
    sign[place_a], sign[place_b] = np.where(cut_a, ord("|"), ord(",")), np.where(cut_b, ord(";"), ord(","))
    most = len(str(int(ids.max()))) if len(ids) else 1
    digits, used = np.empty((len(ids), most + 1), dtype=np.uint8), np.ones((len(ids), most + 1), dtype=bool)
    digits[:, most] = sign
    for k in range(most):
        power = 10 ** (most - 1 - k)
        digits[:, k] = 48 + ids // power % 10
        used[:, k] = (ids >= power) | (power == 1)
    ends = np.concatenate([[0], np.cumsum(used.sum(axis=1))])
    return digits[used].tobytes(), ends[bounds_a + bounds_b]


def pieces(row: int, text: bytes):
    """(row, part of the text) for parts of about WINDOW_BYTES, less the space that begins each, so that none needs more.

    A part ends before a space that follows a visible sign of ASCII. Neither tokenizer has a token over such a border:
    pretokens of A take a space only at their front, pieces of B have their mark only in front. The last space of a text
    begins no part, as B adds no mark to nothing.
    """
    at = 0
    while len(text) - at > WINDOW_BYTES:
        cut = text.find(b" ", at + WINDOW_BYTES)
        while cut > 0 and not 32 < text[cut - 1] < 127:
            cut = text.find(b" ", cut + 1)
        if cut < 0 or cut + 1 == len(text):
            break
        yield row, text[at:cut]
        at = cut + 1
    yield row, text[at:]


def windows(texts: list[bytes]):
    window, size = [], 0
    for row, text in enumerate(texts):
        for piece in pieces(row, text) if text else ():
            if window and size + len(piece[1]) > WINDOW_BYTES:
                yield window
                window, size = [], 0
            window.append(piece)
            size += len(piece[1])
    if window:
        yield window


class Aligned:
    """Counts, hash of the groups and links of each text of a chunk."""

    def __init__(self, encoders: Encoders, texts: list[bytes]):
        n, width = len(texts), len(encoders.bytes_b)
        self.counts = np.zeros((4, n), dtype=np.int64)  # n_a, n_b, n_groups, n_links
        hashes, fails = [hashlib.sha256() for _ in texts], np.zeros(n, dtype=bool)
        begun = np.zeros(n, dtype=bool)
        rows, keys = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for window in windows(texts):
            row = np.array([r for r, _ in window])
            (ids_a, bounds_a, end_a), (ids_b, bounds_b, end_b), covered = encoders.tokens([t for _, t in window])
            fails[row[~covered]] = True
            link_a, link_b, cut_a, cut_b = lockstep(end_a, end_b, bounds_a, bounds_b)
            text, ends = written(ids_a, ids_b, cut_a, cut_b, bounds_a, bounds_b)
            owner = np.searchsorted(bounds_a, link_a, side="right") - 1
            within = np.concatenate([[0], np.cumsum(cut_a)])[bounds_a]
            for counts, own in zip(self.counts, (np.diff(bounds_a), np.diff(bounds_b), np.diff(within), np.bincount(owner, minlength=len(row)))):
                np.add.at(counts, row, own)
            for r, low, high in zip(row.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
                if high > low:
                    hashes[r].update((b";" if begun[r] else b"") + text[low : high - 1])
                    begun[r] = True
            pair, first = distinct(ids_a[link_a].astype(np.int64) * width + ids_b[link_b])
            names = (ids_a[link_a[first]].astype(np.int64) * width) + ids_b[link_b[first]]
            both, times = counted(row[owner] * max(len(names), 1) + pair)
            rows.append(np.stack([both // max(len(names), 1), times]).T.reshape(-1, 2))
            keys.append(names[both % max(len(names), 1)])
        self.counts[:, fails] = 0
        self.hashes = [h.hexdigest() if b and not f else "" for h, b, f in zip(hashes, begun.tolist(), fails.tolist())]
        rows = np.concatenate([r.reshape(-1, 2) for r in rows])
        good = ~fails[rows[:, 0]] if len(rows) else np.zeros(0, dtype=bool)
        rows, keys = rows[good], np.concatenate(keys)[good]
        self.code, first = distinct(keys)
        self.pairs = keys[first]
        self.row, self.times = rows[:, 0], rows[:, 1]
        self.pair_times = np.zeros(len(self.pairs), dtype=np.int64)
        np.add.at(self.pair_times, self.code, self.times)


CHUNK = pa.schema([
    ("chunk", pa.int64()), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())), ("n_groups", pa.list_(pa.int64())), ("n_links", pa.list_(pa.int64())),
    ("hashes", pa.list_(pa.string())), ("row", pa.binary()), ("code", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int64())), ("pair_times", pa.list_(pa.int64())),
])
CHUNK_SQL = "chunk long, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, hashes array<string>, row binary, code binary, times binary, pairs array<long>, pair_times array<long>"


def align_chunks(docs: DataFrame, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """A row for each chunk of about CHUNK_BYTES of texts: what is known of its documents, and its distinct pairs."""

    def run(batches):
        encoders, task, made = Encoders(byte_bpe, piece_bpe), TaskContext.get().partitionId(), 0
        texts, ids, size = [], [], 0

        def chunk():
            x = Aligned(encoders, texts)
            low = (x.row.astype("<u4"), x.code.astype("<u4"), np.minimum(x.times, 0xFFFFFFFF).astype("<u4"))
            values = [[(task << 32) + made], *([c.tolist()] for c in x.counts), [x.hashes], *([packed(v)] for v in low), [x.pairs], [x.pair_times]]
            columns = [pa.array(v, t.type) for v, t in zip(values, CHUNK)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([pa.concat_arrays(ids)], pa.list_(ids[0].type))], [*CHUNK.names, "ids"])

        for batch in batches:
            for low in range(0, batch.num_rows, 16):
                part = batch.slice(low, 16)
                for i, text in enumerate(part.column(1).cast(pa.large_binary()).to_pylist()):
                    texts.append(text or b"")
                    ids.append(part.column(0).slice(i, 1))
                    size += len(text or b"")
                    if size >= CHUNK_BYTES or len(texts) >= 200_000:
                        yield chunk()
                        made, texts, ids, size = made + 1, [], [], 0
        if texts:
            yield chunk()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"{CHUNK_SQL}, ids array<{kind}>")


def packed(values: np.ndarray) -> bytes:
    """Differences of numbers below 2**32 with equal bytes side by side, which compress well."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)
    return np.cumsum(steps, dtype=np.uint32).astype(np.int64)


def align_tokens(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row for each row of ``docs`` (doc_id, text).

    A encodes a space and the text by ``byte_bpe``, B the text by ``piece_bpe``, which adds the space; special tokens are
    plain text. Groups are the parts between bytes where tokens of both end; links are pairs of tokens that share bytes. A
    pair of ids counts its links over all rows; ``n_best`` counts the links whose pair is the most frequent of its B id,
    ties included. Null and empty texts, and texts whose tokens do not give back their bytes, have zeros and ''; null ids
    stay null; repeated rows are answered and counted each; an empty table gives no rows; other columns are not read.
    Texts of any length are read whole, in windows.

    Texts do not move: tasks write their chunks with the distinct pairs in them, the pairs are counted with partial sums,
    and the counts go back to the chunks. A pair is one row a chunk, an id of B has no more pairs than A has ids.
    """
    width = len(Encoders(byte_bpe, piece_bpe).bytes_b)
    chunks = stage_table(align_chunks(docs, byte_bpe, piece_bpe), "aligned-chunks")
    asked = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "pair_times")).alias("code", "of")).select("chunk", "code", F.col("of.pairs").alias("pair"), F.col("of.pair_times").alias("times"))
    counts = stage_table(asked.groupBy("pair").agg(F.sum("times").alias("count")), "pair-counts")
    most = counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("count").alias("most"))  # no more rows than B has ids
    counts = counts.withColumn("b", F.col("pair") % width).join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = asked.select(F.col("chunk").alias("of_chunk"), "code", "pair").join(counts, "pair").select("of_chunk", "code", "count", "best")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(own: pa.Table, told: pa.Table) -> pa.Table:
        row = own.slice(0, 1)
        ids = row.column("ids").combine_chunks().flatten()
        lists = {c: row.column(c).combine_chunks().flatten() for c in ("n_a", "n_b", "n_groups", "n_links", "hashes")}
        place, code, times = (unpacked(row.column(c)[0].as_py()) for c in ("row", "code", "times"))
        at = told.column("code").to_numpy()
        count, best = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=bool)
        count[at], best[at] = told.column("count").to_numpy(), told.column("best").to_numpy()
        sums = np.zeros((2, len(ids)), dtype=np.int64)
        np.add.at(sums[0], place, times * best[code])
        np.add.at(sums[1], place, times * count[code])
        columns = [ids, *(lists[c] for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(sums[0]), pa.array(sums[1]), lists["hashes"]]
        return pa.Table.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    needed = chunks.drop("pairs", "pair_times")
    return needed.groupBy("chunk").cogroup(answers.groupBy("of_chunk")).applyInArrow(
        finish, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )


@query("op13_token_alignment")
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of the tokens of two tokenizers for every whole document."""
    return align_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
