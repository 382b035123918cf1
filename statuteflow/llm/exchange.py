"""Questions about hashes that every text asks of all others, packed for the shuffle.

A chunk is a group of about ``CHUNK_BYTES`` of texts, dealt by a hash. A task that holds a chunk deals the hashes of its
texts to parts by their first bits and sends one row per part, with the hashes as bytes; a task that holds a part answers
every row in the order of its hashes; the answers go back to the chunk, which makes its hashes anew. No hash is a row.
Chunks and parts are hash groups of an even size, whatever the texts have in common.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20


def chunked(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", others: tuple[Column, ...] = ()) -> DataFrame:
    """chunk, id, text (bytes) and other columns of all rows. The number of chunks follows the size of the texts."""
    text = F.col(text_column).cast("string")
    size = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    return docs.select(
        F.pmod(F.xxhash64(id_column, text), F.lit(1 + size // CHUNK_BYTES)).alias("chunk"),
        F.col(id_column).alias("id"), F.encode(text, "UTF-8").alias("text"), *others,
    )


def part_count(docs: DataFrame) -> int:
    """Parts of the hashes: four for each shuffle partition, so that tasks with several of them are even."""
    return 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def deal(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the keys by part, bounds of the parts in it); equal keys go to one part."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    order = np.argsort(part.astype(np.uint16) if parts < 65536 else part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1).astype(np.uint64))


def planes(values: np.ndarray) -> bytes:
    """64-bit integers with equal bytes of their numbers side by side, which compress well."""
    return np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, -1).T).view(np.int64).reshape(-1)


def flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=n).astype(bool)


def gather_flags(order: np.ndarray, bounds: np.ndarray, parts, answers) -> np.ndarray:
    """One flag for each key, from the answers of the parts (their numbers and packed flags)."""
    out = np.zeros(len(order), dtype=bool)
    for part, raw in zip(parts, answers):
        at = order[bounds[part] : bounds[part + 1]]
        out[at] = flags(raw, len(at))
    return out
