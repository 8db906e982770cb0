"""Which keys of a document (shingles, k-mers) are found in another document too.

Documents are dealt into chunks of a few MB by a hash of their content. A chunk sends its distinct keys, four bytes
each, to the parts of the key space and gets one bit back for each: found in two documents or more. A key that every
document holds costs four bytes a chunk, wherever it is. The parts grow in number with the corpus, so a part's size,
and the odds that two keys of a part share their four bytes (about one in a thousand), stay the same; such a pair only
makes a key seem repeated, and what uses the answers compares whole keys again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 8 << 20
PART_BYTES = 8 << 20


def sizes_of(docs: DataFrame, text: str) -> tuple[int, int]:
    """Numbers of chunks and of key parts; both follow the bytes of text."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    chunks = max(1, -(-total // CHUNK_BYTES))
    parts = 16
    while parts * PART_BYTES < total:
        parts *= 2
    return chunks, parts


def chunked(docs: DataFrame, text: str, key: str, chunks: int) -> DataFrame:
    """(chunk, doc_id, text): rows without id are spread by their text."""
    body = F.coalesce(F.col(text), F.lit(""))
    chunk = F.when(F.col(key).isNull(), chunk_of(F.xxhash64(body), chunks)).otherwise(chunk_of(F.col(key), chunks))
    return docs.select(chunk.alias("chunk"), F.col(key).cast("long").alias("doc_id"), body.alias("text"))


def chunk_of(key: Column, chunks: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("long")), F.lit(chunks))


def in_order(rows: pd.DataFrame) -> tuple[list, list[bytes]]:
    """Ids and lowered texts of a chunk, in an order that depends on its content alone."""
    if rows["doc_id"].is_unique:  # texts need not be compared
        rows = rows.sort_values("doc_id", na_position="first")
    else:
        rows = rows.sort_values(["doc_id", "text"], kind="stable", na_position="first")
    return [None if pd.isna(i) else int(i) for i in rows["doc_id"]], [
        t.encode("utf-8", "surrogatepass").lower() for t in rows["text"]
    ]


def _distinct(keys: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of a chunk, and whether more than one of its documents holds each."""
    found = list(keys)
    return np.unique(np.concatenate(found) if found else np.zeros(0, dtype=np.uint64), return_counts=True)


def repeated_keys(
    chunks: DataFrame,
    parts: int,
    keys_of: Callable[[list[bytes]], Iterator[np.ndarray]] | None,
    distinct_of: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]] | None = None,
) -> DataFrame:
    """(chunk, part, mask): for each chunk a bit for each of its distinct keys, in order, part by part.

    ``keys_of`` gives for each text its distinct 64-bit keys; or ``distinct_of`` for all texts at once the sorted distinct
    keys, and in how many texts each is (any number over 1 for more than one).
    """
    bits = parts.bit_length() - 1

    def send(rows: pd.DataFrame) -> pd.DataFrame:
        _, texts = in_order(rows)
        keys, counts = distinct_of(texts) if distinct_of else _distinct(keys_of(texts))
        edges = np.searchsorted(keys >> np.uint64(64 - bits), np.arange(parts + 1, dtype=np.uint64))
        short = ((keys << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
        some = np.flatnonzero(np.diff(edges))
        return pd.DataFrame(
            {
                "chunk": rows["chunk"].iloc[0],
                "part": some.astype(np.int32),
                "keys": [short[edges[p] : edges[p + 1]].tobytes() for p in some],
                "many": [np.packbits(counts[edges[p] : edges[p + 1]] > 1).tobytes() for p in some],
            }
        )

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(k, dtype="<u4") for k in rows["keys"]]
        many = [np.unpackbits(np.frombuffer(m, dtype=np.uint8), count=len(k)).astype(bool) for m, k in zip(rows["many"], keys)]
        every = np.sort(np.concatenate([*keys, *(k[m] for k, m in zip(keys, many))]))
        twice = every[1:][every[1:] == every[:-1]]
        masks = []
        for k in keys:
            at = np.minimum(np.searchsorted(twice, k), max(0, len(twice) - 1))
            masks.append(np.packbits(twice[at] == k if len(twice) else np.zeros(len(k), dtype=bool)).tobytes())
        return pd.DataFrame({"chunk": rows["chunk"], "part": rows["part"], "mask": masks, "n": [len(k) for k in keys]})

    sent = chunks.groupBy("chunk").applyInPandas(send, "chunk BIGINT, part INT, keys BINARY, many BINARY")
    return sent.groupBy("part").applyInPandas(answer, "chunk BIGINT, part INT, mask BINARY, n INT")


def repeated_of(texts: list[bytes], masks: pd.DataFrame, keys_of) -> np.ndarray:
    """The keys of the chunk whose bit is set, sorted."""
    keys, _ = _distinct(keys_of(texts))
    masks = masks.sort_values("part")
    bits = [np.unpackbits(np.frombuffer(m, dtype=np.uint8), count=n) for m, n in zip(masks["mask"], masks["n"])]
    return keys[np.concatenate(bits).astype(bool)] if bits else keys[:0]


def members(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each of ``keys`` is among ``sorted_keys``."""
    if len(sorted_keys) == 0:
        return np.zeros(len(keys), dtype=bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys
