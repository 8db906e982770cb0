"""Suffix-array dedup: maximal repeats of at least ``width`` bytes, with all their occurrences, over a corpus in parts.

One suffix array cannot hold a corpus, so suffixes are dealt into parts in which all suffixes with the same first
``width`` bytes meet. Each window of ``width`` bytes is led by its least K-byte run (by hash, the leftmost of equals);
that depends on the window's bytes alone. Runs that only one document holds are dropped first, by exchanging four bytes
a run. For each other run a chunk sends the text of the windows that it leads, once for all equal ones in the chunk, to
the part of its hash. Runs found in HOT chunks or more are split further, by the bytes that STRATUM neighbouring windows
have in common, so that text beside a frequent passage does not gather in one part.

A part sorts its suffixes, takes the longest common prefix of neighbours and scans both with a stack: every interval of
the common-prefix tree of ``width`` bytes or more is a repeat, and one is reported, with all its members, where the bytes
before the members differ (or a window led by another run lies before one, whose repeat is found there). Repeats that
extend to the left are reported by the interval further left, so nothing covered is lost.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterfair.llm.common import staged
from counterfair.llm.words import mix

K = 26
CHUNK_BYTES = 8 << 20
PART_BYTES = 8 << 20
BLOCK = 1 << 16  # window starts hashed at a time
HOT = 32  # chunks
STRATUM = 5  # neighbouring windows of a hot run that meet in one part
_BITS = np.random.Generator(np.random.PCG64(77))
_BYTE = _BITS.integers(0, 2**64, 256, dtype=np.uint64)
_WORD = _BITS.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 17) - 1)
CHUNK = "chunk BIGINT, n_bytes BIGINT, ids BINARY, sizes BINARY, body BINARY"
SENT = "chunk BIGINT, part INT, kind INT, n INT, data BINARY"


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 3)


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype=kind)


def _pack_all(*arrays: np.ndarray) -> bytes:
    packed = [_pack(a) for a in arrays]
    return struct.pack(f"<{len(packed)}q", *map(len, packed)) + b"".join(packed)


def _unpack_all(data: bytes, *kinds) -> list[np.ndarray]:
    sizes = struct.unpack_from(f"<{len(kinds)}q", data)
    at, out = 8 * len(kinds), []
    for size, kind in zip(sizes, kinds):
        out.append(_unpack(data[at : at + size], kind))
        at += size
    return out


class Chunk:
    """Documents of a chunk: ids, and bytes of document i at ``bounds[i]:bounds[i + 1]``."""

    def __init__(self, ids: bytes, sizes: bytes, body: bytes):
        self.ids = _unpack(ids, np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(_unpack(sizes, np.int64))])
        self.data = _unpack(body, np.uint8)


def pack_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents packed into rows of about CHUNK_BYTES of text; a longer document is a row of its own."""
    task, made = TaskContext.get().partitionId() if TaskContext.get() else 0, 0

    def row(ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        packed = (_pack(np.array(ids, dtype=np.int64)), _pack(sizes), zstandard.compress(b"".join(texts), 3))
        numbers = (pa.array([(task << 32) + made], pa.int64()), pa.array([size], pa.int64()))
        return pa.record_batch(
            [*numbers, *(pa.array([x], pa.binary()) for x in packed)], names=["chunk", "n_bytes", "ids", "sizes", "body"]
        )

    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            t = t.as_py()
            if ids and size + len(t) > CHUNK_BYTES:
                yield row(ids, texts)
                made, ids, texts, size = made + 1, [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
    if ids:
        yield row(ids, texts)


def _rolled(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from each place on (of each row), by doubling."""
    n = data.shape[-1] - width + 1
    power, step, done = _BYTE[data], 1, 0
    out = np.zeros((*data.shape[:-1], n), dtype=np.uint64)
    while step <= width:
        if width & step:
            out = out * np.uint64(pow(int(_BASE), step, 1 << 64)) + power[..., done : done + n]
            done += step
        if 2 * step <= width:
            power = power[..., :-step] * np.uint64(pow(int(_BASE), step, 1 << 64)) + power[..., step:]
        step *= 2
    return mix(out)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    step = 1
    while 2 * step <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return np.minimum(values[: len(values) - (width - step)], values[width - step :]) if width > step else values


def leaders(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs that lead windows: their places, hashes, and the first and last window (start) that each leads.

    Windows lie inside one document.
    """
    near = width - K + 1
    places, keys, lows, highs = [], [], [], []
    last = len(data) - width + 1
    for start in range(0, max(0, last), BLOCK):
        stop = min(start + BLOCK, last)
        held = data[start : stop + width - 1]
        hashes = _rolled(held, K)
        order = np.arange(len(hashes), dtype=np.uint64)
        lead = (_least((hashes & ~_PLACE) | order, near) & _PLACE).astype(np.int64)
        first, end = np.searchsorted(bounds, [start + 1, stop + width])
        for b in bounds[max(1, first - 1) : end + 1].tolist():  # windows over a document's end lead nowhere
            lead[max(0, b - width + 1 - start) : max(0, b - start)] = -1
        cut = np.concatenate([[0], np.flatnonzero(np.diff(lead)) + 1, [len(lead)]])
        runs = lead[cut[:-1]]
        some = runs >= 0
        places.append(runs[some] + start)
        keys.append(mix(hashes[runs[some]]))  # least hashes are small: mixed again, they fill the key space evenly
        lows.append(cut[:-1][some] + start)
        highs.append(cut[1:][some] - 1 + start)
    if not places:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none, none
    at, key, low, high = (np.concatenate(x) for x in (places, keys, lows, highs))
    same = np.concatenate([[False], (at[1:] == at[:-1])])  # windows of one run on both sides of a block's edge
    heads = np.flatnonzero(~same)
    return at[heads], key[heads], low[heads], high[np.append(heads[1:], len(at)) - 1]


def _distinct(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and whether more than one document id holds each."""
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    if len(first) == 0:
        return keys, np.zeros(0, dtype=bool)
    return keys[first], np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)


def _owners(chunk: Chunk, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(chunk.bounds, at, side="right") - 1


def _by_part(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each part begins among sorted keys."""
    return np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def _send_keys(batches: Iterable[pa.RecordBatch], width: int, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            row = batch.slice(r, 1).to_pylist()[0]
            chunk = Chunk(row["ids"], row["sizes"], row["body"])
            at, keys, _, _ = leaders(chunk.data, chunk.bounds, width)
            keys, many = _distinct(keys, chunk.ids[_owners(chunk, at)])
            edges = _by_part(keys, bits)
            short = ((keys << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
            some = np.flatnonzero(np.diff(edges))
            data = [_pack_all(short[edges[p] : edges[p + 1]], np.packbits(many[edges[p] : edges[p + 1]])) for p in some]
            yield _record(row["chunk"], some, 0, np.diff(edges)[some], data)


def _record(chunk: int, parts: np.ndarray, kind: int, n: np.ndarray, data: list[bytes]) -> pa.RecordBatch:
    size = len(data)
    return pa.record_batch(
        [
            pa.array(np.full(size, chunk, dtype=np.int64)),
            pa.array(np.asarray(parts, dtype=np.int32)),
            pa.array(np.full(size, kind, dtype=np.int32)),
            pa.array(np.asarray(n, dtype=np.int32)),
            pa.array(data, pa.binary()),
        ],
        names=["chunk", "part", "kind", "n", "data"],
    )


def _answer_keys(rows: pd.DataFrame) -> pd.DataFrame:
    """For each key sent: 0 for one document, 1 for more, 2 for HOT chunks or more."""
    sent = [_unpack_all(d, "<u4", np.uint8) for d in rows["data"]]
    keys, counts = np.unique(np.concatenate([k for k, _ in sent]), return_counts=True)
    twice = counts > 1
    for k, m in sent:
        many = np.unpackbits(m, count=len(k)).astype(bool)
        twice[np.searchsorted(keys, k[many])] = True
    level = (twice.astype(np.uint8) + (counts >= HOT)).astype(np.uint8)
    back = [_pack(level[np.searchsorted(keys, k)]) for k, _ in sent]
    return pd.DataFrame({"chunk": rows["chunk"], "part": rows["part"], "kind": 1, "n": rows["n"], "data": back})


def _context_hash(words: np.ndarray, windows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), dtype=np.uint64)
    for j in range(words.shape[1]):
        out = mix(out + words[:, j] * _WORD[j])
    return mix(out + windows.astype(np.uint64) * _WORD[-1])


def _contexts(chunk: Chunk, low: np.ndarray, high: np.ndarray, width: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Text from window ``low`` to the end of window ``high``, zero-filled, in rows of ``wide`` bytes; number of windows."""
    length = high - low + width
    out = np.zeros((len(low), wide), dtype=np.uint8)
    span = np.arange(wide, dtype=np.int64)
    for s in range(0, len(low), 1 << 15):
        part = slice(s, s + (1 << 15))
        index = low[part, None] + span
        inside = span < length[part, None]
        out[part] = np.where(inside, chunk.data[np.clip(index, 0, len(chunk.data) - 1)], 0)
    return out, (high - low + 1).astype(np.uint8)


def _candidates(chunk: Chunk, answers: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, first and last windows of all runs that more than one document holds; those of hot runs in strata."""
    at, keys, low, high = leaders(chunk.data, chunk.bounds, width)
    known, _ = _distinct(keys, chunk.ids[_owners(chunk, at)])
    answers = answers.sort_values("part")
    level = np.concatenate([_unpack(d, np.uint8) for d in answers["data"]]) if len(answers) else np.zeros(0, dtype=np.uint8)
    mine = level[np.searchsorted(known, keys)] if len(known) else level
    plain, hot = mine == 1, np.flatnonzero(mine == 2)
    out = [(keys[plain], low[plain], high[plain])]
    strata = -(-(width - K + 1) // STRATUM)
    shared = width - STRATUM + 1
    powers = np.array([pow(int(_BASE), shared - 1 - j, 1 << 64) for j in range(shared)], dtype=np.uint64)
    for q in range(strata):  # windows that begin STRATUM * q to STRATUM * q + 4 bytes before the run
        lo = np.maximum(low[hot], at[hot] - STRATUM * q - (STRATUM - 1))
        hi = np.minimum(high[hot], at[hot] - STRATUM * q)
        some = lo <= hi
        lo, hi, place = lo[some], hi[some], (at[hot] - STRATUM * q)[some]
        common = np.zeros(len(place), dtype=np.uint64)
        for j in range(shared):
            common += _BYTE[chunk.data[place + j]] * powers[j]
        out.append((mix(common + np.uint64(q + 1)), lo, hi))
    keys, low, high = (np.concatenate(x) for x in zip(*out))
    return keys, low, high


def _records(chunk: Chunk, answers: pd.DataFrame, width: int) -> tuple[np.ndarray, ...]:
    """Occurrences (keys, first windows) in the order of their contexts, where each distinct context begins, its text and windows."""
    keys, low, high = _candidates(chunk, answers, width)
    wide = -(-(2 * width - K) // 8) * 8
    text, windows = _contexts(chunk, low, high, width, wide)
    code = _context_hash(text.view(np.uint64), windows)
    order = np.lexsort((low, code, keys))
    keys, code, low = keys[order], code[order], low[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (code[1:] != code[:-1])
    heads = np.flatnonzero(new)
    return keys, low, heads, text[order[heads]], windows[order[heads]]


def _send_contexts(rows: pd.DataFrame, answers: pd.DataFrame, width: int, bits: int) -> pd.DataFrame:
    """One record per distinct context of the chunk to its part."""
    schema = ["chunk", "part", "kind", "n", "data"]
    if len(rows) == 0:
        return pd.DataFrame(columns=schema)
    chunk = Chunk(*rows.iloc[0][["ids", "sizes", "body"]])
    keys, low, heads, text, windows = _records(chunk, answers, width)
    if len(heads) == 0:
        return pd.DataFrame(columns=schema)
    ids = chunk.ids[_owners(chunk, low)]
    least, most = np.minimum.reduceat(ids, heads), np.maximum.reduceat(ids, heads)
    edges = _by_part(keys[heads], bits)
    some = np.flatnonzero(np.diff(edges))
    data = []
    for p in some:
        s = slice(edges[p], edges[p + 1])
        data.append(_pack_all(text[s], windows[s], least[s], most[s] - least[s]))
    name = rows["chunk"].iloc[0]
    return pd.DataFrame({"chunk": name, "part": some, "kind": 2, "n": np.diff(edges)[some], "data": data})


def suffix_array(text: np.ndarray, row: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes (rows of ``text`` from ``start`` on, ``length`` bytes) and common prefixes with the one before."""
    wide = text.shape[1]
    flat = np.concatenate([text.ravel(), np.zeros(wide, dtype=np.uint8)])
    span = np.arange(wide, dtype=np.int64)
    suffixes = np.zeros((len(row), wide), dtype=np.uint8)
    for s in range(0, len(row), 1 << 15):
        part = slice(s, s + (1 << 15))
        got = flat[(row[part].astype(np.int64) * wide + start[part])[:, None] + span]
        suffixes[part] = np.where(span < length[part, None], got, 0)
    order = np.lexsort((length, suffixes.view(f"S{wide}").ravel()))
    common = np.zeros(len(row), dtype=np.int64)
    for s in range(1, len(row), 1 << 15):
        here, there = order[s : s + (1 << 15)], order[s - 1 : s - 1 + (1 << 15)]
        there = there[: len(here)]
        differ = suffixes[here] != suffixes[there]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
        common[s : s + len(here)] = np.minimum(first, np.minimum(length[here], length[there]))
    return order, common


def intervals(
    common: np.ndarray, left: np.ndarray, least: np.ndarray, most: np.ndarray, width: int
) -> list[tuple[int, int, int, int]]:
    """Intervals (first, last, length, least id) of the common-prefix tree that are maximal repeats of two documents.

    All arrays are in suffix order; ``common`` is with the suffix before. ``left`` is the byte before a suffix, below 0
    where it counts as different from any other. A stack holds the open intervals with the least and the largest id in
    them and their byte before (-1 once two differ).
    """
    out = []
    stack: list[list[int]] = []  # length, first, least, most, left
    common, left, least, most = (np.append(x, 0).tolist() for x in (common, left, least, most))
    n = len(common) - 1
    for i in range(1, n + 1):
        c = common[i] if i < n else 0
        if c < width and not stack:
            continue
        first, lo, hi, byte = i - 1, least[i - 1], most[i - 1], left[i - 1]
        while stack and stack[-1][0] > c:
            length, begin, a, b, x = stack.pop()
            lo, hi = (a if a < lo else lo), (b if b > hi else hi)
            if x != byte:
                byte = -1
            first = begin
            if byte < 0 and hi > lo:
                out.append((first, i - 1, length, lo))
        if c >= width:
            if stack and stack[-1][0] == c:
                top = stack[-1]
                top[2], top[3] = (lo if lo < top[2] else top[2]), (hi if hi > top[3] else top[3])
                if top[4] != byte:
                    top[4] = -1
            else:
                stack.append([c, first, lo, hi, byte])
    return out


def _repeats(rows: pd.DataFrame, width: int, listed: bool) -> pd.DataFrame:
    """The maximal repeats of a part, told to each chunk record by record: window, length, least id, number of the repeat.

    Where they are not to be ``listed``, a record hears only of repeats that some document of its own must give up.
    """
    wide = -(-(2 * width - K) // 8) * 8
    sent = [_unpack_all(d, np.uint8, np.uint8, np.int64, np.int64) for d in rows["data"]]
    text = np.concatenate([s[0] for s in sent]).reshape(-1, wide)
    windows, least, spread = (np.concatenate([s[j] for s in sent]) for j in range(1, 4))
    most = least + spread
    code = _context_hash(text.view(np.uint64), windows)
    _, picked, same = np.unique(code, return_index=True, return_inverse=True)
    text, windows = text[picked], windows[picked]
    low = np.full(len(picked), np.iinfo(np.int64).max)
    high = np.full(len(picked), np.iinfo(np.int64).min)
    np.minimum.at(low, same, least)
    np.maximum.at(high, same, most)
    # All windows of all distinct contexts; those whose first bytes no other one has make no interval.
    row = np.repeat(np.arange(len(windows), dtype=np.int64), windows)
    first = np.concatenate([[0], np.cumsum(windows, dtype=np.int64)])[:-1]
    at = np.arange(len(row), dtype=np.int64) - np.repeat(first, windows)
    starts = np.arange(text.shape[1] - width + 1)
    begin = [_rolled(text[s : s + 4096], width)[starts < windows[s : s + 4096, None]] for s in range(0, len(text), 4096)]
    begin = np.concatenate(begin) if begin else np.zeros(0, dtype=np.uint64)
    order = np.argsort(begin)
    alike = begin[order[1:]] == begin[order[:-1]]
    shared = order[np.concatenate([alike, [False]]) | np.concatenate([[False], alike])] if len(order) else order
    row, at = row[shared], at[shared]
    length = windows[row].astype(np.int64) + width - 1 - at
    order, common = suffix_array(text, row, at, length)
    row, at = row[order], at[order]
    left = np.where(at == 0, -1, text[row, at - 1].astype(np.int64))
    found = intervals(common, left, low[row], high[row], width)
    # A context of several documents repeats as a whole, besides what it shares with others.
    whole = np.flatnonzero(high > low)
    u, w = [whole], [np.zeros(len(whole), dtype=np.int64)]
    size, owner = [windows[whole].astype(np.int64) + width - 1], [low[whole]]
    number = [np.arange(len(whole), dtype=np.int64)]
    if found:
        a, b, c, d = (np.array(x, dtype=np.int64) for x in zip(*found))
        n = b - a + 1
        member = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        u.append(row[member])
        w.append(at[member])
        size.append(np.repeat(c, n))
        owner.append(np.repeat(d, n))
        number.append(np.repeat(np.arange(len(n), dtype=np.int64) + len(whole), n))
    u, w, size, owner, number = (np.concatenate(x) for x in (u, w, size, owner, number))
    order = np.argsort(u, kind="stable")
    u, w, size, owner, number = (x[order] for x in (u, w, size, owner, number))
    edges = np.searchsorted(u, np.arange(len(picked) + 1))
    back, start = [], 0
    part = int(rows["part"].iloc[0])
    for n in rows["n"].tolist():
        mine = same[start : start + n]
        count = edges[mine + 1] - edges[mine]
        record = np.repeat(np.arange(n), count)
        index = np.repeat(edges[mine] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        if not listed:
            told = owner[index] < most[start : start + n][record]
            record, index = record[told], index[told]
        back.append(
            _pack_all(
                record.astype("<i4"), w[index].astype(np.uint8), size[index].astype(np.uint8), owner[index],
                number[index] + (part << 32) if listed else owner[:0],
            )
        )
        start += n
    return pd.DataFrame({"chunk": rows["chunk"], "part": rows["part"], "kind": 4, "n": rows["n"], "data": back})


def _told(chunk: Chunk, rows: pd.DataFrame, width: int) -> tuple[np.ndarray, ...]:
    """Occurrences of a chunk's repeats: start, length, least id of the repeat, its number."""
    if len(rows) == 0:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    _, low, heads, _, _ = _records(chunk, rows[rows["kind"] == 1], width)
    first = np.append(heads, len(low))
    count = np.diff(first)
    back = rows[rows["kind"] == 4].sort_values("part")
    out, base = [], 0
    for n, data in zip(back["n"].tolist(), back["data"]):
        record, at, size, owner, number = _unpack_all(data, "<i4", np.uint8, np.uint8, np.int64, np.int64)
        record = record + base
        base += n
        times = count[record].astype(np.int64)
        each = np.repeat(np.arange(len(record)), times)
        index = np.repeat(first[record] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum()) if len(record) else record
        number = number if len(number) else np.zeros(len(record), dtype=np.int64)
        out.append((low[index] + at[each], size[each].astype(np.int64), owner[each], number[each]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, dtype=np.int64) for _ in range(4))


KEPT = "doc_id BIGINT, kept BINARY, n_bytes BIGINT, spans ARRAY<STRUCT<start: BIGINT, stop: BIGINT>>"


def _cut(rows: pd.DataFrame, told: pd.DataFrame, width: int) -> pd.DataFrame:
    """Each document without the bytes that a repeat with a smaller least id covers."""
    chunk = Chunk(*rows.iloc[0][["ids", "sizes", "body"]])
    start, size, owner, _ = _told(chunk, told, width)
    if len(start):
        gone = chunk.ids[_owners(chunk, start)] > owner
        start, size = start[gone], size[gone]
    step = np.zeros(len(chunk.data) + 1, dtype=np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, start + size, -1)
    covered = np.cumsum(step[:-1]) > 0
    kept, spans, sizes = [], [], np.diff(chunk.bounds)
    for i, n in enumerate(sizes.tolist()):
        mine = covered[chunk.bounds[i] : chunk.bounds[i + 1]]
        text = chunk.data[chunk.bounds[i] : chunk.bounds[i + 1]]
        if not mine.any():
            kept.append(text.tobytes())
            spans.append([])
            continue
        kept.append(text[~mine].tobytes())
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
        spans.append([{"start": a, "stop": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())])
    return pd.DataFrame({"doc_id": chunk.ids, "kept": kept, "n_bytes": sizes, "spans": spans})


LISTED = "repeat_id BIGINT, length INT, doc_id BIGINT, start BIGINT"


def _listed(rows: pd.DataFrame, told: pd.DataFrame, width: int) -> pd.DataFrame:
    chunk = Chunk(*rows.iloc[0][["ids", "sizes", "body"]])
    start, size, _, number = _told(chunk, told, width)
    owner = _owners(chunk, start)
    return pd.DataFrame({"repeat_id": number, "length": size, "doc_id": chunk.ids[owner], "start": start - chunk.bounds[owner]})


def _exchanged(docs: DataFrame, text: str, key: str, width: int, listed: bool) -> tuple[DataFrame, DataFrame]:
    """Packed chunks of the documents with an id, and what the parts tell them."""
    if not K <= width <= 100:
        raise ValueError(f"width must be between {K} and 100 bytes")
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    packed = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("i"), body.alias("t")).mapInArrow(pack_chunks, CHUNK)
    chunks = staged(packed, "suffix-chunks")
    total = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    parts = 16
    while parts * PART_BYTES < total:
        parts *= 2
    bits = parts.bit_length() - 1
    sent = chunks.mapInArrow(lambda b: _send_keys(b, width, bits), SENT)
    answers = staged(sent.groupBy("part").applyInPandas(_answer_keys, SENT), "suffix-answers")
    contexts = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(
        lambda a, b: _send_contexts(a, b, width, bits), SENT
    )
    told = contexts.groupBy("part").applyInPandas(lambda p: _repeats(p, width, listed), SENT)
    return chunks, told.unionByName(answers)


def suffix_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 50) -> DataFrame:
    """(doc_id, kept, n_bytes, spans) for each row: its UTF-8 text without the bytes covered by a string of ``width``
    bytes that also starts in a document of smaller id, and the runs removed.

    Strings are judged on the input, overlaps count, and none crosses documents; ``kept`` is binary, as a cut may fall
    inside a character. Null texts are empty and lose nothing, like texts shorter than ``width``. Rows without id take no
    part and stay whole. Rows that repeat an id are one document to all others and each other: none of them makes
    another lose bytes. Other columns are not read; an empty table gives no rows.
    """
    chunks, told = _exchanged(docs, text, key, width, listed=False)
    cut = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(lambda a, b: _cut(a, b, width), KEPT)
    loose = docs.where(F.col(key).isNull()).select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("kept"))
    loose = loose.select("doc_id", "kept", F.octet_length("kept").cast("long").alias("n_bytes"), F.array().cast(KEPT.split("spans ")[1].lower()).alias("spans"))
    return cut.unionByName(loose)


def maximal_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 50) -> DataFrame:
    """(repeat_id, length, doc_id, start): all occurrences of the maximal repeats of ``width`` bytes or more that two
    documents or more hold.

    A repeat is looked at within the windows of one leading run, so a longer one is a chain of overlapping repeats of at
    most ``2 * width - K`` bytes; each starts where the bytes before its occurrences differ, or where another run takes
    over. Rows without id and other columns are left out.
    """
    chunks, told = _exchanged(docs, text, key, width, listed=True)
    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(lambda a, b: _listed(a, b, width), LISTED)
