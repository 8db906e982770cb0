"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is cut into short paragraphs: at line ends, and where a hash of the last four bytes says so (denser near the
beginning, so that short texts have several paragraphs too). An edit moves only the cuts beside it. A digest
covers a paragraph's bytes and how often the text held it before, so a text is a set of 64-bit digests. A sketch adds
each digest to one cell in each of three tables: a count, the sum of digests and the sum of their checks, modulo 2**64.
Sketches of two versions subtract cell by cell; peeling cells that hold one digest recovers the digests in which the
versions differ. Where that fails the sketch is made again, four times larger.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from counterfair.llm.common import staged
from counterfair.llm.words import _BASE, _BYTE, _tables, mix

#: (up to this byte of a text, mask of the hash bits that must be 0 for a cut)
CUTS = ((32, 1), (256, 7), (1 << 62, 31))
CELLS = 12
PAIR_BYTES = 1 << 20
_SALTS = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93], dtype=np.uint64)
_CHECK = np.uint64(0x5851F42D4C957F2D)


class Digests:
    """Sorted paragraph digests of a run of texts: ``keys[bounds[i]:bounds[i + 1]]`` are those of text i."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        first = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(sizes, out=first[1:])
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        owner = np.repeat(np.arange(len(texts)), sizes)
        at = np.arange(len(data)) - first[owner]
        roll = data.astype(np.uint64)
        for back in (1, 2, 3):  # bytes before the text's first count as 0
            before = np.zeros(len(data), dtype=np.uint64)
            before[back:] = data[: max(0, len(data) - back)][: len(before) - back]
            before[at < back] = 0
            roll |= before << np.uint64(8 * back)
        limit = np.array([m for _, m in CUTS], dtype=np.uint64)[np.searchsorted([x for x, _ in CUTS], at, side="right")]
        ends_here = (mix(roll) & limit == 0) | (data == 10)
        ends_here[first[1:][sizes > 0] - 1] = True
        ends = np.flatnonzero(ends_here) + 1
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        power, inverse = _tables(len(data))
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((_BYTE[data] | np.uint64(1)) * power, out=total[1:])
        keys = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        text = owner[starts] if len(starts) else starts
        order = np.lexsort((keys, text))
        keys, text = keys[order], text[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
        place = np.arange(len(keys))
        repeat = place - np.maximum.accumulate(np.where(new, place, 0))
        self.keys = mix(keys + repeat.astype(np.uint64) * _BASE)
        self.text = text
        self.counts = np.bincount(text, minlength=len(texts)).astype(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)])


def _cell(keys: np.ndarray, table: int, width: np.ndarray) -> np.ndarray:
    return (mix(keys ^ _SALTS[table]) % width.astype(np.uint64)).astype(np.int64)


class Sketches:
    """Cells of many sketches in one array; sketch i has three tables of ``widths[i]`` cells."""

    def __init__(self, widths: np.ndarray):
        self.widths = widths
        self.first = np.concatenate([[0], np.cumsum(3 * widths)])
        n = int(self.first[-1])
        self.count = np.zeros(n, dtype=np.int64)
        self.keys, self.checks = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
        self.owner = np.repeat(np.arange(len(widths)), 3 * widths)

    def add(self, sketch: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> None:
        signed = keys * sign.astype(np.uint64)
        checks = mix(keys ^ _CHECK) * sign.astype(np.uint64)
        for j in range(3):
            at = self.first[sketch] + j * self.widths[sketch] + _cell(keys, j, self.widths[sketch])
            np.add.at(self.count, at, sign)
            np.add.at(self.keys, at, signed)
            np.add.at(self.checks, at, checks)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Empty the cells that can be; returns the sketch, digest and sign of all that came out, and which sketches failed."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        table = (np.arange(len(self.count)) - self.first[self.owner]) // self.widths[self.owner]
        idle, j = 0, 0
        live = [np.flatnonzero(table == k) for k in range(3)]
        while idle < 3:
            at = live[j]
            at = at[np.abs(self.count[at]) == 1]
            sign = self.count[at]
            keys = self.keys[at] * sign.astype(np.uint64)
            good = mix(keys ^ _CHECK) * sign.astype(np.uint64) == self.checks[at]
            good &= _cell(keys, j, self.widths[self.owner[at]]) == (at - self.first[self.owner[at]]) % self.widths[self.owner[at]]
            at, keys, sign = at[good], keys[good], sign[good]
            if len(at):
                self.add(self.owner[at], keys, -sign)
                found.append((self.owner[at], keys, sign))
                idle = 0
            else:
                idle += 1
            j = (j + 1) % 3
        left = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        failed = np.bincount(self.owner, weights=left, minlength=len(self.widths)) > 0
        none = np.zeros(0, dtype=np.int64)
        owner, keys, sign = (np.concatenate(x) for x in zip((none, none.astype(np.uint64), none), *found))
        return owner, keys, sign, failed


def differences(a: Digests, ia: np.ndarray, b: Digests, ib: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, digest, sign) of every digest in which texts ``a[ia]`` and ``b[ib]`` differ, by pair; sign 1 is of ``a`` only.

    Recovered by subtracting sketches and peeling; pairs whose sketch fails are sketched again four times larger.
    """
    na, nb = a.counts[ia], b.counts[ib]
    out = []
    open_ = np.flatnonzero(na + nb > 0)
    width = np.full(len(ia), CELLS // 3, dtype=np.int64)
    while len(open_):
        # A sketch too small for the difference in size alone cannot be peeled.
        while (low := 3 * width[open_] < np.abs(na[open_] - nb[open_])).any():
            width[open_[low]] *= 4
        cells = Sketches(width[open_])
        for side, index, sign in ((a, ia, 1), (b, ib, -1)):
            n = side.counts[index[open_]]
            start = side.bounds[index[open_]]
            at = np.arange(n.sum()) + np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            cells.add(np.repeat(np.arange(len(open_)), n), side.keys[at], np.full(len(at), sign, dtype=np.int64))
        owner, keys, sign, failed = cells.peel()
        sure = ~failed[owner]
        out.append((open_[owner[sure]], keys[sure], sign[sure]))
        open_ = open_[failed]
        width[open_] *= 4
    none = np.zeros(0, dtype=np.int64)
    pair, keys, sign = (np.concatenate(x) for x in zip((none, none.astype(np.uint64), none), *out))
    order = np.lexsort((keys, pair))
    return pair[order], keys[order], sign[order]


def likeness(a: Digests, ia: np.ndarray, b: Digests, ib: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Intersection over union of the digests of texts ``a[ia]`` and ``b[ib]``, 1 for two empty texts; ``pair`` as from ``differences``."""
    differ = np.bincount(pair, minlength=len(ia))
    both = (a.counts[ia] + b.counts[ib] - differ) / 2
    return np.where(both + differ > 0, both / np.maximum(both + differ, 1), 1.0)


STORED = np.dtype([("n", "<u2"), ("key", "<u8"), ("check", "<u2")])


def fingerprints(d: Digests, n: int, size: int = CELLS) -> list[str]:
    """Text form of a sketch of ``size`` cells: the number of digests, then its cells.

    Counts and checks are kept modulo 2**16, so that two fingerprints of one size subtract (``subtract``).
    """
    cells = Sketches(np.full(n, size // 3, dtype=np.int64))
    cells.add(d.text, d.keys, np.ones(len(d.keys), dtype=np.int64))
    packed = np.zeros(n * size, dtype=STORED)
    packed["n"], packed["key"], packed["check"] = cells.count % 65536, cells.keys, cells.checks & np.uint64(0xFFFF)
    raw, width = packed.tobytes(), STORED.itemsize * size
    return [f"{d.counts[i]}:{base64.b64encode(raw[i * width : (i + 1) * width]).decode()}" for i in range(n)]


def subtract(a: str, b: str) -> tuple[list[int], list[int]] | None:
    """The digests that only the text of fingerprint ``a`` or only that of ``b`` holds; None where more differ than its cells can tell."""
    (na, x), (nb, y) = ((int(n), np.frombuffer(base64.b64decode(c), dtype=STORED)) for n, c in (f.split(":") for f in (a, b)))
    if len(x) != len(y):
        raise ValueError("fingerprints of different sizes")
    width = np.array([len(x) // 3])
    count, check = ((x[f].astype(np.int64) - y[f]) % 65536 for f in ("n", "check"))
    key = x["key"] - y["key"]
    only: dict[int, list[int]] = {1: [], -1: []}
    again = True
    while again:
        again = False
        for i in range(len(x)):
            sign = {1: 1, 65535: -1}.get(int(count[i]))
            if sign is None:
                continue
            digest = key[i : i + 1] * np.int64(sign).astype(np.uint64)
            own = int(mix(digest ^ _CHECK)[0]) & 0xFFFF
            if sign * own % 65536 != check[i] or _cell(digest, i // int(width[0]), width)[0] != i % width[0]:
                continue
            if int(digest[0]) in (*only[1], *only[-1]):
                return None  # a cell that only looked like one digest came out before
            for j in range(3):
                at = j * int(width[0]) + int(_cell(digest, j, width)[0])
                count[at], check[at] = (count[at] - sign) % 65536, (check[at] - sign * own) % 65536
                key[at : at + 1] -= digest * np.int64(sign).astype(np.uint64)
            only[sign].append(int(digest[0]))
            again = True
    if count.any() or check.any() or key.any() or len(only[1]) - len(only[-1]) != na - nb:
        return None
    return sorted(only[1]), sorted(only[-1])


def changed_digests(a: str, b: str) -> tuple[list[int], list[int]]:
    """``subtract`` for two texts: their fingerprints, four times larger until the difference can be told."""
    size, texts = CELLS, [Digests([t.encode("utf-8", "surrogatepass")]) for t in (a, b)]
    while (found := subtract(*(fingerprints(d, 1, size)[0] for d in texts))) is None:
        size *= 4
    return found


def edited(text: str, following: str) -> str:
    """The last quarter of the code points gives way to the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n] if n else text


RESULT = (
    "doc_id BIGINT, n_chars BIGINT, edited_sha256 STRING, fingerprint STRING, edited_fingerprint STRING,"
    " near_edited DOUBLE, near_next DOUBLE, lost ARRAY<BIGINT>, gained ARRAY<BIGINT>"
)
_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string())]
    + [("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    + [("lost", pa.list_(pa.int64())), ("gained", pa.list_(pa.int64()))]
)
_EDGE = pa.schema([*_RESULT, ("part", pa.int32()), ("side", pa.string()), ("text", pa.string())])
EDGE = RESULT + ", part INT, side STRING, text STRING"


def _compare(ids: list, texts: list[str], following: list[str]) -> dict[str, list]:
    """Result columns for texts and the text that follows each."""
    changed = [edited(t, f) for t, f in zip(texts, following)]
    raw = [[t.encode("utf-8", "surrogatepass") for t in x] for x in (texts, changed, following)]
    own, other, after = (Digests(x) for x in raw)
    every = np.arange(len(texts))
    pair, keys, sign = differences(own, every, other, every)
    lost, gained = ([x.view(np.int64) for x in np.split(keys[mine], np.searchsorted(pair[mine], every[1:]))] for mine in (sign > 0, sign < 0))
    return {
        "doc_id": ids,
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(x).hexdigest() for x in raw[1]],
        "fingerprint": fingerprints(own, len(texts)),
        "edited_fingerprint": fingerprints(other, len(texts)),
        "near_edited": likeness(own, every, other, every, pair),
        "near_next": likeness(own, every, after, every, differences(own, every, after, every)[0]),
        "lost": lost,
        "gained": gained,
    }


def _runs(pairs: Iterator[tuple]) -> Iterator[list[tuple]]:
    held, size = [], 0
    for p in pairs:
        held.append(p)
        size += len(p[1]) + len(p[2]) + 64
        if size >= PAIR_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, so that sorting moves less than half of their bytes."""
    for batch in batches:
        packed = [zstandard.compress(t.encode("utf-8", "surrogatepass"), 3) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(packed, pa.binary())], names=["doc_id", "packed"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition: a result for each row with a successor here; the first and last as edges."""
    part = TaskContext.get().partitionId()
    first = last = None

    def pairs():
        nonlocal first, last
        for batch in batches:
            for i, packed in zip(batch["doc_id"].to_pylist(), batch["packed"].to_pylist()):
                t = zstandard.decompress(packed).decode("utf-8", "surrogatepass")
                if first is None:
                    first = (i, t)
                else:
                    yield (*last, t)
                last = (i, t)

    for run in _runs(pairs()):
        out = _compare(*(list(x) for x in zip(*run)))
        n = len(run)
        yield pa.RecordBatch.from_pydict(out | {"part": [part] * n, "side": ["row"] * n, "text": [None] * n}, schema=_EDGE)
    if first is not None:
        rows = [{"doc_id": x[0], "part": part, "side": s, "text": x[1]} for x, s in ((first, "first"), (last, "last"))]
        yield pa.RecordBatch.from_pylist(rows, schema=_EDGE)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ((x["doc_id"], x["text"], x["following"]) for b in batches for x in b.to_pylist())
    for run in _runs(rows):
        yield pa.RecordBatch.from_pydict(_compare(*(list(x) for x in zip(*run))), schema=_RESULT)


def fingerprint_versions(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprint each text and its edited version, whose last quarter comes from the next document.

    ``lost`` and ``gained`` are the digests of paragraphs that only the text or only its edited version holds.

    The next document is that with the next larger id (after the last: the first); rows with equal ids follow each
    other in the order of their compressed texts, rows without id come first. A null text is empty; two empty texts have likeness 1, an empty and
    another 0. Rows are sorted by ranges once; only the first and last rows of the ranges are met again by a join.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    packed = rows.mapInArrow(_packed, "doc_id BIGINT, packed BINARY")
    sorted_rows = packed.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "packed")
    found = staged(sorted_rows.mapInArrow(_neighbours, EDGE), "fingerprints")
    firsts = found.where("side = 'first'").select(F.col("part").alias("_next"), F.col("text").alias("following"))
    parts = found.where("side = 'first'").select("part")  # one row for each range
    after = parts.withColumn("_next", F.lead("part").over(Window.orderBy("part")))
    after = after.crossJoin(parts.agg(F.min("part").alias("_least")))  # one row
    after = after.select("part", F.coalesce("_next", "_least").alias("_next"))
    lasts = found.where("side = 'last'").select("doc_id", "text", "part")
    ends = lasts.join(after, "part").join(firsts, "_next").select("doc_id", "text", "following")
    return found.where("side = 'row'").select(*_RESULT.names).unionByName(ends.mapInArrow(_pairs, RESULT))
