"""SentencePiece BPE encoding and decoding by suffix-array matching.

A batch of texts is cut into words (a space mark and what follows), the distinct words are joined into one text, and
its suffixes are sorted by as many characters as the longest piece has. Every piece of the vocabulary is then a range
of suffixes, found by binary search; the ranges give all edges (start, piece) of the words, which are sorted by end and
relaxed from left to right: the last token of a prefix is the piece that the token before it lets stand, that is, whose
pair BPE would not have merged otherwise. A token sequence is the BPE encoding exactly if each neighbouring pair is.

Runs of space marks, whose pieces all have one score, are merged from the left apart from the words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_CHAR = -2
START = -1
BATCH_CHARS = 3_000_000
INDEX_CHARS = 600_000  # of new distinct words indexed at a time


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Vocabulary:
    """Fixed tables of one model; the words of tens of thousands of pieces, so a few MB."""

    pieces: list[str]
    token_of: dict[str, int]
    byte_of: dict[int, int]  # token -> byte
    tokens_of_byte: list[int]
    code_of: dict[str, int]  # character -> 1, 2, ...; 0 separates words
    code_at: np.ndarray  # the same by code point, a further code for those without; the last place is for all beyond
    rank: np.ndarray  # by token: order of merging, -1 for characters
    left: np.ndarray
    right: np.ndarray
    merge_keys: np.ndarray  # sorted left * n + right of all pairs that make a piece, and that piece's rank
    merge_ranks: np.ndarray
    matched: np.ndarray  # tokens that the matching looks for, their lengths and codes
    lengths: np.ndarray
    codes: np.ndarray
    raw: list[bytes]  # what a token stands for

    def run(self, n: int) -> list[int]:
        """Tokens of n space marks in a row: equal scores, so the leftmost pair merges first."""
        return list(_run(self, n))


def _merge(symbols: list[str], rank_of: dict[str, int]) -> list[str]:
    """Plain BPE: again and again the neighbours whose union comes first in the vocabulary."""
    symbols = list(symbols)
    while True:
        best = min(((rank_of.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))), default=None)
        if best is None or best[0] == 1 << 60:
            return symbols
        i = best[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def _run(v: Vocabulary, n: int) -> list[int]:
    out: list[int] = []  # lengths; merging from the left only ever touches the end of this list
    for _ in range(n):
        out.append(1)
        while len(out) > 1 and MARK * (out[-2] + out[-1]) in v.token_of:
            out[-2:] = [out[-2] + out[-1]]
    return [v.token_of[MARK * k] for k in out]


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """Tables of a BPE model with byte fallback, identity normalisation and a space mark before the text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    byte_of = {i: int(pieces[i][1:-1], 16) for i in range(n) if model.is_byte(i)}
    normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    runs = {i for i in normal if len(pieces[i]) > 1 and set(pieces[i]) == {MARK}}
    words = [i for i in normal if i not in runs]
    scores = {i: model.get_score(i) for i in words if len(pieces[i]) > 1}
    run_scores = {model.get_score(i) for i in runs}
    if len(set(scores.values())) < len(scores) or any(MARK in pieces[i][1:] for i in words):
        raise ValueError("the model has pieces of equal score or with a space inside")
    if len(run_scores) > 1 or (run_scores and min(scores.values()) <= max(run_scores)):
        raise ValueError("runs of spaces must merge last and have one score")
    probe = "A\u030a \u00c5 \ufb01  \u2460\u00a0x "  # what the usual normal forms and a trimming of spaces would change
    if len(byte_of) != 256 or model.decode(model.encode(probe)) != probe:
        raise ValueError("the model needs byte fallback and must not normalise")
    token_of = {pieces[i]: i for i in normal}
    order = sorted(scores, key=lambda i: -scores[i])
    rank = np.full(n + 1, -1, dtype=np.int64)
    rank[order] = np.arange(len(order))
    rank_of = {pieces[i]: int(rank[i]) for i in order}
    left, right = np.full(n + 1, -1, dtype=np.int64), np.full(n + 1, -1, dtype=np.int64)
    matched = []
    keys, ranks = [], []
    for i in words:
        p = pieces[i]
        for k in range(1, len(p)):
            a, b = token_of.get(p[:k]), token_of.get(p[k:])
            if a is not None and b is not None:
                keys.append(a * n + b)
                ranks.append(int(rank[i]))
        if len(p) > 1:
            parts = _merge(list(p), _Below(rank_of, int(rank[i])))
            if len(parts) != 2:
                continue  # no sequence of merges makes this piece
            left[i], right[i] = token_of[parts[0]], token_of[parts[1]]
        matched.append(i)
    characters = sorted({c for i in matched for c in pieces[i]})
    code_of = {c: k + 1 for k, c in enumerate(characters)}
    code_at = np.full(max(map(ord, characters)) + 2, len(characters) + 1, dtype=np.int32)
    code_at[[ord(c) for c in characters]] = np.arange(1, len(characters) + 1)
    longest = max(len(pieces[i]) for i in matched)
    codes = np.zeros((len(matched), longest), dtype=np.int64)
    for row, i in enumerate(matched):
        codes[row, : len(pieces[i])] = [code_of[c] for c in pieces[i]]
    by_key = np.argsort(np.array(keys, dtype=np.int64))
    return Vocabulary(
        pieces=pieces,
        token_of=token_of,
        byte_of=byte_of,
        tokens_of_byte=[t for t, _ in sorted(byte_of.items(), key=lambda x: x[1])],
        code_of=code_of,
        code_at=code_at,
        rank=rank,
        left=left,
        right=right,
        merge_keys=np.array(keys, dtype=np.int64)[by_key],
        merge_ranks=np.array(ranks, dtype=np.int64)[by_key],
        matched=np.array(matched, dtype=np.int64),
        lengths=np.array([len(pieces[i]) for i in matched], dtype=np.int64),
        codes=codes,
        raw=[bytes([byte_of[i]]) if i in byte_of else pieces[i].encode() for i in range(n)],
    )


class _Below:
    """Ranks below a limit, without a copy of the table."""

    def __init__(self, rank_of: dict[str, int], limit: int):
        self.rank_of, self.limit = rank_of, limit

    def get(self, piece: str, default: int) -> int:
        rank = self.rank_of.get(piece, default)
        return rank if rank < self.limit else default


def stands(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether BPE leaves the tokens a, b side by side.

    Merges are undone, the latest first. What then touches across the border must not make a piece that comes before
    the merge just undone, for BPE would have made that piece instead.
    """
    ok = np.ones(len(a), dtype=bool)
    live = np.arange(len(a))
    limit = np.full(len(a), 1 << 60, dtype=np.int64)
    a, b = a.copy(), b.copy()
    n = len(v.pieces)
    while len(live):
        x, y = a[live], b[live]
        key = x * n + y
        at = np.minimum(np.searchsorted(v.merge_keys, key), len(v.merge_keys) - 1)
        broken = (v.merge_keys[at] == key) & (v.merge_ranks[at] < limit[live])
        ok[live[broken]] = False
        rx, ry = v.rank[x], v.rank[y]
        more = ~broken & (np.maximum(rx, ry) >= 0)
        live, x, y, rx, ry = live[more], x[more], y[more], rx[more], ry[more]
        first = rx > ry  # of two equal merges the right one is the later
        limit[live] = np.where(first, rx, ry + 1)  # an equal piece on the left would have come before b
        a[live] = np.where(first, v.right[x], x)
        b[live] = np.where(first, y, v.left[y])
    return ok


class Pairs:
    """Answers of ``stands``; a slot keeps that of the last pair that came to it, so a pair in use is worked out seldom."""

    BITS = 20
    SPREAD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, v: Vocabulary):
        self.v, self.held = v, np.full(1 << self.BITS, -1, dtype=np.int64)  # twice the pair's key, and its answer

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * len(self.v.pieces) + b
        slot = (key.astype(np.uint64) * self.SPREAD) >> np.uint64(64 - self.BITS)
        held = self.held[slot]
        out = (held & 1).astype(bool)
        missing = np.flatnonzero(held >> 1 != key)
        if len(missing):
            new, inverse = np.unique(key[missing], return_inverse=True)
            found = stands(self.v, new // len(self.v.pieces), new % len(self.v.pieces))
            out[missing] = found[inverse]
            self.held[slot[missing]] = 2 * key[missing] + out[missing]
        return out


def edges(v: Vocabulary, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, row of ``v.matched``) of every occurrence of a piece in the coded text."""
    bits = int(v.codes.max()).bit_length() + 1
    per = 62 // bits
    levels = -(-v.codes.shape[1] // per)
    padded = np.concatenate([text, np.zeros(per * levels, dtype=np.int64)])
    window = np.zeros(len(padded), dtype=np.int64)  # per characters from each place on, as one number
    for j in range(per):
        window = (window << bits) | np.concatenate([padded[j:], np.zeros(j, dtype=np.int64)])
    # Suffixes by their first per * levels characters: sort by one window, then by (rank, rank of what follows).
    suffixes = np.argsort(window[: len(text)])
    size, span = per, 1
    while span < levels:
        sorted_rank = np.zeros(len(padded) + per * levels, dtype=np.int64)
        key = window[suffixes] if span == 1 else combined[suffixes]
        new = np.ones(len(key), dtype=np.int64)
        new[1:] = key[1:] != key[:-1]
        sorted_rank[suffixes] = np.cumsum(new)
        combined = sorted_rank[: len(text)] * (len(text) + 2) + sorted_rank[size : size + len(text)]
        suffixes = np.argsort(combined)
        size, span = size * 2, span * 2
    piece = np.zeros((len(v.codes), per * levels), dtype=np.int64)
    piece[:, : v.codes.shape[1]] = v.codes
    low = np.zeros(len(piece), dtype=np.int64)
    high = np.full(len(piece), len(text), dtype=np.int64)
    for level in range(levels):
        value = window[suffixes + level * per]
        used = np.clip(v.lengths - level * per, 0, per)
        first = np.zeros(len(piece), dtype=np.int64)
        for j in range(per):
            first = (first << bits) | piece[:, level * per + j]
        last = first | ((np.int64(1) << (bits * (per - used))) - 1)
        low, high = _bisect(value, low, high, first, False), _bisect(value, low, high, last, True)
    n = np.maximum(high - low, 0)
    row = np.repeat(np.arange(len(piece)), n)
    at = np.arange(n.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    return suffixes[at], row


def _bisect(values: np.ndarray, low: np.ndarray, high: np.ndarray, target: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of each target within its own range of ``values``."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) // 2
        x = values[np.minimum(middle, len(values) - 1)]
        go = open_ & ((x <= target) if after else (x < target))
        low = np.where(go, middle + 1, low)
        high = np.where(open_ & ~go, middle, high)


def _order(offset: np.ndarray, length: np.ndarray) -> np.ndarray:
    key = offset * (int(length.max(initial=0)) + 1) + length
    if key.max(initial=0) < 1 << 16:
        key = key.astype(np.uint16)  # sorted by digits
    return np.argsort(key, kind="stable")


def encode_words(v: Vocabulary, words: list[str], pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each word, joined, and their bounds; a character outside the vocabulary is UNKNOWN_CHAR."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    raw = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])  # a separator after each word
    coded = v.code_at[np.minimum(raw, len(v.code_at) - 1)]
    strange = coded > len(v.code_of)
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(raw)) + word  # in the text with separators
    text = np.zeros(int(first[-1]), dtype=np.int64)
    text[place] = coded
    start, row = edges(v, text)
    token, end = v.matched[row], start + v.lengths[row]
    odd = place[strange]
    start, end = np.concatenate([start, odd]), np.concatenate([end, odd + 1])
    token = np.concatenate([token, np.full(len(odd), UNKNOWN_CHAR)])
    word_at = np.zeros(len(text) + 1, dtype=np.int64)
    word_at[place] = first[word]
    offset = end - word_at[start]
    order = _order(offset, end - start)  # by place in the word, the longest last
    start, end, token, offset = start[order], end[order], token[order], offset[order]
    last = np.full(len(text) + 1, START, dtype=np.int64)  # last token of the word up to here, and where it starts
    back = np.full(len(text) + 1, -1, dtype=np.int64)
    steps = np.searchsorted(offset, np.arange(1, (offset.max() if len(offset) else 0) + 2))
    for low, high in zip(steps[:-1], steps[1:]):
        s, e, t = start[low:high], end[low:high], token[low:high]
        before = np.where(s == word_at[s], START, last[s])
        free = (before < 0) | (t < 0)
        good = free.copy()
        if not free.all():
            good[~free] = pairs(before[~free], t[~free])
        s, e, t = s[good], e[good], t[good]
        last[e], back[e] = t, s
    # Walk all words back at once.
    at = first[:-1] + sizes
    live = np.flatnonzero(sizes > 0)
    found = []
    while len(live):
        found.append((live, last[at[live]]))
        at[live] = back[at[live]]
        live = live[at[live] > first[live]]
    bounds = np.zeros(len(words) + 1, dtype=np.int64)
    for live, _ in found:
        bounds[live + 1] += 1
    bounds = np.cumsum(bounds)
    tokens = np.zeros(bounds[-1], dtype=np.int64)
    for n, (live, token) in enumerate(found, 1):
        tokens[bounds[live + 1] - n] = token
    return tokens, bounds


_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Encoder:
    """Encodes batches of texts. Keeps pair answers and the tokens of the first WORDS words for later batches."""

    WORDS = 200_000

    def __init__(self, v: Vocabulary):
        self.v, self.pairs = v, Pairs(v)
        self.index: dict[str, int] = {}
        self.tokens, self.bounds = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts, joined, and their bounds."""
        cut = [_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        index = self.index
        new = [w for w in dict.fromkeys(chain.from_iterable(cut)) if w not in index]
        parts = [self._words([w for _, w in part]) for part in _batches(zip(new, new), INDEX_CHARS)]
        sizes = np.concatenate([np.diff(b) for _, b in parts]) if parts else np.zeros(0, dtype=np.int64)
        tokens = np.concatenate([t for t, _ in parts]) if parts else self.tokens[:0]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        index.update(zip(new, range(len(index), len(index) + len(new))))
        tokens = np.concatenate([self.tokens, tokens])
        bounds = np.concatenate([self.bounds, self.bounds[-1] + bounds[1:]])
        words = np.fromiter(map(index.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=sum(map(len, cut)))
        sizes = np.diff(bounds)[words]
        before = np.concatenate([[0], np.cumsum(sizes)])
        out = tokens[np.arange(before[-1]) + np.repeat(bounds[words] - before[:-1], sizes)]
        text_bounds = before[np.concatenate([[0], np.cumsum([len(c) for c in cut], dtype=np.int64)])]
        if len(index) <= self.WORDS:
            self.tokens, self.bounds = tokens, bounds
        else:
            for w in new:
                del index[w]
        return out, text_bounds

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        v, mark = self.v, self.v.token_of[MARK]
        bare = [w if w[1:2] not in ("", MARK) else MARK + r if (r := w.lstrip(MARK)) else "" for w in words]
        tokens, bounds = encode_words(v, bare, self.pairs)
        odd = set(np.flatnonzero(np.add.reduceat(np.append(tokens == UNKNOWN_CHAR, 0), bounds[:-1]) * (np.diff(bounds) > 0)).tolist()) if words else set()
        odd.update(i for i, w in enumerate(words) if w[1:2] in ("", MARK))
        if not odd:
            return tokens.astype(np.int32), bounds
        parts, done = [], 0
        sizes = np.diff(bounds)
        for i in sorted(odd):
            parts.append(tokens[bounds[done] : bounds[i]])
            own = tokens[bounds[i] : bounds[i + 1]].tolist()
            marks = len(words[i]) - len(words[i].lstrip(MARK))
            if own and own[0] != mark:
                marks -= 1  # one went into the first piece
            elif own:
                own = own[1:]
            own = v.run(marks) + self._bytes(words[i].lstrip(MARK), own)
            parts.append(np.array(own, dtype=np.int64))
            sizes[i], done = len(own), i + 1
        parts.append(tokens[bounds[done] :])
        return np.concatenate(parts).astype(np.int32), np.concatenate([[0], np.cumsum(sizes)])

    def _bytes(self, word: str, own: list[int]) -> list[int]:
        """Characters outside the vocabulary become the tokens of their UTF-8 bytes."""
        odd = iter([c for c in word if c not in self.v.code_of])
        out: list[int] = []
        for t in own:
            if t == UNKNOWN_CHAR:
                out += [self.v.tokens_of_byte[b] for b in next(odd).encode("utf-8", "surrogatepass")]
            else:
                out.append(t)
        return out


def decode(v: Vocabulary, ids: list[int]) -> str:
    """Text of a token sequence: byte tokens are joined as UTF-8, the first space mark is not part of the text."""
    out = b"".join([v.raw[t] for t in ids])
    text = out.decode("utf-8", "surrogatepass").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def _batches(rows: Iterator[tuple], limit: int) -> Iterator[list[tuple]]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[-1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", model: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded_ok) of each row's whole text.

    A null or empty text has no tokens. Rows that repeat an id or have none are rows like others; a very long text is a
    batch of its own; an empty table gives no rows; columns named in ``keep`` go along. ``decoded_ok`` says that decoding gives the text back; the space mark U+2581
    itself is read as a space. ``model`` is the path of the vocabulary file, read on the driver only; its tables (tens
    of thousands of pieces) go to the tasks.
    """
    v = load(model or default_model())
    shared = docs.sparkSession.sparkContext.broadcast(v)
    names = ["doc_id", "ids", "n_tokens", "decoded_ok", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts, at = [t or "" for t in batch["text"].to_pylist()], 0
            for held in _batches(((t,) for t in texts), BATCH_CHARS):
                held = [t for t, in held]
                ids, bounds = encoder(held)
                good = [
                    decode(encoder.v, ids[a:b].tolist()) == t.replace(MARK, " ") for a, b, t in zip(bounds[:-1], bounds[1:], held)
                ]
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                rows = batch.slice(at, len(held))
                columns = [rows["doc_id"], lists, pa.array(np.diff(bounds), pa.int64()), pa.array(good, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*columns, *(rows[f"k{i}"] for i in range(len(keep)))], names=names)
                at += len(held)

    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *kept)
    types = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, "doc_id BIGINT, ids ARRAY<INT>, n_tokens BIGINT, decoded_ok BOOLEAN" + types)
