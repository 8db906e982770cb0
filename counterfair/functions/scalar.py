"""Column functions. Everything here stays inside the JVM."""

from __future__ import annotations

import math
from functools import reduce
from zlib import crc32

from pyspark.sql import Column
from pyspark.sql import functions as F


def q(name: str) -> Column:
    """Column by exact name, dots included."""
    return F.col(f"`{name}`")


def fixed(col: Column, digits: int) -> Column:
    """Half-up rounding by one multiply and one floor (``round`` on doubles goes through decimals)."""
    scale = float(10**digits)
    return F.floor(col * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def score_bin(p: Column, eps: float = 0.025) -> Column:
    """Index of the last edge ``i * eps`` that is <= p, edges covering [0, 1).

    ``floor(p / eps)`` is at most one off, so it is corrected against the two neighbouring edges.
    """
    last = math.ceil(round(1.0 / eps, 9)) - 1
    guess = F.floor(p / F.lit(eps)).cast("int")
    step = F.lit(eps)
    exact = guess + F.when((guess + 1) * step <= p, 1).when(guess * step > p, -1).otherwise(0)
    return F.least(exact, F.lit(last)).cast("int")


def softmax(values: Column) -> Column:
    """Softmax of an array, shifted by its maximum."""
    top = F.array_max(values)
    exps = F.transform(values, lambda v: F.exp(v - top))
    total = F.aggregate(exps, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(exps, lambda v: v / total)


def l1_mean(a: Column, b: Column) -> Column:
    """Mean absolute difference of two equally long arrays."""
    diffs = F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double"))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, v: acc + v) / F.size(a)


def argmax_index(values: Column) -> Column:
    """Zero-based index of the largest element, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def sign_move(grad: Column, other: Column, movable: Column) -> Column:
    """Step of the global search: the sign of ``grad`` where both gradients agree.

    An all-zero side lends the other side's signs as the mask; protected positions
    (``movable`` = 0) never move.
    """
    s = F.transform(grad, lambda g: F.signum(g))
    n = F.transform(other, lambda g: F.signum(g))
    agree = F.zip_with(s, n, lambda a, b: (a == b).cast("double"))
    zero_s = ~F.exists(s, lambda v: v != 0)
    zero_n = ~F.exists(n, lambda v: v != 0)
    mask = F.when(zero_s, n).when(zero_n, s).otherwise(agree)
    moved = F.zip_with(s, mask, lambda a, b: a * b)
    return F.zip_with(moved, movable, lambda a, m: a * m)


def inverse_gradient_prob(grad: Column, other: Column, movable: Column) -> Column:
    """Choice probabilities proportional to 1 / (|g| + |g'|) over movable positions.

    Uniform over movable positions when a weight is infinite on every side or nothing is finite.
    """
    weights = F.zip_with(
        F.zip_with(grad, other, lambda a, b: F.abs(a) + F.abs(b)),
        movable,
        lambda g, m: F.when(m == 0, F.lit(0.0)).when(g == 0, F.lit(math.inf)).otherwise(F.lit(1.0) / g),
    )
    total = F.aggregate(weights, F.lit(0.0), lambda acc, v: acc + v)
    count = F.aggregate(movable, F.lit(0.0), lambda acc, v: acc + v)
    usable = (total > 0) & (total < F.lit(math.inf))
    return F.when(usable, F.transform(weights, lambda w: w / total)).otherwise(
        F.transform(movable, lambda m: m / count)
    )


def hash_int(*parts: Column) -> Column:
    """32-bit integer from an md5 digest: the same on every engine, run and retry."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_unit(*parts: Column) -> Column:
    """Uniform number in [0, 1) from ``hash_int``."""
    return hash_int(*parts) / F.lit(4294967296.0)


MIX = 739982445  # odd and below 2^30, so that products of 32-bit words stay within 64 bits
WORD = 0xFFFFFFFF


def mix_int(tag: str, *parts: Column) -> Column:
    """32-bit integer mixed from whole numbers by multiply and xor-shift rounds, one per 32-bit word.

    For choices counted by step: unlike ``hash_int`` it has an array form (``mixed_numbers``), and needs no text.
    """
    longs = [p.cast("bigint") for p in parts]
    words = [w for p in longs for w in (p.bitwiseAND(F.lit(WORD)), F.shiftright(p, 32).bitwiseAND(F.lit(WORD)))]

    def mixed(state: Column, word: Column) -> Column:
        product = (state.bitwiseXOR(word) * F.lit(MIX)).bitwiseAND(F.lit(WORD))
        return product.bitwiseXOR(F.shiftright(product, 15))

    zero = F.lit(0).cast("bigint")
    return F.aggregate(F.array(*words, zero, zero), F.lit(crc32(tag.encode())).cast("bigint"), mixed)


def mix_unit(tag: str, *parts: Column) -> Column:
    """Uniform number in [0, 1) from ``mix_int``."""
    return mix_int(tag, *parts) / F.lit(4294967296.0)


def mixed_state(state, part):
    """Array form of the rounds of ``mix_int`` over one part; the first state is a tag's ``crc32``."""
    for word in (part & WORD, (part >> 32) & WORD):
        product = ((state ^ word) * MIX) & WORD
        state = product ^ (product >> 15)
    return state


def mixed_numbers(state, part):
    """Array form of ``mix_int``: the state before the last part, and that part."""
    return mixed_state(mixed_state(state, part), 0)


def weighted_choice(probs: Column, unit: Column) -> Column:
    """Zero-based index whose cumulative probability first exceeds ``unit``."""
    start = F.struct(F.lit(0.0).alias("acc"), F.lit(-1).alias("idx"), F.lit(0).alias("pos"))
    total = F.aggregate(probs, F.lit(0.0), lambda acc, v: acc + v)
    target = unit * total

    def step(state, v):
        acc = state["acc"] + v
        hit = (state["idx"] < 0) & (v > 0) & (acc > target)
        return F.struct(
            acc.alias("acc"),
            F.when(hit, state["pos"]).otherwise(state["idx"]).alias("idx"),
            (state["pos"] + 1).alias("pos"),
        )

    return F.aggregate(probs, start, step, lambda s: s["idx"])


def substring_distance(pattern: Column, text: Column) -> Column:
    """Fewest edits that turn ``pattern`` into some substring of ``text`` (the empty one included)."""
    size = F.length(text)
    pieces = F.flatten(
        F.transform(
            F.sequence(F.lit(1), size),
            lambda i: F.transform(F.sequence(i, size), lambda j: F.substr(text, i, j - i + 1)),
        )
    )
    best = F.array_min(F.transform(pieces, lambda s: F.levenshtein(pattern, s)))
    return F.when(size == 0, F.length(pattern)).otherwise(F.least(best, F.length(pattern)))


def fuzzy_closest(value: Column, choices: Column, max_errors: int = 10) -> Column:
    """Choice with the fewest edits, the first on ties; NULL when none is within ``max_errors``."""
    ranked = F.transform(
        choices,
        lambda c, i: F.struct(substring_distance(value, c).alias("d"), i.alias("i"), c.alias("c")),
    )
    best = F.array_min(ranked)
    return F.when(best["d"] <= max_errors, best["c"])


def too_similar(original: Column, answer: Column, max_errors: int = 2) -> Column:
    """True when some prefix of ``answer`` is within ``max_errors`` edits of ``original``.

    A prefix that is longer than the original by more than ``max_errors`` cannot be, so a long answer
    costs no more than a short one.
    """
    longest = F.least(F.length(answer), F.length(original) + max_errors)
    distances = F.transform(
        F.sequence(F.lit(0), longest),
        lambda i: F.levenshtein(original, F.substr(answer, F.lit(1), i)),
    )
    return F.array_min(distances) <= max_errors


def is_json_object(text: Column) -> Column:
    """True when the whole text is one JSON object, by the strict grammar.

    Spark's JSON functions stop at the end of the first value and take single quotes; inside an array the
    text must parse strictly and be exactly one element.
    """
    listed = F.concat(F.lit("["), text, F.lit("]"))
    one = F.try_parse_json(listed).isNotNull() & (F.json_array_length(listed) == 1)
    return F.coalesce(one & F.json_object_keys(text).isNotNull(), F.lit(False))


def has_all_keys(json_text: Column, required: list[str]) -> Column:
    """True when the JSON object holds every required key; false for anything else."""
    keys = F.when(is_json_object(json_text), F.json_object_keys(json_text))
    missing = F.size(F.array_except(F.array(*[F.lit(k) for k in required]), keys))
    return F.coalesce(missing == 0, F.lit(False))


def json_parse_status(text: Column) -> Column:
    """``ok`` for a JSON object, ``format_error`` for other text, ``other_error`` for no answer."""
    return (
        F.when(text.isNull(), F.lit("other_error"))
        .when(~is_json_object(text), F.lit("format_error"))
        .otherwise(F.lit("ok"))
    )


def json_scalar(col: Column) -> Column:
    """One JSON value: a number when the text is a whole number, otherwise a quoted string."""
    text = col.cast("string")
    quoted = F.to_json(F.array(text))
    bare = F.regexp_extract(quoted, r"(?s)^\[(.*)\]$", 1)
    return F.when(text.rlike(r"^-?(0|[1-9][0-9]*)$"), text).otherwise(bare)


def format_request(columns: list[str], protected: list[str]) -> Column:
    """Row as a JSON request: whole numbers bare, the rest quoted, plus the requested attributes."""
    fields = [F.concat(F.lit(f'"{c}":'), json_scalar(q(c))) for c in columns]
    fields.append(F.lit(f'"Counterfactual.request":"{",".join(protected)}"'))
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def path_part(path: Column, position: int) -> Column:
    """One part of a path; negative positions count from the end."""
    return F.element_at(F.split(path, "/"), position)


def clipped(col: Column, lo, hi) -> Column:
    """Value held within the limits; NULL stays NULL (``greatest`` and ``least`` skip it)."""
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(lo)), F.lit(hi)))


def number(text: Column) -> Column:
    """The number a text stands for, NULL for any other text; '1d' and '2f' are not numbers."""
    plain = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:nan|inf|infinity))\s*$"
    return F.when(text.rlike(plain), text.try_cast("double"))


def sum_columns(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)
