"""Discrimination searches as set-at-a-time rounds over a frontier of all seeds.

One round advances every seed by one move. Rounds are narrow wherever the next move of a seed does
not depend on other seeds; the shuffle by masked key happens once per round or once at the end. The
frontier is checkpointed each round, so plans stay short and a lost executor restarts one round. Paths that depend on
other seeds only by where they end are walked first and matched afterwards; walkers that share probabilities walk together.
All choices come from hashes of (seed, step), never from a task's random state: md5 where the JVM works them out, mixed
integers where walkers take thousands of steps inside a task.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from counterfair.functions.scalar import (
    clipped,
    fixed,
    hash_int,
    inverse_gradient_prob,
    mix_int,
    mix_unit,
    mixed_numbers,
    mixed_state,
    q,
    sign_move,
    weighted_choice,
)
from counterfair.operators import metrics, picks
from counterfair.operators.expand import Domain
from counterfair.operators.joins import not_seen
from counterfair.operators.prepare import column_difference, mask_protected, union_tables
from counterfair.operators.score import (
    MATRIX_ROWS,
    array_udf,
    row_metrics,
    score_bins,
    variant_bins,
    variant_probabilities,
    variant_scores,
)
from counterfair.session import cut_lineage


@dataclass(frozen=True)
class SearchSpace:
    """Features with their bounds, and which of them are protected."""

    bounds: dict[str, tuple[int, int]]
    protected: tuple[str, ...]
    eps: float = 0.025
    salt: int = 0

    @property
    def features(self) -> list[str]:
        return list(self.bounds)

    @property
    def free(self) -> list[str]:
        return column_difference(self.features, list(self.protected))

    @property
    def domain(self) -> Domain:
        return Domain.of({p: self.bounds[p] for p in self.protected})

    def movable(self) -> Column:
        return F.array(*[F.lit(0.0 if f in self.protected else 1.0) for f in self.features])

    def key(self) -> list[str]:
        return self.free

    def clip(self, name: str, value: Column) -> Column:
        lo, hi = self.bounds[name]
        return clipped(value, lo, hi).cast("int")


def _hash_parts(space: SearchSpace, *names: str) -> list[Column]:
    return [F.lit(space.salt), *[F.col(n) for n in names]]


def _nonzero_move(df: DataFrame, move: Column, space: SearchSpace, parts: list[Column]) -> DataFrame:
    """Adds ``_move``: the given one, or where that is zero one hashed free feature, up or down."""
    at = F.element_at(
        F.array(*[F.lit(space.features.index(f)) for f in space.free]),
        (hash_int(F.lit("feature"), *parts) % len(space.free)).cast("int") + 1,
    )
    sign = F.when(hash_int(F.lit("sign"), *parts) % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    known = picks.pinned(df, {"_move": move, "_at": at, "_sign": sign})
    places = F.sequence(F.lit(0), F.lit(len(space.features) - 1))
    other = F.transform(places, lambda i: F.when(i == F.col("_at"), F.col("_sign")).otherwise(F.lit(0.0)))
    chosen = F.when(F.exists("_move", lambda v: v != 0), F.col("_move")).otherwise(other)
    return picks.pinned(known, {"_move": chosen}).drop("_at", "_sign")


def _apply_move(df: DataFrame, space: SearchSpace, move: str) -> DataFrame:
    return df.withColumns(
        {f: space.clip(f, q(f) + F.element_at(move, i + 1)) for i, f in enumerate(space.features)}
    )


def _pair_gradients(df: DataFrame, model, space: SearchSpace, partner: dict[str, Column]) -> DataFrame:
    """Gradients at the row and at the row with its protected values replaced by the partner's."""
    twins = {f"_t_{p}": c for p, c in partner.items()}
    other = [f"_t_{f}" if f in space.protected else f for f in space.features]
    return df.withColumns(twins).withColumns(
        {"grad": array_udf(model.gradient, space.features), "grad_twin": array_udf(model.gradient, other)}
    )


def search_step(frontier: DataFrame, model, space: SearchSpace) -> DataFrame:
    """One global round: score, pick, record and the next position (``next_…``) of every seed.

    Columns in: seed_id, step, features. Adds k, spread, low and high picks for the local search.
    """
    parts = _hash_parts(space, "seed_id", "step")
    picked = picks.partition_picks(frontier, model, space.domain, space.eps, *parts)
    domain = space.domain
    moved = picked.withColumns({p: domain.value(p, F.col("member")) for p in space.protected})
    twins = {p: domain.value(p, F.col("partner")) for p in space.protected}
    graded = _pair_gradients(moved, model, space, twins)
    move = sign_move(F.col("grad"), F.col("grad_twin"), space.movable())
    stepped = _nonzero_move(graded, move, space, parts)
    nexts = {
        f"next_{f}": space.clip(f, q(f) + F.element_at("_move", i + 1)) for i, f in enumerate(space.features)
    }
    return stepped.withColumns(nexts).drop("grad", "grad_twin", "_move", *[f"_t_{p}" for p in space.protected])


def _trials(df: DataFrame) -> list[str]:
    return ["trial"] if "trial" in df.columns else []


def _salt(df: DataFrame, space: SearchSpace) -> Column:
    """Salt of a row's choices: its trial's number further than that of the space."""
    return F.lit(space.salt) + F.col("trial") if _trials(df) else F.lit(space.salt)


TAGS = (*picks.PICKS[2:], "feature", "sign")


def _agreeing_move(grad: np.ndarray, twin: np.ndarray, movable: np.ndarray) -> np.ndarray:
    """Array form of ``functions.scalar.sign_move``."""
    mine, theirs = np.sign(grad), np.sign(twin)
    mask = np.where(theirs.any(axis=1)[:, None], mine == theirs, mine)
    return mine * mask * movable


def search_paths(seeds: DataFrame, model, space: SearchSpace, max_iter: int, began: float) -> DataFrame:
    """All positions of all seeds, one row per ``search_step``: the same moves as repeating that step.

    The hashes of every step are known beforehand and come from the JVM; the path itself is one Arrow pass
    without checkpoints. A seed with a NULL feature has no path. A column ``trial`` sets seeds of other trials apart.
    """
    trials, salt = _trials(seeds), _salt(seeds, space)
    features, domain, steps = space.features, space.domain, max_iter + 1
    slots = [features.index(p) for p in domain.names]
    free = np.array([features.index(f) for f in space.free])
    movable = np.array([0.0 if f in space.protected else 1.0 for f in features])
    low, high = (np.array([space.bounds[f][i] for f in features], dtype=float) for i in (0, 1))
    seed_id = F.col("seed_id").cast("bigint")
    hashes = [hash_int(F.lit(t), salt, seed_id, F.lit(n)) for n in range(steps) for t in TAGS]
    known = seeds.dropna(subset=features)
    start = known.select(*trials, seed_id.alias("seed_id"), *[q(f).cast("double").alias(f) for f in features], F.array(*hashes).alias("_h"))
    ints = ["k", "spread", "member", "partner", "low", "high"]
    numbers = ["step", *features, *ints]
    names = [*trials, "seed_id", *numbers, "elapsed"]
    schema = "".join(f"{t} INT, " for t in trials) + "seed_id BIGINT, " + ", ".join(f"`{c}` INT" for c in numbers) + ", elapsed DOUBLE"

    def walk(batches):
        grid = domain.grid()
        for batch in batches:
            piece = max(1, MATRIX_ROWS // len(grid))
            for at in range(0, batch.num_rows, piece):
                rows = batch.slice(at, piece)
                x = np.column_stack([rows.column(f).to_numpy(zero_copy_only=False) for f in features]).astype(float)
                h = rows.column("_h").flatten().to_numpy(zero_copy_only=False).reshape(len(x), steps, len(TAGS))
                for n in range(steps):
                    picked = picks.pick_variants(score_bins(variant_scores(x, features, model, domain), space.eps), h[:, n])
                    twin = x.copy()
                    x[:, slots], twin[:, slots] = grid[picked[:, 2]], grid[picked[:, 3]]
                    columns = [*[rows.column(c) for c in (*trials, "seed_id")], pa.array(np.full(len(x), n), pa.int32())]
                    columns += [pa.array(v.astype(np.int32)) for v in (*x.T, *picked.T)]
                    columns.append(pa.array(np.full(len(x), time.time() - began)))
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    move = _agreeing_move(model.gradient(x), model.gradient(twin), movable)
                    still = np.flatnonzero(~move.any(axis=1))
                    move[still, free[h[still, n, 4] % len(free)]] = np.where(h[still, n, 5] % 2 == 0, 1.0, -1.0)
                    x = np.clip(x + move, low, high)

    return start.mapInArrow(walk, schema)


def global_search(
    seeds: DataFrame, model, space: SearchSpace, max_iter: int = 10, local_rounds: int = 0
) -> DataFrame:
    """Found rows (phase, seed_id, step, features, k, spread, elapsed), unique by masked key.

    A seed's path does not depend on what others found, so all its rounds are one narrow pass; duplicates
    are removed once, keeping the earliest (step, seed). ``elapsed`` is when a task reached the position.
    Seeds with a column ``trial`` are searched trial by trial in the same pass: finds are unique within a trial.
    """
    key = [*_trials(seeds), *space.key()]
    began = time.time()
    paths = search_paths(seeds, model, space, max_iter, began)
    unique = not_seen(paths, key, ["step", "seed_id"])
    found = _found(unique, space, "global")
    if not local_rounds:
        return found
    unique = cut_lineage(unique)
    starts = unique.filter(F.col("k") >= 2)
    local = local_search(local_starts(starts, space), model, space, local_rounds, began)
    fresh = not_seen(local, key, ["step", "seed_id"], unique)
    return _found(unique, space, "global").unionByName(_found(fresh, space, "local"))


def _found(rows: DataFrame, space: SearchSpace, phase: str) -> DataFrame:
    masked = mask_protected(rows, list(space.protected))
    return masked.select(
        *_trials(rows), F.lit(phase).alias("phase"), "seed_id", "step", *[q(f) for f in space.features], "k", "spread", "elapsed"
    )


def rescored(found: DataFrame, seeds: DataFrame, model, space: SearchSpace) -> DataFrame:
    """Found rows of ``global_search`` as ``metrics.search_report`` takes them.

    Every find is scored again under all protected values (k, spread, sh_entropy, min_entropy, disc);
    ``init_k`` is the K of the seed it came from. A seed leads to a few finds per round at most.
    """
    measured = row_metrics(found.drop("k", "spread"), model, space.domain, space.eps)
    first = row_metrics(seeds.select("seed_id", *[q(f) for f in space.features]), model, space.domain, space.eps)
    starts = first.select(F.col("seed_id").cast("bigint").alias("seed_id"), F.col("k").alias("init_k"))
    disc = metrics.discriminatory_score(F.col("p_min"), F.col("p_max"))
    judged = measured.withColumns(
        {"disc": disc, "sh_entropy": fixed(F.abs("sh_entropy"), 6), "min_entropy": metrics.min_entropy(F.col("k"))}
    )
    return judged.drop("p_min", "p_max").join(starts, "seed_id")


def search_trials(
    seeds: DataFrame, model, space: SearchSpace, trials: int, max_iter: int = 10, local_rounds: int = 0
) -> DataFrame:
    """Finds of ``trials`` repetitions of ``global_search`` with other choices, scored again; a column ``trial`` counts from 0.

    One search over all trials' seeds, not one after the other. The result is what ``metrics.search_report`` takes
    by trial, and ``metrics.mean_std_over_trials`` after it. No seeds or no trials give no rows.
    """
    numbers = F.array(*[F.lit(t) for t in range(trials)]).cast("array<int>")
    repeated = seeds.drop("trial").withColumn("trial", F.explode(numbers))
    return rescored(global_search(repeated, model, space, max_iter, local_rounds), seeds, model, space)


def local_starts(found: DataFrame, space: SearchSpace) -> DataFrame:
    """Walkers of the local search: the row under its lowest-bin values, the highest-bin values as twin."""
    domain = space.domain
    return found.select(
        *_trials(found),
        "seed_id",
        F.col("step").alias("origin"),
        "spread",
        *[
            domain.value(f, F.col("low")).alias(f) if f in space.protected else q(f)
            for f in space.features
        ],
        *[domain.value(p, F.col("high")).alias(f"_t_{p}") for p in space.protected],
    )


def _drawn_feature(df: DataFrame, probs: Column, parts: list[Column]) -> DataFrame:
    """Adds ``_at``, the index of the feature to move."""
    drawn = weighted_choice(F.col("_p"), mix_unit("feature", *parts))
    return picks.pinned(picks.pinned(df, {"_p": probs}), {"_at": drawn}).drop("_p")


def local_step(walkers: DataFrame, model, space: SearchSpace, step: int) -> DataFrame:
    """One local round: every walker tries one feature, one step up or down.

    The feature is drawn with probability inverse to its gradient. ``try_…`` is the position tried;
    the walker keeps it when the bin spread did not drop, or with probability exp(drop) otherwise.
    """
    parts = [F.lit(space.salt), F.col("seed_id"), F.col("origin"), F.lit(step)]
    twins = {p: F.col(f"_t_{p}") for p in space.protected}
    graded = _pair_gradients(walkers, model, space, twins)
    probs = inverse_gradient_prob(F.col("grad"), F.col("grad_twin"), space.movable())
    sign = F.when(mix_int("sign", *parts) % 2 == 0, F.lit(1)).otherwise(F.lit(-1))
    chosen = _drawn_feature(graded, probs, parts)
    tried = chosen.withColumns(
        {
            f"try_{f}": space.clip(f, q(f) + F.when(F.col("_at") == i, sign).otherwise(F.lit(0)))
            for i, f in enumerate(space.features)
        }
    )
    probe = tried.drop("grad", "grad_twin", "_at", "k").withColumnRenamed("spread", "_spread")
    names = {f: f"_at_{f}" for f in space.features}
    at_try = probe.withColumnsRenamed(names).withColumnsRenamed({f"try_{f}": f for f in space.features})
    ends = {"k": F.size(F.array_distinct("bins")), "spread": F.array_max("bins") - F.array_min("bins")}
    scored = variant_bins(at_try, model, space.domain, space.eps).withColumns(ends).drop("bins")
    accept = (F.col("spread") >= F.col("_spread")) | (
        mix_unit("accept", *parts) < F.exp((F.col("spread") - F.col("_spread")).cast("double"))
    )
    return scored.withColumn("_keep", accept)


def _drawn_features(grad: np.ndarray, twin: np.ndarray, movable: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Array form of ``inverse_gradient_prob`` and ``weighted_choice``: the feature each walker moves, or -1."""
    size = np.abs(grad) + np.abs(twin)
    with np.errstate(divide="ignore", invalid="ignore"):
        weights = np.where(movable == 0, 0.0, 1.0 / size)
        total = np.cumsum(weights, axis=1)[:, -1:]
        probs = np.where((total > 0) & (total < math.inf), weights / total, movable / movable.sum())
    upto = np.cumsum(probs, axis=1)
    hit = (probs > 0) & (upto > unit[:, None] * upto[:, -1:])
    return np.where(hit.any(axis=1), hit.argmax(axis=1), -1)


# In the place of the round that a local walker starts from: walks of the single-attribute searches.
LOCAL, WALK = -1, -2


def _heads(tags: tuple[str, ...], salt, ids: np.ndarray, origin) -> dict[str, np.ndarray]:
    """Mixed states of each tag's choices by walker; what is missing is the step."""
    return {t: mixed_state(mixed_state(mixed_state(crc32(t.encode()), salt), ids), origin) for t in tags}


def walk_paths(starts: DataFrame, space: SearchSpace, middle: Column, twins: dict[str, Column], gain: Column, rounds: int, pair, judge, fields: str, began: float) -> DataFrame:
    """All rounds of all walkers in one Arrow pass: the positions tried, with the ``fields`` that ``judge`` gives them.

    A walker's path does not depend on other walkers. ``pair(x, twin)`` gives both gradients; the last column of
    ``judge(x)`` is what a walker wants to keep, ``gain`` its value at the start. A position where it drops is
    kept with probability exp(drop). Of equal masked keys of a trial in a batch only the earliest (step, seed) is returned.
    """
    trials = _trials(starts)
    features = space.features
    slots, partners = [features.index(p) for p in twins], [f"_t_{p}" for p in twins]
    free = [features.index(f) for f in space.free]
    movable = np.array([0.0 if f in space.protected else 1.0 for f in features])
    low, high = (np.array([space.bounds[f][i] for f in features], dtype=float) for i in (0, 1))
    start = starts.select(
        *trials,
        F.col("seed_id").cast("bigint").alias("seed_id"),
        _salt(starts, space).cast("bigint").alias("_salt"),
        middle.cast("bigint").alias("_origin"),
        *[q(f).cast("double").alias(f) for f in features],
        *[c.cast("double").alias(f"_t_{p}") for p, c in twins.items()],
        gain.cast("bigint").alias("_gain"),
    )
    parts = int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [*trials, "seed_id", "step", *features, *[f.split()[0] for f in fields.split(", ")], "elapsed"]
    schema = "".join(f"{t} INT, " for t in trials) + "seed_id BIGINT, step INT, " + ", ".join(f"`{f}` INT" for f in features) + f", {fields}, elapsed DOUBLE"
    piece = max(1, MATRIX_ROWS // space.domain.size)

    def walk(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, piece):
                rows = batch.slice(at, piece).to_pandas().sort_values("seed_id", kind="stable")
                ids, salts = rows["seed_id"].to_numpy(), rows["_salt"].to_numpy()
                heads = _heads(("feature", "sign", "accept"), salts, ids, rows["_origin"].to_numpy())
                x, was = rows[features].to_numpy(dtype=float), rows["_gain"].to_numpy()
                partner = rows[partners].to_numpy()
                seen = set()
                for n in range(rounds):
                    twin = x.copy()
                    twin[:, slots] = partner
                    chosen = _drawn_features(*pair(x, twin), movable, mixed_numbers(heads["feature"], n) / 4294967296.0)
                    sign = np.where(mixed_numbers(heads["sign"], n) % 2 == 0, 1.0, -1.0)
                    tried = np.clip(x + np.where(np.arange(len(features)) == chosen[:, None], sign[:, None], 0.0), low, high)
                    judged = judge(tried)
                    now = judged[:, -1].astype(np.int64)
                    new = []
                    for i, key in enumerate(map(bytes, np.column_stack([salts, tried[:, free].astype(np.int64)]))):
                        if key not in seen:
                            seen.add(key)
                            new.append(i)
                    if new:
                        columns = [pa.array(rows[t].to_numpy()[new], pa.int32()) for t in trials]
                        columns += [pa.array(ids[new], pa.int64()), pa.array(np.full(len(new), n), pa.int32())]
                        columns += [pa.array(v.astype(np.int32)) for v in tried[new].T]
                        columns += [pa.array(v) for v in judged[new].T]
                        columns.append(pa.array(np.full(len(new), time.time() - began)))
                        yield pa.RecordBatch.from_arrays(columns, names=names)
                    keep = (now >= was) | (mixed_numbers(heads["accept"], n) / 4294967296.0 < np.exp((now - was).astype(float)))
                    x, was = np.where(keep[:, None], tried, x), np.where(keep, now, was)

    return start.repartition(parts, "seed_id").mapInArrow(walk, schema)


def local_search(starts: DataFrame, model, space: SearchSpace, max_rounds: int, began: float | None = None) -> DataFrame:
    """All positions tried by the walkers, with their K and spread: the same as repeating ``local_step``."""
    began = began or time.time()
    features, domain = space.features, space.domain

    def ends(x: np.ndarray) -> np.ndarray:
        bins = np.sort(score_bins(variant_scores(x, features, model, domain), space.eps), axis=1)
        k = (np.diff(bins, axis=1) != 0).sum(axis=1) + 1
        return np.column_stack([k, bins[:, -1] - bins[:, 0]]).astype(np.int32)

    def pair(x: np.ndarray, twin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return model.gradient(x), model.gradient(twin)

    twins = {p: F.col(f"_t_{p}") for p in space.protected}
    return walk_paths(starts, space, F.col("origin"), twins, F.col("spread"), max_rounds, pair, ends, "k INT, spread INT", began)


def _flip_view(frontier: DataFrame, model, space: SearchSpace) -> DataFrame:
    """Adds the partner value and whether some protected value changes the class (one attribute)."""
    if len(space.protected) != 1:
        raise ValueError("this search takes exactly one protected attribute")
    name = space.protected[0]
    lo = space.bounds[name][0]
    scored = variant_probabilities(frontier, model, space.domain)
    partner, flips = picks.max_difference_partner(F.col("pv"), (q(name) - lo).cast("int"))
    value = F.when(F.col("_partner") >= 0, F.col("_partner") + lo).otherwise(q(name))
    judged = picks.pinned(scored, {"_partner": partner, "flips": flips})
    return judged.withColumn("n_value", value).drop("pv", "_partner")


# Chance that a walker leaves a discriminatory position for one that is not: exp(-1), one unit of the objective.
LEAVE = math.exp(-1)


def _kept_position(done: DataFrame, names: list[str], parts: list[Column]) -> DataFrame:
    """Walkers after a try: where ``flips`` was lost, most stay at ``_was_…``; else all move on."""
    keep = F.col("flips") | ~F.col("_was_flips") | (mix_unit("accept", *parts) < LEAVE)
    judged = picks.pinned(done, {"_keep": keep})
    back = {n: F.when(F.col("_keep"), q(n)).otherwise(q(f"_was_{n}")) for n in [*names, "flips"]}
    return judged.withColumns(back).drop("_keep", "_was_flips", *[f"_was_{n}" for n in names])


def _flip_walk(starts: DataFrame, model, space: SearchSpace, max_rounds: int, pair: Callable) -> DataFrame:
    """Local walk of the single-attribute searches: positions tried with their ``flips`` flag.

    A walker starts at a find. It gives up a position that flips for one that does not with probability
    exp(-1) only; every other try is accepted.
    """

    def flips(x: np.ndarray) -> np.ndarray:
        classes = variant_scores(x, space.features, model, space.domain) > 0.5
        return (classes.any(axis=1) & ~classes.all(axis=1))[:, None]

    twins = {space.protected[0]: F.col("n_value")}
    walked = walk_paths(starts, space, F.lit(LOCAL), twins, F.lit(1), max_rounds, pair, flips, "flips BOOLEAN", time.time())
    return cut_lineage(walked.drop("elapsed"))


def _partners(x: np.ndarray, model, space: SearchSpace) -> tuple[np.ndarray, np.ndarray]:
    """Array form of ``_flip_view``: the partner's protected value, and whether some value changes the class."""
    name = space.protected[0]
    slot, lo = space.features.index(name), space.bounds[name][0]
    p = variant_scores(x, space.features, model, space.domain)
    own = (x[:, slot] - lo).astype(np.int64)
    mine = np.take_along_axis(p, own[:, None], axis=1)
    other = (p > 0.5) != (mine > 0.5)
    flips = other.any(axis=1)
    change = np.abs(np.maximum(p, 1 - p) - np.maximum(mine, 1 - mine))
    np.put_along_axis(change, own[:, None], -1.0, axis=1)
    farthest = np.where(change.max(axis=1) > 0, change.argmax(axis=1), own)
    return np.where(flips, other.argmax(axis=1), farthest) + lo, flips


def guided_paths(seeds: DataFrame, model, space: SearchSpace, max_iter: int, tags: tuple[str, ...], mover) -> DataFrame:
    """(seed_id, step, features, flips, n_value): all positions of all seeds in one Arrow pass, whoever finds what.

    ``mover()`` makes a function of (matrix, matrix with the partner's value, hashes of the step by tag) that returns
    the move; it may remember earlier moves of the same rows. A seed with a NULL feature has no path.
    """
    features, steps = space.features, max_iter + 1
    slot = features.index(space.protected[0])
    low, high = (np.array([space.bounds[f][i] for f in features], dtype=float) for i in (0, 1))
    seed_id = F.col("seed_id").cast("bigint")
    hashes = [hash_int(F.lit(t), F.lit(space.salt), seed_id, F.lit(n)) for n in range(max_iter) for t in tags]
    start = seeds.dropna(subset=features).select(
        seed_id.alias("seed_id"), *[q(f).cast("double").alias(f) for f in features], F.array(*hashes).cast("array<bigint>").alias("_h")
    )
    names = ["seed_id", "step", *features, "flips", "n_value"]
    schema = "seed_id BIGINT, step INT, " + ", ".join(f"`{f}` INT" for f in features) + ", flips BOOLEAN, n_value INT"

    def walk(batches):
        piece = max(1, MATRIX_ROWS // space.domain.size)
        for batch in batches:
            for at in range(0, batch.num_rows, piece):
                rows = batch.slice(at, piece)
                x = np.column_stack([rows.column(f).to_numpy(zero_copy_only=False) for f in features]).astype(float)
                h = rows.column("_h").flatten().to_numpy(zero_copy_only=False).reshape(len(x), max_iter, len(tags))
                move = mover()
                for n in range(steps):
                    value, flips = _partners(x, model, space)
                    columns = [rows.column("seed_id"), pa.array(np.full(len(x), n), pa.int32())]
                    columns += [pa.array(v.astype(np.int32)) for v in x.T]
                    columns += [pa.array(flips), pa.array(value.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    if n < max_iter:
                        twin = x.copy()
                        twin[:, slot] = value
                        x = np.clip(x + move(x, twin, h[:, n]), low, high)

    return start.mapInArrow(walk, schema)


def earliest_matches(edges: DataFrame, left: list[str], right: list[str], order: list[str]) -> DataFrame:
    """The edges that a pass in ascending ``order`` takes, where each left and each right end can be taken once.

    An edge that is the least left at both of its ends is taken whatever happens elsewhere, so each round takes all
    of those and drops the other edges of their ends. ``order`` must differ between the edges of one end. Rounds end
    with the edges, after as many rounds as there are different first values of ``order`` at most.
    """
    place = F.struct(*[q(c) for c in order])
    rest, taken = cut_lineage(edges.withColumn("_place", place)), []
    while True:
        at_left = rest.groupBy(*left).agg(F.min("_place").alias("_l"))
        at_right = rest.groupBy(*right).agg(F.min("_place").alias("_r"))
        least = rest.join(at_left, left).join(at_right, right)
        now = cut_lineage(least.where("_place = _l AND _place = _r").select(*rest.columns))
        taken.append(now)
        ends = [now.select(*[q(c) for c in side]) for side in (left, right)]
        rest = cut_lineage(rest.join(ends[0], left, "left_anti").join(ends[1], right, "left_anti"))
        if rest.isEmpty():
            return union_tables(*taken).select(*[q(c) for c in edges.columns])


def guided_search(
    seeds: DataFrame, model, space: SearchSpace, max_iter: int, local_rounds: int, tags: tuple[str, ...], mover, pair
) -> DataFrame:
    """Frame of the single-attribute searches: a seed stops at its first new find.

    What others find only ends a seed's path, so all paths are walked to the end first. Finds are then the matches of
    seeds with keys, earliest (step, seed) first, and a seed's positions count up to its find. ``pair(x, twin)`` gives
    both gradients for the local walk.
    """
    if len(space.protected) != 1:
        raise ValueError("this search takes exactly one protected attribute")
    paths = cut_lineage(guided_paths(seeds, model, space, max_iter, tags, mover))
    first = Window.partitionBy("seed_id", *[q(f) for f in space.key()]).orderBy("step")
    visits = paths.where("flips").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "flips")
    found = cut_lineage(earliest_matches(visits, ["seed_id"], space.key(), ["step", "seed_id"]))
    stops = found.select("seed_id", F.col("step").alias("_stop"))
    tried = paths.join(stops, "seed_id", "left").where("_stop IS NULL OR step <= _stop").drop("_stop", "n_value")
    result = _single_found(found, space, "global")
    visited = distinct_tries(tried, space, "global")
    if local_rounds:
        starts = found.select("seed_id", "n_value", *[q(f) for f in space.features])
        walked = _flip_walk(starts, model, space, local_rounds, pair)
        fresh = not_seen(walked.filter("flips"), space.key(), ["step", "seed_id"], found)
        result = result.unionByName(_single_found(fresh, space, "local"))
        visited = visited.unionByName(distinct_tries(walked, space, "local", visited))
    return visited.join(
        result.select("phase", *[q(f) for f in space.key()], F.lit(1).alias("_hit")), ["phase", *space.key()], "left"
    ).withColumn("disc", F.coalesce("_hit", F.lit(0))).drop("_hit")


def distinct_tries(rows: DataFrame, space: SearchSpace, phase: str, *visited: DataFrame) -> DataFrame:
    """Distinct masked keys tried in a phase: (phase, seed_id, step, free features).

    Finds go first, so that a key counted as a find keeps that seed and step.
    """
    keyed = rows.select("seed_id", "step", (~F.col("flips")).cast("int").alias("_miss"), *[q(f) for f in space.key()])
    first = not_seen(keyed, space.key(), ["_miss", "step", "seed_id"], *visited)
    return first.select(F.lit(phase).alias("phase"), "seed_id", "step", *[q(f) for f in space.key()])


def _single_found(rows: DataFrame, space: SearchSpace, phase: str) -> DataFrame:
    return rows.select(F.lit(phase).alias("phase"), "seed_id", "step", *[q(f) for f in space.key()])


def _other_moves(move: np.ndarray, h: np.ndarray, space: SearchSpace) -> np.ndarray:
    """Array form of ``_nonzero_move``; ``h`` holds the hashes for the feature and the sign."""
    free = np.array([space.features.index(f) for f in space.free])
    still = np.flatnonzero(~move.any(axis=1))
    move[still, free[h[still, 0] % len(free)]] = np.where(h[still, 1] % 2 == 0, 1.0, -1.0)
    return move


def adf_search(seeds: DataFrame, model, space: SearchSpace, max_iter: int = 10, local_rounds: int = 0) -> DataFrame:
    """Gradient-guided search on one protected attribute: (phase, seed_id, step, free features, disc)."""
    movable = np.array([0.0 if f in space.protected else 1.0 for f in space.features])

    def pair(x: np.ndarray, twin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return model.gradient(x), model.gradient(twin)

    def mover():
        return lambda x, twin, h: _other_moves(_agreeing_move(*pair(x, twin), movable), h, space)

    start = seeds.select("seed_id", *[q(f) for f in space.features])
    return guided_search(start, model, space, max_iter, local_rounds, ("feature", "sign"), mover, pair)


def neuron_guided_search(
    seeds: DataFrame, model, space: SearchSpace, layer: int, mask: list[int], max_iter: int = 40, local_rounds: int = 0
) -> DataFrame:
    """As ``adf_search`` with gradients of masked hidden vectors and a hashed restart on oscillation."""
    keep = np.asarray(mask, dtype=float)
    movable = np.array([0.0 if f in space.protected else 1.0 for f in space.features])

    def pair(x: np.ndarray, twin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return model.pair_gradient(x, twin, layer, keep), model.pair_gradient(twin, x, layer, keep)

    def mover():
        before: list[np.ndarray] = []  # the last three moves, at first 0, 1 and -1 everywhere

        def move(x: np.ndarray, twin: np.ndarray, h: np.ndarray) -> np.ndarray:
            if not before:
                before.extend(np.full(x.shape, v) for v in (0.0, 1.0, -1.0))
            grad = model.pair_gradient(x, twin, layer, keep)
            stuck = ~grad.any(axis=1) | (before[0] == before[2]).all(axis=1)
            now = np.where(stuck[:, None], (h % 3 - 1).astype(float), np.sign(grad)) * movable
            before.append(now)
            before.pop(0)
            return now

        return move

    start = seeds.select("seed_id", *[q(f) for f in space.features])
    return guided_search(start, model, space, max_iter, local_rounds, tuple(space.features), mover, pair)


def random_rows(spark: SparkSession, n: int, space: SearchSpace) -> DataFrame:
    """``n`` rows drawn uniformly within bounds by hash: (seed_id, features)."""
    draws = [
        (F.lit(lo) + hash_int(F.lit(space.salt), F.lit(f), F.col("id")) % (hi - lo + 1)).cast("int").alias(f)
        for f, (lo, hi) in space.bounds.items()
    ]
    return spark.range(n).select(F.col("id").alias("seed_id"), *draws)


@dataclass
class WalkWeights:
    """Feature and direction probabilities shared by all walkers, updated once per round."""

    feature: list[float]
    down: list[float]
    change: float = 0.001

    @classmethod
    def uniform(cls, n: int) -> WalkWeights:
        return cls([1.0 / n] * n, [0.5] * n)

    def update(self, counts: list[tuple[int, int, int, int]]) -> None:
        """``counts``: (feature, direction, successes, failures) of one round, one entry per pair."""
        for at, direction, good, bad in counts:
            gain = (good - bad) * self.change
            self.feature[at] = max(self.feature[at] + gain, 0.0)
            self.down[at] = min(max(self.down[at] - direction * gain, 0.0), 1.0)
        total = sum(self.feature)
        self.feature = [f / total for f in self.feature] if total > 0 else [1.0 / len(self.feature)] * len(self.feature)


def _walk_parts(space: SearchSpace, step: int) -> list[Column]:
    return [F.lit(space.salt), F.col("seed_id"), F.lit(WALK), F.lit(step)]


def random_step(walkers: DataFrame, model, space: SearchSpace, weights: WalkWeights, step: int) -> DataFrame:
    """One round of the adaptive walk: (seed_id, features, at, direction, flips), before as ``_was_…``."""
    parts = _walk_parts(space, step)
    probs = F.array(*[F.lit(w) for w in weights.feature])
    down = F.array(*[F.lit(w) for w in weights.down])
    lows = F.array(*[F.lit(space.bounds[f][0]) for f in space.features])
    highs = F.array(*[F.lit(space.bounds[f][1]) for f in space.features])
    before = {f"_was_{n}": q(n) for n in [*space.features, "flips"]}
    chosen = picks.pinned(walkers.withColumns(before), {"at": weighted_choice(probs, mix_unit("feature", *parts))})
    slot = F.col("at") + 1
    value = F.element_at(F.array(*[q(f).cast("int") for f in space.features]), slot)
    edge = (value == F.element_at(lows, slot)) | (value == F.element_at(highs, slot))
    chance = F.when(edge, F.lit(0.5)).otherwise(F.element_at(down, slot))
    direction = F.when(mix_unit("direction", *parts) < chance, F.lit(-1)).otherwise(F.lit(1))
    moved = picks.pinned(chosen, {"direction": direction}).withColumns(
        {
            f: space.clip(f, q(f) + F.when(F.col("at") == i, F.col("direction")).otherwise(F.lit(0)))
            for i, f in enumerate(space.features)
        }
    )
    return _flip_view(moved, model, space).drop("n_value")


def _rounds_together(rows: list, walk_round, rounds: int, tasks: int) -> Iterator:
    """Each round of this task's walkers, then its counts to all tasks and theirs back."""
    context = BarrierTaskContext.get() if tasks > 1 else None
    for step in range(rounds):
        positions, counts = walk_round(step)
        yield positions
        heard = [json.loads(m) for m in context.allGather(json.dumps(counts))] if context else [counts]
        total: dict[tuple[int, int], list[int]] = {}
        for told in heard:
            for at, direction, good, bad in told:
                held = total.setdefault((at, direction), [0, 0])
                held[0], held[1] = held[0] + good, held[1] + bad
        rows.append([(*k, *v) for k, v in sorted(total.items())])


WALKERS = 20_000  # of a task in the adaptive walk


def adaptive_walk(starts: DataFrame, model, space: SearchSpace, rounds: int) -> DataFrame:
    """All rounds of the adaptive walk as one barrier stage: the positions tried, (seed_id, step, features, flips).

    The same as repeating ``random_step`` and updating the shared weights. Walkers stay in their tasks; after each round the
    tasks tell each other their success counts (a few numbers per feature), and all update the weights alike. An exchange
    takes Spark about a second, so a task gets up to WALKERS walkers before another is used; there are at most as many
    tasks as cores, all of which must run at once. Of equal masked keys in a task only the earliest
    (step, seed) is returned. A lost task restarts the stage, with the same choices.
    """
    features = space.features
    free = [features.index(f) for f in space.free]
    low, high = (np.array([space.bounds[f][i] for f in features], dtype=float) for i in (0, 1))
    start = starts.select(
        F.col("seed_id").cast("bigint").alias("seed_id"),
        *[q(f).cast("double").alias(f) for f in features],
    )
    names = ["seed_id", "step", *features, "flips"]
    schema = "seed_id BIGINT, step INT, " + ", ".join(f"`{f}` INT" for f in features) + ", flips BOOLEAN"
    salt = space.salt

    def walk(batches):
        mine = [b.to_pandas() for b in batches]  # a task without walkers still takes part in every exchange
        held = pd.concat(mine) if mine else pd.DataFrame(columns=["seed_id", *features])
        held = held.sort_values("seed_id", kind="stable")
        ids = held["seed_id"].to_numpy(dtype=np.int64)
        heads = _heads(("feature", "direction", "accept"), salt, ids, WALK)
        state = {"x": held[features].to_numpy(dtype=float), "was": np.ones(len(held), dtype=bool)}
        weights, told, seen = WalkWeights.uniform(len(features)), [], set()
        lines = np.arange(len(held))

        def units(tag: str, step: int) -> np.ndarray:
            return mixed_numbers(heads[tag], step) / 4294967296.0

        def walk_round(step: int):
            if told:
                weights.update(told.pop())
            x, was = state["x"], state["was"]
            probs = np.array(weights.feature)
            upto = np.cumsum(probs)
            hit = (probs > 0) & (upto > units("feature", step)[:, None] * upto[-1])
            at = np.where(hit.any(axis=1), hit.argmax(axis=1), -1)
            value = x[lines, at]
            chance = np.where((value == low[at]) | (value == high[at]), 0.5, np.array(weights.down)[at])
            direction = np.where(units("direction", step) < chance, -1, 1)
            tried = np.clip(x + np.where(np.arange(len(features)) == at[:, None], direction[:, None], 0), low, high)
            flips = np.zeros(len(tried), dtype=bool)
            piece = max(1, MATRIX_ROWS // space.domain.size)
            for s in range(0, len(tried), piece):
                flips[s : s + piece] = _partners(tried[s : s + piece], model, space)[1]
            new = []
            for i, key in enumerate(map(bytes, np.ascontiguousarray(tried[:, free].astype(np.int64)))):
                if key not in seen:
                    seen.add(key)
                    new.append(i)
            columns = [pa.array(ids[new], pa.int64()), pa.array(np.full(len(new), step), pa.int32())]
            columns += [pa.array(v.astype(np.int32)) for v in tried[new].T] + [pa.array(flips[new], pa.bool_())]
            counts = [
                [int(a), int(d), int((flips & mine).sum()), int((~flips & mine).sum())]
                for a in np.unique(at).tolist()
                for d in (-1, 1)
                if (mine := (at == a) & (direction == d)).any()
            ]
            keep = flips | ~was | (units("accept", step) < LEAVE)
            state["x"], state["was"] = np.where(keep[:, None], tried, x), np.where(keep, flips, was)
            return pa.RecordBatch.from_arrays(columns, names=names), counts

        yield from _rounds_together(told, walk_round, rounds, tasks)

    tasks = max(1, min(starts.sparkSession.sparkContext.defaultParallelism, -(-starts.count() // WALKERS)))
    return start.repartition(tasks).mapInArrow(walk, schema, barrier=True)


def random_search(
    spark: SparkSession, model, space: SearchSpace, samples: int, local_rounds: int = 0
) -> DataFrame:
    """Uniform global sampling, then an adaptive local walk from every find; result as in ``adf_search``."""
    drawn = cut_lineage(_flip_view(random_rows(spark, samples, space), model, space))
    tried = drawn.withColumn("step", F.lit(0))
    found = cut_lineage(not_seen(tried.filter("flips").drop("n_value"), space.key(), ["seed_id"]))
    visited = distinct_tries(tried, space, "global")
    result = _single_found(found, space, "global")
    if local_rounds:
        # The shuffle by key ends the barrier stage: a failed task restarts it, which a stage of results would not.
        steps = cut_lineage(not_seen(adaptive_walk(found, model, space, local_rounds), space.key(), ["step", "seed_id"]))
        fresh = not_seen(steps.filter("flips"), space.key(), ["step", "seed_id"], found)
        result = result.unionByName(_single_found(fresh, space, "local"))
        visited = visited.unionByName(distinct_tries(steps, space, "local", visited))
    return visited.join(
        result.select("phase", *[q(f) for f in space.key()], F.lit(1).alias("_hit")), ["phase", *space.key()], "left"
    ).withColumn("disc", F.coalesce("_hit", F.lit(0))).drop("_hit")
