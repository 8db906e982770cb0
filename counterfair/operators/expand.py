"""Row expansion over protected domains and one-step neighbours. Narrow: no join, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterfair.functions.scalar import clipped, q


@dataclass(frozen=True)
class Domain:
    """Inclusive value ranges of the protected attributes. Variants are numbered like an odometer:
    the last attribute changes fastest."""

    bounds: tuple[tuple[str, int, int], ...]

    @classmethod
    def of(cls, bounds: dict[str, tuple[int, int]]) -> Domain:
        return cls(tuple((n, int(lo), int(hi)) for n, (lo, hi) in bounds.items()))

    @property
    def names(self) -> list[str]:
        return [n for n, _, _ in self.bounds]

    @property
    def size(self) -> int:
        total = 1
        for _, lo, hi in self.bounds:
            total *= hi - lo + 1
        return total

    def variant_id(self) -> Column:
        number = F.lit(0)
        for n, lo, hi in self.bounds:
            number = number * (hi - lo + 1) + (q(n) - lo)
        return number.cast("int")

    def value(self, name: str, variant: Column) -> Column:
        """Value of one attribute in variant number ``variant``."""
        below = 1
        for n, lo, hi in reversed(self.bounds):
            span = hi - lo + 1
            if n == name:
                return (F.floor(variant / below) % span + lo).cast("int")
            below *= span
        raise KeyError(name)

    def grid(self) -> np.ndarray:
        axes = [np.arange(lo, hi + 1) for _, lo, hi in self.bounds]
        return np.stack([g.ravel() for g in np.meshgrid(*axes, indexing="ij")], axis=1).astype(float)


def expand_protected(df: DataFrame, domain: Domain) -> DataFrame:
    """Every row under every combination of protected values (its own included).

    Ranges are literals exploded in place, so the output keeps the input's partitioning: a later
    aggregate by row id on data already partitioned by it needs no further shuffle.
    """
    for name, lo, hi in domain.bounds:
        columns = [c for c in df.columns if c != name]
        df = df.select(*[q(c) for c in columns], F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias(name))
    return df.withColumn("variant_id", domain.variant_id())


def flip_protected(col: Column, low: int, high: int) -> Column:
    """The lowest value becomes the highest; anything else becomes the lowest."""
    return F.when(col == low, F.lit(high)).otherwise(F.lit(low))


def neighbour_join(df: DataFrame, bounds: dict[str, tuple[int, int]], step: int = 1) -> DataFrame:
    """All one-step neighbours: each named feature moved down and up by ``step``, clipped."""
    moves = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.lit(d).alias("delta")) for f in bounds for d in (-step, step)]
    )
    moved = df.withColumn("_m", F.explode(moves))
    changed = {
        f: F.when(F.col("_m.feature") == f, clipped(q(f) + F.col("_m.delta"), lo, hi)).otherwise(q(f))
        for f, (lo, hi) in bounds.items()
    }
    return moved.withColumns({**changed, "feature": F.col("_m.feature"), "delta": F.col("_m.delta")}).drop("_m")
