"""Embedding near-dedup by PCA-ordered tiles.

Equal vectors (as directions) are one row with a count. Unit vectors are turned into the axes of their covariance, the
largest first, and sorted into tiles by their leading coordinates. A cell of two tiles adds up the leading products;
the rest cannot exceed the product of the two suffix norms (Cauchy-Schwarz), so pairs, and often whole cells, stop as
soon as they cannot reach the threshold. Pairs that stay are decided in double precision on the vectors as given.

A cell returns for each of its vectors how many links it found, weighted by copies, and of the links themselves only a
spanning forest, so a dense cluster of any size gives a line of edges per cell and not its square.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterfair.llm.common import staged
from counterfair.llm.components import components

TILE_ROWS = 4096
STRIP_ROWS = 256
STEPS = (8, 24)
SLACK = 1e-9


def _axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes, the largest first, of the unit vectors of each dimension there is: dim x dim numbers each."""

    def moments(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["v"].to_numpy())
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return pd.DataFrame({"dim": [x.shape[1]], "m": [(x.T @ x).ravel()]})

    salted = vectors.withColumn("_salt", F.pmod(F.col("vh"), F.lit(64)))
    sums = salted.groupBy("dim", "_salt").applyInPandas(moments, "dim INT, m ARRAY<DOUBLE>")
    total: dict[int, np.ndarray] = {}
    for r in sums.orderBy("dim").collect():
        total[r["dim"]] = total.get(r["dim"], 0) + np.array(r["m"]).reshape(r["dim"], r["dim"])
    return {d: np.linalg.eigh(m)[1][:, ::-1] for d, m in total.items()}


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (a[i], b[i])."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[y] = x
            keep.append(i)
    return a[keep], b[keep]


def compare(left: np.ndarray, right: np.ndarray, turned_left: np.ndarray, turned_right: np.ndarray, threshold: float):
    """Index pairs of rows with cosine >= threshold; ``turned`` are unit vectors in PCA order, the others as given."""
    dim = turned_left.shape[1]
    steps = [*(s for s in STEPS if s < dim), dim]
    rest = {s: [np.sqrt((t[:, s:] ** 2).sum(axis=1)) for t in (turned_left, turned_right)] for s in steps}
    bound = threshold - SLACK
    dots = turned_left[:, : steps[0]] @ turned_right[:, : steps[0]].T
    rows, cols = np.nonzero(dots + np.outer(*rest[steps[0]]) >= bound)
    dots = dots[rows, cols]
    for done, step in zip(steps, steps[1:]):
        if len(rows) == 0:
            break
        dots = dots + np.einsum("ij,ij->i", turned_left[rows, done:step], turned_right[cols, done:step])
        live = dots + rest[step][0][rows] * rest[step][1][cols] >= bound
        rows, cols, dots = rows[live], cols[live], dots[live]
    norms = np.linalg.norm(left, axis=1)[rows] * np.linalg.norm(right, axis=1)[cols]
    good = np.einsum("ij,ij->i", left[rows], right[cols]) >= threshold * norms
    return rows[good], cols[good]


def _cell(rows: pa.Table, axes: dict[int, np.ndarray], threshold: float) -> pa.Table:
    """Links within a tile, or between two: a count for each vector that has some, and a forest of edges."""
    rows = rows.sort_by([(c, "ascending") for c in ("side", "rep", "vh")])
    v = rows["v"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
    rep, vh, copies, side = (rows[c].to_numpy() for c in ("rep", "vh", "copies", "side"))
    turned = _turned(v, axes)
    n = int((side == 0).sum())
    start = 0 if n == len(rep) else n  # a tile with itself, or the second tile
    links = np.zeros(len(rep), dtype=np.int64)
    edges = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
    for low in range(0, n, STRIP_ROWS):
        high = min(n, low + STRIP_ROWS)
        a, b = compare(v[low:high], v[start:], turned[low:high], turned[start:], threshold)
        a, b = a + low, b + start
        if start == 0:
            a, b = a[a < b], b[a < b]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        edges.append(_forest(a, b))
    x, y = _forest(*(np.concatenate(e) for e in zip(*edges)))
    some = np.flatnonzero(links)
    counts = pa.table({"rep": rep[some], "vh": vh[some], "n": links[some], "other": pa.nulls(len(some), pa.int64())})
    none = pa.nulls(len(x), pa.int64())
    return pa.concat_tables([counts, pa.table({"rep": rep[x], "vh": none, "n": none, "other": rep[y]})])


def _turned(v: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True) @ axes[v.shape[1]]


CELL = "rep BIGINT, vh BIGINT, n BIGINT, other BIGINT"
LED = "v ARRAY<DOUBLE>, vh BIGINT, rep BIGINT, copies BIGINT, dim INT, p DOUBLE, q DOUBLE"
TILE = ["dim", "stripe", "part", "sub"]


def _tiles(placed: DataFrame) -> DataFrame:
    """(tile, p, q, v, vh, rep, copies): stripes along the first axis, cut along the second, by quantiles.

    Only the balance of the tiles depends on the quantiles; a tile that ties overfill is cut further by hash.
    """
    tiles = max(1, -(-placed.count() // TILE_ROWS))
    stripes = max(1, round(tiles**0.5))
    per = -(-tiles // stripes)
    cuts = placed.approxQuantile("p", [i / stripes for i in range(1, stripes)], 0.005) if stripes > 1 else []
    placed = placed.withColumn("stripe", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col("p") > c)) if cuts else F.lit(0))
    shares = [i / per for i in range(1, per)] or [0.5]
    inner = placed.groupBy("dim", "stripe").agg(F.percentile_approx("q", shares, 1000).alias("cut"))
    part = F.size(F.filter("cut", lambda c: F.col("q") > c)) if per > 1 else F.lit(0)
    placed = placed.join(inner, ["dim", "stripe"]).withColumn("part", part)
    size = placed.groupBy(*TILE[:3]).agg(F.count(F.lit(1)).alias("k"))
    sub = F.expr(f"pmod(vh, (k + {2 * TILE_ROWS - 1}) div {2 * TILE_ROWS})")
    placed = placed.join(size, TILE[:3]).withColumn("sub", sub)
    return placed.select(F.concat_ws(".", *TILE).alias("tile"), "dim", "p", "q", "v", "vh", "rep", "copies")


def near_vectors(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``.

    Two vectors link when their cosine in double precision is at least ``threshold``; vectors of different length,
    and those that are null, empty, zero or hold null or non-finite components, link with nothing. ``component_id`` is
    the smallest id reachable, ``kept`` marks the rows whose id that is. A row without id links with nothing, has no
    component and is not kept; rows that repeat an id count as further vectors, and are one node of the graph.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    # Copies of a vector have equal components; -0.0 is 0.0.
    rows = rows.withColumn("v", F.when(usable, F.transform("v", lambda x: x + F.lit(0.0))))
    rows = rows.withColumn("vh", F.xxhash64("v"))
    distinct = rows.where("v IS NOT NULL").groupBy("v", "vh")
    distinct = distinct.agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    distinct = staged(distinct.withColumn("dim", F.size("v")), "vectors")
    axes = _axes(distinct)

    def lead(batches):
        for rows in batches:
            out = np.zeros((len(rows), 2))
            dims = rows["dim"].to_numpy()
            for d in np.unique(dims):
                out[dims == d, : min(2, d)] = _turned(np.stack(rows["v"][dims == d].to_numpy()), axes)[:, :2]
            yield rows.assign(p=out[:, 0], q=out[:, 1])

    led = distinct.select("v", "vh", "rep", "copies", "dim").mapInPandas(lead, LED)
    tiled = staged(_tiles(staged(led, "vectors-led")), "vectors-tiled")
    box = tiled.groupBy("dim", "tile").agg(*(f(c).alias(f"{c}{i}") for c in "pq" for i, f in enumerate((F.min, F.max))))
    # Unit vectors with that cosine are at most so far apart, and so are their coordinates along any axis.
    far = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    near = " AND ".join(f"x.{c}0 <= y.{c}1 + {far} AND y.{c}0 <= x.{c}1 + {far}" for c in "pq")
    cells = box.alias("x").join(box.alias("y"), F.expr(f"x.dim = y.dim AND x.tile <= y.tile AND {near}"))
    cells = staged(cells.select(F.col("x.tile").alias("x"), F.col("y.tile").alias("y")), "vectors-cells")
    sides = cells.select("x", "y", F.col("x").alias("tile"), F.lit(0).alias("side")).union(
        cells.where("x <> y").select("x", "y", F.col("y").alias("tile"), F.lit(1).alias("side"))
    )
    members = tiled.select("tile", "v", "vh", "rep", "copies").join(sides, "tile")
    found = members.groupBy("x", "y").applyInArrow(lambda rows: _cell(rows, axes, threshold), CELL)
    found = staged(found, "vectors-links")

    linked = found.where("n IS NOT NULL").groupBy("rep", "vh").agg(F.sum("n").alias("n"))
    of = components(found.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    classes = distinct.select("v", "vh", "rep", "copies").join(linked, ["rep", "vh"], "left")
    classes = classes.join(of, F.col("rep") == F.col("node"), "left")
    classes = classes.select(
        "v", "vh", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c")
    )
    out = rows.join(classes, ["vh", "v"], "left")
    component = F.coalesce("c", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
