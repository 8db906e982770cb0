"""N-gram Jaccard join by grouped prefixes.

Two sets with a Jaccard similarity of t or more share one of the first n - ceil(t n) + 1 members of each, in any fixed
order. The order here is rarest first. Members that no other document holds lead it and can match nothing, so only the
rest, the core, is kept, and a document whose core is shorter than t n cannot link at all. Equal sets are one class.
Classes with equal size and prefix form a group; groups that share a prefix member, and whose sizes and places allow
the overlap, are expanded into classes and verified on their whole cores.

Within the groups of one member not all pairs are formed. Each is first compared with the most central one, that with
the fewest members of its own; what then lies in one component needs no more comparison. Only pairs of different
components are left, and these are all compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterfair.llm.common import staged
from counterfair.llm.components import components
from counterfair.llm.repeats import chunked, in_order, members, repeated_keys, repeated_of, sizes_of
from counterfair.llm.words import Words, chunks, mix, shingles

PERCENT = 80


def sets_of(width: int):
    """A function that gives the sorted distinct shingles of each text."""

    def run(texts: list[bytes]) -> Iterator[np.ndarray]:
        for _, held in chunks(texts):
            w = Words(held)
            for i in range(len(held)):
                yield np.unique(shingles(w.of(i), width))

    return run


def _least(n: Column, percent: int) -> Column:
    """Smallest overlap with a set of size n that any partner must have."""
    return F.ceil(n * percent / 100)


def shingle_sets(docs: DataFrame, text: str, key: str, width: int, percent: int) -> DataFrame:
    """(doc_id, n, s1, s2, core): size, two sums that identify the set, and the members that other documents hold too.

    ``core`` is null where it is too small for any link.
    """
    n_chunks, parts = sizes_of(docs, text)
    rows = chunked(docs, text, key, n_chunks)
    keys_of = sets_of(width)
    masks = repeated_keys(rows, parts, keys_of)

    def core(rows: pd.DataFrame, masks: pd.DataFrame) -> pd.DataFrame:
        ids, texts = in_order(rows)
        repeated = repeated_of(texts, masks, keys_of)
        out = []
        for i, s in zip(ids, keys_of(texts)):
            own = s[members(repeated, s)]
            sums = [int(mix(s ^ np.uint64(salt)).sum().astype(np.int64)) for salt in (1, 2)]
            enough = len(own) > 0 and 100 * len(own) >= percent * len(s)
            out.append((i, len(s), *sums, own.astype(np.int64) if enough else None))
        frame = pd.DataFrame(out, columns=["doc_id", "n", "s1", "s2", "core"])
        return frame.astype({"doc_id": "Int64"})

    grouped = rows.groupBy("chunk").cogroup(masks.groupBy("chunk"))
    return grouped.applyInPandas(core, "doc_id BIGINT, n BIGINT, s1 BIGINT, s2 BIGINT, core ARRAY<BIGINT>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of class representatives whose sets are similar enough."""
    a = sets.select(F.col("rid").alias("a"), F.col("n").alias("na"), F.col("core").alias("ca"))
    b = sets.select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("core").alias("cb"))
    both = pairs.join(a, "a").join(b, "b").withColumn("_i", F.size(F.array_intersect("ca", "cb")))
    return both.where(F.col("_i") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("_i"))).select("a", "b")


def _possible(a: str, b: str, percent: int) -> Column:
    """Sizes and places in the prefix leave room for the overlap."""
    na, nb, pa, pb = (F.col(x) for x in (f"{a}.n", f"{b}.n", f"{a}.at", f"{b}.at"))
    room = F.least(na - pa, nb - pb)
    return (room * (100 + percent) >= percent * (na + nb)) & (F.least(na, nb) * 100 >= percent * F.greatest(na, nb))


def class_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the rows of ``sets`` (rid, n, core), one row per distinct set, that join all components.

    Every similar pair is either here or lies in a component that the links here hold together.
    """
    tokens = sets.select("rid", "n", F.explode("core").alias("t"))
    common = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    cores = tokens.join(common, "t").groupBy("rid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("s"))
    cores = cores.where(F.size("s") * 100 >= percent * F.col("n"))
    own = (F.col("n") - F.size("s")).cast("long")
    length = (F.col("n") - _least(F.col("n"), percent) + 1 - F.col("own")).cast("int")
    cores = cores.select("rid", "n", own.alias("own"), F.expr("transform(s, x -> x.t)").alias("core"))
    cores = staged(cores.withColumn("prefix", F.slice("core", 1, length)), "jaccard-cores")

    grouped = cores.groupBy("n", "own", "prefix").agg(F.min("rid").alias("g"))
    places = grouped.select("g", "n", "own", F.posexplode("prefix").alias("p", "t"))
    places = staged(places.select("t", "g", "n", "own", (F.col("own") + F.col("p")).alias("at")), "jaccard-places")
    member = cores.join(grouped, ["n", "own", "prefix"]).select("rid", "g")
    member = staged(member, "jaccard-members")

    def wanted(x: DataFrame, y: DataFrame, condition: str) -> DataFrame:
        """Pairs of groups (x, y), each once, that ``condition`` names and sizes and places allow."""
        both = x.alias("x").join(y.alias("y"), F.expr(condition)).where(_possible("x", "y", percent))
        return both.select(F.least("x.g", "y.g").alias("x"), F.greatest("x.g", "y.g").alias("y")).distinct()

    # All groups of a prefix member against the most central one, and the members of a group against its first.
    hub = places.groupBy("t").agg(F.min(F.struct("own", "n", "g", "at")).alias("m"), F.count(F.lit(1)).alias("k"))
    hub = hub.where("k > 1").select("t", "m.*")
    pairs = wanted(hub, places, "x.t = y.t AND x.g <> y.g")
    right = member.select(F.col("g").alias("y"), F.col("rid").alias("b"))
    left = member.select(F.col("g").alias("x"), F.col("rid").alias("a"))
    star = pairs.join(left, "x").join(right, "y").select("a", "b")
    star = star.union(member.where("rid <> g").select("g", "rid")).distinct()
    links = staged(_verified(star, cores, percent), "jaccard-links")

    # What lies in different components by now: all pairs.
    of = components(links).withColumnRenamed("node", "rid")
    label = staged(member.join(of, "rid", "left").select("rid", "g", F.coalesce("component", "rid").alias("c")), "jaccard-labels")
    spots = places.join(label.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")), "g")
    mixed = spots.groupBy("t").agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi")).where("_lo <> _hi")
    open_ = spots.join(mixed, "t")
    pairs = wanted(open_, open_, "x.t = y.t AND x.g < y.g AND (x.lo <> y.lo OR x.hi <> y.hi OR x.lo <> x.hi)")
    left = label.select(F.col("g").alias("x"), F.col("rid").alias("a"), F.col("c").alias("ca"))
    right = label.select(F.col("g").alias("y"), F.col("rid").alias("b"), F.col("c").alias("cb"))
    rest = pairs.join(left, "x").join(right, "y").where("ca <> cb").select("a", "b")
    within = label.alias("x").join(label.alias("y"), F.expr("x.g = y.g AND x.rid < y.rid AND x.c <> y.c"))
    rest = rest.union(within.select("x.rid", "y.rid")).distinct()
    return links.union(_verified(rest, cores, percent))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = PERCENT):
    """(doc_id, n_shingles, component_id) for each row of ``docs``.

    The set of a text is its distinct runs of ``width`` words (fewer words: the whole sequence); sets link when
    100 * intersection >= percent * union. ``component_id`` is the smallest id reachable by links. A null, empty or
    blank text has the empty set and links with nothing; a row without id links with nothing and has no component;
    rows that repeat an id are one node of the graph, whatever their texts. A very long text is one row of a chunk of its
    own; an empty table gives no rows; other columns are not read.
    """
    sets = shingle_sets(docs, text, key, width, percent)
    # A class has a key of its own: an id may lead several. Sets that cannot link are classes of their id alone.
    alone = F.xxhash64(F.lit("alone"), "doc_id")
    sets = sets.withColumn("ck", F.when(F.col("core").isNotNull(), F.xxhash64("n", "s1", "s2")).otherwise(alone)).drop("s1", "s2")
    sets = staged(sets, "jaccard-sets")
    known = sets.where("doc_id IS NOT NULL")
    classes = staged(known.groupBy("ck").agg(F.min("doc_id").alias("first")), "jaccard-classes")
    able = known.where("core IS NOT NULL").join(classes, "ck").where("doc_id = first")
    held = able.groupBy("ck").agg(F.min(F.struct("n", "core")).alias("m")).select(F.col("ck").alias("rid"), "m.*")
    # Classes of one id are one node: edges from each to the least of them.
    several = known.groupBy("doc_id").agg(F.min("ck").alias("a"), F.max("ck").alias("b")).where("a <> b").drop("b")
    same_id = known.select("doc_id", F.col("ck").alias("b")).join(several, "doc_id").where("a <> b").select("a", "b")
    found = staged(components(class_links(held, percent).union(same_id)), "jaccard-components")
    least = found.join(classes, F.col("node") == F.col("ck")).groupBy("component").agg(F.min("first").alias("c"))
    named = found.join(least, "component").select(F.col("node").alias("ck"), "c")
    named = classes.join(named, "ck", "left").select("ck", F.coalesce("c", "first").alias("c"))
    out = sets.join(named, "ck", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
