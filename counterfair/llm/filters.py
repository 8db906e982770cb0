"""Filter interaction audit: what each filter removes at each place of each order, and its Shapley share.

A document is no more than the set of filters that it fails, so all documents of a part collapse into one count per
subset. Subsets of filters already applied are the states of a lattice, one more filter is an edge. What an edge removes
is a sum over at most 2**n counts. Forward and backward path counts say how many orders reach the edge's lower state and
how many leave its upper one; their product weights the edge's removals in the Shapley sum, and each step of each order
is read from the edge that it walks over.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterfair.llm.common import SPACES

MAX_FILTERS = 8  # 8! orders; states and edges are driver-side tables of 2**n and n * 2**(n - 1) rows

Failure = Callable[[Column], Column]


def text_words(text: Column) -> Column:
    """Maximal runs of characters other than 0x20 and 0x09-0x0D; of a text without any, no words."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACES}]+"))


def few_words(least: int) -> Failure:
    return lambda text: F.size(text_words(text)) < least


def repeated_words(percent: int) -> Failure:
    """Distinct words are fewer than ``percent`` of 100 words."""
    return lambda text: 100 * F.size(F.array_distinct(text_words(text))) < percent * F.size(text_words(text))


def many_capitals(percent: int) -> Failure:
    """A-Z are more than ``percent`` of 100 code points."""

    def fails(text: Column) -> Column:
        capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
        return 100 * capitals.cast("long") > percent * F.char_length(text).cast("long")

    return fails


def holds(pattern: str) -> Failure:
    return lambda text: text.rlike(pattern)


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """For each subset of n filters, in how many orders it can be reached, and left for the full set."""
    full = (1 << n) - 1
    forward, backward = [0] * (full + 1), [0] * (full + 1)
    forward[0] = backward[full] = 1
    for state in range(full + 1):
        for i in range(n):
            if not state >> i & 1:
                forward[state | 1 << i] += forward[state]
    for state in range(full, -1, -1):
        for i in range(n):
            if state >> i & 1:
                backward[state ^ 1 << i] += backward[state]
    return forward, backward


def failure_counts(
    docs: DataFrame,
    failures: dict[str, Failure],
    labels: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    part: str = "lang",
) -> DataFrame:
    """(part, fails, n, n_good, n_toxic): documents by the set of filters they fail, as a bit mask.

    The bits follow ``failures``; the bit after them is set for a text that a row of smaller id holds too, anywhere in
    the table. Copies of a text meet as counts, summed before each shuffle, never as rows of one task.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).cast("long").alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("_t")
    )
    mask = sum((F.when(f(F.col("_t")), 1 << i).otherwise(0) for i, f in enumerate(failures.values())), F.lit(0))
    digest = F.unhex(F.sha2("_t", 256))
    # A row without id joins no label; its second key spreads such rows.
    rows = rows.select("_id", "part", mask.alias("fails"), digest.alias("h"))
    rows = rows.withColumn("_apart", F.when(F.col("_id").isNull(), F.xxhash64("h", "part")).otherwise(0))
    rows = rows.withColumn("_id", F.coalesce("_id", F.lit(0)))
    marks = labels.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("_id"), F.lit(0).cast("long").alias("_apart"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"),
    )
    marks = marks.groupBy("_id", "_apart").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    marked = rows.join(marks, ["_id", "_apart"], "left").na.fill(False, ["good", "toxic"])
    group = ["h", "part", "fails", "good", "toxic"]
    by_id = marked.groupBy("_id", "_apart", *group).agg(F.count("*").alias("n"))
    known = F.col("_apart") == 0
    copies = by_id.groupBy(*group).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(known, F.col("n")).otherwise(0)).alias("with_id"),
        F.min(F.when(known, F.struct("_id", "n"))).alias("first"),
    )
    least = F.min("first._id").over(Window.partitionBy("h"))
    owners = F.when(F.col("first._id") == F.col("least"), F.col("first.n")).otherwise(0)
    copies = copies.withColumn("least", least).withColumn("again", F.col("with_id") - owners)
    bit = 1 << len(failures)
    both = F.array(
        F.struct(F.col("fails").alias("fails"), (F.col("n") - F.col("again")).alias("n")),
        F.struct((F.col("fails") + bit).alias("fails"), F.col("again").alias("n")),
    )
    split = copies.select("part", "good", "toxic", F.inline(both))
    return split.groupBy("part", "fails").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("n_good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("n_toxic"),
    )


def filter_audit(
    docs: DataFrame,
    failures: dict[str, Failure],
    labels: DataFrame,
    copies: str,
    text: str = "text",
    key: str = "doc_id",
    part: str = "lang",
) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    ``failures`` maps one-letter names to conditions on the text; ``copies`` names one more filter, failed by a text that
    a row of smaller id holds too. Counts are of documents of the part: ``kept`` after the step, ``removed`` by it,
    ``redundant`` (fail its filter but went before), ``unique_fails`` (fail its filter alone), ``good_lost`` and
    ``toxic_lost`` (removed here, with label quality or toxic 1); ``shapley`` is what its filter removes summed over all orders.

    Null texts are empty, null parts the empty string. A row without id is a document, has no label, is no copy and makes
    no other row one. Rows that repeat an id count each; among equal texts those of the least id all stay. Repeated
    labels of an id count as one, 1 where one of them is. An empty table gives no rows; other columns are not read.
    """
    letters = [*failures, copies]
    n = len(letters)
    if n > MAX_FILTERS or len(set(letters)) < n:
        raise ValueError(f"at most {MAX_FILTERS} filters with different names")
    forward, backward = path_counts(n)
    counts = failure_counts(docs, failures, labels, text, key, part)
    edges = [(s, i, forward[s] * backward[s | 1 << i]) for s in range(1 << n) for i in range(n) if not s >> i & 1]
    steps = [
        ("".join(letters[i] for i in order), k + 1, sum(1 << i for i in order[:k]), order[k])
        for order in permutations(range(n))
        for k in range(n)
    ]
    spark = docs.sparkSession
    walks = spark.createDataFrame(steps, "filter_order STRING, step INT, state INT, filter INT")
    every_edge = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(i).alias("filter"), F.lit(w).cast("long").alias("orders")) for s, i, w in edges])
    bit = F.expr("shiftleft(1, filter)")
    fails, before = (F.col("fails").bitwiseAND(bit) != 0), (F.col("fails").bitwiseAND(F.col("state")) != 0)

    def total(what: str, where: Column, name: str) -> Column:
        return F.sum(F.when(where, F.col(what)).otherwise(0)).alias(name)

    priced = (
        counts.select("*", F.inline(every_edge))
        .groupBy("part", "state", "filter", "orders")
        .agg(
            total("n", ~fails & ~before, "kept"),
            total("n", fails & ~before, "removed"),
            total("n", fails & before, "redundant"),
            total("n", F.col("fails") == bit, "unique_fails"),
            total("n_good", fails & ~before, "good_lost"),
            total("n_toxic", fails & ~before, "toxic_lost"),
        )
    )
    share = F.sum(F.col("orders") * F.col("removed")).over(Window.partitionBy("part", "filter"))
    # A fixed table of n! * n rows, n at most MAX_FILTERS.
    read = priced.withColumn("shapley", share).join(F.broadcast(walks), ["state", "filter"])
    return read.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
