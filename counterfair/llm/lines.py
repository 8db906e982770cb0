"""Line dedup: drop lines that many documents share, all but in one document.

Lines are compared by key: surrounding white space stripped, A-Z lower-cased. Keys meet as a pair of 64- and 32-bit
hashes; counts of distinct documents are partly summed before the shuffle. To be marked, the occurrences of a line are
dealt by document over SALTS tasks, each with its own copy of the line's one row, so a line that every document holds is
no single task. What comes back to a document is only the places of its lines to drop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterfair.llm.common import SPACES, lower_ascii

SALTS = 16


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def _signature(line: Column, min_chars: int) -> Column:
    key = line_key(line)
    return F.when(
        (F.octet_length(line) >= min_chars) & (F.char_length(key) >= min_chars),
        F.struct(F.xxhash64(key).alias("a"), F.hash(key).alias("b")),
    )


def line_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = 40, min_docs: int = 5):
    """(row, text, n_lines, n_dropped) for each row of ``docs``; ``row`` is the whole input row.

    Texts are split at ``\\n``; a null or empty text is one empty line. Lines whose key has at least ``min_chars`` code
    points and is found in at least ``min_docs`` distinct documents stay only in the document with the largest id that
    holds them, where all their copies stay. A row without id is not counted and loses no line. Rows that repeat an id
    count as one document, each keeping its own text.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.struct("*").alias("row"), F.col(key).alias("_id"), body.alias("_t"), F.xxhash64(body).alias("_v")
    )
    split = F.split(F.col("_t"), "\n", -1)
    long = (
        rows.where(F.col("_id").isNotNull() & (F.octet_length("_t") >= min_chars))
        .select("_id", "_v", F.posexplode(F.transform(split, lambda x: _signature(x, min_chars))).alias("_at", "_s"))
        .where(F.col("_s").isNotNull())
        .select("_id", "_v", "_at", F.col("_s.a").alias("_a"), F.col("_s.b").alias("_b"))
    )
    shared = (
        long.groupBy("_a", "_b")
        .agg(F.countDistinct("_id").alias("_n"), F.max("_id").alias("_keep"))
        .where(F.col("_n") >= min_docs)
        .drop("_n")
    )
    shared = shared.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    gone = (
        long.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
        .join(shared, ["_a", "_b", "_salt"])
        .where(F.col("_id") != F.col("_keep"))
        .groupBy("_id", "_v")
        .agg(F.collect_set("_at").alias("_gone"))
    )
    joined = rows.join(gone, ["_id", "_v"], "left").withColumn("_l", split)
    kept = F.expr("transform(array_except(sequence(0, size(_l) - 1), _gone), i -> _l[i])")
    left = F.when(F.col("_gone").isNull(), F.col("_t")).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        "row",
        left.alias("text"),
        F.size("_l").cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
