"""Chat-style JSON: documents of ordered messages, or one message per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from counterfair.session import cut_lineage

MESSAGE_SCHEMA = "role STRING, content STRING"
DOCUMENT_SCHEMA = "messages ARRAY<STRUCT<role: STRING, content: STRING>>"
LINE_SCHEMA = f"doc STRING, pos BIGINT, {MESSAGE_SCHEMA}"


def read_chat_json(spark: SparkSession, path: str, form: str = "file") -> DataFrame:
    """(doc, pos, role, content) in message order; content is text or the raw JSON of an object.

    ``form`` is ``file`` (one document per file), ``blocks`` (the same, each file read by as many tasks as it has input
    splits), ``documents`` (one per line) or ``messages`` (one message per line). ``file`` and ``documents`` parse a
    document in one task.
    """
    if form == "blocks":
        return _read_blocks(spark, path)
    if form == "messages":
        return spark.read.json(path, schema=LINE_SCHEMA)
    documents = spark.read.json(path, schema=f"doc STRING, {DOCUMENT_SCHEMA}", multiLine=form == "file")
    name = F.coalesce("doc", F.col("_metadata.file_path"))
    return documents.select(name.alias("doc"), F.posexplode("messages").alias("pos", "message")).select(
        "doc", F.col("pos").cast("bigint").alias("pos"), "message.role", "message.content"
    )


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, piece, flip, d0, d1): the text up to each closing brace, with what it does to quotes and depth.

    ``flip`` is 1 where quotes open or close a string over the piece's end; ``d0`` and ``d1`` are what the piece adds to
    the depth if it begins outside or inside a string.
    """
    # Splits end at closing braces, so any number of tasks can read one line.
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("piece"),
    )
    parts = F.split(F.regexp_replace("piece", r"(?s)\\.", ""), '"', -1)
    depth = F.transform(parts, lambda p: F.octet_length(F.regexp_replace(p, r"[^{\[]", "")) - F.octet_length(F.regexp_replace(p, r"[^\]]", "")))

    def side(k: int) -> Column:
        return F.aggregate(F.filter("_d", lambda d, i: i % 2 == k), F.lit(0), lambda a, d: a + d)

    flip = (F.size("_d") - 1) % 2
    counted = pieces.withColumn("_d", depth)
    return counted.select(
        "file", "block", "seq", "piece", flip.alias("flip"), (side(0) - (1 - flip)).alias("d0"), (side(1) - flip).alias("d1")
    )


def _read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file, {..., "messages": [...]}, where ``messages`` is the first array of objects.

    Which side of a quote a split begins on, and how deep, follows from the splits before it: each works out both sides,
    and a scan over the splits, one row each, chooses. A message ends where a brace outside a string leads back to the
    depth of the array; pieces of one message are joined wherever they were read.
    """
    order = Window.partitionBy("file", "block").orderBy("seq")
    upto, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    begun = F.coalesce(F.sum("flip").over(earlier), F.lit(0)) % 2
    local = _pieces(spark, path).withColumn("inside", begun)
    other = F.when(F.col("inside") == 0, F.col("d1")).otherwise(F.col("d0"))
    own = F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1"))
    local = local.withColumns({"own": own, "other": other})
    local = local.withColumns({"own": F.sum("own").over(upto), "other": F.sum("other").over(upto)})
    local = cut_lineage(local.select("file", "block", "seq", "piece", "flip", "inside", "own", "other"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def so_far(what: str) -> Column:
        return F.coalesce(F.sum(what).over(before), F.lit(0))

    splits = local.groupBy("file", "block").agg(F.sum("flip").alias("flips"), F.max_by("own", "seq").alias("d0"), F.max_by("other", "seq").alias("d1"))
    splits = splits.withColumn("side", so_far("flips") % 2)
    splits = splits.withColumn("depth", F.when(F.col("side") == 0, F.col("d0")).otherwise(F.col("d1")))
    splits = splits.select("file", "block", "side", so_far("depth").alias("depth"))
    placed = local.join(splits, ["file", "block"])
    outside = (F.col("inside") + F.col("side") + F.col("flip")) % 2 == 0
    depth = F.col("depth") + F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))
    ended = (outside & (depth == 2)).cast("int")
    placed = placed.select("file", "block", "seq", "piece", ended.alias("ended"))
    ends = placed.groupBy("file", "block").agg(F.sum("ended").alias("n"))
    ends = ends.select("file", "block", so_far("n").alias("ends"))
    number = F.col("ends") + F.coalesce(F.sum("ended").over(earlier), F.lit(0))
    numbered = placed.join(ends, ["file", "block"]).withColumn("pos", number)
    pieces = F.array_sort(F.collect_list(F.struct("block", "seq", F.concat("piece", F.lit("}")).alias("piece"))))
    texts = numbered.groupBy("file", "pos").agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("text"), F.max("ended").alias("whole"))
    texts = texts.where("whole = 1")
    # Before the first message stands the head of the document, before the others a comma; after the array, its end.
    head = F.regexp_extract("text", r'(?s)^(.*?"messages"\s*:\s*\[)', 1)
    body = F.when(F.col("pos") == 0, F.substr("text", F.char_length(head) + 1)).otherwise(F.regexp_replace("text", r"^[\s,]+", ""))
    doc = F.from_json(F.when(F.col("pos") == 0, F.concat(head, F.lit("]}"))), "doc STRING")["doc"]
    cut = texts.select("file", "pos", F.btrim(body, F.lit(" \t\r\n")).alias("text"), doc.alias("doc"))
    facts = cut.groupBy("file").agg(F.max("doc").alias("doc"), F.min(F.when(F.col("text").startswith("]"), F.col("pos"))).alias("over"))
    kept = cut.drop("doc").join(facts, "file").where(F.col("over").isNull() | (F.col("pos") < F.col("over")))
    message = F.from_json("text", MESSAGE_SCHEMA)
    return kept.select(F.coalesce("doc", "file").alias("doc"), F.col("pos").cast("bigint").alias("pos"), message.alias("m")).select(
        "doc", "pos", "m.role", "m.content"
    )


def split_roles(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(system messages, user messages)."""
    return messages.filter(F.col("role") == "system"), messages.filter(F.col("role") == "user")


def write_chat_json(messages: DataFrame, path: str, form: str = "messages") -> None:
    """Write (doc, pos, role, content) in any of the forms of ``read_chat_json``.

    The document forms gather a document's messages in one row; keep them for documents that fit one.
    """
    if form == "messages":
        messages.select("doc", "pos", "role", "content").write.mode("overwrite").json(path)
        return
    ordered = F.array_sort(F.collect_list(F.struct("pos", "role", "content")))
    packed = messages.groupBy(F.col("doc").cast("string").alias("doc")).agg(ordered.alias("m"))
    bare = F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    # A file per document is many files: tasks put theirs in place, not the driver one after the other.
    writer = packed.select("doc", bare.alias("messages")).write.mode("overwrite")
    if form == "file":
        writer = writer.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2)
    writer.json(path)
