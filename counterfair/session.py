"""Session-level helpers: shared folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SMALL_BYTES = 64 << 20
NESTED = (T.ArrayType, T.MapType, T.StructType)
CHECKPOINT_CONF = "spark.checkpoint.dir"


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to a
    temporary folder; anywhere else an unset folder is an error, because executors could not see it.
    """
    context = spark.sparkContext
    root = context.getConf().get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="counterfair-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later rounds restart from files, not from the first round."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/counterfair/{name}-{uuid.uuid4().hex}"


def is_small(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than one row beyond that."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only after counting rows and bytes; a larger side is left to a shuffled join."""
    width = sum(
        (
            F.coalesce(F.octet_length(F.to_json(F.struct(f"`{f.name}`")) if isinstance(f.dataType, NESTED) else F.col(f"`{f.name}`")), F.lit(1))
            if isinstance(f.dataType, (*NESTED, T.StringType, T.BinaryType))
            else F.lit(16)
            for f in df.schema
        ),
        F.lit(0),
    )
    rows, size = df.select(width.alias("_w")).limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum("_w"), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= SMALL_BYTES else df
