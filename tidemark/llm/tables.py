"""Small helpers on DataFrames shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands in for a missing id inside an operator: it comes after every other id.
LAST_ID = (1 << 63) - 1

#: White space that separates words, for trims and patterns.
SPACE = " \t\n\x0b\f\r"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_columns(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Columns id, tag and text of a table with an id and a text.

    ``id`` is never null (a missing one comes last); ``tag`` tells rows with the same id and other text apart; a null
    text is empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(text).alias("tag"),
            text.alias("text")]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tag and text of docs and nothing else, so that no other column can clash."""
    return docs.select(*key_columns(id_col, text_col))


def given_id(column: str = "id") -> Column:
    """The id as it was given: null where it was missing."""
    return F.when(F.col(column) != LAST_ID, F.col(column))


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id's decimal text modulo ``parts``; 0 for a missing id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts, F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: the one the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset, and the driver is the only machine, a folder of its own is made.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidemark-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; nothing is created."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
