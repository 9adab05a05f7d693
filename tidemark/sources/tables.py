"""Parquet tables on a shared file system: plain partitioned folders, replaced by dynamic partition overwrite.

Layout: ``<root>/<table>/<part>=<value>/batch_id=<id>/*.parquet``. The part is the table's date; tables without one are spread
over ``KEY_PARTS`` parts by a hash of their key.

* An append writes the folders of its batch, and overwrites them when the batch is sent again: a retried batch changes nothing.
* A rewrite (upsert, delete, retention, compaction) reads and replaces only the parts it concerns.

A table has one writer at a time, and a query that is still reading folders while they are replaced fails and is to be run
again. Folders are replaced one after the other as the job commits, not all at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.operators.windows import latest_per_key

# Table: schema, partition column, columns that identify a row.
TABLES: dict[str, tuple[T.StructType, str | None, tuple[str, ...]]] = {
    "servers": (schemas.SERVERS, None, ("ip", "port")),
    "maps": (schemas.MAPS, None, ("name",)),
    "snaps": (schemas.SNAPS, None, ("guid",)),
    "facts": (schemas.FACTS, "bucket_date", ()),
    "rollup_2h": (schemas.ROLLUP, "bucket_date", ("bucket", "server_id", "map_id")),
    "server_names": (schemas.SERVER_NAMES, None, ("ip", "port")),
    "server_cooldowns": (schemas.COOLDOWNS, None, ("ip", "port")),
    "request_log": (schemas.REQUEST_LOG, "log_date", ()),
    "request_verdicts": (schemas.REQUEST_VERDICTS, "log_date", ()),
    "rejected_probes": (schemas.REJECTED_PROBES, None, ()),
    "cycle_metrics": (schemas.CYCLE_METRICS, None, ("cycle",)),
    "blocked_ips": (schemas.BLOCKED_IPS, None, ("ip",)),
}
KEY_PARTS = 8  # fixed: another number would look for stored keys in other parts
_BASE_BATCH = -1  # batch id of merged rows
_NO_PART = "__HIVE_DEFAULT_PARTITION__"  # how Spark names the folder of a null part


def _key_part(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(KEY_PARTS)).cast("int")


class Store:
    """The tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- folders --------------------------------------------------------------------------------
    def _fs(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), jpath

    def _folders(self, table: str) -> dict[tuple[str, int], str]:
        """Path of each (part, batch id); only names are listed, no file is opened."""
        fs, p = self._fs(f"{self.root}/{table}/{self._part(table)}=*/batch_id=*")
        paths = [s.getPath() for s in fs.globStatus(p) or []]
        return {(p.getParent().getName().split("=", 1)[1], int(p.getName().split("=", 1)[1])): str(p.toString()) for p in paths}

    def _delete(self, paths: Sequence[str]) -> None:
        for path in paths:
            fs, p = self._fs(path)
            fs.delete(p, True)

    # -- reading --------------------------------------------------------------------------------
    def _part(self, table: str) -> str:
        return TABLES[table][1] or "key_part"

    def _stored(self, table: str) -> DataFrame:
        """All rows with their part and batch."""
        schema, dated, _ = TABLES[table]
        full = T.StructType([*schema.fields, *([] if dated else [T.StructField("key_part", T.IntegerType())]),
                             T.StructField("batch_id", T.LongType())])
        if not self._folders(table):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(f"{self.root}/{table}")

    def _part_name(self, table: str) -> Column:
        return F.coalesce(F.col(self._part(table)).cast("string"), F.lit(_NO_PART))

    def _in_parts(self, table: str, parts: Sequence[str]) -> DataFrame:
        return self._stored(table).filter(self._part_name(table).isin(*parts))

    def read(self, table: str, before_batch: int | None = None) -> DataFrame:
        """Current rows; of batches earlier than ``before_batch`` only, if given."""
        df = self._stored(table)
        if before_batch is not None:
            df = df.filter(F.col("batch_id") < before_batch)
        return df.select(*TABLES[table][0].fieldNames())

    def read_batch(self, table: str, batch_id: int) -> DataFrame:
        return self._stored(table).filter(F.col("batch_id") == batch_id).select(*TABLES[table][0].fieldNames())

    def latest(self, table: str, before_batch: int | None = None) -> DataFrame:
        """One row per key, the newest: appended changes are resolved when they are read."""
        return latest_per_key(self.read(table, before_batch), TABLES[table][2], "updated_at")

    # -- appending ------------------------------------------------------------------------------
    def _laid_out(self, df: DataFrame, table: str, batch_id: int) -> DataFrame:
        """Rows as they are stored: the table's columns, their part and their batch."""
        schema, dated, keys = TABLES[table]
        out = df.select(*[F.col(f.name).cast(f.dataType) for f in schema], F.lit(int(batch_id)).cast("long").alias("batch_id"))
        if not dated:
            out = out.withColumn("key_part", _key_part(keys or schema.fieldNames()))
        return out

    def _write(self, rows: DataFrame, table: str) -> None:
        """Replaces the folders that ``rows`` has rows for. AQE splits those with many rows and merges small ones."""
        by = [self._part(table), "batch_id"]
        (rows.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*by).parquet(f"{self.root}/{table}"))

    def append(self, df: DataFrame, table: str, batch_id: int) -> None:
        """``df`` must not read this batch of this table: a batch that is sent again goes before it is written."""
        self._delete([path for (_, n), path in self._folders(table).items() if n == batch_id])
        self._write(self._laid_out(df, table, batch_id), table)

    def insert_ignore(self, df: DataFrame, table: str, batch_id: int, *order: str) -> DataFrame:
        """Append the first row, by ``order``, of each key that is new; returns the table with them."""
        self.append(fresh(self.read(table, before_batch=batch_id), df, TABLES[table][2], *order), table, batch_id)
        return self.read(table)

    # -- rewriting ------------------------------------------------------------------------------
    def _replace(self, rows: DataFrame, table: str, parts: Sequence[str]) -> None:
        """``rows``, with part and batch, become all rows of the parts; folders without rows go."""
        old = {k: path for k, path in self._folders(table).items() if k[0] in set(parts)}
        filled = {(r.part, r.batch_id) for r in rows.select(self._part_name(table).alias("part"), "batch_id").distinct().collect()}
        if filled:
            self._write(rows, table)
        self._delete([path for k, path in old.items() if k not in filled])

    def _parts_of(self, rows: DataFrame, table: str) -> list[str]:
        """Parts, ``KEY_PARTS`` at most, of rows of a table without date."""
        if TABLES[table][1]:
            raise ValueError(f"{table} is kept by date: append to it")
        return [str(r.key_part) for r in rows.select("key_part").distinct().collect()]

    def upsert(self, df: DataFrame, table: str, *order: str) -> None:
        """The last new row of each key, by ``order``, replaces the stored one."""
        keys = list(TABLES[table][2])
        last = _one_per_key(self._laid_out(df, table, _BASE_BATCH), keys, order, True).persist()
        try:
            parts = self._parts_of(last, table)
            if parts:
                stays = self._in_parts(table, parts).join(last.select(*keys), keys, "left_anti")
                self._replace(stays.unionByName(last), table, parts)
        finally:
            last.unpersist()

    def delete_keys(self, keys: DataFrame, table: str) -> None:
        names = list(TABLES[table][2])
        typed = keys.select(*[F.col(n).cast(TABLES[table][0][n].dataType) for n in names])
        gone = typed.distinct().withColumn("key_part", _key_part(names)).persist()
        try:
            parts = self._parts_of(gone, table)
            if parts:
                self._replace(self._in_parts(table, parts).join(gone.select(*names), names, "left_anti"), table, parts)
        finally:
            gone.unpersist()

    def retain(self, table: str, ts: str, cutoff: Column) -> None:
        """Keep rows from the cutoff on; rows without a time go.

        Of a dated table the folders of older dates go and the cutoff's own date is rewritten, nothing else is read. Older
        rows that are appended later are rows like any others, until the next call.
        """
        day, at = self.spark.range(1).select(cutoff.cast("date").cast("string"), cutoff.cast("timestamp_ntz").cast("string")).first()
        if at is None:
            return
        folders = self._folders(table)
        parts = sorted({part for part, _ in folders})
        if TABLES[table][1]:
            self._delete([path for (part, _), path in folders.items() if part < day or part == _NO_PART])
            parts = [day] if day in parts else []
        if parts:
            rows = self._in_parts(table, parts)
            self._replace(rows.filter(F.col(ts) >= F.lit(at).cast("timestamp_ntz")), table, parts)

    def compact(self, table: str) -> None:
        """Few large files instead of one folder per batch; changes and rollup deltas are merged.

        Only parts with several folders are read. The newest batch keeps its folder, so that it can still be sent again.
        """
        folders = self._folders(table)
        newest = max((n for _, n in folders), default=_BASE_BATCH)
        older = [part for part, n in folders if n < newest]
        parts = sorted({part for part in older if older.count(part) > 1})
        if not parts:
            return
        batch = F.when(F.col("batch_id") < newest, _BASE_BATCH).otherwise(F.col("batch_id")).cast("long")
        df = self._in_parts(table, parts).withColumn("batch_id", batch)
        if table == "rollup_2h":
            df = df.groupBy("bucket", "server_id", "map_id", "bucket_date", "batch_id").agg(
                F.sum("players").alias("players"))
        elif table in ("server_names", "server_cooldowns"):
            df = latest_per_key(df, [*TABLES[table][2], "batch_id"], "updated_at")
        self._replace(df, table, parts)

    def compact_all(self) -> None:
        for table in TABLES:
            self.compact(table)


def _one_per_key(new: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool) -> DataFrame:
    """The first or last row of each key by ``order``; ties, and rows without an order, go by all other columns."""
    by = [*order, *sorted(c for c in new.columns if c not in keys and c not in order)]
    w = W.partitionBy(*keys).orderBy(*[F.col(c).desc() if last else F.col(c).asc() for c in by] or [F.lit(0)])
    return new.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= 1).drop("_nth")


def upserted(stored: DataFrame, new: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """Stored rows without the keys of ``new``, and the last new row of each key by ``order``."""
    names, last = list(keys), _one_per_key(new, keys, order, True)
    return stored.join(last.select(*names), names, "left_anti").select(*stored.columns).unionByName(
        last.select(*stored.columns))


def fresh(stored: DataFrame, new: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """Of ``new`` the first row, by ``order``, of each key that is not stored."""
    names = list(keys)
    return _one_per_key(new, keys, order, False).join(stored.select(*names), names, "left_anti")


def insert_ignored(stored: DataFrame, new: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """Stored rows and the fresh ones."""
    return stored.unionByName(fresh(stored, new, keys, *order).select(*stored.columns))
