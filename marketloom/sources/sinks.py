"""Sinks: keyed upserts, versioned snapshots, insert-if-absent, retention, freezes and exports on parquet."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from marketloom.operators.series import latest_per_key


def upserted(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Last write wins per key."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return latest_per_key(both, keys, ["_new"]).drop("_new")


def upsert_partitions(spark: SparkSession, path: str, incoming: DataFrame, keys: list[str], partition: str) -> None:
    """Upsert into a partitioned table, rewriting only the partitions the batch touches.

    These are the partitions of the batch and those that still hold one of its keys, so a key may move.
    They are read, merged and replaced by dynamic overwrite; a partition left without rows is dropped.
    A rerun of the same batch changes nothing.
    """
    from marketloom.sources.shared import materialize
    touched = None
    try:
        existing = spark.read.schema(incoming.schema).parquet(path)
        moved = existing.join(incoming.select(*keys).distinct(), keys, "left_semi").select(partition)
        touched = materialize(incoming.select(partition).unionByName(moved).distinct(), "upsert-touched")
        hit = touched.select(F.col(partition).alias("_p"))
        merged = upserted(existing.join(hit, existing[partition].eqNullSafe(hit["_p"]), "left_semi"), incoming, keys)
    except Exception as e:  # first write of the table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        merged = latest_per_key(incoming, keys, [F.lit(1)])
    # the source partitions are replaced below, so the merge is written out before
    merged = materialize(merged, "upsert")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    if touched is not None:  # dynamic overwrite leaves partitions alone that got no row
        left = merged.select(F.col(partition).alias("_p")).distinct()
        for row in touched.join(left, touched[partition].eqNullSafe(left["_p"]), "left_anti").select(F.col(partition).cast("string")).collect():
            _drop_partition(spark, path, partition, row[0])


def _drop_partition(spark: SparkSession, path: str, partition: str, value: str | None) -> None:
    jvm = spark._jvm
    names = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{partition}={names.DEFAULT_PARTITION_NAME() if value is None else names.escapePathName(value)}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def keep_recent(df: DataFrame, date: str, today: Column, days: int) -> DataFrame:
    """Retention: rows of the last ``days`` days, at least one."""
    if days < 1:
        raise ValueError("days must be 1 or more")
    return df.where(F.col(date) >= F.date_sub(today, days))


def write_snapshot(df: DataFrame, path: str, version: str) -> None:
    """Versioned result snapshot partitioned by as_of and version; a rerun replaces its own partitions."""
    (df.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("as_of", "version").parquet(path))


def freeze(df: DataFrame, date: str, end: Column, path: str, capture_id: str) -> None:
    """Frozen copy of an input up to an end date."""
    (df.where(F.col(date) <= end).withColumn("capture_id", F.lit(capture_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("capture_id").parquet(path))


def replace_children(parents: DataFrame, children: DataFrame, stored_children: DataFrame, key: str) -> DataFrame:
    """Children of the incoming parents replace the stored ones; other parents keep theirs.

    The parents' keys are hashed, each once, and the children stream past them unsorted.
    """
    return stored_children.join(hashed_keys(parents, key), key, "left_anti").unionByName(children)


def hashed_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys for a semi or anti join against a larger table: a task holds its share of the distinct keys, not the sorted rows."""
    return df.select(key).hint("shuffle_hash")


def definition_versions(obs: DataFrame, key: str, at: str, definition: list[str]) -> DataFrame:
    """Append-only observations with a version that rises when the hashed definition changes."""
    w = Window.partitionBy(key).orderBy(at)
    d = obs.withColumn("definition_hash", F.sha2(F.to_json(F.struct(*definition)), 256))
    changed = ~F.col("definition_hash").eqNullSafe(F.lag("definition_hash").over(w))
    return d.withColumn("_c", changed.cast("int")).withColumn("definition_version", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Distributed export of a result frame."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)
