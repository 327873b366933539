"""The chunk store as DataFrame algebra: current rows, upsert, delete, patch, skip; and a versioned directory."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def current(rows: DataFrame, key: list[str], *latest: str) -> DataFrame:
    """One row for each key of an append-only table: the greatest by ``latest``, nulls least, then by all columns' order."""
    rest = [c for c in rows.columns if c not in key and c not in latest]
    top = rows.groupBy(*key).agg(F.max(F.struct(*latest, *rest)).alias("_m"))
    return top.select(*key, *[F.col("_m")[c].alias(c) for c in rows.columns if c not in key])


def upsert(base: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """The base with the batch's rows in place of those with equal keys; the batch's keys must be distinct."""
    return base.join(batch.select(*key), key, "left_anti").unionByName(batch)


def delete(base: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return base.join(keys.select(*key).distinct(), key, "left_anti")


def patch(base: DataFrame, changes: DataFrame, key: list[str], column: str) -> DataFrame:
    """One column replaced where ``changes`` (key, column) has a row; of several the greatest counts."""
    new = changes.groupBy(*key).agg(F.max(column).alias("_new"), F.lit(True).alias("_hit"))
    return base.join(new, key, "left").withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).drop("_new", "_hit")


def incremental_skip(files: DataFrame, stored: DataFrame, key: list[str], content_hash: str) -> DataFrame:
    """Files whose hash is not stored under their key: those to index again."""
    return files.join(stored.select(*key, content_hash).distinct(), [*key, content_hash], "left_anti")


class Store:
    """Tables in a directory, one folder a version; a pointer file names the current one, so readers see
    whole versions only. Deletion and upsert write a new version; append adds to the current one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _pointer(self, table: str) -> str:
        return os.path.join(self.root, table, "current.json")

    def path(self, table: str) -> str | None:
        try:
            with open(self._pointer(table)) as f:
                return os.path.join(self.root, table, json.load(f)["version"])
        except FileNotFoundError:
            return None

    def read(self, table: str) -> DataFrame | None:
        p = self.path(table)
        return self.spark.read.parquet(p) if p else None

    def publish(self, table: str, df: DataFrame) -> None:
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(os.path.join(self.root, table, version))
        tmp = self._pointer(table) + ".new"
        with open(tmp, "w") as f:
            json.dump({"version": version}, f)
        os.replace(tmp, self._pointer(table))

    def append(self, table: str, df: DataFrame) -> None:
        p = self.path(table)
        if p:
            df.write.mode("append").parquet(p)
        else:
            self.publish(table, df)

    def upsert(self, table: str, batch: DataFrame, key: list[str]) -> None:
        base = self.read(table)
        self.publish(table, batch if base is None else upsert(base, batch, key))

    def delete(self, table: str, keys: DataFrame, key: list[str]) -> None:
        base = self.read(table)
        if base is not None:
            self.publish(table, delete(base, keys, key))
