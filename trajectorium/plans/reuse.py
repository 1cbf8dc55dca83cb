"""Reuse of finished work: stages committed under the content of what they were made from, and frames that have not changed."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(df: DataFrame) -> str:
    """A digest of the rows, whatever their order: their number and sums of two hashes of each row. One aggregation, combined before the shuffle."""
    row = F.to_json(F.struct(*[df[c] for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    part = lambda *x: F.sum(F.xxhash64(*x).cast("decimal(38,0)"))
    got = df.select(row.alias("_r")).agg(F.count("*"), part("_r"), part("_r", F.lit(1))).first()
    return hashlib.sha256("/".join(map(str, [*got, df.schema.simpleString()])).encode()).hexdigest()


class StageCache:
    """Stages under a folder that driver and executors share. A stage's table counts once its record, which is written last, names the request and inputs it was made from; a run that ends before leaves nothing that counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _records(self, name: str, key: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/{key}.commit")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return []
        return [r["value"] for r in self.spark.read.text(path.toString()).collect()]  # one line

    def stage(self, name: str, request: dict, inputs: dict[str, str], build: Callable[[], DataFrame], still: Callable[[], dict[str, str]] | None = None) -> DataFrame:
        """The table of this request on these inputs (name -> fingerprint): read if it is committed, else built, written and committed. still: fingerprints of the inputs after the work; if they differ, nothing is committed."""
        key = hashlib.sha256(json.dumps([request, inputs], sort_keys=True).encode()).hexdigest()
        for line in self._records(name, key):
            return self.spark.read.parquet(json.loads(line)["path"])
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        build().write.parquet(path)
        if still is not None and still() != inputs:
            raise RuntimeError(f"the inputs of {name} changed while it ran")
        record = json.dumps({"request": request, "inputs": inputs, "path": path}, sort_keys=True)
        self.spark.range(1).select(F.lit(record).alias("value")).coalesce(1).write.mode("overwrite").text(f"{self.root}/{name}/{key}.commit")
        return self.spark.read.parquet(path)


def reusable(old: DataFrame, new: DataFrame, frame: str, order: str, columns: list[str]) -> DataFrame:
    """frame, reusable: whether a frame of new has the same rows as in old. Frames are compared by digest."""

    def digests(df: DataFrame, name: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *[F.col(c).alias(f"_{c}") for c in columns])))
        return df.groupBy(frame).agg(F.sha2(F.to_json(rows), 256).alias(name))

    return digests(new, "_new").join(digests(old, "_old"), frame, "left").select(frame, F.coalesce(F.col("_new") == F.col("_old"), F.lit(False)).alias("reusable"))
