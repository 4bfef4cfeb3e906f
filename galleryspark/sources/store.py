"""Vector store on Parquet: batches are appended as versions and merged on read."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

REQUIRED = ("original_filename", "page_num", "component_type", "parent_pdf_id")  # fixed metadata keys


def latest(rows: DataFrame, key: str = "id", version: str | Column = "version") -> DataFrame:
    """Newest version of every id. The maximum is partly made before the shuffle, so an id written over and
    over does not fill one task."""
    rest = [c for c in rows.columns if c != key]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("_row"))
    return newest.select(key, "_row.*")


def upsert(current: DataFrame, batch: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """Current rows with the batch inserted or replaced by id."""
    return latest(current.unionByName(batch, allowMissingColumns=True), key, version)


def check_batch(batch: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """The batch itself; a missing column or an empty required value is an error that names it."""
    missing = [c for c in ("id", "embedding", *required) if c not in batch.columns]
    if missing:
        raise ValueError(f"metadata lacks the required keys {missing}")
    checked = batch
    for name in required:
        message = F.concat(F.lit(f"metadata lacks {name} for id "), F.coalesce(F.col("id").cast("string"), F.lit("")))
        checked = checked.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(message)).otherwise(F.col(name)))
    return checked


class VectorStore:
    """Directory of ``version=N/stream=S/batch=B`` folders; the newest version of an id counts.

    A batch is written whole or not at all. A new one gets the version after the largest there is, whichever stream it
    comes from; a batch that is run again finds its own folder and replaces it in its old place. Two streams that draw
    one number at the same moment write different folders, and the stream's name decides between them. An append
    costs the size of the batch; ``compact`` writes the merged rows as one version of a new store.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, batch: DataFrame, version: int) -> None:
        """Write the batch as ``version``; the same version again replaces it."""
        self._write(batch, f"version={version}/stream=direct/batch={version}")

    def append_batch(self, batch: DataFrame, stream: str, number: int) -> int:
        """Write batch ``number`` of ``stream`` as the newest version, or where it was before; the version it has."""
        place = f"stream=s{hashlib.md5(stream.encode()).hexdigest()}/batch={number}"
        own = self._versions_of(f"/{place}")
        version = own[0] if own else max(self._versions_of(""), default=-1) + 1
        self._write(batch, f"version={version}/{place}")
        return version

    def _versions_of(self, below: str) -> list[int]:
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version=*{below}")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
        return [int(status.getPath().toString().rsplit("/version=", 1)[1].split("/")[0]) for status in found]

    def _write(self, batch: DataFrame, folder: str) -> None:
        # Within one batch the later row of an id cannot be told apart; one of them is kept by value.
        checked = check_batch(batch)
        rest = [c for c in checked.columns if c != "id"]
        single = checked.groupBy("id").agg(F.max_by(F.struct(*rest), F.xxhash64(*rest)).alias("_row")).select("id", "_row.*")
        single.write.mode("overwrite").parquet(f"{self.path}/{folder}")

    def versions(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(self.path)

    def current(self) -> DataFrame:
        return latest(self.versions(), version=F.struct("version", "stream", "batch")).drop("stream", "batch")

    def compact(self, path: str) -> VectorStore:
        target = VectorStore(self.spark, path)
        self.current().drop("version").write.mode("overwrite").parquet(f"{target.path}/version=0/stream=direct/batch=0")
        return target
