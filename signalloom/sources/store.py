"""Several derived tables that change together: versions per table, made visible by one manifest.

A batch writes its rows of every table under its own number, in folders by hash of the key, and then the manifest that names the
version of each table.  Readers see what the newest manifest names, so a job that dies between two tables shows the state before it,
and its retry, which writes the same folders again, the state behind it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


def bucket_of(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class Store:
    """Tables below ``root``, all keyed by one column: each version holds all rows of the keys in it.

    A table's schema is that of its first version; later ones must have it too.
    """

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def write(self, table: str, df: DataFrame, version: int) -> DataFrame:
        """Write a version of a table, not visible yet; gives what was written, which is computed once."""
        path = f"{self.root}/{table}/version={version}"
        full = df.withColumn("bucket", bucket_of(self.key))
        full.write.mode("overwrite").partitionBy("bucket").parquet(path)
        return self.spark.read.schema(full.schema).parquet(path)

    def commit(self, version: int, tables: list[str]) -> None:
        """Make ``version`` of ``tables`` visible, in one step: the manifest is written aside and renamed."""
        named = {**self.versions(), **dict.fromkeys(tables, version)}
        fs, aside = self._fs(f"{self.root}/_manifest/_{version:012d}.json")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps({"version": version, "tables": named}).encode()))
        out.close()
        _, final = self._fs(f"{self.root}/_manifest/{version:012d}.json")
        if fs.exists(final):  # a retry of a batch that was visible already
            fs.delete(final, False)
        if not fs.rename(aside, final):
            raise OSError(f"cannot write {final}")

    def versions(self) -> dict[str, int]:
        """The visible version of each table."""
        fs, folder = self._fs(f"{self.root}/_manifest")
        names = sorted(n for s in fs.listStatus(folder) if (n := s.getPath().getName())[0].isdigit()) if fs.exists(folder) else []
        if not names:
            return {}
        _, newest = self._fs(f"{self.root}/_manifest/{names[-1]}")
        stream = fs.open(newest)
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return {k: int(v) for k, v in json.loads(text)["tables"].items()}

    def log(self, table: str, schema: T.StructType, upto: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """All visible rows ever written to a table, or those up to a version, with ``version``; only some buckets if given."""
        upto = self.versions().get(table, -1) if upto is None else upto
        full = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("version", T.IntegerType())])
        fs, folder = self._fs(f"{self.root}/{table}")
        if not fs.exists(folder):
            return self.spark.createDataFrame([], full)
        rows = self.spark.read.schema(full).option("basePath", f"{self.root}/{table}").parquet(f"{self.root}/{table}/version=*")
        rows = rows.where(F.col("version") <= upto)
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def read(self, table: str, schema: T.StructType) -> DataFrame:
        """The table as the newest manifest names it: of each key the rows of its newest version."""
        rows = self.log(table, schema)
        last = rows.groupBy(F.col(self.key).alias("_k")).agg(F.max("version").alias("_v"))
        return rows.join(last, F.col(self.key).eqNullSafe(F.col("_k")) & (F.col("version") == F.col("_v")), "left_semi").drop("bucket", "version")
