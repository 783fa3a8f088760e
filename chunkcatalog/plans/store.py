"""Publishing a catalog: versioned folders of Parquet and a manifest, so that readers see one version or the next."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkcatalog.schema import TABLES

Catalog = dict[str, DataFrame]


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder that the cluster names; choose one only where none is set and all tasks run on this machine."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="chunkcatalog-checkpoint-"))
    return df.checkpoint(eager=True)


def settle_all(cat: Catalog, *names: str) -> Catalog:
    return {k: settle(v) if not names or k in names else v for k, v in cat.items()}


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """``(version, published_at)`` of the manifest; empty where nothing is published."""
    schema = "version bigint, published_at bigint"
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    if not path.getFileSystem(conf).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{folder}/manifest")


def publish(cat: Catalog, folder: str, published_at: int, names: tuple[str, ...] = tuple(TABLES)) -> int:
    """Writes all tables of a new version, then its manifest row; a version without one is never read."""
    spark = next(iter(cat.values())).sparkSession
    version = (versions(spark, folder).agg(F.max("version")).first()[0] or 0) + 1
    for name in names:
        cat[name].write.mode("overwrite").parquet(f"{folder}/v{version}/{name}")
    spark.createDataFrame([(version, published_at)], "version bigint, published_at bigint").coalesce(1).write.mode("append").json(f"{folder}/manifest")
    return version


def load(spark: SparkSession, folder: str, version: int | None = None, names: tuple[str, ...] = tuple(TABLES)) -> Catalog:
    """The latest version, or a given one."""
    known = [r.version for r in versions(spark, folder).orderBy("version").collect()]
    if version is None and known:
        version = known[-1]
    if version not in known:
        raise KeyError(version)
    return {n: spark.read.schema(TABLES[n]).parquet(f"{folder}/v{version}/{n}") for n in names}


def append_once(log: DataFrame, batch: DataFrame) -> DataFrame:
    """Positioned appends ``(log_id, offset, data)``: repeats, in the log or in the batch, are dropped if they are equal, and an error if they differ."""
    other = F.raise_error(F.lit("other bytes stand there"))
    once = batch.groupBy("log_id", "offset").agg(F.min("data").alias("data"), F.max("data").alias("__most"))
    once = once.withColumn("data", F.when(F.col("data").eqNullSafe(F.col("__most")), F.col("data")).otherwise(other.cast("binary"))).drop("__most")
    known = log.select("log_id", "offset", F.col("data").alias("__old"), F.lit(True).alias("__known"))
    x = once.join(known, ["log_id", "offset"], "left")
    same = F.when(F.col("__known").isNull(), F.lit(False)).when(F.col("__old").eqNullSafe(F.col("data")), F.lit(True)).otherwise(other.cast("boolean"))
    return log.unionByName(x.withColumn("__same", same).where("NOT __same").select(*log.columns))
