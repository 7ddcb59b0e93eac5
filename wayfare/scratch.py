"""Tables that cut lineage, kept where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where the setting is absent, a local master gets a temporary folder (driver
    and executors are then one process) and any other master a folder beside the
    warehouse, which a cluster shares.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if spark.sparkContext.master.startswith("local["):
            _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        else:
            _own[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return _own[app]


def write_table(
    df: DataFrame, label: str, compression: str = "zstd", partition_by: list[str] | None = None
) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    What is read back depends on files alone: a lost executor costs a re-read,
    not a re-computation, and what follows plans with known sizes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wayfare-{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    schema = df.schema
    return spark.read.schema(schema).parquet(path)
