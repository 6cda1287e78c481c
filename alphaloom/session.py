"""Session builder and frame helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "alphaloom", **conf: str) -> SparkSession:
    """A session with UTC dates and adaptive execution; cluster settings come from the environment."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def no_nan(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column: missing values have one form inside the library."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded, without negative zeros."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def written_out(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` as text with seven digits: for values that compound over many orders of magnitude."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.format_string("%.6e", F.col(c) + F.lit(0.0))) for c in columns})


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, else a folder on the default file system.

    On a cluster whose default file system is each machine's own disk there is no such folder: the setting must name one.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        home = sc._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(sc._jsc.hadoopConfiguration()).toString().rstrip("/")
        if home.startswith("file:") and sc.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"{home}/tmp/alphaloom-{sc.applicationId}"
    return root.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: what several branches of a plan read is computed once and survives lost executors."""
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
