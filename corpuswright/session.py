"""Session helpers: table loading and lineage cuts that survive executor loss."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; schema comes from the Parquet footer, so pruning and pushdown apply."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where the setting is absent and the session is local (tests) a temporary folder is made, once
    per session; on a cluster the setting is required.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    made = getattr(spark.sparkContext, "_corpuswright_dir", None)
    if made is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        made = "file://" + tempfile.mkdtemp(prefix="corpuswright-")
        spark.sparkContext._corpuswright_dir = made
    return made


def _own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is removed when the driver's Python ends."""
    sc = spark.sparkContext
    made = getattr(sc, "_corpuswright_own", None)
    if made is None:
        made = f"{shared_dir(spark)}/corpuswright/{sc.applicationId}"
        sc._corpuswright_own = made

        def remove() -> None:
            try:
                path = sc._jvm.org.apache.hadoop.fs.Path(made)
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
            except Exception:  # the session has ended already
                pass

        atexit.register(remove)
    return made


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here.

    The files are compressed Parquet, so the copy costs less disk than a checkpoint and a lost
    executor never recomputes what lies before it.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpuswright_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove written tables that no later plan reads: everything built on them must be written itself."""
    for t in tables:
        path = getattr(t, "_corpuswright_path", None)
        if path is not None:
            sc = t.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
