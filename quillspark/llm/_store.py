"""Where intermediate tables go: the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids up to this many (8 MB) are sent to every executor; more go through a shuffled join.
BROADCAST_IDS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder, if the master is local, as in tests.

    On a cluster it must be set: a folder of one machine would lose the other machines' rows.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and losing an executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def restrict(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows of df whose key is (left_semi) or isn't (left_anti) among ids, a materialised table of distinct keys.

    Up to BROADCAST_IDS keys are broadcast, after counting them; more are joined by shuffle. A null key equals a null key.
    Columns may bear any names, as in ``pick``.
    """
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    ids = ids.select(F.col(key).alias("_key_"))
    flat = numbered(df)
    return flat.join(F.broadcast(ids) if few else ids, F.col(f"_{df.columns.index(key)}").eqNullSafe(F.col("_key_")), how).toDF(*df.columns)


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named _0, _1 and so on."""
    return df.toDF(*(f"_{i}" for i in range(len(df.columns))))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone. Other columns may bear any name, even one of these in other letters or once more."""
    have = df.columns
    return numbered(df).select(*(F.col(f"_{have.index(n)}").alias(n) for n in names))


def map_rows(df: DataFrame, run: Callable) -> DataFrame:
    """What run makes of df's record batches, in the columns of df, whatever their names."""
    flat = numbered(df)
    return flat.mapInArrow(run, flat.schema).toDF(*df.columns)
