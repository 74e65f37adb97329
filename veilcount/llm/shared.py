"""Tables that cut lineage, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where none is set and all tasks run on this machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="veilcount-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


class Tables:
    """Tables of one operator's run, which can be dropped when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def saved(self, df: DataFrame) -> DataFrame:
        """The rows, written to a table of the shared folder and read from there."""
        path = f"{shared_folder(self.spark)}/veilcount-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(table))[1])
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def drop_all_but(self, *tables: DataFrame) -> None:
        """Drops what no table among these and nothing later reads."""
        self.drop(*(t for t, _ in list(self.paths.values()) if not any(t is x for x in tables)))


def saved(df: DataFrame) -> DataFrame:
    """The rows, written to a table of the shared folder and read from there."""
    return Tables(df.sparkSession).saved(df)


def pack(carry: tuple[str, ...]) -> Column:
    """The carried columns but doc_id and text as one struct ``carried``, so that none of their names meets an operator's own."""
    rest = [F.col(f"`{c}`").alias(c) for c in carry if c not in ("doc_id", "text")]
    return F.struct(*(rest or [F.lit(True).alias("none")])).alias("carried")


def unpack(carry: tuple[str, ...], outputs: tuple[str, ...] = ()) -> list[Column]:
    """The carried columns again; one that has an output's name comes back with ``_given`` behind its own."""
    whole = F.col("carried")
    return [(F.col(c) if c in ("doc_id", "text") else whole[c]).alias(f"{c}_given" if c in outputs else c) for c in carry]


def with_fields(df: DataFrame, more: str) -> StructType:
    """The columns of ``df`` and further ones."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def give_back() -> None:
    """Returns freed memory of a Python worker, which Spark keeps for later stages, to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
