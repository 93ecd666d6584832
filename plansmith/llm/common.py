"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Functions sent to executors carry this subpackage's code with them, and so do values sent by ``ship``: executors need no copy.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

SALTS = 8


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may leave it unset; it gets a
    folder of its own."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        there = spark.sparkContext._jsc.sc().getCheckpointDir()
        if there.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            set_to = f"file://{tempfile.mkdtemp(prefix='plansmith-')}"
            spark.sparkContext.setCheckpointDir(set_to)
        else:
            set_to = there.get()
    return set_to.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Parquet tables in the shared folder that cut an operator's lineage.

    A table that a returned, still lazy result reads stays until the application ends; others go by drop()."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self._end)

    def keep(self, df: DataFrame, few: bool = False) -> DataFrame:
        """few: the table's rows are few or narrow, and it is dealt over at most four rounds of tasks behind the stage that
        computes it: tiny tables of many partitions are mostly the cost of their files."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        (df.repartition(4 * self.spark.sparkContext.defaultParallelism) if few else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None:
                _delete(self.spark, t._scratch_path)

    def tidy(self) -> None:
        """Let Spark delete the shuffle files of jobs that are over."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _end(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session is gone
            pass


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(n))


def ship(spark: SparkSession, value):
    """Broadcasts a value with its classes' code; the result gives it on an executor, made once a worker."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get():
        from pyspark import cloudpickle as loader

        if not hasattr(held, "_made"):
            held._made = loader.loads(held.value)
        return held._made

    return get


def salted(many: DataFrame, few: DataFrame, key: str, by: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Joins by a key that any share of many's rows may bear: these are dealt by a hash of ``by``, few's rows repeated."""
    m = many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    f = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return m.join(f, [key, "_salt"], how).drop("_salt")


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(batches, rows: int = 256):
    """Arrow batches in slices of few rows, so that a task holds the Python form of few texts at once."""
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.slice(i, rows)
