"""Sources: JSON lines, prepared tables, families of raw rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grids, records
from ..plans.model import RECORD


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a known schema: blank lines are skipped, a missing path is an empty table, broken lines are an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of every file under a path, computed where the files are read; a file is one row, so for files
    that fit an executor. Spark's source leaves empty files out."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_raw(spark: SparkSession, source: dict) -> DataFrame:
    """Raw rows of a source: ``path`` and ``format`` (json, parquet, orc, csv), and a ``schema`` where it should be fixed."""
    reader = spark.read.format(source.get("format", "json"))
    if "schema" in source:
        reader = reader.schema(source["schema"])
    if source.get("format") == "csv":
        reader = reader.option("header", True)
    return reader.load(source["path"])


def review_split() -> F.Column:
    """A review's split by its own ``type``, wherever its file lies."""
    return records.split_name("type")


def read_family(spark: SparkSession, dataset: str, spec: dict, seed: int) -> DataFrame:
    """Records of one dataset. spec: ``splits`` (name to source), or one ``source`` whose rows name their split, or
    ``counts`` of generated grids and the ``research`` fractions that split them."""
    if dataset == "zebralogic" and "counts" in spec:
        return grid_records(spark, spec["counts"], spec.get("research", {"research_train": 0.8, "research_validation": 0.1, "research_test": 0.1}), seed)
    if "source" in spec:
        raw = read_raw(spark, spec["source"])
        return records.normalize(raw, dataset, review_split() if "type" in raw.columns else records.split_name("split"))
    parts = [records.normalize(read_raw(spark, s), dataset, F.lit(name)) for name, s in spec["splits"].items()]
    return reduce(DataFrame.unionByName, parts)


def grid_records(spark: SparkSession, counts: dict[str, int], fractions: dict[str, float], seed: int) -> DataFrame:
    """Generated grids as records, split by puzzle within each difficulty."""
    from ..operators.sampling import group_split

    parts = []
    for i, domain in enumerate(sorted(counts)):
        g = grids.generate(spark, {domain: counts[domain]}, seed)
        parts.append(group_split(g, "source_id", fractions, seed + i))
    g = reduce(DataFrame.unionByName, parts)
    g = g.select(F.col("source_id").alias("id"), F.regexp_replace("domain", "^zebra_", "").alias("difficulty"), "grid_size", "categories", "clues", "assignment", "text", "split")
    return records.normalize(g, "zebralogic", F.col("split"))


def load_prepared(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Selected records and their schemas, by source_id."""
    return spark.read.parquet(f"{root}/records"), spark.read.parquet(f"{root}/schemas")


def empty_records(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RECORD)
