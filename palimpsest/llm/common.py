"""Helpers shared by the training-data operators."""
from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words: space, tab, newline, VT, FF, CR.
WHITE = "\t\n\x0b\x0c\r"


#: Most rows and bytes of an Arrow batch that a Python worker gets at once; texts can be long.
BATCH_ROWS, BATCH_BYTES = 500, 2_000_000


def seen_by_workers(spark: SparkSession) -> None:
    """Python workers find this library where the driver does, installed or not, and get batches of bounded size."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = "".join(c for c in spark.conf.get(key) if c.isdigit() or c == "-")
        if not 0 < int(now) <= most:
            spark.conf.set(key, most)
    root, env = str(Path(__file__).parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH")]))


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """For what runs inside: Arrow batches of up to so many rows, as narrow rows allow; their bytes stay bounded."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    seen_by_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder the cluster names; one is set only where none is named and all runs on one machine, as in tests."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.conf.get("spark.palimpsest.shared.dir", "")
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = f"file:///tmp/palimpsest-{uuid.uuid4().hex}"
            spark.conf.set("spark.palimpsest.shared.dir", root)
    path = f"{root.rstrip('/')}/palimpsest/{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df written to the shared folder and read again: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    seen_by_workers(spark)
    path = shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words: maximal runs without ASCII white space."""
    return F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, computed once a row: as a lambda's variable it is not copied to each of its uses when filters move down a plan."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def fit_in(total: int, each: int, least: int) -> int:
    """Number of groups of about `each` items, `least` or more."""
    return max(least, -(-int(total or 0) // each))


def boxed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a struct of the other columns, whose names then clash with nothing."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("__none"), *(F.col(f"`{c}`") for c in others)).alias("__rest"))


def unboxed(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like` from a boxed frame; n_chars, where it is there, follows text."""
    rest = {c: F.col("__rest").getField(c) for c in like.columns if c not in ("doc_id", "text")}
    if "n_chars" in rest:
        rest["n_chars"] = F.when(F.col("text").isNull(), rest["n_chars"]).otherwise(F.length("text").cast(like.schema["n_chars"].dataType))
    return df.select(*(rest.get(c, F.col(c)).alias(c) for c in like.columns))
