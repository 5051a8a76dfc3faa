"""What the corpus operators share: staging in the shared folder, table readers and text patterns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import shared_dir

#: Runs of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: The six ASCII blanks, for trimming.
BLANKS = " \t\n\x0b\x0c\r"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

_scratch: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A folder that the driver and all executors reach, new for every application."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        folder = shared_dir(spark)
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _scratch[app] = f"{folder.rstrip('/')}/llm-{uuid.uuid4().hex}"
    return _scratch[app]


def staged(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet, with the writer's options, to the shared folder and read it back.

    Cuts the lineage: a lost executor costs its running tasks, never an earlier step.
    """
    path = f"{scratch(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, or with underscores behind it the first form that no column of the frames has (case aside)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
