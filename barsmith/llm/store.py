"""Tables written to the folder all executors share, and read back: the cut between two jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.session import shared_dir


#: Whether the shuffle files of a finished write are removed at once, not when the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as Parquet in the shared folder; a lost executor costs a read, not a rerun."""
    conf = df.sparkSession.conf
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    before = conf.get(SHUFFLE_CLEANUP, None)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if before is None:
            conf.unset(SHUFFLE_CLEANUP)
        else:
            conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` has not got, whatever case its own are in."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def keyed(df: DataFrame, name: str) -> DataFrame:
    """A hash of every column but maps: the same for a recomputed row, unlike a generated id."""
    cols = [F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t and t != "variant"]
    return df.withColumn(name, F.xxhash64(*cols))
