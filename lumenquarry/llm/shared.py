"""What several training-data operators need: lineage cuts and word rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import folders

#: A word is a maximal run of letters and digits; the underscore is neither.
WORD = re.compile(r"[^\W_]+")

#: Code points that separate words, spelled out because Java's ``\s`` is ASCII only.
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


#: The same signs one by one.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


_written: list[tuple[SparkSession, str]] = []


def cut(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, so that a lost
    executor costs a read and not the whole lineage. The table goes when the session ends, or with
    ``release``."""
    spark = df.sparkSession
    path = folders.fresh(spark, "table")
    _written.append((spark, path))
    schema = df.schema
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def release() -> None:
    """Remove all tables that ``cut`` has written: for long sessions, once the results that read them
    are stored elsewhere."""
    while _written:
        folders.remove(*_written.pop())


#: Members of a class that join in one task.
CLASS_BLOCK = 10_000


def expanded(pairs: DataFrame, members: DataFrame, on: str, sizes: DataFrame, block: int = CLASS_BLOCK) -> DataFrame:
    """``pairs`` joined with all ``members`` of the class in column ``on``. A class of more than
    ``block`` members, by ``sizes`` (the class, n), is joined in blocks, so that a hot one is many tasks."""
    big = sizes.toDF(on, "_n").filter(F.col("_n") > block).select(on, F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    if big.isEmpty():
        return pairs.join(members, on)
    (other,) = [c for c in members.columns if c != on]
    blocks = F.coalesce("_blocks", F.lit(1))  # at most members / block rows of big
    left = pairs.join(big, on, "left").withColumn("_b", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("_blocks")
    right = members.join(big, on, "left").withColumn("_b", F.pmod(F.xxhash64(other), blocks).cast("int")).drop("_blocks")
    return left.join(right, [on, "_b"]).drop("_b")


def bare(col: Column) -> Column:
    """Letters and digits of a text in order, ignoring letter case; '' for null."""
    return F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N}]", "")


def digest(*cols: Column) -> Column:
    """128 bits that stand for the given texts (nulls count as '')."""
    return F.unhex(F.md5(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in cols])))


def keyed(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """``key`` and ``columns`` of the rows that have a key; a row without one can't be reported."""
    return df.filter(F.col(key).isNotNull()).select(key, *columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
