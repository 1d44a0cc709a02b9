"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def typed(df: DataFrame, name: str, kind: str) -> Column:
    """The column as ``kind``; bare if it is so already, as a needless alias keeps Spark from sharing a shuffle."""
    return F.col(name) if dict(df.dtypes)[name] == kind else F.col(name).cast(kind).alias(name)


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` computed once, although ``v`` is used in inner lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Elements that ``running`` handles before it begins a new list.
RUN_BLOCK = 256


def running(items: Column, zero: Column, kind: str, step) -> Column:
    """The array of what a left-to-right pass over ``items`` gives out.

    ``step(state, item)`` returns a struct of the next state ``at`` and an array ``more`` (of SQL type ``kind``) to append. As appending copies
    what is there already, the pass goes by blocks, so that its cost stays linear.
    """
    empty = lambda depth: F.array().cast("array<" * depth + kind + ">" * depth)

    def within(acc: Column, x: Column) -> Column:
        return let(step(acc["at"], x), lambda s: F.struct(s["at"].alias("at"), F.concat(acc["out"], s["more"]).alias("out")))

    def over(array: Column) -> Column:
        def block(acc: Column, k: Column) -> Column:
            some = F.slice(array, k * RUN_BLOCK + 1, RUN_BLOCK)
            done = F.aggregate(some, F.struct(acc["at"].alias("at"), empty(1).alias("out")), within)
            return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

        blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(array) - 1, F.lit(0)) / RUN_BLOCK).cast("int"))
        return F.aggregate(blocks, F.struct(zero.alias("at"), empty(2).alias("out")), block, lambda acc: F.flatten(acc["out"]))

    return let(items, over)


def words(text: Column) -> Column:
    """The words of ``text`` in order; null and blank texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is missing, a local session (all threads on one machine) gets a folder of this machine; any other
    one is an error, as its executors could not see one another's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="marketloom-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage that outlives executors.

    A Parquet writer holds 100 rows before it looks at their size, and a reader decodes up to 4,096 of a file at once. Rows
    of megabytes therefore need files of few of them (``rows_a_file``; 0 for any number).
    """
    path = shared_dir(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
