"""Tables between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import run_folder

#: Rows of a table that is broadcast at most, for tables whose rows have a fixed size.
BROADCAST = 1_000_000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, its file system spelt out for Python workers."""
    base = run_folder(spark)
    if "://" not in base:
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        base = base.replace("file:/", "file:///", 1) if "://" not in base else base
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def squeezed(df: DataFrame, name: str) -> DataFrame:
    """written(), in less room."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that written() made and nothing reads any more, and lets Spark delete the shuffles of past jobs, which it does when the driver collects garbage."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        spark._jvm.System.gc()


def sent(small: DataFrame, most: int = BROADCAST) -> DataFrame:
    """A written table of rows of a fixed size, marked for broadcast if it has at most so many."""
    return F.broadcast(small) if small.count() <= most else small


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that df lacks (in any case), each like the wanted one."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        k = 0
        while (own := f"__{name}{k or ''}").lower() in taken:
            k += 1
        taken.add(own.lower())
        out.append(own)
    return out


def joined_by_group(rows: DataFrame, groups: DataFrame, key: str, count: str, large: int = 1000) -> DataFrame:
    """rows.join(groups, key) of written tables, groups having one row a key and the number of its rows: the rows of large groups meet in no task.

    Few groups are broadcast; of many, those of more than `large` rows, or of so many that they are few.
    """
    if groups.count() <= BROADCAST:
        return rows.join(F.broadcast(groups), key)
    limit = max(large, int(groups.agg(F.sum(count)).first()[0] // BROADCAST))
    big = F.broadcast(groups.where(F.col(count) > limit))
    rest = rows.join(big.select(key), key, "left_anti").join(groups.where(F.col(count) <= limit), key)
    return rows.join(big, key).unionByName(rest)
