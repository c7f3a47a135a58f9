"""What the operators share: scratch tables in the shared folder, rows kept whole under clashing names, global order."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes between words, as a Java and Python character class: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot if it holds more than one in HOT of all rows, so there are fewer than HOT such keys.
HOT = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or where it is unset, on a local master only, a temporary one."""
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        found = f"file://{tempfile.mkdtemp(prefix='webdelta-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(_remove, spark, found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended; the folder is scratch
        pass


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/webdelta/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back. It cuts the lineage, and a lost executor takes none of it along."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._webdelta_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table of stored() that nothing reads any more."""
    _remove(df.sparkSession, df._webdelta_path)


def text_of(df: DataFrame, col: str = "text") -> Column:
    return F.coalesce(df[col].cast("string"), F.lit(""))


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct, so that no name of theirs can clash with a name of an operator."""
    return F.struct(*[df[c] for c in df.columns])


def in_order(df: DataFrame, keys: list[Column], name: str, sums: dict[str, Column] | None = None, groups: Column | None = None) -> DataFrame:
    """df stored in global order, with running totals and no window over all rows.

    Adds `rank` (0, 1, ...) and for each entry of sums its total over the rows before. With groups, counts and totals start
    anew for each value of groups, which must lead the order. Rows are range partitioned by keys; each partition counts its
    own rows, and the totals of the partitions before, a few numbers for each partition and group, are joined by broadcast.
    """
    sums = {"rank": F.lit(1)} | (sums or {})
    g = F.lit(0) if groups is None else groups
    part = stored(
        df.select("*", g.alias("_g"), *[v.cast("long").alias(f"_v_{k}") for k, v in sums.items()]).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()),
        name,
    )
    by_part = part.groupBy("_g", "_part").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select(F.col("_g").alias("_g2"), F.col("_part").alias("_part2"), *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums])
    inside = Window.partitionBy("_g", "_part").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    out = part.select("*", *[F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)).alias(f"_i_{k}") for k in sums])
    out = out.join(F.broadcast(base), (out["_g"].eqNullSafe(base["_g2"])) & (out["_part"] == base["_part2"]))
    return out.select(*df.columns, *[(F.col(f"_i_{k}") + F.col(f"_b_{k}")).alias(k) for k in sums])


def slices(batches, columns=("text",), most: int = 4 << 20):
    """Cuts Arrow batches into runs of rows whose named columns hold about `most` bytes, or one row, so memory stays bounded."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.zeros(batch.num_rows, np.int64)
        for c in columns:
            size += np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0))
        at = np.unique(np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()) + most, most)))
        edges = np.unique(np.concatenate([[0], at[(at > 0) & (at < batch.num_rows)], [batch.num_rows]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield batch.slice(a, b - a)


def lean(run):
    """run(batches), after whose last batch the worker gives the memory it no longer uses back to the system.

    A worker lives on when its task ends, beside the JVM stages that follow; what the allocators keep would count for as long.
    """

    @functools.wraps(run)
    def all_of(batches):
        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return all_of


def joined_with_hot(rows: DataFrame, table: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """rows joined to table, unique by `on`, whose column `count` says how many rows have the key; total: of all rows.

    The fewer than HOT keys with more than one in HOT of the rows are joined by broadcast, the rest by shuffle, so no key's
    rows meet in one task. Read rows from a stored table: they are scanned twice.
    """
    hot = F.col(count) * HOT > total
    few, many = F.broadcast(table.filter(hot)), table.filter(~hot)
    return rows.join(few, on).unionByName(rows.join(few.select(on), on, "left_anti").join(many, on))
