"""Incremental copies of a table: key-set pages beyond a high-water mark, upserts by key, children by changed parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def versions(spark: SparkSession, target: str) -> list[int]:
    """The complete versions of a target folder, in order."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [str(s.getPath().getName()) for s in fs.listStatus(path)]
    return sorted(int(n[1:]) for n in found if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{target}/{n}/_SUCCESS")))


def current(spark: SparkSession, target: str, schema) -> DataFrame:
    """The latest complete version; an empty frame before the first."""
    found = versions(spark, target)
    return spark.read.schema(schema).parquet(f"{target}/v{found[-1]}") if found else spark.createDataFrame([], schema)


def upsert(target: str, stored: DataFrame, changed: DataFrame, keys: list[str], order: list[str]) -> None:
    """Writes a new version: for each key the row that comes last by `order`. Rows that come twice change nothing. A version counts once it is complete, so a run that fails leaves the old one."""
    spark = stored.sparkSession
    row = F.struct(*[c for c in stored.columns if c not in keys])
    merged = stored.unionByName(changed.select(stored.columns)).groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("row"))
    found = versions(spark, target)
    merged.select(*[F.col(c) if c in keys else F.col("row")[c].alias(c) for c in stored.columns]).write.mode("overwrite").parquet(f"{target}/v{found[-1] + 1 if found else 0}")


def after(at: str, id_col: str, mark) -> Column:
    """Rows beyond a mark (time, id) in key-set order."""
    return (F.col(at) > F.lit(mark[0])) | ((F.col(at) == F.lit(mark[0])) & (F.col(id_col) > F.lit(mark[1])))


def sync(source: DataFrame, target: str, keys: list[str], at: str = "scraped_at", id_col: str = "id", page: int | None = None, overlap: int = 60, children: dict[str, tuple[DataFrame, str, list[str]]] | None = None) -> int:
    """Brings a target folder up to date with a source and returns how many rows were beyond the high-water mark: the greatest (at, id) that the target's log of marks has.

    With `page`, one call takes that many rows beyond the mark at most, the next in key-set order; the mark moves to the last of them, so a caller that stops goes on where it was. Rows of
    the `overlap` seconds before the mark are read again, as late writers may have added some; as rows are upserted by key, those already there change nothing.
    children: name -> (table, column of the parent's key, own keys); the children of changed parents are upserted into target/name. `keys` has one parent column then.
    Rows without a time or id are never beyond a mark and are left out.
    """
    spark = source.sparkSession
    source = source.where(F.col(at).isNotNull() & F.col(id_col).isNotNull())
    marks = f"{target}/marks"
    seen = versions(spark, marks)
    mark = spark.read.parquet(f"{marks}/v{seen[-1]}").first() if seen else None
    new = source.where(after(at, id_col, mark)) if mark else source
    if page is not None:
        new = new.orderBy(at, id_col).limit(page)
    last = new.agg(F.max(F.struct(at, id_col)).alias("m"), F.count("*").alias("n")).select("m.*", "n").first()
    if not last["n"]:
        return 0
    upto = ~after(at, id_col, last)
    window = source.where(upto & (F.col(at) >= F.lit(mark[0]) - F.expr(f"INTERVAL {overlap} SECONDS"))) if mark else source.where(upto)
    parents = None
    for name, (rows, parent, own) in (children or {}).items():
        parents = parents if parents is not None else window.select(F.col(keys[0]).alias(parent)).distinct()
        upsert(f"{target}/{name}", current(spark, f"{target}/{name}", rows.schema), rows.join(parents.withColumnRenamed(parents.columns[0], parent), parent, "left_semi"), own, own)
    upsert(f"{target}/rows", current(spark, f"{target}/rows", source.schema), window, keys, [at, id_col])
    spark.createDataFrame([(last[0], last[1])], source.select(at, id_col).schema).write.mode("overwrite").parquet(f"{marks}/v{seen[-1] + 1 if seen else 0}")
    return last["n"]
