"""Sinks: flat text files and JSON lines, one folder a table, replaced as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten(df: DataFrame, separator: str = ",") -> DataFrame:
    """Arrays of text as joined text, maps and structs as JSON; text files take nothing else."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, (T.StructType, T.ArrayType, T.MapType)):
            c = F.array_join(c.cast("array<string>"), separator)
        elif isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Quotes doubled inside quotes, a header in every part."""
    own = flatten(df).select(*[f"`{c}`" for c in columns]) if columns else flatten(df)
    own.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_issues(issues: DataFrame, path: str) -> None:
    issues.persist()
    write_csv(issues, f"{path}/csv", [c for c in issues.columns if c != "metric" or "issue" not in issues.columns])
    write_json(issues, f"{path}/json")
    issues.unpersist()


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Every table of a run as CSV and JSON, computed once."""
    for name, df in tables.items():
        df.persist()
        write_csv(df, f"{path}/{name}/csv")
        write_json(df, f"{path}/{name}/json")
        df.unpersist()


def write_checkpoint(pages: DataFrame, issues: DataFrame, path: str, note: str = "Partial run; site-wide reports are written when it ends.") -> None:
    """What a run has so far, with a row of progress that is written last: a reader that finds it finds the rest whole."""
    pages.write.mode("overwrite").parquet(f"{path}/pages")
    write_issues(issues, f"{path}/issues")
    spark = pages.sparkSession
    counts = spark.read.parquet(f"{path}/pages").agg(F.count(F.lit(1)).alias("totalCrawled")).join(spark.read.json(f"{path}/issues/json", schema="url string").agg(F.count(F.lit(1)).alias("issueCount")))
    write_json(counts.withColumn("generatedAt", F.current_timestamp()).withColumn("note", F.lit(note)), f"{path}/progress")


def put(spark, path: str, text: str) -> None:
    """A small file that is there whole or not at all: written beside its place and renamed. A file of that name is replaced."""
    jvm = spark.sparkContext._jvm
    at, aside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}._writing")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(at):
        fs.delete(at, False)
    if not fs.rename(aside, at):
        raise OSError(f"{path} can't be put in its place")


def listed(spark, path: str) -> list[str]:
    """The names in a folder, or none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def read_csv(spark, path: str, schema: T.StructType) -> DataFrame:
    """Read back with cells that span lines; rows are counted by the reader, not by lines."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
