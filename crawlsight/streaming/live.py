"""Streams of raw pages: page rules need one page at a time, so they append exactly once."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.streaming import StreamingQuery

from ..operators import extract, rules, site
from ..schema import RAW_PAGE
from ..sources import sinks


def raw_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(RAW_PAGE).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_discoveries(stream: DataFrame, fetched_at: str, lateness: str = "1 hour") -> DataFrame:
    """One record for each final URL within the watermark."""
    return stream.withWatermark(fetched_at, lateness).dropDuplicatesWithinWatermark(["finalUrl"])


def issue_stream(stream: DataFrame, settings: rules.Settings = rules.Settings()) -> DataFrame:
    """Page issues as a stream; stateless, in append mode."""
    return rules.page_issues(extract.pages(stream), settings)


def append_issues(stream: DataFrame, out: str, checkpoint: str, settings: rules.Settings = rules.Settings()) -> StreamingQuery:
    """Parse each micro-batch once and append its pages' issues; a batch that runs again replaces its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        rules.page_issues(extract.pages(batch), settings).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _members(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The second and later pages of a group, and its first page when the second comes; the state is how many there were and the first one."""
    n, url, kind = state.get if state.exists else (0, None, None)
    for batch in batches:
        out = []
        for own, own_kind in zip(batch["finalUrl"], batch["pageType"], strict=True):
            n += 1
            if n == 1:
                url, kind = own, own_kind
                continue
            if n == 2:
                out.append((url, kind, *key, n))
            out.append((own, own_kind, *key, n))
        yield pd.DataFrame(out, columns=["finalUrl", "pageType", "code", "value", "n"])
    state.update((n, url, kind))


def duplicate_stream(pages: DataFrame) -> DataFrame:
    """Duplicate issues as pages come in, in append mode: a page is reported as soon as another one shares its title, description or text.

    ``metric`` is the size of the group when the page was reported, so a group's largest is its size. What is kept for a
    value doesn't grow with its pages; of a value that many pages of a micro-batch share, one task sees no more than those.
    """
    rows = site.duplicate_values(pages).groupBy("code", "value").applyInPandasWithState(
        _members, "finalUrl string, pageType string, code string, value string, n long", "n long, url string, kind string", "append", "NoTimeout"
    )
    return site.duplicate_issues(rows)


_PROGRESS = "batch long, pages long, totalCrawled long, issueCount long, ended boolean, target string, generatedAt string, note string"
_PARTIAL = "Partial run; site-wide reports are written when it ends."


def checkpointed(stream: DataFrame, out: str, checkpoint: str, every: int = 100, target: str = "", keep_query: bool = False, settings: rules.Settings = rules.Settings()) -> StreamingQuery:
    """Parse each micro-batch once into pages and issues below ``out``, and commit what is there each time that ``every`` pages or more have come since the last commit.

    A commit is a manifest, which is written last and names the last batch that counts; ``pages`` and ``issues`` of
    batches are never rewritten, so a commit costs the same however long the run is.
    A batch that runs again replaces its own folders and counts once. ``end`` commits the rest.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        parsed = extract.pages(batch, keep_query)
        parsed.write.mode("overwrite").parquet(f"{out}/pages/batch={number}")
        pages = spark.read.schema(parsed.schema).parquet(f"{out}/pages/batch={number}")
        rules.page_issues(pages, settings).write.mode("overwrite").parquet(f"{out}/issues/batch={number}")
        last = _progress(spark, out, number)
        if _pages_after(spark, out, last["batch"], number) >= every:
            _commit(spark, out, number, last, target, False)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def end(spark: SparkSession, out: str, target: str = "") -> None:
    """The forced commit at the end of a run: whatever whole batches there are count, however few."""
    whole = sorted(_batches(spark, out, "pages") & _batches(spark, out, "issues"))
    if whole:
        _commit(spark, out, whole[-1], _progress(spark, out, whole[-1]), target, True)


def _batches(spark: SparkSession, out: str, table: str) -> set[int]:
    """Batches whose table was written to its end."""
    found = [n for n in sinks.listed(spark, f"{out}/{table}") if n.startswith("batch=")]
    return {int(n[6:]) for n in found if "_SUCCESS" in sinks.listed(spark, f"{out}/{table}/{n}")}


def _progress(spark: SparkSession, out: str, before: int | None = None) -> dict:
    """The last manifest, or the last one of batches before ``before``."""
    numbers = [int(n[:-5]) for n in sinks.listed(spark, f"{out}/manifests") if n.endswith(".json")]
    numbers = [n for n in numbers if before is None or n < before]
    if not numbers:
        return {"batch": -1, "totalCrawled": 0, "issueCount": 0}
    return spark.read.schema(_PROGRESS).json(f"{out}/manifests/{max(numbers)}.json").first().asDict()


def _read(spark: SparkSession, out: str, table: str, after: int, upto: int) -> DataFrame:
    return spark.read.parquet(f"{out}/{table}").filter((F.col("batch") > after) & (F.col("batch") <= upto))


def _pages_after(spark: SparkSession, out: str, after: int, upto: int) -> int:
    return _read(spark, out, "pages", after, upto).count()


def _commit(spark: SparkSession, out: str, number: int, last: dict, target: str, ended: bool) -> None:
    pages = _pages_after(spark, out, last["batch"], number)
    issues = _read(spark, out, "issues", last["batch"], number).count()
    row = {"batch": number, "pages": pages, "totalCrawled": last["totalCrawled"] + pages, "issueCount": last["issueCount"] + issues, "ended": ended, "target": target, "generatedAt": dt.datetime.now(dt.UTC).isoformat(), "note": "" if ended else _PARTIAL}
    sinks.put(spark, f"{out}/manifests/{number}.json", json.dumps(row))


def read_checkpoint(spark: SparkSession, out: str) -> tuple[dict, DataFrame, DataFrame]:
    """Progress, pages and issues as of the last commit; a folder without one is refused."""
    last = _progress(spark, out)
    if last["batch"] < 0:
        raise ValueError(f"{out} holds no committed checkpoint")
    return last, *(_read(spark, out, table, -1, last["batch"]).drop("batch") for table in ("pages", "issues"))


def status_windows(fetches: DataFrame, at: str, width: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Fetches and failures by window of event time."""
    return fetches.withWatermark(at, lateness).groupBy(F.window(at, width)).agg(F.count(F.lit(1)).alias("fetches"), F.count_if(F.col("status") >= 400).alias("failures"))
