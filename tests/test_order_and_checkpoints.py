"""Order as readers expect it, fetch histories, and checkpoints of a stream."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from crawlsight import schema
from crawlsight.functions import text as tx
from crawlsight.operators import extract, fetches, graph, lineage, site
from crawlsight.sources import sinks
from crawlsight.streaming import live

HOST = "https://ex.com"
ORDERED = ["", "-", "_1", "1", "a", "A", "á", "Á", "ab", "b", "B", "z", "Z"]


def test_text_is_put_in_collated_order(spark):
    words = ORDERED[:]
    random.Random(1).shuffle(words)
    frame = spark.createDataFrame([(w,) for w in words], "w string").repartition(3)
    got = [r["w"] for r in frame.orderBy(tx.collated("w"), "w").collect()]
    assert [w for w in got if w not in ("-", "_1")] == [w for w in ORDERED if w not in ("-", "_1")] and set(got[1:3]) == {"-", "_1"}
    placed = lineage.numbered(frame, [tx.collated("w"), F.col("w")], "order", "n")
    assert [r["w"] for r in placed.orderBy("n").collect()] == got and [r["n"] for r in placed.orderBy("n").collect()] == list(range(1, len(words) + 1))


def test_edges_stand_in_collated_order(spark):
    edges = spark.createDataFrame([(f"{HOST}/{a}", f"{HOST}/{b}") for a in ("B", "a", "É", "e") for b in ("Z", "y")], schema.EDGE)
    got = [(r["source"][len(HOST) + 1 :], r["target"][len(HOST) + 1 :]) for r in graph.typed_edges(edges).collect()]
    assert got == [(a, b) for a in ("a", "B", "e", "É") for b in ("y", "Z")]


# Fetch histories


def plain_attempts(rows, retries=2):
    out, number, before = [], 0, None
    for url, seq, status, after in sorted(rows, key=lambda r: (r[0], r[1], -1 if r[2] is None else r[2], -1 if r[3] is None else r[3])):
        number = number + 1 if before == url and number < retries else 0
        failed = status is None or status in fetches.RETRYABLE
        again = failed and number < retries
        wait = 0 if not again else 3000 if status is None else int(after * 1000) if after is not None and after > 0 else (number + 2) * 3000
        out.append((url, seq, status, number, again, wait))
        before = url if failed else None
    return out


@pytest.mark.parametrize("block", [1, 3, 7, 100_000])
def test_attempts_against_the_loop(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice(["hot", "hot", "a", "b", f"u{i}"]), i, rng.choice([None, 200, 404, 429, 500, 503, 503]), rng.choice([None, 0.0, 2.0, 0.5])) for i in range(400)]
    got = fetches.attempts(spark.createDataFrame(rows, "url string, seq long, status int, retry_after double").repartition(5), block=block)
    want = plain_attempts(rows)
    assert sorted(map(str, (tuple(r) for r in got.select("url", "seq", "status", "attempt", "again", "wait_ms").collect()))) == sorted(map(str, want))
    done = fetches.fetches(got)
    assert done.agg(F.sum("attempts")).first()[0] == 400 and done.count() == sum(w[3] == 0 for w in want)
    total = {}
    for url, *_, wait in want:
        total[url] = total.get(url, 0) + wait
    assert {r["url"]: r["waited_ms"] for r in fetches.histories(done).collect()} == total


def test_no_attempts(spark):
    none = fetches.attempts(spark.createDataFrame([], "url string, seq long, status int, retry_after double"))
    assert fetches.histories(fetches.fetches(none)).isEmpty()


# Checkpoints


def raw_files(spark, folder, batches):
    n = 0
    for i, size in enumerate(batches):
        rows = [(n + k, f"{HOST}/{n + k}", f"{HOST}/{n + k}", None, False, 0, 200, 0, "text/html", None, 1, "<html><title>x</title></html>") for k in range(size)]
        spark.createDataFrame(rows, schema.RAW_PAGE).coalesce(1).write.mode("append").parquet(folder)
        n += size


def test_checkpoints_every_so_many_pages_and_at_the_end(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    with pytest.raises(ValueError, match="no committed checkpoint"):
        live.read_checkpoint(spark, out)
    raw_files(spark, raw, [2, 2, 2, 2, 2])
    live.checkpointed(live.raw_stream(spark, raw, 1), out, str(tmp_path / "state"), every=4, target=HOST).awaitTermination()
    progress, pages, issues = live.read_checkpoint(spark, out)
    assert (progress["batch"], progress["totalCrawled"], progress["ended"]) == (3, 8, False) and pages.count() == 8 and issues.count() == progress["issueCount"] > 0
    # A run that is killed between files: pages of a batch, but not its issues.
    pages.limit(1).write.parquet(f"{out}/pages/batch=5")
    assert live.read_checkpoint(spark, out)[0]["totalCrawled"] == 8
    live.end(spark, out, HOST)
    progress, pages, _ = live.read_checkpoint(spark, out)
    assert (progress["batch"], progress["totalCrawled"], progress["ended"], progress["note"]) == (4, 10, True, "") and pages.count() == 10
    assert [n for n in sinks.listed(spark, f"{out}/manifests") if n.endswith(".json")] == ["1.json", "3.json", "4.json"]


def test_a_file_is_put_whole(spark, tmp_path):
    for text in ("one", "two"):
        sinks.put(spark, str(tmp_path / "x.json"), text)
        assert (tmp_path / "x.json").read_text() == text
    assert "x.json._writing" not in sinks.listed(spark, str(tmp_path)) and sinks.listed(spark, str(tmp_path / "none")) == []


def test_duplicates_of_a_stream_are_those_of_all_pages(spark, tmp_path):
    rng, raw, n = random.Random(3), str(tmp_path / "raw"), 0
    for _ in range(3):
        rows = [(n + k, f"{HOST}/{n + k}", f"{HOST}/{n + k}", None, False, 0, 200, 0, "text/html", None, 1, f"<html><title>{rng.choice(['same', 'same', 'a', 'b', f't{n + k}', ''])}</title><body>{rng.choice('xyz')}{k}</body></html>") for k in range(12)]
        spark.createDataFrame(rows, schema.RAW_PAGE).coalesce(1).write.mode("append").parquet(raw)
        n += 12
    stream = live.duplicate_stream(extract.pages(live.raw_stream(spark, raw, 1)))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = site.duplicates(extract.pages(spark.read.schema(schema.RAW_PAGE).parquet(raw)))
    keys = ["url", "code", "severity", "category", "evidence"]
    assert sorted(map(tuple, got.select(*keys).collect())) == sorted(map(tuple, want.select(*keys).collect())) and want.count() > 10
    size = lambda df: {tuple(r) for r in df.groupBy("code", "evidence").agg(F.max("metric")).collect()}
    assert size(got) == size(want)
