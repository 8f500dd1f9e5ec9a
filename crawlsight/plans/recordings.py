"""Queries over what a crawl records: probes and the crawl itself, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fetches
from ..operators.lineage import portions, saved
from ..schema import RAW_PAGE
from ..sources import probes, recorded
from . import crawl
from .adapters import HOST, ITEMS_A_TASK, LINKS, STORE, flat
from .catalogue import query

_PAGES = "SELECT DISTINCT l_suppkey AS s, CAST(1 + l_orderkey % 22 AS INT) AS p FROM lineitem"


def _answers(pages: str, more: str = "") -> str:
    """Answers to probes of each supplier's collection, of eight kinds: whole, HTML only, neither form, server error, blank, broken, repeating, timed out."""
    return f"""
SELECT s, p, 'json' AS tier, CAST(CASE WHEN s % 8 IN (1, 2) AND p = 1 THEN 404 WHEN s % 8 = 3 AND p = 3 THEN 500 WHEN s % 8 = 6 AND p = 2 THEN 403 ELSE 200 END AS INT) AS status,
  CASE WHEN s % 8 = 4 AND p = 2 THEN 'blank' WHEN s % 8 = 5 AND p = 4 THEN 'broken' ELSE 'list' END AS kind, CASE WHEN s % 8 = 7 AND p = 2 THEN 'ETIMEDOUT' END AS error{more}
FROM ({pages}) AS a WHERE NOT (s % 16 = 8 AND p = 6)
UNION ALL SELECT s, p, 'html', CAST(CASE WHEN s % 8 = 2 AND s % 3 = 0 AND p = 1 THEN 503 ELSE 200 END AS INT), CASE WHEN s % 8 = 2 AND s % 3 = 1 AND p = 1 OR s % 8 = 2 AND p = 5 THEN 'blank' ELSE 'list' END, NULL{more}
FROM ({pages}) AS b WHERE s % 8 IN (1, 2)
"""


_ANSWERS = _answers(_PAGES)
_LISTED = f"SELECT a.s, a.p, a.tier, l.l_partkey AS part FROM ({_ANSWERS}) AS a JOIN lineitem AS l ON l.l_suppkey = a.s AND 1 + l.l_orderkey % 22 = CASE WHEN a.s % 8 = 6 AND a.p >= 5 THEN 1 ELSE a.p END WHERE a.kind = 'list'"
_ENDS = f"""
u AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'parse_or_fetch_error' WHEN tier = 'html' AND p = 1 AND (status = 404 OR status >= 500 OR kind = 'blank') THEN 'both_tiers_failed' WHEN status = 404 OR status >= 500 THEN 'failed_status' WHEN kind = 'blank' THEN 'empty_response' WHEN kind = 'broken' THEN 'parse_or_fetch_error' END AS fault
  FROM ({_ANSWERS}) AS a WHERE p <= 20 AND tier = CASE WHEN s % 8 IN (1, 2) THEN 'html' ELSE 'json' END),
x AS (SELECT u.s, u.p, u.tier, part FROM u JOIN ({_LISTED}) AS l ON l.s = u.s AND l.p = u.p AND l.tier = u.tier WHERE fault IS NULL),
f AS (SELECT s, part, min(p) AS p FROM x GROUP BY s, part), n AS (SELECT s, p, count(*) AS fresh FROM f GROUP BY s, p),
c AS (SELECT s, p, CASE WHEN tier = 'json' THEN count(*) + 1 ELSE count(DISTINCT part) END AS listed FROM x GROUP BY s, p, tier),
j AS (SELECT u.s, u.p, fault, coalesce(listed, 1) AS listed, coalesce(fresh, 0) AS fresh, coalesce(fault, CASE WHEN fresh IS NULL THEN 'zero_new_products' END) AS reason FROM u LEFT JOIN n ON n.s = u.s AND n.p = u.p LEFT JOIN c ON c.s = u.s AND c.p = u.p),
g AS (SELECT s, min(r) AS gap FROM (SELECT DISTINCT s FROM ({_PAGES}) AS q) AS q2, range(1, 21) AS t(r) WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.s = q2.s AND u.p = r) GROUP BY s),
e AS (SELECT q.s, least(coalesce(min(p) FILTER (WHERE reason IS NOT NULL), 21), coalesce(min(gap), 21)) AS stop, min(gap) AS gap FROM (SELECT DISTINCT s FROM ({_PAGES}) AS q0) AS q LEFT JOIN j ON j.s = q.s LEFT JOIN g ON g.s = q.s GROUP BY q.s)
"""


def _probe_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with bodies; every JSON list holds one product whose handle is no text, every HTML page a product of another host.

    Lines meet once, in as many tasks as they call for; all else is made of the pages' lists.
    """
    at = F.concat(F.lit(f"{HOST}/collections/supplier-"), F.col("s").cast("string"))
    lines = flat(spark, sf_dir, "SELECT l_suppkey AS s, CAST(1 + l_orderkey % 22 AS INT) AS p, l_partkey AS part FROM lineitem")
    dealt = lines.repartition(portions(spark, lines.count(), ITEMS_A_TASK), "s", "p")
    lists = saved(dealt.groupBy("s", "p").agg(F.sort_array(F.collect_list("part")).alias("parts")), "probe-lists")
    rows = spark.sql(_answers("SELECT * FROM {lists}", ", parts"), lists=lists)
    repeats = F.coalesce(F.expr("s % 8 = 6 AND p >= 5"), F.lit(False))
    first = lists.filter("s % 8 = 6 AND p = 1").select("s", "parts")
    rows = rows.filter(~repeats).unionByName(rows.filter(repeats).drop("parts").join(first, "s", "left"))
    each = lambda head, tail: F.when(F.size("parts") > 0, F.concat(F.lit(head), F.array_join(F.col("parts").cast("array<string>"), tail + head), F.lit(tail))).otherwise("")
    as_json = F.concat(F.lit('{"products":['), each('{"handle":" item-', '"},'), F.lit('{"handle":7}]}'))
    as_html = F.concat(F.lit('<html><body><a href="https://other.example/products/far">far</a>'), each('<a href="/collections/x/products/item-', '?v=1">x</a>'))
    body = F.when(F.col("kind") == "blank", " \n").when(F.col("kind") == "broken", '{"products":[').when(F.col("tier") == "json", as_json).otherwise(as_html)
    return rows.select(at.alias("collection_url"), F.col("p").alias("page_no"), "tier", "status", body.alias("body"), "error")


@query("probe_stop_reasons", f"""
WITH {_ENDS}, r AS (SELECT e.s, least(stop, 20) AS stop, CASE WHEN stop = 21 THEN 'max_probe_pages' WHEN stop = gap THEN 'parse_or_fetch_error' ELSE reason END AS reason FROM e LEFT JOIN j ON j.s = e.s AND j.p = e.stop)
SELECT '{HOST}/collections/supplier-' || CAST(s AS STRING) AS collection_url, 'supplier-' || CAST(s AS STRING) AS handle, 1 AS attempted, CAST(reason = 'zero_new_products' AS INT) AS exhausted, CAST(reason IN ('both_tiers_failed', 'failed_status', 'empty_response', 'parse_or_fetch_error') AS INT) AS failed,
  CAST(stop AS INT) AS probe_pages_fetched, CAST(stop + CASE WHEN s % 8 IN (1, 2) THEN 1 ELSE 0 END AS INT) AS requests, CAST(coalesce((SELECT sum(fresh) FROM j WHERE j.s = r.s AND j.p <= r.stop AND fault IS NULL), 0) AS BIGINT) AS products_found, reason AS stop_reason FROM r""")
def probe_stop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.probe(_probe_log(spark, sf_dir)).collections


@query("probe_read_pages", f"""
WITH {_ENDS} SELECT '{HOST}/collections/supplier-' || CAST(j.s AS STRING) AS collection_url, j.p AS page, CAST(listed AS BIGINT) AS products_found, CAST(fresh AS BIGINT) AS "new" FROM j JOIN e ON e.s = j.s WHERE fault IS NULL AND j.p <= stop""")
def probe_read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.probe(_probe_log(spark, sf_dir)).pages


# --- the crawl -------------------------------------------------------------------------------------------

_DEPTH, _MOST, _SEEDS = 4, 1500, 3
_RAW_LINKS = f"SELECT src, dst FROM ({LINKS}) AS l GROUP BY src, dst"


def _generations() -> str:
    """The queue generation by generation; a page's links stand in order of their address."""
    steps = [f"""st AS MATERIALIZED (SELECT * FROM ({STORE}) AS s), ln AS MATERIALIZED (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS pos FROM ({_RAW_LINKS}) AS l WHERE dst NOT LIKE '%/cart'),
q0 AS MATERIALIZED (SELECT * FROM (SELECT url, 0 AS depth, CAST(row_number() OVER (ORDER BY n) AS BIGINT) AS place FROM (SELECT '{HOST}/' AS url, -1 AS n UNION ALL SELECT '{HOST}/collections/supplier-' || CAST(s_suppkey AS STRING), s_suppkey FROM supplier WHERE s_suppkey <= {_SEEDS}) AS z) AS y WHERE place <= {_MOST})"""]
    for d in range(1, _DEPTH + 1):
        seen = " UNION ALL ".join(f"SELECT url FROM q{i}" for i in range(d))
        steps.append(f"""q{d} AS MATERIALIZED (SELECT url, {d} AS depth, CAST(place AS BIGINT) AS place FROM (SELECT url, (SELECT count(*) FROM ({seen}) AS a) + row_number() OVER (ORDER BY o) AS place
  FROM (SELECT ln.dst AS url, min((q.place, ln.pos)) AS o FROM q{d - 1} AS q JOIN st ON st.url = q.url JOIN ln ON ln.src = st.final_url WHERE ln.dst NOT IN ({seen}) GROUP BY ln.dst) AS c) AS p WHERE place <= {_MOST})""")
    return ", ".join(steps) + ", q AS (" + " UNION ALL ".join(f"SELECT * FROM q{d}" for d in range(_DEPTH + 1)) + ")"


@query("crawl_queue", f"WITH {_generations()} SELECT q.url AS key, depth, place, CASE WHEN st.url IS NULL THEN 'no_record' ELSE 'page' END AS state FROM q LEFT JOIN st ON st.url = q.url")
def crawl_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl from the home page and a few collections over pages whose markup holds the links."""
    anchor = F.transform(F.array_sort(F.collect_list("dst")), lambda x: F.concat(F.lit('<a href="'), x, F.lit('">x</a>')))
    bodies = flat(spark, sf_dir, _RAW_LINKS).groupBy(F.col("src").alias("finalUrl")).agg(F.array_join(anchor, "").alias("_links"))
    pages = flat(spark, sf_dir, STORE).select("crawl_seq", "url", F.col("final_url").alias("finalUrl"), "status").join(bodies, "finalUrl", "left")
    html = F.concat(F.lit("<html><body>"), F.coalesce("_links", F.lit("")))
    own = {"html": html, "contentType": F.lit("text/html"), "redirected": F.lit(False), "redirectCount": F.lit(0), "depth": F.lit(0), "loadTimeMs": F.lit(0)}
    raw = pages.select(*[(own[f.name] if f.name in own else F.col(f.name) if f.name in pages.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW_PAGE.fields])
    listed = flat(spark, sf_dir, f"SELECT '{HOST}/collections/supplier-' || CAST(s_suppkey AS STRING) AS url, s_suppkey AS n FROM supplier WHERE s_suppkey <= {_SEEDS}")
    seeds = crawl.seed_rows(spark.createDataFrame([(f"{HOST}/", 0)], "url string, n long"), collections=listed)
    return crawl.crawl(raw, seeds, f"{HOST}/", crawl.Limits(_MOST, _DEPTH)).queue.select("key", "depth", "place", "state")


# --- fetch histories -------------------------------------------------------------------------------------

#: Attempts in order; one address has a third of them.
_TRIES = """
SELECT CASE WHEN event_id % 3 = 0 THEN '/hot' ELSE '/u' || CAST(user_id % 40 AS STRING) END AS url, event_id AS seq, CAST(CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 429 WHEN 'click' THEN 404 WHEN 'view' THEN 200 END AS INT) AS status,
  CAST(CASE WHEN user_id % 5 = 0 THEN 2 WHEN user_id % 5 = 1 THEN 0 END AS DOUBLE) AS retry_after FROM events
"""
_TRIED = f"""
t0 AS (SELECT *, status IS NULL OR status IN (429, 503) AS failed, row_number() OVER (ORDER BY url, seq, status NULLS FIRST) AS n FROM ({_TRIES}) AS t),
t1 AS (SELECT *, CASE WHEN lag(url) OVER (ORDER BY n) = url AND lag(failed) OVER (ORDER BY n) THEN NULL ELSE n END AS begin FROM t0),
t2 AS (SELECT *, CAST((n - max(begin) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING)) % 3 AS INT) AS attempt FROM t1),
tried AS (SELECT url, seq, status, retry_after, n - attempt AS fid, attempt, failed AND attempt < 2 AS again, CAST(CASE WHEN NOT (failed AND attempt < 2) THEN 0 WHEN status IS NULL THEN 3000 WHEN retry_after > 0 THEN retry_after * 1000 ELSE (attempt + 2) * 3000 END AS BIGINT) AS wait_ms FROM t2)
"""
_FETCHED = f"""
{_TRIED}, done AS (SELECT url, fid, count(*) AS attempts, count(*) FILTER (WHERE again AND status IS NOT NULL) AS status_retries, count(*) FILTER (WHERE again AND status IS NULL) AS error_retries, CAST(sum(wait_ms) AS BIGINT) AS waited_ms, last(status ORDER BY attempt) AS status,
  CASE WHEN last(again ORDER BY attempt) THEN 'unfinished' WHEN last(status ORDER BY attempt) IS NULL THEN 'error' WHEN last(status ORDER BY attempt) IN (429, 503) THEN 'given_up' WHEN last(status ORDER BY attempt) >= 400 THEN 'failed' ELSE 'answered' END AS outcome FROM tried GROUP BY url, fid)
"""


def _tried(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetches.attempts(flat(spark, sf_dir, _TRIES))


@query("fetch_attempts", f"WITH {_TRIED} SELECT url, seq, attempt, again, wait_ms FROM tried")
def fetch_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tried(spark, sf_dir).select("url", "seq", "attempt", "again", "wait_ms")


@query("fetch_outcomes", f"WITH {_FETCHED} SELECT url, attempts, status_retries, error_retries, waited_ms, status, outcome, CAST(count(*) AS BIGINT) AS n FROM done GROUP BY ALL")
def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fetches.fetches(_tried(spark, sf_dir))
    return done.groupBy("url", "attempts", "status_retries", "error_retries", "waited_ms", "status", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("fetch_histories", f"""
WITH {_FETCHED} SELECT url, CAST(count(*) AS BIGINT) AS fetches, CAST(sum(attempts) AS BIGINT) AS attempts, count(*) FILTER (WHERE attempts > 1) AS retried, CAST(sum(waited_ms) AS BIGINT) AS waited_ms, max(waited_ms) AS longest_wait_ms,
  count(*) FILTER (WHERE outcome = 'answered') AS answered, count(*) FILTER (WHERE outcome = 'answered' AND attempts > 1) AS recovered, last(outcome ORDER BY fid) AS last_outcome, last(status ORDER BY fid) AS last_status FROM done GROUP BY url""")
def fetch_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetches.histories(fetches.fetches(_tried(spark, sf_dir)))


# --- page speed ------------------------------------------------------------------------------------------

#: Answers of the page-speed interface: of four pages one has none, one an error, two a result.
_SPEED = f"SELECT final_url AS url, crawl_seq, status, k, CASE k % 4 WHEN 1 THEN 'timed out' END AS error, k % 4 >= 2 AS measured FROM ({STORE}) AS s"
_MEASURED = 200


@query("page_speed_sample", f"""
WITH p AS ({_SPEED}), f AS (SELECT url, min(crawl_seq) AS place FROM p WHERE status = 200 GROUP BY url ORDER BY place, url LIMIT {_MEASURED})
SELECT f.url, place, 'mobile' AS strategy, CASE WHEN measured THEN 'ok' ELSE 'error' END AS status, CASE WHEN measured THEN '' ELSE coalesce(error, 'no result') END AS error, CASE WHEN measured THEN CAST(k % 101 AS INT) END AS "performanceScore",
  CASE WHEN measured THEN CAST(k * 7 AS DOUBLE) END AS "speedIndexMs", CASE WHEN measured THEN CAST(k % 9 AS DOUBLE) / 8 END AS "cumulativeLayoutShift", CASE WHEN measured THEN 'B: ' || CAST(k + 9 AS STRING) || ' ms | A: ' || CAST(k AS STRING) || ' ms' ELSE '' END AS "topOpportunities"
FROM f JOIN (SELECT url, min(k) AS k, bool_or(measured) AS measured, min(error) AS error FROM p GROUP BY url) AS x ON x.url = f.url""")
def page_speed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = flat(spark, sf_dir, _SPEED)
    k = F.col("k").cast("string")
    audit = lambda name, body: F.concat(F.lit(f'"{name}":{{'), body, F.lit("}"))
    chance = lambda name, ms: F.concat(F.lit(f'"title":"{name}","details":{{"type":"opportunity","overallSavingsMs":'), ms, F.lit("}"))
    audits = F.concat_ws(",", audit("speed-index", F.concat(F.lit('"numericValue":'), (F.col("k") * 7).cast("string"))), audit("cumulative-layout-shift", F.concat(F.lit('"numericValue":'), ((F.col("k") % 9) / 8).cast("string"))), audit("a", chance("A", k)), audit("b", chance("B", (F.col("k") + 9).cast("string"))))
    body = F.concat(F.lit('{"lighthouseResult":{"categories":{"performance":{"score":'), ((F.col("k") % 101) / 100).cast("string"), F.lit('}},"audits":{'), audits, F.lit("}}}"))
    results = pages.filter("k % 4 > 0").select("url", F.lit("mobile").alias("strategy"), "error", F.when(F.col("measured"), body).alias("body"))
    out = recorded.page_speed_sample(pages.select(F.col("url").alias("finalUrl"), "crawl_seq", "status"), results, _MEASURED)
    return out.select("url", "place", "strategy", "status", "error", "performanceScore", "speedIndexMs", "cumulativeLayoutShift", "topOpportunities")
