"""Small cases of requeueing, leases, telemetry, stores and streams; ranks over ranges against plain windows."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crawlquarry.functions import content, html
from crawlquarry.operators import discovery, hosts, linkgraph, reports, requeue, skew, telemetry
from crawlquarry.sources import stores
from crawlquarry.streaming import hoststate, results


def test_ranks_over_ranges_equal_windows(spark):
    # One host holds most rows, one has none, one is null.
    rows = [("hot" if i % 5 else None if i % 2 else "cold", i % 7, i * 37 % 101, i) for i in range(400)]
    df = spark.createDataFrame(rows, "host string, branch int, v int, id int")
    order = [F.desc("v"), F.asc("id")]
    parts = skew.in_ranges(df, "host", order)
    assert parts.where("host = 'hot'").select("part").distinct().count() > 1
    got = skew.running_max(skew.ranked(skew.ranked(parts, ["host"], order, "r"), ["host", "branch"], order, "b"), ["host"], order, F.col("id"), "top")
    w = Window.partitionBy("host").orderBy(*order)
    want = df.withColumns({"r": F.row_number().over(w), "b": F.row_number().over(Window.partitionBy("host", "branch").orderBy(*order)), "top": F.max("id").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    key = lambda d: {x.id: (x.r, x.b, x.top) for x in d.collect()}
    assert key(got) == key(want)


def test_ewma_has_no_reach(spark):
    values = [(("h", i, 100.0 + i % 13)) for i in range(700)] + [("h", 900, None), ("h", 901, -1.0), ("one", 1, 7.0)]
    df = spark.createDataFrame(values, "host string, at int, ms double")
    mean = 0.0
    for _, _, v in values[:700]:
        mean = v if mean <= 0 else 0.8 * mean + 0.2 * v
    got = {r.host: r for r in hosts.latency_ewma(df, "host", ["at"], "ms").collect()}
    assert got["h"].samples == 700 and abs(got["h"].ewma_ms - mean) < 1e-9 and got["h"].last_ms == values[699][2]
    assert got["one"].ewma_ms == 7.0
    assert hosts.latency_ewma(df.limit(0), "host", ["at"], "ms").count() == 0


def test_nofollow_and_scope(spark):
    p = spark.createDataFrame(
        [("a", "http://x.org/p", "T", 10, "text/html", ["http://x.org/q", "http://y.org/r"], "index, NOFOLLOW"), ("b", "http://x.org/s", None, None, None, ["http://x.org/t", "http://y.org/u"], None), ("c", "http://x.org/n", None, None, None, None, "nofollow")],
        "url_hash string, url string, title string, content_length int, content_type string, outlinks array<string>, meta_robots string",
    )
    none = spark.createDataFrame([], "host string, low_value boolean")
    scored = discovery.scored_links(discovery.page_links(p), none.select("host"), none)
    c = discovery.Control("expand", 0.5, 200, 8, 8)
    reasons = {r.url: r.reason for r in discovery.decided_links(scored, c).collect()}
    assert reasons["http://x.org/q"] == reasons["http://y.org/r"] == "nofollow_parent" and reasons["http://x.org/t"] == reasons["http://y.org/u"] == "candidate"
    assert {r.url: r.raw_value for r in scored.collect()} == {"http://x.org/q": 110, "http://y.org/r": 35, "http://x.org/t": 125, "http://y.org/u": 80}
    scoped = {r.url: r.reason for r in discovery.decided_links(scored, c, same_host=True).collect()}
    assert scoped["http://y.org/r"] == scoped["http://y.org/u"] == "scope_filtered" and scoped["http://x.org/q"] == "nofollow_parent"
    d = discovery.decided_links(scored, c)
    counts = discovery.admission_counts(d, discovery.capped_links(d, c))
    assert {r.reason: r.n for r in counts.collect()} == {"nofollow_parent": 2, "admitted": 2, "external_generic": 1}
    assert tuple(discovery.admission_summary(counts).collect()[0]) == (4, 2, 2, 1, 0.5)
    assert discovery.admission_summary(counts.limit(0)).collect()[0].ratio is None


PAGE = "url_hash string, url string, host string, title string, status int, content_length int, outlink_count int, crawled_at double, created_at double"


def page(k, at, created, url=None, host="H", status=200):
    return (k, url or f"http://h/{k}", host, None, status, None, 0, float(at), float(created))


def test_upserts_keep_the_first_identity(spark):
    old = spark.createDataFrame([page("a", 1, 1, "http://first/a", "First")], PAGE)
    new = spark.createDataFrame([(*page("a", 5, 5, "http://second/a", "Second", 404), None), (*page("b", 2, 2), ""), (*page("c", 2, 2), "timeout"), (*page("a", 3, 3, status=500), None)], PAGE + ", error string")
    got = {r.url_hash: r for r in stores.upsert_pages(old, new).collect()}
    assert set(got) == {"a", "b"} and (got["a"].url, got["a"].host, got["a"].created_at, got["a"].status, got["a"].crawled_at) == ("http://first/a", "first", 1.0, 404, 5.0)


def test_bodies_are_put_and_deleted(spark, tmp_path):
    bodies = spark.createDataFrame([("a", "old", 1.0), ("b", "stays", 1.0), ("c", "goes", 1.0)], "url_hash string, content string, updated_at double")
    incoming = spark.createDataFrame([("a", "new", 2.0), ("a", "older", 1.5), ("c", None, 2.0), ("d", "", 2.0), ("e", "fresh", 2.0), (None, "x", 1.0)], bodies.schema)
    assert {(r.url_hash, r.content) for r in stores.put_bodies(bodies, incoming).collect()} == {("a", "new"), ("b", "stays"), ("e", "fresh")}
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "abc.txt").write_text("Größe", encoding="utf-8")
    assert [(r.url_hash, r.content) for r in stores.read_bodies(spark, str(tmp_path)).collect()] == [("abc", "Größe")]


def test_store_rewrites_touched_buckets_only(spark, tmp_path):
    store = results.PageStore(spark, f"file://{tmp_path}/store", buckets=8)
    store.merge(spark.createDataFrame([page(f"k{i}", 1, 1) for i in range(40)], PAGE), 0)
    before = store.manifest(0)
    store.merge(spark.createDataFrame([page("k3", 9, 9, status=404), page("k3", 4, 4)], PAGE), 1)
    after = store.manifest(1)
    assert len(before) == 8 and sum(after[b] != before[b] for b in after) == 1
    rows = {r.url_hash: r for r in store.read().collect()}
    assert len(rows) == 40 and rows["k3"].status == 404 and rows["k3"].created_at == 1.0
    store.merge(spark.createDataFrame([page("k3", 9, 9, status=404)], PAGE), 1)
    assert store.read().count() == 40 and store.versions() == [0, 1]
    store.merge(spark.createDataFrame([], PAGE), 2)
    assert store.read().count() == 40


def test_documents_logs_and_migrations(spark, tmp_path):
    stores.write_document(spark.createDataFrame([(2, "b"), (1, None)], "n int, a string"), f"file://{tmp_path}/doc")
    (part,) = (tmp_path / "doc").glob("part-*")
    assert sorted(json.loads(part.read_text()), key=lambda r: r["n"]) == [{"n": 1}, {"a": "b", "n": 2}]
    log = stores.ObservationLog(spark, f"file://{tmp_path}/log", max_bytes=10, keep=2)
    for i in range(4):
        log.append(spark.createDataFrame([(i, "x" * 20)], "b int, a string"))
    assert log.numbers() == [2, 3] and sorted(r.value for r in log.read().collect())[0] == '{"a":"' + "x" * 20 + '","b":2}'
    with pytest.raises(ValueError):
        stores.ObservationLog(spark, "x", keep=0)
    ran = []

    def fail(s):
        raise RuntimeError("not yet")

    at = f"file://{tmp_path}/applied"
    assert stores.migrate(spark, at, {"002": lambda s: ran.append(2), "001": lambda s: ran.append(1)}) == ["001", "002"]
    with pytest.raises(RuntimeError):
        stores.migrate(spark, at, {"001": fail, "003": lambda s: ran.append(3), "004": fail})
    assert stores.migrate(spark, at, {"003": fail, "004": lambda s: ran.append(4)}) == ["004"] and ran == [1, 2, 3, 4]


def test_holds_expire_with_the_watermark(spark, tmp_path):
    schema = "key string, kind string, at timestamp, until double"
    src = tmp_path / "in"
    src.mkdir()
    t = 1_700_000_000
    batches = [[("l1", "lease", t, t + 60.0), ("b", "backoff", t, t + 900.0)], [("l1", "lease", t + 30, t + 200.0)], [("x", "lease", t + 400, t + 9999.0)], [("y", "lease", t + 500, t + 9999.0)], [("z", "lease", t + 600, t + 9999.0)]]
    for i, b in enumerate(batches):
        (src / f"{i}.json").write_text("\n".join(json.dumps({"key": k, "kind": n, "at": F.__name__ and __import__("datetime").datetime.fromtimestamp(a, __import__("datetime").timezone.utc).isoformat(), "until": u}) for k, n, a, u in b))
        import os

        os.utime(src / f"{i}.json", (t + i, t + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    q = hoststate.expiries(stream).writeStream.format("memory").queryName("expired").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("expired").collect()] == [("l1", "lease", t + 200.0)]


def test_telemetry_of_nothing(spark):
    got = telemetry.timing_summaries(spark.createDataFrame([("stages", "fetch_ms", None)], "part string, field string, ms double")).collect()
    assert len(got) == 40 and all(tuple(r)[2:] == (0, 0.0, 0.0, 0.0, 0.0) for r in got)
    rows = spark.createDataFrame([("q", 1, 1, None, 4), ("q", 2, 1, 5.0, 2), ("q", 3, 1, 3.0, 9), ("e", 1, 1, None, 1)], "queue string, at int, seq int, wait_ms double, depth int")
    assert {tuple(r) for r in telemetry.queue_waits(rows).collect()} == {("q", 3.0, 5.0, 9), ("e", 0.0, 0.0, 1)}


def test_sections_that_fail_are_named(spark):
    done, failed = reports.safely({"good": lambda: spark.range(1), "bad": lambda: spark.table("no_such_table"), "worse": lambda: spark.range(1).select(F.raise_error(F.lit("x")))})
    assert [r.section for r in done.collect()] == ["good"] and failed == ["bad", "worse"]


def test_content_expressions(spark):
    def one(c, **columns):
        return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]).select(c).collect()[0][0]

    text = "word " * 200
    assert one(content.needs_browser("h"), h=f"<p>{text}</p>") is False and one(content.needs_browser("h"), h=f'<div id="app"> </div><p>{text}</p>') is True
    assert one(content.needs_browser("h"), h=f"<script>{text}</script><p>few</p>") is True and one(content.needs_browser("h"), h=f"<p ng-app>{text}</p>") is True
    assert one(content.title("h"), h="<TITLE lang=en>\n A  b </TITLE><title>c</title>") == "A  b" and one(content.title("h"), h="none") in ("", None)
    assert one(content.meta_robots("h"), h="<meta content='NoIndex, nofollow' name=\"ROBOTS\">") == "noindex, nofollow" and one(content.meta_robots("h"), h="<meta name='x' content='y'>") == ""
    assert one(html.css_first(F.col("h"), "b"), h="<b> </b><b>x</b>") == "x" and one(html.css_first(F.col("h"), "i"), h="<b>x</b>") is None
    assert one(html.images_column(F.col("h")), h="<img src=a><img alt=b src=c><img>") == [("a", ""), ("c", "b")]
    assert one(html.links_column(F.col("h")), h="<a href='#x'> t </a><a>no</a>") == [("#x", "t")]
    assert one(html.extract_all(F.col("h"), {"p": "p", "none": "i"}), h="<p>1</p><p></p><p>2</p>") == {"p": ["1", "2"], "none": []}


def test_recursable_links(spark):
    rows = [("http://a.org/x/", True), ("http://a.org", True), ("http://a.org/p.HTML?q=1", True), ("http://a.org/p", False), ("http://b.org/", False), ("http://a.org:8080/", False), ("http://a.org/f.pdf", False)]
    df = spark.createDataFrame(rows, "u string, want boolean").withColumn("base", F.lit("http://a.org/start"))
    assert all(r.got == r.want for r in df.withColumn("got", linkgraph.recursable("u", "base")).collect())


def test_worker_pools(spark):
    got = [tuple(r) for r in telemetry.worker_pools(spark.createDataFrame([(0, 0.5), (6, 0.3), (4, 2.0)], "concurrency int, probing_ratio double")).collect()]
    assert got == [(0, 0.5, 1, 0, 1, 0, 16), (6, 0.3, 5, 1, 3, 2, 24), (4, 2.0, 3, 1, 1, 2, 16)]


def test_requeue_defaults():
    assert requeue.QUEUE_OF_INTENT["retry"] == "scheduled" and requeue.INTENT_OF_QUEUE["refresh"] == "refresh"


def test_observations_within_a_budget(spark, tmp_path):
    from crawlquarry.streaming import observe

    log = stores.ObservationLog(spark, f"file://{tmp_path}/obs")
    state = iter([True, False, True, True, True])
    sections = lambda: {"good": lambda: spark.range(2), "flaky": (lambda: spark.range(1)) if not next(state) else (lambda: spark.table("gone"))}
    with pytest.raises(observe.BudgetSpent):
        observe.observe(sections, log, rounds=9, budget=2)
    lines = [json.loads(r.value) for r in log.read().collect()]
    assert len(lines) == 10 and sum("json" not in x for x in lines) == 4


def test_pipeline_of_fetched_pages(spark, tmp_path):
    schema = PAGE + ", content_type string, outlinks array<string>, content string, error string"
    fetched = lambda k, at, body, links=None, error=None: (*page(k, at, at, url=f"http://h.org/{k}"), "text/html", links, body, error)
    src = tmp_path / "in"
    batches = [
        [fetched("a", 1, "<a href='/x'>x</a><a href='http://o.org/'>o</a>"), fetched("b", 1, None, ["http://h.org/y"]), fetched("e", 1, "<a href='/no'>n</a>", None, "timeout")],
        [fetched("a", 2, "<a href='/x'>x</a><a href='/z'>z</a>"), fetched("c", 2, "")],
    ]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(src))
    p = results.CrawlPipeline(spark, f"file://{tmp_path}/crawl", buckets=4)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    p.run(stream, str(tmp_path / "cp")).awaitTermination()
    assert {r.url_hash: r.outlinks for r in p.store.read().collect()} == {"a": ["http://h.org/x", "http://h.org/z"], "b": ["http://h.org/y"], "c": None}
    assert {r.url for r in p.tasks().collect()} == {"http://h.org/x", "http://h.org/z", "http://o.org/", "http://h.org/y"}
    lines = [json.loads(r.value) for r in spark.read.option("recursiveFileLookup", "true").text(f"file://{tmp_path}/crawl/out").collect()]
    assert len(lines) == 4 and not any("content" in x for x in lines)
    p.process(spark.createDataFrame(batches[1], schema), 1)
    assert p.tasks().count() == 4


def test_upkeep_steps_see_one_another(spark):
    import os

    from crawlquarry.operators import frontier
    from crawlquarry.plans.sql import NOW
    from crawlquarry.session import materialize, table

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    s = frontier.snapshot(spark, d, NOW)
    after, changes = requeue.apply_upkeep(s, frontier.pages(table(spark, d, "pages")), {"admit": 50, "refresh": 20, "per_host": 3, "per_branch": 2}, materialize)
    assert list(changes) == ["recovered", "admitted", "quarantined", "refreshed", "delayed", "retired", "promoted"] and changes["admitted"] == 50
    # What was admitted is queued; the snapshot at the start hasn't changed.
    assert after.queue.join(s.queue.select("url"), "url", "left_anti").count() > 0
    retired = s.ledger.where("terminal_reason IS NULL").select("url").join(after.ledger.where("terminal_reason IS NOT NULL").select("url"), "url")
    assert retired.count() >= min(1, changes["retired"]) and retired.join(after.queue, "url", "left_semi").count() == 0
    up = after.queue.where("physical_queue = 'runnable'").count() - s.queue.where("physical_queue = 'runnable'").count()
    assert changes["promoted"] >= 0 and up <= changes["promoted"]
    # Delays come after refreshes: nothing that was delayed is due now.
    assert after.queue.where("physical_queue = 'refresh'").count() >= changes["refreshed"]
