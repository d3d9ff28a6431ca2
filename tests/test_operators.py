import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlquarry.operators import discovery, heads, hosts, linkgraph, skew, transitions
from crawlquarry.session import materialize
from crawlquarry.sources import stores
from crawlquarry.streaming import hoststate, results


# --- skew


def test_weighted_values_equal_numpy(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, *range(40)]), 1) for _ in range(4000)]
    df = spark.createDataFrame(rows, "k string, v int, weight int")
    w = skew.weighted_values(df, F.col("k"), F.col("v"))
    summary = {r.key: r for r in skew.key_summary(w).collect()}
    pct = {r.key: r for r in skew.percentiles(w, {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}).collect()}
    by = defaultdict(list)
    for k, v, _ in rows:
        if k is not None:
            by[k].append(v)
    assert set(summary) == set(by)
    for k, vs in by.items():
        known = sorted(v for v in vs if v is not None)
        top = Counter(known)
        best = min(top, key=lambda v: (-top[v], v))
        assert (summary[k].rows, summary[k].distinct, summary[k].mode, summary[k].mode_rows) == (len(vs), len(top), best, top[best])
        for p, name in ((0, "p0"), (0.5, "p50"), (0.99, "p99"), (1, "p100")):
            assert pct[k][name] == known[max(1, int(np.ceil(len(known) * p))) - 1]


def test_heavy_keys_and_empty(spark):
    df = spark.createDataFrame([("H", f"u{i}") for i in range(97)] + [("h", "u1"), ("s", "x1"), ("s", "x2"), ("s", "x3"), (None, "n"), ("t", None)], "host string, url string")
    assert {(r.key, r.distinct) for r in skew.heavy_keys(df, F.lower("host"), F.col("url"), 3).collect()} == {("h", 97), ("s", 3)}
    e = df.limit(0)
    assert skew.heavy_keys(e, F.col("host"), F.col("url"), 3).count() == 0
    assert skew.percentiles(skew.weighted_values(e, F.col("host"), F.col("url")), {"p": 0.5}).count() == 0


# --- admission caps against the sequential rule


def sequential(cands, c, parent, seeds, known):
    out, selected, per, new = {}, 0, Counter(), set()
    for value, url, host in sorted(cands, key=lambda x: (-x[0], x[1])):
        external = host and host != parent and host not in seeds
        if c.per_page > 0 and selected >= c.per_page:
            out[url] = "per_page_cap"
        elif c.active and c.new_external_hosts > 0 and len(new) >= c.new_external_hosts and external and host not in known and host not in new:
            out[url] = "new_host_pressure"
        elif c.per_target_host > 0 and per[host] >= c.per_target_host:
            out[url] = "per_target_host_cap"
        else:
            out[url] = "admitted"
            selected += 1
            per[host] += 1
            if c.active and external and host not in known:
                new.add(host)
    return out


def test_caps_equal_the_sequential_rule(spark):
    rng = random.Random(11)
    for active in ("drain", "balanced"):
        c = discovery.Control(active, 0.5, 6, 2, 2)
        seeds, known, rows, want = {"s.com"}, {"k.com"}, [], {}
        for p in range(60):
            cands = []
            for i in range(rng.randrange(14)):
                host = rng.choice(["p.com", "s.com", "k.com", "n1.com", "n2.com", "n3.com", "n4.com", ""])
                cands.append((rng.choice([80, 95, 125]), f"http://{host}/{i}", host))
            for v, u, h in cands:
                rows.append((f"p{p}", u, h, "p.com", v, h in seeds, h in known, "candidate"))
            want |= {(f"p{p}", u): o for u, o in sequential(cands, c, "p.com", seeds, known).items()}
        df = spark.createDataFrame(rows, "page string, url string, host string, parent_host string, value int, is_seed boolean, known boolean, reason string")
        assert {(r.page, r.url): r.outcome for r in discovery.capped_links(df, c).collect()} == want


def test_bands():
    assert [discovery.control(p, 500_000).mode for p in (299_999, 300_000, 600_000, 900_000)] == ["expand", "balanced", "reduce", "drain"]
    with pytest.raises(ValueError):
        discovery.control(1, 0)


# --- hosts


def test_ewma_only_needs_recent_samples(spark):
    rng = random.Random(3)
    vs = [rng.uniform(1, 900) for _ in range(1200)]
    df = spark.createDataFrame([("h", i, v) for i, v in enumerate(vs)] + [("h", 5000, None), ("z", 1, -1.0), ("o", 1, 7.0)], "host string, i int, v double")
    e = 0.0
    for v in vs:
        e = v if e <= 0 else 0.8 * e + 0.2 * v
    got = {r.host: r for r in hosts.latency_ewma(df, "host", ["i"], "v").collect()}
    assert got["h"].samples == 1200 and abs(got["h"].ewma_ms - e) < 1e-9 and got["h"].last_ms == vs[-1] and got["o"].ewma_ms == 7 and "z" not in got


def test_outcomes_and_pacing(spark):
    rows = [("a", 1, 10.0, False), ("a", 2, 20.0, True), ("a", 3, 30.0, True), ("b", 4, 5.0, True), ("b", 5, 6.0, False), ("c", 6, 1.0, True)]
    got = {r.host: r for r in hosts.host_outcomes(spark.createDataFrame(rows, "h string, i int, t double, f boolean"), "h", "t", "i", "f").collect()}
    assert (got["a"].consecutive_failures, got["a"].backoff_until) == (2, 90.0) and got["b"].consecutive_failures == 0 and got["c"].backoff_until == 31.0
    req = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 0.5), ("a", 3, 10.0)], "h string, i int, t double")
    assert [(r.id, r.slot) for r in hosts.pacing_slots(req, "h", "t", "i", 1.0).orderBy("id").collect()] == [(1, 0.0), (2, 1.0), (3, 10.0)]


# --- queue


def test_overcrowded_golden(spark):
    q = spark.createDataFrame([(f"http://h/{i}", "h", "/b", "scheduled", 1.0, 0.0, float(i)) for i in range(3)], "url string, host string, branch_key string, physical_queue string, scheduler_score double, next_fetch_at double, added_at double")
    assert heads.overcrowded(q, 1, 9).count() == 2 and heads.overcrowded(q, 9, 2).count() == 1


def test_prepare_and_upsert(spark):
    tasks = spark.createDataFrame([(1, "HTTP://E.com/a/", 0.8, None, 5.0, 5.0, None), (2, "http://e.com/a", 1.2, "s", 4.0, 6.0, "explore"), (3, "http://10.0.0.1/", 1.0, None, 1.0, 1.0, None), (4, "http://e.com/b", 0.5, None, 9.0, 9.0, None), (5, "http://e.com/c", 9.0, None, 0.0, 0.0, None)], "seq int, url string, value double, source_url string, added_at double, next_fetch_at double, intent string")
    p = {r.url: r for r in transitions.prepare_tasks(tasks).collect()}
    assert set(p) == {"http://e.com/a", "http://e.com/b", "http://e.com/c"}
    a = p["http://e.com/a"]
    assert (a.value, a.source_url, a.intent, a.added_at, a.next_fetch_at) == (1.2, "s", "explore", 4.0, 5.0)
    ledger = spark.createDataFrame([("http://e.com/b", 1.0, "x", 1.0, 1.0, "retry", None, None), ("http://e.com/c", 1.0, "x", 1.0, 1.0, None, "gone", None)], "url string, discovery_value double, source_url string, added_at double, next_fetch_at double, current_intent string, terminal_reason string, last_success_at double")
    changes = {r.url: r.change for r in transitions.ledger_upsert(ledger, transitions.prepare_tasks(tasks)).collect()}
    assert changes == {"http://e.com/a": "inserted"}


def test_reach(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "b")], "source string, target string")
    assert {(r.url, r.depth) for r in linkgraph.reach(e, spark.createDataFrame([("a",)], "url string"), 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_check_reach_visits_a_page_first_checked_from_another_host(spark):
    # b/x is checked from host a at once; only the later link of its own host leads into it.
    e = spark.createDataFrame([("http://a/", "http://b/x.html"), ("http://a/", None), ("http://b/", "http://b/y.html"), ("http://b/y.html", "http://b/x.html"), ("http://b/x.html", "http://b/z.gif"), ("http://b/y.html", None)], "source string, target string")
    got = [(r.url, r.depth) for r in linkgraph.check_reach(e, spark.createDataFrame([("http://a/",), ("http://b/",)], "url string"), 3).collect()]
    assert sorted(got, key=str) == sorted([("http://a/", 0), ("http://b/", 0), ("http://b/x.html", 1), ("http://b/y.html", 1), ("http://b/z.gif", 3), (None, 1)], key=str)
    assert linkgraph.check_reach(e, spark.createDataFrame([("http://a/",)], "url string"), 0).count() == 1


# --- stores and streams

PAGE = "url_hash string, url string, host string, title string, status int, content_length int, content_type string, source_url string, outlinks array<string>, storage_tier string, storage_reason string, stored_content_bytes int, content_truncated boolean, outlink_count int, stored_outlink_count int, crawled_at double, created_at double"


def page(k, at, status=200):
    return (k, f"http://h/{k}", "H", None, status, None, None, None, None, "body", "x", 1, False, 0, 0, float(at), float(at))


def test_page_store_versions(spark, tmp_path):
    store = results.PageStore(spark, f"file://{tmp_path}/pages")
    assert store.read() is None
    store.merge(spark.createDataFrame([page("a", 1), page("b", 1)], PAGE), 0)
    again = spark.createDataFrame([page("a", 5, 404), page("a", 3)], PAGE)
    store.merge(again, 1)
    store.merge(again, 1)
    got = {r.url_hash: (r.status, r.crawled_at, r.created_at) for r in store.read().collect()}
    assert got == {"a": (404, 5.0, 1.0), "b": (200, 1.0, 1.0)}


def test_result_stream(spark, tmp_path):
    spark.createDataFrame([page("a", 1), page("b", 2)], PAGE).coalesce(1).write.parquet(f"{tmp_path}/in")
    store = results.PageStore(spark, f"file://{tmp_path}/pages")
    stream = spark.readStream.schema(PAGE).parquet(f"{tmp_path}/in")
    results.maintain(stream, store, f"{tmp_path}/ck").awaitTermination()
    assert store.read().count() == 2


def test_host_state_stream_equals_fold(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"h{rng.randrange(4)}", i, float(i), rng.random() < 0.3, rng.uniform(1, 500)) for i in range(200)]
    kind = "host string, id long, at double, failed boolean, ms double"
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 70 == part], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
    got = {r.host: r for r in hoststate.latest_states(hoststate.run_to_table(hoststate.host_states(stream), "t")).collect()}
    import pandas as pd

    for h in {r[0] for r in rows}:
        want = hoststate.fold((0, 0.0, 0.0, 0, 0.0), pd.DataFrame([r for r in rows if r[0] == h], columns=["host", "id", "at", "failed", "ms"]))
        assert (got[h].samples, got[h].streak) == (want[0], want[3]) and abs(got[h].ewma_ms - want[1]) < 1e-9


def test_seeds_and_schema(spark, tmp_path):
    (tmp_path / "seeds.json").write_text('{"seeds": [{"url": "http://a/"}, {"url": "http://b/", "enabled": false}, {"url": "http://c/", "enabled": true, "tags": ["x"]}]}')
    seeds = stores.read_seeds(spark, str(tmp_path / "seeds.json"))
    assert [r.url for r in stores.enabled_seeds(seeds).orderBy("position").collect()] == ["http://a/", "http://c/"]
    with pytest.raises(stores.SchemaError, match="lacks columns: nope"):
        stores.require_columns(seeds, "seeds", {"url", "nope"})
    assert "scheduler_score" in stores.renamed(spark.createDataFrame([(1,)], "priority int"), {"priority": "scheduler_score"}).columns


def test_materialize_keeps_rows(spark):
    df = materialize(spark.range(10).repartition(3), "x")
    assert df.count() == 10
