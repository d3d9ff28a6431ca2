from collections import defaultdict

from crawlquarry.llm import repeated_lines as rl

PAGES = "url_hash string, host string, extra int, offset int"
CONTENT = "url_hash string, content string, updated_at double, line string"


def brute(pages, content, least=5, percent=10):
    host = {k: h.lower() for k, h, *_ in pages if k and h}
    docs = {k: c for k, c, *_ in content if k in host and c is not None}
    n = defaultdict(int)
    at = defaultdict(set)
    lines = []
    key = lambda s: "".join(c for c in s.lower() if c not in " \t0123456789")
    for k, c in docs.items():
        n[host[k]] += 1
        for i, line in enumerate(c.split("\n")):
            x = key(line)
            if sum(ch.isalpha() for ch in x) >= 4:
                at[host[k], x].add(k)
                lines.append((k, i, host[k], x))
    return {(k, i) for k, i, h, x in lines if len(at[h, x]) >= least and len(at[h, x]) * 100 >= percent * n[h]}


def corpus(size=60):
    pages = [(f"p{i}", "Big.Example" if i % 3 else "small.example", i, 1) for i in range(size)]
    content = [(f"p{i}", f"Title {i} of its own words {chr(97 + i % 26) * 5}\nShare  this page {i}\n\nSHARE THIS PAGE\nabc 12\n{'Legal notice' if i % 7 == 0 else 'other line ' + chr(97 + i % 20) * 4}", 1.0, "x") for i in range(size)]
    return pages + pages[:5] + [(None, "x", 0, 0), ("p1000", None, 0, 0)], content + [("p1000", "Share this page", 1.0, ""), ("nowhere", "Share this page", 1.0, ""), ("p1001", None, 1.0, ""), (None, "Share this page", 1.0, "")]


def found(spark, pages, content, **kw):
    return {(r.url_hash, r.line_no) for r in rl.repeated_lines(spark.createDataFrame(pages, PAGES), spark.createDataFrame(content, CONTENT), **kw).collect()}


def test_equals_brute_force_sparse_and_dense(spark):
    pages, content = corpus()
    want = brute(pages, content)
    assert want
    assert found(spark, pages, content) == want
    # Small containers and early bitmaps give the same.
    assert found(spark, pages, content, container_pages=7, dense_from=1) == want


def test_clean_and_empty(spark):
    pages, content = corpus()
    clean = {r.url_hash: (r.content, r.removed) for r in rl.without_repeated_lines(spark.createDataFrame(pages, PAGES), spark.createDataFrame(content, CONTENT)).collect()}
    assert "Share" not in clean["p3"][0] and clean["p3"][1] >= 2
    assert clean["nowhere"] == ("Share this page", 0)
    assert found(spark, [], []) == set()


def test_long_lines_and_repeats(spark):
    pages = [(f"p{i}", "h", 0, 0) for i in range(6)]
    content = [(f"p{i}", "x" * 200_000 + "\n", 1.0, "") for i in range(6)] * 2
    assert found(spark, pages, content) == {(f"p{i}", 0) for i in range(6)}
