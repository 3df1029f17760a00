import random

import duckdb

from foliospark.llm import url_lists as U


def host_patterns(url):
    if not url or "://" not in url:
        return set()
    rest = url.split("://", 1)[1]
    authority = rest.split("/", 1)[0].split("?")[0].split("#")[0]
    host = authority.rsplit("@", 1)[-1].split(":")[0].rstrip(".").lower()
    labels = host.split(".")
    found = {host} | {".".join(labels[-k:]) for k in range(2, len(labels) + 1)}
    path = rest[len(rest.split("/", 1)[0]) :]
    parts = path.split("?")[0].split("#")[0].split("/")
    return found | ({f"{host}/{parts[1]}/"} if len(parts) > 2 else set())


def active(entries, pattern, day):
    state = False
    for d, action in sorted({(d, a) for p, d, a in entries if p == pattern and d is not None and a in ("add", "remove") and d <= day}, key=lambda x: (x[0], x[1])):
        state = action == "add"
    return state


def test_against_brute_force(spark):
    rng = random.Random(4)
    hosts = ["a.example.com", "b.a.example.com", "hot.example.net", "x.org"]
    entries = [(rng.choice(hosts + ["example.com", "hot.example.net/en/", "net"]), rng.randrange(0, 300), rng.choice(["add", "remove"])) for _ in range(60)] + [("x.org", None, "add"), (None, 3, "add"), ("x.org", 5, "block")]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en/', 'de/', ''])}{i}" for i in range(40)] + ["HTTPS://u:p@Hot.Example.NET.:8080/en/x?y=/z/", "no url", "", None, "http://x.org?q=/a/b/"]
    captures = [(i, rng.choice(urls), rng.randrange(0, 330)) for i in range(400)] + [(900, urls[0], None), (901, None, 5), (5, urls[1], 7), (5, urls[1], 7)]
    rows = U.evaluate(spark.createDataFrame(captures, "id long, url string, day int"), spark.createDataFrame(entries, "pattern string, day int, action string")).collect()
    assert len(rows) == len(captures)
    for r in rows:
        on = sorted((p for p in host_patterns(r.url) if active(entries, p, r.day)), key=lambda p: (-len(p), p)) if r.day is not None else []
        assert (r.n_active, r.matched) == (len(on), on[0] if on else None), r


def test_the_list_of_its_day_counts(spark):
    captures = spark.createDataFrame([(d, "http://a.b.c/x", d, "old") for d in (4, 5, 9, 10, 11, 200)], "id int, url string, day int, matched string")
    entries = spark.createDataFrame([("b.c", 5, "add"), ("b.c", 7, "add"), ("b.c", 10, "remove"), ("b.c", 12, "remove"), ("b.c", 100, "add")], "pattern string, day int, action string")
    assert {r.day: r.n_active for r in U.evaluate(captures, entries).collect()} == {4: 0, 5: 1, 9: 1, 10: 0, 11: 0, 200: 1}


def test_empty_tables(spark):
    captures = spark.createDataFrame([(1, "http://a.b/", 3)], "id int, url string, day int")
    entries = spark.createDataFrame([("a.b", 1, "add")], "pattern string, day int, action string")
    assert [r.n_active for r in U.evaluate(captures, entries.limit(0)).collect()] == [0]
    assert U.evaluate(captures.limit(0), entries).collect() == []


def test_addresses_in_brackets(spark):
    captures = [(1, "http://[2001:DB8::1]/a/x", 9), (2, "http://u@[2001:db8::1]:8080?q=/z/", 9), (3, "http://[::ffff:1.2.3.4]/a/x", 9), (4, "http://[2001:db8::1/a/", 9), (5, "http://2001:db8::1/a/", 9), (6, "http://[]/a/", 9)]
    entries = [("[2001:db8::1]", 1, "add"), ("[2001:db8::1]/a/", 2, "add"), ("[::ffff:1.2.3.4]", 1, "add"), ("3.4]", 1, "add"), ("[", 1, "add")]
    rows = U.evaluate(spark.createDataFrame(captures, "id int, url string, day int"), spark.createDataFrame(entries, "pattern string, day int, action string")).collect()
    assert {r.id: (r.n_active, r.matched) for r in rows} == {1: (2, "[2001:db8::1]/a/"), 2: (1, "[2001:db8::1]"), 3: (1, "[::ffff:1.2.3.4]"), 4: (0, None), 5: (0, None), 6: (0, None)}


def test_all_parents_of_a_host_of_many_labels(spark):
    for n in (12, 150):
        labels = [f"l{i}" for i in range(n)]
        parents = [".".join(labels[i:]) for i in range(n - 1)]
        entries = spark.createDataFrame([(p, 1, "add") for p in parents] + [(labels[-1], 1, "add")], "pattern string, day int, action string")
        rows = U.evaluate(spark.createDataFrame([(1, f"http://x.{parents[0]}/", 3), (2, f"http://{parents[1]}/", 3)], "id int, url string, day int"), entries).collect()
        assert {r.id: (r.n_active, r.matched) for r in rows} == {1: (n - 1, parents[0]), 2: (n - 2, parents[1])}


def test_deep_hosts_against_sql(spark, tmp_path):
    pages = [(i, f"http://{'.'.join(f'h{(i * k) % 5}' for k in range(1, 13))}.example.com/{'a/' if i % 2 else ''}{i}", "") for i in range(60)] + [(99, None, None), (100, "http://x.org/", "")] + [(200 + i, f"http://[2001:db8::{i}]:80/{'b/' if i % 2 else ''}", "") for i in range(40)] + [(300, "http://[::ffff:1.2.3.4]/", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(connection.sql(U.SQL).fetchall(), key=str)
    got = sorted((tuple(r) for r in U.query(spark, str(tmp_path)).select("page_id", "day", "n_active", "matched").collect()), key=str)
    assert got == want and sum(r[2] for r in got) > 10
