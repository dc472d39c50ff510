"""URL verdicts: rules, links in pages, and both walks, against plain Python and SQL over made pages with links."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from checks import compare
from pagemill.llm import link_trust
from pagemill.llm.link_trust import Rule
from pagemill.llm.queries import URL_RULES

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def cut(url):
    if not url or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def ruled(host, path):
    fitting = []
    for name, verdict in RULES:
        rule_host, _, rest = name.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rest):
            fitting.append((len(name), name, verdict))
    return max(fitting)[1:] if fitting else (None, None)


def links(html):
    out = set()
    for value in re.findall(r"""(?i)\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", html or ""):
        value = value.strip("\"'").strip(" ")
        if re.match(r"([A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]", value):
            out.add(re.search(r"//([^/?#]*)", value)[1].lower())
    return out


def walk(shares, seed, hosts, steps=link_trust.STEPS, damping=link_trust.DAMPING):
    """One personalised PageRank in whole units."""
    mass = {h: seed.get(h, 0) * link_trust.UNIT for h in hosts}
    for _ in range(steps):
        new = {h: int(seed.get(h, 0) * link_trust.UNIT * (1 - damping)) for h in hosts}
        for h, m in mass.items():
            passed = int(m * damping)
            for to, n in shares.get(h, {h: 1}).items():
                new[to] += int(passed * (n / sum(shares.get(h, {h: 1}).values())))
        mass = new
    return mass


def by_hand(rows):
    placed = [(page, *cut(url), html) for page, url, html in rows]
    seeds = {"allow": Counter(), "block": Counter()}
    ahead, back = defaultdict(Counter), defaultdict(Counter)
    for _, host, path, html in placed:
        if ruled(host, path)[1]:
            seeds[ruled(host, path)[1]][host] += 1
        for to in links(html) - {host} if host else ():
            ahead[host][to] += 1
            back[to][host] += 1
    hosts = {h for _, h, *_ in placed} | set(ahead) | set(back)
    trust, distrust = walk(ahead, seeds["allow"], hosts), walk(back, seeds["block"], hosts)
    out = []
    for page, host, path, _ in placed:
        name, verdict = ruled(host, path)
        out.append((page, host, path, name, verdict or ("block" if distrust[host] > trust[host] else "allow"), trust[host] / link_trust.UNIT, distrust[host] / link_trust.UNIT))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def linked(spark):
    """Pages of 40 hosts that link to each other, a third of them on one host, with odd urls and markup."""
    draw = random.Random(3)
    hosts = [f"{w}.{d}" for w in ("a", "b", "www.c", "d.example", "e") for d in ("org", "com", "net", "example.org", "example.com", "de", "co", "io")]
    rows = []
    for n in range(900):
        host = "hub.net" if n % 3 == 0 else draw.choice(hosts)
        url = f"{draw.choice(['http', 'HTTPS'])}://{host.upper() if n % 7 == 0 else host}/{draw.choice(['fr', 'de', 'es', 'en'])}/{draw.randrange(30)}{draw.choice(['', '?x=1', '#top'])}"
        refs = "".join(draw.choice(["<a href=\"http://{}/x\">", "<A HREF='//{}'>", "<a href= https://{}?q>", "<a href=\" http://{}\">", "<a href='/{}'>"]).format(draw.choice(hosts)) for _ in range(draw.randrange(5)))
        rows.append((n, url, f"<p>{refs}</p>"))
    rows += [(900, None, None), (901, "", ""), (902, "no scheme", "<a href='http://a.org'>"), (903, "x://", None), (None, "http://a.com/en/1", None), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2])]
    rows += [(904, "http://a.org", None), (905, "http://notexample.org/es/1", None), (906, "a://b://c.org/fr/", None), (907, "http://example.org/en/1?x", "é" * 100_000 + "<a href=http://long.io>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return rows, df.select("*", *[F.lit("x").alias(c) for c in ("host", "path", "rule", "verdict", "weight", "spread", "found")]).repartition(3).persist()


def test_against_plain_python(linked):
    rows, df = linked
    got = link_trust.judge(df, URL_RULES)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "trust", "distrust"]
    want = by_hand(rows)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    free = Counter(row[4] for row in want if row[3] is None)
    assert free["allow"] > 50 and free["block"] > 50  # links decide both ways


def test_against_sql(spark, linked, tmp_path):
    import duckdb

    linked[1].select("page_id", "url", "html").write.parquet(f"{tmp_path}/pages")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    columns, want = compare.sql_rows(con, link_trust.judge_sql(URL_RULES))
    assert compare.spark_rows(link_trust.judge(spark.read.parquet(f"{tmp_path}/pages"), URL_RULES)) == (columns, want)


def test_salted_hosts(linked, monkeypatch):
    rows, df = linked
    monkeypatch.setattr(link_trust, "EDGES_OF_A_TASK", 3)
    assert sorted(map(tuple, link_trust.judge(df, URL_RULES).collect()), key=repr) == by_hand(rows)


def test_mass_is_kept_and_spreads(spark):
    """a -> b -> c: trust of a reaches c, distrust of c reaches a; a host off the path gets none."""
    edges = spark.createDataFrame([("a", "b", 2), ("b", "c", 1), ("x", "y", 1)], "src string, dst string, pages long")
    seeds = spark.createDataFrame([("a", 10, 0), ("c", 0, 10)], "host string, trust long, distrust long")
    mass = {r.host: (r.trust, r.distrust) for r in link_trust.spread(edges, seeds).collect()}
    assert set(mass) == set("abcxy") and mass["x"] == mass["y"] == (0, 0)
    for i in (0, 1):
        assert 10 * link_trust.UNIT - 200 < sum(m[i] for m in mass.values()) <= 10 * link_trust.UNIT
    assert mass["c"][0] > 0 and mass["a"][1] > 0 and mass["a"][0] == mass["c"][1]


def test_longest_rule_wins(spark):
    rules = [Rule("block", "b.c", "/"), Rule("allow", "c", "/x"), Rule("block", "c", "/x/yyy")]
    rows = [("a.b.c", "/x"), ("c", "/x/yyyz"), ("b.c", ""), ("ab.c", "/"), ("xb.c", "/x")]
    df = spark.createDataFrame(rows, "host string, path string")
    got = [r[0] for r in df.select(link_trust.rule_of(F.col("host"), F.col("path"), rules)["rule"]).collect()]
    assert got == ["b.c/", "c/x/yyy", None, None, "c/x"]


def test_none(linked, spark):
    empty = linked[1].limit(0)
    assert link_trust.judge(empty, URL_RULES).collect() == []
    assert link_trust.spread(spark.createDataFrame([], "src string, dst string, pages long"), spark.createDataFrame([], "host string, trust long, distrust long")).collect() == []


def test_stays_in_the_jvm(linked):
    plan = link_trust.judge(linked[1], URL_RULES)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "MapInArrow", "MapInPandas", "Scan ExistingRDD[page_id, url"))
