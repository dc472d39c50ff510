"""URL verdicts from host rules and, where no rule fits, from trust and distrust that spread over links between hosts.

Hosts with pages that a rule allows are trusted seeds, hosts with pages that a rule blocks are distrusted ones. Trust walks
along links (whom a trusted host links to), distrust walks against them (who links to a blocked host): two personalised
PageRanks over the same host edges, advanced together in one join and one grouping per step. Masses are whole numbers,
so sums do not depend on the order of rows, and a repeated task gives the same verdicts.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from pagemill.plans.skew import join_on_hot_key
from pagemill.plans.stored import materialize

UNIT = 1_000_000  # mass of one seed page
DAMPING = 0.6  # share of its mass that a host passes on
STEPS = 12  # 0.6 ** 12: about a five-hundredth of the mass is still under way
THRESHOLD = 0.5  # a host is blocked where distrust is more than this share of its mass
STORE_EVERY = 4  # steps between two cuts of the lineage
EDGES_OF_A_TASK = 50_000  # edges of one host that meet its mass in one task
LINK = r"""(?i)\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


class Rule(NamedTuple):
    """``host`` and its subdomains, paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def _lower(value: Column) -> Column:
    return F.translate(value, string.ascii_uppercase, string.ascii_lowercase)


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    """Lower-case host after the first ``://``; empty where there is none."""
    return F.coalesce(_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty where there is no host."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def linked_hosts(html: Column) -> Column:
    """Distinct hosts that a page's ``href`` values name; relative ones name none."""
    values = F.transform(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)), lambda v: F.trim(F.btrim(v, F.lit("\"'"))))
    whole = F.filter(values, lambda v: v.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]"))
    return F.array_distinct(F.transform(whole, lambda v: _lower(F.regexp_extract(v, r"//([^/?#]*)", 1))))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct of ``rule`` and ``verdict``; null where none does."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        named = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(rule.fits(host, path), named).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(``src``, ``dst``, ``pages``): how many pages of one host link to another. Links of a host to itself say nothing about it."""
    rows = pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(linked_hosts(F.col("html"))).alias("dst"))
    return rows.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("pages"))


def _walks(edges: DataFrame) -> DataFrame:
    """Edges of both walks with the share of a host's mass that each takes, salted at hosts with many of them."""
    ahead = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "pages")
    back = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "pages")
    both = ahead.union(back)
    sizes = both.groupBy("kind", "host").agg(F.sum("pages").alias("all_pages"), F.count("*").alias("degree"))
    sizes = sizes.withColumn("salts", F.ceil(F.col("degree") / EDGES_OF_A_TASK).cast("int"))
    shared = both.join(sizes, ["kind", "host"]).withColumn("share", F.col("pages") / F.col("all_pages"))
    return shared.select("kind", "host", F.pmod(F.xxhash64("to"), F.col("salts")).cast("int").alias("salt"), "to", "share", "salts")


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """Mass per host after ``steps`` steps of both walks: (``host``, ``trust``, ``distrust``) in ``UNIT`` a seed page.

    ``seeds`` holds (``host``, ``trust``, ``distrust``) in pages. In each step a host hands ``damping`` of its mass to the hosts its
    edges lead to, by their pages, and its seed pages give the rest anew; where no edge leaves a host, its mass stays. Every host of
    ``edges`` or ``seeds`` gets a row. Parts of a unit are lost. No edges and no seeds give an empty table.
    """
    walks = materialize(_walks(edges), "walks")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("seed")) for k in ("trust", "distrust")]))
    starts = seeds.select("host", kinds.alias("k")).select("k.kind", "host", (F.col("k.seed") * UNIT).cast("long").alias("seed"))
    nothing = F.lit(0).cast("long").alias("seed")
    ends = walks.select("kind", "host", nothing, "salts").union(walks.select("kind", F.col("to").alias("host"), nothing, F.lit(0).alias("salts")))
    nodes = starts.withColumn("salts", F.lit(0)).union(ends).groupBy("kind", "host").agg(F.sum("seed").alias("seed"), F.max("salts").alias("salts"))
    nodes = materialize(nodes, "nodes")
    fresh = nodes.select("kind", "host", F.floor(F.col("seed") * (1 - damping)).cast("long").alias("mass"), "salts")
    state = nodes.withColumnRenamed("seed", "mass")
    walks = walks.drop("salts")
    for step in range(1, steps + 1):
        passed = F.floor(F.col("mass") * damping).cast("long")
        salts = F.when(F.col("salts") > 0, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.lit(-1)))
        met = state.filter("mass > 0").withColumn("salt", F.explode(salts)).join(walks, ["kind", "host", "salt"], "left")
        to = F.when(F.col("salts") > 0, F.col("to")).otherwise(F.col("host"))  # without edges the mass stays
        moved = met.select("kind", to.alias("host"), F.floor(passed * F.coalesce("share", F.lit(1.0))).cast("long").alias("mass"), F.lit(0).alias("salts"))
        state = fresh.union(moved.filter("host IS NOT NULL")).groupBy("kind", "host").agg(F.sum("mass").alias("mass"), F.max("salts").alias("salts"))
        if step % STORE_EVERY == 0 or step == steps:
            state = materialize(state, "masses")
    mass = {k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0)).cast("long").alias(k) for k in ("trust", "distrust")}
    return state.groupBy("host").agg(*mass.values())


def judge(
    pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url", html: str = "html",
    damping: float = DAMPING, steps: int = STEPS, threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per page: ``key``, ``host``, ``path``, ``rule``, ``verdict``, ``trust``, ``distrust``.

    ``verdict`` is that of the longest fitting rule, else ``block`` where distrust is more than ``threshold`` of the host's mass,
    else ``allow``: a host that neither walk reaches is allowed, and so is a url without host. Rules are a short list of literals.
    Null or empty html has no links, a null url neither host nor path, a null key stays null. Repeated rows are judged
    alike and all returned, and each counts as a page. Further columns of the input are dropped, whatever their names. Long pages are
    read whole. Equal trust and distrust allow. An empty table gives an empty one. One pass over the pages finds links and
    rules; verdicts reach the pages by a join that splits hosts with many pages.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    placed = pages.select(F.col(key).alias(key), F.col(html).alias("html"), host.alias("host"), path.alias("path"))
    edges = host_edges(placed)
    # Which copy of a host's verdict a page meets: any number that stays the same when a task runs again.
    ruled = placed.drop("html").withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).withColumn("spread", F.monotonically_increasing_id())
    counted = {k: F.count_if(F.col("found.verdict") == v).alias(k) for k, v in (("trust", "allow"), ("distrust", "block"))}
    hosts = materialize(ruled.groupBy("host").agg(F.count("*").alias("weight"), *counted.values()), "hosts")
    masses = spread(edges, hosts.filter("trust + distrust > 0").select("host", "trust", "distrust"), damping, steps)
    scored = hosts.select("host", "weight").join(masses, "host", "left").select(
        "host", "weight", *[(F.coalesce(F.col(k), F.lit(0)) / UNIT).alias(k) for k in ("trust", "distrust")]
    )
    judged = join_on_hot_key(ruled, scored, "host", "weight", "spread", "left")
    by_mass = F.when(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), "block").otherwise("allow")
    return judged.select(
        key, "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", by_mass).alias("verdict"), "trust", "distrust"
    )


def judge_sql(rules: Sequence[Rule], damping: float = DAMPING, steps: int = STEPS, threshold: float = THRESHOLD) -> str:
    """The same verdicts as SQL over the view ``pages``, one common table per step."""
    fits = lambda r: f"(host = '{r.host}' OR host LIKE '%.{r.host}') AND path LIKE '{r.path}%'"
    longest = sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name), reverse=True)
    pick = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in longest) + " END"
    lower = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
    parts = [
        "cut AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages)",
        f"""placed AS (SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), {lower}), '') AS host,
            coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut)""",
        f"ruled AS (SELECT page_id, host, path, {pick(lambda r: r.name)} AS rule, {pick(lambda r: r.verdict)} AS said FROM placed)",
        f"""hrefs AS (SELECT host, list_transform(regexp_extract_all(html, '{LINK.replace("'", "''")}', 1), lambda v: trim(trim(v, '"'''))) AS found
            FROM placed WHERE host <> '')""",
        rf"""named AS (SELECT host AS src, unnest(list_distinct(list_transform(
            list_filter(found, lambda v: regexp_matches(v, '^([A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]')),
            lambda v: translate(regexp_extract(v, '//([^/?#]*)', 1), {lower})))) AS dst FROM hrefs)""",
        "edges AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM named WHERE src <> dst GROUP BY ALL)",
        """both_ways AS (SELECT 'trust' AS kind, src AS host, dst AS target, n FROM edges
            UNION ALL SELECT 'distrust', dst, src, n FROM edges)""",
        "walks AS MATERIALIZED (SELECT kind, host, target, n / sum(n) OVER (PARTITION BY kind, host) AS share FROM both_ways)",
        """seeds AS (SELECT host, count(*) FILTER (said = 'allow') AS trust, count(*) FILTER (said = 'block') AS distrust
            FROM ruled GROUP BY host HAVING count(said) > 0)""",
        f"""starts AS (SELECT 'trust' AS kind, host, trust * {UNIT} AS seed FROM seeds
            UNION ALL SELECT 'distrust', host, distrust * {UNIT} FROM seeds
            UNION ALL SELECT kind, host, 0 FROM walks UNION ALL SELECT kind, target, 0 FROM walks)""",
        """nodes AS MATERIALIZED (SELECT s.kind, s.host, sum(s.seed)::BIGINT AS seed, max(w.host IS NOT NULL) AS leaves
            FROM starts s LEFT JOIN (SELECT DISTINCT kind, host FROM walks) w ON s.kind = w.kind AND s.host = w.host GROUP BY 1, 2)""",
        "step0 AS (SELECT kind, host, seed AS mass FROM nodes)",
    ]
    passed = f"floor(x.mass * {damping}::DOUBLE)"
    for i in range(1, steps + 1):
        parts.append(f"""step{i} AS MATERIALIZED (SELECT kind, host, sum(mass)::BIGINT AS mass FROM (
            SELECT kind, host, floor(seed * {1 - damping}::DOUBLE)::BIGINT AS mass FROM nodes
            UNION ALL SELECT x.kind, x.host, {passed}::BIGINT FROM step{i - 1} x JOIN nodes n ON n.kind = x.kind AND n.host = x.host AND NOT n.leaves
            UNION ALL SELECT x.kind, w.target, floor({passed} * w.share)::BIGINT FROM step{i - 1} x JOIN walks w ON w.kind = x.kind AND w.host = x.host
            ) GROUP BY kind, host)""")
    parts.append(f"""scored AS (SELECT host, coalesce(sum(mass) FILTER (kind = 'trust'), 0) / {UNIT}::DOUBLE AS trust,
        coalesce(sum(mass) FILTER (kind = 'distrust'), 0) / {UNIT}::DOUBLE AS distrust FROM step{steps} GROUP BY host)""")
    return "WITH " + ",\n".join(parts) + f"""
        SELECT page_id, r.host, path, rule, coalesce(said, CASE WHEN distrust > {threshold} * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict,
            coalesce(trust, 0.0) AS trust, coalesce(distrust, 0.0) AS distrust
        FROM ruled r LEFT JOIN scored s ON s.host = r.host"""
