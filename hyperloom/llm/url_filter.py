"""URL filters: rules first, then trust and distrust propagated over the host graph.

Rules name a host and a path prefix; the longest that fits a page decides. Pages without a rule are
judged by their host. Hosts that rules speak for are seeds: trusted with the number of their allowed
pages, blocked with the number of their blocked ones. Trust flows along links (personalised PageRank
from the trusted seeds); distrust flows against them (a page that links to a bad host is suspect), from
the blocked seeds. A host is blocked if distrust reaches it and is at least SHARE of both together; a
host that neither reaches is allowed. Only the ratio counts: scores are shares of the whole table's seeds,
so they shrink as it grows.

The graph is the host pairs of links that name a host, with a scheme or without, counted before they are
shuffled; scores are a table that each round joins with the edges and is written to the shared folder, so
lineage stays short; the table of the round before is deleted. Scores of nodes without outgoing links
return to the seeds.

Defined results: a null url or one without `://` has an empty host and path, no rule, and is allowed;
null html has no links; equal rows have equal results, rows without an id or of one id are judged each by
itself; an empty table gives an empty result; columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.llm.shared import Work, table

#: (verdict, rule): host before the first slash, path from it on.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
DAMPING = 0.85
ROUNDS = 20
SHARE = 0.6
#: Links that name a host, with a scheme or with the page's own.
_LINK = r"""(?i)\shref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url):
    """A url's host, A to Z lower-cased, and its path; both empty without `://`."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"\A[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host, path, rules=RULES):
    """The longest rule that fits, as a struct of rule and verdict; else null."""
    found = None
    for verdict, rule in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """(source, target, weight): links that name a host, between different hosts, of pages (host, html)."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1))
    targets = F.array_distinct(F.transform(links, lambda x: F.translate(x, _UPPER, _LOWER)))
    pairs = pages.where("host <> ''").select(F.col("host").alias("source"), F.explode(targets).alias("target"))
    return pairs.where("source <> target and target <> ''").groupBy("source", "target").agg(F.count("*").cast("double").alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, work: Work, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trusted, blocked) over edges (source, target, weight)."""
    total = seeds.agg(F.sum("trusted").alias("t"), F.sum("blocked").alias("b")).first()
    # Both start from the same unit for a page, so that neither is stronger by being rarer.
    unit = max(total.t or 0, total.b or 0, 1)
    starts = seeds.select("host", (F.col("trusted") / unit).alias("trusted"), (F.col("blocked") / unit).alias("blocked"))
    both = edges.select("source", "target", "weight", F.lit("trust").alias("kind")).union(edges.select("target", "source", "weight", F.lit("distrust")))
    out = both.groupBy("source", "kind").agg(F.sum("weight").alias("out"))
    flows = work.keep(both.join(out, ["source", "kind"]).select("source", "target", "kind", (F.col("weight") / F.col("out")).alias("share")))
    nodes = work.keep(starts.select("host", "trusted", "blocked").union(edges.select(F.explode(F.array("source", "target")), F.lit(0.0), F.lit(0.0))).groupBy("host").agg(F.sum("trusted").alias("trusted"), F.sum("blocked").alias("blocked")))
    score = nodes.select("host", F.col("trusted").alias("trust"), F.col("blocked").alias("distrust"))
    mass = nodes.agg(F.sum("trusted").alias("t"), F.sum("blocked").alias("b")).first()
    before = None
    for _ in range(rounds if not flows.isEmpty() else 0):
        moved = flows.join(score, flows.source == score.host).select("target", (F.col("share") * F.when(F.col("kind") == "trust", F.col("trust")).otherwise(0.0)).alias("t"), (F.col("share") * F.when(F.col("kind") == "distrust", F.col("distrust")).otherwise(0.0)).alias("d")).groupBy("target").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        got = work.keep(nodes.join(moved, nodes.host == moved.target, "left").select("host", "trusted", "blocked", F.coalesce("t", F.lit(0.0)).alias("t"), F.coalesce("d", F.lit(0.0)).alias("d")))
        lost = got.agg(F.sum("t").alias("t"), F.sum("d").alias("d")).first()
        # What flowed nowhere goes back to the seeds, in proportion.
        back = lambda all_, kept: (1 - damping * (kept or 0.0) / all_) if all_ else 0.0
        score = got.select("host", (damping * F.col("t") + back(mass.t, lost.t) * F.col("trusted")).alias("trust"), (damping * F.col("d") + back(mass.b, lost.d) * F.col("blocked")).alias("distrust"))
        if before is not None:
            work.drop(before)
        before = got
    return work.settle(score)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust, distrust_share (rounded)."""
    work = Work(pages.sparkSession, "urls")
    host, path = host_and_path(F.col("url"))
    placed = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), "html")
    ruled = placed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    seeds = work.keep(ruled.groupBy("host").agg(F.sum((F.col("rule.verdict") == "allow").cast("double")).alias("trusted"), F.sum((F.col("rule.verdict") == "block").cast("double")).alias("blocked")).select("host", F.coalesce("trusted", F.lit(0.0)).alias("trusted"), F.coalesce("blocked", F.lit(0.0)).alias("blocked")))
    edges = work.keep(host_edges(placed))
    score = propagate(seeds.where("host <> ''"), edges, work)
    bad = (F.col("distrust") > 0) & (F.col("distrust") >= SHARE * (F.col("trust") + F.col("distrust")))
    own = F.when(bad, "block").otherwise("allow")
    both = F.col("trust") + F.col("distrust")
    return ruled.select("page_id", "host", "path", "rule").join(score, "host", "left").select(
        "page_id", "host", "path", F.col("rule.rule").alias("rule"), F.coalesce("rule.verdict", own).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
        F.when(both > 0, F.round(F.col("distrust") / both, 6)).otherwise(0.0).alias("distrust_share"),
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages."""
    return judge(table(spark, sf_dir, "pages", ["page_id", "url", "html"])).drop("trust", "distrust")


QUERIES = {"op3_url_filter": op3_url_filter}


def _oracle() -> str:
    """The same in SQL, the rounds written out."""
    fits = []
    for verdict, rule in sorted(RULES, key=lambda x: (-len(x[1]), x[1])):
        name, slash, rest = rule.partition("/")
        fits.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash + rest}') THEN {{{{'rule': '{rule}', 'verdict': '{verdict}'}}}}".replace("{{", "{").replace("}}", "}"))
    link = _LINK.replace("'", "''")
    rounds = ["s0 AS (SELECT host, trusted AS t, blocked AS d FROM nodes)"]
    for k in range(ROUNDS):
        rounds.append(f"""m{k} AS (SELECT target AS host, sum(CASE WHEN kind = 't' THEN share * t ELSE 0 END) AS t, sum(CASE WHEN kind = 'd' THEN share * d ELSE 0 END) AS d FROM flows JOIN s{k} ON source = host GROUP BY target),
s{k + 1} AS MATERIALIZED (SELECT n.host, {DAMPING} * coalesce(m.t, 0) + CASE WHEN a.t > 0 THEN 1 - {DAMPING} * coalesce((SELECT sum(t) FROM m{k}), 0) / a.t ELSE 0 END * trusted AS t, {DAMPING} * coalesce(m.d, 0) + CASE WHEN a.d > 0 THEN 1 - {DAMPING} * coalesce((SELECT sum(d) FROM m{k}), 0) / a.d ELSE 0 END * blocked AS d FROM nodes n LEFT JOIN m{k} m USING (host), mass a)""")
    return f"""WITH cut AS (SELECT page_id, coalesce(html, '') AS html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosted AS (SELECT page_id, html, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
placed AS (SELECT page_id, html, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosted),
ruled AS MATERIALIZED (SELECT *, CASE {" ".join(fits)} END AS x FROM placed),
seeds AS (SELECT host, count(*) FILTER (x.verdict = 'allow')::DOUBLE AS trusted, count(*) FILTER (x.verdict = 'block')::DOUBLE AS blocked FROM ruled WHERE host <> '' GROUP BY host),
unit AS (SELECT greatest(coalesce(sum(trusted), 0), coalesce(sum(blocked), 0), 1) AS u FROM seeds),
links AS (SELECT host AS source, unnest(list_distinct(list_transform(regexp_extract_all(html, '{link}', 1), lambda h: translate(h, '{_UPPER}', '{_LOWER}')))) AS target FROM ruled WHERE host <> ''),
edges AS (SELECT source, target, count(*)::DOUBLE AS weight FROM links WHERE source <> target AND target <> '' GROUP BY source, target),
mirrored AS (SELECT source, target, weight, 't' AS kind FROM edges UNION ALL SELECT target, source, weight, 'd' FROM edges),
flows AS MATERIALIZED (SELECT source, target, kind, weight / sum(weight) OVER (PARTITION BY source, kind) AS share FROM mirrored),
nodes AS MATERIALIZED (SELECT host, sum(trusted) AS trusted, sum(blocked) AS blocked FROM (SELECT host, trusted / u AS trusted, blocked / u AS blocked FROM seeds, unit UNION ALL SELECT unnest([source, target]), 0, 0 FROM edges) GROUP BY host),
mass AS (SELECT coalesce(sum(trusted), 0) AS t, coalesce(sum(blocked), 0) AS d FROM nodes),
{", ".join(rounds)}
SELECT page_id, r.host, path, x.rule AS rule, coalesce(x.verdict, CASE WHEN d > 0 AND d >= {SHARE} * (t + d) THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN t + d > 0 THEN round(d / (t + d), 6) ELSE 0 END::DOUBLE AS distrust_share
FROM ruled r LEFT JOIN s{ROUNDS} s ON s.host = r.host"""


ORACLE = {"op3_url_filter": _oracle()}
