"""URL filters: explicit rules, and trust propagated over the host graph for the rest.

Rules name a host with all its subdomains and a path prefix; the longest rule
that fits a page decides. Pages that no rule fits get their host's verdict:
personalised PageRank from the trusted hosts along host edges, and from the
blocked hosts along the reversed edges (distrust); a host is blocked when its
distrust exceeds ``THRESHOLD`` times its trust.

Host edges are the absolute links of the pages, and edges between a host and its
parent domain, so that a site's subdomains share their reputation. What reaches a
host without edges goes back to the seeds, and the steps end when ``CUT_EVERY`` of
them move less than ``TOLERANCE`` of the mass. All steps are DataFrame functions;
the pages' html is read once, pages are counted by host before anything is
shuffled, the rank steps join and sum host rows only, and a host's pages meet its
row in ``SALTS`` parts, since one host may have a third of all pages.

Defined results for odd input: a null url, or one without ``://``, has an empty
host and path, no rule and no links, and is allowed; a null html has no links;
repeated rows stay; equally long fitting rules are decided by the smaller text;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcstep.llm.common import discard, table, written

#: (verdict, host/path) in any order.
RULES: tuple[tuple[str, str], ...] = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Share of a score that is passed along the edges in a step.
DAMPING = 0.85
#: Steps of a propagation at most, and the share of the mass that still moves when it ends.
STEPS, TOLERANCE = 60, 1e-2
#: Steps between checkpoints, after which the end is tested.
CUT_EVERY = 5
#: Parts over which the pages of a host are dealt.
SALTS = 32
#: Stands for all hosts without edges; no page has it as its host.
_SINK = ""
#: A host is blocked when its distrust is more than this many times its trust.
THRESHOLD = 1.0
#: Share of a host's pages that must be blocked, or allowed, by rules to make it a seed.
SEED_SHARE = 0.5
#: Weight of an edge between a host and its parent domain, beside one for each link.
DOMAIN_WEIGHT = 1.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"(?i)\bhref\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/\"'?#\s>]+)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a url; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """The host and all its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def rules_frame(spark: SparkSession, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """rule_host and its rules, array<struct(n, rule, path, verdict)>."""
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules])).alias("r")
    each = spark.range(1).select(rows).select(
        F.substring_index("r.rule", "/", 1).alias("rule_host"),
        F.struct(
            F.length("r.rule").alias("n"),
            F.col("r.rule").alias("rule"),
            F.expr("substring(r.rule, instr(r.rule, '/'))").alias("path"),
            F.col("r.verdict").alias("verdict"),
        ).alias("rule"),
    )
    return each.groupBy("rule_host").agg(F.collect_set("rule").alias("rules"))


def by_host_row(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """``pages`` with the columns of their host's one row, if there is one."""
    dealt = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)))
    copies = hosts.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    return dealt.join(copies, ["host", "salt"], "left").drop("salt")


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict``, both null where no rule fits, to rows with host and path.

    Hosts are made distinct before they meet the rules, so a long list of rules
    is joined with hosts and not with pages.
    """
    hosts = pages.select("host").distinct()
    by_host = (
        hosts.select("host", F.explode(suffixes(F.col("host"))).alias("rule_host"))
        .join(rules, "rule_host")
        .groupBy("host")
        .agg(F.flatten(F.collect_list("rules")).alias("rules"))
    )
    joined = by_host_row(pages, by_host)
    fits = F.filter("rules", lambda r: F.col("path").startswith(r["path"]))
    best = F.element_at(
        F.array_sort(
            fits,
            lambda a, b: F.when(a["n"] > b["n"], -1).when(a["n"] < b["n"], 1).when(a["rule"] < b["rule"], -1).when(a["rule"] > b["rule"], 1).otherwise(0),
        ),
        1,
    )
    best = F.when(F.size(fits) > 0, best)
    return joined.withColumn("best", best).withColumn("rule", F.col("best.rule")).withColumn("rule_verdict", F.col("best.verdict")).drop("best", "rules")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): links of pages (host, links) between different hosts, and parent-domain edges both ways."""
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode("links").alias("to"))
    links = links.select("src", F.translate("to", _UPPER, _LOWER).alias("dst"), F.lit(1.0).alias("w"))
    hosts = pages.where("host <> ''").select("host").distinct()
    up = (
        hosts.select(F.explode(suffixes(F.col("host"))).alias("src"))
        .where(F.size(F.split("src", r"\.")) > 2)
        .distinct()
        .select("src", F.expr("substring(src, instr(src, '.') + 1)").alias("dst"), F.lit(DOMAIN_WEIGHT).alias("w"))
    )
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return links.unionByName(up).unionByName(down).where("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, score): personalised PageRank from seeds (host, s), s adding up to one.

    Hosts without out-edges pass their score to a sink, which deals it to the seeds
    a step later, its damping made up for; the sink itself is not returned.
    """
    out = edges.groupBy("src").agg(F.sum("w").alias("total"))
    shares = edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share"))
    ends = edges.select(F.col("dst").alias("src")).union(seeds.select("host")).distinct().join(out, "src", "left_anti")
    to_sink = ends.select("src", F.lit(_SINK).alias("dst"), F.lit(1.0).alias("share"))
    from_sink = seeds.select(F.lit(_SINK).alias("src"), F.col("host").alias("dst"), (F.col("s") / DAMPING).alias("share"))
    shares = written(shares.unionByName(to_sink).unionByName(from_sink))
    base = written(seeds.select("host", ((1 - DAMPING) * F.col("s")).alias("score")))
    ranks = last = seeds.select("host", F.col("s").alias("score"))
    for step in range(1, steps + 1):
        moved = ranks.join(shares, F.col("host") == F.col("src")).select(
            F.col("dst").alias("host"), (F.lit(DAMPING) * F.col("score") * F.col("share")).alias("score")
        )
        ranks = moved.unionByName(base).groupBy("host").agg(F.sum("score").alias("score"))
        if step % CUT_EVERY == 0 or step == steps:
            before, last = last, written(ranks)
            ranks = last
            change = ranks.unionByName(before.select("host", (-F.col("score")).alias("score"))).groupBy("host").agg(F.sum("score").alias("d"))
            moving = change.agg(F.sum(F.abs("d"))).first()[0]
            discard(before)
            if moving is None or moving < tolerance:
                break
    return ranks.where(F.col("host") != _SINK)


def host_scores(edges: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, trust, distrust) from counts (host, n, allowed, blocked)."""

    def seeds(column: str) -> DataFrame:
        chosen = counts.where((F.col("host") != "") & (F.col(column) > 0) & (F.col(column) >= SEED_SHARE * F.col("n")))
        total = chosen.count()
        return chosen.select("host", F.lit(1.0 / total if total else 0.0).alias("s"))

    trust = propagate(edges, seeds("allowed")).withColumnRenamed("score", "trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    distrust = propagate(back, seeds("blocked")).withColumnRenamed("score", "distrust")
    return trust.join(distrust, "host", "full").select(
        "host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust."""
    host, path = host_and_path(F.col("url"))
    links = F.coalesce(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)), F.array().cast("array<string>"))
    read = written(pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), links.alias("links")))
    judged = written(match_rules(read.drop("links"), rules_frame(pages.sparkSession, rules)))
    is_ = lambda v: F.count(F.when(F.col("rule_verdict") == v, 1))
    counts = written(judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), is_("allow").alias("allowed"), is_("block").alias("blocked")))
    scores = host_scores(written(host_edges(read)), counts)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    method = F.when(zero("distrust") > THRESHOLD * zero("trust"), "block").otherwise("allow")
    return by_host_row(judged, written(scores)).select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", method).alias("verdict"),
        F.round(zero("trust"), 9).alias("trust"), F.round(zero("distrust"), 9).alias("distrust"),
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page."""
    return judge(table(spark, sf_dir, "pages"))


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{v}', '{r}', '{r.split('/')[0]}', '{r[r.index('/'):]}')" for v, r in RULES)

    def ranks(name: str, edges: str, seeds: str) -> str:
        return f"""{name}_share AS MATERIALIZED (
  SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM {edges}
  UNION ALL SELECT DISTINCT src, '{_SINK}', 1.0::DOUBLE FROM (SELECT dst AS src FROM {edges} UNION SELECT host FROM {seeds}) WHERE src NOT IN (SELECT src FROM {edges})
  UNION ALL SELECT '{_SINK}', host, s / {DAMPING} FROM {seeds}),
{name}_all(step, host, score) AS (
  SELECT 0, host, s FROM {seeds}
  UNION ALL
  SELECT step + 1, host, sum(score) FROM (
    SELECT step, dst AS host, {DAMPING} * score * share AS score FROM {name}_all JOIN {name}_share ON src = host
    UNION ALL
    SELECT t.step, x.host, {1 - DAMPING} * x.s FROM {seeds} x, (SELECT max(step) AS step FROM {name}_all) t WHERE t.step IS NOT NULL
  ) WHERE step < {STEPS} GROUP BY step, host
),
{name}_end AS (SELECT coalesce(min(step), {STEPS}) AS step FROM (SELECT step, sum(abs(d)) AS moving FROM (
  SELECT step, host, sum(score) AS d FROM (SELECT step, host, score FROM {name}_all WHERE step > 0 AND step % {CUT_EVERY} = 0 UNION ALL SELECT step + {CUT_EVERY}, host, -score FROM {name}_all WHERE step % {CUT_EVERY} = 0 AND step < {STEPS}) GROUP BY step, host
) GROUP BY step) WHERE moving < {TOLERANCE}),
{name} AS MATERIALIZED (SELECT host, score FROM {name}_all WHERE step = (SELECT step FROM {name}_end))"""

    return {
        "op6_url_filter": f"""
WITH RECURSIVE rules(v, rule, rh, rp) AS (VALUES {rules}),
p AS (SELECT page_id, html, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
h AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
j AS MATERIALIZED (
  SELECT page_id, host, path, html,
    (SELECT arg_max(rule, length(rule)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
    (SELECT arg_max(v, length(rule)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rv
  FROM h
),
c AS (SELECT host, count(*) AS n, count(*) FILTER (rv = 'allow') AS a, count(*) FILTER (rv = 'block') AS b FROM j GROUP BY host),
ta AS (SELECT host, 1.0::DOUBLE / count(*) OVER () AS s FROM c WHERE host <> '' AND a > 0 AND a >= {SEED_SHARE} * n),
tb AS (SELECT host, 1.0::DOUBLE / count(*) OVER () AS s FROM c WHERE host <> '' AND b > 0 AND b >= {SEED_SHARE} * n),
suf AS (SELECT DISTINCT array_to_string(l[i:], '.') AS src FROM (SELECT string_split(host, '.') AS l, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM c WHERE host <> '')),
up AS (SELECT src, substr(src, instr(src, '.') + 1) AS dst, 1.0::DOUBLE AS w FROM suf WHERE len(string_split(src, '.')) > 2),
e AS MATERIALIZED (SELECT src, dst, sum(w)::DOUBLE AS w FROM (SELECT * FROM up UNION ALL SELECT dst, src, w FROM up
  UNION ALL SELECT host, translate(unnest(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/"''?#\\s>]+)', 1)), '{_UPPER}', '{_LOWER}'), 1.0 FROM j WHERE host <> ''
) WHERE src <> dst GROUP BY src, dst),
eb AS (SELECT dst AS src, src AS dst, w FROM e),
{ranks('t', 'e', 'ta')},
{ranks('d', 'eb', 'tb')}
SELECT page_id, j.host, path, rule,
  coalesce(rv, CASE WHEN coalesce(dd.score, 0) > {THRESHOLD} * coalesce(tt.score, 0) THEN 'block' ELSE 'allow' END) AS verdict,
  round(coalesce(tt.score, 0), 9) AS trust, round(coalesce(dd.score, 0), 9) AS distrust
FROM j LEFT JOIN t tt ON tt.host = j.host AND j.host <> '' LEFT JOIN d dd ON dd.host = j.host AND j.host <> ''"""
    }


def queries() -> dict:
    return {"op6_url_filter": op6_url_filter}
