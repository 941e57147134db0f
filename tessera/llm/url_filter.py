"""URL filters: rules first, then trust and distrust propagated over the link graph of hosts.

Everything is DataFrame functions. Trust starts at hosts whose pages the rules allow and
flows along links; distrust starts at hosts whose pages they block and flows against
links, to those that link there. Both are personalised PageRank with the number of such
pages as restart mass; a host passes its mass on in proportion to distinct edges. Edges
are the hosts that a page's absolute links name and, since rules hold for subdomains
too, a host's parent domain. A page without a rule is blocked if its host's distrust
exceeds its trust, else allowed.

Links are counted per pair of hosts before anything is joined, so one popular host costs
one row per neighbour; its rows in a join are split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import read, small, stored

DAMPING, ITERATIONS = 0.85, 10
#: (verdict, rule): host, then a path from its first slash
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)\bhref\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _fits(rule: str, host: Column, path: Column) -> Column:
    name, slash, rest = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)


def longest_rule(rules, host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest fitting rule (of equally long ones the first by text), else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        out = F.when(_fits(rule, host, path), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst): linked hosts and parent domains, for columns host and html."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1)),
        lambda h: F.translate(h, _UPPER, _LOWER)))).alias("dst"))
    hosts = links.select(F.col("dst").alias("src")).union(pages.select("host")).distinct()
    suffixes = F.split("src", r"\.")
    up = hosts.select(F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(suffixes) - 1, F.lit(1))),
        lambda i: F.struct(F.array_join(F.slice(suffixes, i, F.size(suffixes)), ".").alias("src"),
                           F.array_join(F.slice(suffixes, i + 1, F.size(suffixes)), ".").alias("dst")))).alias("e"))
    return links.union(up.select("e.src", "e.dst")).filter("src <> dst and src <> '' and dst <> ''").distinct()


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """(kind, host, rank) after some steps; ``seeds`` has kind ('t' or 'd'), host and mass."""
    both = edges.select(F.lit("t").alias("kind"), "src", "dst").union(
        edges.select(F.lit("d"), F.col("dst"), F.col("src")))
    degree = both.groupBy("kind", "src").agg(F.count(F.lit(1)).alias("n"))
    flow = stored(both.join(degree, ["kind", "src"]))
    restart = seeds.select("kind", "host", (F.col("mass") * (1 - damping)).alias("rank"))
    rank = restart
    for _ in range(iterations):
        moved = flow.join(rank.withColumnsRenamed({"host": "src"}), ["kind", "src"]).select(
            "kind", F.col("dst").alias("host"), (F.col("rank") / F.col("n") * damping).alias("rank"))
        rank = moved.union(restart).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
    return rank


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """Per row of ``pages``: id, host, path, rule, verdict. Other columns are ignored.

    A null url, or one without ``://``, has an empty host and path and fits no rule; it
    has no trust or distrust and is allowed. A null html has no links.
    """
    own = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"),
                       path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    ruled = own.withColumn("_r", longest_rule(rules, F.col("host"), F.col("path")))
    seeds = (ruled.filter(F.col("_r").isNotNull())
             .groupBy(F.when(F.col("_r.verdict") == "allow", "t").otherwise("d").alias("kind"), "host")
             .agg(F.count(F.lit(1)).cast("double").alias("mass")))
    rank = propagate(stored(seeds), host_edges(own), damping, iterations)
    bad = rank.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "t", F.col("rank")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "d", F.col("rank")).otherwise(0.0)).alias("distrust"))
    # a host is blocked beyond rounding differences only
    bad = stored(bad.filter("distrust > trust * (1 + 1e-9) + 1e-12").select(F.col("host").alias("_host")))
    out = ruled.drop("html").join(small(bad), F.col("host") == F.col("_host"), "left")
    return out.select(F.col("_id").alias(id_col), "host", "path", F.col("_r.rule").alias("rule"), F.coalesce(
        F.col("_r.verdict"), F.when(F.col("_host").isNotNull(), "block").otherwise("allow")).alias("verdict"))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))


def _sql() -> str:
    fits, verdicts = [], []
    for verdict, rule in sorted(RULES, key=lambda r: -len(r[1])):
        name, _, rest = rule.partition("/")
        test = f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}')"
        fits.append(f"WHEN {test} THEN '{rule}'")
        verdicts.append(f"WHEN rule = '{rule}' THEN '{verdict}'")
    lower = f"translate({{}}, '{_UPPER}', '{_LOWER}')"
    steps = ["r0 AS (SELECT * FROM restart)"]
    for i in range(ITERATIONS):
        steps.append(f"r{i + 1} AS (SELECT kind, host, sum(rank) AS rank FROM (SELECT f.kind, f.dst AS host, r.rank / f.n * {DAMPING} AS rank "
                     f"FROM flow f JOIN r{i} r ON f.kind = r.kind AND f.src = r.host UNION ALL SELECT * FROM restart) GROUP BY kind, host)")
    link = _LINK.replace("'", "''")
    return rf"""
WITH o AS (SELECT page_id, coalesce(html, '') AS html, {lower.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')")} AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
p AS (SELECT *, CASE {' '.join(fits)} END AS rule FROM o),
v AS (SELECT *, CASE {' '.join(verdicts)} END AS said FROM p),
restart AS (SELECT CASE WHEN said = 'allow' THEN 't' ELSE 'd' END AS kind, host, count(*) * (1 - {DAMPING}) AS rank FROM v WHERE said IS NOT NULL GROUP BY 1, 2),
links AS (SELECT host AS src, {lower.format('t.h')} AS dst FROM o, unnest(regexp_extract_all(html, '{link}', 1)) AS t(h)),
hosts AS (SELECT DISTINCT string_split(h, '.') AS s FROM (SELECT dst AS h FROM links UNION ALL SELECT host FROM o)),
up AS (SELECT array_to_string(s[i:], '.') AS src, array_to_string(s[i + 1:], '.') AS dst FROM hosts, unnest(range(1, greatest(len(s), 2))) AS t(i)),
edges AS (SELECT DISTINCT src, dst FROM (SELECT * FROM links UNION ALL SELECT * FROM up) WHERE src <> dst AND src <> '' AND dst <> ''),
two AS (SELECT 't' AS kind, src, dst FROM edges UNION ALL SELECT 'd', dst, src FROM edges),
flow AS (SELECT kind, src, dst, count(*) OVER (PARTITION BY kind, src) AS n FROM two),
{', '.join(steps)},
s AS (SELECT host, sum(CASE WHEN kind = 't' THEN rank ELSE 0 END) AS trust, sum(CASE WHEN kind = 'd' THEN rank ELSE 0 END) AS distrust FROM r{ITERATIONS} GROUP BY host)
SELECT page_id, v.host, path, rule, coalesce(said, CASE WHEN distrust > trust * (1 + 1e-9) + 1e-12 THEN 'block' ELSE 'allow' END) AS verdict
FROM v LEFT JOIN s USING (host)
"""


OP3_SQL = _sql()
