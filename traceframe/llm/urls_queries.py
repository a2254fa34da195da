"""Query of the URL filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from traceframe.llm.registry import query, table
from traceframe.llm.urls import Rule, TreeParameters, url_filter

RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))
P = TreeParameters()


def _rule_sql(value: str) -> str:
    cases = "".join(
        f" WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, value)}'"
        for r in sorted(RULES, key=lambda r: -len(r.text))
    )
    return f"CASE{cases} END"


def _tree_sql() -> str:
    """One pair of common table expressions for each level of the tree."""
    text = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
),
ruled AS (
  SELECT *, {_rule_sql("text")} AS rule, {_rule_sql("verdict")} AS ruled, regexp_replace(path, '[0-9]+', '#', 'g') AS shape FROM parts
),
shapes AS (
  SELECT host, shape, count(*) AS n, count(ruled) AS labelled, count(*) FILTER (ruled = 'block') AS bad FROM ruled GROUP BY ALL
),
r0 AS (
  SELECT *, CASE WHEN len(s) <= {P.depth} THEN s ELSE list_concat(s[1:{P.depth}], [array_to_string(s[{P.depth + 1}:], '/')]) END AS p,
         '' AS template, '' AS parent
  FROM (SELECT *, string_split(shape, '/') AS s FROM shapes)
)"""
    for k in range(P.depth + 1):
        slash = "" if k == 0 else "/"
        text += f""",
c{k} AS (SELECT host, template, p[{k + 1}] AS seg, sum(n) AS c FROM r{k} WHERE p[{k + 1}] IS NOT NULL GROUP BY ALL),
k{k} AS (
  SELECT host, template, seg FROM (SELECT *, sum(c) OVER (PARTITION BY host, template) AS a FROM c{k})
  WHERE c >= {P.min_count} AND c >= {P.min_share}::DOUBLE * a
),
r{k + 1} AS (
  SELECT r.host, r.shape, r.n, r.labelled, r.bad, r.p,
         CASE WHEN p[{k + 1}] IS NULL THEN r.template
              ELSE r.template || '{slash}' || CASE WHEN p[{k + 1}] = '' THEN '' ELSE coalesce(k.seg, '*') END END AS template,
         CASE WHEN p[{k + 1}] IS NULL THEN r.parent ELSE r.template END AS parent
  FROM r{k} r LEFT JOIN k{k} k ON r.host = k.host AND r.template = k.template AND p[{k + 1}] = k.seg
)"""
    last = P.depth + 1
    return f"""{text},
nodes AS (SELECT host, parent, template, sum(labelled)::DOUBLE AS l, sum(bad)::DOUBLE AS b FROM r{last} GROUP BY ALL),
steps AS (
  SELECT *, lag(l) OVER w AS l0, lag(b) OVER w AS b0 FROM nodes WHERE l > 0
  WINDOW w AS (PARTITION BY host, parent ORDER BY b / l, template)
),
breaks AS (
  SELECT *, CASE WHEN (b / l - b0 / l0) * (b / l - b0 / l0)
    > {P.z}::DOUBLE * {P.z}::DOUBLE * ((b0 + b) / (l0 + l)) * (1 - (b0 + b) / (l0 + l)) * (1 / l0 + 1 / l) THEN 1 ELSE 0 END AS brk
  FROM steps
),
branches AS (SELECT *, sum(brk) OVER (PARTITION BY host, parent ORDER BY b / l, template) AS branch FROM breaks),
judged AS (
  SELECT host, parent, template,
         (sum(b) OVER w + {P.weight * P.prior}::DOUBLE) / (sum(l) OVER w + {P.weight}::DOUBLE) AS purity
  FROM branches WINDOW w AS (PARTITION BY host, parent, branch)
),
tree AS (
  SELECT r.host, r.shape, r.template, coalesce(j.purity, {P.prior}::DOUBLE) AS purity
  FROM r{last} r LEFT JOIN judged j ON r.host = j.host AND r.parent = j.parent AND r.template = j.template
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity >= {P.reject_at}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict,
       template, purity
FROM ruled JOIN tree USING (host, shape)"""


@query("op3_url_filter", _tree_sql())
def op3_url_filter(spark: SparkSession, directory: str) -> DataFrame:
    judged = url_filter(table(spark, directory, "pages").select("page_id", "url"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity")
