"""URL filter: host and path rules, and for all other pages a tree of path templates judged by labelled purity.

Everything is a DataFrame expression: no Python runs on the executors.

1. A path is cut at `/`; runs of digits become `#`. Equal (host, shape) rows are counted at once, so the tree is grown
   on that small table and the pages are joined back once.
2. Level by level, below each (host, template so far), a segment with fewer than `min_count` pages or less than
   `min_share` of its parent's pages becomes the wildcard `*`. So a parent keeps at most 1 / min_share literal children.
   Segments beyond `depth` form one last segment.
3. Labelled siblings are put in order of their share of bad pages; neighbours whose shares do not differ by a
   two-proportion test are merged and judged together.
4. purity = (bad + weight * prior) / (labelled + weight); templates with purity >= `reject_at` are rejected. A template
   without labels has the prior and is never rejected when the prior is lower than `reject_at`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from traceframe.llm.common import lower_ascii, stored


@dataclass(frozen=True)
class Rule:
    """`text` is host and path prefix, as in `example.net/en/`; it fits the host and all its subdomains."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


@dataclass(frozen=True)
class TreeParameters:
    depth: int = 4
    min_count: int = 5
    min_share: float = 0.02
    z: float = 1.96
    weight: float = 2.0
    prior: float = 0.5
    reject_at: float = 0.9


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or one without `://`."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(rules: Sequence[Rule], host: Column, path: Column, value: str) -> Column:
    """`text` or `verdict` of the longest fitting rule, else null; of equally long rules the first given."""
    out = F.lit(None).cast("string")
    for r in reversed(sorted(rules, key=lambda r: -len(r.text))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, value))).otherwise(out)
    return out


def path_shape(path: Column) -> Column:
    return F.regexp_replace(path, "[0-9]+", "#")


def template_tree(shapes: DataFrame, p: TreeParameters) -> DataFrame:
    """(host, shape, n, labelled, bad) -> the same rows with `template` and `purity`."""
    parts = F.split(F.col("shape"), "/")
    tail = F.array_join(F.slice(parts, p.depth + 1, F.greatest(F.size(parts) - p.depth, F.lit(0))), "/")
    capped = F.when(F.size(parts) <= p.depth, parts).otherwise(F.concat(F.slice(parts, 1, p.depth), F.array(tail)))
    rows = stored(shapes.withColumn("__parts", capped).withColumn("template", F.lit("")).withColumn("__parent", F.lit("")))
    for level in range(p.depth + 1):
        seg = F.get("__parts", F.lit(level))
        rows = rows.withColumn("__seg", seg)
        child = rows.where("__seg is not null").groupBy("host", "template", "__seg").agg(F.sum("n").alias("c"))
        parent = child.groupBy("host", "template").agg(F.sum("c").alias("all"))
        literal = (
            child.join(parent, ["host", "template"])
            .where((F.col("c") >= p.min_count) & (F.col("c") >= p.min_share * F.col("all")))
            .select("host", "template", "__seg", F.col("__seg").alias("__literal"))
        )
        rows = rows.join(literal, ["host", "template", "__seg"], "left")
        grown = F.concat(
            "template", F.lit("" if level == 0 else "/"), F.when(F.col("__seg") == "", "").otherwise(F.coalesce("__literal", F.lit("*")))
        )
        has = F.col("__seg").isNotNull()
        # the next level reads its rows twice: stored once, the plan stays linear in the depth
        rows = stored(rows.select(
            "host", "shape", "n", "labelled", "bad", "__parts",
            F.when(has, F.col("template")).otherwise(F.col("__parent")).alias("__parent"),
            F.when(has, grown).otherwise(F.col("template")).alias("template"),
        ))
    nodes = rows.groupBy("host", "__parent", "template").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    siblings = Window.partitionBy("host", "__parent").orderBy(F.col("b") / F.col("l"), "template")
    l0, b0 = F.lag("l").over(siblings), F.lag("b").over(siblings)
    pooled = (b0 + F.col("b")) / (l0 + F.col("l"))
    gap = F.col("b") / F.col("l") - b0 / l0
    differ = gap * gap > p.z * p.z * pooled * (1 - pooled) * (1 / l0 + 1 / F.col("l"))
    seen = nodes.where("l > 0").withColumn("__break", F.coalesce(differ, F.lit(False)).cast("int"))
    seen = seen.withColumn("__branch", F.sum("__break").over(siblings.rowsBetween(Window.unboundedPreceding, 0)))
    branch = Window.partitionBy("host", "__parent", "__branch")
    purity = (F.sum("b").over(branch) + p.weight * p.prior) / (F.sum("l").over(branch) + p.weight)
    judged = seen.select("host", "template", "__parent", purity.alias("purity"))
    return rows.join(judged, ["host", "__parent", "template"], "left").select(
        "host", "shape", "template", F.coalesce("purity", F.lit(p.prior)).alias("purity")
    )


def url_filter(
    pages: DataFrame, rules: Sequence[Rule], url: str = "url", bad: Column | None = None, p: TreeParameters = TreeParameters()
) -> DataFrame:
    """`pages` with host, path, rule, verdict, template and purity.

    `bad` labels pages (true, false or null); without it the verdicts of the rules are the labels. Null and malformed
    urls have empty host and path and are judged like any other host. Repeated rows count as often as they occur. Columns of
    `pages` with the name of an output are dropped before.
    """
    out = ("host", "path", "rule", "verdict", "template", "purity")
    host, path = host_and_path(F.col(url))
    base = pages.withColumn("__bad", F.lit(None).cast("boolean") if bad is None else bad)
    base = base.select(*[c for c in base.columns if c not in out], host.alias("host"), path.alias("path"))
    base = base.withColumn("rule", rule_of(rules, F.col("host"), F.col("path"), "text"))
    base = base.withColumn("__ruled", rule_of(rules, F.col("host"), F.col("path"), "verdict"))
    label = F.col("__ruled") == "block" if bad is None else F.col("__bad")
    base = base.withColumn("__label", label).withColumn("shape", path_shape(F.col("path")))
    shapes = base.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count("__label").alias("labelled"), F.count(F.when(F.col("__label"), 1)).alias("bad")
    )
    tree = template_tree(shapes, p)
    verdict = F.coalesce("__ruled", F.when(F.col("purity") >= p.reject_at, "block").otherwise("allow"))
    kept = [c for c in base.columns if c not in ("__bad", "__ruled", "__label", "shape")]
    return base.join(tree, ["host", "shape"]).select(*kept, verdict.alias("verdict"), "template", "purity")
