"""URL filters: a short list of rules, and for the rest a tree of path templates learned from what the rules decide.

Pages that a rule allows or blocks are labels for the others. Per host, paths are generalised segment by segment: a
segment with a digit is a wildcard, and so is every segment below a node with more than ``MAX_CHILDREN`` different ones.
Sibling branches that both hold labels are merged when a two-proportion test can't tell their shares of blocked pages
apart. A template is rejected when its share of blocked pages among its labelled ones, smoothed towards the share in the
whole table, reaches ``PURITY``; a template without labels of its own is never rejected.

All of it are DataFrame operations. Pages are first counted per host and path shape, so a host with a third of all pages is
a few rows before anything is shuffled by host; joins back to many rows deal the keys over ``DEALS`` parts.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandspark.session import materialize


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str  # fits itself and all subdomains
    path: str  # what the path has to start with

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"
# Segments beyond this depth count as one wildcard.
DEPTH = 6
MAX_CHILDREN = 16
Z_LIMIT = 1.96
PRIOR_PAGES = 4.0
PURITY = 0.9
DEALS = 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path; both empty for a null url or one without ``://``."""
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, PARTS, 1), UPPER, LOWER), F.regexp_extract(text, PARTS, 2)


def _by_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict, or null; of rules of one length the blocking one."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block")):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _segments(path: Column) -> Column:
    """Segments of a path, those with a digit as ``*``, all beyond ``DEPTH`` as one ``*``; an empty path has none."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    parts = F.transform(parts, lambda s: F.when(s.rlike("[0-9]"), "*").otherwise(s))
    parts = F.when(F.size(parts) > DEPTH, F.concat(F.slice(parts, 1, DEPTH), F.array(F.lit("*")))).otherwise(parts)
    return F.when(path == "", F.array().cast("array<string>")).otherwise(parts)


def _dealt_join(rows: DataFrame, table: DataFrame, keys: list[str], by: list[str], how: str = "left") -> DataFrame:
    """``rows`` joined with ``table``, whose keys are few each but may be those of a third of all rows."""
    deals = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long")))
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64(*by), F.lit(DEALS)))
    return dealt.join(table.withColumn("deal", deals), [*keys, "deal"], how).drop("deal")


def _branches(shapes: DataFrame, depth: int) -> DataFrame:
    """What each segment below a node is called: itself, ``*``, or the merged branch it belongs to (host, node, segment, label)."""
    children = shapes.groupBy("host", "node", "segment").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    children = materialize(children, f"url-children-{depth}")
    nodes = children.groupBy("host", "node").agg(F.count("*").alias("children"))
    wide = nodes.filter(F.col("children") > MAX_CHILDREN).select("host", "node", F.lit(True).alias("wide"))
    children = _dealt_join(children, wide, ["host", "node"], ["segment"])
    variable = children.filter("wide").select("host", "node", "segment", F.lit("*").alias("label"))
    narrow = children.filter("wide is null")  # at most MAX_CHILDREN rows a node
    bare = narrow.filter("labelled = 0").select("host", "node", "segment", F.col("segment").alias("label"))
    siblings = W.partitionBy("host", "node").orderBy("share", "segment")
    known = narrow.filter("labelled > 0").withColumn("share", F.col("blocked") / F.col("labelled"))
    known = known.withColumns({"n0": F.lag("labelled").over(siblings), "b0": F.lag("blocked").over(siblings), "s0": F.lag("share").over(siblings)})
    pooled = (F.col("blocked") + F.col("b0")) / (F.col("labelled") + F.col("n0"))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / F.col("n0")))
    apart = F.col("s0").isNotNull() & (F.col("share") - F.col("s0") > Z_LIMIT * spread)
    known = known.withColumn("cluster", F.sum(apart.cast("int")).over(siblings))
    merged = F.array_join(F.sort_array(F.collect_list("segment").over(W.partitionBy("host", "node", "cluster"))), "|")
    return variable.unionByName(bare).unionByName(known.select("host", "node", "segment", merged.alias("label")))


def templates(shapes: DataFrame) -> DataFrame:
    """``shapes`` (host, segments, labelled, blocked) with ``node``, the template that each belongs to."""
    shapes = materialize(shapes.withColumn("node", F.lit("")), "url-shapes")
    for depth in range(DEPTH + 1):
        ended = F.size("segments") <= depth
        open_ = shapes.filter(~ended).withColumn("segment", F.col("segments")[depth])
        labels = _branches(open_, depth)
        further = _dealt_join(open_, labels, ["host", "node", "segment"], ["segments"])
        further = further.withColumn("node", F.concat("node", F.lit("/"), "label")).select(shapes.columns)
        shapes = materialize(shapes.filter(ended).unionByName(further), f"url-shapes-{depth}")
    return shapes


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    The longest rule that fits decides. Without one, a page is blocked if its template is rejected, else allowed. A null
    url or one without ``://`` has an empty host and path, and such pages share one template without labels. Equal urls
    get the same verdict, repeated rows are kept, other columns are ignored, urls of any length are read whole, and an empty table gives
    an empty result.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("by", _by_rule(F.col("host"), F.col("path"), rules)).withColumn("segments", _segments(F.col("path")))
    blocked = F.count_if(F.col("by.verdict") == "block")
    shapes = rows.groupBy("host", "segments").agg(F.count("by").alias("labelled"), blocked.alias("blocked"))
    shapes = templates(shapes)
    base = shapes.agg(F.coalesce(F.sum("blocked") / F.sum("labelled"), F.lit(0.0))).first()[0]
    counts = shapes.groupBy("host", "node").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    purity = (F.col("blocked") + F.lit(PRIOR_PAGES * base)) / (F.col("labelled") + F.lit(PRIOR_PAGES))
    bad = counts.filter((F.col("labelled") > 0) & (purity >= PURITY)).select("host", "node")
    rejected = _dealt_join(shapes, bad, ["host", "node"], ["segments"], "left_semi")
    rejected = rejected.select("host", "segments", F.lit(True).alias("rejected"))
    ruled = rows.filter("by is not null").select("page_id", "host", "path", "by.rule", "by.verdict")
    open_ = _dealt_join(rows.filter("by is null"), rejected, ["host", "segments"], ["page_id", "path"])
    verdict = F.when(F.col("rejected"), "block").otherwise("allow")
    return ruled.unionByName(open_.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), verdict.alias("verdict")))
