"""URL filter: rules first, then templates of paths learnt per host.

Rules: the longest that fits the host, or a domain above it, and the start of the path decides.

Template tree: each host is a tree of path segments. Numbers, hexadecimal ids and dates become
wildcards at once, for they vary by nature. Then, level by level from the host down, a node's branches
are compared with the node: a branch seen fewer than ``SUPPORT`` times, or whose share of bad pages does
not differ from the node's by ``Z`` standard errors, is merged with the others of its kind into one
wildcard branch; the rest stay branches of their own. There is no fixed depth: levels go on as long as a
node may still split. A node with fewer than ``SUPPORT`` pages, or whose labels are all alike, cannot, nor can
any below it (all of a pure node's branches are within ``Z`` errors of it), so all that is deeper becomes
wildcards there, one a segment, and its pages leave the tree. What a page's path has become is its template.

A template is rejected if its smoothed share of bad labelled pages reaches ``PURITY``: the share of the
whole table counts like ``PRIOR`` further labelled pages, so a template with few labels needs nearly all
of them bad.

Pages are counted per host and path before the tree is built, so a host with most of the pages is a
few rows by then; the tree itself is never in one task.

Cases: a null url, or one without ``://``, has empty host and path; such pages share a template. Pages
without a label (null) count as seen only. Without labels nothing is rejected. Repeated rows are judged
alike, each. Columns of the input stay, apart from those added, which are replaced. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.llm.columns import let, pack, unpack
from cartwise.session import shared_path, stage

SUPPORT = 20
Z = 2.58
PRIOR = 10.0
PURITY = 0.5
_VARIES = r"^(?:[0-9]+|[0-9a-fA-F-]{12,}|[0-9]{1,4}[-_][0-9]{1,2}(?:[-_][0-9]{1,4})?)(?:\.[a-z]{2,5})?$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
ADDED = ("host", "path", "rule", "template", "bad_share", "verdict")


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def longest_rule(host_of: Column, path_of: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct<size, rule, verdict> of the longest of a few ``rules`` (verdict, domain, path) that fits, else null."""
    fits = [
        F.when(((host_of == domain) | host_of.endswith("." + domain)) & path_of.startswith(start),
               F.struct(F.lit(len(domain + start)).alias("size"), F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict")))
        for verdict, domain, start in rules]
    return F.array_max(F.array_compact(F.array(*fits).cast("array<struct<size:int,rule:string,verdict:string>>")))


def _segments(path_of: Column) -> Column:
    """Segments of a path, wildcards for what varies by nature."""
    parts = F.filter(F.split(path_of, "/", -1), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(_VARIES), "*").otherwise(s))


def templates(paths: DataFrame) -> DataFrame:
    """(host, segments, template, bad_share) from ``paths`` (host, segments, n, labelled, bad), one row a host and path."""
    spark = paths.sparkSession
    tree = stage(paths.withColumn("template", F.col("host")), "paths")
    totals = tree.agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")).first()
    overall = (totals["b"] or 0) / totals["l"] if totals["l"] else 0.0
    folder, levels = shared_path(spark, "levels"), []
    while not levels or not tree.isEmpty():
        level = len(levels)
        segment = F.get("segments", F.lit(level))
        branch = tree.filter(segment.isNotNull()).groupBy("template", segment.alias("segment")).agg(
            F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
        branch = stage(branch, "branches")
        node = branch.groupBy("template").agg(F.sum("n").alias("node_n"), F.sum("l").alias("node_l"), F.sum("b").alias("node_b"))
        node = node.filter((F.col("node_n") >= SUPPORT) & (F.col("node_b") > 0) & (F.col("node_b") < F.col("node_l")))
        share = (F.col("node_b") + 1) / (F.col("node_l") + 2)
        differs = F.abs(F.col("b") - share * F.col("l")) > Z * F.sqrt(F.col("l") * share * (1 - share))
        own = (F.col("n") >= SUPPORT) & (F.col("segment") != "*") & (F.col("l") > 0) & differs
        split = branch.join(node, "template").select("template", "segment", own.alias("own"))
        step = tree.withColumn("segment", segment).join(split, ["template", "segment"], "left")
        grown = F.when(F.col("own").isNull(), F.concat("template", F.repeat(F.lit("/*"), F.size("segments") - level))).otherwise(
            F.concat("template", F.lit("/"), F.when(F.col("own"), F.col("segment")).otherwise("*")))
        step = step.select(*paths.columns, grown.alias("template"), F.col("own").isNull().alias("whole"))
        levels.append(f"{folder}/{level}")
        step.write.parquet(levels[-1])
        tree = spark.read.schema(step.schema).parquet(levels[-1]).filter(~F.col("whole")).drop("whole")
    tree = spark.read.schema(step.schema).parquet(*levels).filter("whole")
    share = tree.groupBy("template").agg(
        ((F.sum("bad") + PRIOR * overall) / (F.sum("labelled") + PRIOR)).alias("bad_share"))
    return tree.join(share, "template").select("host", "segments", "template", "bad_share")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], bad: Column, url: str = "url") -> DataFrame:
    """``pages`` with ADDED. ``bad`` is a page's label: boolean, null where unknown."""
    df = pages.select(pack(pages, *ADDED), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"), bad.cast("int").alias("bad"))
    df = df.withColumn("segments", _segments(F.col("path")))
    paths = df.groupBy("host", "segments").agg(
        F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    learnt = stage(templates(paths), "templates")
    df = df.drop("bad").join(learnt, ["host", "segments"], "left").withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("bad_share") >= PURITY, "block").otherwise("allow"))
    return unpack(df, "host", "path", F.col("_rule.rule").alias("rule"), "template", "bad_share", verdict.alias("verdict"))


def looks_bad(html: Column) -> Column:
    """Label from a page's own text: few words, or many symbols, table bars or capitals among them; null without html."""
    text = F.regexp_replace(html, r"(?s)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    text = F.regexp_replace(text, r"&(amp|lt|gt);", "&")

    def test(t: Column) -> Column:
        shown = F.length(F.regexp_replace(t, r"\s+", ""))
        symbols = F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))
        capitals = F.length(t) - F.length(F.regexp_replace(t, r"[A-Z]+", ""))
        return (shown < 100) | (12 * symbols > shown) | (2 * capitals > shown)

    return F.when(html.isNotNull(), let(text, test))
