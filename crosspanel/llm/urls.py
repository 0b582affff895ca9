"""URL filter: host-suffix and path-prefix expressions against a rule table, in DataFrame functions only.

Each URL is expanded into its expressions of the shapes that rules have (so many host labels, so
many path characters): no more than its own labels and characters allow. An equi-join on short hash prefixes finds candidates, the
full digest confirms them, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of the digest that the join compares first.
PREFIX_HEX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(url)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def labels(host: Column) -> Column:
    return F.size(F.split(host, r"\.", -1))


def filter_urls(pages: DataFrame, rules: DataFrame, keep: tuple[str, ...] = ("page_id",), url: str = "url", default: str = "allow") -> DataFrame:
    """Judge every row of ``pages`` by ``rules`` (host, path, verdict).

    A rule fits its host and all subdomains if the path starts with the rule's path; of the rules
    that fit, the longest (host and path together) wins, then the longer host, then ``block``.
    Returns the columns ``keep``, then host, path, rule (null if none fits) and verdict
    (``default`` if none fits). Repeated rows each get a row; a null or malformed URL has an empty
    host and path and fits no rule; other columns of ``pages``, whatever their names, are not read;
    without rules every row gets the default; an empty table gives no rows. URLs of any length are
    read whole.
    """
    # one row for each shape of rule: bounded by label counts and path lengths, not by rules or URLs
    shapes = [tuple(r) for r in rules.select(labels(F.col("host")), F.length("path")).distinct().collect()]
    rule = F.concat("host", "path")
    known = rules.select(
        F.substring(F.sha2(rule, 256), 1, PREFIX_HEX).alias("rule_prefix"),
        F.sha2(rule, 256).alias("rule_digest"),
        F.struct(F.length(rule).alias("length"), F.length("host").alias("host_length"), (F.col("verdict") == "block").alias("blocks"), rule.alias("rule"), F.col("verdict").alias("verdict")).alias("fit"),
    )
    host, path = url_parts(F.col(url))
    rows = pages.select(F.struct(*keep).alias("kept"), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    known_shapes = F.array(*[F.struct(F.lit(n).alias("labels"), F.lit(p).alias("length")) for n, p in sorted(shapes)])
    fitting = F.filter(known_shapes, lambda s: (s["labels"] <= labels(F.col("host"))) & (s["length"] <= F.length("path")))
    suffix = lambda n: F.array_join(F.slice(F.split("host", r"\."), -n, n), ".")
    made = F.transform(fitting, lambda s: F.concat(suffix(s["labels"]), F.substring(F.col("path"), F.lit(1), s["length"])))
    expanded = rows.withColumn("expression", F.explode_outer(made if shapes else F.array(F.lit(None).cast("string"))))
    expanded = expanded.withColumn("digest", F.sha2("expression", 256))
    hits = expanded.join(known, F.substring("digest", 1, PREFIX_HEX) == F.col("rule_prefix"), "left")
    # the expressions of a URL are neighbours in one task, so that the partial aggregate shuffles one row a URL
    best = hits.groupBy("row", "kept", "host", "path").agg(F.max(F.when(F.col("digest") == F.col("rule_digest"), F.col("fit"))).alias("fit"))
    return best.select("kept.*", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.lit(default)).alias("verdict"))
