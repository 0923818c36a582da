"""URL filters by sort-merge range joins, native operations only.

A host's canonical key is its labels in reverse, a dot after each, so a host and all its subdomains share a prefix and a
rule's host is the interval from that prefix to the same with the dot raised by one.  A rule's path is, below its host, the
interval of all paths that begin with it.  Intervals of either kind nest or are disjoint, so between two bounds, which cut
the key space, the same rules are active:

1. a sweep over hosts finds for each url the stack of rule hosts that are its host or above it, one per label at most;
2. below each of these hosts, a sweep over paths finds the innermost rule.  A bound carries that one rule and not all that are
   active, so a host with many rules makes no long rows: at a rule's start that is itself, at its end its parent, the
   longest rule of its host that it begins with.

A url's verdict is that of the longest rule found.  In a sweep, rows and bounds are range-partitioned and sorted by key, and
what the last bound said goes to the rows after it; partitions take over what the one before ended with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``, empty without one."""
    at = F.locate("://", url)
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to a query or a fragment."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def host_bounds(rules: DataFrame) -> DataFrame:
    """``(key, hosts)``: from ``key`` on, up to the next, these hosts of rules are active, the outermost first.

    From a rule host's first key it and its parent domains are active; from its end only the parents.
    """
    hosts = rules.select("host").distinct().withColumn("key", canonical_key(F.col("host")))
    labels = F.split(F.col("host"), r"\.", -1)
    above = hosts.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("host"))
    active = above.join(hosts.select("host"), "host")
    entry = F.struct(F.length("host").alias("depth"), "host")
    stacks = active.groupBy("key").agg(F.sort_array(F.collect_list(entry)).alias("stack"))  # the hosts above one host
    names = lambda stack: F.transform(stack, lambda r: r["host"])
    outer = F.slice("stack", F.lit(1), F.size("stack") - 1)
    ends = stacks.select(F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/")).alias("key"), names(outer).alias("value"))
    return stacks.select("key", names(F.col("stack")).alias("value")).unionByName(ends)


_RULE = "struct<n:int,rule:string,verdict:string>"


def path_bounds(rules: DataFrame) -> DataFrame:
    """``(host, key, value)``: from ``key`` on, in bytes, up to the next of the same host, ``value`` is the innermost rule; its ``rule`` is null for none.

    A rule's interval ends after its path and a byte that no text holds.
    """
    name = F.concat("host", "path")
    own = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).select("host", "path", F.struct(F.length(name).alias("n"), name.alias("rule"), "verdict").alias("value"))
    # a rule's parent has one of the starts of its path
    starts = own.where("path <> ''").select("host", F.col("path").alias("inner"), F.explode(F.transform(F.sequence(F.lit(0), F.length("path") - 1), lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("path"))
    parents = starts.join(own, ["host", "path"]).groupBy("host", F.col("inner").alias("path")).agg(F.max("value").alias("parent"))
    none = F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    ends = own.join(parents, ["host", "path"], "left").select("host", F.concat(F.col("path").cast("binary"), F.lit(b"\xff")).alias("key"), F.coalesce("parent", none).cast(_RULE).alias("value"))
    return own.select("host", F.col("path").cast("binary").alias("key"), F.col("value").cast(_RULE).alias("value")).unionByName(ends)


def _sweep(rows: DataFrame, bounds: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with the ``value`` of the last of ``bounds(keys..., value)`` at or before them, null where there is none."""
    both = rows.withColumn("kind", F.lit(1)).unionByName(bounds.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    # the row's number spreads the rows of one key over partitions
    dealt = materialise(both.repartitionByRange(*keys, "kind", "row").withColumn("part", F.spark_partition_id()), name)
    order = Window.partitionBy("part").orderBy(*keys, "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = dealt.withColumn("value", F.last("value", True).over(order)).where("kind = 1")
    # one row per partition: what its last bound says, then the last of all partitions before
    last = dealt.where("kind = 0").groupBy("part").agg(F.max_by("value", F.struct(*keys)).alias("ends"))
    parts = dealt.select("part").distinct().join(last, "part", "left")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = materialise(parts.select("part", F.last("ends", True).over(before).alias("carried")), f"{name}-carried")
    return swept.join(F.broadcast(carried), "part").withColumn("value", F.coalesce("value", "carried")).drop("carried", "part", "kind")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(id, url, host, path, rule, verdict)`` for every row of ``pages`` by ``rules(verdict, host, path)``.

    The longest rule (host and path together) wins, then the smaller text, then the smaller verdict; without one,
    ``default``.  A null url, or one without ``://``, has an empty host and path and matches no rule but one for the empty host.
    Urls may be of any length; ids may be null; repeated rows are judged each and repeated rules count once; other columns are
    ignored; empty pages give an empty result, empty rules the default.
    """
    url = F.col(url_col).cast("string")
    urls = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    urls = urls.withColumn("key", canonical_key(F.col("host"))).withColumn("row", F.monotonically_increasing_id())
    urls = materialise(urls.withColumn("value", F.lit(None).cast("array<string>")).transform(lambda rows: _sweep(rows, host_bounds(rules), ["key"], "hosts")), "under-hosts")
    below = urls.select("row", F.explode("value").alias("host"), F.col("path").cast("binary").alias("key"), F.lit(None).cast(_RULE).alias("value"))
    found = _sweep(below, path_bounds(rules), ["host", "key"], "paths").where("value.rule is not null")
    best = found.groupBy("row").agg(F.min(F.struct((-F.col("value.n")).alias("n"), F.col("value.rule").alias("rule"), F.col("value.verdict").alias("verdict"))).alias("best"))
    return urls.join(best, "row", "left").select("id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")
