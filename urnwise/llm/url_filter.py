"""URL filters as a sort-merge range join, in DataFrame functions only.

A host's labels in reverse order, each with a dot, make a key under which a rule's
host and all its subdomains are one interval: from the key to the key with a byte
FF, which no UTF-8 text holds. Such intervals are nested or apart, so a sweep over
sorted keys needs a stack: an interval's start puts that host's rules on top, its
end restores what lies below. Each boundary carries the stack it leaves (the rules
of its host and of the hosts above, longest rule first), and a running last-value
over the sorted union of boundaries and pages hands every page its stack; the
first of it whose path starts the page's path wins.

The sweep runs in many slices at once: pages are dealt by a hash of their row, not
by host, so a host with a third of all pages is spread like any other, and every
slice gets all boundaries (rules times slices rows; no page is copied).

Defined results: a url that is null or without `://` has empty host and path; a url
that no rule fits has rule null and the default verdict. Of rules of equal length
the longer host wins, then the smaller text, then `allow`. Repeated rows stay;
no rules give the default for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

#: The rules of the registered query: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """`www.example.com` as `com.example.www.`; the empty host as the empty key."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def boundaries(rules: DataFrame) -> DataFrame:
    """Rows (k binary, stack): what lies on the stack from this key on."""
    r = rules.where("host is not null and path is not null").select(
        host_key(F.translate("host", UPPER, LOWER)).alias("key"),
        F.struct((-F.length(F.concat("host", "path"))).alias("order"), (-F.length("host")).alias("host_order"), F.concat("host", "path").alias("rule"), "verdict", "path").alias("r"),
    )
    own = r.groupBy("key").agg(F.collect_set("r").alias("own"))
    parts = F.split(F.col("key"), r"\.")
    above = own.select("key", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), i), "."), F.lit("."))))).alias("up")).distinct()
    lines = above.join(own.select(F.col("key").alias("up"), F.explode("own").alias("r")), "up")
    stacks = lines.groupBy("key").agg(F.array_sort(F.collect_list("r")).alias("stack"), F.array_sort(F.collect_list(F.when(F.col("up") != F.col("key"), F.col("r")))).alias("below"))
    return stacks.select(F.explode(F.array(F.struct(F.encode("key", "UTF-8").alias("k"), F.col("stack")), F.struct(F.concat(F.encode("key", "UTF-8"), F.unhex(F.lit("FF"))).alias("k"), F.col("below").alias("stack")))).alias("b")).select("b.*")


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", slices: int | None = None) -> DataFrame:
    """Rows (key, host, path, rule, verdict), one for each row of pages."""
    slices = slices or 4 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_path(F.col(url))
    own = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    own = own.select(F.pmod(F.xxhash64("id", "url"), F.lit(slices)).cast("int").alias("slice"), F.encode(host_key(F.col("host")), "UTF-8").alias("k"), F.lit(1).alias("kind"), "id", "host", "path")
    marks = boundaries(rules).select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "k", F.lit(0).alias("kind"), "stack")
    sweep = Window.partitionBy("slice").orderBy("k", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = own.unionByName(marks, allowMissingColumns=True).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    won = swept.withColumn("won", F.get(F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0)))
    return won.select(F.col("id").alias(key), "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


OP8_SQL = """
with u as (select page_id, case when coalesce(instr(url, '://'), 0) > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select row_number() over () as n, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r(rh, rp, rv) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m as (select n, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(rv, length(rh || rp)) as rv
  from p join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by n)
select page_id, host, path, rule, coalesce(rv, 'allow') as verdict from p left join m using (n)
"""
