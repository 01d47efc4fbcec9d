"""URL filters by a sort-merge range join with DataFrame functions only.

A rule (host, path, verdict) fits its host and all subdomains if the path
starts with the rule's. Hosts are reversed by label (``www.example.org`` gives
``org.example.www``); a page is a point under each of its ancestors that has
rules, at the bytes of its path, and a rule is the interval from its path to
its path followed by byte FF, which no UTF-8 text contains. Intervals of one
host nest or are disjoint. Points and interval ends are sorted together; each
end carries the stack of rules active behind it, so the last stack seen in the
sweep is what holds at a point, and its top is the longest rule of that host.

A popular host is swept in several salted groups, each with a copy of its
rules; the number of groups follows the host's counted pages, so that no group
grows with the input, and a group has at least eight pages for each rule.

Defined results. The longest rule wins, by the length of host plus path, then
of host; of equal rules block wins. Null URLs and URLs without ``://`` have an
empty host and path and get the default verdict, as do all pages if there are
no rules. Rules with an empty host or a null are ignored. Rows that repeat are
judged alike and all returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwise.llm.common import ascii_lower, broadcast_if_small
from loomwise.session import cut

#: The rules of the registered query, with their hosts, paths and verdicts.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Pages in a swept group at least.
GROUP_ROWS = 512
STACK = "array<struct<path:string,verdict:string>>"


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def _reversed(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _stacks(rules: DataFrame) -> DataFrame:
    """Each rule with the rules of its host that enclose it, the outermost first."""
    r = rules.alias("r").select("key", "path", "verdict", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n"))
    up = rules.select(F.col("key").alias("u_key"), F.col("path").alias("u_path"), F.col("verdict").alias("u_verdict"))
    inside = (r.key == up.u_key) & (F.substring(r.path, F.lit(1), r.n) == up.u_path)
    return (
        r.join(up, inside)
        .groupBy("key", "path", "verdict")
        .agg(F.array_sort(F.collect_list(F.struct(F.length("u_path").alias("n"), F.col("u_path").alias("path"), F.col("u_verdict").alias("verdict")))).alias("s"))
        .select("key", "path", F.transform("s", lambda x: F.struct(x.path, x.verdict)).cast(STACK).alias("stack"))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", group_rows: int = GROUP_ROWS) -> DataFrame:
    """page_id, url, host, path, rule (host and path of the winner, or null) and verdict of every page."""
    base = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rules = (
        rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict")
        .dropna()
        .where("host <> ''")
        .groupBy(F.array_join(_reversed(F.col("host")), ".").alias("key"), "path")
        .agg(F.max("verdict").alias("verdict"))
    )
    depth = rules.agg(F.max(F.size(F.split("key", r"\.")))).first()[0] or 0  # one number
    labels = base.where("host <> ''").select("page_id", "url", "path", F.slice(_reversed(F.col("host")), 1, max(depth, 1)).alias("l"))
    levels = F.transform(F.sequence(F.lit(1), F.size("l")), lambda k: F.array_join(F.slice("l", F.lit(1), k), "."))
    points = labels.select("page_id", "url", "path", F.explode(levels).alias("key"))

    hosts = rules.groupBy("key").agg(F.count("*").alias("n_rules"))
    counted = points.groupBy("key").agg(F.count("*").alias("n_pages"))
    salts = F.ceil(F.col("n_pages") / F.greatest(F.lit(group_rows), 8 * F.col("n_rules"))).cast("int")
    hosts = cut(hosts.join(counted, "key").select("key", salts.alias("n_salts")))
    held = broadcast_if_small(hosts)

    bytes_of = lambda c: F.encode(c, "utf-8")
    mine = points.join(held, "key").select(
        "key",
        F.pmod(F.xxhash64("page_id", "url"), F.col("n_salts")).cast("int").alias("salt"),
        bytes_of(F.col("path")).alias("at"),
        F.lit(1).alias("kind"),
        F.lit(None).cast(STACK).alias("stack"),
        "page_id",
        "url",
    )
    ends = (
        _stacks(rules)
        .join(held, "key")
        .select("key", "path", "stack", F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1)).alias("salt"))
        .select(
            "key",
            "salt",
            F.explode(
                F.array(
                    F.struct(bytes_of(F.col("path")).alias("at"), F.lit(0).alias("kind"), F.col("stack").alias("stack")),
                    F.struct(F.concat(bytes_of(F.col("path")), F.unhex(F.lit("FF"))).alias("at"), F.lit(0).alias("kind"), F.slice("stack", F.lit(1), F.size("stack") - 1).alias("stack")),
                )
            ).alias("e"),
        )
        .select("key", "salt", "e.at", "e.kind", "e.stack")
    )
    swept = mine.unionByName(ends, allowMissingColumns=True)
    so_far = Window.partitionBy("key", "salt").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = swept.withColumn("top", F.get(F.last("stack", True).over(so_far), F.size(F.last("stack", True).over(so_far)) - 1)).where("kind = 1 AND top IS NOT NULL")
    name = F.array_join(_reversed(F.col("key")), ".")
    won = (
        active.select("page_id", "url", F.struct((F.length("key") + F.length("top.path")).alias("n"), F.length("key").alias("h"), F.concat(name, F.col("top.path")).alias("rule"), F.col("top.verdict").alias("verdict")).alias("w"))
        .groupBy(F.col("page_id").alias("w_id"), F.col("url").alias("w_url"))
        .agg(F.max("w").alias("w"))
    )
    return base.join(won, base.page_id.eqNullSafe(won.w_id) & base.url.eqNullSafe(won.w_url), "left").select(
        "page_id", "url", "host", "path", F.col("w.rule").alias("rule"), F.coalesce("w.verdict", F.lit(default)).alias("verdict")
    )


def op10_url_rules(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules).drop("url")


ORACLE_SQL = r"""
WITH r(rhost, rpath, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (
  SELECT row_number() OVER () AS n, page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
m AS (
  SELECT n, max_by(rhost || rpath, length(rhost) + length(rpath)) AS rule, max_by(v, length(rhost) + length(rpath)) AS v
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (n)
"""
