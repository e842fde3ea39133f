"""URL filters over time: dated list entries become validity intervals, captures are joined as of their fetch.

A list changes by dated entries (add or remove) for hosts with their subdomains
and for path prefixes. Window functions turn each pattern's entries into
intervals [valid_from, valid_to); an equi-join on the pattern with a range
condition finds the entries active when a capture was fetched. All of it is
DataFrame expressions.

Captures are reduced to distinct (url, fetched) first, so a URL fetched often is
judged once. The join is a plain sort-merge join on the pattern, both sides
straight from an exchange: a host with a third of all captures is split by
adaptive execution. Only as many path levels are tried as the deepest entry has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, without


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user, port and trailing dot; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1))


def path_of(url: Column) -> Column:
    """Path of an absolute URL, without query and fragment."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, verdict, kind, pattern, valid_from, valid_to) of dated entries.

    entries: list, verdict ('block' or 'allow'), kind ('host' or 'prefix'),
    pattern, action ('add' or 'remove'), dated (timestamp). A pattern is on a
    list from an 'add' until its next entry; valid_to is null if there is none.
    Of entries with one date the 'remove' counts last. Entries with a null
    pattern, list, action or date are left out; repeated entries count once.
    """
    e = entries.select("list", "verdict", "kind", F.lower("pattern").alias("pattern"), "action", "dated").where("list is not null and pattern is not null and action is not null and dated is not null").distinct()
    w = Window.partitionBy("list", "verdict", "kind", "pattern").orderBy("dated", "action")
    e = e.withColumn("valid_to", F.lead("dated").over(w)).where("action = 'add' and (valid_to is null or valid_to > dated)")
    return e.select("list", "verdict", "kind", "pattern", F.col("dated").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """Add decision, list and pattern to every capture; columns of these names are replaced.

    The longest active pattern decides; of two with one length 'block' wins, then
    the list that sorts first. Without an active entry the decision is
    'unlisted'; a null URL, one without a host, or a null fetch time is
    'unknown'. A host entry covers its subdomains. Repeated captures all stay;
    URLs of any length are judged whole. An empty table of captures gives an empty
    result, without entries all captures are 'unlisted' or 'unknown'. Other
    columns of the entries are ignored.
    """
    df = without(captures, ("decision", "list", "pattern", "url_", "at_", "best_"))
    listed = intervals(entries)
    depth = listed.where("kind = 'prefix'").agg(F.coalesce(F.max(F.size(F.split("pattern", "/"))), F.lit(1)) - 1).first()[0]
    known = df.select(F.col(url).alias("url_"), F.col(fetched).alias("at_")).where("url_ is not null and at_ is not null").distinct()
    host = known.select("url_", "at_", host_of(F.col("url_")).alias("host"), path_of(F.col("url_")).alias("path")).where("host != ''")
    domains = F.transform(F.sequence(F.lit(1), F.size(F.split("host", r"\."))), lambda i: F.struct(F.lit("host").alias("kind"), F.array_join(F.slice(F.split("host", r"\."), F.size(F.split("host", r"\.")) - i + 1, i), ".").alias("pattern")))
    parts = F.split("path", "/")  # the first is empty: a path begins with a slash
    levels = F.when((F.lit(depth) > 0) & (F.size(parts) > 1), F.sequence(F.lit(2), F.least(F.size(parts), F.lit(depth) + 1))).otherwise(F.expr("array()").cast("array<int>"))
    prefixes = F.transform(levels, lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(F.col("host"), F.lower(F.array_join(F.slice(parts, 1, i), "/"))).alias("pattern")))
    keys = host.select("url_", "at_", F.explode(F.concat(domains, prefixes)).alias("k")).select("url_", "at_", "k.kind", "k.pattern")
    active = keys.join(listed, (keys["kind"] == listed["kind"]) & (keys["pattern"] == listed["pattern"]) & (keys["at_"] >= listed["valid_from"]) & (listed["valid_to"].isNull() | (keys["at_"] < listed["valid_to"])))
    # The smallest of (-length, block before allow, list, pattern) decides.
    rank = F.struct((-F.length(listed["pattern"])).alias("n"), (listed["verdict"] != "block").alias("b"), listed["list"].alias("list"), listed["pattern"].alias("pattern"), listed["verdict"].alias("verdict"))
    best = active.select("url_", "at_", rank.alias("r")).groupBy("url_", "at_").agg(F.min("r").alias("best_"))
    out = df.join(best, (F.col(url) == F.col("url_")) & (F.col(fetched) == F.col("at_")), "left")
    unknown = F.col(url).isNull() | F.col(fetched).isNull() | (host_of(F.col(url)) == "")
    decision = F.when(unknown, F.lit("unknown")).otherwise(F.coalesce(F.col("best_.verdict"), F.lit("unlisted")))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], decision.alias("decision"), F.col("best_.list").alias("list"), F.col("best_.pattern").alias("pattern"))


#: There is no list and no fetch time among the tables. A page is fetched page_id hours after this; each host and each
#: language folder of a host goes on a list some hours after its first page and off again later.
START = 1_704_067_200  # 2024-01-01 in UTC


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision on every page as of its fetch, under lists that change with time.

    Hosts with an even number of letters are on the block list from the middle
    of their pages' fetch times, the others from the first to the middle; the
    folder host/en is on an allow list from a quarter on.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hour = lambda c: F.timestamp_seconds(F.lit(START) + c.cast("bigint") * 3600)
    captures = pages.withColumn("fetched", hour(F.col("page_id")))
    span = pages.withColumn("host", host_of(F.col("url"))).where("host != ''").groupBy("host").agg(F.min("page_id").alias("a"), F.max("page_id").alias("b"))
    middle, even = F.floor((F.col("a") + F.col("b")) / 2), F.length("host") % 2 == 0
    entry = lambda name, verdict, kind, pattern, action, at: F.struct(F.lit(name).alias("list"), F.lit(verdict).alias("verdict"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), hour(at).alias("dated"))
    first = F.col("a")
    early = F.array(entry("early", "block", "host", F.col("host"), "add", first), entry("early", "block", "host", F.col("host"), "remove", middle))
    late = F.array(entry("late", "block", "host", F.col("host"), "add", middle))
    allowed = F.array(entry("language", "allow", "prefix", F.concat("host", F.lit("/en")), "add", F.floor((3 * F.col("a") + F.col("b")) / 4)))
    entries = span.select(F.explode(F.concat(F.when(even, late).otherwise(early), allowed)).alias("e")).select("e.*")
    return judge(captures, entries).withColumns({c: F.coalesce(c, F.lit("")) for c in ("list", "pattern")})


OP6_SQL = r"""
WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*?)\.?(?::[0-9]*)?(?:[/?#]|$)', 1)) AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
s AS (SELECT host, min(page_id) AS a, max(page_id) AS b FROM p WHERE host <> '' GROUP BY host),
l AS (
  SELECT 'late' AS list, 'block' AS verdict, 'host' AS kind, host AS pattern, (a + b) // 2 AS f, NULL::BIGINT AS t FROM s WHERE length(host) % 2 = 0
  UNION ALL SELECT 'early', 'block', 'host', host, a, (a + b) // 2 FROM s WHERE length(host) % 2 = 1 AND (a + b) // 2 > a
  UNION ALL SELECT 'language', 'allow', 'prefix', host || '/en', (3 * a + b) // 4, NULL FROM s),
m AS (
  SELECT p.page_id, l.*, row_number() OVER (PARTITION BY p.page_id, p.url ORDER BY -length(pattern), verdict <> 'block', list) AS r
  FROM p JOIN l ON p.page_id >= l.f AND (l.t IS NULL OR p.page_id < l.t)
   AND ((l.kind = 'host' AND (p.host = l.pattern OR p.host LIKE '%.' || l.pattern))
     OR (l.kind = 'prefix' AND (lower(p.host || p.path) = l.pattern OR lower(p.host || p.path) LIKE l.pattern || '/%'))))
SELECT p.page_id, p.url, TIMESTAMP '2024-01-01 00:00:00' + to_hours(p.page_id) AS fetched,
  CASE WHEN p.url IS NULL OR p.host = '' THEN 'unknown' ELSE coalesce(m.verdict, 'unlisted') END AS decision, coalesce(m.list, '') AS list, coalesce(m.pattern, '') AS pattern
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.r = 1
"""
