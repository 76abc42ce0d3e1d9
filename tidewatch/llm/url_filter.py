"""URL filters: a temporal list join.

A list is dated entries (key, action, since): an entry adds or removes a rule for a host, a
registered domain or a path prefix from a day on. The entries of a key become validity intervals
[since, until) by its next entry. A capture is listed when an interval of any of its keys was
active at fetch time: the as-of join is an equi-join on the key with a range condition, and an
entry dated after the fetch never counts.

Scale: a capture is looked up by its host, parent domains, and its path prefixes of all depths that
occur in the list, and captures of one key and day are combined before the join, so a host with a third of all captures
is one row a day. Only matching (key, day) rows go back to captures, in a second equi-join on the
whole key set of a URL, which AQE can split where one host is hot.

Edge cases: a null URL or one without a host has no keys and is not listed; a null fetch time or a
null date in an entry matches nothing; of a key's entries of one day one holds, a
removal before the category that sorts last;
repeated rows are each evaluated; empty tables give unlisted captures; the operator's columns
replace input columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let


KEYS = "__url_keys"  # a column of captures, under a name that no input has
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]]+?)\.?(?::[0-9]*)?(?:[/?#].*)?$"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def url_host(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot, an IPv6 address with its brackets; empty if there is none."""
    return F.lower(F.regexp_extract(url, _HOST, 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def list_depths(entries: DataFrame) -> list[int]:
    """Numbers of path parts of the list's keys; no more than the deepest one has."""
    depth = F.size(F.split("key", "/")) - 1
    return sorted(r.depth for r in entries.where("key is not null").select(depth.alias("depth")).where("depth > 0").distinct().collect())


def url_keys(url: Column, depths: list[int] | None = None) -> Column:
    """Keys of a URL: the host and its parent domains of two labels or more, and host + path prefixes (all, or of these depths)."""
    labels = F.split(url_host(url), "\\.")
    domains = F.when(url_host(url).startswith("["), F.array(url_host(url))).otherwise(let(labels, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - 1, F.lit(1))), lambda i: F.array_join(F.slice(x, i, F.size(x)), "."))))
    parts = F.filter(F.split(url_path(url), "/"), lambda p: p != "")
    none = F.array().cast("array<string>")

    def prefixes_of(p: Column) -> Column:
        asked = F.sequence(F.lit(1), F.size(p)) if depths is None else F.filter(F.array(*map(F.lit, depths)), lambda i: i <= F.size(p))
        return F.transform(asked, lambda i: F.concat(url_host(url), F.lit("/"), F.array_join(F.slice(p, 1, i), "/")))

    prefixes = none if depths == [] else F.when(F.size(parts) > 0, let(parts, prefixes_of)).otherwise(none)
    return F.when(F.coalesce(url_host(url), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, since, until, category) of the entries that add; until is null while none follows.

    entries: key, action ('add' or 'remove'), since (date), category. A key has few entries.
    """
    order = Window.partitionBy("key").orderBy("since", F.col("action") == "remove", "category")
    dated = entries.where("key is not null and since is not null").withColumn("until", F.lead("since").over(order))
    return dated.where("action = 'add' and (until is null or until > since)").select("key", "since", "until", "category")


def listed(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetch_date") -> DataFrame:
    """``captures`` with is_listed, n_active (intervals met), first_key and categories, as of the fetch."""
    captures = captures.drop("is_listed", "n_active", "first_key", "categories").withColumn(KEYS, url_keys(F.col(url_col), list_depths(entries)))
    asked = captures.select(F.explode(KEYS).alias("key"), F.to_date(time_col).alias("day")).distinct()
    held = intervals(entries)
    active = asked.join(held, "key").where("since <= day and (until is null or day < until)")
    active = active.groupBy("key", "day").agg(F.collect_set("category").alias("cs"), F.count("*").alias("n"))
    # captures of one URL and day share one verdict
    urls = captures.select(KEYS, F.to_date(time_col).alias("day")).distinct()
    met = urls.select(KEYS, "day", F.explode(KEYS).alias("key")).join(active, ["key", "day"])
    verdict = met.groupBy(KEYS, "day").agg(F.sum("n").alias("n_active"), F.min("key").alias("first_key"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("cs")))).alias("categories"))
    verdict = verdict.withColumnsRenamed({KEYS: "__url_k", "day": "__url_day"})
    out = captures.join(verdict, (F.col(KEYS) == F.col("__url_k")) & (F.to_date(time_col) == F.col("__url_day")), "left").drop(KEYS, "__url_k", "__url_day")
    return out.withColumn("n_active", F.coalesce("n_active", F.lit(0).cast("long"))).withColumn("is_listed", F.col("n_active") > 0).withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures of the pages table, which has no fetch time: a day of 2024 is dealt to each page."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int")).alias("fetch_date"))


def page_entries(pages: DataFrame) -> DataFrame:
    """A dated list from the hosts and first path parts of the pages themselves.

    Of the hosts, by checksum, some are added in one month and removed in a later one, some added
    again; their first path parts are listed likewise.
    """
    host = pages.select(url_host(F.col("url")).alias("key"), F.concat(url_host(F.col("url")), F.lit("/"), F.get(F.split(url_path(F.col("url")), "/"), 1)).alias("path"))
    keys = host.select("key").where("key != ''").distinct().unionByName(host.select(F.col("path").alias("key")).where("key is not null and not endswith(key, '/')").distinct())
    h = keys.withColumn("h", F.conv(F.substring(F.md5("key"), 1, 6), 16, 10).cast("long"))
    start = F.lit("2024-01-01").cast("date")

    def entry(keep: Column, action: str, day: Column) -> DataFrame:
        return h.where(keep).select("key", F.lit(action).alias("action"), F.date_add(start, day.cast("int")).alias("since"), F.concat(F.lit("c"), (F.col("h") % 5).cast("string")).alias("category"))

    first = F.col("h") % 180
    added = entry(F.col("h") % 4 == 0, "add", first)
    removed = entry(F.col("h") % 8 == 0, "remove", first + F.col("h") % 97 + 1)
    again = entry(F.col("h") % 16 == 0, "add", first + F.col("h") % 97 + 1 + F.col("h") % 31)
    return added.unionByName(removed).unionByName(again)


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return listed(page_captures(pages), page_entries(pages)).select("page_id", "url", "fetch_date", "is_listed", "n_active", "first_key", F.array_join("categories", ",").alias("categories"))


OP2_SQL = rf"""
WITH u AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS fetch_date,
         lower(regexp_extract(url, '{_HOST}', 1)) AS host, regexp_extract(url, '{_PATH}', 1) AS path
  FROM pages),
s AS (SELECT *, string_split(host, '.') AS l, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM u),
k AS (
  SELECT page_id, fetch_date, unnest(list_distinct(list_concat(
           CASE WHEN starts_with(host, '[') THEN [host] ELSE list_transform(range(1, greatest(len(l) - 1, 1) + 1), lambda i: array_to_string(l[i:], '.')) END,
           list_transform(range(1, len(p) + 1), lambda i: host || '/' || array_to_string(p[1:i], '/'))))) AS key
  FROM s WHERE coalesce(host, '') <> ''),
names AS (
  SELECT DISTINCT host AS key FROM u WHERE host <> ''
  UNION ALL SELECT DISTINCT host || '/' || string_split(path, '/')[2] AS key FROM u WHERE string_split(path, '/')[2] <> ''),
h AS (SELECT key, CAST('0x' || substr(md5(key), 1, 6) AS BIGINT) AS h FROM names WHERE key IS NOT NULL),
e AS (
  SELECT key, 'add' AS action, h % 180 AS d, 'c' || (h % 5) AS category FROM h WHERE h % 4 = 0
  UNION ALL SELECT key, 'remove', h % 180 + h % 97 + 1, 'c' || (h % 5) FROM h WHERE h % 8 = 0
  UNION ALL SELECT key, 'add', h % 180 + h % 97 + 1 + h % 31, 'c' || (h % 5) FROM h WHERE h % 16 = 0),
w AS (SELECT *, DATE '2024-01-01' + CAST(d AS INTEGER) AS since FROM e),
i AS (
  SELECT * FROM (SELECT *, lead(since) OVER (PARTITION BY key ORDER BY since, action = 'remove', category) AS until FROM w)
  WHERE action = 'add' AND (until IS NULL OR until > since)),
a AS (
  SELECT k.page_id, count(*) AS n_active, min(k.key) AS first_key, array_to_string(list_sort(list_distinct(list(i.category))), ',') AS categories
  FROM k JOIN i ON k.key = i.key AND i.since <= k.fetch_date AND (i.until IS NULL OR k.fetch_date < i.until)
  GROUP BY k.page_id)
SELECT page_id, url, fetch_date, n_active IS NOT NULL AS is_listed, coalesce(n_active, 0) AS n_active, first_key, coalesce(categories, '') AS categories
FROM u LEFT JOIN a USING (page_id)
"""
