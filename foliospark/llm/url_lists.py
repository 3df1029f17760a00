"""URL filters as a temporal list join, with DataFrame functions only.

Dated list entries become validity intervals, and every capture is evaluated against the entries that were active when
it was fetched: not those of today.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm.common import plain_table

#: Days that one bucket of time covers; entries are repeated for each bucket that their interval touches.
BUCKET_DAYS = 64


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, from_day, to_day (exclusive; null: still valid) of dated entries (pattern, day, action).

    action is 'add' or 'remove'; other actions and rows with a null are passed over. On one day a removal counts after an
    addition. An addition of a listed pattern and a removal of one that isn't listed change nothing.
    """
    daily = entries.where(F.col("action").isin("add", "remove") & F.col("pattern").isNotNull() & F.col("day").isNotNull()).groupBy("pattern", "day").agg(F.min("action").alias("low"), F.max("action").alias("high"))
    state = daily.select("pattern", "day", (F.col("high") == "add").alias("listed"))  # 'remove' is the larger word
    own = Window.partitionBy("pattern").orderBy("day")
    turns = state.withColumn("was", F.coalesce(F.lag("listed").over(own), F.lit(False))).where(F.col("was") != F.col("listed"))
    return turns.withColumn("to_day", F.lead("day").over(own)).where("listed").select("pattern", F.col("day").alias("from_day"), "to_day")


def host_of(url: F.Column) -> F.Column:
    """Lower-case host without user, port and final dot; empty where there is none. An IPv6 address keeps its brackets."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:]*?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1))


def patterns_of(url: F.Column) -> F.Column:
    """What entries can match a URL by: its host, the host's parent domains of two labels at least, and host + first folder.

    An IPv6 address has no parents; it matches in the spelling that it has, in lower case.
    """
    host = host_of(url)
    labels = F.split(host, "\\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.least(n, F.lit(2)), n), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    domains = F.when(F.startswith(host, F.lit("[")), F.array().cast("array<string>")).otherwise(domains)
    folder = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:]*://[^/?#]*(/[^/?#]*/)", 1)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(host), domains, F.when(folder != "", F.array(F.concat(host, folder))).otherwise(F.array().cast("array<string>")))))


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day", bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """captures with n_active (how many patterns of the URL were listed on its day) and matched (the longest of them).

    A capture of the day an entry begins is under it, one of the day it ends no longer is. matched is null, and n_active
    0, for captures without an active entry, with a null or unparsable URL, or a null day. Of equally long patterns the
    first in the alphabet is named. Rows and their number never change, repeated rows stay; input columns named n_active
    or matched are replaced. Both tables may be empty.

    Patterns and captures meet by pattern and bucket of time, so a host that has a large share of all captures is dealt
    to as many tasks as there are buckets, and Spark may split these further. Captures of one URL and day are looked
    up once.
    """
    captures = captures.drop("n_active", "matched")
    # a row may give as many patterns as its host has labels, so the rows are dealt out again before
    tasks = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = captures.select(F.col(url).alias("__url"), F.col(day).alias("__day")).where("__url is not null and __day is not null").distinct().repartition(tasks, "__url", "__day")
    each = wanted.select("__url", "__day", F.explode(patterns_of(F.col("__url"))).alias("pattern")).withColumn("bucket", F.floor(F.col("__day") / bucket_days))
    last = F.lit(captures.agg(F.max(day)).first()[0]).cast("long")
    spans = intervals(entries).where(F.col("from_day") <= last)
    upto = F.least(F.coalesce(F.col("to_day") - 1, last), last)
    bucketed = spans.select("pattern", "from_day", "to_day", F.explode(F.sequence(F.floor(F.col("from_day") / bucket_days), F.floor(upto / bucket_days))).alias("bucket"))
    met = each.join(bucketed, ["pattern", "bucket"]).where((F.col("__day") >= F.col("from_day")) & (F.col("__day") < F.coalesce("to_day", F.col("__day") + 1)))
    found = met.groupBy("__url", "__day").agg(F.count("*").alias("n_active"), F.min(F.struct((-F.length("pattern")).alias("n"), "pattern"))["pattern"].alias("matched"))
    joined = captures.join(found, (captures[url] == found["__url"]) & (captures[day] == found["__day"]), "left")
    return joined.select(*[captures[f"`{c}`"] for c in captures.columns], F.coalesce("n_active", F.lit(0)).alias("n_active"), "matched")


def _digit(value: F.Column, salt: str) -> F.Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), value)), 1, 6), 16, 10).cast("int")


def page_captures(pages: DataFrame) -> DataFrame:
    """page_id, url, day: the tables name no fetch times, so a page's id stands in for one of 720 days."""
    return pages.select("page_id", "url", F.pmod(F.col("page_id") * 37, F.lit(720)).cast("int").alias("day"))


def page_entries(pages: DataFrame) -> DataFrame:
    """pattern, day, action: a made-up list whose entries follow from the hosts and folders of the pages by MD5.

    A third of the hosts is added, removed and added again; of another third, the domain above is added for good; and a
    fifth of the first folders is added for good.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct().withColumn("h", _digit(F.col("host"), "h"))
    day = F.col("h") % 200
    three = F.array(*[F.struct(F.col("host").alias("pattern"), (day + plus).alias("day"), F.lit(action).alias("action")) for plus, action in ((0, "add"), (100, "remove"), (300, "add"))])
    above = F.array(F.struct(F.regexp_replace("host", "^[^.]*\\.", "").alias("pattern"), (F.col("h") % 400).alias("day"), F.lit("add").alias("action")))
    of_hosts = hosts.select(F.explode(F.when(F.col("h") % 3 == 0, three).when((F.col("h") % 3 == 1) & (F.size(F.split("host", "\\.")) > 3), above)).alias("e")).select("e.*")
    folders = pages.select(F.concat(host_of(F.col("url")), F.regexp_extract("url", r"^[^:]*://[^/?#]*(/[^/?#]*/)", 1)).alias("pattern")).where("pattern like '%/%'").distinct().withColumn("h", _digit(F.col("pattern"), "f"))
    return of_hosts.unionByName(folders.where("h % 5 = 0").select("pattern", (F.col("h") % 300).alias("day"), F.lit("add").alias("action")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, day, n_active, matched of every page, as captured on its stand-in day, under the made-up list."""
    pages = plain_table(spark, sf_dir, "pages", "page_id", "url")
    return evaluate(page_captures(pages), page_entries(pages)).select("page_id", "day", "n_active", "matched")


SQL = r"""
WITH captures AS (
  SELECT page_id, url, ((page_id * 37) % 720)::INT AS day,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:]*?)\.?(?::[0-9]*)?(?:[/?#]|$)', 1)) AS host,
    regexp_extract(url, '^[^:]*://[^/?#]*(/[^/?#]*/)', 1) AS folder FROM pages
), hosts AS (
  SELECT host, ('0x' || substr(md5('h' || host), 1, 6))::INT AS h FROM (SELECT DISTINCT host FROM captures WHERE host <> '')
), folders AS (
  SELECT pattern, ('0x' || substr(md5('f' || pattern), 1, 6))::INT AS h FROM (SELECT DISTINCT host || folder AS pattern FROM captures) WHERE pattern LIKE '%/%'
), spans AS (
  SELECT host AS pattern, h % 200 AS from_day, h % 200 + 100 AS to_day FROM hosts WHERE h % 3 = 0
  UNION ALL SELECT host, h % 200 + 300, NULL FROM hosts WHERE h % 3 = 0
  UNION ALL SELECT regexp_replace(host, '^[^.]*\.', ''), min(h % 400), NULL FROM hosts WHERE h % 3 = 1 AND len(string_split(host, '.')) > 3 GROUP BY 1
  UNION ALL SELECT pattern, h % 300, NULL FROM folders WHERE h % 5 = 0
), merged AS (
  SELECT s.* FROM spans s
), each AS (
  SELECT page_id, day, unnest(list_distinct(list_concat([host], list_transform(CASE WHEN starts_with(host, '[') THEN []::BIGINT[] ELSE range(least(len(string_split(host, '.')), 2), len(string_split(host, '.')) + 1) END,
    lambda k: array_to_string(string_split(host, '.')[-k:], '.')), CASE WHEN folder <> '' THEN [host || folder] ELSE [] END))) AS pattern
  FROM captures WHERE host <> ''
), active AS (
  SELECT DISTINCT page_id, day, e.pattern FROM each e JOIN merged m ON e.pattern = m.pattern AND day >= from_day AND day < coalesce(to_day, day + 1)
)
SELECT c.page_id, c.day, count(a.pattern) AS n_active, arg_min(a.pattern, (-length(a.pattern), a.pattern)) AS matched
FROM captures c LEFT JOIN active a ON c.page_id = a.page_id AND c.day = a.day GROUP BY c.page_id, c.day
"""
