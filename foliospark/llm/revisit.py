"""WARC: resolving not-modified revisits to the full responses that they stand for.

A revisit record of the profile server-not-modified carries no body, only the headers of a 304 answer. It is resolved to
the latest earlier full response of the same canonical URL; the validators of both are compared; and the stored headers
are updated by those that a 304 answer may update.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.asof import latest_before
from foliospark.llm.common import checkpointed, plain_table
from foliospark.llm.hosts import ascii_host

# The profiles' identifiers, query parameters that only track, and headers that an update mustn't touch
NOT_MODIFIED = ("http://netpreserve.org/warc/1.0/revisit/server-not-modified", "http://netpreserve.org/warc/1.1/revisit/server-not-modified")
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"
FRAMING = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")


def _plain_escapes(value: F.Column) -> F.Column:
    """Escapes of letters, digits, '-', '.', '_' and '~' undone, the hexadecimal digits of the others in upper case; a % that begins none is one itself."""
    pieces = F.split(value, "%")

    def piece(x):
        code = F.conv(F.substring(x, 1, 2), 16, 10).cast("int")
        plain = F.chr(code)
        rest = F.substring(x, 3, 1 << 30)
        return F.when(~x.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.lit("%25"), x)).when(plain.rlike("^[A-Za-z0-9._~-]$"), F.concat(plain, rest)).otherwise(F.concat(F.lit("%"), F.upper(F.substring(x, 1, 2)), rest))

    undone = F.concat(F.get(pieces, 0), F.array_join(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))), piece), ""))
    return F.when(F.contains(value, F.lit("%")), undone).otherwise(value)


def canonical(url: F.Column) -> F.Column:
    """What captures of one page share: no scheme, user, www, default port, final dot of the host, fragment, tracking, final slash.

    Host in lower case, an international one in its ASCII form; escapes of unreserved characters undone, others in upper case, a lone % as %25, a space in a query always as %20;
    the other query parameters in alphabetical order. Null for null.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^(?i:https?)://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), "^.*@", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, ":(80|443)?$", ""), "\\.(:[0-9]+)?$", "$1"), "^www\\.", "")
    host = ascii_host(host)
    path = F.regexp_replace(_plain_escapes(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1)), "/+$", "")
    kept = F.filter(F.split(F.regexp_extract(bare, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(f"^(?i:{TRACKING})(=|$)"))
    asked = F.array_join(F.array_sort(F.transform(kept, lambda p: _plain_escapes(F.replace(p, F.lit("+"), F.lit("%20"))))), "&")
    return F.concat(host, path, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(F.lit("")))


def _lowered(headers: str) -> F.Column:
    """Headers with lower-case names; of names that differ in case alone, the last in the map counts. Never null."""
    pairs = F.transform(F.map_entries(F.coalesce(F.col(headers), F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))
    return last


def _strong(tag: F.Column) -> F.Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """One row for each not-modified revisit: record_id, url_key, resolved_id, outcome, headers.

    records: record_id (unique), kind (WARC-Type), uri, at (long, microseconds), profile, status (int) and headers (map).
    Full responses are records of kind 'response' with status 200. outcome:
      resolved          the validators that both have agree (entity tags without their weakness mark, else Last-Modified)
      unchecked         an earlier response, but no validator that both have
      mismatch          an earlier response whose validator differs; resolved_id names it, its headers aren't merged
      no earlier        no full response of this URL before the revisit; at the same moment doesn't count
    headers are those of the full response, updated by the revisit's except framing, content coding and content type, with
    lower-case names; null if nothing was merged. Records without a URL or time resolve to nothing. Of responses at one
    moment the one with the largest record_id counts. Repeated revisits stay, each once: a response that is there several
    times is one, and of different headers under one record_id the largest in the order of their names and values count.

    Only ids travel through the as-of join; headers join by the id that was found.
    """
    keyed = records.select("record_id", "kind", "at", "profile", "status", _lowered("headers").alias("headers"), canonical(F.col("uri")).alias("url_key"))
    full = keyed.where("kind = 'response' and status = 200")
    revisits = keyed.where((F.col("kind") == "revisit") & F.col("profile").isin(*NOT_MODIFIED)).select("record_id", "url_key", "at", F.col("headers").alias("fresh"))
    found = latest_before(full, revisits, "url_key", "at", "record_id", "resolved_id")
    # a table of its own, so that both sides of the join come straight from their shuffles and a response that most
    # revisits resolve to can be split
    stored = checkpointed(full.groupBy(F.col("record_id").alias("resolved_id")).agg(F.map_from_entries(F.max(F.array_sort(F.map_entries("headers")))).alias("stored")))
    both = found.join(stored, "resolved_id", "left")
    tag, date = (lambda side, name: F.get(F.map_values(F.map_filter(side, lambda k, _: k == name)), 0)), "last-modified"
    fresh_tag, stored_tag = _strong(tag(F.col("fresh"), "etag")), _strong(tag(F.col("stored"), "etag"))
    fresh_date, stored_date = tag(F.col("fresh"), date), tag(F.col("stored"), date)
    same = F.when(fresh_tag.isNotNull() & stored_tag.isNotNull(), fresh_tag == stored_tag).when(fresh_date.isNotNull() & stored_date.isNotNull(), fresh_date == stored_date)
    judged = both.withColumn("outcome", F.when(F.col("stored").isNull(), "no earlier").when(same, "resolved").when(~same, "mismatch").otherwise("unchecked"))
    update = F.map_filter("fresh", lambda k, _: ~k.isin(*FRAMING))
    merged = F.map_concat(F.map_filter("stored", lambda k, _: ~F.array_contains(F.map_keys(update), k)), update)
    return judged.select("record_id", "url_key", "resolved_id", "outcome", F.when(F.col("outcome").isin("resolved", "unchecked"), merged).alias("headers"))


def page_records(pages: DataFrame) -> DataFrame:
    """WARC records that stand in for the crawl that the table of pages lacks.

    Every page gives a full response at a time made of its id, and two revisits of other spellings of its URL: one before
    and one after it, or both after; every seventh of these has a stale entity tag, every fifth none at all.
    """
    def header(*pairs):
        return F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v for _, v in pairs]))

    i = F.col("page_id")
    tag = F.md5(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    day = F.pmod(i * 13, F.lit(400)) * 86_400_000_000
    size = F.length(F.coalesce("html", F.lit(""))).cast("string")
    nothing = F.lit(None).cast("string")
    first = F.struct((i * 3).alias("record_id"), F.lit("response").alias("kind"), F.col("url").alias("uri"), day.alias("at"), nothing.alias("profile"), F.lit(200).alias("status"), header(("ETag", F.concat(F.lit('"'), tag, F.lit('"'))), ("Content-Length", size), ("Date", day.cast("string"))).alias("headers"))

    def again(k, shift):
        mark = F.when(i % 7 == 0, F.lit('"stale"')).otherwise(F.concat(F.lit('W/"'), tag, F.lit('"')))
        plain = header(("Date", (day + shift).cast("string")), ("Content-Length", F.lit("0")))
        with_tag = header(("Date", (day + shift).cast("string")), ("Content-Length", F.lit("0")), ("etag", mark))
        uri = F.concat(F.regexp_replace("url", "^http:", "https:"), F.lit("#again"))
        return F.struct((i * 3 + k).alias("record_id"), F.lit("revisit").alias("kind"), uri.alias("uri"), (day + shift).alias("at"), F.lit(NOT_MODIFIED[1]).alias("profile"), F.lit(304).alias("status"), F.when(i % 5 == 0, plain).otherwise(with_tag).alias("headers"))

    days = 86_400_000_000
    return pages.select(F.explode(F.array(first, again(1, F.when(i % 4 == 0, F.lit(-days)).otherwise(F.lit(3 * days))), again(2, F.lit(40 * days)))).alias("r")).select("r.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, url_key, resolved_id, outcome, n_headers and headers_md5 of every revisit of the stand-in records.

    The digest is of all merged headers, a line "name:value" each, in the order of names; null where nothing was merged.
    """
    found = resolve(page_records(plain_table(spark, sf_dir, "pages", "page_id", "url", "html")))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), "\n")
    return found.select("record_id", "url_key", "resolved_id", "outcome", F.when(F.col("headers").isNotNull(), F.size("headers")).alias("n_headers"), F.md5(F.encode(lines, "UTF-8")).alias("headers_md5"))


_ESCAPES = r"""array_to_string(list_transform(string_split({0}, '%'), lambda x, i: CASE WHEN i = 1 THEN x WHEN NOT regexp_matches(x, '^[0-9A-Fa-f]{{2}}') THEN '%25' || x
      WHEN regexp_matches(chr(('0x' || substr(x, 1, 2))::INT), '^[A-Za-z0-9._~-]$') THEN chr(('0x' || substr(x, 1, 2))::INT) || substr(x, 3)
      ELSE '%' || upper(substr(x, 1, 2)) || substr(x, 3) END), '')"""
_PATH, _PARAMETER = _ESCAPES.format(r"regexp_extract(bare, '^[^/?]*([^?]*)', 1)"), _ESCAPES.format("replace(q, '+', '%20')")

SQL = rf"""
WITH p AS (
  SELECT page_id AS i, url, '"' || md5(coalesce(html, '')) || '"' AS tag, ((page_id * 13) % 400) * 86400000000 AS day, length(coalesce(html, '')) AS size,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^https?://', '', 'i') AS bare FROM pages
), keyed AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)?$', ''), '\.(:[0-9]+)?$', '\1'), '^www\.', '')
    || regexp_replace({_PATH}, '/+$', '') AS base,
    array_to_string(list_sort(list_transform(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)', 'i')),
      lambda q: {_PARAMETER})), '&') AS asked
  FROM p
), k AS (
  SELECT *, base || CASE WHEN asked <> '' THEN '?' || asked ELSE '' END AS url_key FROM keyed
), revisits AS (
  SELECT i * 3 + n AS record_id, url_key, day + CASE WHEN n = 2 THEN 40 WHEN i % 4 = 0 THEN -1 ELSE 3 END * 86400000000 AS seen,
    CASE WHEN i % 5 = 0 THEN NULL WHEN i % 7 = 0 THEN '"stale"' ELSE 'W/' || tag END AS fresh FROM k, (VALUES (1), (2)) v(n)
), earlier AS (
  SELECT r.*, k.i * 3 AS resolved_id, k.tag AS stored, k.size,
    row_number() OVER (PARTITION BY r.record_id ORDER BY k.day DESC NULLS LAST, k.i DESC) AS place
  FROM revisits r LEFT JOIN k ON r.url_key = k.url_key AND k.day < r.seen
), judged AS (
  SELECT *, CASE WHEN resolved_id IS NULL THEN 'no earlier' WHEN fresh IS NULL THEN 'unchecked'
    WHEN replace(fresh, 'W/', '') = stored THEN 'resolved' ELSE 'mismatch' END AS outcome FROM earlier WHERE place = 1
)
SELECT record_id, url_key, resolved_id, outcome, CASE WHEN outcome IN ('resolved', 'unchecked') THEN 3 END AS n_headers,
  CASE WHEN outcome IN ('resolved', 'unchecked') THEN md5('content-length:' || size || chr(10) || 'date:' || seen || chr(10) || 'etag:' || coalesce(fresh, stored)) END AS headers_md5
FROM judged
"""
