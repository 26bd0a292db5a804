"""Not-modified revisits of a web archive, resolved to the responses they stand for.

A revisit says that a page had not changed since an earlier capture.  It is joined,
as of its time, to the latest earlier full response under the same canonical URL; if
their validators agree it gets that response's content, with those headers replaced
that a not-modified answer may update.

A URL can have very many captures.  Captures are therefore cut into slices of about one
size in the order of URL and time, the latest response is sought inside a slice first,
and only the last response of each slice is carried to the URL's following ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, staged

#: Fixed by the HTTP standard: header fields that a 304 answer may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that don't select content.
IGNORED_PARAMETERS = r"^(utm_[a-z]+|fbclid|gclid|ref|sessionid)(=|$)"

SCHEMA = (
    "record_id long, url string, at long, kind string, etag string, last_modified string, digest string, "
    "headers map<string,string>, body string"
)


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default ports, path, sorted parameters.

    Scheme, fragment, user and parameters that don't select content are dropped, and
    a final slash of the path; a URL of another form stays as it is, null stays null."""
    form = r"(?i)^https?://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, form, 1)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, form, 2), "/+$", "")
    given = F.filter(F.split(F.regexp_extract(url, form, 3), "&"), lambda p: (p != "") & ~p.rlike(IGNORED_PARAMETERS))
    query = F.array_join(F.array_sort(given), "&")
    whole = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(url.rlike(form), whole).otherwise(url)


def _sliced(rows: DataFrame, rows_per_slice: int) -> DataFrame:
    """``rows`` with a number ``slice`` that grows with URL and time; as many slices as the
    rows need.  Captures of one URL and time share one.  Ranges are found from a sample, so
    the numbers are written down before they are used twice."""
    slices = -(-rows.count() // rows_per_slice)
    if slices < 2:
        return rows.withColumn("slice", F.lit(0))
    return staged(rows.repartitionByRange(slices, "url_key", "at").withColumn("slice", F.spark_partition_id()))


def _same_tag(a: Column, b: Column) -> Column:
    return F.regexp_replace(a, "^W/", "") == F.regexp_replace(b, "^W/", "")


def resolve_revisits(records: DataFrame, rows_per_slice: int = 1 << 20) -> DataFrame:
    """Every revisit of ``records`` (columns as in SCHEMA, others ignored):
    ``record_id, url_key, at, outcome, response_id, headers``.

    ``outcome`` is ``resolved``, ``changed`` (a validator differs), ``unvalidated``
    (neither has a validator in common; nothing is merged) or ``missing`` (no earlier
    response).  Validators are judged in the order etag, last_modified, digest; the
    first that both have decides.  Earlier means a smaller ``at``; of responses at one
    time the one with the largest id counts.  Null urls match nothing, null times are
    never earlier and see nothing earlier.  Repeated revisits are resolved each."""
    every = records.select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "at", "kind", "etag", "last_modified", "digest",
        F.array_sort(F.map_entries("headers")).alias("fields"),
    )
    placed = F.col("url_key").isNotNull() & F.col("at").isNotNull()
    # what has no URL or time meets nothing, so it isn't put in one group
    nowhere = every.where((F.col("kind") == "revisit") & ~placed)
    rows = _sliced(every.where(placed & F.col("kind").isin("response", "revisit")), rows_per_slice)
    rows = rows.withColumn("response", F.when(F.col("kind") == "response", F.struct("at", "record_id", "etag", "last_modified", "digest", "fields")))
    last = rows.groupBy("url_key", "slice").agg(F.max("response").alias("last"))
    before = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(F.col("url_key").alias("key"), F.col("slice").alias("of"), F.max("last").over(before).alias("carried"))
    inside = Window.partitionBy("url_key", "slice").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("inside", F.max("response").over(inside)).where(F.col("kind") == "revisit")
    found = found.join(carried, (F.col("url_key") == F.col("key")) & (F.col("slice") == F.col("of")), "left")
    found = found.withColumn("r", F.coalesce("inside", "carried"))
    agrees = F.coalesce(
        _same_tag(F.col("etag"), F.col("r.etag")), F.col("last_modified") == F.col("r.last_modified"), F.col("digest") == F.col("r.digest")
    )
    outcome = F.when(F.col("r").isNull(), "missing").when(agrees, "resolved").when(~agrees, "changed").otherwise("unvalidated")
    own = F.filter(F.coalesce("fields", F.array()), lambda x: F.lower(x["key"]).isin(*PERMITTED))
    names = F.transform(own, lambda x: F.lower(x["key"]))
    kept = F.filter(F.coalesce(F.col("r.fields"), F.array()), lambda x: ~F.array_contains(names, F.lower(x["key"])))
    found = found.withColumn("outcome", outcome).select(
        "record_id", "url_key", "at", "outcome", F.when(F.col("r").isNotNull(), F.col("r.record_id")).alias("response_id"),
        F.when(F.col("outcome") == "resolved", F.map_from_entries(F.array_sort(F.concat(kept, own)))).alias("headers"),
    )
    none = {"outcome": F.lit("missing"), "response_id": F.lit(None).cast("long"), "headers": F.lit(None).cast("map<string,string>")}
    return found.unionByName(nowhere.withColumns(none).select(found.columns))


def with_content(resolved: DataFrame, records: DataFrame, heavy_rows: int = 1000, copies: int = 64) -> DataFrame:
    """``resolved`` with the ``body`` of the response of each revisit that is resolved.

    Of responses that repeat an id the greatest body counts.  A response that stands for
    more than ``heavy_rows`` and a thousandth of all revisits is copied, and its revisits
    are dealt over the copies; the others' revisits are dealt by their own ids."""
    resolved = cut(resolved)
    done = F.col("outcome") == "resolved"
    heavy = resolved.where(done).groupBy("response_id").agg(F.count("*").alias("n")).where(F.col("n") > max(heavy_rows, resolved.count() // 1000))
    heavy = cut(heavy.select(F.col("response_id").alias("heavy_id")))  # a thousand rows at most
    bodies = records.where(F.col("kind") == "response").select(F.col("record_id").alias("body_id"), F.col("body").alias("found"))
    last = F.when(F.col("heavy_id").isNotNull(), copies - 1).otherwise(0)
    bodies = bodies.join(F.broadcast(heavy), F.col("body_id") == F.col("heavy_id"), "left").withColumn("copy_no", F.explode(F.sequence(F.lit(0), last)))
    bodies = bodies.groupBy("body_id", "copy_no").agg(F.max("found").alias("found"))
    dealt = F.when(F.col("heavy_id").isNotNull(), F.pmod(F.xxhash64("record_id"), F.lit(copies)).cast("int")).otherwise(0)
    rows = resolved.join(F.broadcast(heavy), done & (F.col("response_id") == F.col("heavy_id")), "left").select(
        *resolved.columns, F.when(done, F.col("response_id")).otherwise(F.col("record_id")).alias("want_id"), F.when(done, dealt).otherwise(-1).alias("want_no")
    )
    met = rows.join(bodies, (F.col("want_id") == F.col("body_id")) & (F.col("want_no") == F.col("copy_no")), "left")
    return met.select(*resolved.columns, F.col("found").alias("body"))


def captures_of(pages: DataFrame) -> DataFrame:
    """An archive made of a table of pages: each page is a response at time 10 * page_id,
    and is visited again 25 later or, every eleventh, 5 before.  A response has an etag, a
    date of change and a digest, or (by page_id modulo 6) two of them; the other answer
    has one of them or none (modulo 4), every fifth that of another version."""
    page = F.col("page_id")
    base = pages.select("page_id", "url", "html", F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16).alias("tag"))
    headers = lambda kind, tag: F.map_filter(
        F.create_map(F.lit("Date"), F.concat(F.lit(kind), page.cast("string")), F.lit("ETag"), tag, F.lit("Server"), F.lit(kind)), lambda _, value: value.isNotNull()
    )

    def capture(kind: str, offset: Column, has: list[Column], etag: str, version: Column, body: Column) -> DataFrame:
        marks = [F.when(ok, F.concat(F.lit(form), version, F.col("tag"))) for ok, form in zip(has, (etag, "m", "d"), strict=True)]
        return base.select(
            (page * 2 + int(kind == "revisit")).alias("record_id"), "url", (page * 10 + offset).alias("at"), F.lit(kind).alias("kind"),
            *[m.alias(name) for m, name in zip(marks, ("etag", "last_modified", "digest"), strict=True)],
            headers(kind, marks[0]).alias("headers"), body.alias("body"),
        )

    response = capture("response", F.lit(0), [page % 6 != i for i in range(3)], "", F.lit(""), F.col("html"))
    version = F.when(page % 5 == 0, F.lit("x")).otherwise(F.lit(""))
    offset = F.when(page % 11 == 0, F.lit(-5)).otherwise(F.lit(25))
    return response.unionByName(capture("revisit", offset, [page % 4 == i for i in range(3)], "W/", version, F.lit(None).cast("string")))
