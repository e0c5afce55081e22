"""WARC records and the resolution of not-modified revisits.

A revisit of profile server-not-modified says that a capture was as an earlier one; its content is that
of the latest earlier full response of the same canonical URL. ``resolve`` finds it by an as-of join:
per URL and time range, full responses and revisits are ordered together and each revisit takes the last
full response before it. Ranges keep a URL with a third of all captures from being one task; what a
range's start needs from earlier ranges is carried by a summary of one row per range. The validators (ETag,
Last-Modified) of both records are checked, and only headers that a 304 response may update are merged.
Payloads aren't moved: the as-of join carries the base's id, digest and headers.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: parameters that name a visit, not a page
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref", "sessionid")
# fixed values: headers that a 304 response may carry to update the stored response
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "age", "server")
NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def canonical(url: Column) -> Column:
    """One form for the addresses of a page: no scheme, credentials, www or m label, default port, fragment, index page,
    trailing slash or tracking parameters; host in lower case, other parameters sorted."""
    u = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(u, r"^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"^(?:www\d*|m)\.", ""), r":(?:80|443)?$", "")
    path = F.regexp_extract(u, r"^[^/?]*([^?]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, r"/index\.\w+$", "/"), "/+$", "")
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def lower_names(headers: Column) -> Column:
    """The headers with names in lower case and in order. Lines of one name, in any case, are one: their values in order of the names as written,
    joined by commas, as HTTP reads them. Null values count as absent; no headers make an empty map."""
    held = F.array_sort(F.filter(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: e["value"].isNotNull()))
    names = F.array_sort(F.array_distinct(F.transform(held, lambda e: F.lower(e["key"]))))
    value = lambda n: F.array_join(F.transform(F.filter(held, lambda e: F.lower(e["key"]) == n), lambda e: e["value"]), ", ")
    return F.map_from_arrays(names, F.transform(names, value))


def header(headers: Column, name: str) -> Column:
    """The value of a header, whose name may be in any case."""
    return F.element_at(lower_names(headers), name.lower())


def resolve(records: DataFrame, *, range_seconds: int = 3600) -> DataFrame:
    """Each revisit with the full response it stands for.

    records: record_id long, url string, ts timestamp, kind ('response' or 'revisit'), profile string,
    status int, headers map<string,string>, digest string. A full response is a response of status 200.
    Returns record_id, canonical_url, ts, base_id, base_ts, age_seconds, validator ('etag', 'last-modified',
    'none' or 'mismatch'), resolved boolean, status int, digest, headers (the base's with the revisit's
    permitted ones merged in, names in lower case).

    Only not-modified revisits are resolved; others are left out. Earlier means an earlier time, or the
    same time and a smaller id; a null time or URL resolves to nothing, as does a revisit without an earlier
    full response: base_id is null and resolved false. A validator that both records have and that differs
    makes a mismatch, which is reported but not resolved. Headers whose names differ only in case are one (lower_names).
    Repeated rows are resolved each; an empty table gives no row. Extra columns are ignored, whatever their names.
    """
    r = records.select(
        "record_id", canonical(F.col("url")).alias("canonical_url"), F.col("url").isNotNull().alias("known"), "ts", "kind", "profile", "status", "digest",
        lower_names(F.col("headers")).alias("headers"),
    ).withColumn("span", F.floor(F.unix_timestamp("ts") / range_seconds))
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    base = F.when(full, F.struct("ts", "record_id", "digest", F.map_entries("headers").alias("entries")))
    asked = (F.col("kind") == "revisit") & (F.col("profile") == NOT_MODIFIED)
    timed = r.where(F.col("ts").isNotNull() & F.col("known") & (full | asked))
    within = Window.partitionBy("canonical_url", "span").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    here = timed.withColumn("near", F.last(base, ignorenulls=True).over(within))
    # the last full response of each range, and of the ranges before it: one row per URL and range
    lasts = timed.where(full).groupBy("canonical_url", "span").agg(F.max(base).alias("last")).select("canonical_url", "span", "last")
    asking = here.where(asked)
    need = asking.where("near is null").select("canonical_url", "span").distinct()
    ranges = lasts.unionByName(need.withColumn("last", F.lit(None).cast(lasts.schema["last"].dataType)))
    summary = ranges.groupBy("canonical_url", "span").agg(F.max("last").alias("last"))
    carried = summary.withColumn("far", F.last("last", ignorenulls=True).over(Window.partitionBy("canonical_url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))).select("canonical_url", "span", "far")
    held = asking.join(carried.where("far is not null"), ["canonical_url", "span"], "left").withColumn("base", F.coalesce("near", "far"))
    lost = r.where(asked & (F.col("ts").isNull() | ~F.col("known"))).withColumn("base", F.lit(None).cast(held.schema["base"].dataType))
    columns = ["record_id", "canonical_url", "ts", "headers", "base"]
    return _merged(held.select(*columns).unionByName(lost.select(*columns)))


def _merged(found: DataFrame) -> DataFrame:
    old = F.map_from_entries("base.entries")
    tag, old_tag, when, old_when = (F.element_at(m, n) for n in ("etag", "last-modified") for m in (F.col("headers"), F.col("old")))
    weak = lambda t: F.regexp_replace(t, "^W/", "")  # noqa: E731  (a not-modified answer compares weakly)
    validator = (
        F.when(F.col("base").isNull(), "none")
        .when(weak(tag) == weak(old_tag), "etag")
        .when(weak(tag) != weak(old_tag), "mismatch")
        .when(when == old_when, "last-modified")
        .when(when != old_when, "mismatch")
        .otherwise("none")
    )
    fresh = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(F.map_filter("old", lambda k, _: ~F.map_contains_key(F.col("fresh"), k)), F.col("fresh")))))
    x = found.withColumn("old", F.coalesce(old, F.create_map().cast("map<string,string>"))).withColumn("fresh", fresh).withColumn("validator", validator)
    ok = F.col("base").isNotNull() & (F.col("validator") != "mismatch")
    return x.select(
        "record_id", "canonical_url", "ts", F.col("base.record_id").alias("base_id"), F.col("base.ts").alias("base_ts"),
        (F.unix_timestamp("ts") - F.unix_timestamp("base.ts")).alias("age_seconds"), "validator", ok.alias("resolved"),
        F.when(ok, 200).otherwise(304).alias("status"), F.when(ok, F.col("base.digest")).alias("digest"), F.when(ok, merged).otherwise(F.col("headers")).alias("headers"),
    )


def with_payload(resolved: DataFrame, records: DataFrame, payload: str = "payload") -> DataFrame:
    """``resolved`` with the base's payload: a join on the base's id, for those who need the content itself."""
    base = records.select(F.col("record_id").alias("base_id"), F.col(payload).alias(payload))
    return resolved.join(base, "base_id", "left")


# files ------------------------------------------------------------------------------------------


def encode(kind: str, url: str, ts: str, record_id: str, content: bytes, extra: dict[str, str] | None = None) -> bytes:
    """One WARC/1.1 record as a gzip member of its own."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Target-URI: {url}", f"WARC-Date: {ts}", f"WARC-Record-ID: <{record_id}>", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(content)}"]
    lines += [f"{k}: {v}" for k, v in (extra or {}).items()]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + content + b"\r\n\r\n", mtime=0)


def inflated(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The content of a file, gzip members one after another or plain, in pieces. It ends where a member is torn or isn't one."""
    view = memoryview(data)
    if data[:2] != b"\x1f\x8b":
        yield from (bytes(view[i : i + size]) for i in range(0, len(view), size))
        return
    at = 0
    while at < len(view):
        unzip = zlib.decompressobj(31)
        try:
            while not unzip.eof and at < len(view):
                fed = view[at : at + size]
                at += len(fed)
                piece = unzip.decompress(fed, size)
                yield piece
                while unzip.unconsumed_tail and not unzip.eof:
                    yield unzip.decompress(unzip.unconsumed_tail, size)
            if not unzip.eof:
                yield unzip.flush()
        except zlib.error:
            return
        at -= len(unzip.unused_data)


def decode(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, content) of each record of a WARC file, compressed or not.

    One record is in memory at a time. A torn last record is left out, whether the file ends inside it, inside its headers
    or inside its gzip member; so is a record whose length isn't a number, and what follows it up to the next one.
    """
    pieces = inflated(data)
    held = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while (start := held.find(b"WARC/")) < 0:
            del held[: max(0, len(held) - 4)]  # a mark may lie across two pieces
            if not more():
                return
        del held[:start]
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                return
        named = dict(line.split(":", 1) for line in held[:end].decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
        named = {k.strip().lower(): v.strip() for k, v in named.items()}
        size = named.get("content-length", "0")
        if not size.isdigit():
            del held[:5]
            continue
        stop = end + 4 + int(size)
        while len(held) < stop:
            if not more():
                return
        yield named, bytes(held[end + 4 : stop])
        del held[:stop]


def parse_http(content: bytes) -> tuple[int | None, dict[str, str], bytes]:
    """Status, headers and body of an HTTP response; (None, {}, content) if it isn't one. Repeated headers are joined by commas."""
    head, sep, body = content.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    first = lines[0].split(" ", 2)
    if not first[0].startswith("HTTP/") or len(first) < 2 or not first[1].isdigit():
        return None, {}, content
    named: dict[str, str] = {}
    for line in lines[1:]:
        k, colon, v = line.partition(":")
        if colon:
            k, v = k.strip(), v.strip()
            named[k] = f"{named[k]}, {v}" if k in named else v
    return int(first[1]), named, body


RECORDS = "record string, url string, ts timestamp, kind string, profile string, status int, headers map<string,string>, digest string, payload binary"


def moment(text: str | None) -> pd.Timestamp | None:
    try:
        return pd.Timestamp(text).tz_convert("UTC").tz_localize(None) if text else None
    except (ValueError, TypeError):
        return None


def read_warc(spark: SparkSession, path: str, *, batch: int = 8 << 20) -> DataFrame:
    """The records of all WARC files of a path, read by Spark; a file is one task's work, as WARC files are of bounded size.

    A task holds a file as it is stored, one record, and a batch of records of about ``batch`` bytes. A date that can't be read is null.
    """

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["record", "url", "ts", "kind", "profile", "status", "headers", "digest", "payload"]
        rows, size = [], 0
        for pdf in parts:
            for data in pdf["content"]:
                for named, content in decode(data):
                    status, http, body = parse_http(content)
                    rows.append((named.get("warc-record-id", "").strip("<>"), named.get("warc-target-uri"), moment(named.get("warc-date")), named.get("warc-type"), named.get("warc-profile"), status, http, named.get("warc-payload-digest"), body))
                    size += len(content)
                    if size >= batch:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
        yield pd.DataFrame(rows, columns=columns)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, RECORDS)


# the pages table as a crawl -------------------------------------------------------------------------


def crawl(pages: DataFrame, *, revisit_every: int = 2) -> DataFrame:
    """The ``pages`` table as WARC records, two for each page: its full response, and a later revisit.

    Page p is fetched at second p of 2024. Every page is asked for again a day or more later; the
    server answers not modified, with a new Date and Expires. In one of seven the ETag has changed (a
    mismatch), in one of five the revisit came before the page's own capture, and every ``revisit_every``-th
    answer carries Last-Modified instead of an ETag. Ids: 2 p for the response, 2 p + 1 for the revisit.
    """
    p = F.col("page_id").cast("long")
    start = F.lit(1_704_067_200)
    digest = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    changed = F.concat(F.lit('"'), F.reverse(F.substring(digest, 1, 16)), F.lit('"'))
    stamp = lambda s: F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    at, later = start + p, start + p + F.when(p % 5 == 4, -7_200).otherwise(86_400 + p % 1000)
    pairs = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    base = pages.select((2 * p).alias("record_id"), F.col("url"), F.timestamp_seconds(at).alias("ts"), F.lit("response").alias("kind"), F.lit(None).cast("string").alias("profile"), F.lit(200).alias("status"), pairs("Content-Type", "text/html", "ETag", tag, "Last-Modified", stamp(at), "Date", stamp(at), "Content-Length", F.coalesce(F.octet_length("html"), F.lit(0)).cast("string")).alias("headers"), digest.alias("digest"))
    answer = F.when(p % revisit_every == 0, pairs("ETag", F.when(p % 7 == 3, changed).otherwise(tag), "Date", stamp(later), "Expires", stamp(later + 3600), "Content-Length", F.lit("0"))).otherwise(pairs("Last-Modified", F.when(p % 7 == 3, stamp(at - 60)).otherwise(stamp(at)), "Date", stamp(later), "Set-Cookie", F.lit("a=b")))
    again = pages.select((2 * p + 1).alias("record_id"), F.col("url"), F.timestamp_seconds(later).alias("ts"), F.lit("revisit").alias("kind"), F.lit(NOT_MODIFIED).alias("profile"), F.lit(304).alias("status"), answer.alias("headers"), F.lit(None).cast("string").alias("digest"))
    return base.unionByName(again)
