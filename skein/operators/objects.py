"""Object inventories: listings, ranges, conditions, entity tags, copies, batch deletes, multipart listings.

Form: objects(key binary, size, etag, modified_at_ms).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.hashing import multipart_etag
from skein.functions.predicates import has_prefix


def common_prefix(key: Column, prefix: bytes, delimiter: bytes) -> Column:
    """The key up to and including the first delimiter after the prefix; null without one."""
    text, mark = key.cast("string"), delimiter.decode()
    rest = F.substring(text, len(prefix.decode()) + 1, 1 << 30)
    at = F.instr(rest, mark)
    return F.when(at > 0, F.concat(F.lit(prefix.decode()), F.substring(rest, F.lit(1), at + len(mark) - 1)))


def listing(objects: DataFrame, *, prefix: bytes = b"", delimiter: bytes = b"", after: bytes | None = None, max_keys: int | None = None) -> DataFrame:
    """(entry, is_prefix, objects, last_key) in order: keys, and common prefixes as one entry each. max_keys counts scanned
    keys: a page may end within a prefix, and the next page (after last_key) has that prefix again."""
    rows = objects.filter(has_prefix(F.col("key"), prefix)) if prefix else objects
    rows = rows if after is None else rows.filter(F.col("key") > F.lit(after))
    rows = rows if max_keys is None else rows.orderBy("key").limit(max_keys)
    fold = common_prefix(F.col("key"), prefix, delimiter) if delimiter else F.lit(None).cast("string")
    rows = rows.withColumn("entry", F.coalesce(fold, F.col("key").cast("string"))).withColumn("is_prefix", fold.isNotNull())
    return rows.groupBy("entry", "is_prefix").agg(F.count("*").alias("objects"), F.max("key").alias("last_key")).orderBy("entry")


def byte_range(header: Column, length: Column) -> Column:
    """struct(status, start, end) of a Range header: full, partial, invalid, multiple or unsatisfiable; end is exclusive."""
    first, last = (F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", k).try_cast("long") for k in (1, 2))
    shaped = header.rlike(r"^bytes=(\d+-\d*|-\d+)$") & ~(first.isNotNull() & last.isNotNull() & (last < first))
    start = F.when(first.isNotNull(), first).otherwise(F.greatest(length - last, F.lit(0)))
    end = F.when(first.isNull() | last.isNull(), length).otherwise(F.least(last + 1, length))
    empty = (first.isNotNull() & (first >= length)) | (first.isNull() & (last == 0)) | (length == 0)
    status = F.when(header.isNull(), "full").when(header.startswith("bytes=") & header.contains(","), "multiple").when(~shaped, "invalid").when(empty, "unsatisfiable").otherwise("partial")
    ok = status == "partial"
    return F.struct(status.alias("status"), F.when(status == "full", 0).when(ok, start).alias("start"), F.when(status == "full", length).when(ok, end).alias("end"))


def etag_matches(header: Column, etag: Column, weak: bool) -> Column:
    """Whether a list of quoted tags or * names the tag; weak tags only count in weak comparison."""
    plain = lambda x: F.replace(F.regexp_replace(F.trim(x), "^W/", "") if weak else F.trim(x), F.lit('"'), F.lit(""))
    return (F.trim(header) == "*") | F.exists(F.split(header, ","), lambda x: plain(x) == etag)


def http_seconds(text: Column) -> Column:
    """Seconds of an HTTP date; null if it is none."""
    return F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, "^[A-Za-z]{3}, ", ""), " GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss")))


def condition(etag: Column, modified_s: Column, if_match: Column, if_unmodified: Column, if_none_match: Column, if_modified: Column) -> Column:
    """ok, failed or not_modified. If-Match outranks If-Unmodified-Since, If-None-Match outranks If-Modified-Since."""
    failed = F.when(if_match.isNotNull(), ~etag_matches(if_match, etag, False)).otherwise(F.coalesce(modified_s > http_seconds(if_unmodified), F.lit(False)))
    same = F.when(if_none_match.isNotNull(), etag_matches(if_none_match, etag, True)).otherwise(F.coalesce(modified_s <= http_seconds(if_modified), F.lit(False)))
    return F.when(failed, "failed").when(same, "not_modified").otherwise("ok")


def percent_decoded(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def deleted(objects: DataFrame, keys: DataFrame) -> DataFrame:
    return objects.join(keys.select("key"), "key", "left_anti")


def copied(objects: DataFrame, copies: DataFrame, at_ms: int) -> DataFrame:
    """objects with copies(source, target); a target that is there is replaced."""
    new = copies.join(objects, copies.source == objects.key).select(F.col("target").alias("key"), "size", "etag", F.lit(at_ms).cast("long").alias("modified_at_ms"))
    return objects.join(new.select("key"), "key", "left_anti").unionByName(new)


def parts_page(parts: DataFrame, upload: str, after: int, limit: int) -> DataFrame:
    """parts(upload, number, size, etag) of an upload after a part number; of a number sent twice the last counts."""
    own = parts.filter((F.col("upload") == upload) & (F.col("number") > after))
    return own.groupBy("number").agg(F.max_by(F.struct("size", "etag"), "sent").alias("p")).orderBy("number").limit(limit).select("number", "p.size", "p.etag")


#: Least size of a part that is not the last, and the largest part number.
MIN_PART, MAX_PARTS = 5 << 20, 10_000


def copy_source(header: Column) -> Column:
    """struct(status, bucket, key) of a copy-source header: ok, unsupported (a version is asked for) or invalid."""
    text = F.regexp_replace(header, "^/", "")
    at = F.instr(text, "/")

    def plain(part: Column) -> Column:
        tokens = F.regexp_extract_all(part, F.lit("(?s)%[0-9A-Fa-f]{2}|[^%]+"), F.lit(0))
        return F.unhex(F.array_join(F.transform(tokens, lambda t: F.when(t.startswith("%"), F.substring(t, 2, 2)).otherwise(F.hex(t))), ""))

    bucket, key = plain(F.substring(text, F.lit(1), at - 1)), plain(F.substring(text, at + 1, F.length(text)))
    fits = F.octet_length(bucket).between(1, 63) & F.octet_length(key).between(1, 1024) & ~F.contains(bucket, F.lit(b"/")) & ~F.contains(bucket, F.lit(b"\0")) & ~F.contains(key, F.lit(b"\0"))
    status = F.when(header.contains("?"), "unsupported").when(text.rlike("%(?![0-9A-Fa-f]{2})") | (at == 0), "invalid").when(fits, "ok").otherwise("invalid")
    ok = status == "ok"
    return F.struct(F.coalesce(status, F.lit("invalid")).alias("status"), F.when(ok, bucket).alias("bucket"), F.when(ok, key).alias("key"))


def part_range(header: Column, length: Column) -> Column:
    """struct(start, end) of the range of a part copy, end exclusive; null unless both ends are given, within a source of
    over MIN_PART bytes."""
    first, last = (F.regexp_extract(header, r"^bytes=(\d+)-(\d+)$", k).try_cast("long") for k in (1, 2))
    return F.when((length > MIN_PART) & (first <= last) & (last < length), F.struct(first.alias("start"), (last + 1).alias("end")))


def newest_parts(parts: DataFrame) -> DataFrame:
    """parts(upload, number, size, etag, sent): of a number that was sent twice the last counts."""
    return parts.groupBy("upload", "number").agg(F.max_by(F.struct("size", "etag"), "sent").alias("p")).select("upload", "number", "p.size", "p.etag")


def completed(parts: DataFrame, chosen: DataFrame, min_part: int = MIN_PART) -> DataFrame:
    """(upload, problem, size, etag) of each upload to complete with the parts chosen(upload, place, number, etag): they must be
    there with that tag, in rising numbers, and only the last may be under min_part bytes. An upload has at most MAX_PARTS
    parts, which bounds its list."""
    there = newest_parts(parts).select("upload", "number", "size", F.col("etag").alias("_e"))
    rows = chosen.join(there, ["upload", "number"], "left").withColumn("ok", F.coalesce(F.col("_e") == F.col("etag"), F.lit(False)))
    found = rows.groupBy("upload").agg(F.sort_array(F.collect_list(F.struct("place", "number", "size", "_e"))).alias("c"), F.bool_and("ok").alias("ok"))
    c = F.col("c")
    numbers = F.transform(c, lambda x: x["number"])
    rising = F.forall(F.sequence(F.lit(1), F.size(c)), lambda i: (i == F.size(c)) | (F.get(numbers, i - 1) < F.get(numbers, i)))
    small = F.exists(F.sequence(F.lit(1), F.size(c)), lambda i: (i < F.size(c)) & (F.get(c, i - 1)["size"] < min_part))
    problem = F.when(~F.col("ok"), "part").when(~rising, "order").when(small, "size").when((F.size(c) > MAX_PARTS) | (F.array_max(numbers) > MAX_PARTS) | (F.array_min(numbers) < 1), "number")
    size = F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["size"])
    good = problem.isNull()
    return found.select("upload", problem.alias("problem"), F.when(good, size).alias("size"), F.when(good, multipart_etag(F.transform(c, lambda x: x["_e"]))).alias("etag"))


def uploads_page(uploads: DataFrame, *, prefix: bytes = b"", after: tuple[bytes, str] | None = None, limit: int = 1000) -> DataFrame:
    """uploads(key, upload) in order of both, after a key and an upload of it, or after all of a key (upload '')."""
    rows = uploads.filter(has_prefix(F.col("key"), prefix)) if prefix else uploads
    if after is not None:
        key, upload = F.lit(after[0]), after[1]
        rows = rows.filter((F.col("key") > key) | ((F.col("key") == key) & (F.col("upload") > F.lit(upload)) & F.lit(bool(upload))))
    return rows.orderBy("key", "upload").limit(limit)
