"""Lines repeated across the pages of one host, found with compressed bitmaps.

Every page of a host gets a small ordinal inside one of the host's *containers*
(about ``CONTAINER_PAGES`` pages each, by hash of the page's key), so that a
line's pages are a set of (container, offset). A set is kept as a sorted offset
array while it is sparse and as a bitmap once it is dense. Lines that differ only in
case, blanks or digits are variants: their sets are built one by one and then
united. A united set whose exact cardinality reaches the thresholds marks the line,
and deletion is a look-up of each page's bit.

Containers double as salt: no key ever gathers more than one container of a
host, however large the host.

Defined results: null content, null host, pages without content and hosts below ``min_pages``
pages give no rows; blank lines and lines with under four letters never count;
repeated rows of a page count once (the latest content wins); extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crawlquarry.session import materialize

CONTAINER_PAGES = 16384
DENSE_FROM = 2048
FOUR_LETTERS = r"\p{L}[^\p{L}]*\p{L}[^\p{L}]*\p{L}[^\p{L}]*\p{L}"


def page_hosts(pages: DataFrame) -> DataFrame:
    """(url_hash, host): each page once, host in lower case."""
    return (
        pages.where(F.col("url_hash").isNotNull() & F.col("host").isNotNull())
        .groupBy("url_hash")
        .agg(F.min(F.lower("host")).alias("host"))
    )


def page_texts(content: DataFrame) -> DataFrame:
    """(url_hash, content): each page once, the latest content of repeated rows."""
    return (
        content.where(F.col("url_hash").isNotNull() & F.col("content").isNotNull())
        .groupBy("url_hash")
        .agg(F.max_by("content", F.struct("updated_at", "content")).alias("content"))
    )


def line_key(line):
    """What two lines must share to be the same line."""
    return F.translate(F.lower(line), " \t0123456789", "")


def page_ordinals(pages: DataFrame, content: DataFrame, container_pages: int = CONTAINER_PAGES) -> DataFrame:
    """(url_hash, host, n_pages, n_containers, container, offset) of each page with content."""
    present = content.where(F.col("content").isNotNull()).select("url_hash").distinct()
    docs = page_hosts(pages).join(present, "url_hash", "left_semi")
    per_host = docs.groupBy("host").agg(F.count("*").alias("n_pages"))
    per_host = per_host.withColumn("n_containers", F.ceil(F.col("n_pages") / container_pages).cast("int"))
    docs = docs.join(per_host, "host").withColumn("container", F.pmod(F.xxhash64("url_hash"), F.col("n_containers")).cast("int"))
    by = Window.partitionBy("host", "container").orderBy("url_hash")
    return docs.withColumn("offset", F.row_number().over(by) - 1)


def host_lines(pages: DataFrame, content: DataFrame, container_pages: int = CONTAINER_PAGES) -> DataFrame:
    """One row for each line that can count, with its variant and the key that unites variants."""
    docs = page_ordinals(pages, content, container_pages)
    lines = docs.join(page_texts(content), "url_hash").select(
        "url_hash", "host", "n_pages", "n_containers", "container", "offset", F.posexplode(F.split("content", "\n")).alias("line_no", "line")
    )
    key = line_key(F.col("line"))
    return lines.withColumn("k", key).where(F.col("k").rlike(FOUR_LETTERS)).select(
        "url_hash", "host", "n_pages", "n_containers", "container", "offset", F.col("line_no").cast("long").alias("line_no"),
        F.unhex(F.md5("k")).alias("line_key"), F.xxhash64("line").alias("variant"),
    )


def repeated_line_sets(lines: DataFrame, min_pages: int = 5, min_share_percent: int = 10, dense_from: int = DENSE_FROM) -> DataFrame:
    """(host, line_key, container, offsets, bitmap): the page sets of lines repeated beyond the thresholds."""
    # A line's rows bound its pages from above: what fails here can't pass the exact test below.
    reach = F.greatest(F.lit(min_pages), F.ceil(F.col("n_pages") * min_share_percent / F.lit(100)))
    maybe = (
        lines.groupBy("host", "line_key")
        .agg(F.count("*").alias("rows"), F.first("n_pages").alias("n_pages"), F.first("n_containers").alias("n_containers"))
        .where((F.col("rows") >= min_pages) & (F.col("rows") * 100 >= F.col("n_pages") * min_share_percent))
        .select("host", "line_key", (F.col("rows") > dense_from * F.col("n_containers")).alias("dense"), F.explode(F.sequence(F.lit(0), F.col("n_containers") - 1)).alias("container"))
    )
    # Joined by container too, so that a line on every page of a huge host is spread.
    lines = lines.join(maybe, ["host", "line_key", "container"])
    group = ["host", "line_key", "container"]
    sparse = (
        lines.where(~F.col("dense"))
        .groupBy(*group, "n_pages", "variant").agg(F.collect_set("offset").alias("offsets"))
        .groupBy(*group, "n_pages").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("offsets")))).alias("offsets"))
        .select(*group, "n_pages", "offsets", F.lit(None).cast("binary").alias("bitmap"), F.lit(0).cast("long").alias("bucket"), F.size("offsets").cast("long").alias("n"))
    )
    dense = (
        lines.where("dense").withColumn("at", F.col("offset").cast("long") + 1).withColumn("bucket", F.bitmap_bucket_number("at"))
        .groupBy(*group, "n_pages", "bucket", "variant").agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
        .groupBy(*group, "n_pages", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        .select(*group, "n_pages", F.lit(None).cast("array<int>").alias("offsets"), "bitmap", "bucket", F.bitmap_count("bitmap").alias("n"))
    )
    sets = sparse.unionByName(dense)
    counted = (
        sets.groupBy("host", "line_key").agg(F.sum("n").alias("docs"), F.first("n_pages").alias("n_pages"))
        .where((F.col("docs") >= min_pages) & (F.col("docs") >= reach))
        .select("host", "line_key", "docs")
    )
    return sets.join(counted, ["host", "line_key"])


def repeated_lines(
    pages: DataFrame, content: DataFrame, min_pages: int = 5, min_share_percent: int = 10, container_pages: int = CONTAINER_PAGES, dense_from: int = DENSE_FROM
) -> DataFrame:
    """(url_hash, line_no, docs): the lines to remove and on how many of the host's pages each occurs."""
    lines = materialize(host_lines(pages, content, container_pages), "lines")
    sets = repeated_line_sets(lines, min_pages, min_share_percent, dense_from).select("host", "line_key", "container", "bucket", "offsets", "bitmap", "docs")
    hit = lines.join(sets, ["host", "line_key", "container"])
    at = F.col("offset").cast("long") + 1
    byte = F.conv(F.hex(F.expr("substring(bitmap, cast(bitmap_bit_position(cast(offset as bigint) + 1) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    in_bitmap = (F.bitmap_bucket_number(at) == F.col("bucket")) & (F.expr("shiftleft(1, cast(bitmap_bit_position(cast(offset as bigint) + 1) % 8 as int))").bitwiseAND(byte) != 0)
    present = F.when(F.col("bitmap").isNull(), F.array_contains("offsets", F.col("offset"))).otherwise(in_bitmap)
    return hit.where(present).select("url_hash", "line_no", "docs")


def without_repeated_lines(pages: DataFrame, content: DataFrame, min_pages: int = 5, min_share_percent: int = 10) -> DataFrame:
    """(url_hash, content, removed): each page with its repeated lines deleted; every page with content comes out."""
    gone = repeated_lines(pages, content, min_pages, min_share_percent).groupBy("url_hash").agg(F.collect_set("line_no").alias("gone"))
    texts = page_texts(content).join(gone, "url_hash", "left")
    kept = F.expr("filter(transform(split(content, '\\n'), (x, i) -> struct(x as line, cast(i as bigint) as i)), s -> not array_contains(gone, s.i)).line")
    return texts.select(
        "url_hash",
        F.when(F.col("gone").isNull(), F.col("content")).otherwise(F.array_join(kept, "\n")).alias("content"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("removed"),
    )
