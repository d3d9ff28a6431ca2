"""Reading and writing of pages, seeds, runtime payloads and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SchemaError(ValueError):
    """A relation is missing or lacks columns."""


def require_columns(df: DataFrame, name: str, columns: set[str]) -> DataFrame:
    """``df``, or SchemaError naming the columns it lacks."""
    missing = sorted(columns - set(df.columns))
    if missing:
        raise SchemaError(f"{name} lacks columns: {', '.join(missing)}")
    return df


def renamed(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Old column names as their new ones, where only the old are there."""
    for old, new in renames.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def list_pages(pages: DataFrame, since: float = 0.0, limit: int = 100, offset: int = 0, host: str | None = None) -> DataFrame:
    """Pages crawled strictly after ``since``, oldest first, ties by key."""
    p = pages.where(F.col("crawled_at") > since)
    if host is not None:
        p = p.where(F.col("host") == host.lower())
    return p.orderBy("crawled_at", "url_hash").offset(offset).limit(limit)


def with_bodies(pages: DataFrame, bodies: DataFrame) -> DataFrame:
    """Pages with ``content``: the stored body, '' where none is stored."""
    b = bodies.select("url_hash", F.col("content").cast("string").alias("body"))
    stored = F.coalesce("stored_content_bytes", F.lit(0)) > 0
    return pages.join(b, "url_hash", "left").withColumn("content", F.when(stored, F.coalesce("body", F.lit(""))).otherwise("")).drop("body")


def upsert_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """Snapshot after saving ``new``: the latest crawl of each page wins, but its first url, host and created_at stay.

    Results with an error aren't saved. The first values are the least by (created_at, crawled_at, url,
    host), so the snapshot is the same in whatever batches the crawls arrive.
    """
    from crawlquarry.operators import frontier

    if "error" in new.columns:
        new = new.where(F.col("error").isNull() | (F.col("error") == "")).drop("error")
    both = old.drop("error").unionByName(new)
    kept = F.struct("created_at", "crawled_at", "url", "host")
    first = both.where(F.col("url_hash").isNotNull()).groupBy("url_hash").agg(F.min(kept).alias("f"))
    latest = frontier.pages(both).join(first, "url_hash")
    return latest.withColumns({"url": F.col("f.url"), "host": F.lower("f.host"), "created_at": F.col("f.created_at")}).drop("f")


def put_bodies(bodies: DataFrame, incoming: DataFrame) -> DataFrame:
    """Bodies after a save: those that come with bytes replace the stored one, the others delete it.

    ``incoming`` (url_hash, content, updated_at); the latest row of a key counts.
    """
    last = incoming.where(F.col("url_hash").isNotNull()).groupBy("url_hash").agg(F.max_by(F.struct("content", "updated_at"), F.struct("updated_at", F.coalesce("content", F.lit("")))).alias("r")).select("url_hash", "r.*")
    return without_bodies(bodies, last).select("url_hash", "content", "updated_at").unionByName(last.where(F.length("content") > 0))


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(key, content, updated_at) of bodies stored one file a key; the key is the file's name without its suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^/.]*)?$", 1).alias("url_hash"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").cast("double").alias("updated_at"))


def without_bodies(bodies: DataFrame, gone: DataFrame) -> DataFrame:
    """Bodies that stay when the keys of ``gone`` are deleted."""
    return bodies.join(gone.select("url_hash"), "url_hash", "left_anti")


def results_as_json(results: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """(json): one JSON document a row, chosen columns left out."""
    return results.drop(*drop).select(F.to_json(F.struct("*")).alias("json"))


def write_jsonl(results: DataFrame, path: str, include_content: bool = False) -> None:
    """One JSON document a line under ``path``."""
    (results if include_content else results.drop("content")).write.mode("overwrite").json(path)


def write_document(rows: DataFrame, path: str) -> None:
    """A result as one JSON document, an array of its rows in one file; meant for reports of a few rows."""
    rows.agg(F.to_json(F.collect_list(F.struct(*sorted(rows.columns)))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def migrate(spark: SparkSession, ledger: str, steps: dict[str, object]) -> list[str]:
    """Run the steps, in order of their names, that the table at ``ledger`` doesn't list yet; gives the names run.

    Each step is a function of the session. It is recorded once it's done, so one that failed runs again, and those before it don't.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(ledger)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    done = {r[0] for r in spark.read.parquet(ledger).select("name").collect()} if there else set()
    ran = []
    for name in sorted(steps):
        if name not in done:
            steps[name](spark)
            spark.createDataFrame([(name,)], "name string").withColumn("applied_at", F.current_timestamp()).write.mode("append").parquet(ledger)
            ran.append(name)
    return ran


class ObservationLog:
    """Observations as JSON lines with sorted keys, in numbered files; full files are closed and the oldest dropped.

    Each append is one file of its own under the shared folder, so no line is half written; a file number is a
    directory, which is full at ``max_bytes``.
    """

    def __init__(self, spark: SparkSession, path: str, max_bytes: int = 10_000_000, keep: int = 5):
        if max_bytes <= 0 or keep <= 0:
            raise ValueError("max_bytes and keep must be positive")
        self.spark, self.path, self.max_bytes, self.keep = spark, path.rstrip("/"), max_bytes, keep

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def numbers(self) -> list[int]:
        fs, path = self._fs()
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path(self.path))) if fs.exists(path(self.path)) else []

    def append(self, rows: DataFrame) -> None:
        fs, path = self._fs()
        numbers = self.numbers()
        now = numbers[-1] if numbers else 0
        if numbers and fs.getContentSummary(path(f"{self.path}/{now}")).getLength() >= self.max_bytes:
            now += 1
        results_as_json(rows.select(*sorted(rows.columns))).withColumnRenamed("json", "value").coalesce(1).write.mode("append").text(f"{self.path}/{now}")
        for old in self.numbers()[: -self.keep]:
            fs.delete(path(f"{self.path}/{old}"), True)

    def read(self) -> DataFrame:
        """(value): all lines kept."""
        return self.spark.read.option("recursiveFileLookup", "true").text(self.path)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(position, url, enabled, tags, notes) of a seed catalogue, in file order; ``enabled`` defaults to true."""
    schema = "seeds array<struct<url:string,enabled:boolean,tags:array<string>,notes:string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("seeds").alias("position", "s")).select("position", "s.*").withColumn("enabled", F.coalesce("enabled", F.lit(True)))


def enabled_seeds(seeds: DataFrame) -> DataFrame:
    return seeds.where(F.coalesce("enabled", F.lit(True)))


def latest_payloads(rows: DataFrame) -> DataFrame:
    """The latest payload of each component (component, payload, updated_at, seq)."""
    return rows.groupBy("component").agg(F.max_by(F.struct("payload", "updated_at"), F.struct("updated_at", "seq")).alias("r")).select("component", "r.*")


def relation_sizes(spark: SparkSession, d: str, names: tuple[str, ...]) -> DataFrame:
    """(name, bytes, rows) of the relations that exist, largest first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in names:
        p = jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            out.append((name, fs.getContentSummary(p).getLength(), spark.read.parquet(f"{d}/{name}.parquet").count()))
    return spark.createDataFrame(sorted(out, key=lambda r: (-r[1], r[0])), "name string, bytes long, rows long")
