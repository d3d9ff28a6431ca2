"""Crawl results arriving in micro-batches, merged into versioned snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlquarry.operators import transitions
from crawlquarry.sources import stores


class PageStore:
    """Page snapshots under a folder, in buckets by key hash; readers see whole versions only.

    A version is a small manifest that names, for each bucket, the version that wrote it last. A merge reads and
    rewrites only the buckets its results fall into, so a micro-batch costs what it touches; more buckets make them smaller.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        """Versions whose manifest is whole."""
        fs, path = self._fs()
        root = path(f"{self.path}/manifest")
        if not fs.exists(root):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(root)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(path(f"{self.path}/manifest/{n}/_SUCCESS")))

    def manifest(self, version: int) -> dict[int, int]:
        """Bucket -> version that wrote it; one row a bucket."""
        return {r[0]: r[1] for r in self.spark.read.parquet(f"{self.path}/manifest/v={version}").select("bucket", "version").collect()}

    def _read(self, manifest: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(manifest.items())]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        """The latest whole version."""
        found = self.versions()
        return self._read(self.manifest(found[-1])) if found else None

    def merge(self, results: DataFrame, batch: int) -> None:
        """Version ``batch``: the version before it, with results merged in. Running a batch again gives the same version."""
        before = [v for v in self.versions() if v < batch]
        manifest = self.manifest(before[-1]) if before else {}
        ok = results.where(F.col("error").isNull() | (F.col("error") == "")).drop("error") if "error" in results.columns else results
        ok = ok.where(F.col("url_hash").isNotNull())
        number = F.pmod(F.xxhash64("url_hash"), F.lit(self.buckets)).cast("int")
        touched = sorted(r[0] for r in ok.select(number.alias("b")).distinct().collect())  # at most one a bucket
        old = self._read({b: v for b, v in manifest.items() if b in touched})
        merged = stores.upsert_pages(ok.limit(0) if old is None else old, ok)
        if touched:
            merged.withColumn("bucket", number).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={batch}")
        manifest |= {b: batch for b in touched}
        self.spark.createDataFrame(sorted(manifest.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={batch}")


def maintain(stream: DataFrame, store: PageStore, checkpoint: str):
    """A query that merges a stream of results into ``store``."""
    return stream.writeStream.foreachBatch(lambda df, n: store.merge(df, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class CrawlPipeline:
    """Fetched pages through parsing, finalising and publishing, a micro-batch at a time.

    * parse: links come out of each page's HTML where no outlinks are given;
    * finalise: the batch's pages go into the page store, its links become tasks, merged by URL;
    * publish: the pages are written as JSON lines without their bodies.

    Everything a batch writes lies under its number and is overwritten as a whole, so a batch that runs again leaves
    one copy. The source bounds a batch (``maxFilesPerTrigger``), the trigger sets the longest wait.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self.store = PageStore(spark, f"{self.path}/pages", buckets)

    def parse(self, fetched: DataFrame) -> DataFrame:
        """``fetched`` with the outlinks of its HTML (column ``content``) where it has none of its own; failed fetches keep none."""
        from crawlquarry.functions import html

        # Rows of a micro-batch are one a page, so its key tells them apart.
        links = html.outlinks(html.anchor_rows(fetched.where(F.col("outlinks").isNull() & F.col("error").isNull()), html="content")).withColumnRenamed("outlinks", "found")
        return fetched.join(links, "url_hash", "left").withColumn("outlinks", F.coalesce("outlinks", "found")).drop("found")

    def process(self, fetched: DataFrame, batch: int) -> None:
        one = fetched.where(F.col("url_hash").isNotNull()).dropDuplicates(["url_hash", "crawled_at"])
        parsed = one.join(self.parse(frontier_latest(one)).select("url_hash", F.col("outlinks").alias("parsed")), "url_hash", "left").withColumn("outlinks", F.coalesce("outlinks", "parsed")).drop("parsed").persist()
        try:
            self.store.merge(parsed.drop("content"), batch)
            good = parsed.where(F.col("error").isNull())
            links = good.select("url_hash", F.col("url").alias("source_url"), "crawled_at", F.posexplode(F.coalesce("outlinks", F.array().cast("array<string>"))).alias("i", "url"))
            tasks = links.select(F.concat_ws(":", "url_hash", F.lpad(F.col("i").cast("string"), 6, "0")).alias("seq"), "url", F.lit(0.8).alias("value"), "source_url", F.col("crawled_at").alias("added_at"), F.col("crawled_at").alias("next_fetch_at"), F.lit("explore").alias("intent"))
            transitions.prepare_tasks(tasks).write.mode("overwrite").parquet(f"{self.path}/tasks/batch={batch}")
            stores.results_as_json(good, drop=("content",)).withColumnRenamed("json", "value").write.mode("overwrite").text(f"{self.path}/out/batch={batch}")
        finally:
            parsed.unpersist()

    def run(self, stream: DataFrame, checkpoint: str, **trigger):
        """The streaming query; by default it takes what is there in bounded batches and ends."""
        return stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def tasks(self) -> DataFrame:
        """All tasks so far, merged over the batches."""
        rows = self.spark.read.parquet(f"{self.path}/tasks")
        return transitions.prepare_tasks(rows.withColumn("seq", F.concat_ws(":", F.lpad(F.col("batch").cast("string"), 12, "0"), "source_url")))


def frontier_latest(rows: DataFrame) -> DataFrame:
    """The latest crawl of each page of a batch."""
    from crawlquarry.operators import frontier

    return frontier.latest(rows, "url_hash", [F.col("crawled_at"), F.coalesce("content", F.lit(""))])
