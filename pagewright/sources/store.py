"""A store of crawls whose readers see whole commits only.

    data/<table>/batch=<id>/    rows of a staged batch, with site_id and crawl_id
    versions/<number>/          the manifest of a version: site_id, crawl_id, finished_at, batch
    staged/<id>/                manifests that are being written

A batch is written first; nothing names it, so a writer that is lost leaves no trace but files that vacuum() removes. A commit
writes the next manifest aside and renames its folder to the next number, which fails if that number is there: of two writers
one gets it, and the other starts again from what that one left. The rename has to be atomic, as on HDFS or a local disk. A
manifest is a table, not a file on the driver, as it has a row for each crawl that is kept.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "site_id long, crawl_id long, finished_at timestamp, batch string"
_KEY = ["site_id", "crawl_id"]


class Conflict(RuntimeError):
    """Another writer has committed since the version that this one built upon."""


def newest(crawls: DataFrame, most: int) -> DataFrame:
    """The newest crawls of each site; among those that finished together the one of the larger id (limits before the shuffle)."""
    place = F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc_nulls_last("finished_at"), F.desc("crawl_id")))
    return crawls.withColumn("place", place).where(F.col("place") <= most).drop("place")


class CrawlStore:
    """Tables of crawls under one folder; most crawls of a site are kept."""

    def __init__(self, spark: SparkSession, folder: str, most: int = 2) -> None:
        self.spark, self.folder, self.most = spark, folder.rstrip("/"), most
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def _names(self, folder: str) -> list[tuple[str, float]]:
        """Names under a folder with the seconds of their last change."""
        path = self._path(f"{self.folder}/{folder}")
        held = self._fs.listStatus(path) if self._fs.exists(path) else []
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in held]

    def version(self) -> int:
        """The number of the last commit; 0 if there is none."""
        return max((int(n) for n, _ in self._names("versions") if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/versions/{v:012d}") if v else self.spark.createDataFrame([], MANIFEST)

    def stage(self, tables: dict[str, DataFrame]) -> str:
        """Writes tables (each with site_id and crawl_id) as a batch that no reader sees yet, and gives its name."""
        batch = uuid.uuid4().hex
        for name, rows in tables.items():
            rows.write.parquet(f"{self.folder}/data/{name}/batch={batch}")
        return batch

    def commit(self, batch: str, crawls: DataFrame, base: int | None = None, tries: int = 20) -> int:
        """Makes crawls (site_id, crawl_id, finished_at) of a batch seen, all at once, and gives the new version.

        A crawl that is there already is replaced; of each site the newest are kept. With base it is a Conflict if another commit
        has followed that version; without, the commit is built anew upon what has come meanwhile.
        """
        new = crawls.select("site_id", "crawl_id", "finished_at", F.lit(batch).alias("batch")).dropDuplicates(_KEY)
        return self._next(lambda old: newest(old.join(new, _KEY, "left_anti").unionByName(new), self.most), base, tries)

    def remove(self, crawls: DataFrame, base: int | None = None, tries: int = 20) -> int:
        """Takes crawls (site_id, crawl_id) out of what is seen."""
        return self._next(lambda old: old.join(crawls, _KEY, "left_anti"), base, tries)

    def _next(self, change: Callable[[DataFrame], DataFrame], base: int | None, tries: int) -> int:
        for _ in range(tries):
            v = self.version()
            if base is not None and v != base:
                raise Conflict(f"version {v} has followed {base}")
            aside, there = f"{self.folder}/staged/{uuid.uuid4().hex}", f"{self.folder}/versions/{v + 1:012d}"
            change(self.manifest(v)).write.parquet(aside)
            self._fs.mkdirs(self._path(f"{self.folder}/versions"))
            try:
                self._files.rename(self._path(aside), self._path(there), self._no_overwrite)
                return v + 1
            except Py4JJavaError as e:
                if not self._fs.exists(self._path(there)):
                    raise
                self._fs.delete(self._path(aside), True)
                if base is not None:
                    raise Conflict(f"version {v + 1} has followed {base}") from e
        raise Conflict(f"no version was free in {tries} tries")

    def read(self, table: str, schema: str, version: int | None = None) -> DataFrame:
        """Rows of a table that a version's manifest names; batches that it does not name are pruned as partitions."""
        kept = self.manifest(version).select(*_KEY, "batch")
        if not self._fs.exists(self._path(f"{self.folder}/data/{table}")):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, batch string").parquet(f"{self.folder}/data/{table}")
        return rows.join(kept, [*_KEY, "batch"], "left_semi").drop("batch")

    def vacuum(self, versions: int = 2, grace_seconds: float = 86_400) -> list[str]:
        """Removes all but the last versions, and batches and manifests aside that none of those names and that are older than the
        grace, which has to be longer than any write takes. Gives the names of the batches that went."""
        before, last = time.time() - grace_seconds, self.version()
        kept = range(max(1, last - versions + 1), last + 1)
        named = set()
        for v in kept:  # as many names as batches
            named |= {r.batch for r in self.manifest(v).select("batch").distinct().toLocalIterator()}
        gone = set()
        for table, _ in self._names("data"):
            for name, changed in self._names(f"data/{table}"):
                if name.removeprefix("batch=") not in named and changed < before:
                    self._fs.delete(self._path(f"{self.folder}/data/{table}/{name}"), True)
                    gone.add(name.removeprefix("batch="))
        for name, _ in self._names("versions"):
            if name.isdigit() and int(name) < kept.start:
                self._fs.delete(self._path(f"{self.folder}/versions/{name}"), True)
        for name, changed in self._names("staged"):
            if changed < before:
                self._fs.delete(self._path(f"{self.folder}/staged/{name}"), True)
        return sorted(gone)
