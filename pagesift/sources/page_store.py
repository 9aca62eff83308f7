"""A pages table that is changed by small layers and merged when read.

Every layer is a folder bucketed and sorted by URL, one file a bucket: a base, deltas with whole page
rows, and deltas with vectors only. On read the newest row of a URL wins, and a vector is taken if it
was computed from the very crawl that the row holds and written after it. All layers have the same number
of buckets, so they are joined where they lie: an upsert of one row in a hundred writes about a hundredth of
the bytes, and stored text never goes through an exchange. ``compact`` rewrites the given buckets
into a new layer; the others keep their files.

What is live is told by a version, a small file that lists the layers with their buckets. It is written after
the layer that it adds, so a job that is killed leaves the version before it in force and at most an unnamed
folder. One writer at a time; a second one that takes the same version number fails, nothing is lost.
Folders below ``layers`` that the versions still in use do not name may be deleted.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagesift.functions.vectors import l2_normalize

BUCKET_BYTES = 256 << 20
"""Stored bytes that make a bucket when a store is created; its number of buckets then stays."""
ROWS, VECTORS = "rows", "vectors"
_VERSION = "layer string, kind string, seq bigint, buckets array<int>, columns string, n_buckets int"
_KEY = "url"


@dataclass(frozen=True)
class Layer:
    folder: str
    kind: str
    seq: int
    buckets: frozenset[int]
    columns: str


def _names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder, in whatever file system it is; empty if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []


class PageStore:
    """Pages by URL: ``page_id, url, title, description, content, crawled_at, vector, can_be_vectorized``, and any columns more."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.version, rows = self._newest()
        self.n = rows[0]["n_buckets"]
        self.layers = self._sorted(rows)

    @classmethod
    def create(cls, pages: DataFrame, folder: str, buckets: int | None = None) -> PageStore:
        """A new store of ``pages``, one row a URL; the number of buckets follows from the bytes of their texts unless given."""
        spark = pages.sparkSession
        if buckets is None:
            texts = [f.name for f in pages.schema if f.dataType.simpleString() == "string"]
            size = pages.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(64)).cast("bigint"))).first()[0] or 0
            buckets = min(100_000, max(8, -(-size // BUCKET_BYTES)))
        store = cls.__new__(cls)
        store.spark, store.folder, store.version, store.n, store.layers = spark, folder.rstrip("/"), -1, buckets, []
        store._commit([store._write(pages, ROWS, 0)])
        return store

    # --- versions and layers ---

    @staticmethod
    def _sorted(rows: list) -> list[Layer]:
        return sorted((Layer(r[0], r[1], r[2], frozenset(r[3]), r[4]) for r in rows), key=lambda x: x.seq)

    def _newest(self) -> tuple[int, list]:
        for name in reversed(_names(self.spark, f"{self.folder}/versions")):
            if "_SUCCESS" in _names(self.spark, f"{self.folder}/versions/{name}"):
                return int(name), self.spark.read.schema(_VERSION).parquet(f"{self.folder}/versions/{name}").collect()  # one row a layer
        raise FileNotFoundError(f"no page store in {self.folder}")

    def _commit(self, layers: list[Layer]) -> None:
        taken = [int(x) for x in _names(self.spark, f"{self.folder}/versions")]
        version = max([self.version, *taken]) + 1
        full = [x for x in layers if x.buckets]
        if all(x.kind != ROWS for x in full):  # an empty table still has columns
            full.append([x for x in layers if x.kind == ROWS][-1])
        rows = [(x.folder, x.kind, x.seq, sorted(x.buckets), x.columns, self.n) for x in full]
        self.spark.createDataFrame(rows, _VERSION).coalesce(1).write.parquet(f"{self.folder}/versions/{version:012d}")
        self.version, self.layers = version, self._sorted(rows)

    def _write(self, rows: DataFrame, kind: str, seq: int) -> Layer:
        name = f"{seq:012d}-{uuid.uuid4().hex}"
        table = f"page_store_{uuid.uuid4().hex}"
        folder = f"{self.folder}/layers/{name}"
        rows.repartition(self.n, _KEY).write.bucketBy(self.n, _KEY).sortBy(_KEY).option("path", folder).saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # the entry; files stay
        there = {int(m[1]) for m in (re.search(r"_(\d{5,})\.c\d", x) for x in _names(self.spark, folder)) if m}
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return Layer(name, kind, seq, frozenset(there), columns)

    def _scan(self, layer: Layer, only: frozenset[int] | None = None) -> DataFrame:
        """The live buckets of a layer (and of ``only``), as a bucketed scan."""
        wanted = layer.buckets if only is None else layer.buckets & only
        table = f"page_store_{uuid.uuid4().hex}"
        # one file a bucket, which is named in it: others are not even listed
        pattern = "*_{" + ",".join(f"{b:05d}" for b in sorted(wanted)) + "}.c*" if wanted else "none"
        self.spark.sql(
            f"CREATE TABLE {table} ({layer.columns}) USING parquet OPTIONS (path '{self.folder}/layers/{layer.folder}', pathGlobFilter '{pattern}') "
            f"CLUSTERED BY ({_KEY}) SORTED BY ({_KEY}) INTO {self.n} BUCKETS"
        )
        rows = self.spark.table(table)
        rows.schema  # resolved now; the plan holds the files, not the entry
        self.spark.sql(f"DROP TABLE {table}")
        return rows

    def next_seq(self) -> int:
        return max(x.seq for x in self.layers) + 1

    # --- reading ---

    def read(self, only: set[int] | None = None) -> DataFrame:
        """The table as it is now, or some buckets of it."""
        chosen = None if only is None else frozenset(only)
        parts = [rows.drop("_seq") for rows in self._merged(chosen)]
        return reduce(DataFrame.unionByName, parts)

    def _merged(self, only: frozenset[int] | None) -> list[DataFrame]:
        own = [x for x in self.layers if x.kind == ROWS]
        live = [x for x in own if only is None or x.buckets & only] or own[:1]
        over = lambda a, b: a.seq < b.seq and bool(a.buckets & b.buckets & (only if only is not None else a.buckets))
        scans = {x: self._scan(x, only) for x in live}
        newer = [b for b in live if any(over(a, b) for a in live)]
        if newer:
            keys = reduce(DataFrame.unionByName, [scans[x].select(_KEY, F.lit(x.seq).cast("bigint").alias("top")) for x in newer])
            # as many partitions as buckets, so that only these keys move
            top = keys.repartition(self.n, _KEY).groupBy(_KEY).agg(F.max("top").alias("top"))
        parts = []
        for x, rows in scans.items():
            if any(over(x, b) for b in newer):
                rows = rows.join(top.where(F.col("top") > x.seq), _KEY, "left_anti")
            parts.append(self._with_vectors(rows.withColumn("_seq", F.lit(x.seq).cast("bigint")), x, only))
        return parts

    def _with_vectors(self, rows: DataFrame, layer: Layer, only: frozenset[int] | None) -> DataFrame:
        """``rows`` of a layer with the vectors that were computed for them and stored later."""
        later = [x for x in self.layers if x.kind == VECTORS and x.seq > layer.seq and x.buckets & layer.buckets]
        if not later:
            return rows
        stored = [self._scan(x, only).withColumn("_at", F.lit(x.seq).cast("bigint")) for x in later]
        newest = Window.partitionBy(_KEY, "crawled_at").orderBy(F.col("_at").desc())
        filled = reduce(DataFrame.unionByName, stored).repartition(self.n, _KEY).withColumn("_rn", F.row_number().over(newest)).where("_rn = 1")
        filled = filled.select(F.col(_KEY).alias("_url"), F.col("crawled_at").alias("_crawled"), F.col("vector").alias("_vector"), F.col("can_be_vectorized").alias("_can"))
        # the URL alone is the join key, by which all layers are bucketed
        same = (F.col(_KEY) == F.col("_url")) & (F.col("crawled_at") <= F.col("_crawled")) & (F.col("crawled_at") >= F.col("_crawled"))
        joined = rows.join(filled, same, "left")
        kind = rows.schema["vector"].dataType
        return joined.withColumns(
            {
                "vector": F.when(F.col("_url").isNotNull(), F.col("_vector").cast(kind)).otherwise(F.col("vector")),
                "can_be_vectorized": F.coalesce("_can", "can_be_vectorized"),
            }
        ).select(rows.columns)

    # --- changing ---

    def upsert(self, updates: DataFrame, version: str = "version", new_id: Column | None = None) -> int:
        """Overwrite whole rows by URL; returns the store's version.

        Of several updates of one URL the highest ``version`` wins. Pages that are there keep
        their id, others get ``new_id`` (a hash of the URL unless given).
        """
        newest = Window.partitionBy(_KEY).orderBy(F.col(version).desc())
        latest = updates.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn", version, "page_id")
        name = f"{self.folder}/updates/{uuid.uuid4().hex}"
        latest.write.parquet(name)
        latest = self.spark.read.schema(latest.schema).parquet(name)
        asked = latest.select(_KEY).repartition(self.n, _KEY)
        found = [self._scan(x).select(_KEY, "page_id").join(asked, _KEY, "left_semi") for x in self.layers if x.kind == ROWS]
        ids = reduce(DataFrame.unionByName, found).groupBy(_KEY).agg(F.max("page_id").alias("page_id"))  # the same in every layer
        rows = latest.join(ids, _KEY, "left")
        rows = rows.withColumns(
            {
                "page_id": F.coalesce("page_id", new_id if new_id is not None else F.xxhash64(_KEY)),
                "can_be_vectorized": ~F.coalesce(F.size("vector") == 0, F.lit(False)),
                "vector": F.when(F.size("vector") > 0, l2_normalize(F.col("vector"))),
            }
        )
        schema = next(self._scan(x) for x in self.layers if x.kind == ROWS).schema
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
        self._commit([*self.layers, self._write(rows, ROWS, self.next_seq())])
        return self.version

    def write_back(self, embedded: DataFrame) -> int:
        """Store vectors ``(url, crawled_at, vector)`` for the crawls they were computed from; an empty one marks a page as never to be embedded.

        Of several vectors for one crawl the greatest counts. Only vectors are written, no page row.
        """
        new = embedded.groupBy(_KEY, "crawled_at").agg(F.max("vector").alias("vector")).where(F.col("vector").isNotNull())
        full = F.size("vector") > 0
        rows = new.select(_KEY, "crawled_at", F.when(full, l2_normalize(F.col("vector"))).alias("vector"), full.alias("can_be_vectorized"))
        self._commit([*self.layers, self._write(rows, VECTORS, self.next_seq())])
        return self.version

    def crowded(self, layers: int = 4) -> set[int]:
        """Buckets that more than ``layers`` layers hold rows or vectors of."""
        return {b for b in range(self.n) if sum(b in x.buckets for x in self.layers) > layers}

    def compact(self, buckets: set[int] | None = None) -> int:
        """Merge all layers of the given buckets (else of all) into one; the other buckets' files stay as they are."""
        chosen = frozenset(range(self.n)) if buckets is None else frozenset(buckets)
        merged = self._write(self.read(set(chosen)), ROWS, self.next_seq())
        kept = [Layer(x.folder, x.kind, x.seq, x.buckets - chosen, x.columns) for x in self.layers]
        self._commit([*kept, merged])
        return self.version
