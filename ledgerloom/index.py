"""The inverted index of an ingested history: a fragment per batch, sealed pages, open buckets, and repair after a crash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import postings

STREAMS = {"logs": postings.log_streams, "txs": postings.tx_streams, "traces": postings.trace_streams}
IDS = {"logs": "log_id", "txs": "tx_id", "traces": "trace_id"}
SCHEMA = "kind string, value string, bucket long, bits binary, first_id long, last_id long, count long"


class PostingIndex:
    """Postings beside the rows of a history.

    A batch leaves its postings, written before its head is published: those of buckets that lie inside
    the batch go to a folder of whole buckets, where they stay for good, those of the buckets at its ends
    to a fragment.  A bucket of ids is sealed once the published ids have gone beyond it: its fragments
    are then joined to one page each.  Pages lie in folders named by the buckets they hold and count once
    they are complete, so readers see a bucket either by its page or by its fragments, whatever a crash
    has left.
    """

    def __init__(self, spark: SparkSession, root: str, bucket: int = postings.BUCKET):
        self.spark, self.root, self.bucket = spark, root.rstrip("/"), bucket
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        """Names of the folders in a folder; a few for each batch or sealing, none where it isn't there."""
        at = self._path(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at) if x.isDirectory()) if self.fs.exists(at) else []

    def _complete(self, folder: str) -> bool:
        return self.fs.exists(self._path(f"{folder}/_SUCCESS"))

    def _delete(self, folder: str) -> None:
        self.fs.delete(self._path(folder), True)

    def add(self, family: str, rows: DataFrame, batch: str) -> None:
        """The postings of one batch, whole buckets and fragments; a retry overwrites them."""
        at = F.col(IDS[family])
        ends = rows.agg(F.min(at), F.max(at)).first()
        first, stop = (-(-ends[0] // self.bucket), (ends[1] + 1) // self.bucket) if ends[0] is not None else (0, 0)
        inside = (at >= first * self.bucket) & (at < stop * self.bucket)
        for folder, own in (("whole", rows.where(inside)), ("index", rows.where(~inside))):
            made = postings.build(STREAMS[family](postings.dealt(own, IDS[family], self.bucket)), self.bucket)
            self._write(made, f"{self.root}/{family}_{folder}/{batch}")

    def _write(self, made: DataFrame, folder: str) -> None:
        """Postings with their bits trimmed; each file is sorted by kind, value and bucket."""
        made = made.withColumn("bits", postings.trimmed(self.bucket)).select(*[F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in SCHEMA.split(", ")])
        made.sortWithinPartitions("kind", "value", "bucket").write.mode("overwrite").option("compression", "zstd").parquet(folder)

    def sealed(self, family: str) -> int:
        """Buckets below this one have pages; pages follow each other without a hole."""
        end = 0
        for name in self._names(f"{self.root}/{family}_pages"):
            start, stop = map(int, name.split("-"))
            if start == end and self._complete(f"{self.root}/{family}_pages/{name}"):
                end = stop
        return end

    def _fragments(self, family: str, head: int, kind: str = "index") -> DataFrame:
        folder = f"{self.root}/{family}_{kind}"
        kept = [f"{folder}/{n}" for n in self._names(folder) if int(n.split("=")[1]) <= head]
        return self.spark.read.schema(SCHEMA).parquet(*kept) if kept else self.spark.createDataFrame([], SCHEMA)

    def seal(self, family: str, head: int, next_id: int) -> list[int]:
        """Pages for the buckets that ``next_id`` has gone beyond; the starts of the ids sealed now."""
        start, stop = self.sealed(family), next_id // self.bucket
        if stop <= start:
            return []
        own = self._fragments(family, head).where((F.col("bucket") >= start) & (F.col("bucket") < stop))
        self._write(postings.compact(own, self.bucket), f"{self.root}/{family}_pages/{start:012d}-{stop:012d}")
        return [b * self.bucket for b in range(start, stop)]

    def open_buckets(self, family: str, head: int) -> DataFrame:
        """(bucket, fragments, entries) of the buckets without a page yet."""
        rows = self._fragments(family, head).union(self._fragments(family, head, "whole")).where(F.col("bucket") >= self.sealed(family))
        return rows.groupBy("bucket").agg(F.count("*").alias("fragments"), F.sum("count").alias("entries"))

    def read(self, family: str, head: int) -> DataFrame:
        """(kind, value, bucket, bits, first_id, last_id, count): whole buckets, pages of sealed ones, fragments of open ones joined."""
        end, folder = self.sealed(family), f"{self.root}/{family}_pages"
        pages = [f"{folder}/{n}" for n in self._names(folder) if int(n.split("-")[1]) <= end and self._complete(f"{folder}/{n}")]
        parts = [postings.compact(self._fragments(family, head).where(F.col("bucket") >= end), self.bucket).select(*[c.split(" ")[0] for c in SCHEMA.split(", ")])]
        stored = [self._fragments(family, head, "whole")] + ([self.spark.read.schema(SCHEMA).parquet(*pages)] if pages else [])
        parts += [x.withColumn("bits", postings.whole(self.bucket)) for x in stored]
        return reduce(DataFrame.unionByName, parts)

    def recover(self, head: int, next_ids: dict[str, int], id_tables: dict[str, DataFrame]) -> dict:
        """Takes away what crashes left beyond the head and half-written pages, rebuilds lost fragments, seals what is due.

        ``id_tables``: the published rows of each family, with their ids and ``batch``.
        """
        out = {"removed_batches": 0, "removed_pages": 0, "rebuilt_fragments": 0, "sealed": 0}
        for table in self._names(self.root):
            for name in self._names(f"{self.root}/{table}"):
                if name.startswith("batch=") and int(name.split("=")[1]) > head:
                    self._delete(f"{self.root}/{table}/{name}")
                    out["removed_batches"] += 1
        for family in STREAMS:
            folder = f"{self.root}/{family}_pages"
            for name in self._names(folder):
                if not self._complete(f"{folder}/{name}"):
                    self._delete(f"{folder}/{name}")
                    out["removed_pages"] += 1
            for name in self._names(f"{self.root}/{family}"):
                if not all(self._complete(f"{self.root}/{family}_{kind}/{name}") for kind in ("index", "whole")):
                    self.add(family, id_tables[family].where(F.col("batch").cast("long") == int(name.split("=")[1])), name)
                    out["rebuilt_fragments"] += 1
            out["sealed"] += len(self.seal(family, head, next_ids.get(family, 0)))
        return out
