"""Ingest of hash-linked batches with an atomically published head, and the lease that guards it."""

from __future__ import annotations

import json
import os
import threading
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import (
    CasConflict,
    FinalityViolation,
    InvalidParams,
    InvalidParent,
    InvalidSequence,
    LeaseLost,
    LeaseObservationUnavailable,
    LeaseStillFresh,
)
from .functions import has_value, is_call, trace_selector
from .index import PostingIndex
from .operators.ids import block_windows, placed_ids
from .operators.postings import BUCKET
from .operators.stats import with_previous
from .scratch import release

ZEROS = "0" * 64
ORDERS = {"txs": ("tx_idx", "tx_id"), "logs": ("log_idx", "log_id"), "traces": (("tx_idx", "trace_idx"), "trace_id")}


@dataclass(frozen=True)
class Publication:
    head: int = 0
    head_hash: str = ZEROS
    next_ids: tuple[tuple[str, int], ...] = (("logs", 0), ("traces", 0), ("txs", 0))
    owner: str | None = None
    session: str | None = None
    lease_end: int = 0
    version: int = 0


class PublicationStore:
    """One versioned record; of writers that saw the same version, one wins.

    Each version is a file created exclusively, so a file system that creates names atomically is enough.
    """

    def __init__(self, path: str):
        self.path = path
        os.makedirs(path, exist_ok=True)

    def load(self) -> Publication | None:
        versions = [int(n.split(".")[0]) for n in os.listdir(self.path) if n.endswith(".json")]
        if not versions:
            return None
        with open(f"{self.path}/{max(versions):020d}.json") as f:
            raw = json.load(f)
        return Publication(**raw | {"next_ids": tuple((k, v) for k, v in raw["next_ids"])})

    def compare_and_set(self, expected: int, new: Publication) -> Publication:
        now = self.load()
        if (now.version if now else 0) != expected:
            raise CasConflict(f"version {now.version if now else 0} is not {expected}")
        new = replace(new, version=expected + 1)
        own = f"{self.path}/.{uuid.uuid4().hex}"
        with open(own, "w") as f:
            json.dump(asdict(new), f)
        try:
            os.link(own, f"{self.path}/{new.version:020d}.json")  # fails where another writer was first
        except FileExistsError:
            raise CasConflict(f"version {new.version} is there already") from None
        finally:
            os.unlink(own)
        return new


class MemoryPublicationStore:
    """The same record in the driver's memory: every version stays, for tests and for histories that nobody else reads."""

    def __init__(self):
        self.versions: list[Publication] = []
        self._lock = threading.Lock()

    def load(self) -> Publication | None:
        return self.versions[-1] if self.versions else None

    def compare_and_set(self, expected: int, new: Publication) -> Publication:
        with self._lock:
            if len(self.versions) != expected:
                raise CasConflict(f"version {len(self.versions)} is not {expected}")
            self.versions.append(replace(new, version=expected + 1))
            return self.versions[-1]


class HadoopPublicationStore:
    """The same record on any Hadoop file system: a version is renamed into place, which fails where it exists.

    HDFS renames atomically; an object store must offer conditional writes instead.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self.fs = self._jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._jvm.Path(path))

    def load(self) -> Publication | None:
        names = [x.getPath().getName() for x in self.fs.listStatus(self._jvm.Path(self.path))]
        names = [n for n in names if n.endswith(".json") and not n.startswith(".")]
        if not names:
            return None
        raw = json.loads(self.spark.read.text(f"{self.path}/{max(names)}", wholetext=True).first()[0])
        return Publication(**raw | {"next_ids": tuple((k, v) for k, v in raw["next_ids"])})

    def compare_and_set(self, expected: int, new: Publication) -> Publication:
        now = self.load()
        if (now.version if now else 0) != expected:
            raise CasConflict(f"version {now.version if now else 0} is not {expected}")
        new = replace(new, version=expected + 1)
        own, name = (self.fs.makeQualified(self._jvm.Path(f"{self.path}/{n}")) for n in (f".{uuid.uuid4().hex}", f"{new.version:020d}.json"))
        out = self.fs.create(own, False)
        out.write(bytearray(json.dumps(asdict(new)).encode()))
        out.close()
        jvm = self.spark._jvm
        context = self._jvm.FileContext.getFileContext(name.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(own, name, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))  # never over what is there
        except Py4JJavaError:
            self.fs.delete(own, False)
            raise CasConflict(f"version {new.version} is there already") from None
        return new


class LeaseAuthority:
    """Right to write, measured in observed upstream blocks: valid through observed + lease - 1."""

    def __init__(self, store: PublicationStore, owner: str, observe: Callable[[], int | None], lease_blocks: int = 10, renew_threshold: int = 2):
        if lease_blocks <= 0 or renew_threshold >= lease_blocks:
            raise InvalidParams("the lease must be positive and longer than its renewal threshold")
        self.store, self.owner, self.observe, self.lease, self.threshold = store, owner, observe, lease_blocks, renew_threshold
        self.session, self.held = uuid.uuid4().hex, None

    def _observed(self) -> int:
        n = self.observe()
        if n is None:
            raise LeaseObservationUnavailable("no upstream block was observed")
        return n

    def begin_write(self) -> tuple[Publication, str]:
        """(state, fresh | continuous | reacquired): takes, keeps or renews the lease."""
        seen, now = self._observed(), self.store.load()
        ours = now is not None and now.owner == self.owner and now.session == self.session
        if self.held is not None and not ours:
            self.held = None
            raise LeaseLost("another session has taken over")
        if ours and self.held is not None and seen <= now.lease_end:
            if now.lease_end - seen + 1 <= self.threshold:
                now = self._take(now, seen)
            self.held = now.version
            return now, "continuous"
        if now is not None and now.owner not in (None, self.owner) and seen <= now.lease_end:
            raise LeaseStillFresh(f"{now.owner} holds the lease through block {now.lease_end}")
        fresh = now is None or now.owner is None
        now = self._take(now or Publication(), seen)
        return now, "fresh" if fresh else "reacquired"

    def _take(self, now: Publication, seen: int) -> Publication:
        out = self.store.compare_and_set(now.version, replace(now, owner=self.owner, session=self.session, lease_end=seen + self.lease - 1))
        self.held = out.version
        return out

    def publish(self, before: Publication, head: int, head_hash: str, next_ids: dict[str, int]) -> Publication:
        now = self.store.load()
        if now is None or (now.owner, now.session) != (self.owner, self.session):
            raise LeaseLost("another session has taken over")
        if self._observed() > now.lease_end:
            raise LeaseLost("the lease ran out before the head was published")
        if head <= now.head:
            raise FinalityViolation(f"head {head} is not beyond {now.head}")
        out = self.store.compare_and_set(before.version, replace(now, head=head, head_hash=head_hash, next_ids=tuple(sorted(next_ids.items()))))
        self.held = out.version
        return out


class Ingestor:
    """Appends batches as Parquet, one folder each, and publishes the head last.

    A batch is written to a folder named by its block range: a retry of an unpublished batch overwrites
    it, and readers, who filter by the head, never see what a crash left.  Postings go the same way, and
    the buckets of ids that a published batch has filled are sealed behind it.
    """

    def __init__(self, spark: SparkSession, root: str, authority: LeaseAuthority, bucket: int = BUCKET):
        self.spark, self.root, self.authority = spark, root.rstrip("/"), authority
        self.index = PostingIndex(spark, self.root, bucket)

    def _validate(self, blocks: DataFrame, state: Publication) -> tuple[int, int, str, str]:
        linked = with_previous(blocks, "block_num", "block_num", "block_hash")
        bad = F.col("_prev_block_num").isNotNull()
        found = linked.agg(
            F.count("*").alias("n"), F.min("block_num").alias("low"), F.max("block_num").alias("high"), F.max_by("block_hash", "block_num").alias("hash"), F.min_by("parent_hash", "block_num").alias("parent"),
            F.sum((bad & (F.col("block_num") != F.col("_prev_block_num") + 1)).cast("int")).alias("holes"), F.sum((bad & (F.col("parent_hash") != F.col("_prev_block_hash"))).cast("int")).alias("unlinked"),
        ).first()
        if not found["n"]:
            raise InvalidParams("an ingest needs at least one block")
        if found["low"] != state.head + 1 or found["holes"] or found["n"] != found["high"] - found["low"] + 1:
            raise InvalidSequence(f"blocks must follow {state.head} one by one")
        if found["parent"] != state.head_hash or found["unlinked"]:
            raise InvalidParent("a parent hash is not the hash of the block before")
        return found["low"], found["high"], found["hash"], found["parent"]

    def _validate_items(self, batch: dict[str, DataFrame]) -> None:
        for family, place in (("txs", "tx_idx"), ("logs", "log_idx")):
            wrong = batch[family].groupBy("block_num").agg(F.count("*").alias("n"), F.min(place).alias("low"), F.max(place).alias("high"), F.count_distinct(place).alias("kinds"))
            if wrong.where("low <> 0 or high <> n - 1 or kinds <> n").limit(1).count():
                raise InvalidParams(f"{place} must count from 0 in each block")
            if batch[family].join(batch["blocks"], "block_num", "left_anti").limit(1).count():
                raise InvalidParams(f"{family} name a block outside the batch")

    def ingest(self, batch: dict[str, DataFrame]) -> dict:
        """{head, written_logs, written_txs, written_traces}; ``batch`` has blocks, txs, logs and traces."""
        state, _ = self.authority.begin_write()
        low, high, digest, _ = self._validate(batch["blocks"], state)
        self._validate_items(batch)
        ids, out = dict(state.next_ids), {"head": high}
        folder = f"batch={low:020d}"
        release(self.spark)
        self._write(batch["blocks"], f"blocks/{folder}")
        for family, (order, id_col) in ORDERS.items():
            rows = batch[family]
            if family == "traces":
                rows = rows.withColumns({"is_top_level": F.col("depth") == 0, "has_value": has_value(F.col("value_hex")), "is_call": is_call(F.col("typ"), F.col("flags"))})
                if "input" in rows.columns:
                    rows = rows.withColumn("selector", trace_selector(F.col("typ"), F.col("flags"), F.length("input"), F.lower(F.hex(F.substring("input", 1, 4)))))
            self._write(block_windows(rows, batch["blocks"], ids[family]), f"{family}_windows/{folder}")
            windows = self.spark.read.parquet(f"{self.root}/{family}_windows/{folder}")
            # rows sorted by id, so that a range of blocks touches few row groups
            self._write(placed_ids(rows, windows, order, id_col, high - low + 1), f"{family}/{folder}")
            release(self.spark)  # the rows dealt out, before their postings are
            self.index.add(family, self.spark.read.parquet(f"{self.root}/{family}/{folder}"), folder)
            n = windows.agg(F.sum("count")).first()[0]
            out[f"written_{family}"], ids[family] = n, ids[family] + n
            release(self.spark)
        self.authority.publish(state, high, digest, ids)
        for family in ORDERS:
            self.index.seal(family, high, ids[family])
            release(self.spark)
        return out

    def _write(self, rows: DataFrame, folder: str) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{folder}")

    def recover(self) -> dict:
        """What the last crash left, made good: the rows and postings of unpublished batches go, due pages are sealed."""
        now = self.authority.store.load() or Publication()
        rows = {f: self.spark.read.parquet(f"{self.root}/{f}").where(F.col("batch").cast("long") <= now.head) for f in ORDERS} if now.head else {}
        return self.index.recover(now.head, dict(now.next_ids), rows)

    def postings(self, family: str) -> DataFrame:
        """The index of a family up to the published head."""
        return self.index.read(family, (self.authority.store.load() or Publication()).head)

    def tables(self) -> dict[str, DataFrame]:
        """All folders of each table, at most those up to the head: unpublished ones lie beyond it."""
        names = ["blocks", *ORDERS, *[f"{f}_windows" for f in ORDERS]]
        head = (self.authority.store.load() or Publication()).head
        return {n: self.spark.read.parquet(f"{self.root}/{n}").where(F.col("batch").cast("long") <= head).where(F.col("block_num") <= head).drop("batch") for n in names}

    def compact(self, family: str, target: str, files: int) -> None:
        """One sorted, range-partitioned copy of a family."""
        _, id_col = ORDERS[family]
        self.tables()[family].repartitionByRange(files, id_col).sortWithinPartitions(id_col).write.mode("overwrite").parquet(target)
