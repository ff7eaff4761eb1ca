"""A durable store of runs: immutable sorted Parquet, published by manifests that follow one another.

A commit writes its run first, under a name that no other writer uses, then a manifest holding the whole live set with its
own checksum. The manifest of number n + 1 is written aside and renamed into place, which fails if it is there already: of
writers that started from the same manifest one wins and the others get Conflict and have published nothing. Then the pointer
moves in one rename. A crash between the two leaves a whole manifest behind the pointer; the next open goes on to it. What
a crash leaves behind before that is unreferenced and ignored until ``vacuum``. Sequence numbers are given out when a
commit is published and never reused. The unit of durability is a commit, not a row. Files go through Hadoop's file
systems, so any store that Spark reaches will do.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.recovery import replay
from tidemark.operators.resolve import as_of, get, multi_get, newest
from tidemark.operators.scan import key_range
from tidemark.plans.history import MAX_SEQ, numbered

SCHEMA = "k string, seq long, kind int, v string"
COMPARATOR = "bytewise: key ascending, sequence descending"


class Refused(Exception):
    """The store is damaged or was made by other rules."""


class Conflict(Exception):
    """Another writer has published since this store was opened."""


class Closed(Exception):
    pass


@dataclass
class Run:
    number: int
    level: int
    rows: int
    smallest: str | None
    largest: str | None
    name: str = ""


@dataclass
class Manifest:
    number: int = 1
    next_file: int = 2
    last_seq: int = 0
    #: Reads as of an earlier sequence number are refused: compaction has removed versions that they would see.
    oldest: int = 0
    #: Logs below this number are in runs already.
    log_number: int = 0
    comparator: str = COMPARATOR
    runs: list[Run] = field(default_factory=list)

    def encode(self) -> str:
        body = json.dumps(asdict(self), sort_keys=True)
        return json.dumps({"sha256": hashlib.sha256(body.encode()).hexdigest(), "body": body})

    @staticmethod
    def decode(text: str) -> Manifest:
        try:
            outer = json.loads(text)
            if hashlib.sha256(outer["body"].encode()).hexdigest() != outer["sha256"]:
                raise Refused("manifest checksum")
            body = json.loads(outer["body"])
            own = Manifest(**body | {"runs": [Run(**r) for r in body["runs"]]})
        except (ValueError, KeyError, TypeError) as e:  # an unknown field is refused too
            raise Refused(f"manifest can't be read: {e}") from e
        if own.comparator != COMPARATOR:
            raise Refused("another comparator")
        return own


class Store:
    """Open or create the store at path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.closed = spark, path.rstrip("/"), False
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)
        if self._fs.exists(self._at("CURRENT")):
            number = named = self._current()
            while self._fs.exists(self._at(f"MANIFEST-{number + 1:06d}")):  # published, but the pointer wasn't moved
                number += 1
            if not self._fs.exists(self._at(f"MANIFEST-{number:06d}")):
                raise Refused(f"MANIFEST-{number:06d} is missing")
            self.manifest = Manifest.decode(self._read(f"MANIFEST-{number:06d}"))
            if number != named:
                self._point(number)
        else:
            self.manifest = Manifest()
            self._publish(self.manifest)

    def _current(self) -> int:
        name = self._read("CURRENT").strip()
        if not name.startswith("MANIFEST-") or not name[9:].isdigit():
            raise Refused("CURRENT names no manifest")
        return int(name[9:])

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        stream = self._fs.create(self._at(name), True)
        stream.write(bytearray(text.encode()))
        stream.hsync()
        stream.close()

    def _rename(self, draft: str, name: str, overwrite: bool) -> None:
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds = self._jvm.org.apache.hadoop.fs.Options.Rename
        options[0] = kinds.OVERWRITE if overwrite else kinds.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        context.rename(context.makeQualified(self._at(draft)), context.makeQualified(self._at(name)), options)

    def _point(self, number: int) -> None:
        draft = f"CURRENT.{uuid.uuid4().hex}.tmp"
        self._write(draft, f"MANIFEST-{number:06d}\n")
        self._rename(draft, "CURRENT", True)

    def _publish(self, manifest: Manifest) -> None:
        name, draft = f"MANIFEST-{manifest.number:06d}", f"MANIFEST.{uuid.uuid4().hex}.tmp"
        if manifest.number > 1 and self._current() > self.manifest.number:
            raise Conflict(f"{name} isn't the next one any more")
        self._write(draft, manifest.encode())
        try:
            self._rename(draft, name, False)
        except Py4JJavaError as e:
            self._fs.delete(self._at(draft), False)
            if self._fs.exists(self._at(name)):
                raise Conflict(f"{name} was published by another writer") from e
            raise
        self._point(manifest.number)
        self.manifest = manifest

    def _next(self, runs: list[Run], files: int, last_seq: int, **changed: int) -> Manifest:
        return replace(self.manifest, number=self.manifest.number + 1, next_file=self.manifest.next_file + files, last_seq=last_seq, runs=runs, **changed)

    def _open(self) -> None:
        if self.closed:
            raise Closed(self.path)

    def _write_run(self, rows: DataFrame, number: int, level: int) -> Run:
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        ordered = rows.repartitionByRange(parts, "k").sortWithinPartitions(F.col("k"), F.col("seq").desc())
        name = f"{number:06d}-{uuid.uuid4().hex[:12]}.run"
        to = f"{self.path}/{name}"
        ordered.write.option("parquet.page.write-checksum.enabled", "true").option("parquet.bloom.filter.enabled#k", "true").parquet(to)
        n, low, high = self.spark.read.schema(SCHEMA).parquet(to).agg(F.count(F.lit(1)), F.min("k"), F.max("k")).first()
        return Run(number, level, n, low, high, name)

    def write(self, batch: DataFrame) -> int:
        """Apply one batch (i, kind, k, v) as a whole, later entries over earlier ones; the new last sequence number.
        An empty batch changes nothing."""
        self._open()
        base = self.manifest.last_seq + 1
        rows = numbered(batch.select("i", "kind", "k", F.when(F.col("kind") == 1, F.coalesce("v", F.lit(""))).alias("v")), base)
        run = self._write_run(rows.select("k", "seq", F.col("kind").cast("int"), "v"), self.manifest.next_file, 0)
        if not run.rows:
            return self.manifest.last_seq
        if base + run.rows - 1 > MAX_SEQ:
            raise Refused("no sequence numbers left")
        self._publish(self._next([*self.manifest.runs, run], 1, base + run.rows - 1))
        return self.manifest.last_seq

    def put(self, key: str, value: str) -> int:
        return self.write(self.spark.createDataFrame([(0, 1, key, value)], "i long, kind int, k string, v string"))

    def delete(self, key: str) -> int:
        return self.write(self.spark.createDataFrame([(0, 0, key, None)], "i long, kind int, k string, v string"))

    def history(self, key: str | None = None) -> DataFrame:
        """All versions, as of the manifest now; with a key, of runs whose bounds hold it."""
        self._open()
        runs = [r for r in self.manifest.runs if key is None or r.smallest <= key <= r.largest]
        paths = [f"{self.path}/{r.name}" for r in runs]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("parquet.page.verify-checksum.enabled", "true").parquet(*paths)

    def _readable(self, at: int | None) -> None:
        if at is not None and at < self.manifest.oldest:
            raise Refused(f"versions before {self.manifest.oldest} are gone")

    def get(self, key: str, at: int | None = None) -> str | None:
        self._readable(at)
        found = get(self.history(key), key, at).select("v").first()
        return None if found is None else found[0]

    def multi_get(self, keys: DataFrame, at: int | None = None) -> DataFrame:
        self._readable(at)
        return multi_get(keys, self.history(), at)

    def as_of(self, asked: DataFrame) -> DataFrame:
        """asked (k, at) with seq, v and found, each row at a snapshot of its own."""
        first = asked.agg(F.min("at")).first()[0]
        self._readable(first)
        return as_of(asked, self.history())

    def scan(self, low: str | None = None, high: str | None = None, at: int | None = None) -> DataFrame:
        """Live rows with low <= k < high; a bound that is None is open."""
        self._readable(at)
        return key_range(self.history(), low, high, at)

    def recover(self, logs: DataFrame) -> int:
        """Replay logs (number, content) from the first that no run covers on, and publish what they hold as one run; the new last
        sequence number. Doing it again changes nothing."""
        self._open()
        found = replay(logs.where(F.col("number") >= self.manifest.log_number)).where(F.col("seq") > self.manifest.last_seq)
        numbers = logs.agg(F.max("number")).first()[0]
        return self.add_run(found.select("k", "seq", "kind", "v"), max(self.manifest.log_number, (numbers or 0) + 1))

    def add_run(self, rows: DataFrame, log_number: int) -> int:
        """Publish rows (SCHEMA) that have their sequence numbers as a run, and that logs before log_number are in runs; the new
        last sequence number. No rows change nothing."""
        self._open()
        run = self._write_run(rows, self.manifest.next_file, 0)
        if run.rows:
            last = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{run.name}").agg(F.max("seq")).first()[0]
            self._publish(self._next([*self.manifest.runs, run], 1, last, log_number=log_number))
        return self.manifest.last_seq

    def compact(self, oldest: int | None = None) -> None:
        """All runs into one at level 1. Reads as of ``oldest`` (the last sequence number if None) and later stay as they are: of
        versions up to it the newest of each key stays, unless it is a tombstone, and all later ones. Earlier reads are refused from then on."""
        self._open()
        floor = max(self.manifest.oldest, self.manifest.last_seq if oldest is None else min(oldest, self.manifest.last_seq))
        rows = self.history()
        kept = newest(rows, floor).where("kind = 1").unionByName(rows.where(F.col("seq") > floor))
        run = self._write_run(kept.select("k", "seq", "kind", "v"), self.manifest.next_file, 1)
        self._publish(self._next([run] if run.rows else [], 1, self.manifest.last_seq, oldest=floor))

    def vacuum(self) -> list[str]:
        """Remove what no one refers to: runs, manifests and the pointer's draft; their names."""
        self._open()
        keep = {"CURRENT", f"MANIFEST-{self.manifest.number:06d}", *(r.name for r in self.manifest.runs)}
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(""))]
        old_logs = [n for n in names if n.endswith(".log") and n[:-4].isdigit() and int(n[:-4]) < self.manifest.log_number]
        known = old_logs + [n for n in names if n.startswith("MANIFEST-") or n.endswith((".run", ".tmp"))]
        gone = sorted(n for n in known if n not in keep)
        for n in gone:
            self._fs.delete(self._at(n), True)
        return gone

    def close(self) -> None:
        self.closed = True
