"""A versioned table on a file system: writes, snapshots, scans, compaction.

Every batch of writes is flushed as one table of level 0; compaction moves
tables down.  A table is one Parquet file, sorted by key and newest first.  Which
tables make up a version is a small Parquet table of metadata, written anew for
every version together with the next number, the last sequence number and the
compaction pointers, so none of these is ever used twice.  Readers pin a version,
so nothing they read disappears under them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .errors import NotFound, ReadOnly, Released
from .operators import read, scan, write
from .options import Options
from .plans import compaction, layout
from .plans.compaction import File

META = "version_id long, level int, num long, size long, entries long, imin_k string, imax_k string, next_num long, last_seq long, pointers map<int,string>"
ENTRY = "ukey string, seq long, kind byte, value double"


@dataclass(frozen=True)
class State:
    """A version: its files and numbers."""

    files: tuple[File, ...] = ()
    entries: dict[int, int] = field(default_factory=dict)
    next_num: int = 1
    last_seq: int = 0
    pointers: dict[int, str] = field(default_factory=dict)


class Snapshot:
    """What a read saw when the snapshot was taken, until it is released."""

    def __init__(self, store: Store, version: int, seq: int):
        self.store, self.version, self._seq, self.released = store, version, seq, False

    @property
    def seq(self) -> int:
        if self.released:
            raise Released(f"snapshot {self._seq}")
        return self._seq

    def scan(self, keys: scan.Range = scan.Range()) -> DataFrame:
        return self.store.scan(keys, seq=self.seq)

    def release(self) -> None:
        if not self.released:
            self.released = True
            self.store.pins[self._seq] -= 1


class Store:
    """One writer at a time, which a lock file sees to; any number of readers."""

    def __init__(self, spark: SparkSession, path: str, options: Options = Options()):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options
        self.fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        #: Sequence numbers that snapshots hold, with the number of these.
        self.pins: Counter[int] = Counter()

    # Versions

    def versions(self) -> list[int]:
        root = self.fs_path(f"{self.path}/versions")
        if not self.fs.exists(root):
            return []
        names = (s.getPath().getName() for s in self.fs.listStatus(root))
        found = [n for n in names if n.startswith("v") and self.fs.exists(self.fs_path(f"{self.path}/versions/{n}/_SUCCESS"))]
        return sorted(int(n[1:]) for n in found)

    def _version(self, version: int | None) -> DataFrame | None:
        have = self.versions()
        if version is None:
            if not have:
                return None
            version = have[-1]
        if version not in have:
            raise NotFound(f"version {version}")
        return self.spark.read.schema(META).parquet(f"{self.path}/versions/v{version}")

    def meta(self, version: int | None = None) -> DataFrame:
        """``version_id, level, num, size, entries, imin_k, imax_k`` of the files of a version."""
        found = self._version(version)
        found = self.spark.createDataFrame([], META) if found is None else found
        return found.where("level is not null").drop("next_num", "last_seq", "pointers")

    def state(self, version: int | None = None) -> State:
        found = self._version(version)
        if found is None:
            return State()
        rows = found.collect()
        own = next(r for r in rows if r.level is None)
        files = [r for r in rows if r.level is not None]
        return State(
            tuple(File(r.level, r.num, r.size, r.imin_k, r.imax_k) for r in files), {r.num: r.entries for r in files}, own.next_num, own.last_seq, dict(own.pointers),
        )

    def _publish(self, state: State) -> int:
        """The version becomes visible with its _SUCCESS mark, all at once."""
        version = (self.versions() or [0])[-1] + 1
        rows = [(version, f.level, f.num, f.size, state.entries[f.num], f.low, f.high, None, None, None) for f in state.files]
        rows.append((version, None, None, None, None, None, None, state.next_num, state.last_seq, state.pointers))
        self.spark.createDataFrame(rows, META).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/v{version}")
        return version

    @contextmanager
    def _writing(self) -> Iterator[None]:
        lock = self.fs_path(f"{self.path}/LOCK")
        try:
            self.fs.create(lock, False).close()
        except Exception as e:
            raise ReadOnly(f"{self.path} is locked") from e
        try:
            yield
        finally:
            self.fs.delete(lock, False)

    # Writes

    def _flush(self, entries: DataFrame, level: int, state: State, tables: int = 1, cuts: list[str] = ()) -> State:
        """Write disjoint tables of consecutive key ranges; their numbers are new."""
        number = F.lit(state.next_num) + F.spark_partition_id() * (len(cuts) + 1)
        # Behind a cut a table begins anew: a key at a cut still belongs before it.
        passed = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("ukey"))) if cuts else F.lit(0)
        parts = entries.select("ukey", "seq", "kind", "value").repartitionByRange(tables, "ukey").withColumn("num", (number + passed).cast("long"))
        root = f"{self.path}/tables"
        sorted_ = parts.sortWithinPartitions("num", "ukey", F.desc("seq"), F.desc("kind"))
        sorted_.write.mode("append").partitionBy("num").parquet(root)
        made = [n for n in range(state.next_num, state.next_num + tables * (len(cuts) + 1)) if self.fs.exists(self.fs_path(f"{root}/num={n}"))]
        rows = []
        if made:
            rows = self._read(made).groupBy("num").agg(F.count("*").alias("n"), F.min("ukey").alias("low"), F.max("ukey").alias("high"), F.max("_metadata.file_size").alias("size")).collect()
        files = tuple(File(level, r.num, r.size, r.low, r.high) for r in sorted(rows, key=lambda r: r.num))
        return replace(state, files=state.files + files, entries=state.entries | {r.num: r.n for r in rows}, next_num=state.next_num + tables * (len(cuts) + 1))

    def _read(self, nums: list[int]) -> DataFrame:
        root = f"{self.path}/tables"
        return self.spark.read.schema(f"{ENTRY}, num long").option("basePath", root).parquet(*[f"{root}/num={n}" for n in nums])

    def write(self, batch: DataFrame, order: str | None = None) -> int:
        """Append ``ukey, value, kind`` (1 live, 0 deleted) as one batch, seen whole or
        not at all.  Returns the new version.

        With ``order``, a column of numbers from 0 on, each row gets a sequence number
        of its own, and of a key given twice the later row counts.  Without, all of it
        gets one, and one row of a key is kept, a live one before a deleted one.
        """
        with self._writing():
            state = self.state()
            first = state.last_seq + 1
            seq = F.lit(first).cast("long") if order is None else (F.lit(first) + F.col(order)).cast("long")
            rows = batch.select("ukey", seq.alias("seq"), F.col("kind").cast("byte").alias("kind"), F.col("value").cast("double").alias("value"))
            best = Window.partitionBy("ukey", "seq").orderBy(F.desc("kind"), F.desc("value"))
            once = rows.withColumn("_n", F.row_number().over(best)).where("_n = 1")
            last = first if order is None else first + (batch.agg(F.max(order)).first()[0] or 0)
            return self._publish(replace(self._flush(once, 0, state), last_seq=last))

    def delete(self, keys: DataFrame) -> int:
        return self.write(keys.select("ukey", F.lit(None).cast("double").alias("value"), F.lit(0).alias("kind")))

    # Reads

    def snapshot(self) -> Snapshot:
        """Pin what is visible now; compaction keeps it until it is released."""
        have = self.versions()
        seq = self.state().last_seq
        self.pins[seq] += 1
        return Snapshot(self, have[-1] if have else 0, seq)

    def log(self, version: int | None = None, keys: scan.Range = scan.Range()) -> DataFrame:
        """Entries of the files that can hold keys of the range."""
        files = scan.prune_files(self.meta(version), keys).select("level", "num").collect()
        out = self.spark.createDataFrame([], f"level int, file_num long, {ENTRY}")
        for level in sorted({f.level for f in files}):
            # One scan a level; the folder of a file tells its number.
            rows = self._read([f.num for f in files if f.level == level])
            out = out.unionByName(rows.select(F.lit(level).alias("level"), F.col("num").alias("file_num"), "ukey", "seq", "kind", "value"))
        return scan.in_range(out, keys)

    def scan(self, keys: scan.Range = scan.Range(), version: int | None = None, seq: int | None = None) -> DataFrame:
        return read.scan_latest(self.log(version, keys), seq).select("ukey", "seq", "value")

    def get(self, key: str, version: int | None = None, seq: int | None = None) -> DataFrame:
        return self.scan(scan.Range(key, key + "\0"), version, seq)

    # Maintenance

    def exhausted(self, probes: DataFrame, version: int | None = None) -> int | None:
        """The file to compact because of the seeks in ``probes`` (keys read, with
        repeats): the first one that a read has to pass too often."""
        meta = self.meta(version)
        walked = read.files_for_keys(meta, probes.withColumn("_probe", F.monotonically_increasing_id()).select(F.col("ukey"), "_probe"), ["_probe"])
        used = layout.seek_exhausted(meta, walked.withColumnsRenamed({"ukey": "_key", "_probe": "ukey"}), self.options)
        found = layout.seek_nominee(used).first()
        return found.num if found else None

    def compact(self, level: int | None = None, low: str | None = None, high: str | None = None, exhausted: int | None = None) -> int | None:
        """Compact what the scores or seeks ask for, or a range of a given level; None
        if nothing has to be done."""
        with self._writing():
            state = self.state()
            files = list(state.files)
            if level is None:
                plan = compaction.pick(files, self.options, state.pointers, exhausted)
            else:
                plan = compaction.plan(files, level, compaction.in_range(files, level, low, high, self.options), self.options)
            if plan is None:
                return None
            pointers = state.pointers | {plan.level: plan.pointer}
            if plan.is_move(self.options) and not plan.bottom:
                moved = tuple(replace(f, level=f.level + 1) if f.num in plan.nums else f for f in files)
                return self._publish(replace(state, files=moved, pointers=pointers))
            chosen = self.log().where(F.col("file_num").isin(list(plan.nums)))
            pins = [seq for seq, n in self.pins.items() if n > 0]
            merged = write.compact(chosen, chosen.select("file_num"), plan.bottom, pins)
            tables = max(1, -(-plan.bytes // self.options.table_limit(plan.level + 1)))
            rest = replace(state, files=tuple(f for f in files if f.num not in plan.nums), pointers=pointers)
            return self._publish(self._flush(merged, plan.level + 1, rest, tables, plan.cuts))

    def collect_garbage(self, pinned: list[int] = ()) -> list[int]:
        """Remove versions but the newest and the pinned ones, and tables that no
        remaining version holds."""
        with self._writing():
            have = self.versions()
            keep = {*have[-1:], *pinned}
            held = {f.num for v in keep for f in self.state(v).files}
            for v in have:
                if v not in keep:
                    self.fs.delete(self.fs_path(f"{self.path}/versions/v{v}"), True)
            gone = []
            for s in self.fs.listStatus(self.fs_path(f"{self.path}/tables")):
                name = s.getPath().getName()
                if name.startswith("num=") and int(name[4:]) not in held:
                    self.fs.delete(s.getPath(), True)
                    gone.append(int(name[4:]))
            return sorted(gone)
