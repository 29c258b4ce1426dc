"""A durable versioned key-value store: Parquet files, a version document, and the operators on top.

Layout: ``data/file_id=N`` (Parquet, sorted by key and sequence) and ``CURRENT``,
the version document, which lists the families, the live files with their
levels, ranges and sizes, the pinned snapshots, and the last sequence number.  A write adds its files first and
publishes the document last, by rename, so a failed write leaves nothing behind
but unlisted files, which ``vacuum`` removes.  One writer at a time is assumed,
as in any engine with one log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvstrata.operators import compact as compaction
from kvstrata.operators import picker, read
from kvstrata.operators.write import number_operations
from kvstrata.sources.kv import KV_SCHEMA
from kvstrata.sources.pointer import Pointer
from kvstrata.sources.scratch import durable

DEFAULT_FAMILY = "default"


class Store:
    """Open (or create) the store in a folder."""

    def __init__(self, spark: SparkSession, path: str, codec: str = "zstd", bloom: bool = False):
        self.spark, self.path, self.codec, self.bloom = spark, path.rstrip("/"), codec, bloom
        self._pointer = Pointer(spark, f"{self.path}/CURRENT")
        self._version = self._pointer.read()
        if self._version is None:
            self._version = {"families": {DEFAULT_FAMILY: 0}, "files": [], "snapshots": {}, "last_seq": 0, "next_file": 1}
            self._fs().mkdirs(self._at(self.path))
            self._pointer.publish(self._version)

    def _at(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._at(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    @property
    def last_sequence(self) -> int:
        return self._version["last_seq"]

    @property
    def families(self) -> dict[str, int]:
        return dict(self._version["families"])

    def create_family(self, name: str) -> int:
        """A new family's id; a name that exists is an error."""
        if name in self._version["families"]:
            raise ValueError(f"family {name} exists")
        cf = max(self._version["families"].values()) + 1
        self._publish(families={**self._version["families"], name: cf})
        return cf

    def family(self, name: str) -> int:
        """The id of a family; an unknown name is an error."""
        if name not in self._version["families"]:
            raise ValueError(f"no family {name}")
        return self._version["families"][name]

    def refresh(self) -> None:
        """Take up what another process has published."""
        self._version = self._pointer.read()

    def pinned(self) -> list[int]:
        """Pinned sequence numbers; they are part of the version, so that compactions of any process keep what they see."""
        return sorted(int(s) for s in self._version.get("snapshots", {}))

    def snapshot(self) -> int:
        """Pin the last committed sequence number until it is released."""
        seq, held = str(self.last_sequence), dict(self._version.get("snapshots", {}))
        self._publish(snapshots={**held, seq: held.get(seq, 0) + 1})
        return int(seq)

    def release(self, seq: int) -> None:
        """Unpin it."""
        held = dict(self._version["snapshots"])
        held[str(seq)] -= 1
        self._publish(snapshots={s: n for s, n in held.items() if n})

    def _publish(self, **changes) -> None:
        version = {**self._version, **changes}
        self._pointer.publish(version)
        self._version = version

    def _write_file(self, rows: DataFrame, file_id: int) -> list[dict]:
        folder = f"{self.path}/data/file_id={file_id}"
        writer = rows.select("cf", "key", "seq", "op", "value").repartitionByRange("cf", "key").sortWithinPartitions("cf", "key", F.desc("seq")).write.mode("overwrite").option("compression", self.codec)
        if self.bloom:
            writer = writer.option("parquet.bloom.filter.enabled#key", "true")
        writer.parquet(folder)
        stats = compaction.file_stats(self.spark.read.schema(KV_SCHEMA).parquet(folder), []).first()
        return [self._described(file_id, stats)] if stats.num_entries else []

    def _described(self, file_id: int, stats) -> dict:
        named = {c: stats[c] for c in ("smallest", "largest", "smallest_seq", "largest_seq", "num_entries")}
        return {"file_id": file_id, **named, "file_size": stats.raw_key_bytes + stats.raw_value_bytes}

    def write(self, ops: DataFrame) -> int:
        """Apply batches atomically: rows (batch_id, ordinal, cf, key, op, value).  Returns the new last sequence number.

        Empty keys and unknown families are errors, and nothing is written then."""
        known = list(self._version["families"].values())
        bad = ops.where(F.coalesce(F.length("key") == 0, F.lit(True)) | ~F.coalesce(F.col("cf").isin(known), F.lit(False)) | ~F.coalesce(F.col("op").isin("PUT", "DEL"), F.lit(False)))
        if not bad.isEmpty():
            raise ValueError("a batch holds an empty key, an unknown family or an unknown operation")
        numbered = number_operations(ops, self.last_sequence)
        file_id = self._version["next_file"]
        made = self._write_file(numbered, file_id)
        if made:
            self._publish(files=self._version["files"] + [{**made[0], "level": 0}], next_file=file_id + 1, last_seq=made[0]["largest_seq"])
        return self.last_sequence

    def ingest(self, outside: DataFrame) -> int:
        """Take in a table (cf, key, op, value; one row per key) whose rows all get one new sequence number."""
        rows = outside.select("cf", "key", F.lit(self.last_sequence + 1).cast("long").alias("seq"), "op", "value")
        file_id = self._version["next_file"]
        made = self._write_file(rows, file_id)
        if made:
            self._publish(files=self._version["files"] + [{**made[0], "level": 0}], next_file=file_id + 1, last_seq=self.last_sequence + 1)
        return self.last_sequence

    def versions(self, key: str | None = None, files: list[int] | None = None) -> DataFrame:
        """All stored versions; with a key, only of files whose range holds it."""
        live = [f for f in self._version["files"] if (files is None or f["file_id"] in files) and (key is None or f["smallest"] <= key <= f["largest"])]
        if not live:
            return self.spark.createDataFrame([], KV_SCHEMA)
        return self.spark.read.schema(KV_SCHEMA).parquet(*[f"{self.path}/data/file_id={f['file_id']}" for f in live])

    def get(self, key: str, family: str = DEFAULT_FAMILY, snapshot: int | None = None) -> str | None:
        """The visible value of a key, or None."""
        row = read.point_get(self.versions(key), self.family(family), key, self.last_sequence if snapshot is None else snapshot).first()
        return row.value if row else None

    def multi_get(self, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
        return read.multi_get(self.versions(), keys, self.last_sequence if snapshot is None else snapshot)

    def scan(self, family: str = DEFAULT_FAMILY, snapshot: int | None = None, reverse: bool = False, start: str | None = None, end: str | None = None) -> DataFrame:
        """Live entries of a family in key order."""
        bounds = (F.col("cf") == self.family(family)) & read.key_range(start, end)
        return read.scan(self.versions(), self.last_sequence if snapshot is None else snapshot, reverse, bounds)

    def _pages(self, family: str, n: int, start: str | None, reverse: bool, inclusive: bool, snapshot: int | None) -> DataFrame:
        """The first ``n`` live entries from a place on, from no more files than that takes.

        Files are taken in key order by their stored ranges.  What lies before the next
        file's first key (after its last, in reverse) can be in no other file, so the page
        is complete once it is filled there; each time it is not, twice as many files are taken."""
        key, snapshot = F.col("key"), self.last_sequence if snapshot is None else snapshot
        bounds = F.lit(True) if start is None else ((key <= start if inclusive else key < start) if reverse else (key >= start if inclusive else key > start))
        files = [f for f in self._version["files"] if start is None or (f["smallest"] <= start if reverse else f["largest"] >= start)]
        files.sort(key=lambda f: f["largest"] if reverse else f["smallest"], reverse=reverse)
        taken = 1
        while True:
            rest = files[taken:]
            within = bounds
            if rest:
                within = within & (key > rest[0]["largest"] if reverse else key < rest[0]["smallest"])
            page = read.page(self.versions(files=[f["file_id"] for f in files[:taken]]), self.family(family), n, within, reverse, snapshot)
            if not rest or page.count() >= n:
                return page
            taken *= 2

    def seek(self, target: str, family: str = DEFAULT_FAMILY, reverse: bool = False, snapshot: int | None = None) -> DataFrame:
        """The first live entry at or after a key, or the last one at or before it."""
        return self._pages(family, 1, target, reverse, True, snapshot)

    def first(self, family: str = DEFAULT_FAMILY, n: int = 1, snapshot: int | None = None) -> DataFrame:
        """The first live entries."""
        return self._pages(family, n, None, False, True, snapshot)

    def last(self, family: str = DEFAULT_FAMILY, n: int = 1, snapshot: int | None = None) -> DataFrame:
        """The last live entries."""
        return self._pages(family, n, None, True, True, snapshot)

    def next(self, key: str, family: str = DEFAULT_FAMILY, n: int = 1, snapshot: int | None = None) -> DataFrame:
        """The live entries that follow a key."""
        return self._pages(family, n, key, False, False, snapshot)

    def prev(self, key: str, family: str = DEFAULT_FAMILY, n: int = 1, snapshot: int | None = None) -> DataFrame:
        """The live entries before a key."""
        return self._pages(family, n, key, True, False, snapshot)

    def prefix(self, start: str, family: str = DEFAULT_FAMILY, snapshot: int | None = None) -> DataFrame:
        """Live entries whose key begins so, in key order, from the files whose ranges can hold them."""
        held = [f["file_id"] for f in self._version["files"] if f["largest"] >= start and f["smallest"][: len(start)] <= start]
        bounds = (F.col("cf") == self.family(family)) & F.col("key").startswith(start)
        return read.scan(self.versions(files=held), self.last_sequence if snapshot is None else snapshot, bounds=bounds)

    def compact(self, bottommost: bool = True) -> None:
        """Merge all files into one sorted run of the last level; pinned snapshots stay readable."""
        inputs = self._version["files"]
        if not inputs:
            return
        file_id = self._version["next_file"]
        made = self._write_file(compaction.compact(self.versions(), self.pinned(), bottommost), file_id)
        self._publish(files=[{**f, "level": 6} for f in made], next_file=file_id + 1)

    def _write_files(self, out: DataFrame) -> list[dict]:
        """Write rows with file_no as one file per family and number; their metadata.  The list is part of the version document."""
        stats = compaction.file_stats(out, ["cf", "file_no"]).orderBy("cf", "file_no").collect()
        first = self._version["next_file"]
        named = {first + i: s for i, s in enumerate(stats)}
        for file_id in named:  # what a run that failed left behind
            self._fs().delete(self._at(f"{self.path}/data/file_id={file_id}"), True)
        numbers = self.spark.createDataFrame([(s.cf, s.file_no, i) for i, s in named.items()], "cf int, file_no long, file_id long")
        rows = out.join(numbers.hint("merge"), ["cf", "file_no"]).select("cf", "key", "seq", "op", "value", "file_id")
        writer = rows.repartition("file_id").sortWithinPartitions("file_id", "cf", "key", F.desc("seq")).write.mode("append").option("compression", self.codec)
        if self.bloom:
            writer = writer.option("parquet.bloom.filter.enabled#key", "true")
        writer.partitionBy("file_id").parquet(f"{self.path}/data")
        return [self._described(i, s) for i, s in named.items()]

    def compact_level(self, options: picker.LevelOptions | None = None, target_bytes: int = 64 << 20) -> dict | None:
        """One compaction step: pick the level with the highest score, merge its chosen files with those they meet on the output level, cut the result by bytes.

        Returns the edit that was published ({output_level, deleted, added}: file ids), or None if no level needs one."""
        files = self._version["files"]
        if not files:
            return None
        rows = [("all", f["file_id"], f["level"], f["file_size"], f["smallest"], f["largest"], False) for f in files]
        table = self.spark.createDataFrame(rows, "grp string, file_id long, level int, file_size long, smallest string, largest string, being_compacted boolean")
        picked = durable(picker.pick_level(picker.level_scores(table, "grp", options or picker.LevelOptions()), "grp"))
        inputs = picker.expand_inputs(table, durable(picker.pick_files(table, picked, "grp")), "grp").collect()
        if not inputs:
            return None
        level, ids = inputs[0].output_level, sorted({r.file_id for r in inputs})
        merged = [f for f in files if f["file_id"] in set(ids)]
        lo, hi = min(f["smallest"] for f in merged), max(f["largest"] for f in merged)
        kept = [f for f in files if f["file_id"] not in set(ids)]
        bottommost = not any(f["level"] >= level and f["smallest"] <= hi and f["largest"] >= lo for f in kept)
        out = durable(compaction.split_files(self.versions(files=ids), target_bytes, self.pinned(), bottommost))
        made = self._write_files(out) if not out.isEmpty() else []
        self._publish(files=kept + [{**f, "level": level} for f in made], next_file=self._version["next_file"] + len(made))
        return {"output_level": level, "deleted": ids, "added": [f["file_id"] for f in made]}

    def files(self) -> list[dict]:
        """Metadata of the live files."""
        return [dict(f) for f in self._version["files"]]

    def vacuum(self) -> list[int]:
        """Remove stored files that the published version does not list; returns their ids."""
        fs, root = self._fs(), self._at(f"{self.path}/data")
        if not fs.exists(root):
            return []
        live = {f["file_id"] for f in self._version["files"]}
        gone = []
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if not name.startswith("file_id="):  # the mark of a finished job
                continue
            number = int(name.removeprefix("file_id="))
            if number not in live:
                fs.delete(status.getPath(), True)
                gone.append(number)
        return sorted(gone)
