"""Many small files into fewer well-sized ones.

Planning: the small live files of a database, family and level are taken in order
of their numbers and cut along their running size into outputs of about the
target size.  Running sizes are added up in blocks, so a hot group is many tasks.

Merging: byte-level concatenation of real files in a shared folder.  Only names
are shuffled; the task that makes an output reads its parts one after the other
and writes their bytes as they are.  Newline-delimited parts are joined after
boundary handling (a missing last line end is added, a repeated header line is
dropped), complete zstandard frames as they are: a zstandard stream may consist
of many frames.  Nothing is decompressed or parsed; frames are only walked from
block header to block header to see that they end where the part ends.

Checks: each part must have the length and checksum that were recorded when it was
stored.  From the recorded figures alone follow the length and the checksum that
the output must have (checksums of joined bytes are combined by arithmetic), and
the output is read back from the folder and compared before it gets its name.
``FileSet`` then replaces the inputs by the outputs with one rename, so a failed
merge leaves the old files in force, and ``vacuum`` removes what is not listed.

Defined results: a file without a known size (null or negative in all its
revisions) is not small; empty parts add nothing; a torn frame, a part that is not
as recorded, or parts with different headers raise an error and nothing is swapped.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvstrata.operators.ordering import blocked_sums
from kvstrata.operators.skew import spread_join
from kvstrata.sources.pointer import Pointer
from kvstrata.sources.scratch import durable
from kvstrata.sources.tables import file_number

#: File numbers in a block of running sizes.
NUMBERS_PER_BLOCK = 4096
#: A file is small if SMALL times its size is under the target of its level.
SMALL = 4

#: Fixed values of the public zstandard format.
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
ZSTD_DICT_BYTES = (0, 1, 2, 4)
#: The polynomial of the public CRC-32, least bit last.
CRC_POLYNOMIAL = 0xEDB88320


def small_files(live: DataFrame, files: DataFrame, targets: DataFrame) -> DataFrame:
    """(db_id, cf, file_level, file_number, file_size, num_entries, target) of live small files."""
    known = files.where("file_size >= 0").withColumn("file_number", file_number("packed_number_and_path_id"))
    sizes = known.groupBy("db_id", "file_number").agg(F.max(F.struct("meta_rev", "file_size", "num_entries")).alias("m")).select("db_id", "file_number", "m.file_size", "m.num_entries")
    wanted = targets.where("target_file_bytes IS NOT NULL").groupBy("file_level").agg(F.max("target_file_bytes").alias("target"))
    return live.join(sizes, ["db_id", "file_number"]).join(wanted, "file_level").where(F.col("file_size") * SMALL < F.col("target")).select("db_id", "cf", "file_level", "file_number", "file_size", "num_entries", "target")


GROUP = ["db_id", "cf", "file_level"]


def plan_merges(small: DataFrame) -> DataFrame:
    """The rows of ``small`` that have company in their database, family and level, with out_no: the output file of the group that each goes to."""
    small = durable(small)
    loads = durable(small.groupBy(*GROUP).agg(F.count("*").alias("n"), F.sum("file_size").alias("total")).where("n > 1"))
    rows = loads.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    company = spread_join(small, loads, GROUP, "n", rows, null_safe=True)
    run = blocked_sums(company, GROUP, F.floor(F.col("file_number") / NUMBERS_PER_BLOCK), ["file_number"], ["file_size"])
    outputs = F.greatest(F.lit(1), F.expr("(2 * total + target) DIV (2 * target)"))
    before = F.col("run_file_size") - F.col("file_size")
    out_no = F.when(F.col("total") > 0, F.least(outputs - 1, F.floor(before / (F.col("total") / outputs)))).otherwise(0)
    return run.select(*small.columns, out_no.cast("long").alias("out_no")).drop("target")


def frame_end(data: bytes, at: int = 0) -> int:
    """Where the zstandard frame that starts at ``at`` ends, from its headers alone."""
    if data[at : at + 4] != ZSTD_MAGIC:
        kind = int.from_bytes(data[at : at + 4], "little")
        if kind >> 4 == 0x184D2A5 and len(data) >= at + 8:  # a skippable frame
            end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        else:
            raise ValueError(f"no zstandard frame at byte {at}")
    else:
        flags = data[at + 4]
        single = flags >> 5 & 1
        content = (single, 2, 4, 8)[flags >> 6]
        at += 5 + (not single) + ZSTD_DICT_BYTES[flags & 3] + content
        last = 0
        while not last:
            if at + 3 > len(data):
                raise ValueError("torn zstandard frame")
            head = int.from_bytes(data[at : at + 3], "little")
            last, kind, size = head & 1, head >> 1 & 3, head >> 3
            if kind == 3:
                raise ValueError("reserved zstandard block type")
            at += 3 + (1 if kind == 1 else size)
        end = at + 4 * (flags >> 2 & 1)
    if end > len(data):
        raise ValueError("torn zstandard frame")
    return end


def whole_frames(data: bytes) -> int:
    """Number of complete frames that make up ``data``; raises if it is anything else."""
    at = n = 0
    while at < len(data):
        at = frame_end(data, at)
        n += 1
    return n


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of the checksum; the highest of 32 bits is the constant term."""
    out = 0
    for at in range(31, -1, -1):
        if a >> at & 1:
            out ^= b
        b = b >> 1 ^ (CRC_POLYNOMIAL if b & 1 else 0)
    return out


def shifted(crc: int, n: int) -> int:
    """What a checksum adds to that of the same bytes followed by ``n`` more: its product with x^(8n), by repeated squaring."""
    power, square = 1 << 31, 1 << 23
    while n:
        if n & 1:
            power = _times(power, square)
        square, n = _times(square, square), n >> 1
    return _times(power, crc)


def combined(first: int, second: int, n: int) -> int:
    """The checksum of bytes with checksum ``first`` followed by ``n`` bytes with checksum ``second``."""
    return shifted(first, n) ^ second


class Joiner:
    """Boundary handling and checks of the parts of one output; ``length`` and ``crc`` are what the output must have, from the recorded figures."""

    def __init__(self, codec: str, header: bool = False):
        if codec not in ("lines", "zstd"):
            raise ValueError(f"unknown codec {codec}")
        self.codec, self.header, self.head = codec, header, None
        self.length, self.crc, self.parts = 0, 0, 0

    def add(self, part: bytes, n_bytes: int, crc: int) -> bytes:
        """The bytes to write for a part that was recorded with a length and a checksum."""
        if len(part) != n_bytes or zlib.crc32(part) != crc:
            raise ValueError("a part is not as it was recorded")
        self.parts += 1
        if not part:
            return part
        if self.codec == "zstd":
            whole_frames(part)
        else:
            if part[-1:] != b"\n":
                part, crc, n_bytes = part + b"\n", combined(crc, zlib.crc32(b"\n"), 1), n_bytes + 1
            if self.header:
                at = part.index(b"\n") + 1
                head = part[:at]
                if self.head is None:
                    self.head = head
                elif head != self.head:
                    raise ValueError("parts of one output have different headers")
                else:
                    part, n_bytes = part[at:], n_bytes - at
                    crc ^= shifted(zlib.crc32(head), n_bytes)  # the checksum of what follows the header
        self.length += n_bytes
        self.crc = combined(self.crc, crc, n_bytes)
        return part


def _folder(uri: str):
    """(file system, path) of a folder that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _read(fs, path: str) -> bytes:
    with fs.open_input_stream(path) as f:
        return f.read()


def _place(fs, path: str, chunks: Iterator[bytes], expect: Callable[[], tuple[int, int]]) -> tuple[int, int]:
    """Write a file beside its name, read it back, compare length and checksum, and give it its name; a task that runs again makes the same file again."""
    draft = f"{path}.draft"
    with fs.open_output_stream(draft) as out:
        for chunk in chunks:
            out.write(chunk)
    n, crc = 0, 0
    with fs.open_input_stream(draft) as back:
        while chunk := back.read(1 << 20):
            n, crc = n + len(chunk), zlib.crc32(chunk, crc)
    if (n, crc) != expect():
        raise ValueError(f"{path} differs from its parts")
    fs.move(draft, path)
    return n, crc


def write_files(bodies: DataFrame, folder: str) -> DataFrame:
    """Store each row's ``payload`` (null counts as empty) as the file ``name`` in a folder; the other columns and n_bytes, crc32 of each."""
    rest = [c for c in bodies.columns if c not in ("name", "payload")]
    kinds = dict(bodies.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _folder(folder)
        fs.create_dir(root, recursive=True)
        for b in batches:
            names, held = b.column(len(rest)), []
            for name, payload in zip(names.to_pylist(), b.column(len(rest) + 1).to_pylist()):
                body = payload or b""
                held.append(_place(fs, f"{root}/{name}", iter([body]), lambda body=body: (len(body), zlib.crc32(body))))
            sizes = [pa.array([x[i] for x in held], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], names, *sizes], names=[*rest, "name", "n_bytes", "crc32"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in rest) + (", " if rest else "") + "name string, n_bytes long, crc32 long"
    return bodies.select(*rest, "name", "payload").mapInArrow(run, schema)


def concatenate(parts: DataFrame, out_key: list[str], order: str, source: str, target: str, codec: str, header: bool = False) -> DataFrame:
    """(out_key, name, n_parts, entries, n_bytes, crc32) of the outputs made of parts (out_key, order, name, n_bytes, crc32, entries).

    The files lie in the folder ``source`` and go to ``target``.  An output is one
    task's work and is bounded by its target size; its parts are read one at a time."""
    kinds = dict(parts.dtypes)
    names = [*out_key, "name", "n_parts", "entries", "n_bytes", "crc32"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in out_key) + ", name string, n_parts long, entries long, n_bytes long, crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (inputs, root), (outputs, to) = _folder(source), _folder(target)
        outputs.create_dir(to, recursive=True)
        shape = None

        def make(key: list, held: list[tuple]) -> pa.RecordBatch:
            joiner = Joiner(codec, header)
            name = "out-" + "-".join("null" if x is None else str(x) for x in key)
            chunks = (joiner.add(_read(inputs, f"{root}/{part}"), n, crc) for part, n, crc, _ in held)
            n, crc = _place(outputs, f"{to}/{name}", chunks, lambda: (joiner.length, joiner.crc))
            return pa.RecordBatch.from_pylist([dict(zip(names, [*key, name, joiner.parts, sum(x[3] or 0 for x in held), n, crc]))], schema=shape)

        key, held = None, []
        for b in batches:
            shape = shape or pa.schema([*[b.schema.field(i) for i in range(len(out_key))], ("name", pa.string()), *[(n, pa.int64()) for n in names[len(out_key) + 1 :]]])
            for *now, _, part, n, crc, entries in zip(*(c.to_pylist() for c in b.columns)):
                if held and now != key:
                    yield make(key, held)
                    held = []
                key = now
                held.append((part, n, crc, entries))
        if held:
            yield make(key, held)

    sized = parts.select(*out_key, order, "name", "n_bytes", "crc32", "entries").repartition(*out_key).sortWithinPartitions(*out_key, order)
    return sized.mapInArrow(run, schema)


class FileSet:
    """Files in a shared folder: ``files/``, a table of the live ones under ``listings/N`` and the pointer ``CURRENT`` that says which listing holds."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._pointer = Pointer(spark, f"{self.root}/CURRENT")

    @property
    def folder(self) -> str:
        return f"{self.root}/files"

    def version(self) -> int:
        return (self._pointer.read() or {"version": 0})["version"]

    def listing(self) -> DataFrame:
        """The live files: name, n_bytes, crc32, entries."""
        return self.spark.read.parquet(f"{self.root}/listings/{self.version()}")

    def _publish(self, listing: DataFrame) -> None:
        at = self.version() + 1
        listing.select("name", "n_bytes", "crc32", "entries").write.mode("overwrite").parquet(f"{self.root}/listings/{at}")
        self._pointer.publish({"version": at})

    def add(self, bodies: DataFrame) -> DataFrame:
        """Store files (name, payload, entries) and list them; their recorded lengths and checksums."""
        stored = durable(write_files(bodies.select("name", "payload", "entries"), self.folder))
        self._publish(self.listing().unionByName(stored) if self.version() else stored)
        return stored

    def merge(self, plan: DataFrame, out_key: list[str], order: str, codec: str, header: bool = False) -> DataFrame:
        """Replace the planned files (name, out_key, order) by their concatenations; the outputs, once they are in force."""
        plan = plan.select("name", *out_key, order)
        live = self.listing()
        parts = live.join(plan.hint("merge"), "name")
        out = durable(concatenate(parts, out_key, order, self.folder, self.folder, codec, header))
        rest = live.join(plan.select("name").hint("merge"), "name", "left_anti")
        self._publish(rest.unionByName(out.select("name", "n_bytes", "crc32", "entries")))
        return out

    def vacuum(self) -> DataFrame:
        """Remove the files of the version before that the published one does not list; their names."""
        at = self.version()
        if at < 2:
            return self.spark.createDataFrame([], "name string")
        gone = self.spark.read.parquet(f"{self.root}/listings/{at - 1}").select("name").join(self.listing().select("name").hint("merge"), "name", "left_anti")
        folder = self.folder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow.fs import FileType

            fs, root = _folder(folder)
            for b in batches:
                for name in b.column(0).to_pylist():
                    if fs.get_file_info(f"{root}/{name}").type == FileType.File:
                        fs.delete_file(f"{root}/{name}")
                yield b

        return durable(gone.mapInArrow(run, "name string"))


def described_files(files: DataFrame) -> DataFrame:
    """(name, payload, entries): stand-ins for files (db_id, file_number, num_entries) that a table describes but does not hold.

    A header line, then one line for each entry with its file and place; the last line of
    files with even numbers has no end, as happens in files from elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = []
            for db, number, n in zip(*(c.to_pylist() for c in b.columns)):
                lines = ["db file entry", *(f"{db} {number} {i}" for i in range(n or 0))]
                bodies.append(("\n".join(lines) + ("" if number % 2 == 0 else "\n")).encode())
            names = [f"{db}-{number}" for db, number in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary()), b.column(2)], names=["name", "payload", "entries"])

    return files.select("db_id", "file_number", F.col("num_entries").cast("long")).mapInArrow(run, "name string, payload binary, entries long")


def flushed_entries(plan: DataFrame, files: DataFrame, kv_log: DataFrame, step: int = 256) -> DataFrame:
    """(db_id, file_number, entries): operations of the log that each planned flushed (level 0) file holds.

    A flushed file holds the operations of its family between its least and
    greatest sequence number; ranges meet operations by steps of the number."""
    ranges = files.withColumn("file_number", file_number("packed_number_and_path_id")).groupBy("db_id", "file_number").agg(F.min("smallest_seqno").alias("lo"), F.max("largest_seqno").alias("hi"))
    flushed = plan.where("file_level = 0").join(ranges, ["db_id", "file_number"]).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / step), F.floor(F.col("hi") / step))))
    ops = kv_log.where("tp <> 3 AND user_key IS NOT NULL").select("db_id", "cf", "seqno").distinct().withColumn("bucket", F.floor(F.col("seqno") / step))
    held = flushed.select("db_id", "cf", "bucket", "file_number", "lo", "hi").hint("merge").join(ops, ["db_id", "cf", "bucket"]).where("seqno BETWEEN lo AND hi")
    return held.groupBy("db_id", "file_number").agg(F.count("*").alias("entries"))
