import random
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from helpers import EDITS, FILES, edit, file_row, rows
from kvstrata.operators import smallfiles
from kvstrata.operators.changes import live_files
from kvstrata.operators.smallfiles import FileSet, Joiner, combined, described_files, frame_end, plan_merges, small_files, whole_frames

TARGETS = "file_level int, target_file_bytes long"


def planned(spark, sizes, target=1000):
    edits = spark.createDataFrame([edit(1, i + 1, "ADD_FILE", i) for i in range(len(sizes))], EDITS)
    files = spark.createDataFrame([file_row(1, i, size=s) for i, s in enumerate(sizes)], FILES)
    return plan_merges(small_files(live_files(edits), files, spark.createDataFrame([(0, target)], TARGETS)))


def test_outputs_are_well_sized_and_whole(spark, monkeypatch):
    r = random.Random(2)
    sizes = [r.randrange(1, 240) for _ in range(500)]
    for per_block in (4096, 100):
        monkeypatch.setattr(smallfiles, "NUMBERS_PER_BLOCK", per_block)
        plan = planned(spark, sizes).cache()
        assert sorted(x.file_number for x in plan.collect()) == list(range(500))
        out = [x.b for x in plan.groupBy("out_no").agg(F.sum("file_size").alias("b")).collect()]
        assert sum(out) == sum(sizes) and all(500 < b < 1500 for b in out)


def test_unknown_sizes_revisions_and_loners(spark):
    edits = spark.createDataFrame([edit(1, i, "ADD_FILE", i, cf=i // 10) for i in range(1, 6)] + [edit(1, 11, "ADD_FILE", 11, cf=1)], EDITS)
    files = [file_row(1, 1, size=5), file_row(1, 2, size=999), file_row(1, 2, size=3, rev=1), file_row(1, 2, size=None, rev=2), file_row(1, 3, size=-1), file_row(1, 4, size=None), file_row(1, 5, size=250), file_row(1, 11, cf=1, size=1), file_row(1, 1, size=5)]
    targets = spark.createDataFrame([(0, 1000), (1, None)], TARGETS)
    plan = plan_merges(small_files(live_files(edits), spark.createDataFrame(files, FILES), targets))
    assert rows(plan, "file_number", "file_size", "out_no") == [(1, 5, 0), (2, 3, 0)]
    assert planned(spark, [0, 0, 0]).select("out_no").distinct().count() == 1
    assert plan_merges(small_files(live_files(edits.limit(0)), spark.createDataFrame([], FILES), targets)).count() == 0


def test_frames_are_walked(spark):
    texts = [b"", b"a", b"x" * 300_000, random.Random(1).randbytes(200_000)]
    for checksum in (False, True):
        for known in (False, True):
            press = zstandard.ZstdCompressor(write_checksum=checksum, write_content_size=known)
            frames = [press.compress(t) for t in texts]
            assert all(frame_end(f) == len(f) for f in frames)
            assert whole_frames(b"".join(frames)) == len(frames)
    skippable = b"\x50\x2a\x4d\x18\x03\x00\x00\x00abc"
    assert whole_frames(skippable + frames[1]) == 2
    for bad in (frames[2][:-1], frames[1] + b"x", b"nonsense", frames[3][:9]):
        with pytest.raises((ValueError, IndexError)):
            whole_frames(bad)


def recorded(part):
    return part, len(part), zlib.crc32(part)


def test_checksums_combine():
    r = random.Random(3)
    for _ in range(30):
        a, b = r.randbytes(r.randrange(400)), r.randbytes(r.randrange(400))
        assert combined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_lines_headers_and_checks():
    j = Joiner("lines", header=True)
    body = b"".join(j.add(*recorded(part)) for part in (b"h\n1\n", b"h\n2", b"", b"h\n", b"h"))
    assert body == b"h\n1\n2\n" and (j.length, j.crc, j.parts) == (6, zlib.crc32(body), 5)
    for bad in ((b"other\n3\n", 8, zlib.crc32(b"other\n3\n")), (b"h\n1\n", 4, 7), (b"h\n1\n", 5, zlib.crc32(b"h\n1\n"))):
        with pytest.raises(ValueError):
            j.add(*bad)
    with pytest.raises(ValueError):
        Joiner("gzip")


BODIES, PLAN = "name string, payload binary, entries long", "name string, out long, no long"


@pytest.mark.parametrize("codec", ["lines", "zstd"])
def test_files_are_merged_and_swapped(spark, tmp_path, codec):
    press = zstandard.ZstdCompressor(write_checksum=True).compress if codec == "zstd" else bytes
    plain = {f"f{i}": f"line {i}\n".encode() * (i % 7) for i in range(60)}
    files = FileSet(spark, f"file://{tmp_path}/set")
    files.add(spark.createDataFrame([(n, press(b), i % 7) for i, (n, b) in enumerate(plain.items())] + [("loner", press(b"x\n"), 1)], BODIES))
    plan = spark.createDataFrame([(f"f{i}", i % 4, i) for i in range(60)], PLAN)
    out = {r.out: r for r in files.merge(plan, ["out"], "no", codec).collect()}
    assert {r.name for r in files.listing().collect()} == {"loner", *(r.name for r in out.values())} and files.version() == 2
    for o, r in out.items():
        body = (tmp_path / "set" / "files" / r.name).read_bytes()
        assert (r.n_bytes, r.crc32, r.n_parts, r.entries) == (len(body), zlib.crc32(body), 15, sum(i % 7 for i in range(60) if i % 4 == o))
        whole = zstandard.ZstdDecompressor().stream_reader(body, read_across_frames=True).read() if codec == "zstd" else body
        assert whole == b"".join(plain[f"f{i}"] for i in range(60) if i % 4 == o)
    assert files.vacuum().count() == 60 and len([x for x in (tmp_path / "set" / "files").iterdir() if not x.name.startswith(".")]) == 5


def test_a_damaged_part_stops_the_merge(spark, tmp_path):
    files = FileSet(spark, f"file://{tmp_path}/set")
    files.add(spark.createDataFrame([("a", b"1\n", 1), ("b", b"2\n", 1), ("c", None, 0)], BODIES))
    (tmp_path / "set" / "files" / "b").write_bytes(b"3\n")  # as long, but other bytes
    with pytest.raises(Exception, match="not as it was recorded"):
        files.merge(spark.createDataFrame([("a", 1, 1), ("b", 1, 2)], PLAN), ["out"], "no", "lines")
    assert files.version() == 1 and files.listing().count() == 3
    (tmp_path / "set" / "files" / "b").write_bytes(b"2\n")
    out = files.merge(spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("c", 1, 3)], PLAN), ["out"], "no", "lines")
    assert rows(out, "n_parts", "entries", "n_bytes") == [(3, 2, 4)] and files.version() == 2
    assert files.merge(spark.createDataFrame([], PLAN), ["out"], "no", "lines").count() == 0


def test_described_files(spark):
    df = spark.createDataFrame([(1, 2, 2), (1, 3, None)], "db_id int, file_number long, num_entries long")
    assert rows(described_files(df)) == [("1-2", bytearray(b"db file entry\n1 2 0\n1 2 1"), 2), ("1-3", bytearray(b"db file entry\n"), None)]
