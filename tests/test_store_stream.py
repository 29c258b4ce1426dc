import pytest
from pyspark.sql import functions as F

from helpers import rows
from kvstrata.operators import picker
from kvstrata.operators.read import visible
from kvstrata.sources.kv import KV_SCHEMA
from kvstrata.sources.store import Store
from kvstrata.streaming.ingest import fold_batches, stream_apply

OPS = "batch_id long, ordinal long, cf int, key string, op string, value string"


def batch(spark, *ops, cf=0):
    return spark.createDataFrame([(1, i, cf, k, "PUT" if v is not None else "DEL", v) for i, (k, v) in enumerate(ops)], OPS)


def test_life_of_a_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/db", bloom=True)
    assert s.families == {"default": 0} and s.get("k1") is None and s.scan().count() == 0
    s.write(batch(spark, ("k1", "v1"), ("k2", "v2")))
    pinned = s.snapshot()
    s.write(batch(spark, ("k1", None), ("k3", "v3")))
    assert (s.get("k1"), s.get("k2"), s.get("k3"), s.get("k1", snapshot=pinned)) == (None, "v2", "v3", "v1")
    other = s.create_family("write")
    with pytest.raises(ValueError):
        s.create_family("write")
    with pytest.raises(ValueError):
        s.get("k1", "nowhere")
    for bad in (batch(spark, ("", "x")), batch(spark, ("k", "x"), cf=9)):
        with pytest.raises(ValueError):
            s.write(bad)
    s.write(batch(spark, ("k1", "w1"), cf=other))
    again = Store(spark, f"file://{tmp_path}/db")
    assert again.families == {"default": 0, "write": 1} and again.last_sequence == 5
    assert again.get("k1", "write") == "w1" and again.get("k1") is None
    before = rows(s.scan()), rows(s.scan(snapshot=pinned))
    s.compact()
    assert (rows(s.scan()), rows(s.scan(snapshot=pinned))) == before
    assert len(s.files()) == 1 and s.vacuum() == [1, 2, 3] and s.vacuum() == []
    s.release(pinned)
    s.compact()
    assert s.versions().where("op = 'DEL'").count() == 0 and rows(s.scan()) == before[0]
    s.ingest(spark.createDataFrame([(0, "k2", "PUT", "outside")], "cf int, key string, op string, value string"))
    assert s.get("k2") == "outside"
    assert [r.key for r in s.scan(reverse=True, start="k2", end="k4").collect()] == ["k3", "k2"]


def test_pins_outlive_their_process(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/db")
    s.write(batch(spark, ("a", "1")))
    pin = s.snapshot()
    other = Store(spark, f"file://{tmp_path}/db")
    other.write(batch(spark, ("a", "2"), ("b", "3")))
    other.compact()
    assert other.pinned() == [pin] and other.get("a", snapshot=pin) == "1" and other.get("a") == "2"
    other.release(pin)
    s.refresh()
    assert s.pinned() == [] and s.get("a") == "2"


@pytest.fixture(scope="module")
def levelled(spark, tmp_path_factory):
    """A store whose 4 level-0 files were compacted into small files of the last level, and one more write; and what it must hold."""
    s, want = Store(spark, f"file://{tmp_path_factory.mktemp('levelled')}/db"), {}
    for i in range(5):
        ops = [(f"k{j:03}", None if (i + j) % 5 == 0 else f"{i}-{j}") for j in range(i, 120, 2)]
        s.write(batch(spark, *ops))
        want.update(ops)
        if i == 3:
            edit = s.compact_level(picker.LevelOptions(base_bytes=400, level0_trigger=4), target_bytes=100)
            assert edit["deleted"] == [1, 2, 3, 4] and edit["output_level"] == 6 and len(edit["added"]) > 5
    return s, {k: v for k, v in want.items() if v is not None}


def test_levels_are_compacted(spark, levelled, tmp_path):
    s, want = levelled
    assert {r.key: r.value for r in s.scan().collect()} == want
    files = sorted((f for f in s.files() if f["level"] == 6), key=lambda f: f["smallest"])
    assert all(a["largest"] < b["smallest"] for a, b in zip(files, files[1:])) and all(f["file_size"] < 100 + 12 for f in files)
    assert s.vacuum() == [1, 2, 3, 4] and {r.key: r.value for r in s.scan().collect()} == want
    assert s.compact_level() is None


def test_cursors_read_few_files(levelled):
    s, want = levelled
    keys = sorted(want)
    entry = lambda df: [(r.key, r.value) for r in df.orderBy("key").collect()]
    few = lambda df: len({f.split("file_id=")[1].split("/")[0] for f in df.inputFiles()}) < len(s.files()) / 2
    for at in ("", "k050", "k0501", keys[-1]):
        up, down = [k for k in keys if k >= at][:1], [k for k in keys if k <= at][-1:]
        assert entry(s.seek(at)) == [(k, want[k]) for k in up] and entry(s.seek(at, reverse=True)) == [(k, want[k]) for k in down]
        assert entry(s.next(at, n=3)) == [(k, want[k]) for k in keys if k > at][:3]
        assert entry(s.prev(at, n=3)) == [(k, want[k]) for k in keys if k < at][-3:]
    assert entry(s.seek("zzz")) == [] == entry(s.prefix("x"))
    assert entry(s.first(n=2)) == [(k, want[k]) for k in keys[:2]] and entry(s.last()) == [(keys[-1], want[keys[-1]])]
    assert entry(s.prefix("k05")) == [(k, want[k]) for k in keys if k.startswith("k05")]
    assert few(s.seek("k050")) and few(s.next("k050", n=3)) and few(s.prev("k060")) and few(s.prefix("k05")) and few(s.versions("k050"))


def test_unpublished_write_leaves_the_version(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/db")
    s.write(batch(spark, ("a", "1")))
    s._write_file(spark.createDataFrame([(0, "b", 2, "PUT", "2")], KV_SCHEMA), 2)  # a write that failed before it was published
    again = Store(spark, f"file://{tmp_path}/db")
    assert [r.key for r in again.scan().collect()] == ["a"] and again.vacuum() == [2]


def test_stream_with_late_and_repeated_rows(spark, tmp_path):
    made = [[(0, "a", 3, "PUT", "new"), (0, "b", 1, "PUT", "x")], [(0, "a", 2, "PUT", "late"), (0, "b", 4, "DEL", None)], [(0, "a", 3, "PUT", "new"), (0, None, 9, "PUT", "x")]]
    for i, part in enumerate(made[:2]):
        spark.createDataFrame(part, KV_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    read = lambda: spark.readStream.schema(KV_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    assert rows(stream_apply(read(), lambda b: b, f"{tmp_path}/state")) == [(0, "a", 3, "new")]
    spark.createDataFrame(made[2] + [(0, "c", 10, "PUT", "y")], KV_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    out = stream_apply(read(), lambda b: b, f"{tmp_path}/state")
    assert rows(out) == [(0, "a", 3, "new"), (0, "c", 10, "y")]
    assert fold_batches(spark, f"{tmp_path}/state", 1) and not fold_batches(spark, f"{tmp_path}/state", 1)
    assert rows(stream_apply(read(), lambda b: b, f"{tmp_path}/state")) == rows(out)
    everything = spark.read.schema(KV_SCHEMA).parquet(f"{tmp_path}/in/*")
    assert rows(visible(everything.where(F.lit(True)))) == rows(out)
