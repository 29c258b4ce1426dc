import math
import random

from helpers import rows
from picker_sets import picked_sets, picker_sets

from kvstrata.operators import picker


#: Base level, factor and targets of levels 1 to 6 of the sets, worked out by hand from the sizing rule.
SIZED = {
    "A6.1": (6, 1.0, [None] * 6), "A6.2": (6, 1.0, [None] * 5 + [400]), "A6.3": (5, 10.0, [None] * 4 + [400, 600]),
    "A7.1": (4, math.sqrt(600 / 21), [None] * 3 + [200, 200, 599]), "A7.2": (4, math.sqrt(3303 / 33), [None] * 3 + [200, 330, 3301]),
}


def test_levels_are_sized(spark):
    got: dict = {}
    for o, f in picker_sets(spark):
        for r in picker.level_scores(f, "fixture", o).collect():
            got.setdefault(r.fixture, {})[r.level] = r
    for name, (base, factor, targets) in SIZED.items():
        assert {r.base_level for r in got[name].values()} == {base} and abs(got[name][0].factor - factor) < 1e-9, name
        assert [got[name][i].target for i in range(1, 7)] == targets, name
    assert round(got["A7.2"][5].score, 2) == 3.03 and got["A7.2"][6].score is None and got["A6.1"][0].score == 1.0


def test_picks(spark):
    got = {}
    for files, picked in picked_sets(spark):
        for r in picker.expand_inputs(files, picker.pick_files(files, picked, "fixture"), "fixture").collect():
            got.setdefault((r.fixture, r.output_level), set()).add(r.file_id)
    assert got == {("A6.1", 6): {0, 1, 2, 3}, ("A6.2", 6): set(range(4, 12)), ("A6.3", 5): {8, 9, 10, 11}, ("A7.1", 4): {1, 2, 5, 6}, ("A7.2", 6): {5}}


def test_busy_files_block(spark):
    files = spark.createDataFrame([("g", 1, 5, 300, "a", "c", False), ("g", 2, 5, 10, "d", "e", False), ("g", 3, 6, 50, "b", "b", True)], "g string, file_id long, level int, file_size long, smallest string, largest string, being_compacted boolean")
    picked = spark.createDataFrame([("g", 5, 6, 2.0)], "g string, level int, output_level int, score double")
    assert rows(picker.pick_files(files, picked, "g"), "file_id") == [(2,)]


def test_overlap_matches_pairs(spark):
    r = random.Random(5)
    made = [(g, i, *sorted("".join(r.choices("abc", k=3)) for _ in range(2)), r.randrange(9)) for i in range(60) for g in [r.randrange(2)]] + [(0, 99, None, None, 4)]
    df = spark.createDataFrame([(g, i, a, b, n, False) for g, i, a, b, n in made], "g int, file_id long, smallest string, largest string, file_size long, being_compacted boolean")
    want = {i: (len(m := [y for y in made if a and y[2] and y[0] == g and y[2] <= b and y[3] >= a]), sum(y[4] for y in m)) for g, i, a, b, _ in made}
    for ranges in (1, 3, None):
        assert {x.file_id: (x.n_overlap, x.overlap_bytes) for x in picker.overlap_totals(df, df, ["g"], ranges).collect()} == want
