"""The picker's known cases, as file sets with their sizing options."""

from kvstrata.operators import picker
from kvstrata.sources.kv import FILE_SCHEMA
from kvstrata.sources.scratch import durable

#: File sets (id, size, level, smallest, largest) with their sizing options; the inputs of the picker's known cases.
_L0 = [(100, 0, "aa", "ca"), (100, 0, "ba", "da"), (100, 0, "ca", "da"), (100, 0, "aa", "ba")]
PICKER_SETS = {
    "A6.1": (400, 4, [(i, *f) for i, f in enumerate(_L0)]),
    "A6.2": (400, 4, [(4, 100, 6, "aa", "aa"), (5, 100, 6, "ba", "ba"), (6, 100, 6, "ca", "ca"), (7, 100, 6, "da", "da"), *[(8 + i, *f) for i, f in enumerate(_L0)]]),
    "A6.3": (400, 4, [(1, 200, 6, "aa", "aa"), (2, 200, 6, "ba", "ba"), (3, 100, 6, "ca", "ca"), (4, 100, 6, "da", "da"), *[(8 + i, *f) for i, f in enumerate(_L0)]]),
    "A7.1": (200, 2, [(1, 1, 0, "150", "200"), (2, 1, 0, "200", "250"), (3, 300, 6, "200", "250"), (4, 300, 6, "300", "350"), (5, 3, 4, "150", "180"), (6, 3, 4, "181", "350"), (7, 3, 4, "400", "450")]),
    "A7.2": (200, 2, [(1, 1, 0, "150", "200"), (2, 300, 6, "200", "250"), (3, 3000, 6, "300", "350"), (4, 3, 6, "400", "450"), (5, 300, 5, "150", "180"), (6, 500, 5, "181", "350"), (7, 200, 5, "400", "450")]),
}


def picker_sets(spark):
    """(options, files) per option pair."""
    by: dict = {}
    for name, (base, trigger, rows) in PICKER_SETS.items():
        by.setdefault((base, trigger), []).extend((name, i, 0, level, size, lo, hi, 0, 0, 0, 0, False) for i, size, level, lo, hi in rows)
    return [(picker.LevelOptions(base_bytes=b, level0_trigger=t), spark.createDataFrame(rows, "fixture string, " + FILE_SCHEMA)) for (b, t), rows in by.items()]


def picked_sets(spark):
    for options, files in picker_sets(spark):
        yield files, durable(picker.pick_level(picker.level_scores(files, "fixture", options), "fixture"))
