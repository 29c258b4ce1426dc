import random

from pyspark.sql import functions as F

from helpers import BLOCKS, EDITS, T0, edit, rows
from kvstrata.operators import orphans as orphan_module
from kvstrata.operators.orphans import life_spans, manifest_references, orphan_counts, orphans


def block(no, db, file, at):
    return (no, db, file, 0, 1, None, at, T0)


def brute(edits, blocks):
    out, seen = set(), {}
    for e in sorted({(e[0], e[1]): e for e in edits}.values(), key=lambda e: (e[0], e[1])):
        db, no, cf, kind, file = e[0], e[1], e[3], e[5], e[6]
        file = None if file is None else file & (1 << 62) - 1
        if kind == "DEL_FILE" and file is not None and not seen.get((db, "f", file)):
            out.add(("edits", "deleted_files", db, no))
        if kind != "ADD_CF" and cf not in (None, 0) and not seen.get((db, "c", cf)):
            out.add(("edits", "column_family", db, no))
        if kind in ("ADD_FILE", "DEL_FILE") and file is not None:
            seen[db, "f", file] = kind == "ADD_FILE"
        if kind in ("ADD_CF", "DROP_CF"):
            seen[db, "c", cf] = kind == "ADD_CF"
    for no, db, file, _, _, _, at, _ in blocks:
        if file is None or db is None or at is None:
            continue
        last = max((e for e in edits if e[0] == db and e[6] is not None and e[5].endswith("FILE") and (e[6] ^ file) & (1 << 62) - 1 == 0 and e[1] <= at), key=lambda e: e[1], default=None)
        if last is None or last[5] != "ADD_FILE":
            out.add(("filter_blocks", "packed_number_and_path_id", db, no))
    return sorted(out, key=repr)


def made(seed, n=400):
    r = random.Random(seed)
    edits = []
    for no in range(n):
        kind = r.choice(["ADD_FILE"] * 4 + ["DEL_FILE"] * 3 + ["ADD_CF", "DROP_CF", "SET_LOG"])
        file = (r.randrange(12) | r.randrange(2) << 61 * 0) if "FILE" in kind and r.random() < 0.97 else None
        edits.append(edit(r.randrange(2), no, kind, file, cf=r.choice([None, 0, 1, 1, 1, 2]) if "CF" not in kind else r.choice([1, 2]), ts=r.choice([None, T0])))
    blocks = [block(i, r.randrange(3), r.choice([None, *range(14)]), r.randrange(n)) for i in range(120)] + [block(900, None, 3, 5)]
    return edits, blocks


def test_both_branches_match_brute_force(spark):
    for seed in (1, 2):
        edits, blocks = made(seed)
        refs, events = manifest_references(spark.createDataFrame(edits + edits[::5], EDITS), spark.createDataFrame(blocks + blocks[::3], BLOCKS))
        spans = life_spans(events)
        want = brute(edits, blocks)
        for parts, most in ((1024, 10**9), (8, 10**9), (8, 0), (1, 0)):  # all keys are heavy, some are, some without a broadcast, none are
            assert rows(orphans(refs, spans, parts, most).select("ref_table", "ref_field", F.col("scope").alias("db"), "ref_no").distinct()) == want
        counted = orphan_counts(refs, spans, parts=8)
        assert sum(r.n_orphans for r in counted.collect()) == len(want)
        assert {r.period for r in counted.collect()} == {None, "2024-01"}


def test_a_hot_key_is_cut_into_blocks(spark, monkeypatch):
    """A family that is added and dropped over and over and named by a third of all references."""
    monkeypatch.setattr(orphan_module, "BLOCK", 64)
    r = random.Random(7)
    edits = [edit(1, i, *r.choice([("ADD_CF",), ("DROP_CF",), ("SET_LOG",), ("SET_LOG",)]), cf=1) for i in range(600)] + [edit(1, 600 + i, "DEL_FILE", i, cf=2 + i) for i in range(300)]
    refs, events = manifest_references(spark.createDataFrame(edits, EDITS), spark.createDataFrame([], BLOCKS))
    spans = life_spans(events, 50)
    assert rows(spans) == rows(life_spans(events))
    loads = orphan_module.reference_loads(refs).cache()
    lookup = orphan_module.Lookup(loads, spans)
    assert [(x.scope, x.key) for x in lookup.heavy.collect()][:1] and max(len(x.spans) for x in lookup.blocks.collect()) <= 33
    for most in (10**9, 0):
        assert rows(orphans(refs, spans, 1024, most).select("ref_table", "ref_field", F.col("scope").alias("db"), "ref_no")) == brute(edits, [])


def test_empty_and_clashing_columns(spark):
    none, no_blocks = spark.createDataFrame([], EDITS), spark.createDataFrame([], BLOCKS)
    refs, events = manifest_references(none, no_blocks)
    assert orphans(refs, life_spans(events)).count() == 0 == orphan_counts(refs, life_spans(events)).count()
    extra = {c: F.lit("x") for c in ("key", "scope", "period", "point", "file", "pos", "c", "b", "n")}
    df = spark.createDataFrame([edit(1, 1, "DEL_FILE", 4)], EDITS).withColumns(extra)
    refs, events = manifest_references(df, spark.createDataFrame([block(1, 1, 4, 9)], BLOCKS).withColumns(extra))
    assert rows(orphans(refs, life_spans(events)), "ref_table", "ref_no") == [("edits", 1), ("filter_blocks", 1)]
