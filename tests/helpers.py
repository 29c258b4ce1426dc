"""Helpers shared by the tests."""

from __future__ import annotations

import datetime as dt
import os

LOG = "db_id int, cf int, user_key string, seqno long, tp int, val string, log_number long, arrived_at timestamp_ntz"
EDITS = "db_id int, edit_no long, group_no long, cf int, cf_name string, kind string, packed_number_and_path_id long, file_level int, log_number long, last_sequence long, edit_ts timestamp_ntz, arrived_at timestamp_ntz"
FILES = "db_id int, packed_number_and_path_id long, cf int, file_level int, file_size long, smallest string, largest string, smallest_seqno long, largest_seqno long, num_entries long, num_deletions long, being_compacted boolean, meta_rev int, log_number long, recorded_at timestamp_ntz"
BLOCKS = "block_no long, db_id int, packed_number_and_path_id long, cf int, num_added long, hash_entries array<long>, edit_no long, built_at timestamp_ntz"
RUNS = "run_no long, report_no int, db_id int, cf int, status string, log_number long, last_sequence long, started_at timestamp_ntz, reported_at timestamp_ntz"

T0 = dt.datetime(2024, 1, 31, 23, 59)


def rows(df, *cols):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)


def op(db, cf, key, seq, tp, log=1):
    return (db, cf, key, seq, tp, "v", log, None)


def edit(db, no, kind, file=None, cf=0, level=0, log=None, last=None, ts=T0):
    return (db, no, no, cf, "f" if kind == "ADD_CF" else None, kind, file, level if file is not None else None, log, last, ts, None)


def file_row(db, file, cf=0, level=0, size=10, rev=0, log=1, hi=1, lo=1, entries=1):
    return (db, file, cf, level, size, "a", "b", lo, hi, entries, 0, False, rev, log, None)


def duck(d):
    """A DuckDB connection with a view per table of a data directory."""
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(d):
        at = f"{d}/{name}"
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    return c
