import os

import pytest

from helpers import duck, rows
from kvstrata.plans.store_queries import ORACLE_SQL
from kvstrata.plans.views import register

D = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_sql_over_views(spark):
    names = register(spark, D)
    assert {"kv", "kv_live", "files", "edits"} <= set(names)
    live = rows(spark.sql("SELECT cf, key, seq, value FROM kv_live"))
    by_hand = spark.sql("SELECT cf, key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY cf, key ORDER BY seq DESC) AS rn FROM kv) WHERE rn = 1 AND op = 'PUT'")
    want = sorted(duck(D).execute(ORACLE_SQL["forward_scan"]).fetchall(), key=repr)
    assert live == rows(by_hand) == want
    assert spark.sql("SELECT count(*) FROM files f JOIN edits e ON e.db_id = f.db_id").first()[0] > 0
