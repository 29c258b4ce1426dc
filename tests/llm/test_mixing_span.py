from pyspark.sql import functions as F

from kvstrata.llm.mixing import _cut


def test_cut_goes_on_behind_the_first_slots(spark):
    """The last of 1,001 blocks holds 60 % of the tokens: the first 2 x 300 + 64 slots hold 26,560 of the 30,000 wanted."""
    sizes = spark.range(1001).select(F.lit("s").alias("source"), F.col("id").alias("block"), F.when(F.col("id") == 1000, 60_000).otherwise(40).cast("long").alias("size"))

    def slots(plan):
        m, _, s, begin, n = plan[0]
        return spark.range(begin, begin + n).select(F.lit(m).alias("mix_name"), F.lit(s).alias("source"), F.col("id").alias("slot"), F.col("id").alias("block"))

    assert _cut(slots, sizes, {"m": {"s": (300, 30_000.0, 1001)}}) == {("m", "s"): 750}
    assert _cut(slots, sizes, {"m": {"s": (300, 100_000.0, 1001)}}) == {("m", "s"): 1001}
