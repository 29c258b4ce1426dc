import random

import __spark_entry__ as entry


def test_shared_passages_are_removed(spark, tmp_path):
    """A passage of 200 code points goes from both speeches, one of 199 stays, copies go whole, null and short texts stay."""
    r = random.Random(3)
    word = lambda n: "".join(r.choices("abcdefgh ä", k=n))
    long, short, twin = word(200), word(199), word(300)
    docs = [(1, "A" + long + "B" + short + "C"), (2, "D" + short + "E" + long + "F"), (3, twin), (4, twin), (5, None), (6, "x"), (7, word(500))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x.text for x in entry.queries()["p8_left"](spark, str(tmp_path)).collect()}
    assert got == {**dict(docs), 1: "AB" + short + "C", 2: "D" + short + "EF", 3: "", 4: ""}
