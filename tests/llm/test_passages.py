import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import rows
from kvstrata.llm import passages
from kvstrata.llm.passages import SuffixAutomaton, anchors_of, merge_spans, remove_spans, shared_pairs, shared_share, shared_spans

DOCS = "doc_id long, text string"


def text(r, n, letters="abcdefgh é\n"):
    return "".join(r.choices(letters, k=n))


def windows(docs, n):
    out = {}
    for i, t in docs:
        if i is not None and t:
            for j in range(len(t) - n + 1):
                out.setdefault(t[j : j + n], set()).add(i)
    return out


def brute_pairs(docs, n):
    return sorted({(a, b) for s in windows(docs, n).values() if len(s) > 1 for a in s for b in s if a < b}, key=repr)


def brute_cover(docs, n):
    w, out = windows(docs, n), {}
    for i, t in docs:
        mask = np.zeros(len(t or ""), bool)
        for j in range(len(t or "") - n + 1):
            if i is not None and len(w[t[j : j + n]]) > 1:
                mask[j : j + n] = True
        out[i] = int(mask.sum())
    return out


def made(seed=1):
    r = random.Random(seed)
    common = [text(r, n) for n in (39, 40, 41, 90, 200)]
    docs = []
    for i in range(60):
        parts = [text(r, r.randrange(1, 120)) for _ in range(4)]
        for p in r.sample(common, 2):
            parts.insert(r.randrange(4), p)
        docs.append((i, "".join(parts)))
    docs += [(100 + i, docs[3][1]) for i in range(5)] + [(200, docs[4][1][:-1]), (201, docs[4][1] + "!"), (202, "a" * 500), (203, "a" * 300), (204, "ab" * 100)]
    return docs + [(300, None), (301, ""), (302, "short"), (None, docs[5][1]), docs[7], docs[8]]


@given(st.lists(st.text("ab", max_size=30), min_size=1, max_size=3), st.text("abc", max_size=40))
@settings(max_examples=200, deadline=None)
def test_automaton_spans(passages_, stream):
    got = SuffixAutomaton(passages_).spans(stream, 4)
    ends = {}
    for i in range(len(stream)):
        for j in range(len(stream), i + 3, -1):
            if any(stream[i:j] in p for p in passages_):
                ends.setdefault(j, i)
                break
    maximal = sorted((i, j) for j, i in ends.items())
    assert sorted(got) == maximal
    assert bool(SuffixAutomaton(passages_).spans(stream, 4, first=True)) == bool(maximal)


def test_every_window_has_an_anchor():
    r = random.Random(2)
    for t in (text(r, 3000), "a" * 500, text(r, 700, "ab")):
        owner, pos, h = anchors_of(["x" * 10, t, text(r, 25)], 12, 40)
        own = np.sort(pos[owner == 1])
        assert all(((own >= j) & (own + 12 <= j + 40)).any() for j in range(len(t) - 39))
        again = anchors_of([text(r, 400), t], 12, 40)
        assert {(p, x) for o, p, x in zip(*again) if o == 1} == {(p, x) for o, p, x in zip(owner, pos, h) if o == 1}


@pytest.mark.parametrize("hot", [1, 3, 10_000])
def test_pairs_match_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(passages, "STREAMS_PER_TASK", 4)
    docs = made()
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    assert rows(shared_pairs(df, min_len=40, k=20, hot_anchor=hot)) == brute_pairs(docs, 40)


@pytest.mark.parametrize("hot", [1, 10_000])
def test_shares_and_removal(spark, hot):
    docs = made(5)
    df = spark.createDataFrame([(i, t) for i, t in docs if i is not None], DOCS).distinct()
    cover = brute_cover(docs, 40)
    spans = shared_spans(df, min_len=40, k=20, hot_anchor=hot).cache()
    held = {r.doc: r.n for r in spans.groupBy("doc").agg(F.sum(F.col("end") - F.col("start")).alias("n")).collect()}
    assert held == {i: n for i, n in cover.items() if n and i is not None}
    cut = {r.doc_id: r.text for r in remove_spans(df, spans).collect()}
    assert all(len(cut[i] or "") == len(t or "") - cover[i] for i, t in docs if i is not None)
    assert cut[300] is None and cut[301] == ""


def test_share_of_default_length(spark):
    r = random.Random(8)
    p = text(r, 250)
    df = spark.createDataFrame([(1, p + text(r, 250)), (2, text(r, 100) + p), (3, text(r, 199)), (4, None), (5, "")], DOCS).withColumns({c: F.lit(1) for c in ("doc", "h", "pos", "n")})
    assert rows(shared_share(df), "doc_id", "n_chars", "shared_chars") == [(1, 500, 250), (2, 350, 250), (3, 199, 0), (4, 0, 0), (5, 0, 0)]
    assert rows(shared_pairs(df)) == [(1, 2)]
    assert shared_pairs(df.limit(0)).count() == 0 == shared_share(df.limit(0)).count()


def test_long_texts_are_cut_into_overlapping_pieces(spark, monkeypatch):
    monkeypatch.setattr(passages, "PIECE", 1000)
    r = random.Random(9)
    long = text(r, 30_000)
    docs = [(1, long)] + [(10 + i, text(r, 50) + long[at : at + 200] + text(r, 50)) for i, at in enumerate(range(700, 29_000, 997))] + [(99, text(r, 50) + long[5000:5199] + "#" + text(r, 50))]
    assert rows(shared_pairs(spark.createDataFrame(docs, DOCS))) == [(1, d) for d, _ in docs[1:-1]]


def test_a_large_class_is_paired_in_blocks(spark, monkeypatch):
    """40 copies of one text and 30 texts with one passage, in blocks of 8: all pairs, and no block meets more than 8 of a group at once."""
    monkeypatch.setattr(passages, "PAIR_BLOCK", 8)
    r = random.Random(12)
    twin, common = text(r, 300), text(r, 220)
    docs = [(i, twin) for i in range(40)] + [(100 + i, text(r, 60) + common + text(r, 60)) for i in range(30)] + [(200, twin[:250] + common)]
    got = rows(shared_pairs(spark.createDataFrame(docs, DOCS)))
    assert got == brute_pairs(docs, 200)
    copies = spark.createDataFrame([(i, 0) for i in range(40)], "doc long, rep long")
    _, members = passages._members(copies)
    assert members.count() == 40 and max(x["count"] for x in members.groupBy("rep", "block").count().collect()) <= 16 and members.select("block").distinct().count() == 5


def test_a_formula_in_all_texts_makes_no_pairs(spark):
    r = random.Random(10)
    formula = text(r, 150)
    docs = [(i, text(r, 300) + formula + text(r, 300)) for i in range(400)]
    docs[7] = (7, docs[7][1] + docs[8][1][250:480])
    assert rows(shared_pairs(spark.createDataFrame(docs, DOCS), hot_anchor=50)) == [(7, 8)]


def test_monotonous_texts_stay_linear(spark):
    docs = spark.createDataFrame([(i, c * 20_000 + str(i)) for i in range(4) for c in "a"] + [(9, "ab" * 5000), (10, "ab" * 4000 + "a" * 300)], DOCS)
    assert rows(shared_pairs(docs)) == sorted([(a, b) for a in range(4) for b in range(a + 1, 4)] + [(a, 10) for a in range(4)] + [(9, 10)], key=repr)
    assert rows(shared_share(docs), "doc_id", "shared_chars") == sorted([(i, 20_000) for i in range(4)] + [(9, 10_000), (10, 8300)], key=repr)


def test_merge_spans(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 3, 4), (1, 9, 10), (2, 1, 2), (1, 0, 5)], "doc long, start long, end long")
    assert rows(merge_spans(df), "doc", "start", "end") == [(1, 0, 7), (1, 9, 10), (2, 1, 2)]
