"""Long passages that stand word for word in more than one text.

Method: suffix automata of reference shards, streamed over by the other texts.
A blind broadcast of every shard to every text would cost (corpus x shards), so
texts are routed first: two texts that share a passage of ``min_len`` code
points also share an anchor, a ``k``-gram that is the least by hash in some
window of ``min_len`` code points.  A shard is one reference text (cut into
passages around its shared anchors); its automaton goes to the texts that share
an anchor with it and to no others, and their matching statistics give the
maximal spans.  Hence nothing is sent to all executors, and no link is lost.

Skew.  Exact copies are folded into one representative before anything else and
expanded at the end, members of a large class or texts of a common window in
blocks of ``PAIR_BLOCK``, so that no task makes all pairs of one group.  Rows of a
hot anchor, digest or reference text are kept apart from the shuffle of the others,
and texts are thinned by bitmaps of the ids asked for before they are shuffled; no
side that grows is broadcast.  An anchor that stands in many texts (a formula shorter
than ``min_len``, say) is split by the text of its full windows: every window
of ``min_len`` code points around it becomes an anchor of its own, so that only
texts that do share a whole window meet; for spans these meet in a star around
one text per window, not in pairs.  A reference text with many partners is
dealt over several tasks.

Defined results: null and empty texts, texts under ``min_len`` code points and
rows with a null id share nothing; a repeated row of one id never pairs with
itself; case, blanks and line breaks count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvstrata.operators.skew import may_be_in, spread_join, thinned
from kvstrata.sources.scratch import durable

#: Length of the anchors; passages of MIN_LEN have MIN_LEN - ANCHOR + 1 of them to choose from.
ANCHOR = 100
MIN_LEN = 200
#: Anchors at more places than this are split by their full windows: n places make n^2 / 2 streams of some 300 characters, or 150 n hashed windows.
HOT_ANCHOR = 16
#: Streams of one reference text that one task takes.
STREAMS_PER_TASK = 512
#: Texts of one group that one task pairs with all others of the group.
PAIR_BLOCK = 256
#: Code points hashed at once (arrays stay in the CPU's cache), and the largest piece of a long text.
CHUNK, PIECE = 1 << 15, 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up, down = (np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _U(x), _U)]), dtype=_U) for x in (_BASE, inverse))
        _POWERS[size] = up, down
    return _POWERS[size]


def _spread(x: np.ndarray) -> np.ndarray:
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    return x


def _slide(a: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over each ``width`` neighbours, by doubling."""
    done, out = 1, a
    while done * 2 <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    return pick(out[: len(out) - (width - done)], out[width - done :]) if width > done else out


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all ``k``-grams of a code point array."""
    up, down = _powers(len(points) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(points) + 1, _U)
        sums[0] = 0
        value = _spread((points.astype(_U) + _U(1)) * _U(0xBF58476D1CE4E5B9))
        value *= up[: len(points)]
        np.cumsum(value, out=sums[1:])
        h = sums[k:] - sums[:-k]
        h *= down[: len(h)]
        return _spread(h)


def anchors_of(texts: list[str], k: int, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of some texts, taken together: (index of the text, position, hash)."""
    lengths = np.array([len(x) for x in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) < min_len:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.int64),)
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(texts)), lengths)
    left = np.repeat(starts + lengths, lengths) - np.arange(len(points))  # code points up to the text's end
    h = gram_hashes(points, k)
    rank = (h >> _U(32)).astype(np.uint32)
    width = min_len - k + 1
    least = _slide(rank, width, np.minimum)
    least[left[: len(least)] < min_len] = 0
    around = np.zeros(len(rank) + width - 1, np.uint32)
    around[width - 1 : width - 1 + len(least)] = least
    hit = np.flatnonzero((_slide(around, width, np.maximum) == rank) & (left[: len(rank)] >= k))
    return owner[hit], hit - starts[owner[hit]], h[hit].view(np.int64)


def _pieces(ids: list, texts: list[str], min_len: int) -> Iterator[tuple[list, list[int], list[str]]]:
    """Batches of text pieces of about CHUNK code points; long texts in overlapping pieces, so that every window is whole in one."""
    batch: tuple[list, list[int], list[str]] = ([], [], [])
    held = 0
    for i, text in zip(ids, texts):
        if i is None or text is None or len(text) < min_len:
            continue
        for at in range(0, max(1, len(text) - min_len + 1), PIECE):
            piece = text if len(text) <= PIECE else text[at : at + PIECE + min_len - 1]
            for part, x in zip(batch, (i, at, piece)):
                part.append(x)
            held += len(piece)
            if held >= CHUNK:
                yield batch
                batch, held = ([], [], []), 0
    if batch[0]:
        yield batch


def extract_anchors(docs: DataFrame, k: int = ANCHOR, min_len: int = MIN_LEN) -> DataFrame:
    """(h, doc, pos) for every anchor of ``docs`` (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, offsets, texts in _pieces(b.column(0).to_pylist(), b.column(1).to_pylist(), min_len):
                owner, pos, h = anchors_of(texts, k, min_len)
                if len(h):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h), pa.array(np.array(ids, np.int64)[owner]), pa.array((pos + np.array(offsets, np.int64)[owner]).astype(np.int32))], names=["h", "doc", "pos"]
                    )

    return docs.select("doc", "text").mapInArrow(run, "h long, doc long, pos int")


def _hash(column: str):
    return F.xxhash64(column)


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` thinned to the texts whose id may be in the stored table ``wanted``, before they are shuffled to it."""
    return thinned(docs, _hash("doc"), wanted, _hash("doc"), wanted.count())


def _windows_around(docs: DataFrame, hot: DataFrame, k: int, min_len: int) -> DataFrame:
    """(h, doc, pos): the full windows around hot anchors, as anchors of their own."""
    at = durable(hot.groupBy("doc").agg(F.collect_set("pos").alias("at")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text, places in zip(*(c.to_pylist() for c in b.columns)):
                if len(text) < min_len:
                    continue
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                h = gram_hashes(points, min_len).view(np.int64)
                wanted = np.zeros(len(h), bool)
                for p in places:
                    wanted[max(0, p + k - min_len) : p + 1] = True
                pos = np.flatnonzero(wanted)
                yield pa.RecordBatch.from_arrays([pa.array(h[pos]), pa.array(np.full(len(pos), doc, np.int64)), pa.array(pos.astype(np.int32))], names=["h", "doc", "pos"])

    return _texts_of(docs, at).join(at.hint("merge"), "doc").select("doc", "text", "at").mapInArrow(run, "h long, doc long, pos int")


class SuffixAutomaton:
    """Suffix automaton of some passages; no match runs over a passage's end."""

    def __init__(self, passages: list[str]):
        nexts: list[dict] = [{}]
        links, lens = [-1], [0]
        last = 0
        for n, passage in enumerate(passages):
            for c in [*passage, n]:  # the number, unlike any character, ends the passage
                cur = len(nexts)
                nexts.append({})
                lens.append(lens[last] + 1)
                links.append(0)
                p = last
                while p >= 0 and c not in (t := nexts[p]):
                    t[c] = cur
                    p = links[p]
                if p >= 0:
                    q = nexts[p][c]
                    if lens[p] + 1 == lens[q]:
                        links[cur] = q
                    else:
                        clone = len(nexts)
                        nexts.append(dict(nexts[q]))
                        lens.append(lens[p] + 1)
                        links.append(links[q])
                        while p >= 0 and nexts[p].get(c) == q:
                            nexts[p][c] = clone
                            p = links[p]
                        links[q] = links[cur] = clone
                last = cur
        self.nexts, self.links, self.lens = nexts, links, lens

    def spans(self, text: str, least: int, first: bool = False) -> list[tuple[int, int]]:
        """Maximal spans (start, end) of ``text`` of at least ``least`` code points that stand in a passage, from its matching statistics; with ``first``, one is enough."""
        nexts, links, lens = self.nexts, self.links, self.lens
        out: list[tuple[int, int]] = []
        v = n = 0
        for i, c in enumerate(text):
            t = nexts[v].get(c)
            if t is not None:
                v = t
                n += 1
                if first and n >= least:
                    return [(i + 1 - n, i + 1)]
                continue
            if n >= least:
                out.append((i - n, i))
            while v >= 0 and c not in nexts[v]:
                v = links[v]
            if v < 0:
                v = n = 0
            else:
                n = lens[v] + 1
                v = nexts[v][c]
                if first and n >= least:
                    return [(i + 1 - n, i + 1)]
        if n >= least:
            out.append((len(text) - n, len(text)))
        return out


def copy_classes(docs: DataFrame, min_len: int = MIN_LEN) -> DataFrame:
    """(doc, rep) for every text of ``min_len`` or more code points that has exact copies; rep is the least id of them."""
    hashed = durable(docs.where(F.char_length("text") >= min_len).select("doc", F.md5("text").alias("digest"), F.char_length("text").alias("n")))
    classes = hashed.groupBy("digest", "n").agg(F.count("*").alias("load"), F.min("doc").alias("rep"), F.max("doc").alias("top")).where("rep < top").drop("top")
    return spread_join(hashed, durable(classes), ["digest", "n"], "load", hashed.count()).select("doc", "rep").distinct()


def _met(anchors: DataFrame) -> DataFrame:
    """(h, doc, pos, n): the stored ``anchors`` that stand in two texts or more, with the number of their places."""
    groups = anchors.groupBy("h").agg(F.count("*").alias("n"), F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    shared = durable(groups.where("lo < hi").select("h", "n", F.col("n").alias("load")))
    count, places = shared.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    rows = durable(thinned(anchors, F.col("h"), shared, F.col("h"), count))
    return durable(spread_join(rows, shared, ["h"], "load", places))


def _blocks(n: Column) -> Column:
    """Numbers of the blocks that a group of n texts is dealt to."""
    return F.sequence(F.lit(0).cast("long"), F.ceil(n / PAIR_BLOCK) - 1)


def _pairs_by(anchors: DataFrame) -> DataFrame:
    """(ref, doc, pos_ref, pos_doc), ref < doc: places of one anchor in two texts, from anchors (h, doc, pos, n) with n places.

    The texts of an anchor are dealt to blocks; each block meets all of them in a task of its own."""
    left = anchors.select("h", "doc", "pos", F.explode(_blocks(F.col("n"))).alias("block"))
    other = anchors.select("h", F.pmod(_hash("doc"), F.ceil(F.col("n") / PAIR_BLOCK)).alias("block"), F.col("doc").alias("d2"), F.col("pos").alias("p2"))
    return left.join(other.hint("merge"), ["h", "block"]).where("doc < d2").select(F.col("doc").alias("ref"), F.col("d2").alias("doc"), F.col("pos").alias("pos_ref"), F.col("p2").alias("pos_doc"))


def _window_candidates(wide: DataFrame, both: bool) -> DataFrame:
    """Candidates from anchors that are whole windows, so that all texts with one share a passage.

    For pairs, one place per text is enough, and of windows that stand in the same
    texts one is.  For spans no pairs are needed: all texts of a window are
    streamed over its first text, and that one over the second."""
    first = wide.groupBy("h", "doc").agg(F.min("pos").alias("pos"))
    if not both:
        sets = first.groupBy("h").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y"))
        one = durable(sets.groupBy("n", "x", "y").agg(F.min("h").alias("h")).select("h", "n", F.col("n").alias("load")))
        places = one.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return _pairs_by(durable(spread_join(durable(first), one, ["h"], "load", places)))
    low = first.groupBy("h").agg(F.min(F.struct("doc", "pos")).alias("low"), F.count("*").alias("load"))
    second = _centred(first, durable(low)).where("doc > low.doc").groupBy("h").agg(F.min(F.struct("doc", "pos")).alias("second"))
    stars = durable(low.join(second.hint("merge"), "h"))
    near = _centred(wide, stars)
    centre = F.when(F.col("doc") > F.col("low.doc"), F.col("low")).otherwise(F.col("second"))
    return near.select(centre["doc"].alias("ref"), "doc", centre["pos"].alias("pos_ref"), F.col("pos").alias("pos_doc"))


def _centred(places: DataFrame, centres: DataFrame) -> DataFrame:
    """``places`` with the centre of their window; windows of many texts are kept apart."""
    stored = durable(places)
    return spread_join(stored, centres, ["h"], "load", stored.count())


def _candidates(docs: DataFrame, k: int, min_len: int, hot_anchor: int, both: bool) -> DataFrame:
    """(ref, doc, pos_ref, pos_doc): what to stream over what, and where they share an anchor; each pair one way or ``both``."""
    met = _met(durable(extract_anchors(docs, k, min_len)))
    found = _pairs_by(met.where(F.col("n") <= hot_anchor))
    if both:
        found = found.unionByName(found.select(F.col("doc").alias("ref"), F.col("ref").alias("doc"), F.col("pos_doc").alias("pos_ref"), F.col("pos_ref").alias("pos_doc")))
    hot = met.where(F.col("n") > hot_anchor).select("doc", "pos")
    if not hot.isEmpty():
        wide = _met(durable(_windows_around(docs, hot, k, min_len))).select("h", "doc", "pos")
        found = found.unionByName(_window_candidates(wide, both))
    return found


_MERGED = "array<struct<at:int,n:int>>"


def _merge_segments(before: int, after: int):
    """Pandas UDF: positions to merged segments [pos - before, pos + after)."""

    @F.pandas_udf(_MERGED)
    def merged(lists):
        import pandas as pd

        out = []
        for places in lists:
            segments: list[list[int]] = []
            for p in sorted(places):
                lo, hi = max(0, int(p) - before), int(p) + after
                if segments and lo <= segments[-1][1]:
                    segments[-1][1] = hi
                else:
                    segments.append([lo, hi])
            out.append([{"at": lo, "n": hi - lo} for lo, hi in segments])
        return pd.Series(out)

    return merged


def _match(rows: DataFrame, min_len: int, first: bool) -> DataFrame:
    """Stream the passages of each shard over the automaton of its reference passages.

    rows (ref, salt, doc, at, seg): doc = ref are the reference passages.  Out:
    (ref, doc, start, end), in places of doc."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, passages, automaton, done = None, [], None, None
        for b in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for ref, salt, role, doc, at, seg in zip(*(c.to_pylist() for c in b.columns)):
                if (ref, salt) != key:
                    key, passages, automaton, done = (ref, salt), [], None, None
                if role == 0:
                    passages.append(seg)
                    continue
                if first and done == doc:
                    continue
                if automaton is None:
                    automaton = SuffixAutomaton(passages)
                for start, end in automaton.spans(seg, min_len, first):
                    done = doc
                    for part, x in zip(out, (ref, doc, at + start, at + end)):
                        part.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["ref", "doc", "start", "end"])

    cols = ["ref", "salt", "role", "doc", "at", "seg"]
    parted = rows.select(cols).repartition("ref", "salt").sortWithinPartitions("ref", "salt", "role", "doc", "at")
    return parted.mapInArrow(run, "ref long, doc long, start long, end long")


def _verified(docs: DataFrame, candidates: DataFrame, k: int, min_len: int, every: bool) -> DataFrame:
    """(ref, doc, start, end): spans of doc that stand in ref, for the candidates; all of them or one of each pair."""
    pairs = durable(candidates.groupBy("ref", "doc").agg(F.collect_set("pos_ref").alias("pr"), F.collect_set("pos_doc").alias("pd")))
    merged = _merge_segments(min_len - k, min_len)
    loads = durable(pairs.groupBy("ref").agg(F.count("*").alias("load"), F.ceil(F.count("*") / STREAMS_PER_TASK).cast("int").alias("salts")))
    salted = spread_join(pairs, loads, ["ref"], "load", pairs.count()).withColumn("salt", F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int"))
    streams = salted.select("ref", "salt", F.lit(1).alias("role"), "doc", merged("pd").alias("segments"))
    places = salted.select("ref", "salt", F.explode("pr").alias("p")).groupBy("ref", "salt").agg(F.collect_set("p").alias("p"))
    refs = places.select("ref", "salt", F.lit(0).alias("role"), F.col("ref").alias("doc"), merged("p").alias("segments"))
    parts = durable(streams.unionByName(refs).select("ref", "salt", "role", "doc", F.explode("segments").alias("s")).select("ref", "salt", "role", "doc", "s.at", "s.n"))
    rows = parts.hint("merge").join(_texts_of(docs, durable(parts.select("doc").distinct())), "doc").select("ref", "salt", "role", "doc", "at", F.expr("substring(text, at + 1, n)").alias("seg"))
    return _match(rows, min_len, not every)


def _prepared(documents: DataFrame, id_col: str, text_col: str, min_len: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = documents.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where(F.col("doc").isNotNull() & (F.char_length("text") >= min_len))
    copies = durable(copy_classes(docs, min_len))
    spare = durable(copies.where("doc <> rep").select("doc"))
    marked = may_be_in(docs, _hash("doc"), spare, _hash("doc"), spare.count())
    single = marked.where("NOT _may").unionByName(marked.where("_may").join(spare.hint("merge"), "doc", "left_anti")).drop("_may")
    return docs, copies, single


def _members(copies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((rep, size), (rep, block, member)): the classes of copies, their members dealt to blocks."""
    sizes = durable(copies.groupBy("rep").agg(F.count("*").alias("size")))
    stored = sizes.withColumn("load", F.col("size"))
    dealt = spread_join(copies, stored, ["rep"], "load", copies.count()).select("rep", F.pmod(_hash("doc"), F.ceil(F.col("size") / PAIR_BLOCK)).alias("block"), F.col("doc").alias("member"))
    return sizes, durable(dealt)


def _expanded(rows: DataFrame, column: str, sizes: DataFrame, members: DataFrame) -> DataFrame:
    """``rows`` once for every member of the class that ``column`` represents; members of a large class join in blocks."""
    held = rows.join(sizes.select(F.col("rep").alias(column), "size").hint("merge"), column, "left")
    alone = held.where("size IS NULL").drop("size")
    classes = held.where("size IS NOT NULL").withColumn("block", F.explode(_blocks(F.col("size")))).drop("size")
    met = classes.join(members.withColumnRenamed("rep", column).hint("merge"), [column, "block"])
    return alone.unionByName(met.withColumn(column, F.col("member")).select(alone.columns))


def shared_pairs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = MIN_LEN, k: int = ANCHOR, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: all pairs of texts that share a passage of ``min_len`` or more code points."""
    _, copies, single = _prepared(documents, id_col, text_col, min_len)
    found = durable(_verified(single, _candidates(single, k, min_len, hot_anchor, both=False), k, min_len, every=False).select(F.col("ref").alias("a"), F.col("doc").alias("b")))
    sizes, members = _members(copies)
    inside = sizes.select(F.col("rep").alias("a"), F.col("rep").alias("b"))  # a class shares its text with itself
    for side in ("a", "b"):
        found, inside = (_expanded(x, side, sizes, members) for x in (found, inside))
    return found.unionByName(inside.where("a < b")).select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b")).distinct()


def shared_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = MIN_LEN, k: int = ANCHOR, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """(doc, start, end): the merged spans of each text that also stand in another text, in passages of ``min_len`` or more."""
    docs, copies, single = _prepared(documents, id_col, text_col, min_len)
    spans = _verified(single, _candidates(single, k, min_len, hot_anchor, both=True), k, min_len, every=True).select("doc", "start", "end")
    spans = _expanded(spans, "doc", *_members(copies))
    whole = docs.select("doc", F.char_length("text").cast("long").alias("end")).join(copies.select("doc").hint("merge"), "doc", "left_semi").select("doc", F.lit(0).cast("long").alias("start"), "end")
    return merge_spans(spans.unionByName(whole))


def merge_spans(spans: DataFrame) -> DataFrame:
    """Union of overlapping or touching spans (doc, start, end) of each text."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.distinct().withColumn("fresh", F.when(F.col("start") <= reach, 0).otherwise(1))
    island = fresh.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("doc", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def shared_share(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = MIN_LEN) -> DataFrame:
    """One row per text id: its code points, those in passages that stand elsewhere too, and their share (0 for null or empty texts)."""
    held = shared_spans(documents, id_col, text_col, min_len).groupBy("doc").agg(F.sum(F.col("end") - F.col("start")).alias("shared_chars"))
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("n_chars")).where("doc_id IS NOT NULL")
    out = docs.join(held.hint("merge"), docs.doc_id == held.doc, "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0).cast("long")))
    return out.select("doc_id", "n_chars", "shared_chars", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(F.lit(0.0)).alias("shared_share"))


def remove_spans(documents: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with the given merged spans (doc, start, end) cut from the text; texts without spans stay as they are."""
    cuts = durable(spans.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cuts")))
    kept = """aggregate(_cuts, struct('' AS t, CAST(0 AS BIGINT) AS p),
              (s, c) -> struct(s.t || substring(_text, CAST(s.p + 1 AS INT), CAST(c.start - s.p AS INT)) AS t, c.end AS p),
              s -> s.t || substring(_text, CAST(s.p + 1 AS INT)))"""
    marked = may_be_in(documents, F.xxhash64(F.col(id_col).cast("long")), cuts, F.xxhash64("doc"), cuts.count(), "_cut")
    out = marked.where("_cut").withColumn("_text", F.col(text_col)).join(cuts.withColumnRenamed("doc", "_doc").hint("merge"), F.col(id_col) == F.col("_doc"), "left")
    out = out.withColumn(text_col, F.when(F.col("_cuts").isNull(), F.col("_text")).otherwise(F.expr(kept))).drop("_text", "_doc", "_cuts")
    return out.unionByName(marked.where("NOT _cut")).drop("_cut")
