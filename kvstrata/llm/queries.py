"""Queries of the training-text operators, over whole tables and whole texts."""

from __future__ import annotations

from kvstrata.llm.mixing import checked_shares, draw, shares
from kvstrata.llm.packing import checked_assignment, fill_report, pack, read_specs, sized_documents
from kvstrata.llm.passages import remove_spans, shared_pairs, shared_share, shared_spans
from kvstrata.sources.scratch import durable
from kvstrata.sources.tables import table


def p6_assignment(spark, d):
    """Every speech in containers of every spec."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return pack(sized_documents(docs), read_specs(table(spark, d, "container_specs")))


def p6_fill(spark, d):
    """Fill per container spec."""
    return fill_report(p6_assignment(spark, d), read_specs(table(spark, d, "container_specs")))


def p6_checked(spark, d):
    """What the assignment must keep, per spec: every speech placed whole and once, cut only where it exceeds the capacity, and no container over it."""
    specs = read_specs(table(spark, d, "container_specs"))
    sized = durable(sized_documents(table(spark, d, "documents").select("doc_id", "source", "text")))
    return checked_assignment(sized, durable(pack(sized, specs)), specs)


def _sized(spark, d):
    return durable(sized_documents(table(spark, d, "documents").select("doc_id", "source", "text")).drop("cluster"))


def p7_drawn(spark, d):
    """The speeches drawn for every mix."""
    return draw(_sized(spark, d), table(spark, d, "mix_targets"))


def p7_shares(spark, d):
    """Actual shares per mix and source."""
    sized, targets = _sized(spark, d), table(spark, d, "mix_targets")
    return shares(draw(sized, targets), targets, sized)


def p7_checked(spark, d):
    """What the mixes must keep: which sources are drawn from, no speech too often, shares near their targets."""
    sized, targets = _sized(spark, d), table(spark, d, "mix_targets")
    return checked_shares(shares(draw(sized, targets), targets, sized))


def p8_found(spark, d):
    """Pairs of speeches with an identical passage of 200 or more code points."""
    return shared_pairs(table(spark, d, "documents").select("doc_id", "text"))


def p8_shared_share(spark, d):
    """Per speech: the share of its text that stands in another, too."""
    return shared_share(table(spark, d, "documents").select("doc_id", "text"))


def p8_left(spark, d):
    """Per speech: its text without the passages that stand in another, too."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return remove_spans(docs, shared_spans(docs))


QUERIES = {f.__name__: f for f in (p6_assignment, p6_fill, p6_checked, p7_drawn, p7_shares, p7_checked, p8_found, p8_shared_share, p8_left)}

_WINDOWS = """t AS (SELECT doc_id, text FROM documents WHERE length(text) >= 200),
w AS (SELECT doc_id, i, substring(text, i, 200) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM t) x),
u AS (SELECT DISTINCT doc_id, s FROM w), m AS (SELECT s FROM u GROUP BY s HAVING count(*) > 1)"""

#: Token counts, packing and draws have no SQL form: p6_checked and p7_checked compare what they must keep with what the tables ask for, tests/llm checks them against brute force.
ORACLE_SQL: dict[str, str] = {
    "p6_checked": """SELECT s.spec_name, CAST(s.capacity_tokens AS BIGINT) AS capacity_tokens, CAST(d.n AS BIGINT) AS n_docs, CAST(d.n AS BIGINT) AS n_whole, CAST(0 AS BIGINT) AS n_overfull
FROM container_specs s, (SELECT count(DISTINCT doc_id) AS n FROM documents WHERE doc_id IS NOT NULL) d WHERE s.spec_name IS NOT NULL AND s.capacity_tokens >= 1 AND d.n > 0""",
    "p7_checked": """SELECT t.mix_name, t.source, t.max_repeats, coalesce(d.n, 0) > 0 AS is_drawn, true AS within_repeats, true AS near_target
FROM mix_targets t LEFT JOIN (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL AND length(text) > 0 GROUP BY 1) d ON d.source = t.source""",
    "p8_found": f"""WITH {_WINDOWS} SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM u a JOIN m ON m.s = a.s JOIN u b ON b.s = a.s AND b.doc_id > a.doc_id""",
    "p8_shared_share": f"""WITH {_WINDOWS}, p AS (SELECT w.doc_id, w.i, lead(w.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS j FROM w JOIN m ON m.s = w.s),
c AS (SELECT doc_id, sum(least(coalesce(j - i, 200), 200)) AS n FROM p GROUP BY 1),
d AS (SELECT doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars FROM documents)
SELECT d.doc_id, d.n_chars, CAST(coalesce(c.n, 0) AS BIGINT) AS shared_chars, CASE WHEN d.n_chars > 0 THEN coalesce(c.n, 0) / d.n_chars ELSE 0.0 END AS shared_share FROM d LEFT JOIN c ON c.doc_id = d.doc_id""",
    "p8_left": f"""WITH {_WINDOWS}, p AS (SELECT w.doc_id, w.i, lead(w.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS j FROM w JOIN m ON m.s = w.s),
c AS (SELECT p.doc_id, min(i) AS first, string_agg(CASE WHEN j IS NULL THEN substring(t.text, i + 200) WHEN j > i + 200 THEN substring(t.text, i + 200, j - i - 200) ELSE '' END, '' ORDER BY i) AS rest FROM p JOIN t ON t.doc_id = p.doc_id GROUP BY 1)
SELECT d.doc_id, CASE WHEN c.doc_id IS NULL THEN d.text ELSE substring(d.text, 1, first - 1) || rest END AS text FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id""",
}
