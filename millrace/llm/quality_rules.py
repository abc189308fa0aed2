"""Quality rules: lines that many documents of a host share are boilerplate."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import doc_id, fresh, join_small, text_hash, worker, written

MAX_DOCS = 10
MIN_KEPT = 0.3


def line_frequency_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS, min_kept: float = MIN_KEPT
) -> DataFrame:
    """One row (doc_id, n_lines, n_chars, n_removed, removed_chars, removed, rejected) for each document.

    A line is normalised (lower case, runs of blanks as one, none at the ends) and hashed to 128 bits. It goes from
    all documents of a host in which more than max_docs documents have it, exact copies among them. A document is
    depleted, and rejected, when less than min_kept of its normalised characters stays. removed: the positions
    of its removed lines, ascending, comma-separated.

    Counting is an aggregate on (host, line, document), then a map-side combined one on (host, line), so a hot line costs a
    row a document, then a row a task. Only the frequent lines are joined back to their occurrences, of which just positions and lengths move.

    Blank lines aren't counted. A null text counts as empty; a document without any line is depleted. A null host
    counts as the empty one. Rows that repeat an id and its text are one document; a null id is an id, ids of another than a whole-number type are a TypeError. An empty table gives none.
    """
    return _rules(docs, id_col, text_col, host_col, max_docs, min_kept).drop("host", "th")


def _rules(docs: DataFrame, id_col: str, text_col: str, host_col: str, max_docs: int, min_kept: float) -> DataFrame:
    d = docs.select(doc_id(docs, id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), text_hash(text_col).alias("th"))
    lines = d.select("doc_id", "host", "th", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    lines = lines.select("doc_id", "host", "th", "pos", F.trim(F.regexp_replace(F.lower("raw"), "[ \t\r]+", " ")).alias("line")).where("line != ''")
    lines = lines.select("doc_id", "host", "th", "pos", F.length("line").alias("n"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), F.col("line")).alias("h2"))
    hot = lines.select("host", "h1", "h2", "doc_id", "th").distinct().groupBy("host", "h1", "h2").agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs).drop("docs")
    gone = lines.join(hot, ["host", "h1", "h2"]).groupBy("host", "doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("pos", "n"))).alias("gone"))
    gone = gone.select("host", "doc_id", "th", F.transform("gone", lambda g: g["pos"]).alias("removed"), F.aggregate("gone", F.lit(0).cast("long"), lambda a, g: a + g["n"]).alias("removed_chars"))
    whole = F.filter(F.transform(F.split("text", "\n"), lambda x: F.length(F.trim(F.regexp_replace(F.lower(x), "[ \t\r]+", " ")))), lambda n: n > 0)
    base = d.select("doc_id", "host", "th", whole.alias("w")).select("doc_id", "host", "th", F.size("w").alias("n_lines"), F.aggregate("w", F.lit(0).cast("long"), lambda a, n: a + n).alias("n_chars"))
    base = base.groupBy("host", "doc_id", "th").agg(F.first("n_lines").alias("n_lines"), F.first("n_chars").alias("n_chars"))
    same = [base[c].eqNullSafe(gone[c]) for c in ("host", "doc_id", "th")]
    removed = F.coalesce(gone["removed_chars"], F.lit(0).cast("long"))
    return base.join(gone, same, "left").select(
        base["host"], base["th"], base["doc_id"], base["n_lines"], base["n_chars"],
        F.coalesce(F.size(gone["removed"]), F.lit(0)).alias("n_removed"), removed.alias("removed_chars"),
        F.coalesce(F.array_join(gone["removed"].cast("array<string>"), ","), F.lit("")).alias("removed"),
        (((base["n_chars"] - removed).cast("double") < F.lit(float(min_kept)) * base["n_chars"].cast("double")) | (base["n_chars"] == 0)).alias("rejected"),
    )


def _cutter(text: str, column: str):
    def cut(batches):
        for b in batches:
            at = b.schema.get_field_index(text)
            new = []
            for t, removed in zip(b.column(at).to_pylist(), b.column(column).to_pylist()):
                if t is not None and removed:
                    gone = set(map(int, removed.split(",")))
                    t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
                new.append(t)
            yield b.set_column(at, b.schema.field(text), pa.array(new, b.schema.field(text).type)).drop_columns([column])

    return cut


def clean_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS, min_kept: float = MIN_KEPT
) -> DataFrame:
    """docs, all columns of any name, without the lines that line_frequency_rules removes and the documents that it rejects (those without any line are)."""
    doc, th, host, removed, key, own = fresh(docs, "__doc", "__th", "__host", "__removed", "__key", "__own")
    rules = _rules(docs, id_col, text_col, host_col, max_docs, min_kept).where("rejected OR n_removed > 0")
    rules = written(rules.select(F.col("doc_id").alias(doc), F.col("th").alias(th), F.col("host").alias(host), F.when(F.col("rejected"), F.lit("all")).otherwise(F.col("removed")).alias(removed)))
    keyed = docs.withColumns({key: text_hash(text_col), own: F.coalesce(F.col(host_col).cast("string"), F.lit(""))})
    joined = join_small(keyed, rules, F.col(id_col).eqNullSafe(F.col(doc)) & (F.col(key) == F.col(th)) & (F.col(own) == F.col(host)), "left").drop(doc, th, host, key, own)
    return joined.where(F.coalesce(F.col(removed), F.lit("")) != "all").transform(worker, _cutter(text_col, removed), docs.schema)


ORACLE = f"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS host, text, u.i - 1 AS pos,
    trim(regexp_replace(lower(string_split(coalesce(text, ''), chr(10))[u.i]), '[ \\t\\r]+', ' ', 'g'), ' ') AS line
  FROM documents, LATERAL (SELECT unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i) u
), hot AS (
  SELECT host, line FROM l WHERE line != '' GROUP BY host, line HAVING count(DISTINCT doc_id) + max(CAST(doc_id IS NULL AS INTEGER)) > {MAX_DOCS}
), m AS (
  SELECT l.doc_id, l.pos, length(l.line) AS n, hot.line IS NOT NULL AS gone FROM l LEFT JOIN hot ON l.host = hot.host AND l.line = hot.line
)
SELECT doc_id, CAST(count(*) FILTER (WHERE n > 0) AS INTEGER) AS n_lines, CAST(sum(n) AS BIGINT) AS n_chars, CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS n_removed,
  CAST(coalesce(sum(n) FILTER (WHERE gone), 0) AS BIGINT) AS removed_chars, coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE gone), '') AS removed,
  CAST(coalesce(sum(n) FILTER (WHERE NOT gone), 0) AS DOUBLE) < CAST({MIN_KEPT} AS DOUBLE) * CAST(sum(n) AS DOUBLE) OR sum(n) = 0 AS rejected
FROM m GROUP BY doc_id
"""
