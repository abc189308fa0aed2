"""Chat formatting: each participant of a dialogue in turn as the assistant."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row (conv_id, participant, n_turns, n_loss_turns, rendered, loss_spans) for each conversation and participant.

    Participants are the roles but for system. In a participant's view its turns are the assistant's, those of others
    are a named user's, system turns stay the system's. loss_spans: half-open ranges of characters (code points) of rendered that
    are to be learnt, the assistant's contents with their end marks, as "start:end;start:end".

    Turns are in the order of turn (nulls last), then role and text. A null role is "unknown", a null text empty. "<|"
    in texts and names is written "< |", so that no content can forge a mark. Repeated rows are repeated turns. A null
    conv_id is a conversation. A conversation with system turns only gives no row; an empty table gives none. Other
    columns are not read. One aggregate by conversation, no join.
    """
    safe = lambda c, null: F.replace(F.coalesce(F.col(c).cast("string"), F.lit(null)), F.lit("<|"), F.lit("< |"))
    t = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).isNull().alias("last"), F.col(turn_col).alias("turn"), safe(role_col, "unknown").alias("role"), safe(text_col, "").alias("text")).alias("t"))
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    g = g.select("conv_id", "ts", F.explode(F.array_distinct(F.filter(F.transform("ts", lambda x: x["role"]), lambda r: r != "system"))).alias("participant"))
    mine = lambda x: x["role"] == F.col("participant")
    head = lambda x: F.when(x["role"] == "system", F.lit("<|system|>\n")).when(mine(x), F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), x["role"], F.lit("|>\n")))
    g = g.withColumn("parts", F.transform("ts", lambda x: F.struct(head(x).alias("head"), F.concat(x["text"], F.lit("<|end|>\n")).alias("body"), mine(x).alias("mine"))))
    step = lambda a, p: F.struct(
        (a["at"] + F.length(p["head"]) + F.length(p["body"])).alias("at"),
        F.when(p["mine"], F.concat(a["spans"], F.array(F.concat((a["at"] + F.length(p["head"])).cast("string"), F.lit(":"), (a["at"] + F.length(p["head"]) + F.length(p["body"]) - 1).cast("string"))))).otherwise(a["spans"]).alias("spans"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return g.select(
        "conv_id", "participant", F.size("parts").alias("n_turns"), F.size(F.filter("parts", lambda p: p["mine"])).alias("n_loss_turns"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"),
        F.array_join(F.aggregate("parts", zero, step)["spans"], ";").alias("loss_spans"),
    )


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS k FROM t
), p AS (
  SELECT DISTINCT conv_id, role AS participant FROM t WHERE role != 'system'
), r AS (
  SELECT n.conv_id, p.participant, n.k, n.role = p.participant AS mine,
    CASE WHEN n.role = 'system' THEN '<|system|>' WHEN n.role = p.participant THEN '<|assistant|>' ELSE '<|user name=' || n.role || '|>' END || chr(10) AS head,
    n.text || '<|end|>' || chr(10) AS body
  FROM n JOIN p ON n.conv_id = p.conv_id
), o AS (
  SELECT *, CAST(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, participant ORDER BY k) AS BIGINT) AS stop FROM r
)
SELECT conv_id, participant, CAST(count(*) AS INTEGER) AS n_turns, CAST(count(*) FILTER (WHERE mine) AS INTEGER) AS n_loss_turns, string_agg(head || body, '' ORDER BY k) AS rendered,
  string_agg(CASE WHEN mine THEN CAST(stop - length(body) AS VARCHAR) || ':' || CAST(stop - 1 AS VARCHAR) END, ';' ORDER BY k) AS loss_spans
FROM o GROUP BY conv_id, participant
"""
