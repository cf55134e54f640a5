"""Preference formatting: the longest common turn prefix once, and a masked completion for each side.

A pair has two conversations, chosen and rejected.  Turns are compared by their position after ordering by
turn number; equal means the same role and the same text.  The sides are joined turn by turn, the end of the
common prefix is the least position that differs, and each turn is rendered once: as prompt while it is
common, else as completion of its side.  No conversation is gathered to find the prefix; only the final strings
of a pair are, which are the result itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm import common

#: Fixed values of the rendering.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def rendered(role: F.Column, text: F.Column) -> F.Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit(MIDDLE), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def format_preferences(turns: DataFrame) -> DataFrame:
    """One row per pair from turns of (pair_id, side, turn, role, text), side being chosen or rejected.

    Returns pair_id, n_common (turns of the prompt), n_chosen, n_rejected (turns after it), prompt, chosen,
    rejected, and for each completion the mask: (start, end) character spans that are trained on, which are the
    texts of assistant turns with their closing mark.

    A null text or role is rendered as empty and equals only another null of its kind.  Repeated turn numbers
    are ordered by role and text.  A pair with one side missing has an empty prompt, an empty other side and
    that side's whole conversation.  Pairs with null pair_id and turns of any other side are left out.  Empty
    input gives no rows.  Other columns are not read.
    """
    order = Window.partitionBy("pair_id", "side").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    given = turns.select("pair_id", "side", "turn", "role", "text").filter("pair_id IS NOT NULL AND side IN ('chosen', 'rejected')")
    placed = given.withColumn("at", F.row_number().over(order) - 1)
    met = placed.groupBy("pair_id", "at").agg(
        *(F.max(F.when(F.col("side") == s, F.struct("role", "text"))).alias(s) for s in ("chosen", "rejected"))
    )
    equal = F.col("chosen").isNotNull() & F.col("rejected").isNotNull() & F.col("chosen.role").eqNullSafe(F.col("rejected.role")) & F.col("chosen.text").eqNullSafe(F.col("rejected.text"))
    parts = met.withColumn("end", F.min(F.when(~equal, F.col("at"))).over(Window.partitionBy("pair_id")))
    common_turn = F.coalesce(F.col("at") < F.col("end"), F.lit(True))

    def piece(side: str, when: F.Column) -> F.Column:
        return F.when(when & F.col(side).isNotNull(), F.struct("at", rendered(F.col(f"{side}.role"), F.col(f"{side}.text")).alias("s"), (F.coalesce(F.col(f"{side}.role"), F.lit("")) == "assistant").alias("m"), F.length(F.concat(F.lit(OPEN), F.coalesce(F.col(f"{side}.role"), F.lit("")), F.lit(MIDDLE))).alias("skip")))

    lists = parts.groupBy("pair_id").agg(
        F.array_sort(F.collect_list(piece("chosen", common_turn))).alias("p"),
        F.array_sort(F.collect_list(piece("chosen", ~common_turn))).alias("c"),
        F.array_sort(F.collect_list(piece("rejected", ~common_turn))).alias("r"),
    )

    def joined(name: str) -> F.Column:
        return F.array_join(F.transform(name, lambda x: x["s"]), "")

    def mask(name: str) -> F.Column:
        start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("spans"))

        def step(a: F.Column, x: F.Column) -> F.Column:
            end = a["at"] + F.length(x["s"])
            span = F.struct((a["at"] + x["skip"]).alias("start"), (end - 1).alias("end"))
            return F.struct(end.alias("at"), F.when(x["m"], F.array_append(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

        return F.aggregate(name, start, step)["spans"]

    return lists.select(
        "pair_id", F.size("p").alias("n_common"), F.size("c").alias("n_chosen"), F.size("r").alias("n_rejected"),
        joined("p").alias("prompt"), joined("c").alias("chosen"), joined("r").alias("rejected"),
        mask("c").alias("chosen_mask"), mask("r").alias("rejected_mask"),
    )


def paired(conversations: DataFrame) -> DataFrame:
    """The pairs of the query: conversations 2k (chosen) and 2k + 1 (rejected) are one pair."""
    return conversations.select(
        F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"),
        F.when(F.col("conv_id") % 2 == 0, "chosen").otherwise("rejected").alias("side"), "turn", "role", "text",
    )


def op6(spark, sf_dir: str) -> DataFrame:
    out = format_preferences(paired(common.read(spark, sf_dir, "conversations")))
    text = [F.concat_ws(",", F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string")))).alias(c) for c in ("chosen_mask", "rejected_mask")]
    return out.select(*[c for c in out.columns if not c.endswith("_mask")], *text)


SQL = r"""
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
same AS (
  SELECT pair_id, pos, count(*) = 2 AND count(DISTINCT side) = 2
         AND min(coalesce('1' || role, '0')) = max(coalesce('1' || role, '0'))
         AND min(coalesce('1' || text, '0')) = max(coalesce('1' || text, '0')) AS eq
  FROM t GROUP BY pair_id, pos),
ends AS (SELECT pair_id, coalesce(min(pos) FILTER (WHERE NOT eq), max(pos) + 1) AS fin FROM same GROUP BY pair_id),
r AS (
  SELECT t.pair_id, side, pos, fin, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS s,
         length('<|im_start|>' || coalesce(role, '') || chr(10)) AS skip, coalesce(role, '') = 'assistant' AS m
  FROM t JOIN ends USING (pair_id)),
o AS (
  SELECT *, sum(length(s)) OVER (PARTITION BY pair_id, side, pos >= fin ORDER BY pos) AS upto FROM r)
SELECT pair_id,
       (count(*) FILTER (WHERE side = 0 AND pos < fin))::INTEGER AS n_common,
       (count(*) FILTER (WHERE side = 0 AND pos >= fin))::INTEGER AS n_chosen,
       (count(*) FILTER (WHERE side = 1 AND pos >= fin))::INTEGER AS n_rejected,
       coalesce(string_agg(s, '' ORDER BY pos) FILTER (WHERE side = 0 AND pos < fin), '') AS prompt,
       coalesce(string_agg(s, '' ORDER BY pos) FILTER (WHERE side = 0 AND pos >= fin), '') AS chosen,
       coalesce(string_agg(s, '' ORDER BY pos) FILTER (WHERE side = 1 AND pos >= fin), '') AS rejected,
       coalesce(string_agg((upto - length(s) + skip) || '-' || (upto - 1), ',' ORDER BY pos) FILTER (WHERE side = 0 AND pos >= fin AND m), '') AS chosen_mask,
       coalesce(string_agg((upto - length(s) + skip) || '-' || (upto - 1), ',' ORDER BY pos) FILTER (WHERE side = 1 AND pos >= fin AND m), '') AS rejected_mask
FROM o GROUP BY pair_id
"""
