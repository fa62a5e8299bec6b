"""Preference formatting: one shared prompt and two masked completions for each chosen/rejected pair.

The turns of both conversations are put in order; their longest common prefix of turns (equal role and
text) is rendered once as the prompt, and what follows on either side as a completion. A completion
carries its loss mask as spans of code points: the text and end mark of assistant turns, and nothing
else, count towards the loss.

Turns are collected once for each pair; the rest is per row. A pair is one row of the
result, so one conversation's turns must fit a row, as its rendered text must. `swapped` makes preference
pairs from plain conversations, by one join on conv_id.

Defined results: rows without conv_id belong to no pair and are left out. Turns are ordered by turn
(null last), role, text; a null role is "user", a null text empty; repeated rows are repeated turns. A
pair with one side only has an empty prompt, an empty other completion and paired = false. Equal
conversations are all prompt. Turns of any length are kept whole. "<|" inside a text is rendered "< |", so texts can't pose as marks. An
empty table gives an empty result. Other columns don't take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import table

#: One conversation in so many is rejected from its first answer on.
CUT = 5
START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED = "assistant"


def _ordered(side: str) -> Column:
    turns = F.collect_list(F.when(F.col("side") == side, F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "text")))
    return F.transform(F.sort_array(turns), lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t.role, F.lit(MIDDLE), t.text, F.lit(END))), "")


def _mask(turns: Column) -> Column:
    """Spans "start:end" of what counts towards the loss, comma-joined."""

    def add(state: Column, t: Column) -> Column:
        begin = state.at + len(START + MIDDLE) + F.char_length(t.role)
        end = begin + F.char_length(t.text) + len(END)
        span = F.array(F.concat_ws(":", begin, end))
        return F.struct(end.alias("at"), F.when(t.role == TRAINED, F.concat(state.spans, span)).otherwise(state.spans).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.array_join(F.aggregate(turns, start, add, lambda s: s.spans), ",")


def preferences(turns: DataFrame) -> DataFrame:
    """(pair_id, paired, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask).

    `turns` has pair_id, side ("chosen" or "rejected"), turn, role and text.
    """
    clean = turns.where("pair_id IS NOT NULL AND side IS NOT NULL").select(
        "pair_id", "side", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text")
    )
    pairs = clean.groupBy("pair_id").agg(_ordered("chosen").alias("a"), _ordered("rejected").alias("b"))
    both = F.least(F.size("a"), F.size("b"))
    alike = F.zip_with(F.slice("a", F.lit(1), both), F.slice("b", F.lit(1), both), lambda x, y: x == y)
    first = F.array_position(alike, False)
    pairs = pairs.withColumn("n", F.when(first > 0, (first - 1).cast("int")).otherwise(both))
    after = lambda c: F.slice(c, F.col("n") + 1, F.size(c))
    return pairs.select(
        "pair_id", (both > 0).alias("paired"), F.col("n").cast("long").alias("n_prompt_turns"), _rendered(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"),
        _rendered(after("a")).alias("chosen"), _rendered(after("b")).alias("rejected"),
        _mask(after("a")).alias("chosen_mask"), _mask(after("b")).alias("rejected_mask"),
    )


def swapped(turns: DataFrame, cut: int = CUT) -> DataFrame:
    """Preference turns (pair_id, side, turn, role, text) from conversations (conv_id, turn, role, text).

    The conversation itself is chosen. Rejected is the same one with its last assistant turn's text taken from the
    last assistant turn of conversation conv_id XOR 1 (an empty text where that has none), so the pair shares all turns before. Where conv_id is
    divisible by `cut`, the first assistant turn is replaced instead and the rejected side ends there. A
    conversation without assistant turns is rejected unchanged.
    """
    key = F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "text")
    rows = turns.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("key", key)
    answers = rows.where(F.col("role") == TRAINED).groupBy("conv_id").agg(F.min("key").alias("first"), F.max("key").alias("final"))
    other = answers.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("final.text").alias("other"))
    short = F.col("conv_id") % cut == 0
    places = answers.join(other, "conv_id", "left").select(
        "conv_id", F.when(short, F.col("first")).otherwise(F.col("final")).alias("at"), F.coalesce("other", F.lit("")).alias("other")
    )
    rows = rows.join(places, "conv_id", "left")
    kept = F.col("at").isNull() | ~short | (F.col("key") <= F.col("at"))
    replaced = F.when(F.col("key") == F.col("at"), F.col("other")).otherwise(F.col("text"))
    side = lambda name, text: F.struct(F.lit(name).alias("side"), text.alias("text"))
    sides = F.when(kept, F.array(side("chosen", F.col("text")), side("rejected", replaced))).otherwise(F.array(side("chosen", F.col("text"))))
    return rows.select("conv_id", "turn", "role", F.explode(sides).alias("s")).select(F.col("conv_id").alias("pair_id"), "s.side", "turn", "role", "s.text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with an answer of another (see `swapped`)."""
    return preferences(swapped(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


SQL = r"""
WITH clean AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'user'), coalesce(text, '')) AS nth
  FROM conversations WHERE conv_id IS NOT NULL),
ends AS (
  SELECT conv_id, min(nth) AS first_nth, max(nth) AS final_nth FROM clean WHERE role = 'assistant' GROUP BY conv_id),
answers AS (
  SELECT e.conv_id, f.turn AS first_turn, f.text AS first_text, l.turn AS final_turn, l.text AS final_text
  FROM ends e JOIN clean f ON f.conv_id = e.conv_id AND f.nth = e.first_nth JOIN clean l ON l.conv_id = e.conv_id AND l.nth = e.final_nth),
places AS (
  SELECT a.conv_id, coalesce(b.final_text, '') AS other, a.conv_id % 5 = 0 AS short,
    CASE WHEN a.conv_id % 5 = 0 THEN a.first_turn ELSE a.final_turn END AS at_turn, CASE WHEN a.conv_id % 5 = 0 THEN a.first_text ELSE a.final_text END AS at_text
  FROM answers a LEFT JOIN answers b ON b.conv_id = xor(a.conv_id, 1)),
rejects AS (
  SELECT c.conv_id, c.turn, c.role, c.nth, c.text, p.other, p.short,
    p.conv_id IS NOT NULL AND c.role = 'assistant' AND c.turn IS NOT DISTINCT FROM p.at_turn AND c.text = p.at_text AS hit
  FROM clean c LEFT JOIN places p ON p.conv_id = c.conv_id),
limits AS (
  SELECT conv_id, max(nth) FILTER (hit) AS stop FROM rejects GROUP BY conv_id),
turns AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, replace(text, '<|', '< |') AS text FROM clean
  UNION ALL
  SELECT r.conv_id, 'rejected', r.turn, r.role, replace(CASE WHEN r.hit THEN r.other ELSE r.text END, '<|', '< |')
  FROM rejects r JOIN limits l ON l.conv_id = r.conv_id WHERE NOT coalesce(r.short, false) OR r.nth <= l.stop),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS LAST, role, text) AS place FROM turns),
sizes AS (
  SELECT pair_id, CAST(count(*) FILTER (side = 'chosen') AS BIGINT) AS na, CAST(count(*) FILTER (side = 'rejected') AS BIGINT) AS nb FROM turns GROUP BY pair_id),
broken AS (
  SELECT a.pair_id, min(a.place) AS place FROM placed a JOIN placed b ON a.pair_id = b.pair_id AND a.place = b.place
  WHERE a.side = 'chosen' AND b.side = 'rejected' AND (a.role <> b.role OR a.text <> b.text) GROUP BY a.pair_id),
prompts AS (
  SELECT pair_id, na > 0 AND nb > 0 AS paired, coalesce(place - 1, least(na, nb)) AS n FROM sizes LEFT JOIN broken USING (pair_id)),
drawn AS (
  SELECT p.*, q.paired, q.n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown FROM placed p JOIN prompts q USING (pair_id)),
spanned AS (
  SELECT *, sum(length(shown)) OVER (PARTITION BY pair_id, side, place > n ORDER BY place) AS stop FROM drawn)
SELECT pair_id, any_value(paired) AS paired, CAST(any_value(n) AS BIGINT) AS n_prompt_turns,
  coalesce(string_agg(shown, '' ORDER BY place) FILTER (side = 'chosen' AND place <= n), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY place) FILTER (side = 'chosen' AND place > n), '') AS chosen,
  coalesce(string_agg(shown, '' ORDER BY place) FILTER (side = 'rejected' AND place > n), '') AS rejected,
  coalesce(string_agg((stop - length(text) - 11)::BIGINT || ':' || stop::BIGINT, ',' ORDER BY place) FILTER (side = 'chosen' AND place > n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((stop - length(text) - 11)::BIGINT || ':' || stop::BIGINT, ',' ORDER BY place) FILTER (side = 'rejected' AND place > n AND role = 'assistant'), '') AS rejected_mask
FROM spanned GROUP BY pair_id
"""
