"""Chat formatting: preference pairs with a shared prompt and masked completions.

All in DataFrame functions: one shuffle gathers a pair's turns, the rest are
array expressions. A pair's turns become one row, as its rendered text must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is rendered, and whose text is learned.
HEAD, TAIL, LEARNED = ("<|", "|>\n"), "<|end|>\n", "assistant"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(HEAD[0]), turn["role"], F.lit(HEAD[1]))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(TAIL))), "")


def mask(turns: Column) -> Column:
    """Runs ``bit:characters`` of a rendering: 1 for text and end mark of learned turns, 0 for the rest."""

    def runs(t: Column) -> Column:
        head, body = F.length(_head(t)), F.length(t["text"]) + len(TAIL)
        return F.when(t["role"] == LEARNED, F.concat(F.lit("0:"), head, F.lit(",1:"), body)).otherwise(F.concat(F.lit("0:"), head + body))

    return F.array_join(F.transform(turns, runs), ",")


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading turns of two arrays agree in role and text."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, n).cast("int")


def preference_pairs(turns: DataFrame) -> DataFrame:
    """From ``(pair, chosen, turn, role, text)`` rows, with chosen a boolean, one row for each pair.

    The longest common prefix of turns is the prompt, and each side's other turns
    its completion. A null role or text counts as empty. Turns go by number, then
    role and text; repeated rows are repeated turns. A side without turns has a
    null completion and mask, and the prompt is then empty. Rows without a pair
    or side belong to no pair and are left out.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.where(F.col("pair").isNotNull() & F.col("chosen").isNotNull())
    sides = rows.groupBy("pair").agg(*[F.sort_array(F.collect_list(F.when(F.col("chosen") == side, turn))).alias(name) for name, side in (("a", True), ("b", False))])
    both = sides.withColumn("n", common_prefix(F.col("a"), F.col("b")))
    rest = lambda c: F.when(F.size(c) > 0, F.slice(F.col(c), F.col("n") + 1, F.greatest(F.size(c), F.lit(1))))
    return both.select(
        "pair",
        F.col("n").alias("n_prompt_turns"),
        rendered(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"),
        rendered(rest("a")).alias("chosen"),
        mask(rest("a")).alias("chosen_mask"),
        rendered(rest("b")).alias("rejected"),
        mask(rest("b")).alias("rejected_mask"),
    )


PAIRS_SQL = """
WITH t AS (SELECT conv_id // 2 AS pair, conv_id % 2 AS side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT pair,
    coalesce(list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE side = 0), []) AS a,
    coalesce(list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE side = 1), []) AS b FROM t GROUP BY pair),
p AS (SELECT *, coalesce(nullif(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i].role = b[i].role AND a[i].text = b[i].text), false), 0) - 1, least(len(a), len(b)))::INT AS n FROM g)
SELECT pair, n AS n_prompt_turns,
    coalesce(array_to_string(list_transform(a[1:n], lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), ''), '') AS prompt,
    CASE WHEN len(a) > 0 THEN coalesce(array_to_string(list_transform(a[n+1:], lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), ''), '') END AS chosen,
    CASE WHEN len(a) > 0 THEN coalesce(array_to_string(list_transform(a[n+1:], lambda x: CASE WHEN x.role = 'assistant' THEN '0:' || (length(x.role) + 5) || ',1:' || (length(x.text) + 8) ELSE '0:' || (length(x.role) + length(x.text) + 13) END), ','), '') END AS chosen_mask,
    CASE WHEN len(b) > 0 THEN coalesce(array_to_string(list_transform(b[n+1:], lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), ''), '') END AS rejected,
    CASE WHEN len(b) > 0 THEN coalesce(array_to_string(list_transform(b[n+1:], lambda x: CASE WHEN x.role = 'assistant' THEN '0:' || (length(x.role) + 5) || ',1:' || (length(x.text) + 8) ELSE '0:' || (length(x.role) + length(x.text) + 13) END), ','), '') END AS rejected_mask
FROM p
"""
