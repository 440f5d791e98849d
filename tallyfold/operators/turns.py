"""Conversation tables: merged turns, transcript tails, contextual queries, intents.

A conversation may be arbitrarily long. Running state therefore goes through bounded chunks of the turn
order, and look-back through fixed-size blocks that also hold the few turns before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.text import clip_text, one_line, strip
from tallyfold.plans.ordering import BLOCK, HALO, POSITION, carried, running_sum, with_blocks, with_position
from tallyfold.plans.scale import DEFAULT, Scale, row_count

# How much of a conversation is looked at.
TAIL_TEXT = 600
CONTEXT_TURNS = 8
CONTEXT_TEXT = 320
SHORT_MESSAGE = 100
SUBSTANTIVE = 15
BLOCK_TURNS = 10_000

# Patterns of chart requests, comparisons and relation questions.
CHART_REQUEST = (
    r"(?i)\b("
    r"chart|charts|graph|graphs|graphique|graphiques|graphe|graphes|"
    r"visuali[sz]e?|visuali[sz]ation|plot|plots|draw|diagram|figure|"
    r"affich(?:e|er).*graph|montre.*graph|show.*chart|generate.*graph"
    r")\b"
)
COMPARISON = r"(?i)\b(difference|compare|comparison|between|vs\.?|versus|by month|monthly|trend|over time)\b"
RELATION = r"(?i)\b(correlat|affect|impact|improve|relate|wonder if|cut.*hour|cause|between)\b"


def merge_turns(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", scale: Scale = DEFAULT) -> DataFrame:
    """Neighbouring turns of one role become one turn, texts joined by an empty line."""
    rows = row_count(df)
    with_previous = carried(
        df, {"_previous": F.col("role")}, [turn], rows, [conversation], scale, include_current=False
    )
    starts = (~F.col("role").eqNullSafe(F.col("_previous"))).cast("int")
    # Starts before the row plus its own: the number of the island it belongs to.
    started = with_previous.withColumn("_start", starts)
    numbered = running_sum(started, [conversation], [turn], F.col("_start"), rows, "_before", scale)
    text = F.coalesce(F.nullif(strip(F.coalesce("text", F.lit(""))), F.lit("")), F.lit("(empty message)"))
    island = F.col("_before") + F.col("_start")
    grouped = (
        numbered.withColumn("_island", island)
        .groupBy(conversation, "_island")
        .agg(
            F.min(turn).alias("first_turn"),
            F.first("role").alias("role"),
            F.count(F.lit(1)).alias("turns"),
            F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), text.alias("x")))).alias("_parts"),
        )
    )
    joined = F.array_join(F.transform("_parts", lambda p: p["x"]), "\n\n")
    return grouped.select(conversation, "first_turn", "role", "turns", joined.alias("text"))


def transcript_tail(
    df: DataFrame, max_turns: int, conversation: str = "conv_id", turn: str = "turn"
) -> DataFrame:
    """Last turns per conversation as lines, oldest first. The rank limit also runs before the shuffle."""
    newest = Window.partitionBy(conversation).orderBy(F.desc(turn))
    kept = df.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= max_turns)
    line = F.concat("role", F.lit(": "), clip_text(one_line(F.coalesce("text", F.lit(""))), TAIL_TEXT))
    return (
        kept.groupBy(conversation)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), line.alias("x")))).alias("_lines"))
        .select(conversation, F.array_join(F.transform("_lines", lambda p: p["x"]), "\n").alias("transcript"))
    )


def contextual_query(
    df: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    block_turns: int = BLOCK_TURNS,
    scale: Scale = DEFAULT,
) -> DataFrame:
    """Search text of every user turn: short messages get the eight turns before them in front."""
    rows = row_count(df)
    placed = with_position(df, [turn], rows, [conversation], scale)
    spread = with_blocks(placed, block_turns, before=CONTEXT_TURNS)
    before = Window.partitionBy(conversation, BLOCK).orderBy(POSITION).rowsBetween(-CONTEXT_TURNS, -1)
    line = F.concat("role", F.lit(": "), clip_text(one_line(F.coalesce("text", F.lit(""))), CONTEXT_TEXT))
    message = strip(F.coalesce("text", F.lit("")))
    looked = spread.withColumn("_history", F.collect_list(line).over(before)).filter(
        ~F.col(HALO) & (F.col("role") == "user")
    )
    alone = (F.length(message) >= SHORT_MESSAGE) | (F.size("_history") == 0)
    query = F.when(alone, message).otherwise(
        F.array_join(F.concat(F.col("_history"), F.array(F.concat(F.lit("user: "), message))), "\n")
    )
    return looked.select(conversation, turn, query.alias("query"))


def intent_flags(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds whether a text asks for a chart, a comparison, or a relation."""
    cell = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns(
        {
            "wants_chart": cell.rlike(CHART_REQUEST),
            "compares": cell.rlike(COMPARISON),
            "asks_relation": cell.rlike(RELATION),
        }
    )


def last_question(
    df: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    chart_request: Column | None = None,
    scale: Scale = DEFAULT,
) -> DataFrame:
    """Per user turn the question it stands for: chart requests refer to the last real question before them."""
    text = strip(F.coalesce("text", F.lit("")))
    asks_chart = F.col("text").rlike(CHART_REQUEST) if chart_request is None else chart_request
    flagged = df.withColumn("_chart", F.coalesce(asks_chart, F.lit(False)))
    real = F.when((F.col("role") == "user") & (F.length(text) > SUBSTANTIVE) & ~F.col("_chart"), text)
    rows = row_count(df)
    found = carried(flagged, {"_question": real}, [turn], rows, [conversation], scale, include_current=False)
    question = F.when(F.col("_chart"), F.coalesce("_question", "text")).otherwise(F.col("text"))
    return found.filter("role = 'user'").select(conversation, turn, question.alias("question"))
