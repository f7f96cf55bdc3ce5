"""Dialogue operators: lines to turns, turns to five-turn dialogues, speaker views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators.scan import numbered_turns


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """``speaker TAB text`` lines as columns; blank lines, rulers and lines without a tab go."""
    kept = lines.where((F.trim(line) != "") & ~F.col(line).startswith("----") & F.col(line).contains("\t"))
    parts = F.split(F.trim(line), "\t", 2)
    return kept.select(*[c for c in lines.columns if c != line], F.trim(parts[0]).alias("speaker"), F.trim(F.get(parts, F.lit(1))).alias("text"))


def _joined(utterances: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, turn, speaker, text): the utterances of a turn as one text, in order."""
    listed = utterances.groupBy(*keys, "turn").agg(F.first("speaker").alias("speaker"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.col("text").alias("t")))).alias("parts"))
    return listed.select(*keys, "turn", "speaker", F.array_join(F.transform("parts", lambda p: p["t"]), " ").alias("text"))


def merge_turns(utterances: DataFrame, group: str, order: str) -> DataFrame:
    """Runs of one speaker as turns, from 1: (group, turn, speaker, text)."""
    numbered = numbered_turns(utterances.select(group, order, "speaker", "text"), group, order)
    return _joined(numbered, [group], order)


def chunk_dialogues(utterances: DataFrame, group: str, order: str, turns: int = 5) -> DataFrame:
    """Dialogues of ``turns`` turns: (group, dialogue, turns array<struct<speaker, text>>).

    A dialogue closes with the first utterance of its last turn; the rest of that run begins the next one. What is
    left at the end of a group goes. A group of any size is folded in parallel (``scan.py``); what is collected in one
    row is a dialogue."""
    numbered = numbered_turns(utterances.select(group, order, "speaker", "text"), group, order, turns)
    listed = _joined(numbered, [group, "dialogue"], order).groupBy(group, "dialogue").agg(F.array_sort(F.collect_list(F.struct("turn", "speaker", "text"))).alias("t"))
    return listed.where(F.size("t") == turns).select(group, "dialogue", F.transform("t", lambda t: F.struct(t["speaker"].alias("speaker"), t["text"].alias("text"))).alias("turns"))


def dialogue_text(turns: Column) -> Column:
    """One line a turn, the speaker before its text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["speaker"], F.lit(": "), t["text"])), "\n")


def wide_turns(dialogues: DataFrame, n: int = 5) -> DataFrame:
    return dialogues.select(*[c for c in dialogues.columns if c != "turns"], *[F.concat(F.get("turns", F.lit(i))["speaker"], F.lit(": "), F.get("turns", F.lit(i))["text"]).alias(f"turn_{i + 1}") for i in range(n)])


def speaker_view(turns: Column, speaker: str) -> Column:
    """The texts of a speaker's turns, joined by spaces; what follows the name's first colon is kept as it is."""
    mine = F.filter(turns, lambda t: t["speaker"].startswith(f"{speaker}"))
    return F.array_join(F.transform(mine, lambda t: F.trim(F.substr(F.concat(t["speaker"], F.lit(": "), t["text"]), F.lit(len(speaker) + 2)))), " ")
