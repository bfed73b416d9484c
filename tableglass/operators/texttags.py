"""Tagging tables of texts with intents, actions, groups, filters and the columns they name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableglass.functions import text, words
from tableglass.functions.columns import raw


def normalize_text(df: DataFrame, column: str, to: str = "normalized") -> DataFrame:
    """Adds the normalised text."""
    return df.withColumn(to, text.normalized(raw(column)))


def with_scores(df: DataFrame, column: str) -> tuple[DataFrame, list[Column]]:
    """The table with its normalised text and one column per intent score, and those columns.

    Kept as columns of their own, each is computed once however often it is used.
    """
    normal = df.withColumn("_text", text.normalized(raw(column)))
    scores = text.intent_scores(F.col("_text"))
    named = [f"_intent{i}" for i in range(len(scores))]
    return normal.select("*", *[s.alias(n) for s, n in zip(scores, named)]), [F.col(n) for n in named]


def tag_intent(df: DataFrame, column: str) -> DataFrame:
    """Adds intent and intent_confidence (the share of the best intent in all scores)."""
    scored, scores = with_scores(df, column)
    return scored.select(*[raw(c) for c in df.columns], text.best_intent(scores).alias("intent"),
                         text.intent_confidence(scores).alias("intent_confidence"))


def tag_action(df: DataFrame, column: str) -> DataFrame:
    """Adds intent and action."""
    kept = [raw(c) for c in df.columns]
    scored, scores = with_scores(df, column)
    chosen = scored.select(*kept, "_text", text.best_intent(scores).alias("intent"))
    return chosen.select(*kept, "intent", text.action(F.col("_text"), F.col("intent")).alias("action"))


def extract_group_phrase(df: DataFrame, column: str, columns: Sequence[str]) -> DataFrame:
    """Adds group_column: the one of ``columns`` named in a phrase like "par X" or "group by X"."""
    found = df.withColumn("_words", text.group_words(raw(column)))
    return found.withColumn("group_column", text.group_column(F.col("_words"), columns)).drop("_words")


def extract_filter_phrases(df: DataFrame, column: str) -> DataFrame:
    """The rows with operator, value, value_min and value_max: one row per comparison found."""
    return df.select("*", F.inline(text.filter_phrases(raw(column))))


def rank_column_mentions(df: DataFrame, column: str, columns: Sequence[str]) -> DataFrame:
    """The rows with target, score, place and confidence: one row per column kept, at most two.

    Kept are the columns that score at least 0.7 of the best; the confidence is the mean of the
    intent's and the best column's.
    """
    kept = [raw(c) for c in df.columns]
    normal, intents = with_scores(df, column)
    tokens = normal.select(*kept, "_text", text.intent_confidence(intents).alias("_intent"),
                           F.array_distinct(F.split("_text", " ")).alias("_tokens"))
    telling = F.array(*[F.lit(w) for w in text.telling_words(columns)]).cast("array<string>")
    looked_up = tokens.select(*kept, "_text", "_intent", F.size("_tokens").alias("_length"),
                              F.array_intersect("_tokens", telling).alias("_telling"))
    scores = [F.col(f"_score{i}") for i in range(len(columns))]
    scored = looked_up.select(*kept, "_intent", *[
        text.mention_score(F.col("_text"), F.col("_length"), F.col("_telling"), c).alias(f"_score{i}")
        for i, c in enumerate(columns)])
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    ranked = scored.select(*kept, "_intent", best.alias("_best"), *scores)
    named = F.array_compact(F.array(*[
        F.when((s > 0) & (s >= F.col("_best") * words.KEPT_OF_BEST),
               F.struct((-s).alias("order"), F.lit(i).alias("spot"), F.lit(c).alias("target")))
        for i, (s, c) in enumerate(zip(scores, columns))]))
    # best first, ties in the order of the names
    first = F.slice(F.sort_array(named), 1, words.KEPT_COLUMNS)
    placed = ranked.select(*kept, ((F.col("_intent") + F.col("_best")) / 2.0).alias("confidence"),
                           F.posexplode(first).alias("_at", "_kept"))
    return placed.select(*kept, F.col("_kept.target").alias("target"), (-F.col("_kept.order")).alias("score"),
                         (F.col("_at") + 1).alias("place"), "confidence")
