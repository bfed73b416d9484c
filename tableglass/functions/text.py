"""Tags of one text as column expressions. Everything is a built-in function of the text column,
so tagging a table is a projection: no shuffle, whatever the size."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tableglass.functions import words


def normalized(text: Column) -> Column:
    """Lower case, everything but letters, digits and underscores as single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\W+", " "))


def normalized_name(name: str) -> str:
    """The same for a column name known while the query is written."""
    return " ".join(re.sub(r"[^\w\s]", " ", name.lower()).split())


def hits(text: Column, keywords: Sequence[str]) -> Column:
    """How many of the words occur in the text, as substrings."""
    return sum((text.contains(w).cast("int") for w in keywords), F.lit(0))


def any_hit(text: Column, keywords: Sequence[str]) -> Column:
    """Whether one of the words occurs; stops at the first that does."""
    found = F.lit(False)
    for w in keywords:
        found = found | text.contains(w)
    return found


def intent_scores(text: Column) -> list[Column]:
    """One score per intent, in their order, of a normalised text."""
    return [hits(text, w) for w in words.INTENT_WORDS.values()]


def best_intent(scores: Sequence[Column]) -> Column:
    """The intent with the highest score, the earlier one on ties; unknown if all are 0."""
    best = F.greatest(*scores)
    choice = F.when(best == 0, words.UNKNOWN)
    for intent, score in zip(words.INTENT_WORDS, scores):
        choice = choice.when(score == best, intent)
    return choice.otherwise(words.UNKNOWN)


def intent_confidence(scores: Sequence[Column]) -> Column:
    total = sum(scores[1:], scores[0])
    return F.coalesce(F.try_divide(F.greatest(*scores).cast("double"), total.cast("double")), F.lit(0.0))


def action(text: Column, intent: Column) -> Column:
    """The first action of the intent with a synonym in the normalised text; unknown if none."""
    choice = None
    for name, actions in words.INTENT_ACTIONS.items():
        of_intent = None
        for a in actions:
            found = any_hit(text, words.SYNONYMS[a])
            of_intent = F.when(found, a) if of_intent is None else of_intent.when(found, a)
        condition, result = intent == name, of_intent.otherwise(words.UNKNOWN)
        choice = F.when(condition, result) if choice is None else choice.when(condition, result)
    return choice.otherwise(words.UNKNOWN)


def group_words(text: Column) -> Column:
    """Array with the word after each grouping phrase of the raw text, empty where there is none."""
    return F.array(*[F.lower(F.regexp_extract(text, "(?iU)" + p, 1)) for p in words.GROUP_PATTERNS])


def group_column(found: Column, columns: Sequence[str]) -> Column:
    """The first of the columns whose name holds the word of the first phrase that fits one."""
    choice = F.when(F.lit(False), F.lit(None).cast("string"))
    for i in range(len(words.GROUP_PATTERNS)):
        word = found.getItem(i)
        for c in columns:
            choice = choice.when((word != "") & F.contains(F.lit(normalized_name(c)), word), c)
    return choice


def filter_phrases(text: Column) -> Column:
    """Array of (operator, value, value_min, value_max) for all comparisons named in the raw text."""
    none = F.lit(None).cast("double")

    def compared(operator: str):
        return lambda v: F.struct(F.lit(operator).alias("operator"), v.alias("value"),
                                  none.alias("value_min"), none.alias("value_max"))
    parts = [
        F.transform(F.regexp_extract_all(text, F.lit("(?iU)" + pattern), F.lit(2)), compared(operator))
        for pattern, operator in words.COMPARISON_PATTERNS
    ]
    low = F.regexp_extract_all(text, F.lit("(?iU)" + words.RANGE_PATTERN), F.lit(1))
    high = F.regexp_extract_all(text, F.lit("(?iU)" + words.RANGE_PATTERN), F.lit(2))
    parts.append(F.zip_with(low, high, lambda a, b: F.struct(
        F.lit("between").alias("operator"), F.lit(None).cast("string").alias("value"),
        a.try_cast("double").alias("value_min"), b.try_cast("double").alias("value_max"))))
    return F.concat(*parts)


def trigger_words(name: str) -> list[str]:
    """The words that stand for the column through a synonym group the name belongs to."""
    norm = normalized_name(name)
    related = [group for key, group in words.SYNONYMS.items() if any(s in norm for s in [key, *group])]
    return sorted({w for group in related for w in group})


def telling_words(columns: Sequence[str]) -> list[str]:
    """The words that can make a text name one of the columns: their own and their triggers."""
    return sorted({w for c in columns for w in [*normalized_name(c).split(), *trigger_words(c)]})


def mention_score(text: Column, length: Column, telling: Column, name: str) -> Column:
    """How strongly a text names the column; 0 for not at all.

    ``text`` is normalised, ``length`` the number of its distinct words, ``telling`` those of them
    that can matter for any column, so that a long text is searched for words only once.
    """
    norm = normalized_name(name)
    own = sorted(set(norm.split()))
    triggers = trigger_words(name)

    def listed(ws: Sequence[str]) -> Column:
        return F.array(*[F.lit(w) for w in ws])
    score = F.when(text == norm, F.lit(words.SAME)).when(text.contains(norm), F.lit(words.CONTAINED))
    if own:
        common = F.size(F.array_intersect(telling, listed(own)))
        score = score.when(F.arrays_overlap(telling, listed(own)),
                           common / F.greatest(length, F.lit(len(own))) * F.lit(words.SHARED_WORDS))
    if triggers:
        score = score.when(F.arrays_overlap(telling, listed(triggers)), F.lit(words.SYNONYM))
    return score.otherwise(F.lit(0.0))
