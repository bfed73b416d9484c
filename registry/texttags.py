"""Text tagging, over all conversations and documents."""

from pyspark.sql import functions as F

from registry import rounded, table
from tableglass.functions import words
from tableglass.functions.text import normalized_name, trigger_words
from tableglass.operators import texttags

# column names as a table of people, sales and texts might have them
NAMES = ["total_price", "type", "user", "average rating", "text", "line count", "mean_value", "est"]
TURN = ["conv_id", "turn"]


def turns(s, d):
    return table(s, d, "conversations").select(*TURN, "text")


def documents(s, d):
    return table(s, d, "documents").select("doc_id", "text")


def tagged(s, d, tag, *kept):
    """conversations and documents tagged alike: (id, turn, tags)."""
    a = turns(s, d).select(F.col("conv_id").alias("id"), "turn", "text")
    b = documents(s, d).select(F.col("doc_id").alias("id"), F.lit(-1).cast("bigint").alias("turn"), "text")
    return tag(a.unionAll(b)).select("id", "turn", *kept)


BOTH = """(SELECT conv_id AS id, turn, text FROM conversations UNION ALL SELECT doc_id, CAST(-1 AS BIGINT), text FROM documents)"""
NORMAL = r"""trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{Nd}\p{Pc}\s]', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g'))"""
TEXTS = f"(SELECT id, turn, text, {NORMAL} AS norm FROM {BOTH})"


def quoted(w):
    return "'" + w.replace("'", "''") + "'"


def hits(ws):
    return "(" + " + ".join(f"CAST(contains(norm, {quoted(w)}) AS INTEGER)" for w in ws) + ")"


INTENTS = list(words.INTENT_WORDS)
SCORES = ", ".join(f"{hits(w)} AS s{i}" for i, w in enumerate(words.INTENT_WORDS.values()))
BEST = "greatest(s0, s1, s2, s3)"
INTENT = f"CASE WHEN {BEST} = 0 THEN 'inconnu' " + " ".join(
    f"WHEN s{i} = {BEST} THEN '{intent}'" for i, intent in enumerate(INTENTS)) + " END"
CONFIDENCE = f"CASE WHEN s0 + s1 + s2 + s3 = 0 THEN 0.0 ELSE {BEST} / CAST(s0 + s1 + s2 + s3 AS DOUBLE) END"
SCORED = f"(SELECT *, {SCORES} FROM {TEXTS})"
ACTION = "CASE " + " ".join(
    f"WHEN intent = '{intent}' THEN CASE " + " ".join(
        f"WHEN {hits(words.SYNONYMS[a])} > 0 THEN '{a}'" for a in actions) + " ELSE 'inconnu' END"
    for intent, actions in words.INTENT_ACTIONS.items()) + " ELSE 'inconnu' END"


def sql_pattern(pattern):
    """Unicode letters for words, as in the query's patterns."""
    return "(?i)" + pattern.replace(r"\w", r"[\p{L}\p{M}\p{Nd}\p{Pc}]").replace(r"\d", r"\p{Nd}")


def group_choice(pattern):
    word = f"lower(regexp_extract(text, '{sql_pattern(pattern)}', 1))"
    cases = " ".join(f"WHEN {word} <> '' AND contains({quoted(normalized_name(c))}, {word}) THEN {quoted(c)}" for c in NAMES)
    return f"CASE {cases} END"


def comparisons():
    parts = []
    for pattern, operator in words.COMPARISON_PATTERNS:
        parts.append(f"""SELECT id, turn, '{operator}' AS operator, unnest(regexp_extract_all(text, '{sql_pattern(pattern)}', 2)) AS value,
          CAST(NULL AS DOUBLE) AS value_min, CAST(NULL AS DOUBLE) AS value_max FROM {BOTH}""")
    pattern = sql_pattern(words.RANGE_PATTERN)
    parts.append(f"""SELECT id, turn, 'between', NULL, CAST(unnest(regexp_extract_all(text, '{pattern}', 1)) AS DOUBLE),
      CAST(unnest(regexp_extract_all(text, '{pattern}', 2)) AS DOUBLE) FROM {BOTH}""")
    return " UNION ALL ".join(parts)


def mention(name):
    norm = normalized_name(name)
    own = sorted(set(norm.split()))
    tokens = "list_distinct(string_split(norm, ' '))"
    common = f"len(list_intersect({tokens}, {own}))"
    return f"""CASE WHEN norm = {quoted(norm)} THEN 1.0 WHEN contains(norm, {quoted(norm)}) THEN 0.9
      WHEN {common} > 0 THEN {common} / CAST(greatest(len({tokens}), {len(own)}) AS DOUBLE) * CAST(0.8 AS DOUBLE)
      WHEN {f"list_has_any({tokens}, {trigger_words(name)})" if trigger_words(name) else 'false'} THEN 0.6 ELSE 0.0 END"""


MENTIONS = " UNION ALL ".join(
    f"SELECT id, turn, {i} AS spot, {quoted(c)} AS target, CAST({mention(c)} AS DOUBLE) AS score FROM {TEXTS}" for i, c in enumerate(NAMES))

QUERIES = {
    "normalize_text": lambda s, d: tagged(s, d, lambda t: texttags.normalize_text(t, "text"), "normalized"),
    "tag_intent": lambda s, d: rounded(tagged(s, d, lambda t: texttags.tag_intent(t, "text"), "intent", "intent_confidence")),
    "tag_action": lambda s, d: tagged(s, d, lambda t: texttags.tag_action(t, "text"), "intent", "action"),
    "extract_group_phrase": lambda s, d: tagged(
        s, d, lambda t: texttags.extract_group_phrase(t, "text", NAMES), "group_column"),
    "extract_filter_phrases": lambda s, d: tagged(
        s, d, lambda t: texttags.extract_filter_phrases(t, "text"), "operator", "value", "value_min", "value_max"),
    "rank_column_mentions": lambda s, d: rounded(tagged(
        s, d, lambda t: texttags.rank_column_mentions(t, "text", NAMES), "target", "score", "place", "confidence")),
}

SQL = {
    "normalize_text": f"SELECT id, turn, norm AS normalized FROM {TEXTS}",
    "tag_intent": f"SELECT id, turn, {INTENT} AS intent, round({CONFIDENCE}, 6) AS intent_confidence FROM {SCORED}",
    "tag_action": f"SELECT id, turn, intent, {ACTION} AS action FROM (SELECT *, {INTENT} AS intent FROM {SCORED})",
    "extract_group_phrase": f"""SELECT id, turn, coalesce({', '.join(group_choice(p) for p in words.GROUP_PATTERNS)}) AS group_column
      FROM {BOTH}""",
    "extract_filter_phrases": comparisons(),
    "rank_column_mentions": f"""WITH m AS ({MENTIONS}), b AS (SELECT *, max(score) OVER (PARTITION BY id, turn) AS best,
        row_number() OVER (PARTITION BY id, turn ORDER BY score DESC, spot) AS place FROM m)
      SELECT id, turn, target, round(score, 6) AS score, CAST(place AS INTEGER) AS place,
        round((c.confidence + best) / 2, 6) AS confidence
      FROM b JOIN (SELECT id, turn, CAST({CONFIDENCE} AS DOUBLE) AS confidence FROM {SCORED}) c USING (id, turn)
      WHERE score > 0 AND score >= 0.7 * best AND place <= 2""",
}
