"""Tags of single sentences."""

import pytest

from tableglass.operators import texttags

COLUMNS = ["Age", "Gender", "prix total", "note_max"]


@pytest.fixture
def tag(spark):
    def run(operator, text, *args):
        return operator(spark.createDataFrame([(text,)], "q string"), "q", *args).drop("q").collect()
    return run


@pytest.mark.parametrize("text, intent, action", [
    ("Moyenne de Age par Gender", "statistique", "moyenne"),
    ("histogramme des prix", "visualisation", "histogramme"),
    ("y a-t-il des doublons ?", "nettoyage", "detecter_doublons"),
    ("describe the table", "exploration", "describe"),
    ("bonjour", "inconnu", "inconnu"),
    ("max missing", "statistique", "maximum"),
])
def test_intent_and_action(tag, text, intent, action):
    assert tuple(tag(texttags.tag_action, text)[0]) == (intent, action)


def test_confidence(tag):
    assert tuple(tag(texttags.tag_intent, "max missing")[0]) == ("statistique", 0.5)
    assert tuple(tag(texttags.tag_intent, "rien")[0]) == ("inconnu", 0.0)


def test_normalized_text_keeps_accents(tag):
    assert tag(texttags.normalize_text, "  L'Été,  c'est_bien!! ")[0][0] == "l été c est_bien"


@pytest.mark.parametrize("text, column", [
    ("moyenne par gender", "Gender"), ("pour chaque AGE", "Age"), ("selon le prix", None),
    ("group by total", "prix total"), ("par ville selon age", "Age"), ("", None)])
def test_group_phrase(tag, text, column):
    assert tag(texttags.extract_group_phrase, text, COLUMNS)[0][0] == column


def test_filter_phrases(tag):
    got = tag(texttags.extract_filter_phrases, "Age > 30 et prix inferieur 12.5, ville est Paris, entre 5 et 10.5")
    assert [tuple(r) for r in got] == [
        (">", "30", None, None), ("<", "12.5", None, None), ("==", "Paris", None, None), ("between", None, 5.0, 10.5)]
    assert tag(texttags.extract_filter_phrases, "rien") == []


def test_column_mentions(tag):
    got = tag(texttags.rank_column_mentions, "moyenne de Age par Gender", COLUMNS)
    assert [(r["target"], r["score"], r["place"]) for r in got] == [("Age", 0.9, 1), ("Gender", 0.9, 2)]
    assert got[0]["confidence"] == pytest.approx((1.0 + 0.9) / 2)
    exact = tag(texttags.rank_column_mentions, "prix total", COLUMNS)
    assert [(r["target"], r["score"]) for r in exact] == [("prix total", 1.0)]
    shared = tag(texttags.rank_column_mentions, "le prix du pain", COLUMNS)
    assert [(r["target"], r["score"]) for r in shared] == [("prix total", pytest.approx(0.2))]
    synonym = tag(texttags.rank_column_mentions, "le maximum", COLUMNS)
    assert [(r["target"], r["score"]) for r in synonym] == [("note_max", 0.6)]
    assert tag(texttags.rank_column_mentions, "rien", COLUMNS) == []
