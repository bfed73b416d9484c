"""Word lists and patterns of the text tagging.

All of these are fixed values: they have to be exactly these for the tags to come out right.
"""

# The words that speak for each intent, intents in order of preference.
INTENT_WORDS = {
    "statistique": [
        "moyenne", "mean", "average", "somme", "sum", "total", "min", "max",
        "mediane", "median", "ecart", "std", "variance", "count", "nombre",
    ],
    "visualisation": [
        "histogramme", "hist", "graphique", "plot", "chart", "figure",
        "bar", "scatter", "nuage", "ligne", "line", "camembert", "pie",
        "box", "boite", "heatmap", "matrice",
    ],
    "nettoyage": [
        "manquant", "missing", "null", "doublon", "duplicate", "outlier",
        "anomalie", "aberrant", "nettoyer", "clean",
    ],
    "exploration": [
        "describe", "resume", "apercu", "type", "dtype", "structure",
        "correlation", "correle", "explore", "analyse",
    ],
}
UNKNOWN = "inconnu"

# The synonyms of every action and phrase.
SYNONYMS = {
    "moyenne": ["mean", "average", "avg", "moyen", "moyenne"],
    "somme": ["sum", "total", "somme", "addition"],
    "minimum": ["min", "minimum", "plus petit", "plus bas", "inf"],
    "maximum": ["max", "maximum", "plus grand", "plus haut", "sup"],
    "mediane": ["median", "mediane", "milieu"],
    "ecart_type": ["std", "ecart-type", "ecart type", "standard", "dispersion"],
    "variance": ["var", "variance", "variabilite"],
    "count": ["count", "nombre", "occurrences", "frequence"],
    "histogramme": ["hist", "histogramme", "distribution", "repartition", "densite"],
    "bar_chart": ["bar", "barplot", "bar chart", "diagramme barre", "batons"],
    "scatter_plot": ["scatter", "nuage", "points", "correlation", "relation", "xy"],
    "line_chart": ["line", "ligne", "courbe", "evolution", "temporel", "serie"],
    "pie_chart": ["pie", "camembert", "secteur", "circulaire", "proportion"],
    "box_plot": ["box", "boite", "boxplot", "moustache", "quartiles"],
    "heatmap": ["heatmap", "matrice", "correlation matrix", "chaleur"],
    "detecter_manquants": ["manquant", "missing", "null", "na", "vide", "absent"],
    "detecter_doublons": ["doublon", "duplicate", "dupli", "identique", "redondant"],
    "detecter_outliers": ["outlier", "anomalie", "aberrant", "extreme", "atypique"],
    "describe": ["describe", "resume", "apercu", "synthese", "statistiques"],
    "dtypes": ["type", "dtype", "datatype", "structure", "format"],
    "correlation": ["correlation", "correle", "lie", "dependance"],
    "par": ["par", "group", "groupe", "selon", "pour chaque", "chaque"],
    "superieur": ["superieur", ">", "plus grand que", "au dessus", "above"],
    "inferieur": ["inferieur", "<", "plus petit que", "au dessous", "below"],
    "egal": ["egal", "=", "vaut", "est"],
}

# The actions of each intent, in the order they are tried.
INTENT_ACTIONS = {
    "statistique": ["moyenne", "somme", "minimum", "maximum", "mediane", "ecart_type", "variance", "count"],
    "visualisation": ["histogramme", "bar_chart", "scatter_plot", "line_chart", "pie_chart", "box_plot", "heatmap"],
    "nettoyage": ["detecter_manquants", "detecter_doublons", "detecter_outliers"],
    "exploration": ["describe", "dtypes", "correlation"],
}

# The phrases that name a group, in the order they are tried; the group is the word.
GROUP_PATTERNS = [
    r"par\s+(\w+)",
    r"groupe\s+par\s+(\w+)",
    r"pour\s+chaque\s+(\w+)",
    r"selon\s+(\w+)",
    r"chaque\s+(\w+)",
    r"group\s+by\s+(\w+)",
]

# The phrases that name a comparison with a value, and the one naming a range.
COMPARISON_PATTERNS = [
    (r"(superieur|>|plus\s+grand\s+que|au\s+dessus\s+de)\s+(\d+(?:\.\d+)?)", ">"),
    (r"(inferieur|<|plus\s+petit\s+que|au\s+dessous\s+de)\s+(\d+(?:\.\d+)?)", "<"),
    (r"(egal\s+a|vaut|est)\s+(\w+)", "=="),
]
RANGE_PATTERN = r"entre\s+(\d+(?:\.\d+)?)\s+et\s+(\d+(?:\.\d+)?)"

# The scores of a column named in a text, and which columns are kept.
SAME, CONTAINED, SHARED_WORDS, SYNONYM = 1.0, 0.9, 0.8, 0.6
KEPT_OF_BEST, KEPT_COLUMNS = 0.7, 2
