"""Small parameter lists. Every operator that uses one takes it as an argument.

The lists are Python values, so their size is known before a plan is built;
`table` turns rows into a DataFrame for joins.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

# Category seed rows (name, description, keywords).
DEFAULT_CATEGORIES = (
    ("technology", "Technology, software, and IT related content", ["software", "hardware", "programming", "computer", "tech", "ai", "ml"]),
    ("business", "Business, finance, and corporate content", ["business", "finance", "market", "company", "revenue", "profit"]),
    ("science", "Scientific research and discoveries", ["research", "study", "experiment", "scientific", "discovery", "analysis"]),
    ("health", "Health, medical, and wellness content", ["health", "medical", "doctor", "treatment", "wellness", "medicine"]),
    ("education", "Educational and academic content", ["education", "school", "university", "learning", "academic", "student"]),
    ("entertainment", "Entertainment and media content", ["entertainment", "movie", "music", "celebrity", "show", "game"]),
    ("sports", "Sports and athletic content", ["sport", "team", "player", "game", "tournament", "athletic"]),
    ("politics", "Political and government related content", ["politics", "government", "election", "policy", "democracy", "vote"]),
    ("travel", "Travel and tourism content", ["travel", "vacation", "tourism", "destination", "trip", "hotel"]),
    ("general", "General content that doesn't fit other categories", ["general", "misc", "other", "various", "mixed"]),
)

# Keywords matched against whole tokens.
TOKEN_CATEGORIES = {
    "technology": ["software", "hardware", "computer", "digital", "tech", "ai", "machine learning", "programming"],
    "business": ["company", "market", "revenue", "profit", "strategy", "business", "corporate", "finance"],
    "science": ["research", "study", "experiment", "scientific", "analysis", "data", "discovery"],
    "health": ["health", "medical", "doctor", "patient", "treatment", "medicine", "wellness"],
    "education": ["school", "student", "teacher", "learning", "education", "university", "academic"],
    "entertainment": ["movie", "music", "game", "entertainment", "celebrity", "show", "film"],
    "sports": ["sport", "team", "player", "game", "match", "tournament", "athletic"],
    "politics": ["government", "political", "election", "policy", "candidate", "vote", "democracy"],
    "travel": ["travel", "vacation", "destination", "trip", "tourism", "hotel", "flight"],
    "food": ["food", "recipe", "cooking", "restaurant", "cuisine", "meal", "ingredient"],
}

# Keywords matched as substrings of the lower-cased text.
SUBSTRING_CATEGORIES = {
    "technology": [
        "technology", "software", "computer", "digital", "ai", "artificial intelligence", "machine learning",
        "programming", "code", "tech",
    ],
    "business": ["business", "company", "market", "finance", "economy", "revenue", "profit", "sales", "corporate"],
    "science": ["science", "research", "study", "experiment", "discovery", "scientific", "analysis", "theory"],
    "health": ["health", "medical", "medicine", "doctor", "patient", "treatment", "healthcare", "wellness"],
    "education": ["education", "school", "university", "learning", "student", "teacher", "academic", "knowledge"],
    "entertainment": ["entertainment", "movie", "music", "game", "celebrity", "show", "film", "media"],
    "sports": ["sport", "team", "player", "game", "match", "tournament", "athletic", "competition"],
    "politics": ["politics", "government", "election", "policy", "democracy", "vote", "political"],
    "travel": ["travel", "vacation", "tourism", "destination", "trip", "hotel", "journey"],
    "general": ["general", "information", "content", "text", "article"],
}

# Class names of the classifier, in index order.
CLASS_NAMES = tuple(name for name, _, _ in DEFAULT_CATEGORIES)

# Our own stop-word lists; they double as the language profiles.
STOP_WORDS = {
    "en": (
        "a about above after again all also am an and any are as at be because been before being below between both "
        "but by can could did do does doing down during each few for from further had has have having he her here "
        "hers him his how i if in into is it its itself just me more most my myself no nor not now of off on once "
        "only or other our ours out over own same she should so some such than that the their theirs them then there "
        "these they this those through to too under until up very was we were what when where which while who whom "
        "why will with would you your yours"
    ).split(),
    "fr": (
        "à au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais même ne nous on "
        "ou où par pas plus pour qu que qui sa sans se ses son sur tu un une vous"
    ).split(),
    "de": (
        "aber als am an auch auf aus bei bin das dass dem den der des die durch ein eine einem einen einer er es für "
        "hat ich im in ist mit nach nicht noch nur oder sein sich sie sind so über um und unter von vor war was wie "
        "wir zu zum zur"
    ).split(),
    "es": (
        "al como con cuando de del donde el ella en entre era es esta este la las le lo los más me mi muy no nos o "
        "para pero por porque que se ser si sin sobre su sus también un una y ya"
    ).split(),
}
LANGUAGES = tuple(STOP_WORDS)

# Our own lexicon (word, valence, polarity, subjectivity). Quarter steps keep sums exact in any order.
SENTIMENT = (
    ("good", 2.0, 0.75, 0.5), ("great", 3.0, 0.75, 0.75), ("excellent", 3.25, 1.0, 1.0), ("love", 3.25, 0.5, 0.5),
    ("best", 3.25, 1.0, 0.25), ("happy", 2.75, 0.75, 1.0), ("nice", 1.75, 0.5, 1.0), ("wonderful", 2.75, 1.0, 1.0),
    ("useful", 2.0, 0.25, 0.0), ("clear", 1.5, 0.0, 0.5), ("success", 2.75, 0.25, 0.0), ("win", 2.75, 0.75, 0.5),
    ("easy", 2.0, 0.5, 0.75), ("safe", 2.0, 0.5, 0.5), ("strong", 2.25, 0.5, 0.75), ("thanks", 2.0, 0.25, 0.25),
    ("bad", -2.5, -0.75, 0.75), ("terrible", -2.0, -1.0, 1.0), ("awful", -2.0, -1.0, 1.0), ("hate", -2.75, -0.75, 1.0),
    ("worst", -3.0, -1.0, 1.0), ("worthless", -2.0, -0.75, 1.0), ("sad", -2.0, -0.5, 1.0), ("poor", -2.0, -0.5, 0.5),
    ("wrong", -2.0, -0.5, 1.0), ("problem", -1.75, 0.0, 0.0), ("fail", -2.5, -0.5, 0.25), ("hard", -0.5, -0.25, 0.5),
    ("danger", -2.5, 0.0, 0.0), ("angry", -2.25, -0.5, 1.0), ("broken", -2.0, -0.5, 0.5), ("fear", -2.25, 0.0, 0.0),
)

EMOTIONS = (
    ("happy", "joy"), ("love", "joy"), ("great", "joy"), ("wonderful", "joy"), ("sad", "sadness"), ("loss", "sadness"),
    ("cry", "sadness"), ("angry", "anger"), ("hate", "anger"), ("attack", "anger"), ("fear", "fear"),
    ("danger", "fear"), ("afraid", "fear"), ("awful", "disgust"), ("dirty", "disgust"), ("sudden", "surprise"),
    ("unexpected", "surprise"), ("wow", "surprise"),
)

GAZETTEER = (
    ("london", "GPE"), ("paris", "GPE"), ("berlin", "GPE"), ("madrid", "GPE"), ("europe", "LOC"), ("africa", "LOC"),
    ("monday", "DATE"), ("january", "DATE"), ("english", "LANGUAGE"), ("french", "LANGUAGE"),
)

# Our own wording: kind, role text, task, answer guide, token budget.
PROMPTS = (
    ("comprehensive", "You analyse content in a thorough and structured way.", "Analyse this content in full.",
     "Cover themes, insights, quality, tone, audience, strengths, weaknesses and advice.", 1000),
    ("summary", "You write short summaries.", "Summarise this content in two or three paragraphs.", "Summary:", 300),
    ("sentiment", "You judge emotional tone.", "Judge the sentiment and tone of this content.",
     "State overall sentiment, a confidence from 0 to 1, indicators and tone.", 200),
    ("topics", "You name topics and themes.", "Name the main topics and themes of this content.",
     "List primary topic, secondary topics, themes and categories.", 300),
    ("entities", "You extract named entities.", "Extract the named entities of this content.",
     "Group people, organisations, places, products, concepts and dates.", 400),
    ("quality", "You assess content quality.", "Assess the quality of this content.",
     "Rate accuracy, clarity, depth, originality, readability and an overall score from 1 to 10.", 400),
)


def all_stop_words() -> list[str]:
    """Union of the language lists, in list order."""
    return list(dict.fromkeys(w for words in STOP_WORDS.values() for w in words))


def table(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """A parameter list as a DataFrame."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def sql_values(rows: Iterable[Sequence], columns: str) -> str:
    """The same list as a SQL relation, for the checking queries."""

    def literal(v) -> str:
        if isinstance(v, bool) or v is None:
            return str(v).upper() if v is not None else "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"{v}::DOUBLE" if isinstance(v, float) else str(v)

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({columns}))"
