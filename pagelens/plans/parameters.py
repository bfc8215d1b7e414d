"""Parameter lists for the registered queries, over words that occur in the given tables.

The reference word lists hit almost nothing in invented text, so the list-based
operators are exercised with function words and frequent fragments instead.
Quarter steps keep valence sums exact in any order.
"""

SENTIMENT = (
    ("the", 0.25, 0.25, 0.25), ("of", -0.5, -0.25, 0.5), ("and", 0.5, 0.5, 0.0), ("worthless", -2.0, -0.75, 1.0),
    ("with", 1.25, 0.5, 0.5), ("from", -1.25, -0.5, 0.75), ("this", 1.75, 0.75, 0.5), ("was", -1.5, -0.5, 0.25),
    ("tion", 0.75, 0.25, 0.5), ("la", 0.25, 0.25, 0.0), ("de", -0.25, -0.25, 0.25), ("pas", -1.5, -0.5, 0.5),
    ("pour", 1.0, 0.25, 0.75), ("und", 0.5, 0.25, 0.0), ("nicht", -1.25, -0.75, 0.5), ("ist", 0.75, 0.5, 0.25),
    ("que", 0.5, 0.25, 0.25), ("por", -0.75, -0.25, 0.5), ("no", -1.5, -0.75, 1.0), ("para", 1.25, 0.5, 0.75),
)

TOKEN_CATEGORIES = {
    "technology": ["the", "thing", "ing"],
    "business": ["of", "tion", "machine learning"],
    "science": ["and", "er"],
    "health": ["to", "st"],
    "education": ["in", "is", "la"],
    "entertainment": ["that", "it", "game"],
    "sports": ["for", "was", "game"],
    "politics": ["de", "les", "der"],
    "travel": ["que", "el", "die"],
    "food": ["und", "y", "et"],
}

EMOTIONS = (
    ("the", "joy"), ("with", "joy"), ("of", "sadness"), ("from", "sadness"), ("and", "anger"), ("de", "anger"),
    ("to", "fear"), ("der", "fear"), ("is", "surprise"), ("la", "surprise"), ("que", "surprise"),
)

GAZETTEER = (("thing", "THING"), ("tion", "THING"), ("ing", "FORM"), ("ment", "FORM"), ("heit", "FORM"))

CANCELLED_TOXIC = 4
