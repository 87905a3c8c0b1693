"""The study's own settings: where it searches, for what, and how much it samples.

Fixed values, kept equal to the study's configuration. Any of them can be replaced by the caller.
"""

from __future__ import annotations

from chorale.functions.terms import all_of, any_of, phrase, prefix, term

COMMUNITIES = (
    "Palestine", "Gaza", "SocialDemocracy", "Liberal",
    "politics",
    "JewsOfConscience", "DemocraticSocialism",
    "AskALiberal",
    "Israel", "Jewish", "Conservative",
    "AskConservatives", "ProgressivesForIsrael",
    "PoliticalDiscussion", "geopolitics", "IsraelPalestine", "TrueUnpopularOpinion", "UnpopularOpinion",
)
ACTIVE_COMMUNITIES = ("Liberal", "politics", "Conservative")

# Each query asks for a place name together with one of the frame's words. The two place groups of a
# query share their word list, so they are one group here; the matches are the same.
PLACES = any_of("gaza", prefix("palestine"), "israel")
HUMANITARIAN = all_of(PLACES, any_of(
    "genocide", prefix("humanitarian"), "UN", "ICJ", "victims", phrase("war crime")))
SECURITY = all_of(PLACES, any_of(
    "hamas", prefix("terroris"), "attack", "hostages", "netanyahu", "IDF", "war", "conflict"))
GEOPOLITICAL = all_of(PLACES, any_of(
    "biden", "trump", "US", "congress", "EU", "ally", prefix("antisemit"), phrase("anti-semit", open_end=True)))
MEDIA = all_of(PLACES, any_of(
    "media", "narrative", "propaganda", "bias", "reporting", prefix("antisemit"),
    phrase("anti-semit", open_end=True), prefix("islamophob"), "misinformation", phrase("hate speech")))
ANY_MENTION = any_of(term("gaza"), prefix("palestine"))

QUERIES = (HUMANITARIAN, SECURITY, GEOPOLITICAL, MEDIA, ANY_MENTION)
ACTIVE_QUERIES = (SECURITY,)
ACTIVE_SORTS = ("relevance",)

SEARCH_LIMIT = 1000
ACTIVE_SEARCH_LIMIT = 5
TIME_WINDOW = "year"

SAMPLE_SIZE = 100
ACTIVE_SAMPLE_SIZE = 10
SAMPLE_SEED = 123
VALIDATION_RATIO = 0.85

PILOT_SIZE = 25
PILOT_SEED = 111
SAVE_EVERY = 5
LEGACY_SAMPLE_SIZE = 20

# What 1 and 5 mean on the stance scale.
STANCE_POLES = ("Pro-Palestine", "Pro-Israel")
