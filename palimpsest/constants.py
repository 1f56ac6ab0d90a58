"""Enumerations and word lists that results depend on."""

from __future__ import annotations

# key/value memory.
ACTIONS = ("ADD", "UPDATE", "NOOP")
MEMORY_TYPES = ("fact", "preference", "event", "plan", "assistant_fact")
ACTIVE_STATUSES = ("active", "planned", "completed")

# Surface relations and the predicate each one stands for.
RELATIONS = {
    "PURCHASED": ("bought", "purchase", "purchased"),
    "ATTENDED": ("went to", "attended", "is attending", "is_attending"),
    "COMPLETED": ("completed", "has completed", "has_completed", "completed courses", "finished"),
    "OBSERVED": ("observed",),
    "TARGET": ("target",),
    "PREFERS": ("prefers", "likes"),
    "PLANS": ("plans", "planned", "plans to", "plans_to", "is planning to"),
    "LOCATED_IN": ("lives in", "located in"),
    "MENTIONS": ("mentions",),
    "OBSERVED_WAKE_TIME": ("observed wake time", "observed_wake_time", "wake time observed"),
    "USES": ("uses", "use"),
    "DOWNLOADED": ("downloaded", "download"),
}
# Predicates by how their facts are told apart.
OCCURRENCE_PREDICATES = ("PURCHASED", "DOWNLOADED", "ATTENDED", "COMPLETED", "OBSERVED", "OBSERVED_WAKE_TIME", "MENTIONS", "USES")
NUMERIC_PREDICATES = ("PURCHASED", "ATTENDED", "COMPLETED", "OBSERVED", "OBSERVED_WAKE_TIME")
FUNCTIONAL_PREDICATES = ("TARGET", "PREFERS", "PLANS", "LOCATED_IN")
DONE_PREDICATES = ("PURCHASED", "ATTENDED", "COMPLETED")
# Words that name a category.
CATEGORY_HINTS = {
    "grocery": ("grocery", "groceries", "chicken", "beef", "produce", "organic", "food", "meal", "snack", "pantry", "dairy", "vegetable", "fruit"),
}
# Words of a question that match no fact.
STOP_WORDS = (
    "what which where when how many much did do i my the a an of to in on at for from and or is are was were have has had "
    "been be between past last total number most least highest lowest money spent days time long online"
).split()
CONTEXT_STOP_WORDS = ("the", "and", "or", "to", "in", "of", "is", "a", "an")
# Phrases that say that something changed.
UPDATE_PHRASES = (
    r"\bchanged\b.+\bto\b",
    r"\bupdated\s+to\b",
    r"\bnow\s+lives\s+in\b",
    r"\bno\s+longer\b.+\binstead\b",
    r"\bcorrected\b.+\bto\b",
)
# Nouns that are counted.
COUNT_NOUNS = "courses? coins? items? days? plants? albums? books? graduations? events? trips? nights?".split()
# Currency signs.
CURRENCIES = {"$": "USD", "€": "EUR", "£": "GBP"}
# Months and weekdays.
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
# Thresholds.
KEY_DRIFT_SIMILARITY = 0.82
NEAR_UNITS = 32
