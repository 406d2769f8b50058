"""Results depend on these exact words, numbers and labels."""

# Pay tiers: (exclusive ceiling, label); the last tier has no ceiling.
TIERS = [
    (55_000, "Tier 1 — Entry/Support"),
    (80_000, "Tier 2 — Technical Core"),
    (110_000, "Tier 3 — Senior/Specialist"),
    (None, "Tier 4 — Leadership/Expert"),
]

# Pay range shown next to each tier.
TIER_RANGES = {
    "Tier 1 — Entry/Support": "< $55,000",
    "Tier 2 — Technical Core": "$55,000 – $79,999",
    "Tier 3 — Senior/Specialist": "$80,000 – $109,999",
    "Tier 4 — Leadership/Expert": "$110,000+",
}

# Marker colour of each tier and of anything else.
TIER_COLOURS = {
    "Tier 1 — Entry/Support": "#94a3b8",
    "Tier 2 — Technical Core": "#60a5fa",
    "Tier 3 — Senior/Specialist": "#34d399",
    "Tier 4 — Leadership/Expert": "#fbbf24",
}
DEFAULT_COLOUR = "#e2e8f0"

# Words never reported as a missing skill.
GAP_STOPWORDS = [
    "and", "or", "the", "to", "of", "a", "in", "is", "with",
    "for", "on", "by", "as", "be", "are", "at", "from", "an",
    "this", "that", "such", "each", "have", "has", "may", "not",
    "using", "use", "used", "their", "other", "when", "which",
]

# Words left out of topic vocabularies.
TOPIC_STOPWORDS = [
    "and", "or", "the", "to", "of", "a", "in", "is", "with", "for", "on",
    "by", "as", "be", "are", "at", "from", "an", "this", "that", "such",
    "each", "have", "has", "may", "not", "using", "use", "used", "other",
    "when", "which", "their", "work", "workers", "working", "tasks", "skills",
]

# Section headings removed before topic modelling.
TOPIC_HEADINGS = ["Tasks:", "Skills:"]

# Names given to topics until somebody edits them.
TOPIC_LABELS = {
    0: "Heavy Equipment Operation",
    1: "Blueprint Reading & Planning",
    2: "Structural Installation",
    3: "Electrical & Mechanical Systems",
    4: "Project Management & Coordination",
    5: "Safety & Compliance",
    6: "Civil & Site Work",
    7: "Supervision & Leadership",
}

# Trailing characters cut from organisation names before comparing them.
NAME_TAIL = ".,inc lc"

# Clustering methods in order of preference on equal scores, and their label columns.
METHOD_COLUMNS = {
    "kmeans": "cluster_kmeans",
    "gmm": "cluster_gmm",
    "agglomerative": "cluster_agglom",
    "hdbscan": "cluster_hdbscan",
}

# Use-case -> preferred method.
PREFERRED_METHOD = {
    "progress": "kmeans",
    "pivot": "gmm",
    "field_change": "agglomerative",
    "skill_match": "hdbscan",
}

WAGE_BLEND = 0.35
DEFAULT_WAGE = 45_000.0
TRAINING_COST = 5_000.0
CODE_PATTERN = r"^\d{2}-\d{4}"
GENERAL = "GENERAL"
