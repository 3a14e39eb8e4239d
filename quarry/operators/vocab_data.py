"""Vocabulary for column-domain tagging, written for this library.

Structure (fixed): seven categories checked in this priority order, each
mapped to a bucket; the category -> bucket mapping below is a fixed value of
the modelled behaviour.  The alias words themselves are this library's own.
"""

# Category priority order and category -> bucket mapping.
CATEGORY_ORDER = ["performance", "playing_time", "injury", "entity", "physical", "workload", "spatial"]
CATEGORY_BUCKET = {
    "performance": "post_match_cols",
    "playing_time": "playing_time_cols",
    "injury": "injury_cols",
    "entity": "identity_cols",
    "physical": "physical_cols",
    "workload": "workload_cols",
    "spatial": "post_match_cols",
}

# Whole-token abbreviations expanded before matching: those of business tables.
ABBREVIATIONS = {
    "acct": "account",
    "addr": "address",
    "amt": "amount",
    "cust": "customer",
    "disc": "discount",
    "mkt": "market",
    "ord": "order",
    "prod": "product",
    "qty": "quantity",
    "supp": "supplier",
    "ts": "timestamp",
    "wgt": "weight",
}

# category -> canonical term -> aliases: what a business or a club records, by the kind of measure
SYNONYMS = {
    "performance": {
        "sales value": ["extendedprice", "totalprice", "retailprice", "price", "revenue", "amount"],
        "points": ["points", "pts", "scored", "goals"],
        "discount": ["discount", "rebate", "tax"],
        "quality": ["quality", "toxic", "grade"],
        "balance": ["acctbal", "balance"],
    },
    "playing_time": {
        "time taken": ["minutes", "duration", "elapsed", "time spent"],
        "attendance": ["visits", "turn", "attendance"],
    },
    "injury": {
        "fault": ["injury", "defect", "returnflag", "complaint"],
        "absence": ["absence", "out of stock", "downtime"],
    },
    "entity": {
        "customer": ["customer", "custkey", "client"],
        "supplier": ["supplier", "suppkey", "vendor"],
        "order": ["orderkey", "order number", "order id"],
        "product": ["partkey", "product", "item id", "brand"],
        "person or team": ["player", "team", "employee", "user id"],
        "record": ["doc id", "conv id", "page id", "vec id", "event id"],
    },
    "physical": {
        "size": ["size", "height", "weight", "volume"],
        "container": ["container", "package"],
    },
    "workload": {
        "quantity": ["quantity", "units", "n chars", "count"],
        "load": ["load", "throughput", "sessions"],
    },
    "spatial": {
        "place": ["nation", "nationkey", "region", "regionkey", "address", "url"],
        "kind of event": ["event type", "action"],
    },
}

# Category values that reveal the domain when column names do not: market segments, order states and events.
VALUE_TERMS = [
    "automobile", "building", "furniture", "household", "machinery",
    "urgent", "not specified", "purchase", "checkout", "refund", "signup",
    "wholesale", "back order", "free shipping",
]

# Question templates keyed by (issue type, category); the first listed category wins.
QUESTION_TEMPLATES = [
    ("leakage_candidate", "performance",
     "'{column}' looks like a statistic recorded during or after the match. Is it known before the "
     "outcome you want to predict, or should it be left out?"),
    ("leakage_candidate", "spatial",
     "'{column}' describes where an event happened. Is that known before the outcome, or only afterwards?"),
    ("high_missingness", "playing_time",
     "'{column}' is often empty. Does an empty value mean the player did not take part?"),
    ("high_missingness", "injury",
     "'{column}' is often empty. Does an empty value mean there was no injury, or that it was not recorded?"),
    ("noisy_categories", "entity",
     "'{column}' identifies customers, products or people. Should it be used as a feature or only as an identifier?"),
]
DOMAIN_QUESTION = (
    "Some column names look like records of this domain, but not clearly. Does the table "
    "describe it?"
)
