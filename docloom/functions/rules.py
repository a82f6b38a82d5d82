"""Rule tables as data, with the defaults of appliance support."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import WS, col, contains_any, first_rule, words

Rules = list[tuple[str, list[str]]]

# fixed values: page types by keyword, in order
SUPPORT_TYPES: Rules = [
    ("error_code", ["error_code", "error code", "flashing_light", "blinking", "f1", "f2", "f3", "f5", "f7", "e1", "e2"]),
    ("installation", ["install", "hook up", "hookup", "set up", "setup", "level the", "connect the"]),
    ("troubleshooting", ["troubleshoot", "not working", "won't", "does not", "will not", "problem", "issue", "diagnos"]),
    ("maintenance", ["clean", "maintenance", "care", "descale", "filter", "affresh", "deodor"]),
    ("warranty", ["warranty", "service plan", "extended service", "coverage", "protection"]),
    ("parts", ["part", "replace", "order", "accessori"]),
    ("safety", ["safety", "hazard", "caution", "warning label", "recall"]),
    ("specifications", ["spec", "dimension", "capacity", "weight", "energy", "ampere", "voltage", "btu"]),
    ("manual", ["manual", "owner", "literature", "guide", "pdf"]),
]
# fixed values: those tried after the file type
SUPPORT_TYPES_LATE: Rules = [
    ("usage", ["how to", "usage", "cycle", "setting", "option", "feature", "operation", "load", "dispenser"]),
    ("faq", ["faq"]),
]
# fixed values: categories in URL paths and in texts
URL_CATEGORIES: Rules = [("dishwasher", ["dishwasher"]), ("refrigerator", ["refrigerator", "freezer"]), ("washer", ["washer", "laundry", "dryer"])]
TEXT_CATEGORIES: Rules = [("dishwasher", ["dishwasher"]), ("refrigerator", ["refrigerator", "refrigirator", "fridge", "fidge", "freezer"]), ("washer", ["washer", "washing machine"])]
# fixed values: brands; the short name is sought anywhere in a text
BRANDS: Rules = [("whirlpool", ["whirlpool"]), ("ge", ["ge appliances", "general electric", "ge"])]
# fixed values: safety words by category, in order
SAFETY: Rules = [
    ("electrical", ["shock", "electrocution", "live wire", "electrical hazard", "electric shock", "exposed wire"]),
    ("gas", ["gas", "propane", "natural gas", "leak", "gas leak", "carbon monoxide"]),
    ("recall", ["recall", "dangerous", "safety issue", "hazard", "fire risk", "burn risk", "fire", "smoke", "burning", "flames", "smell smoke"]),
    ("warranty", ["warranty void", "authorized service", "authorized repair"]),
]
# fixed values: words of a new problem and of a new topic
PROBLEMS = ["not working", "not cooling", "not draining", "not starting", "leaking", "broken", "problem", "issue"]
TOPICS = ["how", "what", "when", "where", "why", "can", "should", "move", "install", "clean", "repair", "replace", "prepare", "safe", "safely", "maintenance"]
# fixed values: components that a query or a hit may name
QUERY_COMPONENTS = ["ice", "freezer", "dispenser", "water", "filter", "icemaker", "ice maker"]
HIT_COMPONENTS = ["icemaker", "ice maker", "ice cube", "water dispenser", "water filter"]
# fixed values: what a followed link's path holds
SUPPORT_PATHS = [
    "troubleshoot", "support", "error", "manual", "guide", "laundry", "washer", "kitchen", "dishwasher", "refrigerat", "service-and-support", "front_load", "top_load", "compact", "product_info", "faq", "gea-support",
]
# fixed values: words that a strict host's paths must hold, by category
STRICT_PATHS: dict[str, list[str]] = {"washer": ["washer", "dryer", "laundry", "washing", "drying"], "refrigerator": ["refrigerator", "freezer", "fridge", "cooling"], "dishwasher": ["dishwasher", "dish", "washing"]}
STRICT_HOSTS = ["geappliances.com", "www.geappliances.com"]
# fixed values: categories as the client tells them, whole words only
CLIENT_CATEGORIES: Rules = [
    ("refrigerator", ["fridge", "fidge", "refrigerator", "refrgerator", "refrigirator", "freezer"]), ("washer", ["washer", "washing machine"]), ("dishwasher", ["dishwasher"]), ("dryer", ["dryer"])
]

# fixed values: brands as the client tells them, whole words only
CLIENT_BRANDS: Rules = [("Whirlpool", ["whirlpool"]), ("GE Appliances", ["ge", "ge appliances", "general electric"])]
# fixed values: what the client takes for an appliance and for a question
CLIENT_APPLIANCES = ["fridge", "fidge", "refrigerator", "refrgerator", "refrigirator", "freezer", "washer", "washing machine", "dishwasher", "dryer"]
CLIENT_QUESTIONS = [
    "how", "what", "when", "where", "why", "can", "should", "is", "are", "do", "does", "will", "help", "move", "install", "clean", "repair", "replace", "prepare", "safe", "safely",
    "not working", "not cooling", "not draining", "not starting", "leaking", "broken", "problem", "issue",
]
# fixed values: whom a safety category is referred to
REFERRALS = {
    "electrical": "Please contact a qualified electrician or our support team.",
    "gas": "Please contact a qualified technician or our support team immediately.",
    "recall": "Please contact our support team immediately for safety concerns.",
    "warranty": "Please contact our authorized service center to avoid voiding your warranty.",
}
OTHER_REFERRAL = "Please contact our support team."


def support_type(url: Column | str, title: Column | str, body: Column | str, is_pdf: Column, early: Rules = SUPPORT_TYPES, late: Rules = SUPPORT_TYPES_LATE, otherwise: str = "general_support") -> Column:
    """The page type by URL, title and the first 1000 characters of the body."""
    text = F.concat_ws(" ", F.lower(F.coalesce(col(url), F.lit(""))), F.lower(F.coalesce(col(title), F.lit(""))), F.substring(F.lower(F.coalesce(col(body), F.lit(""))), 1, 1000))
    return F.coalesce(first_rule(text, early, None), F.when(is_pdf, F.lit("manual")), first_rule(text, late, otherwise))


def url_category(url: Column | str, rules: Rules = URL_CATEGORIES) -> Column:
    return first_rule(F.lower(F.coalesce(F.try_parse_url(col(url), F.lit("PATH")), F.lit(""))), rules, "")


def category(text: Column | str, rules: Rules = TEXT_CATEGORIES) -> Column:
    return first_rule(F.lower(col(text)), rules, None)


def whole_words(text: Column | str, names: list[str]) -> Column:
    """Whether one of the names stands in the text, bounded by what is no ASCII letter, digit or underscore."""
    return col(text).rlike(r"(?i)(?<![A-Za-z0-9_])(" + "|".join(names) + r")(?![A-Za-z0-9_])")


def client_issue(text: Column | str, appliances: list[str] = CLIENT_APPLIANCES, questions: list[str] = CLIENT_QUESTIONS) -> Column:
    """Whether a message of three words or more names an appliance and asks something. As on the client,
    pieces between white space count, empty ones at the ends too."""
    return (F.size(F.split(col(text), f"{WS}+", -1)) >= 3) & whole_words(text, appliances) & whole_words(text, questions)


def referral(category: Column, table: dict[str, str] = REFERRALS, other: str = OTHER_REFERRAL) -> Column:
    out = F.lit(other)
    for name, message in table.items():
        out = F.when(category == name, message).otherwise(out)
    return out


def whole_word_category(text: Column | str, rules: Rules = CLIENT_CATEGORIES) -> Column:
    """Words are bounded by what is no ASCII letter, digit or underscore, as on the client."""
    out = None
    for label, names in rules:
        hit = whole_words(text, names)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out


def brand(text: Column | str, rules: Rules = BRANDS) -> Column:
    """Characters other than letters and digits count as spaces."""
    return first_rule(F.concat(F.lit(" "), F.regexp_replace(F.lower(col(text)), r"[^\p{L}\p{N}]", " "), F.lit(" ")), rules, None)


def safety(text: Column | str, rules: Rules = SAFETY) -> Column:
    return first_rule(F.lower(col(text)), rules, None)


def new_issue(query: Column | str, categories: Rules = TEXT_CATEGORIES, problems: list[str] = PROBLEMS) -> Column:
    return category(query, categories).isNotNull() & contains_any(F.lower(col(query)), problems)


def new_topic(query: Column | str, categories: Rules = TEXT_CATEGORIES, topics: list[str] = TOPICS, problems: list[str] = PROBLEMS) -> Column:
    lower = F.lower(col(query))
    return category(query, categories).isNotNull() & (F.size(words(query)) >= 3) & (contains_any(lower, topics) | contains_any(lower, problems))


def changes_category(query: Column | str, history: Column | str, categories: Rules = TEXT_CATEGORIES) -> Column:
    return F.coalesce(category(query, categories) != category(history, categories), F.lit(False))


def followed_link(host: Column, url: Column, page_category: str) -> Column:
    """Whether a link on a page of host and category is followed."""
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    own = url_category(url)
    strict = ~F.lower(host).isin(STRICT_HOSTS) | contains_any(path, STRICT_PATHS.get(page_category, []))
    return (F.try_parse_url(url, F.lit("HOST")) == host) & ((own == "") | (own == page_category)) & strict & contains_any(path, SUPPORT_PATHS)
