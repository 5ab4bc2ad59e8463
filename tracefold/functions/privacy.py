"""Sensitivity of values, card checks, secrets: column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bound import bound

LEVELS = ["PUBLIC", "PERSONAL", "SENSITIVE", "RESTRICTED"]
REDACTED, SUPPRESSED, SECRET = "[REDACTED]", "[SUPPRESSED: SENSITIVE PERSONAL DATA]", "[REDACTED SECRET]"
# Patterns of card numbers, social security numbers and mail addresses.
CARD = r"\b(?:[0-9]{4}[ -]?){3}[0-9]{1,7}\b|\b[0-9]{13,19}\b"
SOCIAL_NUMBER = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
EMAIL = r"\b[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+\b"
#: Keys may stand after a beginning, a character that is no letter or digit, or "_"; they end likewise.
_BEFORE, _AFTER = r"(?i)(?:^|[^A-Za-z0-9])(?:", r")(?:[^A-Za-z0-9]|$)"
#: name, level, whether it is redacted, words of a key, pattern of a value. Fixed values.
RULES = [
    ("credential", 3, True, ["password", "passwd", "secret", "token", "api[_-]?key", "private[_-]?key", "credential", "authorization", "cookie", "session[_-]?id", "access[_-]?key"], None),
    ("payment_card", 3, True, ["card[_-]?number", "iban", "bic", "swift", "account[_-]?number"], CARD),
    ("government_id", 3, True, ["ssn", "social[_-]?security", "passport[_-]?(?:no|number)", "national[_-]?id", "tax[_-]?id", "driver[_-]?licen[cs]e", "nino", "aadhaar"], SOCIAL_NUMBER),
    ("residential_address", 2, True, ["street[_-]?address", "home[_-]?address", "postal[_-]?address", "address[_-]?line", "residence", "post[_-]?code", "zip[_-]?code"], None),
    ("precise_location", 2, True, ["latitude", "longitude", "geo[_-]?coordinates", "gps", "geolocation"], None),
    ("date_of_birth", 2, True, ["date[_-]?of[_-]?birth", "dob", "birth[_-]?date", "birthday"], None),
    ("phone_number", 2, True, ["phone", "mobile", "telephone", "msisdn", "whatsapp"], None),
    ("breach_exposure", 2, False, ["breach[a-z]*", "pwned[a-z]*", "exposure[a-z]*"], None),
    ("email_address", 1, False, ["email", "e[_-]?mail", "mailbox"], EMAIL),
    ("person_name", 1, False, ["full[_-]?name", "first[_-]?name", "last[_-]?name", "surname", "given[_-]?name", "real[_-]?name", "display[_-]?name", "bio", "biography"], None),
    ("coarse_location", 1, False, ["location", "city", "country", "region", "place"], None),
]
#: category, pattern: published shapes of credentials. Fixed values.
SECRETS = [
    ("cloud access key id", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("code host token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("private key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("signed web token", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("assigned token", r"(?i)\b(?:token|secret|password|api[_-]?key) ?[:=] ?[\"'][^\"'\n]{8,}[\"']"),
]
#: Keys that keep their value unless it is restricted. Fixed values.
PRESERVED = ["url", "source_url", "profile_url", "html_url", "archived_url", "original_url", "hostname", "domain", "record_type", "platform", "repository", "secret_type", "status", "commit"]


def luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits (other characters are dropped) pass the check sum."""
    d = F.regexp_replace(digits, "[^0-9]", "")
    n = F.length(d)
    at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))

    def weight(k: Column) -> Column:
        x = F.substring(d, k, F.lit(1)).cast("int") * F.when((n - k) % 2 == 1, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    total = F.aggregate(F.transform(at, weight), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.coalesce(n.between(13, 19) & (total % 10 == 0), F.lit(False))


def _matches(key: Column, value: Column, words: list[str], pattern: str | None) -> Column:
    found = F.coalesce(key.rlike(_BEFORE + "|".join(words) + _AFTER), F.lit(False))
    if pattern == CARD:
        return found | luhn(F.regexp_extract(value, CARD, 0))
    return found | F.coalesce(value.rlike(pattern), F.lit(False)) if pattern else found


def classify(key: Column, value: Column) -> Column:
    """Struct of level (0 to 3), redact and the names of the rules that matched, in order."""
    value = F.coalesce(value, F.lit(""))
    hits = [(name, level, redact, _matches(key, value, words, pattern)) for name, level, redact, words, pattern in RULES]
    level = F.greatest(F.lit(0), F.lit(0), *(F.when(hit, level).otherwise(0) for _, level, _, hit in hits))
    redact = F.lit(False)
    for _, lv, does, hit in hits:
        if does and lv >= 2:
            redact = redact | hit
    rules = F.array_compact(F.array(*(F.when(hit, name) for name, _, _, hit in hits)))
    return F.struct(level.alias("level"), redact.alias("redact"), rules.alias("rules"))


def redact_secrets(text: Column) -> Column:
    for _, pattern in SECRETS:
        text = F.regexp_replace(text, pattern, SECRET)
    return text


def count_secrets(text: Column) -> dict[str, Column]:
    return {category: F.regexp_count(text, F.lit(pattern)) for category, pattern in SECRETS}


LONGEST, CUT = 4000, "…[truncated]"


def stored(key: Column, value: Column) -> Column:
    """Struct of the value as it may be stored, its level (a secret has the highest) and whether
    something was removed. Secrets go first, then the key's and the value's rules apply; of a longer
    value 4000 characters and a mark are kept. Secrets go before the cut, which so leaves no part of
    one."""

    def cut(text: Column) -> Column:
        return F.when(F.length(text) > LONGEST, F.concat(F.substring(text, 1, LONGEST), F.lit(CUT))).otherwise(text)

    def judged(x: Column) -> Column:
        found, clean = x["found"], x["clean"]
        secret = F.coalesce(clean != value, F.lit(False))
        removed = found["redact"] & ~(F.lower(key).isin(PRESERVED) & (found["level"] < 3))
        marker = F.when(found["level"] == 3, REDACTED).otherwise(SUPPRESSED)
        kept = F.when(value.isNull(), value).when(secret, cut(clean)).when(removed, marker).otherwise(cut(value))
        return F.struct(kept.alias("value"), F.when(secret, len(LEVELS) - 1).otherwise(found["level"]).alias("level"), (value.isNotNull() & (secret | removed)).alias("redacted"))

    return bound(F.struct(classify(key, value).alias("found"), redact_secrets(value).alias("clean")), judged)


def filtered(key: Column, value: Column) -> Column:
    """The value as it may be stored."""
    return stored(key, value)["value"]


def is_redacted(value: Column) -> Column:
    return F.coalesce(value.contains(REDACTED) | value.contains(SUPPRESSED) | value.contains(SECRET), F.lit(False))


def excerpt(text: Column, most: int = 500) -> Column:
    clean = F.trim(redact_secrets(text))
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, most), F.lit("…"))).otherwise(clean)


def level_name(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), level + 1)


def level_rank(name: Column) -> Column:
    ladder = F.when(name == LEVELS[0], 0)
    for rank, level in enumerate(LEVELS[1:], 1):
        ladder = ladder.when(name == level, rank)
    return ladder


def withheld(data: Column, rank: Column, most: int) -> tuple[Column, Column]:
    """The data for export, a marker above level `most`, and whether it was withheld."""
    over = rank > most
    return F.when(over, F.concat(F.lit("[WITHHELD: "), level_name(rank), F.lit("]"))).otherwise(data), over
