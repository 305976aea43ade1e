"""Which extracted values are no secrets, and why."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credtrail.functions.keywords import holds_any, smallest_cover
from credtrail.functions.text import java_quote
from credtrail.rules import Rules

# Starts of a code fragment.
CODE_STARTS = ("func ", "return ", "if ", "for ", "range ", "make(", "append(", "new(", "len(")

# Starts of an address.
URL_STARTS = ("http://", "https://", "ftp://", "ssh://", "file://", "mailto:")

# Words that are no secret by themselves.
COMMON_WORDS = ("password", "secret", "token", "key", "credential", "auth", "pass", "pwd")

# Braces at the ends, a code word at the start, identifier.Field with one dot
# only, or more than two dots.
CODE = "|".join(
    (
        r"^\{",
        r"\}\z",
        "^(?:" + "|".join(java_quote(w) for w in CODE_STARTS) + ")",
        r"^[A-Za-z0-9_]+[.][A-Z][^.]*\z",
        r"[.][^.]*[.][^.]*[.]",
    )
)
URL = "^(?:" + "|".join(java_quote(w) for w in URL_STARTS) + ")"
COMMON = "^(?:" + "|".join(COMMON_WORDS) + r")\z"


def value_length(value: Column, rules: Rules) -> Column:
    return F.octet_length(value) if rules.length_in_bytes else F.length(value)


def bad_length(value: Column, rules: Rules) -> Column:
    return ~value_length(value, rules).between(rules.min_length, rules.max_length)


def looks_like_code(value: Column) -> Column:
    return (
        (value.contains("(") & value.contains(")"))
        | (value.contains("[") & value.contains("]"))
        | value.rlike(CODE)
    )


def is_url(value: Column) -> Column:
    return F.lower(value).rlike(URL)


def is_common_word(value: Column) -> Column:
    return F.lower(value).rlike(COMMON)


def ignored_texts(rules: Rules) -> list[str]:
    """The value is folded in every case, the listed text only if case does not
    matter: with ``case_sensitive`` an entry in upper case never applies."""
    if rules.case_sensitive:
        return list(rules.ignored_values)
    return [t.lower() for t in rules.ignored_values]


def has_ignored_text(value: Column, rules: Rules) -> Column:
    return holds_any(F.lower(value), ignored_texts(rules))


def reject_tests(value: Column, rules: Rules) -> list[tuple[str, Column]]:
    return [
        ("length", bad_length(value, rules)),
        ("code", looks_like_code(value)),
        ("url", is_url(value)),
        ("common_word", is_common_word(value)),
        ("ignored_text", has_ignored_text(value, rules)),
    ]


def is_ignored_value(value: Column, rules: Rules) -> Column:
    """Any of the tests; those on the folded value share one regex."""
    texts = [java_quote(t) for t in smallest_cover(ignored_texts(rules))]
    folded = F.lower(value).rlike("|".join([URL, COMMON, *texts]))
    return bad_length(value, rules) | looks_like_code(value) | folded


def reject_reason(value: Column, rules: Rules) -> Column:
    """Name of the first test that fires, null for a secret."""
    return F.coalesce(*[F.when(test, name) for name, test in reject_tests(value, rules)])


def is_usable_value(value: Column) -> Column:
    """Fit for redaction."""
    return (value != "") & ~value.contains("REMOVED")
