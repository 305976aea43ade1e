"""Keyword tests on a line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credtrail.functions.files import any_of
from credtrail.functions.text import java_quote
from credtrail.rules import Rules


def _folded(line: Column, rules: Rules) -> Column:
    return line if rules.case_sensitive else F.lower(line)


def _needle(keyword: str, rules: Rules) -> str:
    return keyword if rules.case_sensitive else keyword.lower()


def has_keyword(line: Column, keyword: str, rules: Rules) -> Column:
    return _folded(line, rules).contains(_needle(keyword, rules))


def smallest_cover(words: list[str]) -> list[str]:
    """The words that contain no other word: a line holds a word of the list
    exactly when it holds one of these."""
    unique = list(dict.fromkeys(words))
    return [w for w in unique if not any(o != w and o in w for o in unique)]


def holds_any(text: Column, words: list[str]) -> Column:
    """One regex for all words keeps the generated code small."""
    if not words:
        return F.lit(False)
    return text.rlike("|".join(java_quote(w) for w in smallest_cover(words)))


def has_any_keyword(line: Column, rules: Rules) -> Column:
    words = [_needle(kw, rules) for _, _, kw in rules.keywords]
    return holds_any(_folded(line, rules), words)


def may_match(line: Column, rules: Rules) -> Column:
    """Cheap necessary condition for any extraction pattern."""
    needs = [p.needs for p in rules.patterns]
    if not needs or any(n is None for n in needs):
        return F.lit(True)
    return any_of(line.contains(n) for n in dict.fromkeys(needs))


def word_array(words: list[str]) -> Column:
    """A constant array; Catalyst folds the split."""
    return F.split(F.lit("\n".join(words)), "\n")


def keyword_indexes(line: Column, rules: Rules) -> Column:
    """``kw_idx`` of all keywords in the line, ascending. A keyword listed twice
    is there twice; the first element is the lowest, the size the count."""
    words = word_array([_needle(kw, rules) for _, _, kw in rules.keywords])
    places = F.sequence(F.lit(0), F.lit(len(rules.keywords) - 1))
    # The outer lambda folds the line once, not once per keyword.
    found = F.transform(
        F.array(_folded(line, rules)),
        lambda text: F.filter(places, lambda i: F.contains(text, words[i])),
    )
    return found[0]


def keyword_name(kw_idx: Column, rules: Rules) -> Column:
    names = word_array([kw for _, _, kw in rules.keywords])
    return F.try_element_at(names, kw_idx + 1)
