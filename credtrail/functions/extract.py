"""Key and value of a line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credtrail.functions.text import java_regex, strip_space
from credtrail.functions.values import is_ignored_value
from credtrail.rules import Rules


def extracted(line: Column, rules: Rules) -> Column:
    """``struct(pattern, key, value)`` of the first pattern that matches, else null."""
    tries = []
    for p in rules.patterns:
        regex = java_regex(p.regex)
        value = strip_space(F.regexp_extract(line, regex, p.value_group))
        found = F.struct(
            F.lit(p.name).alias("pattern"),
            strip_space(F.regexp_extract(line, regex, 1)).alias("key"),
            value.alias("value"),
        )
        fires = line.rlike(regex)
        if p.needs is not None:
            fires = line.contains(p.needs) & fires
        if rules.fallthrough:
            fires = fires & ~is_ignored_value(value, rules)
        tries.append(F.when(fires, found))
    return F.coalesce(*tries)
