"""Replace values in texts, plan it and check it.

A value may stand anywhere in a text. ``find_values`` tells which values each
text holds: values and texts meet on a short piece of the value (its anchor),
so no text is compared with every value. ``redact`` then replaces, in each text,
only the values found there, longest first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from credtrail.functions import windows
from credtrail.functions.text import mask, quote_regex
from credtrail.functions.values import is_usable_value
from credtrail.operators.aggregate import detect_source
from credtrail.operators.dedup import distinct_files, usable_values
from credtrail.plans.ranking import numbered
from credtrail.plans.sizing import BROADCAST_BYTES, broadcast_if_small, byte_size
from credtrail.plans.storage import materialized, stored

# Fixed value: what a secret is replaced by.
REMOVED = "***REMOVED***"

# Fixed value: how many values one replacement pattern holds.
BATCH_SIZE = 100

# Length of an anchor. Most values have a piece of this many word characters;
# prose has few, so texts offer few anchors to the join.
ANCHOR = 8

# From so many pieces at the end of a value its anchor is chosen.
ANCHORS_TRIED = 8

# The sieve in front of the join has this many bits per anchor, in so many longs at most.
SIEVE_BITS = 32
SIEVE_LONGS = 1 << 17


def pieces(text: Column, length: int, word: bool) -> Column:
    """Distinct overlapping pieces of a text, in one regex pass."""
    unit = "[0-9A-Za-z_]" if word else "."
    found = F.regexp_extract_all(text, F.lit(f"(?s)(?=({unit}{{{length}}}))"), F.lit(1))
    return F.array_distinct(found)


def anchors(values: DataFrame) -> DataFrame:
    """``(value, word, size, anchor)``: for each value its rarest piece.

    Values often share their start (key prefixes, token headers); the piece that
    the fewest values share keeps the join free of hot anchors.
    """
    value = F.col("value")
    size = F.least(F.length(value), F.lit(ANCHOR))
    word = value.rlike(f"[0-9A-Za-z_]{{{ANCHOR}}}")
    options = F.when(word, pieces(value, ANCHOR, True))
    for n in range(1, ANCHOR):
        options = options.when(size == n, F.array(value))
    options = options.otherwise(pieces(value, ANCHOR, False))
    # Any piece will do. The last ones are enough to find a rare one: what values
    # share is mostly their start.
    some = F.slice(options, F.greatest(F.size(options) - (ANCHORS_TRIED - 1), F.lit(1)),
                   F.lit(ANCHORS_TRIED))
    each = values.select(
        "value", word.alias("word"), size.alias("size"), F.explode(some).alias("anchor")
    )
    counts = each.groupBy("word", "size", "anchor").agg(F.count("*").alias("_n"))
    rarest = F.min(F.struct("_n", "anchor"))["anchor"]
    rated = each.join(counts, ["word", "size", "anchor"])
    return rated.groupBy("value", "word", "size").agg(rarest.alias("anchor"))


def _longs(table: DataFrame) -> int:
    longs, bits = 16, SIEVE_BITS * table.count()
    while longs < SIEVE_LONGS and longs * 64 < bits:
        longs *= 2
    return longs


def _sieve(table: DataFrame) -> tuple[Column, int]:
    """A bit table of the anchors, as a subquery of one row, and its number of longs.

    A piece whose bit is not set is no anchor. The table has a fixed upper size; with more
    anchors than it is made for it lets more pieces pass."""
    longs = _longs(table)
    place = _place(F.col("anchor"), longs)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))
    set_bits = table.groupBy(F.floor(place / 64).alias("id")).agg(F.bit_or(bit).alias("_bits"))
    words = table.sparkSession.range(longs).join(set_bits, "id", "left")
    listed = F.array_sort(F.collect_list(F.struct("id", F.coalesce("_bits", F.lit(0)).alias("bits"))))
    return words.agg(F.transform(listed, lambda w: w["bits"])).scalar(), longs


def _place(piece: Column, longs: int) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(longs * 64))


def _passes(piece: Column, bits: Column, longs: int) -> Column:
    place = _place(piece, longs)
    word = F.get(bits, F.floor(place / 64).cast("int"))
    return F.call_function("shiftright", word, (place % 64).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1


def _window_sieve(table: DataFrame) -> np.ndarray:
    """As :func:`_sieve`, for windows of bytes."""
    longs = _longs(table)

    def placed(parts):
        for part in parts:
            yield windows.sieve_bits(part.column("anchor"), longs)

    each = table.select("anchor").mapInArrow(placed, "id bigint, bits bigint")
    bits = np.zeros(longs, np.uint64)
    # One row per long at most.
    for row in each.groupBy("id").agg(F.bit_or("bits").alias("bits")).collect():
        bits[row["id"]] = row["bits"] & (1 << 64) - 1
    return bits


def _offers(texts: DataFrame, table: DataFrame, key: list[str], text: str) -> DataFrame | None:
    """``(*key, _line, anchor)``: the windows of the texts that may be anchors, in one pass.

    Values have no line ends (they come from lines), so texts are cut into lines,
    which keeps the windows of one row few; if some value has one, the whole text
    is taken at once. Windows are tried where they stand: a line is passed on with the few of
    them that the sieve lets through, each once.
    """
    sizes = sorted(r[0] for r in table.select(F.octet_length("anchor")).distinct().collect())
    if not sizes:
        return None
    whole = table.where(F.col("value").contains("\n")).limit(1).count() > 0
    units = F.array(F.col(text)) if whole else F.split(F.col(text), "\n")
    lines = texts.select(*key, F.explode(units).alias("_line"))
    # No value can be in a line shorter than the shortest one.
    lines = lines.where(F.octet_length("_line") >= sizes[0])
    sieve = _window_sieve(table)

    def offered(parts):
        for part in parts:
            yield from windows.with_windows(part, "_line", sizes, sieve)

    kept = lines.mapInArrow(offered, StructType([*lines.schema, StructField("_anchors", ArrayType(StringType()))]))
    return kept.select(*key, "_line", F.explode("_anchors").alias("anchor"))


def candidates(
    texts: DataFrame, values: DataFrame, key: list[str], text: str
) -> tuple[DataFrame, bool]:
    """``(*key, value)`` with at least the values each text holds, and whether it
    is exactly those. ``key`` must be unique.

    With anchors small enough to broadcast, texts stay where they are and each
    line is checked at once. Otherwise keys and the windows that pass the sieve are shuffled,
    without the text, and a pair only says that the anchor is there.
    """
    table = stored(anchors(values), "anchors")
    small = byte_size(table) <= BROADCAST_BYTES
    offers = _offers(texts, table, key, text)
    if offers is None:
        none = texts.select(*key, F.lit("").alias("value")).where(F.lit(False))
        return none, True
    looked_up = table.select("anchor", "value")
    if small:
        met = offers.join(F.broadcast(looked_up), "anchor")
        # A short value is its own anchor.
        met = met.where((F.col("anchor") == F.col("value")) | F.col("_line").contains(F.col("value")))
    else:
        # Windows are told by their first bytes; what is shuffled is tried as a whole before.
        likely = offers.where(_passes(F.col("anchor"), *_sieve(table)))
        met = likely.select(*key, "anchor").distinct().join(looked_up, "anchor")
    return met.select(*key, "value").distinct(), small


def find_values(texts: DataFrame, values: DataFrame, key: list[str], text: str) -> DataFrame:
    """``(*key, value)``: exactly the values each text holds."""
    pairs, exact = candidates(texts, values, key, text)
    if exact:
        return pairs
    held = pairs.join(texts.select(*key, F.col(text).alias("_text")), key)
    return held.where(F.col("_text").contains(F.col("value"))).select(*key, "value")


def fold(text: Column, values: Column, replacement: str = REMOVED) -> Column:
    """Replace the values of an array one after the other, longest first. A value
    that is not in the text changes nothing, so candidates give the same result.

    Each value cuts the pieces that the values before have left, and the replacement comes in
    between at the end: no value can match across it or inside it, whatever the text holds."""
    ordered = F.array_sort(
        F.transform(values, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v"), quote_regex(v).alias("q")))
    )

    def cut(parts: Column, v: Column) -> Column:
        return F.flatten(F.transform(parts, lambda part: F.split(part, v["q"], -1)))

    return F.array_join(F.aggregate(ordered, F.array(text), cut), replacement)


def _with_lists(texts: DataFrame, lists: DataFrame, key: list[str]) -> DataFrame:
    """``texts`` with the column ``_list`` of ``lists (*key, _list, _bytes)``, null where a text has none.

    What was found is small next to the texts. If measured so, it is broadcast
    and the texts are not shuffled at all."""
    names = {k: f"_f_{k}" for k in key}
    right = lists.withColumnsRenamed(names)
    size = lists.agg(F.coalesce(F.sum(F.col("_bytes") + 64), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        right = F.broadcast(right)
    same = None
    for k, renamed in names.items():
        test = F.col(k).eqNullSafe(F.col(renamed))
        same = test if same is None else same & test
    return texts.join(right, same, "left").select(*texts.columns, "_list")


def _replaced(texts: DataFrame, listed: DataFrame, text: str, done: Column) -> DataFrame:
    done = F.when(F.col("_list").isNull(), F.col(text)).otherwise(done)
    return listed.select(*texts.columns, done.alias("redacted")).withColumn(
        "modified", ~F.col("redacted").eqNullSafe(F.col(text))
    )


def redact_by_anchor(
    texts: DataFrame,
    values: DataFrame,
    key: list[str],
    text: str,
    replacement: str = REMOVED,
) -> DataFrame:
    """Add ``redacted`` and ``modified``, for any number of values."""
    # Replacing a value that is not there changes nothing, so candidates will do.
    # One group holds values of one text, which bounds them.
    lists = candidates(texts, values, key, text)[0].groupBy(*key).agg(
        F.collect_set("value").alias("_list"), F.sum(F.octet_length("value")).alias("_bytes")
    )
    listed = _with_lists(texts, stored(lists, "found"), key)
    return _replaced(texts, listed, text, fold(F.col(text), F.col("_list"), replacement))


def redact(
    texts: DataFrame,
    values: DataFrame,
    key: list[str],
    text: str,
    replacement: str = REMOVED,
) -> DataFrame:
    """Add ``redacted`` and ``modified``, with one meaning for any number of values."""
    return redact_by_anchor(texts, values, key, text, replacement)


def redact_files(
    files: DataFrame,
    found: DataFrame,
    key: list[str],
    text: str,
    replacement: str = REMOVED,
    max_bytes: int | None = None,
) -> DataFrame:
    """Redact the files named by the findings, and no others; larger files than
    ``max_bytes`` stay as they are. Returns the files looked at."""
    named = materialized(distinct_files(found.where(is_usable_value(F.col("value")))))
    kept = files.join(broadcast_if_small(named), "file", "left_semi")
    if max_bytes is not None:
        kept = kept.where(F.octet_length(text) <= max_bytes)
    return redact(kept, usable_values(found), key, text, replacement)


def redact_lines(
    lines: DataFrame, values: DataFrame, key: list[str], replacement: str = REMOVED
) -> DataFrame:
    """Redact a whole history: both signs, all files, no size limit."""
    return redact(lines, values, key, "line", replacement)


def redact_by_pattern(
    texts: DataFrame,
    values: DataFrame,
    key: list[str],
    text: str,
    replacement: str = REMOVED,
) -> DataFrame:
    """The other kernel: one regex replacement per pattern batch, for any number of values.

    Text put in by an earlier batch can be hit by a later one, text inside a
    batch cannot, and overlapping values give another result than :func:`redact`. Each text
    meets only the part of a batch that can match there: the values it may hold, and
    those that a replacement could complete (rare; they are tried on every text that changes).
    """
    placed = numbered(
        values.withColumn("_length", F.length("value")),
        [F.col("_length").desc(), F.col("value").asc()],
    )
    entry = F.struct(
        F.floor((F.col("position") - 1) / F.lit(BATCH_SIZE)).alias("batch"), "position", quote_regex(F.col("value")).alias("q")
    )
    placed = stored(placed.select("value", entry.alias("_entry")), "placed-values")
    found = candidates(texts, values, key, text)[0].join(placed, "value")
    lists = found.groupBy(*key).agg(
        F.collect_list("_entry").alias("_list"), F.sum(F.octet_length("value")).alias("_bytes")
    )
    later = placed.where(_can_complete(F.col("value"), replacement))
    more = later.agg(F.collect_list("_entry").alias("e"), F.sum(F.octet_length("value")).alias("n"))
    lists = lists.select(
        *key,
        F.concat("_list", more.select("e").scalar()).alias("_list"),
        (F.col("_bytes") + F.coalesce(more.select("n").scalar(), F.lit(0))).alias("_bytes"),
    )
    listed = _with_lists(texts, stored(lists, "found"), key)
    entries = F.array_sort(F.array_distinct("_list"))
    patterns = F.transform(
        F.array_distinct(F.transform(entries, lambda e: e["batch"])),
        lambda b: F.array_join(
            F.transform(F.filter(entries, lambda e: e["batch"] == b), lambda e: e["q"]), "|"
        ),
    )
    with_dollar = F.lit(replacement.replace("\\", "\\\\").replace("$", "\\$"))
    done = F.aggregate(patterns, F.col(text), lambda t, p: F.regexp_replace(t, p, with_dollar))
    return _replaced(texts, listed, text, done)


def _can_complete(value: Column, replacement: str) -> Column:
    """Whether a value can match text of which a replacement is a part."""
    if not replacement:
        return F.lit(True)  # what stood apart comes together
    test = F.lit(replacement).contains(value) | value.contains(replacement)
    for n in range(1, len(replacement)):
        test = test | value.startswith(replacement[-n:]) | value.endswith(replacement[:n])
    return test


def _guard(values: Column, size: int = 4) -> Column:
    """A look-ahead for the characters the values start with, so that the regex
    rarely has to try them one by one."""
    shortest = F.array_min(F.transform(values, F.length))

    def one_of(place: int) -> Column:
        chars = F.array_distinct(F.transform(values, lambda v: F.substring(v, place, 1)))
        quoted = F.transform(
            F.array_sort(chars), lambda c: F.regexp_replace(c, "([^0-9A-Za-z])", r"\\$1")
        )
        listed = F.concat(F.lit("["), F.array_join(quoted, ""), F.lit("]"))
        return F.when(shortest >= place, listed).otherwise("")

    return F.concat(F.lit("(?="), *[one_of(n) for n in range(1, size + 1)], F.lit(")"))


def pattern_batches(values: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """``(batch, n, pattern, guard)``: quoted values, longest first, ``size`` to a
    pattern. One group holds ``size`` values at most."""
    ordered = numbered(
        values.withColumn("_length", F.length("value")),
        [F.col("_length").desc(), F.col("value").asc()],
    )
    batch = F.floor((F.col("position") - 1) / F.lit(size)).cast("int")
    ranked = F.array_sort(F.collect_list(F.struct("position", "value")))
    rows = ordered.groupBy(batch.alias("batch")).agg(
        F.transform(ranked, lambda r: r["value"]).alias("_values")
    )
    body = F.array_join(F.transform("_values", quote_regex), "|")
    return rows.select(
        "batch",
        F.size("_values").alias("n"),
        F.concat(F.lit("("), body, F.lit(")")).alias("pattern"),
        _guard(F.col("_values")).alias("guard"),
    )


def redact_plan(found: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Dry run: how many values and patterns, and which source."""
    counts = usable_values(found).agg(F.count("*").alias("n_values"))
    n_files = distinct_files(found.where(is_usable_value(F.col("value")))).agg(
        F.count("*").alias("n")
    )
    source = detect_source(found).select("source").scalar()
    return counts.select(
        "n_values",
        F.ceil(F.col("n_values") / F.lit(size)).cast("bigint").alias("n_patterns"),
        source.alias("source"),
        n_files.scalar().alias("n_files"),
    )


def redact_preview(values: DataFrame, size: int = 10) -> DataFrame:
    """The first values of a dry run, masked."""
    first = values.orderBy(F.length("value").desc(), "value").limit(size)
    # At most ``size`` rows are left to rank.
    rank = F.row_number().over(Window.orderBy(F.length("value").desc(), F.col("value")))
    return first.select(rank.alias("rank"), mask(F.col("value")).alias("masked"))


def redact_summary(redacted: DataFrame) -> DataFrame:
    """Outcome of a redaction."""
    return redacted.agg(
        F.count("*").alias("texts"),
        F.count_if("modified").alias("texts_modified"),
    )


def redact_outcome(redacted: DataFrame, found: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """What a redaction did, in one row: values and patterns, their source, and the texts and files
    that changed. ``redacted`` has a column ``file``."""
    plan = redact_plan(found, size)
    done = redacted.agg(
        F.count("*").alias("texts"),
        F.count_if("modified").alias("texts_modified"),
        F.count_distinct(F.when(F.col("modified"), F.col("file"))).alias("files_modified"),
    )
    return done.select(
        plan.select("n_values").scalar().alias("secrets_removed"),
        plan.select("n_patterns").scalar().alias("patterns_used"),
        plan.select("source").scalar().alias("source"),
        "texts", "texts_modified", "files_modified",
    )


def changed_files(redacted: DataFrame) -> DataFrame:
    """The files that a redaction changes, with the number of texts in each."""
    return redacted.where("modified").groupBy("file").agg(F.count("*").alias("texts_modified"))


def residual(redacted: DataFrame, values: DataFrame, key: list[str]) -> DataFrame:
    """Texts that still hold a value after redaction: ``(*key, value)``."""
    return find_values(redacted, values, key, "redacted")


@dataclass(frozen=True)
class Loaded:
    """What a cleaning run takes from a scan: values, files and their source."""

    values: DataFrame
    files: DataFrame
    source: DataFrame


def load_for_cleaning(found: DataFrame) -> Loaded:
    usable = found.where(is_usable_value(F.col("value")))
    return Loaded(usable_values(found), distinct_files(usable), detect_source(found))

