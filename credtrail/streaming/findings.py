"""Findings, first findings and running statistics over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from credtrail.functions.keywords import keyword_name
from credtrail.functions.text import mask
from credtrail.operators.scan import scan_current, scan_history, secret_keys
from credtrail.rules import Rules, default_rules
from credtrail.sources.records import as_entries, parsed_findings


def history_stream(lines: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Findings of a stream of patch lines. The type is the first keyword of the
    line: an order over the whole input cannot hold in a stream."""
    rules = rules or default_rules()
    found = scan_history(lines, rules)
    return found.withColumn("type", keyword_name(F.col("kw_first"), rules))


def current_stream(lines: DataFrame, scan_date: Column, rules: Rules | None = None) -> DataFrame:
    """Findings of a stream of file lines."""
    rules = rules or default_rules()
    found = scan_current(lines, scan_date, rules)
    return found.withColumn("type", keyword_name(F.col("kw_first"), rules))


FINDING_COLUMNS = ("repo", "file", "key", "value", "type", "commit", "author", "date", "date_raw")


def entries(found: DataFrame) -> DataFrame:
    return found.select(*(c for c in FINDING_COLUMNS if c in found.columns))


def both_stream(history: DataFrame, current: DataFrame) -> DataFrame:
    """One stream of both, the current files with ``src_rank`` 0."""

    def placed(found: DataFrame, source: int) -> DataFrame:
        order = [c for c in ORDER if c in found.columns and c not in FINDING_COLUMNS]
        return found.select(*entries(found).columns, *order, F.lit(source).alias("src_rank"))

    return placed(history, 1).unionByName(placed(current, 0), allowMissingColumns=True)


def _thin_out(keys: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop_duplicates(keys)

    return run


def first_in_stream(found: DataFrame, watermark: str | None = None) -> DataFrame:
    """Each (file, key, value) once.

    Repeats inside an Arrow batch go before the shuffle, so a hot value does not
    flood one state partition. The state keeps every value ever seen, as the
    feature asks; with ``watermark`` (a delay on ``date``) it forgets old ones
    and a value may come again after that.
    """
    keys = [*secret_keys(found), "value"]
    rows = entries(found)
    rows = rows.mapInPandas(_thin_out(keys), rows.schema)
    if watermark is None:
        return rows.dropDuplicates(keys)
    return rows.withWatermark("date", watermark).dropDuplicatesWithinWatermark(keys)


# What decides which finding of a value is the first: its source, keyword, log and place there. The
# commit and author only make the order total.
ORDER = {"src_rank": "INT", "kw_first": "INT", "path": "STRING", "seq": "BIGINT", "commit": "STRING", "author": "STRING"}


def least_in_stream(found: DataFrame) -> DataFrame:
    """A log of changes: for each (file, key, value) its first finding so far, and one more
    row (``version`` 2, 3, …) whenever an earlier finding arrives.

    "First" is as in :func:`credtrail.operators.dedup.first_findings`, and so the row of the highest
    version, :func:`latest_versions`, does not depend on how the input is cut into triggers. The state
    holds the order of the row per value, as the feature asks. Repeats inside an Arrow batch
    go before the shuffle, so a hot value does not flood one state partition.
    """
    keys = [*secret_keys(found), "value"]
    shown = entries(found)
    order = [c for c in ORDER if c in found.columns]
    # Unions fill columns that one side lacks with nulls, which numbers of pandas do not have.
    absent = {"INT": F.lit(-1), "BIGINT": F.lit(-1).cast("bigint"), "STRING": F.lit("")}
    ranked = found.select(
        *shown.columns,
        *(F.coalesce(F.col(c).cast(ORDER[c]), absent[ORDER[c]]).alias(f"_o_{c}") for c in order),
    )
    places = [f"_o_{c}" for c in order]

    def thinned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.sort_values(places).drop_duplicates(keys)

    def least(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get if state.exists else None
        best, row = known and tuple(known[:-1]), None
        for batch in batches:
            head = batch.sort_values(places).head(1)
            place = tuple(x.item() if hasattr(x, "item") else x for x in head[places].iloc[0].tolist())
            if best is None or place < best:
                best, row = place, head
        if row is not None:
            version = known[-1] + 1 if known else 1
            state.update((*best, version))
            yield row.drop(columns=places).assign(version=version)

    state_type = ", ".join([*(f"`{p}` {ORDER[c]}" for p, c in zip(places, order)), "version BIGINT"])
    out = StructType([*shown.schema.fields, StructField("version", LongType())])
    thin = ranked.mapInPandas(thinned, ranked.schema)
    return thin.groupBy(*keys).applyInPandasWithState(least, out, state_type, "append", GroupStateTimeout.NoTimeout)


def latest_versions(changes: DataFrame) -> DataFrame:
    """The rows that hold, of a log of changes that a stream has written."""
    keys = [*secret_keys(changes), "value"]
    rest = [c for c in changes.columns if c not in keys]
    best = F.max(F.struct("version", F.struct(*rest).alias("_row"))).alias("_best")
    return changes.groupBy(*keys).agg(best).select(*keys, "_best._row.*").drop("version")


def write_findings_stream(
    found: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """JSON-lines sink, exactly once. Instants keep their microseconds."""
    masked = found.withColumn("maskedValue", mask(F.col("value")))
    writer = masked.writeStream.format("json").outputMode("append")
    writer = writer.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_findings_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over JSON-lines findings, unreadable lines left out."""
    parsed = parsed_findings(spark.readStream.text(path))
    return as_entries(parsed.where(~F.col("bad")).drop("bad"))


def running_counts(stream: DataFrame, by: str) -> DataFrame:
    """Findings per author, file or type so far; complete or update mode."""
    return stream.groupBy(by).agg(F.count("*").alias("count"))


# After so many epochs the counts so far are written as one.
FOLDED_EVERY = 16

COUNT_SCHEMA = "section STRING, name STRING, n BIGINT, folded INT, epoch BIGINT"


def section_counts(found: DataFrame, sections: Sequence[str]) -> DataFrame:
    """``(section, name, n)``: findings by each of the columns, and all of them (section ``total``),
    in one pass and one aggregate."""
    listed = [F.struct(F.lit(s).alias("section"), F.col(s).cast("string").alias("name")) for s in sections]
    listed.append(F.struct(F.lit("total").alias("section"), F.lit("").alias("name")))
    each = found.select(F.inline(F.array(*listed)))
    return each.groupBy("section", "name").agg(F.count("*").alias("n"))


def counts_upsert(path: str, sections: Sequence[str], every: int = FOLDED_EVERY) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: keep the long table of counts under ``path`` up to date.

    An epoch owns the folder ``folded=0/epoch=N`` and writes it whole, so a batch that
    is run again after a failure changes nothing. From time to time all folders so far become one
    (``folded=1``), so that readers need not add up a long tail."""

    def save(batch: DataFrame, epoch: int) -> None:
        counts = section_counts(batch, sections)
        counts.write.mode("overwrite").parquet(f"{path}/folded=0/epoch={epoch}")
        if (epoch + 1) % every == 0:
            so_far = _counts_until(batch.sparkSession, path, epoch)
            so_far.write.mode("overwrite").parquet(f"{path}/folded=1/epoch={epoch}")

    return save


def _counts_until(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    """Sums of all epochs up to ``epoch``, from the last folding before it."""
    rows = spark.read.schema(COUNT_SCHEMA).option("basePath", path).parquet(path)
    rows = rows.where(F.col("epoch") <= epoch)
    # A folding of this very epoch may be left from a run that failed.
    before = rows.where((F.col("folded") == 1) & (F.col("epoch") < epoch)).agg(F.max("epoch")).first()[0]
    start = -1 if before is None else before
    kept = rows.where(
        ((F.col("folded") == 1) & (F.col("epoch") == start)) | ((F.col("folded") == 0) & (F.col("epoch") > start))
    )
    return kept.groupBy("section", "name").agg(F.sum("n").alias("n"))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """``(section, name, count)`` over all epochs under ``path``."""
    sums = _counts_until(spark, path, (1 << 62))
    return sums.withColumnRenamed("n", "count")


def findings_per_day(stream: DataFrame, delay: str | None = None) -> DataFrame:
    """Findings per day of the commit. Without ``delay`` nothing is ever too late: use
    complete or update mode, state holds one row per day. With it days close, for append
    mode, and findings that come later than that are dropped."""
    if delay is not None:
        stream = stream.withWatermark("date", delay)
    counted = stream.groupBy(F.window("date", "1 day")).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("day"), "n")
