"""References to records that do not exist, as things stood when the referring row was loaded.

References and parent keys are partitioned and sorted by key and merged linearly (a sort-merge join); each parent
carries one validity interval, from its first load to its removal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citygrain.operators.skew import hot_keys, salted_join


def parent_intervals(parents: DataFrame, removed: DataFrame) -> DataFrame:
    """(table_name, ref_id, valid_from, valid_to): first load and first removal of each parent.

    ``parents`` is (table_name, ref_id, loaded_at), ``removed`` (table_name, ref_id, removed_at). A parent that
    was removed but never loaded keeps no interval. Reloads do not move the start. Rows of null key are dropped.
    """
    events = parents.select("table_name", "ref_id", F.col("loaded_at").alias("_on"), F.lit(None).cast("timestamp").alias("_off"))
    events = events.unionByName(removed.select("table_name", "ref_id", F.lit(None).cast("timestamp").alias("_on"), F.col("removed_at").alias("_off")))
    spans = events.where(F.col("ref_id").isNotNull()).groupBy("table_name", "ref_id").agg(F.min("_on").alias("valid_from"), F.min("_off").alias("valid_to"))
    return spans.where(F.col("valid_from").isNotNull())


def orphans(references: DataFrame, parents: DataFrame, removed: DataFrame, reference_rows: int | None = None) -> DataFrame:
    """(table_name, field_name, row_id, ref_id, loaded_at, status) of references without a valid target.

    ``references`` is (table_name, field_name, row_id, ref_id, loaded_at). Status ``missing``: no such parent at
    all; ``late``: loaded only after the reference; ``deleted``: removed at or before it. Null refers to nothing.
    A reference without a load time can only be ``missing``. Repeated references give one row. References to a hot
    key are spread over several tasks, its one interval being repeated. ``reference_rows`` is their number if known.
    """
    refs = references.where(F.col("ref_id").isNotNull())
    spans = parent_intervals(parents, removed)
    hot = hot_keys(refs, "ref_id", rows=reference_rows)
    joined = salted_join(refs, spans.hint("merge"), ["table_name", "ref_id"], "ref_id", hot, F.col("row_id"))
    status = (
        F.when(F.col("valid_from").isNull(), "missing")
        .when(F.col("valid_from") > F.col("loaded_at"), "late")
        .when(F.col("valid_to") <= F.col("loaded_at"), "deleted")
    )
    out = joined.withColumn("status", status).where(F.col("status").isNotNull())
    return out.select("table_name", "field_name", "row_id", "ref_id", "loaded_at", "status").dropDuplicates(["table_name", "field_name", "row_id", "ref_id"])


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts of orphan references per table, field, month of the referring row, and status."""
    period = F.date_format("loaded_at", "yyyy-MM").alias("period")
    return found.groupBy("table_name", "field_name", period, "status").agg(F.count("*").alias("n_refs"), F.countDistinct("ref_id").alias("n_targets"))
