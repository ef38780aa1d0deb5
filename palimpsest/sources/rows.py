"""Memory rows as they are stored, made regular."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.expressions import layer_name

#: States of a row, and what its time can be to the time it was told. Fixed values.
STATUSES = ["active", "superseded", "archived", "deleted"]
RELATIONS = ["past", "present", "future", "recurring", "atemporal", "unknown"]


def regular(rows: DataFrame) -> DataFrame:
    """rows with names, defaults and bounds as all other operators expect them; other columns stay.

    A layer may have an older name; an unknown or missing one is l1_raw, and an
    unknown or missing status `active`. Facts and intentions without observed_at
    were observed at memory_at, and memory_at may stand in created_at. An
    unknown temporal_relation is `unknown`, a blank one null. Confidence is held
    to 0 and 1, and null if it is no number. valid_from is gmt_created unless
    given; is_latest is true and access_count 0 unless given.
    """
    status = F.lower(F.trim("status"))
    relation = F.lower(F.trim("temporal_relation"))
    confidence = F.col("normalization_confidence").try_cast("double")
    out = rows.withColumns(
        {
            "layer": F.coalesce(layer_name(F.col("layer")), F.lit("l1_raw")),
            "status": F.when(status.isin(STATUSES), status).otherwise("active"),
            "memory_at": F.coalesce("memory_at", "created_at"),
            "temporal_relation": F.when(relation.isin(RELATIONS), relation).when(relation != "", "unknown"),
            "normalization_confidence": F.when(confidence.isNotNull() & ~F.isnan(confidence), F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))),
            "valid_from": F.coalesce("valid_from", "gmt_created"),
            "is_latest": F.coalesce("is_latest", F.lit(True)),
            "access_count": F.coalesce("access_count", F.lit(0)),
        }
    )
    told = F.when(F.col("layer").isin("l2_fact", "l7_intention"), F.col("memory_at"))
    return out.withColumn("observed_at", F.coalesce("observed_at", told)).drop("created_at")
