"""Coverage of units by translation records: six states, counts and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import columns as tc

STATES = ("translated-valid", "untranslated", "rejected-structure", "superseded", "unresolved", "obsolete")
BLOCKING = ("untranslated", "rejected-structure", "superseded", "unresolved")


def classify_coverage(units: DataFrame, records: DataFrame) -> DataFrame:
    """(unit_id, passage, state, identity, codes) of each unit and of each record without a unit.

    units: unit_id, passage, raw_text, protected_text, placeholders, context.  records: unit_id, passage, translation,
    protected_translation, source_fingerprint.  No record: valid if there is nothing to translate, else untranslated; a
    fingerprint that is there and differs: superseded; findings: rejected; a record without a unit: obsolete.
    """
    u = units.select("unit_id", F.col("passage").alias("u_passage"), "raw_text", "protected_text", "placeholders", "context", F.lit(True).alias("in_units"))
    r = records.select("unit_id", F.col("passage").alias("r_passage"), "translation", "protected_translation", F.nullif("source_fingerprint", F.lit("")).alias("source_fingerprint"), F.lit(True).alias("in_records"))
    both = u.join(r, "unit_id", "full_outer")
    here, there = F.col("in_units").isNotNull(), F.col("in_records").isNotNull()
    moved = here & there & F.col("source_fingerprint").isNotNull() & (F.col("source_fingerprint") != tc.source_fingerprint(F.col("protected_text")))
    both, live = both.withColumn("live", here & there & ~F.coalesce(moved, F.lit(False))), F.col("live")
    checked = both.withColumn("codes", F.when(live, F.array_distinct(F.transform(tc.verify(F.col("raw_text"), F.col("translation"), F.col("context"), F.col("protected_text"), F.col("protected_translation"), F.col("placeholders")), lambda f: f["code"]))))
    checked, identity = checked.withColumn("identity", here & ~there & tc.is_identity(F.col("raw_text"))), F.col("identity")
    state = F.when(~here, "obsolete").when(identity, "translated-valid").when(~there, "untranslated").when(~live, "superseded").when(F.size("codes") > 0, "rejected-structure").otherwise("translated-valid")
    return checked.select("unit_id", F.coalesce("u_passage", "r_passage").alias("passage"), state.alias("state"), "identity", "codes")


def mark_unresolved(states: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Valid units, other than those with nothing to translate, that the planner couldn't place."""
    gone = unresolved.select("unit_id", F.lit(True).alias("gone")).distinct()
    hit = (F.col("state") == "translated-valid") & ~F.col("identity") & F.col("gone").isNotNull()
    return states.join(gone, "unit_id", "left").withColumn("state", F.when(hit, "unresolved").otherwise(F.col("state"))).drop("gone")


def coverage_counts(states: DataFrame) -> DataFrame:
    """(state, n) with all six states, also those without a unit."""
    spark = states.sparkSession
    every = spark.createDataFrame([(s,) for s in STATES], "state string")
    counted = states.groupBy("state").agg(F.count("*").alias("n"))
    return every.join(F.broadcast(counted), "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))  # at most six rows


def strict_gate(states: DataFrame) -> DataFrame:
    """(blocking_total, strict_pass, missing, changed, rejected, obsolete) in one row."""

    def n(state: str):
        return F.count(F.when(F.col("state") == state, 1))

    total = F.count(F.when(F.col("state").isin(*BLOCKING), 1))
    return states.agg(total.alias("blocking_total"), (total == 0).alias("strict_pass"), n("untranslated").alias("missing"), n("superseded").alias("changed"), n("rejected-structure").alias("rejected"), n("obsolete").alias("obsolete"))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.asc(order))
    return rows.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")
