"""What the codes of a tracked box's provenance mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values, in the order in which they are listed: code, short name, meaning.
CODES = [
    (0, "S0", "S0 - start-frame initialization"),
    (1, "S1", "S1 - strong IoU + heading-gated assignment"),
    (2, "S2", "S2 - strong IoU + axis-cost assignment"),
    (3, "S3", "S3 - loose IoU (IoU > 0) + heading-gated assignment"),
    (4, "S4", "S4 - loose IoU (IoU > 0) + axis-cost assignment"),
    (6, "S5", "S5 - fast-distance active-track recovery (IoU = 0)"),
    (11, "S6", "S6 - long-gap dormant-track recovery by main detection"),
    (7, "Backfill", "Backfill - retroactive detected-OBB match in a gap frame"),
    (13, "Dir-NaN", "Direction withheld for Viterbi resolution"),
    (14, "C4-DIR-FIX", "Direction corrected (tracking repair or C4 direction-spike fix)"),
    (17, "DIR-FLIP", "Direction flipped 180 degrees (tracking repair or C4 segment flip)"),
    (15, "Dir-DP", "Direction corrected by Viterbi post-filter"),
    (16, "Turn-Accept", "Direction committed after sharp-turn run acceptance"),
    (20, "C1-KF-INTERP", "C1 - OBB filled by KF-gated interpolation"),
    (21, "C2-OVERLAP-FILL", "C2 - OBB copied from overlapping ID to fill a gap"),
    (22, "C3-EMBED-ABSTAIN", "C3 - embedding targeted but no reliable decision (abstained)"),
    (26, "C3-EMBED-IDENTITY", "C3 - embedding confirmed current identity (no swap)"),
    (23, "C3-EMBED-RELABEL", "C3 - embedding contact episode relabelled (ID swap applied)"),
    (24, "C5-MISSING", "C5 - OBB still missing after correction; manual review"),
    (25, "C4-POS-FIX", "C4 - position spike corrected by OBB interpolation"),
    (30, "GUI-PRE", "GUI pre-correction interpolation"),
    (31, "GUI-POST", "GUI post-correction fill"),
    (32, "GUI-ANCHOR", "GUI direction corrected by anchor consistency filter"),
    (33, "GUI-SPIKE", "GUI short direction spike removed by post-filter"),
    (34, "GUI-INTERP", "GUI OBB/direction filled by post-filter interpolation"),
    (35, "GUI-ID-SWAP", "GUI long ID swap corrected by post-filter"),
]
#: The codes that refinement doesn't look at.
NOT_REFINED = (0, 1)


def table(spark: SparkSession) -> DataFrame:
    """code, place (in the listed order), short, label, refined: one row for each code."""
    rows = [(code, place, short, label, code not in NOT_REFINED) for place, (code, short, label) in enumerate(CODES)]
    return spark.createDataFrame(rows, "code bigint, place int, short string, label string, refined boolean")


def described(df: DataFrame, code: str = "code") -> DataFrame:
    """df with its code's place, short name, label and whether refinement looks at it; null for other codes."""
    names = table(df.sparkSession).withColumnRenamed("code", code)
    return df.join(F.broadcast(names), code, "left")  # as many rows as there are codes


def is_refined(code: Column) -> Column:
    """Whether refinement looks at a code; codes that aren't listed, and null, aren't looked at."""
    return F.coalesce(code.isin([c for c, *_ in CODES if c not in NOT_REFINED]), F.lit(False))
