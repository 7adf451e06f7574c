"""Small tables for edge cases: nulls, repeats, corrections, clashing extra columns, none at all."""

from datetime import datetime

FRAMES = "recording string, frame int, pose array<array<double>>, conf array<double>, loaded_at timestamp"
RESULTS = "recording string, frame int, syllable int, latent_state array<double>, centroid array<double>, heading double, loaded_at timestamp"
INDEX = "name string, group_name string, rig string, subject string, recorded_at timestamp"
T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def index(spark, rows=()):
    return spark.createDataFrame(list(rows), INDEX)


def rigs(spark):
    return spark.createDataFrame([("floor_a", 640.0, 480.0, 30, "px")], "rig string, width double, height double, fps int, unit string")


def info(spark, rows=((0, "Walk slow"), (1, "walk-SLOW."), (2, None), (3, "  "))):
    return spark.createDataFrame([(*r, None, None) for r in rows], "syllable int, label string, short_description string, movie_path string")


def results(spark, rows):
    """rows: (recording, frame, syllable[, loaded_at])."""
    return spark.createDataFrame([(r[0], r[1], r[2], None, None, None, r[3] if len(r) > 3 else T0) for r in rows], RESULTS)


def frames(spark, rows):
    """rows: (recording, frame, pose, conf[, loaded_at])."""
    return spark.createDataFrame([(*r[:4], r[4] if len(r) > 4 else T0) for r in rows], FRAMES)


def clash(df):
    """Extra columns under names the operators use inside."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in ("block", "_v", "_run", "pos", "n", "cell", "miss", "kp", "chunk", "rank", "h") if c not in df.columns})
