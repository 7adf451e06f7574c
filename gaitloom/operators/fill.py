"""Filling missing cells by sequential hot-deck (problem 2).

Within a recording the donor is the same keypoint's nearest observed reading before or after, by
frame number. Where a recording never observes the keypoint, the donor is a reading of a comparable
recording: same rig, nearest recording day. Every filled cell carries its donor's distance.

Plan. ``frames`` is read twice: once for the census (recordings, blocks, the pairs written instead of
positions), once for the rows, which are hashed once by (recording, time block). A donor is always
next to a row that misses something, so only such rows and their neighbours, and the ends of the
block, go on; sorted by time, they hand every cell's last observed reading on, forwards and
backwards. What lies beyond a block's edge comes from the first and last observed readings of its
neighbour blocks: one summary row per block and cell (bounded by the 32-bit frame number, see
``tables.BLOCK``), joined back by (recording, block). Recordings without a donor of their own use
per-(rig, day) representatives, bounded by the calendar.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaitloom.operators.missing import census, flat_pose, no_nan, placeholder_frame, placeholder_pairs
from gaitloom.tables import block_of, recording_meta

READING = "struct<frame:int,x:double,y:double>"


def _rows(frames: DataFrame, counts: DataFrame, known: DataFrame, keypoints: int) -> DataFrame:
    """Rows in force, sorted by frame in their block: recording, block, frame, p (x and y in turn), c, ``miss`` (bit i: cell i has no
    usable value) and ``near`` (the row, or one next to it, misses something, or it ends the block)."""
    pose = F.array(*[no_nan(v) for i in range(keypoints) for v in flat_pose(i)])
    conf = F.array(*[no_nan(F.get("conf", F.lit(i))) for i in range(keypoints)])
    loaded = F.coalesce(F.unix_micros(F.col("loaded_at").cast("timestamp")), F.lit(-(2**62)))
    rows = frames.where("recording is not null and frame is not null").select("recording", "frame", block_of().alias("block"), loaded.alias("loaded"), pose.alias("p"), conf.alias("c")).repartition("recording", "block")
    places = counts.select("recording", "block").distinct().join(known.select("recording", "px", "py"), "recording")
    places = places.select(F.col("recording").alias("_r"), F.col("block").alias("_b"), "px", "py").hint("shuffle_hash")  # one narrow row for a block
    rows = rows.join(places, (F.col("recording") == F.col("_r")) & (F.col("block") == F.col("_b")), "left").drop("_r", "_b")
    w = Window.partitionBy("recording", "block").orderBy("frame", "loaded")
    rows = rows.withColumn("_next", F.lead("frame").over(w)).where("_next is null or _next <> frame")
    bits = []
    for k in range(keypoints):
        x, y = F.get("p", F.lit(2 * k)), F.get("p", F.lit(2 * k + 1))
        bits.append(F.when(x.isNull() | y.isNull() | ((x == F.col("px")) & (y == F.col("py"))), F.lit(1 << k)).otherwise(F.lit(0)))
        bits.append(F.when(F.get("c", F.lit(k)).isNull(), F.lit(1 << (keypoints + k))).otherwise(F.lit(0)))
    rows = rows.select("recording", "block", "frame", "loaded", "p", "c", reduce(lambda a, b: a + b, bits).cast("bigint").alias("miss"))
    beside = lambda f: F.coalesce(f("miss").over(w), F.lit(1)) != 0
    return rows.withColumn("near", (F.col("miss") != 0) | beside(F.lag) | beside(F.lead)).drop("loaded")


def _readings(rows: DataFrame, keypoints: int) -> DataFrame:
    """The rows that miss something or may help, with one reading per cell (v0, v1, ...), null where it has no usable value."""
    has = lambda i: F.col("miss").bitwiseAND(F.lit(1 << i)) == 0
    pose = [F.when(has(k), F.struct("frame", F.get("p", F.lit(2 * k)).alias("x"), F.get("p", F.lit(2 * k + 1)).alias("y"))) for k in range(keypoints)]
    conf = [F.when(has(keypoints + k), F.struct("frame", F.get("c", F.lit(k)).alias("x"), F.lit(None).cast("double").alias("y"))) for k in range(keypoints)]
    return rows.where("near").select("recording", "block", "frame", "p", "c", "miss", *[v.cast(READING).alias(f"v{i}") for i, v in enumerate(pose + conf)])


def _beyond(rows: DataFrame, known: DataFrame, cells: int) -> DataFrame:
    """Per (recording, block) with something to add: ``carry``, a map from the cell to the last reading of earlier blocks,
    the first of later ones, and that of another recording."""
    ends = rows.groupBy("recording", "block").agg(*[f(f"v{i}").alias(f"{n}{i}") for i in range(cells) for n, f in (("f", F.min), ("l", F.max))])
    ends = ends.select("recording", "block", F.posexplode(F.array(*[F.struct(F.col(f"f{i}").alias("f"), F.col(f"l{i}").alias("l")) for i in range(cells)])).alias("cell", "e")).select("recording", "block", "cell", "e.f", "e.l")
    ends = ends.repartition("recording", "cell")  # both users below read every column of this one exchange
    whole = ends.groupBy("recording", "cell").agg(F.max_by("l", F.when(F.col("l").isNotNull(), F.col("block"))).alias("top"), F.count("f").alias("seen"))
    other = _comparable(whole, known)
    back = Window.partitionBy("recording", "cell").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("recording", "cell").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    all_ = F.count("l").over(Window.partitionBy("recording", "cell"))
    ends = ends.select("recording", "block", "cell", F.last("l", ignorenulls=True).over(back).alias("b"), F.last("f", ignorenulls=True).over(ahead).alias("a"), all_.alias("seen"))
    add = ends.where("b is not null or a is not null or seen = 0").join(other, ["recording", "cell"], "left")
    entry = F.struct("cell", F.struct("b", "a", "o").alias("e"))
    return add.groupBy(F.col("recording").alias("_r"), F.col("block").alias("_b")).agg(F.map_from_entries(F.collect_list(entry)).alias("carry")).hint("shuffle_hash")


def _comparable(whole: DataFrame, known: DataFrame) -> DataFrame:
    """Donor of another recording for each (recording, cell) without reading: o, struct of recording, reading and days.

    Of each (rig, day) the recording with the least name stands for the day; the nearest day gives
    the donor, the earlier at equal distance. Unknown rigs and days form their own.
    """
    place = known.select("recording", F.coalesce("rig", F.lit("")).alias("rig"), "day")
    placed = whole.join(place, "recording")
    both = placed.groupBy("rig", "cell", "day").agg(F.min(F.when(F.col("seen") > 0, F.struct("recording", "top"))).alias("d"))
    dated = F.when(F.col("d").isNotNull(), F.struct("day", "d"))
    back = Window.partitionBy("rig", "cell").orderBy(F.col("day").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("rig", "cell").orderBy(F.col("day").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.select("rig", "cell", "day", F.last(dated, ignorenulls=True).over(back).alias("b"), F.last(dated, ignorenulls=True).over(ahead).alias("a"))
    db, da, far = F.abs(F.datediff("day", "b.day")), F.abs(F.datediff("a.day", "day")), F.lit(2**30)
    later = F.col("b").isNull() | (F.coalesce(da, far) < F.coalesce(db, far))
    d = F.when(later, F.col("a.d")).otherwise(F.col("b.d"))
    o = F.when(d.isNotNull(), F.struct(d["recording"].alias("recording"), d["top"].alias("v"), F.when(later, da).otherwise(db).alias("days")))
    both = both.select(F.col("rig").alias("_rig"), F.col("cell").alias("_cell"), F.col("day").alias("_day"), o.alias("o"))
    lack = placed.where("seen = 0")
    return lack.join(both, (F.col("rig") == F.col("_rig")) & (F.col("cell") == F.col("_cell")) & F.col("day").eqNullSafe(F.col("_day")), "left").select("recording", "cell", "o")


def _filled(rows: DataFrame, known: DataFrame, keypoints: int) -> DataFrame:
    """Rows of :func:`_rows` that miss something: recording, frame, p, c and ``fills``, array of struct(cell, method, distance, recording, v)."""
    cells = 2 * keypoints
    read = _readings(rows, keypoints)
    up = Window.partitionBy("recording", "block").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("recording", "block").orderBy(F.desc("frame")).rowsBetween(Window.unboundedPreceding, 0)
    gone = F.filter(F.sequence(F.lit(0), F.lit(cells - 1)), lambda i: F.get(F.array(*[F.col(f"v{j}").isNull() for j in range(cells)]), i))
    pick = lambda n: F.when(F.size("gone") > 0, F.transform("gone", lambda i: F.get(F.array(*[F.col(f"{n}{j}") for j in range(cells)]), i)))
    keep = ["recording", "block", "frame", "p", "c", "gone"]
    near = read.select(*keep[:-1], F.when(F.col("miss") != 0, gone).otherwise(F.array().cast("array<int>")).alias("gone"), *[f"v{i}" for i in range(cells)], *[F.last(f"v{i}", ignorenulls=True).over(up).alias(f"b{i}") for i in range(cells)])
    near = near.select(*keep, *[f"v{i}" for i in range(cells)], pick("b").alias("b"))
    near = near.select(*keep, "b", *[F.last(f"v{i}", ignorenulls=True).over(down).alias(f"a{i}") for i in range(cells)]).where(F.size("gone") > 0)
    near = near.select(*keep, "b", pick("a").alias("a"))
    near = near.join(_beyond(read, known, cells), (F.col("recording") == F.col("_r")) & (F.col("block") == F.col("_b")), "left")

    def found(z: Column) -> Column:
        carry = F.try_element_at("carry", z["gone"])
        b, a = F.coalesce(z["b"], carry["b"]), F.coalesce(z["a"], carry["a"])
        return F.struct(z["gone"].alias("cell"), F.when(b.isNull() | (a["frame"] - F.col("frame") < F.col("frame") - b["frame"]), a).otherwise(b).alias("v"), carry["o"].alias("o"))

    def told(z: Column) -> Column:
        timed = z["v"].isNotNull()
        return F.struct(
            z["cell"].alias("cell"), F.when(timed, "time").when(z["o"].isNotNull(), "day").otherwise("none").alias("method"),
            F.when(timed, F.abs(F.col("frame") - z["v"]["frame"])).otherwise(z["o"]["days"]).cast("int").alias("distance"),
            F.when(timed, F.col("recording")).otherwise(z["o"]["recording"]).alias("recording"), F.when(timed, z["v"]).otherwise(z["o"]["v"]).alias("v"),
        )

    return near.select("recording", "frame", "p", "c", F.transform(F.transform(F.arrays_zip("gone", "b", "a"), found), told).alias("fills"))


def _inputs(frames: DataFrame, index: DataFrame, rigs: DataFrame, keypoints: int) -> tuple[DataFrame, DataFrame]:
    counts = census(frames)
    meta = recording_meta(counts, index, rigs)
    known = placeholder_frame(meta, placeholder_pairs(counts, meta))
    return _rows(frames, counts, known, keypoints), known


def fill_cells(frames: DataFrame, index: DataFrame, rigs: DataFrame, keypoints: int) -> DataFrame:
    """Every cell in force without usable value: recording, frame, kp, field, method, distance, donor_recording, donor_frame, x, y.

    field 'pose': x and y are the filled position; 'conf': x is the filled confidence, y null.
    method 'time': donor in the same recording, distance in frames; 'day': donor in another
    recording of the same rig, distance in days (null if a day is unknown); 'none': no donor
    anywhere, the value stays null.

    A pose cell is missing if either coordinate is null or NaN, or if it is the pair that its rig
    writes instead of a position. Ties: of equally distant donors the earlier. Repeated or corrected
    rows: the latest ``loaded_at`` counts, null being earliest. Rows without recording or frame are
    left out; an empty table gives no rows; extra columns are ignored.
    """
    cells = _filled(*_inputs(frames, index, rigs, keypoints), keypoints).select("recording", "frame", F.explode("fills").alias("z"))
    pose = F.col("z.cell") < keypoints
    return cells.select(
        "recording", "frame", F.when(pose, F.col("z.cell")).otherwise(F.col("z.cell") - keypoints).cast("int").alias("kp"), F.when(pose, "pose").otherwise("conf").alias("field"),
        "z.method", "z.distance", F.col("z.recording").alias("donor_recording"), F.col("z.v.frame").alias("donor_frame"), "z.v.x", "z.v.y",
    )


def fill_missing(frames: DataFrame, index: DataFrame, rigs: DataFrame, keypoints: int) -> DataFrame:
    """Every frame in force with the cells of :func:`fill_cells` put in.

    Columns: recording, frame, pose array<array<double>>, conf array<double>, pose_filled and
    conf_filled array<struct<kp, method, distance>> (empty where nothing was missing). Genuine values
    are kept bit for bit; cells without any donor are null.
    """
    rows, known = _inputs(frames, index, rigs, keypoints)
    none = F.array().cast("array<struct<kp:int,method:string,distance:int>>")
    own_pose = F.array(*[F.array(F.get("p", F.lit(2 * k)), F.get("p", F.lit(2 * k + 1))) for k in range(keypoints)])
    whole = rows.where("miss = 0").select("recording", "frame", own_pose.alias("pose"), F.col("c").alias("conf"), none.alias("pose_filled"), none.alias("conf_filled"))
    part = _filled(rows, known, keypoints)
    part = part.withColumn("at", F.map_from_entries(F.transform("fills", lambda z: F.struct(z["cell"].alias("cell"), z["v"].alias("v")))))
    ids = F.sequence(F.lit(0), F.lit(keypoints - 1))
    has = lambda i: F.map_contains_key("at", i)
    pose = F.transform(ids, lambda k: F.when(has(k), F.array(F.try_element_at("at", k)["x"], F.try_element_at("at", k)["y"])).otherwise(F.array(F.get("p", 2 * k), F.get("p", 2 * k + 1))))
    conf = F.transform(ids, lambda k: F.when(has(k + keypoints), F.try_element_at("at", k + keypoints)["x"]).otherwise(F.get("c", k)))

    def marks(low: int) -> Column:
        mine = F.filter("fills", lambda z: (z["cell"] >= low) & (z["cell"] < low + keypoints))
        return F.coalesce(F.transform(mine, lambda z: F.struct((z["cell"] - low).alias("kp"), z["method"].alias("method"), z["distance"].alias("distance"))), none)

    return whole.unionByName(part.select("recording", "frame", pose.alias("pose"), conf.alias("conf"), marks(0).alias("pose_filled"), marks(keypoints).alias("conf_filled")))
