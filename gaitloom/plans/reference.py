"""Queries over the canonical tables, one per operator of the engine, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaitloom.operators import clustering, formatting, graph, hypothesis, instances, kinematics, model, pose_model, pose_store, sequence, signal
from gaitloom.operators.timeline import run_numbers, runs, states
from gaitloom.sources import sinks, videos
from gaitloom.sources.loaders import missing_share, recording_name, reindex
from gaitloom.streaming import streams
from gaitloom.tables import by_block, in_force, read, recording_index

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FPS = 30.0
#: Added before rounding: keeps means of short decimals off the halves, where two engines may part.
NUDGE = 3.3e-8
MIN_FREQUENCY = 0.005


def query(sql: str | None = None):
    """Register a function as a query, with its SQL if there is one."""

    def put(f):
        Q[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


# --- inputs ----------------------------------------------------------------------------------


def _states(s: SparkSession, d: str) -> DataFrame:
    r = states(read(s, d, "results"), ["centroid", "heading"])
    return r.select("recording", "frame", "pos", "n", "syllable", F.get("centroid", F.lit(0)).alias("cx"), F.get("centroid", F.lit(1)).alias("cy"), "heading")


def _runs(s: SparkSession, d: str) -> DataFrame:
    return runs(states(read(s, d, "results")))


def _points(s: SparkSession, d: str) -> DataFrame:
    return signal.keypoints(read(s, d, "frames"))


def _poses(s: SparkSession, d: str) -> DataFrame:
    return signal.poses(read(s, d, "frames"))


def _groups(s: SparkSession, d: str) -> DataFrame:
    return recording_index(read(s, d, "recording_index"))


def _table(s: SparkSession, d: str) -> DataFrame:
    return kinematics.frame_table(_states(s, d), _groups(s, d), FPS)


def _grouped_runs(s: SparkSession, d: str) -> DataFrame:
    g = _groups(s, d).select(F.col("recording").alias("_r"), "group_name")
    return _runs(s, d).join(g, F.col("recording") == F.col("_r"), "left").withColumn("group", F.coalesce("group_name", F.lit("default"))).drop("_r", "group_name")


def _frequencies(s: SparkSession, d: str) -> DataFrame:
    """group, name, syllable, value: each recording's share of runs, 0 where a label is absent."""
    r = _grouped_runs(s, d).select("recording", "syllable", "group", "run")
    n = r.groupBy("group", F.col("recording").alias("name"), "syllable").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("frequency", F.col("n") / F.sum("n").over(Window.partitionBy("name"))).drop("n")  # one row per label
    return kinematics.dense_pivot(n, "frequency")


_RES = "(select * from (select *, row_number() over (partition by recording, frame order by loaded_at desc nulls last) rn_ from results where recording is not null and frame is not null) where rn_ = 1)"
_FRM = "(select * from (select *, row_number() over (partition by recording, frame order by loaded_at desc nulls last) rn_ from frames where recording is not null and frame is not null) where rn_ = 1)"
_R = f"""r as (select recording, frame, syllable, centroid[1] as cx, centroid[2] as cy, heading, latent_state, row_number() over (partition by recording order by frame) - 1 as pos, count(*) over (partition by recording) as n from {_RES} where syllable is not null),
f_ as (select *, case when syllable = lag(syllable) over (partition by recording order by pos) then 0 else 1 end as new from r),
q as (select *, cast(sum(new) over (partition by recording order by pos) - 1 as bigint) as run from f_),
runs as (select recording, run, syllable, min(pos) as start, max(pos) + 1 as "end", max(n) as n from q group by recording, run, syllable),
grp as (select lower(regexp_replace(trim(name), '\\.[A-Za-z0-9]{{1,5}}$', '')) as rec, min(nullif(regexp_replace(lower(trim(group_name)), '[\\s\\-_]+', '_', 'g'), '')) as group_name from recording_index where name is not null group by 1),
usage as (select syllable, count(*) / sum(count(*)) over () as frequency from runs group by 1),
gruns as (select r.*, coalesce(g.group_name, 'default') as grp from runs r left join grp g on g.rec = r.recording)
"""
_W = "with " + _R
_P = f"""pts as (select recording, frame, k - 1 as kp, case when isnan(pose[k][1]) then null else pose[k][1] end as x, case when isnan(pose[k][2]) then null else pose[k][2] end as y, case when isnan(conf[k]) then null else conf[k] end as conf from {_FRM}, (select unnest(range(1, 9)) as k) where pose is not null or conf is not null)"""


def _mirror(j: str) -> str:
    return f"least(((({j}) % (2 * n)) + 2 * n) % (2 * n), 2 * n - 1 - (((({j}) % (2 * n)) + 2 * n) % (2 * n)))"


def _taps(lo: int, hi: int, columns: str) -> str:
    """SQL: every row with the rows at offsets lo..hi, ends reflected."""
    return f"taps as (select a.recording, a.pos, a.frame, a.n, a.off, {columns} from (select recording, pos, frame, n, off, {_mirror('pos + off')} as src from r, (select unnest(range({lo}, {hi + 1})) as off)) a join r b on b.recording = a.recording and b.pos = a.src)"


_WEIGHTS = "wts as (select " + "unnest(range(-12, 13)) as off, unnest([" + ", ".join(repr(x) for x in signal.gaussian_weights(3)) + "]) as wt)"
_ANG = _taps(-12, 12, "coalesce(b.heading, 0) as h") + ", " + _WEIGHTS + """,
sm as (select recording, pos, frame, atan2(sum(sin(h) * wt), sum(cos(h) * wt)) as hs from taps join wts using (off) group by 1, 2, 3),
ang as (select recording, pos, frame, case when pos = 0 then 0.0 else (hs - lag(hs) over (partition by recording order by pos)) * 30 end as av from sm)"""
_VEL = "vel as (select *, case when pos = 0 then 0.0 else sqrt((cx - lag(cx) over w) ** 2 + (cy - lag(cy) over w) ** 2) * 30 end as velocity from r window w as (partition by recording order by pos))"
_TABLE = f"""{_ANG}, {_VEL},
tab as (select v.recording as name, coalesce(g.group_name, 'default') as grp, v.pos, v.syllable, v.heading, a.av as angular_velocity, v.velocity from vel v join ang a using (recording, pos) left join grp g on g.rec = v.recording)"""


# --- sources, projections, predicates --------------------------------------------------------


@query(f"select recording, frame, syllable, round(centroid[1], 6) as cx, round(centroid[2], 6) as cy from {_RES}")
def frames_scan(s, d):
    rows = in_force(by_block(read(s, d, "results").select("recording", "frame", "loaded_at", "syllable", "centroid")), ["syllable", "centroid"])
    return rows.select("recording", "frame", "syllable", F.round(F.get("centroid", F.lit(0)), 6).alias("cx"), F.round(F.get("centroid", F.lit(1)), 6).alias("cy"))


@query("select name, regexp_replace(name, '\\.[^./]*$', '') as recording from recording_index where name is not null")
def file_name_parse(s, d):
    return read(s, d, "recording_index").where("name is not null").select("name", recording_name(F.concat(F.lit("/data/"), F.col("name"))).alias("recording"))


@query(f"with {_P} select recording, frame, kp, x, y, conf from pts")
def keypoints_unpivot(s, d):
    return _points(s, d).select("recording", "frame", "kp", "x", "y", "conf")


@query("select event_id, try_cast(json_extract_string(props, '$.k') as int) as k from events")
def json_props_extract(s, d):
    return read(s, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query(f"with {_P} select recording, b.bodypart, round(avg(case when x is null or y is null then 1.0 else 0.0 end), 6) as missing from pts p join bodyparts b on b.kp = p.kp group by 1, 2")
def missing_proportion(s, d):
    gone = (F.col("x").isNull() | F.col("y").isNull()).cast("double")
    return _points(s, d).join(read(s, d, "bodyparts"), "kp").groupBy("recording", "bodypart").agg(F.round(F.avg(gone), 6).alias("missing"))


@query(_W + "select recording, pos // 5 as step, frame, syllable from r where pos % 5 = 0")
def stride_downsample(s, d):
    return _states(s, d).where("pos % 5 = 0").select("recording", F.floor(F.col("pos") / 5).alias("step"), "frame", "syllable")


@query(_W + "select recording, pos - n // 10 as pos, syllable from r where pos >= n // 10 and pos < n - n // 10")
def trim_bounds(s, d):
    lo = F.floor(F.col("n") / 10)
    return _states(s, d).where((F.col("pos") >= lo) & (F.col("pos") < F.col("n") - lo)).select("recording", (F.col("pos") - lo).alias("pos"), "syllable")


def _no_nan(e: str) -> str:
    """SQL of the engine's rule that NaN is null."""
    return f"case when not isnan({e}) then {e} end"


def _reindexed(s, d) -> tuple[DataFrame, list[str]]:
    names = [r.bodypart for r in read(s, d, "bodyparts").sort("kp").collect()]  # fixed table
    rows = in_force(by_block(read(s, d, "frames").select("recording", "frame", "loaded_at", "pose", "conf")), ["pose", "conf"])
    return reindex(rows, names, names[::-1]), names


@query(f"select recording, frame, {_no_nan('conf[8]')} as c_last, {_no_nan('conf[1]')} as c_first from {_FRM} where conf is not null")
def bodypart_reindex(s, d):
    """The keypoint axis reordered by name; the reordered ends are shown."""
    turned, names = _reindexed(s, d)
    return turned.where("conf is not null").select("recording", "frame", F.get("conf", F.lit(0)).alias("c_last"), F.get("conf", F.lit(len(names) - 1)).alias("c_first"))


@query("select a.kp as src, b.kp as dst from bodyparts a join bodyparts b on a.parent_kp = b.kp")
def skeleton_edges(s, d):
    b = read(s, d, "bodyparts")
    return b.where("parent_kp is not null").select(F.col("kp").alias("src"), F.col("parent_kp").alias("dst")).join(b.select(F.col("kp").alias("dst")), "dst").select("src", "dst")


@query(f"with {_P} select recording, frame, kp, round(greatest(coalesce(conf, 0), 0) + 0.001, 6) as conf from pts")
def conf_clean(s, d):
    return signal.clean_confidence(_points(s, d)).select("recording", "frame", "kp", F.round("conf", 6).alias("conf"))


@query(f"with {_P}, c as (select kp, log10(conf + 0.001) as c from pts where conf >= 0), m as (select min(c) lo, max(c) hi from c) select cast(kp as int) as kp, cast(least(floor((c - lo) / (hi - lo) * 10), 9) as int) as bin, count(*) as n from c, m group by 1, 2")
def confidence_bins(s, d):
    return signal.confidence_bins(_points(s, d)).select(F.col("kp").cast("int").alias("kp"), "bin", "n")


@query(f"select recording, frame, syllable, round_even(centroid[1], 4) as x, round_even(heading, 4) as heading from {_RES}")
def csv_export_rounding(s, d):
    rows = in_force(by_block(read(s, d, "results").select("recording", "frame", "loaded_at", "syllable", "centroid", "heading", "latent_state")), ["syllable", "centroid", "heading", "latent_state"])
    return sinks.results_csv(rows).select("recording", "frame", "syllable", F.col("centroid x").alias("x"), "heading")


@query(f"select recording, frame, {_no_nan('pose[1][1]')} as nose_x, {_no_nan('pose[1][2]')} as nose_y, {_no_nan('conf[8]')} as tail_base_conf from {_FRM}")
def keypoints_export(s, d):
    names = [r.bodypart for r in read(s, d, "bodyparts").sort("kp").collect()]  # fixed table
    rows = in_force(by_block(read(s, d, "frames").select("recording", "frame", "loaded_at", "pose", "conf")), ["pose", "conf"])
    return sinks.keypoints_wide(rows, names).select("recording", "frame", "nose_x", "nose_y", "tail_base_conf")


#: The keypoints of the fixed table ``bodyparts`` in order, for the SQL of whole exports.
_PARTS = ["nose", "head", "left_ear", "right_ear", "spine_upper", "spine_mid", "spine_low", "tail_base"]


@query("select recording, frame, " + ", ".join(f"{_no_nan(f'pose[{k}][1]')} as x_{b}, {_no_nan(f'pose[{k}][2]')} as y_{b}, {_no_nan(f'conf[{k}]')} as c_{b}" for k, b in reversed([*enumerate(_PARTS, 1)])) + f" from {_FRM}")
def bodypart_reindex_all(s, d):
    """As bodypart_reindex, with positions and confidences of every keypoint under its name."""
    turned, names = _reindexed(s, d)
    at = lambda i, j: F.get(F.get("pose", F.lit(i)), F.lit(j))
    return turned.select("recording", "frame", *[c for i, n in enumerate(reversed(names)) for c in (at(i, 0).alias(f"x_{n}"), at(i, 1).alias(f"y_{n}"), F.get("conf", F.lit(i)).alias(f"c_{n}"))])


@query(f"""select recording, frame, syllable, round_even(centroid[1], 4) as "centroid x", round_even(centroid[2], 4) as "centroid y", round_even(heading, 4) as heading,
round_even(latent_state[1], 4) as "latent_state 0", round_even(latent_state[2], 4) as "latent_state 1", round_even(latent_state[3], 4) as "latent_state 2" from {_RES}""")
def csv_export_all(s, d):
    """As csv_export_rounding, with all columns of the file."""
    columns = ["syllable", "centroid", "heading", "latent_state"]
    return sinks.results_csv(in_force(by_block(read(s, d, "results").select("recording", "frame", "loaded_at", *columns)), columns))


@query("select recording, frame, " + ", ".join(f"{_no_nan(f'pose[{k}][1]')} as {b}_x, {_no_nan(f'pose[{k}][2]')} as {b}_y, {_no_nan(f'conf[{k}]')} as {b}_conf" for k, b in enumerate(_PARTS, 1)) + f" from {_FRM}")
def keypoints_export_all(s, d):
    """As keypoints_export, with all columns of the file."""
    names = [r.bodypart for r in read(s, d, "bodyparts").sort("kp").collect()]  # fixed table
    return sinks.keypoints_wide(in_force(by_block(read(s, d, "frames").select("recording", "frame", "loaded_at", "pose", "conf")), ["pose", "conf"]), names)


# --- sequences -------------------------------------------------------------------------------


@query(_W + 'select recording, run, syllable, start, "end" from runs')
def run_length_encode(s, d):
    return _runs(s, d).drop("n")


@query(_W + "select recording, frame, syllable, new = 1 as onset from q")
def onset_flag(s, d):
    return sequence.onsets(_states(s, d))


@query(_W + "select recording, frame, syllable, coalesce(syllable <> lag(syllable) over (order by recording, frame), true) as onset from r")
def onset_flag_across(s, d):
    return sequence.onsets_across(_states(s, d))


@query(_W + "select recording, pos, run as trial from q")
def trial_id(s, d):
    return run_numbers(states(read(s, d, "results"))).select("recording", "pos", F.col("run").alias("trial"))


@query(_W + "select l.syllable, round(coalesce(u.frequency, 0), 9) as frequency from (select unnest(range(0, (select max(syllable) from runs) + 1)) as syllable) l left join usage u on u.syllable = l.syllable")
def syllable_frequency_runs(s, d):
    return sequence.frequency(_runs(s, d)).select("syllable", F.round("frequency", 9).alias("frequency"))


@query(_W + "select l.syllable, round(coalesce(u.n, 0) / (select count(*) from r), 9) as frequency from (select unnest(range(0, (select max(syllable) from r) + 1)) as syllable) l left join (select syllable, count(*) n from r group by 1) u on u.syllable = l.syllable")
def syllable_frequency_frames(s, d):
    return sequence.frequency(states(read(s, d, "results"))).select("syllable", F.round("frequency", 9).alias("frequency"))


@query(_W + "select recording, syllable, round(count(*) / sum(count(*)) over (partition by recording), 9) as frequency from runs group by 1, 2")
def frequency_per_recording(s, d):
    return sequence.frequency_per_recording(_runs(s, d)).select("recording", "syllable", F.round("frequency", 9).alias("frequency"))


@query(_W + 'select syllable, median("end" - start) as median, round(quantile_cont("end" - start, 0.95), 6) as p95 from runs group by 1')
def duration_quantiles(s, d):
    n = _runs(s, d).groupBy("syllable", (F.col("end") - F.col("start")).alias("d")).agg(F.count(F.lit(1)).alias("n"))  # counts first: the percentile sees one row per length
    return n.groupBy("syllable").agg(F.percentile("d", F.lit(0.5), F.col("n")).alias("median"), F.round(F.percentile("d", F.lit(0.95), F.col("n")), 6).alias("p95"))


@query(_W + 'select cast(floor(("end" - start) / 5) as bigint) as bin, count(*) as n, round(count(*) / (sum(count(*)) over () * 5), 9) as density from runs group by 1')
def duration_histogram(s, d):
    h = sequence.histogram(_runs(s, d).withColumn("duration", F.col("end") - F.col("start")), 5)
    return h.select("bin", "n", F.round("density", 9).alias("density"))


_BI = "succ as (select recording, syllable as l1, lead(syllable) over w as l2, lead(syllable, 2) over w as l3 from runs where run > 0 window w as (partition by recording order by run))"


@query(_W + ", " + _BI + " select recording, l1, l2, count(*) as n from succ where l2 is not null and l1 < 99 and l2 < 99 group by 1, 2, 3")
def bigram_counts(s, d):
    return sequence.ngrams(_runs(s, d), 2)


@query(_W + ", " + _BI + " select recording, l1, l2, l3, count(*) as n from succ where l3 is not null group by 1, 2, 3, 4")
def trigram_counts(s, d):
    return sequence.ngrams(_runs(s, d), 3)


def _matrix(s, d, normalize, by_group=False):
    b = sequence.ngrams(_runs(s, d), 2)
    by = []
    if by_group:
        g = _groups(s, d).select(F.col("recording").alias("_r"), "group_name")
        b = b.join(g, F.col("recording") == F.col("_r"), "left").withColumn("group", F.coalesce("group_name", F.lit("default")))
        by = ["group"]
    return sequence.transition_matrix(b, by, normalize).select(*by, "src", "dst", F.col("n").cast("bigint").alias("n"), F.round("p", 9).alias("p"))


def _matrix_sql(over: str, group: bool = False) -> str:
    g, j = ("coalesce(group_name, 'default') as \"group\", ", "left join grp on rec = recording ") if group else ("", "")
    k = "1, 2, 3" if group else "1, 2"
    return _W + ", " + _BI + f", m as (select {g}l1 as src, l2 as dst, count(*) as n from succ {j}where l2 is not null group by {k}) select *, round(n / sum(n) over ({over}), 9) as p from m"


@query(_matrix_sql(""))
def transition_bigram(s, d):
    return _matrix(s, d, "bigram")


@query(_matrix_sql("partition by src"))
def transition_rows(s, d):
    return _matrix(s, d, "rows")


@query(_matrix_sql("partition by dst"))
def transition_columns(s, d):
    return _matrix(s, d, "columns")


@query(_matrix_sql('partition by "group"', True))
def transition_by_group(s, d):
    return _matrix(s, d, "bigram", True)


@query(_W + ", " + _BI + """, m as (select l1, l2, count(*) as n from succ where l2 is not null group by 1, 2), l as (select distinct syllable from runs)
select a.syllable as src, b.syllable as dst, coalesce(n, 0) as n from l a cross join l b left join m on l1 = a.syllable and l2 = b.syllable""")
def transition_dense(s, d):
    r = _runs(s, d)
    m = sequence.transition_matrix(sequence.ngrams(r, 2), [])
    return sequence.dense_matrix(m.withColumn("n", F.col("n").cast("bigint")), r.select("syllable").distinct(), []).select("src", "dst", "n")


@query("with m as (" + _matrix_sql('partition by "group"', True) + ') select "group", least(src, dst) as a, greatest(src, dst) as b, round(max(p) * 100, 6) as weight from m where p > 0 group by 1, 2, 3')
def transition_graph(s, d):
    return graph.undirected(_matrix(s, d, "bigram", True)).withColumn("weight", F.round("weight", 6))


@query("with m as (" + _matrix_sql('partition by "group"', True) + """), x as (select coalesce(a.src, b.src) as src, coalesce(a.dst, b.dst) as dst, (coalesce(a.p, 0) - coalesce(b.p, 0)) * 1000 as d
from (select * from m where "group" = 'saline') a full join (select * from m where "group" = 'dose_low') b on a.src = b.src and a.dst = b.dst) select src, dst, round(abs(d), 6) as weight, d > 0 as up from x where d <> 0""")
def transition_diff(s, d):
    return graph.difference(_matrix(s, d, "bigram", True), "saline", "dose_low").withColumn("weight", F.round("weight", 6))


@query(_W + """select grp as "group", syllable, round(count(*) / sum(count(*)) over (partition by grp) * 2000 + 1000, 6) as size from gruns group by 1, 2""")
def graph_node_sizes(s, d):
    u = _grouped_runs(s, d).groupBy("group", "syllable").agg(F.count(F.lit(1)).cast("double").alias("frequency"))
    return graph.node_sizes(u).select("group", "syllable", F.round("size", 6).alias("size"))


_SHARES = "u as (select grp, syllable, count(*) / sum(count(*)) over (partition by grp) as f from gruns group by 1, 2)"


@query(_W + ", " + _SHARES + """, d as (select syllable, coalesce(max(case when grp = 'saline' then f end), 0) - coalesce(max(case when grp = 'dose_low' then f end), 0) as d from u group by 1)
select syllable, round(abs(d) / sum(abs(d)) over () * 1000 + 500, 6) as size, d > 0 as up from d""")
def graph_node_differences(s, d):
    n = _grouped_runs(s, d).groupBy("group", "syllable").agg(F.count(F.lit(1)).alias("n"))
    u = n.withColumn("frequency", F.col("n") / F.sum("n").over(Window.partitionBy("group")))  # one row per label
    return graph.node_differences(u, "saline", "dose_low").withColumn("size", F.round("size", 6))


@query(_W + ", l as (select distinct syllable from runs), k as (select syllable, 2 * pi() * (row_number() over (order by syllable) - 1) / count(*) over () as t from l) select syllable, round(cos(t), 6) as x, round(sin(t), 6) as y from k")
def graph_layout(s, d):
    return graph.circle(_runs(s, d).select("syllable").distinct()).withColumns({c: F.round(c, 6) + F.lit(0.0) for c in "xy"})


@query(_W + """, m as (select syllable as a, syllable % 10 as b, count(*) as n from r group by 1, 2) select a as first, b as second, n, round(n / sum(n) over (partition by a), 9) as p from m""")
def confusion_matrix(s, d):
    a = states(read(s, d, "results")).select("recording", "frame", "syllable")
    return sequence.confusion(a, a.withColumn("syllable", F.col("syllable") % 10)).withColumn("p", F.round("p", 9))


MERGE = [[0, 34], [5, 32], [9, 33]]
_MERGED = _W + """, dense as (select l.syllable, coalesce(u.frequency, 0) as frequency from (select unnest(range(0, (select max(syllable) from runs) + 1)) as syllable) l left join usage u on u.syllable = l.syllable),
gr as (select syllable, frequency, case when syllable in (0, 34) then 0 when syllable in (5, 32) then 1 when syllable in (9, 33) then 2 else syllable + 3 end as g from dense),
tot as (select g, sum(frequency) as f, min(syllable) as least from gr group by 1), rk as (select g, row_number() over (order by round(f, 12) desc, least desc) - 1 as new from tot)"""


@query(_MERGED + "select syllable as old, cast(new as int) as new from gr join rk using (g)")
def merge_mapping(s, d):
    return sequence.merge_mapping(sequence.frequency(_runs(s, d)), MERGE).select("old", F.col("new").cast("int").alias("new"))


@query(_MERGED + "select r.recording, r.frame, cast(new as int) as syllable from r join gr using (syllable) join rk using (g)")
def apply_mapping(s, d):
    st = states(read(s, d, "results"))
    return sequence.relabel(st.select("recording", "frame", "syllable"), sequence.merge_mapping(sequence.frequency(runs(st)), MERGE))


@query(_W + """, dense as (select l.syllable, coalesce(u.frequency, 0) as frequency from (select unnest(range(0, (select max(syllable) from runs) + 1)) as syllable) l left join usage u on u.syllable = l.syllable)
select syllable as old, cast(row_number() over (order by round(frequency, 12) desc, syllable desc) - 1 as int) as new from dense""")
def reindex_by_frequency(s, d):
    return sequence.frequency_order(sequence.frequency(_runs(s, d))).select("old", F.col("new").cast("int").alias("new"))


# --- signals ---------------------------------------------------------------------------------


@query(_W + ", " + _VEL + " select recording, frame, round(velocity, 6) as velocity from vel")
def velocity(s, d):
    return kinematics.velocity(_states(s, d)).select("recording", "frame", F.round("velocity", 6).alias("velocity"))


@query(_W + ", " + _ANG + " select recording, frame, round(av, 4) as angular_velocity from ang")
def angular_velocity(s, d):
    return kinematics.angular_velocity(_states(s, d)).select("recording", "frame", F.round("angular_velocity", 4).alias("angular_velocity"))


@query(_W + ", " + _taps(-4, 4, "b.cx as v") + " select recording, frame, round(median(v), 6) as filtered from taps group by 1, 2")
def median_filter(s, d):
    return signal.median_filter(_states(s, d), "cx").select("recording", "frame", F.round("filtered", 6).alias("filtered"))


@query(_W + ", " + _taps(-12, 12, "coalesce(b.cy, 0) as v") + ", " + _WEIGHTS + " select recording, frame, round(sum(v * wt), 5) as filtered from taps join wts using (off) group by 1, 2")
def gaussian_filter(s, d):
    return signal.gaussian_filter(_states(s, d), "cy", 3).select("recording", "frame", F.round("filtered", 5).alias("filtered"))


@query(_W + ", " + _taps(-4, 4, "coalesce(b.heading, 0) as v") + " select recording, frame, round(atan2(median(sin(v)), median(cos(v))), 6) as filtered from taps group by 1, 2")
def angle_filter(s, d):
    return signal.median_angle(_states(s, d), "heading").select("recording", "frame", F.round("filtered", 6).alias("filtered"))


@query(_W + ", " + _taps(-3, 3, "b.cx as v") + " select recording, frame, round((sum(case when off >= 0 then v end) - sum(case when off <= 0 then v end)) / 4, 7) as derivative from taps group by 1, 2")
def filtered_derivative(s, d):
    return signal.filtered_derivative(_states(s, d), "cx", 3).select("recording", "frame", F.round("derivative", 7).alias("derivative"))


@query(_W + """select a.recording, a.frame, b.syllable as permuted from (select *, (cast('0x' || substr(md5('7-' || recording), 1, 8) as bigint) + pos) as want from r) a join (select *, cast('0x' || substr(md5('7-' || recording), 1, 8) as bigint) as o from r) b on b.recording = a.recording and (b.pos + b.o) % b.n = a.pos""")
def cyclic_permute(s, d):
    return signal.cyclic_permute(states(read(s, d, "results")), "syllable", 7).select("recording", "frame", "permuted")


_INT = """i as (select *, case when x is not null and y is not null then frame end as f from {src}),
j as (select *, last_value(f ignore nulls) over w1 as pf, first_value(f ignore nulls) over w2 as nf, last_value(case when f is not null then x end ignore nulls) over w1 as px, first_value(case when f is not null then x end ignore nulls) over w2 as nx, last_value(case when f is not null then y end ignore nulls) over w1 as py, first_value(case when f is not null then y end ignore nulls) over w2 as ny
from i window w1 as (partition by recording, kp order by frame rows between unbounded preceding and current row), w2 as (partition by recording, kp order by frame rows between current row and unbounded following)),
lin as (select recording, frame, kp, conf, f is null as filled, case when f is not null then x when pf is not null and nf is not null then px + (nx - px) * (frame - pf) / (nf - pf) else coalesce(px, nx, 0) end as x, case when f is not null then y when pf is not null and nf is not null then py + (ny - py) * (frame - pf) / (nf - pf) else coalesce(py, ny, 0) end as y from j)"""


@query(f"with {_P}, " + _INT.format(src="pts") + f" select recording, frame, cast(kp as int) as kp, round(x + {NUDGE!r}, 5) as x, round(y + {NUDGE!r}, 5) as y, filled from lin")
def interpolate_keypoints(s, d):
    return signal.interpolate(_points(s, d)).select("recording", "frame", "kp", F.round(F.col("x") + NUDGE, 5).alias("x"), F.round(F.col("y") + NUDGE, 5).alias("y"), "filled")


@query(f"with {_P}, g as (select recording, frame, median(x) as cx, median(y) as cy, avg(case when kp in (0, 1) then x end) as ax, avg(case when kp in (0, 1) then y end) as ay, avg(case when kp in (6, 7) then x end) as bx, avg(case when kp in (6, 7) then y end) as by_ from pts group by 1, 2) select recording, frame, round(cx, 5) as cx, round(cy, 5) as cy, round(atan2(by_ - ay, bx - ax) + pi(), 5) as heading from g")
def centroid_heading(s, d):
    c = signal.centroid_heading(_poses(s, d), [0, 1], [6, 7])
    return c.select("recording", "frame", F.round("cx", 5).alias("cx"), F.round("cy", 5).alias("cy"), F.round("heading", 5).alias("heading"))


_OUT = f"""{_P}, med as (select recording, frame, median(x) as mx, median(y) as my from pts group by 1, 2),
dist as (select p.*, sqrt((x - mx) ** 2 + (y - my) ** 2) as distance from pts p join med using (recording, frame)),
m1 as (select recording, kp, median(distance) as m from dist group by 1, 2), m2 as (select recording, kp, median(abs(distance - m)) as mad from dist join m1 using (recording, kp) group by 1, 2),
outl as (select d.*, coalesce(distance > m + 6 * mad, false) as outlier from dist d join m1 using (recording, kp) join m2 using (recording, kp))"""


@query("with " + _OUT + " select recording, frame, cast(kp as int) as kp, round(distance, 4) as distance from outl where outlier")
def medoid_outliers(s, d):
    return signal.medoid_outliers(_poses(s, d)).where("outlier").select("recording", "frame", "kp", F.round("distance", 4).alias("distance"))


@query("with " + _OUT + ", blank as (select recording, frame, kp, case when not outlier then x end as x, case when not outlier then y end as y, case when outlier then 0 else conf end as conf from outl), " + _INT.format(src="blank") + f" select recording, frame, cast(kp as int) as kp, round(x + {NUDGE!r}, 5) as x, round(y + {NUDGE!r}, 5) as y, conf from lin where filled")
def outlier_removal(s, d):
    return signal.remove_outliers(_poses(s, d)).where("filled").select("recording", "frame", "kp", F.round(F.col("x") + NUDGE, 5).alias("x"), F.round(F.col("y") + NUDGE, 5).alias("y"), "conf")


@query(_W + ", " + _taps(-15, 14, "b.cx as x, b.cy as y") + """, fl as (select recording, pos, list_sort(list(x))[16] as fx, list_sort(list(y))[16] as fy from taps group by 1, 2),
st as (select sqrt((fx - lag(fx) over w) ** 2 + (fy - lag(fy) over w) ** 2) as step from fl window w as (partition by recording order by pos)) select round(avg(step) ** 2, 6) as sigmasq_loc from st""")
def sigmasq_loc(s, d):
    c = _states(s, d).select("recording", "frame", "cx", "cy").withColumn("block", F.floor(F.col("frame") / 4096).cast("int"))
    return signal.sigmasq_loc(c).select(F.round("sigmasq_loc", 6).alias("sigmasq_loc"))


# --- kinematics and statistics ---------------------------------------------------------------


def _stat_sql(c: str) -> str:
    return ", ".join(f"round({f}({c}) + {NUDGE!r}, 5) as {c}_{n}" for f, n in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max")))


def _round4(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + NUDGE, 5) for c in cols})


_KIN = [f"{c}_{x}" for c in ("heading", "angular_velocity", "velocity") for x in kinematics.STATS]


@query(_W + ", " + _TABLE + f" select grp as \"group\", syllable, {_stat_sql('heading')}, {_stat_sql('angular_velocity')}, {_stat_sql('velocity')} from tab group by 1, 2")
def kinematic_stats(s, d):
    return _round4(kinematics.kinematic_stats(_table(s, d), ["group"]), _KIN)


@query(_W + 'select recording, syllable, round(avg("end" - start) / 30, 6) as duration from runs group by 1, 2')
def mean_duration(s, d):
    return kinematics.mean_duration(_runs(s, d), ["recording"]).withColumn("duration", F.round("duration", 6))


_STATS = _TABLE + f""", keep as (select syllable from usage where frequency > {MIN_FREQUENCY}),
kin as (select grp, name, syllable, {_stat_sql('heading')}, {_stat_sql('angular_velocity')}, {_stat_sql('velocity')} from tab where syllable in (select syllable from keep) group by 1, 2, 3),
fr as (select recording as name, syllable, count(*) / sum(count(*)) over (partition by recording) as frequency, avg("end" - start) / 30 as duration from runs group by 1, 2),
stats as (select k.*, f.frequency, f.duration from kin k join fr f using (name, syllable))"""


def _stats(s, d) -> DataFrame:
    r = _runs(s, d)
    return kinematics.stats_table(_table(s, d), r, sequence.frequency(r), MIN_FREQUENCY)


@query(_W + ", " + _STATS + ' select grp as "group", stats.* exclude (grp, frequency, duration), round(frequency, 6) as frequency, round(duration, 6) as duration from stats')
def stats_df(s, d):
    return _round4(_stats(s, d), _KIN).withColumns({c: F.round(c, 6) for c in ("frequency", "duration")})


@query(_W + f"select syllable from usage where frequency > {MIN_FREQUENCY}")
def frequency_filter_gt(s, d):
    return sequence.frequency(_runs(s, d)).where(F.col("frequency") > MIN_FREQUENCY).select("syllable")


_ELIG = f"""elig as (select recording, syllable, start, "end" from runs where "end" - start >= 3 and start >= 5 and start < n - 15 and syllable in (select syllable from usage where frequency >= {MIN_FREQUENCY}))"""


def _eligible(s, d) -> DataFrame:
    return instances.eligible(_runs(s, d), 5, 15, 3, MIN_FREQUENCY)


@query(_W + ", " + _ELIG + " select * from elig")
def instances_eligible(s, d):
    return _eligible(s, d)


_FREQ = """fq as (select grp, recording as name, syllable, count(*) / sum(count(*)) over (partition by recording) as value from gruns group by 1, 2, 3),
dense as (select n.grp, n.name, l.syllable, coalesce(fq.value, 0.0) as value from (select distinct grp, name from fq) n cross join (select distinct syllable from fq) l left join fq on fq.name = n.name and fq.syllable = l.syllable)"""


@query(_W + ", " + _FREQ + ', m as (select syllable, avg(value) as value from dense group by 1) select syllable, round(value, 9) as value, row_number() over (order by round(value, 9) desc, syllable) - 1 as rank from m')
def stat_order(s, d):
    return kinematics.order_by_stat(_frequencies(s, d), "value").select("syllable", F.round("value", 9).alias("value"), F.col("rank").cast("bigint").alias("rank"))


@query(_W + ", " + _FREQ + """, m as (select syllable, avg(case when grp = 'dose_low' then value end) - avg(case when grp = 'saline' then value end) as d from dense group by 1)
select syllable, round(d, 9) as difference, row_number() over (order by round(d, 9) desc, syllable) - 1 as rank from m where d is not null""")
def stat_diff_order(s, d):
    o = kinematics.order_by_difference(_frequencies(s, d), "value", "saline", "dose_low")
    return o.select("syllable", F.round("difference", 9).alias("difference"), F.col("rank").cast("bigint").alias("rank"))


@query(_W + ", " + _FREQ + ' select grp as "group", name, syllable, round(value, 9) as value from dense')
def pivot_stats(s, d):
    return _frequencies(s, d).select("group", "name", "syllable", F.round("value", 9).alias("value"))


@query(_W + ", " + _FREQ + " select name, case syllable when 0 then 's0' when 1 then 's1' else 's2' end as variable, round(value, 9) as value from dense where syllable in (0, 1, 2)")
def melt_stats(s, d):
    wide = _frequencies(s, d).where("syllable in (0, 1, 2)").groupBy("name").pivot("syllable", [0, 1, 2]).agg(F.max("value"))
    wide = wide.withColumnsRenamed({"0": "s0", "1": "s1", "2": "s2"})
    return wide.unpivot(["name"], ["s0", "s1", "s2"], "variable", "value").select("name", "variable", F.round("value", 9).alias("value"))


@query(_W + ", " + _FREQ + " select name, 's' || cast(syllable as varchar) as variable, round(value, 9) as value from dense")
def melt_stats_all(s, d):
    """As melt_stats, over every label: the label set, bounded by the model's, is read first."""
    long = _frequencies(s, d)
    labels = sorted(r.syllable for r in _runs(s, d).select("syllable").distinct().collect())
    if not labels:
        return long.select("name", F.lit("").alias("variable"), "value")
    wide = long.groupBy("name").pivot("syllable", labels).agg(F.max("value")).withColumnsRenamed({str(k): f"s{k}" for k in labels})
    return wide.unpivot(["name"], [f"s{k}" for k in labels], "variable", "value").select("name", "variable", F.round("value", 9).alias("value"))


# --- tests -----------------------------------------------------------------------------------

_RANK = _FREQ + """, rk as (select *, rank() over (partition by syllable order by value) + (count(*) over (partition by syllable, value) - 1) / 2.0 as rk from dense),
tie as (select syllable, sum(t) as n, sum(t ** 3 - t) as s from (select syllable, value, count(*) as t from rk group by 1, 2) group by 1)"""


@query(_W + ", " + _RANK + ' select name, syllable, rk from rk')
def average_ranks(s, d):
    return hypothesis.average_ranks(_frequencies(s, d)).select("name", "syllable", "rk")


@query(_W + ", " + _RANK + """, p as (select syllable, grp, sum(rk) as r, count(*) as m from rk group by 1, 2), h as (select syllable, sum(r * r / m) as q from p group by 1)
select syllable, round((12.0 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - s / (n ** 3 - n)), 5) as h from h join tie using (syllable)""")
def kruskal_h(s, d):
    return hypothesis.kruskal(hypothesis.average_ranks(_frequencies(s, d))).select("syllable", F.round("h", 5).alias("h"))


_DUNN = _RANK + """, p as (select syllable, grp, avg(rk) as m, count(*) as c from rk group by 1, 2),
dz as (select x.syllable, x.grp as a, y.grp as b, abs(x.m - y.m) / sqrt((n * (n + 1) / 12.0 - s / (12.0 * (n - 1))) * (1.0 / x.c + 1.0 / y.c)) as z from p x join p y on x.syllable = y.syllable and x.grp < y.grp join tie on tie.syllable = x.syllable)"""


@query(_W + ", " + _DUNN + " select syllable, a, b, round(z, 5) as z from dz")
def dunn_z(s, d):
    return hypothesis.dunn(hypothesis.average_ranks(_frequencies(s, d))).withColumn("z", F.round("z", 5))


@query(_W + ", " + _DUNN + """, pv as (select syllable, a, b, round(1 / (1 + z * z), 5) as p from dz), o as (select *, row_number() over (partition by syllable order by p, a, b) as r, count(*) over (partition by syllable) as m from pv),
b_ as (select *, min(p * m / r) over (partition by syllable order by r desc rows between unbounded preceding and current row) as q from o) select syllable, a, b, p, round(least(q, 1.0), 6) as p_adj from b_""")
def fdr_bh(s, d):
    z = hypothesis.dunn(hypothesis.average_ranks(_frequencies(s, d)))
    p = z.select("syllable", "a", "b", F.round(1 / (1 + F.col("z") ** 2), 5).alias("p"))
    return hypothesis.fdr(p, ["syllable"], tie=["a", "b"]).withColumn("p_adj", F.round("p_adj", 6))


@query()
def permutation_pvalue(s, d):
    return hypothesis.permutation_test(hypothesis.average_ranks(_frequencies(s, d)))


@query()
def significant_pairs(s, d):
    return hypothesis.significant_pairs(hypothesis.permutation_test(hypothesis.average_ranks(_frequencies(s, d))))


# --- joins -----------------------------------------------------------------------------------


@query("""with keys as (select distinct recording from results where recording is not null), pre as (select distinct substr(recording, 1, 6) as p from keys union select distinct substr(recording, 1, 14) from keys union select distinct substr(recording, 1, 20) from keys where contains(recording, 'floor'))
select recording, max_by(p, length(p)) as prefix from keys join pre on starts_with(recording, p) group by 1""")
def longest_prefix_match(s, d):
    """The longest known prefix of every recording: prefixes of each name meet the dictionary in an equi join."""
    keys = read(s, d, "results").select("recording").where("recording is not null").distinct()
    cut = lambda n: keys.select(F.substring("recording", 1, n).alias("p"))
    pre = cut(6).union(cut(14)).union(keys.where(F.col("recording").contains("floor")).select(F.substring("recording", 1, 20).alias("p"))).distinct()
    each = keys.select("recording", F.explode(F.transform(F.sequence(F.lit(1), F.length("recording")), lambda i: F.substring("recording", F.lit(1), i))).alias("p"))
    return each.join(pre, "p").groupBy("recording").agg(F.max_by("p", F.length("p")).alias("prefix"))


_VIDEOS = "vids as (select distinct '/videos/' || v || '.avi' as path, v as video from (select split_part(recording, '_', 1) as v from keys union select split_part(recording, '_', 1) || '_' || split_part(recording, '_', 2) from keys))"


@query(f"with keys as (select distinct recording from results where recording is not null), {_VIDEOS} select recording, max_by(path, length(video)) as path from keys join vids on starts_with(recording, video || '_') group by 1")
def video_match(s, d):
    """The video that each recording belongs to, by the longest name that begins the recording's."""
    keys = read(s, d, "results").select("recording").where("recording is not null").distinct()
    part = F.split("recording", "_")
    vids = keys.select(F.explode(F.array(F.get(part, F.lit(0)), F.concat_ws("_", F.get(part, F.lit(0)), F.get(part, F.lit(1))))).alias("v")).select(F.concat(F.lit("/videos/"), "v", F.lit(".avi")).alias("path")).distinct()
    return videos.match_videos(keys, vids, "_")


@query("with keys as (select distinct recording from results where recording is not null) select recording from keys where not contains(recording, 'floor')")
def video_missing(s, d):
    """Recordings without a video, if only those of the floor rigs were filmed."""
    keys = read(s, d, "results").select("recording").where("recording is not null").distinct()
    filmed = keys.where(F.col("recording").contains("floor")).select(F.concat(F.lit("/videos/"), F.col("recording"), F.lit(".mp4")).alias("path"))
    return videos.without_video(keys, videos.match_videos(keys, filmed, strict=False))


@query(f"with {_P} select b.bodypart, round(avg(case when x is null or y is null then 1.0 else 0.0 end), 6) as missing, avg(case when x is null or y is null then 1.0 else 0.0 end) > 0.5 as much from pts p join bodyparts b on b.kp = p.kp group by 1")
def missing_check(s, d):
    """Body parts that are missing in more than half of all rows are marked."""
    return missing_share(_points(s, d).join(read(s, d, "bodyparts"), "kp")).withColumn("missing", F.round("missing", 6))


@query("select s.syllable, label, short_description from (select distinct syllable from results) s join syll_info using (syllable)")
def labelled_syllables(s, d):
    return read(s, d, "results").select("syllable").distinct().join(read(s, d, "syll_info").select("syllable", "label", "short_description"), "syllable")


@query("select syllable, coalesce(label, '') as label, true as shown from syll_info where coalesce(movie_path, '') <> '' union all select syllable, coalesce(label, ''), false from syll_info where coalesce(movie_path, '') = ''")
def info_with_and_without_movie(s, d):
    """The label table put together again from the syllables with a movie and those without."""
    info, movie = read(s, d, "syll_info"), F.coalesce("movie_path", F.lit("")) != ""
    part = lambda rows, shown: rows.select("syllable", F.coalesce("label", F.lit("")).alias("label"), F.lit(shown).alias("shown"))
    return part(info.where(movie), True).unionByName(part(info.where(~movie), False))


@query(_W + "select distinct recording from r where recording not in (select rec from grp)")
def index_missing(s, d):
    return _states(s, d).select("recording").distinct().join(_groups(s, d), "recording", "left_anti")


@query("select distinct recording from frames where recording in (select recording from results)")
def overlap_guard(s, d):
    return read(s, d, "frames").select("recording").distinct().join(read(s, d, "results").select("recording"), "recording", "left_semi")


@query("select coalesce(a.syllable, b.syllable) as syllable, coalesce(b.label, '') as label, a.syllable is not null as used from (select distinct syllable from results where syllable is not null) a full join syll_info b on a.syllable = b.syllable")
def full_outer_info(s, d):
    a = read(s, d, "results").select("syllable").where("syllable is not null").distinct().withColumn("used", F.lit(True))
    return a.join(read(s, d, "syll_info"), "syllable", "full").select("syllable", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("used", F.lit(False)).alias("used"))


@query("select syllable, case when label is null or label = '' then cast(syllable as varchar) else syllable || ' (' || label || ')' end as name from syll_info")
def syllable_names(s, d):
    return read(s, d, "syll_info").select("syllable", F.when(F.coalesce("label", F.lit("")) == "", F.col("syllable").cast("string")).otherwise(F.format_string("%s (%s)", "syllable", "label")).alias("name"))


@query("select recording from (select distinct recording from results intersect select distinct recording from frames) union all select name from (select distinct name from recording_index except select distinct recording from results)")
def key_sets(s, d):
    f, r, i = (read(s, d, t) for t in ("frames", "results", "recording_index"))
    both = r.select("recording").intersect(f.select("recording"))
    return both.unionByName(i.select(F.col("name").alias("recording")).subtract(r.select("recording")))


# --- instances -------------------------------------------------------------------------------


@query(_W + ", " + _ELIG + ", w as (select *, unnest(range(-5, 15)) as rel from elig) select recording, syllable, start, rel, start + rel as pos from w")
def instance_windows(s, d):
    return instances.windows(_eligible(s, d), 5, 15)


def _ego(s, d) -> DataFrame:
    st = _states(s, d)
    pts = st.select("recording", "pos", F.lit(0).alias("kp"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    return instances.egocentric(_eligible(s, d), pts, st.withColumn("heading", F.coalesce("heading", F.lit(0.0))), 5, 15)


_EGO = _ELIG + """, w as (select *, unnest(range(-5, 15)) as rel from elig),
ego as (select w.recording, w.syllable, w.start, w.rel, 0 as kp, cos(coalesce(o.heading, 0)) * (p.cx - o.cx) + sin(coalesce(o.heading, 0)) * (p.cy - o.cy) as x, cos(coalesce(o.heading, 0)) * (p.cy - o.cy) - sin(coalesce(o.heading, 0)) * (p.cx - o.cx) as y
from w join r o on o.recording = w.recording and o.pos = w.start join r p on p.recording = w.recording and p.pos = w.start + w.rel),
typ as (select syllable, rel, median(x) as x, median(y) as y from ego group by 1, 2)"""


@query(_W + ", " + _EGO + " select recording, syllable, start, rel, round(x, 4) as x, round(y, 4) as y from ego")
def egocentric_trajectories(s, d):
    return _ego(s, d).select("recording", "syllable", "start", "rel", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(_W + ", " + _EGO + " select syllable, rel, round(x, 4) as x, round(y, 4) as y from typ")
def typical_trajectory(s, d):
    return instances.typical(_ego(s, d)).select("syllable", "rel", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(_W + ", " + _EGO + " select a.syllable as a, b.syllable as b, round(1 - sum(a.x * b.x + a.y * b.y) / sqrt(sum(a.x ** 2 + a.y ** 2) * sum(b.x ** 2 + b.y ** 2)), 5) as distance from typ a join typ b using (rel) group by 1, 2")
def trajectory_similarity(s, d):
    return instances.similarity(instances.typical(_ego(s, d))).withColumn("distance", F.round("distance", 5))


def _ego_poses(s, d) -> DataFrame:
    frames = read(s, d, "frames").withColumn("conf", F.when(F.col("pose").isNull(), F.col("conf")))  # else confidences only add to what moves
    return instances.egocentric_poses(_eligible(s, d), _states(s, d), signal.poses(frames), 5, 15)


_EGO_KP = _ELIG.replace("elig as (", "elig as materialized (") + ", " + _taps(-4, 4, "b.cx as x, b.cy as y, coalesce(b.heading, 0) as h") + f""", fil as materialized (select recording, pos, median(x) as fx, median(y) as fy, atan2(median(sin(h)), median(cos(h))) as fh from taps group by 1, 2),
w as materialized (select *, unnest(range(-5, 15)) as rel from elig), {_P.replace("pts as (", "pts as materialized (")}, rf as materialized (select recording, pos, frame from r),
at_ as materialized (select w.recording, w.syllable, w.start, w.rel, fx, fy, fh, rf.frame from w join fil o on o.recording = w.recording and o.pos = w.start join rf on rf.recording = w.recording and rf.pos = w.start + w.rel),
ego as materialized (select a.recording, a.syllable, a.start, a.rel, cast(p.kp as int) as kp, cos(fh) * (p.x - fx) + sin(fh) * (p.y - fy) as x, cos(fh) * (p.y - fy) - sin(fh) * (p.x - fx) as y
from at_ a join pts p on p.recording = a.recording and p.frame = a.frame where p.x is not null and p.y is not null),
typ as (select syllable, rel, kp, median(x) as x, median(y) as y from ego group by 1, 2, 3)"""


@query(_W + ", " + _EGO_KP + " select recording, syllable, start, rel, kp, round(x, 4) as x, round(y, 4) as y from ego")
def egocentric_keypoints(s, d):
    """All keypoints around each instance, in the frame of the filtered centroid and heading at its onset."""
    return instances.per_keypoint(_ego_poses(s, d)).select("recording", "syllable", "start", "rel", "kp", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(_W + ", " + _EGO_KP + " select syllable, rel, kp, round(x, 4) as x, round(y, 4) as y from typ")
def typical_keypoints(s, d):
    return instances.typical(instances.per_keypoint(_ego_poses(s, d))).select("syllable", "rel", "kp", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(_W + ", " + _EGO_KP + " select a.syllable as a, b.syllable as b, round(1 - sum(a.x * b.x + a.y * b.y) / sqrt(sum(a.x ** 2 + a.y ** 2) * sum(b.x ** 2 + b.y ** 2)), 5) as distance from typ a join typ b using (rel, kp) group by 1, 2")
def keypoint_similarity(s, d):
    return instances.similarity(instances.typical(instances.per_keypoint(_ego_poses(s, d)))).withColumn("distance", F.round("distance", 5))


@query()
def typical_keypoints_dense(s, d):
    """Typical trajectories over the instances around each syllable's exemplar."""
    k = read(s, d, "bodyparts").count()  # fixed table
    return instances.typical_dense(_ego_poses(s, d), 5, 15, k, n=10)


@query(_W + ", " + _ELIG + """ select recording, syllable, start, "end" from (select *, row_number() over (partition by syllable order by md5('3-' || recording || '-' || cast(start as varchar)), recording, start) as k from elig) where k <= 4""")
def random_sample(s, d):
    return instances.draw(_eligible(s, d), ["syllable"], ["recording", "start"], 4, 3)


@query(f"with {_P}, c as (select *, log10(conf + 0.001) as c from pts where conf >= 0), m as (select min(c) lo, max(c) hi from c), b as (select recording, frame, kp, cast(least(floor((c - lo) / (hi - lo) * 10), 9) as int) as bin from c, m) select recording, frame, cast(kp as int) as kp, bin from (select *, row_number() over (partition by bin order by md5('5-' || recording || '-' || cast(frame as varchar) || '-' || cast(kp as varchar)), recording, frame, kp) as k from b) where k <= 10")
def stratified_sample(s, d):
    p = _points(s, d).where("conf is not null and conf >= 0").withColumn("c", F.log10(F.col("conf") + 0.001))
    span = p.agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    b = p.crossJoin(F.broadcast(span)).select("recording", "frame", "kp", F.least(F.floor((F.col("c") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 10), F.lit(9)).cast("int").alias("bin"))  # span is one row
    first = F.substring(F.md5(F.concat_ws("-", F.lit("5"), "recording", F.col("frame").cast("string"), F.col("kp").cast("string"))), 1, 3)
    head = Window.partitionBy("bin", "_salt").orderBy("_h", "recording", "frame", "kp")
    salted = b.withColumn("_h", F.md5(F.concat_ws("-", F.lit("5"), "recording", F.col("frame").cast("string"), F.col("kp").cast("string")))).withColumn("_salt", first)
    few = salted.withColumn("_k", F.row_number().over(head)).where("_k <= 10").drop("_k")  # a bin may hold most cells: first within slices of the hash
    last = Window.partitionBy("bin").orderBy("_h", "recording", "frame", "kp")
    return few.withColumn("_k", F.row_number().over(last)).where("_k <= 10").select("recording", "frame", "kp", "bin")


@query()
def density_exemplar(s, d):
    v = read(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    return instances.density_exemplars(v)


@query(f"with {_OUT} select cast(kp as int) as kp, round(regr_slope(log10(distance + 1), log10(conf + 0.001)), 5) as slope, round(regr_intercept(log10(distance + 1), log10(conf + 0.001)), 5) as intercept from dist where distance is not null and conf >= 0 group by 1")
def regression_calibration(s, d):
    m = signal.medoid_outliers(_poses(s, d)).where("distance is not null and conf >= 0")
    e, c = F.log10(F.col("distance") + 1), F.log10(F.col("conf") + 0.001)
    return m.groupBy("kp").agg(F.round(F.regr_slope(e, c), 5).alias("slope"), F.round(F.regr_intercept(e, c), 5).alias("intercept"))


@query(_W + ", " + _EGO_KP + """, far as (select unnest([max(abs(x)), max(abs(y))]) as v from ego group by recording, start, rel), win as (select cast(ceil(quantile_cont(round(v, 2), 0.9) * 1.1 * 2 / 16) * 16 as int) as side from far),
pick as (select recording, syllable, start, "end" from (select *, row_number() over (partition by syllable order by md5('3-' || recording || '-' || cast(start as varchar)), recording, start) as k from elig) where k <= 4)
select p.recording, p.syllable, p.start, p."end", round(fx, 4) as x, round(fy, 4) as y, round(fh, 4) as heading, side as "window" from pick p join fil f on f.recording = p.recording and f.pos = p.start, win""")
def grid_manifest(s, d):
    """What a grid of examples shows: drawn instances, where to crop and how far to turn, and the common window."""
    few = instances.draw(_eligible(s, d), ["syllable"], ["recording", "start"], 4, 3)
    at = signal.body_frame(_states(s, d)).select("recording", F.col("pos").alias("start"), F.round("fx", 4).alias("x"), F.round("fy", 4).alias("y"), F.round("fh", 4).alias("heading"))
    return few.join(at, ["recording", "start"]).crossJoin(F.broadcast(instances.window_size(_ego_poses(s, d))))  # one row


# --- models ----------------------------------------------------------------------------------


@query()
def pca_variance(s, d):
    return model.variance_explained(read(s, d, "embeddings"), "embedding", 64)


_U = "((cast('0x' || substr(md5('42-' || recording || '-' || cast(frame as varchar) || '-' || cast(kp as varchar) || '-{0}'), 1, 8) as bigint) / 4294967296.0) * 2 - 1) * 0.1"
_FORMATTED = f"with {_P}, " + _INT.format(src="pts") + f""", fr as (select recording, frame, row_number() over (partition by recording order by frame) - 1 as pos, count(*) over (partition by recording) as n from (select distinct recording, frame from lin)),
own as (select *, pos // 50 as seg, false as context from fr), ext as (select * from own union all select recording, frame, pos, n, seg + 1, true from own where pos % 50 >= 47 and (seg + 1) * 50 < n)"""


@query(_FORMATTED + f" select e.recording, seg, pos, context, cast(kp as int) as kp, round(x + {_U.format('x')} + {NUDGE!r}, 5) as x, round(y + {_U.format('y')} + {NUDGE!r}, 5) as y, round(greatest(coalesce(conf, 0), 0) + 0.001, 6) as conf from ext e join lin using (recording, frame)")
def formatted_data(s, d):
    """Model input from frames: interpolated, cleaned, with noise, in segments of 50 with 3 rows of context."""
    f = formatting.format_data(read(s, d, "frames"), list(range(8)), 50)
    z = f.select("recording", "seg", "pos", "context", F.posexplode(F.arrays_zip("x", "y", "conf")).alias("kp", "z"))
    return z.select("recording", "seg", "pos", "context", "kp", F.round(F.col("z.x") + NUDGE, 5).alias("x"), F.round(F.col("z.y") + NUDGE, 5).alias("y"), F.round("z.conf", 6).alias("conf"))


def _aligned(s, d) -> DataFrame:
    return formatting.aligned(formatting.cleaned(read(s, d, "frames"), list(range(8))), [0, 1], [6, 7])


@query(f"with {_P}, " + _INT.format(src="pts") + """, c as (select recording, frame, median(x) as cx, median(y) as cy, atan2(avg(case when kp in (6, 7) then y end) - avg(case when kp in (0, 1) then y end), avg(case when kp in (6, 7) then x end) - avg(case when kp in (0, 1) then x end)) + pi() as h from lin group by 1, 2),
v as (select recording, frame, kp * 2 + a as i, case when a = 0 then cos(h) * (x - cx) + sin(h) * (y - cy) else cos(h) * (y - cy) - sin(h) * (x - cx) end as v from lin join c using (recording, frame), (select unnest([0, 1]) as a)),
m as (select i, avg(v) as m, count(*) as n from v group by 1), w as (select v.*, v.v - m.m as z from v join m using (i))
select cast(a.i as int) as i, cast(b.i as int) as j, round(corr(a.z, b.z), 6) as correlation from w a join w b using (recording, frame) where a.i < b.i group by 1, 2""")
def pose_correlation(s, d):
    """Correlation of the coordinates of aligned poses, from the moments behind the principal components."""
    n, x, xx = formatting.moments(_aligned(s, d), "v", 16)
    cov = xx / max(n, 1) - np.outer(x, x) / max(n, 1) ** 2
    rows = [(i, j, float(cov[i, j] / np.sqrt(cov[i, i] * cov[j, j]))) for i in range(16) for j in range(i + 1, 16) if cov[i, i] > 0 < cov[j, j]] if n else []
    return s.createDataFrame(rows, "i int, j int, correlation double").withColumn("correlation", F.round("correlation", 6))


@query()
def pose_pca_variance(s, d):
    return model.variance_explained(_aligned(s, d), "v", 16)


@query()
def pose_latents(s, d):
    """Scores of every aligned pose on the first four components."""
    v = _aligned(s, d)
    return formatting.pca_project(v, "v", formatting.pca_fit(v, "v", 16), 4).select("recording", "frame", "latent")


@query(_W + "select round(sum((50 - n % 50) % 50) / sum(n) * 100, 6) as padding from (select recording, max(n) as n from r group by 1)")
def segment_padding(s, d):
    return model.padding_share(_states(s, d), 50).select(F.round("padding", 6).alias("padding"))


@query(_W + 'select recording, pos // 50 as seg, min(pos) as start, max(pos) + 1 as "end" from r group by 1, 2')
def segment_batch(s, d):
    return model.segments(_states(s, d), 50)


def _latent(s, d) -> DataFrame:
    r = states(read(s, d, "results"), ["latent_state"]).where("latent_state is not null")
    return r.select("recording", "pos", F.floor(F.col("pos") / 1000).alias("seg"), F.col("latent_state").alias("x"))


_HYPER = model.Hyper(states=100, lags=3, kappa=20.0)  # the size of the configuration


def _fitted(s, d) -> model.Params:
    return model.fit(_latent(s, d), _HYPER, 3, seed=1)[0]


@query()
def arhmm_fit(s, d):
    trace = model.fit(_latent(s, d), _HYPER, 3, seed=1)[1]
    return s.createDataFrame([(i, float(v)) for i, v in enumerate(trace)], "iteration int, log_likelihood double")


@query()
def arhmm_apply(s, d):
    return model.apply(_latent(s, d), _fitted(s, d))


@query()
def state_marginals(s, d):
    return model.state_marginals(_latent(s, d), _fitted(s, d))


@query()
def model_likelihood(s, d):
    """Three models, each fitted to the latents of a third of the recordings and scored on those of the others."""
    part = F.pmod(F.xxhash64("recording"), F.lit(3))
    latents = [_latent(s, d).where(part == j) for j in range(3)]
    return model.cross_likelihoods(latents, [model.fit(x, _HYPER, 3, seed=1)[0] for x in latents])


@query(_W + """, snap as (select k as kappa, 1 as iter, recording, pos, syllable // k as syllable from r, (select unnest([1, 4]) as k)),
f2 as (select *, case when syllable = lag(syllable) over (partition by kappa, recording order by pos) then 0 else 1 end as new from snap), q2 as (select *, sum(new) over (partition by kappa, recording order by pos) as run from f2)
select cast(kappa as double) as kappa, iter, median(len) as median_duration from (select kappa, iter, recording, run, count(*) as len from q2 group by all) group by 1, 2""")
def kappa_scan_summary(s, d):
    st = states(read(s, d, "results")).select("recording", "pos", "n", "syllable")
    snap = st.withColumn("kappa", F.explode(F.array(F.lit(1), F.lit(4)))).withColumn("syllable", F.floor(F.col("syllable") / F.col("kappa")).cast("int")).withColumn("iter", F.lit(1))
    return model.kappa_summary(snap)


@query()
def pose_model_results(s, d):
    """Results of the whole model, of the configuration's size, fitted to all poses: state, latent state, centroid and heading of every frame."""
    use = list(range(read(s, d, "bodyparts").count()))  # fixed table
    store = pose_store.build(read(s, d, "frames"), use, [0, 1], [6, 7], lags=_HYPER.lags)
    p, last = pose_model.fit(pose_store.start(store, _HYPER, 4), store)
    return pose_store.extract(p, store, last)


# --- streams ---------------------------------------------------------------------------------


def _event_stream(s, d) -> DataFrame:
    """``events`` as a stream; its timestamps carry no zone and count as UTC."""
    return s.readStream.schema(read(s, d, "events").schema).parquet(f"{d}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("select * from (select time_bucket(interval '1 day', ts) as start, event_type, count(*) as n from events group by 1, 2) where start + interval '1 day' <= (select max(ts) - interval '1 hour' from events)")
def stream_window_usage(s, d):
    """Windows the watermark has closed after all input."""
    return streams.run_to_table(streams.window_usage(_event_stream(s, d), "ts", "event_type", "1 day")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '12 hours' then 0 else 1 end as new from events),
b as (select *, sum(new) over (partition by user_id order by ts) as k from e), x as (select user_id, min(ts) as start, max(ts) + interval '12 hours' as "end", count(*) as n from b group by user_id, k)
select * from x where "end" <= (select max(ts) - interval '1 hour' from events)""")
def stream_sessions(s, d):
    """Sessions the watermark has closed after all input."""
    out = streams.run_to_table(streams.sessions(_event_stream(s, d), "user_id", "ts", "12 hours"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


_LATE = 64


@query(f"""with top as (select recording, max(frame) as m from results where recording is not null and frame is not null group by 1),
r as (select recording, frame, syllable from {_RES} join top using (recording) where frame <= m - {_LATE} and syllable is not null),
f_ as (select *, case when syllable = lag(syllable) over (partition by recording order by frame) then 0 else 1 end as new from r), q as (select *, sum(new) over (partition by recording order by frame) as run from f_),
x as (select recording, run, syllable, cast(min(frame) as bigint) as first_frame, cast(max(frame) as bigint) as last_frame, count(*) as n from q group by 1, 2, 3), l as (select recording, max(run) as m from x group by 1)
select x.recording, syllable, first_frame, last_frame, n from x join l using (recording) where run < m""")
def stream_rle(s, d):
    """Runs a stream has closed after all input: rows become final {_LATE} frames later, and every recording's last run is still open."""
    source = s.readStream.schema(read(s, d, "results").schema).parquet(f"{d}/result[s].parquet")
    return streams.with_state_store(s, lambda: streams.run_to_table(streams.stream_runs(source, _LATE)))


@query()
def stream_filtering(s, d):
    """Online state probabilities under the parameters of the fit."""
    source = s.readStream.schema(read(s, d, "results").schema).parquet(f"{d}/result[s].parquet")
    p = _fitted(s, d)
    return streams.with_state_store(s, lambda: streams.run_to_table(streams.stream_filter(source.withColumnRenamed("latent_state", "x"), p, _LATE)))


@query()
def syllable_dendrogram(s, d):
    """Clustering of the syllables by their typical keypoint trajectories."""
    return clustering.dendrogram(instances.similarity(instances.typical(instances.per_keypoint(_ego_poses(s, d)))))


@query(_W + ", " + _FREQ + """, b as (select grp, name, syllable, value, rep, cast('0x' || substr(md5('0-' || rep || '-' || name), 1, 8) as bigint) / 4294967296.0 as u from dense, (select unnest(range(1, 201)) as rep)),
w as (select *, (u >= 0.36787944117144233)::int + (u >= 0.7357588823428847)::int + (u >= 0.9196986029286058)::int + (u >= 0.9810118431238462)::int + (u >= 0.9963401531726563)::int + (u >= 0.9994058151824183)::int as k from b),
m as (select grp, syllable, rep, sum(value * k) / nullif(sum(k), 0) as m from w group by all)
select grp as "group", syllable, round(quantile_cont(m, 0.16), 9) as low, round(quantile_cont(m, 0.84), 9) as high from m group by 1, 2""")
def bootstrap_intervals(s, d):
    return kinematics.bootstrap_interval(_frequencies(s, d), "value").withColumns({c: F.round(c, 9) for c in ("low", "high")})


@query()
def pose_reconstruction(s, d):
    """Poses of every frame's latent state under a fixed set of loadings."""
    r = states(read(s, d, "results"), ["latent_state", "centroid", "heading"]).where("latent_state is not null and centroid is not null")
    rows = r.select("recording", "frame", F.col("latent_state").alias("x"), F.col("centroid").alias("v"), F.coalesce("heading", F.lit(0.0)).alias("h"))
    return model.reconstruct(rows, np.random.default_rng(0).normal(size=(16, 4)), 8).select("recording", "frame", "pose")


QUERIES = Q

