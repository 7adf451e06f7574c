"""The pN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaitloom.llm.mixing import mix, mix_shares
from gaitloom.llm.packing import pack
from gaitloom.llm.patterns import frequent_patterns
from gaitloom.llm.percentiles import duration_summary, merge, percentiles, summarize, with_group
from gaitloom.llm.runs import collapse_runs
from gaitloom.llm.split import split_recordings
from gaitloom.llm.truncated import truncated, truncation_rates
from gaitloom.session import durable
from gaitloom.tables import by_block, in_force, read

PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]
#: Relative error of percentiles of continuous columns.
ERROR = 0.005


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pieces(spark, d).select("profile", "recording").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_recordings(read(spark, d, "frames"), read(spark, d, "split_limits"))


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of each recording must keep: frames covered once overlaps are taken off, pieces too long or too short, overlaps that
    are not as asked. Too short are only pieces of recordings that can be divided without any."""
    pieces, limits, frames = p1_pieces(spark, d), read(spark, d, "split_limits"), read(spark, d, "frames")
    per = pieces.join(F.broadcast(limits), "profile")  # a fixed table of profiles
    after = Window.partitionBy("profile", "recording").orderBy("piece")
    per = per.withColumn("next", F.lead("first_frame").over(after))
    # the frames shared with the next piece, counted in the frames that are there
    shown = by_block(frames.select("recording", "frame")).select("recording", "frame").distinct()
    shared = per.where("next is not null").select("profile", "recording", "piece", "overlap_frames", F.explode(F.sequence("next", F.greatest("next", "last_frame"))).alias("frame")).join(shown, ["recording", "frame"]).groupBy("profile", "recording", "piece", "overlap_frames").agg(F.count(F.lit(1)).alias("k"))
    wrong = shared.groupBy("profile", "recording").agg(F.sum((F.col("k") != F.col("overlap_frames")).cast("int")).alias("wrong_overlaps"))
    out = per.groupBy("profile", "recording").agg((F.sum("n_frames") - (F.count(F.lit(1)) - 1) * F.max("overlap_frames")).alias("frames"), F.sum((F.col("n_frames") > F.col("max_frames")).cast("int")).alias("too_long"), F.sum((F.col("n_frames") < F.col("min_frames")).cast("int")).alias("too_short"))
    return out.join(wrong, ["profile", "recording"], "left").na.fill({"wrong_overlaps": 0})


def p3_support(spark: SparkSession, d: str) -> DataFrame:
    return frequent_patterns(read(spark, d, "results"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_support(spark, d).drop("support")


def p5_runs(spark: SparkSession, d: str) -> DataFrame:
    return collapse_runs(read(spark, d, "results"), read(spark, d, "syll_info"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_runs(spark, d).select("recording", "first_frame", "last_frame")


def _durations(spark: SparkSession, d: str, per_day: bool) -> DataFrame:
    return duration_summary(read(spark, d, "results"), read(spark, d, "syll_info"), read(spark, d, "recording_index"), per_day)


def p6_duration_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per group and behaviour, from the stored summaries of separate days, combined in two portions."""
    by = ["group_name", "behaviour"]
    daily = durable(_durations(spark, d, True))
    odd = F.coalesce(F.dayofmonth("day") % 2 == 1, F.lit(False))
    return percentiles(merge([daily.where(odd).drop("day"), daily.where(~odd).drop("day")], by), by, PROBS)


def p6_daily_summary(spark: SparkSession, d: str) -> DataFrame:
    return _durations(spark, d, True)


def p6_heading_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Heading of every frame per group, within ERROR of exact."""
    rows = in_force(by_block(read(spark, d, "results").select("recording", "frame", "loaded_at", "heading")), ["heading"])
    per = with_group(summarize(rows, ["recording"], "heading", ERROR), read(spark, d, "recording_index"))
    out = percentiles(merge([per.select("group_name", "bin", "n")], ["group_name"]), ["group_name"], PROBS, ERROR)
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c[0] == "p"})


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(read(spark, d, "documents"), read(spark, d, "pack_limits"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per profile: containers, tokens, and the share of the room that is used."""
    c = p7_containers(spark, d).where("position = 0").groupBy("profile", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("fill").alias("tokens"))
    return c.withColumn("used", F.col("tokens") / (F.col("containers") * F.col("capacity")))


def p7_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What a packing must keep, per profile: documents placed, containers over capacity, places taken twice."""
    c = p7_containers(spark, d)
    place = c.groupBy("profile", "container", "position").agg(F.count(F.lit(1)).alias("k")).groupBy("profile").agg(F.sum((F.col("k") > 1).cast("int")).alias("taken_twice"))
    return c.groupBy("profile").agg(F.count_distinct("doc_id").alias("documents"), F.sum((F.col("fill") > F.col("capacity")).cast("int")).alias("overfull")).join(place, "profile")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_shares(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated(read(spark, d, "documents")).select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation_rates(read(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_pieces, p1_coverage, p3_found, p3_support, p5_found, p5_runs, p6_duration_percentiles, p6_daily_summary, p6_heading_percentiles, p7_containers, p7_fill, p7_coverage, p8_mixture, p8_shares, p9_found, p9_rates)
}

_IN_FORCE = "(select * from (select *, row_number() over (partition by recording, frame order by loaded_at desc nulls last) rn_ from results where recording is not null and frame is not null) where rn_ = 1)"
_RUNS = f"""
with named as (
  select syllable as id, min(nullif(regexp_replace(lower(label), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '')) as label from syll_info where syllable is not null group by 1),
rws as (
  select r.recording, r.frame, coalesce(n.label, '#' || cast(r.syllable as varchar)) as behaviour
  from {_IN_FORCE} r left join named n on n.id = r.syllable where r.syllable is not null),
flagged as (
  select *, case when frame - lag(frame) over (partition by recording, behaviour order by frame) <= 3 then 0 else 1 end as new from rws),
numbered as (select *, sum(new) over (partition by recording, behaviour order by frame) as run from flagged),
runs as (select recording, behaviour, min(frame) as first_frame, max(frame) as last_frame, count(*) as n_rows from numbered group by recording, behaviour, run),
reach as (select *, max(last_frame) over (partition by recording order by first_frame rows between unbounded preceding and 1 preceding) as reached from runs),
kept as (select recording, behaviour, first_frame, last_frame, n_rows, last_frame - first_frame + 1 as duration from reach where reached is null or reached < last_frame)
"""
_GROUPS = r"""
idx as (
  select lower(regexp_replace(trim(name), '\.[A-Za-z0-9]{1,5}$', '')) as rec, min(nullif(regexp_replace(lower(trim(group_name)), '[\s\-_]+', '_', 'g'), '')) as group_name
  from recording_index where name is not null group by 1)
"""

ORACLE: dict[str, str] = {
    "p1_found": "select l.profile, n.recording from (select recording, count(distinct frame) as n from frames where recording is not null group by 1) n join split_limits l on n.n > l.max_frames",
    "p5_runs": _RUNS + "select recording, behaviour, first_frame, last_frame, cast(n_rows as bigint) as n_rows, cast(duration as int) as duration from kept",
    "p5_found": _RUNS + "select recording, first_frame, last_frame from kept",
    "p6_duration_percentiles": _RUNS + "," + _GROUPS + """
select coalesce(i.group_name, '(none)') as group_name, behaviour, cast(count(*) as bigint) as n,
""" + ", ".join(f"cast(quantile_disc(duration, {p}) as double) as p{round(p * 100):02d}" for p in PROBS) + """
from kept left join idx i on i.rec = lower(trim(recording)) group by 1, 2""",
    "p1_coverage": "select l.profile, n.recording, n.n as frames, 0 as too_long, 0 as too_short, 0 as wrong_overlaps from (select recording, count(distinct frame) as n from frames where recording is not null group by 1) n join split_limits l on n.n > l.max_frames",
    "p6_daily_summary": _RUNS + "," + _GROUPS + """, days as (select recording, cast(max(loaded_at) as date) as day from results where recording is not null group by 1)
select day, coalesce(group_name, '(none)') as group_name, behaviour, cast(duration as double) as bin, count(*) as n
from kept left join days using (recording) left join idx on rec = lower(trim(recording)) group by all""",
    "p6_heading_percentiles": "with " + _GROUPS.strip() + f""", h as (select recording, heading as v from {_IN_FORCE} where heading is not null and not isnan(heading)),
b as (select coalesce(group_name, '(none)') as group_name, cast(case when v > 1e-9 then ceil(ln(abs(v) / 1e-9) / ln({(1 + ERROR) / (1 - ERROR)!r})) + 1 when v < -1e-9 then -ceil(ln(abs(v) / 1e-9) / ln({(1 + ERROR) / (1 - ERROR)!r})) - 1 else 0 end as bigint) as bin from h left join idx on rec = lower(trim(recording))),
c as (select group_name, count(*) as n, """ + ", ".join(f"quantile_disc(bin, {p}) as b{round(p * 100):02d}" for p in PROBS) + """ from b group by 1)
select group_name, n, """ + ", ".join(f"round(case when b{k} = 0 then 0.0 else sign(b{k}) * 1e-9 * pow({(1 + ERROR) / (1 - ERROR)!r}, abs(b{k}) - 1) * 2 / (1 + {(1 + ERROR) / (1 - ERROR)!r}) end, 9) as p{k}" for k in (f"{round(p * 100):02d}" for p in PROBS)) + " from c",
    "p7_coverage": "select profile, (select count(*) from documents where doc_id is not null) as documents, 0 as overfull, 0 as taken_twice from pack_limits where profile is not null and capacity_tokens is not null",
    "p3_support": f"""
with e as (select recording, frame, syllable from {_IN_FORCE} where syllable is not null),
c as (select *, lag(syllable) over (partition by recording order by frame) as before from e),
s as (select recording, syllable, row_number() over (partition by recording order by frame) as pos from c where before is null or before <> syllable),
q as (select distinct a.recording, a.syllable s1, b.syllable s2, c.syllable s3, d.syllable s4
  from s a join s b on b.recording = a.recording and b.pos - a.pos between 1 and 3 and b.syllable <> a.syllable
  join s c on c.recording = a.recording and c.pos - b.pos between 1 and 3 and c.syllable not in (a.syllable, b.syllable)
  join s d on d.recording = a.recording and d.pos - c.pos between 1 and 3 and d.syllable not in (a.syllable, b.syllable, c.syllable))
select s1, s2, s3, s4, count(*) as support from q group by 1, 2, 3, 4
having count(*) >= 3 and count(*) >= 0.1 * (select count(distinct recording) from results)""",
}
ORACLE["p3_found"] = f"select s1, s2, s3, s4 from ({ORACLE['p3_support']})"
