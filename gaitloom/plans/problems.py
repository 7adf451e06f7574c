"""The pN_ queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitloom.operators.fill import fill_cells, fill_missing
from gaitloom.operators.spikes import implausible_readings
from gaitloom.tables import read


def keypoints(spark: SparkSession, d: str) -> int:
    """Number of keypoints by the fixed table of body parts."""
    return (read(spark, d, "bodyparts").agg(F.max("kp")).first()[0] or 0) + 1


def _inputs(spark: SparkSession, d: str) -> tuple:
    return read(spark, d, "frames"), read(spark, d, "recording_index"), read(spark, d, "rigs"), keypoints(spark, d)


def p2_cells(spark: SparkSession, d: str) -> DataFrame:
    return fill_cells(*_inputs(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_cells(spark, d).select("recording", "frame", "kp", "field")


def p2_filled(spark: SparkSession, d: str) -> DataFrame:
    return fill_missing(*_inputs(spark, d))


def p4_flags(spark: SparkSession, d: str) -> DataFrame:
    return implausible_readings(*_inputs(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_flags(spark, d).select("recording", "frame", "kp", "field")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_cells, p2_filled, p4_found, p4_flags)}

_CELLS = r"""
with f as materialized (select recording, frame, pose, conf from (select *, row_number() over (partition by recording, frame order by loaded_at desc nulls last) as rn from frames where recording is not null and frame is not null) where rn = 1),
idx as materialized (select lower(regexp_replace(trim(name), '\.[A-Za-z0-9]{1,5}$', '')) as rec, min(rig) as rig, cast(min(recorded_at) as date) as day from recording_index where name is not null group by 1),
recs as materialized (select recording, count(*) as n from frames where recording is not null and frame is not null group by 1),
named as materialized (select r.recording, min(g.rig) as rig from recs r join rigs g on contains(lower(r.recording), g.rig) group by 1),
meta as materialized (select r.recording, coalesce(i.rig, n.rig) as rig, i.day from recs r left join named n on n.recording = r.recording left join idx i on i.rec = lower(regexp_replace(trim(r.recording), '\.[A-Za-z0-9]{1,5}$', ''))),
whole as materialized (select recording, p[1] as x, p[2] as y, count(*) as n from (select recording, unnest(pose) as p from frames where recording is not null and frame is not null) where not isnan(p[1]) and not isnan(p[2]) and p[1] = floor(p[1]) and p[2] = floor(p[2]) group by 1, 2, 3),
hits as materialized (select rig, x, y, count(*) as recs, sum(n) as n from whole join meta using (recording) group by 1, 2, 3),
sizes as materialized (select recording, sum(coalesce(len(pose), 0)) as cells from frames where recording is not null and frame is not null group by 1),
tot as materialized (select rig, count(*) as recs, sum(cells) as cells from sizes join meta using (recording) group by 1),
pairs as materialized (select rig, x, y from (select h.*, row_number() over (partition by h.rig order by h.recs desc, h.n desc, h.x desc, h.y desc) as rn from hits h join tot t using (rig) where h.recs >= 0.25 * t.recs and h.n >= 0.001 * t.cells and h.n >= 3) where rn = 1),
o as materialized (
  select c.recording, m.rig, m.day, frame, cast(k as int) as kp, 'pose' as field, c.x, c.y, coalesce(not isnan(c.x) and not isnan(c.y) and not coalesce(c.x = p.x and c.y = p.y, false), false) as ok
  from (select recording, frame, k, pose[k + 1][1] as x, pose[k + 1][2] as y from f, (select unnest(range(0, 8)) as k)) c join meta m using (recording) left join pairs p on p.rig = m.rig
  union all
  select c.recording, m.rig, m.day, frame, cast(k as int), 'conf', c.x, null, coalesce(not isnan(c.x), false)
  from (select recording, frame, k, conf[k + 1] as x from f, (select unnest(range(0, 8)) as k)) c join meta m using (recording))
"""
ORACLE: dict[str, str] = {
    "p2_found": _CELLS + "select recording, frame, kp, field from o where not ok",
    "p2_cells": _CELLS + """,
n as (select *, max(case when ok then frame end) over (partition by recording, field, kp order by frame rows between unbounded preceding and current row) as b,
  min(case when ok then frame end) over (partition by recording, field, kp order by frame rows between current row and unbounded following) as a from o),
miss as (select *, case when b is null or a - frame < frame - b then a else b end as near from n where not ok),
tops as (select recording, rig, day, field, kp, max(case when ok then frame end) as top from o group by all),
days as (select rig, day, field, kp, min_by(recording, recording) as donor, min_by(top, recording) as top from tops where top is not null group by all),
far as (select t.recording, t.field, t.kp, d.donor, d.top, abs(date_diff('day', d.day, t.day)) as days,
  row_number() over (partition by t.recording, t.field, t.kp order by d.day is null, abs(date_diff('day', d.day, t.day)), d.day) as rn
  from tops t join days d on d.rig is not distinct from t.rig and d.field = t.field and d.kp = t.kp and (t.day is not null or d.day is null) where t.top is null),
got as (select m.recording, m.frame, m.kp, m.field, case when near is not null then 'time' when x.top is not null then 'day' else 'none' end as method,
  cast(case when near is not null then abs(m.frame - near) else x.days end as int) as distance,
  case when near is not null then m.recording else x.donor end as donor_recording, coalesce(near, x.top) as donor_frame
  from miss m left join far x on x.recording = m.recording and x.field = m.field and x.kp = m.kp and x.rn = 1)
select g.*, v.x, v.y from got g left join o v on v.recording = g.donor_recording and v.frame = g.donor_frame and v.kp = g.kp and v.field = g.field""",
}
