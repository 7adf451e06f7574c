"""The whole model over many poses: segments in batches of like length, kept as files in the shared folder.

Frames are hashed once by (recording, block) and packed, a row for each block, at a few bytes a value.
A recording that lies in one block is cleaned inside its row; blocks of longer ones get bounds and
neighbours from the others first. A batch is one file that is written once with what sampling does not
change, and one with the latent states, centroids, headings and states, replaced by every iteration.
So an iteration moves nothing but its sums, and a step in time is one product over a batch.
"""

from __future__ import annotations

import pickle
import uuid
from dataclasses import dataclass, replace
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaitloom.operators import formatting, pose_model, signal
from gaitloom.operators import model as M
from gaitloom.session import durable, release, shared_folder
from gaitloom.tables import by_block, in_force

#: Rows of a batch, and of the smallest that a table is cut into.
HELD, LEAST = 105_000, 4_000
RESULT = "recording string, frame int, syllable int, latent_state array<double>, centroid array<double>, heading double"
_PACKED = "recording string, block int, n int, width int, frames binary, x binary, y binary, c binary"
_SEGMENT = "recording string, seg bigint, skip int, n int, frames binary, y binary, c binary"


# --- files -----------------------------------------------------------------------------------


def _save(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Written under another name first, so that a task that is run again leaves no half file."""
    at, path = fs.FileSystem.from_uri(folder)
    part = f"{path}/part-{uuid.uuid4().hex}"
    with at.open_output_stream(part) as f:
        f.write(pickle.dumps(arrays, 5))
    at.move(part, f"{path}/{name}")


def _load(folder: str, name: str) -> dict[str, np.ndarray]:
    at, path = fs.FileSystem.from_uri(folder)
    with at.open_input_stream(f"{path}/{name}") as f:
        return pickle.loads(f.read())


def _new(folder: str) -> str:
    at, path = fs.FileSystem.from_uri(folder)
    at.create_dir(path, recursive=True)
    return folder


def _delete(folder: str) -> None:
    at, path = fs.FileSystem.from_uri(folder)
    at.delete_dir(path)


# --- packing ---------------------------------------------------------------------------------


def encode(a: np.ndarray) -> bytes:
    """Doubles (rows, columns), exactly: as whole numbers of a decimal unit where they are such, then compressed."""
    gone, scale = np.isnan(a), 0.0
    plain = np.where(gone, 0.0, a)
    if np.abs(plain).max(initial=0) < 1e5 and not (np.signbit(plain) & (plain == 0)).any():
        scale = next((u for u in (1.0, 10.0, 100.0, 1e3, 1e4) if np.array_equal(np.rint(plain * u) / u, plain)), 0.0)
    if scale:
        whole = np.where(gone, -(2**31), np.rint(plain * scale)).astype(np.int32)
        raw = np.diff(whole, axis=0, prepend=np.zeros((1, a.shape[1]), np.int32)).T.tobytes()
    else:
        raw = np.ascontiguousarray(a.T).tobytes()
    return np.float64(scale).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def decode(b: bytes, n: int, width: int) -> np.ndarray:
    scale = np.frombuffer(b[:8])[0]
    raw = pa.decompress(b[8:], n * width * (4 if scale else 8), codec="zstd", asbytes=True)
    if not scale:
        return np.frombuffer(raw).reshape(width, n).T
    whole = np.cumsum(np.frombuffer(raw, np.int32).reshape(width, n).T, axis=0, dtype=np.int32)
    return np.where(whole == -(2**31), np.nan, whole / scale)


def _dense(flat: np.ndarray, first: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """Lists of any lengths as rows of ``width``, NaN where a list is shorter."""
    if (length == width).all():
        return flat[first[0] : first[0] + len(first) * width].reshape(-1, width) if len(first) else np.empty((0, width))
    out, n = np.full((len(first), width), np.nan), np.repeat(np.arange(len(first)), length)
    at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    out[n, at] = flat[np.repeat(first, length) + at]
    return out


def _lists(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of lists; null ones are empty."""
    off = a.offsets.to_numpy()
    return off[:-1], np.where(a.is_valid().to_numpy(zero_copy_only=False), np.diff(off), 0)


def _doubles(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False).astype(float, copy=False)


def _values(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x, y and confidence (rows, keypoints) of poses, NaN where missing, and which rows have keypoints at all."""
    pose, conf = b.column("pose"), b.column("conf")
    (first, length), (cfirst, clength) = _lists(pose), _lists(conf)
    inner, coords = pose.values, _doubles(pose.values.values)
    at, size = _lists(inner)
    pick = lambda i: np.where(size > i, coords[np.minimum(at + i, len(coords) - 1)] if len(coords) else np.nan, np.nan)
    width = int(max(length.max(initial=0), clength.max(initial=0)))
    return _dense(pick(0), first, length, width), _dense(pick(1), first, length, width), _dense(_doubles(conf.values), cfirst, clength, width), (length > 0) | (clength > 0)


def pack(frames: DataFrame) -> DataFrame:
    """A row for each (recording, block) of the frames in force: their number, the keypoints of the widest, and their arrays."""
    rows = in_force(by_block(frames.select("recording", "frame", "loaded_at", "pose", "conf")), ["pose", "conf"])  # in order inside a task

    def row(key: tuple, parts: list) -> dict:
        width = max(p[1].shape[1] for p in parts)
        x, y, c = (np.concatenate([np.pad(p[i], ((0, 0), (0, width - p[i].shape[1])), constant_values=np.nan) for p in parts]) for i in (1, 2, 3))
        f = np.concatenate([p[0] for p in parts])
        return {"recording": key[0], "block": key[1], "n": len(f), "width": width, "frames": f.tobytes(), "x": encode(x), "y": encode(y), "c": encode(c)}

    def work(batches):
        key, parts = None, []
        for b in batches:
            out = []
            x, y, c, there = _values(b)
            rec, block, f = (b.column(n).to_numpy(zero_copy_only=False)[there] for n in ("recording", "block", "frame"))
            x, y, c = x[there], y[there], c[there]
            cuts = np.r_[0, np.flatnonzero((rec[1:] != rec[:-1]) | (block[1:] != block[:-1])) + 1, len(f)] if len(f) else np.zeros(1, int)
            for i, j in zip(cuts[:-1], cuts[1:]):
                if (rec[i], int(block[i])) != key:
                    out += [row(key, parts)] if parts else []
                    key, parts = (rec[i], int(block[i])), []
                parts.append((f[i:j].astype(np.int32), x[i:j], y[i:j], c[i:j]))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_schema(_PACKED))
        if parts:
            yield pa.RecordBatch.from_pylist([row(key, parts)], schema=_schema(_PACKED))

    return rows.mapInArrow(work, _PACKED)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


# --- cleaning --------------------------------------------------------------------------------


def _middle(a: np.ndarray, axis: int) -> np.ndarray:
    """Median of what is not NaN; NaN if there is nothing."""
    s, n = np.sort(a, axis), (~np.isnan(a)).sum(axis, keepdims=True)
    at = lambda i: np.take_along_axis(s, np.maximum(i, 0), axis)
    return ((at((n - 1) // 2) + at(n // 2)) / 2).squeeze(axis)


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances (rows, keypoints) from the frame's medoid."""
    return np.sqrt((x - _middle(x, 1)[:, None]) ** 2 + (y - _middle(y, 1)[:, None]) ** 2)


def blank(x: np.ndarray, y: np.ndarray, c: np.ndarray, use: list[int], bound: np.ndarray | None = None, outliers: float = 6.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y, conf of the keypoints ``use``: NaN and 0 where a distance is beyond the recording's ``bound`` (of these rows, if none is given)."""
    far = _far(x, y)
    if bound is None:
        med = _middle(far, 0)
        bound = med + outliers * _middle(np.abs(far - med), 0)
    out = far > bound
    wide = max(0, max(use, default=-1) + 1 - x.shape[1])
    x, y, c, out = (np.pad(a, ((0, 0), (0, wide)), constant_values=v)[:, use] for a, v in ((x, np.nan), (y, np.nan), (c, np.nan), (out, False)))
    gone = np.isnan(x) | np.isnan(y) | out
    return np.where(gone, np.nan, x), np.where(gone, np.nan, y), np.where(out, 0.0, c)


def fill(frames: np.ndarray, x: np.ndarray, y: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """x and y (rows, keypoints) with NaN filled as :func:`signal.interpolate` does.

    ``before`` and ``after`` (keypoints, 3): frame, x, y of the nearest readings outside, NaN where there are none.
    """
    x, y, frames = x.copy(), y.copy(), frames.astype(float)
    for k in np.flatnonzero(np.isnan(x).any(0)):
        there = ~np.isnan(x[:, k])
        have, gone = np.stack([frames, x[:, k], y[:, k]], 1)[there], ~there
        have = np.concatenate([have, *[e[k : k + 1] for e in (before, after) if e is not None and not np.isnan(e[k, 0])]])
        if not len(have):
            x[:, k] = y[:, k] = 0.0
            continue
        have = have[np.argsort(have[:, 0], kind="stable")]
        i = np.searchsorted(have[:, 0], frames[gone])
        p, q = have[np.maximum(i - 1, 0)], have[np.minimum(i, len(have) - 1)]
        p = np.where((i == 0)[:, None], q, p)
        t = (frames[gone] - p[:, 0]) / np.where(p[:, 0] == q[:, 0], 1, q[:, 0] - p[:, 0])
        for v, c in ((x, 1), (y, 2)):
            v[gone, k] = np.where(p[:, 0] == q[:, 0], p[:, c], p[:, c] + (q[:, c] - p[:, c]) * t)
    return x, y


def noise(recording: str, frames: np.ndarray, keypoints: int, level: float, seed: int) -> np.ndarray:
    """Noise (rows, keypoints, 2), as :func:`formatting.uniform` draws it in :func:`formatting.segmented`."""
    start, ends = f"{seed}-{recording}-".encode(), [f"-{i}-{c}".encode() for i in range(keypoints) for c in "xy"]
    got = b"".join([md5(f + e).digest()[:4] for f in [b"%s%d" % (start, t) for t in frames.tolist()] for e in ends])
    return ((np.frombuffer(got, ">u4").astype(float) / 2**32 * 2 - 1) * level).reshape(-1, keypoints, 2)


def _moments(x: np.ndarray, y: np.ndarray, anterior: list[int], posterior: list[int]) -> np.ndarray:
    """Number, sums and sums of products of poses as :func:`formatting.aligned` turns them."""
    h = np.arctan2(y[:, posterior].mean(1) - y[:, anterior].mean(1), x[:, posterior].mean(1) - x[:, anterior].mean(1)) + np.pi
    dx, dy, c, s = x - _middle(x, 1)[:, None], y - _middle(y, 1)[:, None], np.cos(h)[:, None], np.sin(h)[:, None]
    v = np.stack([c * dx + s * dy, c * dy - s * dx], -1).reshape(len(x), -1)
    return np.r_[len(v), v.sum(0), (v.T @ v).ravel()]


def _attach(blocks: DataFrame, values: DataFrame) -> DataFrame:
    """``values`` of a recording in all its blocks' rows; joined by (recording, block), so that no recording is one key."""
    places = blocks.select("recording", "block").join(values, "recording")
    return blocks.join(places.hint("shuffle_hash"), ["recording", "block"], "left")


def long_segments(packed: DataFrame, use: list[int], anterior: list[int], posterior: list[int], outliers: float, size: int, lags: int, pseudocount: float, level: float, seed: int) -> tuple[DataFrame, list]:
    """Segments (schema ``_SEGMENT``) of recordings with several blocks, and rows whose ``s`` are their moments.

    Only distances, the first and last reading of each block, and pieces of segments move between blocks.
    """
    k, columns = len(use), "recording string, block int, kp int, v double"

    def flat(rows, value) -> object:
        for b in rows:
            for r in b.to_pylist():
                far = value(r, _far(*(decode(r[q], r["n"], r["width"]) for q in "xy")))
                at = np.flatnonzero(~np.isnan(far.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([r["recording"]] * len(at)), pa.array(np.full(len(at), r["block"], np.int32)), pa.array((at % r["width"]).astype(np.int32)), pa.array(far.ravel()[at])], ["recording", "block", "kp", "v"])

    def listed(r: dict, name: str, width: int) -> np.ndarray:
        out = np.full(width, np.nan)
        for e in r["own"] or []:
            if e["kp"] < width:
                out[e["kp"]] = e[name]
        return out

    def per(values: DataFrame, *names: str) -> DataFrame:
        return values.groupBy("recording").agg(F.collect_list(F.struct("kp", *names)).alias("own"))  # one entry a keypoint

    def blanked(r: dict) -> tuple:
        bound = listed(r, "_med", r["width"]) + outliers * listed(r, "_mad", r["width"])
        return np.frombuffer(r["frames"], np.int32), *blank(*(decode(r[q], r["n"], r["width"]) for q in "xyc"), use, bound)

    def edges(rows):
        for b in rows:
            for r in b.to_pylist():
                f, x, y, _ = blanked(r)
                have = [np.flatnonzero(~np.isnan(x[:, i])) for i in range(k)]
                ends = lambda i: [list(map(float, (f[t], x[t, i], y[t, i]))) for t in (have[i][0], have[i][-1])] if len(have[i]) else [None, None]  # noqa: E731, B023
                both = [ends(i) for i in range(k)]
                yield pa.RecordBatch.from_pydict({"recording": [r["recording"]] * k, "block": pa.array([r["block"]] * k, pa.int32()), "kp": pa.array(range(k), pa.int32()), "f": pa.array([e[0] for e in both], pa.list_(pa.float64())), "l": pa.array([e[1] for e in both], pa.list_(pa.float64()))})

    def pieces(rows):
        for b in rows:
            out = []
            for r in b.to_pylist():
                f, x, y, c = blanked(r)
                near = [np.full((k, 3), np.nan) for _ in range(2)]
                for e in r["ends"] or []:
                    for at, v in zip(near, (e["p"], e["a"])):
                        at[e["kp"]] = v or np.nan
                x, y = fill(f, x, y, *near)
                sums, o, n = _moments(x, y, anterior, posterior), r["o"], len(f)
                y, c = np.stack([x, y], -1) + noise(r["recording"], f, k, level, seed), np.maximum(np.nan_to_num(c), 0.0) + pseudocount
                for g in range(o // size, (o + n - 1) // size + 2):
                    for context, i, j in ((True, g * size - lags, g * size), (False, g * size, g * size + size)):
                        i, j = max(i - o, 0), min(j - o, n)
                        if i < j and g * size < r["total"]:
                            out.append({"recording": r["recording"], "seg": g, "pos": o + i, "skip": (j - i) * context, "n": j - i, "frames": f[i:j].tobytes(), "y": y[i:j].tobytes(), "c": c[i:j].tobytes(), "s": sums.tobytes() if len(sums) else None})
                            sums = sums[:0]
            if out:
                yield pa.RecordBatch.from_pylist(out, _schema(_SEGMENT + ", pos bigint, s binary"))

    def added(rows):
        total = np.zeros(1 + 2 * k + 4 * k * k)
        for b in rows:
            total += sum(np.frombuffer(v) for v in b.column("s").to_pylist())
        yield pa.RecordBatch.from_pydict({"batch": [-1], "n": [0], "s": [total.tobytes()]}, _schema("batch int, n int, s binary"))

    def merge(key, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        rows = [{"recording": key[0], "seg": key[1], "skip": g["skip"].sum(), "n": g["n"].sum(), **{q: b"".join(map(bytes, g[q])) for q in ("frames", "y", "c")}}]
        return pd.DataFrame(rows if g["n"].sum() > lags + 1 else [], columns=[c.split()[0] for c in _SEGMENT.split(", ")])

    by = ["recording", "kp"]
    med = durable(signal.grouped_median(packed.mapInArrow(lambda rows: flat(rows, lambda r, d: d), columns), by, "v", "_med"))
    off = _attach(packed, per(med, "_med")).mapInArrow(lambda rows: flat(rows, lambda r, d: np.abs(d - listed(r, "_med", r["width"]))), columns)
    known = durable(_attach(packed, per(durable(med.join(signal.grouped_median(off, by, "v", "_mad"), by)), "_med", "_mad")))
    ends = known.mapInArrow(edges, "recording string, block int, kp int, f array<double>, l array<double>")
    course = lambda *key, down=False: Window.partitionBy(*key).orderBy(F.desc("block") if down else "block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("recording", "block", "kp", F.last("l", True).over(course(*by)).alias("p"), F.last("f", True).over(course(*by, down=True)).alias("a"))
    place = known.select("recording", "block", F.coalesce(F.sum("n").over(course("recording")), F.lit(0)).alias("o"), F.sum("n").over(Window.partitionBy("recording")).alias("total"))  # a row a block
    ends = ends.groupBy("recording", "block").agg(F.collect_list(F.struct("kp", "p", "a")).alias("ends"))
    cut = durable(known.join(place, ["recording", "block"]).join(ends, ["recording", "block"]).mapInArrow(pieces, _SEGMENT + ", pos bigint, s binary"))
    sums = cut.where("s is not null").select("s").mapInArrow(added, "batch int, n int, s binary").collect()
    lines = durable(cut.drop("s").groupBy("recording", "seg").applyInPandas(merge, _SEGMENT))
    for done in (med, known, cut):
        release(done)
    return lines, sums


# --- batches ---------------------------------------------------------------------------------


@dataclass
class Store:
    """Batches of segments in ``folder``: files y-<batch>, and x-<batch> in a folder for each iteration."""

    spark: SparkSession | None  # none where a task holds it
    folder: str
    batches: list[int]
    keypoints: int
    anterior: list[int]
    posterior: list[int]
    pca: formatting.Pca
    slope: float = -0.5
    intercept: float = 0.25

    def sample(self, p: pose_model.PoseParams, iterations: int, seed: int) -> tuple[pose_model.PoseParams, str | None]:
        return fit(p, self, iterations, seed)


def _batched(lines: DataFrame, key: list[str], held: int, first: int) -> tuple[DataFrame, int]:
    """``lines`` (with ``n`` rows each) in one partition for each batch of about ``held`` rows, and the next free number.

    Lengths are counted (at most a segment's length of them reach the driver); long segments come first.
    """
    count = sorted(((r.n, r["count"]) for r in lines.groupBy("n").count().collect()), reverse=True)
    if not count:
        return lines.withColumn("batch", F.lit(first)), first
    rows = np.array([n * c for n, c in count])
    before, total = np.cumsum(rows) - rows, int(rows.sum())
    number = max(1, round(total / held))
    plan = lines.sparkSession.createDataFrame([(int(n), float(b), float(r)) for (n, _), b, r in zip(count, before, rows)], "_n int, _before double, _rows double")
    at = F.pmod(F.xxhash64(*key), F.lit(2**20)) / 2**20
    batch = F.least(F.floor((F.col("_before") + at * F.col("_rows")) / F.lit(float(total)) * number), F.lit(number - 1)).cast("int")
    out = lines.join(plan, F.col("n") == F.col("_n")).withColumn("batch", batch).drop("_n", "_before", "_rows")
    return out.repartitionById(number, F.col("batch")).withColumn("batch", F.col("batch") + first), first + number


def _write(folder: str, batch: int, parts: list[tuple]) -> int:
    """A batch of (recording, seg, skip, frames, y, conf), longest first; its rows."""
    parts = sorted(parts, key=lambda q: (-len(q[3]), q[0], q[1]))
    if parts:
        level, place = np.unique(np.concatenate([q[5].ravel() for q in parts]), return_inverse=True)
        kind = np.uint16 if len(level) < 2**16 else np.uint32
        _save(folder, f"y-{batch}", recording=np.array([q[0].encode() for q in parts], object).astype("S"), seg=np.array([q[1] for q in parts], np.int64), skip=np.array([q[2] for q in parts], np.int32), size=np.array([len(q[3]) for q in parts]), frames=np.concatenate([q[3] for q in parts]), y=np.concatenate([q[4] for q in parts]), level=level, conf=place.reshape(-1, parts[0][5].shape[1]).astype(kind))
    return sum(len(q[3]) for q in parts)


def build(frames: DataFrame, use: list[int], anterior: list[int], posterior: list[int], outliers: float = 6.0, size: int = 10_000, lags: int = 3, pseudocount: float = 1e-3, level: float = 0.1, seed: int = 42) -> Store:
    """Cleans all frames as :func:`formatting.format_data` and writes them in batches; principal components of the aligned poses.

    Segments with no more rows than lags + 1 count for the components, but are left out of the batches.
    """
    spark, k = frames.sparkSession, len(use)
    folder = _new(f"{shared_folder(spark).rstrip('/')}/poses-{uuid.uuid4().hex}")
    packed = durable(pack(frames))
    per = packed.groupBy("recording").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("rows"))
    many = durable(per.where(F.col("blocks") > 1).select("recording"))
    total = packed.agg(F.sum("n")).first()[0] or 0
    cores = spark.sparkContext.defaultParallelism
    held = max(LEAST, -(-total // (cores * max(2, -(-total // (cores * HELD))))))  # whole rounds of tasks

    def whole(rows):
        parts, sums, batch = [], np.zeros(1 + 2 * k + 4 * k * k), -1
        for b in rows:
            for r in b.to_pylist():
                batch, f, shape = r["batch"], np.frombuffer(r["frames"], np.int32), (r["n"], r["width"])
                x, y, c = blank(*(decode(r[q], *shape) for q in "xyc"), use, None, outliers)
                x, y = fill(f, x, y)
                sums += _moments(x, y, anterior, posterior)
                if len(f) > lags + 1:
                    parts.append((r["recording"], 0, 0, f, np.stack([x, y], -1) + noise(r["recording"], f, k, level, seed), np.maximum(np.nan_to_num(c), 0.0) + pseudocount))
        if batch >= 0:
            yield pa.RecordBatch.from_pydict({"batch": [batch], "n": [_write(folder, batch, parts)], "s": [sums.tobytes()]}, _schema("batch int, n int, s binary"))

    def segments(rows):
        parts, batch = [], -1
        for b in rows:
            for r in b.to_pylist():
                batch = r["batch"]
                parts.append((r["recording"], r["seg"], r["skip"], np.frombuffer(r["frames"], np.int32), np.frombuffer(r["y"]).reshape(-1, k, 2), np.frombuffer(r["c"]).reshape(-1, k)))
        if batch >= 0:
            yield pa.RecordBatch.from_pydict({"batch": [batch], "n": [_write(folder, batch, parts)], "s": [b""]}, _schema("batch int, n int, s binary"))

    ones, free = _batched(packed.join(many, "recording", "left_anti"), ["recording"], held, 0)
    done = ones.mapInArrow(whole, "batch int, n int, s binary").collect() if free else []
    if not many.isEmpty():
        lines, own = long_segments(packed.join(many, "recording", "left_semi"), use, anterior, posterior, outliers, size, lags, pseudocount, level, seed)
        later, _ = _batched(lines, ["recording", "seg"], held, free)
        done = later.mapInArrow(segments, "batch int, n int, s binary").collect() + done + own
        release(lines)
    release(packed)
    moved = sum((np.frombuffer(bytes(r.s)) for r in done if r.s), np.zeros(1 + 2 * k + 4 * k * k))
    count, first, second = int(moved[0]), moved[1 : 1 + 2 * k], moved[1 + 2 * k :].reshape(2 * k, 2 * k)
    return Store(spark, folder, sorted(r.batch for r in done if r.n), k, anterior, posterior, formatting.pca_of(count, first, second))


def start(store: Store, hyper: M.Hyper, dims: int, seed: int = 0) -> pose_model.PoseParams:
    """First parameters, as in :func:`pose_model.start`."""
    return pose_model.PoseParams(M.initial(hyper, dims, seed), np.c_[store.pca.components[:dims].T, store.pca.mean], np.full(store.keypoints, pose_model.SIGMASQ_0))


def iterate(p: pose_model.PoseParams, store: Store, seed: int, it: int, source: str | None, target: str) -> np.ndarray:
    """One pass over all batches from the files in ``source`` (none: first values) to those in ``target``; the sums."""

    own = replace(store, spark=None)

    def work(tasks):
        for b in tasks:
            for i in b["id"]:
                g, rng = _load(own.folder, f"y-{i}"), np.random.default_rng([seed, it, int(i)])
                prior = pose_model.noise_prior(g["level"], own.slope, own.intercept)[g["conf"]]
                old = _load(source, f"x-{i}") if source else dict(zip("xvh", pose_model.first(p, g["y"], own.anterior, own.posterior)))
                (x, v, h, _, z), sums = pose_model.run_pass(p, g["y"], prior, old["x"], old["v"], old["h"], g["size"], rng)
                _save(target, f"x-{i}", x=x, v=v, h=h, z=z.astype(np.uint8 if p.ar.hyper.states <= 256 else np.int32))
                yield pd.DataFrame({"id": [i], "s": [sums.tobytes()]})

    def add(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": [g["id"].min()], "s": [sum(np.frombuffer(bytes(v)) for v in g.sort_values("id")["s"]).tobytes()]})

    parts = _tasks(store).mapInPandas(work, "id bigint, s binary")
    if len(store.batches) > 64:  # at most 8 rows reach the driver
        parts = parts.groupBy(F.pmod("id", F.lit(8))).applyInPandas(add, "id bigint, s binary")
    return sum(np.frombuffer(bytes(r.s)) for r in sorted(parts.collect(), key=lambda r: r.id))


def _tasks(store: Store) -> DataFrame:
    """The numbers of the batches, one a task, the longest segments first."""
    rows = store.spark.sparkContext.parallelize([(i,) for i in store.batches], max(1, len(store.batches)))
    return store.spark.createDataFrame(rows, "id bigint")


def fit(p: pose_model.PoseParams, store: Store, iterations: int = 50, seed: int = 0) -> tuple[pose_model.PoseParams, str | None]:
    """Gibbs sampling of everything as :func:`pose_model.fit`: the last parameters and the folder of the last draws."""
    source = None
    for it in range(iterations if store.batches else 0):
        target = _new(f"{store.folder}/{it}")
        after = pose_model.next_params(p, iterate(p, store, seed, it, source, target), seed, it)
        if after is None:
            _delete(target)
            break
        if source:
            _delete(source)
        p, source = after, target
    return p, source


def extract(p: pose_model.PoseParams, store: Store, source: str | None) -> DataFrame:
    """Results per frame as :func:`pose_model.extract`; first values, in state 0, where sampling has not drawn any."""
    held, lags = replace(store, spark=None), p.ar.hyper.lags

    def lists(a: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32), np.ascontiguousarray(a).ravel())

    def work(tasks):
        for b in tasks:
            for i in b.column("id").to_pylist():
                g = _load(held.folder, f"y-{i}")
                old = _load(source, f"x-{i}") if source else dict(zip("xvh", pose_model.first(p, g["y"], held.anterior, held.posterior))) | {"z": np.zeros(len(g["y"]) - lags * len(g["size"]), np.uint8)}
                size, n = g["size"], len(g["y"])
                t, seg = np.arange(n) - np.repeat(np.cumsum(size) - size, size), np.repeat(np.arange(len(size)), size)
                z = old["z"].astype(np.int32)[np.maximum(t - lags, 0) + np.repeat(np.cumsum(size - lags) - (size - lags), size)]
                own, names = np.flatnonzero(t >= g["skip"][seg]), np.array([q.decode() for q in g["recording"]], object)
                for at in np.split(own, range(10_000, len(own), 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(names[seg[at]], pa.string()), pa.array(g["frames"][at]), pa.array(z[at]), lists(old["x"][at]), lists(old["v"][at]), pa.array(old["h"][at])], ["recording", "frame", "syllable", "latent_state", "centroid", "heading"])

    return _tasks(store).mapInArrow(work, RESULT) if store.batches else store.spark.createDataFrame([], RESULT)
