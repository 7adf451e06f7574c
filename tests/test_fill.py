import math

from fixtures import T0, T1, clash, frames, index, rigs

from gaitloom.operators.fill import fill_cells, fill_missing

P = [10.0, 20.0]


def cells(df):
    return {(r.recording, r.frame, r.kp, r.field): r for r in df.collect()}


def test_nearest_donor_and_marks(spark):
    rows = [
        ("a", 0, [P, [1.0, 2.0]], [0.5, 0.5]),
        ("a", 1, [None, [1.5, 2.5]], [None, 0.6]),
        ("a", 2, [[None, 3.0], None], [float("nan"), 0.7]),
        ("a", 4, None, None),
        ("a", 5, [[30.0, 40.25], [3.0, 4.0]], [0.9, 0.8]),
        ("a", 5, [[99.0, 99.0], [9.0, 9.0]], [0.1, 0.1], None),
    ]
    df = clash(frames(spark, rows))
    got = cells(fill_cells(df, index(spark), rigs(spark), 2))
    assert set(got) == {("a", 1, 0, "pose"), ("a", 1, 0, "conf"), ("a", 2, 0, "pose"), ("a", 2, 1, "pose"), ("a", 2, 0, "conf"), *[("a", 4, k, f) for k in (0, 1) for f in ("pose", "conf")]}
    r = got["a", 1, 0, "pose"]
    assert (r.x, r.y, r.method, r.distance, r.donor_frame) == (10.0, 20.0, "time", 1, 0)
    assert got["a", 4, 0, "pose"].x == 30.0 and got["a", 4, 0, "pose"].distance == 1
    assert got["a", 2, 0, "conf"].x == 0.5 and got["a", 2, 0, "conf"].distance == 2
    whole = {r.frame: r for r in fill_missing(df, index(spark), rigs(spark), 2).collect()}
    assert whole[0].pose == [P, [1.0, 2.0]] and whole[0].pose_filled == []
    assert whole[4].pose == [[30.0, 40.25], [3.0, 4.0]] and [m.kp for m in whole[4].pose_filled] == [0, 1]


def test_ties_take_the_earlier_and_blocks_are_no_border(spark):
    rows = [("a", 4094, [P], [0.5]), ("a", 4095, [None], [0.5]), ("a", 4096, [None], [0.5]), ("a", 4097, [None], [0.5]), ("a", 4098, [[5.0, 6.0]], [0.5])]
    got = cells(fill_cells(frames(spark, rows), index(spark), rigs(spark), 1))
    assert [got["a", f, 0, "pose"].donor_frame for f in (4095, 4096, 4097)] == [4094, 4094, 4098]


def test_values_of_any_precision_are_kept(spark):
    x = 1 / 3
    rows = [("a", 0, [[x, math.pi]], [x]), ("a", 1, [None], [None])]
    r = cells(fill_cells(frames(spark, rows), index(spark), rigs(spark), 1))["a", 1, 0, "pose"]
    assert (r.x, r.y) == (x, math.pi)
    assert fill_missing(frames(spark, rows), index(spark), rigs(spark), 1).where("frame = 0").first().pose == [[x, math.pi]]


def test_donor_of_a_comparable_recording(spark):
    rows = [("r1", 0, [P], [0.5]), ("r2", 0, [None], [0.5]), ("r2", 1, None, [0.5]), ("r3", 0, [[7.0, 8.0]], [0.5])]
    idx = index(spark, [("R1.csv ", "g", "floor_a", None, T0), ("r2", "g", "floor_a", None, T0), ("r3", "g", "floor_a", None, T1)])
    got = cells(fill_cells(frames(spark, rows), idx, rigs(spark), 1))
    r = got["r2", 1, 0, "pose"]
    assert (r.method, r.distance, r.donor_recording, r.x) == ("day", 0, "r1", 10.0)


def test_rig_placeholder_is_missing(spark):
    rows = [(f"m_floor_a_{i}", f, [[0.0, 0.0] if f == 1 else [10.0 + f, 0.5 * f + 3.25]], [0.5]) for i in range(4) for f in range(8)]
    got = fill_cells(frames(spark, rows), index(spark), rigs(spark), 1).collect()
    assert {(r.frame, r.field) for r in got} == {(1, "pose")} and len(got) == 4


def test_nothing_known_and_nothing_there(spark):
    got = cells(fill_cells(frames(spark, [("a", 0, None, None), (None, 1, None, None), ("a", None, None, None)]), index(spark), rigs(spark), 1))
    assert {r.method for r in got.values()} == {"none"} and len(got) == 2
    assert fill_cells(frames(spark, []), index(spark), rigs(spark), 1).count() == 0
    assert fill_missing(frames(spark, []), index(spark), rigs(spark), 1).count() == 0
