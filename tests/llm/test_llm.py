import itertools
import random
from collections import Counter

import numpy as np
import pytest
from fixtures import T0, T1, clash, frames, index, info, results
from oracle import difference
from pyspark.sql import functions as F

from gaitloom.llm import queries
from gaitloom.llm.mixing import mix, mix_shares
from gaitloom.llm.packing import pack, plan
from gaitloom.llm.patterns import frequent_patterns
from gaitloom.llm.percentiles import merge, percentiles, summarize
from gaitloom.llm.runs import collapse_runs
from gaitloom.llm.split import cuts, split_recordings
from gaitloom.llm.tokens import encoding, VOCABULARY
from gaitloom.llm.truncated import ended, tail, truncated, truncation_rates

LIMITS = "profile string, max_frames int, overlap_frames int, min_frames int"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(name, spark, sf, duck):
    assert difference(queries.QUERIES[name](spark, sf), queries.ORACLE[name], duck) == ""


# --- splitting -------------------------------------------------------------------------------


def pieces(spark, frame_numbers, limits, hidden=()):
    rows = [("a", f, None if f in hidden else [[1.0, 2.0]], [1.0]) for f in frame_numbers]
    return [r for r in split_recordings(clash(frames(spark, rows)), spark.createDataFrame(limits, LIMITS)).orderBy("profile", "piece").collect()]


def check_pieces(got, frame_numbers, most, overlap, least):
    order = sorted(set(frame_numbers))
    place = {f: i for i, f in enumerate(order)}
    assert got[0].first_frame == order[0] and got[-1].last_frame == order[-1]
    for p in got:
        n = place[p.last_frame] - place[p.first_frame] + 1
        assert n == p.n_frames and least <= n <= most
    for a, b in zip(got, got[1:]):
        assert place[a.last_frame] - place[b.first_frame] + 1 == overlap


def test_split_cuts_at_pauses(spark):
    fs = [*range(0, 90), *range(100, 190), *range(200, 250)]
    got = pieces(spark, fs, [("p", 100, 0, 4)])
    assert [(p.first_frame, p.last_frame) for p in got] == [(0, 89), (100, 189), (200, 249)] and all(p.natural_start and p.natural_end for p in got)


def test_split_out_of_sight_is_a_pause(spark):
    got = pieces(spark, range(150), [("p", 100, 0, 4)], hidden=range(80, 90))
    assert any(p.last_frame in (79, 89) for p in got) and all(p.natural_end for p in got)


@pytest.mark.parametrize("seed", range(3))
def test_split_invariants(spark, seed):
    rng = random.Random(seed)
    fs, f = [], rng.randrange(50)
    while len(fs) < 9000:
        fs += range(f, f + rng.randrange(1, 400))
        f = fs[-1] + rng.choice([2, 3, 20])
    got = pieces(spark, fs, [("p", 60, 8, 4), ("q", 10_000, 8, 4)])
    assert {p.profile for p in got} <= ({"p"} if len(fs) <= 10_000 else {"p", "q"})
    check_pieces([p for p in got if p.profile == "p"], fs, 60, 8, 4)


def test_split_dense_optimum():
    rng = np.random.default_rng(0)
    n = rng.integers(5, 40, 12)
    f0 = np.cumsum(n + 3) - n
    frame, got = cuts(np.cumsum(n) - n, n, f0, np.ones(12, bool), 50, 5, 6)
    assert got[0][0] == 0 and got[-1][1] == len(frame) - 1
    assert all(b[0] == a[1] - 4 for a, b in zip(got, got[1:])) and all(6 <= e - s + 1 <= 50 for s, e, _, _ in got)


def test_split_nothing_to_do(spark):
    assert pieces(spark, range(10), [("p", 100, 0, 4)]) == []
    assert pieces(spark, [], [("p", 100, 0, 4)]) == []
    assert pieces(spark, range(10), [(None, 5, 0, 1), ("x", None, 0, 1)]) == []


# --- patterns --------------------------------------------------------------------------------


def brute_patterns(seqs, total, least, share):
    n = Counter()
    for s in seqs:
        found = set()
        for i, j, k, m in itertools.product(range(len(s)), range(1, 4), range(1, 4), range(1, 4)):
            if i + j + k + m < len(s):
                p = (s[i], s[i + j], s[i + j + k], s[i + j + k + m])
                if len(set(p)) == 4:
                    found.add(p)
        n.update(found)
    return {p: c for p, c in n.items() if c >= least and c >= share * total}


def test_patterns_by_brute_force(spark):
    rng = random.Random(2)
    rows, seqs = [], []
    for r in range(12):
        f, seq = 0, []
        for _ in range(30):
            s = rng.choice([0, 1, 2, 3, 4, None])
            for _ in range(rng.choice([1, 2, 3000])):
                rows.append((f"r{r}", f, s))
                f += 1
            if s is not None and (not seq or seq[-1] != s):
                seq.append(s)
        seqs.append(seq)
    rows += [("empty", 0, None), (None, 1, 2), ("r0", None, 1)]
    got = {(r.s1, r.s2, r.s3, r.s4): r.support for r in frequent_patterns(clash(results(spark, rows))).collect()}
    assert got == brute_patterns(seqs, 13, 3, 0.1) and got


def test_patterns_of_nothing(spark):
    assert frequent_patterns(results(spark, [])).count() == 0


# --- runs ------------------------------------------------------------------------------------


def brute_runs(rows):
    by = {}
    for rec, f, b in rows:
        by.setdefault((rec, b), []).append(f)
    runs = []
    for (rec, b), fs in by.items():
        fs = sorted(fs)
        cur = [fs[0]]
        for f in fs[1:]:
            if f - cur[-1] > 3:
                runs.append((rec, cur[0], cur[-1], len(cur)))
                cur = []
            cur.append(f)
        runs.append((rec, cur[0], cur[-1], len(cur)))
    return sorted(r for r in runs if not any(o[0] == r[0] and o[1] < r[1] and o[2] > r[2] for o in runs))


def test_runs_by_brute_force_over_block_borders(spark):
    rng = random.Random(5)
    rows = [(rec, f, rng.choice([0, 0, 1, 2, 3, 4, None])) for rec in "ab" for f in range(4000, 8400) if rng.random() < 0.9]
    rows += [("c", f, 0) for f in range(0, 9000)] + [("c", 4096, 2)]
    rows = [r for r in rows if r != ("c", 4096, 0)]
    name = {0: "walkslow", 1: "walkslow"}
    want = brute_runs([(r, f, name.get(s, f"#{s}")) for r, f, s in rows if s is not None])
    late = [("a", 4000, 3, T1)]
    df = clash(results(spark, [*rows, *rows[:50], (None, 1, 1), ("a", None, 1)]))
    got = sorted((r.recording, r.first_frame, r.last_frame, r.n_rows) for r in collapse_runs(df, info(spark)).collect())
    assert got == want
    fixed = collapse_runs(results(spark, [("a", 4000, 0, T0), *late]), info(spark)).collect()
    assert [(r.behaviour, r.duration) for r in fixed] == [("#3", 1)]


def test_runs_of_nothing(spark):
    assert collapse_runs(results(spark, []), info(spark)).count() == 0
    assert collapse_runs(results(spark, [("a", 0, None)]), info(spark, [])).count() == 0


# --- percentiles -----------------------------------------------------------------------------


def test_percentiles_within_error_and_mergeable(spark):
    rng = np.random.default_rng(0)
    v = np.r_[rng.lognormal(0, 3, 4000), -rng.lognormal(0, 3, 1000), np.zeros(50)]
    g = np.array(["x", None, "y"], object)[rng.integers(0, 3, len(v))]
    rows = [(k, float(x)) for k, x in zip(g, v)] + [("x", None), ("x", float("nan"))]
    df = clash(spark.createDataFrame(rows, "g string, v double"))
    parts = [summarize(d, ["g"], "v", 0.01) for d in df.randomSplit([0.5, 0.3, 0.2], 1)]
    probs = [0.05, 0.5, 0.95]
    got = {r.g: r for r in percentiles(merge(parts, ["g"]), ["g"], probs, 0.01).collect()}
    exact = {r.g: r for r in percentiles(summarize(df, ["g"], "v"), ["g"], probs).collect()}
    for k in ("x", None, "y"):
        s = np.sort(v[[a == k for a in g]])
        for p in probs:
            t = s[max(int(np.ceil(p * len(s) - 1e-9)), 1) - 1]
            c = f"p{round(p * 100):02d}"
            assert exact[k][c] == t and abs(got[k][c] - t) <= 0.01 * abs(t) + 1e-9
        assert got[k].n == len(s)


def test_percentiles_of_nothing(spark):
    assert percentiles(summarize(spark.createDataFrame([], "g string, v double"), ["g"], "v"), ["g"], [0.5]).count() == 0


# --- packing ---------------------------------------------------------------------------------

DOCS = "doc_id bigint, text string, lang string, source string, title string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS)


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_a_packing(seed):
    rng = random.Random(seed)
    cap = rng.choice([7, 64, 1000])
    counts = dict(Counter(rng.randint(1, cap) for _ in range(rng.choice([1, 50, 5000]))))
    segments, opened = plan(counts, cap)
    fill, placed, slots = Counter(), Counter(), set()
    for size, _, items, first, each, position in segments:
        placed[size] += items
        for i in range(items):
            fill[first + i // each] += size
            slots.add((first + i // each, position + i % each))
    assert placed == counts and max(fill.values()) <= cap and set(fill) == set(range(opened)) and len(slots) == sum(counts.values())
    assert opened <= 11 / 9 * max(sum(s * n for s, n in counts.items()) / cap, sum(n for s, n in counts.items() if 2 * s > cap)) + 1


def test_pack(spark):
    rng = random.Random(1)
    words = "the cage is quiet and the picture stays sharp at night".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 20, 60, 400]))), "s") for i in range(300)]
    rows += [(900, "", "s"), (901, None, "s"), (902, "long text without end " * 2000, None), (None, "x", "s"), (5, rows[5][1], "s")]
    lim = spark.createDataFrame([("a", 64), ("b", 1000), (None, 5), ("z", 0)], "profile string, capacity_tokens int")
    got = pack(clash(docs(spark, rows)), lim).collect()
    enc = encoding(VOCABULARY)
    size = {i: len(enc.encode_ordinary(t or "")) for i, t, _ in rows if i is not None}
    for name, cap in (("a", 64), ("b", 1000)):
        mine = [r for r in got if r.profile == name]
        fill, at = Counter(), Counter()
        for r in mine:
            fill[r.container] += r.tokens
            at[r.container, r.position] += 1
        assert max(fill.values()) <= cap and set(at.values()) == {1} and all(fill[r.container] == r.fill for r in mine)
        tokens, count = Counter(), Counter((r.doc_id, r.piece) for r in mine)
        for r in mine:
            tokens[r.doc_id] += r.tokens
        assert tokens == Counter({i: n * (2 if i == 5 else 1) for i, n in size.items() if n}) and count[5, 0] == 2
        assert all(r.piece == 0 for r in mine if size[r.doc_id] <= cap) and {900, 901} <= {r.doc_id for r in mine}
        assert sum(fill.values()) / cap / (max(fill) + 1) > 0.9


def test_pack_nothing(spark):
    lim = spark.createDataFrame([("a", 64)], "profile string, capacity_tokens int")
    assert pack(docs(spark, []), lim).count() == 0
    assert pack(docs(spark, [(1, "a", "s")]), lim.limit(0)).count() == 0


# --- mixing ----------------------------------------------------------------------------------

TARGETS = "source string, target_share double, max_repeats int"


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, "quiet cage " * rng.randint(1, 40), "big") for i in range(900)] + [(1000 + i, "sharp picture " * rng.randint(1, 40), "mid") for i in range(100)]
    rows += [(2000 + i, "short", "tiny") for i in range(3)] + [(3000, "no source", None), (3001, "other", "unnamed"), (3002, None, "mid"), (None, "x", "big")]
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 4), ("tiny", 0.1, 3), ("gone", 0.1, 2), (None, 0.5, 1)], TARGETS)
    df = clash(docs(spark, rows))
    got = mix(df, t, total_tokens=40_000).collect()
    assert len({r.doc_id for r in got}) == len(got) and {r.source for r in got} == {"big", "mid", "tiny"}
    cap = {"big": 1, "mid": 4, "tiny": 3}
    assert all(1 <= r.uses <= cap[r.source] for r in got)
    size = Counter()
    for r in got:
        size[r.source] += r.n_tokens * r.uses
    have = Counter()
    enc = encoding(VOCABULARY)
    for i, x, s in rows:
        if i is not None and s:
            have[s] += len(enc.encode_ordinary(x or ""))
    for s, share in (("big", 0.5), ("mid", 0.3)):
        want = min(share * 40_000, have[s] * cap[s])
        assert abs(size[s] - want) < 0.03 * want
    assert all(r.uses == 3 for r in got if r.source == "tiny")
    shares = {r.source: r for r in mix_shares(df, t, total_tokens=40_000).collect()}
    assert shares["gone"].tokens == 0 and abs(sum(r.actual_share for r in shares.values()) - 1) < 1e-9
    assert {s: shares[s].tokens for s in size} == dict(size)
    assert [r.doc_id for r in got] and mix(docs(spark, []), t).count() == 0


# --- truncation ------------------------------------------------------------------------------


def test_tails():
    assert tail("The picture stays… show all")[2] and tail("was scratched [more]")[2] and tail("matters only for Read more")[2]
    assert tail("half a char �")[1] and tail("it took me&#3")[1] and tail("is sharp &qu")[1] and tail("fine.</p")[1]
    assert not any(tail("Works well.</p>")[1:]) and not tail("fish & chips")[1]
    assert ended("Done.") and ended('He said "done."') and ended("good 👍") and ended("終わり。") and not ended("and then") and not ended("one,")


def test_truncated(spark):
    rng = random.Random(7)
    things, words = ["camera", "housing", "picture", "manual", "cable"], ["quiet", "sharp", "reliable", "excellent"]

    def sentence():
        return f"The {rng.choice(things)} is {rng.choice(words)} and we use it every {rng.choice(['day', 'week'])}."

    rows = [(i, " ".join(sentence() for _ in range(rng.randint(2, 5))), "ok") for i in range(300)]
    full = " ".join(sentence() for _ in range(8))
    cut = {1000: full[: full.index("camera") + 3] if "camera" in full else full[:6], 1001: full[: full.rindex(" and ") + 7], 1002: "The picture is sharp and we use it �", 1003: "The manual is qui", 1004: "The cable is sharp and we use it [more]"}
    fine = {2000: "The cable is sharp and we use it every day", 2001: "Great for our lab", 2002: "", 2003: None, 2004: "The cable is quiet and we use it every week. So, well...", 2005: "The cable is sharp."}
    all_ = rows + [(i, t, "cut") for i, t in cut.items()] + [(i, t, None) for i, t in fine.items()] + [(None, "The cab", "cut")]
    df = docs(spark, all_).withColumn("title", F.when(F.col("doc_id") < 5, "Great for our lab"))
    got = {r.doc_id for r in truncated(clash(df)).collect()}
    assert set(cut) <= got | {1000}, set(cut) - got
    assert not got & set(fine), got & set(fine)
    assert len([i for i in got if i < 1000]) == 0
    rates = {r.source: r for r in truncation_rates(df).collect()}
    assert rates["cut"].cut >= 4 and rates["ok"].cut == 0 and rates[None].documents == 4


def test_truncated_nothing(spark):
    assert truncated(docs(spark, [])).count() == 0 and truncated(docs(spark, [(1, None, None), (2, "  ", "s")])).count() == 0


def test_group_names(spark):
    from gaitloom.llm.percentiles import duration_summary

    r = results(spark, [("a", f, 5) for f in range(10)] + [("b", f, 5) for f in range(4)])
    got = {(x.group_name, x.bin, x.n) for x in duration_summary(r, info(spark), index(spark, [("A.csv ", "Dose Low", None, None, None)])).collect()}
    assert got == {("dose_low", 10.0, 1), ("(none)", 4.0, 1)}


def test_limit_without_texts_just_below_and_copies_are_no_limit(spark):
    from gaitloom.llm.truncated import limits_of

    rows = [("web", f"{i:04d}".ljust(1000, "x")) for i in range(10)] + [("web", "a template".ljust(500, "y"))] * 10 + [("web", f"{i} short".ljust(470 + i, "z")) for i in range(6)]
    got = limits_of(spark.createDataFrame(rows, "source string, text string")).collect()
    assert {tuple(r) for r in got} == {("web", "chars", 1000), ("web", "bytes", 1000)}
