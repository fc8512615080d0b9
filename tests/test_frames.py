import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lingotide.operators import align as AL
from lingotide.operators import classify as CL
from lingotide.operators import contours as CT
from lingotide.operators import frames as FR
from lingotide.operators import segments as SG
from lingotide.operators import spans as SP


def frame_table(spark, tracks):
    """tracks: utt -> dict of equally long columns."""
    parts = [pd.DataFrame({"utt_id": utt, "frame_idx": range(len(next(iter(c.values())))), **c}) for utt, c in tracks.items()]
    return spark.createDataFrame(pd.concat(parts))


def test_semitone_identities_and_scale_invariance(spark):
    from lingotide.functions.units import semitones

    df = spark.createDataFrame([(100.0,), (200.0,), (50.0,), (0.0,)], "f double")
    assert [round(r.s, 9) for r in df.select(semitones(F.col("f")).alias("s")).collect()] == [0.0, 12.0, -12.0, 0.0]
    f0 = np.linspace(120, 260, 40)
    voicing = np.where(np.arange(40) % 7 == 0, 0.2, 0.9)
    rows = frame_table(spark, {u: {"f0_hz": k * f0, "voicing": voicing} for u, k in ((1, 1.0), (2, 1.7))})
    out = FR.robust_normalize(rows.withColumn("st", semitones(F.col("f0_hz"))), ["utt_id"], "st").toPandas()
    a, b = (g.sort_values("frame_idx")["f0_norm"].to_numpy() for _, g in out.groupby("utt_id"))
    assert np.allclose(a, b) and np.all(a[::7] == 0)


def test_constant_pitch_has_unit_deviation(spark):
    rows = frame_table(spark, {1: {"x": [5.0] * 6, "voicing": [0.9] * 6}})
    assert FR.robust_stats(rows, ["utt_id"], "x").first().mad == 1.0


def test_energy_of_short_and_long_signals(spark):
    rng = np.random.default_rng(1)
    signals = {1: rng.normal(size=1000), 2: rng.normal(size=399), 3: rng.normal(size=400)}
    rows = spark.createDataFrame(
        pd.concat([pd.DataFrame({"utt_id": u, "sample_idx": range(len(x)), "x": x}) for u, x in signals.items()])
    )
    got = {(r.utt_id, r.frame_idx): r.energy for r in FR.frame_energy(rows, "utt_id").collect()}
    want = {(2, 0): 0.0}
    for u in (1, 3):
        x = signals[u]
        want |= {(u, i): float(np.sqrt(np.mean(x[160 * i:160 * i + 400] ** 2))) for i in range(1 + (len(x) - 400) // 160)}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    short = FR.frame_energy(rows.filter("utt_id = 2"), "utt_id", short="rms").first().energy
    assert abs(short - np.sqrt(np.mean(signals[2] ** 2))) < 1e-9


def test_gradients_across_blocks(spark):
    x = np.random.default_rng(2).normal(size=50)
    rows = frame_table(spark, {1: {"v": x}})
    got = FR.gradient(rows, "utt_id", "v", block=7).orderBy("frame_idx").toPandas()
    assert np.allclose(got["gradient"], np.gradient(x)) and np.allclose(got["gradient2"], np.gradient(np.gradient(x)))
    d = FR.delta(rows, "utt_id", "v", block=7).orderBy("frame_idx").toPandas()["delta"]
    assert np.allclose(d, np.diff(x, prepend=x[0]))


def test_voicing_gaps(spark):
    voicing = [0.1, 0.1] + [0.9] * 5 + [0.1] * 4 + [0.9] * 3 + [0.1] + [0.9] * 2 + [0.2] * 3
    rows = frame_table(spark, {1: {"voicing": voicing}, 2: {"voicing": [0.9] * 10}})
    targets = spark.createDataFrame([(1, 3, len(voicing)), (2, 4, 10)], "utt_id long, n_syllables int, n_frames int")
    got = sorted((r.utt_id, r.boundary) for r in SG.voicing_boundaries(rows, targets, "utt_id").collect())
    assert got == [(1, 9), (1, 18), (2, 2), (2, 5), (2, 7)]
    spans = SG.boundary_spans(SG.voicing_boundaries(rows, targets, "utt_id"), targets, "utt_id", 0.7).filter("utt_id = 1")
    assert [(r.start_ms, r.end_ms) for r in spans.orderBy("idx").collect()] == [(0, 90), (90, 180), (180, 200)]


def test_fewer_gaps_than_boundaries(spark):
    rows = frame_table(spark, {1: {"voicing": [0.9] * 4 + [0.1] * 2 + [0.9] * 4}})
    targets = spark.createDataFrame([(1, 5, 10)], "utt_id long, n_syllables int, n_frames int")
    assert [r.boundary for r in SG.voicing_boundaries(rows, targets, "utt_id").collect()] == [5]


def brute_segments(energy, n_samples, n_expected):
    smooth = np.convolve(energy, np.ones(5) / 5, mode="same")
    on = smooth > 0.02 * smooth.max()
    at = np.flatnonzero(on)
    groups = np.split(at, np.flatnonzero(np.diff(at) - 1 >= 10) + 1)
    spans = []
    for g in groups:
        if len(on) - 1 - g[-1] < 10:
            spans.append([g[0] * 160, n_samples])
        elif g[-1] > g[0]:
            spans.append([g[0] * 160, g[-1] * 160 + 400])
    while len(spans) > n_expected and len(spans) > 1:
        k = min(range(len(spans)), key=lambda i: (spans[i][1] - spans[i][0], i))
        k = min(k, len(spans) - 2)
        spans[k:k + 2] = [[spans[k][0], spans[k + 1][1]]]
    return [tuple(map(int, s)) for s in spans]


@pytest.mark.parametrize("n_expected", [1, 2, 4])
def test_silence_segments(spark, n_expected):
    rng = np.random.default_rng(7)
    tracks = {}
    for utt in range(6):
        loud = np.repeat(rng.random(30) < 0.5, rng.integers(1, 25, 30))
        tracks[utt] = {"energy": np.where(loud, rng.uniform(0.5, 1, len(loud)), 0.0)}
    rows = frame_table(spark, tracks)
    sizes = {u: len(c["energy"]) * 160 + 240 for u, c in tracks.items()}
    n_samples = spark.createDataFrame(list(sizes.items()), "utt_id long, n_samples long")
    got = SG.silence_segments(rows, "utt_id", n_samples, n_expected, block=16).toPandas()
    for utt, track in tracks.items():
        mine = got[got["utt_id"] == utt].sort_values("seg_no")
        assert list(zip(mine["start_sample"], mine["end_sample"])) == brute_segments(track["energy"], sizes[utt], n_expected)


def test_contours_match_array_form(spark):
    rng = np.random.default_rng(4)
    n = 120
    f0 = np.where(rng.random(n) < 0.2, 0.0, rng.uniform(100, 300, n))
    voicing = np.where(f0 > 0, 0.9, 0.1)
    rows = frame_table(spark, {1: {"f0_hz": f0, "voicing": voicing}})
    spans = [(1, 0, 0, 300), (1, 1, 300, 320), (1, 2, 320, 5000), (1, 3, 700, 700)]
    got = CT.contours(rows, spark.createDataFrame(spans, "utt_id long, idx int, start_ms int, end_ms int"), "utt_id")
    for r in got.collect():
        _, _, a, b = spans[r.idx]
        v, f = voicing[a // 10:min(n, b // 10)], f0[a // 10:min(n, b // 10)]
        want = np.zeros(20)
        if (v >= 0.5).sum() >= 3:
            st = 12 * np.log2(f[v >= 0.5] / 100)
            mad = np.median(np.abs(st - np.median(st))) or 1.0
            want = np.interp(np.linspace(0, 1, 20), np.linspace(0, 1, len(st)), (st - np.median(st)) / (1.4826 * mad))
        assert np.allclose(r.f0_norm, want) and np.allclose(r.df0, np.gradient(want)) and np.allclose(r.ddf0, np.gradient(np.gradient(want)))
        assert r.duration_ms == b - a
        assert abs(r.voicing_ratio - (np.mean(v >= 0.5) if len(v) else 0.0)) < 1e-9


SHAPES = {
    "flat": (np.full(20, 0.3), 200, 0.9, 1),
    "rising": (np.linspace(-1, 1, 20), 200, 0.9, 2),
    "dipping": (np.abs(np.linspace(-1, 1, 20)), 200, 0.9, 3),
    "falling": (np.linspace(1, -1, 20), 200, 0.9, 4),
    "short": (np.linspace(1, -1, 20), 99, 0.9, 0),
    "unvoiced": (np.linspace(1, -1, 20), 200, 0.39, 0),
    "silent": (np.zeros(20), 200, 0.9, 1),
}


def shape_table(spark):
    rows = [(name, [float(x) for x in y], d, v) for name, (y, d, v, _) in SHAPES.items()]
    return spark.createDataFrame(rows, "name string, f0_norm array<double>, duration_ms int, voicing_ratio double")


def test_rule_classifier_shapes(spark):
    for r in CL.classify_rules(shape_table(spark)).collect():
        assert r.predicted == SHAPES[r.name][3], r
        assert abs(sum(r.probs) - 1) < 1e-9 and r.confidence == max(r.probs)


def test_template_classifier_finds_each_template(spark):
    rows = [(t, y, 200, 0.9) for t, y in CL.TEMPLATES.items()]
    df = spark.createDataFrame(rows, "tone int, f0_norm array<double>, duration_ms int, voicing_ratio double")
    for use_dtw in (False, True):
        for r in CL.classify_templates(df, use_dtw=use_dtw).collect():
            assert r.predicted == r.tone and r.tags == ["strong_match"] and abs(sum(r.probs) - 1) < 1e-9


def test_template_distance_stretches_the_shorter_side(spark):
    short, long = np.linspace(-1, 1, 7), np.sin(np.arange(33) / 5)
    df = spark.createDataFrame([(1, short.tolist()), (2, long.tolist())], "id int, f0_norm array<double>")
    for r in CL.template_distances(df).collect():
        y = short if r.id == 1 else long
        for d, t in zip(r.distances, CL.TEMPLATES.values()):
            n = max(len(y), len(t))
            a, b = (np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(z)), z) for z in (y, t))
            assert abs(d - np.sqrt(np.mean((a - b) ** 2))) < 1e-9


def brute_dtw(a, b):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1, j + 1] = abs(a[i] - b[j]) + min(d[i, j + 1], d[i + 1, j], d[i, j])
    return d[-1, -1]


def test_warping_distances():
    rng = np.random.default_rng(9)
    contours, templates = rng.normal(size=(5, 13)), rng.normal(size=(3, 20))
    got = CL.dtw_distances(contours, templates)
    assert np.allclose(got, [[brute_dtw(c, t) for t in templates] for c in contours])


def test_alignment_of_identical_and_stretched_recordings(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(40, 6))
    same = AL.warp(base, base)
    assert abs(same.cost) < 1e-6 and same.steps == 40 and same.first.tolist() == list(range(40))
    twice = np.repeat(base, 2, axis=0)
    bounds, confidence, warning = AL.align_pair(twice, base, 4, 800, 400)
    assert warning is None and confidence > 0.9 and len(bounds) == 5
    assert all(abs(b - 200 * k) <= 20 for k, b in enumerate(bounds[:4]))


def plain_warp(query, reference):
    """Cost, steps and first matches from the whole table of a pair."""
    n, m = len(query), len(reference)
    width = max(1, int(max(n, m) * AL.BAND))
    u, v = (x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8) for x in (query, reference))
    total, origin = {(0, 0): 0.0}, {}
    for i in range(1, n + 1):
        for j in range(max(1, int(i * m / n) - width), min(m, int(i * m / n) + width) + 1):
            best, _, origin[i, j] = min((total.get(c, np.inf), k, c) for k, c in enumerate([(i - 1, j), (i, j - 1), (i - 1, j - 1)]))
            total[i, j] = best + 1 - u[i - 1] @ v[j - 1]
    if not np.isfinite(total.get((n, m), np.inf)):
        return None
    cell, first, steps = (n, m), {}, 0
    while cell != (0, 0):
        first[cell[1] - 1], steps, cell = cell[0] - 1, steps + 1, origin[cell]
    return total[n, m], steps, [first[j] for j in range(m)]


def test_warping_against_the_whole_table():
    rng = np.random.default_rng(21)
    for trial in range(60):
        n, m = rng.integers(1, 60, 2)
        query, reference = rng.normal(size=(n, 5)), rng.normal(size=(n + trial % 5 if trial % 2 else m, 5))
        got, want = AL.warp(query, reference), plain_warp(query, reference)
        assert (got is None) == (want is None)
        if got is not None:
            assert abs(got.cost - want[0]) < 1e-9 and (got.steps, got.first.tolist()) == want[1:]


def test_warping_holds_a_root_of_the_band():
    rng = np.random.default_rng(22)
    query = rng.normal(size=(3000, 4))
    reference = query[np.sort(rng.integers(0, 3000, 3000))]
    tracemalloc.start()
    got = AL.warp(query, reference)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the band alone would be 5 million cells of 8 bytes
    assert got is not None and len(got.first) == 3000 and (np.diff(got.first) >= 0).all() and peak < 4e6


def test_alignment_falls_back_to_even_spans():
    rng = np.random.default_rng(12)
    bounds, confidence, warning = AL.align_pair(rng.normal(size=(3, 4)), rng.normal(size=(60, 4)), 2, 30, 600)
    assert (bounds, confidence, warning) == ([0, 15, 30], 0.5, "dtw_fallback_to_uniform")


def test_uniform_spans_without_targets(spark):
    utts = spark.createDataFrame([(1, 16001, 3), (2, 800, 0)], "utt_id long, n_samples long, n_syllables int")
    got = SP.uniform_spans(utts, "utt_id").orderBy("utt_id", "idx").collect()
    assert [(r.start_ms, r.end_ms) for r in got[:3]] == [(0, 333), (333, 666), (666, 1000)]
    assert got[3].idx is None and got[3].warning == "no_targets" and got[3].confidence == 1.0


def brute_positions(n_samples, n, regions):
    if not regions:
        return [(i * (n_samples // n), (i + 1) * (n_samples // n)) for i in range(n)]
    step = sum(b - a for a, b in regions) // n
    out = []
    for a, b in regions:
        at = a
        while len(out) < n and at < b:
            out.append((at, min(at + step, b)))
            at += step
    return out + [out[-1] if out else (0, n_samples)] * (n - len(out))


def test_positions_in_regions(spark):
    rng = np.random.default_rng(13)
    utts, regions, want = [], [], {}
    for utt in range(60):
        n, total = int(rng.integers(1, 9)), int(rng.integers(50, 400))
        cuts = sorted(rng.integers(0, total, 2 * int(rng.integers(0, 4))).tolist())
        mine = list(zip(cuts[::2], cuts[1::2]))
        if utt == 3:
            mine, n = [(10, 12)], 8
        if utt == 4:
            mine, n = [(7, 7)], 2
        utts.append((utt, total, n))
        regions += [(utt, k, a, b) for k, (a, b) in enumerate(mine)]
        want[utt] = brute_positions(total, n, mine)
    got = SP.proportional_positions(
        spark.createDataFrame(utts, "utt_id long, n_samples long, n_syllables int"),
        "utt_id",
        spark.createDataFrame(regions, "utt_id long, region_no int, start long, end long"),
    ).toPandas()
    for utt, positions in want.items():
        mine = got[got["utt_id"] == utt].sort_values("idx")
        assert list(mine["idx"]) == list(range(len(positions)))
        assert list(zip(mine["start_sample"], mine["end_sample"])) == positions, utt
