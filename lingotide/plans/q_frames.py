"""Frame, segment, contour, classification, span and grading queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingotide.functions import units as U
from lingotide.operators import align as AL
from lingotide.operators import classify as CL
from lingotide.operators import contours as CT
from lingotide.operators import frames as FR
from lingotide.operators import segments as SG
from lingotide.operators import spans as SP
from lingotide.plans import grading as G
from lingotide.plans.q_metrics import SCORES_SQL
from lingotide.plans.registry import query
from lingotide.plans.views import WORD_CLASSES, Views, word_case


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


ST_SQL = "CASE WHEN f0_hz > 0 THEN 12 * log2(f0_hz / 100) ELSE 0.0E0 END"


@query("mth1_semitones", f"SELECT utt_id, frame_idx, round({ST_SQL}, 6) AS semitones FROM frames")
def mth1(v: Views):
    return v.frames.select("utt_id", "frame_idx", F.round(U.semitones(F.col("f0_hz")), 6).alias("semitones"))


@query(
    "mth2_units",
    """
SELECT utt_id, CAST(floor(n_samples / 16000.0E0 * 1000) AS INT) AS ms, CAST(floor(floor(n_samples / 16000.0E0 * 1000) * 100.0E0 / 1000) AS INT) AS ms_frame,
  CAST(floor(floor(n_samples / 16000.0E0 * 1000) * 16000.0E0 / 1000) AS BIGINT) AS back_samples, n_samples // 160 AS frame,
  CASE WHEN n_samples < 400 THEN 1 ELSE 1 + (n_samples - 400) // 160 END AS n_frames FROM utterances""",
)
def mth2(v: Views):
    n = F.col("n_samples")
    ms = U.samples_to_ms(n)
    return v.utterances.select(
        "utt_id", ms.alias("ms"), U.ms_to_frame(ms).alias("ms_frame"), U.ms_to_samples(ms).alias("back_samples"),
        U.samples_to_frame(n).alias("frame"), U.frames_for_samples(n).alias("n_frames"),
    )


@query(
    "mth3_robust_normalize",
    f"""
WITH s AS (SELECT *, {ST_SQL} AS st FROM frames),
m AS (SELECT utt_id, median(st) AS med FROM s WHERE voicing >= 0.5 GROUP BY 1),
d AS (SELECT utt_id, median(abs(st - med)) AS mad FROM s JOIN m USING (utt_id) WHERE voicing >= 0.5 GROUP BY 1)
SELECT utt_id, frame_idx, round(CASE WHEN voicing >= 0.5 THEN (st - med) / (1.4826E0 * CASE WHEN mad = 0 THEN 1 ELSE mad END) ELSE 0 END, 6) AS f0_norm
FROM s LEFT JOIN m USING (utt_id) LEFT JOIN d USING (utt_id)""",
)
def mth3(v: Views):
    st = v.frame_table.withColumn("st", U.semitones(F.col("f0_hz")))
    return _r(FR.robust_normalize(st, ["utt_id"], "st").select("utt_id", "frame_idx", "f0_norm"), "f0_norm")


@query(
    "mth4_normalize_f0",
    """
WITH g AS (SELECT utt_id, avg(ln(f0_hz + 1e-8)) AS a, stddev_pop(ln(f0_hz + 1e-8)) + 1e-8 AS b, median(f0_hz) AS med, min(f0_hz) AS lo, max(f0_hz) AS hi
  FROM frames WHERE f0_hz > 0 GROUP BY 1)
SELECT utt_id, frame_idx, round(CASE WHEN f0_hz > 0 THEN (ln(f0_hz + 1e-8) - a) / b ELSE 0 END, 6) AS log_zscore,
  round(CASE WHEN f0_hz > 0 THEN 12 * log2(f0_hz / med + 1e-8) ELSE 0 END, 6) AS semitone,
  round(CASE WHEN f0_hz > 0 THEN CASE WHEN hi > lo THEN (f0_hz - lo) / (hi - lo) ELSE 0.5E0 END ELSE 0 END, 6) AS minmax
FROM frames LEFT JOIN g USING (utt_id)""",
)
def mth4(v: Views):
    out = v.frame_table.select("utt_id", "frame_idx", "f0_hz")
    for method in ("log_zscore", "semitone", "minmax"):
        out = FR.normalize_f0(out, ["utt_id"], method, name=method)
    return _r(out.drop("f0_hz"), "log_zscore", "semitone", "minmax")


@query(
    "win18_delta",
    "SELECT utt_id, frame_idx, round(coalesce(f0_hz - lag(f0_hz) OVER (PARTITION BY utt_id ORDER BY frame_idx), 0), 6) AS delta FROM frames",
)
def win18(v: Views):
    return _r(FR.delta(v.frames.select("utt_id", "frame_idx", "f0_hz"), "utt_id", "f0_hz").drop("f0_hz"), "delta")


def gradient_sql(value: str, table: str, keys: str, pos: str, name: str) -> str:
    return f"""(SELECT *, CASE WHEN lag({value}) OVER w IS NULL AND lead({value}) OVER w IS NULL THEN 0.0E0 WHEN lag({value}) OVER w IS NULL THEN lead({value}) OVER w - {value}
  WHEN lead({value}) OVER w IS NULL THEN {value} - lag({value}) OVER w ELSE (lead({value}) OVER w - lag({value}) OVER w) / 2 END AS {name}
  FROM {table} WINDOW w AS (PARTITION BY {keys} ORDER BY {pos}))"""


@query(
    "win18_gradient",
    f"""WITH g1 AS {gradient_sql('f0_hz', 'frames', 'utt_id', 'frame_idx', 'gradient')}, g2 AS {gradient_sql('gradient', 'g1', 'utt_id', 'frame_idx', 'gradient2')}
SELECT utt_id, frame_idx, round(gradient, 6) AS gradient, round(gradient2, 6) AS gradient2 FROM g2""",
)
def win18_gradient(v: Views):
    out = FR.gradient(v.frames.select("utt_id", "frame_idx", "f0_hz"), "utt_id", "f0_hz").drop("f0_hz")
    return _r(out, "gradient", "gradient2")


RUNS_SQL = """
gaps AS (SELECT utt_id, min(frame_idx) AS a, count(*) AS len FROM (
  SELECT utt_id, frame_idx, frame_idx - row_number() OVER (PARTITION BY utt_id ORDER BY frame_idx) AS grp FROM frames WHERE voicing < 0.5) GROUP BY utt_id, grp HAVING count(*) >= 2),
bounds AS (
  SELECT utt_id, CAST(a + len // 2 AS INT) AS boundary FROM gaps JOIN frame_targets USING (utt_id)
    QUALIFY row_number() OVER (PARTITION BY utt_id ORDER BY len DESC, a) <= n_syllables - 1
  UNION ALL
  SELECT utt_id, CAST(n_frames * unnest(range(1, n_syllables)) // n_syllables AS INT) FROM frame_targets WHERE utt_id NOT IN (SELECT utt_id FROM gaps))"""


@query("win14_voicing_boundaries", f"WITH {RUNS_SQL} SELECT utt_id, boundary FROM bounds")
def win14(v: Views):
    return SG.voicing_boundaries(v.frame_table, v.frame_targets, "utt_id")


@query(
    "win14_voicing_spans",
    f"""WITH {RUNS_SQL}, ends AS (SELECT utt_id, boundary FROM bounds UNION ALL SELECT utt_id, n_frames FROM frame_targets)
SELECT utt_id, row_number() OVER w - 1 AS idx, coalesce(lag(boundary) OVER w, 0) * 10 AS start_ms, boundary * 10 AS end_ms, 0.7E0 AS confidence
FROM ends WINDOW w AS (PARTITION BY utt_id ORDER BY boundary)""",
)
def win14_spans(v: Views):
    return SG.boundary_spans(SG.voicing_boundaries(v.frame_table, v.frame_targets, "utt_id"), v.frame_targets, "utt_id", 0.7)


@query(
    "win15_energy_boundaries",
    """
WITH sm AS (SELECT utt_id, frame_idx, list_sort([coalesce(lag(energy) OVER w, energy), energy, coalesce(lead(energy) OVER w, energy)])[2] AS e
  FROM frames WINDOW w AS (PARTITION BY utt_id ORDER BY frame_idx)),
b AS (SELECT utt_id, n_frames, n_syllables, unnest(range(0, n_syllables - 1)) AS i FROM frame_targets),
x AS (SELECT *, n_frames * (i + 1) // n_syllables AS ex, greatest(3, n_frames // n_syllables // 3) AS r FROM b)
SELECT x.utt_id, CAST(i AS INT) AS boundary_no, CAST(coalesce(arg_min(frame_idx, (e, frame_idx)), ex) AS INT) AS boundary
FROM x LEFT JOIN sm ON sm.utt_id = x.utt_id AND frame_idx >= greatest(5, ex - r) AND frame_idx < least(n_frames - 5, ex + r) GROUP BY x.utt_id, i, ex""",
)
def win15(v: Views):
    return SG.energy_boundaries(v.frame_table, v.frame_targets, "utt_id")


@query(
    "win16_speech_region",
    """
WITH t AS (SELECT utt_id, max(energy) AS top, max(frame_idx) + 1 AS n FROM frames GROUP BY 1)
SELECT utt_id, CAST(coalesce(min(frame_idx) FILTER (20 * log10(energy / top + 1e-10) > -40) * 10, 0) AS INT) AS start_ms,
  CAST(coalesce((max(frame_idx) FILTER (20 * log10(energy / top + 1e-10) > -40) + 1) * 10, max(n) * 10) AS INT) AS end_ms
FROM frames JOIN t USING (utt_id) GROUP BY 1""",
)
def win16(v: Views):
    return SG.speech_region(v.frame_table, "utt_id")


@query(
    "win16_sample_region",
    """
WITH w AS (SELECT utt_id, sample_idx // 160 AS w, sqrt(avg(x * x)) AS rms, count(*) AS n FROM signal GROUP BY 1, 2),
t AS (SELECT utt_id, max(abs(x)) AS top, count(*) AS total FROM signal GROUP BY 1),
l AS (SELECT utt_id, min(w) AS a, max(w) AS b FROM w JOIN t USING (utt_id) WHERE n = 160 AND rms > CASE WHEN top > 0 THEN 0.02E0 * top ELSE 0.02E0 END GROUP BY 1)
SELECT utt_id, CAST(coalesce(greatest(0, (a - 1) * 160), 0) AS BIGINT) AS start_sample, coalesce(least(total, (b + 2) * 160), total) AS end_sample FROM t LEFT JOIN l USING (utt_id)""",
)
def win16_samples(v: Views):
    return SG.sample_region(v.signal_table, "utt_id")


# energies of the segment queries: quiet unless an event value is high, so that silences occur
QUIET = "CASE WHEN frame_idx % 29 < 13 THEN energy ELSE energy / 1000 END"


def _bursts(v: Views):
    return v.frame_table.select("utt_id", "frame_idx", F.expr(QUIET).alias("energy"))


def _lengths(v: Views):
    return v.frame_targets.select("utt_id", (F.col("n_frames") * U.HOP + 240).alias("n_samples"))


DETECT_SQL = f"""q AS (SELECT utt_id, frame_idx, {QUIET} AS energy FROM frames),
s AS (SELECT utt_id, frame_idx, sum(energy) OVER (PARTITION BY utt_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS e FROM q),
t AS (SELECT utt_id, max(e) AS top, max(frame_idx) + 1 AS n FROM s GROUP BY 1),
a AS (SELECT utt_id, frame_idx, frame_idx - lag(frame_idx) OVER (PARTITION BY utt_id ORDER BY frame_idx) AS jump FROM s JOIN t USING (utt_id) WHERE e > 0.02E0 * top),
g AS (SELECT *, sum(CASE WHEN jump - 1 < 10 THEN 0 ELSE 1 END) OVER (PARTITION BY utt_id ORDER BY frame_idx) AS seg_no FROM a),
m AS (SELECT utt_id, seg_no, min(frame_idx) AS a, max(frame_idx) AS b FROM g GROUP BY 1, 2),
found AS (SELECT utt_id, CAST(seg_no AS BIGINT) AS seg_no, CAST(a * 160 AS BIGINT) AS start_sample, CAST(CASE WHEN n - 1 - b < 10 THEN n * 160 + 240 ELSE b * 160 + 400 END AS BIGINT) AS end_sample
FROM m JOIN t USING (utt_id) WHERE n - 1 - b < 10 OR b > a)"""


@query("win17_detect_segments", f"WITH {DETECT_SQL} SELECT * FROM found")
def win17_detect(v: Views):
    return SG.detect_segments(_bursts(v), "utt_id", _lengths(v))


@query(
    "win17_silence_segments",
    f"""
WITH RECURSIVE {DETECT_SQL},
lists AS (SELECT utt_id, 1 + utt_id % 3 AS wanted, list({{'a': start_sample, 'b': end_sample}} ORDER BY start_sample) AS s FROM found GROUP BY utt_id),
steps(utt_id, wanted, s) AS (SELECT * FROM lists UNION ALL
  SELECT utt_id, wanted, s[1:l - 1] || [{{'a': s[l].a, 'b': s[l + 1].b}}] || s[l + 2:] FROM (
    SELECT utt_id, wanted, s, least(list_position(lens, list_min(lens)), len(s) - 1) AS l FROM (
      SELECT *, list_transform(s, lambda x: x.b - x.a) AS lens FROM steps WHERE len(s) > wanted))),
done AS (SELECT utt_id, s FROM steps WHERE len(s) <= wanted)
SELECT utt_id, CAST(i - 1 AS INT) AS seg_no, s[i].a AS start_sample, s[i].b AS end_sample FROM (SELECT utt_id, s, unnest(range(1, len(s) + 1)) AS i FROM done)""",
)
def win17(v: Views):
    """Each recording has its own number of segments to end with."""
    sizes = _lengths(v).withColumn("n_expected", (F.col("utt_id") % 3 + 1).cast("int"))
    return SG.silence_segments(_bursts(v), "utt_id", sizes, "n_expected")


ENERGY_SQL = """
n AS (SELECT utt_id, count(*) AS n FROM signal GROUP BY 1),
fr AS (SELECT utt_id, n, unnest(CASE WHEN n < 400 THEN [0] ELSE range(0, 1 + (n - 400) // 160) END) AS frame_idx FROM n),
energy AS (SELECT f.utt_id, f.n, f.frame_idx, sqrt(avg(x * x)) AS rms FROM fr f JOIN signal s ON s.utt_id = f.utt_id AND s.sample_idx >= f.frame_idx * 160
  AND s.sample_idx < f.frame_idx * 160 + 400 GROUP BY 1, 2, 3)"""


@query(
    "win19_frame_energy",
    f"WITH {ENERGY_SQL} SELECT utt_id, CAST(frame_idx AS INT) AS frame_idx, round(CASE WHEN n < 400 THEN 0 ELSE rms END, 6) AS energy FROM energy",
)
def win19(v: Views):
    return _r(FR.frame_energy(v.signal, "utt_id"), "energy")


PROFILE_SQL = f"""{ENERGY_SQL},
lvl AS (SELECT utt_id, count(*) / 16000.0E0 AS duration, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak FROM signal GROUP BY 1),
vo AS (SELECT utt_id, min(frame_idx) * 160 / 16000.0E0 AS f, max(frame_idx) * 160 / 16000.0E0 AS l FROM energy WHERE rms > 0.01E0 GROUP BY 1),
profile AS (SELECT utt_id, duration, rms, 20 * log10(rms + 1e-10) AS rms_db, peak, 20 * log10(peak + 1e-10) AS peak_db,
  coalesce(f, 0) AS silence_before, coalesce(duration - l, 0) AS silence_after FROM lvl LEFT JOIN vo USING (utt_id))"""
PROFILE_COLS = ["duration", "rms", "rms_db", "peak", "peak_db", "silence_before", "silence_after"]


@query("agg20_profile", f"WITH {PROFILE_SQL} SELECT utt_id, {', '.join(f'round({c}, 8) AS {c}' for c in PROFILE_COLS)} FROM profile")
def agg20(v: Views):
    # durations are multiples of 1/16000 s, which eight decimals state exactly
    return FR.profile(v.signal_table, "utt_id").withColumns({c: F.round(c, 8) for c in PROFILE_COLS})


SUMMARY_SQL = f"""{PROFILE_SQL},
summary AS (SELECT CASE WHEN s_nationkey < 12 THEN 'pulled' ELSE 'augmented' END AS grp, count(*) AS n, avg(rms) AS rms_mean, stddev_pop(rms) AS rms_std, min(rms) AS rms_min,
  max(rms) AS rms_max, avg(peak) AS peak_mean, stddev_pop(peak) AS peak_std, avg(silence_before) AS silence_before_mean, avg(silence_after) AS silence_after_mean
  FROM profile JOIN supplier ON s_suppkey = utt_id GROUP BY 1)"""
SUMMARY_COLS = ["rms_mean", "rms_std", "rms_min", "rms_max", "peak_mean", "peak_std", "silence_before_mean", "silence_after_mean"]


def _summary(v: Views):
    groups = v.table("supplier").selectExpr("s_suppkey AS utt_id", "IF(s_nationkey < 12, 'pulled', 'augmented') AS grp")
    return FR.profile_summary(FR.profile(v.signal_table, "utt_id").join(groups, "utt_id"), "grp")


@query("agg20_profile_summary", f"WITH {SUMMARY_SQL} SELECT grp, n, {', '.join(f'round({c}, 6) AS {c}' for c in SUMMARY_COLS)} FROM summary")
def agg20_summary(v: Views):
    return _r(_summary(v), *SUMMARY_COLS)


@query(
    "agg20_range_cover",
    f"""WITH {SUMMARY_SQL} SELECT 'pulled' AS inner_group, 'augmented' AS outer_group, a.rms_min >= b.rms_min AND a.rms_max <= b.rms_max AS covered
FROM summary a, summary b WHERE a.grp = 'pulled' AND b.grp = 'augmented'""",
)
def agg20_cover(v: Views):
    return FR.range_cover(_summary(v), "grp", "pulled", "augmented")


# even spans over the frames of each utterance, then contours of 20 points
EVEN_SQL = """
spans AS (SELECT utt_id, CAST(i AS INT) AS idx, CAST(floor(i * (total / n_syllables)) AS INT) AS start_ms,
    CAST(CASE WHEN i = n_syllables - 1 THEN total ELSE floor((i + 1) * (total / n_syllables)) END AS INT) AS end_ms
  FROM (SELECT utt_id, n_syllables, floor(n_frames * 160 / 16000.0E0 * 1000) AS total, unnest(range(n_syllables)) AS i FROM frame_targets))"""
CURVE_SQL = """
inside AS (SELECT f.utt_id, s.idx, f.frame_idx, f.voicing, CASE WHEN f0_hz > 0 THEN 12 * log2(f0_hz / 100) ELSE 0.0E0 END AS st FROM frames f JOIN spans s ON s.utt_id = f.utt_id
  AND f.frame_idx >= CAST(floor(s.start_ms * 100.0E0 / 1000) AS INT) AND f.frame_idx < CAST(floor(s.end_ms * 100.0E0 / 1000) AS INT)),
ratio AS (SELECT utt_id, idx, avg(CASE WHEN voicing >= 0.5 THEN 1.0E0 ELSE 0.0E0 END) AS voicing_ratio FROM inside GROUP BY 1, 2),
med AS (SELECT utt_id, idx, median(st) AS med, count(*) AS m FROM inside WHERE voicing >= 0.5 GROUP BY 1, 2),
mad AS (SELECT utt_id, idx, median(abs(st - med)) AS mad FROM inside JOIN med USING (utt_id, idx) WHERE voicing >= 0.5 GROUP BY 1, 2),
vo AS (SELECT utt_id, idx, m, row_number() OVER (PARTITION BY utt_id, idx ORDER BY frame_idx) - 1 AS i, (st - med) / (1.4826E0 * CASE WHEN mad = 0 THEN 1 ELSE mad END) AS x
  FROM inside JOIN med USING (utt_id, idx) JOIN mad USING (utt_id, idx) WHERE voicing >= 0.5),
tgt AS (SELECT utt_id, idx, j, j * (m - 1) / 19.0E0 AS p FROM med, range(20) r(j) WHERE m >= 3),
lerp AS (SELECT t.utt_id, t.idx, t.j, a.x + (b.x - a.x) * (t.p - a.i) AS v FROM tgt t JOIN vo a ON a.utt_id = t.utt_id AND a.idx = t.idx AND a.i = floor(t.p)
  JOIN vo b ON b.utt_id = t.utt_id AND b.idx = t.idx AND b.i = least(floor(t.p) + 1, a.m - 1)),
curve AS (SELECT s.utt_id, s.idx, CAST(r.j AS INT) AS pos, coalesce(v, 0.0E0) AS v FROM spans s CROSS JOIN range(20) r(j)
  LEFT JOIN lerp l ON l.utt_id = s.utt_id AND l.idx = s.idx AND l.j = r.j)"""
SPAN_SQL = f"{EVEN_SQL},{CURVE_SQL}"


def _spans(v: Views):
    utts = v.frame_targets.withColumn("n_samples", F.col("n_frames") * U.HOP)
    return SP.uniform_spans(utts, "utt_id").select("utt_id", "idx", "start_ms", "end_ms")


@query(
    "mth5_voicing_ratio",
    f"WITH {SPAN_SQL} SELECT s.utt_id, s.idx, end_ms - start_ms AS duration_ms, round(coalesce(voicing_ratio, 0), 6) AS voicing_ratio FROM spans s LEFT JOIN ratio USING (utt_id, idx)",
)
def mth5(v: Views):
    built = CT.contours(v.frame_table, _spans(v), "utt_id")
    return _r(built.select("utt_id", "idx", "duration_ms", "voicing_ratio"), "voicing_ratio")


@query(
    "mth6_resample",
    """
WITH vo AS (SELECT utt_id, f0_hz AS x, row_number() OVER (PARTITION BY utt_id ORDER BY frame_idx) - 1 AS i, count(*) OVER (PARTITION BY utt_id) AS m FROM frames WHERE voicing >= 0.5),
t AS (SELECT DISTINCT utt_id, m, j, j * (m - 1) / 19.0E0 AS p FROM vo, range(20) r(j) WHERE m >= 3)
SELECT t.utt_id, CAST(t.j AS INT) AS pos, round(a.x + (b.x - a.x) * (t.p - a.i), 6) AS value FROM t JOIN vo a ON a.utt_id = t.utt_id AND a.i = floor(t.p)
JOIN vo b ON b.utt_id = t.utt_id AND b.i = least(floor(t.p) + 1, t.m - 1)""",
)
def mth6(v: Views):
    return _r(CT.resample(v.frame_table, ["utt_id"], "f0_hz"), "value")


@query(
    "mth7_contours",
    f"""WITH {SPAN_SQL}, g1 AS {gradient_sql('v', 'curve', 'utt_id, idx', 'pos', 'd1')}, g2 AS {gradient_sql('d1', 'g1', 'utt_id, idx', 'pos', 'd2')}
SELECT utt_id, idx, pos, round(v, 6) AS f0_norm, round(d1, 6) AS df0, round(d2, 6) AS ddf0 FROM g2""",
)
def mth7(v: Views):
    built = CT.contours(v.frame_table, _spans(v), "utt_id")
    long = built.select("utt_id", "idx", F.posexplode(F.arrays_zip("f0_norm", "df0", "ddf0")).alias("pos", "p")).select("utt_id", "idx", "pos", "p.*")
    return _r(long, "f0_norm", "df0", "ddf0")


# shape features and rule decisions over points(gid, pos, v) and meta(gid, duration_ms, voicing_ratio)
FEATURE_SQL = """
size AS (SELECT gid, count(*) AS k, max(abs(v)) = 0 AS flat FROM points GROUP BY 1),
raw AS (SELECT p.gid, any_value(flat) AS flat, regr_slope(v, pos) AS slope, max(v) - min(v) AS range_st, avg(v) FILTER (pos < greatest(1, k // 5)) AS start_level,
  avg(v) FILTER (pos >= k - greatest(1, k // 5)) AS end_level, min(v) AS min_level, max(v) AS max_level,
  arg_min(pos, (v, pos)) / greatest(1, any_value(k) - 1) AS min_position, arg_min(pos, (-v, pos)) / greatest(1, any_value(k) - 1) AS max_position
  FROM points p JOIN size s ON s.gid = p.gid GROUP BY p.gid),
feat AS (SELECT r.gid, duration_ms, voicing_ratio, CASE WHEN flat THEN 0 ELSE slope END AS slope, CASE WHEN flat THEN 0 ELSE range_st END AS range_st,
  CASE WHEN flat THEN 0 ELSE start_level END AS start_level, CASE WHEN flat THEN 0 ELSE end_level END AS end_level, CASE WHEN flat THEN 0 ELSE min_level END AS min_level,
  CASE WHEN flat THEN 0 ELSE max_level END AS max_level, CASE WHEN flat THEN 0.5E0 ELSE min_position END AS min_position, CASE WHEN flat THEN 0.5E0 ELSE max_position END AS max_position
  FROM raw r JOIN meta m ON m.gid = r.gid)"""
RULES_SQL = f"""{FEATURE_SQL},
sc AS (SELECT *, end_level - start_level AS rise, least(start_level, end_level) - min_level AS dip,
  CASE WHEN abs(slope) < 0.02E0 AND range_st < 0.5E0 THEN (1 - abs(slope) / 0.02E0) * (1 - range_st / 0.5E0) ELSE 0 END AS s1 FROM feat),
sd AS (SELECT *, CASE WHEN slope > 0.03E0 AND rise > 0.5E0 THEN least(1, slope / 0.1E0) * least(1, rise / 2) ELSE 0 END AS s2,
  CASE WHEN min_position > 0.25E0 AND min_position < 0.75E0 AND dip > 0 AND range_st > 0.5E0 THEN least(1, dip) * (1 - abs(min_position - 0.5E0)) ELSE 0 END AS s3,
  CASE WHEN slope < -0.03E0 AND -rise > 0.5E0 THEN least(1, abs(slope) / 0.1E0) * least(1, -rise / 2) ELSE 0 END AS s4 FROM sc),
pr AS (SELECT *, 0.8E0 * s1 AS p1, 0.85E0 * s2 AS p2, 0.85E0 * s3 AS p3, 0.85E0 * s4 AS p4 FROM sd),
tot AS (SELECT *, p1 + p2 + p3 + p4 AS total FROM pr),
told AS (SELECT gid, CASE WHEN duration_ms < 100 OR voicing_ratio < 0.4E0 OR total <= 0 THEN 0
    WHEN p1 >= greatest(p2, p3, p4) THEN 1 WHEN p2 >= greatest(p3, p4) THEN 2 WHEN p3 >= p4 THEN 3 ELSE 4 END AS predicted,
  CASE WHEN duration_ms < 100 THEN 0.7E0 WHEN voicing_ratio < 0.4E0 THEN 0.6E0 WHEN total <= 0 THEN 0.2E0 ELSE greatest(p1, p2, p3, p4) / total END AS confidence,
  CASE WHEN duration_ms < 100 THEN 'short_duration' WHEN voicing_ratio < 0.4E0 THEN 'low_voicing' ELSE concat_ws(',', CASE WHEN s1 > 0.5E0 THEN 'flat_contour' END,
    CASE WHEN s2 > 0.3E0 THEN 'rising_contour' END, CASE WHEN s3 > 0.3E0 THEN 'dipping_contour' END, CASE WHEN s4 > 0.3E0 THEN 'falling_contour' END,
    CASE WHEN total <= 0 THEN 'no_rule_matched' END) END AS tags FROM tot)"""
# embeddings are small, so the classifiers see them scaled by 10 and tilted by tone
SHAPED = "list_transform(f0_norm, lambda x, i: x * 2 + CASE tone WHEN 2 THEN (i - 32) * 0.05E0 WHEN 4 THEN (32 - i) * 0.05E0 WHEN 3 THEN abs(i - 32) * 0.04E0 WHEN 1 THEN x * -1.99E0 ELSE 0 END)"
CONTOUR_POINTS_SQL = f"""
shaped AS (SELECT id, duration_ms, voicing_ratio, {SHAPED} AS y FROM contours),
points AS (SELECT id AS gid, generate_subscripts(y, 1) - 1 AS pos, unnest(y) AS v FROM shaped),
meta AS (SELECT id AS gid, duration_ms, voicing_ratio FROM shaped)"""
FEATURES = ["slope", "range_st", "start_level", "end_level", "min_level", "max_level", "min_position", "max_position"]


def _shaped(v: Views):
    y = """transform(f0_norm, (x, i) -> x * 2 + CASE tone WHEN 2 THEN (i - 31) * 0.05E0 WHEN 4 THEN (31 - i) * 0.05E0
      WHEN 3 THEN abs(i - 31) * 0.04E0 WHEN 1 THEN x * -1.99E0 ELSE 0 END)"""
    return v.contours.withColumn("f0_norm", F.expr(y))


@query("mth8_tone_features", f"WITH {CONTOUR_POINTS_SQL}, {FEATURE_SQL.strip()} SELECT gid AS id, {', '.join(f'round({c}, 6) AS {c}' for c in FEATURES)} FROM feat")
def mth8(v: Views):
    return _r(CT.tone_features(_shaped(v)).select("id", *FEATURES), *FEATURES)


@query("cls1_rules", f"WITH {CONTOUR_POINTS_SQL}, {RULES_SQL.strip()} SELECT gid AS id, predicted, round(confidence, 6) AS confidence, tags FROM told")
def cls1(v: Views):
    told = CL.classify_rules(_shaped(v)).withColumn("tags", F.array_join("tags", ","))
    return _r(told.select("id", "predicted", "confidence", "tags"), "confidence")


# the nearest template's probability and tag over d(gid, ord, tone, d) and meta
TOLD_SQL = """
p AS (SELECT *, exp(-d / 2) / sum(exp(-d / 2)) OVER (PARTITION BY gid) AS prob FROM d QUALIFY row_number() OVER (PARTITION BY gid ORDER BY d, ord) = 1),
told AS (SELECT gid, CASE WHEN duration_ms < 100 OR voicing_ratio < 0.4E0 THEN 0 ELSE tone END AS predicted,
  CASE WHEN duration_ms < 100 THEN 0.7E0 WHEN voicing_ratio < 0.4E0 THEN 0.6E0 ELSE prob END AS confidence,
  CASE WHEN duration_ms < 100 THEN 'short_duration' WHEN voicing_ratio < 0.4E0 THEN 'low_voicing' WHEN d < 0.5E0 THEN 'strong_match' WHEN d < 1 THEN 'moderate_match' ELSE 'weak_match' END AS tags
  FROM p JOIN meta USING (gid))"""
TEMPLATE_SQL = "(VALUES " + ", ".join(f"({o}, {t}, {[float(x) for x in y]}::DOUBLE[])" for o, (t, y) in enumerate(CL.TEMPLATES.items())) + ") t(ord, tone, y)"


@query(
    "cls2_templates",
    f"""WITH {CONTOUR_POINTS_SQL},
tmpl AS (SELECT ord, tone, i AS pos, y[CAST(floor(i * 19 / 63.0E0) AS INT) + 1] + (y[least(CAST(floor(i * 19 / 63.0E0) AS INT) + 2, 20)] - y[CAST(floor(i * 19 / 63.0E0) AS INT) + 1])
  * (i * 19 / 63.0E0 - floor(i * 19 / 63.0E0)) AS b FROM {TEMPLATE_SQL}, range(64) r(i)),
d AS (SELECT gid, ord, tone, sqrt(avg((v - b) * (v - b))) AS d FROM points JOIN tmpl USING (pos) GROUP BY 1, 2, 3),
{TOLD_SQL.strip()}
SELECT gid AS id, predicted, round(confidence, 6) AS confidence, tags FROM told""",
)
def cls2(v: Views):
    told = CL.classify_templates(_shaped(v)).withColumn("tags", F.array_join("tags", ","))
    return _r(told.select("id", "predicted", "confidence", "tags"), "confidence")


@query(
    "cls2_templates_dtw",
    f"""WITH RECURSIVE {CONTOUR_POINTS_SQL.strip()},
warp(gid, ord, i, tot) AS (
  SELECT gid, ord, 0::BIGINT, [0.0::DOUBLE] || list_transform(range(20), lambda k: 'inf'::DOUBLE) FROM meta, {TEMPLATE_SQL}
  UNION ALL
  SELECT w.gid, w.ord, i + 1, list_reduce(list_transform(range(1, 21), lambda k: [CAST(k AS DOUBLE)]), lambda acc, k: acc || [abs(s.y[i + 1] - t.y[CAST(k[1] AS BIGINT)])
    + least(tot[CAST(k[1] AS BIGINT) + 1], acc[CAST(k[1] AS BIGINT)], tot[CAST(k[1] AS BIGINT)])], ['inf'::DOUBLE])
  FROM warp w JOIN shaped s ON s.id = w.gid JOIN {TEMPLATE_SQL} ON t.ord = w.ord WHERE i < len(s.y)),
d AS (SELECT gid, w.ord, t.tone, tot[21] AS d FROM warp w JOIN shaped s ON s.id = w.gid JOIN {TEMPLATE_SQL} ON t.ord = w.ord WHERE i = len(s.y)),
{TOLD_SQL.strip()}
SELECT gid AS id, predicted, round(confidence, 6) AS confidence, tags FROM told""",
)
def cls2_dtw(v: Views):
    told = CL.classify_templates(_shaped(v), use_dtw=True).withColumn("tags", F.array_join("tags", ","))
    return _r(told.select("id", "predicted", "confidence", "tags"), "confidence")


@query(
    "agg19_tone_templates",
    """
SELECT tone, CAST(pos AS INT) AS pos, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(*) AS n
FROM (SELECT tone, generate_subscripts(f0_norm, 1) - 1 AS pos, unnest(f0_norm) AS v FROM contours) GROUP BY 1, 2 HAVING count(*) >= 5""",
)
def agg19(v: Views):
    return _r(CT.tone_templates(v.contours), "mean", "std")


@query(
    "arr1_uniform_boundaries",
    """
SELECT utt_id, CAST(i AS INT) AS idx, i * (n_samples // n_syllables) AS start_sample, CASE WHEN i = n_syllables - 1 THEN n_samples ELSE (i + 1) * (n_samples // n_syllables) END AS end_sample
FROM (SELECT *, unnest(range(n_syllables)) AS i FROM utterances)""",
)
def arr1(v: Views):
    return SP.uniform_boundaries(v.utterances, "utt_id")


@query(
    "arr2_uniform_spans",
    """
WITH t AS (SELECT utt_id, CASE WHEN speaker = 0 THEN 0 ELSE n_syllables END AS n, CAST(floor(n_samples / 16000.0E0 * 1000) AS INT) AS total FROM utterances)
SELECT utt_id, CAST(i AS INT) AS idx, CAST(floor(i * (total / n)) AS INT) AS start_ms, CASE WHEN i = n - 1 THEN total ELSE CAST(floor((i + 1) * (total / n)) AS INT) END AS end_ms,
  0.5E0 AS confidence, NULL AS warning FROM (SELECT *, unnest(range(n)) AS i FROM t)
UNION ALL SELECT utt_id, NULL, NULL, NULL, 1.0E0, 'no_targets' FROM t WHERE n = 0""",
)
def arr2(v: Views):
    utts = v.utterances.withColumn("n_syllables", F.when(F.col("speaker") == 0, 0).otherwise(F.col("n_syllables")))
    return SP.uniform_spans(utts, "utt_id")


def _regions(v: Views):
    """Two active regions per utterance; none for speaker 0, fewer samples than syllables for speaker 1."""
    pair = F.array(
        F.struct(F.lit(0).alias("region_no"), F.expr("n_samples div 10").alias("start"), F.expr("n_samples * 4 div 10").alias("end")),
        F.struct(F.lit(1).alias("region_no"), F.expr("n_samples div 2").alias("start"), F.expr("n_samples * 9 div 10").alias("end")),
    )
    tiny = F.array(
        F.struct(F.lit(0).alias("region_no"), F.lit(100).cast("long").alias("start"), (F.col("n_syllables") + 99).cast("long").alias("end"))
    )
    chosen = F.when(F.col("speaker") == 1, tiny).when(F.col("speaker") > 1, pair)
    return v.utterances.select("utt_id", F.inline(chosen))


@query(
    "arr3_positions",
    """
WITH reg AS (
  SELECT utt_id, n_samples, n_syllables, 0 AS region_no, n_samples // 10 AS a, n_samples * 4 // 10 AS b FROM utterances WHERE speaker > 1
  UNION ALL SELECT utt_id, n_samples, n_syllables, 1, n_samples // 2, n_samples * 9 // 10 FROM utterances WHERE speaker > 1
  UNION ALL SELECT utt_id, n_samples, n_syllables, 0, 100, n_syllables + 99 FROM utterances WHERE speaker = 1),
st AS (SELECT utt_id, any_value(n_samples) AS n_samples, any_value(n_syllables) AS n, sum(b - a) AS active, sum(b - a) // any_value(n_syllables) AS step FROM reg GROUP BY 1),
pc AS (SELECT utt_id, n, region_no, a + j * step AS s, least(a + (j + 1) * step, b) AS e FROM (
  SELECT r.utt_id, st.n, st.step, region_no, a, b, unnest(range(CAST((b - a + step - 1) // step AS BIGINT))) AS j FROM reg r JOIN st USING (utt_id) WHERE step > 0)),
nu AS (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY region_no, s) - 1 AS idx FROM pc QUALIFY idx < n),
la AS (SELECT utt_id, n, max(idx) AS m, arg_max(s, idx) AS s, arg_max(e, idx) AS e FROM nu GROUP BY 1, 2)
SELECT utt_id, idx, CAST(s AS BIGINT) AS start_sample, CAST(e AS BIGINT) AS end_sample FROM nu
UNION ALL SELECT utt_id, unnest(range(m + 1, n)), CAST(s AS BIGINT), CAST(e AS BIGINT) FROM la
UNION ALL SELECT utt_id, unnest(range(n)), CASE WHEN active > 0 THEN 100 ELSE 0 END, CASE WHEN active > 0 THEN 100 ELSE n_samples END FROM st WHERE step = 0
UNION ALL SELECT utt_id, i, i * (n_samples // n_syllables), (i + 1) * (n_samples // n_syllables) FROM (SELECT *, unnest(range(n_syllables)) AS i FROM utterances WHERE speaker = 0)""",
)
def arr3(v: Views):
    return SP.proportional_positions(v.utterances, "utt_id", _regions(v))


@query(
    "arr4_chunk_window",
    """
WITH b AS (SELECT utt_id, n_samples AS n, i AS idx, i * (n_samples // n_syllables) AS s, CASE WHEN i = n_syllables - 1 THEN n_samples ELSE (i + 1) * (n_samples // n_syllables) END AS e
  FROM (SELECT *, unnest(range(n_syllables)) AS i FROM utterances)),
l AS (SELECT *, greatest(0, e + 1600 - 16000) AS lo, greatest(0, least(s - 1600, n - 16000)) AS hi FROM b),
c AS (SELECT *, CASE WHEN lo > hi THEN greatest(0, least((s + e) // 2 - 8000, n - 16000)) ELSE (lo + hi) // 2 END AS c FROM l)
SELECT utt_id, CAST(idx AS INT) AS idx, c AS chunk_start, least(c + 16000, n) AS chunk_end, c // 160 AS first_frame, CAST(98 AS BIGINT) AS n_frames, greatest(0, c + 16000 - n) AS pad FROM c""",
)
def arr4(v: Views):
    spans = SP.uniform_boundaries(v.utterances, "utt_id").join(v.utterances.select("utt_id", "n_samples"), "utt_id")
    return SP.chunk_window(spans).drop("start_sample", "end_sample", "n_samples")


@query(
    "arr9_align_to_reference",
    """
WITH RECURSIVE unit AS (SELECT DISTINCT utt_id, frame, list_transform(x, lambda v: v / (sqrt(list_inner_product(x, x)) + 1e-8)) AS u
  FROM (SELECT CAST(floor(vec_id / 10) AS BIGINT) AS utt_id, CAST(vec_id % 10 AS INT) AS frame, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)),
rec AS (SELECT utt_id, list(u ORDER BY frame) AS us FROM unit GROUP BY 1),
pair AS (SELECT a.utt_id, a.us AS q, b.us AS r, len(a.us) AS n, len(b.us) AS m, greatest(1, CAST(floor(greatest(len(a.us), len(b.us)) * 0.3E0) AS BIGINT)) AS w
  FROM rec a JOIN rec b ON b.utt_id = a.utt_id + 1),
dp(utt_id, i, tot) AS (
  SELECT utt_id, 0::BIGINT, [0.0::DOUBLE] || list_transform(range(m), lambda k: 'inf'::DOUBLE) FROM pair
  UNION ALL
  SELECT dp.utt_id, i + 1, list_reduce(list_transform(range(1, m + 1), lambda k: [CAST(k AS DOUBLE)]), lambda acc, k: acc || [CASE WHEN abs(k[1] - (i + 1) * m // n) <= w
      THEN 1 - list_inner_product(q[i + 1], r[CAST(k[1] AS BIGINT)]) + least(tot[CAST(k[1] AS BIGINT) + 1], acc[CAST(k[1] AS BIGINT)], tot[CAST(k[1] AS BIGINT)]) ELSE 'inf'::DOUBLE END], ['inf'::DOUBLE])
  FROM dp JOIN pair ON pair.utt_id = dp.utt_id WHERE i < n),
way(utt_id, i, j) AS (
  SELECT utt_id, n, m FROM pair JOIN dp USING (utt_id) WHERE i = n AND tot[m + 1] < 'inf'::DOUBLE
  UNION ALL
  SELECT way.utt_id, CASE WHEN a.tot[j + 1] <= least(b.tot[j], a.tot[j]) OR b.tot[j] > a.tot[j] THEN way.i - 1 ELSE way.i END,
    CASE WHEN a.tot[j + 1] <= least(b.tot[j], a.tot[j]) THEN j ELSE j - 1 END
  FROM way JOIN dp a ON a.utt_id = way.utt_id AND a.i = way.i - 1 JOIN dp b ON b.utt_id = way.utt_id AND b.i = way.i WHERE way.i > 1 OR j > 1),
firsts AS (SELECT utt_id, j, min(i) - 1 AS f FROM way GROUP BY 1, 2),
cost AS (SELECT way.utt_id, count(*) AS steps, any_value(tot[m + 1]) AS cost FROM way JOIN pair ON pair.utt_id = way.utt_id JOIN dp ON dp.utt_id = way.utt_id AND dp.i = n GROUP BY 1),
found AS (SELECT p.utt_id, list_sort(list_distinct(list(least(f * 10, n * 10)))) AS b FROM pair p, range(4) k(k)
  JOIN firsts f ON f.utt_id = p.utt_id AND f.j = least(CAST(floor(floor(k * (m * 10 / 3.0E0)) / 10) AS BIGINT), m - 1) + 1 GROUP BY 1),
ends AS (SELECT rec.utt_id, CASE WHEN len(b) > 3 THEN b ELSE [CAST(floor(i * (len(us) * 10 / 3.0E0)) AS BIGINT) for i in range(3)] || [len(us) * 10] END AS b,
  CASE WHEN len(b) > 3 THEN greatest(0.3E0, 1 - least(1, cost / steps)) ELSE 0.5E0 END AS confidence,
  CASE WHEN len(b) > 3 THEN NULL ELSE 'dtw_fallback_to_uniform' END AS warning FROM rec LEFT JOIN found USING (utt_id) LEFT JOIN cost USING (utt_id))
SELECT utt_id, CAST(i - 1 AS INT) AS idx, CAST(b[i] AS INT) AS start_ms, CAST(b[i + 1] AS INT) AS end_ms, round(confidence, 6) AS confidence, warning FROM ends, range(1, 4) r(i)""",
)
def arr9(v: Views):
    frames = v.logits.select("utt_id", "frame", F.col("logits").alias("features"))
    reference = frames.withColumn("utt_id", F.col("utt_id") - 1)
    targets = frames.groupBy("utt_id").agg(F.lit(3).alias("n_syllables"))
    return _r(AL.align_to_reference(frames, reference, targets, "utt_id"), "confidence")


def _grading_targets(v: Views):
    utts = v.frame_targets.withColumn("idx", F.explode(F.sequence(F.lit(0), F.col("n_syllables") - 1)))
    return utts.withColumn("n", (F.col("utt_id") * 3 + F.col("idx") * 5) % len(WORD_CLASSES)).selectExpr(
        "utt_id", "idx", f"{word_case(0)} AS base", f"{word_case(1)} AS tone"
    )


GRADED_POINTS_SQL = """
points AS (SELECT utt_id * 100 + idx AS gid, pos, v FROM curve),
meta AS (SELECT s.utt_id * 100 + s.idx AS gid, end_ms - start_ms AS duration_ms, coalesce(voicing_ratio, 0) AS voicing_ratio FROM spans s LEFT JOIN ratio USING (utt_id, idx))"""
GRADED_SQL = f"""
tg AS (SELECT utt_id, idx, {word_case(0)} AS base, {word_case(1)} AS tone FROM (SELECT utt_id, i AS idx, (utt_id * 3 + i * 5) % 8 AS n FROM (SELECT *, unnest(range(n_syllables)) AS i FROM frame_targets))),
t1 AS (SELECT *, CASE WHEN tone = 3 AND lead(tone) OVER (PARTITION BY utt_id ORDER BY idx) = 3 THEN 2 ELSE tone END AS s1 FROM tg),
t2 AS (SELECT *, CASE WHEN base = 'yi' AND tone = 1 THEN CASE lead(s1) OVER (PARTITION BY utt_id ORDER BY idx) WHEN 4 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 4 WHEN 3 THEN 4 ELSE s1 END ELSE s1 END AS s2 FROM t1),
t3 AS (SELECT *, CASE WHEN base = 'bu' AND tone = 4 AND lead(s2) OVER (PARTITION BY utt_id ORDER BY idx) = 4 THEN 2 ELSE s2 END AS expected FROM t2),
graded AS (SELECT 'x' AS scorer, utt_id, idx, expected, predicted, confidence FROM t3 JOIN told ON gid = utt_id * 100 + idx),
{SCORES_SQL.strip().replace('FROM predictions', 'FROM graded')}"""
GRADE_SQL = f"{SPAN_SQL},{GRADED_POINTS_SQL},{RULES_SQL},{GRADED_SQL}"
# spans between voicing gaps, told by the nearest template
TEMPLATE_GRADE_SQL = f"""{RUNS_SQL.strip()},
ends AS (SELECT utt_id, boundary FROM bounds UNION ALL SELECT utt_id, n_frames FROM frame_targets),
spans AS (SELECT utt_id, CAST(row_number() OVER w - 1 AS INT) AS idx, coalesce(lag(boundary) OVER w, 0) * 10 AS start_ms, boundary * 10 AS end_ms FROM ends WINDOW w AS (PARTITION BY utt_id ORDER BY boundary)),
{CURVE_SQL.strip()},{GRADED_POINTS_SQL},
d AS (SELECT gid, ord, tone, sqrt(avg((v - y[pos + 1]) * (v - y[pos + 1]))) AS d FROM points, {TEMPLATE_SQL} GROUP BY 1, 2, 3),
{TOLD_SQL.strip()},{GRADED_SQL}"""


@query(
    "scr3_grade_syllables",
    f"WITH {GRADE_SQL} SELECT utt_id, CAST(idx AS INT) AS idx, expected, predicted, round(confidence, 6) AS confidence, round(overall, 6) AS overall FROM syl",
)
def scr3_syllables(v: Views):
    rows = G.grade_syllables(v.frame_table, _grading_targets(v), "utt_id")
    return _r(rows.select("utt_id", "idx", "expected", "predicted", "confidence", "overall"), "confidence", "overall")


@query("scr3_grade", f"WITH {GRADE_SQL} SELECT utt_id, n_syllables, round(score, 6) AS score, CAST(NULL AS VARCHAR) AS warning FROM sentence")
def scr3(v: Views):
    return _r(G.grade(v.frame_table, _grading_targets(v), v.frame_targets, "utt_id"), "score")


@query(
    "scr3_grade_templates",
    f"WITH {TEMPLATE_GRADE_SQL} SELECT utt_id, n_syllables, round(score, 6) AS score, CAST(NULL AS VARCHAR) AS warning FROM sentence",
)
def scr3_templates(v: Views):
    """The same recordings graded by the nearest template, with spans from the voicing gaps."""
    spans = SG.boundary_spans(SG.voicing_boundaries(v.frame_table, v.frame_targets, "utt_id"), v.frame_targets, "utt_id", 0.7)
    graded = G.grade(v.frame_table, _grading_targets(v), v.frame_targets, "utt_id", spans=spans, classifier="templates")
    return _r(graded, "score")
