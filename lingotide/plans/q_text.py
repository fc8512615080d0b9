"""Sentence filters, text scoring, generated-record intake and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingotide.functions import text as T
from lingotide.operators import quality as Q
from lingotide.operators import sequences as S
from lingotide.operators import texts as X
from lingotide.plans.registry import query
from lingotide.plans.views import Views

WS = T.WHITESPACE
PUNCT = T.SCORING_PUNCTUATION.replace("'", "''").replace("[]", "\\[\\]")


def norm_sql(col: str) -> str:
    return (
        f"lower(translate(regexp_replace({col}, '[{PUNCT}{WS}]', '', 'g'), '{T.FULL_WIDTH}', '{T.HALF_WIDTH.replace(chr(39), chr(39) * 2)}'))"
    )


@query("str1_normalize_text", f"SELECT id, {norm_sql('text')} AS normalized FROM texts")
def str1(v: Views):
    return v.texts.select("id", T.normalize_text(F.col("text")).alias("normalized"))


@query(
    "str2_half_width",
    f"""SELECT id, translate(translate(text, '{T.HALF_WIDTH.replace(chr(39), chr(39) * 2)}', '{T.FULL_WIDTH}'), '{T.FULL_WIDTH}', '{T.HALF_WIDTH.replace(chr(39), chr(39) * 2)}') AS half FROM texts""",
)
def str2(v: Views):
    wide = F.translate("text", T.HALF_WIDTH, T.FULL_WIDTH)
    return v.texts.select("id", T.to_half_width(wide).alias("half"))


PAIR_SQL = f"""
WITH n AS (SELECT *, {norm_sql('ref')} AS r, {norm_sql('hyp')} AS h FROM text_pairs),
d AS (SELECT *, levenshtein(r, h) AS distance, length(r) AS rl, length(h) AS hl FROM n),
c AS (SELECT *, CASE WHEN h IS NULL THEN NULL WHEN rl > 0 THEN distance / rl WHEN hl = 0 THEN 0.0E0 ELSE 1.0E0 END AS cer,
  rl - (distance - greatest(0, hl - rl)) AS matched FROM d),
s AS (SELECT *, CASE WHEN cer >= 1 THEN 0 ELSE round((1.0E0 - cer) * 100) END AS score,
  CASE WHEN rl = 0 THEN 100 WHEN hl = 0 THEN 0 WHEN matched <= 0 THEN 0 ELSE round(least(greatest(matched / rl, 0), 1) * 100) END AS compl FROM c)"""


@query("str3_edit_distance", f"{PAIR_SQL} SELECT id, distance FROM s")
def str3(v: Views):
    return X.score_pairs(v.text_pairs).select("id", F.col("distance").cast("long").alias("distance"))


@query("str4_error_rate", f"{PAIR_SQL} SELECT id, round(cer, 6) AS cer FROM s")
def str4(v: Views):
    return X.score_pairs(v.text_pairs).select("id", F.round("cer", 6).alias("cer"))


@query(
    "str5_error_score",
    f"{PAIR_SQL} SELECT id, CAST(score AS INT) AS score, CAST(compl AS INT) AS completeness FROM s",
)
def str5(v: Views):
    return X.score_pairs(v.text_pairs).select("id", "score", "completeness")


@query(
    "agg25_asr_grade",
    f"""{PAIR_SQL} SELECT id, 'asr_cer_v1' AS method, CAST(CASE WHEN hyp IS NULL THEN 0 ELSE score END AS INT) AS overall,
  CAST(CASE WHEN hyp IS NULL THEN 0 ELSE score END AS INT) AS accuracy, CAST(CASE WHEN hyp IS NULL THEN 0 ELSE compl END AS INT) AS completeness,
  hyp AS recognized_text, round(cer, 6) AS cer, CAST(distance AS INT) AS edit_distance, CAST(CASE WHEN hyp IS NULL THEN NULL ELSE rl END AS INT) AS ref_length,
  CAST(hl AS INT) AS hyp_length, CASE WHEN hyp IS NULL THEN 'recognition_failed' END AS error FROM s""",
)
def agg25(v: Views):
    return X.asr_grade(v.text_pairs).withColumn("cer", F.round("cer", 6))


@query(
    "agg18_error_rate",
    """
WITH d AS (SELECT levenshtein(array_to_string(ref, ''), array_to_string(hyp, '')) AS d, len(ref) AS n FROM token_pairs)
SELECT count(*) AS n_pairs, CAST(sum(d) AS BIGINT) AS errors, CAST(sum(n) AS BIGINT) AS ref_tokens, round(sum(d) / sum(n), 6) AS error_rate,
  round(avg(CASE WHEN d = 0 THEN 1.0E0 ELSE 0.0E0 END), 6) AS exact_share FROM d""",
)
def agg18(v: Views):
    return X.corpus_error_rate(v.token_pairs).withColumns(
        {"error_rate": F.round("error_rate", 6), "exact_share": F.round("exact_share", 6)}
    )


@query(
    "prj1_level",
    """
SELECT sequence_id, CAST(substr(list_filter(tags, lambda t: regexp_full_match(lower(t), 'hsk[0-9]'))[1], 4, 1) AS INT) AS parsed_level,
  list_filter(tags, lambda t: regexp_full_match(t, 'hsk[1-6]'))[1] AS strict_level FROM sequences""",
)
def prj1(v: Views):
    both = S.with_level(S.with_level(v.sequences, name="parsed_level"), strict=True, name="strict_level")
    return both.select("sequence_id", "parsed_level", "strict_level")


@query(
    "src2_to_domain",
    """
SELECT sequence_id AS id, text, coalesce(CASE WHEN difficulty > 2 THEN difficulty END, 1) AS difficulty,
  CASE WHEN level IS NULL THEN 0 ELSE 2 END AS n_tags, 0 AS n_tokens, 0 AS n_gloss,
  CASE WHEN level IS NOT NULL THEN CAST(substr(tags[2], 4, 1) AS INT) END AS level, 'zh-CN' AS language FROM sequences""",
)
def src2(v: Views):
    raw = v.sequences.select(
        F.col("sequence_id").alias("id"),
        "text",
        F.lit(None).cast("map<string,string>").alias("gloss"),
        F.lit(None).cast("array<string>").alias("tokens"),
        F.when(F.col("level").isNotNull(), F.col("tags")).alias("tags"),
        F.when(F.col("difficulty") > 2, F.col("difficulty")).alias("difficulty"),
        F.lit("zh-CN").alias("language"),
    )
    return S.to_domain(raw).select(
        "id", "text", "difficulty", F.size("tags").alias("n_tags"), F.size("tokens").alias("n_tokens"),
        F.size("gloss").alias("n_gloss"), "level", "language",
    )


@query(
    "prj2_point_filters",
    """
SELECT 'id' AS filter, count(*) AS n FROM sequences WHERE sequence_id = 7
UNION ALL SELECT 'tag', count(*) FROM sequences WHERE list_contains(tags, 'hsk3')
UNION ALL SELECT 'difficulty', count(*) FROM sequences WHERE difficulty = 2
UNION ALL SELECT 'level', count(*) FROM sequences WHERE level = 4
UNION ALL SELECT 'all', count(*) FROM sequences""",
)
def prj2(v: Views):
    parts = {
        "id": S.by_id(v.sequences, 7),
        "tag": S.by_tag(v.sequences, "hsk3"),
        "difficulty": S.by_difficulty(v.sequences, 2),
        "level": S.by_level(v.sequences, 4),
        "all": v.sequences,
    }
    out = None
    for name, part in parts.items():
        one = part.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("filter"), "n")
        out = one if out is None else out.union(one)
    return out


@query(
    "prj3_select_rows",
    """
SELECT sequence_id, text, tags[2] AS level_tag FROM sequences
WHERE tags[2] IN ('hsk2', 'hsk5') AND (contains(lower(text), 'red') OR contains(lower(tags[1]), 'red'))
ORDER BY sequence_id LIMIT 25""",
)
def prj3(v: Views):
    rows = v.sequences.withColumn("romanization", F.element_at("tags", 1))
    return S.select_rows(rows, levels=["HSK2", "hsk5 "], term="Red", limit=25).select("sequence_id", "text", "level_tag")


@query(
    "prj4_restrict",
    """
SELECT utt_id, speaker, n_samples FROM utterances
WHERE speaker IN (1, 2, 3, 5, 8, 13) AND utt_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
)
def prj4(v: Views):
    wanted = v.table("orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("utt_id"))
    picked = S.filter_ids(S.filter_speakers(v.utterances, [1, 2, 3, 5, 8, 13]), wanted, "utt_id")
    return picked.select("utt_id", "speaker", "n_samples")


def _voiced(v: Views):
    """Sequences with their voices as a nested array."""
    return v.table("part").selectExpr(
        "CAST(p_partkey AS INT) AS sequence_id",
        """array_compact(array(
  CASE WHEN p_size > 5 THEN named_struct('id', 'f1', 'label', map('en', 'Female'), 'uri', concat('assets://examples/female/', p_partkey, '.opus'), 'duration_ms', p_size) END,
  CASE WHEN p_size <= 45 THEN named_struct('id', 'm1', 'label', map('en', 'Male'), 'uri', concat('assets://examples/male/', p_partkey, '.opus'), 'duration_ms', p_size) END)) AS voices""",
    )


@query(
    "prj5_resolve_voice",
    """
SELECT sequence_id, coalesce(max(uri) FILTER (voice_id = 'f1'), arg_min(uri, pos)) AS female,
  arg_min(uri, pos) AS male, coalesce(max(uri) FILTER (voice_id = 'm1'), arg_min(uri, pos)) AS by_id,
  max(uri) FILTER (voice_id = 'm1') AS strict_id
FROM voices GROUP BY 1""",
)
def prj5(v: Views):
    voices = F.col("voices")
    return _voiced(v).select(
        "sequence_id",
        S.resolve_voice(voices, "female").alias("female"),
        S.resolve_voice(voices, "male").alias("male"),
        S.resolve_voice(voices, " M1 ").alias("by_id"),
        S.resolve_voice(voices, "m1", strict=True).alias("strict_id"),
    )


@query(
    "prj6_uri_paths",
    """
WITH uris AS (SELECT url AS uri FROM pages UNION ALL SELECT uri FROM voices)
SELECT uri, CASE WHEN starts_with(uri, 'assets://') OR starts_with(uri, 'file://') THEN 'local'
  WHEN starts_with(uri, 'http://') OR starts_with(uri, 'https://') THEN 'remote' ELSE 'unsupported' END AS kind,
  CASE WHEN starts_with(uri, 'assets://') THEN concat('/data/assets/', substr(uri, 10)) WHEN starts_with(uri, 'file://') THEN substr(uri, 8) END AS path
FROM uris""",
)
def prj6(v: Views):
    uris = v.table("pages").select(F.col("url").alias("uri")).union(v.voices.select("uri"))
    return uris.select("uri", T.uri_kind(F.col("uri")).alias("kind"), T.uri_to_path(F.col("uri"), "/data/assets").alias("path"))


@query(
    "prj7_romanization_style",
    f"""SELECT id, CASE WHEN regexp_matches(lower(text), '[{T.MARKED_LETTERS}]') THEN 'tone-mark'
  WHEN regexp_matches(lower(text), '[a-zvü]+[1-5]') THEN 'tone-number' ELSE 'other' END AS style FROM texts""",
)
def prj7(v: Views):
    return v.texts.select("id", T.romanization_style(F.col("text")).alias("style"))


@query(
    "prj8_normalize_generated",
    f"""
WITH items AS (
  SELECT id, CASE WHEN language = 'en' THEN 'zh-CN' ELSE language END AS language, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT id, language, CASE WHEN language IN ('en', 'fr') THEN string_split(text, chr(10)) ELSE [text] END AS ls FROM texts)),
t AS (SELECT *, regexp_replace(line, '^[{WS}]+|[{WS}]+$', '', 'g') AS s, row_number() OVER (ORDER BY id, pos) AS no FROM items)
SELECT concat('ts_', CASE WHEN no < 1000000 THEN lpad(CAST(no AS VARCHAR), 6, '0') ELSE CAST(no AS VARCHAR) END) AS id,
  CASE WHEN language = 'zh-CN' THEN regexp_replace(s, '[{T.TRAILING_PUNCTUATION}]+$', '') ELSE s END AS text,
  language, CASE WHEN language = 'fr' THEN line ELSE '' END AS gloss_en, 1 AS difficulty FROM t""",
)
def prj8(v: Views):
    zh = F.when(F.col("language") == "en", "zh-CN").otherwise(F.col("language"))
    lines = F.split("text", "\n")
    response = (
        F.when(F.col("language") == "en", F.to_json(F.struct(F.transform(lines, lambda s: F.struct(s.alias("text"))).alias("sentences"))))
        .when(
            F.col("language") == "fr",
            F.to_json(F.struct(F.transform(lines, lambda s: F.struct(s.alias("text"), s.alias("translation"))).alias("items"))),
        )
        .otherwise(F.to_json(F.struct("text")))
    )
    batches = v.texts.select(F.col("id").alias("batch_id"), zh.alias("language"), response.alias("response"))
    return X.normalize_generated(batches, 1).select(
        "id", "text", "language", F.col("gloss")["en"].alias("gloss_en"), "difficulty"
    )


@query(
    "prj9_numeric_pinyin_errors",
    f"""SELECT id, concat('Numerical pinyin detected in ''', text, ''': ''', source, '''') AS message FROM texts
WHERE regexp_matches(source, '[a-zA-Z]+[1-4](?:[{WS}]|$|,)')""",
)
def prj9(v: Views):
    items = v.texts.select("id", "text", F.col("source").alias("romanization"))
    return X.numeric_pinyin_errors(items)


@query(
    "prj10_expected_seconds",
    """SELECT id, CAST(greatest(ceil(length(text) / CASE WHEN source IN ('src1', 'src2') THEN 3 ELSE 5 END) + 2, 3) AS INT) AS seconds FROM texts""",
)
def prj10(v: Views):
    language = F.when(F.col("source").isin("src1", "src2"), "zh-CN").otherwise(F.col("language"))
    return v.texts.select("id", T.expected_seconds(F.col("text"), language).alias("seconds"))


@query(
    "jn3_join_recordings",
    """
SELECT s.sequence_id, s.text, arg_min(c.path, CASE c.ext WHEN 'wav' THEN 1 ELSE 2 END) AS path
FROM sequences s JOIN catalog c USING (sequence_id) GROUP BY 1, 2""",
)
def jn3(v: Views):
    return S.join_recordings(v.sequences, v.catalog).select("sequence_id", "text", "path")


@query("jn4_with_audio", "SELECT sequence_id, text FROM sequences WHERE sequence_id IN (SELECT sequence_id FROM catalog)")
def jn4(v: Views):
    return S.with_audio(v.sequences, v.catalog, "sequence_id").select("sequence_id", "text")


@query(
    "jn4_missing_audio", "SELECT sequence_id, text FROM sequences WHERE sequence_id NOT IN (SELECT sequence_id FROM catalog)"
)
def jn4_missing(v: Views):
    return S.missing_audio(v.sequences, v.catalog, "sequence_id").select("sequence_id", "text")


@query(
    "jn7_stale_audio",
    """
WITH manifest AS (
  SELECT 'female' AS voice, doc_id AS id, sha256(CASE WHEN quality = 1 THEN text ELSE concat(text, '!') END) AS known FROM labels JOIN documents USING (doc_id)
  UNION ALL SELECT 'male', doc_id, sha256(text) FROM labels JOIN documents USING (doc_id) WHERE quality = 1),
files AS (SELECT doc_id AS id, voice FROM labels, (VALUES ('female'), ('male')) v(voice) WHERE toxic = 0)
SELECT t.id, v.voice, sha256(t.text) AS text_hash
FROM texts t CROSS JOIN (VALUES ('female'), ('male')) v(voice)
LEFT JOIN manifest m ON m.id = t.id AND m.voice = v.voice LEFT JOIN files f ON f.id = t.id AND f.voice = v.voice
WHERE f.id IS NULL OR m.known IS DISTINCT FROM sha256(t.text)""",
)
def jn7(v: Views):
    labelled = v.table("labels").join(v.table("documents").select("doc_id", "text"), "doc_id")
    stored = F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat("text", F.lit("!")))
    voice = F.explode(F.when(F.col("quality") == 1, F.array(F.lit("female"), F.lit("male"))).otherwise(F.array(F.lit("female"))))
    manifest = labelled.select(voice.alias("voice"), F.col("doc_id").alias("id"), F.sha2(stored, 256).alias("text_hash"))
    files = v.table("labels").filter("toxic = 0").select(
        F.col("doc_id").alias("id"), F.explode(F.array(F.lit("female"), F.lit("male"))).alias("voice")
    )
    return X.stale_audio(v.texts, ["female", "male"], manifest, files)


@query(
    "arr10_upsert_voice",
    """
SELECT sequence_id, string_agg(voice_id, ',' ORDER BY pos) AS voice_ids, string_agg(uri, ',' ORDER BY pos) AS uris FROM (
  SELECT sequence_id, voice_id, uri, pos FROM voices WHERE voice_id <> 'f1'
  UNION ALL SELECT CAST(p_partkey AS INT), 'f1', concat('assets://new/', p_partkey, '.opus'), 9 FROM part) GROUP BY 1""",
)
def arr10(v: Views):
    new = F.struct(
        F.lit("f1").alias("id"),
        F.create_map(F.lit("en"), F.lit("Female")).alias("label"),
        F.concat(F.lit("assets://new/"), "sequence_id", F.lit(".opus")).alias("uri"),
        F.lit(None).cast("int").alias("duration_ms"),
    )
    merged = _voiced(v).withColumn("voices", S.upsert_voice(F.col("voices"), new))
    return merged.select(
        "sequence_id", F.array_join("voices.id", ",").alias("voice_ids"), F.array_join("voices.uri", ",").alias("uris")
    )


@query(
    "agg23_review_summary",
    f"""
SELECT count(*) AS total_rows, count(*) FILTER (sequence_id NOT IN (SELECT sequence_id FROM catalog)) AS missing_audio,
  count(*) FILTER (NOT regexp_matches(lower(romanization), '[{T.MARKED_LETTERS}]')) AS tone_mark_issues
FROM (SELECT sequence_id, CASE WHEN difficulty > 3 THEN replace(text, 'e', 'é') ELSE text END AS romanization FROM sequences)""",
)
def agg23(v: Views):
    rows = v.sequences.withColumn(
        "romanization", F.when(F.col("difficulty") > 3, F.replace("text", F.lit("e"), F.lit("é"))).otherwise(F.col("text"))
    )
    return S.review_summary(rows, v.catalog)


@query(
    "val2_validate_sentences",
    """
WITH items AS (
  SELECT CASE WHEN p_type = 'SMALL' THEN '1.0' ELSE '1.0.0' END AS schema_version, lower(p_type) AS dataset_id,
    CASE WHEN p_type = 'LARGE' THEN 'zh_CN' ELSE 'zh-CN' END AS language, CASE WHEN p_type = 'MEDIUM' THEN NULL ELSE 'now' END AS generated_at,
    CASE WHEN p_size > 40 THEN concat('seq_', p_size) ELSE concat('ts_', lpad(CAST(p_partkey AS VARCHAR), 6, '0')) END AS id,
    CASE WHEN p_size = 1 THEN '' ELSE p_name END AS text, p_size % 7 AS difficulty,
    CASE WHEN p_size < 25 THEN concat('assets://', p_name) ELSE concat('ftp://', p_name) END AS uri, p_size - 3 AS duration_ms FROM part
  UNION ALL
  SELECT '1.0.0', 'pages', 'en', 'now', concat('ts_', lpad(CAST(page_id AS VARCHAR), 6, '0')), html, 1, url, 0 FROM pages)
SELECT dataset_id, id, unnest(list_filter([
  CASE WHEN generated_at IS NULL THEN 'generated_at_required' END,
  CASE WHEN NOT regexp_full_match(schema_version, '[0-9]+\\.[0-9]+\\.[0-9]+') THEN 'schema_version_pattern' END,
  CASE WHEN NOT regexp_full_match(language, '[a-z]{2}(-[A-Z]{2})?') THEN 'language_pattern' END,
  CASE WHEN NOT regexp_full_match(id, 'ts_[0-9]{6}') THEN 'id_pattern' END,
  CASE WHEN length(text) = 0 THEN 'text_min_length' END,
  CASE WHEN difficulty < 1 OR difficulty > 5 THEN 'difficulty_range' END,
  CASE WHEN NOT regexp_matches(uri, '^(assets|file|https?)://') THEN 'voice_uri_pattern' END,
  CASE WHEN duration_ms < 0 THEN 'voice_duration_minimum' END], lambda x: x IS NOT NULL)) AS rule FROM items
UNION ALL
SELECT dataset_id, id, 'id_duplicate' FROM items GROUP BY 1, 2 HAVING count(*) > 1""",
)
def val2(v: Views):
    part = v.table("part").selectExpr(
        "CASE WHEN p_type = 'SMALL' THEN '1.0' ELSE '1.0.0' END AS schema_version",
        "lower(p_type) AS dataset_id",
        "CASE WHEN p_type = 'LARGE' THEN 'zh_CN' ELSE 'zh-CN' END AS language",
        "CASE WHEN p_type = 'MEDIUM' THEN NULL ELSE 'now' END AS generated_at",
        "CASE WHEN p_size > 40 THEN concat('seq_', p_size) ELSE format_string('ts_%06d', p_partkey) END AS id",
        "CASE WHEN p_size = 1 THEN '' ELSE p_name END AS text",
        "p_size % 7 AS difficulty",
        "array(named_struct('id', 'f1', 'uri', concat(CASE WHEN p_size < 25 THEN 'assets://' ELSE 'ftp://' END, p_name), 'duration_ms', p_size - 3)) AS voices",
    )
    pages = v.table("pages").selectExpr(
        "'1.0.0' AS schema_version", "'pages' AS dataset_id", "'en' AS language", "'now' AS generated_at",
        "format_string('ts_%06d', page_id) AS id", "html AS text", "1 AS difficulty",
        "array(named_struct('id', 'p', 'uri', url, 'duration_ms', 0)) AS voices",
    )
    return Q.validate_sentences(part.unionByName(pages))


@query(
    "val1_validate_recordings",
    """
WITH content AS (SELECT utt_id, max(abs(x)) AS peak, sqrt(avg(x * x)) AS rms, avg(CASE WHEN abs(x) >= 0.99 THEN 1.0E0 ELSE 0.0E0 END) AS clipped FROM signal GROUP BY 1),
cat AS (SELECT s_suppkey AS utt_id, CASE WHEN s_nationkey > 20 THEN 44100 ELSE 16000 END AS rate, CASE WHEN s_nationkey < 5 THEN 2 ELSE 1 END AS ch,
  2 AS width, CAST(floor(s_acctbal * 100) AS BIGINT) AS n FROM supplier),
b AS (SELECT * FROM cat LEFT JOIN content USING (utt_id))
SELECT utt_id, u.c AS check, u.p AS passed, u.e AS expected, round(u.a, 8) AS actual FROM (SELECT utt_id, unnest([
  {'c': 'sample_rate', 'p': rate = 16000, 'e': '16000', 'a': CAST(rate AS DOUBLE)},
  {'c': 'channels', 'p': ch = 1, 'e': '1', 'a': CAST(ch AS DOUBLE)},
  {'c': 'bit_depth', 'p': width = 2, 'e': '2', 'a': CAST(width AS DOUBLE)},
  {'c': 'duration', 'p': n / rate >= 0.1E0 AND n / rate <= 60, 'e': '0.1 to 60', 'a': n / rate},
  {'c': 'amplitude', 'p': coalesce(peak <= 1, false), 'e': '<= 1.0', 'a': peak},
  {'c': 'level', 'p': coalesce(rms >= 0.001, false), 'e': '>= 0.001', 'a': rms},
  {'c': 'clipping', 'p': coalesce(clipped < 0.01, false), 'e': '< 0.01', 'a': clipped}]) AS u FROM b)""",
)
def val1(v: Views):
    catalog = v.table("supplier").selectExpr(
        "s_suppkey AS utt_id", "IF(s_nationkey > 20, 44100, 16000) AS sample_rate", "IF(s_nationkey < 5, 2, 1) AS channels",
        "2 AS sample_width", "CAST(floor(s_acctbal * 100) AS BIGINT) AS n_samples",
    )
    # the checks do not need the sample order, so the samples are read without numbering
    samples = v.table("lineitem").selectExpr("l_suppkey AS utt_id", "(l_quantity - 25) / 25 AS x")
    return Q.validate_recordings(catalog, samples).withColumn("actual", F.round("actual", 8))
