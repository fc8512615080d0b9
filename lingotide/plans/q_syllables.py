"""Syllable annotation, lexicon and synthetic-corpus queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingotide.functions import pinyin as PY
from lingotide.operators import corpus as C
from lingotide.operators import syllables as SY
from lingotide.operators.blocks import number_rows
from lingotide.plans.registry import query
from lingotide.plans.views import Views, word_case

SANDHI_SQL = """
r1 AS (SELECT *, CASE WHEN tone = 3 AND lead(tone) OVER (PARTITION BY sentence_id ORDER BY idx) = 3 THEN 2 ELSE tone END AS s1 FROM syllables),
r2 AS (SELECT *, CASE WHEN base = 'yi' AND tone = 1 THEN CASE lead(s1) OVER (PARTITION BY sentence_id ORDER BY idx)
  WHEN 4 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 4 WHEN 3 THEN 4 ELSE s1 END ELSE s1 END AS s2 FROM r1),
sandhi AS (SELECT sentence_id, idx, base, tone, s1, s2, CASE WHEN base = 'bu' AND tone = 4 AND lead(s2) OVER (PARTITION BY sentence_id ORDER BY idx) = 4
  THEN 2 ELSE s2 END AS surface FROM r2)"""

VOICES = ["economy", "large"]
VOICE = "economy"


def _sandhi(v: Views, keep_block: str | None = None):
    return SY.apply_sandhi(v.syllables, "sentence_id", keep_block=keep_block)


@query("win6_sandhi_third", f"WITH {SANDHI_SQL} SELECT sentence_id, idx, base, tone, s1 AS surface FROM sandhi")
def win6(v: Views):
    return SY.apply_sandhi(v.syllables, "sentence_id", ("third",))


@query("win7_sandhi_yi", f"WITH {SANDHI_SQL} SELECT sentence_id, idx, base, tone, s2 AS surface FROM sandhi")
def win7(v: Views):
    return SY.apply_sandhi(v.syllables, "sentence_id", ("third", "yi"))


@query("win8_apply_sandhi", f"WITH {SANDHI_SQL} SELECT sentence_id, idx, base, tone, surface FROM sandhi")
def win8(v: Views):
    return _sandhi(v)


def _nested(v: Views):
    """Sentences with their syllables as array<struct<base, tone>>."""
    n = "length(w) % 8"
    return v.sentences.selectExpr(
        "sentence_id",
        f"transform(words, w -> named_struct('base', {word_case(0, n)}, 'tone', {word_case(1, n)})) AS syllables",
    )


@query(
    "win12_with_context",
    """
WITH b AS (SELECT sentence_id, list(base ORDER BY idx) AS bases FROM syllables GROUP BY 1)
SELECT s.sentence_id, s.idx, s.base, s.idx AS n_context, md5(array_to_string(b.bases[1:s.idx], ' ')) AS context_hash
FROM syllables s JOIN b USING (sentence_id)""",
)
def win12(v: Views):
    rows = SY.with_context(_nested(v), "sentence_id")
    return rows.select(
        "sentence_id", "idx", "base", F.size("context").alias("n_context"), F.md5(F.array_join("context", " ")).alias("context_hash")
    )


@query(
    "arr11_training_rows",
    """
SELECT sentence_id, idx, base AS target_base, tone AS target_tone, CAST(count(*) OVER (PARTITION BY sentence_id) AS INT) AS n_syllables, idx AS n_context
FROM syllables""",
)
def arr11(v: Views):
    rows = SY.training_rows(_nested(v), "sentence_id")
    return rows.select("sentence_id", "idx", "target_base", "target_tone", "n_syllables", F.size("context").alias("n_context"))


@query(
    "str9_explode_syllables",
    f"""
SELECT sentence_id, idx, {word_case(3)} AS hanzi, {word_case(2)} AS pinyin, {word_case(0)} AS base,
  regexp_extract({word_case(0)}, '^(zh|ch|sh|[bpmfdtnlgkhjqxzcsryw])?(.*)$', 1) AS initial,
  regexp_extract({word_case(0)}, '^(zh|ch|sh|[bpmfdtnlgkhjqxzcsryw])?(.*)$', 2) AS final, {word_case(1)} AS tone
FROM (SELECT sentence_id, CAST(generate_subscripts(words, 1) - 1 AS INT) AS idx, length(unnest(words)) % 8 AS n FROM sentences)""",
)
def str9(v: Views):
    return SY.explode_syllables(v.romanized, "sentence_id", "hanzi", "romanization")


MARK = f"[{PY.MARKED}]"
VOWEL = f"aeiouü{PY.MARKED}"


@query(
    "str9_unspaced_syllables",
    f"""
WITH rom AS (SELECT sentence_id, len(words) AS n, list_transform(words, lambda w: {word_case(3, 'length(w) % 8')}) AS hs,
    array_to_string(list_transform(words, lambda w: {word_case(2, 'length(w) % 8')}), '') AS j FROM sentences),
marked AS (SELECT *, list_filter(range(1, length(j) + 1), lambda k: regexp_matches(substr(j, k, 1), '{MARK}')) AS marks,
    list_filter(range(2, length(j) + 1), lambda k: substr(j, k, 2) IN ('zh', 'ch', 'sh') OR regexp_matches(substr(j, k - 1, 2), '^[ng{VOWEL}][{PY.LETTER_INITIALS}]')) AS inits FROM rom),
stem AS (SELECT *, list_transform(marks, lambda k: k + length(regexp_extract(substr(j, k + 1, 40), '^[aeiouü]*'))) AS vs FROM marked),
cut AS (SELECT sentence_id, n, hs, j, CASE WHEN n = 1 THEN [0]
    WHEN len(marks) = n THEN [0] || list_transform(vs[1:n - 1], lambda k: k + CASE WHEN regexp_matches(substr(j, k + 1, 3), '^ng([^{VOWEL}]|$)') THEN 2
      WHEN regexp_matches(substr(j, k + 1, 2), '^(n([^g{VOWEL}]|$)|r([^{VOWEL}]|$))') THEN 1 ELSE 0 END)
    WHEN len(inits) + 1 = n THEN [0] || list_transform(inits, lambda k: k - 1)
    ELSE list_transform(range(n), lambda k: k * greatest(1, length(j) // n)) END AS starts FROM stem),
piece AS (SELECT sentence_id, i - 1 AS idx, hs[i] AS hanzi, CASE WHEN i < n THEN substr(j, starts[i] + 1, starts[i + 1] - starts[i]) ELSE substr(j, starts[i] + 1) END AS pinyin
    FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM cut))
SELECT sentence_id, CAST(idx AS INT) AS idx, hanzi, pinyin,
  CASE WHEN regexp_matches(pinyin, '{MARK}') THEN (strpos('{PY.MARKED}', regexp_extract(pinyin, '.*({MARK})', 1)) - 1) % 4 + 1 ELSE 0 END AS tone FROM piece""",
)
def str9_unspaced(v: Views):
    """The same sentences written without spaces, which sends every longer one through the splitter."""
    unspaced = v.romanized.withColumn("romanization", F.translate("romanization", " ", ""))
    return SY.explode_syllables(unspaced, "sentence_id", "hanzi", "romanization").select(
        "sentence_id", "idx", "hanzi", "pinyin", "tone"
    )


@query(
    "str10_parse_numbered",
    f"""
SELECT sentence_id, CAST(generate_subscripts(toks, 1) - 1 AS INT) AS idx, regexp_replace(lower(unnest(toks)), '^([a-zü]+)[0-9]$', '\\1') AS base,
  unnest(list_transform(toks, lambda t: CASE WHEN regexp_full_match(t, '[a-zA-ZüÜ]+[0-4]') THEN CAST(right(t, 1) AS INT) ELSE 0 END)) AS tone
FROM (SELECT sentence_id, list_transform(words, lambda w: concat({word_case(0, 'length(w) % 8')}, CASE WHEN length(w) < 8 THEN CAST(length(w) AS VARCHAR)
  WHEN length(w) < 10 THEN '' ELSE '-x' END)) AS toks FROM sentences)""",
)
def str10(v: Views):
    token = f"concat({word_case(0, 'length(w) % 8')}, CASE WHEN length(w) < 8 THEN CAST(length(w) AS STRING) WHEN length(w) < 10 THEN '' ELSE '-x' END)"
    text = v.sentences.selectExpr("sentence_id", f"array_join(transform(words, w -> {token}), ' ') AS pinyin")
    return SY.read_numbered(text, "sentence_id", "pinyin")


WORDS_SQL = """
words AS (SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[ \\n.,]+')) AS w FROM documents) WHERE w <> '' GROUP BY 1)"""


def _words(v: Views):
    """Distinct lower-case words of the documents with their counts."""
    return (
        v.table("documents")
        .select(F.explode(F.split(F.lower("text"), "[ \\n.,]+")).alias("word"))
        .filter("word <> ''")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "str6_base_pinyin",
    f"""WITH {WORDS_SQL}
SELECT word, n, regexp_replace(translate(word, '{PY.MARKED}', '{PY.PLAIN}'), '[0-9]$', '') AS plain,
  replace(replace(translate(word, '{PY.MARKED}', '{PY.PLAIN}'), 'ü', 'u'), 'v', 'u') AS vocab,
  regexp_replace(replace(translate(word, '{PY.MARKED}', '{PY.PLAIN}'), 'v', 'ü'), '[0-9]$', '') AS corpus FROM words""",
)
def str6(v: Views):
    word = F.col("word")
    return _words(v).select(
        "word", "n", PY.base_pinyin(word).alias("plain"), PY.base_pinyin(word, "vocab").alias("vocab"),
        PY.base_pinyin(word, "corpus").alias("corpus"),
    )


TONE_SQL = f"""CASE WHEN regexp_matches(word, '[{PY.MARKED}]') THEN CAST(translate(regexp_extract(reverse(word), '[{PY.MARKED}]'), '{PY.MARKED}', '{PY.TONES}') AS INT)
  WHEN regexp_matches(word, '[0-4]$') THEN CAST(right(word, 1) AS INT) ELSE 0 END"""


@query(
    "str7_tone_of",
    f"""WITH {WORDS_SQL}
SELECT word, {TONE_SQL} AS last_tone,
  CASE WHEN regexp_matches(word, '[{PY.MARKED}]') THEN CAST(translate(regexp_extract(word, '[{PY.MARKED}]'), '{PY.MARKED}', '{PY.TONES}') AS INT) ELSE 0 END AS first_tone
FROM words""",
)
def str7(v: Views):
    word = F.col("word")
    return _words(v).select("word", PY.tone_of(word).alias("last_tone"), PY.tone_of(word, "first").alias("first_tone"))


@query(
    "str8_initial_final",
    f"""WITH {WORDS_SQL}
SELECT word, regexp_extract(word, '^(zh|ch|sh|[bpmfdtnlgkhjqxzcsryw])?', 1) AS initial,
  regexp_replace(word, '^(zh|ch|sh|[bpmfdtnlgkhjqxzcsryw])', '') AS final FROM words""",
)
def str8(v: Views):
    parts = PY.initial_final(F.col("word"))
    return _words(v).select("word", parts["initial"].alias("initial"), parts["final"].alias("final"))


def _list(values) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


VALID_SQL = f"""
valid AS (
  {' UNION '.join(f"SELECT concat(i, f) AS syllable FROM (SELECT unnest({_list(i)}) AS i), (SELECT unnest({_list(f)}) AS f)" for i, f in C.COMBINATIONS)}
  EXCEPT SELECT unnest({_list(C.NOT_SYLLABLES)}))"""


@query(
    "jn10_valid_syllables",
    f"""WITH {WORDS_SQL}, {VALID_SQL}
SELECT syllable, coalesce(n, 0) AS n_words FROM valid LEFT JOIN words ON word = syllable""",
)
def jn10(v: Views):
    """The valid-syllable table with how often each occurs as a word of the documents."""
    words = _words(v).withColumnRenamed("word", "syllable")
    return C.valid_syllables(v.spark).join(words, "syllable", "left").select(
        "syllable", F.coalesce("n", F.lit(0)).alias("n_words")
    )


def _overlay(position: str) -> str:
    arms = " ".join(f"WHEN '{v}' THEN substr('{m}', t, 1)" for v, m in PY.TONE_MARKS.items())
    marked = f"CASE substr(s, {position}, 1) {arms} END"
    return f"concat(substr(s, 1, {position} - 1), {marked}, substr(s, {position} + 1))"


@query(
    "str11_add_tone_mark",
    f"""WITH {WORDS_SQL}, {VALID_SQL},
st AS (SELECT syllable AS s, unnest([0, 1, 2, 3, 4, 5]) AS t FROM valid JOIN words ON word = syllable),
pos AS (SELECT *, CASE WHEN regexp_matches(s, '[ae]') THEN length(regexp_extract(s, '^[^ae]*')) + 1 WHEN contains(s, 'ou') THEN instr(s, 'o')
  ELSE length(regexp_extract(s, '^.*[iouü]')) END AS p FROM st)
SELECT s AS syllable, t AS tone, CASE WHEN t BETWEEN 1 AND 4 AND p > 0 THEN {_overlay('CAST(p AS INT)')} ELSE s END AS marked FROM pos""",
)
def str11(v: Views):
    seen = C.valid_syllables(v.spark).join(_words(v).select(F.col("word").alias("syllable")), "syllable", "left_semi")
    tones = seen.withColumn("tone", F.explode(F.array(*[F.lit(t) for t in range(6)])))
    return tones.withColumn("marked", PY.add_tone_mark(F.col("syllable"), F.col("tone")))


NEEDED_SQL = f"""{SANDHI_SQL},
needed AS (SELECT base, CASE WHEN surface <> 0 THEN surface ELSE tone END AS tone, count(*) AS n FROM sandhi GROUP BY 1, 2),
have AS (SELECT DISTINCT base, tone FROM lexicon WHERE voice_id = '{VOICE}'),
marked AS (SELECT n.*, h.base IS NOT NULL AS covered FROM needed n LEFT JOIN have h ON h.base = n.base AND h.tone = n.tone)"""


@query("agg7_syllable_frequency", f"WITH {NEEDED_SQL} SELECT base, tone, n FROM needed ORDER BY n DESC, base, tone")
def agg7(v: Views):
    return C.syllable_frequency(_sandhi(v))


@query(
    "agg8_coverage_summary",
    f"""WITH {NEEDED_SQL}
SELECT count(*) AS n_unique, count(*) FILTER (covered) AS n_covered, count(*) FILTER (NOT covered) AS n_missing,
  round(100.0 * count(*) FILTER (covered) / count(*), 6) AS coverage_pct, count(*) FILTER (covered AND n < 3) AS n_under_represented,
  CAST(sum(n) AS BIGINT) AS total_occurrences, (SELECT count(*) FROM sentences) AS total_sentences FROM marked""",
)
def agg8(v: Views):
    total = v.sentences.agg(F.count(F.lit(1)).alias("total_sentences"))
    return C.coverage_summary(_sandhi(v), v.lexicon, VOICE, total).withColumn("coverage_pct", F.round("coverage_pct", 6))


@query(
    "snk6_coverage_report",
    f"""WITH {NEEDED_SQL}, k AS (SELECT concat(base, tone) AS syllable, n, covered FROM marked)
SELECT * FROM (SELECT 'missing' AS section, syllable, n FROM k WHERE NOT covered ORDER BY syllable LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'under_represented', syllable, n FROM k WHERE covered AND n < 3 ORDER BY n, syllable LIMIT 30)
UNION ALL SELECT * FROM (SELECT 'most_frequent', syllable, n FROM k ORDER BY n DESC, syllable LIMIT 20)""",
)
def snk6_coverage(v: Views):
    return C.coverage_report(_sandhi(v), v.lexicon, VOICE)


@query("agg9_unique_syllables", "SELECT DISTINCT base, tone FROM syllables ORDER BY 1, 2")
def agg9(v: Views):
    return C.unique_syllables(v.syllables)


@query(
    "agg6_lexicon_counts",
    """
SELECT u.d AS dimension, u.v AS value, count(*) AS n FROM (SELECT unnest([{'d': 'voice', 'v': voice_id}, {'d': 'tone', 'v': CAST(tone AS VARCHAR)},
  {'d': 'syllable', 'v': concat(base, tone)}, {'d': 'base', 'v': base}]) AS u FROM lexicon) GROUP BY 1, 2""",
)
def agg6_counts(v: Views):
    return C.lexicon_counts(v.lexicon)


@query(
    "agg6_lexicon_stats",
    """
SELECT count(*) AS n_entries, count(DISTINCT (base, tone)) AS n_syllables, count(DISTINCT base) AS n_bases, count(DISTINCT voice_id) AS n_voices,
  coalesce(min(duration_ms) FILTER (duration_ms > 0), 0) AS min_ms, coalesce(max(duration_ms) FILTER (duration_ms > 0), 0) AS max_ms,
  round(coalesce(avg(duration_ms) FILTER (duration_ms > 0), 0), 6) AS mean_ms FROM lexicon""",
)
def agg6_stats(v: Views):
    return C.lexicon_stats(v.lexicon).withColumn("mean_ms", F.round("mean_ms", 6))


LOOKUP_SQL = f"""{SANDHI_SQL},
looked AS (
  SELECT s.sentence_id, v.voice_id, s.idx, s.base, s.tone, s.surface, coalesce(a.duration_ms, b.duration_ms) AS duration_ms
  FROM sandhi s CROSS JOIN (VALUES ('economy'), ('large')) v(voice_id)
  LEFT JOIN lexicon a ON a.voice_id = v.voice_id AND a.base = s.base AND a.tone = s.surface
  LEFT JOIN lexicon b ON b.voice_id = v.voice_id AND b.base = s.base AND b.tone = s.tone)"""


@query(
    "jn5_lookup_audio",
    f"WITH {LOOKUP_SQL} SELECT sentence_id, voice_id, idx, base, surface, duration_ms FROM looked WHERE duration_ms IS NOT NULL",
)
def jn5(v: Views):
    return C.lookup_audio(_sandhi(v), v.lexicon, VOICES).select(
        "sentence_id", "voice_id", "idx", "base", "surface", "duration_ms"
    )


@query("jn6_covered_keys", f"WITH {NEEDED_SQL} SELECT base, tone, n FROM marked WHERE covered")
def jn6_covered(v: Views):
    return C.covered_keys(_sandhi(v), v.lexicon, VOICE)


@query("jn6_missing_keys", f"WITH {NEEDED_SQL} SELECT base, tone, n FROM marked WHERE NOT covered")
def jn6_missing(v: Views):
    return C.missing_keys(_sandhi(v), v.lexicon, VOICE)


# vocabulary: the lexicon's bases in order, ids from 2; words outside it are unknown
VOCAB_SQL = "vocab AS (SELECT base AS syllable, CAST(row_number() OVER (ORDER BY base) AS INT) + 1 AS token_id FROM (SELECT DISTINCT base FROM lexicon))"


def _vocab(v: Views):
    bases = v.lexicon.select(F.col("base").alias("syllable")).distinct()
    numbered = number_rows(bases, [], ["syllable"], F.ascii("syllable"), "no")
    return numbered.select("syllable", (F.col("no") + C.FIRST_SYLLABLE).cast("int").alias("token_id"))


@query(
    "jn8_encode",
    f"""WITH {VOCAB_SQL}
SELECT sentence_id, idx + 1 AS pos, coalesce(token_id, 0) AS token_id FROM syllables LEFT JOIN vocab ON base = syllable
UNION ALL SELECT DISTINCT sentence_id, 0, 1 FROM syllables""",
)
def jn8_encode(v: Views):
    return C.encode(v.syllables, _vocab(v), "sentence_id")


@query(
    "jn8_decode",
    f"""WITH {VOCAB_SQL}, ids AS (SELECT sentence_id, idx, CAST(length(base) * 3 - 6 + idx % 2 AS INT) AS token_id FROM syllables)
SELECT sentence_id, idx, ids.token_id, CASE ids.token_id WHEN 0 THEN '<PAD>' WHEN 1 THEN '<BOS>' ELSE coalesce(syllable, '<UNK>') END AS syllable
FROM ids LEFT JOIN vocab ON vocab.token_id = ids.token_id""",
)
def jn8_decode(v: Views):
    ids = v.syllables.select("sentence_id", "idx", (F.length("base") * 3 - 6 + F.col("idx") % 2).alias("token_id"))
    return C.decode(ids, _vocab(v))


@query(
    "jn8_ctc_targets",
    f"""WITH {SANDHI_SQL}, {VOCAB_SQL}
SELECT sentence_id, idx, greatest(1, coalesce(token_id, 0) - 1) AS syllable_target, surface + 1 AS tone_target FROM sandhi LEFT JOIN vocab ON base = syllable""",
)
def jn8_ctc(v: Views):
    return C.ctc_targets(_sandhi(v), _vocab(v), "sentence_id")


@query(
    "jn9_expand_samples",
    """
SELECT sentence_id, voice_id, CAST(aug AS INT) AS aug, concat(sentence_id, '_', voice_id, CASE WHEN aug < 0 THEN '' ELSE concat('_aug', aug) END) AS sample_id,
  aug >= 0 AS augmented, aug >= 0 AND aug % 2 = 0 AS noisy
FROM sentences, (VALUES ('economy'), ('large')) v(voice_id), range(-1, 2) r(aug)""",
)
def jn9(v: Views):
    return C.expand_samples(v.sentences.select("sentence_id"), "sentence_id", VOICES, 2)


TIMELINE_SQL = f"""{LOOKUP_SQL},
placed AS (SELECT *, duration_ms * 16 AS len, row_number() OVER w AS nth FROM looked WHERE duration_ms IS NOT NULL WINDOW w AS (PARTITION BY sentence_id, voice_id ORDER BY idx))"""


@query(
    "win13_timeline_gap",
    f"""WITH {TIMELINE_SQL},
t AS (SELECT *, sum(len + CASE WHEN idx > 0 THEN 320 ELSE 0 END) OVER (PARTITION BY sentence_id, voice_id ORDER BY idx) AS stop FROM placed)
SELECT sentence_id, voice_id, idx, CAST(floor((stop - len) / 16000.0E0 * 1000) AS INT) AS start_ms, CAST(floor(stop / 16000.0E0 * 1000) AS INT) AS end_ms, 1.0E0 AS confidence FROM t""",
)
def win13_gap(v: Views):
    return C.timeline(_sandhi(v, "block"), v.lexicon, "sentence_id", VOICES, gap_ms=20, block="block")


@query(
    "win13_timeline_crossfade",
    f"""WITH {TIMELINE_SQL},
t AS (SELECT *, sum(len) OVER (PARTITION BY sentence_id, voice_id ORDER BY idx) - 240 * (nth - 1) AS stop FROM placed)
SELECT sentence_id, voice_id, idx, CAST(floor((stop - len) / 16000.0E0 * 1000) AS INT) AS start_ms, CAST(floor(stop / 16000.0E0 * 1000) AS INT) AS end_ms, 1.0E0 AS confidence FROM t""",
)
def win13_crossfade(v: Views):
    return C.timeline(_sandhi(v, "block"), v.lexicon, "sentence_id", VOICES, crossfade_ms=15, block="block")


@query(
    "agg10_synth_stats",
    f"""WITH {LOOKUP_SQL},
per AS (SELECT sentence_id, voice_id, count(duration_ms) > 0 AS ok FROM looked GROUP BY 1, 2),
good AS (SELECT l.surface FROM looked l JOIN per USING (sentence_id, voice_id) WHERE ok),
tot AS (SELECT 3 * count(*) FILTER (ok) AS total_samples, count(*) FILTER (NOT ok) AS failed FROM per)
SELECT CAST(t AS INT) AS tone, 3 * count(surface) AS n, round(100.0 * count(surface) / greatest((SELECT count(*) FROM good), 1), 6) AS pct,
  3 * (SELECT count(*) FROM good) AS total_syllables, total_samples, failed
FROM range(5) r(t) CROSS JOIN tot LEFT JOIN good ON surface = t GROUP BY t, total_samples, failed""",
)
def agg10(v: Views):
    return C.synth_stats(_sandhi(v), v.lexicon, "sentence_id", VOICES, 2).withColumn("pct", F.round("pct", 6))


# utterances that even the smallest prediction table has; the sentences of a document are takes of one of them
UTTERANCES = 62


@query(
    "jn12_pair_by_position",
    f"""
SELECT s.sentence_id, s.idx, s.base, p.predicted FROM syllables s
JOIN predictions p ON p.utt_id = s.sentence_id // 100000 % {UTTERANCES} AND p.idx = s.idx""",
)
def jn12(v: Views):
    """Every sentence with the scores of its utterance; syllables beyond the last score are dropped."""
    takes = v.syllables.withColumn("utt_id", F.expr(f"sentence_id div 100000 % {UTTERANCES}"))
    return C.pair_by_position(takes, v.predictions.select("utt_id", "idx", "predicted"), "utt_id").select("sentence_id", "idx", "base", "predicted")
