"""Domain-shaped views over the base tables, in Spark and in SQL.

``Views`` gives each shape as a DataFrame; ``VIEW_SQL`` states the same rows for the SQL check.
All views cover their base tables in full.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingotide.operators.blocks import block_of, number_rows
from lingotide.session import spread, staged

TODAY = "2024-01-31"

# One syllable per word-length class (length mod 8).
WORD_CLASSES = [
    ("ni", 3, "nǐ", "你"),
    ("yi", 1, "yī", "一"),
    ("bu", 4, "bù", "不"),
    ("hao", 3, "hǎo", "好"),
    ("shi", 4, "shì", "是"),
    ("wo", 3, "wǒ", "我"),
    ("de", 0, "de", "的"),
    ("tian", 1, "tiān", "天"),
]
# Lexicon keys by part size class (size mod 9); tian1 is left out on purpose.
LEXICON_KEYS = [
    ("ni", 3), ("ni", 2), ("yi", 1), ("yi", 4), ("bu", 4), ("hao", 3), ("shi", 4), ("wo", 3), ("de", 0),
]


def _case(subject: str, values: list) -> str:
    quoted = [f"'{v}'" if isinstance(v, str) else str(v) for v in values]
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(quoted[:-1]))
    return f"CASE {subject} {arms} ELSE {quoted[-1]} END"


def word_case(col: int, subject: str = "n") -> str:
    """SQL CASE giving column ``col`` of WORD_CLASSES for a word class."""
    return _case(subject, [w[col] for w in WORD_CLASSES])


ATTEMPTS = """
SELECT event_id AS attempt_id, event_id AS arrival_seq, user_id AS learner_id,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS sequence_id, ts AS graded_at,
  CASE event_type WHEN 'error' THEN 'hard' WHEN 'view' THEN 'almost' WHEN 'click' THEN 'good' ELSE 'easy' END AS rating
FROM events WHERE event_type <> 'signup'"""

TOGGLES = """
SELECT event_id AS arrival_seq, user_id AS learner_id,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS sequence_id, ts AS toggled_at
FROM events WHERE event_type = 'signup'"""

SEQUENCES = """
SELECT CAST(p_partkey AS INT) AS sequence_id, p_name AS text,
  CASE WHEN p_type = 'PROMO' THEN NULL ELSE 1 + p_size % 6 END AS level, 1 + p_size % 5 AS difficulty,
  {array_open}lower(p_type), concat('hsk', CAST(p_size % 8 AS {string})){array_close} AS tags
FROM part"""

TEXTS = "SELECT doc_id AS id, text, lang AS language, source FROM documents"

TEXT_PAIRS = """
SELECT a.p_partkey AS id, a.p_name AS ref, CASE WHEN a.p_type = 'PROMO' THEN NULL ELSE b.p_name END AS hyp
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"""

UTTERANCES = """
SELECT c_custkey AS utt_id, c_nationkey AS speaker, CAST(8000 + floor(abs(c_acctbal) * 10) AS BIGINT) AS n_samples,
  CAST(1 + c_custkey % 12 AS INT) AS n_syllables FROM customer"""

CATALOG = """
SELECT CAST(CASE WHEN p_type = 'PROMO' THEN 1000000000 + p_partkey ELSE p_partkey END AS INT) AS sequence_id,
  'wav' AS ext, concat('recordings/', p_partkey, '.wav') AS path FROM part WHERE p_size > 20
UNION ALL
SELECT CAST(CASE WHEN p_type = 'PROMO' THEN 1000000000 + p_partkey ELSE p_partkey END AS INT) AS sequence_id,
  'm4a' AS ext, concat('recordings/', p_partkey, '.m4a') AS path FROM part WHERE p_size BETWEEN 10 AND 35"""

VOICES = """
SELECT CAST(p_partkey AS INT) AS sequence_id, 'f1' AS voice_id,
  concat('assets://examples/female/', CAST(p_partkey AS {string}), '.opus') AS uri, 0 AS pos FROM part WHERE p_size > 5
UNION ALL
SELECT CAST(p_partkey AS INT) AS sequence_id, 'm1' AS voice_id,
  concat('assets://examples/male/', CAST(p_partkey AS {string}), '.opus') AS uri, 1 AS pos FROM part WHERE p_size <= 45"""

LEXICON_ENTRIES = f"""
SELECT lower(p_type) AS voice_id, {_case('p_size % 9', [k[0] for k in LEXICON_KEYS])} AS base,
  {_case('p_size % 9', [k[1] for k in LEXICON_KEYS])} AS tone, 200 + 7 * p_size AS duration_ms, p_partkey AS pos
FROM part"""

PREDICTIONS = """
SELECT concat('s', CAST(vec_id % 2 AS {string})) AS scorer, CAST(floor(vec_id / 8) AS BIGINT) AS utt_id, CAST(vec_id % 8 AS INT) AS idx,
  label % 5 AS expected, CAST((label + vec_id % 3) % 5 AS INT) AS predicted, (vec_id % 97) / 97.0E0 AS confidence
FROM embeddings"""

VIEW_SQL: dict[str, str] = {
    "attempts": ATTEMPTS,
    "toggles": TOGGLES,
    "sequences": SEQUENCES.format(array_open="[", array_close="]", string="VARCHAR"),
    "texts": TEXTS,
    "text_pairs": TEXT_PAIRS,
    "utterances": UTTERANCES,
    "catalog": CATALOG,
    "voices": VOICES.format(string="VARCHAR"),
    "predictions": PREDICTIONS.format(string="VARCHAR"),
    "pairs": """
SELECT learner_id, sequence_id FROM attempts UNION SELECT learner_id, sequence_id FROM toggles""",
    "lexicon_entries": LEXICON_ENTRIES,
    "lexicon": """
SELECT voice_id, base, tone, arg_max(duration_ms, pos) AS duration_ms FROM lexicon_entries GROUP BY 1, 2, 3""",
    # (sentence, word list) over whole documents
    "sentences": r"""
SELECT doc_id * 100000 + sent_no AS sentence_id, doc_id, list_filter(string_split(sent, ' '), lambda w: w <> '') AS words
FROM (SELECT doc_id, generate_subscripts(s, 1) - 1 AS sent_no, unnest(s) AS sent
      FROM (SELECT doc_id, string_split_regex(text, '[.\n]+') AS s FROM documents))
WHERE len(list_filter(string_split(sent, ' '), lambda w: w <> '')) > 0""",
    "syllables": f"""
SELECT sentence_id, idx, {word_case(0)} AS base, {word_case(1)} AS tone
FROM (SELECT sentence_id, CAST(generate_subscripts(words, 1) - 1 AS INT) AS idx, length(unnest(words)) % 8 AS n FROM sentences)""",
    "romanized": f"""
SELECT sentence_id, array_to_string(list_transform(words, lambda w: {word_case(3, 'length(w) % 8')}), '') AS hanzi,
  array_to_string(list_transform(words, lambda w: {word_case(2, 'length(w) % 8')}), ' ') AS romanization
FROM sentences""",
    "interleaved": f"""
SELECT sentence_id, concat(CAST(sentence_id AS VARCHAR), '.wav', chr(9), array_to_string(list_transform(words,
  lambda w: concat('x ', {word_case(0, 'length(w) % 8')}, CAST({word_case(1, 'length(w) % 8')} AS VARCHAR))), ' ')) AS value
FROM sentences""",
    "frames": """
SELECT user_id AS utt_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) - 1 AS frame_idx,
  CASE WHEN event_type = 'error' THEN 0.0E0 ELSE 50 + value END AS f0_hz,
  CASE WHEN event_type = 'error' THEN 0.0E0 ELSE (event_id % 50 + 50) / 100.0E0 END AS voicing,
  value / 500 AS energy,
  CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS token,
  (event_id % 100) / 100.0E0 AS prob
FROM events""",
    # syllables per utterance of the frames view: 2..5
    "frame_targets": """
SELECT utt_id, CAST(2 + utt_id % 4 AS INT) AS n_syllables, max(frame_idx) + 1 AS n_frames FROM frames GROUP BY utt_id""",
    "logits": """
SELECT CAST(floor(vec_id / 10) AS BIGINT) AS utt_id, CAST(vec_id % 10 AS INT) AS frame,
  CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS token, CAST(unnest(embedding) AS DOUBLE) AS logit, label AS target
FROM embeddings""",
    "probs": """
SELECT utt_id, frame, token, target, logit, exp(logit - max(logit) OVER w) / sum(exp(logit - mx)) OVER w AS prob
FROM (SELECT *, max(logit) OVER (PARTITION BY utt_id, frame) AS mx FROM logits)
WINDOW w AS (PARTITION BY utt_id, frame)""",
    "contours": """
SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f0_norm, CAST(50 + vec_id % 400 AS INT) AS duration_ms,
  (vec_id % 100) / 100.0E0 AS voicing_ratio, label % 5 AS tone FROM embeddings""",
    # embeddings cut into token ids 0..4
    "token_lists": """
SELECT vec_id AS utt_id, list_transform(embedding, lambda x: CASE WHEN CAST(x AS DOUBLE) < -0.12E0 THEN 0
  WHEN CAST(x AS DOUBLE) < -0.03E0 THEN 1 WHEN CAST(x AS DOUBLE) < 0.03E0 THEN 2 WHEN CAST(x AS DOUBLE) < 0.12E0 THEN 3 ELSE 4 END) AS toks
FROM embeddings""",
    "token_pairs": """
SELECT a.utt_id, a.toks AS ref, b.toks AS hyp FROM token_lists a JOIN token_lists b ON b.utt_id = a.utt_id + 1""",
    "signal": """
SELECT l_suppkey AS utt_id,
  CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS INT) - 1 AS sample_idx,
  (l_quantity - 25) / 25 AS x FROM lineitem""",
}


def with_views(sql: str) -> str:
    """Prefix a SQL text with the view definitions it refers to."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEW_SQL.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text, re.IGNORECASE):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in needed)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


class Views:
    """The same shapes as DataFrames over one table folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, text: str, *tables: str) -> DataFrame:
        return self.spark.sql(
            re.sub(r"\b(FROM|JOIN) (\w+)\b", r"\1 {\2}", text), **{t: self.table(t) for t in tables}
        )

    @cached_property
    def attempts(self) -> DataFrame:
        return self._sql(ATTEMPTS, "events")

    @cached_property
    def toggles(self) -> DataFrame:
        return self._sql(TOGGLES, "events")

    @cached_property
    def pairs(self) -> DataFrame:
        keys = ["learner_id", "sequence_id"]
        return self.attempts.select(*keys).union(self.toggles.select(*keys)).distinct()

    @cached_property
    def sequences(self) -> DataFrame:
        return self._sql(SEQUENCES.format(array_open="array(", array_close=")", string="STRING"), "part")

    @cached_property
    def texts(self) -> DataFrame:
        return spread(self._sql(TEXTS, "documents"))

    @cached_property
    def text_pairs(self) -> DataFrame:
        return self._sql(TEXT_PAIRS, "part")

    @cached_property
    def utterances(self) -> DataFrame:
        return self._sql(UTTERANCES, "customer")

    @cached_property
    def catalog(self) -> DataFrame:
        return self._sql(CATALOG, "part")

    @cached_property
    def voices(self) -> DataFrame:
        return self._sql(VOICES.format(string="STRING"), "part")

    @cached_property
    def predictions(self) -> DataFrame:
        return self._sql(PREDICTIONS.format(string="STRING"), "embeddings")

    @cached_property
    def lexicon_entries(self) -> DataFrame:
        return self._sql(LEXICON_ENTRIES, "part")

    @cached_property
    def lexicon(self) -> DataFrame:
        return self.lexicon_entries.groupBy("voice_id", "base", "tone").agg(
            F.max_by("duration_ms", "pos").alias("duration_ms")
        )

    @cached_property
    def sentences(self) -> DataFrame:
        docs = spread(self.table("documents").select("doc_id", "text"))
        docs = docs.select("doc_id", F.posexplode(F.split("text", "[.\\n]+")).alias("sent_no", "sent"))
        # told by the text itself, so that the words are cut once
        return docs.filter(F.trim("sent") != "").select(
            (F.col("doc_id") * 100000 + F.col("sent_no")).alias("sentence_id"),
            "doc_id",
            F.array_remove(F.split("sent", " "), "").alias("words"),
        )

    @cached_property
    def syllables(self) -> DataFrame:
        words = self.sentences.select("sentence_id", F.posexplode("words").alias("idx", "w")).withColumn(
            "n", F.length("w") % 8
        )
        return words.select(
            "sentence_id", "idx", F.expr(word_case(0)).alias("base"), F.expr(word_case(1)).alias("tone")
        )

    @cached_property
    def romanized(self) -> DataFrame:
        return self.sentences.select(
            "sentence_id",
            F.expr(f"array_join(transform(words, w -> {word_case(3, 'length(w) % 8')}), '')").alias("hanzi"),
            F.expr(f"array_join(transform(words, w -> {word_case(2, 'length(w) % 8')}), ' ')").alias("romanization"),
        )

    @cached_property
    def interleaved(self) -> DataFrame:
        token = f"concat('x ', {word_case(0, 'length(w) % 8')}, {word_case(1, 'length(w) % 8')})"
        return self.sentences.select(
            "sentence_id",
            F.expr(f"concat(sentence_id, '.wav\\t', array_join(transform(words, w -> {token}), ' '))").alias("value"),
        )

    @cached_property
    def frames(self) -> DataFrame:
        numbered = number_rows(
            self.table("events").select("user_id", "ts", "event_id", "event_type", "value"),
            ["user_id"],
            ["ts", "event_id"],
            F.to_date("ts"),
            "frame_idx",
        )
        return numbered.selectExpr(
            "user_id AS utt_id",
            "CAST(frame_idx AS INT) AS frame_idx",
            "CASE WHEN event_type = 'error' THEN 0.0E0 ELSE 50 + value END AS f0_hz",
            "CASE WHEN event_type = 'error' THEN 0.0E0 ELSE (event_id % 50 + 50) / 100.0E0 END AS voicing",
            "value / 500 AS energy",
            "CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS token",
            "(event_id % 100) / 100.0E0 AS prob",
        )

    @cached_property
    def frame_table(self) -> DataFrame:
        """The frames as a written table, for queries that read them several times."""
        return staged(self.frames, "frames")

    @cached_property
    def frame_targets(self) -> DataFrame:
        # the frame count needs no numbering: it is the number of events
        return (
            self.table("events")
            .groupBy(F.col("user_id").alias("utt_id"))
            .agg(F.count(F.lit(1)).cast("int").alias("n_frames"))
            .selectExpr("utt_id", "CAST(2 + utt_id % 4 AS INT) AS n_syllables", "n_frames")
        )

    @cached_property
    def logits(self) -> DataFrame:
        """One row per (utterance, frame) with the class scores as an array."""
        return self.table("embeddings").selectExpr(
            "CAST(floor(vec_id / 10) AS BIGINT) AS utt_id",
            "CAST(vec_id % 10 AS INT) AS frame",
            "CAST(embedding AS ARRAY<DOUBLE>) AS logits",
            "label AS target",
        )

    @cached_property
    def contours(self) -> DataFrame:
        return self.table("embeddings").selectExpr(
            "vec_id AS id",
            "CAST(embedding AS ARRAY<DOUBLE>) AS f0_norm",
            "CAST(50 + vec_id % 400 AS INT) AS duration_ms",
            "(vec_id % 100) / 100.0E0 AS voicing_ratio",
            "label % 5 AS tone",
        )

    @cached_property
    def token_lists(self) -> DataFrame:
        return self.table("embeddings").selectExpr(
            "vec_id AS utt_id",
            "transform(CAST(embedding AS ARRAY<DOUBLE>), x -> CASE WHEN x < -0.12E0 THEN 0 WHEN x < -0.03E0 THEN 1"
            " WHEN x < 0.03E0 THEN 2 WHEN x < 0.12E0 THEN 3 ELSE 4 END) AS toks",
        )

    @cached_property
    def token_pairs(self) -> DataFrame:
        ref = self.token_lists.select("utt_id", F.col("toks").alias("ref"))
        hyp = self.token_lists.select((F.col("utt_id") - 1).alias("utt_id"), F.col("toks").alias("hyp"))
        return ref.join(hyp, "utt_id")

    @cached_property
    def signal_table(self) -> DataFrame:
        """The samples as a written table, for queries that read them several times."""
        return staged(self.signal, "signal")

    @cached_property
    def signal(self) -> DataFrame:
        order = [
            "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate",
        ]
        numbered = number_rows(
            self.table("lineitem").select("l_suppkey", *order), ["l_suppkey"], order, block_of("l_orderkey", 1 << 14), "sample_idx"
        )
        return numbered.selectExpr(
            "l_suppkey AS utt_id", "CAST(sample_idx AS INT) AS sample_idx", "(l_quantity - 25) / 25 AS x"
        )
