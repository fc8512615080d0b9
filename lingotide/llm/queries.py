"""Queries of this subpackage: each maps the given tables to an operator's records and its result back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lingotide.llm import bpe, fingerprints, licences, mixing, neighbours, overlap, personal_data, pivots, quality, ranked, sharding, spellings, tokenfiles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def texts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sentence texts: id, text, language, source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("language"), "source")


# the vocabulary of the contracts; another file's path may be given to the operators
VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    """Where the public vocabularies are installed."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@query
def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the text they decode to."""
    rules = bpe.load_rules(vocabulary())
    decoded = bpe.decode_tokens(bpe.encode_texts(texts_of(spark, sf_dir), rules), rules)
    return decoded.select(
        F.col("id").alias("doc_id"),
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op2_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against its half-replaced text and the next document."""
    compared = fingerprints.compare_edits(texts_of(spark, sf_dir))
    return compared.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
        "edited_fingerprint", "near_edited", "near_next",
    )


ORACLES["op2_merkle_fingerprints"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id) AS n FROM documents),
pairs AS (SELECT a.doc_id, a.text, b.text AS next_text,
    CAST(length(a.text) // 2 AS BIGINT) AS cut FROM d a JOIN d b ON b.n = a.n % (SELECT count(*) FROM d) + 1),
three AS (SELECT doc_id, text, next_text, substring(text, 1, length(text) - cut) || substring(next_text, 1, cut) AS edited FROM pairs),
long AS (SELECT doc_id, 0 AS k, text AS t FROM three UNION ALL SELECT doc_id, 1, edited FROM three UNION ALL SELECT doc_id, 2, next_text FROM three),
leaves AS (SELECT doc_id, k, t, list_transform(regexp_extract_all(t, '[^
]+
*|
+'),
    lambda s: list_transform(regexp_extract_all(s, '[^.!?|
]+[.!?|
 ]*|[.!?|
 ]+'), lambda p: sha256(p))) AS ls FROM long),
marks AS (SELECT doc_id, k, t, sha256(array_to_string(list_transform(ls, lambda s: sha256(array_to_string(s, ''))), '')) || ':'
    || array_to_string(list_transform(ls, lambda s: array_to_string(list_transform(s, lambda p: substring(p, 1, 8)), '.')), '/') AS mark,
    list_distinct(list_transform(flatten(ls), lambda p: substring(p, 1, 8))) AS ps FROM leaves),
m AS (SELECT doc_id, max(mark) FILTER (k = 0) AS m0, max(mark) FILTER (k = 1) AS m1, max(mark) FILTER (k = 2) AS m2,
    any_value(ps) FILTER (k = 0) AS p0, any_value(ps) FILTER (k = 1) AS p1, any_value(ps) FILTER (k = 2) AS p2,
    max(length(t)) FILTER (k = 0) AS n_chars, max(sha256(t)) FILTER (k = 1) AS edited_sha256 FROM marks GROUP BY doc_id)
SELECT doc_id, n_chars, edited_sha256, m0 AS fingerprint, m1 AS edited_fingerprint,
  CASE WHEN m0 = m1 THEN 1.0 WHEN len(p0) + len(p1) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(p0, p1)) / (len(p0) + len(p1)) END::DOUBLE AS near_edited,
  CASE WHEN m0 = m2 THEN 1.0 WHEN len(p0) + len(p2) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(p0, p2)) / (len(p0) + len(p2)) END::DOUBLE AS near_next
FROM m"""


@query
def op3_range_coded_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written in ascending order and read back from the files."""
    folder = tokenfiles.token_folder(spark)
    tokenfiles.write_tokens(texts_of(spark, sf_dir), folder, vocabulary())
    read = tokenfiles.read_tokens(spark, folder)
    return read.select(
        F.col("id").alias("doc_id"), "start", F.size("token_ids").cast("long").alias("n_tokens"),
        tokenfiles.little_endian_crc32("token_ids").alias("ids_crc32"),
    )


def held_out(key: Column) -> Column:
    """One of five ids is kept for judging; a null id is not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the labels of ids that are not held out, applied to all."""
    texts = texts_of(spark, sf_dir).select("id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), "quality")
    model = quality.fit_quality(texts, labels, ~held_out(F.col("id")))
    scored = quality.score_quality(texts, model)
    return scored.select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query
def op5_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 equal shards under the law ``key``."""
    dealt = sharding.assign_shards(texts_of(spark, sf_dir))
    return dealt.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


@query
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 5, 2, 1 along the sources, at most three times a source."""
    mixed = mixing.mix_sources(texts_of(spark, sf_dir))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source", "source_size", "target", "taken")


ORACLES["op6_mix_sources"] = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|17'), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM src),
o AS (SELECT *, row_number() OVER (ORDER BY source_size * 3.0::DOUBLE / w, source NULLS LAST) AS n FROM w),
lv AS (SELECT o.*, (total - coalesce(sum(source_size) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3.0::DOUBLE)
    / sum(w) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
t AS (SELECT source, source_size, least(source_size * 3.0::DOUBLE, (SELECT arg_min(level, n) FROM lv WHERE level * w <= source_size * 3.0::DOUBLE) * w) AS target FROM o),
plan AS (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END + 1e-12::DOUBLE) AS sure FROM t),
pl AS (SELECT *, greatest(target - sure * source_size, 0) AS rest, CASE WHEN source_size > 0 THEN greatest(target - sure * source_size, 0) / source_size ELSE 0 END AS p FROM plan),
r AS (SELECT s.doc_id, s.size, s.source, pl.* EXCLUDE (source), CASE WHEN p > 0 THEN u * (1 - p) / (u * (1 - p) + p * (1 - u)) ELSE 1 END AS rank
    FROM sized s JOIN pl ON s.source IS NOT DISTINCT FROM pl.source),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM r),
i AS (SELECT *, p > 0 AND upto <= rest AS inside, coalesce(max(CASE WHEN p > 0 AND upto <= rest THEN upto END) OVER (PARTITION BY source), 0) AS got FROM c),
f AS (SELECT source, arg_min(doc_id, (abs(size - (rest - got)), rank, doc_id)) AS fill FROM i
    WHERE NOT inside AND p > 0 AND size > 0 AND abs(size - (rest - got)) < rest - got GROUP BY source)
SELECT i.doc_id, i.size, i.source, i.source_size, i.target,
  CAST((sure + CASE WHEN inside OR i.doc_id = f.fill AND p > 0 THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM i LEFT JOIN f ON i.source IS NOT DISTINCT FROM f.source"""


@query
def op7_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    contours = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("f0_norm"))
    found = neighbours.nearest_contours(contours, contours.filter("id % 100 = 0"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans found in each document."""
    found = personal_data.find_personal_data(texts_of(spark, sf_dir))
    spans = F.col("spans")
    counts = [F.size(F.filter(spans, _is_kind(k))).cast("long").alias(f"n_{k}") for k in personal_data.BASE]
    return found.select(
        F.col("id").alias("doc_id"),
        *counts,
        F.sha2(personal_data.joined(spans, personal_data.BASE), 256).alias("base_sha256"),
        personal_data.joined(spans).alias("spans"),
    )


def _is_kind(kind: str):
    return lambda s: s["kind"] == kind


ORACLES["op8_personal_data"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
pat(kind, rank, pat, base) AS (VALUES
  ('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', true), ('ip', 1, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)', true),
  ('card', 2, '[0-9]([\x20-]?[0-9])+', true), ('phone', 3, '\+[0-9][\x20().0-9-]+[0-9]', true)),
m AS (SELECT doc_id, t, kind, rank, regexp_extract_all(t, pat) AS ms, string_split_regex(t, pat) AS gs FROM d, pat),
u AS (SELECT doc_id, t, kind, rank, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM m WHERE len(ms) > 0),
p AS (SELECT doc_id, kind, rank, ms[i] AS v, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM u),
g AS (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS dg FROM p),
ok AS (SELECT doc_id, kind, rank, s, s + length(v) AS e FROM g WHERE CASE kind
  WHEN 'ip' THEN list_max(list_transform(string_split(v, '.'), lambda x: try_cast(x AS HUGEINT))) <= 255 AND len(list_filter(string_split(v, '.'), lambda x: length(x) > 30)) = 0
  WHEN 'card' THEN length(dg) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(dg) + 1), lambda i: CASE WHEN i % 2 = 1
      THEN CAST(substr(reverse(dg), i, 1) AS INT) ELSE CAST(substr(reverse(dg), i, 1) AS INT) * 2 - CASE WHEN CAST(substr(reverse(dg), i, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
  WHEN 'phone' THEN length(dg) BETWEEN 10 AND 15 ELSE true END),
l AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS j, count(*) FILTER (kind = 'email') AS n_email,
  count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone FROM ok GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(j, '')) AS base_sha256, coalesce(j, '') AS spans FROM d LEFT JOIN l USING (doc_id)"""


@query
def op9_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, Jaccard of 0.85 and more."""
    groups = overlap.overlap_groups(texts_of(spark, sf_dir), overlap.Rule(words=4, num=85, den=100))
    return groups.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


ORACLES["op9_count_vector_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
r(u, v) AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(r.v), n.doc_id)) AS component_id
FROM n LEFT JOIN r ON r.u = n.doc_id GROUP BY n.doc_id, n.n"""


@query
def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the families of its notices and their places."""
    found = F.col("licences")
    places = F.transform(found, lambda s: F.concat_ws(":", s["family"], s["start"].cast("string"), s["end"].cast("string")))
    scanned = licences.scan_licences(texts_of(spark, sf_dir))
    return scanned.select(
        F.col("id").alias("doc_id"),
        F.size(found).cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(found["family"])), ",").alias("families"),
        F.array_join(places, ",").alias("spans"),
        F.coalesce(F.array_max(found["score"]), F.lit(0.0)).alias("score"),
    )


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, some misspelled by rule, with their forms and roots."""
    return spellings.group_spellings(spellings.spelled_words(texts_of(spark, sf_dir), every=199))


ORACLES["op11_spelling_variants"] = r"""
WITH RECURSIVE poly AS (SELECT list(c ORDER BY b) AS crc FROM (SELECT b, list_reduce(range(0, 9), lambda x, i: CASE WHEN i = 0 THEN b
    WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, b) AS c FROM range(0, 256) t(b))),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]{6,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
d AS (SELECT doc_id, w, count(*) AS c FROM r GROUP BY ALL),
b AS (SELECT w, c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS h FROM d),
k AS (SELECT w, c, xor(list_reduce(list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)),
    lambda x, y: xor(x >> 8, crc[CAST(xor(x, y) & 255 AS INT) + 1]), 4294967295), 4294967295) AS h FROM b, poly),
a AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word, c FROM k),
ws AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM a GROUP BY word HAVING length(word) >= 6 AND sum(c) >= 5),
x AS (SELECT word, n, unnest(range(0, length(word))) AS i FROM ws),
g AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS s FROM x),
p AS (SELECT a.word AS u, b.word AS v FROM g a JOIN g b ON a.i = b.i AND a.s = b.s AND a.word <> b.word
    UNION SELECT g.word, ws.word FROM g JOIN ws ON ws.word = g.s UNION SELECT ws.word, g.word FROM g JOIN ws ON ws.word = g.s),
nr AS (SELECT u AS word, count(*) AS n_near, max(ws.n) AS top FROM p JOIN ws ON ws.word = v GROUP BY u),
f AS (SELECT ws.word, ws.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * ws.n THEN top END AS form_n FROM ws LEFT JOIN nr USING (word)),
fo AS (SELECT f.word, min(v.word) AS form FROM f JOIN p ON p.u = f.word JOIN ws v ON v.word = p.v AND v.n = f.form_n GROUP BY f.word),
o AS (SELECT f.*, form FROM f LEFT JOIN fo USING (word)),
t(word, root, form) AS (SELECT word, word, form FROM o UNION ALL SELECT t.word, o.word, o.form FROM t JOIN o ON o.word = t.form)
SELECT o.word, o.form, t.root, o.n, o.n_near, o.form_n FROM o JOIN t ON t.word = o.word AND t.form IS NULL"""


@query
def op12_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of every hundredth vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    contours = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("f0_norm"))
    found = pivots.top_contours(contours, contours.filter("id % 100 = 0"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLES["op12_pivot_top_k"] = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS c FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.c, v.c) AS BIGINT) AS score FROM v q, v
    WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id AND len(q.c) = len(v.c)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10"""


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = ranked.rank_sentences(texts_of(spark, sf_dir).select("id", "text"), items)
    return found.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


ORACLES["op13_ranked_search"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
st AS (SELECT count(*) AS nn, CAST(sum(len(ts)) AS BIGINT) AS ll FROM d WHERE len(ts) > 0),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
q AS (SELECT item_id, t, count(*) AS c FROM i GROUP BY ALL),
x AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM d),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM x WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, st GROUP BY t, nn),
g AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75 * n * nn) // ll)))) AS g FROM tf JOIN w USING (t), st),
s AS (SELECT item_id, doc_id, CAST(sum(c * g) AS BIGINT) AS score FROM g JOIN q USING (t) GROUP BY ALL HAVING sum(c * g) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 10"""
