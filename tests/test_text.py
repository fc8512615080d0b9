import numpy as np
from pyspark.sql import functions as F

from lingotide.functions import text as T
from lingotide.operators import sequences as S
from lingotide.operators import texts as X


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("v")).first().v


def test_error_scores(spark):
    pairs = [
        (1, "你好", "你好", 100, 100), (2, "你好！", "你好", 100, 100), (3, "你好", "你", 50, 50), (4, "你好", "北京上海", 0, 0),
        (5, "你好", "", 0, 0), (6, "", "", 100, 100), (7, "我们一起去公园吧", "我们一起", 50, 50), (8, "你好", "里好", 50, 50),
        (9, "", "你", 0, 100),
    ]
    df = spark.createDataFrame(pairs, "id int, ref string, hyp string, score0 int, completeness0 int")
    for r in X.score_pairs(df).collect():
        assert (r.score, r.completeness) == (r.score0, r.completeness0), r


def test_failed_recognition_scores_zero(spark):
    row = X.asr_grade(spark.createDataFrame([(1, "你好", None)], "id int, ref string, hyp string")).first()
    assert (row.overall, row.accuracy, row.completeness, row.error) == (0, 0, 0, "recognition_failed")


def test_normalization_order(spark):
    # listed punctuation goes before width folding, so an unlisted full-width dot survives as a plain one
    text = "Ｈｅｌｌｏ，　Ｗ．Ｄ！ [x] “q”"
    assert one(spark, T.normalize_text(F.col("t")), t=text) == "hellow.dx“q”"


def test_half_width(spark):
    assert one(spark, T.to_half_width(F.col("t")), t="Ａ！～　中") == "A!~ 中"


def test_token_distance(spark):
    df = spark.createDataFrame([([1, 2, 300], [1, 300]), ([], [5]), ([7], [7])], "a array<int>, b array<int>")
    assert [r.d for r in df.select(T.token_distance(F.col("a"), F.col("b")).alias("d")).collect()] == [1, 1, 0]


def test_token_distance_of_long_and_wide_lists(spark):
    rng = np.random.default_rng(4)
    long = rng.integers(0, 40_000, 20_000)
    # values that occur nowhere else cost one deletion each
    extra = np.insert(long, np.arange(100, 20_000, 500), 50_000)
    wide = [10**12 * k for k in range(60)]
    rows = [(long.tolist(), extra.tolist()), (wide, wide[:30] + wide[31:]), ([-5, 3, 7], [3, 7, 8]), (None, [1])]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a array<long>, b array<long>")
    got = [r.d for r in df.select("k", T.token_distance(F.col("a"), F.col("b")).alias("d")).orderBy("k").collect()]
    assert got == [len(extra) - len(long), 1, 2, None]


def test_empty_corpus_error_rate(spark):
    row = X.corpus_error_rate(spark.createDataFrame([], "ref array<int>, hyp array<int>")).first()
    assert (row.n_pairs, row.error_rate, row.exact_share) == (0, 0.0, 0.0)


def test_styles(spark):
    for text, style in (("nǐ hǎo", "tone-mark"), ("lü", "tone-mark"), ("NI3 hao3", "tone-number"), ("ni hao", "other")):
        assert one(spark, T.romanization_style(F.col("t")), t=text) == style


def test_expected_seconds(spark):
    assert one(spark, T.expected_seconds(F.col("t"), F.lit("zh-CN")), t="我们一起去") == 4
    assert one(spark, T.expected_seconds(F.col("t"), F.lit("en")), t="") == 3


def test_levels(spark):
    tags = spark.createDataFrame([(["x", "HSK9", "hsk2"],), (["hsk10"],), (None,)], "tags array<string>")
    assert [r.level for r in S.with_level(tags).collect()] == [9, None, None]
    assert [r.level for r in S.with_level(tags, strict=True).collect()] == ["hsk2", None, None]


def test_male_selector_matches_female_id(spark):
    df = spark.sql(
        """SELECT array(named_struct('id', 'female_1', 'label', map('en', 'A'), 'uri', 'a://1', 'duration_ms', 1),
        named_struct('id', 'm1', 'label', map('en', 'Man'), 'uri', 'assets://x/male/1', 'duration_ms', 1)) AS voices"""
    )
    pick = lambda s, **k: df.select(S.resolve_voice(F.col("voices"), s, **k)).first()[0]
    assert pick("male") == "a://1"
    assert pick("M1") == "assets://x/male/1"
    assert pick("nobody") == "a://1"
    assert pick("nobody", strict=True) is None


def test_generated_layouts(spark):
    rows = [
        (1, "zh-CN", '{"sentences": [{"text": " 你好。！"}, {"text": "x", "tags": ["a"], "difficulty": 3, "translation": "t"}]}'),
        (2, "en", '{"items": [{"text": "Hi!"}]}'),
        (3, "zh", '[{"text": "一？"}]'),
        (4, "de", '{"text": "Ja."}'),
        (5, "de", '{"sentences": [], "items": [{"text": "Nein"}]}'),
    ]
    got = X.normalize_generated(spark.createDataFrame(rows, "batch_id int, language string, response string"), 10).orderBy("id").collect()
    assert [(r.id, r.text) for r in got] == [
        ("ts_000010", "你好"), ("ts_000011", "x"), ("ts_000012", "Hi!"), ("ts_000013", "一"), ("ts_000014", "Ja."), ("ts_000015", "Nein"),
    ]
    assert got[1].gloss == {"en": "t"} and got[1].tags == ["a"] and got[1].difficulty == 3
    assert got[0].gloss == {"en": ""} and got[0].tags == [] and got[0].difficulty == 1


def test_failed_batches(spark):
    rows = [(1, "zh-CN", '{"items": [{"text": "好。"}]}'), (2, "zh-CN", "sorry, I cannot"), (3, "en", '{"sentences": []}'), (4, "en", None), (5, "en", '[{"text": "a"}, {"x": 1}]'), (6, "en", " ")]
    batches = spark.createDataFrame(rows, "batch_id int, language string, response string")
    failed = {r.batch_id: (r.response, r.reason) for r in X.failed_batches(batches).collect()}
    assert failed == {2: ("sorry, I cannot", "no JSON"), 3: ('{"sentences": []}', "no items"), 4: (None, "no response"), 6: (" ", "no response")}
    got = [(r.id, r.text) for r in X.normalize_generated(batches).orderBy("id").collect()]
    assert got == [("ts_000001", "好"), ("ts_000002", "a")]
