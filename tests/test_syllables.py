import random

import pytest
from pyspark.sql import functions as F

from lingotide.functions import pinyin as PY
from lingotide.functions.text import WHITESPACE, strip
from lingotide.operators import corpus as C
from lingotide.operators import syllables as SY


def sandhi(spark, rows, **options):
    df = spark.createDataFrame([(1, i, b, t) for i, (b, t) in enumerate(rows)], "sentence_id int, idx int, base string, tone int")
    return [r.surface for r in SY.apply_sandhi(df, "sentence_id", **options).orderBy("idx").collect()]


@pytest.mark.parametrize(
    "rows, want",
    [
        ([("ni", 3), ("hao", 3)], [2, 3]),
        ([("wo", 3), ("hen", 3), ("hao", 3)], [2, 2, 3]),
        ([("ni", 3), ("de", 0), ("hao", 3)], [3, 0, 3]),
        ([("yi", 1), ("ge", 4)], [2, 4]),
        ([("YI", 1), ("tian", 1)], [4, 1]),
        ([("yi", 1), ("nian", 2)], [4, 2]),
        ([("yi", 1), ("qi", 3)], [4, 3]),
        ([("yi", 1), ("de", 0)], [1, 0]),
        ([("yi", 1)], [1]),
        ([("yi", 4), ("ge", 4)], [4, 4]),
        ([("bu", 4), ("shi", 4)], [2, 4]),
        ([("bu", 4), ("hao", 3)], [4, 3]),
        # the yi rule reads the tone the third-tone rule left, the bu rule the one the yi rule left
        ([("yi", 1), ("hao", 3), ("ni", 3)], [4, 2, 3]),
        ([("bu", 4), ("yi", 1), ("tian", 1)], [2, 4, 1]),
    ],
)
def test_sandhi_rules(spark, rows, want):
    assert sandhi(spark, rows) == want


def test_sandhi_in_blocks_equals_whole(spark):
    rng = random.Random(5)
    rows = [rng.choice([("yi", 1), ("bu", 4), ("hao", 3), ("shi", 4), ("de", 0), ("tian", 1)]) for _ in range(300)]
    assert sandhi(spark, rows, block=4) == sandhi(spark, rows)


def test_marked_names_switch_off_yi_and_bu(spark):
    df = spark.createDataFrame([(1, 0, "yi", "yī", 1), (1, 1, "ge", "gè", 4)], "s int, idx int, base string, pinyin string, tone int")
    assert [r.surface for r in SY.apply_sandhi(df, "s", match_marked=True).orderBy("idx").collect()] == [1, 4]


@pytest.mark.parametrize(
    "text, n, want",
    [
        # by spaces
        ("nǐ hǎo", 2, ["nǐ", "hǎo"]),
        # by tone marks; a closing n or ng that a vowel follows goes to the next syllable
        ("xièxiè", 2, ["xiè", "xiè"]),
        ("nǐhǎo", 2, ["nǐ", "hǎo"]),
        ("wǒér", 2, ["wǒ", "ér"]),
        ("gāoxìng", 2, ["gāo", "xìng"]),
        ("tiānānmén", 3, ["tiā", "nān", "mén"]),
        ("fāngàn", 2, ["fā", "ngàn"]),
        ("nánguò", 2, ["ná", "nguò"]),
        # by initials
        ("xièxie", 2, ["xiè", "xie"]),
        ("nǐhǎo ma", 3, ["nǐ", "hǎo", "ma"]),
        # by tokens
        ("xiǎngà de", 3, ["xiǎ", "ngà", "de"]),
        # evenly
        ("zhongguo", 2, ["zhon", "gguo"]),
        ("péngyoumen hǎo", 4, ["pén", "gyo", "ume", "nhǎo"]),
        ("wǒmen shì", 3, ["wǒ", "me", "nshì"]),
        ("eeeeeee", 3, ["ee", "ee", "eee"]),
        # short cuts
        ("hǎo", 1, ["hǎo"]),
        ("a b", 1, ["ab"]),
        ("", 2, []),
    ],
)
def test_splitting(spark, text, n, want):
    assert split_all(spark, [(text, n)]) == [want]


def split_all(spark, cases):
    df = spark.createDataFrame([(k, *case) for k, case in enumerate(cases)], "k int, rom string, n int")
    df = df.withColumn("tokens", F.array_remove(F.split(strip(F.col("rom")), f"[{WHITESPACE}]+"), ""))
    return [r.s for r in PY.split_unspaced(df, "rom", "tokens", "n", "s").orderBy("k").collect()]


def plain_split(text, n, whole=None):
    """The cascade of cuts letter by letter; ``whole`` is the token that is being cut."""
    marked, vowels = set(PY.MARKED), set(PY.MARKED + "aeiouü")
    tokens, joined = text.split(), text.replace(" ", "")
    if len(tokens) == n or not joined:
        return tokens if len(tokens) == n else []
    if n == 1:
        return [joined]
    low = [c.lower() for c in joined]
    if sum(c in marked for c in joined) == n:
        cuts = []
        for k in [k for k, c in enumerate(joined) if c in marked][:-1]:
            k += 1
            while k < len(low) and low[k] in vowels - marked:
                k += 1
            for closing in ("ng", "n", "r"):
                if "".join(low[k:]).startswith(closing):
                    k += len(closing) if not (low[k + len(closing):] and low[k + len(closing)] in vowels) else 0
                    break
            cuts.append(k)
        return [joined[a:b] for a, b in zip([0, *cuts], [*cuts, len(joined)])]
    cuts = [
        k for k in range(1, len(low))
        if "".join(low[k:k + 2]) in ("zh", "ch", "sh") or low[k] in PY.LETTER_INITIALS and low[k - 1] in vowels | {"n", "g"}
    ]
    if len(cuts) + 1 == n:
        return [joined[a:b] for a, b in zip([0, *cuts], [*cuts, len(joined)])]
    if 0 < len(tokens) < n and whole is None:
        pieces = []
        for token in tokens:
            share = max(1, min(sum(c in marked for c in token), n - len(tokens) + len(pieces) + 1))
            pieces += [token] if share == 1 else plain_split(token, share, token)
        if len(pieces) == n:
            return pieces
    width = max(1, len(joined) // n)
    return [joined[k * width:(k + 1) * width] for k in range(n - 1)] + [joined[(n - 1) * width:]]


def test_splitting_against_letter_by_letter(spark):
    rng = random.Random(5)
    parts = ["n", "g", "r", "zh", "ch", "h", "m", "a", "ā", "é", "ǒ", "ü", "ǜ", "i", "Ü", "N", "G", "S", "H", " ", "x", "ng", "Ā", "7"]
    cases = [("".join(rng.choices(parts, k=rng.randint(0, 14))), rng.randint(1, 6)) for _ in range(4000)] + [("āáǎ", 2), ("āáǎ ā", 3)]
    for case, got in zip(cases, split_all(spark, cases)):
        assert got == plain_split(*case), case


def test_unspaced_rows_go_through_the_splitter(spark):
    rows = [(1, "你好！", "nǐhǎo"), (2, "谢谢", "xiè xie"), (3, "abc", "abc"), (4, "好好好", "hǎo"), (5, "好", None)]
    got = SY.explode_syllables(spark.createDataFrame(rows, "id int, text string, romanization string"), "id").orderBy("id", "idx").collect()
    assert [(r.id, r.idx, r.hanzi, r.pinyin, r.tone) for r in got] == [
        (1, 0, "你", "nǐ", 3), (1, 1, "好", "hǎo", 3), (2, 0, "谢", "xiè", 4), (2, 1, "谢", "xie", 0),
        (4, 0, "好", "h", 0), (4, 1, "好", "ǎ", 3), (4, 2, "好", "o", 0), (5, 0, "好", "", 0),
    ]


@pytest.mark.parametrize(
    "syllable, initial, final, tone",
    [
        ("nǐ", "n", "i", 3), ("Hǎo", "h", "ao", 3), ("zhōng", "zh", "ong", 1), ("chī", "ch", "i", 1), ("shì", "sh", "i", 4),
        ("ài", "", "ai", 4), ("de", "d", "e", 0), ("ma1", "m", "a", 1), ("ma5", "m", "a5", 0), ("lǜ", "l", "ü", 4), ("yī", "y", "i", 1),
    ],
)
def test_parse_syllable(spark, syllable, initial, final, tone):
    row = spark.createDataFrame([(syllable,)], "s string").select(PY.parse_syllable(F.col("s")).alias("p")).first().p
    assert tuple(row) == (initial, final, tone)


def test_first_and_last_tone(spark):
    row = spark.createDataFrame([("mǎmá",)], "s string").select(
        PY.tone_of(F.col("s")).alias("last"), PY.tone_of(F.col("s"), "first").alias("first")
    ).first()
    assert (row.last, row.first) == (2, 3)


def test_numbered(spark):
    row = spark.createDataFrame([(" Ni3 hao lv5 x-1 ma9 ",)], "s string").select(PY.parse_numbered(F.col("s")).alias("p")).first().p
    assert [tuple(t) for t in row] == [("ni", 3), ("hao", 0), ("lv", 0), ("x-1", 0), ("ma", 0)]


@pytest.mark.parametrize(
    "base, tone, want",
    [("hao", 3, "hǎo"), ("xie", 4, "xiè"), ("dou", 1, "dōu"), ("gui", 4, "guì"), ("liu", 2, "liú"), ("lü", 4, "lǜ"), ("ma", 0, "ma"), ("ng", 2, "ng"), ("ma", 5, "ma")],
)
def test_tone_marks(spark, base, tone, want):
    df = spark.createDataFrame([(base, tone)], "b string, t int")
    assert df.select(PY.add_tone_mark(F.col("b"), F.col("t"))).first()[0] == want


def test_valid_syllables(spark):
    found = {r.syllable for r in C.valid_syllables(spark).collect()}
    assert {"zhuang", "nüe", "jiong", "er", "shi", "yuan", "que", "lün"} <= found
    assert not found & {"buo", "fei", "gei", "hei", "jü", "ri1"}


def syl(spark, rows):
    return spark.createDataFrame([(1, i, b, t, s) for i, (b, t, s) in enumerate(rows)], "sid int, idx int, base string, tone int, surface int")


def lexicon(spark):
    rows = [("f", "ni", 3, 100), ("f", "ni", 2, 120), ("f", "hao", 3, 200), ("f", "ma", 0, 50)]
    return spark.createDataFrame(rows, "voice_id string, base string, tone int, duration_ms int")


def test_lookup_falls_back_to_underlying_tone(spark):
    rows = syl(spark, [("ni", 3, 2), ("hao", 3, 2), ("tian", 1, 1)])
    got = C.lookup_audio(rows, lexicon(spark), ["f"]).orderBy("idx").collect()
    assert [(r.idx, r.duration_ms) for r in got] == [(0, 120), (1, 200)]


def test_timeline_gap_uses_original_position(spark):
    rows = syl(spark, [("tian", 1, 1), ("ni", 3, 3), ("hao", 3, 3)])
    got = C.timeline(rows, lexicon(spark), "sid", ["f"], gap_ms=10).orderBy("idx").collect()
    assert [(r.idx, r.start_ms, r.end_ms) for r in got] == [(1, 10, 110), (2, 120, 320)]


def test_timeline_crossfade(spark):
    rows = syl(spark, [("ni", 3, 3), ("hao", 3, 3), ("ni", 3, 3)])
    got = C.timeline(rows, lexicon(spark), "sid", ["f"], gap_ms=10, crossfade_ms=15).orderBy("idx").collect()
    assert [(r.start_ms, r.end_ms) for r in got] == [(0, 100), (85, 285), (270, 370)]


def test_crossfade_longer_than_a_piece_fails(spark):
    with pytest.raises(Exception, match="shorter than the crossfade"):
        C.timeline(syl(spark, [("ma", 0, 0)]), lexicon(spark), "sid", ["f"], crossfade_ms=60).collect()


def test_vocabulary(spark):
    vocab = spark.createDataFrame([("ni", 2), ("nu", 3)], "syllable string, token_id int")
    rows = syl(spark, [("NǏ", 3, 3), ("nǚ", 3, 3), ("nv", 3, 0), ("xx", 1, 1)])
    ids = C.encode(rows, vocab, "sid").orderBy("pos")
    assert [r.token_id for r in ids.collect()] == [1, 2, 3, 3, 0]
    assert [r.token_id for r in C.encode(rows, vocab, "sid", add_bos=False).orderBy("pos").collect()] == [2, 3, 3, 0]
    odd = spark.createDataFrame([(0,), (1,), (2,), (99,)], "token_id int")
    assert {r.token_id: r.syllable for r in C.decode(odd, vocab).collect()} == {0: "<PAD>", 1: "<BOS>", 2: "ni", 99: "<UNK>"}
    targets = C.ctc_targets(rows, vocab, "sid").orderBy("idx").collect()
    assert [(r.syllable_target, r.tone_target) for r in targets] == [(1, 4), (2, 4), (2, 1), (1, 2)]


def test_timeline_of_short_sentences_moves_the_syllables_once(spark):
    rows = [(k, i, *[("ni", 3), ("hao", 3), ("xx", 1)][(k + i) % 3]) for k in range(30) for i in range(7)]
    syl = spark.createDataFrame(rows, "sentence_id long, idx int, base string, tone int")
    lexicon = spark.createDataFrame([("a", "ni", 3, 200), ("a", "ni", 2, 210), ("a", "hao", 3, 300), ("b", "hao", 3, 400)], "voice_id string, base string, tone int, duration_ms int")
    out = C.timeline(SY.apply_sandhi(syl, "sentence_id", keep_block="block"), lexicon, "sentence_id", ["a", "b"], gap_ms=20, block="block")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(sentence_id") == 1
    got = {(r.sentence_id, r.voice_id, r.idx): (r.start_ms, r.end_ms) for r in out.collect()}
    want = {}
    surfaces = {(r.sentence_id, r.idx): r.surface for r in SY.apply_sandhi(syl, "sentence_id").collect()}
    known = {(v, b, t): d for v, b, t, d in map(tuple, lexicon.collect())}
    for voice in "ab":
        for k in range(30):
            at = 0
            for _, i, base, tone in rows[7 * k:7 * k + 7]:
                ms = known.get((voice, base, surfaces[k, i]), known.get((voice, base, tone)))
                if ms is not None:
                    at += ms + (20 if i else 0)
                    want[k, voice, i] = (at - ms, at)
    assert got == want


def test_pairing_cuts_the_other_side_to_the_wanted_keys(spark):
    targets = spark.range(1000).selectExpr("id AS utt_id", "0 AS idx", "id * 2 AS a").filter("utt_id < 4")
    other = spark.range(200000).selectExpr("id AS utt_id", "0 AS idx", "id AS b")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "20000")
    try:
        out = C.pair_by_position(targets, other, "utt_id")
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted((r.utt_id, r.a, r.b) for r in out.collect()) == [(k, 2 * k, k) for k in range(4)]
