"""Plan properties: where Python runs, what is limited before a shuffle, what reaches the scan."""

import re
from pathlib import Path

import pytest
from conftest import SMALL

from lingotide.operators import practice as P
from lingotide.operators import scoring as SC
from lingotide.operators import syllables as SY
from lingotide.plans.catalog import ORACLES, QUERIES
from lingotide.plans.views import Views
from lingotide.sources import corpora as CO
from lingotide.sources import transcripts as TR

# operators that are sequential within a recording or a string, and the stateful stream
PYTHON = {
    "cls2_templates_dtw", "arr7_score_aligned", "arr9_align_to_reference", "win17_silence_segments",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def views(spark):
    return Views(spark, SMALL)


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith(("agg1_", "agg5", "win", "srt", "mth8", "cls", "arr", "jn", "str", "prj"))])
def test_no_cross_join_and_no_unexpected_python(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)
    assert bool(re.search("ArrowEvalPython|InPandas|InArrow|BatchEvalPython", text)) == (name in PYTHON)


def test_top_n_is_limited_before_the_shuffle(views):
    text = plan(P.retain_latest(views.attempts))
    assert text.count("WindowGroupLimit") == 2 and text.count("Exchange") == 1


def test_sandhi_rules_share_one_shuffle(views):
    syl = views.syllables
    assert plan(SY.apply_sandhi(syl, "sentence_id")).count("Exchange hashpartitioning") == 1


def test_softmax_and_ranks_need_no_shuffle(views):
    assert "Exchange" not in plan(SC.target_ranks(SC.with_probs(views.logits)))


def test_training_rows_need_no_shuffle(spark):
    rows = spark.createDataFrame([(1, [("ni", 3), ("hao", 3)])], "sid int, syllables array<struct<base:string,tone:int>>")
    assert "Exchange" not in plan(SY.training_rows(rows, "sid"))


def test_filters_and_columns_reach_the_scan(views):
    text = plan(P.practice_totals(views.attempts))
    assert "Not(EqualTo(event_type,signup))" in text
    schema = re.search("ReadSchema: struct<([^>]*)>", text).group(1)
    assert "props" not in schema and "value" not in schema


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)


def test_splitting_stays_in_the_plan_and_is_worked_out_once(views):
    for text in (plan(SY.explode_syllables(views.romanized, "sentence_id", "hanzi", "romanization")),):
        assert "Python" not in text and "Arrow" not in text
        assert not re.search(r"Filter .*arrays_zip", text)


def test_broadcast_is_left_to_size_checks():
    sources = (Path(__file__).resolve().parents[1] / "lingotide").rglob("*.py")
    # the operators of the optional subpackage send models and samples of stated size
    assert not [p for p in sources if "llm" not in p.parts and "broadcast(" in p.read_text()]


def test_sentences_and_halo_stay_in_generated_code(spark, views):
    for rows in (views.syllables, SY.apply_sandhi(views.syllables, "sentence_id")):
        assert "lambdafunction" not in plan(rows)


def test_syllables_take_their_piece_by_place(spark, views):
    text = plan(SY.explode_syllables(views.romanized, "sentence_id", "hanzi", "romanization"))
    assert "arrays_zip" not in text and "regexp_extract(s" not in text


def test_interleaved_lines_move_as_text(spark):
    lines = spark.createDataFrame([("a.wav\tx ni3", 1)], "value string, ord int")
    # no list of tokens is aggregated
    assert "max_by(_rest" in plan(TR.parse_interleaved(lines))


def test_native_syllables_are_built_once(spark):
    said = spark.createDataFrame([("u", "x", "ni3")], "utt_id string, hanzi string, pinyin string")
    heads = spark.createDataFrame([("/S1/u.wav", 1, 16000)], "path string, n_frames long, sample_rate int")
    text = CO.native_sentences(said, heads)._jdf.queryExecution().optimizedPlan().toString()
    # the one lambda over the tokens asks twice, and no list of characters is built within a lambda
    assert text.count("regexp_extract(lambda") == 2 and "get(split(" not in text
