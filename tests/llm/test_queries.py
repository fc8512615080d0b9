"""The queries of the subpackage on the smallest tables: against their SQL, or against brute force."""

import zlib

import numpy as np
import pytest
from check import compare, duck
from conftest import SMALL

import corpus_pipeline
from lingotide.llm.queries import ORACLES, QUERIES, vocabulary


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.fixture(scope="module")
def documents(con):
    return con.execute("SELECT doc_id, coalesce(text, '') AS text FROM documents ORDER BY doc_id").df()


def test_thirteen_queries():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SMALL).toPandas(), con.execute(ORACLES[name]).df()) == ""


def test_encoding_queries(spark, documents):
    import hashlib

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    ids = {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in documents.itertuples()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in QUERIES["op1_bpe_round_trip"](spark, SMALL).collect():
        want = ids[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(want), sha(" ".join(map(str, want))))
        assert r.decoded_sha256 == sha(library.decode(want, skip_special_tokens=False))
    start = 0
    for r in QUERIES["op3_range_coded_tokens"](spark, SMALL).orderBy("doc_id").collect():
        want = np.array([*ids[r.doc_id], 1], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)


def test_quality_on_held_out_labels(spark, con):
    got = QUERIES["op4_quality_classifier"](spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    labels = duck("/root/testdata/sf0.01").execute("SELECT doc_id, quality FROM labels").df()
    held = labels[[zlib.crc32(str(i).encode()) % 5 == 0 for i in labels["doc_id"]]]
    scored = got.loc[held["doc_id"]]
    assert scored["held_out"].all() and (scored["predicted"].to_numpy() == held["quality"].to_numpy()).mean() >= 0.95
    good, bad = scored["score"].to_numpy()[held["quality"] == 1], scored["score"].to_numpy()[held["quality"] == 0]
    assert (good[:, None] > bad[None]).mean() >= 0.97


def test_neighbours_query_recall(spark, con):
    got = QUERIES["op7_learned_partitions"](spark, "/root/testdata/sf0.1").toPandas()
    rows = duck("/root/testdata/sf0.1").execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").df()
    x, ids = np.stack(rows["embedding"]).astype(float), rows["vec_id"].to_numpy()
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = set(ids[np.lexsort((ids, d))[:10]])
        hits, total = hits + len(want & set(got["vec_id"][got["query_id"] == ids[q]])), total + len(want)
    assert hits / total >= 0.9


def test_licences_query(spark, documents):
    marks = {"gpl": "GNU General Public License, version 3.", "mit": "Released under the MIT License.", "all-rights-reserved": "All rights reserved.",
             "cc-by-nc": "CC BY-NC 4.0.", "apache-2.0": "Apache License, Version 2.0."}
    texts = dict(zip(documents["doc_id"], documents["text"]))
    for r in QUERIES["op10_licence_scan"](spark, SMALL).collect():
        assert r.families == ",".join(sorted(k for k, v in marks.items() if v in texts[r.doc_id]))


def test_pipeline(spark, con):
    got = corpus_pipeline.run(spark, SMALL).collect()
    known = {r[0] for r in con.execute("SELECT doc_id FROM documents").fetchall()}
    assert {r.doc_id for r in got} <= known and all(r.n_tokens == len(r.token_ids) for r in got)
    junk = con.execute("SELECT doc_id FROM labels WHERE quality = 0").df()["doc_id"]
    assert len(set(junk) & {r.doc_id for r in got}) <= 0.1 * len(junk)
