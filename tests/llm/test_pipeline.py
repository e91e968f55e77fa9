"""The pipeline and the thin queries on small tables against plain versions."""

import zlib
from collections import Counter

import numpy as np
import pytest
from test_operators import components_of, fresh, normal

import corpus_pipeline
from loomgraph.llm import packing, queries, secrets_scan

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]


def test_queries_have_contract_columns(spark):
    want = {
        "op1": "doc_id start n_tokens ids_crc32", "op2": "page_id host path rule verdict", "op3": "doc_id n_tokens ids_sha256 decoded_sha256", "op4": "query_id rank vec_id score",
        "op5": "doc_id piece start length ids_crc32 sequence_id offset", "op6": "doc_id n_shingles component_id", "op7": "doc_id held_out lang_pred score",
        "op8": "doc_id n_assign n_access n_hex base_sha256 spans", "op9": "doc_id other_id", "op10": "doc_id keep_id group_size kept text_sha256",
    }
    assert {q.split("_")[0] for q in queries.QUERIES} == set(want)
    for name, f in queries.QUERIES.items():
        df = f(spark, SMALL)
        assert set(want[name.split("_")[0]].split()) <= set(df.columns), name
        assert df.count() > 0 or name.startswith("op9"), name


def test_pipeline(spark, documents):
    rows = [d for d in documents if any(c.isalpha() for c in d[1] or "")]
    last = {}
    for d in rows:
        last[normal(d[1])] = d  # ids ascend, so the largest stays
    rows = sorted(last.values())
    keep = {c for _, _, c in components_of([(d[0], d[1]) for d in rows])}
    rows = [d for d in rows if d[0] in keep]
    library = fresh("byte_bpe_50k.json")
    want, lengths = Counter(), Counter()
    for d in rows:
        ids = np.array([*library.encode(secrets_scan.redacted(d[1]), add_special_tokens=False).ids, 2], "<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), 1024)):
            want[d[0], k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
            lengths[n] += 1
    found = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    assert len({r.sequence_id for r in found}) == packing.best_fit(lengths, 1024)[1]


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns  # names, order
        assert stage(spark, docs.limit(0), SMALL).count() == 0
