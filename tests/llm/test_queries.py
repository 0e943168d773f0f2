"""The registered queries: columns of the contracts, one row per document where asked for, SQL where there is one."""

import os
import zlib

import duckdb
import numpy as np
import pytest

from doctables.llm import queries
from doctables.llm.tokens import Encoder, tokenizer_path
from tools.compare import compare

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op2": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op3": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op4": ["doc_id", "n_shingles", "component_id", "kept"],
    "op6": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op7": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op8": ["doc_id", "held_out", "score", "predicted"],
    "op10": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op11": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op12": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
    "op13": ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in sorted(os.listdir(SF)):
        con.execute(f"create view {file.split('.')[0]} as select * from '{SF}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_oracle(spark, db, name):
    assert compare(queries.QUERIES[name](spark, SF), db.sql(queries.ORACLES[name])) is None


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_contract(spark, db, name):
    wanted = COLUMNS.get(name.split("_")[0], [])
    table = queries.QUERIES[name](spark, SF)
    assert set(wanted) <= set(table.columns)
    if wanted[:1] == ["doc_id"] and not name.startswith("op3"):
        ids = [r[0] for r in db.sql("select doc_id from documents").fetchall()]
        assert sorted(r.doc_id for r in table.select("doc_id").collect()) == sorted(ids)


def test_wavelet_query_holds_the_library_ids(spark, db):
    encode, start = Encoder(tokenizer_path("byte_bpe_50k.json")).whole, 0
    got = {r.doc_id: r for r in queries.op1_wavelet_files(spark, SF).collect()}
    for doc_id, text in db.sql("select doc_id, text from documents order by doc_id").fetchall():
        ids = np.append(encode(text or ""), 0).astype("<u4")
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
