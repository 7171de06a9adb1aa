"""The registered queries: one per operator, their SQL, and the columns of their contracts."""

import pytest

from hopline.llm import queries as Q
from tools.compare_oracle import compare, duck

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_credentials": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op2_chat": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op3_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op4_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op5_neighbours": ["query_id", "rank", "vec_id", "score"],
    "op6_simhash": ["doc_id", "fingerprint", "component_id"],
    "op7_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op8_urls": ["page_id", "host", "path", "rule", "verdict"],
    "op9_syncmers": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op10_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op11_pieces": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op12_divergence": ["lang", "source", "part", "item", "value", "rank"],
    "op13_clusters": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, name):
    r = compare(spark, duck(SF), name, Q.queries()[name], Q.oracle_sql()[name], SF)
    assert r["schema"] and r["rows"][0] == r["rows"][1] and r["values"], r


def test_one_query_for_each_operator():
    assert set(Q.queries()) == set(COLUMNS)
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_whole_tables(spark, name):
    df = Q.queries()[name](spark, SF)
    assert df.columns[:len(COLUMNS[name])] == COLUMNS[name]
    table, key = {"op2_chat": ("conversations", "conv_id"), "op5_neighbours": ("embeddings", "vec_id"),
                  "op8_urls": ("pages", "page_id"), "op12_divergence": ("documents", "lang"),
                  "op13_clusters": ("embeddings", "vec_id")}.get(name, ("documents", "doc_id"))
    ids = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    want = {i for i in ids if i % 20 == 0} if name == "op5_neighbours" else ids | {-7} if name == "op2_chat" else ids
    assert {r[0] for r in df.select(df.columns[0]).collect()} == want
