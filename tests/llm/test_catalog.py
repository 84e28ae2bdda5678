"""The registered queries: names, columns and the SQL twins."""

import pytest

import __spark_entry__
from seqloom.llm import catalog
from tests.duck import assert_same, connection

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: "doc_id held_out n_tokens n_known train_tokens base_score score perplexity",
    2: "doc_id piece start length ids_crc32 sequence_id offset",
    3: "doc_id held_out score predicted",
    4: "doc_id n_lines n_dropped kept_sha256",
    5: "doc_id fingerprint component_id",
    6: "page_id host path rule verdict",
    7: "doc_id item_id edits start length",
    8: "query_id rank vec_id score",
    9: "doc_id size text_crc32 law shard slot grown_shard",
    10: "doc_id lang_pred score rejected held_out",
    11: "doc_id leaf subroot root proof_sha256 folded_root verified",
    12: "doc_id n_words n_base first_word last_word base_labels labels score",
    13: "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
}


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert_same(catalog.queries()[name](spark, SF), connection(SF), catalog.oracle_sql()[name])


def test_names_and_columns(spark):
    names = {int(n[2:].split("_")[0]): n for n in catalog.queries()}
    assert sorted(names) == [*range(1, 14)]
    every = __spark_entry__.queries()
    assert {*names.values(), "pipeline"} <= every.keys()
    for n, name in names.items():
        if n not in (4, 8, 11, 12):
            assert every[name](spark, SF).columns == COLUMNS[n].split(), name
