"""Queries over sequences of 16 places of which some have no vector, against their SQL twins."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from seqloom.plans import registry
from tests.duck import assert_same, connection

QUERIES, SQL = registry.queries(), registry.oracle_sql()
NAMES = [
    "ar_nll",
    "carry_sample",
    "configured_sample",
    "masked_sample",
    "filtered_sample",
    "full_history",
    "sample_history",
    "shifted_full_history",
    "shifted_history",
    "shifted_sample",
]


@pytest.fixture(scope="module")
def short(tmp_path_factory):
    """The last sequence has ten places; others lack a row in the prompt, behind it or in the middle."""
    rows = pq.read_table("/root/testdata/sf0.001/embeddings.parquet")
    kept = [r for r in rows.to_pylist() if r["vec_id"] < 122 and r["vec_id"] not in (80, 84, 97, 107, 108)]
    folder = tmp_path_factory.mktemp("short")
    pq.write_table(pa.Table.from_pylist(kept, rows.schema), folder / "embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql_on_short_sequences(spark, short, name):
    assert_same(QUERIES[name](spark, short), connection(short), SQL[name])
