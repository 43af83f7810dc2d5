"""The queries of this subpackage that SQL cannot state, and the plans of all."""

import __spark_entry__ as entry
from modelwatch.llm.queries import ORACLES, QUERIES


def test_queries_without_sql():
    """Tokenizers, trained classifiers and fingerprints; each has a brute-force test."""
    assert set(QUERIES) - set(ORACLES) == {
        "op1_token_counts", "op6_license_scan", "op7_bpe_roundtrip", "op8_prefix_fingerprints", "op10_toxicity"
    }
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
