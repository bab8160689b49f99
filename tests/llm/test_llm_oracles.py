import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import oracle  # noqa: E402
from cindertrail.llm.queries import QUERIES  # noqa: E402
from cindertrail.llm.sql import SQL  # noqa: E402


#: Queries without SQL, which has no tokenizer and no corpus statistics of this kind, and the tests that check them.
ELSEWHERE = {
    "p9_mix": "test_mixture.py: totals, caps and probabilities",
    "p9_shares": "test_mixture.py: reached shares",
    "p10_found": "test_cut_texts.py: planted cuts, counts by brute force",
    "p10_report": "test_cut_texts.py",
}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, name):
    assert name in SQL or name in ELSEWHERE
    oracle.compare(spark, sf, QUERIES[name], SQL.get(name))
