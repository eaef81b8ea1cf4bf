"""Every registered query against its SQL, and the shape of the registry."""

import re
from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__ as entry
from tests.oracle import collected, compare_rows, duck

ROWS_ONLY = {
    "V15_encoding_identity",
    "S05_file_fingerprint",
}
# Queries of the optional text operators have their own tests.
NAMES = [n for n in entry.queries() if re.match(r"[A-Z]\d\d_|decision_profile$", n)]
FAMILIES = {"S": 9, "T": 20, "Q": 25, "P": 21, "C": 15, "V": 15, "A": 7, "M": 18, "R": 17}


def test_every_operator_is_registered():
    seen = {n.split("_")[0] for n in entry.queries() if re.match(r"[A-Z]\d\d_", n)}
    assert seen == {f"{f}{i:02d}" for f, n in FAMILIES.items() for i in range(1, n + 1)}
    assert set(NAMES) - set(entry.oracle_sql()) == ROWS_ONLY


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    """All queries, several at a time: the data is tiny and planning dominates."""
    queries = entry.queries()
    # These settle the tables the others share.
    for first in ("P20_dropped_by_config", "V01_fit_vocab", "V03_fit_scaler", "S08_read_run_reports"):
        queries[first](spark, sf_dir)
    with ThreadPoolExecutor(6) as pool:
        yield {n: pool.submit(lambda fn=fn: collected(fn(spark, sf_dir))) for n, fn in queries.items() if n in NAMES}


@pytest.mark.parametrize("name", sorted(NAMES))
def test_query_equals_sql(results, con, name):
    cols, rows = results[name].result()
    if name in ROWS_ONLY:
        assert rows
    else:
        assert compare_rows(cols, rows, con, entry.oracle_sql()[name], exact=False) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 3
