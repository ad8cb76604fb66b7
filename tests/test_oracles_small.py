"""A sample of registered queries against their DuckDB oracles at sf0.001."""
import duckdb
import pytest

import __spark_entry__ as E
from tabwork.session import TABLES

KEYS = ["profile_columns", "pii_scan_table", "eval_auc_roc", "eval_threshold_sweep", "eda_correlation_matrix",
        "clean_apply", "drift_ks", "fe_target_encode", "adv_target_candidates", "project_rollup",
        "folds_time_series", "explain_pdp"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def _norm(pdf):
    import math
    cols = sorted(pdf.columns)
    rows = []
    for rec in pdf[cols].itertuples(index=False):
        out = []
        for v in rec:
            if hasattr(v, "item"):
                v = v.item()
            if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "NaT"):
                v = None
            elif isinstance(v, float):
                v = round(v, 5) + 0.0
            out.append(v)
        rows.append(tuple(out))
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, sf, con, key):
    got = E.queries()[key](spark, sf).toPandas()
    exp = con.execute(E.oracle_sql()[key]).df()
    gc, gr = _norm(got)
    ec, er = _norm(exp)
    assert gc == ec
    assert len(gr) == len(er)
    for a, b in zip(gr, er):
        for x, y in zip(a, b):
            if isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool):
                assert abs(x - y) <= 1e-4 * max(1.0, abs(x), abs(y)), (key, a, b)
            else:
                assert str(x) == str(y), (key, a, b)
