"""Shares that end in a half: Spark's figures against the same SQL in DuckDB."""

from datetime import datetime, timedelta
from decimal import Decimal
from itertools import permutations

import duckdb
import pytest

from focusloom.operators import profile
from focusloom.plans import catalogue

KINDS = ("click", "view", "purchase", "signup", "error")
#: 157.85 of 328 is 0.48125, as a double 0.48124999999999996, and times 10,000 it is 4812.5.
RECENT = (157.85, 75.30, 51.63, 40.18, 3.04)
BEFORE = (10.0, 20.0, 30.0, 40.0, 50.0)


@pytest.fixture
def sf(spark, tmp_path):
    at = datetime(2024, 1, 20)
    rows = [(i, at - timedelta(days=8, minutes=i), 1, k, v, '{"k": 7}') for i, (k, v) in enumerate(zip(KINDS, BEFORE))]
    rows += [(10 + i, at - timedelta(minutes=i), 1, k, v, '{"k": %d}' % (10 + i)) for i, (k, v) in enumerate(zip(KINDS, RECENT))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["retrieve_differential", "domain_delta", "signature_kl"])
def test_half_share_as_in_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf}/events.parquet/*.parquet'").fetchall()
    cur = con.execute(catalogue.SQL[name])
    columns = [c[0] for c in cur.description]
    want = [tuple(float(v) if isinstance(v, Decimal) else v for v in r) for r in cur.fetchall()]
    got = [tuple(r) for r in catalogue.QUERIES[name](spark, sf).select(*columns).collect()]
    assert want and sorted(got) == sorted(want)


def test_half_share(spark):
    """117.27 of 416.96 is 0.28125; added up as doubles in some orders, the whole is 416.96000000000004 and the share less."""
    values, orders = ("117.27", "89.61", "37.61", "25.23", "147.24"), list(permutations(range(5)))
    rows = [(10 * s + i, str(s), KINDS[k], "2024-01-20", values[k]) for s, order in enumerate(orders) for i, k in enumerate(order)]
    events = spark.createDataFrame(rows, "id long, subject_id string, domain string, at string, v string").selectExpr("id", "subject_id", "domain", "cast(at as timestamp_ntz) as ts_start", "cast(v as decimal(18,2)) as dwell").coalesce(1)
    assert {(r["short"], r["long"]) for r in profile.windows(events, 5, 14).where("domain = 'click'").collect()} == {(0.2813, 0.2813)}
    assert {r["share"] for r in profile.domain_share(events).where("domain = 'click'").collect()} == {0.2813}
