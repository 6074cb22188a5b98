"""Queries that once kept a share of the claims by their key, over all claims and against brute force."""

import pytest
from foliospark.functions import text
from foliospark.queries import QUERIES
from foliospark.sources import views
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def names(spark):
    """(claim, folded name read) of all claims that have one, and (employee, folded name) of all employees."""
    reads = views.claims(spark, SMALL).select("claim_id", text.squash(F.col("person_name")).alias("t")).where("t <> ''").collect()
    people = views.dims(spark, SMALL)["employees"].select("id", text.squash(F.col("full_name")).alias("t")).where("t <> ''").collect()
    return [tuple(r) for r in reads], [tuple(r) for r in people]


def test_all_claims_are_matched_by_name(spark, names):
    reads, people = names
    held = lambda c, t: [i for i, k in people if k in t or t in k]
    want = {c: min(own) for c, t in reads if len(t) >= 8 and (own := held(c, t))}
    got = QUERIES["q21_employee_by_name"](spark, SMALL).collect()
    assert len(got) == len(want) and {r["claim_id"]: r["emp_id"] for r in got} == want
    assert any(c % 20 for c in want)


def test_all_claims_are_looked_up_in_the_index(spark, names):
    reads, people = names
    want = {c: min(own) for c, t in reads if (own := [i for i, k in people if k in t or t in k])}
    got = QUERIES["q63_containment_large"](spark, SMALL).collect()
    assert len(got) == len(want) and {r["claim_id"]: r["emp_id"] for r in got} == want
    assert any(c % 20 for c in want)


def test_all_claims_go_without_a_catalogue(spark):
    claims = views.claims(spark, SMALL).select("claim_id", "kind", "person_name").collect()
    want = {r["claim_id"]: (False, None, None, 1 if r["kind"] == "incapacidad" else None, r["person_name"] or "?") for r in claims}
    got = QUERIES["q66_without_catalogue"](spark, SMALL).collect()
    assert len(got) == len(want) and {r["claim_id"]: tuple(r)[1:] for r in got} == want
    assert any(c % 10 for c in want)
