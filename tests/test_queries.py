"""Every core query with SQL gives the same rows as its SQL."""

import pytest
from oracle import difference

from gaitloom.plans import problems, reference

CASES = {**{n: (problems.QUERIES[n], q) for n, q in problems.ORACLE.items()}, **{n: (reference.QUERIES[n], q) for n, q in reference.ORACLE.items()}}


@pytest.mark.parametrize("name", sorted(CASES))
def test_same_rows(name, spark, sf, duck):
    run, sql = CASES[name]
    assert difference(run(spark, sf), sql, duck) == ""


@pytest.fixture(scope="module")
def one_fit():
    """The model queries share one whole fit, and the model of poses takes two passes: its sampler has tests of its own."""
    patch, fits, fit = pytest.MonkeyPatch(), {}, reference._fitted
    patch.setattr(reference, "_fitted", lambda s, d: fits.setdefault(d, None) or fits.update({d: fit(s, d)}) or fits[d])
    whole = reference.pose_model.fit
    patch.setattr(reference.pose_model, "fit", lambda p, state: whole(p, state, 2))
    yield
    patch.undo()


@pytest.mark.parametrize("name", sorted(set(reference.QUERIES) - set(reference.ORACLE)))
def test_runs(name, spark, sf, one_fit):
    assert reference.QUERIES[name](spark, sf).count() > (-1 if name == "significant_pairs" else 0)  # few recordings: no pair may be significant
