"""The tree queries fit forests and rounds of the reference's size."""

import inspect

import pytest

from casewright.operators import models
from casewright.plans.catalog import QUERIES


class Asked(Exception):
    pass


@pytest.mark.parametrize(
    "name, maker, settings",
    [(n, "random_forest", {"trees": 500, "depth": 30}) for n in ("random_forest", "feature_importance", "top_features", "leakage_audit")]
    + [("boosted_trees", "boosted_trees", {"rounds": 500, "depth": 6})],
)
def test_full_size(spark, monkeypatch, name, maker, settings):
    signature = inspect.signature(getattr(models, maker))

    def asked(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        raise Asked({k: bound.arguments[k] for k in settings})

    monkeypatch.setattr(models, maker, asked)
    with pytest.raises(Asked) as found:
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert found.value.args[0] == settings
