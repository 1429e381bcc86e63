from dataclasses import replace

import pytest

from tallymark import registry


def test_similarity_pairs_raises_where_pairs_would_be_missing(spark, monkeypatch):
    monkeypatch.setattr(registry, "UNMOVED", replace(registry.UNMOVED, max_pair_work=1))
    with pytest.raises(RuntimeError, match="gave up"):
        registry.similarity_pairs(spark, "/root/testdata/sf0.001")
