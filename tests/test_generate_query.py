"""The blended ranks use the operator's own settings."""

from risewatch.catalog import QUERIES, graphs, models


def test_blended_ranks_use_the_defaults(monkeypatch):
    seen = []
    monkeypatch.setattr(graphs, "parts", lambda spark, d: ("train", "test"))
    monkeypatch.setattr(models.links, "known_queries", lambda test, train: test)
    monkeypatch.setattr(models.generate, "fit_generate", lambda *a, **k: seen.append((a, k)))
    monkeypatch.setattr(models.generate, "blend_ranks", lambda *a: None)
    QUERIES["grf_17_blended_ranks"](None, "")
    assert seen == [(("train",), {})]
