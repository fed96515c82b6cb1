"""Hooks take long texts out of an Arrow batch a slice at a time, and keep rows, order and errors."""

from __future__ import annotations

import json

from engramlake import hooks


def test_hook_sees_a_slice_at_a_time(spark):
    n = 3 * hooks.SLICE_ROWS + 5
    rows = [(i, None if i == 7 else "no json" if i == 8 else json.dumps({"content": f"text {i}"})) for i in range(n)]
    frame = spark.createDataFrame(rows, "id long, context string").coalesce(1)

    def classify(context: dict) -> dict:
        return {"category": context["content"]}

    out = hooks.classify_promotions(frame, classify).collect()
    assert [row.id for row in out] == list(range(n))
    assert [row.error for row in out[7:9]] == ["TypeError", "JSONDecodeError"] and out[7].raw is None
    assert all(json.loads(row.raw)["category"] == f"text {row.id}" for row in out if row.id not in (7, 8))
    assert "MapInArrow" in hooks.classify_promotions(frame, classify)._jdf.queryExecution().executedPlan().toString()


def test_embedder_sees_a_slice_at_a_time(spark):
    n = 3 * hooks.SLICE_ROWS + 5
    frame = spark.createDataFrame([(i, None if i == 7 else f"text {i}") for i in range(n)], "id long, content string").coalesce(1)

    def embed(texts: list[str]) -> list[list[float]]:
        if "text 300" in texts:  # one vector too few: the slice is refused, the others stay
            texts = texts[1:]
        return [[float(len(texts)), float(len(text))] for text in texts]

    out = hooks.embed_text(frame, "content", 2, embed).collect()
    assert [row.id for row in out] == list(range(n))
    for row in out:
        size = 5 if row.id >= 3 * hooks.SLICE_ROWS else hooks.SLICE_ROWS
        refused = 1 <= row.id // hooks.SLICE_ROWS < 2
        assert row.vector == (None if refused else [size, 0 if row.id == 7 else len(f"text {row.id}")])
