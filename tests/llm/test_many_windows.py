"""A benchmark of few words and many windows."""

import random

from policylake.llm import decontamination


def test_windows_decide_on_broadcast(spark, monkeypatch):
    rnd = random.Random(2)
    item = " ".join(rnd.choice("abcd") for _ in range(300))
    docs = spark.createDataFrame([(1, f"x {item[40:80]} y"), (2, "x y")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 100)
    found = decontamination.find_windows(docs, items)
    assert "strategy=broadcast" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc_id: r.contaminated for r in decontamination.contamination(docs, items).collect()} == {1: True, 2: False}
