"""Findings of the fourth round."""

from pyspark.sql import functions as F

from marquee.llm import pii


def test_personal_data_is_learned_from_all_texts(spark):
    """windows were taken from the 4,000 texts of least hash, so that a kind which only others hold was never added."""
    ids = [r.id for r in spark.range(4_200).orderBy(F.xxhash64("id"), "id").collect()]
    last = ids[-1]  # the last by hash
    rows = [(i, f"please call +49 151 2345 67{i % 90 + 10} today or write" if i == last else f"plain words {i}") for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weights = pii.fit(docs)
    assert any(name.startswith("phone:") for name in weights)


def test_each_kind_has_its_own_bound(spark, monkeypatch):
    """Many windows of one kind leave room for those of another."""
    monkeypatch.setattr(pii, "KIND_WINDOWS", 5)
    seen = []
    monkeypatch.setattr(pii, "train", lambda rows: seen.extend(rows) or {})
    rows = [(i, f"write to name{i}@example{i}.org soon") for i in range(60)] + [(100 + i, f"the host 10.20.30.{i} is down") for i in range(3)]
    pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    kinds = [kind for *_, kind in seen]
    assert kinds.count("email") == 5 and kinds.count("ip") == 3
