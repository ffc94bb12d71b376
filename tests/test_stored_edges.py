"""The edges as they are stored: the same as derived, in parts whose size doesn't grow with the tables."""

from pathlib import Path

from orrery.plans import views

DATA = "/root/testdata/sf0.001"


def test_parts_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(views, "PER_TASK", 200)
    views.store_edges(spark, DATA, str(tmp_path / "e"))
    stored = spark.read.parquet(str(tmp_path / "e"))
    derived = views.derived_edges(spark, DATA)
    columns = derived.columns
    assert stored.select(columns).exceptAll(derived).isEmpty() and derived.exceptAll(stored.select(columns)).isEmpty()
    # 6,000 lines by 200: 30 parts, not as few as adaptive execution would make of them
    assert len(list(Path(tmp_path, "e", "relation=calls").glob("*.parquet"))) > 15
