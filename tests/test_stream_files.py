"""Streams are fed by as many files as there are tasks, and worked off in batches of many files."""

from pathlib import Path

from leaksieve.plans import queries


def _documents(spark, path):
    rows = [(i, f"user{i}@example.com pwd=secret{i:04d}", "en", f"s{i % 3}", 30) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{path}/documents.parquet")
    return str(path)


def _kept(monkeypatch, tmp_path):
    monkeypatch.setattr(queries, "shared_folder", lambda spark, name: str(tmp_path / name))


def test_a_half_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    _kept(monkeypatch, tmp_path)
    by = {r.source: r.n for r in queries.queries()["stream_levels"](spark, _documents(spark, tmp_path)).selectExpr("source", "documents AS n").collect()}
    assert by == {"s0": 134, "s1": 133, "s2": 133}
    files = [*Path(tmp_path, "stream-rollup", "in").glob("*.parquet")]
    assert len(files) > 2 * spark.sparkContext.defaultParallelism


def test_deliveries_are_few_batches(spark, tmp_path, monkeypatch):
    _kept(monkeypatch, tmp_path)
    got = queries.queries()["stream_once"](spark, _documents(spark, tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == list(range(400))
    assert len([*Path(tmp_path, "stream-once", "in").glob("*.parquet")]) > 2 * spark.sparkContext.defaultParallelism
    batches = [p for p in Path(tmp_path, "stream-once-out", "checkpoint", "commits").iterdir() if p.name.isdigit()]
    assert len(batches) <= 4  # a batch of rows and one that clears the state, for each delivery
