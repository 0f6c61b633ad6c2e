"""A stream gives what the batch gives, also across a restart."""

from leaksieve import assess, flat_report, read_stream, start_scan
from leaksieve.plans.corpus import texts
from leaksieve.sources import decode_text
from leaksieve.sources.files import read_files

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    corpus = texts(spark, SF, "derived")
    first, second = corpus.where("doc_id % 2 = 0"), corpus.where("doc_id % 2 = 1")

    def run():
        arriving = read_stream(spark, source, corpus.schema)
        results = flat_report(assess(arriving), ["doc_id"])
        query = start_scan(results, out, state, until_done=True)
        query.awaitTermination()
        progress = query.lastProgress
        assert not progress or not progress["stateOperators"]
        return spark.read.schema(results.schema).parquet(out)

    first.write.parquet(source)
    assert run().count() == first.count()
    second.write.mode("append").parquet(source)
    got = run()  # only the new files are scanned, nothing twice
    want = flat_report(assess(corpus), ["doc_id"])
    assert sorted(got.collect()) == sorted(want.collect())
    assert run().count() == corpus.count()


def test_stream_of_files(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.txt").write_bytes(b"a@b.cc")
    (folder / "b.txt").write_bytes(b"clean")
    files = read_files(spark, str(folder), streaming=True)
    arriving = files.select("filename", decode_text(files.content).alias("text"))
    results = flat_report(assess(arriving), ["filename"])
    start_scan(results, str(tmp_path / "out"), str(tmp_path / "state"), until_done=True).awaitTermination()
    got = {r.filename: r.score for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a.txt": 7, "b.txt": 12}
