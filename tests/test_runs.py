"""Inbox streams and count models."""

from ledgerloom.operators import count_model as counts
from ledgerloom.sources import files


def test_inbox_stream_lists_each_file_once(spark, tmp_path):
    inbox, archive = tmp_path / "in", tmp_path / "old"
    inbox.mkdir()

    def drain():
        stream = files.stream_inbox(spark, str(inbox), str(archive)).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        stream.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.path.rsplit("/", 1)[1] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    for name in ("a.pdf", "B.ZIP", "c.txt", "pdf"):
        (inbox / name).write_text("x")
    assert drain() == ["B.ZIP", "a.pdf"]
    (inbox / "d.Pdf").write_text("y")
    assert drain() == ["B.ZIP", "a.pdf", "d.Pdf"]
    assert drain() == ["B.ZIP", "a.pdf", "d.Pdf"]
    assert (inbox / "c.txt").exists()


def test_count_model(spark):
    log = [("s", "Acme norte", "ACME")] * 3 + [("s", "acme sur", "ACME"), ("s", "casa norte", "CASA"), ("s", None, "x"), ("t", "??", "Q"), ("t", "!", "P")]
    model = counts.train(spark.createDataFrame(log, "field STRING, original_value STRING, corrected_value STRING"))
    rows = [("s", "ACME este"), ("s", "casa"), ("s", "nothing known"), ("s", None), ("t", "any"), ("u", "acme")]
    got = counts.predict(model, spark.createDataFrame(rows, "field STRING, original_value STRING")).collect()
    assert {(r.field, r.original_value): r.predicted_value for r in got} == {
        ("s", "ACME este"): "ACME", ("s", "casa"): "CASA", ("s", "nothing known"): "ACME", ("s", None): "ACME", ("t", "any"): "P", ("u", "acme"): None
    }
    none = counts.train(spark.createDataFrame([], "field STRING, original_value STRING, corrected_value STRING"))
    assert [r.predicted_value for r in counts.predict(none, spark.createDataFrame(rows[:1], "field STRING, original_value STRING")).collect()] == [None]
