from pyspark.sql import functions as F

from glossweave import ConvertParams
from glossweave.sources.pages import stream_page_dir
from glossweave.streaming.ingest import batch_stats, ingest_batches, read_outcomes

PAGE = (
    '<details data-level="2"><h2><span id="en">x</span></h2><details data-level="3"><h3>Noun</h3>'
    "<ol><li>{}</li></ol></details></details>"
)


def test_slices_and_resume(spark, tmp_path):
    source = tmp_path / "pages"
    source.mkdir()
    for i in range(5):
        (source / f"word{i}").write_text(PAGE.format(i) if i else "nothing")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    params = ConvertParams("en", "en")
    names = str(tmp_path / "names")

    def run():
        ingest_batches(stream_page_dir(spark, str(source), 2, names), params, out, checkpoint)
        return read_outcomes(spark, out)

    stats = batch_stats(run()).collect()
    assert sorted(r.processed + r.skipped for r in stats) == [1, 2, 2]
    assert sum(r.processed for r in stats) == 4
    # A second run goes on where the first one stopped.
    (source / "word9").write_text(PAGE.format("nine"))
    outcomes = run()
    assert outcomes.count() == 6
    late = outcomes.where(F.col("word") == "word9").select("definitions").first()[0]
    assert late[0].defs == ["nine"]


def test_selection_comes_before_batches(spark, tmp_path):
    source = tmp_path / "pages"
    source.mkdir()
    for name in ("word", "слово", "zeta", "_under", "x.html", "alpha"):
        (source / name).write_text(PAGE.format(name), encoding="utf-8")
    (source / "none").write_text("")
    out = str(tmp_path / "out")
    params = ConvertParams("en", "en", scripts=("latin",))
    ingest_batches(stream_page_dir(spark, str(source), 3, str(tmp_path / "names")), params, out, str(tmp_path / "checkpoint"))
    rows = {r.word: r.has_entry for r in read_outcomes(spark, out).collect()}
    assert rows == {"word": True, "zeta": True, "_under": True, "alpha": True, "none": False}
    assert {r.word for r in read_outcomes(spark, out, limit=2).collect()} == {"_under", "alpha"}
