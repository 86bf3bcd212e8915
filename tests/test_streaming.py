"""Report lines that arrive in files are checked batch by batch."""

import anchorage as A
from anchorage.schemas import DOCUMENTS
from anchorage.streaming import check_report_stream, read_report_stream


def test_report_stream(spark, tmp_path):
    docs = spark.createDataFrame([("s/a.md", "# A\n", 0, False, None)], DOCUMENTS)
    inbox = tmp_path / "in"
    inbox.mkdir()
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")

    def run():
        query = check_report_stream(read_report_stream(spark, str(inbox)), docs, None, out, marks)
        assert query.awaitTermination(120)
        return sorted((r.doc_line, r.tag) for r in spark.read.parquet(f"{out}/checked").collect())

    (inbox / "1.txt").write_text("s/b.md:1:  a.md#a\ns/b.md:2:  a.md#b\nbroken\n")
    assert run() == [(1, "OK"), (2, "NO_FRAG")]
    (inbox / "2.txt").write_text("s/b.md:3:  gone.md\n")
    assert run() == [(1, "OK"), (2, "NO_FRAG"), (3, "NO_DOC")]
    rejects = spark.read.parquet(f"{out}/rejects").collect()
    assert [(r.value, r.reason) for r in rejects] == [("broken", "invalid record format")]
