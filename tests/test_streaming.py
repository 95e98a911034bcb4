"""Edits as a stream."""

from sheetwise.sources.package import build
from sheetwise.sources.xlsx import read_cells
from sheetwise.streaming.edits import EDITS, EditStream


def test_edits_make_versions(spark, tmp_path):
    book = build({"S": {(0, 0): 1, (1, 0): 2, (2, 0): {"f": "SUM(A1:A2)"}, (3, 0): {"f": "A3*10"}, (0, 1): {"f": "7+0"}}})
    cells = read_cells(spark.createDataFrame([("a", book), ("b", book)], "path string, content binary"))
    stream = EditStream(spark, str(tmp_path / "books"), cells)
    none = (None,) * 4
    first = [(1, "a", "s", 0, 0, 5.0, *none), (2, "a", "S", 0, 0, 50.0, *none), (3, "b", "S", 1, 0, None, None, None, None, "A1+100")]
    second = [(4, "b", "S", 2, 0, None, "text", None, None, None), (5, "a", "Nowhere", 0, 0, 1.0, *none)]
    source = tmp_path / "edits"
    spark.createDataFrame(first, EDITS).coalesce(1).write.parquet(str(source))
    edits = lambda: spark.readStream.schema(EDITS).parquet(str(source))
    stream.start(edits()).processAllAvailable()
    at = lambda s: {(r.book, r.r, r.c): r.s or r.err or r.n for r in s.values.collect()}
    got = at(stream)
    assert got["a", 2, 0] == 52 and got["a", 3, 0] == 520 and got["b", 1, 0] == 101 and got["b", 3, 0] == 1020 and got["b", 0, 1] == 7
    for q in spark.streams.active:
        q.stop()
    spark.createDataFrame(second, EDITS).coalesce(1).write.mode("append").parquet(str(source))
    again = EditStream(spark, str(tmp_path / "books"))  # goes on where the folder is
    again.start(edits()).processAllAvailable()
    for q in spark.streams.active:
        q.stop()
    got = at(again)
    assert got["b", 2, 0] == "text" and got["b", 3, 0] == "#VALUE!" and got["a", 3, 0] == 520
    again.apply(spark.createDataFrame(second, EDITS), 1)  # a batch that is run again
    assert at(again) == got
