"""A stream of edits to workbooks.

The books' cells and values are tables in a folder, one version after another. Each micro-batch of edits makes the next
version: of several edits of a cell the last holds, and only what depends on the edited cells is computed again. A
version is complete when its marker stands beside it, and it is named after its batch, so a batch that is run again
after a failure finds its version there or writes it anew.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sheets import recalculate
from ..plans.references import FormulaError, compile_text
from ..sources.xlsx import CELLS

#: seq: the order of edits. One of n, s, b, err and formula is set; none: the cell is cleared.
EDITS = "seq long, book string, sheet string, r int, c int, n double, s string, b boolean, err string, formula string"


def _keyed(edits: DataFrame) -> DataFrame:
    """Edits as CELLS."""

    def run(batches):
        for batch in batches:
            keys, problems = [], []
            for text, r, c, sheet in zip(batch["formula"], batch["r"], batch["c"], batch["sheet"], strict=True):
                key = problem = None
                if text is not None:
                    try:
                        key = compile_text(text, int(r), int(c), {}, sheet).key
                    except (FormulaError, RecursionError):
                        problem = "parse"
                keys.append(key)
                problems.append(problem)
            yield pd.DataFrame({**{k: batch[k] for k in ("book", "sheet", "sheet_no", "r", "c", "n", "s", "b", "err")}, "kind": ["value" if x is None else "normal" for x in batch["formula"]], "formula": batch["formula"], "key": keys, "problem": problems, "hidden": batch["hidden"]})

    return edits.mapInPandas(run, CELLS)


class EditStream:
    """Keeps the values of books up to date with a stream of EDITS. folder: one that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, cells: DataFrame | None = None):
        """cells: CELLS of the books as they are at first; without them, the folder's last version goes on."""
        self.spark, self.folder = spark, folder
        if cells is not None:
            cells.write.mode("overwrite").parquet(self._path("cells", -1))
            self._finish(-1, recalculate(self.spark.read.parquet(self._path("cells", -1))))

    def _path(self, what: str, batch: int) -> str:
        return f"{self.folder}/{what}_{batch + 1:010d}"

    def _finish(self, batch: int, values: DataFrame) -> None:
        """Spark writes a table's _SUCCESS last: the values', which are written after the cells, are the marker."""
        values.write.mode("overwrite").parquet(self._path("values", batch))

    def _last(self, before: int | None = None) -> int:
        """The last complete version, by its batch."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/values_*/_SUCCESS")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        done = sorted(int(str(f.getPath().getParent().getName()).split("_")[1]) - 1 for f in found)
        done = [b for b in done if before is None or b < before]
        if not done:
            raise ValueError(f"no version in {self.folder}")
        return done[-1]

    @property
    def values(self) -> DataFrame:
        return self.spark.read.parquet(self._path("values", self._last()))

    @property
    def cells(self) -> DataFrame:
        return self.spark.read.parquet(self._path("cells", self._last()))

    def apply(self, edits: DataFrame, batch: int) -> None:
        last = self._last(batch)
        cells, before = (self.spark.read.parquet(self._path(k, last)) for k in ("cells", "values"))
        spot = ["book", "low", "r", "c"]
        fresh = edits.withColumn("low", F.lower("sheet")).groupBy(*spot).agg(F.max_by(F.struct("sheet", "n", "s", "b", "err", "formula"), "seq").alias("x")).select(*spot, "x.*")
        sheets = cells.filter("sheet is not null").groupBy("book", F.lower("sheet").alias("low")).agg(F.first("sheet").alias("name"), F.first("sheet_no").alias("sheet_no"))
        rows = cells.filter("r is not null").select("book", F.lower("sheet").alias("low"), "r", F.col("hidden")).groupBy("book", "low", "r").agg(F.bool_or("hidden").alias("hidden"))
        fresh = fresh.join(sheets, ["book", "low"]).join(rows, ["book", "low", "r"], "left").drop("sheet").withColumnRenamed("name", "sheet").withColumn("hidden", F.coalesce("hidden", F.lit(False)))
        low = cells.withColumn("low", F.lower("sheet"))
        kept = low.join(fresh.select(*spot), spot, "left_anti").select(cells.columns)
        kept.unionByName(_keyed(fresh)).write.mode("overwrite").parquet(self._path("cells", batch))
        changed = fresh.select("book", F.col("low").alias("sheet"), "r", "c")
        self._finish(batch, recalculate(self.spark.read.parquet(self._path("cells", batch)), changed, before))

    def start(self, edits: DataFrame, **options: str) -> StreamingQuery:
        """Runs over a streaming table of EDITS, a version for each micro-batch."""
        return edits.writeStream.foreachBatch(lambda df, batch: self.apply(df, batch)).option("checkpointLocation", f"{self.folder}/progress").options(**options).start()
