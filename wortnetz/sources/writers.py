"""Sinks: stage tables, exports, chunked checkpoints and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_stage(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """A stage's table as Parquet."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_export(df: DataFrame, path: str, header: bool = True, sep: str = ",") -> None:
    """A text export with missing values as the statistics language writes them."""
    df.write.mode("overwrite").csv(path, header=header, sep=sep, nullValue="NA", emptyValue="", escape='"')


def write_chunks(df: DataFrame, path: str, chunk: str = "chunk") -> int:
    """Adds the chunks that are not there yet, each in a folder of its own; the number of chunks that were there.

    A broken run goes on where it stopped: chunks that have rows at the path are skipped.
    """
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    done = spark.read.parquet(path).select(chunk).distinct() if fs.exists(folder) and fs.listStatus(folder) else None
    n = done.count() if done is not None else 0
    rest = df.join(done, chunk, "left_anti") if n else df
    rest.write.mode("append").partitionBy(chunk).parquet(path)
    return n


def latex_table(df: DataFrame, caption: str, align: str | None = None, most: int = 100) -> str:
    """A report table of at most ``most`` rows, in the frame's order."""
    special = {"&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}"}
    cell = lambda v: "" if v is None else "".join(special.get(c, c) for c in str(v))
    rows = [" & ".join(map(cell, r)) + r" \\" for r in df.limit(most).collect()]
    head = " & ".join(map(cell, df.columns)) + r" \\"
    return "\n".join([r"\begin{table}", rf"\caption{{{cell(caption)}}}", rf"\begin{{tabular}}{{{align or 'l' * len(df.columns)}}}", r"\hline", head, r"\hline", *rows, r"\hline", r"\end{tabular}", r"\end{table}"])


def url_encoded(column):
    return F.url_encode(column)
