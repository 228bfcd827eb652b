"""Text sources; schemas and separators are always given."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import decimal_comma

#: How the statistics language writes a missing value.
NULL_TEXT = "NA"


def read_delimited(spark: SparkSession, path: str | list[str], schema: StructType | str, sep: str = ",", header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """A file, several, or a folder of them. Without a header the schema names the columns."""
    return spark.read.csv(path, schema=schema, sep=sep, header=header, nullValue=NULL_TEXT, encoding=encoding, escape='"', enforceSchema=not header)


def guess_separator(spark: SparkSession, path: str, candidates: Sequence[str] = (",", ";", "\t", "|"), lines: int = 50) -> str:
    """The candidate that splits the first lines of a file into the same number of columns, the most of such candidates;
    the first one if none does. Quoted texts do not count. Only these lines come to the driver."""
    head = [re.sub(r'"[^"]*"', "", r["value"]) for r in spark.read.text(path).limit(lines).collect()]
    even = {c: head[0].count(c) for c in candidates if head and len({x.count(c) for x in head if x}) == 1}
    return max(even, key=even.get) if even and max(even.values()) else candidates[0]


def read_decimal_comma(spark: SparkSession, path: str, schema: StructType | str, numbers: Sequence[str], sep: str = ";", header: bool = True) -> DataFrame:
    """Numbers with decimal commas; the schema has them as strings."""
    df = read_delimited(spark, path, schema, sep, header)
    return df.withColumns({c: decimal_comma(F.col(c)) for c in numbers})


def whole_files(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(value): each file as one text, in any character set that Java knows."""
    return spark.read.format("binaryFile").load(path).select(F.decode("content", encoding).alias("value"))


def lines_after(spark: SparkSession, path: str, skip: int, encoding: str = "UTF-8") -> DataFrame:
    """(line): the lines of each file but its first ``skip`` ones.

    Files are read in splits, whatever their size; a split that begins a file counts off its lines as they pass. Where
    these lines do not fit into a file's first split, that is an error, which a larger spark.sql.files.maxPartitionBytes mends. Files in
    UTF-16 and UTF-32, whose line ends are no single bytes, are one text each.
    """
    if encoding.upper().startswith(("UTF-16", "UTF-32")):
        every = whole_files(spark, path, encoding).select(F.posexplode(F.split("value", r"\r?\n", -1)).alias("n", "line"))
        return every.where(F.col("n") >= skip).select("line")
    m = "_metadata.file_"
    raw = spark.read.text(path, lineSep="\n").select(
        F.regexp_replace(F.decode(F.col("value").cast("binary"), encoding), r"\r$", "").alias("line"),
        F.when(F.col(f"{m}block_start") == 0, F.xxhash64(f"{m}path")).alias("begins"), (F.col(f"{m}block_length") < F.col(f"{m}size")).alias("goes_on"),
    )

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, goes_on = None, skip, False

        def check() -> None:
            if seen < skip and goes_on:
                raise ValueError(f"the first {skip} lines do not fit into the first split of a file; raise spark.sql.files.maxPartitionBytes")

        for batch in batches:
            begins, at = batch.column("begins"), 0
            while at < len(batch):
                here = begins[at].as_py()
                if here != now:
                    check()
                    now, seen, goes_on = here, skip if here is None else 0, batch.column("goes_on")[at].as_py()
                same = pc.equal(begins, here) if here is not None else pc.is_null(begins)
                other = pc.index(pc.fill_null(same.slice(at), False), False).as_py()
                end = at + other if other >= 0 else len(batch)
                gone = min(skip - seen, end - at)
                seen += gone
                if end > at + gone:
                    yield batch.select(["line"]).slice(at + gone, end - at - gone)
                at = end
        check()

    return raw.mapInArrow(drop, "line string") if skip else raw.select("line")


def read_skipping(spark: SparkSession, path: str, schema: StructType, skip: int, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Files whose first lines are no data; empty lines are left out."""
    parsed = F.from_csv("line", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"sep": sep, "nullValue": NULL_TEXT})
    return lines_after(spark, path, skip, encoding).where("line <> ''").select(parsed.alias("r")).select("r.*")


def read_two_row_header(spark: SparkSession, path: str, skip: int = 0, sep: str = ";", encoding: str = "ISO-8859-1", footer: int = 0, join: str = "_") -> DataFrame:
    """A small report whose column names stand in two rows, the upper one filled to the right; all columns are strings.

    The header is read in the driver; ``footer`` lines at the end are left out.
    """
    text = whole_files(spark, path, encoding).first()
    lines = [x for x in (text["value"] if text else "").replace("\r", "").split("\n")[skip:] if x]
    upper, lower = (x.split(sep) for x in lines[:2])
    names, last = [], ""
    for k, low in enumerate(lower):
        last = (upper[k] if k < len(upper) else "") or last
        names.append(join.join(x for x in (last, low) if x) or f"column{k + 1}")
    body = [[None if v in ("", NULL_TEXT) else v for v in x.split(sep)[: len(names)]] for x in lines[2 : len(lines) - footer]]
    body = [r + [None] * (len(names) - len(r)) for r in body]
    return spark.createDataFrame(body, StructType.fromDDL(", ".join(f"`{n}` string" for n in names)))


def read_column(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A file with one value per line and no header."""
    return read_delimited(spark, path, f"`{name}` string", header=False)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, such as a prompt, as one text."""
    row = whole_files(spark, path).first()
    return row["value"] if row else ""


def read_vectors(spark: SparkSession, path: str, words: DataFrame, column: str = "word") -> DataFrame:
    """(word, vec) of the wanted words in a vector file of lines ``word x1 x2 ...``; case does not count, the file's is kept.

    The first line of such files holds counts and is no vector. Lines are parsed only after the semi join.
    """
    lines = spark.read.text(path).select(F.split_part("value", F.lit(" "), F.lit(1)).alias("word"), "value")
    wanted = words.select(F.lower(column).alias("__key")).distinct()
    kept = lines.join(wanted, F.lower("word") == F.col("__key"), "left_semi")
    numbers = F.split(F.trim("value"), " +")
    return kept.select("word", F.transform(F.slice(numbers, F.lit(2), F.size(numbers) - 1), lambda x: x.try_cast("double")).alias("vec")).where(F.size("vec") > 1)
