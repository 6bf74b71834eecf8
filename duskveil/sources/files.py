"""Line files in and out, batch and streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskveil.functions.errors import StreamError

Parser = Callable[[Column], dict[str, Column]]


def whole_line(line: Column) -> dict[str, Column]:
    """A parser: the line is the message."""
    return {"message": line, "context": F.lit("{}")}


def json_line(schema: str) -> Parser:
    """A parser for lines of JSON objects with that schema."""

    def parse(line: Column) -> dict[str, Column]:
        x = F.from_json(line, schema)
        return {"message": x["message"], "context": x["context"]}

    return parse


def _parsed(lines: DataFrame, parse: Parser) -> DataFrame:
    line = F.regexp_replace("value", r"^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$", "")
    return lines.select(line.alias("_line")).where("_line <> ''").select(*(c.alias(n) for n, c in parse(F.col("_line")).items()))


def read_lines(spark: SparkSession, path: str, parse: Parser = whole_line) -> DataFrame:
    """Records of a line file: lines are trimmed, blank ones skipped."""
    try:
        return _parsed(spark.read.text(path), parse)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise StreamError("cannot open the input", path=path) from e
        raise


def stream_lines(spark: SparkSession, path: str, parse: Parser = whole_line, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _parsed(reader.text(path), parse)


def write_lines(df: DataFrame, path: str, line: Column) -> int:
    """Write a line for each record, over what is there; the number of records."""
    from pyspark.sql import Observation

    seen = Observation("lines")
    df.select(line.cast("string").alias("value")).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").text(path)
    return seen.get["n"]
