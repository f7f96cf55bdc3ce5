"""Sources and sinks: text lines, folders of texts, tables as CSV, JSON and Parquet, lexicons, incremental appends."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomtext.operators.select import row_index

#: Bytes of files that a task gives out at once.
BATCH_BYTES = 1 << 22


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value, line): lines in order within each file; blank lines and rulers go. The line number is an order within
    its file, not a count."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value", F.col("_metadata.file_block_start").alias("block"))
    ordered = lines.withColumn("line", F.monotonically_increasing_id())
    return ordered.where((F.trim("value") != "") & ~F.col("value").startswith("----")).select("file", "value", "line")


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """(filename, text): one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("text"))


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", compression: str | None = None) -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path, compression=compression)


def write_text_by_key(df: DataFrame, key: str, text: str, path: str) -> None:
    """A folder for each key, with its text."""
    df.select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)


def _sub_folders(spark: SparkSession, parts: int | range) -> DataFrame:
    parts = range(parts) if isinstance(parts, int) else parts
    return spark.range(parts.start, parts.stop, 1, max(len(parts), 1))


def read_spread(spark: SparkSession, path: str, parts: int | range) -> DataFrame:
    """(filename, text) of the files that ``write_files`` spread over sub-folders, or of some of these. Each task lists and reads its own
    sub-folder, so the driver holds no list of files."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _file_system(path)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                names, texts, held = [], [], 0
                for info in fs.get_file_info(pafs.FileSelector(f"{folder}/{part}", allow_not_found=True)):
                    if info.type != pafs.FileType.File or info.base_name[0] in "._":
                        continue
                    with fs.open_input_stream(info.path) as file:
                        texts.append(file.read().decode(errors="replace"))
                    names.append(info.base_name)
                    held += info.size
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["filename", "text"])
                        names, texts, held = [], [], 0
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["filename", "text"])

    return _sub_folders(spark, parts).mapInArrow(rows, "filename string, text string")


def remove_spread(spark: SparkSession, path: str, parts: int | range) -> int:
    """Removes the files of sub-folders that ``write_files`` made, each by a task; returns the number of sub-folders."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _file_system(path)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                fs.delete_dir_contents(f"{folder}/{part}", missing_dir_ok=True)
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

    return _sub_folders(spark, parts).mapInArrow(rows, "n long").agg(F.sum("n")).first()[0] or 0


def write_files(df: DataFrame, name: str, text: str, path: str, spread: int | None = None) -> int:
    """One file a row, under the row's name in a folder that the cluster shares, or in one of ``spread`` sub-folders of it by a hash of
    the name; a repeated attempt writes the same file again. Returns the number of files."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _file_system(path)
        for part in [""] if spread is None else [f"/{i}" for i in range(spread)]:
            fs.create_dir(f"{folder}{part}", recursive=True)
        for batch in batches:
            for own, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                where = folder if spread is None else f"{folder}/{zlib.crc32(own.encode()) % spread}"
                with fs.open_output_stream(f"{where}/{own}") as file:
                    file.write((body or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

    return df.select(F.col(name).cast("string"), F.col(text).cast("string")).mapInArrow(rows, "n long").agg(F.sum("n")).first()[0] or 0


def numbered_names(df: DataFrame, *order: Column, pattern: str = "dialog_%05d.txt", start: int = 1) -> DataFrame:
    """Adds ``filename``: the pattern with the row's number in an order."""
    return row_index(df, *order, name="__row").withColumn("filename", F.format_string(pattern, F.col("__row") + start)).drop("__row")


def split_summaries(df: DataFrame, path: str) -> None:
    """(id, src, sys) rows as two folders of files named by id: sources and summaries."""
    named = df.withColumn("__file", F.concat(F.col("id").cast("string"), F.lit(".txt")))
    for column in ("src", "sys"):
        write_files(named, "__file", column, f"{path}/{column}")


def write_log(df: DataFrame, path: str, kind: str = "json") -> None:
    """Appends rows to a log: json, csv or tsv, with a header where the kind has one."""
    writer = df.write.mode("append")
    if kind == "json":
        writer.json(path)
    elif kind in ("csv", "tsv"):
        writer.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    else:
        raise ValueError("logs are json, csv or tsv")


def read_log(spark: SparkSession, path: str, schema: StructType | str, kind: str = "json") -> DataFrame:
    if kind == "json":
        return spark.read.schema(schema).json(path)
    return spark.read.csv(path, schema=schema, header=True, sep="\t" if kind == "tsv" else ",")


def lexicon_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(value, line) of one or several lexicon files; later files come later."""
    parts = [spark.read.text(p).select("value", (F.lit(i << 48).cast("long") + F.monotonically_increasing_id()).alias("line")) for i, p in enumerate(paths)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_json_folder(spark: SparkSession, path: str, schema: StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    """Rows with ``task``, the file's name without its suffix."""
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).json(path).withColumn("task", F.regexp_replace("_metadata.file_name", r"\.jsonl?$", ""))


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def save_table(df: DataFrame, path: str) -> DataFrame:
    """Writes once and reads back, in place of a pickle or a hub data set."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def list_lexicon(lines: DataFrame, lower: bool = False) -> DataFrame:
    """``head TAB value TAB value ...`` lines (value, line) -> (word, syns); the last line of a head counts."""
    parts = F.split(F.lower("value") if lower else F.col("value"), "\t")
    rows = lines.where((F.col("value") != "") & ~F.col("value").startswith("#")).select(parts.alias("p"), "line").where(F.size("p") >= 2)
    return rows.groupBy(F.get("p", F.lit(0)).alias("word")).agg(F.max_by(F.slice("p", F.lit(2), F.size("p")), "line").alias("syns"))


def vector_lexicon(lines: DataFrame) -> DataFrame:
    """``head TAB v0 v1 ...`` lines -> (word, vec); lower-cased, the first component is left out, the last line counts."""
    parts = F.split(F.lower("value"), "\t")
    rows = lines.where((F.col("value") != "") & ~F.col("value").startswith("#")).select(F.get(parts, F.lit(0)).alias("word"), F.split(F.get(parts, F.lit(1)), " ").alias("v"), "line").where(F.size("v") >= 2)
    return rows.groupBy("word").agg(F.max_by(F.transform(F.slice("v", F.lit(2), F.size("v")), lambda x: x.cast("double")), "line").alias("vec"))


def number_lexicon(lines: DataFrame, column: int, log: bool = False) -> DataFrame:
    """A column of tab-separated lines by word, lower-cased; its logarithm to base 10 on demand, zeros then left out."""
    parts = F.split(F.lower("value"), "\t")
    rows = lines.where((F.col("value") != "") & ~F.col("value").startswith("#")).select(F.get(parts, F.lit(0)).alias("word"), F.get(parts, F.lit(column)).cast("double").alias("x"), "line")
    rows = rows.where("x <> 0").withColumn("x", F.log10("x")) if log else rows
    return rows.groupBy("word").agg(F.max_by("x", "line").alias("value"))


def parse_metric_struct(column: str, names: list[str]):
    """A dictionary's printed form, single quotes and all, as a struct of doubles."""
    schema = ", ".join(f"`{n}` double" for n in names)
    return F.from_json(F.translate(F.col(column), "'", '"'), schema)
