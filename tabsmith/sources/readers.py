"""Readers for untidy files."""

from __future__ import annotations

import csv
import io
import zipfile
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from tabsmith.functions.columns import col, md5_number, quote, select_with, string_columns
from tabsmith.functions.stats import null_count
from tabsmith.operators.clean import (
    TABLE_NULL_TOKENS,
    drop_empty_columns,
    drop_empty_rows,
    null_tokens,
    number,
)
from tabsmith.operators.dates import flexible_timestamp
from tabsmith.operators.profile import infer_types

CORRUPT = "_corrupt_record"
DELIMITERS = [",", ";", "\t", "|"]
FILE = "_metadata.file_path"
FROM = "_from_file"

# The characters windows-1252 has where ISO-8859-1 has controls.
CP1252_CODES = [
    0x80, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x8B, 0x8C, 0x8E,
    0x91, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0x9B, 0x9C, 0x9E, 0x9F,
]
CP1252_LATIN = "".join(chr(c) for c in CP1252_CODES)
CP1252_TEXT = bytes(CP1252_CODES).decode("cp1252")


def read_csv_text(spark: SparkSession, path, **options) -> DataFrame:
    """CSV with header as texts; a line that does not fit is kept in
    `_corrupt_record` and reading goes on."""
    settings = {"header": True, "escape": '"', **options}
    header = spark.read.options(**settings).csv(path)
    fields = [f"{'`' + f.name.replace('`', '``') + '`'} string" for f in header.schema]
    schema = ", ".join([*fields, f"{CORRUPT} string"])
    return spark.read.options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, **settings).schema(schema).csv(path)


def read_csv(spark: SparkSession, path, tokens: list[str] = TABLE_NULL_TOKENS, **options) -> DataFrame:
    """A1: texts, null tokens, then the narrowest type that reads every value."""
    clean = null_tokens(read_csv_text(spark, path, **options).drop(CORRUPT), tokens)
    return cast_inferred(clean)


def cast_inferred(df: DataFrame) -> DataFrame:
    """Cast text columns to their inferred type; one aggregate decides."""
    found = {r["column"]: r["type"] for r in infer_types(df).collect()}
    casts = {
        "integer": lambda c: F.trim(c).try_cast("bigint"),
        "float": lambda c: number(F.trim(c)),
        "datetime": flexible_timestamp,
    }
    return select_with(df, {c: casts[found[c]](col(c)) for c in string_columns(df) if found[c] in casts})


def _lines(spark: SparkSession, path) -> DataFrame:
    """(file, value, block, place): lines in file order within a block.

    The text source keeps the bytes of a line, whatever their encoding.
    """
    return spark.read.text(path).select(
        F.col(FILE).alias("file"), "value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")
    )


def first_lines(spark: SparkSession, path, n: int) -> DataFrame:
    """(file, value, line): the first n lines of each file, read from its first
    block only; the rank limit is applied before rows are moved."""
    head = _lines(spark, path).filter("block = 0")
    line = F.row_number().over(W.partitionBy("file").orderBy("place"))
    return head.withColumn("line", line).filter(F.col("line") <= n).select("file", "value", "line")


def detect_delimiter(spark: SparkSession, path, lines: int = 10) -> DataFrame:
    """A2: (file, delimiter): the candidate with equal counts in every line,
    else the most frequent one, else the comma."""
    head = first_lines(spark, path, lines).filter(F.col("value") != "")
    counts = head.select(
        "file",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(d).alias("d"),
                        F.lit(-i).alias("place"),
                        (F.length("value") - F.length(F.replace("value", F.lit(d), F.lit("")))).alias("n"),
                    )
                    for i, d in enumerate(DELIMITERS)
                ]
            )
        ).alias("c"),
    )
    per = counts.groupBy("file", "c.d", "c.place").agg(
        F.min("c.n").alias("lo"), F.max("c.n").alias("hi"), F.sum("c.n").alias("total")
    )
    steady = (F.col("lo") == F.col("hi")) & (F.col("lo") > 0)
    best = per.groupBy("file").agg(F.max_by(F.struct("d", "total"), F.struct(steady, F.col("total"), F.col("place"))).alias("b"))
    return best.select("file", F.when(F.col("b.total") > 0, F.col("b.d")).otherwise(",").alias("delimiter"))


def read_csv_robust(spark: SparkSession, path) -> tuple[DataFrame, int]:
    """A3: try ever more lenient settings; the first result with rows wins.

    Files are read with their own delimiter, those of one delimiter together,
    and put under each other by column name. Lines with too many fields are
    skipped, lines with too few are padded. Returns the frame and the number of
    the most lenient setting used.
    """
    files: dict[str, list[str]] = {}
    for r in detect_delimiter(spark, path).orderBy("file").collect():
        files.setdefault(r["delimiter"], []).append(unquote(r["file"]))
    parts = [_lenient(spark, files[d], d) for d in sorted(files)]
    parts = [p for p in parts if p]
    if not parts:
        raise ValueError(f"nothing can be read from {path}")
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df for df, _ in parts])
    return whole, max(place for _, place in parts)


def _lenient(spark: SparkSession, files: list[str], delimiter: str) -> tuple[DataFrame, int] | None:
    """Rows of files of one delimiter and the setting that gave them."""
    ladder = [
        {"sep": delimiter, "ignoreLeadingWhiteSpace": True},
        {"sep": delimiter, "ignoreLeadingWhiteSpace": True, "multiLine": True},
        {"sep": delimiter, "ignoreLeadingWhiteSpace": True, "quote": ""},
        {"sep": ",", "ignoreLeadingWhiteSpace": True},
        {"sep": "\u0001", "quote": ""},
    ]
    for place, options in enumerate(ladder):
        df = read_csv_text(spark, files, **options)
        width = len(df.columns) - 1
        fields = F.size(F.split(F.col(CORRUPT), "\\Q" + options["sep"] + "\\E", -1))
        kept = df.filter(F.col(CORRUPT).isNull() | (fields <= width)).drop(CORRUPT)
        if width > 0 and kept.head(1):
            return tidy_columns(kept), place + 1


def repair_lines(spark: SparkSession, path, delimiter: str = ",", expected: int | None = None) -> DataFrame:
    """A4: every non-blank line cut or padded to the width of the header.

    The CSV reader is used only to skip the header line of each file.
    """
    header = spark.read.text(path).filter(F.col("value").rlike(r"\S")).first()["value"].split(delimiter)
    width = expected or len(header)
    names = (header + [f"column_{i}" for i in range(len(header), width)])[:width]
    raw = spark.read.schema("value string").options(header=True, sep="\u0001", quote="", enforceSchema=True).csv(path)
    parts = F.split("value", "\\Q" + delimiter + "\\E", -1)
    padded = F.slice(F.concat(parts, F.array_repeat(F.lit(""), width)), 1, width)
    fields = raw.filter(F.col("value").rlike(r"\S")).select(padded.alias("f"))
    return fields.select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)])


def normalise_encoding(spark: SparkSession, path) -> DataFrame:
    """A5: (file, encoding, place, value) with every line as valid UTF-8.

    A file is UTF-8 if all its lines are, else windows-1252, or ISO-8859-1 if
    it has a byte windows-1252 leaves undefined. Lines are decoded one by one,
    so files of any size are split over tasks. The text source itself skips the
    byte order mark of UTF-8.
    """
    lines = _lines(spark, path)
    raw = F.col("value").cast("binary")
    latin = F.decode(raw, "ISO-8859-1")
    undefined = latin.rlike("[\\u0081\\u008d\\u008f\\u0090\\u009d]")
    ascii_only = F.octet_length("value") == F.length(F.regexp_replace(latin, "[^\\x00-\\x7f]", ""))
    marked = lines.withColumns(
        {"valid": F.is_valid_utf8("value"), "odd": undefined, "plain": ascii_only}
    )
    verdict = marked.groupBy("file").agg(
        F.min("valid").alias("valid"), F.max("odd").alias("odd"), F.min("plain").alias("plain")
    )
    encoding = (
        F.when(F.col("plain"), "ascii")
        .when(F.col("valid"), "utf-8")
        .when(~F.col("odd"), "windows-1252")
        .otherwise("iso-8859-1")
    )
    named = verdict.select(F.col("file").alias("_f"), encoding.alias("encoding"))
    joined = lines.join(named, F.col("file") == F.col("_f"))  # few files: chosen by size at run time
    text = (
        F.when(F.col("encoding") == "windows-1252", F.translate(latin, CP1252_LATIN, CP1252_TEXT))
        .when(F.col("encoding") == "iso-8859-1", latin)
        .otherwise(F.col("value"))
    )
    return joined.select("file", "encoding", "place", text.alias("value"))


def tidy_names(names: list[str]) -> list[str]:
    """Trimmed names; a name that occurs twice gets its position."""
    trimmed = [n.strip() for n in names]
    return [f"{n}_{i}" if trimmed.count(n) > 1 else n for i, n in enumerate(trimmed)]


def tidy_columns(df: DataFrame) -> DataFrame:
    """Drop empty rows and columns, then tidy the names."""
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    kept = drop_empty_columns(drop_empty_rows(flat))
    places = [int(c[1:]) for c in kept.columns]
    return kept.toDF(*tidy_names([df.columns[i] for i in places]))


MEMBERS = (".csv", ".txt")
MEMBER_LINES = 10_000


def read_archives(spark: SparkSession, path) -> DataFrame:
    """(archive, member, line, value) of the text members of ZIP files."""
    return unpack_archives(spark.read.format("binaryFile").load(path).select("path", "content"))


def unpack_archives(files: DataFrame) -> DataFrame:
    """Text members of (path, content) rows, as lines.

    A ZIP file cannot be split, so an archive is one row; its members are
    streamed out in batches of lines. Hidden and metadata members are left out.
    A file that is no archive is reported with a null member.
    """
    endings, size = MEMBERS, MEMBER_LINES
    columns = ["archive", "member", "line", "value"]

    def lines(archive, content):
        if bytes(content[:4]) != b"PK\x03\x04":
            yield archive, None, None, None
            return
        with zipfile.ZipFile(io.BytesIO(content)) as packed:
            for name in sorted(packed.namelist()):
                base = name.rsplit("/", 1)[-1]
                hidden = not base or base.startswith((".", "__")) or "__MACOSX" in name
                if hidden or not base.lower().endswith(endings):
                    continue
                with packed.open(name) as member:
                    for place, line in enumerate(io.TextIOWrapper(member, encoding="utf-8-sig", errors="replace")):
                        yield archive, name, place, line.rstrip("\r\n")

    def unpack(batches):
        for pdf in batches:
            held = []
            for archive, content in zip(pdf["path"], pdf["content"]):
                for row in lines(archive, content):
                    held.append(row)
                    if len(held) == size:
                        yield pd.DataFrame(held, columns=columns).astype({"line": "Int64"})
                        held = []
            if held:
                yield pd.DataFrame(held, columns=columns).astype({"line": "Int64"})

    return files.mapInPandas(unpack, "archive string, member string, line bigint, value string")


def read_many(spark: SparkSession, path, schema=None, keep_bad: bool = True, **options) -> tuple[DataFrame, DataFrame]:
    """A10: rows of many files and one report row per file.

    Every file is read by its own header, files of one header together, and
    columns are aligned by name. The columns of the result are those of
    `schema`, else texts under the header that most files have (the wider one
    on a tie). A file whose header has not exactly these names, in any order, or
    without a readable row is reported as failed; the others go on. `keep_bad`
    keeps the rows that do not fit, as far as they could be read.
    """
    heads: dict[str, list[str]] = {}
    for r in first_lines(spark, path, 1).orderBy("file").collect():
        heads.setdefault(r["value"].removeprefix("\ufeff"), []).append(unquote(r["file"]))
    sep = options.get("sep", ",")
    names = {h: next(csv.reader([h], delimiter=sep), []) for h in heads}
    if schema is not None:
        kinds = {f.name: f.dataType.simpleString() for f in _struct(schema)}
    elif heads:
        best = min(heads, key=lambda h: (len(names[h]) < 2, -len(heads[h]), -len(names[h]), h))
        kinds = dict.fromkeys(names[best], "string")
    else:
        kinds = {}
    read, failed = [], []
    for h, files in heads.items():
        if sorted(names[h]) != sorted(kinds):
            failed.append((h, files))
            continue
        fields = ", ".join([*(f"{quote(n)} {kinds[n]}" for n in names[h]), f"{CORRUPT} string"])
        settings = {"header": True, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, **options}
        df = spark.read.options(**settings).schema(fields).csv(files)
        read.append(df.select(*[col(n) for n in kinds], CORRUPT, F.col(FILE).alias(FROM)))
    empty = ", ".join([*(f"{quote(n)} {k}" for n, k in kinds.items()), f"{CORRUPT} string", f"{FROM} string"])
    rows = reduce(DataFrame.unionAll, read) if read else spark.createDataFrame([], empty)
    missing = sum((null_count(col(c)) for c in kinds), F.lit(0))
    good = F.count(F.when(F.col(CORRUPT).isNull(), 1))
    # Caching the parsed rows is not needed: the report is one grouped pass.
    report = rows.groupBy(F.col(FROM).alias("file")).agg(
        F.count("*").alias("rows"), F.count(CORRUPT).alias("bad_rows"), missing.alias("missing"),
        F.when(good > 0, "ok").otherwise("failed").alias("status"),
    )
    for h, files in failed:
        lines = F.count("*") - 1
        absent = len(set(kinds) - set(names[h]))
        report = report.unionAll(
            spark.read.text(files).groupBy(F.col(FILE).alias("file")).agg(
                lines.alias("rows"), lines.alias("bad_rows"), (lines * absent).alias("missing"), F.lit("failed").alias("status")
            )
        )
    kept = rows if keep_bad else rows.filter(F.col(CORRUPT).isNull())
    return kept.drop(CORRUPT, FROM), report


def _struct(schema) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def sample_rows(df: DataFrame, key: str, n: int = 10_000, seed: int = 42) -> DataFrame:
    """N rows with the smallest seeded hash of their key; repeatable."""
    return df.orderBy(md5_number(col(key), F.lit(seed)), col(key)).limit(n)


def preview(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first n rows by key."""
    return df.orderBy(col(key)).limit(n)


def preview_pair(before: DataFrame, after: DataFrame, key: str, n: int = 5) -> DataFrame:
    """First rows of both frames as JSON, side by side by key."""
    side = lambda df, name: preview(df, key, n).select(
        col(key).alias("key"), F.to_json(F.struct(*[col(c) for c in df.columns])).alias(name)
    )
    left, right = side(before, "before").alias("l"), side(after, "after").alias("r")
    joined = left.join(right, F.col("l.key") == F.col("r.key"), "full")
    return joined.select(F.coalesce("l.key", "r.key").alias("key"), "before", "after")
