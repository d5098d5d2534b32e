"""Markdown files as documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import glob_pattern

SUFFIXES = ("md", "markdown", "mdown", "mkdn", "mdtxt")


@dataclass(frozen=True)
class Source:
    path: str
    excludes: tuple[str, ...] = ()
    source_id: str = ""


def scan(spark: SparkSession, sources: list[Source], content: bool = True) -> DataFrame:
    """Every Markdown file below the sources: source_id, source_root, document_id, file_path, relative_path, mtime_ns, size and, with
    content, file_hash and text. Without content only the file listing is read.

    A source may be one file. Bytes that are no UTF-8 become U+FFFD; a byte-order mark is dropped.
    """
    every = None
    for s in sources:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(s.path)
        if not content:
            files = files.drop("content")
        root = s.path.rstrip("/")
        path = F.regexp_replace("path", "^file:/*", "/")
        plain = F.lit("/" + root.removeprefix("file:").lstrip("/"))
        below = F.when(path == plain, F.substring_index(path, "/", -1)).otherwise(F.expr("substring(p, length(r) + 2)"))
        rows = files.withColumn("p", path).withColumn("r", plain).withColumn("relative_path", below).filter(F.col("p").rlike(rf"(?i)\.({'|'.join(SUFFIXES)})$"))
        name = F.substring_index("p", "/", -1)
        for g in s.excludes:
            rows = rows.filter(~(F.col("relative_path").rlike(glob_pattern(g)) | F.col("p").rlike(glob_pattern(g)) | name.rlike(glob_pattern(g))))
        source_id = F.lit(s.source_id) if s.source_id else F.substring(F.sha1(F.col("r").cast("binary")), 1, 12)
        columns = [source_id.alias("source_id"), F.col("r").alias("source_root"), F.concat(source_id, F.lit(":"), "relative_path").alias("document_id"), F.col("p").alias("file_path"), "relative_path", (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size")]
        if content:
            columns += [F.sha2("content", 256).alias("file_hash"), F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r"^\x{FEFF}", "").alias("text")]
        rows = rows.select(*columns)
        every = rows if every is None else every.unionByName(rows)
    if every is None:
        raise ValueError("no source")
    return every


def titled(docs: DataFrame, text: str = "text", path: str = "relative_path") -> DataFrame:
    """docs with title (the first heading outside fences, else the file's stem), language and tags: for a derived corpus."""
    from quillspark.functions.text import file_stem, language_guess, let
    from quillspark.operators.cleaning import ATX, FENCE

    lines = F.split(text, "\n", -1)
    outside = let(lines, lambda ls: F.filter(F.transform(ls, lambda x, i: F.when(x.rlike(ATX) & (F.size(F.filter(F.slice(ls, F.lit(1), i), lambda y: y.rlike(FENCE))) % 2 == 0), F.regexp_extract(x, ATX, 2))), lambda t: t.isNotNull()))
    stem = file_stem(F.col(path))
    parts = F.split(F.regexp_replace(path, r"/?[^/]*$", ""), "/")
    return docs.withColumns({"title": F.coalesce(F.get(outside, F.lit(0)), stem), "language": language_guess(F.col(text)), "tags": F.array_distinct(F.filter(F.concat(parts, F.array(stem)), lambda t: t != ""))})


def manifest(corpus: DataFrame, category: str = "category") -> DataFrame:
    """Documents by category and language."""
    return corpus.groupBy(category, "language").agg(F.count("*").alias("documents"))
