"""Files as rows: reading a tree, and accepting files by what they really contain."""

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from attesta import rules
from attesta.functions import text as t
from attesta.functions.similarity import office_kind


#: Files up to this size are hashed where Spark has read them; larger ones piece by piece.
IN_MEMORY = 64 << 20
#: The largest file that one cell holds.
CELL = 2**31 - 1 - (1 << 20)
#: Bytes of a large file read at once.
PIECE = 8 << 20


def _opened(path: str):
    """A file by the path Spark lists it under, which is not escaped."""
    scheme, _, rest = path.partition(":/")
    if scheme in ("", "file"):
        return open(re.sub("^/*", "/", rest if scheme else path), "rb")
    from urllib.parse import quote

    from pyarrow.fs import FileSystem
    files, at = FileSystem.from_uri(quote(path, safe=":/@"))
    return files.open_input_stream(at)


def _bytes_hash(path: str) -> str:
    digest = hashlib.sha256()
    with _opened(path) as f:
        while piece := f.read(PIECE):
            digest.update(piece)
    return digest.hexdigest()


@F.pandas_udf(StringType())
def _file_hash(path: pd.Series) -> pd.Series:
    """SHA-256 of all bytes of each file, of which a piece is held at a time."""
    return path.map(_bytes_hash)


def scan_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """A1. Every file below ``path``: path, file_name, size, modified, content, sha256.

    Spark's file sources list files of zero bytes but read none of them: those are the listed files without a
    row, and get an empty content here (their time of change is not listed, so it is null). A file too large for a
    cell (2 GB) has a null content; its hash and size are of all its bytes. Files over ``IN_MEMORY`` are hashed without
    being held, so who does not ask for their content reads them once, a piece at a time."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(path))

    def part(sizes: Column, content: Column, sha256: Column) -> DataFrame:
        return files.where(sizes).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
                                         content.alias("content"), sha256.alias("sha256"))

    size, content, whole = F.col("length"), F.col("content"), _file_hash("path")
    read = (part(size <= IN_MEMORY, content, F.sha2("content", 256))
            .unionByName(part((size > IN_MEMORY) & (size <= CELL), content, whole))
            .unionByName(part(size > CELL, F.lit(None).cast("binary"), whole)))
    listed = spark.createDataFrame([(f,) for f in files.inputFiles()], "uri string")
    # a listed name is escaped, a path is not
    path = F.regexp_replace(F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B"))), "^file:///", "file:/")
    empty = listed.join(files.select(F.input_file_name().alias("uri")), "uri", "left_anti").select(
        path.alias("path"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("modified"),
        F.lit(b"").alias("content"), F.sha2(F.lit(b""), 256).alias("sha256"))
    return read.unionByName(empty).select(
        "path", F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"), "size", "modified", "content", "sha256")


# How a file of each format begins (hex pattern of its first bytes)
MAGIC = [
    ("pdf", "^25504446"),
    ("jpg", "^FFD8FF"),
    ("png", "^89504E47"),
    ("gif", "^474946"),
    ("webp", "^52494646.{8}57454250"),
    ("tif", "^(49492A00|4D4D002A)"),
    ("bmp", "^424D"),
    ("heic", "^.{8}66747970(68656963|(6D696631|6D736631).*68656963)"),
    ("mp4", "^.{8}66747970(6D70|69736F)"),
    ("rar", "^526172211A07"),
    ("gz", "^1F8B08"),
    ("7z", "^377ABCAF271C"),
    ("exe", "^4D5A"),
    ("zip", "^504B(0304|0506|0708)"),
]
_OLE = "^D0CF11E0A1B11AE1"
_ALIASES = {"jpeg": "jpg", "tiff": "tif"}


def _extension(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"[^/.][^/]*\.([^./]+)$", 1))
    return F.when(ext != "", F.coalesce(F.try_element_at(t.lookup(_ALIASES), ext), ext))


def check_files(files: DataFrame, max_bytes: int = 20 * 1024 * 1024) -> DataFrame:
    """A3. Accept or reject by content: adds ok, extension, mime_type, reason.

    Only zip archives travel to Python, to see whether they hold a Word or Excel file.
    """
    # a file too large for a cell has a size alone
    known = F.col("size") if "size" in files.columns else F.lit(0)
    size = F.coalesce(F.octet_length("content"), F.when(known > CELL, known), F.lit(0))
    head = F.hex(F.substring("content", 1, 48))
    found = F.lit(None).cast("string")
    for kind, pattern in reversed(MAGIC):
        found = F.when(head.rlike(pattern), kind).otherwise(found)
    fits = (size > 0) & (size <= max_bytes)
    df = files.withColumn("__kind", F.when(fits, found))
    df = df.withColumn("__office", office_kind(F.when(F.col("__kind") == "zip",
                                                      F.col("content"))))
    kind = F.coalesce("__office", "__kind")
    named = _extension(F.col("file_name"))
    ole = kind.isNull() & named.isin("doc", "xls") & F.coalesce(head.rlike(_OLE), F.lit(False))
    accepted = (F.when(kind.isin(list(rules.FILE_TYPES)), kind).when(ole & fits, named))
    df = df.withColumn("__ext", accepted)
    return df.select(
        *files.columns, F.col("__ext").isNotNull().alias("ok"), F.col("__ext").alias("extension"),
        F.try_element_at(t.lookup(rules.FILE_TYPES), F.col("__ext")).alias("mime_type"),
        F.when(size == 0, "File is empty")
        .when(size > max_bytes, F.concat(F.lit("File is "), size,
                                         F.lit(f" bytes; limit is {max_bytes}")))
        .when(F.col("__ext").isNull(), F.concat(
            F.lit("Unsupported file type (detected="), F.coalesce(kind, F.lit("unknown")),
            F.lit(", name="), t.quoted("file_name"), F.lit(")"))).alias("reason"))
