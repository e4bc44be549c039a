"""Files as documents: directory scans, dispatch by extension, errors as rows."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlode.functions.text import basename, clean_text, short_hash, stem_title
from lexlode.sources.markup import read_html

KINDS = {"pdf": "pdf", "html": "html", "htm": "html", "txt": "text", "md": "text"}
PdfReader = Callable[[bytes], list[str]]


def extension(path):
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def scan(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Files of known kinds below a folder: path, content, doc_type."""
    if not os.path.exists(folder.removeprefix("file://")) and "://" not in folder:
        raise FileNotFoundError(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder if recursive else f"{folder.rstrip('/')}/*.*")
    kind = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))[extension(F.col("path"))]
    return files.select("path", "content", kind.alias("doc_type")).where("doc_type is not null")


def _pdf(reader: PdfReader | None):
    def run(batches):
        for b in batches:
            texts, errors, pages = [], [], []
            for content in b.column(1).to_pylist():
                try:
                    if reader is None:
                        raise RuntimeError("no PDF reader is installed; pass one as pdf_reader")
                    got = [p for p in reader(content) if p.strip()]
                    texts.append("\n\n".join(got))
                    pages.append(texts[-1].count("\f") + 1)
                    errors.append(None)
                except Exception as e:  # one bad file must not end the scan
                    texts.append(None)
                    pages.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(pages, pa.int32()), pa.array(errors, pa.string())], names=["path", "text", "pages", "error"])
    return run


def load_files(files: DataFrame, pdf_reader: PdfReader | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of scanned files. Each kind goes its own way; text needs no Python."""
    plain = files.where("doc_type = 'text'").select("path", "doc_type", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), stem_title(F.col("path")).alias("title"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("int").alias("pages"))
    page = files.where("doc_type = 'html'").select("path", "content").mapInArrow(read_html, "path string, text string, title string")
    page = page.select("path", F.lit("html").alias("doc_type"), "text", F.coalesce(F.nullif("title", F.lit("")), stem_title(F.col("path"), fold=False)).alias("title"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("int").alias("pages"))
    pdf = files.where("doc_type = 'pdf'").select("path", "content").mapInArrow(_pdf(pdf_reader), "path string, text string, pages int, error string")
    pdf = pdf.select("path", F.lit("pdf").alias("doc_type"), "text", stem_title(F.col("path")).alias("title"), "error", "pages")
    every = plain.unionByName(page).unionByName(pdf)
    meta = F.map_filter(F.create_map(F.lit("file"), basename("path"), F.lit("pages"), F.col("pages").cast("string")), lambda k, v: v.isNotNull())
    docs = every.where("error is null").select(short_hash("path").alias("doc_id"), F.col("path").alias("source"), "doc_type", "title", clean_text("text").alias("text"), meta.alias("metadata"))
    return docs, every.where("error is not null").select(F.col("path").alias("source"), "error")


def safe_name(name: str) -> str:
    """Base name of an uploaded file, without a path or leading dots."""
    return re.sub(r"^\.+", "", re.split(r"[/\\]", name)[-1]) or "upload"


def _write(spark: SparkSession | None, path: str, content: bytes) -> None:
    if spark is None:
        with open(path, "wb") as f:
            f.write(content)
        return
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def save_uploads(uploads: list[tuple[str, bytes]], folder: str, spark: SparkSession | None = None) -> tuple[list[str], list[tuple[str, str]]]:
    """Write uploaded files under safe names, over older ones; returns (paths, errors). Unknown kinds and repeats are refused.

    With a session the folder may be on any file system that it knows, as it must be on
    a cluster; without one it is a folder of this machine.
    """
    if spark is None:
        os.makedirs(folder, exist_ok=True)
    saved, errors, seen = [], [], set()
    for name, content in uploads:
        safe = safe_name(name)
        if safe.rpartition(".")[2].lower() not in KINDS:
            errors.append((name, "unsupported file type"))
        elif (safe, len(content)) not in seen:
            seen.add((safe, len(content)))
            saved.append(f"{folder.rstrip('/')}/{safe}")
            _write(spark, saved[-1], content)
    return saved, errors
