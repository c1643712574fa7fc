"""Uploaded files as rows: validation, decoding, parsing.

Rows have path, length and content, as the binaryFile source gives them. The
path is used for its ending only.
"""

from __future__ import annotations

import io
import multiprocessing
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx

MB = 1024 * 1024


def read_uploads(spark: SparkSession, path: str, max_mb: float = 5.0) -> DataFrame:
    """path, length, content of files; those over the cap come without content, which is never read."""
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= int(max_mb * MB)).select("path", "length", "content")
    large = files.where(F.col("length") > int(max_mb * MB)).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def _ending(path: Column) -> Column:
    """The last dot and what follows, of the file's name; none for a name that starts with its only dot."""
    return F.regexp_extract(F.lower(F.regexp_extract(path, r"([^/]*)$", 1)), r"[^.].*?(\.[^.]*)$", 1)


def zip_problems(uploads: DataFrame, max_mb: float = 5.0) -> DataFrame:
    """path, zip_errors (array) of .docx files with a zip's signature; only their directory is read."""
    cap = int(max_mb * 4 * MB)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                errors = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        sizes = [i.file_size for i in z.infolist()]
                    if len(sizes) > lx.MAX_ZIP_ENTRIES:
                        errors.append("too many entries")
                    if sum(sizes) > cap:
                        errors.append("uncompressed size over the cap")
                    if any(s > cap for s in sizes):
                        errors.append("entry over the cap")
                except zipfile.BadZipFile:
                    errors.append("not a zip archive")
                out.append((path, errors))
            yield pd.DataFrame(out, columns=["path", "zip_errors"])

    docx = uploads.where((_ending(F.col("path")) == ".docx") & F.col("content").isNotNull() & (F.length("content") > 4) & (F.substring("content", 1, 2) == F.lit(b"PK")))
    return docx.select("path", "content").mapInPandas(look, "path string, zip_errors array<string>")


def validate_uploads(uploads: DataFrame, max_mb: float = 5.0, zips: bool = True) -> DataFrame:
    """path, ok, kind (empty if not ok), errors (array), size.

    Empty files, files over the cap and endings that aren't allowed end the
    checks; signatures, zip directories and text are looked at after that.
    """
    c, size = F.col("content"), F.coalesce(F.col("length"), F.lit(0)).cast("long")
    ending = _ending(F.col("path"))
    kind = F.lit(None).cast("string")
    for e, k in lx.UPLOAD_KINDS.items():
        kind = F.when(ending == e, F.lit(k)).otherwise(kind)
    pdf, pk = F.substring(c, 1, 5) == F.lit(b"%PDF-"), (F.length(c) > 4) & (F.substring(c, 1, 2) == F.lit(b"PK"))
    text = F.is_valid_utf8(c.cast("string")) | ~F.contains(F.substring(c, 1, 1024), F.lit(b"\x00"))
    d = uploads
    if zips:
        d = d.join(zip_problems(uploads, max_mb), "path", "left")
    in_zip = F.coalesce(F.col("zip_errors"), F.array().cast("array<string>")) if zips else F.array().cast("array<string>")
    one = lambda m: F.array(F.lit(m))
    none = F.array().cast("array<string>")
    errors = (
        F.when(size == 0, one("file is empty"))
        .when(size > int(max_mb * MB), one("file is over the size cap"))
        .when(kind.isNull(), one("ending is not allowed"))
        .when(kind == "pdf", F.when(pdf, none).otherwise(one("no PDF signature")))
        .when(kind == "docx", F.when(pk, in_zip).otherwise(one("no zip signature")))
        .otherwise(F.when(~text, one("not text")).when(pdf | pk, one("text ending on a PDF or zip")).otherwise(none))
    )
    d = d.withColumn("errors", errors).withColumn("ok", F.size("errors") == 0)
    return d.select("path", "ok", F.when(F.col("ok"), kind).otherwise("").alias("kind"), "errors", size.alias("size"))


def decode(content: Column) -> Column:
    """UTF-8 if it is, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """Paragraphs, then table rows with their cells joined by ' | ', one a line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{W}t"))
    out = [text(p) for p in body.findall(f"{W}p")]
    for row in body.iter(f"{W}tr"):
        out.append(" | ".join("\n".join(text(p) for p in cell.findall(f"{W}p")) for cell in row.findall(f"{W}tc")))
    return "\n".join(out)


def pdf_text(content: bytes) -> str:
    """The text of a PDF by whichever parser is installed, the second where the first fails or finds none."""
    errors = []
    for name in ("pdfminer.high_level", "pypdf"):
        try:
            module = __import__(name, fromlist=["x"])
            if name == "pypdf":
                reader = module.PdfReader(io.BytesIO(content))
                if reader.is_encrypted:
                    raise ValueError("encrypted")
                found = "\n".join(p.extract_text() or "" for p in reader.pages)
            else:
                found = module.extract_text(io.BytesIO(content))
            if found.strip():
                return found
            errors.append(f"{name}: no text")
        except Exception as e:
            errors.append(f"{name}: {type(e).__name__}")
    raise ValueError("; ".join(errors))


class Parsing:
    """A process that parses one file after another; a file that takes too long ends it, and the next one gets another."""

    def __init__(self, parsers: dict[str, Callable[[bytes], str]], timeout_s: float):
        self.parsers, self.timeout_s, self.process, self.pipe = parsers, timeout_s, None, None

    def _serve(self, pipe) -> None:
        while True:
            try:
                kind, content = pipe.recv()
            except EOFError:
                return
            try:
                pipe.send((self.parsers[kind](content), None))
            except Exception as e:
                pipe.send((None, f"{type(e).__name__}: {e}"))

    def parse(self, kind: str, content: bytes) -> tuple[str | None, str | None]:
        """text, error."""
        if self.process is None:
            fork = multiprocessing.get_context("fork")
            self.pipe, theirs = fork.Pipe()
            self.process = fork.Process(target=self._serve, args=(theirs,), daemon=True)
            self.process.start()
            theirs.close()
        try:
            self.pipe.send((kind, content))
            if self.pipe.poll(self.timeout_s):
                return self.pipe.recv()
            error = "parsing took too long"
        except (EOFError, OSError):
            error = "the parser died"
        self.end()
        return None, error

    def end(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.pipe.close()
            self.process = None


def parse_uploads(valid: DataFrame, timeout_s: float = 15.0, parsers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """path, kind, text, error, warning of valid uploads (path, kind, content).

    Text is decoded in the JVM; other kinds go through a parser in a process of
    its own, which a time limit ends. A failure is a row with an error.
    """
    parse = {"docx": docx_text, "pdf": pdf_text} | (parsers or {})
    plain = valid.where(F.col("kind") == "text").select("path", "kind", decode(F.col("content")).alias("text"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("warning"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work = Parsing(parse, timeout_s)
        try:
            for b in batches:
                rows = []
                for path, kind, content in zip(b["path"], b["kind"], b["content"], strict=True):
                    text, error = work.parse(kind, content)
                    rows.append((path, kind, text, error, "the order of a PDF's text is a guess" if kind == "pdf" and text else None))
                yield pd.DataFrame(rows, columns=["path", "kind", "text", "error", "warning"])
        finally:
            work.end()

    other = valid.where(F.col("kind") != "text").select("path", "kind", "content").mapInPandas(run, "path string, kind string, text string, error string, warning string")
    return plain.unionByName(other)


def scan_text(docs: DataFrame, max_mb: float = 5.0) -> DataFrame:
    """doc_id, source_name, n_bytes, ok of pasted texts: not null and within the cap in UTF-8."""
    n = F.octet_length("text")
    name = F.concat(F.lit("paste_"), F.substring(F.md5(F.coalesce(F.col("text"), F.lit(""))), 1, 12))
    return docs.select("doc_id", name.alias("source_name"), F.coalesce(n, F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(n <= int(max_mb * MB), F.lit(False)).alias("ok"))
