"""Files as sources: admission, kinds, decoding."""

from __future__ import annotations

import io
import zipfile
import zlib
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .pdf import pdf_text

# Extensions and media types that are accepted and refused.
ACCEPTED = ("csv", "docx", "json", "pdf", "txt")
DOCX_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
ACCEPTED_TYPES = ("application/pdf", DOCX_TYPE, "text/plain", "text/csv", "application/json")
REFUSED = ("exe", "dll", "bat", "cmd", "com", "msi", "zip", "rar", "7z", "png", "jpg", "jpeg", "gif", "mp4")
REFUSED_TYPES = ("application/x-msdownload", "application/zip", "application/x-rar-compressed", "video/mp4", "image/png", "image/jpeg")
MAX_BYTES = 10 * 1024 * 1024


def file_name(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"[^\w.\-()\s]", "_")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def _is(mime: Column | None, *types: str) -> Column:
    return F.lit(False) if mime is None else F.coalesce(mime.isin(*types), F.lit(False))


def upload_reason(name: Column, mime: Column) -> Column:
    """Why an upload is turned away, null if it is not: extension and media type must both be accepted ones."""
    hidden = F.rlike(F.lower(name), F.lit(r"\.(pdf|docx|txt|csv|json)\."))
    return F.when(hidden, "hidden extension").when(~extension(name).isin(*ACCEPTED) | ~_is(mime, *ACCEPTED_TYPES), "type not allowed")


def reject_reason(name: Column, size: Column, mime: Column | None = None) -> Column:
    """Null for an admissible file. A media type, where one is known, can refuse a file, not admit it."""
    return (
        F.when(size == 0, "empty input")
        .when(size > MAX_BYTES, "too large")
        .when(F.rlike(F.lower(name), F.lit(r"\.(pdf|docx|txt|csv|json)\.")), "hidden extension")
        .when(extension(name).isin(*REFUSED) | _is(mime, *REFUSED_TYPES), "unsupported source")
        .when(extension(name) == "", "missing extension")
        .when(~extension(name).isin(*ACCEPTED), "unsupported source")
    )


def source_type(name: Column, mime: Column | None = None) -> Column:
    n = F.lower(name)
    rows = (extension(n) == "csv") | _is(mime, "text/csv")
    return F.when(rows, "job-board").when(extension(n) == "json", "ats").when(F.contains(n, F.lit("recruiter")) | F.contains(n, F.lit("notes")), "manual").otherwise("resume")


def parser(name: Column, mime: Column | None = None) -> Column:
    """The first parser that takes a file by its media type or extension: rows, JSON, PDF, word processor, text."""
    e = extension(name)
    return (
        F.when((e == "csv") | _is(mime, "text/csv"), "CsvParser")
        .when((e == "json") | _is(mime, "application/json"), "JsonParser")
        .when((e == "pdf") | _is(mime, "application/pdf"), "PdfParser")
        .when((e == "docx") | _is(mime, DOCX_TYPE), "DocxParser")
        .otherwise("TextParser")
    )


#: What Windows-1252 has where Latin-1 has controls; the five places it leaves free are unreadable.
_CONTROLS = bytes(range(0x80, 0xA0)).decode("latin-1")
_WINDOWS = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")


def _wide(content: Column) -> Column:
    """UTF-16: a byte order mark, or a NUL among the first 16 bytes."""
    head = F.hex(F.substring(content, 1, 16))
    return F.rlike(head, F.lit("^(FEFF|FFFE)")) | F.rlike(head, F.lit("^(?:..)*?00"))


def decoded(content: Column) -> Column:
    """Text of bytes that are no UTF-16: UTF-8 if they are valid, else Windows-1252; NULs and marks dropped, trimmed. Never fails."""
    other = F.translate(F.decode(content, "ISO-8859-1"), _CONTROLS, _WINDOWS)
    text = F.regexp_replace(F.coalesce(F.try_validate_utf8(content.cast("string")), other), "[\\x00\\uFEFF\\uFFFE]", "")
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def wide_text(content: bytes) -> str:
    """UTF-16 by its mark, little-endian without one; what is no text is replaced."""
    text = content.decode("utf-16-be" if content[:2] == b"\xfe\xff" else "utf-16-le", "replace")
    return text.replace("\0", "").replace("\ufeff", "").strip()


def described(listed: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Adds source_name and source_type to files (ord, name): from the descriptor at the same place, else the first of the
    same file name; what neither gives is the name without its extension, and the type the name suggests.

    ``descriptors``: ord, file_name, source_name, source_type. Repeated places count once, the smallest descriptor.
    """
    said = F.struct(F.col("source_name").alias("name"), F.col("source_type").alias("type"))
    at = descriptors.groupBy("ord").agg(F.min(said).alias("_at"))
    named = descriptors.filter("file_name is not null").groupBy(F.col("file_name").alias("name")).agg(F.min_by(said, "ord").alias("_named"))
    d = listed.join(at, "ord", "left").join(named, "name", "left").withColumn("_said", F.coalesce("_at", "_named"))
    stem = F.regexp_replace("name", r"(?<=.)\.[^.]*$", "")
    d = d.withColumn("source_name", F.coalesce("_said.name", stem)).withColumn("source_type", F.coalesce("_said.type", source_type(F.col("name"))))
    return d.drop("_at", "_named", "_said")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder: name, type, parser, reject_reason and content; sizes over the limit keep their row, not their content.
    Spark's reader leaves out files without any bytes."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = file_name(F.col("path"))
    f = f.select("path", name.alias("name"), F.col("length").alias("size"), "content").withColumn("reject_reason", reject_reason(F.col("name"), F.col("size")))
    kept = F.when(F.col("reject_reason").isNull(), F.col("content"))
    return f.select("path", "name", "size", "reject_reason", source_type(F.col("name")).alias("source_type"), parser(F.col("name")).alias("parser"), kept.alias("content"))


#: Bytes a word-processor file's text part may unpack to.
MOST_UNPACKED = 64 << 20


def docx_text(content: bytes) -> tuple[str | None, str | None]:
    """(text, None): the paragraphs of a word-processor file, or (None, why it has none)."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            if z.getinfo("word/document.xml").file_size > MOST_UNPACKED:
                return None, "too large"
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, zlib.error, KeyError, ElementTree.ParseError, RuntimeError, NotImplementedError, OSError, EOFError, ValueError):
        return None, "malformed: no word-processor file"
    text = "\n\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p")).strip()
    return (text, None) if text else (None, "empty input")


def _unpacked(parser: str, content: bytes) -> tuple[str | None, str | None]:
    if parser == "PdfParser":
        return pdf_text(content)
    return docx_text(content) if parser == "DocxParser" else (wide_text(content), None)


def contents(files: DataFrame) -> DataFrame:
    """(path, parser, text, error) of admitted files of all kinds. A file that cannot be read has a null text and says why; it costs no other.

    UTF-8 and Windows-1252 are decoded by expressions; UTF-16, PDF and word-processor files one at a time in Arrow batches.
    """
    if "content" not in files.columns:
        return files  # read already
    f = files.filter("content is not null").select("path", "parser", "content")
    packed = F.col("parser").isin("PdfParser", "DocxParser") | _wide(F.col("content"))

    def batch(batches):
        for b in batches:
            for i in range(b.num_rows):  # a file at a time: its bytes and text are let go before the next
                path, parser_, content = (b.column(c)[i].as_py() for c in range(3))
                text, error = _unpacked(parser_, content)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (path, parser_, text, error)], names=["path", "parser", "text", "error"])

    plain = f.filter(~packed).select("path", "parser", decoded(F.col("content")).alias("text"), F.lit(None).cast("string").alias("error"))
    return plain.unionByName(f.filter(packed).mapInArrow(batch, "path string, parser string, text string, error string"))


def texts(files: DataFrame) -> DataFrame:
    """(path, text, error) of text, word-processor and PDF files."""
    return contents(files).filter("parser in ('TextParser', 'DocxParser', 'PdfParser')").select("path", "text", "error")


def json_records(files: DataFrame) -> DataFrame:
    """(path, row_no, record VARIANT) of JSON files, or of their :func:`contents`: an array's objects, a ``candidates`` list's, or the object itself, each with its place; malformed texts give none."""
    v = contents(files).filter("parser = 'JsonParser' and text is not null").select("path", F.try_parse_json("text").alias("v"))
    v = v.filter("v is not null").withColumn("list", F.coalesce(F.try_variant_get("v", "$.candidates", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"), F.array("v")))
    return v.select("path", F.posexplode("list").alias("row_no", "record")).withColumn("row_no", F.col("row_no").cast("long")).filter("schema_of_variant(record) like 'OBJECT%'")
