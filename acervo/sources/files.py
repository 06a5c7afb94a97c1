"""Binary files: what they are, and the blocks of word-processor files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
LARGEST_PART = 200 * 1024 * 1024
# Extensions that each detected format may bear.
EXPECTED = {"docx": ["docx", "docm"], "xlsx": ["xlsx", "xlsm"], "zip": ["zip"], "ole": ["doc", "dot", "xls", "msg"], "rtf": ["rtf", "doc"], "wordperfect": ["wpd", "doc"], "pdf": ["pdf"], "image": ["png", "jpg", "jpeg", "tif", "tiff", "gif", "bmp"], "empty": [], "unknown": []}


def by_magic(content: Column) -> Column:
    """Format by the first bytes; zip containers are looked into by detected()."""
    head = F.hex(F.substring(content, 1, 16))
    starts = lambda *marks: F.coalesce(head.rlike("^(" + "|".join(marks) + ")"), F.lit(False))
    return (
        F.when(F.coalesce(F.length(content), F.lit(0)) == 0, "empty")
        .when(starts("504B0304", "504B0506"), "zip")
        .when(starts("D0CF11E0A1B11AE1"), "ole")
        .when(starts("7B5C727466"), "rtf")
        .when(starts("FF575043"), "wordperfect")
        .when(starts("25504446"), "pdf")
        .when(starts("89504E47", "FFD8FF", "49492A00", "4D4D002A", "47494638", "424D"), "image")
        .otherwise("unknown")
    )


def zip_kind(content: bytes) -> tuple[str, bool]:
    """(docx, xlsx or zip; corrupt): by the main part, which must unpack with its checksum."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for part, kind in (("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx")):
                if part in z.namelist():
                    if z.getinfo(part).file_size > LARGEST_PART:
                        return kind, True
                    z.read(part)
                    return kind, False
            return "zip", False
    except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, zipfile.zlib.error):
        return "zip", True


def detected(files: DataFrame) -> DataFrame:
    """(path, length, format, corrupt, encrypted, extension_mismatch) of files with path, length, content."""
    encrypted = F.decode(F.concat(F.substring("content", 1, 65536), F.expr("substring(content, greatest(1, length(content) - 65535), 65536)")), "ISO-8859-1").contains("/Encrypt")
    magic = files.withColumn("magic", by_magic(F.col("content"))).withColumn("encrypted", F.coalesce((F.col("magic") == "pdf") & encrypted, F.lit(False)))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kinds = [zip_kind(c) if m == "zip" else (m, False) for m, c in zip(batch.magic, batch.content, strict=True)]
            yield pd.DataFrame({"path": batch.path, "length": batch.length, "format": [k for k, _ in kinds], "corrupt": [c for _, c in kinds], "encrypted": batch.encrypted})

    out = magic.select("path", "length", "content", "magic", "encrypted").mapInPandas(look, "path string, length long, format string, corrupt boolean, encrypted boolean")
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    expected = F.create_map(*[x for k, v in EXPECTED.items() for x in (F.lit(k), F.array(*[F.lit(e) for e in v]).cast("array<string>"))])
    known = F.try_element_at(expected, F.col("format"))
    return out.withColumn("extension_mismatch", (F.size(known) > 0) & ~F.array_contains(known, extension))


def docx_blocks(content: bytes) -> list[tuple[int, str, str]]:
    """(order, type, text) of a docx body: paragraphs and table cells; deleted text stays out, inserted text in."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    body = root.find(f"{_W}body")
    out: list[tuple[int, str, str]] = []

    def text_of(node: ElementTree.Element) -> str:
        parts = []
        for e in node.iter():
            if e.tag == f"{_W}t":
                parts.append(e.text or "")
            elif e.tag == f"{_W}tab":
                parts.append("\t")
            elif e.tag in (f"{_W}br", f"{_W}cr"):
                parts.append("\n")
        return re.sub(r"[ \t]+", " ", "".join(parts)).strip()

    def add(kind: str, text: str) -> None:
        if text:
            out.append((len(out), kind, text))

    for child in body if body is not None else ():
        if child.tag == f"{_W}p":
            style = child.find(f"{_W}pPr/{_W}pStyle")
            heading = style is not None and re.match(r"(?i)(heading|t[ií]tulo|title)", style.get(f"{_W}val", ""))
            add("title" if heading else "paragraph", text_of(child))
        elif child.tag == f"{_W}tbl":
            for row in child.iter(f"{_W}tr"):
                for cell in row.findall(f"{_W}tc"):
                    add("table_cell", text_of(cell))
    return out


def pdf_blocks(content: bytes) -> list[tuple[int, str, str]]:
    """(order, type, text) of a PDF's native text; needs the optional reader, which is looked for only here."""
    from pypdf import PdfReader

    out: list[tuple[int, str, str]] = []
    for page in PdfReader(io.BytesIO(content)).pages:
        for part in re.split(r"\n\s*\n", page.extract_text() or ""):
            if part.strip():
                out.append((len(out), "paragraph", " ".join(part.split())))
    return out


PARSERS = {"docx": docx_blocks, "pdf": pdf_blocks}


def parsed_blocks(files: DataFrame, parsers: dict | None = None) -> DataFrame:
    """(path, status, error, order_index, block_type, text): blocks of each file; a file that fails is one row that says why, never an exception."""
    use = PARSERS if parsers is None else parsers

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "status", "error", "order_index", "block_type", "text"]
        for batch in batches:
            for path, content, magic in zip(batch.path, batch.content, batch.magic, strict=True):
                kind = zip_kind(content)[0] if magic == "zip" else magic
                try:
                    if kind not in use:
                        raise ValueError(f"no parser for {kind}")
                    rows = [(path, "parsed", None, n, k, t) for n, k, t in use[kind](content)] or [(path, "failed", "no text", None, None, None)]
                except Exception as error:  # noqa: BLE001
                    rows = [(path, "failed", f"{type(error).__name__}: {error}"[:200], None, None, None)]
                frame = pd.DataFrame(rows, columns=columns)
                frame["order_index"] = frame.order_index.astype("Int32")
                yield frame

    picked = files.select("path", "content", by_magic(F.col("content")).alias("magic"))
    return picked.mapInPandas(parse, "path string, status string, error string, order_index int, block_type string, text string")


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder tree with path, length and content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
