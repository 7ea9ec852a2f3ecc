"""Text of office files. docx, xlsx and pptx are read as zipped XML; pdf needs an optional library."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.functions import paths as P
from corpuslake.sources.notes import _plain

SUPPORTED, LEGACY = (".docx", ".xlsx", ".pptx", ".pdf"), (".doc", ".xls", ".ppt")
MOST_CHARS, MOST_ROWS = 200_000, 2000
CUT = "\n\n[truncated]"


def scan_office(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUPPORTED) -> DataFrame:
    """(path, content_hash, content) of office files, by suffix in either case."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = P.relative(F.col("path"), _plain(spark, root))
    return found.where(P.suffix(F.col("path")).isin(*suffixes)).select(rel.alias("path"), F.substring(F.sha2("content", 256), 1, 16).alias("content_hash"), "content")


def scan_legacy(spark: SparkSession, root: str) -> DataFrame:
    """Files that have to be converted before they can be read."""
    return scan_office(spark, root, LEGACY).select("path")


def _local(node) -> str:
    return node.tag.rpartition("}")[2]


def _text(node, leaf: str = "t") -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x) == leaf)


def _parts(z: zipfile.ZipFile, pattern: str) -> list[str]:
    return sorted((n for n in z.namelist() if re.fullmatch(pattern, n)), key=lambda n: [int(x) for x in re.findall(r"\d+", n)])


def docx(raw: bytes) -> str:
    """Paragraphs outside tables, then table rows."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = next(x for x in ElementTree.fromstring(z.read("word/document.xml")).iter() if _local(x) == "body")
    out = [t for x in body if _local(x) == "p" and (t := _text(x).strip())]
    for table in (x for x in body if _local(x) == "tbl"):
        for row in (x for x in table.iter() if _local(x) == "tr"):
            out.append(" | ".join(_text(c).strip() for c in row if _local(c) == "tc"))
    return "\n".join(out)


def xlsx(raw: bytes, most_rows: int = MOST_ROWS) -> str:
    """Sheets with a heading each, at most ``most_rows`` rows of each."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = [x.get("name") for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(x) == "sheet"]
        shared = [_text(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(x) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
        out = []
        for name, part in zip(names, _parts(z, r"xl/worksheets/sheet\d+\.xml")):
            out.append(f"## Sheet: {name}")
            rows = [x for x in ElementTree.fromstring(z.read(part)).iter() if _local(x) == "row"]
            for row in rows[:most_rows]:
                cells = []
                for c in (x for x in row if _local(x) == "c"):
                    value = _text(c, "t") if c.get("t") == "inlineStr" else _text(c, "v")
                    cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
                if any(cells):
                    out.append(" | ".join(cells))
    return "\n".join(out)


def pptx(raw: bytes) -> str:
    """Slides with a heading each: paragraphs, table rows, then the speaker's notes."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        out = []
        for i, part in enumerate(_parts(z, r"ppt/slides/slide\d+\.xml"), 1):
            out.append(f"## Slide {i}")
            tree = ElementTree.fromstring(z.read(part))
            in_tables = {id(p) for t in tree.iter() if _local(t) == "tbl" for p in t.iter()}
            out += [t for p in tree.iter() if _local(p) == "p" and id(p) not in in_tables and (t := _text(p).strip())]
            out += [" | ".join(_text(c).strip() for c in row if _local(c) == "tc") for row in tree.iter() if _local(row) == "tr"]
            notes = f"ppt/notesSlides/notesSlide{i}.xml"
            if notes in z.namelist() and (said := _text(ElementTree.fromstring(z.read(notes))).strip()):
                out.append(f"Notes: {said}")
    return "\n".join(out)


def pdf(raw: bytes) -> str:
    """Pages with a heading each; a page that fails is empty."""
    from pypdf import PdfReader

    out = []
    for i, page in enumerate(PdfReader(io.BytesIO(raw)).pages, 1):
        try:
            body = page.extract_text() or ""
        except Exception:
            body = ""
        out.append(f"## Page {i}\n{body}")
    return "\n".join(out)


#: The registry of extractors: further suffixes can be added.
EXTRACTORS = {".docx": docx, ".xlsx": xlsx, ".pptx": pptx, ".pdf": pdf}


def extract(found: DataFrame, known: DataFrame | None = None, most_chars: int = MOST_CHARS) -> DataFrame:
    """(path, content_hash, extractor, text, status): ok, skip (hash known), missing-library or fail; texts over the cap are cut and marked."""
    if known is not None:
        found = found.join(known.select("path", F.col("content_hash").alias("known_hash")), "path", "left")
    else:
        found = found.withColumn("known_hash", F.lit(None).cast("string"))

    def run(batches):
        for frame in batches:
            rows = []
            for path, digest, raw, old in zip(frame["path"], frame["content_hash"], frame["content"], frame["known_hash"]):
                kind = "." + path.rpartition(".")[2].lower()
                text, status = None, "ok"
                if old == digest:
                    status = "skip"
                else:
                    try:
                        text = EXTRACTORS[kind](bytes(raw))
                        text = text[:most_chars] + CUT if len(text) > most_chars else text
                    except ImportError:
                        status = "missing-library"
                    except Exception:
                        status = "fail"
                rows.append((path, digest, kind[1:], text, status))
            yield pd.DataFrame(rows, columns=["path", "content_hash", "extractor", "text", "status"])

    return found.select("path", "content_hash", "content", "known_hash").mapInPandas(run, "path string, content_hash string, extractor string, text string, status string")


def orphaned(extracts: DataFrame, sources: DataFrame) -> DataFrame:
    """Extracts whose source is gone."""
    return extracts.join(sources.select("path"), "path", "left_anti")


def source_of(extract_path, prefix: str):
    """The source path of an extract's path."""
    return F.regexp_extract(extract_path, "^" + re.escape(prefix) + r"(.*)\.md$", 1)
