"""Files as pages and tables.

Any store that Spark reads: files come through its ``binaryFile`` source.  Text in office files is taken
out of their XML; PDF and images need an extractor that is handed in (``extractors``), as none is bundled.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAYOUT = "path string, page int, kind string, n int, text string, headers array<string>, rows array<array<string>>, error string"
Extractor = Callable[[bytes], list[dict]]

# The first bytes of each format.
MAGIC = {"pdf": b"%PDF-", "docx": b"PK\x03\x04", "xlsx": b"PK\x03\x04", "png": b"\x89PNG\r\n\x1a\n", "jpg": b"\xff\xd8\xff", "jpeg": b"\xff\xd8\xff"}


def scan(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, extension, sha256, length, content) of the files under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.lower(F.regexp_extract("path", "[.]([A-Za-z0-9]+)$", 1)).alias("extension"), F.sha2("content", 256).alias("sha256"), "length", "content")


def unseen(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content isn't known, one of each."""
    return files.join(known.select("sha256").distinct(), "sha256", "left_anti").dropDuplicates(["sha256"])


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _cells(row) -> list[str]:
    return ["".join(t.text or "" for t in c.iter() if _local(t.tag) == "t") for c in row if _local(c.tag) == "tc"]


def docx(content: bytes) -> list[dict]:
    """Paragraphs and tables of a document, as one page."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))[0]
    out, lines = [], []
    for e in body:
        if _local(e.tag) == "p":
            lines.append("".join(t.text or "" for t in e.iter() if _local(t.tag) == "t"))
        elif _local(e.tag) == "tbl":
            rows = [_cells(r) for r in e if _local(r.tag) == "tr"]
            out.append({"page": 1, "kind": "table", "headers": rows[0] if rows else [], "rows": rows[1:]})
    return [{"page": 1, "kind": "text", "text": "\n".join(x for x in lines if x.strip())}, *out]


def xlsx(content: bytes) -> list[dict]:
    """Each sheet a page with one table; its first row that isn't empty is the head."""
    z = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    out = []
    sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    for page, name in enumerate(sheets, 1):
        rows = []
        for r in (e for e in ElementTree.fromstring(z.read(name)).iter() if _local(e.tag) == "row"):
            cells: dict[int, str] = {}
            for c in r:
                letters = re.match("[A-Z]*", c.get("r", ""))[0]
                at = len(cells) if not letters else sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1
                v = "".join(t.text or "" for t in c.iter() if _local(t.tag) in ("v", "t"))
                cells[at] = shared[int(v)] if c.get("t") == "s" and v else v
            row = [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]
            if any(x.strip() for x in row):
                rows.append(row)
        out.append({"page": page, "kind": "table", "headers": rows[0] if rows else [], "rows": rows[1:]})
    return out


def plain(content: bytes) -> list[dict]:
    return [{"page": i, "kind": "text", "text": t} for i, t in enumerate(content.decode("utf-8", "replace").split("\f"), 1)]


EXTRACTORS: dict[str, Extractor] = {"docx": docx, "xlsx": xlsx, "txt": plain, "md": plain}


def layouts(files: DataFrame, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """Pages and tables of files (path, extension, content).  A file of an unsupported format, or one that
    can't be read, gives a row that says so; it doesn't stop the others."""
    able = EXTRACTORS | (extractors or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, ext, content in zip(b["path"], b["extension"], b["content"], strict=True):
                try:
                    if ext not in able:
                        raise ValueError(f"unsupported format: {ext}")
                    parts = able[ext](content)
                    rows += [{"path": path, "n": i, "text": None, "headers": None, "rows": None, "error": None} | p for i, p in enumerate(parts)]
                except Exception as e:  # one bad file is a row, not a failed job
                    rows.append({"path": path, "page": None, "kind": "error", "n": 0, "text": None, "headers": None, "rows": None, "error": f"{type(e).__name__}: {e}"[:300]})
            yield pd.DataFrame(rows, columns=["path", "page", "kind", "n", "text", "headers", "rows", "error"])

    return files.select("path", "extension", "content").mapInPandas(run, LAYOUT)


def valid(content: Column, extension: Column, most_bytes: int = 50_000_000) -> Column:
    """Whether a file begins as its extension says and isn't too large."""
    right = F.lit(False)
    for ext, magic in MAGIC.items():
        right = right | ((extension == ext) & (F.substring(content, 1, len(magic)) == F.lit(bytearray(magic))))
    return (right | extension.isin("txt", "md", "csv")) & (F.octet_length(content) <= most_bytes) & (F.octet_length(content) > 0)


def zip_ratio(files: DataFrame) -> DataFrame:
    """(path, entries, unpacked, ratio) of zip-based files, from their directories, without unpacking."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    own = zipfile.ZipFile(io.BytesIO(content)).infolist()
                    total = sum(i.file_size for i in own)
                    rows.append((path, len(own), total, total / max(1, len(content))))
                except zipfile.BadZipFile:
                    rows.append((path, None, None, None))
            yield pd.DataFrame(rows, columns=["path", "entries", "unpacked", "ratio"]).astype({"entries": "Int64", "unpacked": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, entries long, unpacked long, ratio double")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files with a JSON object in each line; a line that is none is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def report_html(matrix: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """(metric, html): a table of each metric's rows, as a report shows it; text is escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("—")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), safe(c), F.lit("</td>")) for c in columns), F.lit("</tr>"))
    head = "<tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>"
    rows = matrix.groupBy("metric").agg(F.array_sort(F.collect_list(F.struct(*order, row.alias("_row")))).alias("_r"))
    return rows.select("metric", F.concat(F.lit("<section><h2>"), safe("metric"), F.lit(f"</h2><table>{head}"), F.array_join(F.transform("_r", lambda r: r["_row"]), ""), F.lit("</table></section>")).alias("html"))
