"""Text of files by their kind: the binaryFile source and readers of the standard library."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html import unescape
from operator import attrgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.arrow import added
from ..functions.tables import table_rows, told_rows
from ..session import ready

DEPTH, ENTRIES, ENTRY_BYTES = 5, 100, 20 * 1024 * 1024  # of archives: nesting, entries of one, bytes of an entry
RUN = 4  # characters of a printable run in other binaries


@dataclass
class Part:
    """Text, or an error, of a file or of an archive's entry."""

    path: str
    depth: int
    text: str | None
    error: str | None


def plain(data: bytes) -> str:
    return data.decode("utf-8-sig", "replace")


def html(data: bytes) -> str:
    text = re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", plain(data))
    return " ".join(unescape(re.sub(r"(?s)<[^>]+>", " ", text)).split())


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _table(rows: list[list[str]]) -> str:
    """Rows as a pipe table, the first row its header."""
    width = max(map(len, rows), default=0)
    line = lambda r: "| " + " | ".join([*r, *[""] * (width - len(r))]) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])]) if rows else ""


def docx(data: bytes) -> str:
    """Paragraphs and tables in their order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml"))[0]
    text = lambda e: "".join((x.text or "") if _local(x.tag) == "t" else "\n" if _local(x.tag) == "br" else "" for x in e.iter())
    out = []
    for e in body:
        if _local(e.tag) == "p" and text(e).strip():
            out.append(text(e).strip())
        elif _local(e.tag) == "tbl":
            rows = [[" ".join(text(c).split()) for c in r if _local(c.tag) == "tc"] for r in e if _local(r.tag) == "tr"]
            out.append(_table(rows))
    return "\n".join(out)


def xlsx(data: bytes) -> str:
    """Every sheet: its name, then its rows with sparse cells in their columns."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        sheets = [e.get("name", "") for e in ET.fromstring(z.read("xl/workbook.xml")).iter() if _local(e.tag) == "sheet"]
        files = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        out = []
        for i, name in enumerate(files):
            rows = []
            for row in (e for e in ET.fromstring(z.read(name)).iter() if _local(e.tag) == "row"):
                cells: dict[int, str] = {}
                for c in row:
                    column = 0
                    for ch in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                        column = column * 26 + ord(ch) - 64
                    value = "".join(t.text or "" for t in c.iter() if _local(t.tag) in ("v", "t"))
                    cells[column or len(cells) + 1] = shared[int(value)] if c.get("t") == "s" and value else value
                if cells:
                    rows.append([cells.get(k, "") for k in range(1, max(cells) + 1)])
            out.append(f"# {sheets[i] if i < len(sheets) else name}\n{_table(rows)}")
    return "\n".join(out)


def runs(data: bytes) -> str:
    """Printable runs of a binary, as ASCII and as UTF-16LE."""
    ascii_ = re.findall(rb"[\x20-\x7e]{%d,}" % RUN, data)
    wide = re.findall(rb"(?:[\x20-\x7e]\x00){%d,}" % RUN, data)
    return "\n".join([x.decode("ascii") for x in ascii_] + [x.decode("utf-16-le") for x in wide])


READERS: dict[str, Callable[[bytes], str]] = {"txt": plain, "csv": plain, "md": plain, "html": html, "htm": html, "docx": docx, "xlsx": xlsx}


def register(extension: str, reader: Callable[[bytes], str]) -> None:
    """Add or replace the reader of an extension (such as xls or pdf with a library of one's own)."""
    READERS[extension.lower().lstrip(".")] = reader


def parts_of(path: str, data: bytes, depth: int = 0) -> Iterator[Part]:
    """The text of a file; for an archive that of its entries, each with its own error."""
    extension = path.rpartition(".")[2].lower() if "." in path else ""
    try:
        if extension != "zip":
            yield Part(path, depth, READERS.get(extension, runs)(data), None)
            return
        if depth >= DEPTH:
            yield Part(path, depth, None, "nested too deep")
            return
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for n, entry in enumerate(e for e in z.infolist() if not e.is_dir()):
                inner = f"{path}!{entry.filename}"
                if n >= ENTRIES:
                    yield Part(path, depth, None, "too many entries")
                    return
                if entry.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", entry.filename):
                    yield Part(inner, depth + 1, None, "unsafe path")
                elif entry.file_size > ENTRY_BYTES:
                    yield Part(inner, depth + 1, None, "entry too large")
                else:
                    yield from parts_of(inner, z.read(entry), depth + 1)
    except Exception as e:  # a broken file is a row, not a failed job
        yield Part(path, depth, None, f"{type(e).__name__}: {e}")


def extract_files(spark: SparkSession, pattern: str) -> DataFrame:
    """path, depth, text, error of all files under a path, read by Spark's binaryFile source."""
    return texts_of_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern))


class FileText:
    """The table function file_text(path, content [, lines => true]): path, depth, text, error of a file or of an archive's entries.

    With `lines` a row is a line and its number is a column. One reader an extension; a broken file is a row with an error.
    """

    readers: dict[str, Callable[[bytes], str]] = READERS

    @staticmethod
    def analyze(path: AnalyzeArgument, content: AnalyzeArgument, lines: AnalyzeArgument | None = None) -> AnalyzeResult:
        for argument, kind in ((path, StringType), (content, BinaryType), (lines, BooleanType)):
            if argument is not None and not isinstance(argument.dataType, kind):
                raise ValueError(f"file_text(path string, content binary, lines boolean): {argument.dataType.simpleString()} in place of {kind.typeName()}")
        if lines is not None and not lines.isConstantExpression:
            raise ValueError("file_text: lines must be constant")
        schema = StructType().add("path", StringType()).add("depth", IntegerType())
        if lines is not None and lines.value:
            schema = schema.add("line", IntegerType())
        return AnalyzeResult(schema.add("text", StringType()).add("error", StringType()))

    def eval(self, path, content, lines=False):
        if path is None or content is None:
            return
        READERS.update(self.readers)
        for p in parts_of(path, bytes(content)):
            if not lines:
                yield p.path, p.depth, p.text, p.error
            elif p.text is None:
                yield p.path, p.depth, None, None, p.error
            else:
                for n, line in enumerate(p.text.split("\n"), 1):
                    yield p.path, p.depth, n, line, p.error


def register_table_function(spark: SparkSession, name: str = "file_text") -> SparkSession:
    """Make the table function known to a session, with the readers registered so far."""
    from pyspark.sql.functions import udtf

    class Extractor(FileText):
        readers = dict(READERS)

    ready(spark).udtf.register(name, udtf(Extractor))
    return spark


def texts_of_files(files: DataFrame) -> DataFrame:
    """path, depth, text, error of files given as path and content; an archive gives a row for each entry."""
    spark = register_table_function(files.sparkSession)
    return spark.sql("select t.* from {files} f, lateral file_text(f.path, f.content) t", files=files.select("path", "content"))


def zipped(entries: Column) -> Column:
    """A ZIP archive from array<struct<name: string, content: binary>>, with fixed times, so that equal entries give equal bytes."""

    def pack(column: pd.Series) -> pd.Series:
        out = []
        for own in column:
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                for e in own:
                    z.writestr(zipfile.ZipInfo(e["name"]), e["content"])
            out.append(data.getvalue())
        return pd.Series(out)

    return F.pandas_udf(pack, "binary")(entries)


@dataclass
class Word:
    """A word's box on a page: left, top, right, bottom."""

    text: str
    x0: float
    y0: float
    x1: float
    y1: float


def rows_of_words(words: list[Word], gap: float = 12.0) -> list[list[str]]:
    """Word boxes to table rows: boxes that overlap vertically form a row; column edges come from the widest row; a row whose first cell is empty continues the one above."""
    rows: list[list[Word]] = []
    lowest: list[float] = []  # how far down the rows so far reach: none above is looked at in vain
    for w in sorted(words, key=attrgetter("y0", "x0")):
        middle = (w.y0 + w.y1) / 2
        for k in range(len(rows) - 1, -1, -1):
            if lowest[k] < middle:
                k = -1
                break
            if rows[k][0].y0 <= middle <= rows[k][0].y1:
                rows[k].append(w)
                break
        else:
            k = -1
        if k < 0:
            rows.append([w])
            lowest.append(max(w.y1, lowest[-1]) if lowest else w.y1)
    cut = []
    for r in rows:
        cells: list[list[Word]] = []
        for w in sorted(r, key=attrgetter("x0")) if len(r) > 1 else r:
            cells[-1].append(w) if cells and w.x0 - cells[-1][-1].x1 <= gap else cells.append([w])
        cut.append(cells)
    starts = [c[0].x0 for c in max(cut, key=len, default=[])]
    places: dict[float, int] = {}
    for i, x in enumerate(starts):
        places.setdefault(x, i)
    out: list[list[str]] = []
    for cells in cut:
        line = [""] * len(starts)
        for c in cells:
            at = c[0].x0
            k = places[at] if at in places else min(range(len(starts)), key=lambda i: abs(starts[i] - at))
            text = c[0].text if len(c) == 1 else " ".join([w.text for w in c])
            line[k] = f"{line[k]} {text}".strip()
        if out and not line[0] and len(starts) > 1:
            out[-1] = [f"{a} {b}".strip() for a, b in zip(out[-1], line, strict=True)]
        else:
            out.append(line)
    return out


def word_tables(words: DataFrame, key: str, told: str | None = None) -> DataFrame:
    """key, table_index (the page), row_index, headers, cells, raw, places, many from word boxes: key, page, text, x0, y0, x1, y1. `told` as in tables.parse_tables.

    A page's first row is its header; a row whose first cell is empty goes on with the one above. A group is one page's boxes.
    """
    width = len(StructType.fromDDL(told_rows(told)).names)

    def work(batch: pa.RecordBatch) -> tuple[list[int], list]:
        found = []
        boxes = batch["boxes"]
        ends = boxes.offsets.to_numpy().tolist()
        # Column by column: a box taken out by itself costs more than all that is done with it.
        each = boxes.values.slice(ends[0], ends[-1] - ends[0]).flatten()
        all_ = list(map(Word, *[c.to_numpy(zero_copy_only=False).tolist() for c in each]))
        for at, page in enumerate(batch["page"].to_pylist()):
            rows = rows_of_words(all_[ends[at] - ends[0] : ends[at + 1] - ends[0]])
            found += [(at, page, *r[1:]) for r in table_rows([(rows[0], rows[1:])], told)]
        return [r[0] for r in found], [[r[k + 1] for r in found] for k in range(width)]

    pages = words.groupBy(key, F.col("page").cast("int").alias("page")).agg(F.collect_list(F.struct("text", "x0", "y0", "x1", "y1")).alias("boxes"))
    return added(pages, [key], work, told_rows(told))
