"""Sources of text: folder listings, DOCX files, positioned glyph runs, OCR blocks, and the policy that merges them into pages."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docfacts.functions.text import collapse

#: Kinds that a listing shows, a page's least text without OCR, a line's tolerance.
KINDS = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}
LEAST_TEXT, BASELINE_TOLERANCE = 100, 2.5
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length, content of the PDF and DOCX files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.lower("path").rlike(r"\.(pdf|docx)$"))


def listing(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """Folders, then files by name with numbers in numeric order; shortcuts become their targets, each id once.

    entries: id, name, is_folder, target_id; targets: id, name, is_folder.
    """
    t = targets.select(F.col("id").alias("target_id"), F.col("name").alias("t_name"), F.col("is_folder").alias("t_folder"))
    resolved = entries.join(t, "target_id", "left").where(F.col("target_id").isNull() | F.col("t_name").isNotNull())
    rows = resolved.select(F.coalesce("target_id", "id").alias("id"), F.coalesce("t_name", "name").alias("name"), F.coalesce("t_folder", "is_folder").alias("is_folder")).dropDuplicates(["id"])
    number = lambda p: F.concat(F.lpad(F.length(p).cast("string"), 4, "0"), p)  # noqa: E731 -- the longer number is the greater
    parts = F.transform(F.regexp_extract_all(F.lower("name"), F.lit(r"\d+|\D+"), 0), lambda p: F.when(p.rlike(r"^\d"), number(F.regexp_replace(p, "^0+(?=\\d)", ""))).otherwise(p))
    padded = F.array_join(parts, "")
    return rows.withColumn("sort_key", F.concat(F.when(F.col("is_folder"), "0").otherwise("1"), padded)).orderBy("sort_key")


def to_fetch(remote: DataFrame, stored: DataFrame) -> DataFrame:
    """Remote files (id, modified) that are new, newer than what is stored, or not cached."""
    s = stored.select("id", F.col("modified").alias("stored_at"), "cached")
    return remote.join(s, "id", "left").where(F.col("stored_at").isNull() | (F.col("modified") > F.col("stored_at")) | ~F.coalesce("cached", F.lit(False))).select("id", "modified")


def docx_lines(content: bytes) -> list[str]:
    """Lines of a DOCX body: paragraphs, line breaks within them, white space collapsed, blank ones dropped."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in body.iter(f"{WORD}p"):
        text = "".join("\n" if e.tag == f"{WORD}br" else "\t" if e.tag == f"{WORD}tab" else e.text or "" for e in p.iter() if e.tag in (f"{WORD}t", f"{WORD}br", f"{WORD}tab"))
        out += [" ".join(line.split()) for line in text.split("\n")]
    return [line for line in out if line]


def docx_pages(binary: DataFrame) -> DataFrame:
    """path, page 1, lines of each DOCX file; an unreadable file has no lines and its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            lines, errors = [], []
            for content in f["content"]:
                try:
                    lines.append(docx_lines(content))
                    errors.append(None)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    lines.append([])
                    errors.append(type(e).__name__)
            yield pd.DataFrame({"path": f["path"], "page": 1, "lines": lines, "error": errors})

    return binary.where(F.lower("path").endswith(".docx")).select("path", "content").mapInPandas(run, "path string, page int, lines array<string>, error string")


def group_runs(runs: DataFrame, tolerance: float = BASELINE_TOLERANCE) -> DataFrame:
    """Lines of positioned glyph runs (doc_id, page, seq, text, x, y, w, h): runs join the first line whose baseline is near enough.

    The clustering depends on the order of runs, so each page is one group; a page holds a bounded number of runs.
    """

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        lines: list[dict] = []
        for r in rows.sort_values("seq").itertuples(index=False):
            line = next((c for c in lines if abs(c["y"] - r.y) <= tolerance), None)
            if line is None:
                lines.append({"y": r.y, "runs": [r]})
            else:
                line["runs"].append(r)
        out = []
        for c in sorted(lines, key=lambda c: (c["y"], min(r.x for r in c["runs"]))):
            own = sorted(c["runs"], key=lambda r: r.x)
            text = " ".join("".join(r.text for r in own).split())
            if text:
                x, y = min(r.x for r in own), min(r.y for r in own)
                out.append((text, round(x, 2), round(y, 2), round(max(r.x + r.w for r in own) - x, 2), round(max(r.y + r.h for r in own) - y, 2)))
        first = rows.iloc[0]
        return pd.DataFrame([(first.doc_id, first.page, i, *line) for i, line in enumerate(out)], columns=["doc_id", "page", "line", "text", "x", "y", "w", "h"])

    return runs.groupBy("doc_id", "page").applyInPandas(page, "doc_id long, page int, line int, text string, x double, y double, w double, h double")


def ocr_lines(blocks: DataFrame) -> DataFrame:
    """Lines of OCR output (doc_id, page, blocks array<paragraphs array<lines array<text>>>), nested explodes in reading order."""
    b = blocks.select("doc_id", "page", F.posexplode("blocks").alias("b", "block"))
    p = b.select("doc_id", "page", "b", F.posexplode("block.paragraphs").alias("p", "paragraph"))
    lines = p.select("doc_id", "page", "b", "p", F.posexplode("paragraph.lines").alias("l", "text")).select("doc_id", "page", "b", "p", "l", collapse(F.col("text")).alias("text")).where("text <> ''")
    return lines.withColumn("line", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("b", "p", "l")) - 1).select("doc_id", "page", "line", "text")


def needs_ocr(text: Column) -> Column:
    return F.length(F.trim(text)) < LEAST_TEXT


def acquire(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """Pages (doc_id, page, text) with their source: OCR replaces a thin page if it is at least as long; without OCR such a page has failed."""
    o = ocr.select("doc_id", "page", F.col("text").alias("ocr_text"))
    both = native.join(o, ["doc_id", "page"], "left")
    thin = needs_ocr(F.col("text"))
    use = thin & F.col("ocr_text").isNotNull() & (F.length("ocr_text") >= F.length("text"))
    source = F.when(use, "OCR").when(thin & F.col("ocr_text").isNull(), "OCR_FAILED").otherwise("NATIVE_TEXT")
    return both.select("doc_id", "page", F.when(use, F.col("ocr_text")).otherwise(F.col("text")).alias("text"), source.alias("text_source"))


def document_source(pages: DataFrame) -> DataFrame:
    """Per document: OCR_FAILED if a page failed, OCR if one was recognised, else NATIVE_TEXT; and the pages of both kinds."""
    of = lambda s: F.array_sort(F.collect_set(F.when(F.col("text_source") == s, F.col("page"))))
    rows = pages.groupBy("doc_id").agg(of("OCR").alias("ocr_pages"), of("OCR_FAILED").alias("failed_pages"))
    return rows.withColumn("text_source", F.when(F.size("failed_pages") > 0, "OCR_FAILED").when(F.size("ocr_pages") > 0, "OCR").otherwise("NATIVE_TEXT"))


def compose(a: Column, b: Column) -> Column:
    """The product of two affine transforms struct<a, b, c, d, e, f>: b first, then a."""
    return F.struct(
        (a["a"] * b["a"] + a["c"] * b["b"]).alias("a"), (a["b"] * b["a"] + a["d"] * b["b"]).alias("b"), (a["a"] * b["c"] + a["c"] * b["d"]).alias("c"), (a["b"] * b["c"] + a["d"] * b["d"]).alias("d"),
        (a["a"] * b["e"] + a["c"] * b["f"] + a["e"]).alias("e"), (a["b"] * b["e"] + a["d"] * b["f"] + a["f"]).alias("f"),
    )


def place_box(m: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """The upright box around a box's four transformed corners; null for a degenerate transform or an empty box."""
    corners = [(px, py) for px in (x, x + w) for py in (y, y + h)]
    xs = [m["a"] * px + m["c"] * py + m["e"] for px, py in corners]
    ys = [m["b"] * px + m["d"] * py + m["f"] for px, py in corners]
    box = F.struct(F.least(*xs).alias("x"), F.least(*ys).alias("y"), (F.greatest(*xs) - F.least(*xs)).alias("w"), (F.greatest(*ys) - F.least(*ys)).alias("h"))
    return F.when((m["a"] * m["d"] - m["b"] * m["c"] != 0) & (w > 0) & (h > 0), box)


def area_text(chars: DataFrame) -> DataFrame:
    """Text of an area (doc_id, area, x, y, w, h) in characters (char, cx, cy, ch, seq): those whose centre lies inside, a new line at each gap of more than half the smaller height."""
    inside = chars.where("cx between x and x + w and cy between y and y + h")
    order = Window.partitionBy("doc_id", "area").orderBy("seq")
    gap = F.abs(F.col("cy") - F.lag("cy").over(order)) > F.least(F.col("ch"), F.lag("ch").over(order)) / 2
    marked = inside.withColumn("line", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(order))
    lines = marked.groupBy("doc_id", "area", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "char"))), lambda c: c["char"]), "").alias("text"))
    return lines.groupBy("doc_id", "area").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda c: F.trim(c["text"])), "\n").alias("text"))


def page_lines(lines: Column, text: Column) -> Column:
    """A page's stored lines, or else those of its text, trimmed, without blank ones."""
    own = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.when(F.size(lines) > 0, lines).otherwise(own)
