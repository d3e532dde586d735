"""Layout units of pages from positioned lines: columns, headings, bullets, captions, tables, paragraphs, and
paragraphs that go on on the next page. Lines are folded page by page; pages are joined with a window over units."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from statistics import median

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: They decide which units result.
BULLET = re.compile(r"^\s*(?:[\u2022\uf0b7\u25aa\u25cf\u25e6]|[-*])\s+")
NUMBERED = re.compile(r"^\s*(?:\d+(?:\.\d+)*[.)]?|chương\s+\d+)", re.I)
ENDS = (".", "!", "?", ":", ";", "…")
BRIDGES = [
    "a", "an", "the", "by", "in", "at", "of", "to", "from", "for", "with",
    "và", "của", "tại", "ở", "vào", "từ", "đến", "năm", "ngày", "số",
]


@dataclass(frozen=True)
class Config:
    """Thresholds in points, in median line heights (`*_gap`, but column_gap), or in parts of the page's height."""

    line_gap: float = 1.65
    large_gap: float = 1.9
    edge: float = 8.0
    indent: float = 24.0
    column_gap: float = 48.0
    heading_size: float = 1.1
    heading_chars: int = 180
    captions: tuple[str, ...] = ("Hình", "Bảng", "Figure", "Table")
    align: float = 10.0
    page_top: float = 0.22
    page_bottom: float = 0.84


class Unit:
    """Lines of one kind, in reading order."""

    def __init__(self, kind: str, line: dict) -> None:
        self.kind, self.lines = kind, [line]

    @property
    def text(self) -> str:
        if self.kind == "table_like":
            return "\n".join(x["text"].rstrip("\r\n") for x in self.lines)
        return " ".join(plain(x["text"]) for x in self.lines)

    def takes(self, line: dict, kind: str, tall: float, c: Config) -> bool:
        """Whether the next line of the column belongs to this unit."""
        first, last = self.lines[0], self.lines[-1]
        below = line["y0"] - last["y0"]
        if self.kind == "heading":
            return kind == "heading" and abs(below) <= tall / 4
        goes_with = {"paragraph": ["paragraph"], "bullet_item": ["paragraph"], "table_like": ["table_like"], "caption": []}
        if kind not in goes_with[self.kind] or below > c.line_gap * tall or line["y0"] - last["y1"] > c.large_gap * tall:
            return False
        shift = line["x0"] - last["x0"]
        hangs = {
            "bullet_item": abs(line["x0"] - first["x0"]) <= c.indent,
            "paragraph": last is first and -c.indent <= shift < 0,
        }
        return abs(shift) <= c.edge or hangs.get(self.kind, False)


def plain(text: str) -> str:
    return " ".join(text.split())


def _spans(line: dict) -> list[dict]:
    return line.get("spans") or []


def _heads(line: dict, text: str, size: float, c: Config) -> bool:
    if len(text) > c.heading_chars or text.endswith((".", ",", ";", ":")):
        return False
    letters, numbered = [x.isupper() for x in text if x.isalpha()], bool(NUMBERED.match(text))
    capital = len(letters) >= 4 and sum(letters) >= 0.75 * len(letters)
    bold = any("bold" in (s["font"] or "").casefold() for s in _spans(line))
    large = any((s["size"] or 0) >= c.heading_size * size for s in _spans(line))
    return bold and (numbered or capital or len(text) <= 70) or large and numbered


def kind_of(line: dict, size: float, in_table: bool, c: Config = Config()) -> str:
    """The kind of a line by itself, where size is the page's median font size."""
    text, spans = plain(line["text"]), _spans(line)
    if BULLET.match(line["text"].lstrip()) or (spans and "symbol" in (spans[0]["font"] or "").casefold()):
        return "bullet_item"
    if text.casefold().startswith(tuple(p.casefold() + end for p in c.captions for end in " .")):
        return "caption"
    if in_table:
        return "table_like"
    return "heading" if _heads(line, text, size, c) else "paragraph"


def table_rows(lines: list[dict], tall: float, c: Config) -> list[bool]:
    """Which lines have cells that begin where those of the line above or below do."""
    starts = [sorted(s["x0"] for s in _spans(x) if s["text"].strip()) for x in lines]
    wide = [any(b - a >= 2 * tall for a, b in zip(x, x[1:])) for x in starts]
    found = [False] * len(lines)
    order = sorted(range(len(lines)), key=lambda i: (lines[i]["y0"], lines[i]["x0"]))
    for i, j in zip(order, order[1:]):
        near = lines[j]["y0"] - lines[i]["y0"] <= c.large_gap * tall and wide[i] and wide[j]
        if near and len(starts[i]) == len(starts[j]) and all(abs(a - b) <= c.align for a, b in zip(starts[i], starts[j])):
            found[i] = found[j] = True
    return found


def page_units(lines: list[dict], c: Config = Config()) -> list[Unit]:
    """Units of one page from lines with x0, y0, x1, y1, line (its number), text and spans (text, font, size, x0)."""
    lines = [x for x in lines if x["text"] and plain(x["text"]) and None not in (x["x0"], x["y0"], x["x1"], x["y1"])]
    if not lines:
        return []
    sizes = [s["size"] for x in lines for s in _spans(x) if (s["size"] or 0) > 0]
    size, tall = median(sizes or [12.0]), median(max(1.0, x["y1"] - x["y0"]) for x in lines)
    kinds = {id(x): kind_of(x, size, t, c) for x, t in zip(lines, table_rows(lines, tall, c))}
    left, columns = None, []
    for x in sorted(lines, key=lambda x: (x["x0"], x["y0"], x["line"])):
        if left is None or x["x0"] - left > c.column_gap:
            left = x["x0"]
            columns.append([])
        columns[-1].append(x)
    units: list[Unit] = []
    for column in columns:
        fresh = True
        for x in sorted(column, key=lambda x: (x["y0"], x["x0"], x["line"])):
            if not fresh and units[-1].takes(x, kinds[id(x)], tall, c):
                units[-1].lines.append(x)
            else:
                units.append(Unit(kinds[id(x)], x))
            fresh = False
    return units


def goes_on_in_lower_case(text: str) -> bool:
    """Whether the first character that is no punctuation is a lower-case letter."""
    first = next((x for x in text.lstrip() if not unicodedata.category(x).startswith("P")), "")
    return first.isalpha() and first.islower()


def _row(doc, page: int, k: int, unit: Unit) -> dict:
    """A unit with what joining pages asks of its edges."""
    text, first, last = unit.text, unit.lines[0], unit.lines[-1]
    word = re.search(r"\w+$", text.rstrip())
    begins = text.lstrip()[:1]
    return {
        "doc_id": doc, "page": page, "k": k, "kind": unit.kind, "text": text,
        "spans": [{"page": page, "start": x["source_start"], "end": x["source_end"]} for x in unit.lines],
        "top": first["y0"], "left": last["x0"], "bottom": last["y1"], "right": last["x1"],
        "width": first["width"], "height": first["height"],
        "open": not text.rstrip().endswith(ENDS), "bridge": bool(word) and word[0].casefold() in BRIDGES,
        "low": goes_on_in_lower_case(text), "raised": begins.isupper() or begins.isdigit(),
    }


def document_units(lines: DataFrame, c: Config = Config()) -> DataFrame:
    """doc_id, ordinal, kind, page_start, page_end, text, source_spans, review_flags of each unit.

    lines: doc_id, page, line, width, height, x0, y0, x1, y1, text, source_start, source_end and spans, an array of
    structs (text, font, size, x0); other columns are ignored. A paragraph goes on on the next page if it has no closing
    mark, the next begins in lower case and both stand at their page's edges with the same left edge; if only the text
    or, before a capital or a numeral, only the edges say so, the next unit is flagged for review. A page without
    lines parts its neighbours. Lines without text or box are left out; null ids are one document; an empty table
    gives an empty result. The Python fold holds one page; documents are put together by windows that can spill.
    """
    kind = lines.schema["doc_id"].dataType.simpleString()
    fields = (
        f"doc_id {kind}, page int, k int, kind string, text string, spans array<struct<page: int, start: bigint, end: bigint>>, top double, "
        "left double, bottom double, right double, width double, height double, open boolean, bridge boolean, low boolean, raised boolean"
    )
    names = ["doc_id", "page", "line", "width", "height", "x0", "y0", "x1", "y1", "text", "source_start", "source_end", "spans"]

    def run(page: pa.Table) -> pa.Table:
        units = page_units(page.to_pylist(), c)
        rows = [_row(page["doc_id"][0].as_py(), page["page"][0].as_py(), k, u) for k, u in enumerate(units)]
        return pa.Table.from_pylist(rows, schema(page.schema.field("doc_id").type))

    typed = lines.select(*names).withColumn("page", F.col("page").cast("int"))
    units = typed.groupBy("doc_id", "page").applyInArrow(run, fields)
    along = Window.partitionBy("doc_id").orderBy("page", "k")
    units = units.withColumn("last", F.lag(F.struct("page", "kind", "left", "bottom", "right", "width", "height", "open", "bridge")).over(along))
    prose = (F.col("k") == 0) & (F.col("last.page") == F.col("page") - 1) & (F.col("kind") == "paragraph") & (F.col("last.kind") == "paragraph") & F.col("last.open")
    edges = (
        (F.col("last.bottom") >= F.col("last.height") * c.page_bottom)
        & (F.col("top") <= F.col("height") * c.page_top)
        & (F.abs(F.col("last.left") - F.col("left")) <= c.indent)
    )
    wrapped = edges & F.col("raised") & (F.col("last.bridge") | (F.col("last.right") >= F.col("last.width") * 0.8))
    joins = F.coalesce(prose & F.col("low") & edges, F.lit(False))
    doubt = F.coalesce(prose & (F.col("low") | wrapped), F.lit(False)) & ~joins
    units = units.select("doc_id", "page", "k", "kind", "text", "spans", joins.alias("joins"), doubt.alias("doubt"))
    units = units.withColumn("ordinal", (F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(along) - 1).cast("int"))
    parts = F.sort_array(F.collect_list(F.struct("page", "k", "text", "spans")))
    return (
        units.groupBy("doc_id", "ordinal")
        .agg(F.min("kind").alias("kind"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), parts.alias("parts"), F.max("doubt").alias("doubt"))
        .select(
            "doc_id", "ordinal", "kind", "page_start", "page_end",
            F.array_join("parts.text", " ").alias("text"), F.flatten("parts.spans").alias("source_spans"),
            F.when(F.col("doubt"), F.array(F.lit("ambiguous_page_continuation"))).otherwise(F.array().cast("array<string>")).alias("review_flags"),
        )
    )


def schema(doc_id: pa.DataType) -> pa.Schema:
    """Arrow's schema of a page's units."""
    place = pa.list_(pa.struct([("page", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    fields = [("doc_id", doc_id), ("page", pa.int32()), ("k", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("spans", place)]
    fields += [(n, pa.float64()) for n in ("top", "left", "bottom", "right", "width", "height")]
    return pa.schema(fields + [(n, pa.bool_()) for n in ("open", "bridge", "low", "raised")])


START = re.compile(r"^(?:chương\s+(?:1|i)\b|mở đầu|giới thiệu|introduction|1\.\s+\S)", re.I)
END = re.compile(r"^(?:tài liệu tham khảo|references|bibliography|phụ lục|appendix)\b", re.I)
CONTENTS = re.compile(r"\.{4,}\s*\d+\s*$", re.M)


def body_bounds(pages: list[str]) -> tuple[int, int]:
    """First page of the body and the page after its last.

    The body starts at the first start heading that is no table of contents, looked for in the first max(12, 15 %)
    pages, at most 20; it ends before the first end heading in the last half.
    """
    n = len(pages)
    front = min(n - 1, max(12, min(20, int(0.15 * n)))) if n else 0
    heads = [[x.strip() for x in p.splitlines() if x.strip()][:6] for p in pages]
    toc = [len(CONTENTS.findall(p)) >= 3 for p in pages]
    first = next((i for i in range(front + 1 if n else 0) if not toc[i] and any(START.match(x) for x in heads[i])), None)
    if first is None:
        first = next((i for i in range(n) if not toc[i] and len(pages[i]) >= 800), 0)
    last = next((i for i in range(max(first + 1, n // 2), n) if any(END.match(x) for x in heads[i])), n)
    return first, last


def bodies(pages: DataFrame) -> DataFrame:
    """doc_id, first_page, end_page, n_pages, sufficient (the body starts within the first max(25, 30 %) pages)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("page", kind="stable")
        texts = g["text"].fillna("").tolist()
        first, last = body_bounds(texts)
        ok = first <= max(25, int(0.30 * len(texts))) and sum(map(len, texts[first:last])) >= 5000
        return pd.DataFrame([(g["doc_id"].iloc[0], first, last, len(texts), ok)], columns=["doc_id", "first_page", "end_page", "n_pages", "sufficient"])

    kind = pages.schema["doc_id"].dataType.simpleString()
    return pages.select("doc_id", "page", "text").groupBy("doc_id").applyInPandas(run, f"doc_id {kind}, first_page int, end_page int, n_pages int, sufficient boolean")
