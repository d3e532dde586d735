"""Unicode normalisation that keeps, for every character, the ranges of the source it came from."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SOFT_HYPHEN, REPLACEMENT = chr(0xAD), chr(0xFFFD)
#: Rules of these states apply, if they have evidence.
CONFIRMED = ["automatic", "reviewed"]


@dataclass(frozen=True)
class Normalized:
    text: str
    ranges: list[list[tuple[int, int]]]
    status: str
    flags: list[str]
    rules: list[str]


def coalesced(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges, those that touch or overlap joined."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def aligned(text: str, spans: Sequence[Mapping]) -> dict[int, tuple[Mapping, int]] | None:
    """For each character of the text that is no blank, its span and place there; None if spans don't spell the text.

    Spans (text, font, page, start, end) must be as long as their source range, in order, and apart from each other.
    """
    for span in spans:
        if None in (span["page"], span["start"], span["end"], span["text"]) or span["end"] - span["start"] != len(span["text"]):
            return None
    for a, b in zip(spans, spans[1:]):
        if (b["page"], b["start"]) < (a["page"], a["end"] if a["page"] == b["page"] else 0):
            return None
    own = [i for i, char in enumerate(text) if not char.isspace()]
    places = [(span, i) for span in spans for i, char in enumerate(span["text"]) if not char.isspace()]
    if not spans or len(own) != len(places) or any(text[i] != span["text"][k] for i, (span, k) in zip(own, places)):
        return None
    return dict(zip(own, places))


def composed(chars: Sequence[tuple[str, tuple[int, int]]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """The characters of the NFC form with the ranges of the parts that each is made of."""
    parts: list[tuple[str, tuple[int, int]]] = []
    decomposed = ((part, at) for char, at in chars for part in unicodedata.normalize("NFD", char))
    for marks, run in groupby(decomposed, key=lambda x: unicodedata.combining(x[0]) > 0):
        parts += sorted(run, key=lambda x: unicodedata.combining(x[0])) if marks else run
    first, taken = 0, [False] * len(parts)
    for char in unicodedata.normalize("NFC", "".join(char for char, _ in chars)):
        own = []
        for part in unicodedata.normalize("NFD", char):
            i = next(i for i in range(first, len(parts)) if not taken[i] and parts[i][0] == part)
            taken[i] = True
            own.append(parts[i][1])
        while first < len(parts) and taken[first]:
            first += 1
        yield char, own


def normalized(
    text: str,
    doc_id=None,
    spans: Sequence[Mapping] = (),
    glyphs: Mapping[tuple, tuple[str, str, str]] | None = None,
    pages: Mapping[int, str] | None = None,
) -> Normalized:
    """NFC text without soft hyphens, with runs of blanks as one; ranges[i] are the source ranges of character i.

    glyphs: (doc_id, font, code point) to (replacement, evidence, status). A rule applies if the text's spans spell it,
    the page's text has the span where it says, and the rule has evidence and a confirmed status; anything less, and
    private-use or replacement characters that are left, call for a review.
    """
    glyphs, flags, rules, chars = glyphs or {}, [], [], []
    suspects = {code for doc, _, code in glyphs if doc == doc_id}
    places = aligned(text, spans)
    for i, char in enumerate(text):
        if char == SOFT_HYPHEN:
            continue
        new = char
        span, k = (places or {}).get(i, (None, 0))
        rule = glyphs.get((doc_id, span["font"], ord(char))) if span else None
        if ord(char) in suspects and span is None:
            flags.append("span_alignment_unresolved")
        elif rule and (pages or {}).get(span["page"], "")[span["start"] : span["end"]] != span["text"]:
            flags.append("source_span_unverified")
        elif rule and not (rule[1] and rule[2] in CONFIRMED):
            flags.append("unverified_glyph_rule")
        elif rule:
            new, at = rule[0], span["start"] + k
            told = {"document_id": doc_id, "font_name": span["font"], "codepoint": ord(char), "replacement": new, "source_page": span["page"] + 1}
            told |= {"source_span": [at, at + 1], "evidence": rule[1], "disposition": rule[2]}
            rules.append(json.dumps(told, ensure_ascii=False, sort_keys=True))
        if any(unicodedata.category(x) == "Co" for x in new):
            flags.append("unresolved_pua")
        if REPLACEMENT in new:
            flags.append("replacement_character")
        chars += [(x, (i, i + 1)) for x in new]
    out, ranges = [], []
    for blank, run in groupby(composed(chars), key=lambda x: x[0].isspace()):
        if blank:
            out.append(" ")
            ranges.append(coalesced([r for _, own in run for r in own]))
        else:
            for char, own in run:
                out.append(char)
                ranges.append(coalesced(own))
    inner = slice(int(out[:1] == [" "]), len(out) - int(out[-1:] == [" "]))
    return Normalized("".join(out[inner]), ranges[inner], "review_required" if flags else "active", list(dict.fromkeys(flags)), rules)


def normalized_units(units: DataFrame, glyphs: DataFrame, pages: DataFrame) -> DataFrame:
    """units (unit_id, doc_id, text, spans: array of structs text, font, page, start, end) with column `normalized`.

    glyphs: doc_id, font, codepoint, replacement, evidence, status. pages: doc_id, page, text. normalized is a struct of
    text, status, flags, rules and ranges. Only pages that units with a rule for their document name are joined. Null
    texts are empty, null ids meet no rule, extra columns stay, of rows of the same unit_id each has its own result;
    an empty table gives an empty result.
    """
    rules = glyphs.groupBy("doc_id").agg(F.collect_list(F.struct("font", "codepoint", "replacement", "evidence", "status")).alias("__rules"))
    rows = units.drop("normalized", "__rules", "__pages").join(rules, "doc_id", "left")
    named = rows.where("__rules IS NOT NULL").select("unit_id", "doc_id", F.explode("spans.page").alias("page")).distinct()
    texts = pages.select("doc_id", F.col("page").cast("int").alias("page"), F.col("text").alias("__text")).dropDuplicates(["doc_id", "page"])
    held = named.withColumn("page", F.col("page").cast("int")).join(texts, ["doc_id", "page"])
    held = held.groupBy("unit_id", "doc_id").agg(F.collect_list(F.struct("page", "__text")).alias("__pages"))
    rows = rows.join(held, ["unit_id", "doc_id"], "left")
    result = "struct<text: string, status: string, flags: array<string>, rules: array<string>, ranges: array<array<array<int>>>>"
    kept = [c for c in rows.columns if c not in ("__rules", "__pages")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.struct(
            [("text", pa.string()), ("status", pa.string()), ("flags", pa.list_(pa.string())), ("rules", pa.list_(pa.string())), ("ranges", pa.list_(pa.list_(pa.list_(pa.int32()))))]
        )
        for batch in batches:
            done = []
            for doc, text, spans, own, held in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "spans", "__rules", "__pages"))):
                by_key = {(doc, r["font"], r["codepoint"]): (r["replacement"] or "", r["evidence"], r["status"]) for r in own or []}
                n = normalized(text or "", doc, spans or [], by_key, {p["page"]: p["__text"] or "" for p in held or []})
                done.append({"text": n.text, "status": n.status, "flags": n.flags, "rules": n.rules, "ranges": [[list(r) for r in x] for x in n.ranges]})
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(done, shape)], [*kept, "normalized"])

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{fields}, normalized {result}")
