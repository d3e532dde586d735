"""Parsers of bibliographic records: MARC lines, Dublin Core JSON, citations, cover pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def marc(lines: Column) -> dict[str, Column]:
    """Fields of a record given as lines 'tag value': title, advisors, keywords, year."""
    of = lambda *tags: F.transform(
        F.filter(lines, lambda x: F.substring(x, 1, 3).isin(list(tags))), lambda x: F.trim(F.substring(x, 4, 100_000))
    )
    title = F.trim(F.get(F.split(F.get(of("245"), F.lit(0)), r"\s+/\s+"), F.lit(0)))
    advisors = F.filter(of("700"), lambda x: F.contains(F.lower(x), F.lit("hướng dẫn")))
    advisors = F.transform(advisors, lambda x: F.trim(F.regexp_replace(x, r"(?iu)[,;(]?\s*(?:người\s+)?hướng dẫn.*$", "")))
    words = F.flatten(F.transform(of("650"), lambda x: F.split(x, r"(?i)<br\s*/?>")))
    keywords = F.array_distinct(F.filter(F.transform(words, lambda x: F.trim(x)), lambda x: x != ""))
    years = F.concat(of("260", "264"), of("502"), of("245"))
    year = F.get(F.filter(F.transform(years, T.first_year), lambda y: y.isNotNull()), F.lit(0))
    return {"title": title, "advisors": advisors, "keywords": keywords, "year": year}


DC = "map<string,array<struct<value:string>>>"


def dublin_core(json: Column) -> dict[str, Column]:
    """Fields of a Dublin Core document {name: [{value}]}."""
    meta = F.from_json(json, DC)
    values = lambda name: F.transform(F.coalesce(meta[name], F.array().cast("array<struct<value:string>>")), lambda x: x["value"])
    one = lambda name: F.get(values(name), F.lit(0))
    kind = F.concat_ws(" ", one("dc.type"), one("dc.description.degree"))
    return {
        "title": one("dc.title"),
        "authors": values("dc.contributor.author"),
        "advisors": values("dc.contributor.advisor"),
        "keywords": values("dc.subject"),
        "abstract": one("dc.description.abstract"),
        "year": T.first_year(one("dc.date.issued")),
        "degree": T.degree(kind),
    }


def citation(text: Column) -> dict[str, Column]:
    """Fields of 'title / author, author; advisor (GVHD). -- place, year'."""
    head = F.get(F.split(text, r"\s+--\s+"), F.lit(0))
    title = F.trim(F.substring_index(head, " / ", 1))
    people = F.when(F.contains(head, F.lit(" / ")), F.regexp_replace(F.substring_index(head, " / ", -1), r"\.\s*$", "")).otherwise("")
    groups = F.transform(F.split(people, ";"), lambda x: F.trim(x))
    is_advisor = lambda x: x.rlike(r"(?iu)gvhd|hướng dẫn")
    names = lambda some: F.filter(F.flatten(F.transform(some, lambda x: F.transform(F.split(x, ","), lambda y: F.trim(F.regexp_replace(y, r"(?iu)\(?\s*(?:gvhd|giảng viên hướng dẫn)\s*\)?:?", ""))))), lambda y: y != "")
    return {
        "title": title,
        "authors": names(F.filter(groups, lambda x: ~is_advisor(x))),
        "advisors": names(F.filter(groups, is_advisor)),
        "year": T.first_year(F.get(F.split(text, r"\s+--\s+"), F.lit(1))),
    }


#: Labels of cover pages.
LABELS = {
    "author": r"(?:sinh\s+viên(?:\s+thực\s+hiện)?|học\s+viên|người\s+thực\s+hiện|author|student)",
    "advisor": r"(?:(?:giảng\s+viên|giáo\s+viên|cán\s+bộ|người)\s+hướng\s+dẫn(?:\s+khoa\s+học)?|gvhd|advisor|supervisor)",
    "faculty": r"(?:khoa|faculty|department)",
    "major": r"(?:ngành|chuyên\s+ngành|major)",
}


def cover_fields(text: str) -> dict[str, str | None]:
    """Values after the labels of a cover: on the label's line, or else on the next line that isn't a label."""
    lines = [re.sub(r"\s+", " ", x).strip(" :-–—") for x in (text or "").splitlines()]
    lines = [x for x in lines if x]
    found: dict[str, str | None] = dict.fromkeys((*LABELS, "year"))
    any_label = re.compile("|".join(f"^{p}" for p in LABELS.values()), re.I)
    for i, line in enumerate(lines):
        for name, pattern in LABELS.items():
            m = re.match(rf"^{pattern}\b\s*[:.\-–]?\s*(.*)$", line, re.I)
            if m and found[name] is None:
                follows = lines[i + 1] if i + 1 < len(lines) and not any_label.match(lines[i + 1]) else None
                found[name] = m[1].strip(" :-–—") or follows
        years = re.findall(r"(?<!\d)((?:19|20)\d{2})(?!\d)", line)
        if years and re.search(r"tháng|năm|city|thành\s+phố|tp|hà\s+nội|^\d{4}$", line, re.I):
            found["year"] = years[-1]
    return found


def covers(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and the fields of each cover text."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = [*LABELS, "year"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [cover_fields(t) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], **{n: pd.Series([g[n] for g in got], dtype="object") for n in names}})

    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} string" for n in names))
