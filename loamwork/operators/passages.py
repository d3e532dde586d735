"""Sentences, passages and model windows: folds over the ordered units of a document.

Folds whose next step depends on what was merged before run per document in Python; a group is one document (or
one of its sections), which bounds a task's memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+|[^\w\s]", re.UNICODE)
TERMINAL = ".!?"
#: Abbreviations that don't end a sentence.
ABBREVIATIONS = {"ts", "ths", "th.s", "gs", "pgs", "pgs.ts", "gs.ts", "pgs.th.s", "tp", "dr", "mr", "mrs", "ms", "prof", "vs", "v.v"}
ABBREVIATED = re.compile(r"\b(?:tp|ts|pgs|ths|gs|ks|dr|prof|mr|mrs|ms|e\.g|i\.e|etc|v\.v|stt|qđ|tt|nxb)\.$", re.I)
NUMBERED = re.compile(r"^(?:\d+(?:\.\d+)*\.?\s+|[IVXLCDM]+\.\s+|(?:Chương|Mục|Phần|Bước)\s+\d+)", re.I)
BULLET = re.compile(r"^[•▪*+\-]\s*[A-ZÀ-Ỹ0-9]")
WRAPPED_BULLET = re.compile(r"^[•▪*+]\s*(?=[a-zà-ỹ])")
CONTINUES = {"và", "hoặc", "nhưng", "mà", "được", "là", "trong", "với", "để", "do", "bởi", "thì", "tại", "như"}


def label_of(role: Column) -> Column:
    """Stand-in labels of conversation roles: human, generated, polished."""
    return F.when(role == "user", "H").when(role == "assistant", "G").otherwise("P")


def composition(rows: DataFrame, key: str, order: str, label: str, tokens: str) -> DataFrame:
    """Label sequence with | at changes, boundaries, and the token shares of G and of P or G."""
    w = Window.partitionBy(key).orderBy(order)
    rows = rows.withColumn("__p", F.lag(label).over(w))
    changed = F.coalesce(F.col("__p") != F.col(label), F.lit(False))
    tag = F.when(changed, F.concat(F.lit("| "), F.col(label))).otherwise(F.col(label))
    share = lambda some: F.round(F.sum(F.when(some, F.col(tokens)).otherwise(0)) / F.greatest(F.lit(1), F.sum(tokens)), 4)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), tag.alias("t"))))
    return rows.groupBy(key).agg(
        F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("label_sequence"),
        F.count_if(changed).alias("boundaries"),
        share(F.col(label) == "G").alias("r_g"),
        share(F.col(label) != "H").alias("r_ai"),
    )


def estimate(n: int) -> int:
    """Tokens with the reserve of 18 per cent, in whole numbers."""
    return max(1, -(-n * 118 // 100))


def pack(counts: list[int], joins: list[bool], target: int, least: int, most: int) -> list[tuple[int, int]]:
    """Ranges of units that make passages.

    counts are raw token counts, which add up over units joined by a blank; joins[i] says that unit i may follow
    unit i - 1 in a passage. A passage closes at the target, before it would exceed most, or where units don't
    join; a unit beyond most stands alone. From the end, a passage below least joins its predecessor if it may.
    """
    groups: list[list[int]] = []
    start, total = None, 0

    def close(end: int) -> None:
        nonlocal start
        if start is not None:
            groups.append([start, end, total])
        start = None

    for i, n in enumerate(counts):
        if estimate(n) > most:
            close(i)
            groups.append([i, i + 1, n])
            continue
        if start is not None and (not joins[i] or estimate(total + n) > most):
            close(i)
        if start is None:
            start, total = i, 0
        total += n
        if estimate(total) >= target:
            close(i + 1)
    close(len(counts))
    for g in range(len(groups) - 1, 0, -1):
        (_, _, n), (_, _, m) = groups[g], groups[g - 1]
        if estimate(n) < least and joins[groups[g][0]] and estimate(n + m) <= most:
            groups[g - 1] = [groups[g - 1][0], groups[g][1], n + m]
            del groups[g]
    return [(a, b) for a, b, _ in groups]


def arrow_batch(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def arrow_types(ddl: str) -> tuple[list[str], list[pa.DataType]]:
    """Names and Arrow types of simple columns."""
    plain = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<boolean>": pa.list_(pa.bool_())}
    names, kinds = zip(*(f.split(" ") for f in ddl.split(", ")))
    return list(names), [plain[k] for k in kinds]


def _by_group(units: DataFrame, keys: list[str], fields: list[str], run: Callable[..., list[tuple]], ddl: str, rows: int = 100) -> DataFrame:
    """Rows of run(*keys, *fields) for each group, fields as lists in the order of ordinal.

    Groups come as arrays, many to an Arrow batch, so none costs a frame of its own; a worker turns `rows` of them
    at a time into Python objects.
    """
    kinds = {f.name: f.dataType.simpleString() for f in units.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), ddl])
    names, types = arrow_types(schema)
    groups = units.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ordinal", *(f for f in fields if f != "ordinal")))).alias("__u"))
    groups = groups.select(*keys, *(F.col(f"__u.{f}").alias(f"__{f}") for f in fields))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield arrow_batch(names, types, [r for group in zip(*(c.to_pylist() for c in part.columns)) for r in run(*group)])

    return groups.mapInArrow(work, schema)


def packed(units: DataFrame, target: int = 384, least: int = 128, most: int = 512) -> DataFrame:
    """Passages of units (doc_id, ordinal, section, tokens): first and last ordinal, text, tokens, short_tail."""

    def run(doc, ordinals: list[int], sections: list[str | None], counts: list[int], lines: list[str]) -> list[tuple]:
        named = [s or "" for s in sections]
        joins = [i > 0 and named[i] == named[i - 1] and ordinals[i] == ordinals[i - 1] + 1 for i in range(len(lines))]
        out = []
        for a, b in pack(counts, joins, target, least, most):
            n = estimate(sum(counts[a:b]))
            out.append((doc, ordinals[a], ordinals[b - 1], " ".join(lines[a:b]), n, n < least))
        return out

    ddl = "first_ordinal int, last_ordinal int, text string, approx_tokens int, short_tail boolean"
    return _by_group(units, ["doc_id"], ["ordinal", "section", "tokens", "line"], run, ddl)


def heals(before: str, now: str) -> bool:
    """Whether a unit continues the one before it: release rule."""
    if NUMBERED.match(now):
        return False
    hyphen = before.endswith("-") and not before.endswith(" -")
    abbreviated = before.endswith(".") and bool(ABBREVIATED.search(before[-8:]))  # its longest match has 4 characters
    return before.endswith(",") or hyphen or abbreviated or (now[0].islower() and before[-1] not in TERMINAL)


def continues(before: str, now: str) -> bool:
    """Whether a line continues the sentence before it: curation rule."""
    if not before or not now or NUMBERED.match(now) or BULLET.match(now):
        return False
    if WRAPPED_BULLET.match(now) or now[0].islower() or before[-1] in ",-":
        return True
    if before[-1] in ".!?…\"'”’:;":
        return False
    return now.split(None, 1)[0].lower() in CONTINUES or len(before.split(None, 3)) <= 3


def joined_text(before: str, now: str) -> str:
    return before[:-1] + now if before.endswith("-") and not before.endswith(" -") else f"{before} {now}"


def fold(texts: list[str], merges, most: int | None = None) -> list[tuple[str, int, int]]:
    """Merge texts left to right: (text, index of its first unit, number of units)."""
    out: list[list] = []
    for i, text in enumerate(texts):
        text = text.strip()
        if not text:
            continue
        if out and merges(out[-1][0], text):
            both = joined_text(out[-1][0], WRAPPED_BULLET.sub("", text))
            if most is None or estimate(len(TOKEN.findall(both))) <= most:
                out[-1][0], out[-1][2] = both, out[-1][2] + 1
                continue
        out.append([text, i, 1])
    return [tuple(x) for x in out]


def _folded(units: DataFrame, merges, most: int | None) -> DataFrame:
    def run(doc, ordinals: list[int], lines: list[str]) -> list[tuple]:
        return [(doc, ordinals[i], text, n) for text, i, n in fold(lines, merges, most)]

    return _by_group(units, ["doc_id"], ["ordinal", "line"], run, "ordinal int, text string, n_units int")


def healed(units: DataFrame, most: int = 420) -> DataFrame:
    """Units merged by the release rule while the result stays within `most` estimated tokens."""
    return _folded(units, heals, most)


def merged(units: DataFrame) -> DataFrame:
    """Units merged by the curation rule; repeated consecutive units count once."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    once = units.withColumn("__p", F.lag("line").over(w)).where(~F.col("__p").eqNullSafe(F.col("line"))).drop("__p")
    return _folded(once, continues, None)


def sentence_bounds(text: str) -> list[tuple[int, int]]:
    """Sentences of prose: after a stop, its closing marks and blanks comes a capital or a digit. Decimals,
    abbreviations and numbers of headings don't end one."""
    bounds, start = [], 0
    for m in re.finditer(r"[.!?…][\"'”’)\]}]*(\s+)(?=[\"'“‘(\[{]*(\S))", text):
        opening = re.match(r"[\"'“‘(\[{]*(\S?)", text[m.end() :])[1]
        if not (opening.isupper() or opening.isdigit()):
            continue
        stop = m.start()
        if text[stop] == ".":
            prefix = text[start : stop + 1]
            word = re.search(r"(\S+)\.$", prefix)
            if word and word[1].casefold() in ABBREVIATIONS or re.fullmatch(r"\s*\d+(?:\.\d+)*\.", prefix):
                continue
        bounds.append((start, m.start(1)))
        start = m.end()
    end = len(text.rstrip())
    if start < end:
        bounds.append((start, end))
    trimmed = [(a + len(text[a:b]) - len(text[a:b].lstrip()), b) for a, b in bounds]
    return [(a, b) for a, b in trimmed if a < b]


def split_long(text: str, start: int, end: int, most: int = 512) -> list[tuple[int, int]]:
    """Pieces of at most `most` estimated tokens: cut after punctuation, else at a blank, else at a token."""
    out, todo = [], [(start, end)]
    while todo:
        a, b = todo.pop()
        a += len(text[a:b]) - len(text[a:b].lstrip())
        b = a + len(text[a:b].rstrip())
        if a >= b:
            continue
        tokens = list(TOKEN.finditer(text, a, b))
        if estimate(len(tokens)) <= most:
            out.append((a, b))
            continue
        cut = tokens[min(max(1, most * 100 // 118 - 1), len(tokens)) - 1].end() - a
        half = max(1, cut // 2)
        marks = [m.end() for m in re.finditer(r"[.!?…;:,](?=\s)", text[a : a + cut]) if m.end() >= half]
        blank = text.rfind(" ", a + half, a + cut) - a
        cut = marks[-1] if marks else blank if blank > 0 else cut
        if not 0 < cut < b - a:
            cut = max(1, (b - a) // 2)
        todo += [(a + cut, b), (a, a + cut)]
    return out


def sentences(docs: DataFrame, most: int = 512) -> DataFrame:
    """doc_id, ordinal, start, end, text of each sentence (or piece of an overlong one), in code points."""

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ordinal int, start int, end int, text string"
    names, types = arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):  # what a worker holds beside the batch stays small
                rows = []
                for doc, text in zip(*(c.to_pylist() for c in batch.slice(at, 100).columns)):
                    text = text or ""
                    spans = [p for a, b in sentence_bounds(text) for p in split_long(text, a, b, most)]
                    rows += [(doc, i, a, b, text[a:b]) for i, (a, b) in enumerate(spans)]
                yield arrow_batch(names, types, rows)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def windows_of(counts: list[int], usable: int, central_ratio: float = 0.75) -> list[tuple[int, int, int, int]]:
    """(left, central start, central end, right) over units with these token counts.

    Central ranges partition the units within their share of the budget; context grows outward on each side
    within half of the rest, and shrinks, right side first, if the whole exceeds the budget.
    """
    budget = max(1, int(usable * central_ratio))
    side = max(0, (usable - budget) // 2)
    out, start = [], 0
    while start < len(counts):
        end, total = start + 1, counts[start]
        while end < len(counts) and total < budget and total + counts[end] + 1 <= budget:
            total += counts[end] + 1
            end += 1
        left, used = start, 0
        while left > 0 and used + counts[left - 1] + 1 <= side:
            left -= 1
            used += counts[left] + 1
        right, used = end, 0
        while right < len(counts) and used + counts[right] + 1 <= side:
            used += counts[right] + 1
            right += 1
        while sum(counts[left:right]) > usable and (left < start or right > end):
            left, right = (left, right - 1) if right > end else (left + 1, right)
        out.append((left, start, end, right))
        start = end
    return out


def model_windows(units: DataFrame, max_tokens: int = 512, central_ratio: float = 0.75, special: int = 2) -> DataFrame:
    """Windows over each section's units: text, tokens, masks. Each unit carries loss in exactly one window.

    Tokens are white-space runs; a unit beyond the budget is divided at tokens first.
    """
    usable = max_tokens - special
    if usable < 8:
        raise ValueError("max_tokens leaves no room for text")

    def run(doc, section, ordinals: list[int], lines: list[str]) -> list[tuple]:
        parts = []
        for ordinal, line in zip(ordinals, lines):
            words = line.split()
            parts += [(ordinal, " ".join(words[i : i + usable]), len(words[i : i + usable])) for i in range(0, len(words), usable)]
        rows = []
        for left, a, b, right in windows_of([p[2] for p in parts], usable, central_ratio):
            chosen = parts[left:right]
            loss = [a <= i < b for i in range(left, right)]
            rows.append((doc, section, [p[0] for p in chosen], loss, [not x for x in loss], " ".join(p[1] for p in chosen), sum(p[2] for p in chosen) + special, sum(loss)))
        return rows

    ddl = "ordinals array<int>, loss_mask array<boolean>, context_mask array<boolean>, text string, token_count int, n_loss int"
    return _by_group(units, ["doc_id", "section"], ["ordinal", "line"], run, ddl)
