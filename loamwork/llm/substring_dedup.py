"""Substring deduplication by hashing lines and paragraphs: normalised units are grouped by digest over the whole
corpus, the earliest ranked occurrence stays, and the others go, with their offsets in the original text.

Units are of two kinds. Lines are whole lines, whatever stands around them. A passage may also begin and end inside a
line; for those, paragraphs are bounded by the words themselves: one ends at a word whose three-word hash is
lower than those of the four words on either side. That depends on nearby words only, so copies of a passage have
the same paragraphs but for the first and the last few words, wherever they stand. Where up to four words repeat
again and again, no hash is the lowest; there every PERIODIC words are a paragraph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, staged, text_of
from .simhash import LOWER

#: Words on either side that a unit's end is compared with; bytes hashed at once.
SIDE, BLOCK, PERIODIC = 4, 1 << 22, 13
#: Multiplier of the words' polynomial hash, its inverse modulo 2**64, and the mixer of neighbouring words.
FACTOR = 1_099_511_628_211
INVERSE, MIXER = pow(FACTOR, -1, 1 << 64), np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of words (runs of anything but [\\x20\\x09-\\x0D]) and their hashes."""
    raw = np.frombuffer(data, np.uint8)
    dark = np.concatenate(([False], ~((raw == 32) | ((raw >= 9) & (raw <= 13))), [False]))
    edge = np.flatnonzero(dark[1:] != dark[:-1])
    starts, ends = edge[::2], edge[1::2]
    hashes, first = np.zeros(len(starts), np.uint64), 0
    with np.errstate(over="ignore"):
        while first < len(starts):
            past = max(first + 1, int(np.searchsorted(ends, starts[first] + BLOCK, "right")))
            base, stop = int(starts[first]), int(ends[past - 1])
            power = np.uint64(FACTOR) ** np.arange(stop - base, dtype=np.uint64)
            sums = np.concatenate(([np.uint64(0)], np.cumsum((raw[base:stop].astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)))
            back = np.uint64(INVERSE) ** (starts[first:past] - base).astype(np.uint64)
            hashes[first:past] = _mixed((sums[ends[first:past] - base] - sums[starts[first:past] - base]) * back)
            first = past
    return starts, ends, hashes


def unit_ends(hashes: np.ndarray) -> np.ndarray:
    """For words with these hashes: numbers one past the last word of each unit."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        before = np.concatenate(([np.uint64(0)] * 2, hashes))
        window = _mixed(before[2:] + before[1:-1] * MIXER + before[:-2] * MIXER * MIXER)
    padded = np.concatenate((np.full(SIDE, 2**64 - 1, np.uint64), window, np.full(SIDE, 2**64 - 1, np.uint64)))
    low = np.ones(n, bool)
    for k in (*range(SIDE), *range(SIDE + 1, 2 * SIDE + 1)):
        low &= window < padded[k : k + n]
    again = np.zeros(n, bool)
    for k in range(1, SIDE + 1):
        again[k:] |= window[k:] == window[:-k]
    first = np.flatnonzero(again & ~np.concatenate(([False], again[:-1])))
    place = np.arange(n)
    since = place - first[np.maximum(np.searchsorted(first, place, "right") - 1, 0)] if len(first) else place
    low |= again & (since % PERIODIC == 0)
    return np.unique(np.append(np.flatnonzero(low) + 1, n))


Unit = tuple[int, int, int, bytes]


def all_units(text: str, line_words: int) -> tuple[list[tuple[int, Unit]], list[tuple[int, Unit]]]:
    """Lines of at least line_words words and paragraphs, each with its number and (start, end, words, digest): code
    points in the text from its first to its last word, and the 128-bit digest of its normalised words."""
    original = text.encode()
    lower = original.translate(LOWER)
    starts, ends, hashes = word_places(lower)
    if not len(starts):
        return [], []
    joined, shifted = b" ".join(lower.split()), np.cumsum(ends - starts + 1)
    points = np.cumsum((np.frombuffer(original, np.uint8) & 0xC0) != 0x80) if len(original) != len(text) else None

    def of(number: np.ndarray, first: np.ndarray, past: np.ndarray) -> list[tuple[int, Unit]]:
        places = np.concatenate((starts[first], ends[past - 1]))
        if points is not None:
            places = np.where(places > 0, points[places - 1], 0)
        a, b, n = np.where(first > 0, shifted[first - 1], 0), shifted[past - 1] - 1, len(past)
        each = zip(number.tolist(), places[:n].tolist(), places[n:].tolist(), (past - first).tolist(), a.tolist(), b.tolist())
        return [(i, (s, e, w, xxhash.xxh3_128_digest(joined[x:y]))) for i, s, e, w, x, y in each]

    line = np.searchsorted(np.flatnonzero(np.frombuffer(original, np.uint8) == 10), starts)
    first = np.flatnonzero(np.diff(line, prepend=-1))
    past = np.append(first[1:], len(starts))
    long = past - first >= line_words
    lines = of(line[first[long]], first[long], past[long])
    past = unit_ends(hashes)
    return lines, of(np.arange(len(past)), np.concatenate(([0], past[:-1])), past)


def units_of(text: str) -> list[Unit]:
    """The paragraphs only."""
    return [u for _, u in all_units(text, 1 << 31)[1]]


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 25, within: bool = False, line_words: int = 16) -> DataFrame:
    """One row for each passage to remove: doc_id, part, unit (line or paragraph), start, end, n_words, kept_in.

    Lines of at least line_words words are units as they are (shorter ones are line deduplication's), and so are
    paragraphs; a passage may have a row of each unit. A unit is repeated if a document with a smaller id has its digest, or with `within` if it is any but the first
    occurrence by (doc_id, part, place), so that repeats inside a document go too and kept_in may be its own id; repeated lines, and runs of
    repeated paragraphs of at least min_words words together, are passages. start and end are code points in the original text; kept_in is the first
    of the documents in which their units stay; part is a hash of the text, which tells
    rows of the same id apart. A passage's first and last few words may stay, as units begin and end a few words
    inside it; copies of over 50 words always have enough units inside.

    Null and empty texts have no units. Rows without id rank last, together as one document. Repeated rows of an
    id are one document and don't repeat each other. An empty table gives no passages. Other columns are
    ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("body"))
    rows = rows.select("doc_id", F.xxhash64("body").alias("part"), "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            each = [all_units(t.as_py(), line_words) for t in batch["body"]]
            flat = [(row, line, i, *u) for row, kinds in enumerate(each) for line, own in zip((True, False), kinds) for i, u in own]
            row, line, i, start, end, words, digest = zip(*flat) if flat else ((),) * 7
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch["doc_id"].take(pa.array(row, pa.int64())),
                    "part": batch["part"].take(pa.array(row, pa.int64())),
                    "line": pa.array(line, pa.bool_()),
                    "i": pa.array(i, pa.int32()),
                    "start": pa.array(start, pa.int32()),
                    "end": pa.array(end, pa.int32()),
                    "words": pa.array(words, pa.int32()),
                    "digest": pa.array(digest, pa.binary()),
                }
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    units = rows.mapInArrow(run, f"doc_id {kind}, part bigint, line boolean, i int, start int, end int, words int, digest binary")
    units = staged(units, "passage-units")
    if within:
        spot = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "part", "i")
        shared = units.groupBy("line", "digest").agg(F.min(spot).alias("first"), F.max(spot).alias("last"))
        shared = staged(shared.where("first <> last").select("line", "digest", "first"), "shared-units")
        repeated = units.join(shared, ["line", "digest"]).where(spot != F.col("first")).withColumn("kept_in", F.col("first.doc_id"))
        repeated = repeated.drop("digest", "first").distinct()
    else:
        shared = units.groupBy("line", "digest").agg(F.min("doc_id").alias("kept_in"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("none"))
        shared = staged(shared.where("kept_in < last OR (none AND kept_in IS NOT NULL)").select("line", "digest", "kept_in"), "shared-units")
        repeated = units.join(shared, ["line", "digest"]).where(~F.col("doc_id").eqNullSafe(F.col("kept_in"))).drop("digest").distinct()
    place = F.row_number().over(Window.partitionBy("doc_id", "part", "line").orderBy("i"))
    runs = repeated.withColumn("run", F.col("i") - place).groupBy("doc_id", "part", "line", "run")
    passages = runs.agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("n_words"), F.min("kept_in").alias("kept_in")
    )
    passages = passages.where(F.col("line") | (F.col("n_words") >= min_words))
    return passages.select("doc_id", "part", F.when(F.col("line"), "line").otherwise("paragraph").alias("unit"), "start", "end", "n_words", "kept_in")


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 25, within: bool = False, line_words: int = 16) -> DataFrame:
    """The input rows with the repeated passages cut out of text_col, and column removed: array of (start, end) in
    the original text, apart from each other. A column named removed in the input is replaced; others pass unchanged."""
    place = Window.partitionBy("doc_id", "part").orderBy("start", "end")
    reach = F.max("end").over(place.rowsBetween(Window.unboundedPreceding, -1))
    gone = repeated_passages(docs, id_col, text_col, min_words, within, line_words)
    gone = gone.withColumn("apart", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("run", F.sum("apart").over(place))
    gone = gone.groupBy("doc_id", "part", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    gone = gone.groupBy(F.col("doc_id").alias("gone_id"), F.col("part").alias("gone_part")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("gone"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    body = F.coalesce(F.col("row")[text_col], F.lit(""))
    rows = rows.select("row", F.col("row")[id_col].alias("id"), F.xxhash64(body).alias("part"))
    met = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("part") == F.col("gone_part")), "left").select("row", body.alias("body"), "gone")
    kept = F.aggregate(
        "gone",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("text")),
        lambda a, g: F.struct(g["end"].alias("at"), F.concat(a["text"], F.substring("body", a["at"] + 1, g["start"] - a["at"])).alias("text")),
    )
    met = met.select("row", "body", "gone", kept.alias("kept"))
    text = F.when(F.col("gone").isNull(), F.col("row")[text_col]).otherwise(F.concat("kept.text", F.substring("body", F.col("kept.at") + 1, F.char_length("body"))))
    met = met.select("row", text.alias("text"), F.coalesce("gone", F.array().cast("array<struct<start:int,end:int>>")).alias("gone"))
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in (text_col, "removed")]
    return met.select(*own, F.col("text").alias(text_col), F.col("gone").alias("removed"))
