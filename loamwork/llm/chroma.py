"""Chroma audio fingerprints: integral-image filters over pitch-class frames, packed into integers; recordings align
by histograms of offsets between equal integers and are compared by their bit errors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


@dataclass(frozen=True)
class Settings:
    """Frames of `frame` samples every `hop` at `rate` Hz; an integer looks at `span` frames; bits change at 0 and
    +-`step` of a filter's log ratio."""

    rate: int = 2_000
    frame: int = 512
    hop: int = 100
    low: float = 110.0
    high: float = 960.0
    span: int = 16
    step: float = 0.15
    smooth: tuple[float, ...] = (0.25, 0.75, 1.0, 0.75, 0.25)


def filters(s: Settings) -> list[tuple[int, int, int, int]]:
    """16 filters (shape, first pitch class, height, width): shapes in turn, over different parts of the octave."""
    return [(i % 5, (5 * i) % 12, 2 + 2 * (i % 3), (s.span // 4) * (1 + (i // 4) % 4)) for i in range(16)]


def pcm16(value: bytes) -> np.ndarray:
    """Samples of little-endian 16-bit PCM."""
    return np.frombuffer(value[: len(value) // 2 * 2], "<i2").astype(np.float32) / 32768


def chroma(samples: np.ndarray, s: Settings) -> np.ndarray:
    """Frames by 12 pitch classes: energies, smoothed over time, each frame scaled to length 1 (silence stays 0)."""
    if len(samples) < s.frame:
        samples = np.pad(samples, (0, s.frame - len(samples)))
    cut = np.lib.stride_tricks.sliding_window_view(np.nan_to_num(samples), s.frame)[:: s.hop]
    energy = np.abs(np.fft.rfft(cut * np.hamming(s.frame), axis=1)) ** 2
    hertz = np.fft.rfftfreq(s.frame, 1 / s.rate)
    used = np.flatnonzero((hertz >= s.low) & (hertz <= s.high))
    pitch = np.round(12 * np.log2(hertz[used] / 440)).astype(int) % 12
    out = np.stack([energy[:, used[pitch == p]].sum(1) for p in range(12)], 1)
    kernel = np.array(s.smooth)
    out = np.stack([np.convolve(out[:, p], kernel, "same")[: len(out)] for p in range(12)], 1) if len(out) >= len(kernel) else out
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(length > 1e-6, out / np.maximum(length, 1e-6), 0.0)


def packed(frames: np.ndarray, s: Settings) -> np.ndarray:
    """One unsigned 32-bit integer for each position that `span` frames fit at."""
    n = len(frames) - s.span + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 25))
    image[1:, 1:] = np.concatenate([frames, frames], 1).cumsum(0).cumsum(1)  # pitch classes go round

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[t1 : t1 + n, p1] - image[t0 : t0 + n, p1] - image[t1 : t1 + n, p0] + image[t0 : t0 + n, p0]

    out = np.zeros(n, np.uint32)
    for shape, p, h, w in filters(s):
        whole, mid_t, mid_p = area(0, w, p, p + h), w // 2, p + h // 2
        if shape == 0:
            some = area(0, mid_t, p, p + h)
        elif shape == 1:
            some = area(0, w, p, mid_p)
        elif shape == 2:
            some = area(0, mid_t, p, mid_p) + area(mid_t, w, mid_p, p + h)
        elif shape == 3:
            some = area(w // 4, w - w // 4, p, p + h)
        else:
            some = area(0, w, (p + 6) % 12, (p + 6) % 12 + h)
        rest = whole if shape == 4 else whole - some
        ratio = np.log1p(np.maximum(some, 0)) - np.log1p(np.maximum(rest, 0))
        level = (ratio > -s.step).astype(np.uint32) + (ratio > 0) + (ratio > s.step)
        out = out << np.uint32(2) | (level ^ (level >> np.uint32(1)))  # neighbouring levels differ by one bit
    return out


def fingerprints(
    media: DataFrame, id_col: str, media_col: str, decode: Callable[[object], np.ndarray] = pcm16, s: Settings = Settings()
) -> DataFrame:
    """One row per input row: id, fp (binary, little-endian unsigned 32-bit integers).

    Null, empty, or too short media have an empty fingerprint. Null ids and repeated rows are ordinary. Other
    columns are ignored, whatever their names.
    """
    rows = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for value in batch["media"]:
                samples = decode(value.as_py()) if value.is_valid else np.zeros(0)
                own.append(packed(chroma(samples, s), s).astype("<u4").tobytes() if len(samples) else b"")
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "fp": pa.array(own, pa.binary())})

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp binary")


def bit_error(a: bytes, b: bytes, offset: int) -> tuple[float, int]:
    """Share of differing bits where b, moved by offset, lies over a, and how many integers that is."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    first, last = max(0, offset), min(len(x), len(y) + offset)
    n = last - first
    if n <= 0:
        return 1.0, 0
    return float(np.bitwise_count(x[first:last] ^ y[first - offset : last - offset]).sum()) / (32 * n), n


def aligned(
    prints: DataFrame, is_query, most_error: float = 0.1, least_overlap: int = 32, run: int = 2
) -> DataFrame:
    """Matches of each query recording: query_id, match_id, match_size, offset, bit_error, overlap.

    Recordings with the same fingerprint are one class; match_id is the smallest id of the matching class and
    match_size its rows (the query itself is in its own class, at offset 0). Classes meet where `run` consecutive
    integers are equal; the histogram of their offsets names the one that is compared, bit by bit. Positions
    whose run repeats within a recording count once. Empty fingerprints match nothing.
    """
    prints = staged(prints.where("octet_length(fp) > 0"), "chroma-prints")
    classes = prints.groupBy("fp").agg(F.min("id").alias("match_id"), F.count(F.lit(1)).alias("match_size"))
    classes = staged(classes.withColumn("c", F.unhex(F.md5("fp"))), "chroma-classes")
    asked = staged(
        prints.where(is_query).select("id", "fp").join(classes.select("fp", "c"), "fp").select("id", "c"), "chroma-queries"
    )

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, fp in zip(batch["c"], batch["fp"]):
                x = np.frombuffer(fp.as_py(), "<u4").astype(np.uint64)
                n = len(x) - run + 1
                if n < 1:
                    continue
                key = x[:n]
                for i in range(1, run):
                    key = key * np.uint64(0x9E3779B97F4A7C15) ^ x[i : i + n]
                key, at = np.unique(key, return_index=True)
                yield pa.RecordBatch.from_pydict(
                    {"c": pa.array([c.as_py()] * len(key), pa.binary()), "key": pa.array(key.view(np.int64)), "at": pa.array(at.astype(np.int32))}
                )

    index = staged(classes.select("c", "fp").mapInArrow(positions, "c binary, key bigint, at int"), "chroma-index")
    own = index.join(asked.select("c").distinct(), "c", "left_semi").select(F.col("c").alias("q"), "key", F.col("at").alias("q_at"))
    votes = own.join(index, "key").groupBy("q", "c", (F.col("q_at") - F.col("at")).alias("offset")).agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("q", "c").agg(F.max(F.struct("votes", (-F.abs("offset")).alias("near"), "offset")).alias("best"))
    pairs = best.select("q", "c", F.col("best.offset").alias("offset"))
    pairs = pairs.join(classes.select(F.col("c").alias("q"), F.col("fp").alias("x")), "q")
    pairs = pairs.join(classes.select("c", F.col("fp").alias("y"), "match_id", "match_size"), "c")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [bit_error(x.as_py(), y.as_py(), o.as_py()) for x, y, o in zip(batch["x"], batch["y"], batch["offset"])]
            rows = pa.RecordBatch.from_pydict(
                {k: batch[k] for k in ("q", "match_id", "match_size", "offset")}
                | {"bit_error": pa.array([round(e, 6) for e, _ in got], pa.float64()), "overlap": pa.array([n for _, n in got], pa.int64())}
            )
            yield rows.filter(pa.array([e <= most_error and n >= least_overlap for e, n in got], pa.bool_()))

    kind = prints.schema["id"].dataType.simpleString()
    found = pairs.mapInArrow(compared, f"q binary, match_id {kind}, match_size bigint, offset int, bit_error double, overlap bigint")
    return found.join(asked.select(F.col("c").alias("q"), F.col("id").alias("query_id")), "q").drop("q").select(
        "query_id", "match_id", "match_size", "offset", "bit_error", "overlap"
    )


def melody(vector, rate: int = 2_000, note: int = 200) -> np.ndarray:
    """A stand-in recording of a vector: each value is a note of `note` samples, up to an octave around 440 Hz."""
    values = np.nan_to_num(np.array([0.0 if v is None else v for v in vector], np.float64))
    hertz = 440 * 2 ** (np.clip(np.round(values * 36), -12, 12) / 12)
    return (0.8 * np.sin(2 * np.pi * np.cumsum(np.repeat(hertz, note)) / rate)).astype(np.float32)
