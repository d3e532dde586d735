"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming distance by pivot tables.

Distinct fingerprints meet in buckets. In a bucket each fingerprint has a row in a table of its Hamming distances
to fixed reference fingerprints (pivots). By the triangle inequality no two fingerprints are closer than their
largest difference in any coordinate, so pairs beyond it are discarded and only survivors are compared.

Buckets are exact for small distances: with d + c blocks of bits, two fingerprints within d bits agree on some c
blocks, so there is a table for each choice of c blocks (c is 2, or more for over 2**24 fingerprints).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, staged, text_of
from .graph import components

LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
#: Reference fingerprints of a pivot table, shingles hashed at once, and the run length from which links are a spanning forest.
PIVOTS, BLOCK, LONG_RUN = 16, 1 << 15, 9


def shingle_bytes(text: str, k: int) -> Iterator[bytes]:
    """k-word shingles with repeats: lower-case A-Z, words apart by [\\x20\\x09-\\x0D], joined by a space."""
    words = text.encode().translate(LOWER).split()
    if words:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        for a, b in zip(starts[: max(1, len(words) - k + 1)].tolist(), ends[min(k, len(words)) - 1 :].tolist()):
            yield joined[a:b]


def fingerprint(text: str, k: int, bits: int, seed: int) -> bytes:
    """Big-endian: a bit is set if it is set in over half of the shingles' hashes (XXH64 with seed, seed + 1, ...)."""
    shingles, seeds, n = shingle_bytes(text, k), range(seed, seed + bits // 64), 0
    counts = np.zeros(bits, np.int64)
    while block := [s for s, _ in zip(shingles, range(BLOCK))]:
        n += len(block)
        for j, own in enumerate(seeds):
            hashes = np.array([xxhash.xxh64_intdigest(s, own) for s in block], ">u8")
            rows = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
            counts[64 * j : 64 * (j + 1)] += rows.sum(0, dtype=np.int64)
    return np.packbits(2 * counts > n).tobytes()


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 64, seed: int = 42
) -> DataFrame:
    """doc_id, fp (binary) for each row; a text without words, or null, has the fingerprint zero."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [fingerprint(t.as_py(), shingle, bits, seed) for t in batch["body"]]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "fp": pa.array(own, pa.binary())})

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp binary")


def exact_tables(bits: int, distance: int, rows: int) -> list[list[int]]:
    """Bit positions of each table such that all pairs within the distance meet; keys as long as rows call for."""
    for c in range(2, bits - distance + 1):
        cuts = [round(i * bits / (distance + c)) for i in range(distance + c + 1)]
        blocks = [list(range(a, b)) for a, b in zip(cuts, cuts[1:])]
        if c * (bits // (distance + c)) >= min(math.log2(max(rows, 2)), 32):
            break
    return [sum(chosen, []) for chosen in combinations(blocks, c)]


def pivot_table(words: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (rows of 64-bit words) to the reference fingerprints."""
    pivots = np.random.default_rng(11).integers(0, 2**64, (PIVOTS, words.shape[1]), np.uint64)
    return np.stack([np.bitwise_count(words ^ p).sum(1, dtype=np.int16) for p in pivots], 1)


def linked(words: np.ndarray, table: np.ndarray, a, b, distance) -> np.ndarray:
    """Which of the pairs (a, b) are within the distance (one for all, or one each): pivots first, survivors verified."""
    near = np.abs(table[a] - table[b]).max(1) <= distance
    a, b, distance = np.broadcast_arrays(a, b, distance)
    near[near] = np.bitwise_count(words[a[near]] ^ words[b[near]]).sum(1) <= distance[near]
    return near


def _forest(words: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among words, depth first: at most one edge for each fingerprint."""
    table, rest, a, b = pivot_table(words), np.arange(len(words)), [], []
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            x = front.pop()
            got = linked(words, table, np.array([x]), rest, distance)
            found, rest = rest[got].tolist(), rest[~got]
            a += [x] * len(found)
            b += found
            front += found
    return a, b


def _links_of_runs(keys: np.ndarray, words: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal keys, as index pairs that connect what is within the distance."""
    starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1))))
    sizes = np.diff(np.append(starts, len(keys)))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = np.repeat((sizes > 1) & (sizes < LONG_RUN), sizes)
    run, some = np.repeat(np.arange(len(starts)), sizes), np.flatnonzero(small)
    if len(some):
        table, own, held = pivot_table(words[some]), words[some], run[some]
        for lag in range(1, LONG_RUN - 1):
            i = np.flatnonzero(held[lag:] == held[:-lag])
            i = i[linked(own, table, i, i + lag, distance)] if len(i) else i
            a.append(some[i])
            b.append(some[i + lag])
    for at, size in zip(starts[sizes >= LONG_RUN], sizes[sizes >= LONG_RUN]):
        x, y = _forest(words[at : at + size], distance)
        a.append(np.array(x, np.int64) + at)
        b.append(np.array(y, np.int64) + at)
    return np.concatenate(a), np.concatenate(b)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _whole_runs(batches: Iterator[pa.RecordBatch], width: int, columns: tuple[str, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    """From sorted batches: keys (t, key, pair) and the bytes of columns, such that no run of equal keys is cut."""
    held = [np.zeros((0, 3), np.int64), *(np.zeros((0, width), np.uint8) for _ in columns)]
    for batch in batches:
        fresh = [np.stack([batch[c].to_numpy().astype(np.int64) for c in ("t", "key", "pair")], 1), *(_matrix(batch[c], width) for c in columns)]
        held = [np.concatenate(x) for x in zip(held, fresh)]
        keys = held[0]
        if not len(keys):
            continue
        past = len(keys) - int(np.argmax((keys[::-1] != keys[-1]).any(1))) if (keys != keys[-1]).any() else 0
        if past:
            yield tuple(x[:past] for x in held)
        held = [x[past:] for x in held]
    if len(held[0]):
        yield tuple(held)


def links(distinct: DataFrame, tables: list[list[int]], distance: int, bits: int, bucket_rows: int = 200_000) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints `fp` as their pairs within the distance do.

    A bucket of more than bucket_rows is dealt into blocks and each pair of blocks is searched on its own, so
    a task holds at most about 2 * bucket_rows fingerprints and no link is lost. Runs of LONG_RUN or more give a
    spanning forest only, which connects all that is linked.
    """
    width = bits // 8

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit, n = np.unpackbits(_matrix(batch["fp"], width), axis=1), batch.num_rows
            for t, chosen in enumerate(tables):
                key = np.zeros((n, 64), np.uint8)
                key[:, 64 - min(64, len(chosen)) :] = bit[:, chosen[:64]]
                yield pa.RecordBatch.from_pydict(
                    {
                        "t": pa.array(np.full(n, t, np.int32)),
                        "key": pa.array(np.packbits(key, axis=1).view(">i8").ravel().astype(np.int64)),
                        "fp": batch["fp"],
                    }
                )

    placed = staged(distinct.select("fp").mapInArrow(keyed, "t int, key bigint, fp binary"), "buckets")
    large = placed.groupBy("t", "key").count().where(F.col("count") > bucket_rows)
    placed = placed.withColumn("pair", F.lit(0).cast("long"))
    if not large.isEmpty():
        blocks = F.ceil(F.col("count") / bucket_rows).cast("long")
        own = F.pmod(F.xxhash64("fp"), blocks)
        placed = (
            placed.join(large, ["t", "key"], "left")
            .withColumn("other", F.explode(F.when(F.col("count").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), blocks - 1))))
            .withColumn("pair", F.when(F.col("count").isNull(), 0).otherwise(F.least(own, "other") * 1_000_003 + F.greatest(own, "other")).cast("long"))
            .select("t", "key", "fp", "pair")
        )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps in _whole_runs(batches, width, ("fp",)):
            a, b = _links_of_runs(keys, np.ascontiguousarray(fps).view(np.uint64), distance)
            yield pa.RecordBatch.from_pydict({"a": _binary(fps[a]), "b": _binary(fps[b])})

    return (
        placed.repartition("t", "key", "pair")
        .sortWithinPartitions("t", "key", "pair", "fp")
        .mapInArrow(search, "a binary, b binary")
    )


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    distance: int = 3,
    bits: int = 64,
    seed: int = 42,
    bucket_rows: int = 200_000,
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (lower-case hex), component_id (smallest doc_id reachable by links).

    Fingerprints within `distance` bits are linked; the search is exact. Equal fingerprints are one node, so
    copies never meet as pairs. Null or wordless texts have the fingerprint zero and link like any other. Null
    ids take no part in the minimum; a component of null ids only has a null component_id. Repeated rows each
    get their row. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    own = staged(fingerprints(docs, id_col, text_col, shingle, bits, seed), "fingerprints")
    distinct = staged(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    tables = exact_tables(bits, distance, distinct.count())
    label = labelled(distinct, links(distinct, tables, distance, bits, bucket_rows))
    return own.join(label, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def labelled(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """fp, component_id for distinct fingerprints (fp, least)."""
    roots = components(edges)
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least"
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")
