"""Near-duplicate removal by SimHash: pivot distance tables discard pairs, survivors are verified by Jaccard similarity.

Texts of equal shingle sets are one node. Nodes meet in the buckets of a fixed number of min-hash bands, whatever the
size of the table. In a bucket each fingerprint has a row of Hamming distances to reference fingerprints; pairs
with a larger difference in any coordinate than the limit are discarded, then those whose fingerprints differ more,
and what is left is held against the shingle sets of the whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, staged
from .graph import components
from .simhash import LOWER, linked, pivot_table

#: Bits of a fingerprint, bands and min-hashes of a band: pairs of similarity 0.8 meet in a band with probability 0.988.
BITS, BANDS, ROWS = 512, 24, 8
#: Shingles hashed at once, and the run length from which only a spanning forest is taken at first.
BLOCK, LONG_RUN = 1024, 9
#: Fewer shingles than this make fingerprints that scatter more: the share of bits that may differ instead of the limit.
SMALL_SETS = ((16, 1.0), (128, 0.25))
#: Rows of a bucket, and bytes of shingle sets, that one task holds of a block.
BUCKET_ROWS, BUCKET_BYTES = 100_000, 1 << 25

_rng = np.random.default_rng(5)
#: Odd multipliers: of a shingle's words, of the fingerprint's further 64-bit words, and of the min-hashes.
_PLACE, _WORD, _MIN = (_rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1) for n in (64, BITS // 64, BANDS * ROWS))


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; a text of fewer words is one shingle, one without words none."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)
    n = max(1, len(own) - k + 1)
    sums = np.zeros(n, np.uint64)
    for j in range(min(k, len(own))):
        sums += own[j : j + n] * _PLACE[j % 64]
    return np.unique(_mixed(sums))


def fingerprint(hashes: np.ndarray) -> bytes:
    """A bit is set if it is set in over half of the set's hashes; further 64-bit words are hashes of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 255):
        words = _mixed(hashes[at : at + 255, None] * _WORD)
        counts += np.unpackbits(words.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def bands(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band: a hash of the least values of its min-hash functions."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        np.minimum(least, (hashes[at : at + BLOCK, None] * _MIN).min(0), out=least)
    return _mixed((_mixed(least).reshape(BANDS, ROWS) * _PLACE[:ROWS]).sum(1, dtype=np.uint64)).astype(np.int64)


def distance_limit(bits: int, similarity: float) -> int:
    """Mean and 2.5 standard deviations of the distance at which large sets of this similarity have their fingerprints."""
    angle = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * angle + 2.5 * math.sqrt(bits * angle * (1 - angle)))


def limits(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """For sets of these sizes the number of bits that may differ."""
    out = np.full(len(sizes), distance_limit(BITS, similarity), np.int64)
    for size, share in reversed(SMALL_SETS):
        out[sizes < size] = np.maximum(out[sizes < size], int(BITS * share))
    return out


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def short_edges(words: np.ndarray, limit: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within the limit in runs (numbers, ascending) of fewer than LONG_RUN rows."""
    table, a, b = pivot_table(words), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lag in range(1, LONG_RUN - 1):
        i = np.flatnonzero(run[lag:] == run[:-lag])
        if len(i):
            i = i[linked(words, table, i, i + lag, np.maximum(limit[i], limit[i + lag]))]
        a.append(i)
        b.append(i + lag)
    return np.concatenate(a), np.concatenate(b)


def forest(words: np.ndarray, limit: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs within the limit of one run: at most one edge for each row."""
    table, rest, a, b = pivot_table(words), np.arange(len(words)), [], []
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            x = front.pop()
            got = linked(words, table, np.array([x]), rest, np.maximum(limit[x], limit[rest]))
            found, rest = rest[got].tolist(), rest[~got]
            a += [x] * len(found)
            b += found
            front += found
    return a, b


def run_joins(words: np.ndarray, limit: np.ndarray, root: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Verified edges that join the components (root) of one bucket's nodes: no similar pair is left between two of them."""
    table, root, order, a, b = pivot_table(words), root.copy(), np.arange(len(words)), [], []
    for i in range(len(words) - 1):
        later = order[i + 1 :]
        later = later[root[later] != root[i]]
        if not len(later):
            continue
        for j in later[linked(words, table, np.array([i]), later, np.maximum(limit[i], limit[later]))].tolist():
            if root[j] != root[i] and min(len(sets[i]), len(sets[j])) >= similarity * max(len(sets[i]), len(sets[j])) and jaccard(sets[i], sets[j]) >= similarity:
                a.append(i)
                b.append(j)
                root[root == root[j]] = root[i]
    return a, b


def _whole(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From sorted batches: tables of whole runs of equal keys, those of one row left out, and where the runs start."""
    held: pa.Table | None = None

    def cut(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        keys = np.stack([table[c].to_numpy().astype(np.int64) for c in by], 1)
        return table, np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1))))

    def several(table: pa.Table, starts: np.ndarray) -> tuple[pa.Table, np.ndarray]:
        sizes = np.diff(np.append(starts, table.num_rows))
        table = table.filter(pa.array(np.repeat(sizes > 1, sizes))).combine_chunks()
        return table, np.concatenate(([0], np.cumsum(sizes[sizes > 1])[:-1])) if (sizes > 1).any() else np.zeros(0, np.int64)

    for batch in batches:
        if not batch.num_rows:
            continue
        fresh = pa.Table.from_batches([batch])
        table, starts = cut(pa.concat_tables([held, fresh]) if held is not None else fresh)
        last = int(starts[-1])
        if last:
            yield several(table.slice(0, last), starts[:-1])
        held = table.slice(last).combine_chunks()
    if held is not None:
        yield several(*cut(held))


def _words(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _taken(table: pa.Table, index: list[int] | np.ndarray, *names: str) -> list[pa.Array]:
    some = table.select(list(names)).take(pa.array(index, pa.int64()))
    return [pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in some.columns]


def dealt(rows: DataFrame, by: list[str], weight: Column, most: int) -> DataFrame:
    """rows with column pair: a bucket heavier than `most` is dealt into blocks, and each pair of blocks is one part of it."""
    heavy = rows.groupBy(*by).agg(F.sum(weight).alias("heavy")).where(F.col("heavy") > most)
    if heavy.isEmpty():
        return rows.withColumn("pair", F.lit(0).cast("long"))
    heavy = staged(heavy, "near-heavy")
    count, zero = F.ceil(F.col("heavy") / most).cast("long"), F.lit(0).cast("long")
    own, none = F.pmod(F.xxhash64("node"), count), F.col("heavy").isNull()
    met = rows.join(heavy, by, "left").withColumn("other", F.explode(F.when(none, F.array(zero)).otherwise(F.sequence(zero, count - 1))))
    pair = F.when(none, zero).otherwise(F.least(own, "other") * 1_000_003 + F.greatest(own, "other"))
    return met.withColumn("pair", pair).drop("heavy", "other")


def without_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8
) -> DataFrame:
    """The input rows, one of each group: groups are connected by pairs of at least this Jaccard similarity of shingle sets.

    Pairs that share a band and are within the fingerprints' limit are verified on the sets of the whole texts; both
    together find pairs at 0.8 itself with probability 0.98, closer ones more surely. Of a short bucket all pairs are
    verified; of a long one a spanning forest first, then, with the sets at hand in the bucket's task, every pair that
    the verified links leave in different groups. So a group of any size gives few edges, and no rejected edge hides a pair.

    Of a group the row with the smallest id stays, null ids last; of several rows of that id the one with the least
    hash of its columns; of rows equal in all columns one. Texts without words, or null, are equal to each other. An
    empty table gives an empty result. Columns pass unchanged, whatever their names.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    plain = [F.to_json(F.struct(c)) if "map<" in kind else c for c, (_, kind) in zip(columns, docs.dtypes)]
    rows = docs.select(F.struct(*columns).alias("row"), F.xxhash64(*plain).alias("part"))
    rows = rows.select("row", F.col("row")[id_col].alias("id"), "part", F.coalesce(F.col("row")[text_col], F.lit("")).alias("body"))
    kind = docs.schema[id_col].dataType.simpleString()

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingle_set(t.as_py(), shingle) for t in batch["body"]]
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch["id"],
                    "part": batch["part"],
                    "node": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    "fp": pa.array([fingerprint(s) for s in sets], pa.binary()),
                    "size": pa.array([len(s) for s in sets], pa.int32()),
                    "bands": pa.array([bands(s) for s in sets], pa.list_(pa.int64())),
                }
            )

    form = f"id {kind}, part bigint, node binary, fp binary, size int, bands array<bigint>"
    own = staged(rows.select("id", "part", "body").mapInArrow(sketches, form), "near-sketches")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "part")).alias("least")
    rest = [F.first(c).alias(c) for c in ("fp", "size", "bands")]
    nodes = staged(own.groupBy("node").agg(first, *rest), "near-nodes")
    placed = nodes.select("node", "fp", "size", F.posexplode("bands").alias("t", "key"))
    by = ["t", "key"]
    placed = dealt(placed, by, F.lit(1), BUCKET_ROWS)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole(batches, [*by, "pair"]):
            if not len(starts):
                continue
            words, limit = _words(table["fp"]), limits(table["size"].to_numpy(), similarity)
            sizes = np.diff(np.append(starts, table.num_rows))
            short = np.flatnonzero(np.repeat(sizes < LONG_RUN, sizes))
            i, j = short_edges(words[short], limit[short], np.repeat(np.arange(len(sizes)), sizes)[short]) if len(short) else (short, short)
            a, b, met = [short[i]], [short[j]], [np.zeros(0, np.int64)]
            for at, size in zip(starts[sizes >= LONG_RUN].tolist(), sizes[sizes >= LONG_RUN].tolist()):
                x, y = forest(words[at : at + size], limit[at : at + size])
                a.append(np.array(x, np.int64) + at)
                b.append(np.array(y, np.int64) + at)
                met.append(np.unique([x, y]).astype(np.int64) + at)
            a, b, met = map(np.concatenate, (a, b, met))
            (x,), (y,), nothing = _taken(table, a, "node"), _taken(table, b, "node"), pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_pydict({"a": x, "b": y, "t": nothing.cast(pa.int32()), "key": nothing})
            x, t, key = _taken(table, met, "node", *by)
            yield pa.RecordBatch.from_pydict({"a": x, "b": pa.nulls(len(met), pa.binary()), "t": t, "key": key})

    found = placed.repartition(*by, "pair").sortWithinPartitions(*by, "pair", "node").mapInArrow(candidates, "a binary, b binary, t int, key bigint")
    found = staged(found, "near-found")
    pairs = found.where("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = staged(pairs, "near-candidates")
    members = found.where("b IS NULL").select(F.col("a").alias("node"), *by).distinct()

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingle_set(t.as_py(), shingle).tobytes() for t in batch["body"]]
            yield pa.RecordBatch.from_pydict({"node": batch["node"], "shingles": pa.array(sets, pa.binary())})

    asked = found.select(F.explode(F.array("a", "b")).alias("node")).where("node IS NOT NULL").distinct().join(nodes, "node")
    asked = staged(asked.select("node", F.col("least.id").alias("rep"), F.col("least.part").alias("rep_part")), "near-asked")
    met = lambda i, p: F.col("id").eqNullSafe(F.col(i)) & (F.col("part") == F.col(p))
    sets = rows.select("id", "part", "body").join(asked, met("rep", "rep_part")).select("node", "body")
    sets = staged(sets.mapInArrow(shingles, "node binary, shingles binary").dropDuplicates(["node"]), "near-shingles")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            x, y = ([np.frombuffer(s.as_py(), np.uint64) for s in batch[c]] for c in "xy")
            keep = pa.array([jaccard(p, q) >= similarity for p, q in zip(x, y)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    edges = staged(both.mapInArrow(verified, "a binary, b binary"), "near-edges")

    roots = components(edges).withColumnRenamed("node", "of")
    rooted = members.join(roots, members["node"] == roots["of"], "left").select("node", *by, F.coalesce("root", "node").alias("root"))
    rooted = staged(rooted, "near-members")
    mixed = rooted.groupBy(*by).agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select(*by)
    rooted = rooted.join(staged(mixed, "near-mixed"), by, "left_semi")
    if not rooted.isEmpty():
        rooted = rooted.join(nodes.select("node", "fp", "size"), "node")
        rooted = dealt(rooted, by, F.col("size") * 8 + 100, BUCKET_BYTES).join(sets, "node")

        def joins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, starts in _whole(batches, [*by, "pair"]):
                for at, past in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
                    run = table.slice(at, past - at)
                    root = np.unique(np.array(run["root"].to_pylist(), object), return_inverse=True)[1]
                    own = [np.frombuffer(s, np.uint64) for s in run["shingles"].to_pylist()]
                    a, b = run_joins(_words(run["fp"]), limits(run["size"].to_numpy(), similarity), root, own, similarity)
                    (x,), (y,) = _taken(run, a, "node"), _taken(run, b, "node")
                    yield pa.RecordBatch.from_pydict({"a": x, "b": y})

        more = rooted.repartition(*by, "pair").sortWithinPartitions(*by, "pair", "node").mapInArrow(joins, "a binary, b binary")
        edges = edges.unionByName(staged(more, "near-more-edges"))
        roots = components(edges).withColumnRenamed("node", "of")
    named = nodes.join(roots, nodes["node"] == roots["of"], "left").select(F.coalesce("root", "node").alias("root"), "least")
    stay = named.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.id").alias("kept_id"), F.col("least.part").alias("kept_part"))
    stay = staged(stay, "near-kept")
    kept = rows.join(stay, met("kept_id", "kept_part"))
    again = own.groupBy("id", "part").count().where("count > 1").select(F.col("id").alias("again_id"), F.col("part").alias("again_part"))
    again = staged(again.join(stay, F.col("again_id").eqNullSafe(F.col("kept_id")) & (F.col("again_part") == F.col("kept_part"))).select("again_id", "again_part"), "near-again")
    if not again.isEmpty():
        twice = met("again_id", "again_part")
        kept = kept.join(again, twice, "left_anti").select("row").unionByName(kept.join(again, twice).dropDuplicates(["id", "part"]).select("row"))
    return kept.select("row.*")
