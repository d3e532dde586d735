"""Sharding by best-fit-decreasing bin packing of indivisible groups of equal texts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_of

#: Sizes below 2**EXACT_BITS are packed as they are; larger ones are rounded up to EXACT_BITS significant bits.
#: So a packing deals with at most 2**EXACT_BITS + 2**(EXACT_BITS - 1) * (63 - EXACT_BITS) distinct sizes,
#: however many rows there are, and a bin is overestimated by less than 1 part in 2**(EXACT_BITS - 1).
EXACT_BITS = 11
#: Parts of one numbering that are numbered on their own; a part's start comes from the counts before it.
PARTS = 256


class CapacityTree:
    """Balanced search tree (a treap with fixed pseudo-random priorities) of (remaining capacity, bin)."""

    def __init__(self) -> None:
        self.root = None
        self.seed = 1

    def _priority(self) -> int:
        self.seed = (self.seed * 6364136223846793005 + 1442695040888963407) % 2**64
        return self.seed >> 16

    def _split(self, node, key):
        """Nodes below key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            left, right = self._split(node[3], key)
            return (node[0], node[1], node[2], left), right
        left, right = self._split(node[2], key)
        return left, (node[0], node[1], right, node[3])

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return a[0], a[1], a[2], self._merge(a[3], b)
        return b[0], b[1], self._merge(a, b[2]), b[3]

    def add(self, remaining: int, number: int) -> None:
        left, right = self._split(self.root, (remaining, number))
        node = ((remaining, number), self._priority(), None, None)
        self.root = self._merge(self._merge(left, node), right)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity of at least size."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        node = right
        while node[2] is not None:
            node = node[2]
        _, rest = self._split(right, (node[0][0], node[0][1] + 1))
        self.root = self._merge(left, rest)
        return node[0]


def best_fit_decreasing(
    runs: Iterable[tuple[int, int]], capacity: int, most_bins: int | None = None
) -> list[tuple[int, int, int]] | None:
    """Pack runs (size, count): [(size, bin, count)] in order of size; None if most_bins don't suffice.

    Equal sizes are interchangeable: the bin that is tightest for one item of a run stays the tightest for
    the next until it is too full, so a run fills it in one step. The result equals item-by-item packing.
    """
    tree, bins, out = CapacityTree(), 0, []
    for size, count in sorted(runs, reverse=True):
        while count:
            found = tree.take_tightest(size)
            if found is None:
                if size > capacity or bins == most_bins:
                    return None
                found, bins = (capacity, bins), bins + 1
            put = min(count, found[0] // size)
            out.append((size, found[1], put))
            count -= put
            tree.add(found[0] - put * size, found[1])
    return out


def pack_evenly(runs: list[tuple[int, int]], n_bins: int) -> list[tuple[int, int, int]]:
    """Best-fit-decreasing into n_bins bins of the least common capacity that a binary search finds."""
    total, largest = sum(s * c for s, c in runs), max((s for s, _ in runs), default=1)
    low = max(-(-total // n_bins), largest)
    high = max(2 * low, 1)
    best = best_fit_decreasing(runs, high, n_bins)
    while best is None:
        high *= 2
        best = best_fit_decreasing(runs, high, n_bins)
    while low < high:
        middle = (low + high) // 2
        got = best_fit_decreasing(runs, middle, n_bins)
        if got is None:
            low = middle + 1
        else:
            best, high = got, middle
    return best


def rounded_up(size: Column) -> Column:
    """size, with those of more than EXACT_BITS bits rounded up to EXACT_BITS significant bits."""
    bits = F.length(F.bin(size))
    step = F.pow(F.lit(2.0), F.greatest(bits - EXACT_BITS, F.lit(0))).cast("long")
    return (F.ceil(size / step) * step).cast("long")


def numbered(df: DataFrame, within: list[str], spread: Column, order: list[Column], name: str) -> DataFrame:
    """Gapless numbers from 0 within groups of any size: each group is numbered in PARTS parts at once."""
    df = df.withColumn("__part", F.pmod(spread, F.lit(PARTS)))
    keys = [*within, "__part"]
    before = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(*keys).count().withColumn("__start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    )
    own = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("__own", own).join(starts, keys).withColumn(
        name, (F.col("__own") + F.col("__start")).cast("long")
    ).drop("__part", "__own", "__start")


def shard_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 24, row_overhead: int = 8
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `bytes`: groups of equal texts, in decreasing size, go to the shard with the tightest remaining
    capacity; the capacity is the least for which n_shards suffice. A group stays together unless it is
    itself larger than an even share of all bytes; such a group (there are fewer than n_shards) is dealt by
    id into pieces of about 1/16 of a share, which then count as groups. slot numbers a shard's rows from 0.

    Null texts count as empty, null ids are ordinary values, repeated rows each get a slot. A single row
    larger than a share makes its shard larger. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    text = text_of(text_col)
    rows = staged(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + row_overhead).cast("long").alias("size"),
            F.crc32(text).cast("long").alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("group"),
        ),
        "shard-rows",
    )
    by_group = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    share = max(1, total // n_shards)
    large = by_group.where((F.col("bytes") > share) & (F.col("rows") > 1)).collect()  # fewer than n_shards
    pieces = F.lit(0).cast("long")
    for g in large:
        n = min(g["rows"], -(-16 * g["bytes"] // share))
        dealt = F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("long")
        pieces = F.when(F.col("group") == F.lit(bytes(g["group"])), dealt).otherwise(pieces)
    rows = rows.withColumn("piece", pieces)
    items = rows.groupBy("group", "piece").agg(rounded_up(F.sum("size")).alias("class"))
    runs = [(r["class"], r["count"]) for r in items.groupBy("class").count().collect()]  # bounded, see EXACT_BITS
    packed, at, spans = pack_evenly(runs, n_shards), {}, {}
    for size, number, put in packed:
        first = at.get(size, 0)
        at[size] = first + put
        spans.setdefault(size, []).append((first, first + put, number))
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        list(spans.items()), "class long, spans array<struct<first: long, past: long, shard: int>>"
    )
    ranked = numbered(items, ["class"], F.xxhash64("group", "piece"), [F.col("group"), F.col("piece")], "rank")
    home = ranked.join(plan, "class").select(
        "group",
        "piece",
        F.filter("spans", lambda s: (F.col("rank") >= s["first"]) & (F.col("rank") < s["past"]))[0]["shard"].alias("shard"),
    )
    placed = staged(rows.join(home, ["group", "piece"]).drop("group", "piece"), "shard-placed")
    return numbered(
        placed, ["shard"], F.xxhash64("doc_id"), [F.col("doc_id"), F.col("text_crc32")], "slot"
    ).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
