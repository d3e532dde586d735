"""Byte-level BPE by a rank file: overlapping chunks are pre-tokenised in parallel, stitched, then encoded.

A text of up to one chunk is pre-tokenised and encoded in one step. A longer text is cut into chunks that
overlap. Every match of the pattern depends only on the text from its start on, so once two neighbouring
chunks share a boundary inside their overlap, they agree from there; each chunk contributes the pieces between
its first shared boundary and the next chunk's. If some overlap has no shared boundary (a run without any
boundary that is longer than the overlap), that text is encoded in one step instead.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, staged, text_of

#: Pieces that a Python worker remembers, the first ones it meets; others and longer ones are merged anew.
CACHED, CACHED_CHARS = 150_000, 48


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a base64 token and its rank on each line. Its size bounds what is sent to the executors."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merger(dict):
    """Pieces (str) to their ids as little-endian unsigned 32-bit integers; the library merges a piece's bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        #: The pattern is not used: pieces come from the stitched pre-tokens.
        self.ids = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.ids.encode_single_piece(piece.encode()), dtype="<u4").tobytes()
        if len(piece) <= CACHED_CHARS and len(self) < CACHED:
            self[piece] = ids
        return ids


_mergers: dict[int, Merger] = {}


def _merger(shared) -> Merger:
    """One merger for each vocabulary and Python worker."""
    if shared.id not in _mergers:
        _mergers.clear()
        _mergers[shared.id] = Merger(shared.value)
    return _mergers[shared.id]


class _Shared:
    """A broadcast vocabulary with a number that workers can remember it by."""

    def __init__(self, spark, value) -> None:
        self.sent = spark.sparkContext.broadcast(value)
        self.id = self.sent._jbroadcast.id()

    def __getstate__(self):
        return {"sent": self.sent, "id": self.id}

    @property
    def value(self):
        return self.sent.value


def _replaced(batch: pa.RecordBatch, drop: list[str], **new: pa.Array) -> pa.RecordBatch:
    kept = {n: c for n, c in zip(batch.schema.names, batch.columns) if n not in drop}
    return pa.RecordBatch.from_pydict(kept | new)


def _encode_whole(rows: DataFrame, vocabulary: _Shared, pattern: str) -> DataFrame:
    """rows with column body turned into token_ids."""
    names = [c for c in rows.columns if c != "body"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, pieces = _merger(vocabulary), regex.compile(pattern)
        for batch in sliced(batches):
            done = [b"".join(map(ids.__getitem__, pieces.findall(t.as_py()))) for t in batch["body"]]
            yield _replaced(batch, ["body"], token_ids=pa.array(done, pa.binary()))

    return rows.mapInArrow(encode, f"{_ddl(rows, names)}, token_ids binary")


def _ddl(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _pre_tokens(chunks: DataFrame, pattern: str) -> DataFrame:
    """Chunks with the ends of their pieces, as offsets in the chunk; a match cut off by the chunk's end is left out."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = regex.compile(pattern)
        for batch in sliced(batches):
            ends = []
            for text, last in zip(batch["chunk"], batch["last"]):
                own = np.fromiter((m.end() for m in pieces.finditer(text.as_py())), np.int32)
                ends.append(own if last.as_py() else own[:-1])
            yield _replaced(batch, [], ends=pa.array(ends, pa.list_(pa.int32())))

    return chunks.mapInArrow(split, f"{_ddl(chunks, chunks.columns)}, ends array<int>")


def _encode_stitched(rows: DataFrame, vocabulary: _Shared) -> DataFrame:
    """Encode the pieces of each chunk from offset `from` up to `to`."""
    names = ["doc_id", "part", "k"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _merger(vocabulary)
        for batch in sliced(batches):
            done = []
            for text, ends, start, stop in zip(*(batch[c] for c in ("chunk", "ends", "from", "to"))):
                text, ends, start, stop = text.as_py(), ends.values.to_numpy(), start.as_py(), stop.as_py()
                stop = len(text) if stop is None else stop
                cuts = [start, *ends[(ends > start) & (ends <= stop)].tolist()]
                done.append(b"".join([ids[text[a:b]] for a, b in zip(cuts, cuts[1:])]))
            yield _replaced(batch, ["chunk", "ends", "from", "to"], token_ids=pa.array(done, pa.binary()))

    return rows.mapInArrow(encode, f"{_ddl(rows, names)}, token_ids binary")


def encode_documents(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = 32_768,
    overlap: int = 1_024,
) -> DataFrame:
    """One row per input row: doc_id, token_ids (binary: little-endian unsigned 32-bit ids), n_tokens.

    Each match of the pattern is encoded on its own by the ranks; there are no special tokens. Null texts
    count as empty and have no ids. Null ids and repeated rows are ordinary: every row gets its own result.
    An empty table gives an empty result. Other columns are ignored, whatever their names.

    The result is written before it is returned: what decodes it runs after the encoding workers, not beside them, and
    a lost executor doesn't encode again.
    """
    if not 0 < overlap <= chunk_chars:
        raise ValueError("overlap must be positive and at most chunk_chars")
    vocabulary = _Shared(docs.sparkSession, read_ranks(ranks_path))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("body"))
    short = _encode_whole(rows.where(F.char_length("body") <= chunk_chars), vocabulary, pattern)
    long = rows.where(F.char_length("body") > chunk_chars).withColumn("part", F.sha2("body", 256))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (text, part) in enumerate(zip(batch["body"], batch["part"])):
                text, steps = text.as_py(), range(0, len(text.as_py()), chunk_chars)
                for k, at in enumerate(steps):
                    last = at + chunk_chars + overlap >= len(text)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": batch["doc_id"].slice(i, 1),
                            "part": pa.array([part.as_py()]),
                            "k": pa.array([k], pa.int64()),
                            "last": pa.array([last]),
                            "chunk": pa.array([text[at : at + chunk_chars + overlap]]),
                        }
                    )
                    if last:
                        break

    chunks = long.mapInArrow(cut, f"doc_id {kind}, part string, k bigint, last boolean, chunk string")
    chunks = staged(_pre_tokens(chunks.dropDuplicates(["doc_id", "part", "k"]), pattern), "pre-tokens")
    #: Boundaries in the overlap with the chunk before (from this chunk's start) and with the next (from its start).
    heads = F.concat(F.array(F.lit(0)), F.filter("ends", lambda e: e <= overlap))
    tails = F.transform(F.filter("ends", lambda e: e >= chunk_chars), lambda e: e - chunk_chars)
    along = Window.partitionBy("doc_id", "part").orderBy("k")
    first = F.when(F.col("k") == 0, 0).otherwise(F.array_min(F.array_intersect("heads", F.lag("tails").over(along))))
    cuts = (
        chunks.select("doc_id", "part", "k", heads.alias("heads"), tails.alias("tails"))
        .withColumn("from", first)
        .withColumn("to", F.lead("from").over(along) + chunk_chars)
        .drop("heads", "tails")
    )
    cuts = staged(cuts, "chunk-cuts")
    apart = cuts.where("from IS NULL").select("doc_id", "part").distinct()
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["part"] == b["part"])
    stitched = chunks.join(cuts, same(chunks, cuts) & (chunks["k"] == cuts["k"])).select(
        chunks["doc_id"], chunks["part"], chunks["k"], "chunk", "ends", "from", "to"
    )
    stitched = stitched.join(apart, same(stitched, apart), "left_anti")
    joined = (
        _encode_stitched(stitched, vocabulary)
        .groupBy("doc_id", "part")
        .agg(F.expr("listagg(token_ids) WITHIN GROUP (ORDER BY k)").alias("token_ids"))
    )
    rest = long.join(apart, same(long, apart), "left_semi").drop("part")
    fit = long.select("doc_id", "part").join(joined, same(long, joined)).select(long["doc_id"], "token_ids")
    encoded = short.unionByName(fit).unionByName(_encode_whole(rest, vocabulary, pattern))
    return staged(encoded, "encoded", "zstd").withColumn("n_tokens", F.floor(F.octet_length("token_ids") / 4).cast("long"))


def decode_documents(encoded: DataFrame, ranks_path: str, ids_col: str = "token_ids") -> DataFrame:
    """The input rows with column `decoded` (binary): the raw bytes of the ids, concatenated.

    Null ids decode to null. A column named decoded in the input is replaced.
    """
    vocabulary = _Shared(encoded.sparkSession, read_ranks(ranks_path))
    rows = encoded.drop("decoded")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = [b""] * (max(vocabulary.value.values(), default=-1) + 1)
        for piece, rank in vocabulary.value.items():
            token[rank] = piece
        for batch in sliced(batches):
            done = [
                None if not ids.is_valid else b"".join([token[i] for i in np.frombuffer(ids.as_py(), "<u4").tolist()])
                for ids in batch[ids_col]
            ]
            yield _replaced(batch, [], decoded=pa.array(done, pa.binary()))

    return rows.mapInArrow(decode, f"{_ddl(rows, rows.columns)}, decoded binary")
