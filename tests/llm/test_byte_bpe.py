import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from loamwork.llm.byte_bpe import Merger, decode_documents, encode_documents, read_ranks

from .cases import SCHEMA, awkward, table

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def expected(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), np.array(ids, "<u4").tobytes()


def results(df):
    return sorted((r["doc_id"] is None, r["doc_id"], r["n_tokens"], bytes(r["token_ids"]), bytes(r["decoded"])) for r in df.collect())


def check(spark, library, rows, **options):
    got = results(decode_documents(encode_documents(table(spark, rows), PATH, public_tokenizers.PATTERN, **options), PATH))
    want = sorted((r[0] is None, r[0], *expected(library, r[1]), (r[1] or "").encode()) for r in rows)
    assert got == want


@pytest.mark.parametrize("chunk,overlap", [(40, 10), (64, 64), (100_000, 1000)])
def test_equals_the_library_with_any_chunks(spark, library, chunk, overlap):
    rng = random.Random(5)
    odd = "\x1c\x1d\x1e\x1f\x85  　​﻿᠎ \t\n\r'"
    texts = ["".join(rng.choice(odd + "ab1é日'sll") for _ in range(rng.randint(1, 400))) for _ in range(60)]
    texts += ["it's we'll they've " * 30, "x" * 500, " " * 300 + "a" * 300, "12345 " * 100, "a\n" * 200]
    check(spark, library, awkward() + [(1000 + i, t, None, None, None) for i, t in enumerate(texts)], chunk_chars=chunk, overlap=overlap)


def test_empty_table(spark, library):
    check(spark, library, [])


def test_merging_equals_the_library_on_long_pieces(library):
    rng, own = random.Random(2), Merger(read_ranks(PATH))
    for alphabet in ("ab", "theraning", "éß漢"):
        piece = "".join(rng.choice(alphabet) for _ in range(3000))
        assert own[piece] == expected(library, piece)[1]
