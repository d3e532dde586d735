import numpy as np
import pytest
from pyspark.sql import functions as F

from loamwork.llm.chroma import Settings, aligned, bit_error, chroma, fingerprints, melody, packed, pcm16

S = Settings()


def recordings():
    """Melodies, noisy copies, excerpts, exact copies, silence and media that are too short."""
    rng = np.random.default_rng(0)
    base = [melody(rng.normal(0, 0.15, 64)) for _ in range(20)]
    out = [(i, x) for i, x in enumerate(base)]
    out += [(100 + i, x + rng.normal(0, 0.02, len(x)).astype(np.float32)) for i, x in enumerate(base)]
    out += [(200 + i, x[S.hop * 20 :]) for i, x in enumerate(base)]
    out += [(300 + i, base[0]) for i in range(30)]
    return [(i, (np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()) for i, x in out] + [(400, b""), (401, None), (402, b"\1"), (403, bytes(9000)), (None, base[1].astype("<i2").tobytes())]


def test_alignment_against_brute_force(spark):
    rows = recordings()
    df = spark.createDataFrame(rows, "doc_id long, media binary").withColumn("fp", F.lit(1)).withColumn("q", F.lit(2))
    got = aligned(fingerprints(df, "doc_id", "media"), F.col("id") < 10).collect()
    found = {(r.query_id, r.match_id) for r in got}
    prints = {i: packed(chroma(pcm16(m), S), S).astype("<u4").tobytes() for i, m in rows if m and i is not None}
    first = {}
    for i in sorted(prints):
        first.setdefault(prints[i], i)
    want = set()
    for q in range(10):
        for fp, m in first.items():
            offsets = range(-len(fp) // 4, len(prints[q]) // 4)
            if any(e <= 0.1 and n >= 32 for e, n in (bit_error(prints[q], fp, o) for o in offsets)):
                want.add((q, m))
    assert found <= want and len(found) >= 0.9 * len(want) and len(want) > 20
    assert {(q, q) for q in range(10)} <= found
    assert next(r.match_size for r in got if (r.query_id, r.match_id) == (0, 0)) == 31
    excerpts = [r.offset for r in got if r.match_id == 200 + r.query_id]
    assert excerpts and all(abs(o - 20) <= 1 for o in excerpts)


def test_empty_table_and_unusable_media(spark):
    empty = spark.createDataFrame([], "doc_id long, media binary")
    assert aligned(fingerprints(empty, "doc_id", "media"), F.col("id") % 50 == 0).collect() == []
    odd = spark.createDataFrame([(0, None), (0, b""), (50, b"\1\2\3")], "doc_id long, media binary")
    assert {r.fp for r in fingerprints(odd, "doc_id", "media").collect()} == {b""}


def test_pitch_classes_of_pure_tones():
    for pitch in range(12):
        tone = np.sin(2 * np.pi * 440 * 2 ** (pitch / 12) * np.arange(4000) / S.rate)
        assert (chroma(tone, S)[3:-3].argmax(1) == pitch).all()


@pytest.mark.parametrize("vector", [[], [None, 0.5], [float("nan")] * 64])
def test_melodies_of_odd_vectors(vector):
    assert np.isfinite(melody(vector)).all()
