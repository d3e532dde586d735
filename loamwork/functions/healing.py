"""Repairs of text that lost its blanks: a dictionary of glued words, fixed rewrites, a syllable splitter."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VOWELS = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ"
#: Fixed values, in their order: a word before a number, an index or a variable, a marked vowel before a capital, a stray bullet.
REWRITES = [
    (re.compile(rf"\b([a-zA-Zà-ỹÀ-Ỹ]*[{VOWELS}đ][a-zA-Zà-ỹÀ-Ỹ]*)(\d+(?:\.\d+)*)\b"), r"\1 \2"),
    (re.compile(rf"\b([a-zA-Zà-ỹÀ-Ỹ]*[{VOWELS}đ])([a-z]{{1,2}}th)\b"), r"\1 \2"),
    (re.compile(r"\b(số|gồm|với|trong|cho|tổng|tập|ma trận|vectơ|vector|khoảng)([A-Z])\b"), r"\1 \2"),
    (re.compile(rf"([{VOWELS}])([A-Z])"), r"\1 \2"),
    (re.compile(r"([a-zà-ỹ,])\s*[•▪]\s*([a-zà-ỹ])"), r"\1 \2"),
]
#: Letters that a wrong code page leaves for the horned u.
LETTERS = str.maketrans({"Ƣ": "Ư", "ƣ": "ư"})
#: Some two-syllable terms; glued() derives their glued spellings, and callers add their own.
TERMS = ("dữ liệu", "hệ thống", "phần mềm", "máy tính", "mạng lưới", "ứng dụng", "thông tin", "công nghệ", "người dùng", "thuật toán")


def glued(terms=TERMS) -> dict[str, str]:
    """Glued spelling to the term."""
    return {t.replace(" ", ""): t for t in terms}


def heal(text: str, words: Mapping[str, str] | None = None) -> str:
    """Letters, then glued words (longest first, with the case of the original), then the rewrites."""
    words = glued() if words is None else words
    out = text.translate(LETTERS)
    if words:
        def put(m: re.Match) -> str:
            found, term = m[0], words[m[0].lower()]
            return term.upper() if found.isupper() else " ".join(map(str.capitalize, term.split())) if found[0].isupper() else term.lower()

        out = re.sub(rf"\b(?:{'|'.join(map(re.escape, sorted(words, key=len, reverse=True)))})\b", put, out, flags=re.I)
    for pattern, new in REWRITES:
        out = pattern.sub(new, out)
    return out


TONED = set("áàảãạắằẳẵặấầẩẫậéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ")


def split_syllables(word: str, counts: Mapping[str, float], longest: int = 9, most: int = 4, cost: float = 1.0) -> str:
    """The likeliest division of a glued word into known syllables of two letters or more, or the word itself.

    Only words of at least five letters with a toned vowel that aren't syllables themselves are tried; each piece
    costs `cost` beside its log frequency. Words in capitals stay so, a first capital stays, other letters become
    small. Without counts nothing changes.
    """
    low = unicodedata.normalize("NFC", word.lower())
    if len(low) < 5 or low in counts or not TONED & set(low):
        return word
    total = sum(counts.values()) or 1.0
    best: list[tuple[float, list[str]] | None] = [(0.0, [])] + [None] * len(low)
    for end in range(2, len(low) + 1):
        for start in range(max(0, end - longest), end - 1):
            piece = low[start:end]
            if best[start] is None or not counts.get(piece) or len(best[start][1]) >= most:
                continue
            value = best[start][0] + math.log(counts[piece] / total) - cost
            if best[end] is None or value > best[end][0]:
                best[end] = (value, [*best[start][1], piece])
    if best[-1] is None or len(best[-1][1]) < 2:
        return word
    out = " ".join(best[-1][1])
    return out.upper() if word.isupper() else out[0].upper() + out[1:] if word[0].isupper() else out


def unglue(text: str, counts: Mapping[str, float]) -> str:
    """Each word of Latin letters divided by split_syllables."""
    return WORD.sub(lambda m: split_syllables(m[0], counts), text) if counts else text


WORD = re.compile(r"[a-zA-Zà-ỹÀ-ỸđĐ]+")


def healed(column: Column, words: Mapping[str, str] | None = None) -> Column:
    """heal on a text column, in Arrow batches. Null stays null. words goes to every worker: a dictionary of terms."""
    words = glued() if words is None else dict(words)
    return F.pandas_udf(lambda batch: batch.map(lambda t: heal(t, words), na_action="ignore"), StringType())(column)


def unglued(column: Column, counts: Mapping[str, float]) -> Column:
    """unglue on a text column, in Arrow batches. Null stays null. counts goes to every worker: a language's syllables."""
    counts = dict(counts)
    return F.pandas_udf(lambda batch: batch.map(lambda t: unglue(t, counts), na_action="ignore"), StringType())(column)
