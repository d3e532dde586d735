"""Column functions on text: tokens, keys, normal forms, ratios.

All are built-in, so they stay inside code generation, but for Unicode composition and case folding, which Spark
lacks: those go through Arrow batches, and only for texts with other characters than ASCII.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A run of letters, digits and underscores, or one other character that isn't blank. Explicit classes: the JVM's
#: own word class is ASCII only.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
#: Letters with their plain form, for keys without marks (Vietnamese and western European).
MARKED = {
    "a": "áàảãạăắằẳẵặâấầẩẫậäåãą", "c": "çćč", "d": "đď", "e": "éèẻẽẹêếềểễệëęě", "i": "íìỉĩịîï",
    "n": "ñńň", "o": "óòỏõọôốồổỗộơớờởỡợöõø", "u": "úùủũụưứừửữựüûů", "y": "ýỳỷỹỵÿ", "s": "šś", "z": "žźż",
}


def _plain(c: str) -> str:
    """The case-folded character without its marks."""
    return "".join(x for x in unicodedata.normalize("NFD", c.casefold().replace("đ", "d")) if unicodedata.category(x) != "Mn")


#: Letters of the Latin blocks whose plain form is one ASCII character.
_LATIN = {c: _plain(c) for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF10, 0xFF5B)))}
SINGLE = {c: p for c, p in _LATIN.items() if len(p) == 1 and p.isascii()}


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def bound(column: Column, f: Callable[[Column], Column]) -> Column:
    """f of the column, which is evaluated once however often f names it."""
    return F.get(F.transform(F.array(column), f), F.lit(0))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def _arrow(f: Callable[[str], str]):
    """f of each text as a function of Arrow arrays; a worker turns 100 texts at a time into Python strings."""

    def run(batch: pa.Array) -> pa.Array:
        parts = ([None if t is None else f(t) for t in batch.slice(at, 100).to_pylist()] for at in range(0, len(batch), 100))
        return pa.concat_arrays([pa.array([], pa.string()), *(pa.array(p, pa.string()) for p in parts)])

    return F.arrow_udf(run, StringType())


def by_arrow(text: Column, ascii_: Column, run) -> Column:
    """ascii_ for texts of ASCII only; the Arrow function for the others. One function object for all uses of a
    form, so that a plan evaluates it once for a text."""
    return F.when(is_ascii(text), ascii_).otherwise(run(F.when(~is_ascii(text), text)))


_COMPOSED = _arrow(lambda t: unicodedata.normalize("NFC", t))


def composed(text: Column) -> Column:
    """Unicode normal form C."""
    return by_arrow(filled(text), filled(text), _COMPOSED)


_FOLDED = _arrow(lambda t: unicodedata.normalize("NFC", t).casefold())


def folded(text: Column) -> Column:
    """Normal form C, case-folded: ß as ss, for example."""
    return by_arrow(filled(text), F.lower(filled(text)), _FOLDED)


def raw_tokens(text: Column) -> Column:
    """Number of tokens, unweighted."""
    return F.regexp_count(filled(text), F.lit(TOKEN))


def approx_tokens(text: Column) -> Column:
    """Conservative estimate of model tokens: 1.18 for each token, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(raw_tokens(text) * F.lit("1.18").cast("decimal(3,2)"))).cast("long")


def space_tokens(text: Column) -> Column:
    """Number of runs apart by white space."""
    return F.regexp_count(filled(text), F.lit(r"\S+"))


def token_bucket(n: Column) -> Column:
    """Fixed length buckets of curated passages."""
    return (
        F.when(n < 64, "<64").when(n < 128, "64-127").when(n < 256, "128-255").when(n <= 512, "256-512").otherwise(">512")
    )


#: What counts as white space: that of ASCII with its separators, and the Unicode blanks.
BLANK = r"[\s\x1C-\x1F\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def collapsed(text: Column) -> Column:
    """White space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(filled(text), rf"{BLANK}+", " "))


def clean_line(text: Column) -> Column:
    """Composed text with collapsed white space, without outer blanks, colons and dashes."""
    return F.btrim(F.regexp_replace(composed(text), rf"{BLANK}+", " "), F.lit(" :-–—\t"))


def ascii_key(text: Column) -> Column:
    """Case-folded key without marks: anything but a-z and 0-9 is one space. d with stroke counts as d.

    Marks apart from their letter are dropped, so composed and decomposed texts have the same key.
    """
    t = F.translate(filled(text), "".join(SINGLE), "".join(SINGLE.values()))
    t = F.regexp_replace(F.regexp_replace(t, "[ßẞ]", "ss"), "\ufb01", "fi")
    t = F.when(is_ascii(filled(text)), filled(text)).otherwise(F.regexp_replace(t, r"\p{Mn}+", ""))
    return F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "))


def _letter_key(text: str) -> str:
    kept = (c for c in unicodedata.normalize("NFD", text.casefold().replace("đ", "d")) if not unicodedata.combining(c))
    return " ".join("".join(c if c.isalnum() else " " for c in kept).split())


_LETTERS = _arrow(_letter_key)


def letter_key(text: Column) -> Column:
    """Like ascii_key, but letters and digits of all scripts stay."""
    t = filled(text)
    return by_arrow(t, F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " ")), _LETTERS)


def normalized_line(text: Column) -> Column:
    """Composed text without soft hyphens, white space collapsed."""
    return collapsed(F.replace(composed(text), F.lit("\u00ad"), F.lit("")))


def normalized_paragraph(text: Column) -> Column:
    """Normalised lines as one; a hyphen at a line's end goes where the next line goes on in lower case."""
    lines = F.split(F.replace(composed(text), F.lit("\u00ad"), F.lit("")), r"\r\n|[\n\r\x0B\f\x1C-\x1E\u0085\u2028\u2029]")
    lines = F.filter(F.transform(lines, collapsed), lambda x: x != "")
    return collapsed(F.replace(F.regexp_replace(F.array_join(lines, "\n"), r"-\n(?=\p{Ll})", ""), F.lit("\n"), F.lit(" ")))


def fingerprint(text: Column) -> Column:
    """SHA-256 of the composed, case-folded text with collapsed white space."""
    return F.sha2(collapsed(folded(text)), 256)


def sanitized(text: Column) -> Column:
    """Control characters but newline, carriage return and tab become spaces."""
    return F.regexp_replace(filled(text), r"[\p{Cc}&&[^\n\r\t]]", " ")


def integrity(text: Column) -> dict[str, Column]:
    """Counts and ratios of characters that a broken text layer leaves."""
    t = filled(text)
    size = F.greatest(F.char_length(t), F.lit(1))
    control = F.regexp_count(t, F.lit(r"[\p{Cc}&&[^\n\r\t]]"))
    symbol = F.regexp_count(t, F.lit(r"\p{S}"))
    private = F.regexp_count(t, F.lit(r"[\p{Co}\uFFFD]"))
    return {
        "control_chars": control.cast("long"),
        "symbol_chars": symbol.cast("long"),
        "private_chars": private.cast("long"),
        "control_ratio": F.round(control / size, 6),
        "symbol_ratio": F.round(symbol / size, 6),
    }


def count_of(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a plain term."""
    gone = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(term), F.lit("")))  # bytes are known, characters counted
    return (gone / len(term.encode())).cast("int")


def has_word(text: Column, term: str, edge: str = r"[^\p{L}\p{N}]") -> Column:
    """Whether the term stands in the text as a whole word, or beside underscores."""
    escaped = "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in term)
    return text.rlike(rf"(?:^|{edge}){escaped}(?:$|{edge})")


def first_year(text: Column) -> Column:
    """The first year from 1900 to 2099 that stands alone."""
    found = F.regexp_extract(filled(text), r"(?:^|[^0-9\p{L}_])((?:19|20)[0-9]{2})(?:$|[^0-9\p{L}_])", 1)
    return F.when(found != "", found).try_cast("int")


def degree(text: Column) -> Column:
    """Degree by the words of a document's kind, the higher first."""
    t = F.lower(filled(text))
    return (
        F.when(t.rlike("tiến sĩ|doctor|phd|dissertation"), "doctoral")
        .when(t.rlike("thạc sĩ|master"), "master")
        .when(t.rlike("khóa luận|đồ án|bachelor|undergraduate|capstone"), "bachelor")
        .otherwise("unknown")
    )


def title_key(title: Column) -> Column:
    """Title for deduplication: lower case, punctuation to spaces, collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(filled(title)), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


#: Kinds of work that stand before or after a title proper.
WORK_KINDS = (
    "khóa luận tốt nghiệp|luận văn thạc sĩ|đồ án tốt nghiệp|báo cáo tốt nghiệp|báo cáo thực tập|luận án tiến sĩ"
    "|công trình nghiên cứu|báo cáo chuyên đề|đề tài nghiên cứu khoa học|đề tài|tiểu luận|bachelor thesis|master thesis"
)


def core_title(title: Column) -> Column:
    """Title key without the author after a slash and without the kind of work before or after it."""
    t = F.regexp_replace(F.trim(filled(title)), r"\s*/\s*.*$", "")
    t = F.regexp_replace(t, rf"(?iu)\s*[:\-]\s*(?:{WORK_KINDS}).*$", "")
    t = F.regexp_replace(t, rf"(?iu)^(?:{WORK_KINDS})\s*[:\-./]?\s*", "")
    return title_key(t)


#: Vietnamese spellings with the tone on either vowel of a pair are the same syllable.
def tone_variants(text: Column) -> Column:
    """Tone marks of oa, oe and uy moved to one place."""
    pairs = ("óa oá", "òa oà", "ỏa oả", "õa oã", "ọa oạ", "óe oé", "òe oè", "ỏe oẻ", "õe oẽ", "ọe oẹ", "úy uý", "ùy uỳ", "ủy uỷ", "ũy uỹ", "ụy uỵ")
    out = filled(text)
    for old, new in map(str.split, pairs):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def repaired(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again as UTF-8 where that leaves no replacement character."""
    again = F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")
    odd = text.rlike("[ÃÂÄÆ][\u0080-¿]|á[º»]") & ~text.rlike("[^\u0000-ÿ]")
    return F.when(odd & ~F.contains(again, F.lit("�")), again).otherwise(text)


def chat_text(text: Column) -> Column:
    """A model's answer without code fences, a preface line and wrapping quotes."""
    t = F.trim(filled(text))
    t = F.regexp_replace(t, r"(?s)^```[\p{L}]*\s*\n?(.*?)\n?```$", "$1")
    t = F.regexp_replace(t, r"(?iu)^(?:here is|here's|sure|dưới đây là|đây là)[^\n:]{0,80}:\s*", "")
    return F.trim(F.regexp_replace(F.trim(t), r'(?s)^["“](.*)["”]$', "$1"))
