"""Personal data by weak supervision. Built-in functions only.

Four base detectors (email, ip, card, phone) stand on their own. Beside them, broader candidates get votes from
labelers: their shape (regex), words of a gazetteer before them, and their context. Expectation-maximisation
estimates how reliable each labeler is and how likely each pattern of votes means personal data; with these soft
labels a span classifier (naive Bayes over a span's features) is trained, and its spans are added to the base ones.
The corpus enters the model as counts of vote and feature patterns, whose number has a fixed bound.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Base patterns, possessive where that changes nothing, so that long runs need no recursion and no rescanning:
#: a match can only start where a run starts or where the match before has ended (\G).
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
DIGITS = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Order of kinds that start at the same place.
KINDS = ("email", "ip", "card", "phone", "secret")

#: Words that speak for a kind when they stand before a candidate, and those that speak against any.
GAZETTEER = {
    "email": "mail e-mail contact write reach schreiben contacto courriel correo",
    "ip": "ip host server address adresse client",
    "card": "card credit visa mastercard amex iban konto carte tarjeta kreditkarte",
    "phone": "phone tel telephone call fax mobile cell telefon handy appel llame movil",
    "secret": "token key secret password passwd pwd apikey api_key bearer auth credential",
}
AGAINST = "isbn issn page order invoice version section figure table doi article item sha commit md5 checksum".split()
#: Candidates beside the base ones, and the shape a typical span of the kind has in full.
CANDIDATES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": DIGITS,
    "phone": r"(?<![0-9A-Za-z+.-])(?<!\+[0-9]{1,3}[\x20.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z.-])",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])",
}
SHAPES = {
    "email": r"^[^\[(]+[\[(]at[\])].+[\[(]dot[\])]\x20?[A-Za-z]{2,}$",
    "ip": r"^.{15,}$",
    "card": "luhn",
    "phone": r"^\([0-9]{3}\)",
    "secret": r"^(?=.*[0-9])(?=.*[A-Fa-f])(?:.{32}|.{40}|.{64})$",
}
#: Rounds of expectation-maximisation, and code points of context on either side.
ROUNDS, BEFORE, AFTER = 25, 32, 2
#: Matches whose places are summed in one go.
BLOCK = 512


def spans_of(df: DataFrame, name: str, text: str, pattern: str, needs: Column) -> DataFrame:
    """Add column name: array of (start, end, match, before, after), leftmost and non-overlapping, in code points.

    The places follow from the lengths of the matches and of the text between them.
    """
    none = F.array().cast("array<string>")
    df = df.withColumn(f"{name}_m", F.when(needs, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(f"{name}_g", F.when(F.size(f"{name}_m") > 0, F.split(text, pattern, -1)).otherwise(none))
    m, g = F.col(f"{name}_m"), F.col(f"{name}_g")
    kind = "array<struct<start:int,end:int,match:string,before:string,after:string>>"

    def one(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.char_length(F.get(g, i))
        end = start + F.char_length(F.get(m, i))
        span = F.struct(
            start.alias("start"),
            end.alias("end"),
            F.get(m, i).alias("match"),
            F.right(F.get(g, i), F.lit(BEFORE)).alias("before"),
            F.left(F.get(g, i + 1), F.lit(AFTER)).alias("after"),
        )
        return F.struct(end.alias("at"), F.concat(acc["own"], F.array(span)).alias("own"))

    def block(acc: Column, b: Column) -> Column:
        numbers = F.sequence(b * BLOCK, F.least(b * BLOCK + BLOCK, F.size(m)) - 1)
        inner = F.aggregate(numbers, F.struct(acc["at"].alias("at"), F.array().cast(kind).alias("own")), one)
        return F.transform(
            F.array(inner),
            lambda x: F.struct(x["at"].alias("at"), F.concat(acc["done"], F.array(x["own"])).alias("done")),
        )[0]

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("done"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(m) - 1) / BLOCK).cast("int"))
    found = F.when(F.size(m) > 0, F.flatten(F.aggregate(blocks, start, block)["done"])).otherwise(F.array().cast(kind))
    return df.withColumn(name, found).drop(f"{name}_m", f"{name}_g")


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _card(text: Column, least: int = 14) -> Column:
    digits = _digits(text)
    return F.when(F.char_length(digits).between(least, 19), luhn(digits)).otherwise(False)


VALID = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: s["match"].rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|$)){4}$"),
    "card": lambda s: _card(s["match"]),
    "phone": lambda s: F.char_length(_digits(s["match"])).between(10, 15),
}


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """Columns base_email, base_ip, base_card and base_phone: the valid base matches."""
    digit = F.col(text).rlike("[0-9]")
    for kind, pattern, needs in (
        ("email", EMAIL, F.contains(F.col(text), F.lit("@"))),
        ("ip", IP, digit),
        ("card", DIGITS, digit),
        ("phone", PHONE, F.contains(F.col(text), F.lit("+"))),
    ):
        df = spans_of(df, f"base_{kind}", text, pattern, needs)
        df = df.withColumn(f"base_{kind}", F.filter(f"base_{kind}", VALID[kind]))
    return df


def candidate_spans(df: DataFrame, text: str) -> DataFrame:
    """Columns more_<kind>: the broader candidates, with the labelers' votes and the classifier's features."""
    digit = F.col(text).rlike("[0-9]")
    needs = {"email": F.lower(text).rlike(r"[\[(]at[\])]"), "ip": F.contains(F.col(text), F.lit(":"))}
    for kind, pattern in CANDIDATES.items():
        df = spans_of(df, f"more_{kind}", text, pattern, needs.get(kind, digit))
        df = df.withColumn(f"more_{kind}", F.transform(f"more_{kind}", lambda s: judged(kind, s)))
        if kind == "card":
            df = df.withColumn("more_card", F.filter("more_card", lambda s: s["digits"].between(13, 19)))
    return df


def judged(kind: str, s: Column) -> Column:
    """A span with votes v1 to v4 (1 for, -1 against, 0 abstains) and features f1 to f4, all of few values."""
    vote = lambda yes, no=F.lit(False): F.when(yes, 1).when(no, -1).otherwise(0)
    before, digits = F.lower(s["before"]), F.char_length(_digits(s["match"]))
    shape = _card(s["match"], 13) if kind == "card" else s["match"].rlike(SHAPES[kind])
    words = lambda some: before.rlike(rf"(?:^|[^\p{{L}}])(?:{'|'.join(some)})[^\p{{L}}]{{0,6}}$")
    joined = s["before"].rlike(r"[\p{L}\p{N}_/#-]$") | s["after"].rlike(r"^[\p{L}\p{N}_/-]")
    return F.struct(
        s["start"].alias("start"),
        s["end"].alias("end"),
        digits.alias("digits"),
        vote(shape, ~shape).alias("v1"),
        vote(words(GAZETTEER[kind].split())).alias("v2"),
        vote(s["before"].rlike(r"[=:]\s?[\"']?$"), joined).alias("v3"),
        vote(F.lit(False), words(AGAINST) | s["match"].rlike(r"^(.)\1*$")).alias("v4"),
        F.least(F.char_length(s["match"]) / 8, F.lit(9)).cast("int").alias("f1"),
        F.least(digits / 4, F.lit(9)).cast("int").alias("f2"),
        vote(s["before"].rlike(r"[\"'(\[<]$"), s["before"].rlike(r"[\p{L}]\s?$")).alias("f3"),
        vote(s["match"].rlike("[A-Za-z]"), s["match"].rlike(r"[ .-]")).alias("f4"),
    )


VOTES, FEATURES = ("v1", "v2", "v3", "v4"), ("f1", "f2", "f3", "f4")


def reliabilities(counts: dict[tuple, float], rounds: int = ROUNDS) -> dict[tuple, float]:
    """Vote patterns (kind, v1, ...) with counts to the probability that such a span is personal data.

    Two-class expectation-maximisation: each labeler has its own distribution of votes in either class, shared
    by all kinds; each kind has its own share of personal data. Starts from the votes' balance.
    """
    after = {p: 1 / (1 + math.exp(-(sum(p[1:]) - 0.5))) for p in counts}
    for _ in range(rounds):
        share, seen = defaultdict(lambda: [1.0, 1.0]), defaultdict(lambda: [0.0, 0.0])
        for p, n in counts.items():
            for y, w in ((1, after[p]), (0, 1 - after[p])):
                share[p[0]][y] += n * w
                for j, v in enumerate(p[1:]):
                    seen[j, v][y] += n * w
        total = [sum(n * (after[p] if y else 1 - after[p]) for p, n in counts.items()) for y in (0, 1)]
        #: A labeler is believed a priori to be right more often than wrong: smoothing by the vote's own sign.
        likely = lambda j, v, y: (seen[j, v][y] + (2.0 if v == (1 if y else -1) else 1.0)) / (total[y] + 4.0)
        for p in counts:
            odds = math.log(share[p[0]][1] / share[p[0]][0])
            odds += sum(math.log(likely(j, v, 1) / likely(j, v, 0)) for j, v in enumerate(p[1:]))
            after[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return after


def train(docs: DataFrame, text: str) -> dict[tuple, float]:
    """Log odds of the span classifier: (feature, value) or ("kind", kind) to its weight, from all documents."""
    rows = candidate_spans(docs.select(text), text)
    spans = reduce(
        F.concat, [F.transform(f"more_{k}", lambda s: F.struct(F.lit(k).alias("kind"), s.alias("s"))) for k in CANDIDATES]
    )
    spans = rows.select(F.explode(spans).alias("x")).select("x.kind", *(f"x.s.{c}" for c in (*VOTES, *FEATURES)))
    patterns = spans.groupBy("kind", *VOTES, *FEATURES).count().collect()  # at most 5 * 3**4 * 10 * 10 * 3 * 3
    counts: dict[tuple, float] = defaultdict(float)
    for r in patterns:
        counts[r["kind"], *(r[v] for v in VOTES)] += r["count"]
    after = reliabilities(counts)
    seen, total = defaultdict(lambda: [0.5, 0.5]), defaultdict(lambda: [1.0, 1.0])
    for r in patterns:
        p = after[r["kind"], *(r[v] for v in VOTES)]
        for y, w in ((1, p), (0, 1 - p)):
            total[r["kind"]][y] += r["count"] * w
            for f in (*VOTES, *FEATURES):
                seen[r["kind"], f, r[f]][y] += r["count"] * w
    odds = {(k, f, v): math.log(y / total[k][1]) - math.log(n / total[k][0]) for (k, f, v), (n, y) in seen.items()}
    return odds | {(k, "share", 0): math.log(y / n) for k, (n, y) in total.items()}


def accepted(kind: str, s: Column, odds: dict[tuple, float]) -> Column:
    """Whether the classifier takes the span."""
    if (kind, "share", 0) not in odds:
        return F.lit(False)
    score = F.lit(odds[kind, "share", 0])
    for f in (*VOTES, *FEATURES):
        for (k, own, value), weight in odds.items():
            if (k, own) == (kind, f):
                score = score + F.when(s[f] == value, weight).otherwise(0.0)
    return score > 0


def joined(spans: Column) -> Column:
    """Spans (start, rank, kind, end) as kind:start:end, by start and then by kind."""
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Counts and base_sha256 are of the base spans; spans holds these and the classifier's, kind:start:end in
    code points, by start and kind. Null texts count as empty and have no spans. Null ids and repeated rows
    are ordinary. An empty table, or one without candidates, adds nothing. Other columns are ignored, whatever
    their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("body"))
    odds = train(rows, "body")
    found = candidate_spans(base_spans(rows, "body"), "body")

    def as_spans(column: str, kind: str) -> Column:
        return F.transform(
            column,
            lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")),
        )

    found = found.withColumn("base", F.concat(*(as_spans(f"base_{k}", k) for k in VALID)))
    for kind in CANDIDATES:
        found = found.withColumn(f"more_{kind}", F.filter(f"more_{kind}", lambda s: accepted(kind, s, odds)))
    found = found.withColumn("added", F.array_except(F.concat(*(as_spans(f"more_{k}", k) for k in CANDIDATES)), "base"))
    return found.select(
        "doc_id",
        *(F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in VALID),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
