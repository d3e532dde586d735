"""Toxicity by subword bags: averaged n-gram embeddings into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams, so a misspelling that was never seen still shares most
of them. A window of a few words is the mean of its words, and a softmax reads the window. A text scores as its
most toxic window: a label marks a whole text, so each epoch learns from the window of a toxic text that the model
finds most toxic, and from the hardest and some random windows of the other texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, text_of

#: A Python worker forgets its words once it holds more than CACHED; it scores BLOCK texts and hashes HASHED words at once.
CACHED, BLOCK, HASHED = 200_000, 200, 10_000


@dataclass(frozen=True)
class Settings:
    """n-grams from `shortest` to `longest` characters fall into `buckets`; at most `rows_per_label` labelled rows
    of each label are learnt from, whole, as many of them as together have at most `chars_per_label` characters."""

    buckets: int = 1 << 18
    dim: int = 16
    shortest: int = 3
    longest: int = 5
    window: int = 6
    epochs: int = 16
    batch: int = 256
    rate: float = 0.3
    rows_per_label: int = 5_000
    chars_per_label: int = 20_000_000
    seed: int = 17


def words_of(text: str) -> list[str]:
    return text.lower().split()


#: Multiplier and final mixer of the n-grams' polynomial hash over code points.
FACTOR, MIXER = np.uint64(1_099_511_628_211), np.uint64(0x9E3779B97F4A7C15)


def ngrams(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word itself and of its n-grams, with marks at its ends, and where each word's buckets end."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    done = [_ngrams(words[i : i + HASHED], s) for i in range(0, len(words), HASHED)]
    ends = np.cumsum(np.concatenate([n for _, n in done]))
    at = int(ends[-1])
    buckets = np.empty(at, np.int32)
    while done:  # from the end, so that each part's memory goes once it is copied
        own, _ = done.pop()
        buckets[at - len(own) : at] = own
        at -= len(own)
    return buckets, ends


def _ngrams(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and how many each word has. An n-gram is a polynomial of its code points, a word that of all its own."""
    marked = [f"<{w}>" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(size)
    starts = ends - size
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    word = np.repeat(np.arange(len(words)), size)
    with np.errstate(over="ignore"):
        power = FACTOR ** np.arange(int(size.max(initial=1)), dtype=np.uint64)
        found = [(np.add.reduceat(code * power[np.arange(len(code)) - starts[word]], starts), np.arange(len(words)))]
        rolling = code
        for n in range(2, s.longest + 1):
            rolling = rolling[: max(0, len(code) - n + 1)] * FACTOR + code[n - 1 :]
            if n >= s.shortest:
                own = word[: len(rolling)] == word[n - 1 :]
                found.append((rolling[own] + np.uint64(n), word[: len(rolling)][own]))
        grams = np.concatenate([h for h, _ in found]) * MIXER >> np.uint64(33)
    owner = np.concatenate([w for _, w in found])
    order = np.argsort(owner, kind="stable")
    buckets = (grams % np.uint64(s.buckets)).astype(np.int32)[order]
    return buckets, np.bincount(owner, minlength=len(words))


class Corpus:
    """Texts as runs of word numbers, and the n-grams of each word."""

    def __init__(self, texts: list[str], s: Settings) -> None:
        numbers: dict[str, int] = {}
        runs = [np.array([numbers.setdefault(w, len(numbers)) for w in words_of(t)] or [numbers.setdefault("", len(numbers))], np.int32) for t in texts]
        self.words, self.s = np.concatenate(runs), s
        self.ends = np.cumsum([len(r) for r in runs])
        self.starts = np.concatenate(([0], self.ends[:-1]))
        self.doc = np.repeat(np.arange(len(runs), dtype=np.int32), [len(r) for r in runs])
        self.grams, self.gram_ends = ngrams(list(numbers), s)
        self.gram_starts = np.concatenate(([0], self.gram_ends[:-1]))

    def word_scores(self, by_gram: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.gram_ends), by_gram.dtype)
        for at in range(0, len(out), HASHED):
            starts, ends = self.gram_starts[at : at + HASHED], self.gram_ends[at : at + HASHED]
            out[at : at + HASHED] = np.add.reduceat(by_gram[self.grams[starts[0] : ends[-1]]], starts - starts[0])
        return out / (self.gram_ends - self.gram_starts)

    def best_windows(self, word_scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: where its highest window starts, and that window's mean."""
        at, best = np.zeros(len(self.starts), np.int64), np.zeros(len(self.starts))
        for i, (start, end) in enumerate(zip(self.starts, self.ends)):
            sums = np.concatenate(([0.0], np.cumsum(word_scores[self.words[start:end]])))
            n = min(self.s.window, end - start)
            means = (sums[n:] - sums[:-n]) / n
            k = int(means.argmax())
            at[i], best[i] = start + k, means[k]
        return at, best


class SubwordSoftmax:
    """Embeddings of n-gram buckets and a softmax over (clean, toxic); `scale` and `shift` calibrate a text's logit."""

    def __init__(self, s: Settings) -> None:
        rng = np.random.default_rng(s.seed)
        self.s, self.rng = s, rng
        self.vectors = (rng.random((s.buckets, s.dim), np.float32) - 0.5) / s.dim
        self.weights = (rng.random((2, s.dim), np.float32) - 0.5) * 0.5
        self.bias = np.zeros(2, np.float32)
        self.scale, self.shift = 1.0, 0.0

    def by_gram(self) -> np.ndarray:
        """What each n-gram adds to the logit: averages and softmax are linear up to here."""
        return self.vectors @ (self.weights[1] - self.weights[0])

    def _step(self, c: Corpus, starts: np.ndarray, toxic: np.ndarray, weight: np.ndarray, past: list[np.ndarray]) -> None:
        """One Adagrad step on the windows at starts."""
        size = np.minimum(self.s.window, c.ends[c.doc[starts]] - starts)
        at = np.repeat(starts, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
        window = np.repeat(np.arange(len(starts)), size)
        word = c.words[at]
        grams_each = c.gram_ends[word] - c.gram_starts[word]
        gram = c.grams[np.repeat(c.gram_starts[word], grams_each) + (np.arange(grams_each.sum()) - np.repeat(np.cumsum(grams_each) - grams_each, grams_each))]
        owner = np.repeat(window, grams_each)
        share = (1.0 / np.repeat(grams_each * size[window], grams_each)).astype(np.float32)
        hidden = np.add.reduceat(self.vectors[gram] * share[:, None], np.flatnonzero(np.diff(owner, prepend=-1)))
        logits = hidden @ self.weights.T + self.bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(toxic)), toxic] -= 1
        p *= weight[:, None] / len(toxic)
        back = (p @ self.weights)[owner] * share[:, None]
        order = np.argsort(gram, kind="stable")
        rows, first = np.unique(gram[order], return_index=True)
        change = np.add.reduceat(back[order], first)
        past[0][rows] += (change**2).mean(1)
        self.vectors[rows] -= self.s.rate * change / np.sqrt(past[0][rows] + 1e-9)[:, None]
        for own, grad, seen in ((self.weights, p.T @ hidden, past[1]), (self.bias, p.sum(0), past[2])):
            seen += grad**2
            own -= 0.3 * self.s.rate * grad / np.sqrt(seen + 1e-9)

    def fit(self, texts: list[str], toxic: np.ndarray) -> None:
        c, rng = Corpus(texts, self.s), self.rng
        past = [np.zeros(self.s.buckets, np.float32), np.zeros_like(self.weights), np.zeros_like(self.bias)]
        n = len(c.gram_ends)
        yes, no = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for start, end, label in zip(c.starts, c.ends, toxic):
            (yes if label else no)[np.unique(c.words[start:end])] += 1
        scores = np.log((yes + 0.2) / (toxic.sum() + 1)) - np.log((no + 1.0) / (len(toxic) - toxic.sum() + 1))
        for epoch in range(self.s.epochs):
            if epoch >= self.s.epochs // 6:
                scores = c.word_scores(self.by_gram())
            best, _ = c.best_windows(scores)
            others = np.flatnonzero(toxic == 0)
            drawn = [(c.starts[others] + rng.random(len(others)) * np.maximum(1, c.ends[others] - c.starts[others] - self.s.window + 1)).astype(np.int64) for _ in range(2)]
            starts = np.concatenate([best, *drawn])
            label = np.concatenate([toxic, *[np.zeros(len(others), np.int64)] * 2])
            weight = np.where(label == 1, 0.5 / (label == 1).sum(), 0.5 / (label == 0).sum()).astype(np.float32) * len(label)
            for some in np.array_split(rng.permutation(len(starts)), max(1, len(starts) // self.s.batch)):
                self._step(c, starts[some], label[some], weight[some], past)

    def logits(self, texts: list[str]) -> np.ndarray:
        c = Corpus(texts, self.s)
        return c.best_windows(c.word_scores(self.by_gram()))[1] + self.bias[1] - self.bias[0]

    def calibrate(self, logits: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> None:
        """Logistic regression of the labels on a text's logit, with a weight for each row (Newton's method)."""
        x, beta = np.stack([logits, np.ones_like(logits)], 1), np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            slope = (x * (weight * (p - toxic))[:, None]).sum(0) + 1e-3 * (beta - [1.0, 0.0])
            bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            beta = beta - np.linalg.solve(bend, slope)
        if np.isfinite(beta).all() and beta[0] > 0:
            self.scale, self.shift = map(float, beta)


@dataclass(frozen=True)
class Scorer:
    """What scoring needs of a trained model: n-gram contributions, bias and calibration."""

    s: Settings
    by_gram: np.ndarray
    bias: float
    scale: float
    shift: float

    def word_scores(self, words: list[str]) -> list[float]:
        """The mean of what a word's n-grams add to the logit."""
        buckets, ends = ngrams(words, self.s)
        starts = np.concatenate(([0], ends[:-1]))
        return (np.add.reduceat(self.by_gram[buckets].astype(np.float64), starts) / (ends - starts)).tolist()

    def probability(self, texts: list[str], cache: dict[str, float]) -> list[float]:
        """cache holds words met before; the words of texts that are new are added to it."""
        split, out = [words_of(t) for t in texts], []
        if len(cache) > CACHED:
            cache.clear()
        fresh = list({w for words in split for w in words if w not in cache} | {""} - cache.keys())
        if fresh:
            cache.update(zip(fresh, self.word_scores(fresh)))
        for words in split:
            own = np.fromiter(map(cache.__getitem__, words), np.float64, len(words))
            n = min(self.s.window, len(own))
            sums = np.concatenate(([0.0], np.cumsum(own)))
            logit = self.bias + (float((sums[n:] - sums[:-n]).max()) / n if n else cache[""])
            out.append(float(1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -30, 30)))))
        return out


def held_out(id_col: Column) -> Column:
    """Rows that labels are never learnt from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> Scorer:
    """Learn from a bounded sample of labelled rows (see Settings), in the order of a seeded hash, never from those of
    held_out(). Sampled texts are learnt from whole, whatever their length; one that the bound on characters has no
    room for is passed over.

    A fifth of the sample (remainder 1) sets the calibration, weighted to the labels' true shares. Without
    labels of both kinds every text scores the share of toxic labels (0 without labels). Null or other labels
    are ignored; of several labels of a document, toxic wins.
    """
    known = (
        labels.select(F.col(id_col).alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    shares = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = shares.get(1, 0) / max(1, sum(shares.values()))
    constant = Scorer(s, np.zeros(s.buckets, np.float32), 0.0, 1.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    if min(shares.get(0, 0), shares.get(1, 0)) == 0:
        return constant
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("body"))
    order = F.xxhash64("doc_id", F.lit(s.seed)).alias("place")
    asked = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(s.rows_per_label) for k in (0, 1)]
    asked = asked[0].unionByName(asked[1])
    sizes = texts.join(F.broadcast(asked), "doc_id").groupBy("doc_id", "toxic", order).agg(F.sum(F.char_length("body")).alias("n")).collect()
    taken = []
    for kind in (0, 1):
        left = s.chars_per_label
        for r in sorted((r["place"], r["doc_id"], r["n"]) for r in sizes if r["toxic"] == kind):
            if r[2] <= left:
                left -= r[2]
                taken.append((r[1],))
    if not taken:
        return constant
    chosen = asked.join(docs.sparkSession.createDataFrame(taken, known.select("doc_id").schema), "doc_id")
    aside = (F.crc32(F.col("doc_id").cast("string")) % 5 == 1).alias("aside")
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "body", "toxic", aside).collect()
    rows = sorted(set(rows))
    if not rows:
        return constant
    toxic, aside = np.array([r["toxic"] for r in rows]), np.array([r["aside"] for r in rows])
    if min(toxic[~aside].sum(), (1 - toxic[~aside]).sum()) == 0:
        return constant
    model = SubwordSoftmax(s)
    model.fit([r["body"] for r in rows if not r["aside"]], toxic[~aside])
    own = toxic[aside]
    if 0 < own.sum() < len(own):
        weight = np.where(own == 1, share / own.mean(), (1 - share) / (1 - own.mean()))
        model.calibrate(model.logits([r["body"] for r in rows if r["aside"]]), own, weight)
    return Scorer(s, model.by_gram(), float(model.bias[1] - model.bias[0]), model.scale, model.shift)


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """The input rows with column out: the probability (0 to 1) that the whole text is toxic.

    Null and empty texts score like a word without letters. A column named out in the input is replaced; other
    columns pass unchanged.
    """
    rows = docs.drop(out)
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    text_at = rows.columns.index(text_col)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in sliced(batches, BLOCK):
            own = sent.value.probability([t or "" for t in batch.column(text_at).to_pylist()], cache)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.float64())], [*batch.schema.names, out])

    return rows.mapInArrow(run, f"{ddl}, `{out}` double")
