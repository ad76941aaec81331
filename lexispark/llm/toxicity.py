"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is the bag of itself and its character n-grams (3 to 5 bytes between ``<`` and ``>``), hashed to buckets with an
embedding each; unseen misspellings share most of their n-grams with known words. A passage is the average of its words'
bags, and the softmax over two classes is linear in that average, so every word has one logit and a passage the average
of its words' logits. A text is as toxic as its most toxic passage: the first training phase learns from whole texts, the
second from passages, where a toxic text is represented by the passages that the model finds most toxic and a clean text
by all of its own.

Training reads at most ``most_docs`` labelled rows of each class and ``most_chars`` characters of each class, taken by a
hash of the key; that bound is independent of the input. Scoring covers every word of every text.

Rows with a null key or a null label aren't learned from; labels that contradict each other count as toxic. Null and
empty texts have no passage and score about 0. Without labels of both classes every score is 0. Rows repeat
as in ``docs``; an empty table gives an empty result; of the input only key and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS, DIM, SPAN = 1 << 17, 4, 3
#: Texts of the sample that must hold a bucket, and the weight decay.
MIN_TEXTS, DECAY = 5, 1e-5
MOST_DOCS, MOST_CHARS = 2000, 12_000_000
THRESHOLD = 0.3
#: Distinct words a worker remembers before it starts anew.
MEMORY = 400_000
_STRIP = b".,;:!?\"'()[]{}|-_*"


def words(text: str) -> list[bytes]:
    return [w for x in text.lower().encode().split() if (w := x.strip(_STRIP))]


def subwords(vocab: list[bytes], buckets: int = BUCKETS, words_at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) pairs: each word and its n-grams."""
    parts = [_subwords(vocab[i : i + words_at_once], i, buckets) for i in range(0, len(vocab), words_at_once)]
    none = np.zeros(0, np.int32)
    return np.concatenate([none, *(p[0] for p in parts)]), np.concatenate([none, *(p[1] for p in parts)])


def _subwords(vocab: list[bytes], start: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(b"<" + w + b">" for w in vocab), np.uint8).astype(np.uint64)
    size = np.array([len(w) + 2 for w in vocab])
    owner = np.repeat(np.arange(start, start + len(vocab), dtype=np.int32), size)
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    left = np.repeat(first + size, size) - np.arange(len(flat))  # bytes from here to the word's end
    who, what = [], []
    for n in (3, 4, 5):
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + flat[at + j]
        who.append(owner[at])
        what.append((common.mix(h) % np.uint64(buckets)).astype(np.int32))
    whole = np.full(len(vocab), 77, np.uint64)
    for j in range(int(size.max())):
        at = np.flatnonzero(size > j)
        whole[at] = whole[at] * np.uint64(0x100000001B3) + flat[first[at] + j]
    who.append(np.arange(start, start + len(vocab), dtype=np.int32))
    what.append((common.mix(whole) % np.uint64(buckets)).astype(np.int32))
    return np.concatenate(who), np.concatenate(what)


@dataclass
class Model:
    """Logit of each bucket (embedding times the difference of the softmax's columns) and the bias."""

    logit: np.ndarray
    bias: float
    span: int = SPAN

    def word_logits(self, vocab: list[bytes]) -> np.ndarray:
        who, what = subwords(vocab, len(self.logit))
        return np.bincount(who, self.logit[what], len(vocab)) / np.maximum(np.bincount(who, minlength=len(vocab)), 1)

    def passages(self, values: np.ndarray) -> np.ndarray:
        """Averages of each run of ``span`` words (of all, if fewer)."""
        n = min(self.span, len(values))
        if not n:
            return np.full(1, -np.inf)
        c = np.concatenate([[0], np.cumsum(values)])
        return (c[n:] - c[:-n]) / n

    def score(self, best: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(best + self.bias, -40, 40)))


def _sums(values: np.ndarray, at: np.ndarray, groups: np.ndarray, n: int, share: np.ndarray | None = None, rows: int = 500_000) -> np.ndarray:
    """Sums by group of the rows ``at`` of ``values`` times ``share``, a column and some rows at a time."""
    out = np.zeros((n, values.shape[1]))
    for i in range(0, len(at), rows):
        part = slice(i, i + rows)
        for d in range(values.shape[1]):
            x = values[:, d][at[part]]
            out[:, d] += np.bincount(groups[part], x if share is None else x * share[part], n)
    return out


class Trainer:
    """Embeddings and softmax under Adam; ``fit`` continues from where it is with other bags of words."""

    def __init__(self, ids: list[np.ndarray], vocab: list[bytes], seed: int, dim: int, buckets: int, span: int):
        rng = np.random.default_rng(seed)
        self.buckets, self.span, self.vocab = buckets, span, vocab
        who, what = subwords(vocab, buckets)
        held = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=len(vocab)).astype(np.float64)
        texts = _sums(held[:, None], who, what, buckets)[:, 0]
        common_ = (texts >= MIN_TEXTS)[what]  # a bucket that a few texts hold says nothing of others
        self.size = np.maximum(np.bincount(who, minlength=len(vocab)), 1)[:, None]
        self.used = np.flatnonzero(texts >= MIN_TEXTS)
        place = np.full(buckets, -1, np.int32)
        place[self.used] = np.arange(len(self.used))
        self.who, self.local = who[common_], place[what[common_]]
        del who, what, common_
        self.params = [rng.normal(0, 0.01, (len(self.used), dim)), rng.normal(0, 0.3, (dim, 2)), np.zeros(2)]
        self.moments = [(np.zeros_like(x), np.zeros_like(x)) for x in self.params]
        self.step = 0

    def fit(self, bags: list[np.ndarray], target: np.ndarray, weight: np.ndarray, times: int, rate: float) -> None:
        n, v = len(target), len(self.vocab)
        sets = [np.unique(x, return_counts=True) for x in bags]
        b = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x, _ in sets])
        here, w = np.unique(np.concatenate([x for x, _ in sets]), return_inverse=True)  # the words of these bags only
        w = w.astype(np.int32)
        count = np.concatenate([c for _, c in sets]).astype(np.float32)
        share = (count / np.bincount(b, count, n)[b]).astype(np.float32)
        del sets, count
        place = np.full(v, -1, np.int32)
        place[here] = np.arange(len(here))
        who, local, size = place[self.who], self.local, self.size[here]
        if len(here) < v:
            mine = who >= 0
            who, local = who[mine], local[mine]
        hot = np.eye(2)[target]
        emb, soft, bias = self.params
        for _ in range(times):
            self.step += 1
            word = _sums(emb, local, who, len(here)) / size
            mean = _sums(word.astype(np.float32), w, b, n, share)
            z = mean @ soft + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (p - hot) * weight[:, None]
            d_word = _sums((g @ soft.T).astype(np.float32), b, w, len(here), share) / size
            grads = (_sums(d_word, who, local, len(self.used)) + DECAY * emb, mean.T @ g + DECAY * soft, g.sum(axis=0))
            for param, grad, (m, q) in zip(self.params, grads, self.moments, strict=True):
                m += 0.1 * (grad - m)
                q += 0.01 * (grad * grad - q)
                param -= rate * (m / (1 - 0.9**self.step)) / (np.sqrt(q / (1 - 0.99**self.step)) + 1e-8)

    def word_logits(self) -> np.ndarray:
        """Of the words that it was made with."""
        logit = self.params[0] @ (self.params[1][:, 1] - self.params[1][:, 0])
        return _sums(logit[:, None], self.local, self.who, len(self.vocab))[:, 0] / self.size[:, 0]

    def model(self) -> Model:
        logit = np.zeros(self.buckets)
        logit[self.used] = self.params[0] @ (self.params[1][:, 1] - self.params[1][:, 0])
        return Model(logit, float(self.params[2][1] - self.params[2][0]), self.span)


def train(texts: list[str], labels: list[int], seed: int = 7, first: int = 10, rounds: int = 14, times: int = 8, dim: int = DIM, buckets: int = BUCKETS, span: int = SPAN) -> Model:
    """The model of these texts; see the module for the two phases."""
    rng = np.random.default_rng(seed)
    place: dict[bytes, int] = {}
    ids = [np.array([place.setdefault(w, len(place)) for w in words(t)], np.int32) for t in texts]
    y = np.array(labels, np.int64)
    docs = [i for i, x in enumerate(ids) if len(x)]
    if not docs or len(set(y[docs])) < 2:
        return Model(np.zeros(buckets), -40.0, span)
    vocab = list(place)
    t = Trainer([ids[i] for i in docs], vocab, seed, dim, buckets, span)
    t.fit([ids[i] for i in docs], y[docs], 0.5 / np.bincount(y[docs])[y[docs]], first, 0.02)
    kept: dict[tuple[int, int], int] = {}  # passages of clean texts that were hard once stay
    for _ in range(rounds):
        now, logit = t.model(), t.word_logits()
        bags, target = [], []
        for i in docs:
            tops = now.passages(logit[ids[i]])
            if y[i]:
                bags.append(ids[i][(k := int(tops.argmax())) : k + span])
                target.append(1)
            else:
                for k in {*np.argsort(-tops)[:3].tolist(), *rng.integers(0, len(tops), 2).tolist()}:
                    kept[i, k] = 0
        for i, k in kept:
            bags.append(ids[i][k : k + span])
            target.append(0)
        target = np.array(target)
        t.fit(bags, target, np.array([0.8, 0.2])[target] / np.bincount(target, minlength=2)[target], times, 0.02)
    return t.model()


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most_docs: int = MOST_DOCS, most_chars: int = MOST_CHARS) -> list[tuple[str, int]]:
    """The texts and labels to learn from: a bounded part of the labelled rows, by a hash of the key."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("__y"))
    known = known.withColumn("__h", F.xxhash64(F.col(key), F.lit(1)))
    picked = [known.where(F.col("__y") == c).orderBy("__h", key).limit(most_docs) for c in (0, 1)]
    chosen = picked[0].unionByName(picked[1])
    found = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("__text")).join(F.broadcast(chosen), key)  # 2 * most_docs rows of three numbers
    found = found.groupBy(key, "__y", "__h").agg(F.max("__text").alias("__text")).withColumn(
        "__sum", F.expr("sum(length(__text)) over (partition by __y order by __h rows unbounded preceding)")
    )
    out = found.where(F.col("__sum") <= most_chars).select("__h", "__text", "__y").collect()
    return [(t, int(c)) for _, t, c in sorted(tuple(r) for r in out)]


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): one row for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()
    arrow = common.arrow_type(docs, key)

    def run(batches):
        values = scorer(shared.value)
        for keys, texts in common.rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys, arrow), pa.array(values(texts))], names=["key", "score"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def scorer(model: Model):
    """A function from texts to scores that remembers the words it has seen."""
    known: dict[bytes, float] = {}

    def values(texts: list[str]) -> np.ndarray:
        split = [words(t) for t in texts]
        new = list({w for s in split for w in s if w not in known})
        known.update(zip(new, model.word_logits(new).tolist(), strict=True))
        best = np.array([model.passages(np.fromiter(map(known.__getitem__, s), float, len(s))).max() for s in split])
        if len(known) > MEMORY:
            known.clear()
        return model.score(best)

    return values


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the rows whose crc32 of the key leaves another rest than 2 by 4."""
    rows = sample(docs, labels.where(~common.crc_mod(F.col("doc_id"), 4, 2)))
    return train([t for t, _ in rows], [c for _, c in rows])


def reject(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, other columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        values = scorer(shared.value)
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(at)]
            keep = [np.ones(0, bool)] + [values(texts[i : i + 1024]) < threshold for i in range(0, len(texts), 1024)]
            yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; predicted at ``THRESHOLD``."""
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, learn(docs, common.table(spark, sf_dir, "labels"))).select(
        "doc_id", common.crc_mod(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
