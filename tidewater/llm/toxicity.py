"""Toxicity scores: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams with border marks, hashed to a fixed number of embedding rows; its vector
is their mean, so a misspelling that training never saw shares most n-grams with the word it distorts. The vectors of
a window of ``window`` words are averaged and go through a linear softmax of two classes. The odds of a text are the
mean odds of its windows, times their number up to ``reach``: a few words decide a text of usual length, and a long
clean text scores no higher than a short one. Embeddings and softmax are trained together on the odds of whole
labelled texts by full-batch Adam.

Training takes at most ``sample_rows`` labelled rows of at most ``sample_bytes`` in sum, those of least hash;
everything else covers all data. Scores come from one number for each distinct word, which the linear layer allows,
and run on the executors.

Defined results: a null text is empty; an empty text has the score of a window without words; labels other than 0 and
1 are ignored; a row that repeats an id is a row of its own with the id's largest label; without labels of both
classes every score is the prior of the labels (0 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .scratch import positional

_LETTER = np.array([c >= 0x80 or chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MARK = np.uint8(1)


class Classifier(NamedTuple):
    logit: np.ndarray  # of each n-gram bucket: embedding times the softmax's difference of classes
    bias: float
    window: int
    sizes: tuple[int, ...]
    reach: int


def folded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters and digits; all else is space, so punctuation ends a word."""
    out = _LOWER[data]
    if len(data) > 1:
        big = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
        out[big] += 0x20
    out[~_LETTER[data]] = 0x20
    return out, off


def grams(words: list[bytes], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word with border marks, and the words' offsets; each word has one at least."""
    length = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(length)
    flat = np.frombuffer(b"".join(b"\1" + w + b"\1" for w in words), np.uint8).astype(np.uint64) + np.uint64(1)
    word = np.repeat(np.arange(len(words)), length)
    parts, owners = [], []
    for n in sizes:
        h = tx.mix(tx.roll(flat, n) + np.uint64(n))
        good = word[: len(h)] == word[n - 1 :] if len(h) else np.zeros(0, bool)
        parts.append(h[good])
        owners.append(word[: len(h)][good])
    whole = np.add.reduceat(flat * tx.powers(int(length.max()) + 1)[0][np.arange(len(flat)) - np.repeat(ends - length, length)], ends - length)
    parts.append(tx.mix(whole))
    owners.append(np.arange(len(words)))
    h, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (h[order] % np.uint64(buckets)).astype(np.int32), np.searchsorted(owner[order], np.arange(len(words) + 1))


def windows_of(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the windows of each text (half overlapping), and each window's end; a text has one at least."""
    n = np.diff(bounds)
    step = max(1, size // 2)
    count = np.maximum(1, -(-(n - size) // step) + 1)
    text = np.repeat(np.arange(len(n)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = bounds[text] + at * step
    return first, np.minimum(first + size, bounds[text + 1]), text


def pooled(z: np.ndarray, text: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Logit of each text from those of its windows, which are in order of the text, and each window's share in it."""
    count = np.bincount(text)
    starts = np.cumsum(count) - count
    top = np.maximum.reduceat(z, starts)
    e = np.exp(z - top[text])
    total = np.add.reduceat(e, starts)
    return top + np.log(total) - np.log(np.maximum(1.0, count / reach)), e / total[text]


def _text_logits(word_logit: np.ndarray, bounds: np.ndarray, bias: float, size: int, reach: int) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Logit of class 1 of each text, the shares of its windows, and the windows."""
    first, last, text = windows_of(bounds, size)
    total = np.concatenate([[0.0], np.cumsum(word_logit)])
    return *pooled((total[last] - total[first]) / np.maximum(1, last - first) + bias, text, reach), (first, last, text)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def train(flat: np.ndarray, bounds: np.ndarray, words: list[bytes], labels: np.ndarray, dim: int, buckets: int, window: int, sizes: tuple[int, ...], steps: int, rate: float, seed: int, reach: int, min_texts: int = 5, decay: float = 1e-6) -> Classifier:
    """flat: the words of all texts as numbers in ``words``; text i has flat[bounds[i]:bounds[i + 1]]."""
    parts = [grams(words[at : at + 20_000], sizes, buckets) for at in range(0, len(words), 20_000)]
    edges = np.arange(0, len(words) + 20_000, 20_000)
    texts, size = len(bounds) - 1, len(words)

    def to_grams(x: np.ndarray) -> np.ndarray:
        """Sums of the words' values over each bucket, part by part to bound memory."""
        return sum(np.bincount(g, np.repeat(x[lo:hi], np.diff(s)), buckets) for (g, s), lo, hi in zip(parts, edges, edges[1:], strict=False))

    per = np.concatenate([np.diff(s) for _, s in parts])
    seen = np.unique(np.repeat(np.arange(texts), np.diff(bounds)) * np.int64(size) + flat)
    spread = to_grams(np.bincount(seen % size, minlength=size).astype(float))
    del seen
    alive = (spread >= min_texts)[:, None]  # n-grams of fewer texts stay at zero, so training can't learn texts by heart
    rng = np.random.default_rng(seed)
    emb = alive * rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    out = rng.normal(0, 0.1, dim).astype(np.float32)
    prior = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    bias = np.float32(np.log(prior / (1 - prior)) - np.log(min(float(reach), max(1.0, len(flat) / max(1, texts) / window * 2))))
    params = [emb, out, np.array([bias], np.float32)]
    means, squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for turn in range(1, steps + 1):
        emb, out, b = params
        score = emb @ out
        word = np.concatenate([np.add.reduceat(score[g], s[:-1]) for g, s in parts]) / per
        z, part, (first, last, text) = _text_logits(word[flat], bounds, float(b[0]), window, reach)
        d = ((sigmoid(z) - labels) / texts)[text] * part
        share = d / np.maximum(1, last - first)
        edge = np.bincount(first, share, len(flat) + 1) - np.bincount(last, share, len(flat) + 1)
        d_word = np.bincount(flat, np.cumsum(edge)[:-1], size) / per
        d_gram = to_grams(d_word)
        grads = [(alive * (d_gram[:, None] * out + decay * emb)).astype(np.float32), (d_gram @ emb).astype(np.float32), np.array([d.sum()], np.float32)]
        for x, m, s, g in zip(params, means, squares, grads, strict=True):
            m *= 0.9
            m += 0.1 * g
            s *= 0.99
            s += 0.01 * g * g
            x -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(s / (1 - 0.99**turn)) + 1e-7)
    emb, out, b = params
    return Classifier((emb @ out).astype(np.float64), float(b[0]), window, sizes, reach)


_known: dict[int, dict[bytes, float]] = {}


def _score(model, out: str, at_text: int = 0, cache_words: int = 100_000, part: int = 5_000):
    """at_text: place of the text among the columns. part: words whose n-grams are made at once, which take about 2 KB a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Classifier = model.value
        mark = hash((m.bias, float(m.logit[0]), float(m.logit.sum())))
        if mark not in _known:
            _known.clear()
            _known[mark] = {}
        known = _known[mark]
        tx.claim("toxicity", known)
        for b in batches:
            for lo, hi, data, off in tx.chunks(*tx.utf8(b.column(at_text)), limit=1 << 20):
                flat, _ = folded(data, off)
                raw = flat.tobytes()
                split = [raw[a:z].split() for a, z in zip(off.tolist(), off[1:].tolist(), strict=False)]
                if len(known) > cache_words:
                    known.clear()
                new = list({w for ws in split for w in ws if w not in known})
                for at in range(0, len(new), part):
                    some = new[at : at + part]
                    gram, starts = grams(some, m.sizes, len(m.logit))
                    known.update(zip(some, (np.add.reduceat(m.logit[gram], starts[:-1]) / np.diff(starts)).tolist(), strict=True))
                bounds = np.concatenate([[0], np.cumsum([len(ws) for ws in split])])
                word = np.fromiter((known[w] for ws in split for w in ws), np.float64, int(bounds[-1]))
                score = sigmoid(_text_logits(word, bounds, m.bias, m.window, m.reach)[0])
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, pa.array(score)], [*b.schema.names, out])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 2500, sample_bytes: int = 64_000_000, dim: int = 8, buckets: int = 1 << 18, window: int = 2, sizes: tuple[int, ...] = (3, 5, 7, 9), steps: int = 50, rate: float = 0.1, seed: int = 11, reach: int = 200) -> Classifier:
    """Trains on the labelled rows whose ids ``keep`` (over the columns of ``labels``), in the limits of the sample.

    The rows of least hash of the id are taken, and an id labelled twice has its larger label.
    """
    rows = labels.where(keep).select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y in (0, 1)")
    some = rows.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.xxhash64("id"), F.col("id"), F.xxhash64("text")]
    found = texts.join(F.broadcast(some), "id").orderBy(*order).limit(sample_rows)
    sofar = F.sum(F.octet_length("text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    got = found.withColumn("sofar", sofar).where(F.col("sofar") <= sample_bytes).select("id", "text", "y").toArrow().sort_by([("id", "ascending"), ("text", "ascending")])
    labels = np.array(got["y"].to_pylist(), np.float64)
    if not len(labels) or labels.min() == labels.max():
        prior = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-9, 1 - 1e-9))
        return Classifier(np.zeros(1), float(np.log(prior / (1 - prior))), 1 << 40, sizes, reach)
    vocabulary: dict[bytes, int] = {}
    flat, lengths = [], []
    for batch in got.to_batches(max_chunksize=500):
        data, off = tx.utf8(batch["text"])
        raw = folded(data, off)[0].tobytes()
        for a, z in zip(off.tolist(), off[1:].tolist(), strict=False):
            ws = raw[a:z].split()
            lengths.append(len(ws))
            flat.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in ws), np.int32, len(ws)))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    return train(np.concatenate(flat), bounds, list(vocabulary) or [b""], labels, dim, buckets, window, sizes, steps, rate, seed, reach)


def score_toxicity(docs: DataFrame, model: Classifier, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` and a score from 0 to 1; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c.lower() != score_col.lower()]
    sent = [c.lower() for c in keep]
    at = sent.index(text_col.lower()) if text_col.lower() in sent else len(sent)  # a text that the score replaces goes last, all others go once
    rows = positional(docs.select(*(F.col(f"`{c}`") for c in keep), *[F.col(f"`{text_col}`")] * (at == len(sent))))
    out = rows.mapInArrow(_score(shared, "score", at), rows.withColumn("score", F.lit(0.0)).schema)
    return out.select(*(f"c{i}" for i in range(len(keep))), "score").toDF(*keep, score_col)
