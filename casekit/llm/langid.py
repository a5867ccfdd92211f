"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from ._common import bound_batches, free_name, release, trim_memory, worker_cache

UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")
_PRIME = np.uint64(0x100000001B3)
#: Words whose sums a worker keeps.
_CACHE_WORDS = 200_000


def words_of(text: str) -> list[str]:
    """The runs of letters (as ``str.isalpha``) of whole ``text``, in lower case."""
    words = _WORD.findall(text.lower())
    if words and not "".join(words).isalpha():  # numerals such as fractions and Roman numbers
        words = [x for w in words for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]
    return words


def subwords(words: list[str], buckets: int, low: int = 2, high: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of its word) of every subword of ``words``: of each word, marked as
    ``<word>``, the whole and all character ``low``- to ``high``-grams."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(points))
    place = sizes[word] - left
    most = int(sizes.max()) if len(words) else 0
    power = np.multiply.accumulate(np.append(np.uint64(1), np.full(most, _PRIME, np.uint64)))
    whole = np.add.reduceat(points * power[place], ends - sizes) if len(words) else points
    hashes, of = [whole], [np.arange(len(words))]
    for n in range(low, high + 1):
        at = np.flatnonzero(left >= n)
        value = np.full(len(at), n * 0x51ED270B, np.uint64)
        for k in range(n):
            value = value * _PRIME + points[at + k]
        hashes.append(value)
        of.append(word[at])
    mixed = np.concatenate(hashes)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), np.concatenate(of)


@dataclass
class LanguageModel:
    """Embeddings (buckets x dim), output weights (dim x classes), bias, and calibration."""

    langs: list[str]
    embed: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def folded(self) -> np.ndarray:
        """Each bucket's share of the logits: the mean of embeddings and the output layer
        are linear, so that words can be summed by their logits."""
        return (self.embed @ self.out).astype(np.float64)

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = (logits + self.bias) / self.temperature
        z = np.exp(z - z.max(-1, keepdims=True))
        return z / z.sum(-1, keepdims=True)


class _Features:
    """Of each text: the buckets that occur and their share of all its subwords, end to end
    in two arrays."""

    def __init__(self, texts: Iterable[str], buckets: int):
        kind = np.min_scalar_type(buckets)
        where, share, ends = [], [], [0]
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for text in texts:
            counts = Counter(words_of(text))
            n = 0
            if counts:
                grams, of = subwords(list(counts), buckets)
                found, back = np.unique(grams, return_inverse=True)
                weight = np.bincount(back, np.fromiter(counts.values(), np.float64, len(counts))[of])
                where.append(found.astype(kind))
                share.append((weight / weight.sum()).astype(np.float32))
                n = len(found)
            ends.append(ends[-1] + n)
            if len(where) >= 500:  # small arrays are put together now and then
                parts.append((np.concatenate(where), np.concatenate(share)))
                where, share = [], []
        parts.append((np.concatenate([np.zeros(0, kind), *where]), np.concatenate([np.zeros(0, np.float32), *share])))
        self.where, self.share = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        self.ends = np.array(ends)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        some = slice(self.ends[i], self.ends[i + 1])
        return self.where[some], self.share[some]


def train(texts: list[str], langs: list[str], buckets: int = 1 << 15, dim: int = 16, epochs: int = 6, rate: float = 0.1, batch: int = 32, reject: float = 0.001, seed: int = 7) -> LanguageModel:
    """Fit by stochastic gradient descent in numpy; a fifth of the rows calibrates.

    Steps are divided by the root of the squared gradients so far (of an embedding row, of
    an output weight), as a subword's gradient is as small as its share of the text. The
    temperature minimises the log loss on the calibration rows. The rejection
    threshold is half the ``reject`` quantile of the calibrated confidence of those of
    them that are classified rightly, so that about that share, or fewer, of documents in
    a known language is rejected. Texts without letters are not used. No row gives a
    model without languages, which answers ``und`` for all.
    """
    names = sorted(set(langs))
    code = {name: k for k, name in enumerate(names)}
    made = _Features(texts, buckets)
    rows = [i for i in range(len(langs)) if made.ends[i + 1] > made.ends[i]]
    gold_of = np.array([code[langs[i]] for i in rows], np.int64)
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out = rng.normal(0, 1 / np.sqrt(dim), (dim, len(names))).astype(np.float32)
    model = LanguageModel(names, embed, out, np.zeros(len(names)))
    if not rows:
        return model
    order = rng.permutation(len(rows))
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    prior = np.bincount(gold_of[fit], minlength=len(names))
    scale = len(fit) / np.maximum(prior, 1) / len(names)  # rare languages weigh as much
    seen_embed, seen_out = np.full(buckets, 1e-8, np.float32), np.full(out.shape, 1e-8, np.float32)
    for epoch in range(epochs):
        fit = rng.permutation(fit)
        slow = rate * (1 - epoch / epochs)
        for at in range(0, len(fit), batch):
            chosen = fit[at : at + batch]
            some = [made[rows[i]] for i in chosen]
            mean = np.stack([w @ embed[i] for i, w in some])
            grad = model.probabilities(mean @ out).astype(np.float32)
            gold = gold_of[chosen]
            grad[np.arange(len(some)), gold] -= 1
            grad *= (scale[gold] / len(some))[:, None].astype(np.float32)
            back = grad @ out.T
            step = mean.T @ grad
            seen_out += step**2
            out -= slow * step / np.sqrt(seen_out)
            model.bias -= slow * grad.sum(0)
            for (i, w), g in zip(some, back, strict=True):
                moved = np.outer(w, g)
                seen_embed[i] += (moved**2).mean(1)
                embed[i] -= slow * moved / np.sqrt(seen_embed[i])[:, None]
    if len(held) == 0:
        return model
    logits = np.stack([w @ (embed[i] @ out) for i, w in (made[rows[k]] for k in held)])
    gold = gold_of[held]

    soft = 1 / (len(gold) + 2)  # of the truth, as many rows without an error allow

    def loss(t: float) -> float:
        model.temperature = t
        p = np.log(np.maximum(model.probabilities(logits), 1e-300))
        return float(-((1 - soft) * p[np.arange(len(gold)), gold] + soft * p.mean(1)).mean())

    model.temperature = min((2.0**k for k in np.arange(-4, 4.01, 0.25)), key=loss)
    p = model.probabilities(logits)
    right = p.max(1)[p.argmax(1) == gold]
    model.threshold = float(np.quantile(right, reject) / 2) if len(right) else 0.0
    return model


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bound: int = 3000) -> DataFrame:
    """(text, lang) of about ``bound`` labelled documents that are not held out.

    The bound is shared out evenly over the languages; of each, documents are drawn by a
    hash of their id. The counts behind the shares cover all documents.
    """
    can = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    counts = {r[0]: r[1] for r in can.groupBy(lang_col).count().collect()}
    if not counts:
        return can.select(text_col, lang_col).limit(0)
    each = max(1, bound // len(counts))
    part = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, each / n)))])
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("langid")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return can.where(draw < part[F.col(lang_col)]).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id's text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bound: int = 3000, **how) -> LanguageModel:
    """Train on ``training_rows``. They come to the driver: the bound is a parameter."""
    rows = training_rows(docs, id_col, text_col, lang_col, bound).orderBy(F.xxhash64("text"), "text", "lang").collect()
    model = train([r[0] for r in rows], [r[1] for r in rows], **how)
    del rows
    release(docs.sparkSession)
    trim_memory()
    return model


def _word_sums(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Per word the sum of its subwords' logits and, last, the number of subwords."""
    grams, of = subwords(words, len(weights))
    sums = [np.bincount(of, weights[grams, k], len(words)) for k in range(weights.shape[1])]
    return np.stack([*sums, np.bincount(of, minlength=len(words))], 1)


def _logits(texts: list[str | None], weights: np.ndarray, cache: tuple[dict[str, int], list[np.ndarray]], most: int = _CACHE_WORDS):
    """Per text the mean logits over its subwords, or None without letters. ``cache``
    holds the sums of up to ``most`` words; others are summed anew for each call."""
    index, sums = cache
    found = [words_of(t) if t else [] for t in texts]
    fresh = list(dict.fromkeys(w for words in found for w in words if w not in index))
    now, rows = index, sums[0]
    if fresh:
        added = _word_sums(fresh, weights)
        n = len(index)
        if n + len(fresh) <= most:
            while n + len(fresh) > len(sums[0]):
                sums[0] = np.concatenate([sums[0], np.zeros_like(sums[0])])
            sums[0][n : n + len(fresh)] = added
            index.update(zip(fresh, range(n, n + len(fresh)), strict=True))
            rows = sums[0]
        else:
            now = dict(zip(fresh, range(n, n + len(fresh)), strict=True))
            rows = np.concatenate([sums[0][:n], added])
    for words in found:
        if not words:
            yield None
            continue
        ids = [index[w] if w in index else now[w] for w in words] if now is not index else [index[w] for w in words]
        total = rows[ids].sum(0)
        yield total[:-1] / total[-1]


def predict_column(text: Column | str, model: LanguageModel) -> Column:
    """struct(lang, score, rejected) of each whole text.

    ``lang`` is a learned language, or ``und`` with score 0 where the text is null or has
    no letter; ``score`` is the calibrated probability; ``rejected`` holds for ``und`` and
    where the score is under the model's threshold. Empty texts count as without letters.
    """
    weights = model.folded()

    @pandas_udf("lang string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        cache = worker_cache(("langid", zlib.crc32(weights.tobytes())), lambda: ({}, [np.zeros((1024, weights.shape[1] + 1))]))
        rows = []
        values = texts.tolist()
        for logits in (x for at in range(0, len(values), 500) for x in _logits(values[at : at + 500], weights, cache)):
            if logits is None or not model.langs:
                rows.append((UNDETERMINED, 0.0, True))
                continue
            p = model.probabilities(logits)
            best = int(p.argmax())
            rows.append((model.langs[best], float(min(1.0, p[best])), bool(p[best] < model.threshold)))
        return pd.DataFrame(rows, columns=["lang", "score", "rejected"])

    return predict(text)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """``docs`` with a column ``out_col`` as of ``predict_column``; it gets underscores at its
    end where ``docs`` has such a column."""
    bound_batches(docs.sparkSession)
    (name,) = free_name(docs, out_col)
    return docs.withColumn(name, predict_column(F.col(text_col), model))
