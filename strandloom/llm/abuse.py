"""Abusive, hateful and sexual content by a convolutional text classifier, trained in NumPy.

Words are undisguised (look-alike letters, digits for letters, inserted signs, stretched or spaced letters), each word is
the sum of hashed embeddings of its form, its head and its consonants; filters of several widths slide over them, the
greatest response of each filter over the whole text is kept, and a logistic layer weighs those. Thresholds are
calibrated by language on folds that the models had not seen.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.labels import stripped
from strandloom.runtime import spread

#: Letters of other scripts and signs that stand for Latin letters.
LOOK_ALIKE = dict(zip("аеорсухіјѕԁһкмтвнгпвαεορτυνκιβꞵɡıƒ", "aeopcyxijsdhkmtbhrnbaeoptuvkibbgif", strict=True))
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}
VERDICTS = {"clean": 0.0, "abusive": 1.0, "hateful": 1.0, "sexual": 1.0}

_INVISIBLE = re.compile("[­͏؜ᅟ᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_TAG = re.compile(r"<[^<>]{1,40}>")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!*])(?:[ .\-_·*]{1,2}(?:[^\W_]|[@$!])(?![^\W_])){2,}")
_WORD = re.compile(r"[^\W_](?:[^\W_]|[@$€*]|!(?=\w)|['’](?=[^\W\d_]))*|[@$!](?=[^\W\d_])(?:[^\W_]|[@$€*]|!(?=\w))+")
_RUN = re.compile(r"(.)\1+")
_MANGLED = re.compile("[ÃÂâ][\u0080-¿‘-™]")


def _repaired(text: str) -> str:
    """Text that was UTF-8 read as a one-byte code page, read again; unchanged where that fails."""
    if _MANGLED.search(text):
        for page in ("cp1252", "latin-1"):
            try:
                return text.encode(page).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                pass
        return _MANGLED.sub("", text)
    return text


def _plain(word: str) -> str:
    """A word without disguise; numbers become ``#``, names with three or more digits ``id``, long runs of bases ``dna``."""
    if not any(c.isalpha() for c in word):
        return "#"
    digits = sum(c.isdigit() for c in word)
    if digits:
        if digits >= 3 and word[-1].isdigit() or digits > len(word) // 2 and len(word) > 3:
            return "id"
        word = "".join(LEET.get(c, c) for c in word)
    else:
        word = "".join(LEET.get(c, c) if not c.isalpha() else c for c in word) if not word.isalpha() else word
    if len(word) > 24:
        return "dna"
    return _RUN.sub(r"\1", word)


def words(text: str | None) -> list[str]:
    """The undisguised words of a text, in order; null and empty texts have none."""
    if not text:
        return []
    text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", _repaired(text)))
    text = _TAG.sub(" ", text).lower()
    if not text.isascii():
        text = "".join(LOOK_ALIKE.get(c, c) for c in text)
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    text = _SPACED.sub(lambda m: re.sub(r"[ .\-_·]", "", m.group()), text)
    return [_plain(w) for w in _WORD.findall(text)]


def _hash(text: str, seed: int) -> int:
    h = 2166136261 ^ (seed * 0x9E3779B1 & 0xFFFFFFFF)
    for b in text.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h ^ (h >> 15)


class Features:
    """Words to rows of bucket numbers, with a bounded memo; buckets that are not ``known`` are blank."""

    def __init__(self, buckets: int, known: np.ndarray | None = None):
        self.buckets, self.known, self.memo = buckets, known, {}

    def of(self, word: str) -> tuple[int, int, int]:
        got = self.memo.get(word)
        if got is None:
            masked = "*" in word
            bones = re.sub(r"[aeiouyvw]", "", word.replace("*", "")) or word
            head = word[0] + "*" + word[-1] + str(len(word)) if masked else word[:5]
            got = tuple(_hash(x, i) % self.buckets for i, x in enumerate((word, head, bones[:6]), 1))
            if self.known is not None:
                got = tuple(b if self.known[b] else -1 for b in got)
            if len(self.memo) < 500_000:
                self.memo[word] = got
        return got

    def rows(self, texts: list[list[str]], pad: int) -> tuple[np.ndarray, np.ndarray]:
        """All words of the texts, ``pad`` blanks (-1) before each text and after the last; and where each text starts."""
        out: list[tuple[int, int, int]] = []
        starts = []
        blank = [(-1, -1, -1)] * pad
        for t in texts:
            out += blank
            starts.append(len(out))
            out += [self.of(w) for w in t] or blank[:1]
        out += blank
        return np.array(out, np.int64).reshape(-1, 3), np.array(starts, np.int64)


@dataclass
class Model:
    """Weights of one network; ``widths`` filters of each width."""

    table: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    widths: tuple[int, ...] = field(default=(1, 2, 3, 5))
    known: np.ndarray | None = None

    def features(self) -> Features:
        return Features(len(self.table) - 1, self.known)

    @classmethod
    def fresh(cls, rng: np.random.Generator, buckets: int, size: int, count: int, widths: tuple[int, ...]) -> Model:
        table = rng.normal(0, 0.3, (buckets + 1, size)).astype(np.float32)
        table[-1] = 0
        filters = [rng.normal(0, 1 / np.sqrt(w * size), (w * size, count)).astype(np.float32) for w in widths]
        return cls(table, filters, [np.zeros(count, np.float32) for _ in widths], rng.normal(0, 0.1, count * len(widths)).astype(np.float32), -1.0, widths)

    def embedded(self, rows: np.ndarray) -> np.ndarray:
        return self.table[rows[:, 0]] + self.table[rows[:, 1]] + self.table[rows[:, 2]]

    def pooled(self, rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Per text: the greatest response of every filter, and where it was."""
        x = self.embedded(rows)
        ends = np.append(starts[1:] - max(self.widths), len(rows) - max(self.widths))
        values, places = [], []
        for w, f, b in zip(self.widths, self.filters, self.biases, strict=True):
            n = len(x) - w + 1
            out = x[:n] @ f[: x.shape[1]]
            for j in range(1, w):
                out += x[j : n + j] @ f[j * x.shape[1] : (j + 1) * x.shape[1]]
            out += b
            best = np.empty((len(starts), f.shape[1]), np.int64)
            top = np.empty((len(starts), f.shape[1]), np.float32)
            for i, (s, e) in enumerate(zip(starts, ends, strict=True)):
                # windows that hold at least one word of the text
                a = max(0, s - w + 1)
                part = out[a : min(e, n)]
                k = part.argmax(0)
                best[i] = a + k
                top[i] = part[k, np.arange(f.shape[1])]
            values.append(np.maximum(top, 0))
            places.append(best)
        return np.concatenate(values, 1), places

    def score(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        pooled, _ = self.pooled(rows, starts)
        return 1 / (1 + np.exp(-np.clip(pooled @ self.weights + self.bias, -30, 30)))


def train(texts: list[list[str]], target: np.ndarray, weight: np.ndarray, seed: int, epochs: int = 14, buckets: int = 1 << 15, size: int = 24, count: int = 24, widths: tuple[int, ...] = (1, 2, 3, 5), rate: float = 0.004, keep: float = 0.7, least: int = 1) -> Model:
    """A network fitted by Adam with dropout on the pooled responses; the same input and seed give the same network."""
    rng = np.random.default_rng(seed)
    model = Model.fresh(rng, buckets, size, count, widths)
    pad = max(widths)
    # what only one text has tells nothing about others: names, typing errors
    seen = np.zeros(buckets, np.int64)
    for t in texts:
        rows, _ = Features(buckets).rows([t], 0)
        own = np.unique(rows)
        seen[own[own >= 0]] += 1
    model.known = seen >= least
    features = model.features()
    shapes = [model.table, *model.filters, *model.biases, model.weights]
    first, second = [np.zeros_like(p) for p in shapes], [np.zeros_like(p) for p in shapes]
    bias_m = bias_v = 0.0
    step = 0
    positive = max(1.0, float((target * weight).sum()))
    scale = min(4.0, float(((1 - target) * weight).sum()) / positive)
    encoded = [features.rows([t], pad) for t in texts]
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        order = rng.permutation(len(texts))
        for low in range(0, len(order), 32):
            some = order[low : low + 32]
            parts = [encoded[i][0][:-pad] for i in some]
            sizes = np.array([len(p) for p in parts])
            rows = np.concatenate([*parts, np.full((pad, 3), -1)])
            starts = np.cumsum(sizes) - sizes + pad
            pooled, places = model.pooled(rows, starts)
            drop = (rng.random(pooled.shape) < keep).astype(np.float32) / keep
            fed = pooled * drop
            p = 1 / (1 + np.exp(-np.clip(fed @ model.weights + model.bias, -30, 30)))
            y, w = target[some], weight[some] * np.where(target[some] > 0.5, scale, 1.0)
            delta = ((p - y) * w / len(some)).astype(np.float32)
            grads: list = [None] * len(shapes)
            grads[-1] = fed.T @ delta + 1e-4 * model.weights
            back = delta[:, None] * model.weights[None, :] * drop * (pooled > 0)
            x = model.embedded(rows)
            table_grad = np.zeros_like(x)
            at = 0
            for k, width in enumerate(widths):
                g = back[:, at : at + count]
                at += count
                grad_f = np.zeros_like(model.filters[k])
                for j in range(width):
                    q = places[k] + j
                    piece = model.filters[k][j * size : (j + 1) * size]
                    grad_f[j * size : (j + 1) * size] = np.einsum("bfd,bf->df", x[q], g)
                    np.add.at(table_grad, q.reshape(-1), (g[:, :, None] * piece.T[None]).reshape(-1, size))
                grads[1 + k] = grad_f
                grads[1 + len(widths) + k] = g.sum(0)
            touched = np.flatnonzero(np.abs(table_grad).sum(1))
            index = rows[touched].reshape(-1)
            values = np.repeat(table_grad[touched], 3, 0)
            index, values = index[index >= 0], values[index >= 0]
            step += 1
            c1, c2 = 1 - 0.9**step, 1 - 0.99**step
            ids, inverse = np.unique(index, return_inverse=True)
            own = np.zeros((len(ids), size), np.float32)
            np.add.at(own, inverse, values)
            for k, (value, m, v) in enumerate(zip(shapes, first, second, strict=True)):
                if k == 0:
                    m[ids] = 0.9 * m[ids] + 0.1 * own
                    v[ids] = 0.99 * v[ids] + 0.01 * own**2
                    value[ids] -= lr * (m[ids] / c1) / (np.sqrt(v[ids] / c2) + 1e-7)
                else:
                    m *= 0.9
                    m += 0.1 * grads[k]
                    v *= 0.99
                    v += 0.01 * grads[k] ** 2
                    value -= lr * (m / c1) / (np.sqrt(v / c2) + 1e-7)
            g = float(delta.sum())
            bias_m, bias_v = 0.9 * bias_m + 0.1 * g, 0.99 * bias_v + 0.01 * g * g
            model.bias -= lr * (bias_m / c1) / (np.sqrt(bias_v / c2) + 1e-7)
    return model


def scores(models: list[Model], texts: list[list[str]], features: list[Features], together: int = 20_000) -> np.ndarray:
    """The mean score of the models for each text, a bounded number of words at a time; a text without words scores 0."""
    out = np.zeros(len(texts))
    low = 0
    while low < len(texts):
        high, n = low, 0
        while high < len(texts) and (n == 0 or n + len(texts[high]) <= together):
            n += len(texts[high])
            high += 1
        out[low:high] = np.mean([m.score(*f.rows(texts[low:high], max(m.widths))) for m, f in zip(models, features, strict=True)], 0)
        low = high
    out[[not t for t in texts]] = 0.0
    return out


def _best_threshold(p: np.ndarray, y: np.ndarray, w: np.ndarray, default: float) -> float:
    """The threshold of the best F1, the middle of the gap it lies in; ``default`` if there is nothing to tell apart."""
    if len(p) == 0 or y.sum() < 5 or y.sum() == len(y):
        return default
    order = np.argsort(-p, kind="stable")
    p, y, w = p[order], y[order], w[order]
    hit = np.cumsum(y * w)
    f1 = 2 * hit / (np.cumsum(w) + (y * w).sum())
    f1[:-1][p[:-1] == p[1:]] = -1
    k = int(f1.argmax())
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0.0)) / 2)


def normal_language(c):
    """Two lower-case letters; everything else is ``und``."""
    s = F.lower(F.substring(stripped(c), 1, 2))
    return F.when(s.rlike("^[a-z]{2}$") & ~F.lower(stripped(c)).isin("und", "mul", "zxx"), s).otherwise(F.lit("und"))


@dataclass
class Classifier:
    models: list[Model]
    thresholds: dict[str, float]
    threshold: float


def _one_fold(sample: tuple, fold: np.ndarray, k: int, seed: int, epochs: int) -> tuple[Model, np.ndarray]:
    """A network trained on all folds but ``k`` and the background, and its scores of fold ``k``."""
    texts, target, weight, usual = sample
    inside, out = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
    more = np.zeros(len(usual), np.float32)
    own = inside if len(inside) else out
    model = train([texts[i] for i in own] + usual, np.concatenate([target[own], more]), np.concatenate([weight[own], more + 0.25]), seed + k, epochs)
    return model, scores([model], [texts[i] for i in out], [model.features()]) if len(out) else np.zeros(0)


def _crossed(sample: tuple, fold: np.ndarray, folds: int, seed: int, epochs: int, spark: SparkSession | None) -> tuple[list[Model], np.ndarray]:
    """One network per fold and every text's score by the one that had not seen it; each fold is a task of its own.

    The sample is bounded, and so are the networks that come back, a few MB each.
    """
    if spark is None:
        done = {k: _one_fold(sample, fold, k, seed, epochs) for k in range(folds)}
    else:
        sent = spark.sparkContext.broadcast((sample, fold))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    got = _one_fold(*sent.value, k, seed, epochs)
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([pickle.dumps(got)], pa.binary())], names=["k", "got"])

        rows = spark.range(0, folds, 1, folds).mapInArrow(run, "k bigint, got binary").collect()
        done = {r["k"]: pickle.loads(bytes(r["got"])) for r in rows}
    held = np.zeros(len(sample[0]))
    for k, (_, p) in done.items():
        held[fold == k] = p
    return [done[k][0] for k in range(folds)], held


def fit(labelled: list[tuple[str, str, float, float]], background: list[str] = (), folds: int = 4, seed: int = 7, doubt: float = 0.85, spark: SparkSession | None = None) -> Classifier:
    """Networks, one per fold, and thresholds by language from the rows each had not seen.

    ``labelled``: (text, language, target, weight). Repeats of a text stay in one fold. ``background`` texts, of which
    few are cases, count as clean with little weight; they show what is usual and take no part in the calibration.
    With a session the folds are trained side by side on its executors.
    """
    texts = [words(t) for t, _, _, _ in labelled]
    usual = [words(t) for t in background]
    target = np.array([y for _, _, y, _ in labelled], np.float32)
    weight = np.array([w for _, _, _, w in labelled], np.float32)
    fold = np.array([_hash(" ".join(t), seed) for t in texts])
    # some reviews are wrong: what models that had not seen a text firmly contradict weighs little from then on
    _, held = _crossed((texts, target, weight, usual), fold % 3, 3, seed + 100, 9, spark)
    weight = np.where(np.abs(held - target) > doubt, 0.1 * weight, weight).astype(np.float32)
    models, held = _crossed((texts, target, weight, usual), fold % folds, folds, seed, 14, spark)
    language = np.array([g for _, g, _, _ in labelled])
    hard = (target > 0.5).astype(float)
    overall = _best_threshold(held, hard, weight, 0.5)
    own = {}
    for g in sorted(set(language.tolist())):
        at = language == g
        n = float(hard[at].sum())
        # a language with few cases keeps close to the threshold of all
        own[g] = (n * _best_threshold(held[at], hard[at], weight[at], overall) + 30 * overall) / (n + 30)
    return Classifier(models, own, overall)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, verdict_col: str, most: int) -> list[tuple[str, str, float, float]]:
    """At most ``most`` reviewed documents, chosen by hash: the mean of their verdicts, weighed by how far they agree."""
    verdict = F.lower(stripped(F.col(verdict_col)))
    value = F.lit(None).cast("double")
    for name, y in VERDICTS.items():
        value = F.when(verdict == name, y).otherwise(value)
    votes = labels.select(F.col(id_col).alias("__id"), value.alias("__y")).where("__y is not null and __id is not null").groupBy("__id").agg(F.avg("__y").alias("__y"), F.count("*").alias("__n"))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), normal_language(F.col(lang_col)).alias("__lang")).where("length(__text) > 0")
    rows = texts.join(votes, "__id").orderBy(F.xxhash64("__id")).limit(most).collect()
    out = []
    for r in sorted(rows, key=lambda r: r["__id"]):
        y = float(r["__y"] >= 0.5)
        w = 0.35 if r["__y"] == 0.5 else 1.0 if r["__n"] > 1 else 0.8
        out.append((r["__text"], r["__lang"], y, w))
    return out


def background_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int) -> list[str]:
    """At most ``most`` texts of documents that nobody reviewed, chosen by hash."""
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where("length(__text) > 0 and __id is not null")
    rest = texts.join(labels.select(F.col(id_col).alias("__id")), "__id", "left_anti")
    return [r["__text"] for r in rest.orderBy(F.xxhash64(F.lit(1), "__id")).limit(most).collect()]


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", verdict_col: str = "verdict", most: int = 8_000, background: int = 1_000) -> DataFrame:
    """(id, source, lang, score, flagged) for every document.

    The classifier is fitted on at most ``most`` reviewed documents (``labels`` has ``id_col`` and ``verdict_col``) and
    ``background`` others, samples by hash; all documents are scored over their whole texts. Null, empty and wordless texts score 0 and are not flagged, as is
    everything if no document is reviewed or all reviews agree. Verdicts are compared without case and surrounding
    white space; null and unknown ones are ignored. Repeated ids keep their rows.
    """
    known = labelled_sample(docs, labels, id_col, text_col, lang_col, verdict_col, most)
    found = fit(known, background_sample(docs, labels, id_col, text_col, background), spark=docs.sparkSession) if len({y for _, _, y, _ in known}) > 1 else None
    sent = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        features = [m.features() for m in own.models] if own else []
        for batch in batches:
            lang = batch.column(3).to_pylist()
            for low in range(0, batch.num_rows, 2000):
                texts = batch.column(1).slice(low, 2000).to_pylist()
                p = scores(own.models, [words(t) for t in texts], features) if own else np.zeros(len(texts))
                limit = np.array([own.thresholds.get(g, own.threshold) if own else 1.0 for g in lang[low : low + 2000]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, 2000), batch.column(2).slice(low, 2000), batch.column(3).slice(low, 2000), pa.array(p), pa.array((p > limit) & (p > 0))],
                    names=["id", "source", "lang", "score", "flagged"],
                )

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.lower(stripped(F.col(source_col))).alias("source"), normal_language(F.col(lang_col)).alias("lang"))
    return spread(rows).mapInArrow(run, "id bigint, source string, lang string, score double, flagged boolean")


def rate_report(scored: DataFrame) -> DataFrame:
    """(source, documents, flagged, rate, mean_score); source null is a group of its own."""
    return scored.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("flagged").alias("flagged"), F.avg(F.col("flagged").cast("int")).alias("rate"), F.avg("score").alias("mean_score"))
