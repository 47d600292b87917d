"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, everything else is one blank; n-grams of 1 to 3
characters are hashed into a fixed number of features.  Document frequencies come from
all rows that may be learned from; the weights are learned from a bounded sample
of them by follow-the-regularised-leader with L1 and L2 penalties, and a
temperature is fitted to a part of the sample that the weights did not see.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegraph.llm import words as W
from citegraph.llm.shared import by_value, release, small_batches, written

by_value(__name__)

FEATURES, GRAMS = 1 << 13, (1, 2, 3)
#: The bound of the training sample, over all languages.
MAX_TRAINING_ROWS = 4000
MAX_LANGUAGES = 1000
DF_TASKS = 8
UNKNOWN = "und"
_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """For each character of the basic plane its lower-case form if it is a letter, else 0; letters beyond it stay as they are."""
    if not _FOLD:
        _FOLD.append(np.array([ord(c.lower()) if (c := chr(i)).isalpha() and len(c.lower()) == 1 else i * c.isalpha() for i in range(1 << 16)], np.uint32))
    return _FOLD[0]


def counts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count) of the features present, ordered; and the number of letters of each text."""
    texts = len(at) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
    fold = _fold()
    folded = fold[np.minimum(points, 0xFFFF)]
    far = np.flatnonzero(points > 0xFFFF)
    if len(far):
        folded[far] = [p if chr(p).isalpha() else 0 for p in points[far].tolist()]
    text = np.repeat(np.arange(texts), np.diff(begins))
    letters = np.bincount(text, folded > 0, texts).astype(np.int64)
    keep = folded > 0
    keep[1:] |= (folded[:-1] > 0) & (text[1:] == text[:-1])  # one blank after each word
    folded, text = folded[keep].astype(np.uint64), text[keep]
    cell = []
    for n in GRAMS:
        if len(folded) < n:
            continue
        size = len(folded) - n + 1
        key = np.full(size, n, np.uint64)
        for i in range(n):
            key = key * np.uint64(0x100000001B3) + folded[i : i + size]
        same = text[:size] == text[n - 1 :] if n > 1 else folded > 0
        cell.append((text[:size] * FEATURES + (W.mix(key) >> np.uint64(51)).astype(np.int64))[same])
    flat = np.bincount(np.concatenate(cell), minlength=texts * FEATURES) if cell else np.zeros(0, np.int64)
    where = np.flatnonzero(flat)
    return where // FEATURES, where % FEATURES, flat[where], letters


def _pieces(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks of few enough texts for a dense table of counts."""
    for lo, hi, data, at in W.chunks(col):
        for a in range(lo, hi, 128):
            b = min(a + 128, hi)
            yield a, b, data[at[a - lo] : at[b - lo]], at[a - lo : b - lo + 1] - at[a - lo]


_SURVEY = pa.schema([("lang", pa.string()), ("spot", pa.float64()), ("n", pa.int64()), ("features", pa.binary()), ("counts", pa.binary())])


def _packed(features: np.ndarray, counts: np.ndarray) -> dict[str, bytes]:
    return {"features": features.astype("<u2").tobytes(), "counts": counts.astype("<i8").tobytes()}


def _survey(share: dict[str, float]):
    """One row for each task with document frequencies (no lang), and one for each row of the sample with its counts, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            langs, spots, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for lo, hi, data, at in _pieces(batch.column(2)):
                text, feature, count, letters = counts(data, at)
                df += np.bincount(feature, minlength=FEATURES)
                seen += hi - lo
                cut = np.searchsorted(text, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    if letters[i] and spots[lo + i] < share.get(langs[lo + i], 0):
                        a, b = cut[i], cut[i + 1]
                        out.append({"lang": langs[lo + i], "spot": spots[lo + i], "n": 1, **_packed(feature[a:b], count[a:b])})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_SURVEY)
        if seen:
            there = np.flatnonzero(df)
            yield pa.RecordBatch.from_pylist([{"lang": None, "spot": None, "n": seen, **_packed(there, df[there])}], schema=_SURVEY)

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The document frequencies of all rows of a task as one row."""
    df, seen = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        seen += sum(batch.column("n").to_pylist())
        for f, c in zip(batch.column("features"), batch.column("counts"), strict=True):
            df[np.frombuffer(f.as_py(), "<u2")] += np.frombuffer(c.as_py(), "<i8")
    there = np.flatnonzero(df)
    yield pa.RecordBatch.from_pylist([{"lang": None, "spot": None, "n": seen, **_packed(there, df[there])}], schema=_SURVEY)


@dataclasses.dataclass
class Model:
    """langs, idf by feature, weights (features x langs), bias and temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, text: np.ndarray, feature: np.ndarray, count: np.ndarray, texts: int) -> np.ndarray:
        value = (1 + np.log(count)) * self.idf[feature]
        norm = np.sqrt(np.bincount(text, value * value, texts))
        norm[norm == 0] = 1
        sums = [np.bincount(text, value * self.weights[feature, k], texts) / norm for k in range(len(self.langs))]
        return np.stack(sums, 1) + self.bias if sums else np.zeros((texts, 0))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], langs: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal; rows are (features, values, class). The bias is a last feature without L1."""
    z, n = np.zeros((FEATURES + 1, langs)), np.zeros((FEATURES + 1, langs))

    def weigh(z, n, penalty):
        return np.where(np.abs(z) <= penalty, 0.0, -(z - np.sign(z) * penalty) / ((beta + np.sqrt(n)) / alpha + l2))

    penalty = np.full(FEATURES + 1, l1)
    penalty[-1] = 0
    for _ in range(epochs):
        for features, values, label in rows:
            f, v = np.append(features, FEATURES), np.append(values, 1.0)
            w = weigh(z[f], n[f], penalty[f, None])
            p = _softmax(v @ w)
            p[label] -= 1
            g = v[:, None] * p
            more = n[f] + g * g
            z[f] += g - (np.sqrt(more) - np.sqrt(n[f])) / alpha * w
            n[f] = more
    w = weigh(z, n, penalty[:, None])
    return w[:-1], w[-1]


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean())

    a, b, g = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """A model from the rows of `docs` (doc_id, text, lang) with a lang and a text; what the caller holds out must not be among them.

    Document frequencies are counted over all these rows.  About `max_rows` rows and never more than
    twice as many, as many of each language as there are, chosen by a hash of
    doc_id and text, train the weights; every seventh of them the temperature
    alone.  Repeated rows and ties of the hash are rows like any other.  Without rows
    the model knows no language; more than MAX_LANGUAGES of them are an error, as the
    model has FEATURES weights for each.
    """
    # Repeated rows and copies of one document fall together, so a hash below a share takes them all; the bound below holds anyhow.
    spot = (F.xxhash64("doc_id", F.length("text")).cast("double") / 2.0**64) + 0.5
    rows = small_batches(docs).filter("lang is not null and text is not null")
    totals = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    each = max_rows / max(1, len(totals))
    share = {lang: min(1.0, each / n) for lang, n in totals.items()}
    kind = "lang string, spot double, n long, features binary, counts binary"
    seen = written(rows.select("lang", spot.alias("spot"), "text").mapInArrow(_survey(share), kind), "langid")
    # Each task leaves one row of at most FEATURES numbers; they are added up in tasks again before the last few come here.
    frequencies = seen.filter("lang is null").repartition(DF_TASKS).mapInArrow(_add_up, kind).toArrow()
    idf, total = np.zeros(FEATURES), sum(frequencies["n"].to_pylist())
    for f, c in zip(frequencies["features"], frequencies["counts"], strict=True):
        idf[np.frombuffer(f.as_py(), "<u2")] += np.frombuffer(c.as_py(), "<i8")
    idf = np.log((1 + total) / (1 + idf)) + 1
    # Packed numbers in Arrow buffers: the driver holds the sample once, some 3 kB a row.
    sample = seen.filter("lang is not null").orderBy("spot", "lang", "features", "counts").limit(2 * max_rows).select("lang", "features", "counts").toArrow()
    langs = sorted(totals)
    fitted, unseen = [], []
    for i in range(sample.num_rows):
        f, c = np.frombuffer(sample["features"][i].as_py(), "<u2").astype(np.int32), np.frombuffer(sample["counts"][i].as_py(), "<i8")
        v = (1 + np.log(c)) * idf[f]
        (fitted if i % 7 else unseen).append((f, (v / np.sqrt((v * v).sum())).astype(np.float32), langs.index(sample["lang"][i].as_py())))
    del sample
    release(seen)
    weights, bias = fit_ftrl(fitted, len(langs)) if langs else (np.zeros((FEATURES, 0)), np.zeros(0))
    logits = np.array([v @ weights[f] + bias for f, v, _ in unseen]).reshape(len(unseen), len(langs))
    return Model(langs, idf, weights, bias, _temperature(logits, np.array([k for *_, k in unseen], int)))


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [np.empty(0, object)], [np.empty(0)]
            for lo, hi, data, at in _pieces(batch.column(batch.num_columns - 1)):
                text, feature, count, letters = counts(data, at)
                lang, score = np.full(hi - lo, UNKNOWN, object), np.zeros(hi - lo)
                some = np.flatnonzero(letters > 0)
                if len(some) and model.langs:
                    p = _softmax(model.logits(text, feature, count, hi - lo)[some] / model.temperature)
                    best = p.argmax(1)
                    lang[some], score[some] = np.array(model.langs, object)[best], p[np.arange(len(some)), best]
                langs.append(lang)
                scores.append(score)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate(langs), pa.string()), pa.array(np.concatenate(scores))], [f"c{i}" for i in range(len(kept) + 2)])

    return run


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns `keep` of `docs` with lang_pred and score (calibrated probability) of each whole text; two columns of those names in `keep` are an error.

    A text that is null or has no letter, and every text if the model knows no
    language, is `und` with score 0.  Ties go to the language first by code point.
    Repeated rows are judged alike; an empty table gives an empty one.
    """
    if {"lang_pred", "score"} & set(keep):
        raise ValueError("lang_pred and score are columns of the result")
    judged = _judged(docs, model, *keep)
    return judged.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col(f"c{len(keep)}").alias("lang_pred"), F.col(f"c{len(keep) + 1}").alias("score"))


def _judged(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """`keep` as c0, c1, ..., then the language and the score."""
    kept = small_batches(docs).select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.coalesce("text", F.lit("")).alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(_predict(model), f"{schema}, c{len(keep)} string, c{len(keep) + 1} double")


def confident(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of `docs`, with all their columns whatever their names, whose text has a language of at least `least`; if the model knows none, those with a letter."""
    if not model.langs:
        return docs.filter(F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"\p{L}")))
    n = len(docs.columns)
    judged = _judged(docs, model, *docs.columns).filter((F.col(f"c{n}") != UNKNOWN) & (F.col(f"c{n + 1}") >= least))
    return judged.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def held_out() -> Column:
    """Whether crc32 of the doc_id as text leaves 0 by 5; a row without a doc_id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(True))
