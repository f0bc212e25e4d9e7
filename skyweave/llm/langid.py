"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, trained by FTRL-proximal, calibrated by a temperature."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, whole_row

#: Character n-grams of 1 to 3 code points are hashed to so many features.
FEATURES = 1 << 14
_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], dtype=np.uint32)
#: Code points above this are hashed like any other, without a table.
_SPACE = 32


def grams(text: str) -> np.ndarray:
    """Features of all n-grams of a text. White space and digits of any kind count as one blank, letters are lower-cased."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = np.where((code < 65) | (code == 160), np.uint32(_SPACE), code)
    out = []
    for n in (1, 2, 3):
        if len(code) >= n:
            h = np.full(len(code) - n + 1, n * 0x51ED27 + 1, dtype=np.uint32)
            for k in range(n):
                h ^= code[k : len(code) - n + 1 + k] * _MIX[k]
                h *= np.uint32(0x2C1B3C6D)
            out.append(h >> np.uint32(32 - 14))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text)) if not text.isascii() else any(c.isalpha() for c in text[:64]) or any(map(str.isalpha, text[64:]))


def _counts(text: str) -> np.ndarray:
    return np.bincount(grams(text), minlength=FEATURES)


def _weighted(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of length one; term frequencies are damped, so a long text is no other than a short one."""
    x = np.sqrt(count) * idf
    return x / max(float(np.linalg.norm(x)), 1e-12)


@dataclass(frozen=True)
class LanguageModel:
    """languages, idf (FEATURES), weights (FEATURES + 1 for the bias, languages), temperature."""

    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        count = _counts(text)
        on = np.flatnonzero(count)
        x = _weighted(count[on], self.idf[on])
        return x @ self.weights[on] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return "und", 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        return self.languages[int(p.argmax())], float(p.max())


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], n_languages: int, *, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> np.ndarray:
    """FTRL-proximal over (features, values, class) rows: per-coordinate rates, L1 zeroes weak features, L2 shrinks the rest."""
    z, n = np.zeros((FEATURES + 1, n_languages)), np.zeros((FEATURES + 1, n_languages))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            on, value, label = rows[k]
            on, value = np.append(on, FEATURES), np.append(value, 1.0)
            zs, ns = z[on], n[on]
            w = weights(zs, ns)
            s = value @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1
            g = value[:, None] * p[None, :]
            sigma = (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha
            z[on] = zs + g - sigma * w
            n[on] = ns + g * g
    return weights(z, n)


def temperature_of(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature, 0.05 to 20, of least log loss on rows kept out of training: golden-section search over its logarithm."""

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]))

    if not len(labels):
        return 1.0
    low, high, gold = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - gold * (high - low), low + gold * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(doc_id: Column) -> Column:
    """Documents kept for testing: crc32 of doc_id as text is a multiple of five. A null doc_id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each feature occurs, over all rows, and the number of rows. FEATURES rows at most go to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total[:FEATURES] += _counts(text or "") > 0
                total[FEATURES] += 1
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int64()), pa.array(total[on], pa.int64())], ["feature", "n"])

    rows = docs.select("text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(FEATURES + 1, dtype=np.int64)
    for r in rows:
        out[r["feature"]] = r["n"]
    return out[:FEATURES], int(out[FEATURES])


def _first(rows: list[tuple[str, tuple]], n: int) -> list[tuple]:
    """Of (language, row) the n smallest rows of each language, in order."""
    of: dict[str, list[tuple]] = {}
    for lang, row in rows:
        of.setdefault(lang, []).append(row)
    return sorted(x for own in of.values() for x in sorted(own)[:n])


def fit_languages(docs: DataFrame, *, most_each: int = 750, seed: int = 0) -> LanguageModel:
    """Learn from text and lang of the documents that have both and are not held out.

    The IDF counts all of them. Weights and temperature are fitted on a bounded sample: of each language most_each rows, those of the
    smallest hashes of doc_id and text, so that a rare language is learned too; rows repeated in full count once; it goes to the driver as features, FEATURES at most for each text. Every fifth row of
    a language only sets the temperature, so that no language of few rows goes without learning. Whole texts are used. No rows, or one language alone, give a model that predicts nothing, or that language.
    """
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    known = known.withColumn("place", F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 11) / float(2**53))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(np.flatnonzero(c), c) for c in (_counts(t) for t in batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([on.astype("<u2").tobytes() for on, _ in kept], pa.binary()), pa.array([c[on].astype("<u4").tobytes() for on, c in kept], pa.binary()), batch.column(2)],
                ["place", "features", "counts", "lang"])

    # of distinct rows, to 2 %: repeated ones would make the share that is wanted look smaller than it is
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("place", 0.02).alias("n")).collect()}
    rows = []
    with small_batches(docs.sparkSession):
        frequency, n_docs = document_frequencies(known)
        if sizes:
            # hashes below twice the share that is wanted leave about 2 * most_each distinct rows of each language; half of that would do
            cut = F.element_at(F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, 2.0 * most_each / n)]), F.col("lang"))
            likely = known.select("place", "lang").where(F.col("place") < cut).distinct().collect()
            places = _first([(r["lang"], (r["place"], r["lang"])) for r in likely], most_each)
            chosen = docs.sparkSession.createDataFrame(places, known.select("place", "lang").schema)
            drawn = known.join(F.broadcast(chosen), ["place", "lang"], "left_semi").select("place", "text", "lang").mapInArrow(counted, "place double, features binary, counts binary, lang string")
            found = [(r["lang"], (r["place"], bytes(r["features"]), bytes(r["counts"]), r["lang"])) for r in drawn.distinct().collect()]
            rows = sorted(_first(found, most_each))
    idf = np.where(frequency > 0, np.log((n_docs + 1) / (frequency + 1)) + 1, 0.0)
    languages = tuple(sorted({r[3] for r in rows}))
    data = []
    for _, features, counts, lang in rows:
        on = np.frombuffer(features, dtype="<u2").astype(np.int64)
        data.append((on, _weighted(np.frombuffer(counts, dtype="<u4"), idf[on]), languages.index(lang)))
    seen: Counter[str] = Counter()
    nth = [(seen.update([lang]), seen[lang] - 1)[1] for *_, lang in rows]
    fit, rest = [x for k, x in zip(nth, data) if k % 5 < 4], [x for k, x in zip(nth, data) if k % 5 == 4]
    weights = train(fit, len(languages)) if languages else np.zeros((FEATURES + 1, 0))
    logits = np.array([x @ weights[on] + weights[-1] for on, x, _ in rest])
    return LanguageModel(languages, idf, weights, temperature_of(logits, np.array([y for *_, y in rest])))


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred and score (the calibrated probability of lang_pred).

    und with score 0 where the text is null or holds no letter. Repeated rows get the same; an empty table gives an empty one; a
    column of docs called lang_pred or score is replaced. lang, source and doc_id are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of FEATURES * languages numbers

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts):
        import pandas as pd

        return pd.DataFrame([shared.value.predict(t if isinstance(t, str) else None) for t in texts], columns=["lang_pred", "score"])

    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(whole_row(docs).alias("row"), predicted("text").alias("found")).select(*own, "found.lang_pred", "found.score")


def fold(doc_id: int) -> int:
    """The remainder that decides whether a document is held out (0), for tests."""
    return zlib.crc32(str(doc_id).encode()) % 5
