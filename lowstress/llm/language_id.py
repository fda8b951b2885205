"""Language identification by string kernels: blended-spectrum presence, Nystroem landmarks, kernel ridge regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowstress.llm.sampling import per_class_sample

#: Hashed n-gram space, n-gram sizes (UTF-8 bytes), landmarks, ridge, and softmax sharpness of the score.
SPACE, SIZES, LANDMARKS, RIDGE, SHARP = 1 << 14, (1, 2, 3), 240, 1e-2, 6.0
#: Bounds of the fitting sample: documents per language, and the length of those it may hold.
SAMPLE_PER_LANG, SAMPLE_CHARS, SAMPLE_LANGS = 400, 20_000, 200
#: Documents of the whole sample; the driver holds SPACE floats for each (260 MB).
SAMPLE_TOTAL = 4000
UNDETERMINED = "und"
_PIECE = 1 << 20


def presence(texts: list[str | None]) -> np.ndarray:
    """A row of 0/1 for each text: which hashed n-grams of any of the sizes occur in the whole of it."""
    out = np.zeros((len(texts), SPACE), np.float32)
    for row, text in zip(out, texts, strict=True):
        raw = np.frombuffer((text or "").lower().encode(), np.uint8)
        for at in range(0, len(raw), _PIECE):  # long texts in pieces that overlap by the longest n-gram
            b = raw[at : at + _PIECE + max(SIZES) - 1].astype(np.uint32)
            for n in SIZES:
                if len(b) >= n:
                    h = b[: len(b) - n + 1].copy()
                    for j in range(1, n):
                        h = h * np.uint32(257) + b[j : len(b) - n + 1 + j]
                    row[((h * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(18)) & np.uint32(SPACE - 1)] = 1.0
    return out


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared n-grams over the geometric mean of the texts' n-gram counts."""
    na, nb = np.sqrt(np.maximum(a.sum(axis=1), 1)), np.sqrt(np.maximum(b.sum(axis=1), 1))
    return (a @ b.T) / na[:, None] / nb[None]


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # SPACE x languages: landmarks times their dual weights

    def decision(self, texts: list[str | None]) -> np.ndarray:
        """One value per text and language. The product with the landmarks and with the dual weights is
        one matrix product here, since (P L') A = P (L' A) for the presence rows P."""
        p = presence(texts)
        return (p @ self.weights) / np.sqrt(np.maximum(p.sum(axis=1), 1))[:, None]


def fit(texts: list[str], langs: list[str]) -> Model:
    """Landmarks are taken from each language in turn; one-versus-rest ridge regression on Nystroem features."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((SPACE, 0), np.float32))
    p = np.concatenate([presence(texts[i : i + 256]) for i in range(0, len(texts), 256)])
    y = np.array([[1.0 if x == n else -1.0 for n in names] for x in langs])
    where = {n: [i for i, x in enumerate(langs) if x == n] for n in names}
    picked = sorted(i for n in names for i in where[n][: max(1, LANDMARKS // len(names))])
    marks = p[picked]
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    phi = kernel(p, marks) @ whiten
    w = np.linalg.solve(phi.T @ phi + RIDGE * len(texts) * np.eye(phi.shape[1]), phi.T @ y)
    dual = (whiten @ w) / np.sqrt(np.maximum(marks.sum(axis=1), 1))[:, None]
    return Model(names, (marks.T @ dual).astype(np.float32))


def fit_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on at most SAMPLE_PER_LANG documents of each of the SAMPLE_LANGS most frequent languages, and SAMPLE_TOTAL in all.

    Rarer languages are not learned; of equally frequent ones the first by name are.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.length("text") <= SAMPLE_CHARS))
    sample = per_class_sample(rows, ["lang"], "id", SAMPLE_PER_LANG, SAMPLE_LANGS, SAMPLE_TOTAL).orderBy("lang", "id").toPandas()
    return fit(sample["text"].tolist(), sample["lang"].tolist())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row, from its whole text alone.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Ties between
    languages go to the first by name. A map without a shuffle; repeated ids stay, other columns are not
    read, an empty table gives no rows. The model is a fixed-size matrix.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).alias("text"))

    def predict(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                if model.langs:
                    f = model.decision(texts)
                    e = np.exp(SHARP * (f - f.max(axis=1, keepdims=True)))
                    best, score = f.argmax(axis=1), (e / e.sum(axis=1, keepdims=True)).max(axis=1)
                    got = [(model.langs[b], float(s)) if t is not None else (UNDETERMINED, 0.0) for t, b, s in zip(texts, best, score, strict=True)]
                else:
                    got = [(UNDETERMINED, 0.0)] * len(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["id", "lang_pred", "score"])

    return rows.mapInArrow(predict, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


__all__ = ["Model", "fit", "fit_on", "identify", "kernel", "presence"]
