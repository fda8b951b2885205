"""Toxicity: a convolutional text classifier on hashed word embeddings, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowstress.llm.blocks import lean
from lowstress.llm import text as T
from lowstress.llm.sampling import crc_mod, per_class_sample

#: Embedding rows (per hash), their length, filters of each width, and bytes of the word-beginning hash.
ROWS, DIM, WIDTHS, FILTERS, PREFIX = 1 << 16, 12, (1, 2, 3), 8, 4
#: Bounds of the fitting sample: documents per label and language, and the length of those it may hold.
SAMPLE_PER_CLASS, SAMPLE_CHARS = 800, 16_000
#: Documents of the whole sample, whatever the number of labels and languages.
SAMPLE_TOTAL = 16_000
EPOCHS, STEPS_OF, BATCH, RATE, VALIDATION, POSITIVE = (6, 30), 16_000, 16, 0.05, 5, 1.5
LANG_ROWS = 1 << 14


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the three embedding tables for each word (n x 3), and the word offsets of the texts.

    Words are runs of letters and digits. Two independent hashes of the word keep apart words that
    share one row; a hash of its first bytes lets rare forms of a word share what was learned.
    """
    raw, offs = T.utf8(column)
    starts, ends = T.token_spans(raw, offs, T.NON_ALNUM)
    word = T.span_hashes(raw, starts, ends)
    begin = T.span_hashes(raw, starts, np.minimum(starts + PREFIX, ends))
    mask = np.uint64(ROWS - 1)
    ids = np.stack([word & mask, ((word >> np.uint64(24)) & mask) + np.uint64(ROWS), (begin & mask) + np.uint64(2 * ROWS)], axis=1)
    return ids.astype(np.int32), np.searchsorted(starts, offs)


@dataclass
class Model:
    langs: list[str]
    emb: np.ndarray
    conv: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    lang_words: np.ndarray  # LANG_ROWS x languages: log-probabilities of words, to tell a text's language
    shift: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log-odds threshold of each language, last: no word

    def pooled(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled filter outputs of each text (texts x filters) and the word positions they come from."""
        n = len(offs) - 1
        e = self.emb[ids[:, 0]] + self.emb[ids[:, 1]] + self.emb[ids[:, 2]]
        best = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
        at = np.full(best.shape, -1, np.int64)
        size = np.diff(offs)
        for j, width in enumerate(WIDTHS):
            has = np.flatnonzero(size >= width)
            if not len(has):
                continue
            z = e[: len(e) - width + 1] @ self.conv[j][:DIM]
            for k in range(1, width):
                z += e[k : len(e) - width + 1 + k] @ self.conv[j][k * DIM : (k + 1) * DIM]
            cols = slice(j * FILTERS, (j + 1) * FILTERS)
            for i in has:
                own = z[offs[i] : offs[i + 1] - width + 1]
                m = own.argmax(axis=0)
                at[i, cols] = m + offs[i]
                best[i, cols] = own[m, np.arange(FILTERS)] + self.bias[j]
        return np.maximum(best, 0), at

    def logits(self, ids: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return self.pooled(ids, offs)[0] @ self.out + self.out_bias

    def language(self, ids: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The most likely language of each text by its words; the index after the last: no word."""
        n, langs = len(offs) - 1, len(self.langs)
        found = np.full(n, langs)
        has = np.flatnonzero(np.diff(offs) > 0)
        if len(has) and langs:
            sums = np.add.reduceat(self.lang_words[ids[:, 0] % LANG_ROWS], offs[:-1][has], axis=0)
            found[has] = sums.argmax(axis=1)
        return found

    def score(self, column: pa.Array) -> np.ndarray:
        """Probability-like scores; 0.5 is the threshold of the text's (recognised) language."""
        ids, offs = tokens(column)
        z = self.logits(ids, offs) - self.shift[self.language(ids, offs)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[str] | pa.Array, labels: list[int], langs: list[str]) -> Model:
    """Adagrad on the logistic loss; every fifth document is kept to calibrate the languages' thresholds."""
    names = sorted({x for x in langs if x is not None})
    g = np.random.Generator(np.random.PCG64(7))
    m = Model(
        names, g.normal(0, 0.05, (3 * ROWS, DIM)).astype(np.float32), [g.normal(0, 0.3, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS], g.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), 0.0,
        np.zeros((LANG_ROWS, len(names)), np.float32), np.zeros(len(names) + 1),
    )
    if not len(texts):
        return m
    texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
    parts = [tokens(texts[i : i + 256]) for i in range(0, len(texts), 256)]
    ids = np.concatenate([p[0] for p in parts])
    offs = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))])
    del parts
    y = np.array(labels, np.float32)
    lang = np.array([names.index(x) if x is not None else len(names) for x in langs])
    counts = np.full((LANG_ROWS, len(names)), 0.1)
    for i in np.flatnonzero(lang < len(names)):
        counts[:, lang[i]] += np.bincount(ids[offs[i] : offs[i + 1], 0] % LANG_ROWS, minlength=LANG_ROWS)
    m.lang_words = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    check = np.arange(len(y)) % VALIDATION == 0
    train = np.flatnonzero(~check)
    square = {k: np.full(v.shape, 1e-3, np.float32) for k, v in (("emb", m.emb), ("out", m.out), *((f"c{j}", c) for j, c in enumerate(m.conv)), *((f"b{j}", b) for j, b in enumerate(m.bias)))}

    def step(name: str, param: np.ndarray, grad: np.ndarray) -> None:
        square[name] += grad * grad
        param -= RATE * grad / np.sqrt(square[name])

    for _ in range(int(np.clip(STEPS_OF // max(1, len(train)), *EPOCHS))):  # small samples are read more often
        for batch in np.array_split(g.permutation(train), max(1, len(train) // BATCH)):
            size = offs[batch + 1] - offs[batch]
            own = np.repeat(offs[batch], size) + T.ramp(size)
            x, xo = ids[own], np.concatenate([[0], np.cumsum(size)])
            h, at = m.pooled(x, xo)
            p = 1 / (1 + np.exp(-np.clip(h @ m.out + m.out_bias, -30, 30)))
            d = ((p - y[batch]) * np.where(y[batch] > 0, POSITIVE, 1) / len(batch)).astype(np.float32)
            dh = d[:, None] * m.out[None] * (h > 0)
            step("out", m.out, h.T @ d)
            m.out_bias -= RATE * float(d.sum())
            touched, grads = [], []
            for j, width in enumerate(WIDTHS):
                cols = slice(j * FILTERS, (j + 1) * FILTERS)
                doc, flt = np.nonzero((dh[:, cols] != 0) & (at[:, cols] >= 0))
                if not len(doc):
                    continue
                value, where = dh[:, cols][doc, flt], at[:, cols][doc, flt]
                seen = np.concatenate([m.emb[x[where + k]].sum(axis=1) for k in range(width)], axis=1)
                dc = np.zeros_like(m.conv[j])
                np.add.at(dc.T, flt, seen * value[:, None])
                back = m.conv[j].T[flt] * value[:, None]
                step(f"c{j}", m.conv[j], dc)
                step(f"b{j}", m.bias[j], np.bincount(flt, value, FILTERS).astype(np.float32))
                for k in range(width):
                    touched.append(x[where + k].ravel())
                    grads.append(np.repeat(back[:, k * DIM : (k + 1) * DIM], 3, axis=0))
            if touched:
                rows, inverse = np.unique(np.concatenate(touched), return_inverse=True)
                total = np.zeros((len(rows), DIM), np.float32)
                np.add.at(total, inverse, np.concatenate(grads))
                square["emb"][rows] += total * total
                m.emb[rows] -= RATE * total / np.sqrt(square["emb"][rows])
    _calibrate(m, ids, offs, y, np.flatnonzero(check))
    return m


def _calibrate(m: Model, ids: np.ndarray, offs: np.ndarray, y: np.ndarray, check: np.ndarray) -> None:
    """Per recognised language, the log-odds that give the best F1 on kept documents (middle of the best range)."""
    z, lang = np.zeros(len(y)), np.zeros(len(y), np.int64)
    for i in check:
        own, ends = ids[offs[i] : offs[i + 1]], np.array([0, offs[i + 1] - offs[i]])
        z[i], lang[i] = m.logits(own, ends)[0], m.language(own, ends)[0]

    def best(rows: np.ndarray, fallback: float) -> float:
        if len(rows) < 20 or y[rows].sum() < 5 or (1 - y[rows]).sum() < 5:
            return fallback
        order = rows[np.argsort(-z[rows], kind="stable")]
        hit = np.cumsum(y[order])
        f1 = 2 * hit / (np.arange(1, len(order) + 1) + y[rows].sum())
        k = int(f1.argmax())
        return float((z[order[k]] + z[order[min(k + 1, len(order) - 1)]]) / 2)

    overall = best(check, 0.0)
    m.shift = np.array([best(check[lang[check] == i], overall) for i in range(len(m.langs))] + [overall])


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", split: int = 5) -> Model:
    """Fit on at most SAMPLE_PER_CLASS documents of each label and language whose crc32(id) mod ``split`` is not 0, SAMPLE_TOTAL in all.

    A document with several labels counts as toxic if one says so. The sampled ids are bounded by
    these parameters, so joining them to their texts by broadcast is too.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null")
    marks = marks.where(crc_mod("id", split) != 0).groupBy("id").agg(F.max("y").cast("int").alias("y"))
    sizes = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.length(text_col).alias("n")).where("id is not null")
    known = marks.join(sizes.where(F.col("n") <= SAMPLE_CHARS).drop("n"), "id")
    picked = per_class_sample(known, ["y", "lang"], "id", SAMPLE_PER_CLASS, total=SAMPLE_TOTAL)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    sample = texts.join(F.broadcast(picked), "id").select("id", "text", "y", "lang").orderBy(F.xxhash64("id"), "id").toArrow()
    return fit(sample["text"].combine_chunks(), sample["y"].to_pylist(), sample["lang"].to_pylist())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns and ``score``: how likely the whole text is toxic, from its words alone.

    Null and empty texts have a score too (that of a text without words). A map without a shuffle:
    every row is kept; an input column ``score`` is replaced. The model has a fixed size (about 10 MB).
    """
    rows = docs.drop("score")
    at = rows.columns.index(text_col)

    def judge(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(part.column(at)))], names=[*part.schema.names, "score"])

    return rows.mapInArrow(lean(judge), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", score double")
