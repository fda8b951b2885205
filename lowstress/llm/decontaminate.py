"""Benchmark decontamination: a BM25 index of test items, block-max WAND, then question and answer overlap."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowstress.llm.blocks import lean
from lowstress.llm import text as T

#: BM25 constants; postings of a block; least words of a passage and its step; least share of an item's own score.
K1, B, BLOCK, PASSAGE, STEP, LEAST = 1.2, 0.75, 16, 160, 80, 0.6
#: Share of its step that the longest item of an index may have: a copy of it with more words still lies in one passage.
ROOM = 0.8
#: Words of an n-gram and least share of the question's and of the answer's n-grams (hundredths).
NGRAM, COVER = 5, 80
#: Items of one index: larger benchmarks are cut into shards, so that what travels to tasks is bounded.
SHARD_ITEMS, SHARD_CHARS = 20_000, 20_000_000
#: Share of an item's score that its essential words have.
ESSENTIAL = 0.75


def split_item(text: str) -> tuple[list[bytes], list[bytes]]:
    """Question and answer words: cut at the sentence end nearest to the middle, else in the middle."""
    words = text.encode().lower().split()
    ends = [len(text[: m.end()].encode().split()) for m in re.finditer(r"[.?!:]\s", text)]
    middle = len(words) / 2
    cut = min(ends, key=lambda e: abs(e - middle), default=len(words) // 2)
    if not len(words) // 4 <= cut <= len(words) - len(words) // 4:
        cut = len(words) // 2
    return words[:cut], words[cut:]


def _hashes(words: list[bytes]) -> np.ndarray:
    return T.word_hashes(pa.array([b" ".join(words).decode()]))[0] if words else np.zeros(0, np.uint64)


def grams(words: np.ndarray, n: int) -> set[int]:
    """Hashes of all runs of n words (none if there are fewer)."""
    return set(T.shingle_hashes(words, np.array([0, len(words)]), n)[0].tolist()) if 0 < n <= len(words) else set()


def _half(words: np.ndarray) -> tuple[int, set[int]]:
    """Run length and runs of a question or answer; one of fewer than NGRAM words is one run."""
    n = min(NGRAM, len(words))
    return n, grams(words, n)


def scale_of(n: int) -> int:
    """The power of two by which passages grow for items of n words."""
    scale = 1
    while n > ROOM * STEP * scale:
        scale *= 2
    return scale


@dataclass
class Index:
    """Postings of each word: items in ascending order with weights (share of the item's own score), and block maxima."""

    ids: list[int | None]
    words: np.ndarray  # sorted word hashes
    best: np.ndarray  # largest weight of each
    postings: list[tuple[list[int], list[float], list[float]]]
    question: list[tuple[int, set[int]]]
    answer: list[tuple[int, set[int]]]
    need: np.ndarray  # what an item's essential words must add up to, if all others occur
    essential: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # per word: offsets of (item, weight); a table of their low bits
    scale: int = 1  # passages and steps are this many times PASSAGE and STEP

    @staticmethod
    def build(items: list[tuple[int, str]]) -> Index:
        parts = [split_item(t) for _, t in items]
        halves = [(_hashes(q), _hashes(a)) for q, a in parts]
        bags = [Counter(np.concatenate(h).tolist()) for h in halves]
        mean = sum(b.total() for b in bags) / max(1, len(bags))
        df = Counter(w for b in bags for w in b)
        idf = {w: float(np.log1p((len(bags) - n + 0.5) / (n + 0.5))) for w, n in df.items()}
        lists: dict[int, tuple[list[int], list[float]]] = {}
        for i, b in enumerate(bags):
            weight = {w: idf[w] * f * (K1 + 1) / (f + K1 * (1 - B + B * b.total() / mean)) for w, f in b.items()}
            own = sum(weight.values())
            for w, x in weight.items():
                at = lists.setdefault(w, ([], []))
                at[0].append(i)
                at[1].append(x / own)
        names = sorted(lists)
        postings = [(lists[w][0], lists[w][1], [max(lists[w][1][k : k + BLOCK]) for k in range(0, len(lists[w][0]), BLOCK)]) for w in names]
        # an item's heaviest words, up to ESSENTIAL of its score; the rest alone cannot reach the threshold
        heavy: dict[int, list[tuple[int, float]]] = {}
        of_item: list[list[tuple[float, int]]] = [[] for _ in items]
        for n, p in enumerate(postings):
            for i, x in zip(p[0], p[1], strict=True):
                of_item[i].append((-x, n))
        need = np.zeros(len(items))
        for i, ws in enumerate(of_item):
            total = 0.0
            for x, n in sorted(ws):
                if total >= ESSENTIAL:
                    break
                total -= x
                heavy.setdefault(n, []).append((i, -x))
            need[i] = LEAST - (1 - total) - 1e-9
        sizes = np.array([len(heavy.get(n, ())) for n in range(len(names))], np.int64)
        flat = [x for n in range(len(names)) for x in heavy.get(n, ())]
        table = np.zeros(1 << 20, bool)
        table[(np.array(names, np.uint64)[sizes > 0] & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        essential = (np.concatenate([[0], np.cumsum(sizes)]), np.array([x[0] for x in flat], np.int64), np.array([x[1] for x in flat]), table)
        return Index([i for i, _ in items], np.array(names, np.uint64), np.array([max(p[1]) for p in postings]), postings, [_half(q) for q, _ in halves], [_half(a) for _, a in halves], need, essential, scale_of(max((b.total() for b in bags), default=0)))

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: every (item, score) with a score of LEAST or more for these distinct words (positions in ``words``)."""
        found = []
        cursors = [[self.postings[t][0][0], t, 0] for t in terms]
        heapq.heapify(cursors)
        while cursors:
            # the pivot: the first item that the lists up to it could bring to the threshold
            order, bound, pivot = sorted(cursors), 0.0, None
            for n, c in enumerate(order):
                bound += self.best[c[1]]
                if bound >= LEAST:
                    pivot, reach = c[0], n
                    break
            if pivot is None:
                break
            while reach + 1 < len(order) and order[reach + 1][0] == pivot:
                reach += 1
            # block maxima at the pivot; where even they are too small, go to the end of the nearest block
            shallow, limit = 0.0, order[reach + 1][0] if reach + 1 < len(order) else len(self.ids)
            for c in order[: reach + 1]:
                items, _, blocks = self.postings[c[1]]
                k = c[2] // BLOCK
                while (k + 1) * BLOCK < len(items) and items[(k + 1) * BLOCK - 1] < pivot:
                    k += 1
                if items[min(len(items), (k + 1) * BLOCK) - 1] >= pivot:
                    shallow += blocks[k]
                    limit = min(limit, items[min(len(items), (k + 1) * BLOCK) - 1] + 1)
            if shallow >= LEAST and order[0][0] == pivot:
                score = sum(self.postings[c[1]][1][c[2]] for c in order[: reach + 1])
                if score >= LEAST:
                    found.append((pivot, score))
                target = pivot + 1
            else:
                target = pivot if shallow >= LEAST else max(limit, pivot + 1)
            rest = order[reach + 1 :]
            for c in order[: reach + 1]:
                items = self.postings[c[1]][0]
                k = c[2]
                while k < len(items) and items[k] < target:
                    k += 1
                if k < len(items):
                    rest.append([items[k], c[1], k])
            cursors = rest
        return found

    def passages(self, words: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first word, end) of overlapping passages of PASSAGE (times the scale) words that cover each text."""
        n, size, step = np.diff(offs), PASSAGE * self.scale, STEP * self.scale
        count = np.where(n > 0, 1 + np.maximum(0, -(-(n - size) // step)), 0)
        row = np.repeat(np.arange(len(n)), count)
        start = offs[:-1][row] + T.ramp(count) * step
        return row, start, np.minimum(start + size, offs[1:][row])

    def promising(self, words: np.ndarray, offs: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Passages whose essential words could bring an item to the threshold, if all its other words occurred.

        Nothing else can be retrieved. Words that are repeated in a passage count again, so this bounds from above.
        """
        ptr, items, weights, table = self.essential
        size, step = PASSAGE * self.scale, STEP * self.scale
        maybe = np.flatnonzero(table[(words & np.uint64(len(table) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.words, words[maybe]), len(self.words) - 1)
        hit = (self.words[at] == words[maybe]) & (ptr[at + 1] > ptr[at])
        where, at = maybe[hit], at[hit]
        n = ptr[at + 1] - ptr[at]
        entry = np.repeat(ptr[at], n) + T.ramp(n)
        where = np.repeat(where, n)
        # passage k of a row begins at word k * step: a word is in those that begin less than a passage before it
        of_row = np.searchsorted(offs, where, "right") - 1
        first = np.searchsorted(row, of_row)
        last = np.searchsorted(row, of_row, "right") - 1
        newest = (where - offs[of_row]) // step
        keys, values = [], []
        for back in range(-(-size // step)):
            k = newest - back
            ok = (k >= 0) & (first + k <= last) & (where - offs[of_row] - k * step < size)
            keys.append(((first + k) * len(self.ids) + items[entry])[ok])
            values.append(weights[entry][ok])
        key, value = np.concatenate(keys), np.concatenate(values)
        pairs, inverse = np.unique(key, return_inverse=True)
        total = np.bincount(inverse, value, len(pairs))
        return np.unique(pairs[total >= self.need[pairs % len(self.ids)]] // len(self.ids))

    def leaks(self, column: pa.Array) -> list[tuple[int, int, float, float, float]]:
        """(row, item id, score, question share, answer share) of verified leaks; the best passage of each pair."""
        words, offs = T.word_hashes(column)
        row, start, end = self.passages(words, offs)
        if not len(row) or not len(self.words):
            return []
        best: dict[tuple[int, bool, int], tuple[float, float, float]] = {}
        for p in self.promising(words, offs, row):
            part = slice(start[p], end[p])
            own = np.unique(words[part])
            terms = np.searchsorted(self.words, own[np.isin(own, self.words)])
            for item, score in self.retrieve(terms.tolist()):
                share = lambda half: len(half[1] & grams(words[part], half[0])) / len(half[1]) if half[1] else 1.0  # noqa: E731, B023
                q, a = share(self.question[item]), share(self.answer[item])
                if min(q, a) * 100 >= COVER:
                    pair = (int(row[p]), self.ids[item] is None, self.ids[item] or 0)
                    best[pair] = max(best.get(pair, (0.0, 0.0, 0.0)), (score, q, a))
        return [(r, None if nameless else i, *x) for (r, nameless, i), x in sorted(best.items())]


def shards(items: DataFrame, id_col: str, text_col: str):
    """Indexes of the items, each of one class of lengths and within the shard bounds; items without words are left out."""
    n = F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+"))
    kind = F.greatest(F.lit(0), F.ceil(F.log2(n / (ROOM * STEP)) - 1e-9)).cast("int")
    rows = items.where(n > 0).select(kind.alias("_class"), F.col(id_col).cast("long"), F.col(text_col)).orderBy("_class", id_col, text_col)
    held: list[tuple[int | None, str]] = []
    chars = last = 0
    for c, i, t in rows.toLocalIterator():
        if held and (c != last or len(held) >= SHARD_ITEMS or chars + len(t) > SHARD_CHARS):
            yield Index.build(held)
            held, chars = [], 0
        held.append((i, t))
        chars += len(t)
        last = c
    if held:
        yield Index.build(held)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, score, question_share, answer_share): which rows contain which test items.

    Every passage of the whole text queries the index; items whose BM25 score reaches LEAST of their
    score for their own words are retrieved, all of them, and verified: COVER hundredths or more of the
    question's and of the answer's NGRAM-word runs occur in the passage. Items are indexed by classes of
    length, and the passages of each overlap by more than its longest item, so a copy lies whole in one
    of them wherever it begins. A map over the documents, without a shuffle; the index is bounded by
    shards, and a benchmark of many shards (or classes: the length in words, by powers of two) costs as
    many passes.

    Before a passage queries the index, an exact bound (``Index.promising``: the items' essential words) leaves out
    those that can reach no item's threshold. Rows of one id yield their own rows each; null and empty texts
    contain nothing; items without an id count like others and are reported together with a null item_id; an
    empty table or benchmark gives no rows; other columns are not read.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, item_id long, score double, question_share double, answer_share double"
    out = None
    for index in shards(items, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index)  # within SHARD_ITEMS and SHARD_CHARS

        def look(batches, shared=shared):
            found = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    got = list(zip(*found.leaks(part.column(1)), strict=True)) or [[]] * 5
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(got[0], pa.int64())), pa.array(got[1], pa.int64()), *(pa.array(g, pa.float64()) for g in got[2:])],
                        names=["id", "item_id", "score", "question_share", "answer_share"],
                    )

        one = rows.mapInArrow(lean(look), schema)
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("id", id_col)


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names: str) -> DataFrame:
    """The rows that contain no test item (rows of one id go together; a null id never matches, so its row stays)."""
    leaks = find_leaks(docs, items, id_col, text_col, **names).select(id_col).distinct()
    return docs.join(leaks, id_col, "left_anti")


__all__ = ["Index", "drop_leaks", "find_leaks", "split_item"]
