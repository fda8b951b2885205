"""Cross-polytope groups, divergence audit, importance resampling: kernels, brute force and edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lowstress.llm import cross_polytope, divergence, importance
from pyspark.sql import functions as F

# --- cross-polytope hashing


def test_hadamard_keeps_lengths_and_corners_are_the_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 8))
    y = cross_polytope.hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(cross_polytope.hadamard(y), x)
    first = cross_polytope.corners(x, 3, 2)
    assert np.array_equal(first, cross_polytope.corners(x * 5, 3, 2)) and np.array_equal(first ^ 1, cross_polytope.corners(-x, 3, 2))


def _brute(rows, cosine=0.9):
    sound = [i for i, (_, x) in enumerate(rows) if x and all(c is not None and math.isfinite(c) for c in x) and any(x)]
    root, links = list(range(len(rows))), [0] * len(rows)
    find = lambda i: i if root[i] == i else find(root[i])
    for p, i in enumerate(sound):
        for j in sound[:p]:
            a, b = rows[i][1], rows[j][1]
            if len(a) == len(b):
                a, b = ([c / max(map(abs, v)) for c in v] for v in (a, b))
                if sum(s * t for s, t in zip(a, b, strict=True)) / math.sqrt(sum(s * s for s in a) * sum(t * t for t in b)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i, (vec, _) in enumerate(rows):
        if vec is not None:
            least[find(i)] = min(vec, least.get(find(i), vec))
    return sorted(((rows[i][0], links[i], least.get(find(i)), rows[i][0] == least.get(find(i))) for i in range(len(rows))), key=repr)


def test_vector_groups_equal_brute_force_whatever_the_rows(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(12):
        centre = rng.normal(size=16)
        rows += [(len(rows) + k, (centre + rng.normal(size=16) * 0.12).tolist()) for k in range(6 + 20 * (g == 0))]
    rows += [(900 + i, rows[3][1]) for i in range(30)]  # copies
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [1.0, float("nan")] + [0.0] * 14), (504, [None] + [1.0] * 15), (505, [float("inf")] * 16)]
    rows += [(506, [1e300] * 16), (507, [1e-300] * 16), (508, [-1.0] * 16), (509, [1.0, 0.0]), (509, [1.0, 0.1]), (None, [0.0, 1.0]), (None, [-0.0, 2.0]), (None, [3.0]), (510, [5.0]), (511, [-5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit("x")).withColumn("n_links", F.lit(1)).repartition(5)
    for tile in (2048, 8):  # large buckets tile by tile
        monkeypatch.setattr(cross_polytope, "TILE", tile)
        got = sorted((tuple(r) for r in cross_polytope.near_groups(df).collect()), key=repr)
        assert got == [(i, n, c, (i == c)) for i, n, c, _ in _brute(rows)]
    assert cross_polytope.near_groups(df.limit(0)).count() == 0
    assert cross_polytope.near_groups(df.where("vec_id = 502")).collect()[0][1:] == (0, 502, True)


def test_pairs_at_the_threshold_are_found(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.9002 * a + math.sqrt(1 - 0.9002**2) * b
    both = [(i, x.tolist()) for i, x in enumerate(np.concatenate([a, b]))]
    found = cross_polytope.near_groups(spark.createDataFrame(both, "vec_id long, embedding array<double>")).where("n_links = 1").count()
    assert found >= 0.98 * 3000


# --- divergence


def _audit(rows, least, top):
    docs = [(l or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for l, s, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = collections.Counter(t for l, _, ts in docs if l == lang for t in set(ts))
        kept = [t for t in df if df[t] >= least]
        counts = {s: collections.Counter(t for l, x, ts in docs if (l, x) == (lang, s) for t in ts if df[t] >= least) for s in {d[1] for d in docs if d[0] == lang}}
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        ps, q = {s: p(c) for s, c in counts.items()}, p(sum(counts.values(), collections.Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in counts:
            pairs = sorted((-sum(f(ps[s][t], ps[o][t]) for t in kept), o.encode(), o) for o in counts if o != s)
            terms = sorted((-f(ps[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] and ps[s][t] > q[t])[:top]
            out += [(lang, s, part, item, -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


def test_audit_equals_brute_force_for_any_split_and_tile_size(spark):
    rnd = random.Random(6)
    vocab = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i % 6]}" for i in range(60)] + ["Ärger", "É"]
    rows = [(rnd.choice(["de", "en", None]), f"src{rnd.randrange(9)}", " ".join(rnd.choices(vocab, [1 / (i + 1) for i in range(62)], k=rnd.randrange(25)))) for _ in range(160)]
    rows += [("fr", "a", "only source"), ("", None, None), ("es", "x", "one"), ("es", "y", ""), ("es", None, "1 2 3 -"), ("de", "src0", "big " * 3000 + "z" * 50_000)] + rows[:3] * 2
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("term", F.lit(1)).withColumn("n", F.lit("x")).repartition(4)
    want = _audit(rows, 3, 4)
    for heavy, groups, terms in ((8, 64, 4096), (0, 4, 7), (3, 2, 16), (1000, 64, 4096)):
        got = divergence.audit(df, least_docs=3, top_terms=4, heavy=heavy, parts=3, tile=(groups, terms))
        assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == want
    assert divergence.audit(df.limit(0)).count() == 0


def test_shares_are_exact_for_huge_counts(spark):
    n, total, v = 9 * 10**14, 2 * 10**15 - 7, 10**9
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * v)


# --- importance resampling


@pytest.mark.parametrize("size", [1, 300, 1 << 22])
def test_composed_crcs_equal_those_of_the_texts(size, monkeypatch):
    monkeypatch.setattr(importance, "SLICE", size)
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("aZ09 .-äß漢\x00") for _ in range(rnd.randrange(120))) for _ in range(80)] + [None, "", "x" * 5000 + " y " + "é" * 300, " ", "a"]
    for i, j, words, bucket, row in importance._features(pa.array(texts), 3, 4_294_967_291):
        got = collections.defaultdict(list)
        for b, r in zip(bucket.tolist(), row.tolist(), strict=True):
            got[i + r].append(b)
        for k in range(i, j):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), texts[k] or "")
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
            assert words[k - i] == len(w)
            assert sorted(got[k]) == sorted(zlib.crc32(" ".join(w[s : s + n]).encode()) % 4_294_967_291 for n in (1, 2, 3) for s in range(len(w) - n + 1))


def _resampled(docs, target, seed=7, buckets=50, least=4):
    def feats(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(w), [zlib.crc32(x.encode()) % buckets for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    s, t = (collections.Counter(b for x in texts for b in feats(x)[1]) for texts in ([d[1] for d in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, text in docs:
        n, f = feats(text)
        w = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def test_resampling_equals_brute_force_whatever_the_rows(spark):
    rnd = random.Random(8)
    docs = [(i, " ".join(rnd.choices("alpha beta Gamma delta ünter 77 x".split(), k=rnd.randrange(12)))) for i in range(120)]
    docs += [(None, None), (None, "alpha beta gamma delta"), (200, ""), (201, "..."), (202, "long " * 40_000)] + [docs[5]] * 3 + [(5, "alpha " * 6)]
    target = ["alpha beta", None, "gamma ünter 77 77", ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("x")).withColumn("weight", F.lit(1)).repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = lambda t: sorted((tuple(r) for r in importance.resample(df, t, buckets=50, least_words=4).collect()), key=repr)
    assert got(goal) == _resampled(docs, target)
    assert got(goal.limit(0)) == _resampled(docs, [])
    assert importance.resample(df.limit(0), goal).count() == 0
