"""Line dedup, n-gram join, language model, decontamination, classifiers and the pipeline against brute force."""

import collections
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lowstress.llm import clusters, decontaminate, interpolated_lm, language_id, line_dedup, ngram_join, queries, toxicity

SF = "/root/testdata/sf0.001"


def documents(sf=SF):
    return duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()


def words(t):
    return (t or "").encode().lower().split()


def sets(docs, k):
    out = []
    for _, t in docs:
        w = words(t)
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def groups(n, linked):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return [find(i) for i in range(n)]


# --- n-gram join


def near_copies(seed=3):
    rnd = random.Random(seed)
    base = [" ".join("".join(rnd.choices("abcdefgh", k=3)) for _ in range(n)) for n in (1, 3, 4, 5, 9, 12, 30, 60, 200, 1500)]
    rows = []
    for t in base:
        for _ in range(8):
            w = t.split()
            for _ in range(rnd.randint(0, max(1, len(w) // 60))):
                w[rnd.randrange(len(w))] = rnd.choice(["zz", "yy"])
            rows.append(" ".join(w).upper() if rnd.random() < 0.2 else " ".join(w))
    rows += [None, "", " \n ", base[-1], base[-1]]
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("k", "num", "tile"), [(4, 85, 8192), (5, 80, 8192), (3, 60, 5)])
def test_components_equal_brute_force(spark, monkeypatch, k, num, tile):
    monkeypatch.setattr(clusters, "TILE", tile)
    docs = near_copies()
    s = sets(docs, k)
    linked = [(i, j) for i, j in itertools.combinations(range(len(s)), 2) if s[i] and 100 * len(s[i] & s[j]) >= num * len(s[i] | s[j])]
    want = groups(len(s), linked)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumn("component_id", F.lit("x")).withColumn("node", F.lit(1))
    got = {r.doc_id: r for r in ngram_join.join_components(df, k, num).collect()}
    assert [got[i].component_id for i in range(len(s))] == want
    assert [got[i].n_shingles for i in range(len(s))] == [len(x) for x in s]
    assert len(set(want)) < len(s) - 20


def test_components_of_documents(spark):
    docs = documents()
    s = sets(docs, 4)
    linked = [(i, j) for i, j in itertools.combinations(range(len(s)), 2) if s[i] and 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j])]
    ids = [d for d, _ in docs]
    lab = groups(len(s), linked)
    low = {}
    for d, g in zip(ids, lab, strict=True):
        low[g] = min(low.get(g, d), d)
    got = {r.doc_id: r.component_id for r in queries.op3_ngram_join(spark, SF).collect()}
    assert got == {d: low[g] for d, g in zip(ids, lab, strict=True)}


def test_join_of_nothing_of_null_ids_and_of_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (4, "other words are in this text"), (9, None)], "doc_id long, text string")
    assert ngram_join.join_components(df.limit(0)).count() == 0
    got = sorted((r.doc_id or -1, r.component_id) for r in ngram_join.join_components(df).collect())
    assert got == [(-1, 4), (4, 4), (4, 4), (4, 4), (9, 9)]


# --- lines


LOWER = {**{c: c + 32 for c in range(65, 91)}, **{c: c + 32 for c in range(0xC0, 0xDF) if c != 0xD7}}


def plain_form(line):
    return re.sub("[^a-z0-9\\x80-\U0010ffff]+", " ", line.translate(LOWER)).strip()


def edits(a, b):
    """Levenshtein distance, row by row."""
    x, y = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (a, b))
    step = np.arange(len(y) + 1)
    row = step.copy()
    for i, c in enumerate(x):
        best = np.minimum(row[1:] + 1, row[:-1] + (y != c))
        row = np.minimum.accumulate(np.concatenate([[i + 1], best]) - step) + step
    return int(row[-1])


def brute_lines(docs):
    occ = [(i, n, plain_form(x)) for i, t in docs for n, x in enumerate((t or "").split("\n")) if t is not None]
    occ = [o for o in occ if o[2]]
    distinct = sorted({o[2] for o in occ})
    size = np.array([len(x) for x in distinct])
    code = [np.frombuffer(x.encode("utf-32-le"), np.uint32).astype(np.int64) for x in distinct]
    runs = np.stack([np.bincount((c[:-2] * 7919 + c[1:-1] * 104729 + c[2:]) % 4096, minlength=4096) if len(c) > 2 else np.zeros(4096, np.int64) for c in code]).astype(np.int32)
    linked = []
    for i in range(1, len(distinct)):
        most = np.maximum(size[i], size[:i]) // 10
        near = np.flatnonzero(abs(size[i] - size[:i]) <= most)
        # an edit changes six counts of runs of three at most, by one
        for j in near[abs(runs[i] - runs[near]).sum(axis=1) <= 6 * most[near]]:
            if most[j] and edits(distinct[i], distinct[j]) <= most[j]:
                linked.append((i, int(j)))
    group = dict(zip(distinct, groups(len(distinct), linked), strict=True))
    first = {}
    for i, n, x in sorted(occ):
        first.setdefault(group[x], (i, n))
    gone = collections.defaultdict(list)
    for i, n, x in occ:
        if first[group[x]] != (i, n):
            gone[i].append(n)
    return gone, linked


def test_lines_equal_brute_force(spark):
    rnd = random.Random(8)
    docs = documents()[:120]
    pool = [x for _, t in docs for x in t.split("\n") if len(x.split()) > 20]
    for i in range(40):  # lines with an edited word
        w = rnd.choice(pool).split()
        w[rnd.randrange(len(w))] = "zz"
        docs.append((1000 + i, " ".join(w) + "\n" + rnd.choice(pool).upper()))
    docs += [(2000, None), (2001, ""), (2002, "\n\n"), (2003, "short line\nshort line"), (2004, "w " * 30_000), (2005, "W, " * 30_000)]
    gone, linked = brute_lines(docs)
    assert linked and sum(map(len, gone.values())) > 60
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumn("key", F.lit("k")).withColumn("n_lines", F.lit("mine"))
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "key", "n_lines", "n_long", "dropped"]
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        assert (i, list(got[i].dropped)) == (i, sorted(gone.get(i, [])))
        want = t if t is None or not gone.get(i) else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i])
        assert got[i].text == want and got[i].key == "k"


def test_lines_of_nothing_and_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "one two three four five\nx"), (1, "one two three four five\nx"), (None, "one two three four five")], "doc_id long, text string")
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    got = sorted((r.doc_id or -1, r.text) for r in line_dedup.dedup_lines(df).collect())
    assert got == [(-1, "one two three four five"), (1, "x"), (1, "x")]


def test_pigeonhole_finds_every_close_pair():

    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in a], np.uint64)
    for plan in ((5, 2), (6, 3), (8, 5)):
        ka, kb = (line_dedup.block_keys(x, *plan)[0].reshape(-1, 300) for x in (a, a ^ flips))
        assert (ka == kb).any(axis=0).all()


# --- language model


def test_model_counts_base_scores_and_gain(spark):
    docs = [*documents(), (5001, None), (5002, ""), (5003, "never seen wordzz here"), (5001, "again the same id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("block", F.lit(0))
    got = collections.defaultdict(list)
    for r in interpolated_lm.score_texts(df).collect():
        got[r.doc_id].append(r)
    tok = lambda t: [*words(t), None]
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    counts = collections.Counter(w for d, t in docs if not held(d) for w in tok(t))
    n, v = sum(counts.values()), len(counts)
    gain = 0.0
    for d, t in docs:
        r = next(x for x in got[d] if x.n_tokens == len(tok(t)))
        assert r.held_out == held(d) and r.n_known == sum(counts[w] > 0 for w in tok(t)) and r.train_tokens == n
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tok(t))
        assert abs(r.base_score - base) < 1e-6 * abs(base) + 1e-9
        gain += (r.score - r.base_score) if r.held_out else 0
    assert gain > 0
    assert interpolated_lm.score_texts(df.limit(0)).count() == 0


def test_mixture_is_a_distribution():

    rng = np.random.default_rng(0)
    t = rng.integers(0, 50, (interpolated_lm.BUCKETS, interpolated_lm.BINS, interpolated_lm.BINS)).astype(float)
    ratio = np.concatenate([[0], 2 ** np.linspace(-4, 12, interpolated_lm.BINS - 1)])
    w = interpolated_lm.em(t, ratio, ratio)
    assert np.allclose(w.sum(axis=1), 1) and (w >= 0).all() and w[0, 0] == 0


def test_packing_round_trips():

    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5, 1000):
        k = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        assert (interpolated_lm.unpack(interpolated_lm.pack(k)) == k).all()
        c = rng.integers(0, 6, n) * rng.integers(0, 70_000, n)
        assert (interpolated_lm.unpack_counts(interpolated_lm.pack_counts(c)) == c).all()


# --- decontamination


def test_leaks_equal_brute_force_on_whole_items(spark):
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    docs = documents("/root/testdata/sf0.01")
    docs += [(9001, None), (9002, ""), (9003, "filler words here " * 5000 + items[0][1]), (9004, items[1][1].upper() if items[1][1].isascii() else items[1][1]), (9004, "clean")]
    want = {(d, i) for d, t in docs for i, x in items if b" ".join(words(x)) in b" ".join(words(t))}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame([*items, (7777, None), (None, items[0][1]), (None, "x y"), (8888, "  ")], "item_id long, text string")
    every = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench).collect()}
    got = {(d, i) for d, i in every if i is not None}
    assert {d for d, i in every - got} >= {d for d, i in want if i == items[0][0]} >= {9003}  # an item without an id counts as well
    assert want <= got and len(want) > 5
    near = sets([(0, t) for _, t in items], 5)
    for d, i in got - want:  # only texts that share most of the item
        n = near[[x for x, _ in items].index(i)]
        assert max(len(n & s) / len(n) for (e, _), s in zip(docs, sets(docs, 5), strict=True) if e == d) > 0.7
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0 and decontaminate.find_leaks(df.limit(0), bench).count() == 0
    kept = decontaminate.drop_leaks(df, bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in every}


def test_wand_retrieves_all_above_the_threshold(monkeypatch):

    items = duckdb.sql("select item_id, text from '/root/testdata/sf0.01/benchmark.parquet'").fetchall()
    index = decontaminate.Index.build(items)
    rnd = random.Random(5)
    for least in (0.05, 0.2, 0.6):
        monkeypatch.setattr(decontaminate, "LEAST", least)
        for _ in range(60):
            terms = sorted(rnd.sample(range(len(index.words)), rnd.randint(1, 120)))
            score = collections.Counter()
            for t in terms:
                for i, x in zip(*index.postings[t][:2], strict=True):
                    score[i] += x
            assert {i for i, _ in index.retrieve(terms)} == {i for i, x in score.items() if x >= least} or min(abs(x - least) for x in score.values()) < 1e-9
    assert len(np.unique(index.words)) == len(index.words)


# --- classifiers


def test_language_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op8_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95 and all(0 <= r.score <= 1 for r in got)
    model = language_id.fit(["the cat sat on the mat", "der hund und die katze"], ["en", "de"])
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "the dog and the cat"), (4, "und der"), (5, "the " * 500_000)], "doc_id long, text string").withColumn("score", F.lit(3))
    out = sorted((r.doc_id, r.lang_pred) for r in language_id.identify(df, model).collect())
    assert out == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "en"), (5, "en")]
    assert {r.lang_pred for r in language_id.identify(df, language_id.fit([], [])).collect()} == {"und"}
    assert language_id.identify(df.limit(0), model).count() == 0
    assert language_id.fit_on(spark.createDataFrame([], "doc_id long, text string, lang string")).langs == []


def test_toxicity_accuracy_and_edges(spark):
    rnd = random.Random(1)
    plain = ["".join(rnd.choices("abcdefg", k=4)) for _ in range(300)]
    texts, labels = [], []
    for i in range(600):
        w = rnd.choices(plain, k=rnd.randint(5, 80))
        if i % 4 == 0:
            w.insert(rnd.randrange(len(w)), rnd.choice(["Vileword!", "nastyword", "grimword"]))
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    model = toxicity.fit(texts[:400], labels[:400], ["en"] * 400)
    import pyarrow as pa

    s = model.score(pa.array(texts[400:]))
    assert sum((x >= 0.5) == bool(y) for x, y in zip(s, labels[400:], strict=True)) / 200 > 0.95
    df = spark.createDataFrame([(1, None), (2, ""), (3, "abc nastyword"), (3, "abc"), (4, "abcd " * 200_000)], "doc_id long, text string").withColumn("score", F.lit("x"))
    out = toxicity.score(df, model).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(df.limit(0), model).count() == 0
    none = toxicity.fit_on(spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(0 <= r.score <= 1 for r in toxicity.score(df, none).collect())


# --- pipeline


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = docs
    ids = [{r.doc_id for r in docs.select("doc_id").collect()}]
    for name, stage in P.STAGES[:-1]:
        before, left = left, P.materialize(stage(spark, left, sf), "test")
        assert left.columns == docs.columns, name
        ids.append({r.doc_id for r in left.select("doc_id").collect()})
        assert ids[-1] <= ids[-2] if name.startswith("n-gram") else ids[-1] < ids[-2]  # line dedup may leave no near copies here
        if name == "line dedup":
            gone, _ = brute_lines(sorted((r.doc_id, r.text) for r in before.collect()))
            texts = {r.doc_id: r.text for r in before.collect()}
            for r in left.collect():
                assert r.text == "\n".join(x for n, x in enumerate(texts[r.doc_id].split("\n")) if n not in gone.get(r.doc_id, [])) and r.n_chars == len(r.text)
    out = {r.doc_id: r for r in P.STAGES[-1][1](spark, left, sf).collect()}
    assert set(out) == ids[-1] and all(r.n_tokens == len(r.ids) for r in out.values())


def test_line_tables_do_not_depend_on_the_batch():
    import pyarrow as pa

    texts = ["a b c d e f\n" * 3 + "w " * 70_000 + "\nq r s t u v", "g h i j k l " * 20_000, None, "", "no\n\nq r s t u v\n"]
    rows = list(zip(*line_dedup.line_table(pa.array(texts)), strict=True))
    assert [(r, n) for r, n, *_ in rows] == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (1, 0), (4, 0), (4, 2)]
    for i, t in enumerate(texts):
        assert [r[1:] for r in rows if r[0] == i] == [r[1:] for r in zip(*line_dedup.line_table(pa.array([t], pa.string())), strict=True)]


def test_candidate_groups_of_the_join_stay_within_bands_of_sizes(spark, monkeypatch):
    """Sets that share single shingles by chance do not chain small sets to large ones; linked ones still meet."""
    from lowstress.llm import ngram_join as J

    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((4, 6, 9, 14, 20, 30, 45, 70)))) for _ in range(400)]
    texts += [t + " end" for t in texts[::5]] + [" ".join(t.split()[1:]) for t in texts[::7]]
    seen = {}

    def spy(members, loaded, link, name):
        size = F.size(F.array_distinct(F.split("text", " ")))
        seen.update({c["cluster"]: (c["low"], c["high"]) for c in loaded.groupBy("cluster").agg(F.min(size).alias("low"), F.max(size).alias("high")).collect()})
        return plain(members, loaded, link, name)

    plain = J.verified_components
    monkeypatch.setattr(J, "verified_components", spy)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in J.join_components(docs, k=1, num=80, den=100).collect()}
    sets = [set(t.split()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    assert got == dict(enumerate(root))
    assert seen and all(high <= 2 * low for low, high in seen.values())
