"""Decontamination of items longer than the least passage."""

import random

import pyarrow as pa

from lowstress.llm import decontaminate


def test_exact_copies_of_long_items_are_found_at_all_offsets(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(3000)]
    items = [(n, " ".join(rnd.choices(words, k=n))) for n in (60, 100, 110, 160, 200, 500, 1000)]
    fill = [f"fill{i}" for i in range(1, 3000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for index in decontaminate.shards(bench, "item_id", "text"):
        for n in index.ids:
            docs = [" ".join([*fill[:at], dict(items)[n], *fill[at : at + 700]]) for at in range(0, 1300, 13)]
            assert {r for r, i, *_ in index.leaks(pa.array(docs)) if i == n} == set(range(len(docs))), n
    docs = spark.createDataFrame([(n, " ".join([*fill[:170], t.upper(), *fill[:90]])) for n, t in items], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()} == {(n, n) for n, _ in items}
