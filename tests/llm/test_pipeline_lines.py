"""The pipeline's line stage keeps documents of which anything is left."""


def test_documents_with_lines_left_stay(spark):
    import corpus_pipeline as P

    same = "one repeated line of boilerplate words"
    docs = [(1, same, 0), (2, same + "\nshort own", 0), (3, same + "\n\n ", 0), (4, "", 0), (5, same + "\n* - *", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in P.drop_repeated_lines(spark, df, "").collect()}
    assert got == {1: same, 2: "short own", 4: "", 5: "* - *"}


def table(spark, rows):
    columns = "doc_id long, text string, n_chars long, score double, n_lines string, key string, block long, dropped string, lang string"
    return spark.createDataFrame([(*r, "en") for r in rows], columns)


def test_stages_decide_by_row_and_leave_other_columns_alone(spark, tmp_path):
    import corpus_pipeline as P

    base = " ".join(f"word{i}" for i in range(60))
    near = base.replace("word30", "other")
    extra = (7.0, "mine", "k", 222, "d")
    sf = str(tmp_path)
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(5, "which river runs there now\nthe long green river")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    leak = "before which river runs there now the long green river after"
    rows = [
        (7, base, 1, *extra), (7, "unrelated words of a document that shares its id with a copy", 2, *extra), (3, near, 3, *extra),
        (None, base.replace("word9 ", "x "), 4, *extra), (8, None, None, *extra), (9, "", 0, *extra), (9, "", 0, *extra),
        (11, "equal rows have words of their own", 5, *extra), (11, "equal rows have words of their own", 5, *extra),
        (12, leak, 6, *extra), (None, leak + " again", 7, *extra), (12, "innocent row of an id that leaks", 8, *extra), (20, "long " * 60_000, 9, *extra),
    ]
    df = table(spark, rows)
    for name, stage in P.STAGES:
        empty = stage(spark, df.limit(0), sf)
        assert empty.count() == 0 and (name.startswith("byte") or empty.columns == df.columns), name
    kept = {tuple(r) for r in P.drop_near_copies(spark, df, sf).collect()}
    texts = sorted((r[0] or -1, r[1] or "") for r in kept)
    assert (3, near) in texts and (7, rows[1][1]) in texts and (7, base) not in texts and all(t != rows[3][1] for _, t in texts)
    assert P.drop_near_copies(spark, df, sf).where("doc_id = 11").count() == 1 and P.drop_near_copies(spark, df, sf).where("doc_id in (8, 9)").count() == 3
    clean = P.drop_leaked(spark, df, sf).collect()
    assert sorted(r.text or "" for r in clean) == sorted(r[1] or "" for r in rows if leak not in (r[1] or ""))
    lines = P.drop_repeated_lines(spark, df, sf).collect()
    assert all((r.score, r.n_lines, r.key, r.block, r.dropped) == extra for r in [*clean, *lines]) and {r.doc_id for r in lines} >= {8, 9, 20}
    judged = P.drop_toxic(spark, df, sf).collect()
    assert all((r.score, r.n_lines, r.key, r.block, r.dropped) == extra for r in judged)
    out = P.tokenize(spark, df, sf).collect()
    assert len(out) == len(rows) and all(r.n_tokens == len(r.ids) for r in out)
