"""The registered queries on real tables, and the operators on nulls, empty tables, ties, repeated rows and clashing names."""

import zlib

import pytest
from pyspark.sql import functions as F

from quillmark.llm import decontam, html_extract, language_id, license_scan, lm_scoring, mixing, ngram_join, queries, suffix_dedup, token_counts, vector_search
from quillmark.llm import kernels as K

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def test_columns_of_contracts(spark, documents):
    want = {
        "op2_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
        "op3_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
        "op4_license_scan": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
        "op5_html_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
        "op6_lm_score": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
        "op7_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op9_vector_search": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
        "op10_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    }
    have = queries.queries()
    rows = {}
    for name, columns in want.items():
        df = have[name](spark, SF)
        assert columns.items() <= dict(df.dtypes).items(), name
        rows[name] = df.collect()
    ids = sorted(r.doc_id for r in documents)
    for name in ("op2_suffix_dedup", "op3_token_counts", "op4_license_scan", "op6_lm_score", "op7_language_id", "op10_jaccard_join"):
        assert sorted(r.doc_id for r in rows[name]) == ids, name
    for name, m, rest in (("op6_lm_score", 7, 2), ("op7_language_id", 5, 0)):
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % m == rest) for r in rows[name])
    text = {r.doc_id: r.text or "" for r in documents}
    assert all(r.n_bytes == len(text[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 2048) for r in rows["op3_token_counts"])
    lang = {r.doc_id: r.lang for r in documents}
    held = [r for r in rows["op7_language_id"] if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.9 * len(held)
    asked = {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect() if r.vec_id % 50 == 0}
    assert {r.query_id for r in rows["op9_vector_search"]} == asked and {r["rank"] for r in rows["op9_vector_search"]} == {1, 2, 3, 4, 5}


def test_held_out_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op7_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def test_decontamination_of_odd_inputs(spark, monkeypatch):
    item = " ".join(f"item{k}" for k in range(30))
    b = spark.createDataFrame([(1, item), (1, item), (None, item), (2, ""), (3, "!!!")], "item_id long, text string")
    rows = [(1, item), (1, item), (None, item), (2, None), (3, ""), (4, ("word " * 200_000) + item)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("item_id", "n_match", "seed", "id", "item", "data", "word")})
    for limit in (1 << 30, -1):
        got = sorted((r.doc_id, r.item_id, r.n_match, r.first_word) for r in decontam.contaminated(d, b, broadcast_bytes=limit).collect())
        assert set(got) == {(1, 1, 30, 0), (4, 1, 30, 200_000)}
        assert decontam.contaminated(d.limit(0), b, broadcast_bytes=limit).count() == 0


def test_language_of_odd_inputs(spark):
    rows = [(i, "aaa bbb abab " * 9, "aa") for i in range(6)] + [(i + 10, "zzz yyy zyzy " * 9, "zz") for i in range(6)] + [(30, "aaa bbb", None), (30, "aaa bbb", None), (None, "zzz yyy", "zz"), (31, "aaab " * 60_000, "aa")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("lang_pred", "w", "vector")})
    model = language_id.fit(d)
    got = [(r.doc_id, r.lang_pred) for r in language_id.identify(d, model).collect()]
    assert len(got) == len(rows) and all(p == ("aa" if i is not None and (i < 10 or i >= 30) else "zz") for i, p in got)
    assert language_id.identify(d.limit(0), model).count() == 0
    tied = language_id.fit(spark.createDataFrame([(1, "abc abc", "xx"), (2, "abc abc", "yy")], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language_id.identify(spark.createDataFrame([(1, "abc abc")], "doc_id long, text string"), tied).collect()} <= {"xx", "yy"}


def test_scores_of_odd_inputs(spark):
    rows = [(1, "x" * 5000), (2, "\x00 \x0b ½ é"), (3, None), (4, "a a a"), (4, "a a a"), (None, "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("word", "c", "base", "model", "held_out", "times")})
    got = lm_scoring.score(d, F.lit(False)).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 4, 4] and all(r.score < 0 and r.n_known == r.n_tokens for r in got)
    none = lm_scoring.score(d, F.lit(True)).collect()  # nothing to learn from
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score < 0 for r in none)
    assert lm_scoring.score(d.limit(0), F.lit(False)).count() == 0


def test_frequent_words_are_bounded(spark, monkeypatch):
    rows = [(i, " ".join(f"w{k}" for k in range(i, i + 40))) for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((r.doc_id, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in lm_scoring.score(d, F.col("doc_id") % 3 == 0).collect())
    monkeypatch.setattr(lm_scoring, "HEAD", 5)
    assert sorted((r.doc_id, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in lm_scoring.score(d, F.col("doc_id") % 3 == 0).collect()) == want


def test_vectors_of_odd_inputs(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [0.0, 1.0], 1), (1, [1.0, 0.1], 1), (2, [1.0, 0.2, 3.0], 1), (None, [1.0, 0.0], 1), (3, [-1.0, 0.0], 1), (4, None, 1), (5, [float("inf"), 1.0], 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("clash") for c in ("cell", "leaf", "id", "data", "score", "rank")})
    got = vector_search.search(d, d.where("vec_id = 0"), k=5).collect()
    assert {r.query_id for r in got} == {0} and {r.vec_id for r in got} == {1, 3}
    one = d.where("vec_id = 1")
    assert vector_search.search(one, one).count() == 0


def test_mixing_of_odd_inputs(spark):
    rows = [(1, "a b c", None, None, 5), (1, "a b c", None, None, 5), (2, "", "en", "s1", 0), (3, None, "en", "s1", 0), (None, "x y", "en", "s1", 3), (4, "w " * 50_000, "en", "s9", 9)]
    d = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("domain", "n_tokens", "epoch", "h", "range", "before", "salt")})
    got = mixing.mix(d, share=1.0, max_epochs=1).collect()
    assert sorted((r.n_tokens, r.epoch) for r in got) == [(2, 0), (3, 0), (3, 0), (50_000, 0)]
    assert mixing.mix(d.limit(0)).count() == 0 and mixing.mix(d, budget=0.0).count() == 0


def test_counts_and_scans_of_repeated_rows(spark):
    d = spark.createDataFrame([(1, "under the MIT license"), (1, "under the MIT license"), (None, "x")], "doc_id long, text string")
    assert [r.n_tokens for r in token_counts.token_counts(d, keep=["doc_id"]).orderBy("doc_id").collect()][1:] == [4, 4]
    assert sorted((str(r.doc_id), r.labels) for r in license_scan.license_scan(d).collect()) == [("1", "mit"), ("1", "mit"), ("None", "")]


def test_pipeline_of_odd_inputs(spark, tmp_path):
    import corpus_pipeline as P

    long = " ".join(f"word{k} and" for k in range(60))
    rows = [(1, long, "en", "s1", len(long)), (2, long + " tail", "en", "s1", 0), (None, "no id here at all", "en", "s1", 0), (None, None, None, None, None), (3, "", "en", "s1", 0), (4, "12345 !!", "en", "s1", 0), (5, "a fine short text", "en", None, 0)]
    d = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("rest", "kept", "spans", "row_key_x")})
    spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sizes = []
    for name, stage in P.STAGES:
        before = d.columns
        d = K.stored(stage(spark, d, str(tmp_path)), f"test-{name}")
        sizes.append(d.count())
        assert name == "mixing" or d.columns == before
    assert sizes[:4] == [4, 3, 3, 3]  # without letters: three rows; the near copy; nothing is repeated, nothing is of the benchmark
    none = spark.createDataFrame([], DOCS)
    for _, stage in P.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_stored_tables_can_be_removed(spark):
    since = K.written()
    one = K.stored(spark.range(5).toDF("x"), "gone")
    two = K.stored(one, "stays")
    K.clear(spark, since, keep=two.stored_path)
    assert two.count() == 5 and K.written() == since + 1
    K.discard(two)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        spark.read.parquet(two.stored_path).count()


def test_hot_groups_are_dealt_out():
    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(20):
        seen = suffix_dedup._Firsts(bits=4)
        key, doc, place = r.integers(0, 9, 300).astype(np.uint64) << K.U(56), r.integers(0, 50, 300), np.arange(300)
        later = np.concatenate([seen.later(key[a : a + 40], doc[a : a + 40], place[a : a + 40]) for a in range(0, 300, 40)])
        for k in np.unique(key):
            own = np.flatnonzero(key == k)
            least = own[np.lexsort((place[own], doc[own]))[0]]
            assert not later[least]  # the first of all is never told to be later
            assert later[own].sum() > 0.6 * len(own)


def test_join_needs_all_orders():
    import numpy as np
    import pyarrow as pa

    def both(x, y):
        return np.concatenate([np.array(sorted(x), np.uint32), np.array(sorted(y), np.uint32)]).tobytes()

    rows = [(1, 2, both([1, 5], [7, 9]), both([5, 6], [9, 10])), (3, 4, both([1, 5], [7, 9]), both([5, 6], [8, 10])), (5, 6, both([1], [2]), both([3], [2]))]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["a", "b", "x", "y"])
    assert [r for out in ngram_join._meet(iter([batch])) for r in out.column(0).to_pylist()] == [1]


def test_pages_of_odd_inputs(spark):
    page = "<body><p>One story that is told here</p></body>"
    d = spark.createDataFrame([(1, "http://h/1", page), (1, "http://h/1", page), (2, None, "&#x110000; &bogus; <p>x</p>"), (3, "", ""), (4, "::", "<" * 1000)], "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("host_x", "text", "n_chars", "salt")})
    got = sorted((r.page_id, r.n_chars == len(r.text)) for r in html_extract.extract(d).collect())
    assert got == [(1, True), (1, True), (2, True), (3, True), (4, True)]
