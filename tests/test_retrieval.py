"""Ranked search and fusion on small cases, and the measures over them."""

import math

import pytest
from pyspark.sql import functions as F

from lectern.operators import evaluation as E
from lectern.operators import vectors as V


def ranks(spark, names):
    return spark.createDataFrame([(1, n, 1.0 - i / 10, i + 1) for i, n in enumerate(names)], "q_id int, id string, score double, rank int")


@pytest.mark.parametrize("alpha, order", [(0.5, "bcad"), (1.0, "abcd"), (0.0, "bcda")])
def test_fusion_order(spark, alpha, order):
    fused = V.fuse(ranks(spark, "abc"), ranks(spark, "bcd"), "id", alpha=alpha).orderBy("rank").collect()
    assert "".join(r.id for r in fused) == order
    if alpha == 0.5:
        assert fused[0].score == round(0.5 / 62 + 0.5 / 61, 9) and fused[3].dense_score is None


def test_fusion_checks_its_parameters(spark):
    with pytest.raises(ValueError):
        V.fuse(ranks(spark, "a"), ranks(spark, "a"), "id", alpha=1.5)


def test_best_hit_of_several_candidates(spark):
    hits = spark.createDataFrame([(1, 0, "a", 0.2), (1, 1, "a", 0.5), (1, 0, "b", 0.4), (1, 1, "b", 0.4), (1, 2, "c", 0.1)], "q_id int, candidate int, id string, score double")
    assert [(r.id, r.candidate) for r in V.merge_best(hits, "id", 2).orderBy("rank").collect()] == [("a", 1), ("b", 0)]


def test_hybrid_search_end_to_end(spark):
    docs = spark.createDataFrame([(1, "prayer needs water", "s"), (2, "water is pure water", "s"), (3, "nothing alike", "s"), (4, "prayer needs water", "s"), (5, None, None), (6, "", "t")], "doc_id long, text string, source string")
    out = V.hybrid_search(spark.createDataFrame([(1, "prayer water"), (2, "")], "q_id int, text string"), docs).orderBy("q_id", "place").collect()
    assert [r.doc_id for r in out] == [1, 2] and {r.q_id for r in out} == {1}
    assert out[0].rerank_score == round(2 / math.sqrt(2 * 3), 9)


def test_exact_vector_search(spark):
    v = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(6)], "vec_id long, v array<double>")
    out = V.vector_top(v.filter("vec_id = 0").select(F.col("vec_id").alias("q_id"), F.col("v").alias("q")), v, 3).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [0, 1, 5]


def test_overlap_of_sets(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"]), (["a"], ["a"])], "a array<string>, b array<string>")
    assert [r.x for r in df.select(V.jaccard(F.col("a"), F.col("b")).alias("x")).collect()] == [1 / 3, 0.0, 1.0]


def test_ranking_measures(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 7), (2, "x", 1)], "q_id int, doc_id string, rank int")
    wanted = spark.createDataFrame([(1, "b"), (1, "c"), (2, "y"), (3, "z")], "q_id int, doc_id string")
    got = {r.q_id: r for r in E.ranking_measures(ranked, wanted).collect()}
    assert (got[1].recall_5, got[1].mrr, got[2].mrr, got[3].recall_20) == (1.0, 0.5, 0.0, 0.0)
    assert got[1].ndcg_10 == pytest.approx((1 / math.log2(3) + 1 / math.log2(8)) / (1 + 1 / math.log2(3)))


def test_citations_match_within_a_page(spark):
    e = spark.createDataFrame([(1, "Al  Hidaya", "2", 10), (1, "Other", None, None), (2, "Book", "1", 5)], "item_id int, book string, volume string, page int")
    a = spark.createDataFrame([(1, "al hidaya ", "2", "11"), (2, "Book", "3", "5"), (2, "Book", None, "x")], "item_id int, book string, volume string, page string")
    assert {r.item_id: r.accuracy for r in E.citation_accuracy(e, a).collect()} == {1: 0.5, 2: 0.0}


def test_grounding_edges(spark):
    answers = spark.createDataFrame([(1, "Water is pure. Fire burns down."), (2, ""), (3, None), (4, "Something said.")], "a_id int, text string")
    evidence = spark.createDataFrame([(1, "pure water here is"), (2, "some text")], "a_id int, text string")
    got = {r.a_id: (r.groundedness, r.hallucination_rate) for r in E.grounding(answers, evidence).collect()}
    assert got == {1: (0.5, 0.5), 2: (0.0, 0.0), 3: (1.0, 0.0), 4: (0.0, 1.0)}


def test_grades_and_scores(spark):
    df = spark.createDataFrame([("a b c", "a b c"), ("a b c d e f", "a x y z"), ("q", "a"), ("", "a")], "g string, e string")
    assert [r.x for r in df.select(E.lexical_grade(F.col("g"), F.col("e")).alias("x")).collect()] == [2, 1, 0, 0]
    raw = spark.createDataFrame([('{"score": 2}',), ("1",), ('"0"',), ("score = 1",), ("none",), (None,)], "r string")
    assert [r.x for r in raw.select(E.judge_score(F.col("r")).alias("x")).collect()] == [2, 1, 0, 1, 0, 0]


def test_latency_and_refusals(spark):
    lat = spark.createDataFrame([("a", float(x)) for x in (100, 200, 300, 400, 500)] + [("b", None)], "k string, ms double")
    assert [(r.k, r.p50, r.p95) for r in E.latency(lat, "k", "ms").collect()] == [("a", 300.0, 500.0)]
    import random

    r = random.Random(2)
    rows = [(k, float(r.choice([1, 2, 2, 3, r.random() * 50]))) for k, n in (("x", 1), ("y", 2), ("z", 3000), ("w", 20)) for _ in range(n)]
    for got in E.latency(spark.createDataFrame(rows, "k string, ms double"), "k", "ms").collect():
        own = sorted(v for k, v in rows if k == got.k)
        n = len(own)
        assert got.n == n and got.p50 == (own[(n - 1) // 2] + own[n // 2]) / 2 and got.p95 == own[min(n - 1, int(0.95 * n))]
    none = E.refusal_matrix(spark.createDataFrame([(False, False)], "expected boolean, given boolean")).first()
    assert (none.precision, none.recall, none.f1, none.tn) == (1.0, 1.0, 1.0, 1)
    gate = E.gate(spark.createDataFrame([("recall@10", 0.9), ("hallucination_rate", 0.2)], "metric string, actual double"))
    bad = {r.metric for r in gate.filter("violation").collect()}
    assert "hallucination_rate" in bad and "mrr" in bad and "recall@10" not in bad


def test_whole_table_queries_against_their_sql(spark, tmp_path):
    """The stated vectors ask all others, and all questions' fused hits are scored: rows as by SQL."""
    import duckdb

    from lectern.plans import catalog, documents  # noqa: F401

    con = duckdb.connect()
    for name, rows in (("embeddings", 40), ("documents", 60), ("benchmark", 12)):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(rows).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for name, key, many in (("dense_topk_cosine", "q_id", 1), ("payload_filter_topk", "q_id", 1), ("jaccard_rerank", "q_id", 12), ("best_sentence", "q_id", 12)):
        got = catalog.QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted(map(tuple, got)) == sorted(con.execute(catalog.ORACLES[name]).fetchall())
        assert len({r[key] for r in got}) == many


@pytest.mark.parametrize("most", [5_000_000, 0])
def test_scanned_rankings_equal_the_joins(spark, monkeypatch, most):
    """Both ways give every question's best, with ties by id, repeated and missing ids, and texts of no words."""
    import random

    from lectern.operators import scans

    monkeypatch.setattr(scans, "MOST_ASKED", most)
    monkeypatch.setattr(scans, "ROWS", 16)
    monkeypatch.setattr(scans, "ASKED", 2)
    r = random.Random(5)
    text = lambda: " ".join(r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.randint(0, 9)))
    rows = [(i, text()) for i in range(150)] + [(7, "a bb A c"), (7, "a"), (None, "a b c"), (None, "a"), (200, None), *[(i, "a a b") for i in range(300, 330)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = V.postings(spark.createDataFrame([(i, text() + " a") for i in range(5)] + [(9, ""), (8, None)], "q_id int, text string"), "q_id", "text")
    sparse = V.postings(docs, "doc_id", "text")
    want = {"dense": V.dense_top(V.dense_postings(asked, "q_id"), V.dense_postings(sparse, "doc_id"), 12), "sparse": V.sparse_top(asked, sparse, 12)}
    got = dict(zip(want, V.rankings(asked, docs, kinds=("dense", "sparse"), k=12)))
    for kind in want:
        assert got[kind].columns == want[kind].columns and sorted(map(tuple, got[kind].collect()), key=str) == sorted(map(tuple, want[kind].collect()), key=str)
    assert want["sparse"].count() == 60


def test_a_scan_hands_on_little_and_makes_no_pairs(spark):
    """What a search shuffles doesn't grow with questions times documents: no join of postings stands in its plan."""
    docs = spark.createDataFrame([(i, f"w{i % 7} x y") for i in range(400)], "doc_id long, text string").repartition(2)
    asked = V.postings(spark.createDataFrame([(i, "x y w1") for i in range(3)], "q_id int, text string"), "q_id", "text")
    plan = V.search(asked, docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
