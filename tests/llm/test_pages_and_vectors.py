"""Main text of pages and nearest neighbours, against plain versions; and the pipeline."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import html_text, neighbours


def test_nearest_against_brute_force(spark, monkeypatch):
    for name, value in (("BLOCK_CELLS", 16 * 50), ("LEAST_ROWS", 60), ("STEP_QUERIES", 3), ("STEP_CANDIDATES", 20)):
        monkeypatch.setattr(neighbours, name, value)
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 16)).astype(np.float32)
    x[50:90] = x[50]
    x[100] = x[51] * 1e-3
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(1000, [0.0] * 16, 1), (1001, None, 1), (1002, [float("nan")] * 16, 1), (1100, [float("inf")] + [1.0] * 15, 1), (None, [1.0] * 16, 1), (1200, [1.0] * 8, 1), (1300, [None] + [1.0] * 15, 1), (300, x[7].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = [(i, np.array(v, np.float64)) for i, v, _ in rows if i is not None and v and len(v) == 16 and all(e is not None and math.isfinite(e) for e in v) and any(v)]
    asked = {}
    for i, v in good:
        if i % 100 == 0 and (i not in asked or tuple(v) < tuple(asked[i])):
            asked[i] = v
    want = {}
    for q, v in asked.items():
        near = sorted((float(np.sqrt(np.add.accumulate((v - c) ** 2)[-1])), i) for i, c in good if i != q)[:10]
        want |= {(q, k): (i, s) for k, (s, i) in enumerate(near, 1)}
    got = {(g.query_id, g["rank"]): (g.vec_id, g.score) for g in neighbours.nearest(df.withColumn("tile", F.lit(1)), df.filter("vec_id % 100 = 0")).collect()}
    assert got == want
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_bounds_hold():
    r = np.random.default_rng(2)
    x, y = r.normal(size=(50, 32)), r.normal(size=(70, 32))
    (a, sa, ea), (b, sb, eb) = neighbours.codes(x), neighbours.codes(y)
    near = np.sqrt((((sa[:, None] * a)[:, None] - (sb[:, None] * b)[None]) ** 2).sum(axis=2))
    true = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    assert (np.abs(near - true) <= ea[:, None] + eb[None] + 1e-9).all()


@pytest.fixture(scope="module")
def labeller(spark):
    pages = [(i, f"http://x/{i}", html_text.written("plain words of a page about some thing".split(), 5000 + i).replace("yesyes ", "").replace("nono ", "")) for i in range(20)]
    return html_text.learn(spark.createDataFrame(pages, "page_id long, url string, html string"))


def test_blocks_of_malformed_markup():
    page = "<body><p>one <b>two&amp;</b>three<br>four<p>five  \n six<script>var x='</p>no'</script><!-- no --><ul><li>a<li>b</ul>a < b &eacute;"
    assert [b.text for b in html_text.blocks(page)] == ["one two&three", "four", "five six", "a", "b", "a < b é"]
    assert html_text.blocks(None) == [] and html_text.blocks("") == [] and html_text.blocks("<p> </p>") == []
    assert [b.text for b in html_text.blocks("<p title='unclosed>text" * 3)] != [None]


@pytest.mark.parametrize(("page", "want"), [
    ("<article><p>one</p><svg-icon></svg-icon><p>two</p></article>", ["one", "two"]), ("<p>a</p><svg/><p>b</p>", ["a", "b"]),
    ("<p>a</p><svg width='1' /><p>b</p><math/>c", ["a", "b", "c"]), ("<p>a</p><!--><p>b</p><!---><p>c</p>", ["a", "b", "c"]), ("a<!-- x --!>b<!-- > -->c", ["abc"]),
    ("<p>a<script>if (a<b) '</p>'</script>b</p>", ["ab"]), ("<script/>no</script>yes", ["yes"]), ("x<svg><g>no<p>y</p>", ["x", "y"]),
    ("a<svg><svg/><svg>no</svg>no</svg>b", ["ab"]), ("a<template>no<template>no</template>no</template>b", ["ab"]), ("a<object>b", ["ab"]), ("a<object>no</object>b", ["ab"]),
    ("<script src=\"a\"b'>no</script>yes", ["yes"]), ("a<style>no", ["a"]), ("<scripty>yes</scripty>", ["yes"]), ("a<math><p>b", ["a", "b"]), ("a<!-- no", ["a"]),
])
def test_what_markup_hides(page, want):
    assert [b.text for b in html_text.blocks(page)] == want


def test_written_pages_are_labelled(labeller):
    cache, wrong, total = {}, 0, 0
    for seed in range(20_000, 20_100):
        page = html_text.blocks(html_text.written("plain words of a page about some thing".split(), seed))
        own = [b for b in page if "yesyes" in b.text or "nono" in b.text]
        want = ["yesyes" in b.text for b in own]
        clean = [html_text.Block(b.path, " ".join(w for w in b.text.split() if w not in ("yesyes", "nono")) or "x", b.linked) for b in own]
        p = labeller.probabilities([html_text.described(clean, cache)])[0]
        wrong += sum((q >= 0.5) != y for q, y in zip(p, want))
        total += len(want)
    assert wrong / total < 0.03


def test_main_text(spark, labeller):
    body = "<nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Title &eacute;</h1><p>First  para.</p><p>Second.</article><div class='comments'><p>Great post!</p></div><footer>&copy; x</footer>"
    long = "<article>" + "<p>Sentence of the text here.</p>" * 3000 + "</article>"
    rows = [(1, "u", f"<html><head><title>t</title></head><body>{body}</body></html>"), (2, "u", None), (3, None, ""), (4, "u", "<p"), (5, "u", f"<body>{long}"), (5, "u", f"<body>{long}"), (None, "u", "<script>x</script>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("tile", F.lit("x"))
    out = html_text.extract(df, labeller, ["page_id", "url"]).collect()
    assert len(out) == 7
    by = {r.page_id: r.text for r in out}
    assert by[1] == "Title é First para. Second." and by[2] == by[3] == by[4] == by[None] == ""
    assert by[5] == " ".join(["Sentence of the text here."] * 3000)
    assert html_text.extract(df.limit(0), labeller, ["page_id"]).count() == 0


def test_pipeline_stage_by_stage(spark, odd, none, tmp_path):
    import corpus_pipeline as P

    from .test_documents import brute_components

    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "substring", "mixing", "bpe"]
    docs = odd
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out{k}")
        assert stage(spark, none, str(tmp_path)).count() == 0
        if k < 4:
            assert out.columns == P.COLUMNS
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
    kept = {r.doc_id for r in spark.read.parquet(f"{tmp_path}/out1").collect()}
    first = [(r.doc_id, r.text) for r in odd.collect()]
    want = brute_components([x for x in first if x[0] != 5])
    assert kept - {None, 5} == {i for i, c in want.items() if i == c and i != 5}
    assert P.run(spark, str(tmp_path)).count() == docs.count()


def test_pipeline_stages_take_effect(spark, odd, tmp_path):
    """Documents that the model rejects go and clean ones stay; the mix is that of its SQL; ids are the library's."""
    import duckdb
    import public_tokenizers
    import tiktoken

    import corpus_pipeline as P
    from lectern.llm import bpe, mixing

    from .conftest import prose
    from .test_documents import clashing

    rows, labels = [], []
    for i in range(300):
        words = prose(i, 50).split(" ")
        if i % 5 == 0:
            words[7:7] = ["vileness", "nastyword", "vileness"]
        rows.append((i, " ".join(words), ["en", "de"][i % 2], f"src{i % 3}", None))
        labels.append((i, 1, int(i % 5 == 0)))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = clashing(spark.createDataFrame(rows, odd.schema))
    left = P.toxic_documents(spark, docs, str(tmp_path))
    assert {r.doc_id for r in left.collect()} == {i for i in range(300) if i % 5}
    mixed = P.mixed_sources(spark, left, str(tmp_path))
    con = duckdb.connect()
    con.register("documents", left.toPandas())
    want = con.execute(f"WITH {mixing.sql('documents', **P.MIX)} SELECT doc_id FROM mixed").fetchall()
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(i for i, in want) and 0 < len(want) < 240
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe._ranks(bpe.default_rank_file()), special_tokens={})
    for r in P.token_ids(spark, mixed, str(tmp_path)).collect():
        assert r.ids == encoding.encode_ordinary(rows[r.doc_id][1]) and r.n_tokens == len(r.ids)


def test_components_against_union_find(spark):
    """Loops, repeats, null ends, either direction, a hub, and a long path."""
    import random

    from lectern.llm.components import components

    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(7, 7), (400, 400)] + [(500, 1000 + i) for i in range(300)] + [(2000 + i, 2001 + i) for i in range(60)]
    edges += edges[:20] + [(v, u) for u, v in edges[20:40]]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    met = {x for u, v in edges if u != v for x in (u, v)}
    df = spark.createDataFrame([*edges, (None, 3), (4, None), (None, None)], "u long, v long")
    assert {x.node: x.component for x in components(df).collect()} == {x: find(x) for x in met}
    assert components(df.limit(0)).count() == 0 and components(df.filter("u = v")).count() == 0
