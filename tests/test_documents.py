"""Layout, metadata and chunking of page frames, and answers."""

from pyspark.sql import functions as F

from lectern.operators import answers as A
from lectern.operators import chunking as C
from lectern.operators import layout as Y
from lectern.operators import metadata as M

FRAME = "doc_id string, page int, block_index int, x0 double, y0 double, x1 double, y1 double, text string, size double, width double, height double"


def page(spark, *blocks, number=1):
    return spark.createDataFrame([("d", b.get("page", number), i, *map(float, b.get("box", (72, 120 + 30 * i, 472, 140 + 30 * i))), b.get("text", "text"), float(b.get("size", 12)), 595.0, 842.0) for i, b in enumerate(blocks)], FRAME)


def test_two_columns_are_read_one_after_the_other(spark):
    left = [{"box": (60, y, 260, y + 15)} for y in (105, 145, 185)]
    right = [{"box": (320, y, 520, y + 15)} for y in (100, 140, 180)]
    df = page(spark, *[x for pair in zip(left, right) for x in pair])
    order = {r.block_index: r.reading_order for r in Y.reading_order(df).collect()}
    assert [k for k, _ in sorted(order.items(), key=lambda x: x[1])] == [0, 2, 4, 1, 3, 5]
    rtl = df.withColumn("text", F.lit("نص عربي"))
    order = {r.block_index: r.reading_order for r in Y.reading_order(rtl).collect()}
    assert [k for k, _ in sorted(order.items(), key=lambda x: x[1])] == [1, 3, 5, 0, 2, 4]


def test_regions(spark):
    df = page(spark, {"box": (72, 30, 472, 45)}, {"box": (72, 120, 472, 140)}, {"box": (72, 700, 472, 712), "size": 9}, {"box": (72, 800, 472, 815), "size": 10}, {"box": (12, 200, 40, 215)}, {"box": (72, 300, 73, 301)})
    got = {r.block_index: r.region for r in Y.regions(df).collect()}
    assert got == {0: "header", 1: "main", 2: "footnote", 3: "footer", 4: "margin", 5: "unknown"}
    rule = spark.createDataFrame([("d", 1, 0, 72.0, 650.0, 420.0, 651.0, 595.0, 842.0)], "doc_id string, page int, drawing_index int, x0 double, y0 double, x1 double, y1 double, width double, height double")
    low = page(spark, {"box": (72, 120, 472, 140)}, {"box": (72, 660, 472, 675)})
    assert {r.block_index: r.region for r in Y.regions(low, rule).collect()} == {0: "main", 1: "footnote"}


def test_file_names(spark):
    names = ["al-Hidaya vol 2 - al-Marghinani.pdf", "Bidayat_3rd edition_1998 by Ibn Rushd.pdf", "scan_001.pdf", "كتاب الجزء الثاني.pdf", "plain.pdf", ""]
    got = [r.f for r in spark.createDataFrame([(n,) for n in names], "n string").select(M.filename_fields(F.col("n")).alias("f")).collect()]
    assert (got[0].title, got[0].author, got[0].volume) == ("al-Hidaya", "al-Marghinani", "2")
    assert (got[1].author, got[1].edition, got[1].year) == ("Ibn Rushd", "3", "1998")
    assert got[3].volume == "2" and (got[4].title, got[4].author) == ("plain", None) and got[5].title is None


def test_pages_sections_and_fields(spark):
    def body(p, *rest):
        return [{"page": p, "text": "body text of this page, long enough to weigh the most"}, *rest]

    blocks = [
        *body(1, {"page": 1, "text": "Kitab al-Tahara", "size": 18, "box": (72, 200, 472, 220)}, {"page": 1, "text": "i", "size": 10, "box": (72, 800, 472, 815)}),
        *body(2, {"page": 2, "text": "Bab al-Wudu", "size": 14, "box": (72, 200, 472, 220)}, {"page": 2, "text": "2", "size": 10, "box": (72, 800, 472, 815)}),
        *body(3, {"page": 3, "text": "Kitab al-Salat", "size": 18, "box": (72, 200, 472, 220)}, {"page": 3, "text": "published by Dar X", "box": (72, 300, 472, 315)}),
    ]
    df = page(spark, *blocks)
    marks = M.headings(df)
    assert [(r.page, r.level) for r in marks.orderBy("place").collect()] == [(1, "kitab"), (2, "bab"), (3, "kitab")]
    last = df.groupBy("doc_id").agg(F.max("page").alias("last_page"))
    assert {(r.name, r.page_start, r.page_end) for r in M.sections(marks, last).collect()} == {("Kitab al-Tahara", 1, 2), ("Bab al-Wudu", 2, 3), ("Kitab al-Salat", 3, 3)}
    active = M.active_sections(df.select("doc_id", "page").distinct(), marks).orderBy("page").collect()
    assert [(r.kitab, r.bab) for r in active] == [("Kitab al-Tahara", None), ("Kitab al-Tahara", "Bab al-Wudu"), ("Kitab al-Salat", "Bab al-Wudu")]
    numbers = M.page_numbers(df).orderBy("page").collect()
    assert [(r.numeral, r.system, r.uncertain) for r in numbers] == [(1, "roman", False), (2, "latin", False), (None, "none", True)]
    assert M.numbering(M.page_numbers(df)).first().numbering == "mixed"
    names = spark.createDataFrame([("d", "scan.pdf")], "doc_id string, filename string")
    fields = {r.field: (r.value, r.source) for r in M.document_fields(names, df).collect()}
    assert fields == {"title": ("Kitab al-Tahara", "cover"), "publisher": ("Dar X", "first_pages")}
    assert M.document_confidence(M.document_fields(names, df), M.page_numbers(df)).first().confidence == round((0.7 + 0.55 + 0.9 + 0.9) / 4, 4)


UNITS = "doc_id string, unit int, text string, level string, page int, printed int"


def plain_packs(counts, most, overlap):
    packs, current, total, carry = [], [], 0, max(1, int(most * overlap))
    for i, c in enumerate(counts):
        if current and total + c > most:
            packs.append((current[0], current[-1]))
            tail, n = [], 0
            for j in reversed(current):
                if tail and n + counts[j] > carry:
                    break
                tail.insert(0, j)
                n += counts[j]
            current, total = tail, n
        current.append(i)
        total += c
    return packs + ([(current[0], current[-1])] if current else [])


def test_packs_against_a_plain_loop(spark):
    import random

    r = random.Random(4)
    lists = [[r.randint(1, 14) for _ in range(r.randint(0, 40))] for _ in range(60)] + [[], [500], [500, 1, 500]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, c array<int>")
    for most, overlap in ((10, 0.15), (30, 0.2), (320, 0.15)):
        got = df.select("i", C.packs(F.col("c"), most, overlap).alias("p")).orderBy("i").collect()
        assert [[(p.first, p.last) for p in g.p] for g in got] == [plain_packs(x, most, overlap) for x in lists]


def test_chunks_follow_structure_and_pages(spark):
    rows = [
        ("d", 0, "Kitab One", "kitab", 1, 1), ("d", 1, "Bab A", "bab", 1, 1), ("d", 2, "First sentence. It goes", None, 1, 1), ("d", 3, "on over the page.", None, 2, 2),
        ("d", 4, "A clean page.", None, 3, 3), ("d", 5, "Bab B", "bab", 3, 3), ("d", 6, "Body of b.", None, 3, 3), ("d", 7, "Bab C", "bab", 4, 4), ("d", 8, "  ", None, 4, 4),
    ]
    out = C.chunks(spark.createDataFrame(rows, UNITS)).orderBy("order_index").collect()
    assert [(r.normalized_text, r.bab, r.page_start, r.page_end) for r in out] == [("First sentence. It goes on over the page.", "Bab A", 1, 2), ("A clean page.", "Bab A", 3, 3), ("Body of b.", "Bab B", 3, 3)]
    assert out[0].raw_text == "Kitab: Kitab One\nBab: Bab A\n\nFirst sentence. It goes\non over the page." and out[0].context_heading == "Kitab: Kitab One\nBab: Bab A"
    assert out[0].chunk_id != out[1].chunk_id and out[0].token_count == 14


def test_oversized_segments_are_cut_at_finer_headings(spark):
    rows = [("d", 0, "Bab A", "bab", 1, 1), ("d", 1, "w " * 8, None, 1, 1), ("d", 2, "Fasl 1", "fasl", 1, 1), ("d", 3, "x " * 8, None, 1, 1), ("d", 4, "T", "topic", 1, 1), ("d", 5, "y " * 8, None, 1, 1)]
    df = spark.createDataFrame(rows, UNITS)
    assert {r.unit: r.segment for r in C.segments(df, 100).collect()} == dict.fromkeys(range(6), 1)
    assert {r.unit: r.segment for r in C.segments(df, 20).collect()} == {0: 1, 1: 1, 2: 2, 3: 2, 4: 2, 5: 2}
    assert {r.unit: r.segment for r in C.segments(df, 10).collect()} == {0: 1, 1: 1, 2: 2, 3: 2, 4: 3, 5: 3}


def test_units_are_dealt_out_by_their_characters(spark, monkeypatch):
    monkeypatch.setattr("lectern.sources.tables.ROWS_EACH", 10)
    df = spark.range(41).selectExpr("id AS doc_id", "0 AS unit", "repeat('word. ', 100) AS text", "CAST(NULL AS STRING) AS level", "0 AS page", "1 AS printed")
    assert C.segments(df).rdd.getNumPartitions() == 25 and C.chunks(df).rdd.getNumPartitions() == 25
    assert C.chunks(df).count() == 41


def test_questions_and_facts(spark):
    q = spark.createDataFrame([(0, "Who wrote this?"), (1, "book title please"), (2, "কত পৃষ্ঠা?"), (3, "الناشر من"), (4, "why"), (5, None)], "i int, t string")
    assert [r.x for r in q.select("i", A.intent(F.col("t")).alias("x")).orderBy("i").collect()] == ["author", "title", "page_count", "publisher", "explanation", "explanation"]
    ranked = spark.createDataFrame([(1, 1, "a", "nothing"), (1, 2, "b", "Written by Someone Known"), (1, 3, "c", "author: Other")], "q_id int, rank int, chunk_id string, text string")
    assert [(r.value, r.chunk_id) for r in A.facts(ranked, "author").collect()] == [("Someone Known", "b")]
    pairs = spark.createDataFrame([(1, "a", "pure water", "Fire burns. Water is pure. Pure water it is.")], "q_id int, chunk_id string, question string, text string")
    assert [(r.sentence, r.hits) for r in A.best_sentences(pairs).collect()] == [("Water is pure.", 2)]


def test_texts_that_are_hit_are_cut_once(spark, monkeypatch):
    """Only texts that are hit go on, one row each, however many questions hit them; the sentences are those of pairs with texts."""
    from lectern.plans import documents

    made = [(i, f"Water {i} is pure. Fire {i} burns. Pure water it is.") for i in range(6)]
    texts = spark.createDataFrame(made, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "pure water"), (2, "fire burns 3")], "item_id int, text string")
    found = spark.createDataFrame([(1, 0), (1, 3), (2, 3)], "q_id int, doc_id long")
    written, keep = {}, documents.stored
    monkeypatch.setattr(documents, "stored", lambda df, name: written.setdefault(name, keep(df, name)))
    monkeypatch.setattr(documents, "read", lambda spark, sf_dir, table: {"documents": texts, "benchmark": asked}[table])
    monkeypatch.setattr(documents, "rrf_fuse", lambda spark, sf_dir: found)
    got = sorted(map(tuple, documents.best_sentence(spark, "").collect()))
    pairs = spark.createDataFrame([(q, i, {1: "pure water", 2: "fire burns 3"}[q], made[i][1]) for q, i in ((1, 0), (1, 3), (2, 3))], "q_id int, chunk_id long, question string, text string")
    assert got == sorted(map(tuple, A.best_sentences(pairs).collect())) and len(got) == 3
    assert sorted(r.chunk_id for r in written["told"].collect()) == [0, 3]


def test_confidence_levels(spark):
    rows = [(1, r, 0.7, "t", "", True) for r in (1, 2, 3)] + [(2, 1, 0.4, "t", "", False), (2, 2, 0.1, "u", "", False), (3, 1, 0.1, None, " ", None)]
    got = {r.q_id: (r.level, r.agreement) for r in A.confidence(spark.createDataFrame(rows, "q_id int, rank int, rerank_score double, topic string, kitab string, verified boolean")).collect()}
    assert got == {1: ("high", "consensus"), 2: ("medium", "conflict"), 3: ("low", "consensus")}


def test_markup_is_made_inert():
    assert A.sanitised("<p onclick='x'>a<script>alert(1)</script></p>") == "<p>aalert(1)</p>"
    assert A.sanitised('<a href="javascript:x">b</a><a href="https://e.org" dir=rtl>c</a>') == '<a>b</a><a href="https://e.org" dir="rtl">c</a>'
    assert A.sanitised("1 < 2 & 3<br/><!-- c -->") == "1 &lt; 2 &amp; 3<br/>" and A.sanitised(None) is None
    assert len(A.sanitised("x" * 100_000)) == A.LONGEST


def test_replies_are_validated(spark):
    good = '```json\n{"answer_language":"en","explanation":{"html":"<p>x [EVIDENCE_1]</p>"},"citations":[{"chunk_id":"a"}]}\n```'
    rows = [good, "no json", good.replace('"en"', '"bn"'), good.replace("<p>x [EVIDENCE_1]</p>", " "), good.replace('"a"', '"z"'), good.replace("EVIDENCE_1", "EVIDENCE_2"), good.replace('"citations"', '"refusal":{"reason":"tired"},"citations"')]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = [r.x for r in df.select("i", A.reply_error(F.col("t"), F.array(F.lit("a"), F.lit("b")), F.lit("en")).alias("x")).orderBy("i").collect()]
    assert got == [None, "not an object", "language", "no text", "unknown citation", "uncited evidence", "refusal reason"]
