"""Operators over documents, against plain versions of them."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import boosting, bpe, jaccard, language, mixing, queries, scoring, simhash, substring, toxicity
from lectern.llm.common import fold, least_hashed
from lectern.llm.mixing_model import Code, Counts, Model, count_pairs, packed_logits, words_of

from .conftest import odd_rows, prose

WORDS = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORDS.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def clashing(df):
    """The same rows with more columns whose names operators use inside."""
    return df.withColumns({n: F.lit(1) for n in ("id", "n", "k1", "body", "token", "score_", "u", "v")})


# --- fingerprints ---------------------------------------------------------------------------------------------------

def test_edited_fingerprints(spark, plain, odd, none):
    rows = {r.doc_id: r for r in simhash.edited_fingerprints(clashing(plain)).collect()}
    texts = {r.doc_id: r.text or "" for r in plain.collect()}
    ids = sorted(texts, reverse=True)
    for a, b in zip(ids, ids[1:] + ids[:1]):
        n, t = len(texts[a]), texts[a]
        edited = t[: n - n // 3] + texts[b][: n // 3]
        assert rows[a].n_chars == n
        assert rows[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        x, y, z = (int(v, 16) for v in (rows[a].fingerprint, rows[a].edited_fingerprint, rows[b].fingerprint))
        assert rows[a].near_edited == 1 - (x ^ y).bit_count() / 128
        assert rows[a].near_next == 1 - (x ^ z).bit_count() / 128
    assert rows[3].fingerprint == rows[20].fingerprint == rows[22].fingerprint
    assert rows[23].fingerprint == rows[24].fingerprint == rows[25].fingerprint == "0" * 32
    assert simhash.edited_fingerprints(odd).count() == odd.count()
    assert simhash.edited_fingerprints(none).count() == 0


def test_ids_far_away_and_null_ids_are_cut_into_ranges(spark, monkeypatch):
    """Every document follows the next greater id, however ids lie; those without an id stand below all others."""
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 2)
    ids = [*range(100), 2**62, -(2**62), 10**12, *[10**12 + 7 * i for i in range(1, 40)], *[None] * 60]
    rows = [(d, f"text {k} of {d} " + "x" * (k % 5)) for k, d in enumerate(ids)]
    near = simhash.neighbours(spark.createDataFrame(rows, "doc_id long, text string")).filter("_tail = 0").collect()
    named = sorted((d, t) for d, t in rows if d is not None)
    after = {t: named[k - 1][1] for k, (_, t) in enumerate(named) if k}
    assert {r._text: r._next for r in near if r._id is not None and r._id != -(2**62)} == after
    below = {r._text: r._next for r in near if r._id is None or r._id == -(2**62)}
    at, seen = named[0][1], []
    while at in below:
        at = below.pop(at)
        seen.append(at)
    assert not below and seen[-1] == named[-1][1] and len(seen) == 61
    sizes = Counter(r._group for r in near)
    assert max(sizes.values()) <= 2 * simhash.FAR


def test_one_document_follows_itself(spark, plain):
    r = simhash.edited_fingerprints(plain.filter("doc_id = 4")).first()
    text = plain.filter("doc_id = 4").first().text
    n = len(text)
    assert r.edited_sha256 == hashlib.sha256((text[: n - n // 3] + text[: n // 3]).encode()).hexdigest() and r.near_next == 1


def test_fingerprints_follow_the_votes(spark, plain):
    """The bits against a plain count of votes, with Spark's hash of each shingle."""
    text = plain.filter("doc_id = 6").first().text
    w = WORDS.findall(text.translate(FOLD))
    table = spark.createDataFrame([tuple(w[i : i + 5]) for i in range(len(w) - 4)], "a string, b string, c string, d string, e string")
    got = table.select(F.xxhash64("a", "b", "c", "d", "e").alias("h")).select("h", F.xxhash64("h").alias("g")).collect()
    bits = ""
    for name in ("h", "g"):
        word = sum(1 << k for k in range(64) if 2 * sum(r[name] >> k & 1 for r in got) > len(got))
        bits += f"{word:016x}"
    assert simhash.fingerprints(plain.filter("doc_id = 6")).first().fingerprint == bits


def test_all_fingerprints_within_the_radius(spark):
    r = np.random.default_rng(3)
    base = [int.from_bytes(r.bytes(16), "big") for _ in range(30)]
    prints = base + [b ^ sum(1 << int(k) for k in r.choice(128, n, replace=False)) for b in base for n in (1, 3, 4, 6)]
    df = spark.createDataFrame([(i, f"{p:032x}") for i, p in enumerate(prints)] + [(999, None), (1000, f"{base[0]:032x}")], "doc_id long, fingerprint string")
    got = {(x.fingerprint, x.other): x.distance for x in simhash.within(df, 4).collect()}
    texts = sorted({f"{p:032x}" for p in prints})
    want = {(a, b): d for i, a in enumerate(texts) for b in texts[i + 1 :] if (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= 4}
    assert got == want


# --- mixing and substring: against their SQL --------------------------------------------------------------------------

def duck(docs, sql):
    import duckdb

    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    return con.execute(sql).fetchall()


def test_mixing_against_sql(spark, plain, odd, none):
    for share, epochs in ((0.3, 1), (0.9, 2), (2.5, 3), (5.0, 2)):
        args = {"share": share, "epochs": epochs, "weights": {"domain": {"*": 1, "domain1": 5}, "language": {"de": 3, "*": 2}}}
        got = mixing.mix(plain, **args).select("doc_id", "_epoch", F.col("_leaf_budget").cast("long")).collect()
        want = duck(plain, f"WITH {mixing.sql('documents', **args)} SELECT doc_id, epoch, CAST(budget AS BIGINT) FROM mixed")
        assert sorted(map(tuple, got)) == sorted(want)
    assert mixing.mix(none).count() == 0
    twice = mixing.mix(odd, share=0.6).groupBy("doc_id", "text", "_epoch").count().filter("doc_id = 4").collect()
    assert all(r["count"] == 2 for r in twice)


def test_mixing_keeps_columns_of_any_name(spark, plain):
    names = ("budget", "rest", "full", "available", "capacity", "weight", "key", "bucket", "n_tokens", "upto", "before", "root", "id")
    wide = plain.withColumns({n: F.lit(5) for n in names}).withColumns({n: F.lit("own") for n in ("domain", "language", "source_name", "_rest", "_epoch")})
    got, want = mixing.mix(wide, share=0.6).collect(), mixing.mix(plain, share=0.6).collect()
    assert sorted((r.doc_id, r._epoch, r.domain) for r in got) == sorted((r.doc_id, r._epoch, r.domain) for r in want)
    assert all(r[n] == 5 for r in got for n in names)


def test_rows_without_an_id_are_mixed_together(spark, odd):
    """All of a leaf is taken where the budget holds it; a leaf without tokens has nothing to give."""
    rows = mixing.mix(odd.filter("doc_id is null"), share=1.0, epochs=1).collect()
    assert [r.text for r in rows] == [r[1] for r in odd_rows() if r[0] is None and r[1] is not None]


def test_shortages_go_to_siblings_before_ancestors(spark):
    rows = [("a", "x", "s1", 100), ("a", "x", "s2", 1000), ("b", "x", "s3", 1000)]
    df = spark.createDataFrame(rows, "domain string, language string, source_name string, n_tokens long")
    got = {r.source_name: int(r.budget) for r in mixing.leaf_budgets(df, F.lit(1000), 1).collect()}
    assert got == {"s1": 100, "s2": 400, "s3": 500}
    got = {r.source_name: int(r.budget) for r in mixing.leaf_budgets(df, F.lit(2000), 1).collect()}
    assert got == {"s1": 100, "s2": 900, "s3": 1000}
    got = {r.source_name: int(r.budget) for r in mixing.leaf_budgets(df.filter("source_name <> 's2'"), F.lit(1000), 1).collect()}
    assert got == {"s1": 100, "s3": 900}


def test_substring_against_sql(spark, plain, odd, none):
    got = substring.deduplicate(clashing(plain)).select("doc_id", "text").collect()
    want = duck(plain, f"WITH {substring.sql('documents')} SELECT doc_id, text FROM deduped")
    told = {r.id: (len(r.removed), ",".join(f"{a}-{b}" for a, b in r.removed)) for r in substring.repeats(plain).collect()}
    spans = duck(plain, f"WITH {substring.sql('documents')} SELECT doc_id, n_spans, spans FROM deduped WHERE n_spans > 0")
    assert told and told == {i: (n, s) for i, n, s in spans}
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert substring.deduplicate(odd).count() == odd.count() and substring.deduplicate(none).count() == 0


def test_passage_inside_a_line_is_found(spark):
    passage = " ".join(f"Words number {i} of a passage that is shared by two texts here." for i in range(6))
    rows = [(1, f"A start of its own here {passage} and an end of one."), (2, f"Quite another beginning of a line {passage} then more"), (3, None)]
    out = {r.doc_id: r for r in substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].text == rows[0][1] and out[1]._removed is None and out[3].text is None
    assert "number 3" not in out[2].text and out[2].text.startswith("Quite another")
    assert all(rows[1][1][r.start : r.end].strip().startswith("Words number") for r in out[2]._removed)


# --- the join -----------------------------------------------------------------------------------------------------------

def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def test_jaccard_against_brute_force(spark, odd, none):
    plain = [r[:2] for r in odd_rows() if r[0] != 5]
    got = jaccard.jaccard_classes(clashing(odd.filter("doc_id is null or doc_id <> 5")))
    want = brute_components(plain)
    for r in got.collect():
        assert r.component_id == want.get(r.doc_id)
    assert {r.n_shingles for r in got.filter("doc_id = 3").collect()} == {len(shingle_set(dict(plain)[3]))}
    assert jaccard.jaccard_classes(none).count() == 0
    two = {r.component_id for r in jaccard.jaccard_classes(odd.filter("doc_id = 5")).collect()}
    assert two == {5}


def test_small_sets_and_heavy_lists(spark):
    """Sets around the boundary, and a family of near copies longer than a list may be before it counts as heavy."""
    import random

    r = random.Random(11)
    rows, base = [], [f"w{i}" for i in range(60)]
    for k in range(80):
        words = list(base)
        for _ in range(r.randint(0, 6)):
            words[r.randrange(60)] = f"x{r.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    for k in range(100, 220):
        n = r.randint(1, 20)
        words = [f"s{r.randrange(3)}" for _ in range(3)] + [f"y{(k % 7)}_{i}" for i in range(n)]
        if r.random() < 0.5:
            words.append(f"z{k}")
        rows.append((k, " ".join(words)))
    got = {x.doc_id: x.component_id for x in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_more_heavy_shingles_than_the_order_knows(spark, monkeypatch):
    """Lists of heavy shingles that are ordered as if they were rare are met by hubs and tiles, and no link is lost."""
    import random

    monkeypatch.setattr(jaccard, "HEAVY", 4)
    r = random.Random(12)
    base = [[f"{c}{i}" for i in range(40)] for c in "abc"]
    rows = []
    for k in range(90):
        words = list(base[k % 3])
        for _ in range(r.randint(0, 5)):
            words[r.randrange(40)] = f"x{r.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for known in (0, 20, 10**6):
        monkeypatch.setattr(jaccard, "KNOWN_HEAVY", known)
        unknown = jaccard.heavy_shingles(docs)[2]
        assert (unknown is None) == (known == 10**6)
        assert {x.doc_id: x.component_id for x in jaccard.jaccard_classes(docs).collect()} == brute_components(rows)


def test_toxicity_without_labels_keeps_every_document(spark, odd):
    """An empty table of labels scores everything 0; a kept column that clashes with the score is refused."""
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    scorer = toxicity.fit(odd, labels)
    scored = toxicity.score_texts(odd, scorer, ["doc_id", "text"]).collect()
    assert len(scored) == odd.count() and {r.score for r in scored} == {0.0}
    with pytest.raises(ValueError):
        toxicity.score_texts(odd.withColumn("score", F.lit(1)), scorer, ["doc_id", "score"])


def test_long_heavy_lists_are_cut_into_bands_and_parts(spark, monkeypatch):
    """A passage in texts of all sizes: lists of many tiles, in which links cross parts and bands."""
    import random

    monkeypatch.setattr(jaccard, "TILE", 7)
    r = random.Random(13)
    shared = [f"p{i}" for i in range(12)]
    rows = []
    for family in range(30):
        base = shared + [f"f{family}_{i}" for i in range(r.randint(1, 90))]
        for k in range(4):
            words = base + [f"e{family}_{i}" for i in range(k * len(base) // 12)]
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    assert {x.doc_id: x.component_id for x in jaccard.jaccard_classes(docs).collect()} == want
    assert len(set(want.values())) < len(rows)


def test_tiles_hold_every_pair_that_may_link_once(spark, monkeypatch):
    """Members of one list of any sizes: each pair of sizes that may link meets in one tile, on its two sides."""
    monkeypatch.setattr(jaccard, "TILE", 5)
    sizes = {i: 1 + i * i // 9 for i in range(60)}
    rows = [(1, len(sizes), i, n, i, [i], [1]) for i, n in sizes.items()]
    tiles = jaccard._tiles(spark.createDataFrame(rows, "token long, members long, id long, n long, component long, light array<long>, dense array<long>"))
    held = {}
    for x in tiles.collect():
        held.setdefault(x.tile, []).append((x.id, x.side))
    met = [(min(a, b), max(a, b)) for t in held.values() for a, s in t for b, q in t if a < b and (s != q or s == 2)]
    assert len(met) == len(set(met))
    assert {(a, b) for a in sizes for b in sizes if a < b and 100 * min(sizes[a], sizes[b]) >= 80 * max(sizes[a], sizes[b])} <= set(met)
    assert max(map(len, held.values())) < 40 and len(met) < len(sizes) * (len(sizes) - 1) // 4


def test_counts_and_lists_are_held_in_pieces():
    """A shingle that every text holds travels once for a batch and is added up as it comes; lists are never cut."""
    import numpy as np
    import pyarrow as pa

    texts = [f"one two three four five own{i} a{i} b{i} c{i}" for i in range(300)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 100)), pa.array(texts[k : k + 100])], ["id", "text"]) for k in (0, 100, 200)]
    packed = list(jaccard._packed(8)(iter(batches)))
    assert sum(len(x) for b in packed for x in b.column("again").to_pylist()) == 3 * 5
    by_bucket = pa.Table.from_batches(packed).sort_by("bucket").to_batches(max_chunksize=7)
    for most in (1, 10, 10**6):
        got = pa.Table.from_batches(jaccard._counted(8, most)(iter(by_bucket))).to_pydict()
        assert got["df"] == [300]
        assert got["token"] == [int(np.int64(jaccard.shingles("one two three four five")[0] >> np.uint64(16)))]
    token = np.repeat(np.arange(40), 5)
    postings = [pa.RecordBatch.from_arrays([pa.array(token[i : i + 3]), pa.array(np.arange(200)[i : i + 3]), pa.array(np.full(200, 9)[i : i + 3])], ["token", "id", "n"]) for i in range(0, 200, 3)]
    pieces = list(jaccard._whole_lists(iter(postings), 12))
    assert len(pieces) > 10 and all(len(t) % 5 == 0 for t, *_ in pieces)
    assert np.concatenate([i for _, i, _ in pieces]).tolist() == list(range(200))
    assert list(jaccard._whole_lists(iter([]))) == []


def test_sets_of_four_and_five_link_under_a_high_boundary(spark):
    """Texts of eight words and the same with a ninth, beside sets that move the boundary above four."""
    rows = [(i, " ".join(f"a{i}_{j}" for j in range(8))) for i in range(12)]
    rows += [(100 + i, f"{rows[i][1]} ninth") for i in range(6)]
    rows += [(200 + i, " ".join(f"b{i}_{j}" for j in range(10 + i % 3))) for i in range(9)]
    assert jaccard.boundary(Counter(len(shingle_set(t)) for _, t in rows)) > 4
    got = {x.doc_id: x.component_id for x in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + i] == i for i in range(6)) and got == brute_components(rows)


# --- language ---------------------------------------------------------------------------------------------------------------

def test_languages_are_told_apart(spark, odd, none):
    texts = {"en": "the quick brown fox and the lazy dog with what they thought ", "de": "der schnelle braune fuchs und der faule hund über straßen ", "fr": "le renard brun et rapide où ça été très élevé "}
    rows = [(i, t * (1 + i % 4), lang, "s", 1) for i, (lang, t) in enumerate(list(texts.items()) * 8)]
    rows += [(100, "1234 !!", "en", "s", 1), (101, None, "en", "s", 1), (102, "", None, "s", 1), (103, texts["de"] * 3000, None, "s", 1)]
    docs = spark.createDataFrame(rows, odd.schema)
    out = {r.doc_id: r for r in language.identify(docs, language.learn(docs, F.col("doc_id") < 12), ["doc_id"]).collect()}
    assert all(out[i].lang_pred == lang for i, (lang, _) in enumerate(list(texts.items()) * 8))
    assert [out[i].lang_pred for i in (100, 101, 102, 103)] == ["und", "und", "und", "de"]
    assert all(0 <= r.score <= 1 for r in out.values())
    assert language.identify(none, language.learn(none, F.lit(True)), ["doc_id"]).count() == 0
    assert {r.lang_pred for r in language.identify(odd, {}, ["doc_id"]).collect()} == {"und"}


def test_guesses_against_plain_ranks(spark, odd):
    """Profiles and out-of-place distances, worked out again from lists of n-grams in order of rank."""
    def plain_ranks(texts):
        found = Counter()
        for t in texts:
            keys, counts = language.grams(t)
            found.update(dict(zip(keys.tolist(), counts.tolist())))
        return [g for g, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))][: language.PROFILE]

    known = [r for r in {(i, t, lang) for i, t, lang, *_ in odd_rows()} if r[0] is not None and r[0] % 2 and r[1] is not None and r[2] is not None]
    profiles = language.learn(odd, F.col("doc_id") % 2 == 1)
    want = {lang: plain_ranks([t for _, t, x in known if x == lang]) for lang in {x for *_, x in known}}
    assert {k: v.tolist() for k, v in profiles.items()} == {k: v for k, v in want.items() if v}
    guess = language.Guess(profiles)
    for _, text, *_ in odd_rows():
        own = plain_ranks([text])
        away = {lang: sum(min(abs(p.index(g) - i), language.PROFILE) if g in p else language.PROFILE for i, g in enumerate(own)) for lang, p in want.items() if p}
        if not own:
            assert guess(text) == ("und", 0.0)
        else:
            best = min(sorted(away), key=away.get)
            assert guess(text) == (best, 1 - away[best] / (len(own) * language.PROFILE))


def test_least_hashed_rows(spark):
    """All of a small group, the bound of a large one, the same whatever the partitioning."""
    rows = spark.createDataFrame([(i, "a" if i < 5000 else "b") for i in range(5030)], "doc_id long, lang string")
    got = least_hashed(rows, "lang", 100)
    assert {r.lang: r["count"] for r in got.groupBy("lang").count().collect()} == {"a": 100, "b": 30}
    assert sorted(got.collect()) == sorted(least_hashed(rows.repartition(7), "lang", 100).collect())
    assert least_hashed(rows.limit(0), "lang", 100).count() == 0


def test_profile_against_plain_counts():
    text = "Ab, ba ab!"
    keys, counts = language.grams(text)
    clean, want = " ab ba ab ", Counter()
    for n in (1, 2, 3):
        for i in range(len(clean) - n + 1):
            g = clean[i : i + n]
            if g != " " and not (n == 3 and g[1] == " "):
                want[g] += 1
    name = lambda k: "".join(chr(k >> s & 0x1FFFFF) for s in (42, 21, 0) if k >> s)
    assert {name(int(k)): int(c) for k, c in zip(keys, counts)} == want


# --- tokens -------------------------------------------------------------------------------------------------------------------

def test_bpe_against_the_library(spark, odd, none):
    """With runs of any length: texts with NULs and other controls, repeated rows, and no other column at all, too."""
    import public_tokenizers
    import tiktoken

    path = bpe.default_rank_file()
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe._ranks(path), special_tokens={})
    controls = ["a \0b", "\0", "\0a \0 b\0", " \0", "a\x1cb \x85c", "\x0b \x0c", "x ", " x", "it's 12 we'll", "\u3000x \u200by", "<|endoftext|>"]
    more = [(1000 + i, t, "en", "src0", None) for i, t in enumerate(controls)]
    rows = [*odd_rows(), *more, more[0]]
    docs = odd.union(spark.createDataFrame([*more, more[0]], odd.schema))
    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(encoding.encode_ordinary(t or ""))
    for chars in (bpe.RUN_CHARS, 2000, 1):
        got = bpe.decode(bpe.encode(clashing(docs).drop("lang"), run_chars=chars)).collect()
        assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(x)) for i, xs in texts.items() for x in xs)
        assert all(encoding.decode_bytes(r.ids) == r.decoded and r.score_ == 1 for r in got)
    alone = bpe.encode(docs.select("text"))
    assert alone.columns == ["ids"] and Counter(tuple(r.ids) for r in alone.collect()) == Counter(tuple(x) for xs in texts.values() for x in xs)
    assert bpe.encode(none).columns == ["doc_id", "lang", "source", "n_chars", "ids"] and bpe.digests(none).count() == 0


def test_a_bucket_encodes_each_word_once(monkeypatch):
    asked = []
    monkeypatch.setattr(bpe, "encode_piece", lambda w, ranks: asked.append(w) or [len(w)])
    import pyarrow as pa
    import zstandard

    pack, unpack = zstandard.ZstdCompressor().compress, zstandard.ZstdDecompressor().decompress
    lists = [(0, [b"a", b"bb"]), (0, [b"bb", b"", b"ccc"]), (1, [b"d"])]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 7]), pa.array([b for b, _ in lists], pa.int32()), pa.array([pack(bpe._joined(w)) for _, w in lists])], ["run", "bucket", "words"])
    out = next(bpe._encoded(bpe.default_rank_file())(iter([batch])))
    got = [[np.frombuffer(i, np.uint16).tolist() for i in bpe._split(unpack(b))] for b in out.column(2).to_pylist()]
    assert got == [[[1], [2]], [[2], [0], [3]], [[1]]] and sorted(asked) == [b"", b"a", b"bb", b"ccc", b"d"]


def test_positions_and_words_are_packed_without_loss():
    r = np.random.default_rng(8)
    for ranks in (np.zeros(0, np.int32), np.zeros(5, np.int32), np.arange(70), r.zipf(1.3, 5000) % 2_000_000, r.integers(0, 1 << 30, 1000)):
        assert np.array_equal(bpe.decoded(bpe.coded(np.asarray(ranks, np.int32))), ranks)
    for items in ([], [b""], [b"a", b"", b"bc" * 40], [b"x" * 300, b"", b"y"]):
        assert bpe._split(bpe._joined(items)) == items


# --- toxicity -------------------------------------------------------------------------------------------------------------------

def test_toxicity_on_held_out_documents(spark, odd, none):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = prose(i, 60).split(" ")
        for k in range(3 if bad else 0):
            words.insert(5 + 9 * k, ["nastyword", "vileness"][k % 2])
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    labels += [(1, 1, None), (None, 1, 1), (9999, 0, 1)]
    docs, marks = spark.createDataFrame(rows, odd.schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scorer = toxicity.fit(docs, marks)
    out = toxicity.score_texts(docs.unionByName(odd), scorer, ["doc_id", "lang"]).collect()
    assert len(out) == 400 + odd.count() and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out[:400] if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in held)
    assert toxicity.score_texts(none, scorer, ["doc_id"]).count() == 0
    nothing = toxicity.fit(none, marks.limit(0))
    assert {r.score for r in toxicity.score_texts(odd, nothing, ["doc_id"]).collect()} == {0.0}


def plain_isotonic(margin, y):
    """The least squares fit that never falls, by its formula: greatest lower averages of rows in order, ties together."""
    values = sorted({margin.min() - 1, margin.max() + 1, *margin.tolist()})
    total = [sum(b for a, b in zip(margin, y) if a == v) + (v > margin.max()) for v in values]
    count = [sum(a == v for a in margin) + (v > margin.max() or v < margin.min()) for v in values]
    average = lambda i, j: sum(total[i : j + 1]) / sum(count[i : j + 1])
    n = len(values)
    return values, [max(min(average(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]


def test_calibration_against_its_formula():
    r = np.random.default_rng(4)
    for n, steps in ((1, 1), (2, 1), (6, 2), (40, 5), (60, 1000)):
        margin = r.integers(0, steps, n) / 4.0
        y = (r.random(n) < 0.2 + 0.6 * margin / max(1, margin.max() or 1)).astype(float)
        knots = boosting.fit_isotonic(margin, y)
        order = r.permutation(n)
        again = boosting.fit_isotonic(margin[order], y[order])
        assert all(np.allclose(a, b) for a, b in zip(knots, again))
        values, want = plain_isotonic(margin, y)
        # Each block of the fit is a run of equal wanted values, and its knot their weighted middle.
        assert np.allclose(sorted(set(np.round(want, 12))), np.round(sorted(set(np.round(knots[1], 12))), 12))
        assert (np.diff(knots[1]) >= 0).all() and (np.diff(knots[0]) > 0).all()
    assert np.allclose(boosting.calibrated(np.zeros(4), boosting.fit_isotonic(np.zeros(4), np.array([1.0, 0, 0, 0]))), 0.25)


def test_trees_against_plain_walks():
    r = np.random.default_rng(6)
    x = np.round(r.normal(size=(300, 4)), 1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = boosting.fit_forest(x, y, trees=12)
    for row, margin in zip(x[:50], forest.margin(x[:50])):
        total = forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        assert abs(total - margin) < 1e-9
    assert np.mean((forest.margin(x) > 0) == (y == 1)) > 0.95


# --- scores ---------------------------------------------------------------------------------------------------------------------

def test_scores_against_plain_counts(spark, odd, none, monkeypatch):
    held = F.coalesce(fold(7), F.lit(-1)) == 2
    cnt = Counter()
    for i, t, *_ in odd_rows():
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            cnt.update([*words_of(t), b"\n"])
    n, v = sum(cnt.values()), len(cnt)
    base = lambda t: sum(math.log10((cnt[w] + 1) / (n + v + 1)) for w in [*words_of(t), b"\n"])
    for frequent in (scoring.FREQUENT, 20):
        monkeypatch.setattr(scoring, "FREQUENT", frequent)
        got = scoring.score(clashing(odd), held).collect()
        assert len(got) == odd.count()
        texts = defaultdict(list)
        for i, t, *_ in odd_rows():
            texts[i].append(t)
        for r in got:
            assert any(abs(r.base_score - base(t)) < 1e-6 * abs(base(t)) and r.n_tokens == len(words_of(t)) + 1 and r.n_known == sum(cnt[w] > 0 for w in [*words_of(t), b"\n"]) for t in texts[r.doc_id])
            assert r.train_tokens == n and r.score < 0
    assert scoring.score(none, held).count() == 0


def test_model_is_a_distribution():
    """The probabilities of all bytes after some text add up to one."""
    texts = [prose(i, 80).replace("\n", " ").encode() for i in range(30)]
    pairs = sum(count_pairs(texts[i : i + 5]) for i in range(0, 30, 5))
    code = Code(pairs.reshape(256, 256))
    counts = Counts()
    counts.add(texts[:25], code)
    words = Counter(w for t in texts[:25] for w in t.split())
    counts.add_words(list(words), np.array(list(words.values())), code, 0.01)
    model = Model(code, [packed_logits(c) for c in counts.parts()])
    model.train(texts[25:])
    before = b"ba kemo"
    own = model.log10([before])[0]
    # What ends here, and every byte that may stand here, of whose text the end mark's share is taken off again.
    total = 0.0
    data, step = [], []
    for b in range(256):
        at, s, _ = code.walk(np.array([before[-1] * 256 + b]))
        data.append(b)
        step.append(s)
    from lectern.llm.mixing_model import CONTEXTS, contexts, laid_out, slots

    for b, s in zip(data, step):
        d, begins = laid_out([before[:] + bytes([b])])
        d = d[: len(before) + 1]
        one, h = contexts(d, begins)
        node, bit = (s >> 1).astype(np.uint64), s & 1
        at = np.full(len(s), len(before))
        x = [model.tables[0][s >> 1]] + [model.tables[k + 1][slots(h[k], at, node, CONTEXTS[k][1])] for k in range(2)]
        gate = (x[1] & 3) << 2 | x[2] & 3
        dot = sum(model.weights[gate, k] * (x[k] >> 2) / 256 for k in range(3))
        total += float(np.prod(1 / (1 + np.exp((1 - 2 * bit) * dot))))
    assert abs(total - 1) < 1e-4 and own < 0


def test_two_bytes_tell_what_follows():
    """After an order 4 context that wasn't seen, the last two bytes still predict; one byte says nothing here."""
    texts = [(b"abx cby", b"cby abx")[i % 2] for i in range(40)]
    code = Code(count_pairs(texts).reshape(256, 256))
    counts = Counts()
    counts.add(texts, code)
    model = Model(code, [packed_logits(c) for c in counts.parts()])
    likely, not_likely = model.log10([b"zzabx", b"zzaby"])
    assert likely > not_likely + 0.2


def test_slots_grow_with_the_distinct_contexts():
    """Bits by parts of texts against plain counts of distinct contexts and next bytes, below and above the least bits."""
    from lectern.llm import mixing_model

    r = np.random.default_rng(5)
    texts = [bytes(r.integers(97, 123, 8).astype(np.uint8)) for _ in range(20_000)]
    for some in (texts[:50], texts):
        pairs = {(t[:i], (t + b"\n")[i]) for t in some for i in range(len(t) + 1)}
        parts = [mixing_model.Distinct() for _ in range(4)]
        for i, d in enumerate(parts):
            d.add(some[i::4])
        least = np.unique(np.concatenate([d.least[2] for d in parts]))[: mixing_model.LEAST]
        for times in (1, 1000):
            scaled = least if times == 1 or len(least) < mixing_model.LEAST else least // times
            want = len(pairs) * (times if len(least) == mixing_model.LEAST else 1) * mixing_model.SLOTS_EACH
            got = mixing_model.slot_bits(2, scaled)
            assert got >= 24 and (got == 24 or 0.45 * want * 0.9 < 2**got / 2 <= want * 1.1)
    assert mixing_model.slot_bits(2, least // 1000) > 24 and mixing_model.slot_bits(1, least[:9]) >= 21


def test_slots_count_every_document_and_every_end(spark, monkeypatch):
    """All slots of the model against counts of all texts at once, words by whether they end a text; the sample is in them."""
    texts = [f"{prose(i, 30)} {('final', 'middle')[i % 2]} {('rare' + str(i), 'stop')[i % 3 > 0]}".replace("\n", " ") for i in range(40)] + ["middle"] * 3
    kept = {}
    learn = scoring.learn_model
    monkeypatch.setattr(scoring, "learn_model", lambda *a: kept.setdefault("model", learn(*a)))
    scoring.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.lit(False)).count()
    own = [words_of(t) for t in texts]
    data = [b" ".join(w) for w in own]
    code, counts = Code(count_pairs(data).reshape(256, 256)), Counts()
    counts.add(data, code)
    times, ends = Counter(w for words in own for w in words), Counter(words[-1] for words in own)
    counts.add_words(list(times), np.array(list(times.values())), code, np.array([ends[w] for w in times]))
    for table, count in zip(kept["model"].tables, counts.parts()):
        assert np.array_equal(table, packed_logits(count))


def test_short_texts_are_refined_too(monkeypatch):
    """A text of some thousand decisions, far below the longest segment, is scored by weights that move within it."""
    from lectern.llm import mixing_model

    texts = [prose(i, 80).replace("\n", " ").encode() for i in range(10)]
    model = Model(Code(count_pairs(texts).reshape(256, 256)), [packed_logits(c) for c in Counts().parts()])
    model.tables[0] = packed_logits(np.tile(np.array([1, 3], np.int32), 65536))
    short = texts[0][:300]
    moved = model.log10([short])[0]
    monkeypatch.setattr(mixing_model, "RATE", 0.0)
    assert moved != model.log10([short])[0]


def test_scores_of_segments_against_a_plain_loop():
    """Texts of no, one and many segments, scored decision by decision with weights that move after every segment."""
    from lectern.llm import mixing_model as mm

    texts = [prose(i, n).replace("\n", " ").encode() for i, n in enumerate((0, 3, 40, 400, 3000, 90))]
    code = Code(sum(count_pairs(texts[i : i + 2]) for i in (0, 2, 4)).reshape(256, 256))
    counts = Counts()
    counts.add(texts, code)
    words = Counter(w for t in texts for w in t.split())
    counts.add_words(list(words), np.array(list(words.values())), code, 0.1)
    model = Model(code, [packed_logits(c) for c in counts.parts()])
    model.train(texts[2:4])
    got = model.log10(texts)
    for text, score in zip(texts, got):
        logits, gate, bit, _ = model._inputs([text])
        x = logits.astype(np.float64)
        shift, total, lo, size = np.zeros(len(x)), 0.0, 0, mm.FIRST
        while lo < len(bit):
            hi = min(lo + size, len(bit))
            move = np.zeros(len(x))
            for i in range(lo, hi):
                z = float(((model.weights[gate[i]] + shift) * x[:, i]).sum())
                p = 1 / (1 + math.exp(-z))
                total += math.log10(p if bit[i] else 1 - p)
                move += (bit[i] - p) * x[:, i]
            shift += mm.RATE * move / (hi - lo)
            lo, size = hi, min(2 * size, mm.SEGMENT)
        assert abs(total - score) < 1e-3 * max(1, abs(total))
    assert len(model._inputs([texts[4]])[2]) > 4 * mm.SEGMENT


def test_labels_that_contradict_each_other(spark, odd):
    """A document that is labelled both ways counts as 1; null labels and held-out documents don't count."""
    labels = spark.createDataFrame([(i, 1, v) for i in range(1, 9) for v in (0, 1)] + [(9, 1, None), (10, 1, 0), (10, 1, 0), (10, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.bounded_sample(odd, labels, "toxic", 100, 5, 0).select("doc_id", "y").distinct().collect()
    kept = {i for i in range(1, 11) if zlib.crc32(str(i).encode()) % 5}
    assert {(r.doc_id, r.y) for r in got} == {(i, 1) for i in kept if i < 9} | {(i, 0) for i in kept if i == 10}
    few = toxicity.bounded_sample(odd, labels, "toxic", 3, 5, 0).select("doc_id", "y").distinct()
    assert few.filter("y = 1").count() == 3


def test_all_queries_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries()) == list(range(1, 14))
    assert set(queries.oracle_sql()) < set(queries.queries())


def test_every_oracle_is_sql():
    assert all(isinstance(sql, str) for sql in queries.oracle_sql().values())


def test_members_of_heavy_lists_travel_without_their_prefixes(spark, monkeypatch):
    """Near copies whose shingles are all heavy: a posting has four numbers, not the whole prefix once for each of its shingles."""
    written, keep = {}, jaccard.materialise
    monkeypatch.setattr(jaccard, "materialise", lambda df, name: (written.setdefault(name, df.columns), keep(df, name))[1])
    body = " ".join(f"x{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"w{i} {body}") for i in range(40)], "doc_id long, text string")
    assert {r.component_id for r in jaccard.jaccard_classes(docs).collect()} == {0}
    assert set(written["postings"]) == {"id", "n", "rare", "token"} and not {"light", "dense"} & set(written["tiles"])


def test_shingles_travel_as_three_bytes_to_be_counted_and_what_is_done_is_deleted(spark, monkeypatch, tmp_path):
    """Counts by heads of tokens equal those by whole ones; the sets that were compared don't lie on the disk until the end."""
    import numpy as np
    import pyarrow as pa

    texts = ["one two three four five six " + " ".join(f"w{(i * k) % 97}" for k in range(60)) for i in range(120)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(120)), pa.array(texts)], ["id", "text"])
    shift = 48 - jaccard.COUNTED_BITS - 10
    packed = pa.Table.from_batches(list(jaccard._packed(10, shift)(iter([batch])))).sort_by("bucket")
    tokens = Counter(int(t >> np.uint64(16 + shift)) for x in texts for t in jaccard.shingles(x))
    assert sum(len(x) for c in ("once", "again") for x in packed.column(c).to_pylist()) == 3 * len(tokens)
    got = pa.Table.from_batches(jaccard._counted(10, shift=shift)(iter(packed.to_batches()))).to_pydict()
    assert dict(zip(got["token"], got["df"])) == {t: k for t, k in tokens.items() if k > jaccard.HEAVY} != {}
    folder, freed = f"file://{tmp_path}", []
    monkeypatch.setattr("lectern.llm.common.shared_folder", lambda spark: folder)
    monkeypatch.setattr(jaccard, "released", lambda spark: freed.append([p.name for p in tmp_path.iterdir()]))
    docs = spark.createDataFrame([(i, f"w{i} " + " ".join(f"x{j}" for j in range(60))) for i in range(10)], "doc_id long, text string")
    assert {r.component_id for r in jaccard.jaccard_classes(docs).collect()} == {0}
    assert len(freed) >= 4 and not [n for n in map(lambda p: p.name, tmp_path.iterdir()) if "-sets-" in n or "-needed-" in n]


def test_weights_are_fitted_on_every_document(spark, monkeypatch):
    """The mixer's weights against plain sums over all texts, also one of over 20,000 characters, each met by the other fold's slots."""
    from lectern.llm.mixing_model import PASSES, Fit

    texts = [prose(i, 30 + 10 * (i % 7)).replace("\n", " ") for i in range(50)] + [prose(99, 5000).replace("\n", " "), "", "a", "ab c", "\x00 é日本"]
    kept, learn = {}, scoring.learn_model
    monkeypatch.setattr(scoring, "learn_model", lambda *a: kept.setdefault("model", learn(*a)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scoring.score(docs, F.lit(False)).count()
    fold = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("f")).collect()}
    data = [[b" ".join(words_of(t)) for i, t in enumerate(texts) if fold[i] == f] for f in (0, 1)]
    code, models = Code(sum(count_pairs(d) for d in data).reshape(256, 256)), []
    for d in data:
        counts = Counts()
        counts.add(d, code)
        times, ends = Counter(w for t in d for w in t.split()), Counter(t.split()[-1] for t in d if t)
        counts.add_words(list(times), np.array(list(times.values())), code, np.array([ends[w] for w in times]))
        models.append(Model(code, [packed_logits(c) for c in counts.parts()]))
    fit = Fit(models[0].weights)
    for _ in range(PASSES):
        sums = 0
        for d, model in zip(data, models[::-1]):
            for t in d:
                logits, gate, bit, _ = model._inputs([t])
                sums = sums + model.sums(logits, gate, bit, np.ones(len(bit)), fit.next)
        if not fit.take(sums):
            break
    assert np.abs(fit.best - 0.25).max() > 0.1
    assert np.allclose(kept["model"].weights, fit.best, atol=1e-3)


def test_counts_of_a_task_are_added_up_before_they_travel(monkeypatch):
    """Each token and each head of a task's batches comes out once, with sums of all batches; where few rows may be held, parts add up to the same."""
    import pyarrow as pa

    texts = [prose(i % 9, 30).replace("\n", " ") for i in range(60)] + ["", "a", "é ab"]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i::3]), pa.array([j % 2 for j in range(len(texts[i::3]))], pa.int32())], ["text", "fold"]) for i in range(3)]
    want = Counter(w for t in texts for w in [*words_of(t), b"\n"])
    for held in (scoring.HELD, 1):
        monkeypatch.setattr(scoring, "HELD", held)
        rows = [r for b in scoring._counted(iter(batches)) for r in b.to_pylist()]
        got = Counter()
        for r in rows:
            if r["token"] is not None:
                got[r["token"]] += r["n"]
        assert got == want
        assert held == 1 or len(rows) == len({(r["token"], r["head"]) for r in rows})


def test_a_rare_gate_takes_no_long_step():
    """A gate that saw few decisions, all of them sure, moves by a bounded step, also by the last one, which no pass checks."""
    from lectern.llm.mixing_model import Fit

    fit = Fit(np.full((1, 2), 0.5))
    sums = np.r_[5.0, -40.0, 30.0, [1e-3, 0, 0, 1e-3]][None]
    fit.take(sums)
    assert np.linalg.norm(fit.next - 0.5) <= 1 + 1e-9 and np.abs(fit.next - 0.5).max() > 0.1


def test_heads_and_rests_are_the_contexts_of_whole_texts():
    """Units by their numbers and rolling sums against the contexts of the texts that they come from."""
    from lectern.llm import mixing_model as mm

    texts = [b" ".join(words_of(t)) for t in [prose(3, 40), "", "a", "abcd abc abcde", "\x00 é日本 x"]]
    data, begins = mm.laid_out(texts)
    one, hashes = mm.contexts(data, begins)
    want = Counter(zip((one * 256 + data).tolist(), *(h.tolist() for h in hashes)))
    words = mm.Words(texts)
    kinds = [words.kinds[k] for k in words.kind]
    got = Counter()
    for units in (mm.head_units(words.heads), mm.word_units([w if len(w) <= 4 else w[:-3] if w.endswith(mm.MARKS) else w for w in kinds])):
        got.update(zip(units.pair.tolist(), *(h.tolist() for h in units.hashes)))
    assert got == want


def test_values_of_binary_columns():
    """Whole columns, slices, empty and null values, and no values at all."""
    import pyarrow as pa

    from lectern.llm.mixing_model import bytes_of

    column = pa.array([b"a", b"", None, b"bcd", b"\x00\n", b"e"], pa.binary())
    for some in (column, column[1:], column[3:5], column[:0], column.filter(column.is_valid())):
        assert bytes_of(some) == [x or b"" for x in some.to_pylist()]
    assert bytes_of(pa.array([], pa.binary())) == [] and bytes_of(pa.array([None], pa.binary())) == [b""]
