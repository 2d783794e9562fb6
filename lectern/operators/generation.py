"""Whole answers from ranked evidence: facts and gists, refusals, quotes, checked replies and their event stream.

``evidence`` is one row for each question, with its few best chunks as an array (``gathered``), so that every rule here is
an expression over some seven structs and no chunk is moved again.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences_for_facts, stripped
from .answers import FACTS, WORD, intent, question_words, shortened

#: Chunks of an answer, and lengths of its parts in characters.
MOST_CHUNKS, CLOSEST, QUOTED, GIST, MORE, SHORT = 7, 300, 240, 280, 200, 180
CHUNK = ("rank", "chunk_id", "text", "book_name", "volume", "printed_page_start", "topic", "kitab", "bab", "region", "verified", "rerank_score")

# Lines that begin with these name where a text stands, and aren't part of it.
HEADER_LINES = ("Kitab", "Topic", "Bab", "Fasl", "Book", "Chapter", "Section", "বই", "অধ্যায়", "কিতাব", "প্রকরণ", "ভূমিকা", "পৃষ্ঠা")
# Words before a name that aren't part of it, and characters around it.
BEFORE_NAMES, AROUND_NAMES = ("গ্রন্থটি", "কিতাবটি", "বইটি", "এই", "উক্ত", "ইহা", "এটি", "এটা", "তার", "তাহার", "ড.", "প্রফেসর", "ডক্টর", "মুহতারাম", "খলিফা"), ":-ঃ،,।"
# A title that follows its author, names of books that aren't known, and Bengali digits.
TITLE = "রচিত\\s*['\"]?\\s*([ঀ-৿؀-ۿ0-9A-Za-z\\s:-]{4,90})"
NO_TITLE, BENGALI_DIGITS = ("unknown", "unknown book"), "০১২৩৪৫৬৭৮৯"
# What answers say in each language; Bengali stands for any other.
SAYINGS = {
    "ar": {
        "author": "المؤلف", "title": "اسم الكتاب", "publisher": "الناشر", "page_count": "عدد الصفحات", "explanation": "الجواب",
        "author_is": "مؤلف هذا الكتاب هو {}.", "title_is": "اسم هذا الكتاب: {}.", "publisher_is": "ناشر هذا الكتاب: {}.", "page_count_is": "يحتوي هذا الكتاب على {} صفحة.",
        "not_found": "لم نعثر على هذه المعلومة في الأدلة المتاحة.", "source": "المصدر:", "volume": "مجلد", "page": "صفحة", "excerpt": "مقتطف",
        "caveat": "إجابة تلقائية مبنية على الأدلة المسترجعة دون توليد نموذج لغوي؛ استشر عالماً مؤهلاً للفتوى.",
        "refusal": "لم نجد أدلة كافية في النصوص المتاحة للإجابة على هذا السؤال. يمكنك إعادة صياغة السؤال أو تضييق نطاقه.", "closest": "أقرب الأدلة الموجودة:",
    },
    "en": {
        "author": "Author", "title": "Book title", "publisher": "Publisher", "page_count": "Pages", "explanation": "Answer",
        "author_is": "The author of this book is {}.", "title_is": "The title of this book is: {}.", "publisher_is": "This book is published by {}.", "page_count_is": "This book has {} pages.",
        "not_found": "This information was not found in the available evidence.", "source": "Source:", "volume": "vol.", "page": "p.", "excerpt": "Excerpt",
        "caveat": "Automated, evidence-grounded answer produced without an LLM; consult a qualified scholar for a full ruling.",
        "refusal": "Not enough evidence was found in the available corpus to answer this question. You may rephrase the question or narrow its scope.", "closest": "Closest evidence found:",
    },
    "bn": {
        "author": "লেখক", "title": "কিতাবের নাম", "publisher": "প্রকাশক", "page_count": "পৃষ্ঠা সংখ্যা", "explanation": "উত্তর",
        "author_is": "এই কিতাবের লেখক {}।", "title_is": "এই কিতাবের নাম {}।", "publisher_is": "এই কিতাবটি প্রকাশ করেছে {}।", "page_count_is": "এই কিতাবে {} পৃষ্ঠা রয়েছে।",
        "not_found": "প্রদত্ত প্রমাণে এই তথ্যটি পাওয়া যায়নি।", "source": "উৎস:", "volume": "খণ্ড", "page": "পৃষ্ঠা", "excerpt": "উদ্ধৃতাংশ",
        "caveat": "এটি LLM ছাড়াই প্রমাণভিত্তিক স্বয়ংক্রিয় উত্তর; পূর্ণাঙ্গ ফতোয়ার জন্য যোগ্য একজন আলেমের পরামর্শ নিন।",
        "refusal": "প্রদত্ত কোরপাসে এই প্রশ্নের উত্তর দেওয়ার মতো পর্যাপ্ত প্রমাণ পাওয়া যায়নি। অনুগ্রহ করে প্রশ্নটি পুনরায় লিখুন বা এর পরিধি সংকুচিত করুন।", "closest": "সবচেয়ে কাছাকাছি প্রমাণ:",
    },
}


def said(language: Column, key: str, value: Column | None = None) -> Column:
    """What an answer says in a language, with a value in its place."""
    def of(code: str) -> Column:
        before, _, after = SAYINGS[code][key].partition("{}")
        return F.lit(before) if value is None else F.concat(F.lit(before), value, F.lit(after))

    return F.when(language == "ar", of("ar")).when(language == "en", of("en")).otherwise(of("bn"))


def _chosen(kind: Column, language: Column, keys: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(kind == k, said(language, key)) for k, key in keys.items()])


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is worked out once, however often it is used: Catalyst would copy a plain one to each use."""
    return df.withColumn(name, F.explode(F.array(value)))


def _blank(c: Column) -> Column:
    return stripped(F.coalesce(c, F.lit(""))) == ""


def _named(c: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(c, F.lit(""))


def body_text(text: Column) -> Column:
    """A chunk's text on one line, without blank lines and the lines at its beginning that name where it stands."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"), stripped), lambda x: x != "")
    names = "|".join(HEADER_LINES)
    left = F.regexp_replace(F.array_join(lines, "\n"), f"^(?:(?U:\\s*(?:{names})\\s*)[:ঃ][^\n]*(?:\n|$))+", "")
    return stripped(F.regexp_replace(left, "(?U)\\s+", " "))


def first_match(text: Column, patterns: tuple[str, ...]) -> Column:
    """(value, at): the first group of the first pattern that is found in a text, and where that match begins, from 0."""
    kind = "struct<value:string,at:int>"
    one = lambda p: F.when(F.regexp_instr(text, F.lit(p)) > 0, F.struct(F.regexp_extract(text, p, 1).alias("value"), (F.regexp_instr(text, F.lit(p)) - 1).alias("at")))
    return F.coalesce(*[one("(?U)" + p).cast(kind) for p in patterns])


def around(text: Column, at: Column) -> Column:
    """The sentence that holds a place of a text: from the last mark before it to the first after it."""
    before, after = F.substring(text, F.lit(1), at), F.substring(text, at + 1, F.length(text))
    head = F.substring_index(F.substring_index(before, "।", -1), ".", -1)
    tail = F.when(F.instr(after, "।") > 0, F.substring_index(after, "।", 1)).otherwise(F.substring_index(after, ".", 1))
    return stripped(F.concat(head, tail))


def clean_name(name: Column) -> Column:
    bare = stripped(F.btrim(stripped(F.coalesce(name, F.lit(""))), F.lit(AROUND_NAMES)))
    words = "|".join(re.escape(w) for w in BEFORE_NAMES)
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "(?U)\\s+", " "), f"^(?:(?:{words})(?: |$))+", ""))


def gathered(ranked: DataFrame, most: int = MOST_CHUNKS) -> DataFrame:
    """(q_id, chunks): the first chunks of each question (``CHUNK`` columns) by rank, each with its ``body``."""
    few = ranked.filter(F.col("rank") <= most).select("q_id", F.struct(*CHUNK, body_text(F.col("text")).alias("body")).alias("c"))
    return few.groupBy("q_id").agg(F.array_sort(F.collect_list("c")).alias("chunks"))


def _first(xs: Column, f) -> Column:
    """The first of what ``f`` gives for the structs of an array that isn't null."""
    return F.get(F.filter(F.transform(xs, f), lambda x: x.isNotNull()), 0)


_FACT = "struct<answer:string,quote:string,chunk_id:string,strength:double>"


def _fact(answer: Column, quote: Column, chunk_id: Column, strength: float) -> Column:
    return F.struct(answer.alias("answer"), quote.alias("quote"), chunk_id.alias("chunk_id"), F.lit(strength).alias("strength")).cast(_FACT)


def _stated(pool: Column, kind: str, language: Column, quoted: bool) -> Column:
    """A name that a chunk's text states: of each chunk only the first pattern that is found counts."""
    def found(c: Column) -> Column:
        text = F.translate(c["body"], BENGALI_DIGITS, "0123456789") if kind == "page_count" else c["body"]
        return F.struct(c["chunk_id"].alias("chunk_id"), text.alias("text"), first_match(text, FACTS[kind]).alias("m"))

    def told(x: Column) -> Column:
        name = x["m"]["value"] if kind == "page_count" else clean_name(x["m"]["value"])
        quote = shortened(around(x["text"], x["m"]["at"]), SHORT) if quoted else F.lit(None)
        return F.when(x["m"].isNotNull() & (name != ""), _fact(said(language, kind + "_is", name), quote, x["chunk_id"], 1.0))

    return _first(F.transform(pool, found), told)


def _title(chunks: Column, pool: Column, language: Column) -> Column:
    def known(c: Column) -> Column:
        name = stripped(F.coalesce(c["book_name"], F.lit("")))
        return F.when((name != "") & ~F.lower(name).isin(*NO_TITLE), _fact(said(language, "title_is", name), F.lit(None), c["chunk_id"], 0.8))

    def found(c: Column) -> Column:
        m = first_match(c["body"], (TITLE,))
        return F.when(m.isNotNull(), _fact(said(language, "title_is", stripped(m["value"])), F.lit(None), c["chunk_id"], 0.7))

    return F.coalesce(_first(chunks, known), _first(pool, found))


def _best_sentence(text: Column, words: Column) -> Column:
    """The sentence with most words of the question, the earliest of several; the text's beginning if it has none."""
    hits = lambda s: F.size(F.filter(F.regexp_extract_all(F.lower(s), F.lit(WORD), F.lit(0)), lambda w: F.array_contains(words, w)))
    scored = F.transform(sentences_for_facts(text), lambda s, i: F.struct((-hits(s)).alias("hits"), i.alias("i"), s.alias("s")))
    best = F.array_min(scored)["s"]
    return F.coalesce(_named(best), shortened(text, 220))


def _gist(pool: Column, question: Column) -> Column:
    """An explanation: the best sentences of the first two chunks."""
    words = question_words(question)
    one, two = (F.when(F.size(pool) > i, _best_sentence(F.get(pool, i)["body"], words)) for i in (0, 1))
    def told(s: Column) -> Column:
        more = F.when((s["two"] != "") & (s["two"] != s["one"]), shortened(s["two"], MORE))
        strength = F.when(F.coalesce(s["one"], F.lit("")) != "", 0.6).otherwise(0.5)
        return F.struct(F.concat_ws(" ", shortened(s["one"], GIST), more).alias("answer"), F.when(F.size(pool) > 0, shortened(s["one"], SHORT)).alias("quote"), F.get(pool, 0)["chunk_id"].alias("chunk_id"), strength.alias("strength")).cast(_FACT)

    return F.get(F.transform(F.array(F.struct(one.alias("one"), two.alias("two"))), told), 0)


def with_facts(evidence: DataFrame) -> DataFrame:
    """``evidence`` (q_id, query, language, chunks) with ``fact_type``, ``heading`` and ``fact``: what the question asks for
    and what the chunks say to it, drawn from their texts or book names only."""
    language, pool, chunks = F.col("language"), F.col("_pool"), F.col("chunks")
    with_pool = _once(_once(evidence, "_pool", F.filter("chunks", lambda c: ~_blank(c["text"]))), "fact_type", intent(F.col("query")))
    none = _fact(said(language, "not_found"), F.lit(None), F.get(pool, 0)["chunk_id"], 0.4)
    kind = F.col("fact_type")
    fact = (
        F.when(kind == "author", F.coalesce(_stated(pool, "author", language, True), none)).when(kind == "title", F.coalesce(_title(chunks, pool, language), none))
        .when(kind == "publisher", F.coalesce(_stated(pool, "publisher", language, True), none)).when(kind == "page_count", F.coalesce(_stated(pool, "page_count", language, False), none))
        .otherwise(_gist(pool, F.col("query")))
    )
    heading = _chosen(kind, language, {k: k for k in ("author", "title", "publisher", "page_count", "explanation")})
    return _once(with_pool.withColumn("heading", heading), "fact", fact).drop("_pool")


def used_chunks(chunks: Column, fact_type: Column, chunk_id: Column) -> Column:
    """The chunks that an answer cites: the first two for an explanation, else the fact's chunk, else the first."""
    own = F.slice(F.filter(chunks, lambda c: c["chunk_id"].eqNullSafe(chunk_id)), 1, 1)
    return F.when(fact_type == "explanation", F.slice(chunks, 1, 2)).when(F.size(own) > 0, own).otherwise(F.slice(chunks, 1, 1))


def source_label(c: Column, language: Column) -> Column:
    volume = F.when(~_blank(c["volume"].cast("string")), F.concat_ws(" ", said(language, "volume"), c["volume"].cast("string")))
    page = F.when(c["printed_page_start"].isNotNull(), F.concat_ws(" ", said(language, "page"), c["printed_page_start"].cast("string")))
    label = F.concat_ws(", ", _named(c["book_name"]), volume, page)
    return F.when(label == "", "unknown source").otherwise(label)


def arabic_quotes(used: Column, language: Column) -> Column:
    """(text, translation, region) of the chunks that have Arabic letters, shortened, with a label of where they stand."""
    some = F.filter(used, lambda c: F.coalesce(c["text"], F.lit("")).rlike("[\u0600-\u06ff]"))
    return F.transform(some, lambda c: F.struct(shortened(c["text"], QUOTED).alias("text"), F.concat_ws(" — ", said(language, "excerpt"), source_label(c, language)).alias("translation"), c["region"].alias("region")))


def cited(used: Column) -> Column:
    """(chunk_id, book, volume, page, edition, chapter) of chunks, from what is known of them."""
    def one(c: Column) -> Column:
        chapter = F.coalesce(_named(c["topic"]), _named(c["kitab"]), _named(c["bab"]))
        return F.struct(c["chunk_id"].alias("chunk_id"), c["book_name"].alias("book"), c["volume"].cast("string").alias("volume"), c["printed_page_start"].cast("string").alias("page"), F.lit(None).cast("string").alias("edition"), chapter.alias("chapter"))

    return F.transform(used, one)


def related_topics(used: Column) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(used, lambda c: _named(c["topic"])), lambda t: t.isNotNull())), 1, 2)


def confidence_of(chunks: Column, translated: Column) -> Column:
    """(level, score, agreement, rationale) of an array of chunks: their best score, and whether the first three agree in
    topic and are verified."""
    three = F.slice(chunks, 1, 3)
    topic = lambda c: F.coalesce(_named(F.trim(c["topic"])), _named(F.trim(c["kitab"])), F.lit("unknown"))
    facts = F.struct(
        F.bround(F.array_max(F.transform(chunks, lambda c: c["rerank_score"])), 4).alias("score"),
        (F.size(F.array_distinct(F.transform(three, topic))) <= 1).alias("one"), F.size(F.filter(three, lambda c: F.coalesce(c["verified"], F.lit(False)))).alias("verified"),
    )

    def told(s: Column) -> Column:
        agreement = F.when(s["one"], "consensus").otherwise("conflict")
        level = F.when((s["score"] >= 0.6) & s["one"] & (s["verified"] >= 2), "high").when(s["score"] >= 0.35, "medium").otherwise("low")
        n = F.size(three).cast("string")
        parts = [
            F.format_string("top rerank score %.2f", s["score"]), F.concat(n, F.lit(" chunk(s) considered")), F.concat(F.lit("source agreement: "), agreement),
            F.concat(F.lit("verified evidence: "), s["verified"].cast("string"), F.lit("/"), n), F.when(F.coalesce(translated, F.lit(False)), "query was machine-translated; confidence reduced"),
        ]
        return F.struct(level.alias("level"), s["score"].alias("score"), agreement.alias("agreement"), F.concat(F.concat_ws("; ", *parts), F.lit(".")).alias("rationale"))

    kind = "struct<level:string,score:double,agreement:string,rationale:string>"
    none = F.struct(F.lit("low").alias("level"), F.lit(0.0).alias("score"), F.lit("unknown").alias("agreement"), F.lit("No evidence retrieved for this question.").alias("rationale"))
    return F.when(F.size(chunks) == 0, none.cast(kind)).otherwise(F.get(F.transform(F.array(facts), told), 0).cast(kind))


def _raised(base: Column, fact_type: Column, strength: Column) -> Column:
    """A fact that was found may raise the level of confidence, never its score."""
    sure = (fact_type != "explanation") & (strength >= 0.8)
    level = F.when(sure, "high").when((fact_type != "explanation") & (strength >= 0.6) & (base["level"] == "low"), "medium").otherwise(base["level"])
    why = F.when(sure, F.concat(F.lit("Deterministic fact extraction matched the source. "), base["rationale"])).otherwise(base["rationale"])
    return base.withField("level", level).withField("rationale", why)


ANSWER = ("q_id", "branch", "answer_language", "fact_type", "html", "quotes", "citations", "confidence", "refusal_reason", "closest", "caveats", "related")


def synthesised(evidence: DataFrame) -> DataFrame:
    """Answers (``ANSWER``) that need no model, of rows (q_id, query, language, translated, chunks) with a chunk or more."""
    told = _once(with_facts(evidence.filter(F.size("chunks") > 0)), "used", used_chunks(F.col("chunks"), F.col("fact_type"), F.col("fact.chunk_id")))
    told = _once(told, "_base", confidence_of(F.col("used"), F.col("translated")))
    language, used = F.col("language"), F.col("used")
    head = F.concat(F.lit("<p><b>"), F.col("heading"), F.lit(":</b> "), F.col("fact.answer"), F.lit("</p>"))
    quote = F.when((F.col("fact_type") != "explanation") & (F.coalesce("fact.quote", F.lit("")) != ""), F.concat(F.lit("<blockquote><p>"), F.col("fact.quote"), F.lit("</p></blockquote>")))
    source = F.concat(F.lit("<p>"), said(language, "source"), F.lit(" <cite>"), source_label(F.get(used, 0), language), F.lit("</cite></p>"))
    return told.select(
        "q_id", F.lit("synthesised").alias("branch"), language.alias("answer_language"), "fact_type", F.concat_ws("\n", head, quote, source).alias("html"),
        arabic_quotes(used, language).alias("quotes"), cited(used).alias("citations"), _raised(F.col("_base"), F.col("fact_type"), F.col("fact.strength")).alias("confidence"),
        F.lit(None).cast("string").alias("refusal_reason"), F.array().cast("array<string>").alias("closest"), F.array(said(language, "caveat")).alias("caveats"), related_topics(used).alias("related"),
    )


def refused(evidence: DataFrame, reason: Column) -> DataFrame:
    """Answers that refuse, with the texts of the first two chunks as the closest evidence."""
    language = F.col("language")
    closest = F.transform(F.filter(F.slice("chunks", 1, 2), lambda c: ~_blank(c["text"])), lambda c: shortened(c["text"], CLOSEST))
    rows = _once(evidence, "_closest", closest)
    listed = F.array_join(F.transform("_closest", lambda t: F.concat(F.lit("<p><i>"), t, F.lit("</i></p>"))), "\n")
    html = F.concat(F.lit("<p>"), said(language, "refusal"), F.lit("</p>"))
    more = F.when(F.size("_closest") > 0, F.concat(F.lit("<p><b>"), said(language, "closest"), F.lit("</b></p>\n"), listed))
    none = "array<struct<text:string,translation:string,region:string>>", "array<struct<chunk_id:string,book:string,volume:string,page:string,edition:string,chapter:string>>"
    return rows.select(
        "q_id", F.lit("refused").alias("branch"), language.alias("answer_language"), F.lit(None).cast("string").alias("fact_type"), F.concat_ws("\n", html, more).alias("html"),
        F.array().cast(none[0]).alias("quotes"), F.array().cast(none[1]).alias("citations"), confidence_of(F.col("chunks"), F.col("translated")).alias("confidence"),
        reason.alias("refusal_reason"), F.col("_closest").alias("closest"), F.array(said(language, "caveat")).alias("caveats"), F.array().cast("array<string>").alias("related"),
    )


def policy(sufficient: Column, reply: Column, faults: Column) -> Column:
    """What is done with a question: ``refuse`` without enough evidence, ``synthesise`` without a reply of a model,
    ``assemble`` a reply without a fault, and ``give_up`` on one that stayed wrong."""
    return F.when(~F.coalesce(sufficient, F.lit(False)), "refuse").when(reply.isNull(), "synthesise").when(faults.isNull(), "assemble").otherwise("give_up")


def answers(evidence: DataFrame) -> DataFrame:
    """Answers without a model for every question (q_id, query, language, translated, evidence_sufficient, chunks)."""
    enough = F.coalesce("evidence_sufficient", F.lit(False)) & (F.size("chunks") > 0)
    return synthesised(evidence.filter(enough)).unionByName(refused(evidence.filter(~enough), F.lit("insufficient_evidence")))


def rebuilt_citations(named: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations (q_id, place, chunk_id) with what is known of their chunks (q_id and ``CHUNK`` columns); ``known`` is false
    for a chunk that the question's evidence doesn't hold. Nothing that a model says of a source is kept."""
    own = chunks.select("q_id", F.struct(*[c for c in CHUNK]).alias("c")).withColumn("chunk_id", F.col("c.chunk_id"))
    met = named.join(own, ["q_id", "chunk_id"], "left").withColumn("known", F.col("c").isNotNull())
    return met.withColumn("citation", F.get(cited(F.array("c")), 0)).select("q_id", "place", "chunk_id", "known", "citation.book", "citation.volume", "citation.page", "citation.chapter")


def evidence_blocks(chunks: Column) -> Column:
    """The chunks of an array as numbered blocks of a prompt."""
    def block(c: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        place = F.concat(F.coalesce(_named(c["book_name"]), F.lit("Unknown Book")), F.lit(", vol "), F.coalesce(_named(c["volume"].cast("string")), F.lit("?")), F.lit(", p. "), F.coalesce(F.nullif(c["printed_page_start"], F.lit(0)).cast("string"), F.lit("?")))
        return F.concat(
            F.lit("[EVIDENCE_"), n, F.lit("]\nSOURCE: "), place, F.lit(" (chunk "), F.coalesce(_named(c["chunk_id"]), F.lit("unknown")), F.lit(")\nTOPIC: "), F.coalesce(_named(c["topic"]), F.lit("General")),
            F.lit("\nCONTENT:\n"), F.coalesce(c["text"], F.lit("")), F.lit("\n[/EVIDENCE_"), n, F.lit("]\n\n"),
        )

    return F.array_join(F.transform(chunks, block), "")


def prompts(evidence: DataFrame, template: str) -> DataFrame:
    """(q_id, prompt): a template with ``{query}``, ``{language}`` and ``{evidence}`` filled in, each in one pass."""
    values = {"{query}": F.col("query"), "{language}": F.col("language"), "{evidence}": evidence_blocks(F.col("chunks"))}
    parts = [values.get(p, F.lit(p)) for p in re.split("(\\{query\\}|\\{language\\}|\\{evidence\\})", template) if p]
    return evidence.select("q_id", F.concat(*parts).alias("prompt"))


def json_text(value: Column, kind: str = "string") -> Column:
    """A value as JSON: null, a string with its escapes, or a number or truth value as it is."""
    if kind == "string":
        quoted = F.to_json(F.array(value))
        return F.when(value.isNull(), "null").otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))
    return F.coalesce(value.cast("string"), F.lit("null"))


def json_object(fields: dict[str, Column]) -> Column:
    """An object of fields that are JSON already, with a space after its separators."""
    parts = [F.concat(F.lit(f'"{k}": '), v) for k, v in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def json_list(values: list[Column]) -> Column:
    return F.concat(F.lit("["), F.concat_ws(", ", *values), F.lit("]"))


def word_groups(html: Column, width: int = 4) -> Column:
    """The text in groups of words, each with a space after it."""
    of = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / width).cast("int")), lambda g: F.concat(F.array_join(F.slice(w, g * width + 1, width), " "), F.lit(" ")))
    return F.get(F.transform(F.array(F.split(html, " ", -1)), of), 0)


def event_stream(answered: DataFrame, questions: DataFrame, budget_ms: int = 3000) -> DataFrame:
    """(q_id, seq, event): the framed events of each answer in order: what was asked, the groups of words, the quotes, the
    citations, the confidence and the end."""
    rows = answered.join(questions.select("q_id", "query", F.col("language").alias("asked_in")), "q_id")
    frame = lambda name, body: F.concat(F.lit(f"event: {name}\ndata: "), body, F.lit("\n\n"))
    text = lambda c: json_text(c)
    meta = json_object({"query": text(F.col("query")), "language": text(F.col("asked_in")), "answer_language": text(F.col("answer_language")), "latency_budget_ms": F.lit(str(budget_ms))})
    each = lambda xs, name, keys: F.transform(xs, lambda x: frame(name, json_object({k: text(x[k]) for k in keys})))
    conf = json_object({"level": text(F.col("confidence.level")), "retrieval_score": json_text(F.col("confidence.score"), "number"), "source_agreement": text(F.col("confidence.agreement")), "rationale": text(F.col("confidence.rationale"))})
    strings = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, text), ", "), F.lit("]"))
    refusal = F.when(F.col("refusal_reason").isNull(), "null").otherwise(json_object({"reason": text(F.col("refusal_reason")), "closest_evidence": strings(F.col("closest"))}))
    done = json_object({"answer_language": text(F.col("answer_language")), "refusal": refusal, "caveats": strings(F.col("caveats")), "related": strings(F.col("related"))})
    parts = [
        F.array(frame("meta", meta)), F.transform(word_groups(F.col("html")), lambda t: frame("delta", json_object({"text": text(t)}))),
        each(F.col("quotes"), "quote", ("text", "translation", "region")), each(F.col("citations"), "citation", ("chunk_id", "book", "volume", "page", "edition", "chapter")),
        F.array(frame("confidence", conf)), F.array(frame("done", done)),
    ]
    return rows.select("q_id", F.posexplode(F.concat(*parts)).alias("seq", "event"))


def cache_key(space: str, scope: list[tuple[Column, str]]) -> Column:
    """``space`` and the hash of the scope, a JSON list of (value, kind); every input that shapes what is kept is in it."""
    return F.concat(F.lit(space + ":v1:"), F.sha2(json_list([json_text(v, kind) for v, kind in scope]), 256))


def embedding_key(text: Column, width: int) -> Column:
    return F.concat(F.lit(f"embedding:v1:{width}:"), F.sha2(text, 256))


def reply_faults(reply: Column, evidence_ids: Column, language: Column) -> Column:
    """The first fault of a model's reply, null if it has none.

    Beyond what ``answers.reply_error`` checks, fields must have their kind: quotes, citations, caveats, related and the
    refusal's closest evidence are lists or absent, a refusal is an object, a quote and a citation are objects with a
    text and a chunk's id.
    """
    bare = F.regexp_replace(F.trim(reply), "(?s)^```[^\n]*\n?|\n?\\s*```$", "")
    # What follows a value is passed over by the parser, so a reply is whole only if it is the one item of a list and the one value of an object.
    within = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), bare, F.lit("]"))), "$", "array<variant>")
    whole = (F.size(within) == 1) & F.try_parse_json(F.concat(F.lit('{"x":'), bare, F.lit("}"))).isNotNull()
    v = F.when(whole, F.try_parse_json(bare))
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    got = lambda path: F.try_variant_get(v, path, "string")
    absent = lambda path: F.coalesce(kind(path), F.lit("VOID")) == "VOID"
    is_list, is_object = (lambda path: kind(path).startswith("ARRAY")), (lambda path: kind(path).startswith("OBJECT"))
    items = lambda path: F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    inner = lambda x, path: F.when(F.schema_of_variant(x).startswith("OBJECT") & (F.schema_of_variant(F.try_variant_get(x, path, "variant")) == "STRING"), F.try_variant_get(x, path, "string"))
    html = F.when(kind("$.explanation.html") == "STRING", got("$.explanation.html"))
    ids = F.transform(items("$.citations"), lambda x: inner(x, "$.chunk_id"))
    shown = F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"\[EVIDENCE_(\d+)\]"), F.lit(1)), lambda i: F.get(evidence_ids, i.try_cast("int") - 1))
    lists = reduce(lambda a, b: a.when(~absent(f"$.{b}") & ~is_list(f"$.{b}"), f"{b} is no list"), ("caveats", "related"), F.when(F.lit(False), ""))
    return (
        F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), "not an object").when(~got("$.answer_language").eqNullSafe(language), "language")
        .when(absent("$.explanation") | ~is_object("$.explanation"), "no explanation").when(html.isNull() | _blank(html), "no text")
        .when(~absent("$.arabic_quotes") & ~is_list("$.arabic_quotes"), "quotes are no list")
        .when(F.exists(items("$.arabic_quotes"), lambda x: _blank(inner(x, "$.text"))), "empty quote")
        .when(~absent("$.citations") & ~is_list("$.citations"), "citations are no list").when(F.exists(ids, lambda c: c.isNull()), "no chunk id")
        .when(F.exists(ids, lambda c: ~F.array_contains(evidence_ids, c)), "unknown citation")
        .when(F.exists(shown, lambda c: c.isNull()), "unknown evidence").when(F.exists(shown, lambda c: ~F.array_contains(ids, c)), "uncited evidence")
        .when(~absent("$.refusal") & ~is_object("$.refusal"), "refusal is no object").when(~absent("$.refusal") & ~got("$.refusal.reason").eqNullSafe(F.lit("insufficient_evidence")), "refusal reason")
        .when(~absent("$.refusal") & ~absent("$.refusal.closest_evidence") & ~is_list("$.refusal.closest_evidence"), "closest evidence is no list").otherwise(lists)
    )


def reply_citations(reply: Column) -> Column:
    """(chunk_id, page, volume) of a checked reply's citations, numbers as text."""
    v = F.try_parse_json(F.regexp_replace(F.trim(reply), "(?s)^```[^\n]*\n?|\n?\\s*```$", ""))
    some = F.coalesce(F.try_variant_get(v, "$.citations", "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(some, lambda c: F.struct(*[F.try_variant_get(c, f"$.{k}", "string").alias(k) for k in ("chunk_id", "page", "volume")]))


RETRIEVED = "query string, canonical string, language string, translated boolean, candidates array<string>, evidence_sufficient boolean, chunks array<struct<chunk_id:string,text:string,book_name:string,volume:string,printed_page_start:int,rerank_score:double>>"
_CACHED = f"retrieval struct<{re.sub(' (?=string|boolean|array)', ':', RETRIEVED).replace(', ', ',')}>, answer struct<answer_language:string,html:string,refusal_reason:string>, _bad string"


def cache_value(retrieval: Column, answer: Column) -> Column:
    """What a cache keeps of a turn, as JSON."""
    return F.to_json(F.struct(retrieval.alias("retrieval"), answer.alias("answer")))


def cached_turns(entries: DataFrame) -> DataFrame:
    """(key, retrieval, answer) of cache entries (key, value); an entry that isn't what ``cache_value`` made is none, and its turn is
    worked out anew."""
    read = entries.withColumn("_v", F.from_json("value", _CACHED, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    good = F.col("_v._bad").isNull() & F.col("_v.retrieval.query").isNotNull() & F.col("_v.answer.html").isNotNull()
    return read.filter(good).select("key", "_v.retrieval", "_v.answer")


def checked_replies(evidence: DataFrame, replies: DataFrame, attempts: int = 2) -> DataFrame:
    """``evidence`` with ``branch`` (see ``policy``), ``reply``, ``attempt`` and ``fault``: which of a model's replies decides.

    ``replies`` has (q_id, attempt from 1, reply); a null reply is a model that couldn't be reached. The first attempt that is unreachable or
    without a fault decides, later ones and those beyond ``attempts`` don't count; else the last fault is told. Without attempts there is no model.
    """
    ids = evidence.select("q_id", "language", F.transform(F.slice("chunks", 1, MOST_CHUNKS), lambda c: c["chunk_id"]).alias("_ids"))
    judged = replies.filter(F.col("attempt") <= attempts).join(ids, "q_id").withColumn("fault", F.when(F.col("reply").isNotNull(), reply_faults(F.col("reply"), F.col("_ids"), F.col("language"))))
    decides = F.col("reply").isNull() | F.col("fault").isNull()
    told = F.struct("reply", "attempt", "fault")
    one = judged.groupBy("q_id").agg(F.min_by(told, F.when(decides, F.col("attempt"))).alias("_first"), F.max_by(told, "attempt").alias("_last"))
    final = one.select("q_id", F.coalesce("_first", "_last").alias("_r")).select("q_id", "_r.reply", "_r.attempt", "_r.fault")
    met = evidence.join(final, "q_id", "left")
    enough = F.coalesce("evidence_sufficient", F.lit(False)) & (F.size("chunks") > 0)
    return met.withColumn("branch", policy(enough, F.col("reply"), F.col("fault")))


def assembled(checked: DataFrame, clean: Callable[[Column], Column] | None = None) -> DataFrame:
    """Answers (``ANSWER``) of replies without a fault: their text, made inert by ``clean`` if it is given, quotes, caveats and topics; what is said of a source comes from
    the evidence, and confidence from its scores, never from the reply."""
    v = F.try_parse_json(F.regexp_replace(F.trim("reply"), "(?s)^```[^\n]*\n?|\n?\\s*```$", ""))
    rows = checked.withColumn("_v", v)
    got = lambda path, kind: F.try_variant_get("_v", path, kind)
    texts = lambda path: F.coalesce(got(path, "array<string>"), F.array().cast("array<string>"))
    html = got("$.explanation.html", "string")
    quote = lambda q: F.struct(*[F.try_variant_get(q, f"$.{k}", "string").alias(k) for k in ("text", "translation", "region")])
    quotes = F.transform(F.coalesce(got("$.arabic_quotes", "array<variant>"), F.array().cast("array<variant>")), quote)
    named = F.transform(reply_citations(F.col("reply")), lambda c: c["chunk_id"])
    known = F.flatten(F.transform(named, lambda i: F.slice(F.filter("chunks", lambda c: c["chunk_id"] == i), 1, 1)))
    return rows.select(
        "q_id", F.lit("assembled").alias("branch"), F.col("language").alias("answer_language"), F.lit(None).cast("string").alias("fact_type"), (clean(html) if clean else html).alias("html"),
        quotes.alias("quotes"), cited(known).alias("citations"), confidence_of(F.slice("chunks", 1, MOST_CHUNKS), F.col("translated")).alias("confidence"),
        got("$.refusal.reason", "string").alias("refusal_reason"), texts("$.refusal.closest_evidence").alias("closest"), texts("$.caveats").alias("caveats"), texts("$.related").alias("related"),
    )


def answers_with_replies(checked: DataFrame, clean: Callable[[Column], Column] | None = None) -> DataFrame:
    """Answers of all four branches of ``checked_replies``: refused, synthesised, assembled, and refused because no reply was sound."""
    of = lambda branch: checked.filter(F.col("branch") == branch)
    parts = [refused(of("refuse"), F.lit("insufficient_evidence")), synthesised(of("synthesise")), assembled(of("assemble"), clean), refused(of("give_up"), F.lit("generation_unavailable"))]
    return reduce(DataFrame.unionByName, parts)


def held_replies(deltas: DataFrame, gap: str = "30 seconds", delay: str | None = None) -> DataFrame:
    """(q_id, attempt, parts, complete) of deltas (q_id, attempt, seq, ts, kind, text), of a table or a stream: nothing is let through before a reply is whole.

    A reply is whole once its ``end`` came; one that falls silent for ``gap`` was broken off. Repeated rows of one ``seq`` count once. A stream
    says so when its watermark, ``delay`` behind, has passed.
    """
    rows = deltas.withWatermark("ts", delay) if delay else deltas
    said = F.sort_array(F.collect_set(F.when(F.col("kind") == "delta", F.struct("seq", "text"))))
    held = rows.groupBy(F.session_window("ts", gap), "q_id", "attempt").agg(said.alias("_said"), F.bool_or(F.col("kind") == "end").alias("complete"))
    return held.select("q_id", "attempt", F.transform("_said", lambda d: d["text"]).alias("parts"), "complete")


def released(held: DataFrame, evidence: DataFrame) -> DataFrame:
    """(q_id, attempt, seq, event, text, cacheable): the deltas of replies that are whole and without a fault, each reply's ``done`` last; for any other reply one
    ``error`` that names its fault. Only what is whole and sound may be kept in a cache."""
    ids = evidence.select("q_id", "language", F.transform(F.slice("chunks", 1, MOST_CHUNKS), lambda c: c["chunk_id"]).alias("_ids"))
    fault = F.when(~F.col("complete"), "broken off").otherwise(reply_faults(F.array_join("parts", ""), F.col("_ids"), F.col("language")))
    judged = held.join(ids, "q_id").withColumn("_fault", fault)
    event = lambda name, text: F.struct(F.lit(name).alias("event"), text.alias("text"))
    good = F.concat(F.transform("parts", lambda t: event("delta", t)), F.array(event("done", F.lit(None).cast("string"))))
    bad = F.array(event("error", F.col("_fault")))
    out = judged.select("q_id", "attempt", F.posexplode(F.when(F.col("_fault").isNull(), good).otherwise(bad)).alias("seq", "_e"), F.col("_fault").isNull().alias("cacheable"))
    return out.select("q_id", "attempt", "seq", "_e.event", "_e.text", "cacheable")
