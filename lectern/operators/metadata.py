"""Bibliographic fields, printed page numbers and sections of documents, from file names and text blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ARABIC_DIGITS, printed_number, stripped, western_digits
from .layout import FOOTER, HEADER, PAGE, dominant_font

# Arabic ordinals by their number.
ORDINALS = {"الأول": 1, "الأولى": 1, "الثاني": 2, "الثانية": 2, "الثالث": 3, "الثالثة": 3, "الرابع": 4, "الرابعة": 4, "الخامس": 5, "الخامسة": 5, "السادس": 6, "السادسة": 6, "السابع": 7, "السابعة": 7, "الثامن": 8, "الثامنة": 8, "التاسع": 9, "التاسعة": 9, "العاشر": 10, "العاشرة": 10}
# Patterns of volumes, editions, years, separators and generic titles in file names.
_DIGITS = f"[{ARABIC_DIGITS}]+"
VOLUMES = (r"(?i)\bvol(?:ume)?(?![a-z])\s*[:.\-]?\s*(?:no\.?[:.\-]?\s*)?(\d{1,3}|" + _DIGITS + ")", r"(?i)\bv(?![a-z])(\d{1,3})\b", r"(?:الجزء|جزء)\s*(\d{1,3}|" + _DIGITS + "|[ء-ي]+)")
EDITIONS = (r"(?i)(\d{1,2})(?:st|nd|rd|th)\s+edition\b", r"(?i)\b(?:edition|ed)(?![a-z])\s*[:.\-]?\s*(?:no\.?[:.\-]?\s*)?(\d{1,3}|" + _DIGITS + ")", r"(?:الطبعة|الطبعه)\s*(\d{1,3}|" + _DIGITS + "|[ء-ي]+)")
YEAR = r"(?<!\d)((?:19|20)\d{2})(?!\d)"
SEPARATOR = r"\s+[-–—|/]\s+|\s+by\s+|\s_by_\s*"
GENERIC = r"(?i)^(?:scan|scanned|book|document|doc|pdf|upload|image|file)(?:[\s_\-]*\d*)?$"
# Patterns of the first pages, tried in order; the first group that matched is the value.
PUBLISHERS = (r"(?:الناشر\s*[:：]?\s*)?((?:دار|مطبعة|المكتبة|نشر)\s+[^\n،]{2,60})", r"(?i)(?:published by|publisher\s*[:：])\s*([^\n]{2,60})")
AUTHORS = (r"تأليف\s+([^\n،]{2,80})", r"المؤلف\s*[:：]\s*([^\n،]{2,80})", r"(?i)(?:authored by|author\s*[:：]|written by)\s*([^\n]{2,80})")
EDITORS = (r"تحقيق\s+([^\n،]{2,80})", r"(?i)(?:edited by|tahqiq|muhaqqiq)\s*[:：]?\s*([^\n]{2,80})")
# Words that name the levels of headings.
HEADINGS = (("kitab", r"كتاب|(?i)^\s*(?:Kitab|Book|Chapter)\b"), ("bab", r"باب|(?i)^\s*(?:Bab|Section|Sub-?chapter)\b"), ("fasl", r"فصل|مسألة|(?i)^\s*(?:Fasl|Part|Subsection|Mas'ala|Masala)\b"))
HEADING_FONT, LONGEST_HEADING, FIRST_PAGES = 1.08, 80, 6


def _filled(text: Column) -> Column:
    return F.when(text != "", text)


def _number_of(token: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ORDINALS.items() for x in (kv[0], str(kv[1]))])
    return F.when(token.rlike(f"^(?:[0-9]+|{_DIGITS})$"), F.coalesce(western_digits(F.when(token.rlike(f"^{_DIGITS}$"), token)).try_cast("int").cast("string"), token)).otherwise(F.try_element_at(table, token))


def _first_number(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[_number_of(_filled(F.regexp_extract(text, p, 1))) for p in patterns])


def filename_fields(name: Column) -> Column:
    """(title, author, volume, edition, year) that a file name tells; null where it doesn't."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    parts = F.split(stem, SEPARATOR)
    author = F.trim(F.element_at(parts, -1))
    has = (F.size(parts) > 1) & (author != "")
    # What stands before the last separator, with the separators inside it as they were.
    before = F.regexp_replace(stem, f"(?s)^(.*)(?:{SEPARATOR}).*?$", "$1")
    plain = F.translate(F.when(has, before).otherwise(stem), "_", " ")
    bare = reduce(lambda t, p: F.regexp_replace(t, p, ""), (*VOLUMES, *EDITIONS, YEAR), plain)
    title = F.btrim(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")), F.lit(" -–—|/_.()[]{},;:"))
    return F.struct(
        _filled(title).alias("title"), F.when(has, author).alias("author"), _first_number(plain, VOLUMES).alias("volume"),
        _first_number(plain, EDITIONS).alias("edition"), _filled(F.regexp_extract(plain, YEAR, 1)).alias("year"),
    )


def _captured(text: Column, patterns: tuple[str, ...]) -> Column:
    clean = lambda p: _filled(F.btrim(stripped(F.regexp_extract(text, p, 1)), F.lit(":：\t,،.;")))
    return F.coalesce(*[clean(p) for p in patterns])


def page_texts(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, text): the blocks of each page in their order, one to a line."""
    rows = F.array_sort(F.collect_list(F.struct("block_index", F.coalesce("text", F.lit("")).alias("text"))))
    return blocks.groupBy(*PAGE).agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("text"))


def first_page_fields(blocks: DataFrame, pages: int = FIRST_PAGES) -> DataFrame:
    """(doc_id, publisher, year, author, muhaqqiq) from the first pages of each document."""
    early = blocks.withColumn("_p", F.dense_rank().over(W.partitionBy("doc_id").orderBy("page"))).filter(F.col("_p") <= pages)
    rows = F.array_sort(F.collect_list(F.struct("page", "text")))
    text = page_texts(early).groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("text"))
    t = F.col("text")
    return text.select("doc_id", _captured(t, PUBLISHERS).alias("publisher"), _filled(F.regexp_extract(t, YEAR, 1)).alias("year"), _captured(t, AUTHORS).alias("author"), _captured(t, EDITORS).alias("muhaqqiq"))


def _body(blocks: DataFrame) -> DataFrame:
    return blocks.filter((F.col("y0") > F.col("height") * HEADER) & (F.col("y1") < F.col("height") * FOOTER))


def cover_titles(blocks: DataFrame) -> DataFrame:
    """(doc_id, title): the largest of the short blocks on the first page that stand out by their size."""
    first = blocks.withColumn("_p", F.dense_rank().over(W.partitionBy("doc_id").orderBy("page"))).filter("_p = 1")
    body = _body(first)
    big = body.join(dominant_font(body), PAGE).filter((F.col("size") >= F.col("font") * 1.3) & F.length(stripped(F.col("text"))).between(1, 100))
    best = big.groupBy("doc_id").agg(F.max_by("text", F.struct("size", -F.col("block_index"))).alias("title"))
    return best.select("doc_id", _filled(F.btrim(stripped(F.col("title")), F.lit(":：\t,،.;"))).alias("title"))


def page_numbers(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, label, numeral, system, uncertain, confidence) from the last block in each page's bottom band."""
    last = W.partitionBy(*PAGE).orderBy(F.desc(F.bround("y1", 1)), F.desc("x0"), F.desc("block_index"))
    foot = blocks.filter(F.col("y1") >= F.col("height") * FOOTER).withColumn("_n", F.row_number().over(last)).filter("_n = 1").select(*PAGE, printed_number(F.trim("text")).alias("f"))
    found = F.col("f").isNotNull()
    return blocks.select(*PAGE).distinct().join(foot, PAGE, "left").select(
        *PAGE, F.coalesce("f.label", F.lit("")).alias("label"), F.col("f.numeral").alias("numeral"), F.coalesce("f.system", F.lit("none")).alias("system"),
        (~found).alias("uncertain"), F.when(found, 0.9).otherwise(0.15).alias("confidence"),
    )


def numbering(pages: DataFrame) -> DataFrame:
    """(doc_id, numbering): the one system of a document's pages, ``mixed`` or ``none``."""
    systems = F.collect_set(F.when(F.col("system") != "none", F.col("system")))
    return pages.groupBy("doc_id").agg(F.when(F.size(systems) == 0, "none").when(F.size(systems) == 1, systems[0]).otherwise("mixed").alias("numbering"))


def heading_level(text: Column, size: Column, font: Column) -> Column:
    """The level of a block, null for body text: headings are short and larger than most of the page."""
    clean = stripped(F.coalesce(text, F.lit("")))
    level = reduce(lambda c, h: c.when(clean.rlike(h[1]), h[0]), HEADINGS[1:], F.when(clean.rlike(HEADINGS[0][1]), HEADINGS[0][0])).otherwise("topic")
    return F.when((clean != "") & (F.length(clean) <= LONGEST_HEADING) & (font > 0) & (size >= font * HEADING_FONT), level)


def headings(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, place, level, name) of all headings in the order of the text."""
    body = _body(blocks)
    known = body.join(dominant_font(body), PAGE).withColumn("level", heading_level(F.col("text"), F.col("size"), F.col("font"))).filter("level is not null")
    order = W.partitionBy("doc_id").orderBy("page", F.bround("y0", 1), "x0", "block_index")
    return known.select("doc_id", "page", F.row_number().over(order).alias("place"), "level", stripped(F.col("text")).alias("name"))


def sections(marks: DataFrame, last_pages: DataFrame) -> DataFrame:
    """(doc_id, level, name, page_start, page_end): of the headings of a level on one page the last counts, and it lasts
    to the page before the next heading of its level, or to the document's last page (doc_id, last_page)."""
    one = marks.withColumn("_n", F.row_number().over(W.partitionBy("doc_id", "level", "page").orderBy(F.desc("place")))).filter("_n = 1")
    ends = F.lead("page").over(W.partitionBy("doc_id", "level").orderBy("page")) - 1
    return one.withColumn("_end", ends).join(last_pages, "doc_id").select("doc_id", "level", "name", F.col("page").alias("page_start"), F.coalesce("_end", F.greatest("last_page", "page")).alias("page_end"))


def active_sections(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """Pages (doc_id, page) with the last kitab, bab and fasl up to and including them; levels don't reset each other."""
    latest = lambda name: F.max_by(F.when(F.col("level") == name, F.col("name")), F.when(F.col("level") == name, F.col("place")))
    own = marks.groupBy(*PAGE).agg(*[latest(n).alias(n) for n in ("kitab", "bab", "fasl")])
    order = W.partitionBy("doc_id").orderBy("page").rowsBetween(W.unboundedPreceding, 0)
    return pages.join(own, PAGE, "left").withColumns({n: F.last(n, ignorenulls=True).over(order) for n in ("kitab", "bab", "fasl")})


def document_fields(names: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, field, value, confidence, source) of documents (doc_id, filename): of each field the first source counts,
    the file name before the cover before the first pages; generic titles of file names don't count."""
    named = names.select("doc_id", filename_fields(F.col("filename")).alias("f"))
    f = lambda field, value, sure, source, place: F.struct(F.lit(field).alias("field"), value.alias("value"), F.lit(sure).alias("confidence"), F.lit(source).alias("source"), F.lit(place).alias("place"))
    title = F.when(~F.col("f.title").rlike(GENERIC), F.col("f.title"))
    own = F.array(f("title", title, 0.85, "filename", 0), f("author", F.col("f.author"), 0.8, "filename", 0), f("volume", F.col("f.volume"), 0.9, "filename", 0), f("edition", F.col("f.edition"), 0.9, "filename", 0), f("publication_year", F.col("f.year"), 0.85, "filename", 0))
    first = F.array(f("publisher", F.col("publisher"), 0.55, "first_pages", 2), f("publication_year", F.col("year"), 0.6, "first_pages", 2), f("author", F.col("author"), 0.7, "first_pages", 2), f("muhaqqiq", F.col("muhaqqiq"), 0.5, "first_pages", 2))
    every = (
        named.select("doc_id", F.inline(own)).union(cover_titles(blocks).select("doc_id", F.inline(F.array(f("title", F.col("title"), 0.7, "cover", 1)))))
        .union(first_page_fields(blocks).select("doc_id", F.inline(first)))
    )
    known = every.filter("value is not null and value <> ''")
    return known.withColumn("_n", F.row_number().over(W.partitionBy("doc_id", "field").orderBy("place"))).filter("_n = 1").drop("_n", "place")


def document_confidence(fields: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, confidence): the mean over a document's fields and its certain pages, to four places."""
    both = fields.select("doc_id", "confidence").union(pages.filter(~F.col("uncertain")).select("doc_id", "confidence"))
    return both.groupBy("doc_id").agg(F.bround(F.avg("confidence"), 4).alias("confidence"))
