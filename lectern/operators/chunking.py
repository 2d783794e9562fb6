"""Structure-aware chunks: units of text are cut into segments at headings and clean page breaks, oversized segments at
finer headings, and the sentences of each are packed with an overlap.

Units are rows (doc_id, unit, text, level, page, printed): ``unit`` is their order, ``level`` is ``kitab``, ``bab``,
``fasl``, ``topic`` or null for body text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import chunk_id, one_space, sentences_for_packing, stripped, token_count
from ..sources.tables import tasks
from .layout import PAGE, dominant_font, regions
from .metadata import heading_level

LEVELS = ("kitab", "bab", "fasl", "topic")
MOST_TOKENS, OVERLAP = 320, 0.15
#: Characters of a unit that count as one more row where units are dealt out.
ROW = 100


def _number(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level)


def units_of(blocks: DataFrame, contexts: DataFrame, drawings: DataFrame | None = None) -> DataFrame:
    """Units of the blocks of main text, in reading order, with the levels of headings and the pages' printed numbers.

    ``blocks`` are those of ``layout``, ``contexts`` has (doc_id, page, printed); a page without one has no printed number.
    Blocks without text are no units.
    """
    main = regions(blocks, drawings).withColumn("text", stripped(F.coalesce("text", F.lit("")))).filter("region = 'main'")
    known = main.join(dominant_font(main), PAGE, "left").join(contexts.select(*PAGE, "printed"), PAGE, "left").filter("text <> ''")
    unit = F.row_number().over(W.partitionBy("doc_id").orderBy("page", "reading_order")) - 1
    return known.select("doc_id", unit.alias("unit"), "text", heading_level(F.col("text"), F.col("size"), F.col("font")).alias("level"), "page", "printed")


def dealt(units: DataFrame) -> DataFrame:
    """Units dealt out by document to so many tasks that each sorts a bounded number of units and characters, beyond one document's."""
    size = units.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    return units.repartition(tasks(units.sparkSession, max(size.n, size.chars // ROW)), "doc_id")


def segments(units: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    """Units with ``segment``: its number within the document after all cuts.

    A document is cut at headings of its main level (bab, or else fasl, or else kitab) and of those above it, and where a
    page begins unless the page before ends in the middle of a sentence. A segment of more than ``most`` body tokens is
    cut at headings of the next finer level, and pieces still too long at the one below that.
    """
    doc, order = W.partitionBy("doc_id"), W.partitionBy("doc_id").orderBy("unit")
    here = lambda name: F.max((F.col("level") == name).cast("int")).over(doc) == 1
    df = dealt(units).withColumn("_n", F.coalesce(_number(F.col("level")), F.lit(0)).cast("int")).withColumn("_main", F.when(here("bab"), 2).when(here("fasl"), 3).when(here("kitab"), 1).otherwise(0))
    final = F.rtrim("text").rlike("[.؟!؛]$")
    goes_on = F.lag((F.col("_n") == 0) & ~final).over(order)
    turned = F.col("page") != F.lag("page").over(order)
    begins = (F.col("_n").between(1, F.col("_main"))) | F.coalesce(turned & ~goes_on, F.lit(False))
    df = df.withColumn("_begins", begins.cast("int")).withColumn("segment", F.sum("_begins").over(order))
    df = df.withColumn("_tokens", F.when(F.col("_n") == 0, token_count(F.col("text"))).otherwise(0)).withColumn("_sub", F.lit(0)).withColumn("_open", F.col("_main").between(2, 3))
    for depth in (1, 2):
        piece = W.partitionBy("doc_id", "segment", "_sub")
        at = F.col("_n") == F.col("_main") + depth
        df = df.withColumn("_at", at.cast("int")).withColumn("_cut", F.col("_open") & (F.sum("_tokens").over(piece) > most) & (F.max("_at").over(piece) == 1))
        inner = F.sum("_at").over(piece.orderBy("unit"))
        df = df.withColumn("_inner", F.when(F.col("_cut"), inner).otherwise(0)).withColumn("_sub", F.col("_sub") * 1_000_000 + F.col("_inner")).withColumn("_open", F.col("_cut"))
    return df.withColumn("segment", F.dense_rank().over(W.partitionBy("doc_id").orderBy("segment", "_sub"))).drop("_n", "_main", "_begins", "_tokens", "_sub", "_open", "_at", "_cut", "_inner")


def with_context(units: DataFrame) -> DataFrame:
    """Units with the last heading of each level up to and including them; a level doesn't reset those below it."""
    order = W.partitionBy("doc_id").orderBy("unit").rowsBetween(W.unboundedPreceding, 0)
    return units.withColumns({name: F.last(F.when(F.col("level") == name, F.col("text")), ignorenulls=True).over(order) for name in LEVELS})


def packs(counts: Column, most: int = MOST_TOKENS, overlap: float = OVERLAP) -> Column:
    """Array of (first, last), from 0, of the sentences of each chunk, from the array of their token counts.

    Sentences are added while they fit. The next chunk begins with the last sentences of the one before that have no
    more than the overlap's share of tokens, one of them at least. A fold over indices: no text is copied.
    """
    carry = max(1, int(most * overlap))
    tail = lambda part: F.aggregate(
        F.reverse(part), F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"), F.lit(True).alias("on")),
        lambda t, c: F.when(t["on"] & ((t["n"] == 0) | (t["sum"] + c <= carry)), F.struct((t["n"] + 1).alias("n"), (t["sum"] + c).alias("sum"), F.lit(True).alias("on"))).otherwise(F.struct(t["n"].alias("n"), t["sum"].alias("sum"), F.lit(False).alias("on"))),
    )
    none = F.array().cast("array<struct<first:int,last:int>>")
    state = lambda done, first, sum_, i: F.struct(done.alias("done"), first.alias("first"), sum_.alias("sum"), i.alias("i"))

    def step(s: Column, c: Column) -> Column:
        def moved(t: Column) -> Column:
            done = F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), (s["i"] - 1).alias("last"))))
            return state(done, s["i"] - t["n"], t["sum"] + c, s["i"] + 1)

        full = (s["i"] > s["first"]) & (s["sum"] + c > most)
        return F.when(full, moved(tail(F.slice(counts, s["first"] + 1, F.greatest(s["i"] - s["first"], F.lit(0)))))).otherwise(state(s["done"], s["first"], s["sum"] + c, s["i"] + 1))

    end = lambda s: F.when(s["i"] > 0, F.concat(s["done"], F.array(F.struct(s["first"].alias("first"), (s["i"] - 1).alias("last"))))).otherwise(none)
    return F.aggregate(counts, state(none, F.lit(0), F.lit(0), F.lit(0)), step, end)


def chunks(units: DataFrame, most: int = MOST_TOKENS, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, order_index, chunk_id, kitab, bab, fasl, topic, context_heading, page_start, page_end, printed_start,
    printed_end, raw_text, normalized_text, token_count) of all documents. Blank units don't count; segments without body
    text make no chunk."""
    clean = units.withColumn("text", stripped(F.col("text"))).filter("text <> ''")
    cut = with_context(segments(clean, most))
    piece = W.partitionBy("doc_id", "segment").orderBy("unit")
    first = piece.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    named = cut.withColumns({name: F.first(name).over(first) for name in LEVELS})
    body = named.filter("level is null").withColumn("_key", F.row_number().over(piece))
    parts = body.select("doc_id", "segment", *LEVELS, "page", "printed", "_key", F.posexplode(sentences_for_packing(F.col("text"))).alias("_pos", "sentence"))
    row = F.struct("_key", "_pos", "sentence", "page", "printed", token_count(F.col("sentence")).alias("n"))
    lists = parts.groupBy("doc_id", "segment", *LEVELS).agg(F.array_sort(F.collect_list(row)).alias("s"))
    # The counts are an own column before the fold, which names them often.
    counted = lists.withColumn("_n", F.transform("s", lambda x: x["n"]))
    packed = counted.select("doc_id", "segment", *LEVELS, "s", F.posexplode(packs(F.col("_n"), most, overlap)).alias("_pack", "p"))
    own = F.slice("s", F.col("p.first") + 1, F.col("p.last") - F.col("p.first") + 1)
    one = packed.withColumn("own", own)
    join = F.aggregate(
        "own", F.struct(F.lit("").alias("t"), F.lit(-1).alias("k")),
        lambda a, x: F.struct(F.concat(a["t"], F.when(a["k"] == -1, "").when(a["k"] == x["_key"], " ").otherwise("\n"), x["sentence"]).alias("t"), x["_key"].alias("k")), lambda a: a["t"],
    )
    label = lambda name: F.when(F.col(name) != "", F.concat(F.lit(f"{name.capitalize()}: "), F.col(name)))
    heading = F.concat_ws("\n", *[label(n) for n in LEVELS])
    made = one.withColumn("_body", join).withColumn("context_heading", F.when(heading != "", heading)).withColumn("raw_text", F.concat(F.when(heading != "", F.concat(heading, F.lit("\n\n"))).otherwise(""), F.col("_body")))
    ordered = made.withColumn("order_index", F.row_number().over(W.partitionBy("doc_id").orderBy("segment", "_pack")) - 1)
    return ordered.select(
        "doc_id", "order_index", chunk_id(F.col("order_index"), F.col("raw_text")).alias("chunk_id"), *LEVELS, "context_heading",
        F.col("own")[0]["page"].alias("page_start"), F.element_at("own", -1)["page"].alias("page_end"), F.col("own")[0]["printed"].alias("printed_start"), F.element_at("own", -1)["printed"].alias("printed_end"),
        "raw_text", one_space(F.col("_body")).alias("normalized_text"), token_count(F.col("raw_text")).alias("token_count"),
    )
