"""Page layout from the geometry of text blocks: columns, margins, footnotes, direction and reading order.

Blocks are rows (doc_id, page, block_index, x0, y0, x1, y1, text, size, width, height), of which width and height are the
page's. A page is the largest group that any window sees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Shares of a page's height or width by which blocks are told apart.
HEADER, FOOTER, FOOTNOTE, FOOTNOTE_FONT, LEAST_WIDTH, LEAST_HEIGHT, GAP = 0.07, 0.93, 0.72, 0.85, 0.02, 0.004, 0.18
#: Character ranges of Arabic script.
ARABIC = "\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{08A0}-\\x{08FF}\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFF}"
PAGE = ["doc_id", "page"]


def _letters() -> tuple[Column, Column]:
    """How many Arabic characters and how many other letters a block's text has."""
    of = lambda pattern: F.coalesce(F.length(F.regexp_replace("text", pattern, "")), F.lit(0))
    return of(f"[^{ARABIC}]"), of(f"[^\\p{{L}}]|[{ARABIC}]")


def directions(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, direction): right to left where Arabic characters outnumber other letters."""
    arabic, letters = _letters()
    return blocks.groupBy(*PAGE).agg(F.when(F.sum(arabic) > F.sum(letters), "rtl").otherwise("ltr").alias("direction"))


def by_page(blocks: DataFrame) -> DataFrame:
    """Blocks dealt out by page, once for all windows over pages and parts of pages that follow."""
    return blocks.repartition(*PAGE)


def _numbered(blocks: DataFrame, name: str, inside: Column) -> DataFrame:
    """Blocks with the number, from 0, of the column that they stand in among those that are ``inside``: sorted by their
    middles, a gap of more than a share of the page begins a new one. The others have columns of their own."""
    order = W.partitionBy(*PAGE, "_in").orderBy("_middle", "block_index")
    gap = (F.col("_middle") - F.lag("_middle").over(order)) > F.col("width") * GAP
    rows = blocks.withColumn("_in", F.coalesce(inside, F.lit(False))).withColumn("_middle", (F.col("x0") + F.col("x1")) / 2)
    rows = rows.withColumn("_gap", F.coalesce(gap.cast("int"), F.lit(0))).withColumn(name, F.sum("_gap").over(order))
    return rows.drop("_middle", "_gap")


def columns(blocks: DataFrame) -> DataFrame:
    """Blocks with ``column``, the number of the column that they stand in."""
    return _numbered(by_page(blocks), "column", F.lit(True)).drop("_in")


def with_reading_order(blocks: DataFrame) -> DataFrame:
    """Blocks, dealt by page, with ``reading_order``: what begins in the top band, the columns in the page's direction, what
    ends in the bottom band. A block in both bands is read at its second place."""
    top, bottom = F.coalesce(F.col("y0") <= F.col("height") * HEADER, F.lit(False)), F.coalesce(F.col("y1") >= F.col("height") * FOOTER, F.lit(False))
    arabic, letters = _letters()
    whole = W.partitionBy(*PAGE)
    rows = blocks.withColumn("_sign", F.when(F.sum(arabic).over(whole) > F.sum(letters).over(whole), -1).otherwise(1))
    rows = _numbered(rows, "_column", ~top & ~bottom)
    ends = W.partitionBy(*PAGE, "_in", "_column")
    middle = F.struct((F.col("_sign") * F.min("x0").over(ends)).alias("a"), (F.col("_sign") * F.max("x1").over(ends)).alias("b"), F.bround("y0", 1).alias("c"), F.col("x0").alias("d"))
    edge = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.col("y0").alias("c"), F.col("x0").alias("d"))
    parts = F.when(top & bottom, F.array(F.lit(0), F.lit(2))).when(top, F.array(F.lit(0))).when(bottom, F.array(F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = rows.withColumn("_key", F.when(F.col("_in"), middle).otherwise(edge)).withColumn("_both", top & bottom).withColumn("_part", F.explode(parts))
    placed = rows.withColumn("reading_order", F.row_number().over(W.partitionBy(*PAGE).orderBy("_part", "_key", "block_index")) - 1)
    return placed.filter(~(F.col("_both") & (F.col("_part") == 0))).drop("_sign", "_in", "_column", "_key", "_both", "_part")


def reading_order(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, block_index, reading_order) of every block."""
    return with_reading_order(by_page(blocks)).select(*PAGE, "block_index", "reading_order")


def with_margins(blocks: DataFrame) -> DataFrame:
    """Blocks, dealt by page, with ``margin``: whether they stand in a narrow column beside the widest one."""
    rows = _numbered(blocks, "_column", (F.col("y1") > F.col("height") * HEADER) & (F.col("y0") < F.col("height") * FOOTER))
    own, side = W.partitionBy(*PAGE, "_in", "_column"), W.partitionBy(*PAGE, "_in")
    rows = rows.withColumn("_l", F.min("x0").over(own)).withColumn("_r", F.max("x1").over(own)).withColumn("_w", F.col("_r") - F.col("_l"))
    rows = rows.withColumn("_m", F.max(F.struct(F.col("_w").alias("w"), (-F.col("_column")).alias("c"), F.col("_l").alias("l"), F.col("_r").alias("r"))).over(side))
    overlap = F.greatest(F.lit(0.0), F.least(F.col("_r"), F.col("_m.r")) - F.greatest(F.col("_l"), F.col("_m.l")))
    share = F.when(F.col("_w") > 0, overlap / F.col("_w")).otherwise(1.0)
    narrow = F.col("_in") & (F.col("_m.w") > 0) & (F.col("_column") != -F.col("_m.c")) & (F.col("_w") < F.col("_m.w") * 0.6) & (share < 0.5)
    return rows.withColumn("margin", F.coalesce(narrow, F.lit(False))).drop("_in", "_column", "_l", "_r", "_w", "_m")


def margins(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, block_index) of the blocks in narrow columns beside the widest one."""
    return with_margins(by_page(blocks)).filter("margin").select(*PAGE, "block_index")


def separators(drawings: DataFrame) -> DataFrame:
    """(doc_id, page, separator): the height of the first rule that may part footnotes, from drawings (doc_id, page,
    drawing_index, x0, y0, x1, y1, width, height)."""
    middle = (F.col("y0") + F.col("y1")) / 2
    rule = (F.col("x1") - F.col("x0") >= F.col("width") * 0.5) & middle.between(F.col("height") * 0.55, F.col("height") * 0.95)
    return drawings.filter(rule).groupBy(*PAGE).agg(F.min_by(middle, "drawing_index").alias("separator"))


def regions(blocks: DataFrame, drawings: DataFrame | None = None) -> DataFrame:
    """Blocks with ``region``, ``confidence`` and ``reading_order``. All of it is windows over one exchange by page."""
    y0, y1, w, h = F.col("y0"), F.col("y1"), F.col("width"), F.col("height")
    in_body = (y1 > h * HEADER) & (y0 < h * FOOTER)
    main_font = F.max(F.when(in_body, F.coalesce("size", F.lit(0.0)))).over(W.partitionBy(*PAGE))
    known = with_margins(by_page(blocks)).withColumn("_font", F.coalesce(main_font, F.lit(0.0)))
    known = known.join(separators(drawings), PAGE, "left") if drawings is not None else known.withColumn("separator", F.lit(None).cast("double"))

    def kind(name: str, sure: float) -> Column:
        return F.struct(F.lit(name).alias("region"), F.lit(sure).alias("confidence"))

    small = (F.col("x1") - F.col("x0") < w * LEAST_WIDTH) | (y1 - y0 < h * LEAST_HEIGHT)
    found = (
        F.when((w <= 0) | (h <= 0), kind("unknown", 0.3)).when(y1 <= h * HEADER, kind("header", 0.95)).when(y0 >= h * FOOTER, kind("footer", 0.95))
        .when(small, kind("unknown", 0.3)).when(F.col("margin"), kind("margin", 0.85)).when(y0 > F.col("separator"), kind("footnote", 0.95))
        .when((y0 >= h * FOOTNOTE) & (F.coalesce("size", F.lit(0.0)) < F.col("_font") * FOOTNOTE_FONT), kind("footnote", 0.9)).otherwise(kind("main", 0.8))
    )
    out = known.withColumn("_k", found).withColumn("region", F.col("_k.region")).withColumn("confidence", F.col("_k.confidence")).drop("_k", "_font", "margin", "separator")
    return with_reading_order(out)


def dominant_font(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, font): the size that most characters have, to one place; ties to the size met first."""
    known = blocks.filter(F.col("size") > 0).withColumn("font", F.bround("size", 1))
    sums = known.groupBy(*PAGE, "font").agg(F.sum(F.length("text")).alias("n"), F.min("block_index").alias("first"))
    return sums.groupBy(*PAGE).agg(F.max_by("font", F.struct("n", -F.col("first"))).alias("font"))
