"""Mixing sources to target weights.

A token budget runs down the tree domain - language - source. At every node the children share it by their weights;
what a child can't use goes to its siblings first, and only what all of them can't use back to the ancestors' other
children. Each leaf then takes whole epochs of its documents and, of the last epoch, the prefix whose tokens fit, in an
order that the seed and the epoch give. All of it is DataFrame operators.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialise

#: Hexadecimal digits of the order's key that name a bucket.
BUCKET_DIGITS = 3
LEVELS = ("domain", "language", "source_name")
Weights = Mapping[str, int]


def domain_of(source: Column) -> Column:
    """The domain of a source: its number modulo four stands for a topic; sources without a number are ``other``."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", "other").otherwise(F.concat(F.lit("domain"), (F.expr("try_cast(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) AS INT)") % 4).cast("string")))


def _weight(name: str, weights: Weights) -> Column:
    out = F.lit(int(weights.get("*", 1)))
    for key, value in weights.items():
        if key != "*":
            out = F.when(F.col(name) == key, int(value)).otherwise(out)
    return out.cast("decimal(38,0)")


def _shared(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Fills children with (weight, capacity) from ``budget``: the greatest level that some of them can't reach is theirs.

    Sorted by capacity for each unit of weight, the children up to the last one below the water level get all they can
    use, and the others the level. Shares are rounded down; weights are positive whole numbers.
    """
    ratio = F.col("capacity").cast("double") / F.col("weight").cast("double")
    order = W.partitionBy(*parent).orderBy(ratio, name)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    down = (
        children.withColumn("used", F.coalesce(F.sum("capacity").over(before), F.lit(0)).cast("decimal(38,0)"))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)).cast("decimal(38,0)"))
        .withColumn("full", F.col("capacity") * F.col("open") <= (F.col("budget") - F.col("used")) * F.col("weight"))
        .withColumn("place", F.row_number().over(order))
        .withColumn("level_at", F.min(F.when(~F.col("full"), F.col("place"))).over(W.partitionBy(*parent)))
    )
    at = F.col("place") == F.col("level_at")
    level = (
        down.withColumn("left", F.max(F.when(at, F.col("budget") - F.col("used"))).over(W.partitionBy(*parent)))
        .withColumn("among", F.max(F.when(at, F.col("open"))).over(W.partitionBy(*parent)))
    )
    share = F.expr("CAST(left * weight AS DECIMAL(38,0)) DIV among").cast("decimal(38,0)")
    capped = F.col("level_at").isNull() | (F.col("place") < F.col("level_at"))
    return level.withColumn("budget", F.when(capped, F.col("capacity")).otherwise(F.least(share, F.col("capacity"))).cast("decimal(38,0)")).drop(
        "used", "open", "full", "place", "level_at", "left", "among"
    )


def leaf_budgets(tokens: DataFrame, total: Column, epochs: int, weights: Mapping[str, Weights] | None = None) -> DataFrame:
    """(domain, language, source_name, available, budget) from rows (domain, language, source_name, n_tokens).

    ``total`` is the budget as an expression over ``available``, the tokens of all leaves.
    """
    whole = "decimal(38,0)"
    weights = weights or {}
    leaves = tokens.groupBy(*LEVELS).agg(F.sum("n_tokens").cast(whole).alias("available"))
    leaf = leaves.withColumn("capacity", (F.col("available") * epochs).cast(whole))
    level1 = leaf.groupBy("domain").agg(F.sum("capacity").cast(whole).alias("capacity"), F.sum("available").cast(whole).alias("available"))
    root = W.partitionBy("root").orderBy("domain").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level1 = level1.withColumn("root", F.lit(0)).withColumn("available", F.sum("available").over(root).cast(whole))
    level1 = level1.withColumn("budget", F.least(F.floor(total), F.col("available") * epochs).cast(whole)).withColumn("weight", _weight("domain", weights.get("domain", {})))
    level1 = _shared(level1, ["root"], "domain").select("domain", "budget")
    level2 = leaf.groupBy("domain", "language").agg(F.sum("capacity").cast(whole).alias("capacity")).join(level1, "domain")
    level2 = _shared(level2.withColumn("weight", _weight("language", weights.get("language", {}))), ["domain"], "language").select("domain", "language", "budget")
    level3 = leaf.join(level2, ["domain", "language"]).withColumn("weight", _weight("source_name", weights.get("source", {})))
    return _shared(level3, ["domain", "language"], "source_name").select(*LEVELS, "available", F.col("budget"))


def mix(docs: DataFrame, share: float = 0.5, epochs: int = 3, seed: int = 17, weights: Mapping[str, Weights] | None = None, total: int | None = None) -> DataFrame:
    """The chosen copies of ``docs``, with ``_epoch`` (from 0), ``_n_tokens`` and ``_leaf_budget``.

    The budget is ``total`` tokens, or the share of all tokens at hand. Tokens are words. Null languages and sources are
    leaves of their own, named ``(none)``; null texts have no tokens. A leaf's documents of equal key (rows that repeat
    an id) are taken or left together, so a prefix never exceeds the leaf's budget; documents without tokens are taken
    as far as the prefix goes, and a leaf without tokens gives none. Rows with a null id share one place in the order. An empty table gives an empty one.
    Columns of ``docs`` pass through, but for those named as in ``LEVELS`` or with an underscore before, which the
    operator's own replace.
    """
    named = (
        docs.drop("_epoch", "_n_tokens", "_leaf_budget", "_key", "_end", "_budget", "_full", "_rest", "_available")
        .withColumn("domain", domain_of(F.col("source"))).withColumn("language", F.coalesce("lang", F.lit("(none)"))).withColumn("source_name", F.coalesce("source", F.lit("(none)")))
        .withColumn("_n_tokens", F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long"))
    )
    goal = F.lit(int(total)) if total is not None else F.col("available") * F.lit(int(round(share * 1000))) / 1000
    # Tokens are counted once for the whole plan: a narrow table of ids and leaves is written first.
    narrow = materialise(named.select("doc_id", *LEVELS, F.col("_n_tokens").alias("n_tokens")), "counted")
    budgets = leaf_budgets(narrow, goal, epochs, weights).select(*LEVELS, F.col("available").alias("_available"), F.col("budget").alias("_budget"))
    budgets = budgets.withColumn("_full", F.when(F.col("_available") > 0, F.expr("CAST(_budget DIV _available AS INT)")).otherwise(0))
    # One row for each leaf: written first, so that its size is known where Spark chooses the joins.
    budgets = materialise(budgets.withColumn("_rest", F.col("_budget") - F.col("_full") * F.col("_available")), "budgets")

    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    placed = narrow.join(budgets, list(LEVELS)).withColumn("key", key).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    # The prefix ends in one bucket of each leaf: sums of buckets find it, and only its documents are ranked.
    sums = placed.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("n"), F.first("_rest").alias("_rest"))
    run = F.sum("n").over(W.partitionBy(*LEVELS).orderBy("bucket"))
    cut_bucket = sums.withColumn("upto", run).filter(F.col("upto") > F.col("_rest")).groupBy(*LEVELS).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("c"))
    cut_bucket = cut_bucket.select(*LEVELS, F.col("c.bucket").alias("cut_bucket"), F.col("c.before").alias("before"))
    inside = placed.join(cut_bucket, list(LEVELS)).filter(F.col("bucket") == F.col("cut_bucket"))
    upto = F.sum("n_tokens").over(W.partitionBy(*LEVELS).orderBy("key").rangeBetween(W.unboundedPreceding, W.currentRow))
    first_out = inside.withColumn("upto", F.col("before") + upto).filter(F.col("upto") > F.col("_rest")).groupBy(*LEVELS).agg(F.min("key").alias("_end"))
    plan = materialise(budgets.join(first_out, list(LEVELS), "left"), "plan")

    chosen = named.join(plan, list(LEVELS)).withColumn("_key", key)
    partial = (F.col("_rest") > 0) & (F.col("_end").isNull() | (F.col("_key") < F.col("_end")))
    times = F.col("_full") + partial.cast("int")
    out = chosen.filter(times > 0).withColumn("_epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    return out.withColumn("_leaf_budget", F.col("_budget").cast("long")).drop("_available", "_budget", "_full", "_rest", "_end", "_key")


def _sql_weight(name: str, weights: Weights) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {int(v)}" for k, v in weights.items() if k != "*")
    other = int(weights.get("*", 1))
    return f"CASE {name} {cases} ELSE {other} END" if cases else str(other)


def _sql_shared(name: str, source: str, parent: str, child: str, keep: str) -> str:
    """Common table expressions that end in ``name``: ``keep`` and the shared budget of the rows of ``source``."""
    return f"""
{name}_a AS (
  SELECT *, coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, row_number() OVER w AS place
  FROM {source} WINDOW w AS (PARTITION BY {parent} ORDER BY CAST(capacity AS DOUBLE) / CAST(weight AS DOUBLE), {child})
),
{name}_b AS (SELECT *, min(CASE WHEN capacity * open > (budget - used) * weight THEN place END) OVER (PARTITION BY {parent}) AS level_at FROM {name}_a),
{name}_c AS (
  SELECT *, max(CASE WHEN place = level_at THEN budget - used END) OVER (PARTITION BY {parent}) AS left_over,
         max(CASE WHEN place = level_at THEN open END) OVER (PARTITION BY {parent}) AS among
  FROM {name}_b
),
{name} AS (
  SELECT {keep}, CASE WHEN level_at IS NULL OR place < level_at THEN capacity ELSE least(left_over * weight // among, capacity) END AS budget FROM {name}_c
)"""


def sql(docs: str, name: str = "mixed", share: float = 0.5, epochs: int = 3, seed: int = 17, weights: Mapping[str, Weights] | None = None) -> str:
    """Common table expressions, the last of them ``name``: each chosen copy of the relation ``docs``."""
    weights = weights or {}
    w = {k: _sql_weight(c, weights.get(k, {})) for k, c in (("domain", "domain"), ("language", "language"), ("source", "source_name"))}
    first = _sql_shared("level1", "top", "root", "domain", "domain")
    second = _sql_shared("level2", "middle", "domain", "language", "domain, language")
    third = _sql_shared("level3", "bottom", "domain, language", "source_name", "domain, language, source_name, available")
    return f"""
named AS (
  SELECT *, CASE WHEN coalesce(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') = '' THEN 'other' ELSE 'domain' || (CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INTEGER) % 4) END AS domain,
         coalesce(lang, '(none)') AS language, coalesce(source, '(none)') AS source_name,
         CAST(coalesce(len(regexp_extract_all(text, '{WORD_PATTERN}')), 0) AS BIGINT) AS n_tokens
  FROM {docs}
),
leaf AS (SELECT domain, language, source_name, CAST(sum(n_tokens) AS HUGEINT) AS available, CAST(sum(n_tokens) AS HUGEINT) * {epochs} AS capacity FROM named GROUP BY ALL),
goal AS (SELECT least(sum(available) * {int(round(share * 1000))} // 1000, sum(capacity)) AS budget FROM leaf),
top AS (SELECT 0 AS root, domain, sum(capacity) AS capacity, {w["domain"]} AS weight, (SELECT budget FROM goal) AS budget FROM leaf GROUP BY domain),{first},
middle AS (SELECT domain, language, c.capacity, {w["language"]} AS weight, budget FROM (SELECT domain, language, sum(capacity) AS capacity FROM leaf GROUP BY ALL) c JOIN level1 USING (domain)),{second},
bottom AS (SELECT domain, language, source_name, available, capacity, {w["source"]} AS weight, budget FROM leaf JOIN level2 USING (domain, language)),{third},
plan AS (SELECT *, CASE WHEN available > 0 THEN budget // available ELSE 0 END AS full_epochs, CASE WHEN available > 0 THEN budget % available ELSE budget END AS rest FROM level3),
placed AS (
  SELECT n.*, p.budget, p.full_epochs, p.rest, md5('{seed}|' || p.full_epochs || '|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS order_key
  FROM named n JOIN plan p USING (domain, language, source_name)
),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, source_name ORDER BY order_key) AS upto FROM placed),
ended AS (SELECT *, min(CASE WHEN upto > rest THEN order_key END) OVER (PARTITION BY domain, language, source_name) AS end_key FROM summed),
timed AS (SELECT *, full_epochs + CASE WHEN rest > 0 AND (end_key IS NULL OR order_key < end_key) THEN 1 ELSE 0 END AS times FROM ended),
{name} AS (SELECT *, CAST(unnest(generate_series(0, CAST(times AS BIGINT) - 1)) AS INTEGER) AS epoch FROM timed WHERE times > 0)"""
