"""Mixing sources to target weights by hierarchical budgets.

Leaves are (domain, language, source). The token budget goes down the tree: a node's share is split among its
children by their weights, but none gets more than its leaves can give in the allowed epochs, and what one can't
use goes to its siblings first and only what all of them can't use stays with the parent's siblings. This is
water-filling at each node with the capacities summed from below. A leaf takes whole epochs of its documents and
of the next epoch, in that epoch's seeded order, the longest prefix within its remaining tokens.

The tree is small rows; documents are never ordered globally. For a leaf's prefix, tokens are summed by the first
HEX or more digits of the order key, as many as leave about BUCKET_DOCS documents to a bucket, first for HEX digits and
then, within the bucket that the prefix ends in, for all of them; only the one boundary bucket of each leaf is
ordered, and the resulting cut key is joined back to the documents. Sums are whole numbers, so the result doesn't depend on partitioning.

Edge cases: null and empty texts have no tokens and belong to every prefix; null languages, sources or domains
are nodes of their own; rows of one doc_id share an order key and stand or fall together; unnamed nodes weigh 1,
those of weight 0 get nothing, and neither they nor what hangs below them count as capacity; an empty table or budget 0 gives an empty result; other columns pass as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import OWN, table, whole_text

TOKEN = "[^\\x20\\x09-\\x0D]+"
#: Digits of the order key that make a bucket, and the most documents of a leaf for so many; beyond, a leaf has more buckets.
HEX = 3
MOST_HEX = 7
BUCKET_DOCS = 1024
LEVELS = ("domain", "lang", "source")
#: More leaves than this are joined by shuffle instead of broadcast.
BROADCAST_LEAVES = 100_000


@dataclass(frozen=True)
class Mixture:
    """share: the budget, of all tokens there are. weights: by level and node name, whole numbers."""

    share: float = 0.6
    epochs: int = 2
    seed: str = "mix-1"
    weights: dict[str, dict[str, int]] = field(default_factory=dict)


#: Production parameters: four domains by the source's number, languages, and equal sources.
DEFAULT = Mixture(weights={"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}})


def default_domain(source: Column) -> Column:
    """'d0' .. 'd3' by the number at the source's end, 'd4' without one."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), F.coalesce(F.when(F.length(number) > 0, number.cast("int") % 4), F.lit(4)).cast("string"))


def _weight(level: str, mixture: Mixture) -> Column:
    named = mixture.weights.get(level, {})
    if not named:
        return F.lit(1)
    pairs = [F.lit(x) for kv in sorted(named.items()) for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _value(level)), F.lit(1))


def _value(level: str) -> Column:
    """What a node's name stands for."""
    return F.when(F.col(level).startswith("="), F.expr(f"substring({level}, 2)"))


def _filled(nodes: DataFrame, parent: list[str], child: str, mixture: Mixture) -> DataFrame:
    """Splits budget (of the parent) among children with capacity; sets budget to the child's own."""
    nodes = nodes.withColumn("w", _weight(child, mixture))
    by = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = by.orderBy(F.col("capacity") / F.col("w"), child)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    nodes = nodes.withColumn("level", (F.col("budget") - before) / rest)
    nodes = nodes.withColumn("level", F.max("level").over(by))
    own = F.when(F.col("capacity") <= F.col("level") * F.col("w"), F.col("capacity")).otherwise(F.floor(F.col("level") * F.col("w")))
    return nodes.withColumn("budget", F.greatest(own.cast("long"), F.lit(0))).drop("level", "w")


def budgets(supply: DataFrame, mixture: Mixture) -> DataFrame:
    """supply (domain, lang, source, tokens) to the same and budget."""
    total = supply.agg(F.sum("tokens")).first()[0] or 0
    leaves = supply.withColumn("capacity", F.col("tokens") * mixture.epochs)
    for level in LEVELS:  # what can't be taken is no capacity of any node above it
        leaves = leaves.filter(_weight(level, mixture) > 0)
    budget = None
    for i, level in enumerate(LEVELS):
        names = list(LEVELS[: i + 1])
        nodes = leaves.groupBy(*names).agg(F.sum("capacity").alias("capacity"))
        if budget is None:
            nodes = nodes.withColumn("budget", F.lit(int(total * mixture.share)).cast("long"))
        else:
            nodes = nodes.join(budget, names[:-1])
        budget = _filled(nodes, names[:-1], level, mixture).select(*names, "budget")
    return supply.join(budget, list(LEVELS))


def order_key(ident: Column, seed: str, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(ident.cast("string"), F.lit("null"))))


def _edge(keyed: DataFrame, bucket: str) -> DataFrame:
    """Of each leaf the bucket that its prefix ends in: the tokens before it, and its documents."""
    sums = keyed.groupBy(*LEVELS, bucket).agg(F.sum("tokens").alias("t"), F.max("rest").alias("rest"), F.max("before").alias("outer"), F.count(F.lit(1)).alias("n"))
    upto = F.col("outer") + F.sum("t").over(W.partitionBy(*LEVELS).orderBy(bucket).rowsBetween(W.unboundedPreceding, 0))
    edge = sums.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("t"))
    return edge.filter((F.col("upto") > F.col("rest")) & (F.col("before") <= F.col("rest")))


def cuts(rows: DataFrame, mixture: Mixture) -> DataFrame:
    """rows (domain, lang, source, doc_id, tokens) to each leaf's whole epochs and the cut key of the next one."""
    supply = table(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "supply")
    plan = budgets(supply, mixture)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.when(F.col("budget") >= 0, 1)).cast("int")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    plan = table(plan.select(*LEVELS, "whole", "rest", "budget"), "budgets")
    partly = plan.filter("rest > 0")
    keyed = rows.join(partly, list(LEVELS)).withColumn("key", order_key(F.col("doc_id"), mixture.seed, F.col("whole")))
    coarse = _edge(keyed.withColumn("bucket", F.substring("key", 1, HEX)).withColumn("before", F.lit(0).cast("long")), "bucket")
    digits = F.least(F.lit(MOST_HEX), F.lit(HEX) + F.ceil(F.greatest(F.log(16.0, F.col("n") / BUCKET_DOCS), F.lit(0.0)))).cast("int")
    coarse = coarse.select(*LEVELS, "bucket", "before", digits.alias("digits"))
    inner = keyed.withColumn("bucket", F.substring("key", 1, HEX)).join(coarse, [*LEVELS, "bucket"]).withColumn("bucket", F.expr("substring(key, 1, digits)"))
    fine = _edge(inner, "bucket").select(*LEVELS, "bucket", "before")
    inner = inner.drop("before").join(fine, [*LEVELS, "bucket"])
    leaf = W.partitionBy(*LEVELS)
    inner = inner.withColumn("upto", F.col("before") + F.sum("tokens").over(leaf.orderBy("key").rangeBetween(W.unboundedPreceding, 0)))
    found = inner.groupBy(*LEVELS).agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("key"))).alias("last"), F.max("bucket").alias("bucket"))
    found = found.select(*LEVELS, F.coalesce("last", "bucket").alias("cut"))
    return table(plan.join(found, list(LEVELS), "left").select(*LEVELS, "whole", "cut", "budget"), "cuts")


def _named(docs: DataFrame, domain: Column) -> DataFrame:
    """docs with the nodes' names: '=' and the value, or 'null'."""
    text = {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}
    return docs.withColumns({k: F.coalesce(F.concat(F.lit("="), v.cast("string")), F.lit("null")) for k, v in text.items()})


def _taken(rows: DataFrame, plan: DataFrame, mixture: Mixture) -> DataFrame:
    """A row of rows (with the leaf's columns and doc_id) for each epoch that takes it, with epoch."""
    if plan.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES:
        plan = F.broadcast(plan)
    rows = rows.join(plan, list(LEVELS))
    more = (order_key(F.col("doc_id"), mixture.seed, F.col("whole")) <= F.col("cut")).cast("int")
    n = F.col("whole") + F.coalesce(more, F.lit(0))
    return rows.filter(n > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), n - 1))).drop("whole", "cut", "budget")


def measured(docs: DataFrame, domain: Column, text: str = "text") -> DataFrame:
    """A table of each document's leaf and number of tokens."""
    rows = _named(docs.select("doc_id", text, "lang", "source"), domain)
    tokens = F.size(F.regexp_extract_all(whole_text(text), F.lit(TOKEN), 0)).cast("long")
    return table(rows.select(*LEVELS, "doc_id", tokens.alias("tokens")), "measured")


def mix(docs: DataFrame, mixture: Mixture = DEFAULT, domain: Column | None = None) -> DataFrame:
    """The chosen rows of docs (doc_id, text, lang, source and more), columns as they were; one for each epoch."""
    domain = default_domain(F.col("source")) if domain is None else domain
    plan = cuts(measured(docs, domain), mixture)
    row = f"{OWN}row"
    rows = docs.withColumn(row, F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select(row, "doc_id", "lang", "source")
    return _taken(_named(rows, domain), plan, mixture).select(f"{row}.*")


def mixture_rows(docs: DataFrame, mixture: Mixture = DEFAULT, domain: Column | None = None) -> DataFrame:
    """doc_id, domain, lang, source, tokens, epoch of the chosen documents."""
    rows = measured(docs, default_domain(F.col("source")) if domain is None else domain)
    out = _taken(rows, cuts(rows, mixture), mixture)
    return out.select("doc_id", *[_value(x).alias(x) for x in LEVELS], "tokens", "epoch")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mixture_rows(docs)


def _level_sql(i: int) -> str:
    names, parent = LEVELS[: i + 1], LEVELS[:i]
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    named = DEFAULT.weights.get(LEVELS[i], {})
    weight = f"CASE {LEVELS[i]} {' '.join(f"WHEN '={k}' THEN {v}" for k, v in sorted(named.items()))} ELSE 1 END" if named else "1"
    above = "(SELECT CAST(floor(sum(tokens) * 0.6::DOUBLE) AS BIGINT) FROM supply)" if not i else "p.budget"
    source = f"FROM supply GROUP BY {', '.join(names)}"
    join = "n" if not i else f"n JOIN b{i - 1} p USING ({', '.join(parent)})"
    return f"""n{i} AS (SELECT {", ".join(names)}, sum(tokens) * {DEFAULT.epochs} AS capacity {source}),
    w{i} AS (SELECT n.*, {weight} AS w, {above} AS share FROM n{i} {join}),
    l{i} AS (SELECT *, (share - coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lev FROM w{i} WINDOW o AS ({by} ORDER BY capacity / w::DOUBLE, {LEVELS[i]})),
    m{i} AS (SELECT *, max(lev) OVER ({by}) AS lv FROM l{i}),
    b{i} AS (SELECT {", ".join(names)}, CAST(greatest(CASE WHEN capacity <= lv * w THEN capacity ELSE floor(lv * w) END, 0) AS BIGINT) AS budget FROM m{i})"""


SQL = f"""WITH r AS (SELECT doc_id, '=d' || CAST(coalesce(TRY_CAST(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS INT) % 4, 4) AS VARCHAR) AS domain,
      coalesce('=' || lang, 'null') AS lang, coalesce('=' || source, 'null') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents),
    supply AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM r GROUP BY domain, lang, source),
    {_level_sql(0)}, {_level_sql(1)}, {_level_sql(2)},
    q AS (SELECT s.*, budget, CASE WHEN s.tokens > 0 THEN budget // s.tokens ELSE 1 END AS whole FROM supply s JOIN b2 USING (domain, lang, source)),
    k AS (SELECT r.*, whole, budget - whole * q.tokens AS rest, md5('{DEFAULT.seed}:' || CAST(whole AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM r JOIN q USING (domain, lang, source)),
    c AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE UNBOUNDED PRECEDING) AS upto FROM k),
    t AS (SELECT *, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS n FROM c)
    SELECT doc_id, substr(domain, 2) AS domain, CASE WHEN lang <> 'null' THEN substr(lang, 2) END AS lang, CASE WHEN source <> 'null' THEN substr(source, 2) END AS source, tokens, CAST(unnest(range(n)) AS INT) AS epoch FROM t WHERE n > 0"""
