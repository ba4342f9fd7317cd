"""Mixing sources to target weights over a tree of levels, native expressions only.

The tree's levels are columns, from the root's children down to the leaves (domain,
language, source). Weights are whole numbers up to MOST_WEIGHT per node; a node's budget is dealt to its
children in proportion to their weights, whole: what rounding down leaves goes to the largest
remainders, one each, ties to the first path. A child can take at most what its subtree can
supply (tokens times the epochs allowed); what it can't take goes to its siblings in
proportion to their weights, and only what a whole subtree can't take is seen by the
level above, because subtrees enter that level with their supply as a cap. So shortages move
among siblings before they move among ancestors.

Within a leaf, documents are ordered anew for each epoch by a keyed digest. A budget
of e whole epochs and r tokens takes every document e times and then the prefix of r tokens of
epoch e's order; the document on the boundary gives its first tokens.

At scale: the documents' sizes are taken once, as a narrow table. A leaf's order
is never sorted as a whole: it is cut into bins of about BIN_ROWS documents by the digest's
value, token sums per bin find the bin that holds the boundary, and only that bin's
documents are sorted. A hot leaf therefore costs partial sums and one bin. The selection is
then a comparison of each document's digest with its leaf's boundary, a join with the
leaf table, broadcast while its counted rows are within the bound.

Cases: null levels are a node of their own (shown as ''). Null or empty texts
have 0 tokens and are taken with what precedes them in the order. Rows that repeat a doc_id
stand at one place of the order; on the boundary each of them gives its first tokens. A budget above the
supply takes the supply. Nodes without a weight have weight 1; weight 0 takes nothing. Level values
should hold no '/', which joins them to paths. Products are decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from emberlog.llm.common import Scratch, sized, words

BIN_ROWS = 2000
#: What a leaf's row is taken to need in a broadcast.
LEAF_BYTES = 256
#: Up to this weight, eighteen digits tell any two quotients apart.
MOST_WEIGHT = 10**9
#: Digests are whole numbers below 2^DIGEST_BITS.
DIGEST_BITS = 52

_ID, _H = "__mix_id", "__mix_h"


def digest(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in an epoch's order."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc_id.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, DIGEST_BITS // 4), 16, 10).cast("long")


def _level(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def _wide(expression: str) -> str:
    return f"cast({expression} as decimal(19, 0))"


def allocate(
    supply: DataFrame, levels: Sequence[str], budget: int | Column, weights: DataFrame | None = None
) -> DataFrame:
    """Deal `budget` down the tree.

    `supply` has a row for each leaf: the levels and `cap`, the most it can give.
    `weights` has (path, weight), a path being the node's levels joined by '/'.
    Returns the leaves with `budget`. The budgets add up to the whole, or to the supply of what has a weight.
    """
    names = list(levels)

    def path(depth: int) -> Column:
        return F.concat_ws("/", *names[:depth])

    dealt = None
    for depth in range(1, len(names) + 1):
        nodes = supply.groupBy(*names[:depth]).agg(F.sum("cap").alias("cap"))
        nodes = nodes.withColumn("path", path(depth))
        if weights is None:
            nodes = nodes.withColumn("weight", F.lit(1).cast("long"))
        else:
            nodes = nodes.join(weights.select("path", F.col("weight").cast("long").alias("given")), "path", "left")
            nodes = nodes.withColumn("weight", F.coalesce("given", F.lit(1))).drop("given")
        if dealt is None:
            nodes = nodes.withColumn("whole", F.lit(budget).cast("long") if isinstance(budget, int) else budget)
        else:
            nodes = nodes.join(dealt, names[: depth - 1])
        parents = names[: depth - 1] or [F.lit(0)]
        # Children by the share at which they run dry; those before the first that has
        # enough for its share take their cap, the others share what is left.
        dry = F.when(
            F.col("weight") > 0, F.expr(f"struct(cap div weight, {_wide('cap % weight')} * {10**18}BD div weight)")
        )
        order = Window.partitionBy(*parents).orderBy(dry.asc_nulls_last(), F.col("path"))
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        after = order.rowsBetween(0, Window.unboundedFollowing)
        nodes = (
            nodes.withColumn("rest", F.col("whole") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
            .withColumn("among", F.sum("weight").over(after))
            .withColumn("fits", (F.col("weight") > 0) & F.expr(f"{_wide('cap')} * {_wide('among')} > {_wide('rest')} * {_wide('weight')}"))
        )
        first = Window.partitionBy(*parents).orderBy(F.when(F.col("fits"), 0).otherwise(1), dry.asc_nulls_last(), "path")
        whole = first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        nodes = nodes.withColumn("r", F.first("rest").over(whole)).withColumn("s", F.first("among").over(whole))
        part = f"{_wide('weight')} * {_wide('greatest(r, 0L)')}"
        nodes = nodes.withColumn("share", F.when(F.col("fits"), F.expr(f"{part} div {_wide('greatest(s, 1L)')}")))
        nodes = nodes.withColumn("over", F.when(F.col("fits"), F.expr(f"{part} % {_wide('greatest(s, 1L)')}")))
        rank = F.row_number().over(Window.partitionBy(*parents).orderBy(F.desc_nulls_last("over"), "path"))
        left = F.greatest(F.col("r"), F.lit(0)) - F.sum("share").over(Window.partitionBy(*parents))
        given = F.when(F.col("weight") <= 0, F.lit(0)).when(~F.col("fits"), F.col("cap"))
        given = given.otherwise(F.col("share") + F.when(F.col("rank") <= F.col("left"), 1).otherwise(0))
        nodes = nodes.withColumn("rank", rank).withColumn("left", left)
        dealt = nodes.select(*names[:depth], given.cast("long").alias("whole"))
    return dealt.withColumnRenamed("whole", "budget")


def _sizes(docs: DataFrame, levels: dict[str, Column], id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        *(_level(column).alias(name) for name, column in levels.items()),
        F.size(words(F.col(text_col))).cast("long").alias("n_tokens"),
    )


def plan(
    docs: DataFrame,
    levels: dict[str, Column],
    fraction: tuple[int, int],
    max_epochs: int = 1,
    seed: int = 0,
    weights: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame, Scratch]:
    """Sizes of the documents, and for each leaf its budget and boundary.

    The total budget is fraction[0] / fraction[1] of all tokens, rounded down. The leaf
    table has the levels, `epochs` (taken whole), and `cut_h`, `cut_id`, `cut_take`: the
    boundary document of the last epoch and how many of its tokens go.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    names = list(levels)
    sizes = scratch.put(_sizes(docs, levels, id_col, text_col), "sizes")
    leaves = scratch.put(
        sizes.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "leaves"
    )
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    budget = total * fraction[0] // fraction[1]
    dealt = allocate(leaves.select(*names, (F.col("tokens") * max_epochs).alias("cap")), names, budget, weights)
    leaves = scratch.put(
        leaves.join(dealt, names).select(
            *names,
            "tokens",
            "budget",
            F.expr("if(tokens = 0, 0L, budget div tokens)").alias("epochs"),
            F.expr("if(tokens = 0, 0L, budget % tokens)").alias("rest"),
            (F.floor(F.col("rows") / BIN_ROWS) + 1).alias("bins"),
        ),
        "leaves",
    )
    n_leaves = leaves.count()
    partial = leaves.where("rest > 0").select(*names, "epochs", "rest", "bins")
    placed = (
        sizes.join(sized(partial, n_leaves, LEAF_BYTES), names)
        .withColumn("h", digest(seed, F.col("epochs"), F.col("doc_id")))
        .withColumn("bin", F.expr(f"h div ({2**DIGEST_BITS} div bins)"))
    )
    sums = scratch.put(placed.groupBy(*names, "rest", "bin").agg(F.sum("n_tokens").alias("t")), "sums")
    upto = Window.partitionBy(*names).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cut = scratch.put(
        sums.withColumn("end", F.sum("t").over(upto))
        .where((F.col("end") >= F.col("rest")) & (F.col("end") - F.col("t") < F.col("rest")))
        .select(*names, F.col("bin").alias("cut_bin"), (F.col("end") - F.col("t")).alias("start")),
        "cut",
    )
    inside = placed.join(sized(cut, n_leaves, LEAF_BYTES), names).where("bin = cut_bin")
    ordered = Window.partitionBy(*names).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        inside.groupBy(*names, "rest", "start", "h", "doc_id").agg(F.sum("n_tokens").alias("t"))
        .withColumn("end", F.col("start") + F.sum("t").over(ordered))
        .where((F.col("end") >= F.col("rest")) & (F.col("end") - F.col("t") < F.col("rest")))
        .select(
            *names,
            F.col("h").alias("cut_h"),
            F.col("doc_id").alias("cut_id"),
            (F.col("rest") - F.col("end") + F.col("t")).alias("cut_take"),
        )
    )
    table = scratch.put(leaves.join(edge, names, "left").drop("bins"), "table")
    scratch.drop(sums, cut)
    return sizes, table, scratch


def _before(h: str, doc_id: str) -> Column:
    return (F.col(h) < F.col("cut_h")) | ((F.col(h) == F.col("cut_h")) & (F.col(doc_id) <= F.col("cut_id")))


def select(docs: DataFrame, levels: dict[str, Column], seed: int = 0, **options) -> DataFrame:
    """One row for each taken document and epoch: doc_id, the levels, epoch, n_tokens, take_tokens."""
    names = list(levels)
    sizes, table, _ = plan(docs, levels, seed=seed, **options)
    rows = sizes.join(sized(table.drop("tokens", "budget", "rest"), table.count(), LEAF_BYTES), names)
    rows = rows.withColumn("h", digest(seed, F.col("epochs"), F.col("doc_id")))
    edge = (F.col("h") == F.col("cut_h")) & (F.col("doc_id") == F.col("cut_id"))
    take = F.when(edge, F.least("n_tokens", "cut_take")).otherwise(F.col("n_tokens"))
    part = F.coalesce(_before("h", "doc_id"), F.lit(False))
    last = F.when(part, F.array(F.struct(F.col("epochs").alias("epoch"), take.alias("take_tokens"))))
    every = F.when(
        F.col("epochs") > 0,
        F.transform(
            F.sequence(F.lit(0).cast("long"), F.greatest(F.col("epochs") - 1, F.lit(0))),
            lambda e: F.struct(e.alias("epoch"), F.col("n_tokens").alias("take_tokens")),
        ),
    )
    none = F.array().cast("array<struct<epoch:bigint,take_tokens:bigint>>")
    taken = F.concat(F.coalesce(every, none), F.coalesce(last, none))
    return rows.select("doc_id", *names, "n_tokens", F.explode(taken).alias("t")).select(
        "doc_id", *names, "t.epoch", "n_tokens", "t.take_tokens"
    )


def keep_selected(
    docs: DataFrame, levels: dict[str, Column], seed: int = 0, id_col: str = "doc_id", **options
) -> DataFrame:
    """The rows of `docs` that the mixture takes, whole and once, with all their columns.

    The boundary document stays. No text is shuffled: the leaf table comes to the rows.
    """
    _, table, _ = plan(docs, levels, seed=seed, id_col=id_col, **options)
    keys = {name: f"__mix_{name}" for name in levels}
    side = table.select(*(F.col(n).alias(k) for n, k in keys.items()), "epochs", "cut_h", "cut_id")
    side = side.select(*keys.values(), *(F.col(c).alias(f"__mix_{c}") for c in ("epochs", "cut_h", "cut_id")))
    h = digest(seed, F.col("__mix_epochs"), F.col(id_col).cast("long"))
    ident = F.col(id_col).cast("long")
    below = (h < F.col("__mix_cut_h")) | ((h == F.col("__mix_cut_h")) & (ident <= F.col("__mix_cut_id")))
    own = docs.withColumns({f"__own_{name}": _level(column) for name, column in levels.items()})
    on = [F.col(f"__own_{name}") == F.col(key) for name, key in keys.items()]
    joined = own.join(sized(side, table.count(), LEAF_BYTES), on)
    return joined.where((F.col("__mix_epochs") > 0) | F.coalesce(below, F.lit(False))).select(*docs.columns)


def oracle(
    levels: dict[str, str], fraction: tuple[int, int], max_epochs: int, seed: int, table: str = "documents", weights: dict[str, int] | None = None
) -> str:
    """DuckDB SQL for select(); weights by path."""
    names = list(levels)
    cols = ", ".join(names)
    given = ", ".join(f"('{path}', {weight})" for path, weight in (weights or {"": 1}).items())
    steps = f"""
wt(path, weight) AS (VALUES {given}),"""
    dealt = ""
    for depth in range(1, len(names) + 1):
        own, up = ", ".join(names[:depth]), names[: depth - 1]
        part = f"PARTITION BY {', '.join(up)} " if up else ""
        path = " || '/' || ".join(names[:depth])
        whole = "(SELECT sum(tokens) * {0} // {1} FROM leaves)".format(*fraction)
        above = f"CROSS JOIN (SELECT CAST({whole} AS HUGEINT) AS whole)"
        if dealt:
            above = f"JOIN {dealt} d USING ({', '.join(up)})"
        steps += f"""
n{depth} AS (
  SELECT n.*, whole, CAST(coalesce(wt.weight, 1) AS HUGEINT) AS weight
  FROM (SELECT {own}, CAST(sum(tokens * {max_epochs}) AS HUGEINT) AS cap, {path} AS path FROM leaves GROUP BY {own}) n {above} LEFT JOIN wt USING (path)
),
w{depth} AS (
  SELECT *, cap // weight AS dry, (cap % weight) * {10**18} // weight AS dust FROM n{depth} WHERE weight > 0
),
o{depth} AS (
  SELECT *, whole - coalesce(sum(cap) OVER ({part}ORDER BY dry, dust, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER ({part}ORDER BY dry, dust, path ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS among
  FROM w{depth}
),
f{depth} AS (SELECT *, cap * among > rest * weight AS fits FROM o{depth}),
g{depth} AS (
  SELECT *, first_value(greatest(rest, 0)) OVER ({part}ORDER BY CASE WHEN fits THEN 0 ELSE 1 END, dry, dust, path) AS r,
    first_value(among) OVER ({part}ORDER BY CASE WHEN fits THEN 0 ELSE 1 END, dry, dust, path) AS s
  FROM f{depth}
),
h{depth} AS (SELECT *, CASE WHEN fits THEN weight * r // s END AS share, CASE WHEN fits THEN weight * r % s END AS over FROM g{depth}),
i{depth} AS (
  SELECT *, row_number() OVER ({part}ORDER BY over DESC NULLS LAST, path) AS place, r - sum(share) OVER ({part}) AS left_over FROM h{depth}
),
d{depth} AS (
  SELECT {own}, CASE WHEN fits THEN share + CASE WHEN place <= left_over THEN 1 ELSE 0 END ELSE cap END AS whole FROM i{depth}
  UNION ALL SELECT {own}, CAST(0 AS HUGEINT) FROM n{depth} WHERE weight <= 0
),"""
        dealt = f"d{depth}"
    return f"""
WITH sizes AS (
  SELECT doc_id, {', '.join(f"coalesce(CAST({expr} AS VARCHAR), '') AS {name}" for name, expr in levels.items())},
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens
  FROM {table}
),
leaves AS (SELECT {cols}, sum(n_tokens) AS tokens FROM sizes GROUP BY {cols}),{steps}
t AS (
  SELECT {cols}, tokens, CASE WHEN tokens = 0 THEN 0 ELSE whole // tokens END AS epochs,
    CASE WHEN tokens = 0 THEN 0 ELSE whole % tokens END AS rest
  FROM leaves JOIN {dealt} USING ({cols})
),
r AS (
  SELECT s.*, t.epochs, t.rest, md5('{seed}:' || t.epochs || ':' || s.doc_id)[:{DIGEST_BITS // 4}] AS h
  FROM sizes s JOIN t USING ({cols})
),
c AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY {cols} ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens AS start FROM r
),
p AS (
  SELECT doc_id, {cols}, epochs AS epoch, n_tokens, least(n_tokens, rest - start) AS take_tokens
  FROM c WHERE rest > 0 AND (start < rest)
),
e AS (SELECT doc_id, {cols}, unnest(range(0, CAST(epochs AS BIGINT))) AS epoch, n_tokens, n_tokens AS take_tokens FROM r)
SELECT doc_id, {cols}, CAST(epoch AS BIGINT) AS epoch, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(take_tokens AS BIGINT) AS take_tokens
FROM (SELECT * FROM p UNION ALL SELECT * FROM e)
"""
