"""Mixing sources to target weights, in DataFrame and SQL functions only.

Each source's documents are put in a seeded order (md5 of seed, doc_id and
text) that is laid end to end, repeated as often as the target asks: copy e of a
document covers the words [e*S + start, e*S + start + size) of its source's
stream, and the mix takes what lies before the target.  The stream is cut into
blocks of equal word counts; a source's quota is its number of blocks.

A splitting tree hands the quotas to the output shards: a node holds a range of
shards and a multiset of block tickets, and passes on exactly the left half's
share of them, drawn without replacement, to the left; the counts by source that
reach a child are multivariate hypergeometric, and every block is in exactly one
leaf.  The tree runs over tickets, of which there are at most `max_blocks` plus
one a source whatever the size of the corpus, not over documents.  A shard's
documents are then shuffled locally by a seeded sort.

Starts are prefix sums in two steps, over key ranges and within them, so no task
holds a whole source, be it a third of the corpus.

Defined results: a null text has size 0; null is a source of its own, last in
order; sources of size 0 get target 0; an empty table gives an empty result;
repeated rows are placed one after the other; columns of the input, whatever
their names, are kept, but for those named as an added column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm._io import Table

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixParams:
    """weights repeat over the sources in order; repeats bounds how often a source's words are taken."""

    weights: tuple[int, ...] = (5, 2, 1)
    repeats: int = 3
    shards: int = 16
    seed: int = 1729
    min_block_words: int = 2048
    max_blocks: int = 50_000
    range_digits: int = 3
    range_rows: int = 20_000
    max_broadcast_rows: int = 200_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hinted(df: DataFrame, rows: int, params: MixParams) -> DataFrame:
    return F.broadcast(df) if rows <= params.max_broadcast_rows else df


def targets(sizes: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """(_src, _no, _total, _target, _block): one row a source, from (_src, _total).

    The water level at which capped shares by weight add up to the whole is found by sorting sources by cap over weight.
    """
    by_name = Window.orderBy(F.col("_src").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in params.weights])
    w = sizes.withColumn("_no", F.row_number().over(by_name) - 1)
    w = w.withColumn("_w", F.element_at(weights, (F.col("_no") % len(params.weights) + 1).cast("int")).cast("long"))
    w = w.withColumn("_cap", F.col("_total") * params.repeats).withColumn("_ratio", F.col("_cap").cast("double") / F.col("_w"))
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = Window.orderBy("_ratio", "_no")
    level = (F.sum("_total").over(every) - F.coalesce(F.sum("_cap").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("double") / F.sum("_w").over(rank.rowsBetween(0, Window.unboundedFollowing))
    w = w.withColumn("_level", level).withColumn("_free", F.col("_level") <= F.col("_ratio"))
    water = F.min(F.when(F.col("_free"), F.struct(F.col("_ratio").alias("a"), F.col("_no").alias("b"), F.col("_level").alias("c")))).over(every)["c"]
    target = F.least(water * F.col("_w"), F.col("_cap").cast("double"))
    block = F.greatest(F.lit(params.min_block_words), F.ceil(F.sum("_total").over(every) / F.lit(params.max_blocks))).cast("long")
    return w.select("_src", F.col("_no").cast("long").alias("_no"), "_total", target.alias("_target"), F.round(target).cast("long").alias("_goal"), block.alias("_block"))


def splitting_tree(quotas: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """(_no, _ticket, _shard) from (_no, _quota): each ticket's leaf."""
    t = quotas.where("_quota > 0").select("_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_quota") - 1)).alias("_ticket"))
    t = t.withColumn("_lo", F.lit(0)).withColumn("_hi", F.lit(params.shards))
    for level in range(max(0, (params.shards - 1).bit_length())):
        draw = F.md5(F.concat_ws(":", F.lit(str(params.seed)), F.lit(f"split{level}"), F.col("_no").cast("string"), F.col("_ticket").cast("string")))
        node = Window.partitionBy("_lo", "_hi")
        t = t.withColumn("_n", F.count("*").over(node)).withColumn("_r", F.row_number().over(node.orderBy(draw, "_no", "_ticket")))
        mid = F.floor((F.col("_lo") + F.col("_hi")) / 2).cast("int")
        share = F.floor(F.col("_n") * (F.col("_mid") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
        t = t.withColumn("_mid", mid).withColumn("_left", F.col("_r") <= share)
        # A node of a single shard is a leaf.
        leaf = F.col("_hi") - F.col("_lo") == 1
        t = t.select(
            "_no",
            "_ticket",
            F.when(leaf | F.col("_left"), F.col("_lo")).otherwise(F.col("_mid")).alias("_lo"),
            F.when(leaf | ~F.col("_left"), F.col("_hi")).otherwise(F.col("_mid")).alias("_hi"),
        )
    return t.select("_no", "_ticket", F.col("_lo").alias("_shard"))


ADDED = ("_size", "_total", "_target", "_taken", "_copies")


def _apart(df: DataFrame, own: tuple[str, ...], name: str) -> tuple[DataFrame, list[str]]:
    """The columns in own as they are, and all others as fields of one column, so that no name clashes; and the others' names."""
    rest = [c for c in df.columns if c.lower() not in own]
    packed = F.struct(*[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(rest)]) if rest else F.lit(None)
    return df.select(*[F.col(c) for c in own], packed.alias(name)), rest


def _back(columns: list[str], rest: list[str], name: str) -> list[Column]:
    """The columns again, in their order."""
    return [F.col(name)[f"f{rest.index(c)}"].alias(c) if c in rest else F.col(c.lower()).alias(c) for c in columns]


def plan(df: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """df (as `measured` returns it) with `_size`, `_total` and `_target` of its source, `_taken`, and `_copies`, an array of (copy, taken, shard)."""
    names = [c for c in df.columns if c.lower() not in (*ADDED, "_text_key")]
    df, rest = _apart(df.select(*[F.col(f"`{c}`") for c in names], "_size", "_text_key"), ("doc_id", "source", "_size", "_text_key"), "_rest")
    # Key ranges are finer where there are more rows, and never cut a key; their number changes no result.
    digits, rows = params.range_digits, df.count()
    while rows > params.range_rows << (4 * digits) and digits < 6:
        digits += 1
    key = F.md5(F.concat_ws(":", F.lit(str(params.seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("_text_key")))
    sized = df.withColumn("_key", key).drop("_text_key").withColumn("_range", F.substring("_key", 1, digits))
    # Both levels of sums come from one small table: words by source and key range.
    sums = Table(sized.groupBy(F.col("source").alias("_src"), "_range").agg(F.sum("_size").alias("_words")), "sums").df
    known = Table(targets(sums.groupBy("_src").agg(F.sum("_words").alias("_total")), params), "targets").df
    sources = known.count()
    small = _hinted(known, sources, params)
    sums = sums.join(small.select("_src", "_no"), sums["_src"].eqNullSafe(known["_src"])).select("_no", "_range", "_words")
    before = F.coalesce(F.sum("_words").over(Window.partitionBy("_no").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = Table(sums.select("_no", "_range", before.alias("_before")), "starts").df
    leaves = Table(splitting_tree(known.select("_no", F.ceil(F.col("_goal") / F.col("_block")).cast("long").alias("_quota")), params), "tickets").df

    d = sized.join(small, F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    d = d.join(_hinted(starts, starts.count(), params), ["_no", "_range"])
    inside = Window.partitionBy("_no", "_range").orderBy("_key", "_size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    shards = leaves.groupBy("_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("_ticket", "_shard"))), lambda x: x["_shard"]).alias("_shards"))
    d = d.join(_hinted(shards, sources, params), "_no", "left")

    def copy(e: int) -> Column:
        at = F.col("_start") + F.col("_total") * e
        taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("_size"), F.col("_goal") - at))
        shard = F.get("_shards", F.floor(at / F.col("_block")).cast("int"))
        return F.struct(F.lit(e).alias("copy"), taken.alias("taken"), F.when(taken > 0, shard).alias("shard"))

    copies = F.filter(F.array(*[copy(e) for e in range(params.repeats)]), lambda c: c["taken"] > 0)
    d = d.withColumn("_copies", copies).withColumn("_taken", F.aggregate("_copies", F.lit(0).cast("long"), lambda a, c: a + c["taken"]))
    return d.select(*_back(names, rest, "_rest"), *ADDED)


def measured(df: DataFrame) -> DataFrame:
    """df with what `plan` needs of the text: `_size` and `_text_key`."""
    return df.withColumn("_size", word_count(F.col("text"))).withColumn("_text_key", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def mix(df: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The mix itself: the columns of df for each copy taken, with `mix_shard` and `mix_copy`, shuffled locally within a shard.

    The last copy of a source's stream may be taken in part; its text then ends after the words taken.
    """
    names = [c for c in df.columns if c.lower() not in ("mix_shard", "mix_copy")]
    apart, rest = _apart(df.select(*[F.col(f"`{c}`") for c in names]), ("doc_id", "source", "text"), "_row")
    d = plan(measured(apart), params).withColumn("_c", F.explode("_copies"))
    pieces = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("_c.taken").cast("int")), "")
    d = d.withColumn("text", F.when(F.col("_c.taken") < F.col("_size"), cut).otherwise(F.col("text")))
    order = F.md5(F.concat_ws(":", F.lit(str(params.seed)), F.lit("local"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("_c.copy").cast("string")))
    d = d.withColumn("_order", order).repartition("_c.shard", F.substring("_order", 1, params.range_digits)).sortWithinPartitions("_c.shard", "_order")
    return d.select(*_back(names, rest, "_row"), F.col("_c.shard").alias("mix_shard"), F.col("_c.copy").alias("mix_copy"))


def oracle(params: MixParams = MixParams()) -> str:
    """DuckDB SQL for the digest of `plan` over documents."""
    s, w = params.seed, ", ".join(map(str, params.weights))
    tree, level_sql = "", "tickets"
    for level in range(max(0, (params.shards - 1).bit_length())):
        tree += f"""
  ranked{level} AS (SELECT *, (lo + hi) // 2 AS mid, count(*) OVER (PARTITION BY lo, hi) AS n,
    row_number() OVER (PARTITION BY lo, hi ORDER BY md5('{s}:split{level}:' || no || ':' || ticket), no, ticket) AS r FROM {level_sql}),
  level{level} AS (SELECT no, ticket, CASE WHEN hi - lo = 1 OR r <= n * (mid - lo) // (hi - lo) THEN lo ELSE mid END AS lo,
    CASE WHEN hi - lo = 1 OR r > n * (mid - lo) // (hi - lo) THEN hi ELSE mid END AS hi FROM ranked{level}),"""
        level_sql = f"level{level}"
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('{s}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
  s AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
  n AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS no FROM s),
  w AS (SELECT *, ([{w}])[no % {len(params.weights)} + 1]::BIGINT AS w FROM n),
  r AS (SELECT *, total * {params.repeats} AS cap, (total * {params.repeats})::DOUBLE / w AS ratio, (sum(total) OVER ())::BIGINT AS whole FROM w),
  v AS (SELECT *, (whole - coalesce(sum(cap) OVER (ORDER BY ratio, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER (ORDER BY ratio, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM r),
  water AS (SELECT level AS water FROM v WHERE level <= ratio ORDER BY ratio, no LIMIT 1),
  t AS (SELECT source, no, total, least(water * w, cap::DOUBLE) AS target, round(least(water * w, cap::DOUBLE))::BIGINT AS goal,
    greatest({params.min_block_words}, ceil(whole::DOUBLE / {params.max_blocks}))::BIGINT AS block FROM v, water),
  tickets AS (SELECT no, unnest(range(ceil(goal::DOUBLE / block)::BIGINT)) AS ticket, 0 AS lo, {params.shards} AS hi FROM t),{tree}
  p AS (SELECT d.*, t.no, total, target, goal, block,
    coalesce(sum(size) OVER (PARTITION BY no ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
  c AS (SELECT p.*, e, greatest(0, least(size, goal - start - e * total)) AS part, (start + e * total) // block AS ticket FROM p, range({params.repeats}) g(e)),
  x AS (SELECT c.*, l.lo AS shard FROM c LEFT JOIN {level_sql} l ON l.no = c.no AND l.ticket = c.ticket AND part > 0)
SELECT doc_id, size, total AS source_size, target, sum(part)::BIGINT AS taken, coalesce(string_agg(shard::VARCHAR, ',' ORDER BY e) FILTER (part > 0), '') AS shards
FROM x GROUP BY doc_id, key, start, size, total, target, source"""
