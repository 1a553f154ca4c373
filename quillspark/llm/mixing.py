"""Operator 9: mixing sources to target weights by Sainte-Laguë apportionment.

Documents of a source and shard, in seeded order, are cut in blocks of BLOCK_TOKENS
tokens (a document belongs to the block that it begins in; a shard's last block may
be shorter). Of all blocks, the share BUDGET is allocated to sources by highest
quotients w / (2 i - 1), i up to the blocks that the source has, w its target weight.
A source's seats go in the same way, weighed by their blocks, to its shards, and in
each shard that many blocks are taken in the order of a seeded hash.

By default the target weight of a source is its number of tokens to the power
TEMPERATURE. Tokens are estimated as a quarter of the characters, rounded up. The
number of shards grows with the corpus; what reaches the driver are sources and, per source,
how many shards have how many blocks.

At least one block is taken, if there are any. A document longer than a block counts as one,
so a seat may bring more tokens to a source of very long documents.

Defined results: equal quotients go to the larger weight, then to the source or shard
first in order; a null source counts as ''; a null or empty text has no tokens and goes with the
block at its place; a row with a null doc_id is ordered by its text; repeated rows are placed each;
a source without weight or with weight 0 gets nothing; a table without rows gives none. Other columns are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialise, numbered, pick, restrict

BLOCK_TOKENS = 16384
SHARD_TOKENS = 20_000_000
BUDGET = 0.9
TEMPERATURE = 0.7
SEED = 9


def apportion(classes: list[tuple[float, int, int]], seats: int) -> tuple[list[int], list[int]]:
    """Highest quotients over classes (weight, most seats a member may have, members), given in tie order.

    Returns the seats of every member of each class, and how many of its first members have one more.
    """
    def above(q: float, w: float, cap: int) -> int:
        i = max(0, min(cap, int((w / q + 1) / 2)))
        while i < cap and w / (2 * i + 1) > q:
            i += 1
        while i and w / (2 * i - 1) <= q:
            i -= 1
        return i

    lo, hi = 0.0, max((w for w, _, _ in classes), default=0.0)
    if hi <= 0:
        return [0] * len(classes), [0] * len(classes)
    for _ in range(80):  # a threshold above which no more quotients lie than there are seats
        mid = (lo + hi) / 2
        if mid <= 0 or mid in (lo, hi):
            break
        lo, hi = (mid, hi) if sum(above(mid, w, c) * m for w, c, m in classes if w > 0) > seats else (lo, mid)
    base = [above(hi, w, c) if w > 0 else 0 for w, c, _ in classes]
    left = seats - sum(b * m for b, (_, _, m) in zip(base, classes))
    more = [0] * len(classes)
    heap = [(-w / (2 * b + 1), -w, k) for k, (b, (w, c, _)) in enumerate(zip(base, classes)) if w > 0 and b < c]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, _, k = heapq.heappop(heap)
        w, cap, members = classes[k]
        if members > left:
            more[k], left = left, 0
        else:
            base[k], left = base[k] + 1, left - members
            if base[k] < cap:
                heapq.heappush(heap, (-w / (2 * base[k] + 1), -w, k))
    return base, more


def seeded(*parts: Column | str) -> Column:
    """Hash that orders rows; in SQL md5(concat_ws(':', seed, ...))."""
    return F.md5(F.concat_ws(":", F.lit(str(SEED)), *parts))


def row_key(doc_id: Column, text: Column) -> Column:
    """What a row is ordered by: its doc_id, or else a digest of its text."""
    return F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))


def blocks_of(docs: DataFrame) -> DataFrame:
    """(doc_id, source, shard, block, n_tokens, key) of every row."""
    rows = pick(docs, "doc_id", "text", "source").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce(F.ceil(F.length("text") / 4), F.lit(0)).alias("n_tokens"), row_key(F.col("doc_id"), F.col("text")).alias("key"))
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    shard = F.conv(F.substring(F.md5(F.concat(F.lit("shard:"), "key")), 1, 8), 16, 10).cast("long") % F.lit(1 + total // SHARD_TOKENS)
    w = Window.partitionBy("source", "shard").orderBy(seeded("key"), "key", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.sum("n_tokens").over(w) - F.col("n_tokens")
    return rows.withColumn("shard", shard).withColumn("block", F.floor(begins / BLOCK_TOKENS))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = BUDGET) -> DataFrame:
    """(doc_id, source, shard, block, n_tokens) of the rows taken."""
    return _taken(docs, weights, budget).drop("key")


def take(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = BUDGET) -> DataFrame:
    """The rows of docs, all columns as they are, that are taken; rows of one source and doc_id, or text where that is null, are taken or left as one."""
    keys = materialise(_taken(docs, weights, budget).select(F.struct("source", "key").alias("row")).distinct(), "taken")
    at = {c: F.col(f"_{docs.columns.index(c)}") for c in ("doc_id", "text", "source")}
    flat = numbered(docs).withColumn("_row_", F.struct(F.coalesce(at["source"], F.lit("")).alias("source"), row_key(at["doc_id"], at["text"]).alias("key")))
    return restrict(flat.withColumnRenamed("_row_", "row"), keys, "row").drop("row").toDF(*docs.columns)


def _taken(docs: DataFrame, weights: dict[str, float] | None, budget: float) -> DataFrame:
    """As mix, with the key of each row."""
    placed = materialise(blocks_of(docs), "placed")
    supply = materialise(placed.groupBy("source", "shard").agg(F.countDistinct("block").alias("blocks"), F.sum("n_tokens").alias("n_tokens")), "supply")
    sources = supply.groupBy("source").agg(F.sum("blocks").alias("blocks"), F.sum("n_tokens").alias("n_tokens")).collect()
    if weights is None:
        weights = {r.source: float(r.n_tokens) ** TEMPERATURE for r in sources}
    classes = sorted(((float(weights.get(r.source, 0.0)), r.source, r.blocks) for r in sources), key=lambda x: (-x[0], x[1]))
    seats, _ = apportion([(w, b, 1) for w, _, b in classes], max(1, int(budget * sum(r.blocks for r in sources))))
    # A class of one member never has a remainder: what is left over goes to it whole.
    quota = {s: n for (_, s, _), n in zip(classes, seats)}
    alike: dict[str, list] = {}
    for r in supply.groupBy("source", "blocks").agg(F.count("*").alias("shards")).collect():
        alike.setdefault(r.source, []).append((r.blocks, r.shards))
    rows = []
    for s, found in alike.items():
        found.sort(reverse=True)
        base, more = apportion([(float(b), b, m) for b, m in found], quota[s])
        rows += [(s, b, n, x) for (b, _), n, x in zip(found, base, more)]
    spark = docs.sparkSession
    table = spark.createDataFrame(rows, "source string, blocks long, base long, more long")
    turn = F.row_number().over(Window.partitionBy("source", "blocks").orderBy("shard"))
    per_shard = supply.join(F.broadcast(table), ["source", "blocks"]).withColumn("quota", F.col("base") + (turn <= F.col("more")).cast("long"))
    order = Window.partitionBy("source", "shard").orderBy(seeded("source", F.col("shard").cast("string"), F.col("block").cast("string")), "block")
    ranked = placed.select("source", "shard", "block").distinct().withColumn("turn", F.row_number().over(order))
    taken = ranked.join(per_shard.select("source", "shard", "quota"), ["source", "shard"]).filter("turn <= quota").select("source", "shard", "block")
    return placed.join(taken, ["source", "shard", "block"], "left_semi").select("doc_id", "source", "shard", "block", "n_tokens", "key")


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(ceil(length(text) / 4)::BIGINT, 0) AS n_tokens, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT *, ('0x' || substr(md5('shard:' || key), 1, 8))::BIGINT % (1 + (SELECT sum(n_tokens) FROM d)::BIGINT // {SHARD_TOKENS}) AS shard FROM d),
p AS (SELECT doc_id, source, shard, n_tokens, (sum(n_tokens) OVER (PARTITION BY source, shard ORDER BY md5('{SEED}:' || key), key, n_tokens
      ROWS UNBOUNDED PRECEDING)::BIGINT - n_tokens) // {BLOCK_TOKENS} AS block FROM s),
b AS (SELECT source, shard, block FROM p GROUP BY ALL),
w AS (SELECT source, sum(n_tokens)::DOUBLE ** {TEMPERATURE} AS w FROM p GROUP BY source),
c AS (SELECT source, count(*) AS cap FROM b GROUP BY source),
q AS (SELECT source, w / (2 * i - 1) AS q, w FROM (SELECT source, w, unnest(range(1, cap + 1)) AS i FROM c JOIN w USING (source))),
seats AS (SELECT source, count(*) AS n FROM (SELECT source FROM q ORDER BY q DESC, w DESC, source
          LIMIT (SELECT greatest(1, floor({BUDGET} * count(*)))::BIGINT FROM b)) GROUP BY source),
sh AS (SELECT source, shard, count(*)::DOUBLE AS w FROM b GROUP BY ALL),
sq AS (SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY w / (2 * i - 1) DESC, w DESC, shard) AS r
       FROM (SELECT source, shard, w, unnest(range(1, w::BIGINT + 1)) AS i FROM sh)),
quota AS (SELECT source, shard, count(*) AS n FROM sq JOIN seats USING (source) WHERE r <= seats.n GROUP BY ALL),
turn AS (SELECT source, shard, block, row_number() OVER (PARTITION BY source, shard ORDER BY md5('{SEED}:' || source || ':' || shard || ':' || block), block) AS r FROM b),
taken AS (SELECT source, shard, block FROM turn JOIN quota USING (source, shard) WHERE r <= n)
SELECT doc_id, source, shard, block, n_tokens FROM p SEMI JOIN taken USING (source, shard, block)
"""
