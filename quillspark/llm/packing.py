"""Operator 7: best-fit packing of documents into bins of CAPACITY tokens, after Martello-Toth reduction.

A document longer than CAPACITY is cut in full pieces, which fill bins of their own, and
a rest. What is packed are lengths, so the instance is a histogram of CAPACITY entries
at most, however many documents there are; it is solved on the driver:

* Reduction. A set of up to three lengths that dominates every set that could hold
  its largest member is fixed as a bin, as often as its lengths allow; the instance
  shrinks, and the reduction is repeated until nothing is fixed.
* Best fit. The remaining lengths, from long to short, go each to the fullest bin
  that still has room, or to a new one.

Documents of equal length are interchangeable: they are numbered, distributed, by
hash bucket and doc_id, and the k-th takes the k-th place that the solution has for its length.

Defined results: a null or empty text has no tokens and is in no bin; rows with a
null doc_id are packed; repeated rows are packed each; rows of one doc_id and length are
interchangeable; very long texts are cut in as many pieces as it takes; a table without rows gives none;
other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialise, pick
from ._vec import lean
from .token_counts import VOCABULARY, counted

CAPACITY = 2048
#: Rows per hash bucket in which documents of one length are numbered.
BUCKET_ROWS = 200_000


class Lengths:
    """A multiset of lengths."""

    def __init__(self, counts: dict[int, int]):
        self.count = {w: c for w, c in counts.items() if c > 0}
        self.sizes = sorted(self.count)

    def take(self, w: int, n: int = 1) -> None:
        self.count[w] -= n
        if not self.count[w]:
            del self.count[w]
            del self.sizes[bisect_left(self.sizes, w)]

    def put(self, w: int, n: int = 1) -> None:
        if w not in self.count:
            insort(self.sizes, w)
        self.count[w] = self.count.get(w, 0) + n

    def largest(self, room: int) -> int | None:
        """Largest length <= room."""
        i = bisect_right(self.sizes, room)
        return self.sizes[i - 1] if i else None

    def smallest_two_above(self, w: int) -> tuple[int, int] | None:
        """The two smallest lengths > w, which may be equal."""
        i = bisect_right(self.sizes, w)
        if i == len(self.sizes):
            return None
        a = self.sizes[i]
        if self.count[a] > 1:
            return a, a
        return (a, self.sizes[i + 1]) if i + 1 < len(self.sizes) else None


def dominating(items: Lengths, j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with j that dominates every feasible set with j, or None; items doesn't hold that j.

    With a the largest length that fits beside j: {j} if none fits; {j, a} if a fills the room or no
    two others fit; {j, a, b}, b the largest that fits beside both, if four never fit and any two that
    fit beside j are either below a and b or together no longer than a.
    """
    room = capacity - j
    a = items.largest(room)
    if a is None:
        return (j,)
    if a == room:
        return j, a
    smallest = items.sizes[0]
    pair = (smallest, smallest) if items.count[smallest] > 1 else (smallest, items.sizes[1]) if len(items.sizes) > 1 else None
    if pair is None or sum(pair) > room:
        return j, a
    items.take(a)
    b = items.largest(room - a)
    # With a put back, three may fit beside j if the three smallest do.
    items.put(a)
    three, left = 0, 3
    for w in items.sizes[:3]:
        n = min(left, items.count[w])
        three, left = three + n * w, left - n
    if not left and three <= room:
        return None
    if b is None:  # two others fit, but none beside a
        return None if _longest_pair(items, room) > a else (j, a)
    between = items.smallest_two_above(b)
    if between is None or sum(between) > room or between[1] > a:
        return j, a, b
    best = _longest_pair(items, room)
    return (j, a) if best <= a else None


def _longest_pair(items: Lengths, room: int) -> int:
    """Greatest sum of two lengths that fit in room; 0 if none do."""
    best, lo, hi = 0, 0, len(items.sizes) - 1
    while lo <= hi:
        x, y = items.sizes[lo], items.sizes[hi]
        if x + y > room or (lo == hi and items.count[x] < 2):
            hi -= 1
            continue
        best = max(best, x + y)
        lo += 1
    return best


def reduce(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """([(lengths of a bin, how often)], lengths that remain), by dominance."""
    items, fixed = Lengths(counts), []
    changed = True
    while changed:
        changed = False
        for j in reversed(list(items.sizes)):
            while items.count.get(j, 0):
                items.take(j)
                found = dominating(items, j, capacity)
                items.put(j)
                if not found:
                    break
                need = Counter(found)
                # Repeating it as long as two of each length stay leaves every comparison as it was.
                times = max(1, min((items.count[w] - 2) // n for w, n in need.items()))
                for w, n in need.items():
                    items.take(w, n * times)
                fixed.append((found, times))
                changed = True
    return fixed, dict(items.count)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a bin, how often)] of best-fit decreasing; equal bins are handled together."""
    open_: dict[int, list[list]] = {}  # room -> [lengths so far, as a linked pair, and how many such bins]
    rooms: list[int] = []

    def add(room: int, filled, n: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append([filled, n])

    for w in sorted(counts, reverse=True):
        left = counts[w]
        while left:
            i = bisect_left(rooms, w)
            if i == len(rooms):  # new bins, each filled with w as far as it goes
                each = capacity // w
                n, rest = divmod(left, each)
                if n:
                    add(capacity - each * w, ((w, each), None), n)
                if rest:
                    add(capacity - rest * w, ((w, rest), None), 1)
                left = 0
                continue
            room = rooms[i]
            filled, n = open_[room][-1]
            each = room // w
            full = min(n, left // each)
            put, bins = (each, full) if full else (left, 1)
            open_[room][-1][1] -= bins
            if not open_[room][-1][1]:
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            left -= put * bins
            add(room - put * w, ((w, put), filled), bins)
    out = []
    for groups in open_.values():
        for filled, n in groups:
            lengths: list[int] = []
            while filled:
                lengths += [filled[0][0]] * filled[0][1]
                filled = filled[1]
            out.append((tuple(sorted(lengths, reverse=True)), n))
    return out


def solve(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins for a histogram of lengths <= capacity: those fixed by dominance, then best fit."""
    fixed, rest = reduce(counts, capacity)
    return fixed + best_fit(rest, capacity)


def places(bins: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, ranks, first bin, places per bin): rank r of a length lies in bin first_bin + (r - first_rank) // per."""
    out, used, first_bin = [], Counter(), 0
    for lengths, n in bins:
        for w, per in Counter(lengths).items():
            out.append((w, used[w], per * n, first_bin, per))
            used[w] += per * n
        first_bin += n
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, n_tokens, bin_id) of every piece of every document with tokens."""

    def run(batches):
        for b in batches:
            yield pa.record_batch({"doc_id": b.column(0), "n": counted(b.column(1), vocabulary)})

    rows = pick(docs, "doc_id", "text")
    sized = rows.mapInArrow(lean(run), "doc_id long, n long").filter("n > 0")
    sized = materialise(sized, "lengths")
    total = sized.count()
    spread = F.pmod(F.xxhash64("doc_id", "n"), F.lit(1 + total // BUCKET_ROWS)).alias("bucket")
    sized = sized.select("doc_id", (F.col("n") % capacity).alias("rest"), F.floor(F.col("n") / capacity).alias("full"), spread)
    # Whole pieces: bins in the order of buckets.
    fills = {r["bucket"]: r["k"] for r in sized.filter("full > 0").groupBy("bucket").agg(F.sum("full").alias("k")).collect()}
    # Rests: ranks within a length go by bucket, then within the bucket.
    per = sized.filter("rest > 0").groupBy("rest", "bucket").count()
    per = materialise(per.withColumn("before", F.sum("count").over(Window.partitionBy("rest").orderBy("bucket")) - F.col("count")), "ranks")
    counts = {r["rest"]: r["k"] for r in per.groupBy("rest").agg(F.sum("count").alias("k")).collect()}
    spark = docs.sparkSession
    table = spark.createDataFrame(places(solve(counts, capacity)), "rest long, first_rank long, ranks long, first_bin long, per long")
    n_full, starts = 0, []
    for k in sorted(fills):
        starts.append((k, n_full))
        n_full += fills[k]
    order = ["doc_id", "full", "rest"]
    start = spark.createDataFrame(starts, "bucket long, start long")
    whole = sized.filter("full > 0").join(F.broadcast(start), "bucket")
    whole = whole.withColumn("first", F.col("start") + F.sum("full").over(Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("full"))
    whole = whole.select("doc_id", F.posexplode(F.sequence(F.col("first"), F.col("first") + F.col("full") - 1)).alias("piece", "bin_id"))
    whole = whole.select("doc_id", F.col("piece").cast("long").alias("piece"), F.lit(capacity).cast("long").alias("n_tokens"), "bin_id")
    ranked = sized.filter("rest > 0").join(per.select("rest", "bucket", "before"), ["rest", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("rest", "bucket").orderBy(*order)) - 1)
    found = ranked.join(F.broadcast(table.withColumnRenamed("rest", "w")), (F.col("rest") == F.col("w")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("ranks")))
    rests = found.select("doc_id", F.col("full").alias("piece"), F.col("rest").alias("n_tokens"), (F.lit(n_full) + F.col("first_bin") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("per"))).alias("bin_id"))
    return whole.unionByName(rests)
