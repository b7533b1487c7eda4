"""Mixing sources to target weights by cube-method balanced sampling.

Sizes are numbers of words `[^\\x20\\x09-\\x0D]+`. Sources, by code point and null last, weigh 3, 1, 2, repeating, and share
`share` times all words; no target passes `most` times its source's words, and what is over goes to the others by weight, until
none is above. A document of a source whose target is r times its words is taken floor(r) times and once more with probability
frac(r). These extra draws are made by the cube method: the inclusion probabilities walk at random through the null space of
the balancing constraints (words and documents of the source) until each is 0 or 1, so every source keeps both totals.

The flight runs in blocks of at most about `BLOCK` documents of one source, dealt by a hash; each leaves at most two documents
open. The open ones of a source, a few thousandths of its rows, meet in further rounds of the same size until what is left of
every source fits one block; that flight ends with a landing that takes, of the 2**n ways to close at most two documents, the
one nearest the word total. Draws come from hashes of the seed and the block's own rows in a fixed order, so reruns agree.

Cases: a null text has 0 words; a source of no words has target 0 and none of its documents is taken; rows with equal ids,
repeated rows and null ids are documents of their own; extra columns are ignored; an empty table gives no rows. The table of
sources, one small row each, comes to the driver to be shared out; it is the only thing that does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, few

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BLOCK = 2000
SEED = 20240229
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text) -> object:
    """Number of words of a string column, without regular expressions row by row: white space to spaces, then pieces that aren't empty."""
    spaced = F.translate(text.cast("string"), "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.array_remove(F.split(spaced, " "), "")), F.lit(0)).cast("bigint")


def share_out(sizes: list[int], weights: list[float], total: float, most: float = MOST) -> list[float]:
    """Targets by weight, none above `most` times its size; the excess goes to the rest until none is above."""
    target = [0.0] * len(sizes)
    free = [i for i in range(len(sizes)) if sizes[i] > 0]
    left = total
    while free:
        scale = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * scale > most * sizes[i]]
        if not over:
            for i in free:
                target[i] = weights[i] * scale
            break
        for i in over:
            target[i] = most * sizes[i]
            left -= target[i]
        free = [i for i in free if i not in set(over)]
    return target


def _draws(seed: int) -> Iterator[float]:
    while True:
        seed = (seed + 0x9E3779B97F4A7C15) & (1 << 64) - 1
        z = (seed ^ seed >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        z = (z ^ z >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
        yield ((z ^ z >> 31) >> 11) / (1 << 53)


def flight(p: list[float], x: list[int], seed: int) -> list[float]:
    """Moves probabilities p through the null space of the totals of 1 and of x until at most two are strictly between 0 and 1.

    The sums of p and of p * x stay as they are, and so does each one's expectation.
    """
    p = list(p)
    draw = _draws(seed)
    rest = iter([i for i in range(len(p)) if 0 < p[i] < 1])
    open_: list[int] = []
    while True:
        while len(open_) < 3 and (i := next(rest, None)) is not None:
            open_.append(i)
        if len(open_) == 3:
            a, b, c = open_
            u = [x[c] - x[b], x[a] - x[c], x[b] - x[a]]
            if u == [0, 0, 0]:
                u = [1, -1, 0]
            mine = open_
        elif len(open_) == 2 and x[open_[0]] == x[open_[1]]:
            u, mine = [1, -1], open_
        else:
            return p
        up = min((1 - p[i]) / v if v > 0 else -p[i] / v for i, v in zip(mine, u, strict=True) if v)
        down = min(p[i] / v if v > 0 else (p[i] - 1) / v for i, v in zip(mine, u, strict=True) if v)
        step = up if next(draw) * (up + down) < down else -down
        still = []
        for i, v in zip(mine, u, strict=True):
            now = p[i] + step * v
            now = 0.0 if now < 1e-9 else 1.0 if now > 1 - 1e-9 else now
            p[i] = now
            if 0 < now < 1:
                still.append(i)
        if len(still) == len(mine):  # rounding: close the nearest
            i = min(still, key=lambda k: min(p[k], 1 - p[k]))
            p[i] = float(round(p[i]))
            still.remove(i)
        open_ = still


def landing(p: list[float], x: list[int], missing: float) -> list[float]:
    """Closes the few probabilities still open, so that the words they add come nearest to `missing`."""
    open_ = [i for i in range(len(p)) if 0 < p[i] < 1]
    ways = [[float(k >> j & 1) for j in range(len(open_))] for k in range(1 << len(open_))]
    best = min(ways, key=lambda w: (abs(sum(v * x[i] for v, i in zip(w, open_, strict=True)) - missing), w))
    out = list(p)
    for i, v in zip(open_, best, strict=True):
        out[i] = v
    return out


def _flown(table: pa.Table) -> pa.Table:
    """One block's flight. Open documents keep their probability in `p`, closed ones have 0 or 1."""
    return _moved(table, False)


def _landed(table: pa.Table) -> pa.Table:
    """The last flight of a source and its landing."""
    return _moved(table, True)


def _moved(table: pa.Table, land: bool) -> pa.Table:
    order = [("hash", "ascending"), ("doc_id", "ascending"), ("size", "ascending"), ("tie", "ascending"), ("copy", "ascending")]
    table = table.sort_by(order)
    p, x = table.column("p").to_pylist(), table.column("size").to_pylist()
    first, last = table.column("hash")[0].as_py(), table.column("hash")[-1].as_py()
    q = flight(p, x, (first * 31 + last * 17 + len(p) + SEED) & (1 << 64) - 1)
    if land:
        # earlier flights kept the source's totals, so closing these to their own expected words closes the source
        closed = sum(b * n for b, n in zip(q, x, strict=True) if not 0 < b < 1)
        q = landing(q, x, sum(a * n for a, n in zip(p, x, strict=True)) - closed)
    return table.set_column(table.schema.get_field_index("p"), "p", pa.array(q, pa.float64()))


def mix(docs: DataFrame, keep: list[str], share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """docs' columns `keep` (among them doc_id and source), then size, source_size, target, copies (how often the mix takes the row)."""
    spark = docs.sparkSession
    measured = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    # equal rows are counted and dealt out again by number, so that a row repeated without end spreads over all blocks
    counted = measured.groupBy(*measured.columns).agg(F.count("*").alias("n")).select(*measured.columns, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("copy"))
    base = cut(counted, "mixing-sizes")
    totals = base.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    totals.sort(key=lambda r: (r.source is None, r.source or ""))
    targets = share_out([r.size for r in totals], [weights[i % len(weights)] for i in range(len(totals))], share * sum(r.size for r in totals), most)
    plan = spark.createDataFrame([(r.source, r.size, t, t / r.size if r.size else 0.0, max(1, math.ceil(r.n / block))) for r, t in zip(totals, targets, strict=True)], "source string, source_size bigint, target double, rate double, blocks int")
    placed = base.join(plan.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    placed = placed.withColumn("whole", F.floor("rate").cast("int")).withColumn("p", F.col("rate") - F.floor("rate"))
    placed = placed.withColumn("hash", F.xxhash64("doc_id", "size", "tie", "copy", F.lit(SEED))).withColumn("block", F.pmod("hash", F.col("blocks")).cast("int"))
    schema = placed.schema
    most_blocks = max((max(1, math.ceil(r.n / block)) for r in totals), default=1)
    done, now = [], placed
    while True:
        land = most_blocks <= 1
        flown = now.groupBy("source", "block").applyInArrow(_landed if land else _flown, schema)
        if land:
            done.append(flown)
            break
        flown = cut(flown, "mixing-flight")
        # a source that had one block comes back as it is and lands with the others
        done.append(flown.where("p <= 0 or p >= 1"))
        now = flown.where("p > 0 and p < 1").withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("blocks") * 2 / block)).cast("int")).withColumn("block", F.pmod(F.xxhash64("hash"), F.col("blocks")).cast("int"))
        most_blocks = max(1, math.ceil(most_blocks * 2 / block))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = few(out)
    return out.select(*keep, "size", "source_size", "target", (F.col("whole") + F.round("p").cast("int")).alias("copies"), "tie")


def verdicts(docs: DataFrame) -> DataFrame:
    """The contract's digest: doc_id, size, source_size, target, taken; then source."""
    return mix(docs, ["doc_id", "source"]).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs' own columns, each row as often as the mix takes it."""
    taken = cut(mix(docs, ["doc_id", "source"]).groupBy("doc_id", "source", "tie").agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).where("copies > 0"), "mixing-taken")
    own = [F.col(f"`{c}`").alias(f"d_{i}") for i, c in enumerate(docs.columns)]
    keyed = docs.select(*own, F.col("doc_id").cast("bigint").alias("k_id"), F.col("source").cast("string").alias("k_source"), F.xxhash64("text").alias("k_tie"))
    met = keyed.join(taken, F.col("k_id").eqNullSafe(F.col("doc_id")) & F.col("k_source").eqNullSafe(F.col("source")) & (F.col("k_tie") == F.col("tie")))
    if not taken.where("n > 1").isEmpty():
        # rows alike in id, source and text have one key: its copies are dealt out over them
        rank = F.row_number().over(Window.partitionBy("k_id", "k_source", "k_tie").orderBy(*(f"d_{i}" for i in range(len(docs.columns)))))
        met = met.withColumn("copies", F.floor(F.col("copies") / F.col("n")) + (rank <= F.col("copies") % F.col("n")).cast("bigint")).where("copies > 0")
    rows = few(met).withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*(F.col(f"d_{i}").alias(c) for i, c in enumerate(docs.columns)))
