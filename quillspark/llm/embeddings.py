"""Near-duplicate embeddings by product quantisation under coarse inverted lists.

Vectors of one label and one length are linked if their cosine is `COSINE` or more. Unit vectors with that cosine lie within
r = sqrt(2 - 2 * cosine) of each other, which makes every step of the search exact:

* coarse lists: each vector belongs to its nearest centroid. q has a neighbour in list c only if the plane midway between c and
  q's own centroid o is at most r away, |q - c|^2 - |q - o|^2 <= 2 r |c - o|, and |q - c| <= r + radius(c); q probes every such
  list, however many.
* residual codes: a vector is its list's centroid plus one codeword for each of `PARTS` subspaces of the residual, `WORDS`
  codewords each. Distances from q to coded vectors come from tables of q's distances to all codewords. The code is off by a
  known distance e(x), kept with it, so x can be a neighbour only if the table distance is at most r + e(x).
* what is left is checked by the exact cosine in double precision.

Centroids and codewords are fitted on a sample of at most `SAMPLE` vectors, chosen by a hash; all vectors are indexed and all
are queries. Equal vectors of a label share one entry with their number. A list's entries and its queries are cut into blocks
of about `BLOCK`, so a list of any size is many tasks; a block sends back, for each query, how many vectors it is linked with
and edges enough to join what its links join, never the pairs.

Each length of vectors has an index of its own, fitted on its own sample, one after the other.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing, nor do rows with a null label; a row with a null vec_id links like any other, and its component_id is the
smallest id of its component, null (and kept true) if there is none, else kept is false; equal vec_ids are one vector with several rows; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, components, cut, few

COSINE = 0.98
#: Lists at most; below that one for so many entries: fewer lists mean fewer probes of each query.
LISTS, LIST_ENTRIES = 1024, 4096
PARTS, WORDS = 16, 32
SAMPLE = 8192
BLOCK = 2048
_SLACK = 1e-5
#: Rows that may link.
SOUND = "label is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)"


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means from a sample of x."""
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((centre**2).sum(1) - 2 * x @ centre.T, axis=1)
        for j in range(len(centre)):
            mine = near == j
            centre[j] = x[mine].mean(0) if mine.any() else x[rng.integers(len(x))]
    return centre


class Index:
    """Coarse centroids and residual codewords."""

    def __init__(self, sample: np.ndarray, lists: int = LISTS, parts: int = PARTS, words: int = WORDS, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        parts = next(p for p in range(min(parts, self.dim), 0, -1) if self.dim % p == 0)
        self.centre = _means(sample, min(lists, max(1, len(sample) // 4)), rng)
        rest = (sample - self.centre[self.nearest(sample)[0]]).reshape(len(sample), parts, -1)
        books = [_means(rest[:, p], words, rng) for p in range(parts)]
        self.book = np.stack(books)

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (self.centre**2).sum(1)[None] - 2 * x @ self.centre.T, 0))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(x)
        own = np.argmin(d, axis=1)
        return own, d[np.arange(len(x)), own]

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and how far off each code is."""
        rest = (x - self.centre[own]).reshape(len(x), len(self.book), -1)
        code = np.empty(rest.shape[:2], np.uint8)
        gap = np.zeros(len(x))
        for p, book in enumerate(self.book):
            d = (rest[:, p] ** 2).sum(1)[:, None] + (book**2).sum(1)[None] - 2 * rest[:, p] @ book.T
            code[:, p] = np.argmin(d, axis=1)
            gap += ((rest[:, p] - book[code[:, p]]) ** 2).sum(1)
        return code, np.sqrt(gap)

    def tables(self, q: np.ndarray, cell: int) -> np.ndarray:
        """Squared distances of the queries' residuals in list `cell` to all codewords: queries x parts x words."""
        rest = (q - self.centre[cell]).reshape(len(q), len(self.book), -1)
        cross = np.einsum("qpd,pwd->qpw", rest, self.book)
        return (rest**2).sum(2)[:, :, None] + (self.book**2).sum(2)[None] - 2 * cross


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors**2).sum(1))[:, None]


def links_in_block(index: Index, cell: int, q: np.ndarray, x: np.ndarray, code: np.ndarray, gap: np.ndarray, raw_q: np.ndarray, raw_x: np.ndarray, cosine: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(query numbers, entry numbers) of confirmed links, some queries at a time."""
    r = np.sqrt(2 - 2 * cosine) + _SLACK
    out = []
    norm_q, norm_x = np.sqrt((raw_q**2).sum(1)), np.sqrt((raw_x**2).sum(1))
    for low in range(0, len(q), 256):
        table = index.tables(q[low : low + 256], cell)
        total = np.zeros((len(table), len(x)))
        for p in range(code.shape[1]):
            total += table[:, p, :][:, code[:, p]]
        a, b = np.nonzero(np.sqrt(np.maximum(total, 0)) <= r + gap[None, :])
        for part in range(0, len(a), 1 << 16):
            i, j = a[part : part + (1 << 16)] + low, b[part : part + (1 << 16)]
            exact = (raw_q[i] * raw_x[j]).sum(1) / (norm_q[i] * norm_x[j]) >= cosine
            out.append((i[exact], j[exact]))
    return out


def spanning(i: np.ndarray, j: np.ndarray, n: int, m: int) -> list[tuple[int, int]]:
    """Of the links between n left and m right nodes, edges (left, right) that join the same: a forest, by passing on labels."""
    label_i, label_j = np.arange(n), np.full(m, n + m)
    np.minimum.at(label_j, j, label_i[i])
    while True:
        new_i = label_i.copy()
        np.minimum.at(new_i, i, label_j[j])
        new_j = label_j.copy()
        np.minimum.at(new_j, j, new_i[i])
        if (new_i == label_i).all() and (new_j == label_j).all():
            break
        label_i, label_j = new_i, new_j
    # each label is the number of one left node; tie every other node of its group to the group's first right node
    first: dict[int, int] = {}
    for y in np.unique(j).tolist():
        first.setdefault(int(label_j[y]), y)
    edges = [(x, first[int(label_i[x])]) for x in np.unique(i).tolist()]
    return edges + [(int(label_j[y]), y) for y in np.unique(j).tolist()]


def _matrix(column, dim: int | None = None) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, dim or 1)


def _found(spark: SparkSession, entries: DataFrame, size: int, cosine: float, lists: int, sample: int, block: int) -> DataFrame:
    """(a, b, links) of the entries, `size` vectors of one length: links of entry a where b is null, else an edge."""
    chosen = entries.where(F.pmod(F.xxhash64("label", "v"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / size))).select("v").toArrow().column("v")
    if not len(chosen):
        chosen = entries.orderBy("name").limit(1).select("v").toArrow().column("v")
    shared = spark.sparkContext.broadcast(Index(unit(_matrix(chosen)), min(lists, max(8, size // LIST_ENTRIES))))  # lists x dimensions and codewords: fixed

    def place(batches):
        index = shared.value
        for batch in batches:
            x = unit(_matrix(batch.column(batch.schema.get_field_index("v"))))
            own, far = index.nearest(x) if len(x) else (np.empty(0, np.int64), np.empty(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    placed = cut(entries.mapInArrow(place, "label string, v array<double>, least bigint, n bigint, name bigint, cell int, far double"), "vectors-placed")
    radius = {r.cell: r.radius for r in placed.groupBy("cell").agg(F.max("far").alias("radius")).collect()}
    cells = placed.groupBy("label", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    reach = float(np.sqrt(2 - 2 * cosine)) + _SLACK

    def probe(batches):
        index = shared.value
        radii = np.array([radius.get(c, -np.inf) for c in range(len(index.centre))])
        for batch in batches:
            x = unit(_matrix(batch.column(1)))
            d = index.distances(x)
            own = np.argmin(d, axis=1) if len(d) else np.empty(0, np.int64)
            apart = index.distances(index.centre)[own]
            a, b = np.nonzero((d**2 - d[np.arange(len(d)), own][:, None] ** 2 <= 2 * reach * apart + _SLACK) & (d <= reach + radii[None]))
            take = batch.take(pa.array(a))
            yield pa.RecordBatch.from_arrays([*take.columns, pa.array(b.astype(np.int32))], names=["label", "v", "name", "cell"])

    probes = placed.select("label", "v", "name").mapInArrow(probe, "label string, v array<double>, name bigint, cell int")
    # entries stand once in their own block; queries go to every block of a list, and are dealt over as many parts
    held = placed.join(cells, ["label", "cell"]).select("label", "cell", F.pmod(F.xxhash64("name"), F.col("blocks").cast("bigint")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.lit(True).alias("entry"), "name", "least", "n", "v")
    asked = probes.join(cells, ["label", "cell"]).select("label", "cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - F.lit(1).cast("bigint"))).alias("block"), F.pmod(F.xxhash64("name", F.lit(1)), F.col("blocks")).cast("int").alias("part"), F.lit(False).alias("entry"), "name", F.lit(None).cast("bigint").alias("least"), F.lit(1).cast("bigint").alias("n"), "v")

    def compare(t: pa.Table) -> pa.Table:
        index = shared.value
        kind = t.column("entry").to_numpy(zero_copy_only=False).astype(bool)
        names, number, v = t.column("name").to_numpy(), t.column("n").to_numpy(), _matrix(t.column("v"), index.dim)
        q, x, cell = v[~kind], v[kind], t.column("cell")[0].as_py() if len(t) else 0
        out_name, out_links, out_a, out_b = [], [], [], []
        if len(q) and len(x):
            ux = unit(x)
            code, gap = index.encode(ux, np.full(len(x), cell))
            links = np.zeros(len(q), np.int64)
            parts = []
            for i, j in links_in_block(index, cell, unit(q), ux, code, gap, q, x, cosine):
                other = names[~kind][i] != names[kind][j]
                i, j = i[other], j[other]
                links += np.bincount(i, weights=number[kind][j], minlength=len(q)).astype(np.int64)
                parts += spanning(i, j, len(q), len(x))
            linked = np.flatnonzero(links)
            out_name, out_links = names[~kind][linked], links[linked]
            if parts:
                i, j = np.array(parts).T
                edges = spanning(i, j, len(q), len(x))
                out_a, out_b = names[~kind][[e[0] for e in edges]], names[kind][[e[1] for e in edges]]
        a = pa.array(np.concatenate((out_name, out_a)).astype(np.int64))
        b = pa.array([*[None] * len(out_name), *map(int, out_b)], pa.int64())
        return pa.table({"a": a, "b": b, "links": pa.array(np.concatenate((out_links, np.zeros(len(out_a)))).astype(np.int64))})

    return cut(held.unionByName(asked).groupBy("label", "cell", "block", "part").applyInArrow(compare, "a bigint, b bigint, links bigint"), "vectors-found")


def near_vectors(table: DataFrame, cosine: float = COSINE, lists: int = LISTS, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """One row for each row: vec_id, n_links (other vectors linked), component_id (smallest vec_id reachable), kept."""
    spark = table.sparkSession
    bound_batches(spark)
    rows = cut(table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label")), "vectors-rows")
    sound = rows.where(SOUND)
    # entries: distinct vectors of a label; the name of an entry is its smallest vec_id, or a hash where all are null
    entry = sound.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    entry = entry.withColumn("name", F.monotonically_increasing_id())
    entries = cut(entry, "vectors-entries")
    lengths = entries.groupBy(F.size("v").alias("n")).count().orderBy("n").collect()
    none = rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not lengths:
        return none
    found = reduce(DataFrame.unionByName, [_found(spark, entries.where(F.size("v") == r.n), r["count"], cosine, lists, sample, block) for r in lengths])
    links = found.where("b is null").groupBy(F.col("a").alias("name")).agg(F.sum("links").alias("links"))
    # components: of entries by name, then each by its smallest vec_id; rows of one vec_id tie their entries together
    keyed = sound.join(entries.select("label", "v", "name", "n"), ["label", "v"]).select("vec_id", "name", "n")
    mine = cut(keyed, "vectors-keyed")
    ties = found.where("b is not null").select("a", "b")
    same = mine.where("vec_id is not null").groupBy("vec_id").agg(F.min("name").alias("low"), F.max("name").alias("high")).where("low < high")
    doubled = mine.join(same, "vec_id").where("name > low").select(F.col("name").alias("a"), F.col("low").alias("b"))
    roots = components(ties.union(doubled), "vectors-links")
    full = entries.select("name", "least").join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    smallest = full.groupBy("root").agg(F.min("least").alias("component"))
    named = full.join(smallest, "root").select("name", "component").join(links, "name", "left")
    each = mine.join(named, "name").groupBy("vec_id").agg(F.min("component").alias("component"), F.max(F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    known = each.where("vec_id is not null")
    out = few(rows.where("vec_id is not null").select("vec_id").join(known, "vec_id", "left"))
    lone = mine.where("vec_id is null").join(named, "name").select("vec_id", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    idle = rows.where("vec_id is null").where(~F.coalesce(F.expr(SOUND), F.lit(False))).select("vec_id", F.lit(None).cast("bigint").alias("component"), F.lit(0).cast("bigint").alias("n_links"))
    out = out.unionByName(lone).unionByName(idle)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), F.coalesce("component", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"))
