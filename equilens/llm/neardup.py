"""Near-duplicate vectors by product quantisation.

Vectors of unit length lie in coarse inverted lists; what remains after the list's centre is coded in subspaces.
A query looks at its own list and at all later ones whose boundary with its list's cell lies within the distance that
a partner moves in that direction (``MARGIN`` standard deviations of an isotropic step at the least cosine); the other
lists look at it.  It adds up table entries of its residual against the codes, and keeps what may be near: the code's
own error bounds how far the sum can be off, so no partner in a list looked at is lost.  What is kept is ranked again
by the exact cosine in double precision.  With ``margin=None`` the whole distance is taken, which loses no link at all
but looks at nearly all lists where vectors have many dimensions and no clusters.

Each of the most frequent dimensions has an index of its own, with centres and codebooks fitted on a bounded sample
(SAMPLE rows with the smallest hashes); every vector is indexed.  Vectors of other dimensions, and of those with few
vectors, are compared in blocks without an index.  Vectors that are equal are indexed once, with their number.  Lists
and their queries are cut into blocks of bounded size; a block hands out counts and links that join something new,
never all its pairs.

Defined results: vectors that are null, of length zero, or hold null or non-finite components link with nothing and
are their own component; vectors of different dimensions never link; repeated rows link with each other; equal
ids of different vectors share their component; a null id is kept if its component has no other; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables
from .components import components

#: Rows on which centres and codebooks are fitted.
SAMPLE = 20_000
#: Rows of an inverted list, on average, until MOST_LISTS are reached; dimensions that get an index.
LIST_ROWS, MOST_LISTS, MOST_DIMENSIONS = 1024, 2048, 4
SUBSPACES, CODES = 8, 64
MARGIN = 3.0
#: A list is known by its dimension and, in so many lower bits, its number.
LIST_BITS = 20
#: Rows of a block of a list, and of a block of queries, on average.
BLOCK = 1024
#: Queries that are looked up at once.
LOOKUP = 256
SEED = 7


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Index:
    """Coarse centres and residual codebooks."""

    def __init__(self, sample: np.ndarray, lists: int, least: float):
        rng = np.random.default_rng(SEED)
        self.centres = kmeans(sample, lists, rng)
        self.radius = math.sqrt(max(0.0, 2 - 2 * least))
        self.dimension = sample.shape[1]
        self.cuts = np.linspace(0, self.dimension, min(SUBSPACES, self.dimension) + 1).astype(int)
        residual = sample - self.centres[self.nearest(sample)]
        self.books = [kmeans(residual[:, a:b], CODES, rng) for a, b in zip(self.cuts, self.cuts[1:])]
        apart = ((self.centres[:, None, :] - self.centres[None, :, :]) ** 2).sum(-1) if len(self.centres) <= 512 else self._apart()
        self.apart = np.sqrt(apart)

    def _apart(self) -> np.ndarray:
        square = (self.centres**2).sum(1)
        return np.maximum(square[:, None] + square - 2 * self.centres @ self.centres.T, 0)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.argmin((self.centres**2).sum(1) - 2 * x @ self.centres.T, axis=1)

    def code(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (uint8) of the residuals, and the length of what the codes leave."""
        residual = x - self.centres[lists]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        error = np.zeros(len(x))
        for s, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            part, book = residual[:, a:b], self.books[s]
            codes[:, s] = np.argmin((book**2).sum(1) - 2 * part @ book.T, axis=1)
            error += ((part - book[codes[:, s]]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def probes(self, x: np.ndarray, own: np.ndarray, margin: float | None) -> list[np.ndarray]:
        """Lists to look at, the own one and later ones: the step towards a cell's boundary is normal to it, with radius / sqrt(dimension) per standard deviation."""
        square = (self.centres**2).sum(1) - 2 * x @ self.centres.T
        reach = self.radius if margin is None else min(self.radius, margin * self.radius / math.sqrt(self.dimension))
        away = (square - square[np.arange(len(x)), own][:, None]) / (2 * np.maximum(self.apart[own], 1e-12))
        return [i + np.flatnonzero(row[i:] <= reach) for i, row in zip(own, away, strict=True)]


def block_pairs(index: Index | None, at: int, least: float, queries: np.ndarray, entries: np.ndarray, codes: np.ndarray, errors: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(query, entries with a cosine of at least ``least``) by table lookups, then exactly."""
    for start in range(0, len(queries), LOOKUP):
        part = queries[start : start + LOOKUP]
        if index is None:
            near = np.ones((len(part), len(entries)), bool)
        else:
            residual = part - index.centres[at]
            total = np.zeros((len(part), len(codes)))
            for s, (a, b) in enumerate(zip(index.cuts, index.cuts[1:])):
                own, book = residual[:, a:b], index.books[s]
                table = (own**2).sum(1)[:, None] + (book**2).sum(1) - 2 * own @ book.T
                total += table[:, codes[:, s]]
            near = total <= (index.radius + errors) ** 2 + 1e-9
        asked, met = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if not len(asked):
            continue
        linked = near[np.ix_(asked, met)] & (part[asked] @ entries[met].T >= least)
        for i, row in zip(asked, linked, strict=True):
            if row.any():
                yield start + int(i), met[row]


def units(vectors: pd.Series, norms: pd.Series) -> np.ndarray:
    """Unit vectors of one dimension, in double precision."""
    return np.stack([np.asarray(v, float) for v in vectors]) / norms.to_numpy()[:, None]


def fitted(entries: DataFrame, least: float) -> dict[int, Index]:
    """An index for each of the most frequent dimensions that fill more than one list."""
    counts = entries.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(MOST_DIMENSIONS).collect()
    out = {}
    for d, n in counts:
        if n >= 2 * LIST_ROWS:
            sample = entries.where(F.size("v") == d).orderBy(F.xxhash64("key")).limit(SAMPLE).select("v", "norm").toPandas()
            out[d] = Index(units(sample["v"], sample["norm"]), min(MOST_LISTS, n // LIST_ROWS), least)
    return out


def near_duplicates(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", margin: float | None = MARGIN) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    spark, tables = vectors.sparkSession, Tables(vectors.sparkSession, "vectors")
    held = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    given = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast(f"array<{held}>").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    sound = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    given = given.withColumn("norm", F.when(sound, norm))
    given = given.withColumn("v", F.when((F.col("norm") > 0) & (F.col("norm") < float("inf")), F.col("v")))
    hashed = [F.when(F.col("v").isNotNull(), F.xxhash64("v", *more)) for more in ((), (F.lit(1),))]
    rows = tables.write(given.select("id", "v", "norm", hashed[0].alias("key"), hashed[1].alias("check")), "rows")
    # A vector is known by the hash of its components; a second hash tells those apart that share the first.
    same_hash = rows.where("v is not null").groupBy("key").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low != high")
    clashes = [r["key"] for r in same_hash.select("key").collect()]  # as few as 64-bit hashes make
    if clashes:
        rows = rows.withColumn("key", F.when(F.col("key").isin(clashes), F.xxhash64("key", "check")).otherwise(F.col("key")))
    entries = rows.where("v is not null").groupBy("key").agg(F.first("v").alias("v"), F.first("norm").alias("norm"), F.count("*").alias("copies"), F.min("id").alias("id"))
    entries = tables.write(entries, "entries")
    shared = spark.sparkContext.broadcast(fitted(entries, least))

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, part in batch.groupby(batch["v"].map(len)):
                index = shared.value.get(d)
                if index is None:
                    none = [b""] * len(part)
                    yield part.assign(list=d << LIST_BITS, codes=none, error=0.0, probes=[[d << LIST_BITS]] * len(part))
                    continue
                x = units(part["v"], part["norm"])
                at = index.nearest(x)
                codes, errors = index.code(x, at)
                yield part.assign(list=(d << LIST_BITS) + at, codes=[c.tobytes() for c in codes], error=errors, probes=[(d << LIST_BITS) + p for p in index.probes(x, at, margin)])

    fields = f"key long, v array<{held}>, norm double, copies long"
    indexed = entries.select("key", "v", "norm", "copies").mapInPandas(coded, f"{fields}, list long, codes binary, error double, probes array<long>")
    indexed = tables.write(indexed, "index")
    sizes = F.broadcast(indexed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")))  # a row for each list
    probing = indexed.select("key", "v", "norm", "copies", F.col("list").alias("own"), F.explode("probes").alias("list"))
    asked = F.broadcast(indexed.select(F.explode("probes").alias("list")).groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("asked")))
    block = lambda n: F.pmod(F.xxhash64("key"), F.col(n))
    of_entry = F.collect_list(F.struct("key", "v", "norm", "copies", "codes", "error")).alias("entries")
    of_query = F.collect_list(F.struct("key", "v", "norm", "copies", "own")).alias("queries")
    entry_blocks = indexed.join(sizes, "list").groupBy("list", block("blocks").alias("entry_block")).agg(of_entry)
    query_blocks = probing.join(asked, "list").groupBy("list", block("asked").alias("query_block")).agg(of_query)
    # Blocks of both sides are dealt out by list and both block numbers, so that a long list is many tasks.
    pairs = sizes.join(asked, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("entry_block"), "asked")
    pairs = pairs.select("list", "entry_block", F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("query_block"))
    both = pairs.join(entry_blocks, ["list", "entry_block"]).join(query_blocks, ["list", "query_block"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                index = shared.value.get(row.list >> LIST_BITS)
                q_key, e_key, copies, q_copies, own = (np.asarray(x) for x in (row.q_key, row.e_key, row.copies, row.q_copies, row.own))
                codes = np.array([np.frombuffer(c, np.uint8) for c in row.codes])
                queries, vectors = units(row.q_v, pd.Series(row.q_norm)), units(row.e_v, pd.Series(row.e_norm))
                links, root, joined = {}, {}, {}

                def top(x: int) -> int:
                    while root.setdefault(x, x) != x:
                        root[x] = x = root[root[x]]
                    return x

                for i, near in block_pairs(index, row.list & ((1 << LIST_BITS) - 1), least, queries, vectors, codes, np.asarray(row.error)):
                    q = int(q_key[i])
                    links[q] = links.get(q, 0) + int(copies[near].sum())
                    for j in near:
                        e = int(e_key[j])
                        if own[i] != row.list:  # this list doesn't look back
                            links[e] = links.get(e, 0) + int(q_copies[i])
                        if (a := top(q)) != (b := top(e)):
                            root[a] = b
                            joined.setdefault(q, []).append(e)
                yield pd.DataFrame([(k, n, joined.get(k, [])) for k, n in links.items()], columns=["key", "links", "joined"])

    of = lambda side, c, name: F.col(f"{side}.{c}").alias(name)
    fields = [of("queries", c, n) for c, n in (("key", "q_key"), ("v", "q_v"), ("norm", "q_norm"), ("copies", "q_copies"), ("own", "own"))]
    fields += [of("entries", c, n) for c, n in (("key", "e_key"), ("v", "e_v"), ("norm", "e_norm"), ("copies", "copies"), ("codes", "codes"), ("error", "error"))]
    found = tables.write(both.select("list", *fields).mapInPandas(compare, "key long, links long, joined array<long>"), "links")
    tables.drop("index")
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))  # with itself and its copies
    labels = components(found.select(F.col("key").alias("a"), F.explode("joined").alias("b")), "vector-components")
    known = entries.select("key", "id").join(counts, "key").join(labels.withColumnRenamed("node", "key"), "key", "left")
    known = known.select("key", "id", F.coalesce("component", "key").alias("component"), (F.col("links") - 1).alias("links"))
    least_id = known.groupBy("component").agg(F.min("id").alias("least"))
    known = tables.write(known.join(least_id, "component").select("key", "links", "least"), "known")
    tables.drop("entries", "links")
    # Equal vectors may be very many; both sides of this join are plain, so that Spark can split them.
    out = rows.select("id", "key").join(known, "key", "left")
    component = F.when(F.col("links").isNotNull(), F.col("least")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
