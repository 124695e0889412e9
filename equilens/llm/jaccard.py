"""Exact n-gram Jaccard join with PartEnum signatures.

A document's set holds the hashes of its word n-grams.  Sets are put into size bands; two sets similar enough lie
in one band or in neighbouring ones, and then differ in at most k elements, k following from the band.  The domain
is partitioned by hash into n1 parts of n2 second-level parts each; of each part all subsets of n2 - k2 second-level
parts are enumerated, and the elements in such a subset make a signature.  At most q = floor(k / (k2 + 1)) parts can
differ in more than k2 second-level parts, so where n1 > q, sets that differ in at most k elements share a signature.
For each band (n1, n2, k2) are those that give the fewest signatures with about as many elements as those of large sets
have: large sets need one second-level part, small ones several with subsets enumerated.

A part is whole if none of its signatures is without elements.  A set gives its signatures that have elements under one
partition; where not more than q parts are whole, it adds those under the next partition, and so on.  Of two similar
sets one ends first, under a partition that the other uses too, and of its whole parts one agrees.  (A set without
such a partition among ``TURNS`` gives those without elements too.)  In the same way a set of one partition may leave
out signatures that more than ``HOT`` sets hold, which come from common lines and passages, while more than q parts
are left whole: how many hold a signature is the same for all who hold it.

Copies (equal sets) are one class.  Classes are compared in three steps, and each step leaves out what the one before
has shown to be in one component.  First all classes of a signature with its smallest; then, where a signature still
holds several components, all others in blocks inside tasks.  Pairs are first compared by sketches, the parities of the
elements' numbers in many hash parts: sketches differ in no more places than sets in elements, so what differs too much
is not similar.  Blocks of a signature hold sketches alone and tell which classes pass, and which components these connect.
Then every class that passed goes with its set, once, into blocks of all that is so connected; they decide by the true intersection
of both sets, and give only links that join what they have not joined yet: fewer than a block has classes, however many
of its pairs are alike.  So no link that
matters is lost, and none is made up (but for equal 64-bit hashes of different n-grams within one pair of sets).
Classes are known by 64-bit hashes of their sets; a second hash checks them, and sets that share the first alone are
told apart by both.

Defined results: null text, empty text and text without words have an empty set, linked with nothing; a text with
fewer words than n has its whole sequence as one element; repeated rows and copies are in one component; equal ids
stay separate rows of their classes; a null id is carried along, and a component without any id has a null one; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chat import let
from .common import Tables, small_batches
from .components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys of texts that are broadcast at most (16 bytes each); more of them are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: A signature holds this share, at least, of the elements that one of so large a set holds with one second-level part, where the
#: band allows it; second-level parts that may differ at most.
HELD, LARGE, MOST_K2 = 0.95, 4096, 3
#: The part of a set's elements that is taken to be rare when room for parts that say little is made, and whole parts beyond q
#: that a partition must leave on average.
RARE_PART, ENOUGH = 0.85, 0.6
#: Partitions that a set tries.
TURNS = 32
#: Classes that a signature may have before sets that can do without it leave it out.
HOT = 64
#: Classes and elements of a block, on average, at most; blocks that go to Python at once, with sets and with sketches alone.
BLOCK, HELD_IN_BLOCK, BLOCKS, SKETCHED = 256, 1 << 20, 4, 64
#: Texts whose sets go to Python at once.
BATCH = 1024
#: Sets that a task describes at once, elements whose signatures it makes at once, and classes of one signature among them that go by their smallest.
ROWS, CHUNK, TOGETHER = 512, 1 << 19, 8
#: Classes whose signatures a task remembers, so that it gives those of copies once.
SEEN = 1 << 16


def shingles(text: Column, n: int) -> Column:
    """Distinct hashes of the word n-grams: an array of long, empty without words."""
    words = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")

    def grams(ws: Column) -> Column:
        heads = F.slice(ws, 1, F.greatest(F.size(ws) - (n - 1), F.lit(0)))
        whole = F.when(F.size(ws) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(ws)))
        return F.when(F.size(ws) >= n, F.transform(heads, lambda w, i: F.xxhash64(w, *[ws[i + j] for j in range(1, n)]))).otherwise(whole)

    return F.array_distinct(let(words, grams))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that leaves no pattern."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Parts(NamedTuple):
    n1: int
    n2: int
    k2: int
    #: Parts that may differ in more than k2 second-level parts.
    q: int


class Bands:
    """Size bands for a similarity of at least num / den, and the parts of each."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.ends = [0]
        self.held = 0.0
        large = int(self.band(np.array([LARGE]))[0])
        self.held = HELD * self._least(large) / self.parts(large).n1
        self.parts.cache_clear()

    def _least(self, band: int) -> int:
        return self.ends[max(band - 2, 0)] + 1

    def band(self, sizes: np.ndarray) -> np.ndarray:
        """1 for the smallest sets."""
        while len(sizes) and self.ends[-1] < sizes.max():
            self.ends.append((self.ends[-1] + 1) * self.den // self.num)
        return np.searchsorted(self.ends, sizes)

    @functools.cache  # noqa: B019  one object for each task
    def parts(self, band: int) -> Parts:
        """For pairs of sets in this band and the one below."""
        while band >= len(self.ends):
            self.ends.append((self.ends[-1] + 1) * self.den // self.num)
        k = 2 * self.ends[band] * (self.den - self.num) // (self.den + self.num)
        least = self._least(band)
        if not k:
            return Parts(1, 1, 0, 0)
        found = []
        for k2 in range(min(k, MOST_K2) + 1):
            q = k // (k2 + 1)
            for n2 in range(k2 + 1, k2 + 5) if k2 else (1,):
                for n1 in range(q + 1, 4 * q + 8):
                    filled = 1 - math.exp(-RARE_PART * least / (n1 * n2))
                    whole = n1 * sum(math.comb(n2, j) * filled**j * (1 - filled) ** (n2 - j) for j in range(k2 + 1, n2 + 1))
                    if whole >= q + ENOUGH:
                        found.append((max(0.0, self.held - least * (n2 - k2) / (n1 * n2)), n1 * math.comb(n2, k2), Parts(n1, n2, k2, q)))
                        break
        return min(found)[2] if found else Parts(k + 1, 1, 0, k)

    def _placed(self, band: int, turn: int, elements: np.ndarray, owner: np.ndarray) -> tuple[np.uint64, np.ndarray, np.ndarray]:
        p = self.parts(band)
        seed = mix(np.array([band * TURNS + turn], np.uint64) + np.uint64(0x9E3779B97F4A7C15))[0]
        mixed = mix(elements ^ seed)
        return seed, mixed, owner * (p.n1 * p.n2) + (mixed % np.uint64(p.n1 * p.n2)).astype(np.int64)

    def spare(self, band: int, elements: np.ndarray, owner: np.ndarray, sets: int) -> np.ndarray:
        """The number of whole parts beyond q in the first partition."""
        p = self.parts(band)
        filled = np.zeros(sets * p.n1 * p.n2, bool)
        filled[self._placed(band, 0, elements, owner)[2]] = True
        return ((filled.reshape(sets, p.n1, p.n2).sum(axis=2) > p.k2).sum(axis=1) - p.q).clip(0)

    def signatures(self, band: int, elements: np.ndarray, owner: np.ndarray, sets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(set, signature) of sets in this band or the one below; the lowest bit of a signature is that of the band."""
        p = self.parts(band)
        subsets = np.array(list(combinations(range(p.n2), p.n2 - p.k2)))
        left = np.arange(sets)
        for turn in range(TURNS):
            seed, mixed, place = self._placed(band, turn, elements, owner)
            order = np.argsort(place)
            ordered = place[order]
            starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
            values, filled = np.zeros(len(left) * p.n1 * p.n2, np.uint64), np.zeros(len(left) * p.n1 * p.n2, bool)
            values[ordered[starts]] = np.add.reduceat(mix(mixed[order] ^ seed), starts)
            filled[ordered[starts]] = True
            names = mix(seed + np.arange(1, p.n1 * len(subsets) + 1, dtype=np.uint64)).reshape(p.n1, -1)
            sums = values.reshape(-1, p.n1, p.n2)[:, :, subsets].sum(axis=3, dtype=np.uint64)
            given = (mix(sums ^ names) & ~np.uint64(1)) | np.uint64(band & 1)
            filled = filled.reshape(-1, p.n1, p.n2)
            told, vague = filled[:, :, subsets].any(axis=3), (filled.sum(axis=2) > p.k2).sum(axis=1) <= p.q
            yield left[np.nonzero(told)[0]], given[told].view(np.int64)
            if turn == 0:
                empty = left, ~told, given
            if not vague.any():
                return
            # Sets of which too few parts are whole take a further partition.
            left, new, of = left[vague], np.cumsum(vague) - 1, vague[owner]
            elements, owner = elements[of], new[owner[of]]
        at, rest, given = empty
        rest &= np.isin(at, left)[:, None, None]
        yield at[np.nonzero(rest)[0]], given[rest].view(np.int64)


def by_band(bands: Bands, sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(band, places of the sets, their elements, the owner of each): every set in its own band and the next."""
    sizes = np.array([len(x) for x in sets])
    own = bands.band(sizes)
    for band in sorted({*own.tolist(), *(own + 1).tolist()} - {0}):
        at = np.flatnonzero(((own == band) | (own + 1 == band)) & (sizes > 0))
        if len(at):
            yield band, at, np.concatenate([sets[i] for i in at]), np.repeat(np.arange(len(at)), sizes[at])


def sketch_bits(size: int, num: int, den: int) -> int:
    """A power of two, about four times the elements in which similar sets of that size may differ."""
    return 1 << max(6, (8 * size * (den - num) // (den + num)).bit_length())


def sketch(elements: np.ndarray, num: int, den: int) -> bytes:
    """Parities of the numbers of elements in hash parts; the first half over the second is the sketch of half the length."""
    bits = sketch_bits(len(elements), num, den)
    counts = np.bincount((mix(elements) % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def sets_in(batch: pa.RecordBatch) -> list[np.ndarray]:
    lists = batch.column("elements")
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), ends[:-1])


def class_of(elements: Column) -> tuple[Column, Column]:
    """The class and the hash that checks it."""
    ordered = F.sort_array(elements)
    return F.xxhash64(ordered).alias("class"), F.xxhash64(ordered, F.lit(1)).alias("check")


def told_apart(sets: DataFrame, clashes: list[int]) -> DataFrame:
    """Classes of different sets with one hash are named by both hashes."""
    if not clashes:
        return sets.drop("check")
    return sets.withColumn("class", F.when(F.col("class").isin(clashes), F.xxhash64("class", "check")).otherwise(F.col("class"))).drop("check")


def text_keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("key"), F.xxhash64(text, F.lit(1)).alias("key2")]


def classes(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key, key2, size, class, check, sketch, spare): the keys are those of the text, spare is that of even and odd bands."""
    fields = "key long, key2 long, class long, check long, size long, sketch binary, spare array<long>"

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in batches:
            if not len(batch):
                continue
            sets = sets_in(batch)
            spare = np.zeros((len(sets), 2), np.int64)
            for start in range(0, len(sets), ROWS):
                for band, at, elements, owner in by_band(bands, sets[start : start + ROWS]):
                    spare[start + at, band & 1] = bands.spare(band, elements, owner, len(at))
            columns = [batch.column(c) for c in ("id", "key", "key2", "class", "check")]
            columns += [pa.array([len(x) for x in sets], pa.int64()), pa.array([sketch(x, num, den) for x in sets], pa.binary()), pa.array(spare.tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "key", "key2", "class", "check", "size", "sketch", "spare"])

    text = docs[text_col]
    sets = docs.select(docs[id_col].alias("id"), *text_keys(text), shingles(text, n).alias("elements"))
    kind = docs.schema[id_col].dataType.simpleString()
    return sets.select("id", "key", "key2", *class_of(F.col("elements")), "elements").mapInArrow(described, f"id {kind}, {fields}")


def signatures(docs: DataFrame, n: int, num: int, den: int, clashes: list[int], text_col: str = "text") -> DataFrame:
    """(signature, salt, class) of all sets that are not empty; they go straight into the shuffle and are not kept.

    Where a task finds many classes with one signature, only the smallest goes by the signature alone (salt 0); all
    of them go by signature and that class too. So no group is much larger than the number of tasks or what one holds.
    """

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()

        def of(sets: list[np.ndarray], owners: list[int]) -> pa.RecordBatch:
            given, own, classes = [], [], np.array(owners, np.int64)
            for band, at, elements, owner in by_band(bands, sets):
                for whose, signature in bands.signatures(band, elements, owner, len(at)):
                    given.append(signature)
                    own.append(classes[at[whose]])
            signature, own = np.concatenate(given), np.concatenate(own)
            order = np.lexsort((own, signature))
            signature, own = signature[order], own[order]
            first = np.concatenate(([True], signature[1:] != signature[:-1]))
            starts = np.flatnonzero(first)
            many = np.diff(np.append(starts, len(signature))) >= TOGETHER
            run = np.cumsum(first) - 1
            salted = many[run]
            alone = ~salted | first
            leader = own[starts][run]
            salt = np.concatenate((np.zeros(alone.sum(), np.int64), leader[salted]))
            columns = [np.concatenate((signature[alone], signature[salted])), salt, np.concatenate((own[alone], own[salted]))]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["signature", "salt", "class"])

        sets, owners, held = [], [], 0
        for batch in batches:
            for own, elements in zip(batch.column("class").to_numpy(zero_copy_only=False).tolist(), sets_in(batch) if len(batch) else (), strict=True):
                if own in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(own)
                sets.append(elements)
                owners.append(own)
                held += len(elements)
                if held >= CHUNK:
                    yield of(sets, owners)
                    sets, owners, held = [], [], 0
        if sets:
            yield of(sets, owners)

    sets = docs.select(shingles(docs[text_col], n).alias("elements")).where(F.size("elements") > 0)
    sets = told_apart(sets.select("elements", *class_of(F.col("elements"))), clashes)
    return sets.select("class", "elements").mapInArrow(signed, "signature long, salt long, class long")


def may_be_similar(a: list[bytes], b: list[bytes], n_a: np.ndarray, n_b: np.ndarray, num: int, den: int) -> np.ndarray:
    """For each pair in turn: whether sizes and sketches allow a similarity of num / den."""
    out = np.minimum(n_a, n_b) * den >= np.maximum(n_a, n_b) * num
    lengths = np.array([min(len(x), len(y)) for x, y in zip(a, b, strict=True)])
    for length in np.unique(lengths[out]):
        at = np.flatnonzero(out & (lengths == length))
        x, y = (folded([of[i] for i in at], int(length)) for of in (a, b))
        out[at] = np.bitwise_count(x ^ y).sum(axis=1) <= (n_a[at] + n_b[at]) * (den - num) // (den + num)
    return out


def folded(sketches: list[bytes], length: int) -> np.ndarray:
    """Sketches of ``length`` bytes or any doubling of it, as words of 64 bits."""
    out = np.zeros((len(sketches), length), np.uint8)
    for i, s in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(s, np.uint8).reshape(-1, length), axis=0)
    return out.view(np.uint64)


def alike(pairs: DataFrame, of_class: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) of classes that sizes and sketches do not tell apart."""

    @F.pandas_udf("boolean")
    def may(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        return pd.Series(may_be_similar(list(a), list(b), n_a.to_numpy(), n_b.to_numpy(), num, den))

    side = lambda of: of_class.select(F.col("class").alias(of), F.col("size").alias(f"n_{of}"), F.col("sketch").alias(f"s_{of}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
    return sized.where(may("s_a", "s_b", "n_a", "n_b")).select("a", "b")


def sets_of(wanted: DataFrame, docs: DataFrame, of_class: DataFrame, n: int, clashes: list[int], text_col: str, tables: Tables) -> DataFrame:
    """(class, elements) of the classes in ``wanted``, each made from one text."""
    keys = tables.write(of_class.join(wanted.select("class").distinct(), "class", "left_semi").select("key", "key2"), "keys")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    text = docs[text_col]
    texts = docs.select(text.alias("text"), *text_keys(text)).join(keys, ["key", "key2"], "left_semi").groupBy("key", "key2").agg(F.first("text").alias("text"))
    sets = texts.select(shingles(F.col("text"), n).alias("elements"))
    sets = tables.write(told_apart(sets.select("elements", *class_of(F.col("elements"))), clashes), "sets")
    tables.drop("keys")
    return sets


def verified(pairs: DataFrame, docs: DataFrame, of_class: DataFrame, n: int, num: int, den: int, clashes: list[int], text_col: str, tables: Tables) -> DataFrame:
    """Those of the pairs (a, b) of classes whose similarity is num / den or more, by their sets."""
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("class")), docs, of_class, n, clashes, text_col, tables)
    a = sets.select(F.col("class").alias("a"), F.col("elements").alias("of_a"))
    b = sets.select(F.col("class").alias("b"), F.col("elements").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    n_a, n_b = F.size("of_a"), F.size("of_b")
    found = tables.write(pairs.join(a, "a").join(b, "b").where(den * both.cast("long") >= num * (n_a + n_b - both)).select("a", "b"), "links")
    tables.drop("sets")
    return found


def kept_members(members: DataFrame, of_class: DataFrame) -> DataFrame:
    """(signature, class) without those that a class can do without."""
    hot = members.groupBy("signature").count().where(F.col("count") > HOT).select("signature", F.lit(True).alias("hot"))
    marked = members.join(hot, "signature", "left").withColumn("odd", F.col("signature").bitwiseAND(F.lit(1)))
    counted = marked.where("hot").groupBy("class", "odd").count()
    spare = F.get("spare", F.col("odd").cast("int"))
    without_them = counted.join(of_class.select("class", "spare"), "class").where(F.col("count") < spare).select("class", "odd", F.lit(True).alias("spared"))
    return marked.join(without_them, ["class", "odd"], "left").where("hot is null or spared is null").select("signature", "class")


def near_in_blocks(left: tuple, right: tuple | None, at_a: np.ndarray, of_b: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, places in the other block) that sizes and sketches do not tell apart and that differ in ``at_a`` and ``of_b`` just then;
    within one block each pair once. A side: (sizes, sketches)."""
    (n, sketches), (n_b, sketches_b) = left, right or left
    lengths, lengths_b = (np.array([len(s) for s in x]) for x in (sketches, sketches_b))
    each = {int(x): tuple(folded([s if len(s) >= x else bytes(x) for s in of], int(x)) for of in (sketches, sketches_b)) for x in {*lengths, *lengths_b}}
    for i in range(len(n)):
        at = np.flatnonzero((of_b != at_a[i]) & (np.minimum(n_b, n[i]) * den >= np.maximum(n_b, n[i]) * num))
        if right is None:
            at = at[at > i]
        shorter = np.minimum(lengths_b[at], lengths[i])
        for length in np.unique(shorter).tolist():
            these, (x, y) = at[shorter == length], each[length]
            apart = np.bitwise_count(x[i] ^ y[these]).sum(axis=1)
            these = these[apart <= (n[i] + n_b[these]) * (den - num) // (den + num)]
            if len(these):
                yield i, these


def block_links(left: tuple, right: tuple | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links within one block or between two that join what is not joined yet: (class, component, sketch, elements).

    Every pair of different components is compared, by sketches and then by sets; a link makes one component of two, so
    there are fewer links than classes.
    """
    (own, component, sketches, sets), (own_b, component_b, sketches_b, sets_b) = left, right or left
    names, codes = np.unique(np.concatenate([component, component_b]), return_inverse=True)
    at_a, at_b = codes[: len(component)].copy(), codes[len(component) :].copy() if right else None
    of_b = at_a if right is None else at_b
    n, n_b = (np.array([len(x) for x in of]) for of in (sets, sets_b))
    out = []
    for i, these in near_in_blocks((n, sketches), (n_b, sketches_b) if right else None, at_a, of_b, num, den):
        for j in these.tolist():
            if of_b[j] == at_a[i]:
                continue
            both = len(np.intersect1d(sets[i], sets_b[j], assume_unique=True))
            if den * both >= num * (n[i] + n_b[j] - both):
                out.append((own[i], own_b[j]))
                gone, stays = of_b[j], at_a[i]
                at_a[at_a == gone] = stays
                of_b[of_b == gone] = stays
    return out


def block_candidates(left: tuple, right: tuple | None, num: int, den: int) -> list[tuple[int, int, int]]:
    """(class, component, least) of the classes that are not told apart from all classes of other components by sizes and
    sketches; least is the smallest of the components that such pairs connect. A side: (class, component, size, sketch).
    """
    sides = [left, right] if right else [left]
    names, codes = np.unique(np.concatenate([s[1] for s in sides]), return_inverse=True)
    at = np.split(codes, [len(left[0])])[: len(sides)]
    found, root = [np.zeros(len(s[0]), bool) for s in sides], np.arange(len(names))
    for i, these in near_in_blocks(left[2:], right[2:] if right else None, at[0], at[-1], num, den):
        found[0][i] = found[-1][these] = True
        met = np.unique(root[np.append(at[-1][these], at[0][i])])
        if len(met) > 1:
            root[np.isin(root, met)] = met[0]
    return [(s[0][i], s[1][i], names[root[of[i]]]) for s, of, any_ in zip(sides, at, found, strict=True) for i in np.flatnonzero(any_)]


def in_blocks(members: DataFrame, group: str, fields: tuple[str, ...], compare: Callable[[tuple, tuple | None], list[tuple]], out: tuple[str, ...], tables: Tables) -> DataFrame:
    """Distinct rows (``out``, whole numbers) that ``compare`` makes of each block of a group and of each two blocks of it.
    members: (group, blocks, class, ...); a side has the ``fields``."""
    placed = members.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
    kept = tables.write(placed.groupBy(group, "blocks", "block").agg(F.collect_list(F.struct(*fields)).alias("sets")), "blocks")
    left = kept.select(group, "blocks", "block", *[F.col(f"sets.{c}").alias(f"{c}_a") for c in fields])
    right = kept.where("blocks > 1").select(group, F.col("block").alias("other"), *[F.col(f"sets.{c}").alias(f"{c}_b") for c in fields])
    others = left.where("blocks > 1 and block < blocks - 1").withColumn("other", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)))

    def values(of: pa.Array) -> list | np.ndarray:
        return [x.values.to_numpy() for x in of] if pa.types.is_list(of.type) else of.to_pylist() if pa.types.is_binary(of.type) else of.to_numpy()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                sides = [tuple(values(batch.column(f"{c}_{s}")[i].values) for c in fields) for s in "ab" if f"class_{s}" in batch.schema.names]
                rows = np.array(compare(sides[0], sides[1] if len(sides) > 1 else None), np.int64).reshape(-1, len(out))
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], list(out))

    schema = ", ".join(f"{c} long" for c in out)
    within = left.select([f"{c}_a" for c in fields]).mapInArrow(compared, schema)
    between = others.join(right, [group, "other"]).select([f"{c}_{s}" for s in "ab" for c in fields]).mapInArrow(compared, schema)
    return within.unionByName(between).distinct()


def links_of_rest(rest: DataFrame, of_class: DataFrame, sets: Callable[[DataFrame], DataFrame], num: int, den: int, tables: Tables) -> DataFrame:
    """Links (a, b) that join all components of classes that share a signature and are linked. rest: (signature, class, component);
    sets: gives (class, elements) of classes.

    A class shares many signatures with many others, most of them unlike it. So signatures are compared by sketches alone;
    what passes connects components into groups, and a class that passes goes with its set into the one group of its component.
    """
    spark = rest.sparkSession
    counts = [F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y")]
    mixed = rest.groupBy("signature").agg(*counts).where("least != most")
    # Signatures with the same classes are compared once.
    chosen = tables.write(mixed.groupBy("n", "x", "y").agg(F.min("signature").alias("signature")).select("signature", F.ceil(F.col("n") / BLOCK).alias("blocks")), "mixed")
    sketched = rest.join(chosen, "signature").join(of_class.select("class", "size", "sketch"), "class")
    with small_batches(spark, SKETCHED):
        candidates = in_blocks(sketched, "signature", ("class", "component", "size", "sketch"), lambda a, b: block_candidates(a, b, num, den), ("class", "component", "least"), tables)
        candidates = tables.write(candidates, "candidates")
    groups = components(candidates.select(F.col("component").alias("a"), F.col("least").alias("b")).distinct(), "jaccard-groups")
    asked = labelled(candidates.select("class", "component").distinct(), groups, "component", "group")
    asked = tables.write(asked.join(of_class.select("class", "size", "sketch"), "class"), "asked")
    blocks = asked.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / HELD_IN_BLOCK)).alias("blocks"))
    members = asked.drop("size").join(blocks, "group").join(sets(asked), "class")
    with small_batches(spark, BLOCKS):
        met = tables.write(in_blocks(members, "group", ("class", "component", "sketch", "elements"), lambda a, b: block_links(a, b, num, den), ("a", "b"), tables), "met")
    tables.drop("mixed", "candidates", "asked", "sets", "blocks")
    return met


def labelled(df: DataFrame, labels: DataFrame, of: str = "class", as_: str = "component") -> DataFrame:
    """``df`` with the component of the class in ``of``; a class without links is its own."""
    named = labels.select(F.col("node").alias(of), F.col("component").alias(as_))
    return df.join(named, of, "left").withColumn(as_, F.coalesce(as_, of))


def join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: documents link where den * intersection >= num * union."""
    tables = Tables(docs.sparkSession, "jaccard")
    with small_batches(docs.sparkSession, BATCH):
        rows = tables.write(classes(docs, n, num, den, id_col, text_col), "rows")
    same_hash = rows.groupBy("class").agg(F.min("check").alias("least"), F.max("check").alias("most")).where("least != most")
    clashes = [r["class"] for r in same_hash.select("class").collect()]  # as few as 64-bit hashes make
    rows = told_apart(rows, clashes)

    first = F.first("class").over(Window.partitionBy("signature", "salt").orderBy("class").rowsBetween(Window.unboundedPreceding, 0))
    shared = signatures(docs, n, num, den, clashes, text_col).withColumn("first", first).where("class != first")
    with small_batches(docs.sparkSession, BATCH):
        members = tables.write(shared.select("signature", F.explode(F.array("first", "class")).alias("class")).distinct(), "members")
    described = [F.min(c).alias(c) for c in ("size", "sketch", "spare")] + [F.min(F.struct("key", "key2")).alias("of_text")]
    of_class = rows.join(members.select("class").distinct(), "class", "left_semi").groupBy("class").agg(*described)
    of_class = tables.write(of_class.select("class", "size", "sketch", "spare", "of_text.*"), "classes")
    kept = tables.write(kept_members(members, of_class), "kept")
    tables.drop("members")

    # All classes of a signature meet its smallest.
    leaders = tables.write(kept.groupBy("signature").agg(F.min("class").alias("leader"), F.max("class").alias("last")).where("leader != last").select("signature", "leader"), "leaders")
    others = kept.join(leaders, "signature").where("class != leader")
    pairs = tables.write(others.select(F.col("leader").alias("a"), F.col("class").alias("b")).distinct(), "pairs")
    near = tables.write(alike(pairs, of_class, num, den), "near")
    tables.drop("pairs")
    # One pair of each class joins most; of the others only those between components matter.
    check = lambda found: verified(found, docs, of_class, n, num, den, clashes, text_col, tables)
    labels = components(check(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")), "jaccard-first")
    open_ = labelled(labelled(near, labels, "a", "of_a"), labels, "b", "of_b").where("of_a != of_b").select("a", "b")
    # Then all others of a signature meet each other where it still holds several components.
    rest = tables.write(labelled(others.select("signature", "class"), labels), "rest")
    sets = lambda wanted: sets_of(wanted, docs, of_class, n, clashes, text_col, tables)
    met = links_of_rest(rest, of_class, sets, num, den, tables)
    tables.drop("rest", "kept", "leaders")
    links = labelled(labelled(check(tables.write(open_, "open")).unionByName(met), labels, "a", "of_a"), labels, "b", "of_b")
    merged = components(links.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")), "jaccard-second")

    # The smallest id of each component, by class: rows of a class are summed up before they meet anything.
    of_id = rows.where("size > 0").groupBy("class").agg(F.min("id").alias("least"))
    of_id = tables.write(labelled(labelled(of_id, labels).withColumnRenamed("component", "first"), merged, "first").select("class", "component", "least"), "ids")
    least = of_id.groupBy("component").agg(F.min("least").alias("component_id"))
    of_id = tables.write(of_id.join(least, "component").select("class", "component_id"), "ids")
    tables.drop("classes", "open", "links", "near", "met")
    out = rows.where("size > 0").select("id", "size", "class").join(of_id, "class").select("id", "size", "component_id")
    alone = rows.where("size = 0").select("id", "size", F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id")
