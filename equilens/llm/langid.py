"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 drawn from a seed and its code point.  An n-gram's vector binds its
letters' vectors, each rotated by its place; a text's vector bundles (sums) those of all its n-grams; a language's
prototype bundles its training texts.  A text gets the language whose prototype has the largest cosine with it.

Counts of all training rows go into the prototypes: each task bundles what it reads, Spark sums by language and
component.  Only the prototypes (languages x dimensions numbers) come to the driver.

Whether a text is in one of the languages at all is judged by its cosine and its number of different n-grams: few
n-grams cannot come near a prototype, so the least cosine grows with that number up to ``FULL`` of them.
It is derived from all labelled texts: half of what all but 1 % of the correctly recognised ones reach.

Defined results: a text that is null or has no letter gets ``und`` and 0; so do all texts when nothing could be
learned; equal cosines go to the language first by name; repeated rows count each time; other columns pass
through, existing columns with the outputs' names are replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without

DIMENSIONS = 1024
N = 3
SEED = 20240611
#: n-gram vectors that a worker remembers; beyond it the memory starts anew.
MEMO = 32_768
#: Characters whose n-grams are counted together.
TOGETHER = 1 << 19
UNDETERMINED = "und"
#: Different n-grams from which a text must reach the full least score.
FULL = 64
#: The least score is this share of this quantile, and at most so many standard deviations of an unrelated text's cosine (tables
#: of a few texts are learned by heart).
SHARE, QUANTILE, MOST_DEVIATIONS = 0.5, 0.01, 8
#: Languages a model may have; more are taken for a wrong label column and refused.
MAX_LANGUAGES = 1000


@functools.cache
def letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_keys(text: str) -> np.ndarray:
    """Keys of all letter n-grams; a run of other characters counts as one word boundary, and so do both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.concatenate(([0], np.where(letters()[points], points, 0), [0]))
    kept = points != 0
    kept[1:] |= kept[:-1].copy()
    kept[0] = True
    points = points[kept]
    if len(points) < N:
        return np.empty(0, np.int64)
    return points[:-2] << 42 | points[1:-1] << 21 | points[2:]


class Space:
    """Vectors of letters and n-grams."""

    def __init__(self, dimensions: int, seed: int):
        self.dimensions, self.seed = dimensions, seed
        self.letter = functools.lru_cache(4096)(self._letter)
        self.rows: dict[int, int] = {}
        self.matrix = np.empty((MEMO, dimensions), np.int8)

    def _letter(self, point: int) -> np.ndarray:
        return np.random.default_rng([self.seed, point]).integers(0, 2, self.dimensions, dtype=np.int8) * np.int8(2) - np.int8(1)

    def ngram(self, key: int) -> np.ndarray:
        a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the n-grams' vectors, each as often as it occurs."""
        total = np.zeros(self.dimensions)
        for i in range(0, len(keys), 4096):
            part = keys[i : i + 4096].tolist()
            new = [k for k in part if k not in self.rows]
            if len(self.rows) + len(new) > MEMO:
                self.rows.clear()
                new = part
            for k in new:
                self.matrix[len(self.rows)] = self.ngram(k)
                self.rows[k] = len(self.rows)
            total += counts[i : i + 4096].astype(np.float32) @ self.matrix[[self.rows[k] for k in part]].astype(np.float32)
        return total


@dataclass(frozen=True)
class Prototypes:
    """Languages by name and one unit vector for each."""

    languages: tuple[str, ...]
    vectors: np.ndarray
    seed: int = SEED


_spaces: dict[tuple[int, int], Space] = {}


def on_worker(dimensions: int, seed: int) -> Space:
    """One space for each Python worker."""
    if (dimensions, seed) not in _spaces:
        _spaces[dimensions, seed] = Space(dimensions, seed)
    return _spaces[dimensions, seed]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED) -> Prototypes:
    """Prototypes of the languages in ``lang_col``; rows with a null text or language are left out."""

    def bundled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, sums = on_worker(dimensions, seed), {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                # Texts are counted together, but not so many that their keys fill the memory.
                for _, some in texts.groupby(texts.str.len().cumsum() // TOGETHER):
                    keys = np.concatenate([ngram_keys(t) for t in some])
                    if len(keys):
                        sums[lang] = sums.get(lang, 0) + space.bundle(*np.unique(keys, return_counts=True))
        if sums:
            yield pd.DataFrame({"lang": list(sums), "vector": [v.tolist() for v in sums.values()]})

    rows = docs.select(docs[lang_col].alias("lang"), docs[text_col].alias("text")).dropna()
    sums = rows.mapInPandas(bundled, "lang string, vector array<double>").select("lang", F.posexplode("vector").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found = sums.limit(MAX_LANGUAGES * dimensions + 1).toPandas()
    if len(found) > MAX_LANGUAGES * dimensions:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; is {lang_col} a language column?")
    languages = tuple(sorted(found["lang"].unique()))
    if not languages:
        return Prototypes((), np.empty((0, dimensions)), seed)
    vectors = found.pivot(index="lang", columns="i", values="x").loc[list(languages)].to_numpy()
    return Prototypes(languages, vectors / np.linalg.norm(vectors, axis=1, keepdims=True).clip(1e-12), seed)


def predict(docs: DataFrame, prototypes: Prototypes, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "lang_score", grams_out: str | None = None) -> DataFrame:
    """``docs`` with the predicted language of the whole text and its cosine, cut to 0..1; in ``grams_out`` the number of its different n-grams."""
    shared = docs.sparkSession.sparkContext.broadcast(prototypes)

    @F.pandas_udf("language string, score double, grams long")
    def classify(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        space = on_worker(known.vectors.shape[1], known.seed)
        for batch in texts:
            out = []
            for text in batch:
                keys = ngram_keys(text) if text is not None else ()
                found = (UNDETERMINED, 0.0, 0)
                if len(keys) and known.languages:
                    different, counts = np.unique(keys, return_counts=True)
                    vector = space.bundle(different, counts)
                    if norm := np.linalg.norm(vector):
                        cosines = known.vectors @ vector / norm
                        best = int(np.argmax(cosines))
                        found = known.languages[best], float(min(1.0, max(0.0, cosines[best]))), len(different)
                out.append(found)
            yield pd.DataFrame(out, columns=["language", "score", "grams"])

    added = {lang_out: F.col("_language.language"), score_out: F.col("_language.score")} | ({grams_out: F.col("_language.grams")} if grams_out else {})
    out = without(docs, *added, "_language").withColumn("_language", classify(docs[text_col]))
    return out.withColumns(added).drop("_language")


def allowance(grams: Column) -> Column:
    """The part of the least score that a text of so many different n-grams must reach."""
    return F.least(grams / FULL, F.lit(1.0))


def least_score(docs: DataFrame, prototypes: Prototypes, text_col: str = "text", lang_col: str = "lang") -> float:
    """The least score of texts in one of the languages, from all labelled texts; 0 where none is recognised."""
    labelled = docs.select(docs[lang_col].alias("lang"), docs[text_col].alias("text")).dropna()
    right = predict(labelled, prototypes, grams_out="grams").where("lang_pred = lang and grams > 0")
    found = right.agg(F.percentile_approx(F.col("lang_score") / allowance(F.col("grams")), QUANTILE)).first()[0]
    return min(SHARE * (found or 0.0), MOST_DEVIATIONS / prototypes.vectors.shape[1] ** 0.5)


def in_language(docs: DataFrame, prototypes: Prototypes, least: float, text_col: str = "text") -> DataFrame:
    """Those of ``docs`` that are in one of the languages, with lang_pred, lang_score and lang_grams."""
    found = predict(docs, prototypes, text_col, grams_out="lang_grams")
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("lang_score") > least * allowance(F.col("lang_grams"))))


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 4, is 2. A null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.where(F.crc32(docs[id_col].cast("string").cast("binary")) % 4 != 2)
