"""Alignment, hard negatives and lattice scores against plain versions, and on awkward tables."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF, table_rows
from equilens.llm import alignment, lattice, negatives, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATHS = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")


def awkward(spark, repeats=1):
    rows = [
        (1, "The quick brown fox jumps over the lazy dog", "en", "a", 5), (1, "The quick brown fox jumps over the lazy dog", "en", "a", 5), (2, "The quick brown fox jumps over the lazy cat", None, None, None),
        (3, None, "en", "a", 0), (None, "no id here at all", "en", "a", 1), (4, "", "en", "a", 0), (5, "ab " * 3000 + "x" * 5000, "en", "a", 9), (6, "  \n\t ", "fr", None, 3), (7, "Żółw 漢字かな 🦊🦊 é　\x1c", "pl", "b", 4),
        (8, "<|endoftext|> and </s><s> <unk>", "xx", "b", 9), (9, "a▁b", "xx", "b", 3), (10, "\x00\r\n  ﬁ", "xx", "b", 3),
    ]
    df = spark.createDataFrame(rows * repeats, DOCS)
    return df.withColumns({c: F.lit("clash") for c in "id row n pairs groups held kind key phrase block anchor score n_links".split()})


# 11


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.tokenizer())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer(PATHS[2]))


def plain_alignment(libraries, docs):
    """Per document: A and B tokens with their byte ranges, groups of ids, links of ends."""
    a, b = libraries
    alphabet = {c: n for c, n in alignment.Model.__init__.__globals__["byte_alphabet"]().items()}
    out = []
    for doc, text in docs:
        pieces = []
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids
            pieces.append([(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in ids])
            ids = b.encode(text)
            pieces.append([(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in ids])
        if not text or any(b"".join(p for _, p in side) != (" " + text).encode() for side in pieces):
            out.append((doc, [], [], [], []))
            continue
        ranges = []
        for side in pieces:
            at, spans = 0, []
            for i, p in side:
                spans.append((i, at, at + len(p)))
                at += len(p)
            ranges.append(spans)
        common = sorted({e for _, _, e in ranges[0]} & {e for _, _, e in ranges[1]})
        groups, low = [], 0
        for high in common:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= high) for side in ranges))
            low = high
        ends = {e: i for i, _, e in ranges[1]}
        out.append((doc, ranges[0], ranges[1], groups, [(i, ends[e]) for i, _, e in ranges[0] if e in ends]))
    return out


def want_alignment(libraries, docs):
    found = plain_alignment(libraries, docs)
    counts = collections.Counter(link for *_, links in found for link in links)
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    rows = []
    for doc, a, b, groups, links in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        rows.append((doc, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(rows, key=repr)


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_registered_alignment(spark, libraries):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op11_alignment(spark, SF).select(*ALIGNED).collect()), key=repr)
    assert got == want_alignment(libraries, docs)


@pytest.mark.parametrize("most", [1 << 21, 0])
def test_alignment_of_awkward_rows_by_broadcast_and_by_shuffle(spark, libraries, most):
    df = awkward(spark)
    found = alignment.align_and_count(df, *map(queries.tokenizer, PATHS), columns=("n_a", "n_b", "n_groups", "n_links", "groups_sha256"), most=most)
    got = sorted((tuple(r) for r in found.select(*ALIGNED).collect()), key=repr)
    assert got == want_alignment(libraries, [(r["doc_id"], r["text"]) for r in df.collect()])
    assert {r[0]: r[1] for r in got}[9] == 0 and {r[0]: r[1] for r in got}[8] > 5
    assert alignment.align_and_count(df.limit(0), *map(queries.tokenizer, PATHS), most=most).count() == 0


def test_products_of_incidence_matrices():
    """Overlap in bytes, shared groups and common ends by Gustavson's products are those of plain loops, in blocks of any size."""
    rng = random.Random(3)
    for _ in range(60):
        width = rng.randrange(1, 40)
        a, b = (np.array(sorted({width, *rng.sample(range(1, width + 1), rng.randrange(width))})) for _ in range(2))
        spans = lambda ends: list(zip([0, *ends[:-1]], ends, strict=True))
        borders = sorted(set(a) & set(b))
        group = lambda e: next(i for i, x in enumerate(borders) if e <= x)
        overlap = {(i, j): min(e, f) - max(s, t) for i, (s, e) in enumerate(spans(a)) for j, (t, f) in enumerate(spans(b)) if min(e, f) > max(s, t)}
        same = {(i, j): 1 for i, e in enumerate(a) for j, f in enumerate(b) if group(e) == group(f)}
        ends = {(i, j): 1 for i, e in enumerate(a) for j, f in enumerate(b) if e == f}
        for kind, want in (("overlap", overlap), ("groups", same), ("ends", ends)):
            assert {(int(i), int(j)): int(n) for i, j, n in zip(*alignment.links(a, b, kind), strict=True)} == want
        parts = list(alignment.multiply(alignment.all_bytes(a), alignment.transpose(alignment.all_bytes(b), width), 3))
        assert {(int(i), int(j)): int(n) for p in parts for i, j, n in zip(*p, strict=True)} == overlap
    assert alignment.possible_pairs([b"ab", b"b", b""], [b"b", b"cab", b"ab"]) == 6


# 12


def plain_negatives(rows, positives=5, negatives_=5):
    """rows: (id, label, vector of floats); the first row of an id by label and vector counts."""
    valid = [(i, str(k), tuple(math.floor(256 * x) for x in v)) for i, k, v in rows if i is not None and k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    by_id = {}
    for row in sorted(valid):
        by_id.setdefault(row[0], row)
    out = []
    for a, label, v in by_id.values():
        if a % 100:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, _, w in by_id.values() if len(w) == len(v)}
        order = sorted((i for i in score if i != a), key=lambda i: (-score[i], i))
        for p in [i for i in order if by_id[i][1] == label][:positives]:
            fit = [i for i in order if by_id[i][1] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:negatives_]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(fit, 1)]
    return sorted(out)


def test_negatives_equal_sql(spark, duck):
    sf = "/root/testdata/sf0.01"
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert table_rows(queries.op12_negatives(spark, sf).toPandas()) == table_rows(c.execute(queries.OP12_SQL).df())


@pytest.mark.parametrize("cells", [1 << 22, 7])
def test_negatives_of_awkward_rows(spark, monkeypatch, cells):
    """Ties, copies, nulls, other lengths, repeated and contradicting rows, negative scores, in small blocks and batches."""
    monkeypatch.setattr(negatives, "CELLS", cells)
    rng = np.random.default_rng(4)
    rows = [(int(i), int(rng.integers(0, 3)), [float(x) for x in rng.integers(-3, 4, 4) / 4]) for i in range(-200, 400)]
    rows += [(1000 + i, i % 2, [0.5, 0.5, 0.5, 0.5]) for i in range(60)] + rows[:5] + [(100, 0, [9.0] * 4), (100, 0, [-9.0] * 4)]
    rows += [(5000, 1, [1.0, 2.0]), (5001, 1, [1.0, 2.0]), (5002, 2, [1.0, 1.9]), (5100, None, [1.0] * 4), (5200, 1, None), (5300, 1, [1.0, None, 1.0, 1.0]), (5400, 1, [float("nan")] * 4), (5500, 1, [float("inf")] * 4), (None, 1, [1.0] * 4), (5600, 1, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit("clash") for c in ("id", "score", "block", "kind", "positives", "anchor", "rank", "vector")})
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        got = sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 100 == 0, block_rows=50).collect())
        assert negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == plain_negatives(rows) and len({r[0] for r in got}) > 3


def test_keys_sort_as_their_parts():
    rng = random.Random(1)
    ends = [negatives.LONG.min, -1, 0, 1, negatives.LONG.max]
    parts = [(rng.choice(ends), rng.choice(ends), rng.randrange(2), rng.choice(ends)) for _ in range(300)]
    assert sorted(parts, key=lambda p: negatives.pack(*p)) == sorted(parts, key=lambda p: (p[0], -p[1], p[2], p[3]))
    assert all(negatives.unpack(negatives.pack(*p)) == p for p in parts)


def test_products_are_exact():
    rng = np.random.default_rng(0)
    for high in (1 << 10, 1 << 29, 1 << 60):
        a, b = rng.integers(-high, high, (3, 5)), rng.integers(-high, high, (4, 5))
        want = [[max(negatives.LONG.min, min(negatives.LONG.max, sum(int(x) * int(y) for x, y in zip(u, v)))) for v in b] for u in a]
        assert negatives.products(a, b).tolist() == want


# 13


def words_of(text):
    return (text or "").encode().lower().split()


def all_spellings(spelling, word):
    """The sum over every way to cut a word into pieces, by recursion."""

    def rest(at):
        if at == len(word):
            return math.exp(spelling.stop)
        return sum(math.exp(spelling.inner[word[at:end]]) * rest(end) for end in range(at + 1, len(word) + 1) if word[at:end] in spelling.inner)

    return math.log(sum(math.exp(w) * rest(len(p)) for p, w in spelling.first.items() if word.startswith(p)))


TINY = lattice.Spelling({b"": math.log(0.3), b"ab": math.log(0.5), b"a": math.log(0.2)}, {b"a": math.log(0.2), b"b": math.log(0.1), b"ba": math.log(0.3)}, math.log(0.4))


def test_forward_recursion_sums_all_spellings():
    words = [bytes(w) for n in range(1, 7) for w in itertools.product(b"ab", repeat=n)]
    got = TINY.of_words(words)
    assert np.allclose(got, [all_spellings(TINY, w) for w in words]) and np.allclose(got, [TINY.of_long(w) for w in words])
    # A proper distribution: words of up to 12 letters, with the empty one, have most of the probability and no more than all.
    empty = math.exp(TINY.first[b""] + TINY.stop)
    total = empty + sum(math.exp(TINY.of_long(bytes(w))) for n in range(1, 13) for w in itertools.product(b"ab", repeat=n))
    assert 0.98 < total <= 1 + 1e-12


def plain_scores(docs, spelling):
    """docs: (id, text, held). Everything by plain loops, with the weights of pieces that the operator has learned."""
    import xxhash

    def phrases(words):
        out, now = [], []
        for w in words:
            now.append(w)
            if xxhash.xxh3_64_intdigest(w) % lattice.CUT == 0:
                out, now = [*out, tuple(now)], []
        return [*out, tuple(now)] if now else out

    words, repeated, ends = collections.Counter(), collections.Counter(), 0
    for _, text, held in docs:
        if not held:
            words.update(words_of(text))
            repeated.update(phrases(words_of(text)))
            ends += 1
    n, v = sum(words.values()) + ends, len(words) + (ends > 0)
    spelled_share = (sum(c == 1 for c in words.values()) + 1) / (n + 2)
    fresh = (sum(c == 1 for c in repeated.values()) + 1) / (sum(repeated.values()) + 2)
    out = []
    for doc, text, held in docs:
        tokens, seen, score, place = words_of(text), collections.Counter(), 0.0, 0
        for phrase in phrases(tokens):
            log = 0.0
            for w in phrase:
                reuse = lattice.REUSE * place / (place + lattice.HALFWAY)
                whole = (1 - reuse) * (1 - spelled_share) * words[w] / max(1, n) + reuse * seen[w] / max(1, place)
                low = math.log((1 - reuse) * spelled_share * (1 - lattice.END)) + spelling.of_long(w)
                log += np.logaddexp(math.log(whole) if whole else -math.inf, low)
                seen[w], place = seen[w] + 1, place + 1
            known = repeated[phrase] * (1 - fresh) / max(1, sum(repeated.values()))
            score += np.logaddexp(math.log(known) if known else -math.inf, log + math.log(fresh))
        reuse = lattice.REUSE * place / (place + lattice.HALFWAY)
        score += math.log((1 - reuse) * ((1 - spelled_share) * ends / max(1, n) + spelled_share * lattice.END))
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens) + math.log10((ends + 1) / (n + v + 1))
        out.append((doc, held, len(tokens) + 1, sum(words[w] > 0 for w in tokens) + (ends > 0), n, base, score / math.log(10)))
    return sorted(out, key=repr)


def same_scores(got, want):
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


@pytest.fixture
def learned(monkeypatch):
    """The spelling that a run learns."""
    kept, train = [], lattice.train_spelling
    monkeypatch.setattr(lattice, "train_spelling", lambda *a: kept.append(train(*a)) or kept[-1])
    return kept


def test_registered_scores(spark, learned):
    docs = [(r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op13_lattice(spark, SF).collect()), key=repr)
    same_scores(got, plain_scores(docs, learned[0]))
    assert all(r[6] < 0 for r in got)


@pytest.mark.parametrize("most", [1 << 18, 0])
def test_scores_of_awkward_rows_by_broadcast_and_by_shuffle(spark, learned, monkeypatch, most):
    monkeypatch.setattr(lattice, "CHARS", 100)
    df = awkward(spark, 2)
    held = F.col("doc_id").isin(2, 7)
    score = lambda d: lattice.score(d, held, queries.tokenizer(PATHS[2]), most=most)
    got = sorted((tuple(r) for r in score(df).collect()), key=repr)
    same_scores(got, plain_scores([(r["doc_id"], r["text"], r["doc_id"] in (2, 7)) for r in df.collect()], learned[0]))
    assert score(df.limit(0)).count() == 0
    nothing = [tuple(r) for r in score(df.where(held)).collect()]  # no training rows
    assert len(nothing) == 4 and all(r[3] == 0 and r[4] == 0 and r[5] == 0 and r[6] < 0 for r in nothing)


def test_groups_of_texts_follow_characters_and_not_batches(spark, monkeypatch):
    batches = [pd.DataFrame({"text": pd.Series(["a" * n for n in sizes], dtype=object)}) for sizes in ((3, 4), (), (2, 30, 1), (1,), (5,))]
    for chars, want in ((8, [[3, 4], [2], [30], [1, 1, 5]]), (1, [[3], [4], [2], [30], [1], [1], [5]]), (1000, [[3, 4, 2, 30, 1, 1, 5]])):
        assert [g["text"].str.len().tolist() for g in lattice.in_groups(iter(batches), chars)] == want
    asked, small = [], lattice.small_batches
    monkeypatch.setattr(lattice, "small_batches", lambda s, rows: asked.append(rows) or small(s, rows))
    lattice.score(spark.createDataFrame([(1, "a b")], "doc_id int, text string"), F.lit(False), queries.tokenizer(PATHS[2]))
    assert asked == [lattice.TEXTS] * 2 and lattice.LOOKED_UP < lattice.CHARS


def test_held_out_texts_teach_nothing(spark):
    df = spark.createDataFrame([(1, "a b c d", False), (2, "a x", False), (3, "a b zzz", True)], "doc_id int, text string, held boolean")
    other = df.withColumn("text", F.when(F.col("held"), "something else altogether").otherwise(F.col("text")))
    one, two = ({r["doc_id"]: tuple(r) for r in lattice.score(d, F.col("held"), queries.tokenizer(PATHS[2])).collect()} for d in (df, other))
    assert one[1] == two[1] and one[2] == two[2] and one[3] != two[3]


def test_a_word_of_any_length(spark):
    df = spark.createDataFrame([(1, "ab" * 100_000), (2, "ab cd")], "doc_id int, text string")
    got = {r["doc_id"]: r["score"] for r in lattice.score(df, F.lit(False), queries.tokenizer(PATHS[2])).collect()}
    assert all(math.isfinite(s) and s < 0 for s in got.values())
