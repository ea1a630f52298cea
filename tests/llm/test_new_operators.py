"""Packing, whitening and alignment against plain versions, over nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import alignment, packing, whitening

ODD = [
    "don't stop_it A-B's 'S foo'Reading <|endoftext|>x<|startoftext|> a<|b", "x\x0by\x0cz\rq\x1cw\x00e\x7f  nb　sp é é ́lead Σας ΣΑΣ İ ﬁ ½ ٣ 漢字 👍🏽 ''s 're'll x1y22z",
    "a\x85b", " ̈́ ̈́", "I'M 'M'D 'LLx 'Ve", "Éàü×÷ß ÀÖØÞ", "a  b   c\n d\n  e\t f   g  h \x1c i\x00j  ", " lead", "  lead2", "\n nl", " ", "   ", "a" * 5000, "ab" * 3000 + " ",
    "▁ under", "x▁y", "<s> </s> <unk>", "\r\n \r\n z", "👍🏽" * 700,
]


@pytest.fixture(scope="module")
def odd(spark, docs):
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string")
    return docs.unionByName(more, allowMissingColumns=True).repartition(3)


# Packing.


def test_ids_are_those_of_the_tokenizer(rows):
    from tokenizers import Tokenizer

    texts = [r[1] for r in rows] + ODD
    whole = Tokenizer.from_file(packing.TOKENIZER)
    got = packing.encoder(packing.TOKENIZER).ids([None if t is None else t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_forgotten_words_are_learned_again(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 3)
    encode = packing.Encoder(packing.TOKENIZER)
    texts = [b"one two three four", b"two five", b"one two three four"]
    first, _, again = list(encode.ids(texts[:1])) + list(encode.ids(texts[1:2])) + list(encode.ids(texts[2:]))
    assert first == again


def test_ids_of_any_mix_of_characters():
    """Letters, digits, marks, apostrophes, blanks, combining marks, special tokens, sigmas and broken UTF-8 beside each other."""
    from tokenizers import Tokenizer

    rng = random.Random(11)
    parts = ["a", "B", "H", "s", "'", "'s", "'T", "'re", "7", ".", ",", "-", "<", "|", "=", " ", "\n", "\x1c", "\x00", "̱", "̌", "̸", "̊", "é", "É", "×", "Σ", "ß", "İ", "漢", "٣", "\x85", "\xa0", "<|endoftext|>", "<|ENDOFTEXT|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))).encode() for _ in range(20000)]
    texts += [bytes(rng.choices(b"aB's.7 <|\n\xc3\xa9\xcc\xb1\xe2\x82\xff", k=rng.randint(0, 10))) for _ in range(20000)] + [None, b"x"]
    whole = Tokenizer.from_file(packing.TOKENIZER)
    want = [e.ids for e in whole.encode_batch_fast([(t or b"").decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.Encoder(packing.TOKENIZER).ids(texts)] == want
    assert list(packing.Encoder(packing.TOKENIZER).ids([])) == []


def test_long_texts_are_laid_out_in_parts(monkeypatch):
    texts = [b"one Two, three" * 50, None, b"four 'five's 6"] * 3
    want = list(packing.Encoder(packing.TOKENIZER).ids(texts))
    for name, size in (("WORDS", 2), ("AT_ONCE", 20), ("AT_ONCE", 0)):
        monkeypatch.setattr(packing, name, size)
        assert list(packing.Encoder(packing.TOKENIZER).ids(texts)) == want


def test_words_that_differ_by_case_and_punctuation_are_learned_once():
    """What is paid for a word is paid for few: 40 forms of each of 500 words, and numbers by their digits."""
    words = ["w" + "".join(c) for c in product("abcde", "fghij", "klmno", "pqrs")]
    forms = [f"{a}{w}{b}" for w in words for w in (w, w.capitalize()) for a in ("", "(", "-", "7") for b in ("", ",", ".", "!", ").")]
    encode = packing.Encoder(packing.TOKENIZER)
    assert sum(map(len, encode.ids([" ".join(forms).encode(), " ".join(map(str, range(10000))).encode()])))
    assert len(encode.words) < len(words) + 30


def ids_of(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.TOKENIZER)
    return [whole.encode(t or "", add_special_tokens=False).ids + [packing.END] for t in texts]


@pytest.mark.parametrize("capacity", [2048, 64, 7])
def test_packing_keeps_every_token_once(odd, capacity):
    held = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    want = Counter((d, tuple(x)) for (d, _), x in zip(held, ids_of([t for _, t in held]), strict=True))
    got = packing.pieces(odd, capacity=capacity).collect()
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id, r.doc_tokens].append((r.start, ids))
    for parts in sequences.values():  # gapless from 0
        assert [o for o, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1].tolist()]
    sizes = Counter(sum(n for _, n in parts) for parts in sequences.values())
    short = [n for n in sizes if n != capacity]
    assert max(sizes) <= capacity and sum(n * sizes[n] for n in short) < capacity
    assert all(n & (n - 1) == 0 and sizes[n] == 1 for n in short)  # nothing is padded
    # tokens by document; repeated rows have the same pieces several times
    tokens = lambda pairs: Counter((d, i, t) for (d, n), parts in pairs for s, ids in parts for i, t in enumerate(ids, s))
    assert tokens(documents.items()) == tokens(((d, len(x)), [(0, list(x))] * n) for (d, x), n in want.items())


def test_packing_digest_and_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    want = {r.doc_id: ids for r, ids in zip(rows, ids_of([r.text for r in rows]), strict=True)}
    got = packing.query(docs).collect()
    assert [f.name for f in packing.query(docs).schema] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert all(r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) for r in got)
    made = packing.sequences(packing.pieces(docs)).collect()
    assert all(len(r.ids) == 4 * r.length and r.padded == r.length for r in made)
    assert sum(r.length for r in made) == sum(map(len, want.values()))


def test_the_closest_multiset_is_found():
    """Against trying all of them."""
    from itertools import product

    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 15): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        room = rng.randint(0, 40)
        best = max(s for take in product(*(range(n + 1) for n in counts.values())) if (s := sum(x * k for x, k in zip(counts, take, strict=True))) <= room)
        got = packing.closest(counts, room)
        assert sum(x * k for x, k in got.items()) == best and all(k <= counts[x] for x, k in got.items())


@pytest.mark.parametrize("histogram", [{}, {1: 5}, {1000: 10**6}, {1999: 3, 7: 1}, {2047: 10**9, 2: 10**9}, {n: n % 7 + 1 for n in range(1, 2048)}, {1024: 3, 512: 1}])
def test_plans_place_every_remainder(histogram):
    total = sum(x * n for x, n in histogram.items())
    rows = packing.plan(histogram)
    assert len(rows) < 20 * 2048 and sum(r[2] * r[4] for r in rows) == total
    placed = defaultdict(list)
    for rest, rank, many, skip, length, *_ in rows:
        placed[rest].append((rank, many, skip, length))
    for rest, parts in placed.items():  # each remainder's tokens come once
        assert sum(n * x for _, n, _, x in parts) == rest * histogram[rest]
        assert max(rank + n for rank, n, _, _ in parts) == histogram[rest]
        assert max(skip + x for _, _, skip, x in parts) == rest


def test_whole_remainders_are_preferred_to_cuts():
    """Where remainders fill windows exactly, none is cut."""
    rows = packing.plan({1500: 100, 548: 100, 2000: 50, 48: 50})
    assert all(skip == 0 and rest == length for rest, _, _, skip, length, *_ in rows)


# Whitening.


def exact(vectors):
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]
    n, x = len(x), np.array(x, object)
    y = n * x - x.sum(0)
    return n, y, y.T.dot(y)


def test_whitening_against_plain_numbers_of_any_size(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    awkward = [(900001, None), (900002, [None] + [0.1] * 63), (900003, [float("nan")] * 64), (900004, [float("inf")] + [0.0] * 63), (900005, []), (900006, [1.0] * 3), (None, [0.5] * 64), (900007, [1e4] * 64), (900007, [1e4] * 64)]
    more = spark.createDataFrame(awkward, "vec_id bigint, embedding array<float>").withColumn("v", F.lit("clash")).withColumn("n", F.lit("clash"))
    rows = rows.unionByName(more, allowMissingColumns=True)
    kept = [r for r in rows.collect() if r.embedding and len(r.embedding) == 64 and all(c is not None and np.isfinite(c) for c in r.embedding)]
    n, y, gram = exact([r.embedding for r in kept])
    values, axes = np.linalg.eigh(np.array([[float(g) / n**3 for g in row] for row in gram]))
    values, axes = values[::-1], axes[:, ::-1]
    want = (y.astype(float) / n) @ axes[:, :8] / np.sqrt(values[:8])
    got = whitening.query(rows).collect()
    assert len(got) == 8 * len(kept)
    by_row = defaultdict(list)
    for r in got:
        by_row[r.vec_id].append(r)
        assert r.n == n and r.identity_error < 1e-6
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9
    signs = {k: np.sign(sum(r.whitened * want[i][k - 1] for i, o in enumerate(kept) if i < 50 for r in by_row[o.vec_id] if r.component == k)) for k in range(1, 9)}
    for i, o in enumerate(kept):
        for r in by_row[o.vec_id]:
            assert r.deviation == (y[i] ** 2).sum() and abs(r.whitened * signs[r.component] - want[i][r.component - 1]) < 1e-5


def test_exact_products_of_large_numbers():
    rng = np.random.default_rng(3)
    z = rng.integers(-(2**61), 2**61, (5000, 3))
    assert (whitening.gram(z) == z.astype(object).T.dot(z.astype(object))).all()
    values = [0, -1, 2**200, -(2**200) + 7, 2**32 - 1]
    assert [whitening.undigits(d.tolist()) for d in whitening.digits(values)] == values


def test_small_eigenvalues_beside_a_huge_one():
    """Against the same by fractions: turned vectors have the covariance that their eigenvalues say."""
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (500, 6)).astype(object)
    x[0] = [10**13] * 6
    y = len(x) * x - x.sum(0)
    values, axes = whitening.eigen(y.T.dot(y), len(x) ** 3)
    turn = np.array([[Fraction(float(v)) for v in row] for row in axes], object)
    got = turn.dot(y.T.dot(y)).dot(turn.T)
    for i in range(6):
        for j in range(6):
            share = float(got[i, j] / len(x) ** 3) / np.sqrt(values[i] * values[j])
            assert abs(share - (i == j)) < 1e-4


def test_whitening_without_variance(spark):
    kind = "vec_id bigint, embedding array<double>"
    assert not whitening.query(spark.createDataFrame([], kind)).count()
    assert not whitening.query(spark.createDataFrame([(1, [1.0, 2.0])] * 3, kind)).count()
    flat = whitening.query(spark.createDataFrame([(i, [float(i), 2.0, float(-i)]) for i in range(10)], kind)).collect()
    assert len(flat) == 10 and {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-9
    huge = whitening.query(spark.createDataFrame([(i, [1e300 * (-1) ** i, float(i)]) for i in range(10)], kind)).collect()
    assert len(huge) >= 10 and all(r.deviation is None for r in huge)


# Alignment.


def aligned(texts):
    """Whole texts by both tokenizers, groups by the ends that both have, pairs in dictionaries."""
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(alignment.BYTES)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    of_two = lambda k: bytes([int(two.id_to_piece(k)[3:-1], 16)]) if two.is_byte(k) else two.id_to_piece(k).replace("▁", " ").encode()
    held, documents = [], Counter()
    for text in texts:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        raw = [[bytes(byte[c] for c in one.id_to_token(k)) for k in a], [of_two(k) for k in b]]
        if not text or any(b"".join(x) != (" " + text).encode() for x in raw):
            held.append(None)
            continue
        ends = [np.cumsum([len(x) for x in r]).tolist() for r in raw]
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            ni, nj = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            groups.append((a[i:ni], b[j:nj]))
            i, j = ni, nj
        pairs = Counter((x, y) for p, q in groups for x in p for y in q)
        documents.update(pairs.keys())
        held.append((len(a), len(b), groups, pairs))
    most = defaultdict(int)
    for (x, _), n in documents.items():
        most[x] = max(most[x], n)
    for h in held:
        if h is None:
            yield (0, 0, 0, 0, 0, 0, "")
            continue
        n_a, n_b, groups, pairs = h
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        best = sum(n for p, n in pairs.items() if documents[p] == most[p[0]])
        yield (n_a, n_b, len(groups), sum(pairs.values()), best, sum(n * documents[p] for p, n in pairs.items()), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize(("chunk", "large"), [(alignment.CHUNK, alignment.LARGE), (40, 1)])
def test_alignment(odd, monkeypatch, chunk, large):
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    monkeypatch.setattr(alignment, "LARGE", large)
    monkeypatch.setattr(alignment, "OUT", 1000 if chunk < 1000 else alignment.OUT)
    held = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    want = Counter((d, *x) for (d, _), x in zip(held, aligned([t for _, t in held]), strict=True))
    got = Counter(map(tuple, alignment.query(odd).collect()))
    assert got == want


def test_segments_are_split_where_neither_vocabulary_crosses():
    held = alignment.aligner(alignment.BYTES, alignment.PIECES)
    assert held.separable and not alignment._crossing(b" a") and alignment._crossing(b"a ") and not alignment._crossing(b"  ")
    assert held.segments("a  b c\n d ") == ["a", " b", "c\n d", ""]
    assert held.segments("  a b") == ["  a", "b"]


def test_without_a_safe_split_texts_are_aligned_whole(monkeypatch):
    held = alignment.Aligner(alignment.BYTES, alignment.PIECES)
    held.separable = False
    assert held.segments("a b") == ["a b"]
    monkeypatch.setattr(held, "second", [b"?"] * len(held.second))
    assert held.align(["a b"]) == [b""]


# Tables without rows.


@pytest.mark.parametrize("run", [packing.query, alignment.query])
def test_no_rows_give_no_rows(empty, run):
    assert run(empty).count() == 0
