"""Removal of passages that an earlier document holds, with repeated-phrase automata.

1. Anchors. Every window of 13 words has eight runs of six words; the run with the least hash is its anchor. Two equal
   windows have equal anchors, so a window can only recur if its anchor does. Documents are read into chunks, which send each of
   their anchors once to a shard by hash and hear which of them stand in two or more documents.
2. Confirmation. Each different window with such an anchor goes, once a chunk, to a shard by a 128-bit hash; those that two or more
   documents hold are recurring phrases, and the least doc_id is their first holder. Where they stand isn't sent.
3. Automata. A chunk compiles the phrases that recur in it into Aho-Corasick automata, a word being one letter, PATTERNS phrases
   in each, and streams all of its documents through them; every occurrence of a phrase first held by a smaller doc_id
   covers its words.

Nothing is broadcast or collected. A phrase held by any number of documents is one entry a chunk, so no shard follows from how often
one phrase stands, and every phase ends in a written table. Documents whose whole text has an earlier exact copy skip the second
phase: all their windows recur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BINARY, LONG, STEPS, batch_of, chunks, distinct_words, few_rows, hashed_words, lean_batches, rolled, shard_limits
from .common import Scratch, small_batches

WINDOW, ANCHOR = 13, 6
PATTERNS = 30_000
#: Bytes of a chunk (but a text is never cut), words of a shard, and how many shards there are at least.
CHUNK_BYTES, SHARD_WORDS, SHARDS = 4 << 20, 1 << 22, 64
#: A word becomes LETTERS letters of BASE, each place with letters of its own, so that matches begin where words do. An automaton
#: looks through a node's letters one by one, so there must not be many. FOREIGN stands for words that no phrase of an automaton has.
LETTERS, BASE, FIRST, FOREIGN = 3, 64, 0x100, 1
_U = np.uint64
_NONE = np.iinfo(np.int64).max


def anchors(hashes: np.ndarray) -> np.ndarray:
    """For each window, the least hash of the runs in it."""
    least, width = rolled(hashes, ANCHOR, STEPS[0]), WINDOW - ANCHOR + 1
    while width > 1:
        least, width = np.minimum(least[: -(width // 2)], least[width // 2 :]), width - width // 2
    return least


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (rid, doc_id, text) as chunks: cid, their ids (the largest number for none), whether they have one, texts, and words."""
    ids, texts, first, size = [], [], None, 0

    def whole() -> pa.RecordBatch:
        n = sum(len(t.split()) for t in texts)
        lists = [pa.array([[_NONE if d is None else d for d in ids]], pa.list_(LONG)), pa.array([[d is not None for d in ids]], pa.list_(pa.bool_())), pa.array([texts], pa.list_(BINARY))]
        return pa.RecordBatch.from_arrays([pa.array([first], LONG), *lists, pa.array([n], LONG)], names=["cid", "ids", "named", "texts", "n"])

    for b in batches:
        for rid, doc_id, text in zip(b.column("rid").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            first = rid if first is None else first
            ids.append(doc_id)
            texts.append(text.encode("utf-8", "surrogatepass") if text else b"")
            size += len(texts[-1])
            if size >= CHUNK_BYTES:
                yield whole()
                ids, texts, first, size = [], [], None, 0
    if texts:
        yield whole()


class Chunk:
    """Windows of the documents that can give or take: the place among all words of the chunk, the document, and the anchor."""

    def __init__(self, ids: list[int], named: list[bool], texts: list[bytes]):
        self.ids, self.texts = np.asarray(ids, np.int64), texts
        parts = [hashed_words(group) for _, group in chunks(texts)]
        none = np.zeros(0, _U)
        self.hashes = np.concatenate([none, *(h for h, _ in parts)])
        self.counts = np.concatenate([none.astype(np.int64), *(c for _, c in parts)])
        windows = np.where(np.asarray(named, bool), np.maximum(self.counts - WINDOW + 1, 0), 0)
        self.doc = np.repeat(np.arange(len(texts)), windows)
        begin = np.cumsum(self.counts) - self.counts
        self.place = begin[self.doc] + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        self.anchor = anchors(self.hashes)[self.place] if len(self.place) else none
        self.whole = np.flatnonzero(windows)  # texts that may be copies as a whole
        digests = [xxhash.xxh128_intdigest(texts[i]) for i in self.whole.tolist()]
        self.digest = np.asarray([[d >> 64, d & (1 << 64) - 1] for d in digests], _U).reshape(-1, 2)

    def distinct_anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Different anchors, sorted, and whether two or more documents of the chunk have them."""
        new = np.ones(len(self.anchor), bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.doc[1:] != self.doc[:-1])
        h, doc = self.anchor[new], self.doc[new]
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        first = _starts(h)
        return h[first], _spread(doc, first)

    def distinct_texts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different digests of whole texts, sorted, the least id that has each; and for each text of whole which it is."""
        order = np.lexsort((self.ids[self.whole], self.digest[:, 1], self.digest[:, 0]))
        d = self.digest[order]
        first = _starts(d[:, 0], d[:, 1])
        which = np.empty(len(order), np.int64)
        which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        return d[first], self.ids[self.whole][order][first], which

    def candidates(self, recurring: np.ndarray, copy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different windows whose anchor recurs, of texts that aren't copies, sorted by their two hashes: these, the least id that has
        each, whether another id has it too, and a place where it stands."""
        at = np.flatnonzero(recurring & ~copy[self.doc])
        w, v = (rolled(self.hashes, WINDOW, s)[self.place[at]] for s in STEPS) if len(at) else (self.anchor[:0], self.anchor[:0])
        order = np.lexsort((v, w))
        w, v, at = w[order], v[order], at[order]
        first, ids = _starts(w, v), self.ids[self.doc[at]]
        least = np.minimum.reduceat(ids, first) if len(at) else ids
        return np.stack([w[first], v[first]], 1), least, _spread(ids, first), self.place[at[first]]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new key begins in sorted ones."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _spread(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether the groups that begin at first have two or more different values."""
    return np.minimum.reduceat(values, first) != np.maximum.reduceat(values, first) if len(values) else values.astype(bool)


def _whole(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


_ASK = [("shard", LONG), ("cid", LONG), ("kind", LONG), ("n", LONG), ("keys", BINARY), ("many", BINARY), ("least", BINARY)]
_ASK_DDL = "shard bigint, cid bigint, kind bigint, n bigint, keys binary, many binary, least binary"
_ANSWER = [("cid", LONG), ("shard", LONG), ("kind", LONG), ("n", LONG), ("many", BINARY), ("least", BINARY)]
_ANSWER_DDL = "cid bigint, shard bigint, kind bigint, n bigint, many binary, least binary"
ANCHORS, TEXTS, WINDOWS = range(3)


def _ask(cid: int, kind: int, keys: np.ndarray, many: np.ndarray, least: np.ndarray | None, shards: int) -> list[tuple]:
    """Rows that ask each shard about its part of sorted keys (a column for each half)."""
    limits = shard_limits(keys if keys.ndim == 1 else keys[:, 0], shards).tolist()
    own = lambda s, e: None if least is None else least[s:e].astype("<i8").tobytes()
    return [(k, cid, kind, e - s, keys[s:e].astype("<u8").tobytes(), np.packbits(many[s:e]).tobytes(), own(s, e)) for k, (s, e) in enumerate(zip(limits[:-1], limits[1:], strict=True)) if s < e]


def _answers(key: tuple, group: pa.Table) -> pa.Table:
    """Tells every chunk which of its keys two or more documents have, in one chunk or several, and who is the first."""
    asked, out = sorted(group.to_pylist(), key=lambda r: r["cid"]), []
    kind, halves = key[1].as_py(), 1 if key[1].as_py() == ANCHORS else 2
    size = np.asarray([r["n"] for r in asked])
    keys = np.frombuffer(b"".join([r["keys"] for r in asked]), "<u8").reshape(-1, halves)
    many = np.concatenate([_whole(r["many"], r["n"]) for r in asked])
    # of an anchor it's enough that two chunks have it; else the ids tell
    least = np.repeat(np.arange(len(asked)), size) if halves == 1 else np.frombuffer(b"".join([r["least"] for r in asked]), "<i8")
    order = np.argsort(keys[:, 0], kind="stable") if halves == 1 else np.lexsort((keys[:, 1], keys[:, 0]))
    first = _starts(*(keys[order, i] for i in range(halves)))
    some = np.logical_or.reduceat(many[order], first) | _spread(least[order], first)
    lowest = np.minimum.reduceat(least[order], first)
    run = np.diff(np.append(first, len(order)))
    every, holder = np.empty(len(order), bool), np.empty(len(order), np.int64)
    every[order], holder[order] = np.repeat(some, run), np.repeat(lowest, run)
    ends = np.cumsum(size).tolist()
    for r, s, e in zip(asked, [0, *ends], ends):
        out.append((r["cid"], r["shard"], kind, e - s, np.packbits(every[s:e]).tobytes(), None if halves == 1 else holder[s:e][every[s:e] | (kind == TEXTS)].astype("<i8").tobytes()))
    return pa.Table.from_batches([batch_of(_ANSWER, out)])


def _heard(answers: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """What all shards say of a chunk's keys of one kind, in the order in which it asked."""
    rows = sorted((r for r in answers.to_pylist() if r["kind"] == kind), key=lambda r: r["shard"])
    many = np.concatenate([np.zeros(0, bool), *(_whole(r["many"], r["n"]) for r in rows)])
    return many, np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["least"] or b"", "<i8") for r in rows)])


def _first(chunk: Chunk, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """For each window whether its anchor recurs, and for each document whether it is a copy of an earlier one."""
    recurs, _ = _heard(answers, ANCHORS)
    h, _ = chunk.distinct_anchors()
    recurring = recurs[np.searchsorted(h, chunk.anchor)]
    copy = np.zeros(len(chunk.texts), bool)
    if len(chunk.whole):
        _, least = _heard(answers, TEXTS)
        copy[chunk.whole] = least[chunk.distinct_texts()[2]] < chunk.ids[chunk.whole]
    return recurring, copy


def coded(words: np.ndarray) -> np.ndarray:
    """Words, as numbers below BASE ** LETTERS, as rows of letters."""
    return np.stack([words // BASE**k % BASE + (FIRST + k * BASE) for k in range(LETTERS)], -1).astype("<u4")


def text_of(letters: np.ndarray) -> str:
    return letters.tobytes().decode("utf-32-le")


def occurrences(words: np.ndarray, phrases: np.ndarray, holders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where phrases (rows of WINDOW words as numbers) stand in a row of words: last places, and the phrases' holders.

    Up to PATTERNS phrases are compiled at a time, fewer if they have too many different words for the letters, and all words are
    streamed through each automaton; of several foreign words in a row one.
    """
    ends, held, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while at < len(phrases):
        size = min(PATTERNS, BASE**LETTERS // WINDOW)
        used, code = np.unique(phrases[at : at + size], return_inverse=True)
        automaton = ahocorasick.Automaton()
        written, width = text_of(coded(code.reshape(-1, WINDOW))), WINDOW * LETTERS
        for i, holder in enumerate(holders[at : at + size].tolist()):
            automaton.add_word(written[i * width : (i + 1) * width], holder)
        automaton.make_automaton()
        number = np.full(max(int(words.max(initial=0)), int(used.max())) + 1, -1)
        number[used] = np.arange(len(used))
        streamed = number[words]
        foreign = streamed < 0
        place = np.flatnonzero(~foreign | np.concatenate(([True], ~foreign[:-1])))
        letters = coded(streamed[place])
        letters[foreign[place]] = FOREIGN
        found = np.asarray(list(automaton.iter(text_of(letters))), np.int64).reshape(-1, 2)
        ends.append(place[found[:, 0] // LETTERS])
        held.append(found[:, 1])
        at += size
    return np.concatenate(ends), np.concatenate(held)


def covered(chunk: Chunk, answers: pa.Table) -> np.ndarray:
    """For each word of a chunk whether it goes."""
    recurring, copy = _first(chunk, answers)
    recurs, held = _heard(answers, WINDOWS)
    marks = np.zeros(len(chunk.hashes) + 1, np.int64)
    _, least, many, place = chunk.candidates(recurring, copy)
    # a phrase that only its first holder has in this chunk covers nothing here
    use = recurs.copy()
    use[recurs] = many[recurs] | (least[recurs] > held)
    place, held = place[use], held[use[recurs]]
    if len(place):
        names, word = distinct_words(chunk.hashes)
        phrases = word[place[:, None] + np.arange(WINDOW)]
        # a word that no phrase has stands between texts
        limits = np.cumsum(chunk.counts)
        ends, holder = occurrences(np.insert(word, limits, len(names)), phrases, held)
        owner = np.repeat(np.arange(len(limits)), chunk.counts + 1)[ends]
        gone = (holder < chunk.ids[owner]) & ~copy[owner] & (chunk.ids[owner] != _NONE)
        last = ends[gone] - owner[gone]
        np.add.at(marks, last - (WINDOW - 1), 1)
        np.add.at(marks, last + 1, -1)
    mask = np.cumsum(marks)[:-1] > 0
    return mask | np.repeat(copy, chunk.counts)


def _stripped(docs: DataFrame, schema: str, row: Callable[[bytes, np.ndarray], tuple]) -> DataFrame:
    """doc_id, n_words and what row makes of a text and which of its words go, for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "substrings")
    own = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = scratch.keep(own.mapInArrow(lean_batches(_chunk), "cid bigint, ids array<bigint>, named array<boolean>, texts array<binary>, n bigint"))
    n_words = held.agg(F.sum("n")).first()[0] or 0
    shards = max(SHARDS, -(-n_words // SHARD_WORDS))
    with few_rows(spark):
        names = ["cid", "ids", "named", "texts"]

        def first_ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for cid, ids, named, texts in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                    chunk = Chunk(ids, named, texts)
                    h, many = chunk.distinct_anchors()
                    digests, least, _ = chunk.distinct_texts()
                    yield batch_of(_ASK, _ask(cid, ANCHORS, h, many, None, shards) + _ask(cid, TEXTS, digests, np.zeros(len(digests), bool), least, shards))

        def second_ask(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            chunk = Chunk(*(left.column(c)[0].as_py() for c in names[1:]))
            keys, least, many, _ = chunk.candidates(*_first(chunk, right))
            return pa.Table.from_batches([batch_of(_ASK, _ask(key[0].as_py(), WINDOWS, keys, many, least, shards))])

        def strip(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            chunk = Chunk(*(left.column(c)[0].as_py() for c in names[1:]))
            mask = covered(chunk, right)
            ends = np.cumsum(chunk.counts).tolist()
            found = [row(t, mask[s:e]) for t, s, e in zip(chunk.texts, [0, *ends], ends)]
            columns = [pa.array([None if d == _NONE else d for d in chunk.ids.tolist()], LONG), pa.array(chunk.counts)]
            columns += [pa.array([f[i] for f in found], t) for i, t in enumerate(types)]
            return pa.Table.from_arrays(columns, names=["doc_id", "n_words", *more])

        kinds = {"bigint": LONG, "string": pa.string(), "spans": pa.list_(pa.struct([("start", LONG), ("end", LONG)]))}
        more, types = zip(*((f.split()[0], kinds["spans" if "array" in f else f.split()[1]]) for f in schema.split("; ")), strict=True)
        told = scratch.keep(held.select(*names).mapInArrow(lean_batches(first_ask), _ASK_DDL).groupBy("shard", "kind").applyInArrow(_answers, _ANSWER_DDL))
        by_chunk = lambda frame: frame.groupBy("cid")
        asked = by_chunk(held.select(*names)).cogroup(by_chunk(told)).applyInArrow(second_ask, _ASK_DDL)
        more_told = scratch.keep(asked.groupBy("shard", "kind").applyInArrow(_answers, _ANSWER_DDL))
        ddl = f"doc_id bigint, n_words bigint, {schema.replace('; ', ', ')}"
        return by_chunk(held.select(*names)).cogroup(by_chunk(told.unionByName(more_told))).applyInArrow(strip, ddl)


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, spans (start and end of each removed run of words, end exclusive) and kept (the words left, joined
    by single blanks) for each row of docs. What query() says of nulls and the like holds here too."""

    def row(text: bytes, mask: np.ndarray) -> tuple:
        edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
        kept = b" ".join(w for w, m in zip(text.split(), mask.tolist(), strict=True) if not m)
        return [{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()], kept.decode("utf-8", "replace")

    return _stripped(docs, "spans array<struct<start: bigint, end: bigint>>; kept string", row)


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for each row of docs.

    doc_id is a whole number, or can be cast to one. A document without doc_id neither takes nor gives: nothing of it is removed.
    Null, empty and short texts have no windows. Rows that share a doc_id are one document as to order (neither is smaller) and are
    each judged on their own text; repeated rows give repeated rows. No rows give no rows. Other columns are not looked at,
    whatever their names. Texts are read whole.
    """

    def row(text: bytes, mask: np.ndarray) -> tuple:
        words = text.split()
        kept = [w for w, m in zip(words, mask.tolist(), strict=True) if not m] if mask.any() else words
        return int(mask.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()

    return _stripped(docs, "n_removed bigint; kept_sha256 string", row)
