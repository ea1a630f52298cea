"""Packing documents into sequences of one length by minimum bin slack.

A document is cut into full windows and a remainder. Which remainders share a window is decided on their lengths alone: how many
remainders of each length there are is a histogram of fewer rows than a window has tokens, however many documents there are. For each
window the longest remaining length is set, and a subset-sum dynamic programme over a bitset of reachable fills finds the multiset of
remaining lengths that comes closest to the capacity; the way back through the bitsets gives how many of each length it takes. The
same multiset is used for as many windows as the histogram holds, so the plan has about as many rows as there are lengths.

Documents then find their place by their rank among the remainders of their length: a place within a part of the input, and a running
count over parts. Where no multiset fills a window, one more remainder is cut to fill it and its rest goes back to the histogram. What
is left in the end, less than one window, is laid out in sequences whose lengths are powers of two, so that nothing is padded.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict, deque
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import lean_batches
from .common import Scratch, batches_of

#: The public tokenizer, the tokens of a sequence, and the id that ends a document; parameters of every function here.
TOKENIZER, CAPACITY, END = "/opt/tokenizers/word_bpe_49k.json", 2048, 1
#: Full windows of a part are numbered from (part + 1) times this on, shared ones from 0 on.
PART = 1 << 40
#: Different words that a worker keeps the ids of, bytes of texts that are encoded at once, and words whose ids are laid out at once.
KEPT_WORDS, AT_ONCE, WORDS = 1 << 20, 1 << 20, 1 << 17
#: Windows whose rows pass to the JVM at once, and texts that come from it.
ROWS, TEXTS = 2048, 256

#: Printable ASCII and the letters of Latin-1, which composing leaves alone and which lower-case one by one; and how the tokenizer parts
#: lines of them.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^\na-z0-9ß-öø-ÿ]+")
#: Stands for the end of a line among ids.
_LINE = b"\xff\xff\xff\xff"
#: What a pair of bytes leads to: the bit that lowers the first, and 1 if the tokenizer parts them whatever is around them.
_LOWER, _PART = 0x20, 1


def _pairs() -> np.ndarray:
    """By first byte * 256 + second. An upper-case letter before a byte that may begin a combining mark stays, since what they compose to
    depends on its case. What follows an apostrophe may belong to it, as in 's."""
    letter, digit, mark = (np.array([c < 128 and test(chr(c)) for c in range(256)]) for test in (str.isalpha, str.isdigit, lambda x: "!" <= x <= "~" and not x.isalnum()))
    free = mark & (np.arange(256) != ord("'"))
    parted = np.outer(letter, digit | mark) | np.outer(digit, letter | digit | mark) | np.outer(free, letter) | np.outer(mark, digit)
    upper = letter & (np.arange(256) < ord("a"))
    return (parted * _PART + np.outer(upper, np.arange(256) < 0xC4) * _LOWER).astype(np.uint8).ravel()


_PAIRS = _pairs()


class Encoder:
    """Ids of texts by the words between ASCII blanks.

    The tokenizer drops blanks, never joins what they part, and lowers single characters, so a text's ids are those of its words in a
    row and each word is looked up once. ASCII letters are lowered and parted from digits and punctuation before, which leaves fewer
    different words. New words are learned many at a time, as lines of one text: plain ones by pre-token through the tokenizer's model;
    others, and those that may hold a special token, through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = {c: ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100))}
        self.bytes = [i.to_bytes(4, "little") for i in range(1 + max(self.whole.get_vocab().values()))]
        self.words: dict[bytes, bytes] = {}

    def _learned(self, words: list[bytes]) -> dict[bytes, bytes]:
        plain, lines, others, ids = [], [], [], {}
        for word, text in zip(words, b"\n".join(words).decode("utf-8", "replace").split("\n"), strict=True):
            if _PLAIN.fullmatch(text) and "<|" not in text:
                plain.append(word)
                lines.append(text)
            else:
                others.append((word, text))
        if plain:
            found = _PRETOKEN.findall("\n".join(lines).lower())
            held = self._pretokens(set(found) - {"\n"}) | {"\n": _LINE}
            joined = b"".join(map(held.__getitem__, found))
            ends = (np.flatnonzero(np.frombuffer(joined, "<u4") == np.frombuffer(_LINE, "<u4")) * 4).tolist()
            for word, at, end in zip(plain, [0, *(e + 4 for e in ends)], [*ends, len(joined)], strict=True):
                ids[word] = joined[at:end]
        if others:
            for (word, _), got in zip(others, self.whole.encode_batch_fast([t for _, t in others], add_special_tokens=False), strict=True):
                ids[word] = np.array(got.ids, "<u4").tobytes()
        return ids

    def _pretokens(self, different: set[str]) -> dict[str, bytes]:
        tokenize, of, letters = self.model.tokenize, self.bytes, "\n".join(different)
        for letter, model in self.letters.items():  # what comes in is none of what goes out
            letters = letters.replace(letter, model)
        return {text: b"".join([of[t.id] for t in tokenize(x)]) for text, x in zip(different, letters.split("\n"), strict=True)}

    def ids(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        group, size = [], 0
        for text in texts:
            group.append(text or b"")
            size += len(group[-1])
            if size > AT_ONCE:
                yield from self._group(group)
                group, size = [], 0
        if group:
            yield from self._group(group)

    def _group(self, group: list[bytes]) -> Iterator[bytes]:
        split = pc.ascii_split_whitespace(_parted(group))
        coded = split.values.view(pa.large_binary()).dictionary_encode()
        words, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        held = list(map(self.words.get, words))
        if new := [i for i, h in enumerate(held) if h is None]:
            learned = self._learned([words[i] for i in new])
            if len(self.words) + len(new) > KEPT_WORDS:
                self.words.clear()
            self.words |= learned
            for i in new:
                held[i] = learned[words[i]]
        ids = np.frombuffer(b"".join(held), "<u4")
        many = np.fromiter(map(len, held), np.int64, len(held)) // 4
        first = np.cumsum(many) - many
        for a, b in pairwise(split.offsets.to_pylist()):
            yield b"".join([_laid_out(ids, first, many, index[at : min(at + WORDS, b)]) for at in range(a, b, WORDS)])


def _parted(texts: list[bytes]) -> pa.Array:
    """Texts with ASCII letters lowered and blanks where _PAIRS says so, but for texts that may hold a special token."""
    joined = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    ends = np.cumsum([0] + [len(t) + 1 for t in texts])
    pairs = joined.astype(np.uint16) << 8
    pairs[:-1] |= joined[1:]
    marks = _PAIRS[pairs]
    for text, at in zip(texts, ends.tolist()):
        if b"<|" in text:
            marks[at : at + len(text)] = 0
    blanks = np.flatnonzero(marks & _PART) + 1
    parted = np.insert(joined | marks & _LOWER, blanks, ord(" "))
    ends += np.searchsorted(blanks, ends)
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(parted)])


def _laid_out(ids: np.ndarray, first: np.ndarray, many: np.ndarray, index: np.ndarray) -> bytes:
    """Ids of the words numbered by index, of which each has so many from its first on."""
    counts = many[index]
    at = np.repeat(first[index] - (np.cumsum(counts) - counts), counts)
    at += np.arange(len(at))
    return ids[at].tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder, made once for a file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def windows(docs: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row for each full window and each remainder of docs: doc_id, start, ids, doc_tokens; rest, which is the length of a remainder and
    0 for a full window; part of the input; and place, the number of those before it in the part that have its rest."""
    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, start bigint, ids binary, doc_tokens bigint, rest int, part int, place bigint"
    last = np.array([end], "<u4").tobytes()
    size = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, places = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity, np.int64)
        for batch in batches:
            from_row, rows = [], []
            for i, ids in enumerate(encode.ids(batch.column("text").to_pylist())):
                ids += last
                for at in range(0, len(ids), size):
                    piece = ids[at : at + size]
                    rest = len(piece) // 4 % capacity
                    from_row.append(i)
                    rows.append((at // 4, piece, len(ids) // 4, rest, part, int(places[rest])))
                    places[rest] += 1
                    if len(rows) == ROWS:
                        yield made(batch, from_row, rows)
                        from_row, rows = [], []
            if rows:
                yield made(batch, from_row, rows)

    def made(batch: pa.RecordBatch, from_row: list[int], rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(from_row)), *columns], names=["doc_id", "start", "ids", "doc_tokens", "rest", "part", "place"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(lean_batches(run), schema)


def closest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length make up the sum closest to room from below; longer ones are preferred among equals."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, many = min(counts[length], room // length), 1
        while left > 0:  # 1, 2, 4, ... of them at once
            many = min(many, left)
            steps.append((length, many, reach))
            reach |= reach << (length * many) & mask
            left -= many
            many *= 2
        if reach >> room:
            break
    at, taken = reach.bit_length() - 1, defaultdict(int)
    for length, many, before in reversed(steps):
        if not before >> at & 1:
            taken[length] += many
            at -= length * many
    return taken


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """Where remainders go, given how many there are of each length. A row (rest, rank, many, skip, length, sequence, each, first, offset)
    says of the remainders of length rest from a rank on, so many, that their length tokens from skip on are the items first, first + 1,
    and so on of a run of which each sequence, from the one named on, takes so many side by side from the offset on."""
    lots: dict[int, deque] = defaultdict(deque)  # by length: rest, rank, many, skip
    for length, many in histogram.items():
        if many:
            lots[length].append((length, 0, many, 0))
    counts = {length: many for length, many in histogram.items() if many}
    total, sequence, rows = sum(x * n for x, n in counts.items()), 0, []

    def take(length: int, many: int) -> Iterator[tuple[int, int, int, int]]:
        counts[length] -= many
        if not counts[length]:
            del counts[length]
        while many:
            rest, rank, held, skip = lots[length].popleft()
            got = min(held, many)
            if got < held:
                lots[length].appendleft((rest, rank + got, held - got, skip))
            yield rest, rank, got, skip
            many -= got

    def place(length: int, each: int, times: int, offset: int, cut: int = 0) -> None:
        """each items of a length, or their first cut tokens, in each of so many sequences."""
        first, back = 0, []
        for rest, rank, many, skip in take(length, each * times):
            rows.append((rest, rank, many, skip, cut or length, sequence, each, first, offset))
            first += many
            if cut:
                back.append((rest, rank, many, skip + cut))
        if cut:
            lots[length - cut].extend(back)
            counts[length - cut] = counts.get(length - cut, 0) + first

    while total >= capacity:
        seed = max(counts)
        others = counts | {seed: counts[seed] - 1}
        need = closest({x: n for x, n in others.items() if n}, capacity - seed)
        need[seed] += 1
        slack = capacity - sum(x * n for x, n in need.items())
        left = {x: n - need.get(x, 0) for x, n in counts.items()}
        donor = max(x for x, n in left.items() if n) if slack else 0
        uses = need | {donor: need.get(donor, 0) + 1} if slack else need
        times, offset = min(counts[x] // n for x, n in uses.items()), 0
        for length in sorted(need, reverse=True):
            place(length, need[length], times, offset)
            offset += length * need[length]
        if slack:
            place(donor, 1, times, offset, slack)
        total -= capacity * times
        sequence += times
    sizes = [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
    offset = 0
    for length in sorted(counts, reverse=True):
        for rest, rank, many, skip in list(take(length, counts[length])):
            for k in range(many):
                at = 0
                while at < length:
                    got = min(length - at, sizes[0] - offset)
                    rows.append((rest, rank + k, 1, skip + at, got, sequence, 1, 0, offset))
                    at, offset = at + got, offset + got
                    if offset == sizes[0]:
                        sizes.pop(0)
                        offset, sequence = 0, sequence + 1
    return rows


PLAN = "rest int, rank bigint, many bigint, skip int, length int, sequence bigint, each bigint, first bigint, offset int"


def pieces(docs: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id and offset of each piece of each document.

    A row of docs is a document of its own: repeated rows and repeated or null doc_ids are packed one by one. A null, empty or blank
    text is the end id alone; texts are taken whole, however long; no rows give no rows; other columns than doc_id and text are not
    looked at. Executors need the tokenizer's file at path. Every sequence has capacity tokens, but for less than capacity tokens of
    the whole table, which make sequences whose lengths are powers of two; only remainders that complete a window are cut.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    with batches_of(spark, TEXTS):
        held = scratch.keep(windows(docs, path, capacity, end), compression="zstd")
    remainders = held.where("rest > 0")
    counts = scratch.keep(remainders.groupBy("part", "rest").agg(F.count("*").alias("n")))
    # a row for each part and length that occurs in it
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    histogram = {r.rest: r.n for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # fewer rows than capacity
    rows = spark.createDataFrame(plan(histogram, capacity), PLAN)

    full = held.where("rest = 0").select("doc_id", "start", F.lit(capacity).cast("long").alias("length"), "ids", "doc_tokens", ((F.col("part").cast("long") + 1) * PART + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    ranked = remainders.join(offsets, ["part", "rest"]).withColumn("own", F.col("before") + F.col("place"))
    p = F.broadcast(rows.select(*[F.col(c).alias(f"p_{c}") for c in rows.columns]))
    item = F.col("p_first") + F.col("own") - F.col("p_rank")
    shared = ranked.join(p, (F.col("rest") == F.col("p_rest")) & (F.col("own") >= F.col("p_rank")) & (F.col("own") < F.col("p_rank") + F.col("p_many"))).select(
        "doc_id",
        (F.col("start") + F.col("p_skip")).alias("start"),
        F.col("p_length").cast("long").alias("length"),
        F.substring("ids", F.col("p_skip") * 4 + 1, F.col("p_length") * 4).alias("ids"),
        "doc_tokens",
        (F.col("p_sequence") + F.expr("(p_first + own - p_rank) div p_each")).alias("sequence_id"),
        (F.col("p_offset") + item % F.col("p_each") * F.col("p_length")).alias("offset"),
    )
    return full.unionByName(shared)


def padded(length: Column, capacity: int = CAPACITY) -> Column:
    """What a sequence of so many tokens is padded to: the capacity, or nothing if the length is a power of two."""
    return F.when(F.bit_count(length) == 1, length).otherwise(F.lit(capacity).cast("long"))


def sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, ids, length and padded length of each sequence, and its documents' offsets; a sequence has capacity pieces at most."""
    held = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("x"))
    joined = F.aggregate("x", F.lit(b""), lambda ids, piece: F.concat(ids, piece["ids"]))
    length = F.aggregate("x", F.lit(0).cast("long"), lambda n, piece: n + piece["length"])
    return held.select("sequence_id", joined.alias("ids"), length.alias("length"), padded(length, capacity).alias("padded"), F.col("x.offset").alias("offsets"))


def query(docs: DataFrame) -> DataFrame:
    return pieces(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
