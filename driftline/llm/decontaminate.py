"""Benchmark passages in texts, also with other numbers, names and units.

Texts become templates. A token is a number (in digits or words, with the unit that follows it, if any), a unit, a run of
capitalised words, or any other word. The first three are slots, placeholders of their type; of other words the lower-case
form without surrounding marks counts. What a token is follows from it and its neighbours alone, whatever else the text holds.

Windows of template tokens are joined by hash with those of the benchmark, and so are windows of plain lower-case words, as
a verbatim passage counts whatever its capitals. Windows on one diagonal make a run. A run is consistent if the values that fill
the benchmark's slots map one to one to the text's, type by type. The consistent runs of an item that lie together in a text are
judged together: their slots must agree and cover enough of the item.

A bit array of fixed size tells tasks which windows can't be the benchmark's, so only the few others are sent on; they and
the benchmark's windows are tables that Spark joins. Neither documents nor the benchmark are collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import chunks, hashed_spans, hashed_words, mix, word_spans
from .common import Scratch, small_batches

#: Tokens of a window; plain words that a template window needs; shortest item in words; words that count, or half the item.
WINDOW, LITERAL, SHORTEST, ENOUGH = 8, 4, 5, 13
#: The bit array has 2 ** BITS bits whatever the benchmark holds, made in parts of 2 ** PART bits.
BITS, PART = 26, 20
# Unit words and number words.
UNITS = (
    b"mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    b"mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons "
    b"s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    b"percent % $ usd eur dollar dollars euro euros cent cents mph kph km/h degree degrees celsius fahrenheit watt watts volt volts"
)
NUMBERS = (
    b"zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    b"twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen"
)
_U = np.uint64
_STEP = _U(0x9FB21C651E98DF25)
WORD, NUM, UNIT, NAME = range(4)
_SLOT = np.asarray([0, 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D], _U)
PLAIN, TEMPLATE = 0, 1


def _bytes(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_MARK = _bytes(b"!\"'()*,-./:;<>?[]_`{|}~#& \t\n\x0b\f\r")
_STOP, _CLOSE = _bytes(b".!?:|"), _bytes(b"\"')]")
# Three counters of 21 bits in one number: digits, bytes that no number has, and capitals.
_COUNT = np.zeros(256, _U)
_COUNT[list(b"0123456789")] += _U(1)
_COUNT[~_bytes(b"0123456789.,:/+-$%")] += _U(1 << 21)
_COUNT[ord("A") : ord("Z") + 1] += _U(1 << 42)
_FIELD = _U((1 << 21) - 1)


class Known:
    """A few words by hash; most others are told apart by sixteen bits."""

    def __init__(self, words: bytes):
        self.hashes = np.sort(hashed_words(words.split())[0])
        self.few = np.zeros(1 << 16, bool)
        self.few[self.hashes & _U(0xFFFF)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = self.few[hashes & _U(0xFFFF)]
        out[out] = np.isin(hashes[out], self.hashes)
        return out


_UNITS, _NUMBERS = Known(UNITS), Known(NUMBERS)


@dataclass
class Reading:
    """Tokens of several texts in a row: how many each text has, hash, value and kind of each, and which words it spans (places
    within its text)."""

    counts: np.ndarray
    hashes: np.ndarray
    values: np.ndarray
    kinds: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _cores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without the marks around them; a word of marks alone stays whole."""
    place = np.arange(len(data))
    after = np.where(_MARK[data], len(data), place)
    after = np.minimum.accumulate(after[::-1])[::-1][starts]
    before = np.maximum.accumulate(np.where(_MARK[data], -1, place))[ends - 1] + 1
    whole = after >= ends
    return np.where(whole, starts, after), np.where(whole, ends, before)


def read(texts: list[bytes]) -> tuple[Reading, Reading]:
    """The plain words and the template tokens of the texts."""
    lowered = [t.decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass") for t in texts]
    data, small = (np.frombuffer(b" ".join(x) + b" ", np.uint8) for x in (texts, lowered))
    (starts, ends), (low_starts, low_ends) = word_spans(data), word_spans(small)
    counts = np.diff(np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])), prepend=0)
    s, e = _cores(data, starts, ends)
    ls, le = _cores(small, low_starts, low_ends)
    plain = hashed_spans(small, ls, le)
    n = len(plain)

    sums = np.concatenate((np.zeros(1, _U), np.cumsum(_COUNT[data], dtype=_U)))
    field = sums[e] - sums[s]
    digits, other, capitals = field & _FIELD, field >> _U(21) & _FIELD, field >> _U(42)
    ascii_first = data[s] < 128
    wide = ~ascii_first
    wide[wide] = (data[s[wide]] != small[ls[wide]]) | (data[s[wide] + 1] != small[ls[wide] + 1]) | ((data[s[wide]] >= 0xE0) & (data[np.minimum(s[wide] + 2, len(data) - 1)] != small[np.minimum(ls[wide] + 2, len(small) - 1)]))
    first_capital = np.where(ascii_first, (data[s] >= 65) & (data[s] <= 90), wide)
    spelled = _NUMBERS(plain)
    number = ((digits > 0) & (other == 0)) | spelled
    unit = _UNITS(plain) & ~number
    name = first_capital & (capitals == np.where(ascii_first, 1, 0)) & (e - s > 1) & ~number & ~unit
    kinds = np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME, WORD))).astype(np.int8)

    first = np.ones(n, bool)  # of a sentence, a line or a text
    last = data[ends - 1]
    stop = _STOP[last] | (_CLOSE[last] & _STOP[data[np.maximum(ends - 2, 0)]])
    first[1:] = stop[:-1]
    for x in (np.searchsorted(starts, np.flatnonzero(data == 10)), np.cumsum(counts)):
        first[x[x < n]] = True
    joins = np.zeros(n, bool)
    joins[1:] = ~first[1:] & (
        (name[1:] & name[:-1]) | (spelled[1:] & spelled[:-1]) | (unit[1:] & number[:-1])
    )
    begin = np.flatnonzero(~joins)
    place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    text = np.repeat(np.arange(len(counts)), counts)
    if len(begin):
        offset = np.minimum(np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n))), 63)
        values = np.add.reduceat(plain * _ROTATE[offset], begin)
    else:
        values = plain
    kinds = kinds[begin]
    following = place[np.append(begin[1:], n) - 1] + 1 if n else place
    tokens = Reading(np.bincount(text[begin], minlength=len(counts)), np.where(kinds == WORD, values, _SLOT[kinds]), values, kinds, place[begin], following)
    words = Reading(counts, plain, plain, np.zeros(n, np.int8), place, place + 1)
    return words, tokens


_ROTATE = np.asarray([pow(0x9E3779B97F4A7C15, k, 2**64) for k in range(64)], _U)


def rolled(h: np.ndarray, length: int, reading: int) -> np.ndarray:
    """Hashes of all runs of so many tokens, apart by reading and length."""
    out = np.zeros(max(0, len(h) - length + 1), _U)
    for j in range(length):
        out = out * _STEP + h[j : j + len(out)]
    return mix(out + _U(2 * length + reading))


def within(counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of windows that lie within one text, and their text."""
    n = np.maximum(counts - length + 1, 0)
    text = np.repeat(np.arange(len(counts)), n)
    return (np.cumsum(counts) - counts)[text] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), text


def _lists(values: np.ndarray, place: np.ndarray, length: int) -> pa.Array:
    flat = values[place[:, None] + np.arange(length)].reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(place) + 1, dtype=np.int32) * length), pa.array(flat))


def _rows(reading: int, r: Reading, length: int, hashes: np.ndarray, place: np.ndarray, text: np.ndarray) -> dict[str, pa.Array]:
    own = np.cumsum(r.counts) - r.counts
    return {
        "h": pa.array(hashes.view(np.int64)),
        "at": pa.array((place - own[text]).astype(np.int64) * 2 + reading),  # both readings in one number
        "start": pa.array(r.start[place].astype(np.int64)),
        "end": pa.array(r.end[place + length - 1].astype(np.int64)),
        "held": _lists(r.values.view(np.int64), place, length),
    }


ROW = "h bigint, at bigint, start bigint, end bigint, held array<bigint>"


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, group in chunks(b.column("text").to_pylist()):
            readings = read(group)
            size = readings[PLAIN].counts
            for reading, r in enumerate(readings):
                for length in range(1, WINDOW + 1):
                    # an item that is shorter than a window is one
                    counts = np.where((size >= SHORTEST) & ((r.counts == length) if length < WINDOW else (r.counts >= length)), r.counts, 0)
                    place, text = within(r.counts, length)
                    fit = counts[text] > 0
                    if reading == TEMPLATE:
                        literal = np.convolve(r.kinds == WORD, np.ones(length, int), "valid")[place] if len(place) else np.zeros(0, int)
                        fit &= (literal >= min(LITERAL, length)) & (literal < length)
                    place, text = place[fit], text[fit]
                    if not len(place):
                        continue
                    rows = _rows(reading, r, length, rolled(r.hashes, length, reading)[place], place, text)
                    of = pa.array(text + first)
                    own = {c: b.column(c).take(of) for c in ("k", "item_id")}
                    own |= {"n_words": pa.array(size[text].astype(np.int64)), "length": pa.array(np.full(len(place), length, np.int64)), "kinds": _lists(r.kinds, place, length)}
                    yield pa.RecordBatch.from_pydict(own | rows)


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h >> _U(64 - BITS), mix(h + _STEP) >> _U(64 - BITS)


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_pydict({"bit": pa.array(np.unique(np.concatenate(_places(b.column(0).to_numpy().view(_U)))).astype(np.int64))})


def _part(key: tuple, group: pa.Table) -> pa.Table:
    bits = np.zeros(1 << PART, bool)
    bits[group.column("bit").to_numpy() & ((1 << PART) - 1)] = True
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def bit_array(windows: DataFrame) -> np.ndarray:
    """Two bits for each window's hash; 2 ** (BITS - 3) bytes."""
    small_batches(windows.sparkSession)
    bits = windows.select("h").mapInArrow(_bits, "bit bigint").distinct().withColumn("part", F.shiftright("bit", PART))
    out = np.zeros(1 << (BITS - 3), np.uint8)
    size = 1 << (PART - 3)
    for r in bits.groupBy("part").applyInArrow(_part, "part bigint, bits binary").collect():  # at most 2 ** (BITS - PART) rows
        out[r.part * size : (r.part + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out


def _doc_windows(sent: Broadcast, lengths: list[tuple[int, int]], names: list[str]):
    def has(places: np.ndarray) -> np.ndarray:
        return (sent.value[places >> _U(3)] >> (places & _U(7)).astype(np.uint8)) & 1 != 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, group in chunks(b.column("text").to_pylist()):
                readings = read(group)
                for reading, length in lengths:
                    r = readings[reading]
                    h = rolled(r.hashes, length, reading)
                    if not len(h):
                        continue
                    one, _ = _places(h)
                    maybe = np.flatnonzero(has(one))
                    maybe = maybe[has(_places(h[maybe])[1])]
                    limits = np.cumsum(r.counts)
                    text = np.searchsorted(limits, maybe, "right")
                    fit = maybe + length <= limits[text]
                    place, text = maybe[fit], text[fit]
                    if len(place):
                        of = pa.array(text + first)
                        yield pa.RecordBatch.from_pydict({c: b.column(c).take(of) for c in names} | _rows(reading, r, length, h[place], place, text))

    return run


@dataclass
class Run:
    start: int
    end: int
    item_start: int
    item_end: int
    slots: dict[tuple[int, int], int]


def _agree(own: dict, back: dict, slots: dict) -> bool:
    """Adds slots to what maps one to one in both directions, if that stays so."""
    if any(own.get(k, v) != v or back.get((k[0], v), k[1]) != k[1] for k, v in slots.items()):
        return False
    for k, v in slots.items():
        own[k], back[k[0], v] = v, k[1]
    return len({(k[0], v) for k, v in slots.items()}) == len(slots)


def runs(rows: list[dict]) -> list[Run]:
    """Consistent runs of one item in one text; rows are the windows that met."""
    diagonals: dict[tuple[int, int], list[dict]] = {}
    for r in rows:
        if all(k != WORD or a == b for k, a, b in zip(r["kinds"], r["held"], r["item_held"], strict=True)):
            diagonals.setdefault((r["at"] & 1, (r["at"] >> 1) - (r["item_at"] >> 1)), []).append(r)
    out = []
    for _, found in sorted(diagonals.items()):
        found.sort(key=lambda r: r["at"])
        groups: list[list[dict]] = []
        upto = -1
        for r in found:
            if (r["at"] >> 1) > upto:
                groups.append([])
            groups[-1].append(r)
            upto = (r["at"] >> 1) + r["length"]
        for g in groups:
            own, back = {}, {}
            ok = True
            for r in g:
                slots: dict[tuple[int, int], int] = {}
                for k, a, b in zip(r["kinds"], r["item_held"], r["held"], strict=True):
                    ok &= k == WORD or slots.setdefault((k, a), b) == b
                ok = ok and _agree(own, back, slots)
            if ok:
                out.append(Run(g[0]["start"], max(r["end"] for r in g), g[0]["item_start"], max(r["item_end"] for r in g), own))
    return out


def judged(rows: list[dict]) -> list[tuple[int, int, int, float, int]]:
    """Start and end in the text, start in the item, share of it and differing slots, of each place where enough of the item is."""
    if not rows:
        return []
    size = rows[0]["n_words"]
    clusters: list[list[Run]] = []
    upto = 0
    for r in sorted(runs(rows), key=lambda r: (r.start, r.end, r.item_start)):
        if not clusters or r.start > upto + size:
            clusters.append([])
        clusters[-1].append(r)
        upto = max(upto, r.end) if len(clusters[-1]) > 1 else r.end
    out = []
    for c in clusters:
        own, back, taken, covered = {}, {}, [], set()
        for r in sorted(c, key=lambda r: (r.item_start - r.item_end, r.start, r.item_start)):
            if _agree(own, back, r.slots):
                taken.append(r)
                covered.update(range(r.item_start, r.item_end))
        if len(covered) >= min(size, ENOUGH) or 2 * len(covered) >= size:
            differing = sum(k[1] != v for k, v in own.items())
            out.append((min(r.start for r in taken), max(r.end for r in taken), min(covered), len(covered) / size, differing))
    return out


def _found(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each place of a text (rid, doc_id) that an item is found in."""
    spark = docs.sparkSession
    small_batches(spark)
    doc_type, item_type = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    rid = docs.schema["rid"].dataType.simpleString()
    items = benchmark.select(F.monotonically_increasing_id().alias("k"), "item_id", "text").where("text IS NOT NULL")
    windows = scratch.keep(items.mapInArrow(_item_windows, f"k bigint, item_id {item_type}, n_words bigint, length bigint, kinds array<tinyint>, {ROW}"))
    lengths = sorted((r.reading, r.length) for r in windows.select((F.col("at") % 2).alias("reading"), "length").distinct().collect())  # at most 2 * WINDOW
    sent = spark.sparkContext.broadcast(bit_array(windows))
    hits = docs.where("text IS NOT NULL").mapInArrow(_doc_windows(sent, lengths, ["rid", "doc_id"]), f"rid {rid}, doc_id {doc_type}, {ROW}")
    renamed = windows.select("h", "k", "item_id", "n_words", "length", "kinds", *[F.col(c).alias(f"item_{c}") for c in ("at", "start", "end", "held")])
    schema = f"rid {rid}, doc_id {doc_type}, item_id {item_type}, start_word bigint, end_word bigint, item_start bigint, share double, n_slots bigint"

    def verify(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        found = judged(rows)
        same = {c: pa.array([rows[0][c]] * len(found), group.schema.field(c).type) for c in ("rid", "doc_id", "item_id")}
        types = [pa.int64()] * 3 + [pa.float64(), pa.int64()]
        rest = {c: pa.array([f[i] for f in found], t) for i, (c, t) in enumerate(zip(("start_word", "end_word", "item_start", "share", "n_slots"), types, strict=True))}
        return pa.table(same | rest)

    return hits.join(renamed, "h").groupBy("rid", "k").applyInArrow(verify, schema)


def links(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each place of a text that an item is found in: doc_id, item_id, start_word and end_word (exclusive),
    item_start, share (of the item's words) and n_slots, how many slots have other values.

    Texts and items are read whole. Null and empty texts or items match nothing, nor do items of fewer than SHORTEST
    words, which can't be told from chance. Null ids are carried through. Repeated rows of either table give repeated
    rows, and empty tables none. Other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    own = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    return _found(own, benchmark, scratch).drop("rid")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no item is found, with docs' own columns.

    A verdict follows from the text alone, so repeated rows go or stay together, as do rows that share no more than a text.
    Rows with null and empty texts stay. An empty table of either kind removes nothing.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    own = docs.select(F.md5("text").alias("rid"), "doc_id", "text")
    bad = scratch.keep(_found(own, benchmark, scratch).select(F.col("rid").alias("bad")).distinct())
    return docs.join(bad, F.md5(docs["text"]) == F.col("bad"), "left_anti")
