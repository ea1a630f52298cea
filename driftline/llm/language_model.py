"""A hierarchical Pitman-Yor model of tokens, trained by Gibbs sampling, and scores of whole texts.

A restaurant for each word before seats every training token at tables of its word. Each table sends one customer to the
restaurant without context, which all contexts share as their parent. Its own parent spells words: each table sends one customer,
the spelled word, to a hierarchy of restaurants over letters, whose contexts are the last three, two, one and no letters; the last
parent is uniform. As in the base score, words that training never saw are one type, the unknown word: its share of the parent is
what the spellings of known words leave over.

Seating is sampled by blocked Gibbs: given the tables of all others and the parent's predictions, the number of a dish's
tables is drawn from its exact conditional distribution (generalised Stirling numbers) for up to EXACT customers, and customers
beyond are seated in order, in growing blocks. A draw follows from the dish, its context and the sweep, not from where a row
lies, so that scores don't depend on partitions. The contexts are drawn anew SWEEPS times, each time followed by sweeps of words
and letters, and the predictions of the last KEPT states are averaged.

What follows the corpus stays distributed, as blocks of numbers rather than rows. Documents are read once into chunks, whose
tokens are numbers of words. Words are dealt to shards by hash, and pairs of words to shards by the first word (those of a very
frequent first word by both, with their context's sums added up apart). A chunk sends each of its pairs once, whatever their
number, and gets probabilities back. The letter restaurants have at most 32 ** 3 * 257 cells whatever the corpus holds, which
bounds what sweeps send to the driver and back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import BINARY, LONG, batch_of, cut, distinct_words, few_rows, grouped, lean_batches, mix, pack, read_chunks, shard_limits, unpack
from .common import Scratch, small_batches

SWEEPS, KEPT = 2, 2  # a row of pairs has the tables of two states
#: Sweeps of words and letters before the first and the later sweeps of contexts.
FIRST_WORD_SWEEPS, WORD_SWEEPS = 4, 2
CONTEXT_STRENGTH, WORD_STRENGTH, LETTER_STRENGTH, LETTER_DISCOUNT = 1.0, 10.0, 1.0, 0.6
EXACT = 64
#: Letters are bytes and one that ends a word; contexts know them by class: 26 letters, digits, other ASCII, first and
#: further bytes of other characters, and 0 for what precedes a word.
SYMBOLS, END, CLASSES = 257, 256, 32
_CLASS = np.zeros(SYMBOLS, np.int64)
_CLASS[:128] = 28
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CLASS[ord("0") : ord("9") + 1] = 27
_CLASS[128:192], _CLASS[192:256] = 30, 29  # a word's end is never part of a context
DEPTH = 3
#: Tokens of a chunk (but a text is never cut), of a shard of pairs, and of a shard of words, and how many shards there are at least.
CHUNK_TOKENS, PAIR_TOKENS, WORD_TOKENS, PAIR_SHARDS, WORD_SHARDS = 1 << 19, 1 << 19, 1 << 22, 64, 16
#: A word that stands more often is a hot context, but never so many words that they'd be more than HOT_WORDS.
HOT, HOT_WORDS = 1 << 18, 1 << 20
PASSES = 3
#: Stands for a text's end among the hashes of words.
END_HASH = 1
_U = np.uint64


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; a missing doc_id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def stirling(discount: float, n: int = EXACT) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: [c, t] sums over seatings of c customers at t tables the product of
    (size - discount) terms."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(n):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(c - discount * t > 0, np.log(np.maximum(c - discount * t, 1e-300)), -np.inf) + out[c, 1 : c + 2]
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], stay)
    return out


def uniform(keys: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers between 0 and 1 that follow from keys and salt."""
    x = keys.astype(_U)
    for k in salt:
        x = mix(x + _U((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return ((mix(x) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def binomial(n: np.ndarray, p: np.ndarray, keys: np.ndarray, salt: int) -> np.ndarray:
    """How many of n succeed, by inversion; by the normal distribution where the variance is large."""
    u, spread = uniform(keys, salt, 0), n * p * (1 - p)
    z = np.sqrt(-2 * np.log(u)) * np.cos(2 * math.pi * uniform(keys, salt, 1))
    out = np.clip(np.rint(n * p + z * np.sqrt(spread)), 0, n).astype(np.int64)
    at = np.flatnonzero(spread <= 30)
    # few of what is rarer
    less = np.minimum(p[at], 1 - p[at])
    mass = np.exp(n[at] * np.log1p(-less))
    below, got = mass.copy(), np.zeros(len(at), np.int64)
    going = np.flatnonzero(u[at] > below)
    k = 0
    while len(going):
        k += 1
        mass[going] *= (n[at[going]] - k + 1) / k * less[going] / (1 - less[going])
        below[going] += mass[going]
        got[going] = k
        going = going[(u[at[going]] > below[going]) & (k < n[at[going]])]
    out[at] = np.where(p[at] <= 0.5, got, n[at] - got)
    return out


def seat(count: np.ndarray, opening: np.ndarray, discount: float, table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Draws how many tables serve each dish of count customers; opening is the weight of a new table, and what is drawn follows
    from keys."""
    tables = np.minimum(count, 1)
    opening = np.maximum(opening, 1e-300)
    near = np.minimum(count, EXACT)
    order = np.argsort(near, kind="stable")
    limits = np.searchsorted(near[order], np.arange(2, EXACT + 2))
    for c in range(2, EXACT + 1):
        at = order[limits[c - 2] : limits[c - 1]]
        for part in np.array_split(at, len(at) * c // (1 << 20) + 1) if len(at) else ():
            weight = table[c, 1 : c + 1][None, :] + np.log(opening[part])[:, None] * np.arange(1, c + 1)[None, :]
            weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), axis=1)
            tables[part] = 1 + (weight < uniform(keys[part], 0)[:, None] * weight[:, -1:]).sum(1)
    at, seated, block = np.flatnonzero(count > EXACT), EXACT, 0
    while len(at):
        block += 1
        more = np.minimum(count[at], seated + max(1, seated // 8)) - seated
        new = opening[at] / (opening[at] + seated - discount * tables[at])
        tables[at] += binomial(more, np.minimum(new, 1.0), keys[at], block)
        seated += max(1, seated // 8)
        at = at[count[at] > seated]
    return tables


class Letters:
    """The letter restaurants: seats of symbols that were seen, and predictions of all."""

    def __init__(self, discount: float = LETTER_DISCOUNT, strength: float = LETTER_STRENGTH):
        self.discount, self.strength, self.table = discount, strength, stirling(discount)
        self.predict = [np.full(CLASSES**d * SYMBOLS, 1 / SYMBOLS, np.float32) for d in range(DEPTH + 1)]
        self.opened: list[np.ndarray | None] = [None] * (DEPTH + 1)
        none = np.zeros(0, np.int64)
        self.seats: Seats = [(none.astype(np.int32), none, none)] * (DEPTH + 1)

    def sweep(self, codes: np.ndarray, counts: np.ndarray, number: int) -> None:
        """Seats the customers (sorted codes of context and symbol, and how many) anew, from the deepest contexts up, and
        predicts from the top down."""
        seats = []
        for d in range(DEPTH, -1, -1):
            context = codes // SYMBOLS
            parent = codes % (CLASSES ** max(0, d - 1) * SYMBOLS)
            up = np.full(len(codes), 1 / SYMBOLS) if d == 0 else self.predict[d - 1][parent]
            opened = np.bincount(context, minlength=CLASSES**d) if self.opened[d] is None else self.opened[d]
            keys = mix(codes.astype(_U) + _U(number * 8 + d << 32))
            tables = seat(counts, (self.strength + self.discount * opened[context]) * up, self.discount, self.table, keys)
            self.opened[d] = np.bincount(context, weights=tables, minlength=CLASSES**d)
            seats.append((codes.astype(np.int32), counts, tables.astype(np.int64)))
            codes, where = np.unique(parent, return_inverse=True)
            counts = np.bincount(where, weights=tables, minlength=len(codes)).astype(np.int64)
        self.seats = seats[::-1]
        self.predict = predictions(self.seats, self.discount, self.strength)


Seats = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def predictions(seats: Seats, discount: float = LETTER_DISCOUNT, strength: float = LETTER_STRENGTH) -> list[np.ndarray]:
    """For each depth the probability of every symbol after every context, from the seats (codes, customers, tables) of
    each depth. Only seats travel between the driver and tasks; this is what both make of them."""
    out: list[np.ndarray] = []
    for d, (codes, counts, tables) in enumerate(seats):
        context = codes // SYMBOLS
        total = strength + np.bincount(context, weights=counts, minlength=CLASSES**d)
        back = (strength + discount * np.bincount(context, weights=tables, minlength=CLASSES**d)) / total
        up = np.full((1, SYMBOLS), 1 / SYMBOLS, np.float32) if d == 0 else out[d - 1].reshape(-1, SYMBOLS)
        own = np.tile(up, (CLASSES**d // len(up), 1))
        own *= back.astype(np.float32)[:, None]
        own = own.reshape(-1)
        own[codes] += ((counts - discount * tables) / total[context]).astype(np.float32)
        out.append(own)
    return out


_DENSE: dict[tuple, np.ndarray] = {}


def log_letters(state: dict) -> np.ndarray:
    """The deepest predictions of a state, as logarithms; a task keeps those of the states it works with."""
    name = (state["sweep"], len(state["seats"][-1][0]), state["tables"])
    if name not in _DENSE:
        while len(_DENSE) >= 2:
            _DENSE.pop(next(iter(_DENSE)))
        dense = predictions(state["seats"]).pop()
        _DENSE[name] = np.log(dense, out=dense)
    return _DENSE[name]


def spelled(letters: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of context and symbol for every letter of words in a row, of so many letters each, and their ends, and where each
    word starts."""
    size = size.astype(np.int64) + 1
    start = np.cumsum(size) - size
    symbol = np.full(size.sum(), END, np.int64)
    inner = np.ones(len(symbol), bool)
    inner[start + size - 1] = False
    symbol[inner] = letters
    place, kind = np.arange(len(symbol)) - np.repeat(start, size), _CLASS[symbol]
    code = np.zeros(len(symbol), np.int64)
    for back in range(DEPTH, 0, -1):
        before = np.zeros(len(symbol), np.int64)
        before[back:] = np.where(place[back:] >= back, kind[:-back], 0)
        code = code * CLASSES + before
    return code * SYMBOLS + symbol, start


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (rid, doc_id, held, text) as chunks."""
    for texts in read_chunks(batches, CHUNK_TOKENS, lower=True):
        ends = np.cumsum(texts.counts)
        h, size = np.insert(texts.hashes, ends, _U(END_HASH)), np.insert(texts.sizes, ends, 0)
        first, which = distinct_words(h)
        # tokens are places in the order of how often words stand, so that most of them are small
        rank = np.empty(len(first), np.int64)
        rank[np.argsort(-np.bincount(which), kind="stable")] = np.arange(len(first))
        held = texts.column("held")
        train = np.repeat(~held.to_numpy(zero_copy_only=False).astype(bool), texts.counts + 1)
        whole = pa.array([0, len(texts.counts)], pa.int32())
        columns = {
            "cid": texts.column("rid").slice(0, 1),
            "doc_id": pa.ListArray.from_arrays(whole, texts.column("doc_id")),
            "held": pa.ListArray.from_arrays(whole, held),
            "size": pa.array([texts.counts + 1], pa.list_(pa.int64())),
            "token": pa.array([pack(rank[which])], pa.binary()),
            "rank": pa.array([pack(rank)], pa.binary()),
            "h": pa.array([h[first].astype("<u8").tobytes()], pa.binary()),
            "c": pa.array([pack(np.bincount(which, weights=train, minlength=len(first)).astype(np.int64))], pa.binary()),
            "letters": pa.array([pack(size[first])], pa.binary()),
            "spelled": pa.array([cut(texts.letters, size, first).tobytes()], pa.binary()),
        }
        yield pa.RecordBatch.from_pydict(columns)


def vocabulary(chunked: DataFrame, shards: int, scratch: Scratch) -> DataFrame:
    """Blocks of words, sorted by hash (cid null: h, c, letters, spelled, v how many, types and tokens of training), and for each
    chunk which of them its words are and their counts (cid, h, c)."""
    schema = [("ws", LONG), ("cid", LONG), ("h", BINARY), ("c", BINARY), ("letters", BINARY), ("spelled", BINARY)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cid, h, c, size, data in zip(*(b.column(n).to_pylist() for n in ("cid", "h", "c", "letters", "spelled")), strict=True):
                h, c, size, data = np.frombuffer(h, "<u8"), unpack(c), unpack(size), np.frombuffer(data, np.uint8)
                limits, at = shard_limits(h, shards), np.concatenate(([0], np.cumsum(size)))
                yield batch_of(schema, [(k, cid, h[s:e].tobytes(), pack(c[s:e]), pack(size[s:e]), data[at[s] : at[e]].tobytes()) for k, (s, e) in enumerate(zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)) if s < e])

    out = [*schema, ("v", LONG), ("types", LONG), ("tokens", LONG)]

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        each = [np.frombuffer(r["h"], "<u8") for r in rows]
        c, size = np.concatenate([unpack(r["c"]) for r in rows]), np.concatenate([unpack(r["letters"]) for r in rows])
        h, first, which = np.unique(np.concatenate(each), return_index=True, return_inverse=True)
        total = np.bincount(which, weights=c, minlength=len(h)).astype(np.int64)
        data = cut(np.frombuffer(b"".join([r["spelled"] for r in rows]), np.uint8), size, first)
        ws = key[0].as_py()
        found = [(ws, None, h.tobytes(), pack(total), pack(size[first]), data.tobytes(), len(h), int((total > 0).sum()), int(total.sum()))]
        ends = np.cumsum([len(x) for x in each]).tolist()
        for r, s, e in zip(rows, [0, *ends], ends):
            found.append((ws, r["cid"], pack(which[s:e]), pack(total[which[s:e]]), None, None, None, None, None))
        return pa.Table.from_batches([batch_of(out, found)])

    ddl = "ws bigint, cid bigint, h binary, c binary, letters binary, spelled binary"
    dealt = chunked.select("cid", "h", "c", "letters", "spelled").mapInArrow(lean_batches(deal), ddl)
    return scratch.keep(dealt.groupBy("ws").applyInArrow(merge, ddl + ", v bigint, types bigint, tokens bigint"))


def _numbered(chunked: DataFrame, words_: DataFrame, offsets: np.ndarray, n: int, v: int, scratch: Scratch) -> DataFrame:
    """Chunks with the numbers of their words, and known and base for each document."""
    doc_ids = chunked.schema["doc_id"].dataType.simpleString()

    def number(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        got = sorted(right.to_pylist(), key=lambda r: r["ws"])
        rank = unpack(left.column("rank")[0].as_py())
        ids, c = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        ids[rank] = np.concatenate([offsets[r["ws"]] + unpack(r["h"]) for r in got])
        c[rank] = np.concatenate([unpack(r["c"]) for r in got])
        token, size = unpack(left.column("token")[0].as_py()), np.asarray(left.column("size")[0].as_py())
        at = np.cumsum(size) - size
        known = np.add.reduceat((c > 0).astype(np.int64)[token], at)
        base = np.add.reduceat(np.log10((c + 0.1) / (n + 0.1 * (v + 1)))[token], at)
        more = {"known": pa.array([known], pa.list_(pa.int64())), "base": pa.array([base], pa.list_(pa.float64())), "id": pa.array([pack(ids)], pa.binary())}
        return pa.table({c: left.column(c) for c in ("cid", "doc_id", "held", "size", "token")} | more)

    left = chunked.select("cid", "doc_id", "held", "size", "token", "rank").groupBy("cid")
    right = words_.where("cid IS NOT NULL").select("cid", "ws", "h", "c").groupBy("cid")
    return scratch.keep(left.cogroup(right).applyInArrow(number, f"cid bigint, doc_id {doc_ids}, held array<boolean>, size array<bigint>, token binary, known array<bigint>, base array<double>, id binary"))


class Deal:
    """Where pairs go. Words have numbers from 0 on in the order of their hashes; start stands for what precedes a text."""

    def __init__(self, start: int, hot: np.ndarray, shards: int):
        self.start, self.hot, self.shards, self.bits = start, hot, shards, (start + 1).bit_length()

    def is_hot(self, b: np.ndarray) -> np.ndarray:
        return np.isin(b, self.hot)

    def pairs(self, size: np.ndarray, token: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The different pairs of a chunk, sorted by shard: first word, second word, shard limits; and for each token its pair."""
        none = len(ids)
        before = np.concatenate(([none], token[:-1]))
        before[np.cumsum(size) - size] = none
        code, which = grouped(before * (none + 1) + token, 2 * (none + 1).bit_length())
        code = code.astype(np.int64)
        b, w = np.append(ids, self.start)[code // (none + 1)], ids[code % (none + 1)]
        shard = mix(b.astype(_U))
        hot = self.is_hot(b)
        shard[hot] = mix(shard[hot] + w[hot].astype(_U))
        shard = ((shard >> _U(40)) * _U(self.shards) >> _U(24)).astype(np.int64)
        order = np.argsort(shard.astype(np.uint16) if self.shards < 1 << 16 else shard, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return b[order], w[order], np.searchsorted(shard[order], np.arange(self.shards + 1)), place[which]


def _runs(b: np.ndarray) -> tuple[bytes, bytes]:
    """A column with equal neighbours, as values and lengths of runs."""
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(b)), bool), b[1:] != b[:-1])))
    return pack(b[new]), pack(np.diff(np.append(new, len(b))))


_PAIRS = "shard bigint, b binary, n binary, w binary, c binary, t binary, s binary, hot_b binary, hot_c binary, hot_t binary, ones bigint, twos bigint"
_PAIR_SCHEMA = [(x.split()[0], LONG if x.endswith("bigint") else BINARY) for x in _PAIRS.split(", ")]


def _pair_row(shard: int, b: np.ndarray, w: np.ndarray, c: np.ndarray, t: np.ndarray, before: np.ndarray, deal: Deal) -> pa.Table:
    """A shard's pairs, sorted, with their tables and those of the sweep before, and what it adds to the sums of hot contexts."""
    first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
    own = b[first]
    hot = deal.is_hot(own)
    sums = [np.add.reduceat(x, first)[hot] for x in (c, t)]
    row = (shard, *_runs(b), pack(w), pack(c), pack(t), pack(before), pack(own[hot]), *map(pack, sums), int((c == 1).sum()), int((c == 2).sum()))
    return pa.Table.from_batches([batch_of(_PAIR_SCHEMA, [row])])


def _first_seats(chunked: DataFrame, deal: Deal, scratch: Scratch) -> DataFrame:
    """Each shard's pairs with counts; one table for each that training holds."""
    schema = [("shard", LONG), ("b", BINARY), ("n", BINARY), ("w", BINARY), ("c", BINARY)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, size, token, ids in zip(*(batch.column(n).to_pylist() for n in ("held", "size", "token", "id")), strict=True):
                size = np.asarray(size)
                b, w, limits, pair = deal.pairs(size, unpack(token), unpack(ids))
                c = np.bincount(pair, weights=np.repeat(~np.asarray(held), size), minlength=len(b)).astype(np.int64)
                yield batch_of(schema, [(k, *_runs(b[s:e]), pack(w[s:e]), pack(c[s:e])) for k, (s, e) in enumerate(zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)) if s < e])

    def gather(key: tuple, group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        b = np.concatenate([np.repeat(unpack(r["b"]), unpack(r["n"])) for r in rows])
        w, c = (np.concatenate([unpack(r[k]) for r in rows]) for k in "wc")
        order = _pair_order(b, w, deal)
        b, w, c = b[order], w[order], c[order]
        new = np.flatnonzero(np.concatenate(([True], (b[1:] != b[:-1]) | (w[1:] != w[:-1]))))
        c = np.add.reduceat(c, new)
        return _pair_row(key[0].as_py(), b[new], w[new], c, np.minimum(c, 1), np.zeros(0, np.int64), deal)

    sent = chunked.select("held", "size", "token", "id").mapInArrow(lean_batches(send), "shard bigint, b binary, n binary, w binary, c binary")
    return scratch.keep(sent.groupBy("shard").applyInArrow(gather, _PAIRS))


def _key(b: np.ndarray, w: np.ndarray, deal: Deal) -> np.ndarray | None:
    """Pairs as one number that sorts alike, if there are few enough words for that."""
    return b.astype(_U) << _U(deal.bits) | w.astype(_U) if 2 * deal.bits <= 64 else None


def _pair_order(b: np.ndarray, w: np.ndarray, deal: Deal) -> np.ndarray:
    key = _key(b, w, deal)
    return np.lexsort((w, b)) if key is None else np.argsort(key)


def _places(b: np.ndarray, w: np.ndarray, ask_b: np.ndarray, ask_w: np.ndarray, deal: Deal) -> np.ndarray:
    """Where sorted pairs hold those asked for, which are among them."""
    key = _key(b, w, deal)
    if key is not None:
        return np.searchsorted(key, _key(ask_b, ask_w, deal))
    both = np.lexsort((np.repeat([0, 1], [len(b), len(ask_b)]), np.append(w, ask_w), np.append(b, ask_b)))
    own = both < len(b)
    out = np.empty(len(ask_b), np.int64)
    out[both[~own] - len(b)] = (np.cumsum(own) - 1)[~own]
    return out


class Sums:
    """Customers and tables of hot contexts."""

    def __init__(self, pairs: DataFrame):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [np.concatenate([np.zeros(0, np.int64), *map(unpack, batch.column(n).to_pylist())]) for n in ("hot_b", "hot_c", "hot_t")]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["b", "c", "t"])

        rows = pairs.select("hot_b", "hot_c", "hot_t").mapInArrow(lean_batches(each), "b bigint, c bigint, t bigint")
        got = rows.groupBy("b").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).orderBy("b").toArrow()  # at most HOT_WORDS + 1 rows
        self.b, self.c, self.t = (got.column(n).to_numpy() for n in "bct")

    def of(self, b: np.ndarray, c: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of each pair's context, given all of a shard's pairs."""
        first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        run, own = np.diff(np.append(first, len(b))), b[first]
        held, tables = np.add.reduceat(c, first), np.add.reduceat(t, first)
        if len(self.b):
            at = np.minimum(np.searchsorted(self.b, own), len(self.b) - 1)
            hot = self.b[at] == own
            held[hot], tables[hot] = self.c[at[hot]], self.t[at[hot]]
        return np.repeat(held, run), np.repeat(tables, run)


def chance(c: np.ndarray, t: np.ndarray, held: np.ndarray, tables: np.ndarray, up: np.ndarray, discount: float) -> np.ndarray:
    """Probability of words in their contexts, given theirs in the parent."""
    return (np.maximum(c - discount * t, 0) + (CONTEXT_STRENGTH + discount * tables) * up) / (CONTEXT_STRENGTH + held)


def discount_of(rows: DataFrame) -> float:
    """A restaurant's discount, from how many dishes have one customer and how many two."""
    ones, twos = (x or 0 for x in rows.agg(F.sum("ones"), F.sum("twos")).first())
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


class Words:
    """The restaurant without context and its parent of letters, as the sampler goes on."""

    def __init__(self) -> None:
        self.letters, self.sweep, self.state, self.discount = Letters(), 0, None, 0.5

    @staticmethod
    def _draw(block: dict, state: dict, discount: float) -> tuple[np.ndarray, np.ndarray]:
        """Tables of each word in the sweep after a state, and codes of its letters."""
        codes, start = spelled(np.frombuffer(block["spelled"], np.uint8), unpack(block["letters"]))
        count = unpack(block["c"])
        if state["tables"] is None:  # each word starts with one table
            return np.minimum(count, 1), codes
        spelling = Words._spelling(codes, start, state)
        keys = mix(np.frombuffer(block["h"], "<u8") + _U(state["sweep"] + 1))
        return seat(count, (WORD_STRENGTH + discount * state["tables"]) * spelling, discount, stirling(discount), keys), codes

    @staticmethod
    def _spelling(codes: np.ndarray, start: np.ndarray, state: dict) -> np.ndarray:
        return np.exp(np.add.reduceat(log_letters(state)[codes].astype(np.float64), start))

    def train(self, words_: DataFrame, sweeps: int) -> None:
        """Sweeps over blocks of words (h, letters, spelled, c customers, ones, twos)."""
        sc = words_.sparkSession.sparkContext
        self.discount = discount = discount_of(words_)
        self.customers = words_.agg(F.sum("held")).first()[0] or 0
        state = self.state or {"sweep": 0, "tables": None, "seats": self.letters.seats}
        for _ in range(sweeps):
            self.sweep += 1
            sent = sc.broadcast(state)

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                cells, sums, opened = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
                for b in batches:
                    for block in b.to_pylist():
                        tables, codes = Words._draw(block, sent.value, discount)
                        own, which = grouped(codes, (CLASSES**DEPTH * SYMBOLS).bit_length())
                        cells.append(own.astype(np.int64))
                        sums.append(np.bincount(which, weights=np.repeat(tables, unpack(block["letters"]) + 1)).astype(np.int64))
                        opened += int(tables.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.append(np.concatenate(cells), -1)), pa.array(np.append(np.concatenate(sums), opened))], names=["code", "n"])

            cells = words_.select("h", "letters", "spelled", "c").mapInArrow(lean_batches(run), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
            got = cells.orderBy("code").toArrow()  # at most CLASSES ** DEPTH * SYMBOLS + 1 rows
            codes, counts = got.column("code").to_numpy(), got.column("n").to_numpy()
            sent.destroy()
            self.letters.sweep(codes[codes >= 0], counts[codes >= 0], self.sweep)
            before = {k: v for k, v in state.items() if k != "before"}
            state = {"sweep": self.sweep, "tables": float(counts[codes < 0].sum()), "seats": self.letters.seats, "before": before}
        self.state = state

    def rated(self, words_: DataFrame) -> DataFrame:
        """ws and up, each word's probability without context, from the seats of the last sweep; words without customers are the
        unknown one. What it reads goes with sent, which can be destroyed once the result is written."""
        sent = self.sent = words_.sparkSession.sparkContext.broadcast(self.state)
        discount, customers = self.discount, self.customers

        def spelled_by(block: dict) -> np.ndarray:
            codes, start = spelled(np.frombuffer(block["spelled"], np.uint8), unpack(block["letters"]))
            return Words._spelling(codes, start, sent.value)

        def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = sum(float(spelled_by(block)[unpack(block["c"]) > 0].sum()) for b in batches for block in b.to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.float64())], names=["p"])

        held = words_.select("letters", "spelled", "c").mapInArrow(lean_batches(known), "p double")
        unknown = max(1.0 - (held.agg(F.sum("p")).first()[0] or 0.0), 1e-6)

        def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for block in b.to_pylist():
                    state, count = sent.value, unpack(block["c"])
                    tables, _ = Words._draw(block, state["before"], discount)
                    p = np.where(count > 0, spelled_by(block), unknown)
                    own = np.maximum(count - discount * tables, 0)
                    up = (own + (WORD_STRENGTH + discount * state["tables"]) * p) / (WORD_STRENGTH + customers)
                    out.append((block["ws"], up.astype("<f8").tobytes()))
                yield batch_of([("ws", LONG), ("up", BINARY)], out)

        return words_.select("ws", "h", "letters", "spelled", "c").mapInArrow(lean_batches(rate), "ws bigint, up binary")


def _parents(pairs: DataFrame, blocks: DataFrame, offsets: np.ndarray, model: Words, scratch: Scratch) -> DataFrame:
    """Sends pairs' tables to the restaurant without context, goes on with its sampler, and gives each shard (shard, ws, up) the
    probabilities of its words back, in the order of their numbers."""
    shards = len(offsets) - 1
    schema = [("ws", LONG), ("shard", LONG), ("rank", BINARY), ("k", BINARY)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, w, t in zip(*(batch.column(n).to_pylist() for n in ("shard", "w", "t")), strict=True):
                w, which = grouped(unpack(w), int(offsets[-1]).bit_length())
                w, k = w.astype(np.int64), np.bincount(which, weights=unpack(t), minlength=len(w)).astype(np.int64)
                limits = np.searchsorted(w, offsets)
                yield batch_of(schema, [(ws, shard, pack(w[s:e] - offsets[ws]), pack(k[s:e])) for ws, (s, e) in enumerate(zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)) if s < e])

    sent = scratch.keep(pairs.select("shard", "w", "t").mapInArrow(lean_batches(send), "ws bigint, shard bigint, rank binary, k binary"))

    def customers(key: tuple, group: pa.Table) -> pa.Table:
        ws = key[0].as_py()
        c = np.zeros(offsets[ws + 1] - offsets[ws], np.int64)
        for r in group.select(["rank", "k"]).to_pylist():
            c[unpack(r["rank"])] += unpack(r["k"])
        return pa.Table.from_batches([batch_of([("ws", LONG), ("c", BINARY), ("held", LONG), ("ones", LONG), ("twos", LONG)], [(ws, pack(c), int(c.sum()), int((c == 1).sum()), int((c == 2).sum()))])])

    seated = sent.groupBy("ws").applyInArrow(customers, "ws bigint, c binary, held bigint, ones bigint, twos bigint")
    words_ = scratch.keep(blocks.select("ws", "h", "letters", "spelled").join(seated, "ws"))
    model.train(words_, FIRST_WORD_SWEEPS if model.state is None else WORD_SWEEPS)

    def answer(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        up = np.frombuffer(right.column("up")[0].as_py(), "<f8")
        out = [(r["shard"], r["ws"], up[unpack(r["rank"])].tobytes()) for r in left.select(["shard", "ws", "rank"]).to_pylist()]
        return pa.Table.from_batches([batch_of([("shard", LONG), ("ws", LONG), ("up", BINARY)], out)])

    rated = model.rated(words_)
    out = scratch.keep(sent.select("ws", "shard", "rank").groupBy("ws").cogroup(rated.groupBy("ws")).applyInArrow(answer, "shard bigint, ws bigint, up binary"))
    model.sent.destroy()
    scratch.drop(sent, words_)
    return out


def _opened(left: pa.Table) -> tuple[np.ndarray, ...]:
    """A shard's pairs: b, w, c, t and the tables of the sweep before."""
    row = left.to_pylist()[0]
    return np.repeat(unpack(row["b"]), unpack(row["n"])), *(unpack(row[k]) for k in "wcts")


def _ups(w: np.ndarray, rows: list[dict]) -> np.ndarray:
    """The parent's probability of each w of a shard."""
    up = np.concatenate([np.frombuffer(r["up"], "<f8") for r in sorted(rows, key=lambda r: r["ws"])])
    return up[np.searchsorted(np.unique(w), w)]


def _redrawn(pairs: DataFrame, ups: DataFrame, sums: Broadcast, deal: Deal, discount: float, sweep: int, scratch: Scratch) -> DataFrame:
    """Pairs with tables drawn anew."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        b, w, c, t, _ = _opened(left)
        _, tables = sums.value.of(b, c, t)
        keys = mix(mix(b.astype(_U) + _U(sweep << 40)) + w.astype(_U))
        drawn = seat(c, (CONTEXT_STRENGTH + discount * tables) * _ups(w, right.select(["ws", "up"]).to_pylist()), discount, stirling(discount), keys)
        return _pair_row(key[0].as_py(), b, w, c, drawn, t, deal)

    return scratch.keep(pairs.groupBy("shard").cogroup(ups.groupBy("shard")).applyInArrow(run, _PAIRS))


def _answers(pairs: DataFrame, ups: list[DataFrame], sums: list[Broadcast], chunked: DataFrame, deal: Deal, discount: float, scratch: Scratch) -> list[DataFrame]:
    """cid, shard and p: for each chunk and shard the logarithms of the probabilities of the chunk's pairs, in their order, averaged
    over the last states; ups and sums are those of each state, the last one last. Shards are asked in PASSES turns, a table each, as
    the questions take more room than all else."""
    schema = [("shard", LONG), ("state", LONG), ("ws", LONG), ("up", BINARY), ("cid", LONG), ("b", BINARY), ("n", BINARY), ("w", BINARY)]

    def ask(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, size, token, ids in zip(*(batch.column(n).to_pylist() for n in ("cid", "size", "token", "id")), strict=True):
                b, w, limits, _ = deal.pairs(np.asarray(size), unpack(token), unpack(ids))
                yield batch_of(schema, [(k, None, None, None, cid, *_runs(b[s:e]), pack(w[s:e])) for k, (s, e) in enumerate(zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)) if s < e and k % PASSES == turn])

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        isup = right.column("ws").is_valid()
        b, w, c, *tables = _opened(left)
        told = right.select(["state", "ws", "up"]).filter(isup).to_pylist()
        p = np.zeros(len(b))
        for k, (t, sent) in enumerate(zip(tables[len(sums) - 1 :: -1], sums, strict=True)):
            p += chance(c, t, *sent.value.of(b, c, t), _ups(w, [r for r in told if r["state"] == k]), discount)
        p = np.log10(p / len(sums)).astype("<f4")
        shard, out = key[0].as_py(), []
        for r in right.select(["cid", "b", "n", "w"]).filter(pc.invert(isup)).to_pylist():
            ask_b, ask_w = np.repeat(unpack(r["b"]), unpack(r["n"])), unpack(r["w"])
            out.append((r["cid"], shard, p[_places(b, w, ask_b, ask_w, deal)].tobytes()))
        return pa.Table.from_batches([batch_of([("cid", LONG), ("shard", LONG), ("p", BINARY)], out)])

    ddl = "shard bigint, state bigint, ws bigint, up binary, cid bigint, b binary, n binary, w binary"
    none = [F.lit(None).cast(t).alias(c) for c, t in (("cid", "bigint"), ("b", "binary"), ("n", "binary"), ("w", "binary"))]
    out = []
    for turn in range(PASSES):
        asked = chunked.select("cid", "size", "token", "id").mapInArrow(lean_batches(lambda batches, turn=turn: ask(batches, turn)), ddl)
        for k, frame in enumerate(ups):
            asked = asked.unionByName(frame.where(F.col("shard") % PASSES == turn).select("shard", F.lit(k).cast("bigint").alias("state"), "ws", "up", *none))
        own = pairs.where(F.col("shard") % PASSES == turn)
        out.append(scratch.keep(own.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(run, "cid bigint, shard bigint, p binary")))
    return out


def query(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs.

    Null, empty and blank texts are one end token. A null doc_id counts as an empty one and is held out. Repeated rows
    are trained on and scored as often as they stand. Without training texts every word is spelled by uniform letters.
    No rows give no rows. Other columns are not looked at. Texts are read whole.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "language-model")
    small_batches(spark)
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_id}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    own = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", held_out(F.col("doc_id")).alias("held"), "text")
    ddl = f"cid bigint, doc_id array<{doc_id}>, held array<boolean>, size array<bigint>, token binary, rank binary, h binary, c binary, letters binary, spelled binary"
    read = scratch.keep(own.mapInArrow(lean_batches(_chunk), ddl))
    sizes = read.select(F.aggregate("size", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"), F.size("size").alias("d"))
    tokens, n_docs = sizes.agg(F.sum("n"), F.sum("d")).first()
    if not tokens:
        return spark.createDataFrame([], schema)
    with few_rows(spark):
        word_shards, pair_shards = (max(least, -(-tokens // each)) for least, each in ((WORD_SHARDS, WORD_TOKENS), (PAIR_SHARDS, PAIR_TOKENS)))
        words_ = vocabulary(read, word_shards, scratch)
        blocks = scratch.keep(words_.where("cid IS NULL").drop("cid"))
        counted = {r.ws: r for r in blocks.select("ws", "v", "types", "tokens").collect()}  # a row a shard
        offsets = np.concatenate(([0], np.cumsum([counted[k].v if k in counted else 0 for k in range(word_shards)])))
        n, v, start = sum(r.tokens for r in counted.values()), sum(r.types for r in counted.values()), int(offsets[-1])
        chunked = _numbered(read, words_, offsets, n, v, scratch)
        most = max(HOT, tokens // HOT_WORDS)

        def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [offsets[ws] + np.flatnonzero(unpack(c) > most) for ws, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], names=["id"])

        hot = np.sort(blocks.select("ws", "c").mapInArrow(lean_batches(frequent), "id bigint").toArrow().column(0).to_numpy())  # at most HOT_WORDS
        deal = Deal(start, np.append(hot, start) if n_docs > most else hot, pair_shards)
        scratch.drop(read, words_)
        pairs = _first_seats(chunked, deal, scratch)
        discount, model = discount_of(pairs), Words()
        ups, sums = [], []  # of the states that are kept, the last one last
        for sweep in range(SWEEPS + 1):
            ups.append(_parents(pairs, blocks, offsets, model, scratch))
            sums.append(spark.sparkContext.broadcast(Sums(pairs)))  # at most HOT_WORDS + 1 rows
            if sweep < SWEEPS:
                following = _redrawn(pairs, ups[-1], sums[-1], deal, discount, sweep, scratch)
                scratch.drop(pairs)
                pairs = following
            while len(ups) > KEPT:
                scratch.drop(ups.pop(0))
                sums.pop(0)
        answers = _answers(pairs, ups, sums, chunked, deal, discount, scratch)
        scratch.drop(pairs, blocks, *ups)
        answered = answers[0]
        for more in answers[1:]:
            answered = answered.unionByName(more)

        def scored(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            size, token, ids = np.asarray(left.column("size")[0].as_py()), *(unpack(left.column(c)[0].as_py()) for c in ("token", "id"))
            got = sorted((r["shard"], r["p"]) for r in right.select(["shard", "p"]).to_pylist())
            p = np.concatenate([np.frombuffer(x, "<f4") for _, x in got]).astype(np.float64)
            score = np.add.reduceat(p[deal.pairs(size, token, ids)[3]], np.cumsum(size) - size)
            flat = lambda c: left.column(c).combine_chunks().flatten()
            columns = [flat("doc_id"), flat("held"), flat("size"), flat("known"), pa.array(np.full(len(size), n), pa.int64()), flat("base"), pa.array(score)]
            return pa.Table.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        return chunked.groupBy("cid").cogroup(answered.groupBy("cid")).applyInArrow(scored, schema)
