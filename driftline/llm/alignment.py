"""Alignment of the tokens of two tokenizers by bytes, over distinct segments.

Texts are split before runs of blanks. The split is safe if no piece of either vocabulary holds a blank behind anything else, which is
looked up in the vocabularies themselves: then neither tokenizer has a token across the split, and what stands before it has no
influence on what stands behind. Chunks of documents tell which different segments they hold; Spark makes these distinct over all
chunks, each is tokenised and aligned once, and joins bring the alignments back to the chunks, which compose them along their documents.

A group ends where tokens of both kinds end. As groups end with segments, the links of a document are those of its segments, and so are
the sums of anything that is known of a link: how often a pair of ids is linked is counted once for a chunk's pairs, and added up
by segment and then by document.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, fields
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import cut, lean_batches, pack, release, unpack
from .common import Scratch, batches_of

#: The public tokenizers, parameters of every function here: a byte-level one that sees space+text, and one that adds the space itself.
BYTES, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Segments of a chunk (but a text is never cut), those that are aligned at once, and texts that come from the JVM at once.
CHUNK, AT_ONCE, TEXTS = 1 << 21, 1 << 13, 256
#: Segments whose links and texts are made at once.
SLICE = 1 << 15
#: Rows that a task bundles at most before it sends them to their chunks.
BUNDLE = 1 << 19
#: Characters of alignments that pass to the JVM at once, if they are of more than one document.
OUT = 1 << 23
#: A group with more links than this is counted by its different ids.
LARGE = 1 << 10

_BEHIND = re.compile(r"\s ")
_SPLIT = re.compile(r"(?<=\S)(?= )")
#: A token of an alignment is its id and, from this bit on, what it is: the first of a group or a later one, of the first or second kind.
KIND = 30


class Aligner:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, bytes_path: str, pieces_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.one = Tokenizer.from_file(bytes_path)
        self.one.encode_special_tokens = True
        self.two = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        names = self.one.get_vocab()
        self.first = [b""] * (max(names.values()) + 1)
        letter = _letters(ByteLevel.alphabet())
        for name, k in names.items():
            self.first[k] = bytes(letter[c] for c in name) if all(c in letter for c in name) else name.encode()
        special = {k for k in self.one.get_added_tokens_decoder()}
        self.second = [self._piece(k) for k in range(self.two.get_piece_size())]
        self.separable = not any(_crossing(b) for k, b in enumerate(self.first) if k not in special) and not any(map(_crossing, self.second))
        self.blank = [self.two.piece_to_id("▁")]  # of a lone space at a text's end: no text gets no space added
        self.sizes = tuple(np.array([len(b) for b in table], np.int64) for table in (self.first, self.second))

    def _piece(self, k: int) -> bytes:
        name = self.two.id_to_piece(k)
        return bytes([int(name[3:-1], 16)]) if self.two.is_byte(k) else name.replace("▁", " ").encode()

    def segments(self, text: str) -> list[str]:
        """Segments of space+text without the space that each begins with."""
        if not self.separable:
            return [text]
        if not _BEHIND.search(" " + text):  # no blank stands before a space
            return text.split(" ")
        return [s[1:] for s in _SPLIT.split(" " + text)]

    def tokens(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both kinds of each segment."""
        one = [e.ids for e in self.one.encode_batch_fast([" " + s for s in segments], add_special_tokens=False)]
        return one, [ids or self.blank for ids in self.two.encode(segments, num_threads=1)]

    def whole(self, ids: list[int], table: list[bytes], segment: str) -> bool:
        return b"".join([table[k] for k in ids]) == b" " + segment.encode()

    def align(self, segments: list[str]) -> list[bytes]:
        """The tokens of each segment, group by group, as 32-bit numbers; none where either kind's bytes aren't the segment's."""
        one, two = self.tokens(segments)
        good = [self.whole(a, self.first, s) and self.whole(b, self.second, s) for s, a, b in zip(segments, one, two, strict=True)]
        ids, ends, owner = [], [], []
        for table, size in ((one, self.sizes[0]), (two, self.sizes[1])):
            lists = [x if g else [] for x, g in zip(table, good, strict=True)]
            flat = np.fromiter(chain.from_iterable(lists), np.int64)
            ids.append(flat)
            ends.append(np.cumsum(size[flat]))  # of all segments in a row: the bytes of both kinds are the same
            owner.append(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
        both = np.intersect1d(ends[0], ends[1])
        group = [np.searchsorted(both, e) for e in ends]
        kind = [np.where(np.diff(g, prepend=-1) > 0, k, k + 1) for g, k in zip(group, (0, 2), strict=True)]
        codes = np.concatenate([i | k << KIND for i, k in zip(ids, kind, strict=True)])
        order = np.lexsort((np.concatenate(kind) >> 1, np.concatenate(group)))
        data = codes[order].astype("<u4").tobytes()
        limits = 4 * np.searchsorted(np.concatenate(owner)[order], np.arange(len(segments) + 1))
        return [data[a:b] for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)]


def _letters(alphabet: list[str]) -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, and those beyond 255 for
    the other bytes in order."""
    own = {c: ord(c) for c in alphabet if ord(c) < 256}
    others = sorted(set(range(256)) - set(own.values()))
    return own | dict(zip(sorted(c for c in alphabet if ord(c) > 255), others, strict=True))


def _crossing(token: bytes) -> bool:
    """Whether a space stands behind anything but a blank."""
    text = token.decode("utf-8", "surrogateescape")
    return re.search(r"\S ", text) is not None


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(*paths: str) -> Aligner:
    """This worker's tokenizers, made once for their files."""
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


@dataclass
class Links:
    """Segments by number: whether they are aligned, their counts, and their links as distinct codes with how often each occurs."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    owner: np.ndarray
    code: np.ndarray
    weight: np.ndarray

    @property
    def broken(self) -> np.ndarray:
        return self.n_groups == 0


def _counts(owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, minlength=n)


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, slice, slice]]:
    """Some segments at a time, so that memory holds the intermediate arrays of few: the first one, the segments, and their tokens."""
    limits = np.append(0, np.cumsum(sizes)).tolist()
    for a in range(0, len(sizes), SLICE):
        b = min(a + SLICE, len(sizes))
        yield a, slice(a, b), slice(limits[a], limits[b])


def links(tokens: np.ndarray, sizes: np.ndarray) -> Links:
    """Links of segments, given their tokens in a row and how many tokens each has. A link's code is its first id << 32 | its second."""
    parts = [_links(tokens[within].astype(np.int64), sizes[some], first) for first, some, within in _slices(sizes)] or [_links(np.zeros(0, np.int64), sizes, 0)]
    return Links(*(np.concatenate([getattr(x, f.name) for x in parts]) for f in fields(Links)))


def _links(tokens: np.ndarray, sizes: np.ndarray, at: int) -> Links:
    n = len(sizes)
    segment = np.repeat(np.arange(n), sizes)
    kind, ids = tokens >> KIND, tokens & ((1 << KIND) - 1)
    group = np.cumsum(kind == 0) - 1
    first = kind < 2
    a, b = ids[first], ids[~first]
    groups = int(group[-1]) + 1 if len(group) else 0
    of_a, per_a, per_b = group[first], _counts(group[first], groups), _counts(group[~first], groups)
    owner = segment[kind == 0]  # of each group
    many = per_a * per_b
    begins_b = np.cumsum(per_b) - per_b
    times = np.where(many > LARGE, 0, per_b)[of_a]
    which = np.repeat(np.arange(len(a)), times)
    other = begins_b[of_a[which]] + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    parts = [(owner[of_a[which]], a[which] << 32 | b[other], np.ones(len(which), np.int64))]
    begins_a = np.cumsum(per_a) - per_a
    for g in np.flatnonzero(many > LARGE).tolist():
        ia, na = np.unique(a[begins_a[g] : begins_a[g] + per_a[g]], return_counts=True)
        ib, nb = np.unique(b[begins_b[g] : begins_b[g] + per_b[g]], return_counts=True)
        parts.append((np.full(len(ia) * len(ib), owner[g]), (ia[:, None] << 32 | ib[None]).reshape(-1), np.multiply.outer(na, nb).reshape(-1)))
    held = [np.concatenate(x) for x in zip(*parts, strict=True)]
    total = np.zeros(n, np.int64)
    np.add.at(total, owner, many)
    return Links(_counts(segment[first], n), _counts(segment[~first], n), _counts(owner, n), total, (held[0] + at).astype(np.int32), held[1], held[2])


def group_texts(tokens: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Each segment's groups as text: ids in decimal, those of a kind with commas, kinds with a bar, groups with semicolons."""
    return [text for _, some, within in _slices(sizes) for text in _group_texts(tokens[within].astype(np.int64), sizes[some])]


def _group_texts(tokens: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    signs = np.frombuffer(b";,|,", np.uint8)
    kind, ids = tokens >> KIND, tokens & ((1 << KIND) - 1)
    names, which = np.unique(ids, return_inverse=True)
    decimal = [b"%d" % k for k in names.tolist()]
    letters, length = np.frombuffer(b"".join(decimal), np.uint8), np.array([len(x) for x in decimal], np.int64)
    size = length[which] + 1
    data = np.empty(int(size.sum()), np.uint8)
    start = np.cumsum(size) - size
    held = np.ones(len(data), bool)
    held[start] = False
    data[start] = signs[kind]
    data[held] = cut(letters, length, which)
    raw = data.tobytes()
    limits = np.append(start, len(raw))[np.append(0, np.cumsum(sizes))].tolist()
    return [raw[x + 1 : y] for x, y in zip(limits[:-1], limits[1:], strict=True)]  # without the sign before the first


def _by_document(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over documents of what each of their segments has, in a row."""
    sums, limits = np.append(0, np.cumsum(values)), np.append(0, np.cumsum(sizes))
    return sums[limits[1:]] - sums[limits[:-1]]


def _documents_of_pairs(held: Links, pair: np.ndarray, n_pairs: int, sizes: np.ndarray, which: np.ndarray, good: np.ndarray) -> np.ndarray:
    """In how many documents each pair is linked."""
    order = np.argsort(held.owner, kind="stable")
    pair, per = pair[order], _counts(held.owner, len(held.n_a))
    begins = np.cumsum(per) - per
    out = np.zeros(n_pairs, np.int64)
    limits = np.append(0, np.cumsum(sizes))
    at = 0
    while at < len(sizes):  # some documents at a time
        upto = max(at + 1, int(np.searchsorted(limits, limits[at] + (1 << 18), "right")) - 1)
        own = np.repeat(np.arange(upto - at), sizes[at:upto])
        keep = good[at:upto][own]
        n = len(held.n_a)
        different = np.unique(own[keep] * n + which[limits[at] : limits[upto]][keep])
        document, segment = different // n, different % n
        times = per[segment]
        found = pair[np.repeat(begins[segment] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
        out += _counts(np.unique(np.repeat(document, times) * n_pairs + found) % n_pairs, n_pairs) if n_pairs else 0
        at = upto
    return out


def align(docs: DataFrame, bytes_path: str = BYTES, pieces_path: str = PIECES) -> DataFrame:
    """For each row of docs doc_id, n_a and n_b tokens of either kind, n_groups, n_links, n_best (links whose pair is linked in as many
    documents as any pair of its first id), count_sum (documents of the pairs of all links) and groups, the alignment as text.

    Null and empty texts have no tokens, nor have texts of which either kind doesn't give back the bytes, such as those with U+2581. Their
    counts are 0 and their groups ''. Texts are taken whole. A null doc_id is carried through, repeated rows are documents of their own;
    no rows give no rows; other columns are not looked at. Executors need the tokenizers' files at the paths.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "alignment")
    paths = (bytes_path, pieces_path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, part, chunk = aligner(*paths).segments, TaskContext.get().partitionId(), 0
        known: defaultdict = defaultdict(count().__next__)
        ids, sizes, which = [], [], []

        def made() -> pa.RecordBatch:
            names = ["cid", "doc_id", "sizes", "which", "segments"]
            columns = [pa.array([part << 32 | chunk]), pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.concat_arrays(ids)), pa.array([pack(np.array(sizes, np.int64))]), pa.array([pack(np.array(which, np.int64))])]
            return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), pa.array(list(known), pa.string()))], names=names)

        for batch in batches:
            first = 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = segments(text) if text else []
                sizes.append(len(found))
                which.extend(map(known.__getitem__, found))
                if len(which) >= CHUNK:
                    ids.append(batch.column("doc_id").slice(first, i + 1 - first))
                    yield made()
                    known = defaultdict(count().__next__)
                    ids, sizes, which, first, chunk = [], [], [], i + 1, chunk + 1
            if first < batch.num_rows:
                ids.append(batch.column("doc_id").slice(first))
        if sizes:
            yield made()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = aligner(*paths).align
        for batch in batches:
            segments = batch.column("segment").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("segment"), pa.array(run(segments), pa.binary())], names=["segment", "tokens"])

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Alignments that go to the same chunk as one row: arrays instead of rows are what is shuffled."""
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BUNDLE:
                yield from bundled(held)
                held, rows = [], 0
        if rows:
            yield from bundled(held)

    def bundled(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).sort_by("asked")
        chunk, tokens = table.column("asked").to_numpy(), table.column("tokens").to_pylist()
        place, size = table.column("place").to_numpy(), np.array([len(t) // 4 for t in tokens], np.int64)
        edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            numbers = np.frombuffer(b"".join(tokens[a:b]), "<u4")
            row = [int(chunk[a]), pack(place[a:b]), pack(size[a:b]), pack(numbers)]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["asked", "places", "size", "tokens"])

    def gather(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of a chunk's segments in a row, how many each has, and of which segments its documents consist."""
        rows = right.to_pylist()
        place, size = (np.concatenate([unpack(r[c]) for r in rows] or [np.zeros(0, np.int64)]) for c in ("places", "size"))
        tokens = np.concatenate([unpack(r["tokens"]).astype(np.uint32) for r in rows] or [np.zeros(0, np.uint32)])
        order = np.argsort(place)
        start = (np.cumsum(size) - size)[order]
        size = size[order]
        tokens = tokens[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        return tokens, size, unpack(left.column("sizes")[0].as_py()), unpack(left.column("which")[0].as_py())

    def counted(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        tokens, size, sizes, which = gather(left, right)
        held = links(tokens, size)
        codes, pair = np.unique(held.code, return_inverse=True)
        good = _by_document(held.broken[which].astype(np.int64), sizes) == 0
        documents = _documents_of_pairs(held, pair, len(codes), sizes, which, good)
        used = documents > 0
        row = [left.column("cid")[0].as_py(), pack(tokens), pack(size), codes[used], documents[used]]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        out = pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["cid", "tokens", "size", "pairs", "documents"])
        release()
        return out

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield from composed({name: batch.column(name)[row] for name in batch.schema.names})

    def composed(chunk: dict[str, pa.Scalar]) -> Iterator[pa.RecordBatch]:
        sizes, which, size, tokens = (unpack(chunk[c].as_py()) for c in ("sizes", "which", "size", "tokens"))
        tokens = tokens.astype(np.uint32)
        held = links(tokens, size)
        good = (_by_document(held.broken[which].astype(np.int64), sizes) == 0) & (sizes > 0)
        codes, documents, best = (chunk[c].values.to_numpy(zero_copy_only=False) if chunk[c].is_valid else np.zeros(0, np.int64) for c in ("pair", "n", "best"))
        order = np.argsort(codes)
        codes, documents, best = codes[order], documents[order], best[order]
        at = np.minimum(np.searchsorted(codes, held.code), max(0, len(codes) - 1))
        there = codes[at] == held.code if len(codes) else np.zeros(len(held.code), bool)  # not those of broken documents alone
        by_segment = [held.n_a, held.n_b, held.n_groups, held.n_links]
        for value in (best.astype(np.int64), documents):
            total = np.zeros(len(size), np.int64)
            np.add.at(total, held.owner[there], held.weight[there] * value[at[there]])
            by_segment.append(total)
        sums = [np.where(good, _by_document(x[which], sizes), 0) for x in by_segment]
        texts, limits = group_texts(tokens, size), np.append(0, np.cumsum(sizes)).tolist()
        ids = chunk["doc_id"].values
        begin, groups, letters = 0, [], 0
        for i, fine in enumerate(good.tolist()):
            groups.append(b";".join([texts[k] for k in which[limits[i] : limits[i + 1]].tolist()]) if fine else b"")
            letters += len(groups[-1])
            if letters >= OUT or i + 1 == len(sizes):
                columns = [ids.slice(begin, i + 1 - begin), *(pa.array(s[begin : i + 1]) for s in sums), pa.array(groups, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *NUMBERS, "groups"])
                begin, groups, letters = i + 1, [], 0

    with batches_of(spark, TEXTS):
        chunks = scratch.keep(docs.select("doc_id", "text").mapInArrow(lean_batches(read), f"cid bigint, doc_id array<{kind}>, sizes binary, which binary, segments array<string>"), compression="zstd")
    with batches_of(spark, AT_ONCE):
        different = chunks.select(F.explode("segments").alias("segment")).distinct()
        aligned = scratch.keep(different.mapInArrow(lean_batches(each), "segment string, tokens binary"), compression="zstd")
        asked = chunks.select(F.col("cid").alias("asked"), F.posexplode("segments").alias("place", "segment"))
        told = asked.join(aligned, "segment").select("asked", "place", "tokens")
        bundles = scratch.keep(told.mapInArrow(lean_batches(bundle), "asked bigint, places binary, size binary, tokens binary"), compression="zstd")
        scratch.drop(aligned)
        found = scratch.keep(
            chunks.select("cid", "sizes", "which").groupBy("cid").cogroup(bundles.groupBy("asked")).applyInArrow(counted, "cid bigint, tokens binary, size binary, pairs array<bigint>, documents array<bigint>"),
            compression="zstd",
        )
    scratch.drop(bundles)
    pairs = found.select("cid", F.explode(F.arrays_zip("pairs", "documents")).alias("x")).select("cid", F.col("x.pairs").alias("pair"), F.col("x.documents").alias("n"))
    total = scratch.keep(pairs.groupBy("pair").agg(F.sum("n").alias("n")))
    a = F.shiftright("pair", 32).alias("a")
    most = total.groupBy(a).agg(F.max("n").alias("most"))
    known = total.select("pair", "n", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    # a chunk has its own pairs alone, of which there are fewer than links in it
    back = pairs.select("cid", "pair").join(known, "pair").groupBy("cid").agg(F.collect_list(F.struct("pair", "n", "best")).alias("x"))
    whole = chunks.select("cid", "doc_id", "sizes", "which").join(found.select("cid", "tokens", "size"), "cid")
    joined = whole.join(back.select("cid", "x.pair", "x.n", "x.best"), "cid", "left").drop("cid")
    return joined.mapInArrow(lean_batches(compose), f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in NUMBERS) + ", groups string")


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def digest(groups: Column) -> Column:
    return F.when(groups == "", F.lit("")).otherwise(F.sha2(groups, 256))


def query(docs: DataFrame) -> DataFrame:
    return align(docs).select("doc_id", *NUMBERS, digest(F.col("groups")).alias("groups_sha256"))
