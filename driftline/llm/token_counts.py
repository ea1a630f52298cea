"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

A text's pre-tokens are its words, each with the mark of a preceding blank. Documents are read in chunks, which send each different
word once to a shard, words that begin alike to the same one. A shard inserts its words in a trie in sorted order, so that of all its
nodes only those on the way to the last word need be held: the forward score of a prefix (that of its best division into pieces) is
computed once, when its node is made, and all pre-tokens that share the prefix share it. A node only has to look at pieces
that end at it, which a second, reversed trie of the vocabulary finds while walking towards the root. A pre-token's token count
stands at its last node, and goes back to the chunks that asked.

Documents are read twice, once for their words and once for their counts; what lies between is a table of a byte for each word
of a chunk. Should the second reading not be that of the first, which a digest of each chunk shows, an error is raised.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BINARY, LONG, batch_of, cut, distinct_words, hashed_spans, lean_batches, mix, pack, read_chunks, unpack, Texts
from .common import Scratch, small_batches

#: The public vocabulary; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Words of a chunk (but a text is never cut), how many shards there are at least (else as many as the session's shuffle partitions),
#: and the first letters that decide which shard a word goes to.
CHUNK_WORDS, SHARDS, LEAD = 1 << 19, 128, 4
#: An unknown character scores so much less than the worst piece, and becomes one token for each of its bytes.
UNKNOWN = 10.0


def pieces(path: str = VOCABULARY) -> dict[str, float]:
    """Pieces and scores. The file orders pieces by use, not by probability; Zipf's law gives the log-probability of the
    piece at each rank. Control, unknown and byte pieces take no part."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    harmonic = sum(1 / (k + 2) for k in range(len(usual)))
    return {model.id_to_piece(i): -math.log((k + 2) * harmonic) for k, i in enumerate(usual)}


class Trie:
    """Forward scores and token counts along the way to the last pre-token; the root is the empty prefix."""

    def __init__(self, scores: dict[str, float]):
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN
        self.single = {p for p in scores if len(p) == 1}
        # the vocabulary read backwards: from a node's last letter towards the root; the score stands under None
        self.back: dict = {}
        for piece, score in scores.items():
            node = self.back
            for letter in reversed(piece):
                node = node.setdefault(letter, {})
            node[None] = score
        self.made = 0
        self.clear()

    def clear(self) -> None:
        self.letters, self.scores, self.counts = [""], [0.0], [0]

    def _grow(self, letter: str) -> None:
        """Adds a node and computes its forward score from its ancestors'. Of equal scores the longest last piece wins."""
        letters, scores = self.letters, self.scores
        best, count = -math.inf, 0
        back, at = self.back.get(letter), len(scores) - 1
        while back is not None:
            own = back.get(None)
            if own is not None and (own := own + scores[at]) >= best:
                best, count = own, self.counts[at] + 1
            back, at = back.get(letters[at]) if at else None, at - 1
        if letter not in self.single and (unknown := scores[-1] + self.unknown) > best:
            best, count = unknown, self.counts[-1] + len(letter.encode("utf-8", "surrogatepass"))
        letters.append(letter)
        scores.append(best)
        self.counts.append(count)
        self.made += 1

    def tokens(self, words: list[str]) -> list[int]:
        """How many tokens the best division of BLANK and each word has; sorted words share all that they can."""
        out, before = [], ""
        for word in words:
            word = BLANK + word
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            for row in (self.letters, self.scores, self.counts):
                del row[same + 1 :]
            for letter in word[same:]:
                self._grow(letter)
            out.append(self.counts[-1])
            before = word
        self.clear()
        return out


_KNOWN: list = []


def _trie(scores: dict[str, float]) -> Trie:
    """This worker's trie; what is read backwards is made once for a vocabulary."""
    if not _KNOWN or _KNOWN[0] is not scores:
        _KNOWN[:] = [scores, Trie(scores)]
    return _KNOWN[1]


def _read(texts: Texts, shards: int) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's name and digest, the place of each different word in the order of shards, shard limits, and for each place of
    the texts which word stands there."""
    first, which = distinct_words(texts.hashes)
    start, size = (np.cumsum(texts.sizes) - texts.sizes)[first], texts.sizes[first]
    lead = np.zeros(len(first), np.uint64)
    for k in range(LEAD):
        long = size > k
        lead[long] = lead[long] << np.uint64(8) | texts.letters[start[long] + k].astype(np.uint64)
    shard = (mix(lead + np.uint64(1)) >> np.uint64(32)).astype(np.int64) * shards >> 32
    order = np.argsort(shard, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    digest = int(np.bitwise_xor.reduce(texts.hashes[first]).view(np.int64)) if len(first) else 0
    limits = np.searchsorted(shard[order], np.arange(shards + 1))
    return texts.column("rid")[0].as_py(), digest, first[order], limits, place[which]


_ASK = [("shard", LONG), ("cid", LONG), ("digest", LONG), ("sizes", BINARY), ("letters", BINARY)]
_ANSWER = [("cid", LONG), ("shard", LONG), ("digest", LONG), ("counts", BINARY)]


def query(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words and n_tokens for each row of docs.

    Null, empty and blank texts have neither; a null doc_id is carried through; repeated rows give repeated rows; no rows
    give no rows; other columns are not looked at. Texts are counted whole. Only the driver reads path; executors get its pieces,
    of which a vocabulary file holds no more than fit in memory.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-counts")
    small_batches(spark)
    scores: Broadcast = spark.sparkContext.broadcast(pieces(path))
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")

    shards = max(SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in read_chunks(batches, CHUNK_WORDS):
            cid, digest, first, limits, _ = _read(texts, shards)
            size, letters = texts.sizes[first], cut(texts.letters, texts.sizes, first)
            ends = np.append(0, np.cumsum(size))
            yield batch_of(_ASK, [(k, cid, digest, pack(size[s:e]), letters[ends[s] : ends[e]].tobytes()) for k, (s, e) in enumerate(zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)) if s < e])

    def answer(key: tuple, group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        sizes = [unpack(r["sizes"]) for r in rows]
        size, data = np.concatenate(sizes), np.frombuffer(b"".join([r["letters"] for r in rows]), np.uint8)
        ends = np.cumsum(size)
        first, which = distinct_words(hashed_spans(data, ends - size, ends))
        words = [data[e - n : e].tobytes().decode("utf-8", "surrogatepass") for e, n in zip(ends[first].tolist(), size[first].tolist(), strict=True)]
        order = sorted(range(len(words)), key=words.__getitem__)
        counts = np.empty(len(words), np.int64)
        counts[order] = _trie(scores.value).tokens([words[i] for i in order])
        told, upto = counts[which], np.cumsum([len(x) for x in sizes]).tolist()
        return pa.Table.from_batches([batch_of(_ANSWER, [(r["cid"], r["shard"], r["digest"], pack(told[s:e])) for r, s, e in zip(rows, [0, *upto], upto)])])

    def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in read_chunks(batches, CHUNK_WORDS):
            cid, digest, _, _, token = _read(texts, shards)
            ids = pa.ListArray.from_arrays(pa.array([0, len(texts.counts)], pa.int32()), texts.column("doc_id"))
            columns = [pa.array([cid], LONG), pa.array([digest], LONG), ids, pa.array([pack(texts.counts)], BINARY), pa.array([pack(token)], BINARY)]
            yield pa.RecordBatch.from_arrays(columns, names=["cid", "digest", "doc_id", "sizes", "token"])

    def total(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ((digest, ids, sizes, token),) = zip(*(left.column(c) for c in ("digest", "doc_id", "sizes", "token")), strict=True)
        token, sizes = unpack(token.as_py()), unpack(sizes.as_py())
        rows = sorted(right.to_pylist(), key=lambda r: r["shard"])
        if {r["digest"] for r in rows} != ({digest.as_py()} if len(token) else set()):
            raise RuntimeError("the documents were not the same when they were read again")
        counts = np.concatenate([np.zeros(0, np.int64), *(unpack(r["counts"]) for r in rows)])
        sums = np.append(0, np.cumsum(counts[token]))
        limits = np.append(0, np.cumsum(sizes))
        return pa.table({"doc_id": ids.values, "n_words": pa.array(sizes), "n_tokens": pa.array(sums[limits[1:]] - sums[limits[:-1]])})

    asked = own.mapInArrow(lean_batches(ask), "shard bigint, cid bigint, digest bigint, sizes binary, letters binary")
    answers = scratch.keep(asked.groupBy("shard").applyInArrow(answer, "cid bigint, shard bigint, digest bigint, counts binary"))
    again = own.mapInArrow(lean_batches(chunk_rows), f"cid bigint, digest bigint, doc_id array<{doc_id}>, sizes binary, token binary")
    return again.groupBy("cid").cogroup(answers.groupBy("cid")).applyInArrow(total, f"doc_id {doc_id}, n_words bigint, n_tokens bigint")
