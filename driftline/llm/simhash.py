"""SimHash near-duplicates by exact tiled comparison.

Distinct fingerprints, not documents, are compared, so that any number of copies costs one row. A tile holds the
fingerprints that have the same population counts in their four 16-bit quarters. Two fingerprints within the radius
have counts that differ by no more than the radius in all, so tile pairs beyond it are skipped; the others are compared
whole with exclusive-or and bit counts. Large tiles are split into parts of TILE_ROWS and every pair of parts is
compared, so that no task holds more than a bounded number of rows whatever a tile holds.

keep_one() is for near copies in general: five-word shingles at a similarity of 0.8 or more. Fingerprints of four words that
count each different shingle once give candidates, within a radius that pairs of that similarity hardly ever exceed; their tiles
are classes of length. Candidates' groups are then compared by their shingle sets, and a link only counts if these have the
similarity: of the smaller set's shingles the other has four fifths or more, and it has four fifths or more of the other's number. (By
what both have over what either has, a text in which one word of thirty is another falls to 0.7, far below what a reader takes for
a near copy.) Groups of any size are cut into parts of
bounded rows and words, and every pair of parts is compared.

A pair of parts doesn't give its links, which grow with the square of a group, but a star for each of its connected
groups: at most one edge a row. Joining the stars gives the same components as all links would.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import STEPS, hashed_words, mix, rolled
from .common import Scratch, components, small_batches

SHINGLE, RADIUS, SEED = 3, 2, 42
TILE_ROWS = 2048
#: For near copies: shingle, similarity, words of fingerprint, how many of these are compared for all pairs and the radius in them,
#: the radius in all of them, and rows of a tile part. A pair at the similarity differs in 52 of 256 bits on average, deviation 6.5
#: (26 of 128, 4.6), and in 63, deviation 6.9 (32 of 128, 4.9), if its sizes differ as much as they may; beyond the radii lie at most
#: three in a thousand. A group that is not yet cut has so many rows, a part of one so many rows and words.
NEAR_SHINGLE, SIMILARITY, WIDTH, WHOLE, FIRST_RADIUS, NEAR_RADIUS, NEAR_ROWS = 5, 0.8, 4, 2, 46, 82, 32768
GROUP_SPREAD, GROUP_ROWS, GROUP_WORDS = 64, 4096, 4_000_000
#: Cells of one comparison and hashes counted at once.
CELLS, HASHES = 1 << 20, 1 << 16
QUARTERS = 4


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a whole text: a bit is set if it is set in over half of the shingles' hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[len(words) - n :].tolist()
    count, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, HASHES):
        h = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[at : at + HASHES], ends[at : at + HASHES], strict=True)), "<u8")
        count += _set_bits(h)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def _set_bits(h: np.ndarray) -> np.ndarray:
    """In how many of the hashes each bit is set."""
    return np.add.reduce(np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the different shingles of a text; the whole text is one if it has fewer words, and none if it has no words."""
    h = hashed_words([text.encode("utf-8", "surrogatepass").lower()])[0] if text else np.zeros(0, np.uint64)
    return np.unique(rolled(h, min(NEAR_SHINGLE, len(h)), STEPS[1])) if len(h) else h


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """WIDTH words: bit k of word i is set if it is set in over half of the i-th hashes, each mixed from the one before."""
    out = np.zeros(WIDTH, np.uint64)
    for i in range(WIDTH if len(h) else 0):
        h = mix(h + np.uint64(0x9E3779B97F4A7C15))
        out[i] = np.packbits(2 * _set_bits(h) > len(h), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs and fp, the fingerprint of its text as a signed long. docs' other columns ride along in their order."""
    small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names if n != "text"), pa.array(fp.view(np.int64))], names=[*(n for n in names if n != "text"), "fp"])

    schema = docs.drop("text").schema.add("fp", "long")
    return docs.mapInArrow(run, schema)


def stars(own: int, words: list[np.ndarray], radii: list[int], whole: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Edges, as places, that join the first so many fingerprints with all that are near, a star for each group.

    words hold the fingerprints' first words, second words and so on; near means that the first so many words together differ in no
    more bits than the first radius says, and those up to each further one than the next. Only the first are compared for all pairs.

    Works block by block. Each block's links are mapped to the groups found so far before they are looked at, so only
    links that still join two groups are followed.
    """
    first, size = words[0], len(words[0])
    root = np.arange(size)
    rows = max(1, CELLS // max(1, size))
    for at in range(0, own, rows):
        far = np.bitwise_count(first[at : min(own, at + rows), None] ^ first[None, :])
        for word in words[1:whole]:
            far += np.bitwise_count(word[at : min(own, at + rows), None] ^ word[None, :])
        i, j = np.nonzero(far <= radii[0])
        if len(words) > whole:
            bits = far[i, j].astype(np.int64)
            for word, radius in zip(words[whole:], radii[1:], strict=True):
                bits += np.bitwise_count(word[i + at] ^ word[j])
                near = bits <= radius
                i, j, bits = i[near], j[near], bits[near]
        i, j = root[i + at], root[j]
        new = i != j
        if not new.any():
            continue
        parent: dict[int, int] = {}

        def find(x: int, parent: dict[int, int] = parent) -> int:
            top = x
            while parent.get(top, top) != top:
                top = parent[top]
            while parent.get(x, x) != x:
                parent[x], x = top, parent[x]
            return top

        for a, b in np.unique(np.stack([i[new], j[new]]), axis=1).T.tolist():
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        moved = np.arange(size)
        for x in parent:
            moved[x] = find(x)
        root = moved[root]
    apart = np.flatnonzero(root != np.arange(size))
    return apart, root[apart]


def neighbours(radius: int) -> list[tuple[int, ...]]:
    """Differences of quarter counts that the radius allows, one of each pair of opposite ones, zero first."""
    every = itertools.product(range(-radius, radius + 1), repeat=QUARTERS)
    return sorted(d for d in every if sum(map(abs, d)) <= radius and d >= (0,) * QUARTERS)


def links(nodes: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """Edges a, b between distinct fingerprints (column fp) whose components are those of all links within radius."""
    count = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))).cast("int") for k in range(QUARTERS)]
    code = lambda p: ((p[0] * 17 + p[1]) * 17 + p[2]) * 17 + p[3]
    tiled = nodes.select("fp", code(count).alias("tile"))
    # at most 17 ** 4 = 83,521 rows whatever the corpus holds: small enough to broadcast
    tiles = scratch.keep(tiled.groupBy("tile").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("fp"), F.col("parts").cast("long")).cast("int")
    split = scratch.keep(tiled.join(F.broadcast(tiles), "tile").select("fp", "tile", part.alias("part")))
    quarter = [F.floor(F.col("tile") / 17 ** (QUARTERS - 1 - k)).cast("int") % 17 for k in range(QUARTERS)]
    # of each fingerprint's tile the later ones within the radius, and its own; what joins is no more than the list of tiles
    step = F.explode(F.array(*[F.array(*map(F.lit, d)) for d in neighbours(radius)]))
    moved = [F.col("p")[k] + F.col("d")[k] for k in range(QUARTERS)]
    inside = F.forall(F.array(*moved), lambda x: (x >= 0) & (x <= 16))
    near = split.select("fp", "tile", "part", F.array(*quarter).alias("p"), step.alias("d")).where(inside).select("fp", "tile", "part", code(moved).alias("at"))
    to = tiles.select(F.col("tile").alias("at"), F.col("parts").alias("to_parts"))
    # every part meets itself, later parts of its own tile, and all parts of later tiles within the radius
    own = split.select(F.col("tile").alias("at"), F.col("part").alias("at_part"), "fp", F.lit(True).alias("own"))
    sent = near.join(F.broadcast(to), "at").where("at != tile OR to_parts > 1").withColumn("at_part", F.explode(F.sequence(F.lit(0), F.col("to_parts") - 1)))
    sent = sent.where("at != tile OR at_part > part").select("at", "at_part", "fp", F.lit(False).alias("own"))

    def compare(group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().view(np.uint64)
        mine = group.column("own").to_numpy(zero_copy_only=False).astype(bool)
        fp = np.concatenate([np.sort(fp[mine]), np.sort(fp[~mine])])
        a, b = stars(int(mine.sum()), [fp], [radius])
        return pa.table({"a": pa.array(fp[a].view(np.int64), pa.int64()), "b": pa.array(fp[b].view(np.int64), pa.int64())})

    return own.unionByName(sent).groupBy("at", "at_part").applyInArrow(compare, "a bigint, b bigint")


def grouped(own: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """fp and component_id, the smallest doc_id reachable, for each distinct fp of own (doc_id, fp)."""
    nodes = scratch.keep(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(scratch.keep(links(nodes, radius, scratch)), scratch)
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return scratch.keep(rooted.join(least, "root").select("fp", "component_id"))


def query(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id for each row of docs (doc_id, text).

    Null, empty and blank texts have fingerprint zero, which links like any other. Repeated rows are repeated in the
    result. A null doc_id is carried through; it names a component only if no other member has one, as null. No rows
    give no rows. Other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    own = scratch.keep(fingerprints(docs.select("doc_id", "text"), shingle))
    out = own.join(grouped(own, radius, scratch), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_links(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges a, b between nodes (rid, fp as an array of words, n shingles) that are near copies of each other, as stars."""
    tiled = nodes.select("rid", "fp", F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / F.log(F.lit(1 / SIMILARITY))).cast("int").alias("tile"))
    # one row for each class of length: a few hundred for texts of any size that fits a row
    tiles = scratch.keep(tiled.groupBy("tile").agg(F.ceil(F.count("*") / NEAR_ROWS).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("rid"), F.col("parts").cast("long")).cast("int")
    split = scratch.keep(tiled.join(F.broadcast(tiles), "tile").select("rid", "fp", "tile", part.alias("part")))
    to = tiles.select(F.col("tile").alias("at"), F.col("parts").alias("to_parts"))
    own = split.select(F.col("tile").alias("at"), F.col("part").alias("at_part"), "rid", "fp", F.lit(True).alias("own"))
    near = split.withColumn("at", F.explode(F.array(F.col("tile"), F.col("tile") + 1))).join(F.broadcast(to), "at")
    sent = near.where("at != tile OR to_parts > 1").withColumn("at_part", F.explode(F.sequence(F.lit(0), F.col("to_parts") - 1)))
    sent = sent.where("at != tile OR at_part > part").select("at", "at_part", "rid", "fp", F.lit(False).alias("own"))
    radii = [FIRST_RADIUS, *[NEAR_RADIUS] * (WIDTH - WHOLE)]

    def compare(group: pa.Table) -> pa.Table:
        mine, rid = group.column("own").to_numpy(zero_copy_only=False).astype(bool), group.column("rid").to_numpy()
        order = np.lexsort((rid, ~mine))
        fp = group.column("fp").combine_chunks().values.to_numpy().view(np.uint64).reshape(-1, WIDTH)[order]
        a, b = stars(int(mine.sum()), [np.ascontiguousarray(fp[:, k]) for k in range(WIDTH)], radii, WHOLE)
        rid = rid[order]
        return pa.table({"a": pa.array(rid[a], pa.int64()), "b": pa.array(rid[b], pa.int64())})

    return own.unionByName(sent).groupBy("at", "at_part").applyInArrow(compare, "a bigint, b bigint")


class Sets:
    """Shingle sets of a part of a group, as numbers in a row."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.asarray([len(x) for x in sets], np.int64)
        self.start = np.cumsum(self.size) - self.size
        names, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.held = np.zeros(len(names), bool)

    def alike(self, i: int, j: np.ndarray) -> np.ndarray:
        """Whether set i has the similarity with each of the sets j, which are sorted."""
        own = self.flat[self.start[i] : self.start[i] + self.size[i]]
        self.held[own] = True
        if 4 * len(j) > len(self.size):  # all at once
            both = np.add.reduceat(self.held[self.flat], self.start, dtype=np.int64)[j]
        else:
            size = self.size[j]
            at = np.repeat(self.start[j] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            both = np.add.reduceat(self.held[self.flat[at]], np.cumsum(size) - size, dtype=np.int64)
        self.held[own] = False
        few, many = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
        return (both >= SIMILARITY * few) & (few >= SIMILARITY * many)


def confirmed(own: int, prints: np.ndarray, sets: list[np.ndarray], across: bool) -> list[tuple[int, int]]:
    """Links, as places, that join the first so many rows with each other (or only with the rest, if across) into the groups
    that all pairs within the radius and of the similarity make: at most one a row. A pair that wouldn't join two groups isn't looked at."""
    root, out = np.arange(len(prints)), []
    held = Sets(sets) if sets else None
    for i in range(own):
        j = np.arange(own if across else i + 1, len(prints))
        few, many = np.minimum(held.size[j], held.size[i]), np.maximum(held.size[j], held.size[i])
        j = j[(root[j] != root[i]) & (few >= SIMILARITY * many)]
        bits = np.zeros(len(j), np.int64)
        for k in range(WIDTH):  # bit counts of a row against all that may still be near
            bits += np.bitwise_count(prints[i, k] ^ prints[j, k])
            if k >= WHOLE - 1:
                near = bits <= (FIRST_RADIUS if k < WHOLE else NEAR_RADIUS)
                j, bits = j[near], bits[near]
        if not len(j):
            continue
        j = j[held.alike(i, j)]
        others, first = np.unique(root[j], return_index=True)
        out += [(i, x) for x in j[first].tolist()]
        root[np.isin(root, others)] = root[i]
    return out


def one_row_each(docs: DataFrame, keys: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of docs, as struct row, that keys name by digest of the text and id, each once; copies says how many there are."""
    own = docs.select(F.struct("*").alias("row"), F.md5(F.coalesce("text", F.lit(""))).alias("d"), F.col("doc_id").alias("i"))
    keys = keys.withColumnRenamed("digest", "kd").withColumnRenamed("id", "ki")
    met = own.join(keys.hint("merge"), (F.col("d") == F.col("kd")) & F.col("i").eqNullSafe(F.col("ki"))).drop("d", "i")
    rest = [c for c in keys.columns if c not in ("kd", "ki")]
    if keys.where("copies > 1").isEmpty():
        return met.select("row", *rest)
    # rows alike in all that is looked at: one of each task goes on, so that any number of them can be met
    many = met.where("copies > 1").groupBy("kd", "ki").agg(*[F.first(c).alias(c) for c in ["row", *rest]])
    return met.where("copies = 1").select("row", *rest).unionByName(many.select("row", *rest))


def near_groups(nodes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """node and root for all nodes (rid, digest, id, copies, fp, n) that are near copies of another, by their shingle sets."""
    candidates = components(scratch.keep(near_links(nodes, scratch)), scratch).withColumnRenamed("root", "cand")
    members = scratch.keep(nodes.join(candidates, F.col("rid") == F.col("node")).drop("node"))
    spread = F.ceil(F.sqrt(F.count("*") / GROUP_SPREAD))  # so that both the pairs of parts and what each holds grow with a group's root
    parts = F.greatest(spread, F.ceil(F.count("*") / GROUP_ROWS), F.ceil(F.sum("n") / GROUP_WORDS)).cast("int")
    sizes = scratch.keep(members.groupBy("cand").agg(parts.alias("parts")))
    placed = scratch.keep(members.join(sizes, "cand").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts").cast("long")).cast("int")))
    texts = one_row_each(docs.select("doc_id", "text"), placed.select("digest", "id", "copies", "rid", "fp", "cand", "part", "parts"), scratch)
    # a part meets itself and every other part of its group
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    sent = texts.select("cand", "rid", "fp", "part", F.col("row.text").alias("text"), other)
    sent = sent.select("cand", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "rid", "fp", "part", "text")

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        p, q = key[1].as_py(), key[2].as_py()
        rid, part = group.column("rid").to_numpy(), group.column("part").to_numpy()
        order = np.lexsort((rid, part))
        prints = group.column("fp").combine_chunks().values.to_numpy().view(np.uint64).reshape(-1, WIDTH)[order]
        text, rid = group.column("text"), rid[order]
        sets = [shingle_set(text[i].as_py()) for i in order.tolist()]
        found = confirmed(len(rid) if p == q else int((part == p).sum()), prints, sets, p != q)
        return pa.table({c: pa.array([int(rid[f[k]]) for f in found], pa.int64()) for k, c in enumerate("ab")})

    edges = scratch.keep(sent.groupBy("cand", "p", "q").applyInArrow(compare, "a bigint, b bigint"))
    out = components(edges, scratch)
    scratch.drop(members, sizes, placed)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs (its own columns) that are first in their group of near copies: least doc_id, nulls last, then one
    row of several that are alike in doc_id and text. Groups are those that all links make, directly or through others.

    Null, empty and blank texts are copies of each other. Repeated rows are copies too. No rows give no rows. Other columns ride
    along whatever their names.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "keep-one")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t) for t in b.column("text").to_pylist()]
            words = pa.array(np.asarray([wide_fingerprint(x) for x in sets], np.uint64).reshape(-1).view(np.int64))
            fp = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * WIDTH), words)
            yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("id"), fp, pa.array([len(x) for x in sets], pa.int64())], names=["digest", "id", "fp", "n"])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.md5(F.coalesce("text", F.lit(""))).alias("digest"), F.col("doc_id").alias("id"), "text")
    own = texts.mapInArrow(run, f"digest string, id {doc_id}, fp array<bigint>, n bigint")
    # one node for each distinct text, however many copies there are
    rows = own.groupBy("digest", "id").agg(F.count("*").alias("copies"), F.first("fp").alias("fp"), F.first("n").alias("n"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "digest", "copies")
    nodes = rows.groupBy("digest").agg(F.min(place).alias("least"), F.first("fp").alias("fp"), F.first("n").alias("n"))
    nodes = scratch.keep(nodes.select("least", "fp", "n", F.monotonically_increasing_id().alias("rid")))
    named = nodes.where("n > 0").select("rid", "fp", "n", "least.digest", "least.id", "least.copies")
    roots = near_groups(named, docs, scratch)
    root = F.when(F.col("n") == 0, F.lit(-1)).otherwise(F.coalesce("root", "rid"))
    rooted = nodes.join(roots, F.col("rid") == F.col("node"), "left").select("least", root.alias("root"))
    first = scratch.keep(rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.digest", "least.id", "least.copies"))
    scratch.drop(nodes)
    return one_row_each(docs, first, scratch).select("row.*")
