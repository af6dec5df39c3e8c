"""N-gram Jaccard join by signature trees.

1. Each text becomes the set of its k-word shingles (64-bit hashes). Equal sets become one class.
2. Candidate clusters, without loss: if Jaccard(A, B) >= t, the sets differ in at most
   d = floor(|A| * (1 - t) / t) shingles for the smaller set A, so if shingles are dealt by hash
   into more than d parts, one part at least is equal in both. Each class is filed under its parts.
   Shingles that are frequent in the corpus (a fixed-size counting sketch over all documents tells)
   share one part, which is not filed: a common passage alone brings nothing together. Sets of
   mostly frequent shingles are filed by their first shingles besides, the frequent ones last.
   Classes filed together meet in a signature tree of their bitmaps, and those whose largest possible
   overlap is enough are joined to clusters (connected components on Spark).
3. Sets under a key of more than CHUNK_SETS are filed again by their rarest shingles, rarity being
   counted exactly among these sets: what they share beside a common passage brings them together.
4. A cluster of bounded size becomes one signature tree whose nodes hold the OR of their sets' token
   bitmaps and their size range. A dual traversal drops the node pairs whose largest possible overlap
   is too small, or that are linked already; what is left at the leaves is counted exactly.
5. Larger clusters are ordered by a min-hash and cut into chunks, by rounds with other min-hashes (one
   set per component goes on); then every pair of chunks that may hold a link between two components
   is traversed, so that no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from recjobs.functions.storage import materialize
from recjobs.llm.components import connected_components, hot_limit, split_join
from recjobs.llm.textvec import mix, shingles, slices

_U = np.uint64
SKETCH_BITS = 20  # counters of the frequency sketch: its size doesn't grow with the corpus
HEAVY_TIMES = 8.0  # a counter this many times the mean holds a frequent shingle
SKETCH_GROUPS = 8  # partial sums of the sketch, before the last one
CHUNK_SETS = 512
CHUNK_TOKENS = 400_000
FILED_ONCE = 20_000
PAIR_TIMES = 4  # chunks that are met pair by pair are so many times larger, as each travels to many
ROUNDS = 3
FILTER_BITS = 26  # of the filter of ids whose texts are read again (8 MB), at most
_FILTER_SALTS = np.array([0x8CB92BA72F3D8DD7, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)
FANOUT = 8


# ---------------------------------------------------------------- signatures


def _sketch(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """Which of the 2**SKETCH_BITS counters of shingle document counts stand out, as a bitmap."""
    size, block = 1 << SKETCH_BITS, 1 << 14

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, found, held = np.zeros(size, np.int64), [], 0
        for batch in batches:
            for part in slices(batch):
                for u in shingles(part.column(0), k):
                    found.append((u >> _U(64 - SKETCH_BITS)).astype(np.int32))
                    held += len(u)
                if held > size:
                    counts += np.bincount(np.concatenate(found), minlength=size)
                    found, held = [], 0
        if found:
            counts += np.bincount(np.concatenate(found), minlength=size)
        at = np.arange(0, size, block)
        group = TaskContext.get().partitionId() % SKETCH_GROUPS
        yield pa.RecordBatch.from_arrays([pa.array([group] * len(at), pa.int32()), pa.array(at // block, pa.int32()), pa.array([counts[i : i + block].tobytes() for i in at], pa.binary())], names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for g, b, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                sums[g, b] = sums.get((g, b), 0) + np.frombuffer(c, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], names)

    names, schema = ["group", "block", "counts"], "group int, block int, counts binary"
    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, schema).repartition("group", "block").mapInArrow(add, schema)
    rows = rows.withColumn("group", F.lit(0)).repartition("block").mapInArrow(add, schema)
    counts = np.zeros(size, np.int64)
    for row in rows.toLocalIterator():  # 2**SKETCH_BITS counters, whatever the corpus
        counts[row.block * block : (row.block + 1) * block] = np.frombuffer(row.counts, np.int64)
    return np.packbits(counts > np.maximum(HEAVY_TIMES * counts.mean(), 16))


class Parts:
    """How sets are dealt into parts, by size level. Levels grow by half; a set is also filed at every
    lower level that a partner may have."""

    def __init__(self, threshold: Fraction):
        self.t = threshold
        self.floors = [1]
        while self.floors[-1] < 1 << 40:
            self.floors.append(max(self.floors[-1] + 1, math.ceil(self.floors[-1] * 1.5)))

    def levels(self, n: int) -> list[int]:
        least, most = np.searchsorted(self.floors, [max(1, math.ceil(self.t * n)), n], side="right") - 1
        return list(range(int(least), int(most) + 1))

    def differing(self, level: int) -> int:
        smaller = self.floors[level + 1] - 1
        return math.floor(smaller * (1 - self.t) / self.t)

    def keys(self, m: np.ndarray, heavy: np.ndarray) -> np.ndarray:
        """Keys under which a set (of mixed hashes) is filed: two sets that are similar enough share
        one at least."""
        out, few = [np.empty(0, _U)], False
        light = m[~heavy] if heavy.any() else m
        for level in self.levels(len(m)):
            d = self.differing(level)
            if d < 1:  # only equal sets
                continue
            spare = 1 + d // 6  # parts that may be empty
            # one more part holds all frequent shingles: it may differ, so d + 1 + spare others do
            keys, empty = self._filed(light, d + 1 + spare, level)
            out.append(keys)
            few |= empty > spare
        if few:  # meets others of this kind by its first shingles, the frequent ones last
            out.append(self._prefix(m, heavy))
        return np.concatenate(out)

    def _prefix(self, m: np.ndarray, heavy: np.ndarray) -> np.ndarray:
        """Similar sets share one of their first shingles in any common order (prefix filter)."""
        first = np.lexsort((m, heavy))[: len(m) - math.ceil(self.t * len(m)) + 1]
        return mix(m[first] ^ _U(0x9E3779B97F4A7C15))

    @staticmethod
    def _filed(m: np.ndarray, parts: int, salt: int) -> tuple[np.ndarray, int]:
        if not len(m):
            return np.empty(0, _U), parts
        part = ((m >> _U(32)) * _U(parts) >> _U(32)).astype(np.uint16 if parts < 1 << 16 else np.int64)
        order = np.argsort(part, kind="stable")
        part = part[order]
        at = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
        sums = np.add.reduceat(m[order], at)
        return mix(sums ^ mix(part[at].astype(_U) * _U(1024) + _U(salt))), parts - len(at)


def _mixed(u: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The shingles mixed, and two fingerprints of their set."""
    m = mix(u ^ _U(0x5851F42D4C957F2D))
    xor = np.bitwise_xor.reduce(m) if len(m) else _U(0)
    return m, int(m.sum(dtype=_U).astype(np.int64)), int(xor.astype(np.int64))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_shingles, fp1, fp2, bitmap)``; fp1 and fp2 tell equal sets."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ns, f1, f2, maps = [], [], [], []
                for u in shingles(part.column(1), k):
                    _, one, two = _mixed(u)
                    ns.append(len(u))
                    f1.append(one)
                    f2.append(two)
                    maps.append(_bitmap(u, 1 << min(12, max(8, (2 * len(u)).bit_length()))).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in (ns, f1, f2)), pa.array(maps, pa.binary())], ["doc_id", "n_shingles", "fp1", "fp2", "bitmap"])

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, fp1 long, fp2 long, bitmap binary")


def _filed(docs: DataFrame, k: int, t: Fraction, heavy_bits: np.ndarray, copied: dict[tuple[int, int], int]) -> DataFrame:
    """``(key, doc_id)``: the keys that each document is filed under. Of the sets in ``copied``, which
    very many documents have, only the one named is filed."""
    parts = Parts(t)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = np.unpackbits(heavy_bits).astype(bool)
        for batch in batches:
            for part in slices(batch):
                ids, held, keys = part.column(0).to_numpy(), [], [np.empty(0, _U)]
                for doc, u in zip(ids.tolist(), shingles(part.column(1), k)):
                    m, one, two = _mixed(u)
                    filed = len(u) and copied.get((one, two), doc) == doc
                    keys.append(parts.keys(m, heavy[(u >> _U(64 - SKETCH_BITS)).astype(np.int64)]) if filed else keys[0])
                    held.append(len(keys[-1]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(ids, held))], ["key", "doc_id"])

    return docs.filter("doc_id is not null").mapInArrow(file, "key long, doc_id long")


# ---------------------------------------------------------------- the tree


def _need(t: Fraction, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least overlap of sets of these sizes: overlap >= t * union."""
    p, q = t.numerator, t.numerator + t.denominator
    return -((-p * (a.astype(np.int64) + b.astype(np.int64))) // q)


def _bitmap(u: np.ndarray, bits: int) -> np.ndarray:
    bit = mix(u ^ _U(0x2545F4914F6CDD1D)) & _U(bits - 1)
    on = np.zeros(bits, np.uint8)
    on[bit.astype(np.int64)] = 1
    return np.packbits(on, bitorder="little").view(_U)


def _folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The same set's bitmap of fewer bits."""
    while len(bitmap) > words:
        bitmap = bitmap[: len(bitmap) // 2] | bitmap[len(bitmap) // 2 :]
    return bitmap


class SignatureTree:
    """Sets, similar sizes next to each other, under nodes with OR-ed bitmaps and size ranges.

    Without ``sets`` the tree can tell what may be linked, but not count."""

    def __init__(self, maps: np.ndarray, size: np.ndarray, sets: list[np.ndarray] | None = None):
        self.sets = sets
        slack = size - np.bitwise_count(maps).sum(1, dtype=np.int64)  # shingles that share a bit
        self.levels = [(maps, size, size, slack)]
        while len(self.levels[-1][1]) > 1:
            maps, lo, hi, slack = self.levels[-1]
            at = np.arange(0, len(lo), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(slack, at)))

    @classmethod
    def of_sets(cls, sets: list[np.ndarray], bits: int) -> SignatureTree:
        return cls(np.stack([_bitmap(u, bits) for u in sets]), np.array([len(u) for u in sets], np.int64), sets)


def _possible(t: Fraction, x: tuple, i: np.ndarray, y: tuple, j: np.ndarray) -> np.ndarray:
    """Which node pairs may hold a pair of sets with enough overlap."""
    keep = np.zeros(len(i), bool)
    for a in range(0, len(i), 4096):
        s, p, q = slice(a, a + 4096), i[a : a + 4096], j[a : a + 4096]
        shared = np.bitwise_count(x[0][p] & y[0][q]).sum(1, dtype=np.int64)
        most = np.minimum(np.minimum(x[2][p], y[2][q]), shared + np.minimum(x[3][p], y[3][q]))
        # sizes a <= b can only reach t if a >= t * b
        lo, hi = np.maximum(x[1][p], y[1][q]), np.minimum(x[2][p], y[2][q])
        keep[s] = (most >= _need(t, x[1][p], y[1][q])) & (hi * t.denominator >= lo * t.numerator)
    return keep


def dual_traversal(t: Fraction, left: SignatureTree, right: SignatureTree, group: np.ndarray, shift: int) -> Iterator[tuple[int, int]]:
    """Linked pairs (index in left, index in right), enough of them to connect what is linked.

    ``group`` is a union-find forest over left's sets and, from ``shift`` on, right's; a pair that is
    connected already is not looked at. ``left is right`` joins a tree with itself.
    """
    same = left is right
    i, j = _leaf_pairs(t, left, right)

    def root(v: int) -> int:
        while group[v] != v:
            group[v] = group[group[v]]
            v = group[v]
        return v

    for a, b in zip(i.tolist(), j.tolist()):
        if same and a == b or (ra := root(a)) == (rb := root(b + shift)):
            continue
        if left.sets is None:
            group[max(ra, rb)] = min(ra, rb)
            yield a, b
            continue
        u, v = left.sets[a], right.sets[b]
        both = len(np.intersect1d(u, v, assume_unique=True))
        if both * t.denominator >= t.numerator * (len(u) + len(v) - both):
            group[max(ra, rb)] = min(ra, rb)
            yield a, b


def _leaf_pairs(t: Fraction, left: SignatureTree, right: SignatureTree) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves that may be linked: both trees are gone down together, level by level."""
    same = left is right
    top = max(len(left.levels), len(right.levels)) - 1
    i = j = np.zeros(1, np.int64)
    for level in range(top, -1, -1):
        x, y = left.levels[min(level, len(left.levels) - 1)], right.levels[min(level, len(right.levels) - 1)]
        if level < top:
            grow_i, grow_j = level < len(left.levels) - 1, level < len(right.levels) - 1
            step = np.arange(FANOUT)
            ii = (i[:, None] * FANOUT + step) if grow_i else i[:, None]
            jj = (j[:, None] * FANOUT + step) if grow_j else j[:, None]
            i, j = np.repeat(ii, jj.shape[1], 1).ravel(), np.tile(jj, (1, ii.shape[1])).ravel()
            keep = (i < len(x[1])) & (j < len(y[1]))
            if same:
                keep &= i <= j
            i, j = i[keep], j[keep]
        keep = _possible(t, x, i, y, j)
        i, j = i[keep], j[keep]

    return i, j


def _bits(sets: list[np.ndarray]) -> int:
    return 1 << min(14, max(9, (4 * max(map(len, sets), default=1) - 1).bit_length()))


def _ordered(ids: np.ndarray, tokens: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    sets = [np.frombuffer(x, _U) for x in tokens]
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0]) if len(sets[i]) else 0))
    return ids[order], [sets[i] for i in order]


def _join_chunk(t: Fraction, ids: np.ndarray, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each set that is linked within its chunk, with the least set of its component there."""
    ids, sets = _ordered(ids, tokens)
    tree, group = SignatureTree.of_sets(sets, _bits(sets)), np.arange(len(sets))
    for _ in dual_traversal(t, tree, tree, group, 0):
        pass
    for i in range(len(group)):  # parents come before their children
        group[i] = group[group[i]]
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, group, ids)
    root = least[group]
    return ids[ids != root], root[ids != root]


def _join_chunks(sets: DataFrame, t: Fraction) -> DataFrame:
    """``(a, b)``: star edges of the components within chunks of ``sets(cluster, set_id, tokens)``: the
    rows come in order, and a chunk ends with its cluster or its bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, tokens, size = None, [], [], 0

        def joined() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1:
                a, b = _join_chunk(t, np.array(ids, np.int64), tokens)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for now, set_id, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if now != key or len(ids) == CHUNK_SETS or ids and size + len(data) > 8 * CHUNK_TOKENS:
                    yield from joined()
                    key, ids, tokens, size = now, [], [], 0
                ids.append(set_id)
                tokens.append(data)
                size += len(data)
        yield from joined()

    return materialize(sets.select("cluster", "set_id", "tokens").mapInArrow(run, "a long, b long"), "links")


def _join_two(t: Fraction):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [pdf[pdf["side"] == s] for s in (0, 1)]
        sides = [_ordered(p["set_id"].to_numpy(), list(p["tokens"])) for p in parts]
        component = dict(zip(pdf["set_id"], pdf["component"]))
        ids = np.concatenate([sides[0][0], sides[1][0]])
        first: dict[int, int] = {}
        group = np.array([first.setdefault(component[x], n) for n, x in enumerate(ids)], np.int64)
        bits = _bits(sides[0][1] + sides[1][1])
        left, right = SignatureTree.of_sets(sides[0][1], bits), SignatureTree.of_sets(sides[1][1], bits)
        pairs = list(dual_traversal(t, left, right, group, len(sides[0][0])))
        return pd.DataFrame({"a": [component[sides[0][0][i]] for i, _ in pairs], "b": [component[sides[1][0][j]] for _, j in pairs]}, dtype="int64")

    return run


# ---------------------------------------------------------------- the join


def _candidates(met: DataFrame, t: Fraction, chain: bool) -> DataFrame:
    """Edges ``(a, b)`` that connect all sets that may be linked, from ``met(key, set_id, n_shingles,
    bitmap)``: of those filed under one key, the ones whose bitmaps leave room for enough overlap. Of
    more than CHUNK_SETS under one key, each is connected to one (``chain``), or named with a null b."""

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, many = None, [], False

        def joined() -> Iterator[pa.RecordBatch]:
            if len(rows) < 2 and not many:
                return
            if many:
                a, b = np.array([r[0] for r in rows]), np.full(len(rows), rows[0][0])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b) if chain else pa.nulls(len(a), pa.int64())], ["a", "b"])
                return
            rows.sort(key=lambda r: (r[1], r[0]))
            ids, maps = np.array([r[0] for r in rows]), [np.frombuffer(r[2], _U) for r in rows]
            words = min(map(len, maps))
            tree = SignatureTree(np.stack([_folded(m, words) for m in maps]), np.array([r[1] for r in rows], np.int64))
            pairs = list(dual_traversal(t, tree, tree, np.arange(len(rows)), 0))
            if pairs:
                a, b = ids[[p[0] for p in pairs]], ids[[p[1] for p in pairs]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

        for batch in batches:
            for now, *row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if now != key:
                    yield from joined()
                    key, rows, many = now, [], False
                if rows and rows[-1][0] == row[0] and rows[-1][2] == row[2]:  # copies
                    continue
                rows.append(row)
                if len(rows) > CHUNK_SETS:  # of so many, part by part
                    many = True
                    yield from joined()
                    rows = rows[:1]
        yield from joined()

    ordered = met.select("key", "set_id", "n_shingles", "bitmap").repartition("key").sortWithinPartitions("key", "set_id")
    return ordered.mapInArrow(connect, "a long, b long").filter("b is null or a > b").distinct()


def _several(filed: DataFrame) -> DataFrame:
    """The rows of keys that have more than one."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key = held_id = np.empty(0, np.int64)
        told = False  # whether the last row of the batch before is out already
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([held_key, batch.column(0).to_numpy()])
            ids = np.concatenate([held_id, batch.column(1).to_numpy()])
            same = keys[1:] == keys[:-1]
            keep = np.zeros(len(keys), bool)
            keep[1:] |= same
            keep[:-1] |= same
            told_now = bool(keep[-1])
            if len(held_key) and told:
                keep[0] = False
            held_key, held_id, told = keys[-1:], ids[-1:], told_now
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(ids[keep])], ["key", "set_id"])

    return filed.repartition("key").sortWithinPartitions("key").mapInArrow(shared, "key long, set_id long")


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each id in a filter of so many."""
    return (mix(ids.view(_U)[:, None] ^ _FILTER_SALTS) & _U(bits - 1)).astype(np.int64)


def _id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of ``ids(set_id)`` as a bitmap of at most 2**FILTER_BITS bits."""
    bits = 1 << min(FILTER_BITS, max(10, (16 * ids.count()).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(batch.column(0).to_numpy(), bits).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((_U(1) << (at & 63).astype(_U)).view(np.int64))], ["word", "bit"])

    words = ids.select("set_id").mapInArrow(place, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("held")).toArrow()
    found = np.zeros(bits >> 6, _U)
    found[words["word"].to_numpy()] = words["held"].to_numpy().view(_U)
    return found


def _sets(docs: DataFrame, named: DataFrame, k: int) -> DataFrame:
    """``named(set_id, ...)`` with the shingles of each document of that id: its columns, ``n_shingles,
    tokens, near``, the last being a min-hash for each round.

    No text travels: a filter of the ids, whose size is bounded, tells tasks which texts may be named,
    and an exact join of their shingles follows."""
    held = _id_filter(named)
    salts = [_U(0xA0761D6478BD642F * (r + 1) & (1 << 64) - 1) for r in range(ROUNDS)]

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(batch.column(0).to_numpy(), 64 * len(held))
            may = (held[at >> 6] >> (at & 63).astype(_U) & _U(1)).all(1)
            for part in slices(batch.filter(pa.array(may))):
                found = list(shingles(part.column(1), k))
                near = [[int(mix(u ^ s).min().astype(np.int64)) if len(u) else 0 for s in salts] for u in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, found), pa.int64()), pa.array([u.tobytes() for u in found], pa.binary()), pa.array(near, pa.list_(pa.int64()))], ["set_id", "n_shingles", "tokens", "near"])

    found = docs.filter("doc_id is not null").mapInArrow(tokens, "set_id long, n_shingles long, tokens binary, near array<long>").filter("n_shingles > 0")
    # a sort-merge join at every size: what is named grows with the corpus, so it is never broadcast
    return found.join(named.hint("merge"), "set_id")


def _refiled(docs: DataFrame, sets: DataFrame, k: int, t: Fraction) -> DataFrame:
    """``(key, set_id)``: the sets named filed again, each by its rarest shingles (how many of these
    sets hold a shingle is counted exactly); shingles that only one of them holds bring nothing together."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x, _U) for x in batch.column(1).to_pylist()]
            n = np.array([len(u) for u in found], np.int64)
            marks = np.array([_mixed(u)[1] for u in found], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, _U), *found]).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(np.repeat(marks, n)), pa.array(np.repeat(n, n))], ["shingle", "set_id", "mark", "n"])

    rows = materialize(_sets(docs, sets, k).select("set_id", "tokens").mapInArrow(cells, "shingle long, set_id long, mark long, n long").distinct(), "cells")
    held = materialize(rows.groupBy("shingle").agg(F.count("*").alias("n_rows")).filter("n_rows > 1"), "held")
    rare = split_join(rows, held.withColumn("n_sets", F.col("n_rows")), ["shingle"], hot_limit(rows.count()))
    first = rare.groupBy("set_id", "mark").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("n_sets", "shingle"))).alias("shared"))
    # of the whole set's first shingles, those that it shares with others
    take = F.expr(f"cast(size(shared) - (n * {t.numerator} + {t.denominator - 1}) div {t.denominator} + 1 as int)")
    return first.withColumn("take", take).filter("take > 0").select(F.explode(F.slice("shared", 1, F.col("take"))).alias("x"), "set_id").select(F.col("x.shingle").alias("key"), "set_id").distinct()


def ngram_jaccard_join(docs: DataFrame, k: int = 5, threshold: float | Fraction = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose k-word shingle sets have a Jaccard similarity of ``threshold``.

    Returns ``(doc_id, n_shingles, component_id, set_id)`` for each row: the size of the set, the least
    id reachable by links, the least id with an equal set. Null, empty and blank texts have no shingle
    and are linked with nothing (their own id); a text of fewer than k words has one shingle. Rows that
    repeat an id are one document: what is linked with one of its texts is linked with all. Rows
    without an id are linked with nothing, their component is null. Other columns, whatever their
    names, are ignored. An empty table gives no rows.
    """
    t = Fraction(threshold).limit_denominator(10_000)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(signatures(source, k), "signatures")
    limit = hot_limit(signed.count())
    equal = ["fp1", "fp2", "n_shingles"]
    classes = signed.filter("n_shingles > 0 and doc_id is not null").groupBy(*equal).agg(F.min("doc_id").alias("set_id"), F.count("*").alias("n_rows"))
    classes = materialize(classes, "classes")
    # of sets of many copies (at most FILED_ONCE sets) one document alone is filed; copies of the others go later
    often = classes.filter(F.col("n_rows") > F.lit(max(8, signed.count() // FILED_ONCE)))
    copied = {(r.fp1, r.fp2): r.set_id for r in often.collect()}
    alone = signed.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("set_id"))
    signed = materialize(split_join(signed.filter("n_shingles > 0 and doc_id is not null"), classes, equal, limit).select("doc_id", "n_shingles", "set_id", "bitmap"), "signed")

    bitmaps = signed.filter("doc_id = set_id").select("set_id", "n_shingles", "bitmap")

    def met(filed: DataFrame) -> DataFrame:
        return _several(filed.select("key", "set_id")).join(bitmaps.hint("merge"), "set_id").select("key", "set_id", "n_shingles", "bitmap")

    filed = _several(_filed(source, k, t, _sketch(source, "text", k), copied).withColumnRenamed("doc_id", "set_id"))
    # copies of a set are one: what its documents are filed under counts once
    filed = filed.withColumnRenamed("set_id", "doc_id").join(signed.select("doc_id", "set_id").hint("merge"), "doc_id").select("key", "set_id").distinct()
    edges = materialize(_candidates(met(filed), t, chain=False), "candidates")
    large = materialize(edges.filter("b is null").select(F.col("a").alias("set_id")).distinct(), "large")
    edges = edges.filter("b is not null")
    if not large.isEmpty():
        edges = edges.unionByName(materialize(_candidates(met(_refiled(source, large, k, t)), t, chain=True), "candidates"))
    clusters = connected_components(edges).select(F.col("node").alias("set_id"), F.col("component").alias("cluster"))

    members = materialize(_sets(source, clusters, k), "members")

    # clusters of one chunk are done at once
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n_rows"), (F.count("*") > CHUNK_SETS).alias("many"), (F.sum("n_shingles") > CHUNK_TOKENS).alias("long"))
    sizes = materialize(sizes.select("cluster", "n_rows", F.expr("many or long").alias("large")), "sizes")
    sized = split_join(members, sizes, ["cluster"], hot_limit(members.count()))
    links = _join_chunks(sized.filter("not large").repartition("cluster").sortWithinPartitions("cluster"), t)
    if not sizes.filter("large").isEmpty():
        links = links.unionByName(_join_large(materialize(sized.filter("large"), "large"), t))
    # rows of one id are one document
    ids = signed.select("doc_id", "set_id").distinct()
    several = ids.groupBy("doc_id").agg(F.min("set_id").alias("b"), F.max("set_id").alias("most")).filter("b < most").select("doc_id", "b")
    same = ids.join(several, "doc_id").select(F.col("set_id").alias("a"), "b")
    joined = connected_components(links.unionByName(same)).select(F.col("node").alias("set_id"), F.col("component").alias("component_id"))
    found = signed.groupBy("set_id").agg(F.count("*").alias("n_rows")).join(joined, "set_id", "left").select("set_id", "n_rows", F.coalesce("component_id", "set_id").alias("component_id"))
    linked = split_join(signed.select("doc_id", "n_shingles", "set_id"), materialize(found, "found"), ["set_id"], limit)
    return linked.select("doc_id", "n_shingles", "component_id", "set_id").unionByName(alone)


def _join_large(members: DataFrame, t: Fraction) -> DataFrame:
    """Links ``(a, b)`` that connect what is linked within clusters of many sets."""
    active, links, n = members, None, members.count()
    # one set of each component goes on to chunks in another order, while that helps
    for r in range(ROUNDS):
        order = ["cluster", F.get("near", F.lit(r)), "set_id"]
        found = _join_chunks(active.repartitionByRange(*order).sortWithinPartitions(*order), t)
        links = found if links is None else links.unionByName(found)
        active = materialize(active.join(found.select(F.col("a").alias("set_id")), "set_id", "left_anti"), "representatives")
        n, before = active.count(), n
        if n > 0.9 * before:
            break
    component = materialize(connected_components(links).filter("node > component").select(F.col("node").alias("set_id"), "component"), "components")
    return links.unionByName(_across(members, component, t))


def _across(members: DataFrame, component: DataFrame, t: Fraction) -> DataFrame:
    """Links ``(a, b)`` of components, between chunks of a cluster that are not all of one yet.

    Large components have chunks of their own, and two chunks of one component are not compared; the
    other sets are dealt by size, and chunks whose sizes can't reach the threshold aren't compared.
    """
    limit = hot_limit(members.count())
    sets = members.select("cluster", "set_id", "n_shingles", "tokens").join(component, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    own = sets.groupBy("cluster", "component").agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") >= CHUNK_SETS).withColumn("own", F.lit(True))
    sets = split_join(sets, materialize(own, "own"), ["cluster", "component"], limit, "left")
    level = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(max(float(1 / t), 1.1)))
    part = F.when(F.col("own"), F.concat(F.lit("own "), F.col("component"))).otherwise(F.concat(F.lit("size "), level))
    sets = materialize(sets.select("cluster", part.alias("part"), "set_id", "component", "n_shingles", "tokens"), "parted")
    by = ["cluster", "part"]
    many = sets.groupBy(*by).agg(F.count("*").alias("n_rows"), F.sum("n_shingles").alias("n_tokens"))
    chunks = F.greatest(F.ceil(F.col("n_rows") / (PAIR_TIMES * CHUNK_SETS)), F.ceil(F.col("n_tokens") / (PAIR_TIMES * CHUNK_TOKENS)), F.lit(1)).cast("long")
    sets = split_join(sets, materialize(many.select(*by, "n_rows", chunks.alias("chunks")), "chunks"), by, limit)
    sets = materialize(sets.withColumn("chunk", F.pmod(F.xxhash64("set_id", F.lit(7)), "chunks")), "parts")
    chunk = sets.groupBy("cluster", "part", "chunk").agg(F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi"))
    x, y = (chunk.select("cluster", *(F.col(c).alias(c + s) for c in ("part", "chunk", "lo", "hi"))) for s in "xy")
    fits = (F.col("hix") * t.denominator >= F.col("loy") * t.numerator) & (F.col("hiy") * t.denominator >= F.col("lox") * t.numerator)
    pairs = x.join(y, "cluster").filter("(partx < party or partx = party and partx like 'size%' and chunkx <= chunky)").filter(fits)
    keys = ["cluster", "partx", "chunkx", "party", "chunky"]
    pairs, rows = materialize(pairs.select(*keys), "pairs"), None
    for side, s in enumerate("xy"):
        own = sets.select("cluster", F.col("part").alias("part" + s), F.col("chunk").alias("chunk" + s), "set_id", "component", "tokens")
        own = pairs.join(own, ["cluster", "part" + s, "chunk" + s]).select(*keys, F.lit(side).alias("side"), "set_id", "component", "tokens")
        rows = own if rows is None else rows.unionByName(own)
    return materialize(rows.groupBy(*keys).applyInPandas(_join_two(t), "a long, b long"), "links")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 2), ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS whole FROM sh GROUP BY doc_id
), links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN sizes k ON k.doc_id = p.a JOIN sizes m ON m.doc_id = p.b WHERE 100 * shared >= 90 * (k.n + m.n - shared)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT w.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, c.component_id,
  CASE WHEN s.n IS NULL THEN w.doc_id ELSE min(w.doc_id) OVER (PARTITION BY s.whole) END AS set_id
FROM w LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""
