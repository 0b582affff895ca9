"""N-gram Jaccard join by PartEnum signatures.

Sets of word shingles are put into bands of about equal size. Within a band, a Jaccard similarity of
at least the threshold bounds the number k of elements in which two sets differ. The feature domain
is split by hash into N partitions: sets that differ in k elements agree in N - k partitions at
least. For small k every subset of N - k partitions makes a signature, and one of them is shared.
For larger k a signature is one partition's content; as N - k of the N are shared, one is among the
first k + 1 of each set in any common order (prefix filter), and the order puts partitions last
that are empty or hold only very frequent shingles. No pair above the threshold is lost.

Sets that share a signature make a group, in which equal sets count once. The pairs of a small group
are candidates. A larger group is compared with its hub, and where links leave several components
around a hub, the members outside the largest one are compared with all others, in blocks. So every
two sets that share a signature are compared or already connected. Of the candidates, those whose
sizes or parity sketches prove them too far apart are left out; the others are confirmed on the sets
themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.common import bit_set, bitmap_at, give_back, in_small_batches, marked, may_contain, membership_bitmap, trimming, written
from crosspanel.llm.components import components
from crosspanel.llm.substrings import Words, mixed, slices

#: Largest k for which all subsets of partitions are enumerated.
ENUMERATED = 2
#: Partitions for each signature of the prefix: room for those that come last.
ROOM = 1.5
#: Members of a group that are still compared pair by pair at once.
SMALL = 6
#: Sets that share a signature in one portion of signatures: of more, one goes on for all, marked as
#: the centre of a crowd, and the group counts as a large one wherever the centre comes.
CROWD = 16
#: Signatures of a portion.
PORTION = 1 << 18
#: Tasks whose signatures of one value may meet in one task; with more, they meet in rounds.
FAN = 2048
HEAVY_BITS = 22
#: Documents, and their shingles, of a block in the comparison of what hubs leave open.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19
#: Candidates of one document that are confirmed in one task.
PER_TASK = 256
_SEED = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def bands(threshold: int, largest: int) -> list[tuple[int, int]]:
    """Bounds of the size bands: sets of similar pairs lie in one band or in two neighbours."""
    out, low = [], 1
    while not out or out[-1][1] < largest:
        out.append((low, low * 100 // threshold))
        low = out[-1][1] + 1
    return out


def most_apart(a: int, b: int, threshold: int) -> int:
    """In how many elements two similar sets of sizes up to ``a`` and ``b`` differ at most."""
    return (a + b) * (100 - threshold) // (100 + threshold)


class ShingleSets:
    """The sorted distinct shingle hashes of several texts, one after the other."""

    def __init__(self, texts: list[bytes], size: int) -> None:
        words = Words([t.lower() for t in texts])  # bytes.lower touches A-Z alone
        n = len(words.hash) - size + 1
        if n > 0:
            of = words.of[:n]
            valid = of == words.of[size - 1 :]
            hashes, of = words.mers(size)[valid], of[valid]
        else:
            hashes, of = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        count = np.diff(words.first)
        short = np.flatnonzero((count > 0) & (count < size))
        if len(short):
            alone = [xxhash.xxh3_64_intdigest(b" ".join(texts[i].lower().split())) for i in short]
            hashes, of = np.concatenate([hashes, np.array(alone, dtype=np.uint64)]), np.concatenate([of, short])
        order = np.lexsort((hashes, of))
        hashes, of = hashes[order], of[order]
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])]) if len(of) else np.empty(0, dtype=bool)
        self.hash, self.of = hashes[new], of[new]
        self.first = np.searchsorted(self.of, np.arange(len(texts) + 1))
        self.size = np.diff(self.first)

    def sketches(self) -> pa.ListArray:
        """The parity of each set's elements by hash position, as 64-bit words, a power of two of
        them. Where two of these differ in d bits the sets differ in d elements or more."""
        words = 1 << np.ceil(np.log2(np.maximum(64, self.size) / 64)).astype(np.int64)
        base = np.cumsum(words) - words
        at = 64 * base[self.of] + (mixed(self.hash ^ _SEED[2]) % (64 * words[self.of]).astype(np.uint64)).astype(np.int64)
        odd = np.bincount(at, minlength=64 * int(words.sum())) & 1
        packed = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.append(base, words.sum()), pa.int32()), pa.array(packed))

    def digests(self) -> list[bytes | None]:
        """The 128-bit digest of each set, None of an empty one."""
        raw, cut = self.hash.tobytes(), (8 * self.first).tolist()
        return [xxhash.xxh3_128_digest(raw[a:b]) if a < b else None for a, b in zip(cut[:-1], cut[1:], strict=True)]


def signatures(sets: ShingleSets, which: np.ndarray, threshold: int, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the sets numbered ``which`` and the numbers they are of."""
    out_sig, out_of = [], []
    size = sets.size
    limits = bands(threshold, int(size.max()) if len(size) else 1)
    high = np.array([b for _, b in limits])
    band = np.searchsorted(high, size)
    for step in (0, 1):  # a set meets those of its own band and the next, and those of the one before
        level = band - step
        lvl = np.maximum(level, 0)
        top = high[lvl] * 100 // threshold
        k = (high[lvl] + top) * (100 - threshold) // (100 + threshold)
        joins = which[(size[which] > 0) & (level[which] >= 0) & (size[which] <= top[which])]
        small = joins[k[joins] <= ENUMERATED]
        for i in small.tolist():
            ki = int(k[i])
            h = sets.hash[sets.first[i] : sets.first[i + 1]]
            n = ki + 2 if ki else 1
            part = (mixed(h ^ _SEED[0]) >> np.uint64(32)) % np.uint64(n)
            content = [int(np.add.reduce(mixed(h[part == p] ^ _SEED[1]))) if (part == p).any() else 0 for p in range(n)]
            for subset in combinations(range(n), n - ki):
                raw = repr((int(level[i]), subset, [content[p] for p in subset])).encode()
                out_sig.append(np.array([xxhash.xxh3_64_intdigest(raw)], dtype=np.uint64))
                out_of.append(np.array([i]))
        large = joins[k[joins] > ENUMERATED]
        if not len(large):
            continue
        n = np.ceil(ROOM * (k[large] + 1)).astype(np.int64)
        base = np.cumsum(n) - n
        counts = size[large]
        elem = np.repeat(sets.first[large] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        h = sets.hash[elem]
        own = np.repeat(np.arange(len(large)), counts)
        slot = base[own] + (((mixed(h ^ _SEED[0]) >> np.uint64(32)) * n[own].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        content = np.zeros(int(n.sum()), dtype=np.uint64)
        np.add.at(content, slot, mixed(h ^ _SEED[1]))
        rank = np.full(len(content), 2, dtype=np.int8)  # 2 empty, 1 frequent shingles only, 0 others
        rank[slot] = 1
        at = (h & np.uint64((1 << HEAVY_BITS) - 1)).astype(np.int64)
        rank[slot[~bit_set(heavy, at)]] = 0
        slot_of = np.repeat(np.arange(len(large)), n)
        place, before = np.zeros(len(content), dtype=np.int64), np.zeros(len(large), dtype=np.int64)
        for r in (0, 1, 2):
            hit = rank == r
            upto = np.cumsum(hit)
            start = np.concatenate([[0], upto])[base]
            place[hit] = (upto - 1 - start[slot_of] + before[slot_of])[hit]
            before += np.add.reduceat(hit.astype(np.int64), base)
        chosen = np.flatnonzero(place <= k[large][slot_of])
        j = (chosen - base[slot_of[chosen]]).astype(np.uint64)
        with np.errstate(over="ignore"):
            tag = mixed((level[large][slot_of[chosen]].astype(np.uint64) << np.uint64(32)) + j + _SEED[2])
            out_sig.append(mixed(content[chosen] ^ tag))
        out_of.append(large[slot_of[chosen]])
    if not out_sig:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    return np.concatenate(out_sig), np.concatenate(out_of)


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    if not len(sorted_keys[0]):
        return np.empty(0, dtype=np.int64)
    new = np.ones(len(sorted_keys[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return np.flatnonzero(new)


class Signed:
    """Signatures, one for each row: value, doc_id, digest of the set in 48 bits, and whether it is
    the centre of a crowd. Sorted by value and digest, equal sets once, by their least doc_id."""

    KINDS = (np.uint64, np.int64, np.uint64, np.bool_)
    #: Bytes of each that travel, the lowest ones.
    BYTES = (8, 8, 6, 1)

    def __init__(self, parts: list[tuple[np.ndarray, ...]]) -> None:
        sig, doc, digest, centre = (np.concatenate([np.empty(0, dtype=t), *c]) for t, c in zip(self.KINDS, zip(*parts, strict=True) if parts else [[]] * 4, strict=True))
        order = np.lexsort((doc, digest, sig))
        sig, doc, digest, centre = (c[order] for c in (sig, doc, digest, centre))
        keep = _starts(sig, digest)
        # equal sets are the centre of a crowd if one of them is
        self.centre = np.logical_or.reduceat(centre, keep) if len(keep) else centre
        self.sig, self.doc, self.digest = sig[keep], doc[keep], digest[keep]
        self.begin = _starts(self.sig)
        self.count = np.diff(np.append(self.begin, len(self.sig)))
        self.of_crowd = np.logical_or.reduceat(self.centre, self.begin) if len(self.begin) else np.empty(0, dtype=bool)

    def members(self, rows: np.ndarray) -> pa.RecordBatch:
        """Rows (kind 1, signature, doc_id, digest) of large groups."""
        return _found(np.ones(len(rows)), self.sig[rows].view(np.int64), self.doc[rows], self.digest[rows].view(np.int64))

    def blocks(self, parts: int, salts: int, salt: int, most: int) -> Iterator[pa.RecordBatch]:
        """The members of crowds as rows of kind 1, and all other signatures and the crowds'
        centres packed by part of the signature domain."""
        crowd = np.repeat(self.count > most, self.count)
        if crowd.any():
            yield _packed(self.members(np.flatnonzero(crowd)))
        centre, keep = self.centre.copy(), ~crowd
        lead = self.begin[self.count > most]
        centre[lead] = keep[lead] = True
        columns = [c[keep] for c in (self.sig, self.doc, self.digest, centre)]
        part = (columns[0] >> np.uint64(64 - parts)).astype(np.int64)  # ascending, as the signatures are
        cut = np.searchsorted(part, np.arange((1 << parts) + 1))
        full = np.flatnonzero(np.diff(cut))
        spans = list(zip(cut[full].tolist(), cut[full + 1].tolist(), strict=True))
        arrays = [pa.array(full, pa.int32()), pa.array(np.full(len(full), salt % salts), pa.int32())]
        for c, width in zip(columns, self.BYTES, strict=True):
            raw = c.view(np.uint8).reshape(-1, c.dtype.itemsize)[:, :width]
            # bytes of one place stand together, which shuffles compress well
            arrays.append(pa.array([raw[a:b].T.tobytes() for a, b in spans], pa.binary()))
        yield pa.RecordBatch.from_arrays([*arrays, *[pa.nulls(len(full), t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64())]], names=_BLOCK_NAMES)

    @classmethod
    def unpacked(cls, blobs: list[bytes]) -> tuple[np.ndarray, ...]:
        out = []
        for blob, kind, width in zip(blobs, cls.KINDS, cls.BYTES, strict=True):
            raw = np.frombuffer(blob, dtype=np.uint8).reshape(width, -1).T
            held = np.zeros((len(raw), np.dtype(kind).itemsize), dtype=np.uint8)
            held[:, :width] = raw
            out.append(held.view(kind).ravel())
        return tuple(out)

    def candidates(self, small: int) -> pa.RecordBatch:
        """Rows (kind, x, y, digest): kind 0, a candidate pair of a small group; kind 1, signature x
        of a larger group that has member y. A group with a crowd's centre is a larger one."""
        several = (self.count > small) | (self.of_crowd & (self.count > 1))
        x, y = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for g in range(2, small + 1):
            at = self.begin[(self.count == g) & ~several]
            for i, j in combinations(range(g), 2):
                x.append(at + i)
                y.append(at + j)
        x, y = np.concatenate(x), np.concatenate(y)
        fit = self.doc[x] != self.doc[y]
        a, b = np.minimum(self.doc[x], self.doc[y])[fit], np.maximum(self.doc[x], self.doc[y])[fit]
        order = np.lexsort((b, a))
        pairs = order[_starts(a[order], b[order])]
        pair_rows = _found(np.zeros(len(pairs)), a[pairs], b[pairs], np.zeros(len(pairs)))
        large = self.members(np.flatnonzero(np.repeat(several, self.count)))
        return pa.Table.from_batches([pair_rows, large]).combine_chunks().to_batches()[0] if len(pairs) + len(large) else pair_rows


_BLOCK_NAMES = ["part", "salt", "sig", "doc", "digest", "centre", "kind", "x", "y", "d"]
_BLOCK = "part int, salt int, sig binary, doc binary, digest binary, centre binary, kind int, x bigint, y bigint, d bigint"


def _found(kind: np.ndarray, x: np.ndarray, y: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), *[pa.array(v.astype(np.int64)) for v in (x, y, d)]], names=["kind", "x", "y", "d"])


def _packed(found: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of ``found`` among packed blocks; their part deals them out evenly."""
    part = pa.array((found.column(2).to_numpy() & 0x3FFFFFFF).astype(np.int32))
    return pa.RecordBatch.from_arrays([part, *[pa.nulls(len(found), t) for t in (pa.int32(), *[pa.binary()] * 4)], *found.columns], names=_BLOCK_NAMES)


def _candidates(base: DataFrame, tasks: int, heavy: np.ndarray, size: int, threshold: int) -> DataFrame:
    """Rows (kind, x, y, d) as :meth:`Signed.candidates` has them, over all documents, not distinct."""
    spark = base.sparkSession
    shared = spark.sparkContext.broadcast(heavy)
    parts = max(10, math.ceil(math.log2(16 * int(spark.conf.get("spark.sql.shuffle.partitions")))))  # a power of two
    salts = math.ceil(tasks / FAN)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        salt = TaskContext.get().partitionId()
        for batch in batches:
            doc = batch.column(0).to_numpy()
            for at, texts in slices(batch.column(1).to_pylist()):
                sets = ShingleSets(texts, size)
                digest = np.array([int.from_bytes(d[:6], "little") if d else 0 for d in sets.digests()], dtype=np.uint64)
                order = np.lexsort((doc[at : at + len(texts)], digest))
                of_each = order[_starts(digest[order])]  # of equal sets the one of least doc_id
                sig, of = signatures(sets, np.sort(of_each[sets.size[of_each] > 0]), threshold, shared.value)
                held.append((sig, doc[at + of], digest[of], np.zeros(len(sig), dtype=bool)))
                if sum(len(h[0]) for h in held) >= PORTION:
                    yield from Signed(held).blocks(parts, salts, salt, CROWD)
                    held = []
        yield from Signed(held).blocks(parts, salts, salt, CROWD)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[Signed | pa.RecordBatch]:
        """The signatures of each part and salt, and rows that were found before."""
        held: list[tuple[np.ndarray, ...]] = []
        now = None
        for batch in batches:
            before = batch.filter(batch.column("kind").is_valid())
            if len(before):
                yield before
            rest = batch.filter(batch.column("kind").is_null())
            for part, salt, *blobs in zip(*(c.to_pylist() for c in rest.columns[:6]), strict=True):
                if (part, salt) != now and held:
                    yield Signed(held)
                    held = []
                now = part, salt
                held.append(Signed.unpacked(blobs))
        if held:
            yield Signed(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in together(batches):
            yield met.candidates(SMALL) if isinstance(met, Signed) else met.select(["kind", "x", "y", "d"])

    blocks = base.mapInArrow(trimming(sign), _BLOCK)
    while salts > 1:
        salts, were = math.ceil(salts / FAN), salts

        def narrow(batches: Iterator[pa.RecordBatch], salts: int = salts) -> Iterator[pa.RecordBatch]:
            for met in together(batches):
                if isinstance(met, Signed):
                    yield from met.blocks(parts, salts, TaskContext.get().partitionId(), CROWD)
                else:
                    yield met

        blocks = blocks.repartition(max(were, 2 ** (parts - 3)), "part", "salt").sortWithinPartitions("part", "salt").mapInArrow(trimming(narrow), _BLOCK)
    return written(blocks.repartition("part").sortWithinPartitions("part", "salt").mapInArrow(trimming(meet), "kind int, x bigint, y bigint, d bigint"), "candidates")


def around_hubs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of the hub of each group (sig, node) with the group's other members. The hub is
    the member of most groups: what many documents were copied from shares signatures with all its
    copies, while the copies may be too far apart from each other."""
    met = members.groupBy("node").agg(F.count("*").alias("met"))
    hub = written(members.join(met, "node").groupBy("sig").agg(F.max(F.struct("met", -F.col("node"))).alias("top")), "hubs")
    return members.join(hub, "sig").select((-F.col("top.col2")).alias("a"), F.col("node").alias("b")).where("a <> b").distinct()


def possible(pairs: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """The ``pairs`` (a, b, star) without those whose sizes or sketches (doc_id, n, sketch) rule out
    that their sets are similar. Rows with one doc_id each count."""
    one = sketches.select(F.col("doc_id").alias("a"), F.col("n").alias("n_one"), F.col("sketch").alias("one"))
    two = sketches.select(F.col("doc_id").alias("b"), F.col("n").alias("n_two"), F.col("sketch").alias("two"))
    n_a, n_b = F.col("n_one"), F.col("n_two")
    met = pairs.join(two, "b").join(one, "a").where(100 * F.least(n_a, n_b) >= threshold * F.greatest(n_a, n_b))
    words = F.least(F.size("one"), F.size("two"))
    # sizes that fit differ by less than a factor of two, and so do the sketches' powers of two
    folded = lambda c: F.when(F.size(c) > words, F.zip_with(F.slice(c, 1, words), F.slice(c, words + 1, words), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(c))
    apart = F.aggregate(F.zip_with(folded("one"), folded("two"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return met.where((100 + threshold) * apart <= (100 - threshold) * (n_a + n_b)).select("a", "b").distinct()


def confirmed(base: DataFrame, pairs: DataFrame, size: int, threshold: int) -> DataFrame:
    """The ``pairs`` (a, b) whose sets are similar. A document with very many candidates as ``a`` is
    confirmed in several tasks."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(1).to_pylist()):
                sets = ShingleSets(texts, size)
                hashes = pa.ListArray.from_arrays(pa.array(sets.first, pa.int32()), pa.array(sets.hash.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(sets.digests(), pa.binary()), hashes], names=["doc_id", "digest", "hashes"])

    sets = may_contain(base, "doc_id", membership_bitmap(ids, "doc_id")).mapInArrow(trimming(sets_of), "doc_id bigint, digest binary, hashes array<bigint>")
    sets = sets.repartition("doc_id").dropDuplicates(["doc_id", "digest"])
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_TASK).cast("int").alias("salts"))
    left = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("one")).join(salts, "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    right = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    right = right.join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("two")), "b")
    both = F.size(F.array_intersect("one", "two"))
    met = right.join(left, ["a", "salt"]).select("a", "b", both.alias("both"), (F.size("one") + F.size("two")).alias("all"))
    return written(met.where((F.col("both") > 0) & (100 * F.col("both") >= threshold * (F.col("all") - F.col("both")))).select("a", "b"), "links")


def components_joined(texts: list[str | None], component: np.ndarray, left: int, size: int, threshold: int) -> list[tuple[int, int]]:
    """The components that links of the first ``left`` texts with the others (or among all, if
    ``left`` is their number) join: fewer pairs than there are components. Intersections of all pairs
    come from products of incidence matrices over the shingles that two texts or more have."""
    portions = [(at, ShingleSets(part, size)) for at, part in slices(texts)]
    of, sizes = np.concatenate([at + s.of for at, s in portions]), np.concatenate([s.size for _, s in portions])
    _, column, times = np.unique(np.concatenate([s.hash for _, s in portions]), return_inverse=True, return_counts=True)
    often = times[column] > 1
    number = np.cumsum(times > 1) - 1
    row, column = of[often], number[column[often]]
    same = left == len(texts)
    right = np.arange(0 if same else left, len(texts))
    both = np.zeros((left, len(right)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    step = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        part = slice(np.searchsorted(column, lo), np.searchsorted(column, lo + step))
        m = np.zeros((len(texts), step), dtype=np.float32)
        m[row[part], column[part] - lo] = 1
        both += m[:left] @ m[right].T
    either = sizes[:left, None] + sizes[right][None, :] - both
    hit = (both > 0) & (100 * both >= threshold * either) & (component[:left, None] != component[right][None, :])
    if same:
        hit = np.triu(hit)
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := parent.get(c, c)) != c:
            c = up
        return c

    out = []
    for i, j in zip(*np.nonzero(hit), strict=True):
        a, b = root(int(component[i])), root(int(component[right[j]]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((a, b))
    return out


def compared_in_blocks(base: DataFrame, rest: DataFrame, sizes: DataFrame, size: int, threshold: int) -> DataFrame:
    """Pairs (a, b) of components that links join between the members of hubs' groups (``rest``:
    hub, node, component) that lie in several components.

    Members outside a hub's largest component meet all others in blocks of about ``BLOCK``; those
    of the largest are not compared among themselves. Texts are shipped once for each meeting of
    their block, pairs never are.
    """
    docs = rest.join(sizes.withColumnRenamed("doc_id", "node"), "node")
    per = docs.groupBy("hub", "component").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))
    hubs = per.groupBy("hub").agg(F.max(F.struct("docs", -F.col("component"), "n")).alias("most"), F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    count = lambda docs, n: F.ceil(F.greatest(docs / BLOCK, n / BLOCK_SHINGLES)).cast("int")
    left_blocks = count(F.col("docs") - F.col("most.docs"), F.col("n") - F.col("most.n"))
    hubs = written(hubs.select("hub", (-F.col("most.col2")).alias("main"), left_blocks.alias("left_blocks"), count(F.col("most.docs"), F.col("most.n")).alias("main_blocks")), "hub-blocks")
    docs = docs.join(hubs, "hub").withColumn("is_main", F.col("component") == F.col("main"))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("main_blocks")).otherwise(F.col("left_blocks"))).cast("int"))
    numbers = lambda count: F.sequence(F.lit(0), F.col(count) - 1)
    meeting = lambda one, two, main, left: F.struct(one.alias("one"), two.alias("two"), F.lit(main).alias("with_main"), left.alias("is_left"))
    block = F.col("block")
    among = F.transform(numbers("left_blocks"), lambda o: meeting(F.least(block, o), F.greatest(block, o), False, block <= o))
    onto = F.transform(numbers("main_blocks"), lambda o: meeting(block, o, True, F.lit(True)))
    from_main = F.transform(numbers("left_blocks"), lambda o: meeting(o, block, True, F.lit(False)))
    docs = docs.select("hub", F.col("node").alias("doc_id"), "component", F.explode(F.when(F.col("is_main"), from_main).otherwise(F.concat(among, onto))).alias("at"))
    docs = written(docs.select("hub", "doc_id", "component", "at.*"), "meetings")
    met = may_contain(base, "doc_id", membership_bitmap(docs, "doc_id")).join(docs, "doc_id")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("is_left", "descending"), ("doc_id", "ascending")])
        alone = key[1].as_py() == key[2].as_py() and not key[3].as_py()  # a block with itself
        left = len(table) if alone else int(np.count_nonzero(table["is_left"].to_numpy()))
        found = components_joined(table["text"].to_pylist(), table["component"].to_numpy(), left, size, threshold) if left else []
        give_back()
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return written(met.groupBy("hub", "one", "two", "with_main").applyInArrow(compare, "a bigint, b bigint").distinct(), "block-links")


def similar_documents(docs: DataFrame, threshold: int = 80, size: int = 5) -> DataFrame:
    """Link documents whose sets of ``size``-word shingles have Jaccard similarity of at least
    ``threshold`` percent, and find the groups that links connect.

    Returns per row doc_id, n_shingles and component_id, the smallest doc_id that links reach.
    Words are parted by ASCII white space and A-Z lower-cased. Texts of fewer words are one shingle;
    null texts and texts without words have none and are linked with nothing. Rows with one doc_id
    are one document, linked if any of its texts is. A null doc_id is linked with nothing and has
    a null component. An empty table gives no rows; columns other than doc_id and text are not read.
    Texts of any length are read whole; the shingles of one text must fit into a task's memory.
    """
    in_small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, sketch, frequent = [], [], [], []
            for _, texts in slices(batch.column(1).to_pylist()):
                sets = ShingleSets(texts, size)
                n += sets.size.tolist()
                digest += sets.digests()
                sketch += sets.sketches().to_pylist()
                values, times = np.unique(sets.hash, return_counts=True)
                common = values[times >= max(5, len(texts) // 200)] & np.uint64((1 << HEAVY_BITS) - 1)
                frequent += [common.astype(np.int64), *[None] * (len(texts) - 1)]
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.list_(pa.int64())), pa.array(frequent, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "sketch", "frequent"])

    surveyed = written(base.mapInArrow(trimming(survey), "doc_id bigint, n_shingles bigint, digest binary, sketch array<bigint>, frequent array<bigint>"), "sets")
    heavy = bitmap_at(surveyed.select(F.explode("frequent").alias("at")).distinct(), HEAVY_BITS)
    whole = surveyed.where("digest IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "digest", "n_shingles")
    # equal sets are one node of the graph, named by the least doc_id
    firsts = whole.groupBy("digest").agg(F.min("doc_id").alias("node"))
    of_several = whole.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("doc_id")
    same_id = whole.join(of_several, "doc_id").join(firsts, "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))

    known = base.where("doc_id IS NOT NULL")
    found = _candidates(known, len(surveyed.inputFiles()), heavy, size, threshold)
    members = found.where("kind = 1").groupBy(F.col("x").alias("sig"), "d").agg(F.min("y").alias("node"))
    alone = found.where("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(False).alias("star")).distinct()
    pairs = written(alone.union(around_hubs(members).withColumn("star", F.lit(True))), "pairs")
    sketches = surveyed.where("digest IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("n_shingles").alias("n"), "sketch")
    left = written(possible(pairs.select("a", "b").distinct(), sketches, threshold), "possible")
    labels = components(confirmed(known, left, size, threshold).union(same_id))

    # members of large groups were compared with hubs only: pairs that those links do not connect follow
    around = pairs.where("star").select(F.col("a").alias("hub"), F.col("b").alias("node"))
    around = around.union(around.select("hub", F.col("hub").alias("node")).distinct())
    around = written(around.join(labels, "node", "left").select("hub", "node", F.coalesce("component", "node").alias("component")), "around")
    split = written(around.groupBy("hub").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("hub"), "split")
    if not split.isEmpty():
        sizes = whole.groupBy("doc_id").agg(F.max("n_shingles").alias("n"))
        joined = components(compared_in_blocks(known, around.join(split, "hub"), sizes, size, threshold))
        alone = joined.select("node", F.col("node").alias("component"))  # components of one node have no label yet
        into = joined.select(F.col("node").alias("component"), F.col("component").alias("into"))
        labels = labels.union(alone).distinct().join(into, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    named = firsts.join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return surveyed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left").select("doc_id", "n_shingles", component.alias("component_id"))


def keep_one_of_each(docs: DataFrame, threshold: int = 80, size: int = 5) -> DataFrame:
    """``docs`` without the documents that links connect with one of smaller doc_id.

    Of rows that repeat both doc_id and text one stays, the first by its columns in JSON; rows of
    one doc_id with other texts stay or go with it. Null and empty texts are linked with nothing and
    stay, as do rows without a doc_id. An empty table gives an empty table. All columns stay,
    whatever their names. Only rows that may go are shuffled; a bitmap tells which.
    """
    found = similar_documents(docs, threshold, size).where("doc_id IS NOT NULL")
    counted = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("component_id"))
    goes = F.col("doc_id") != F.col("component_id")
    touched = written(counted.where((F.col("n") > 1) | goes).select("doc_id", goes.alias("goes")), "touched")
    split = marked(docs, "doc_id", membership_bitmap(touched.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)), "doc_id"))
    gone = touched.where("goes").select("doc_id")
    doubtful = split.where("maybe").select("kept", F.col("kept.doc_id").cast("bigint").alias("doc_id")).join(gone, "doc_id", "left_anti")
    one = doubtful.groupBy("doc_id", F.xxhash64("kept.text"), F.sha2("kept.text", 256)).agg(F.min_by("kept", F.to_json("kept")).alias("kept"))
    return split.where("NOT maybe").select("kept").union(one.select("kept")).select("kept.*")
