"""Substring deduplication: windows of words that an earlier document has too.

A window's minimiser is the least hash among its runs of ``MER`` words. Consecutive windows with one
minimiser (a super-k-mer) travel as one packed string to the minimiser's bucket, where the windows
are named exactly, by sorting pairs of names of shorter windows, and the least doc_id of each name
is found. Only super-k-mers whose minimiser occurs in two documents or more need to travel: equal
windows have equal minimisers. Equal texts are worked on once, and equal strings are merged before
they are shuffled and meet their occurrences again once their windows are settled, so that copies do
not fill a bucket; each document then loses the windows whose least doc_id is below its own. A bucket of
more than ``BUCKET_BYTES`` is dealt on by the windows' second minimiser, the least hash but the first:
its super-k-mers are cut where consecutive windows part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.common import in_small_batches, marked, may_contain, membership_bitmap, trimming, written

#: Words whose hash makes a minimiser.
MER = 8
#: Bytes of super-k-mers that a bucket is meant for; larger ones are dealt into several.
BUCKET_BYTES = 4 << 20
#: Bytes of text, and words, that are worked on at a time.
SLICE_BYTES, SLICE_WORDS = 1_000_000, 400_000
#: Words hashed at a time: eight bytes and more for each of their characters are held.
HASHED_WORDS = 1 << 15
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class Words:
    """The words of several texts at once: where they stand in the joined bytes, and their hashes."""

    def __init__(self, texts: list[bytes]) -> None:
        self.raw = b"\n".join(texts) + b"\n"
        data = np.frombuffer(self.raw, dtype=np.uint8)
        gap = _GAP[data]
        before = np.concatenate([[True], gap[:-1]])
        self.start = np.flatnonzero(~gap & before)
        self.end = np.flatnonzero(gap & ~before)
        sizes = np.array([len(t) + 1 for t in texts])
        self.of = np.searchsorted(np.cumsum(sizes), self.start, side="right")
        self.first = np.searchsorted(self.of, np.arange(len(texts) + 1))
        if not len(self.start):
            self.hash = np.empty(0, dtype=np.uint64)
            return
        length = self.end - self.start
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(int(length.max()), _BASE, dtype=np.uint64))
            self.hash = np.empty(len(length), dtype=np.uint64)
            for lo in range(0, len(length), HASHED_WORDS):
                size = length[lo : lo + HASHED_WORDS]
                span = slice(self.start[lo], self.end[lo + len(size) - 1])
                used = data[span][~gap[span]]
                begin = np.cumsum(size) - size
                value = power[np.arange(len(used), dtype=np.int32) - np.repeat(begin.astype(np.int32), size)]
                value *= used.astype(np.uint64) + np.uint64(1)
                self.hash[lo : lo + len(size)] = mixed(np.add.reduceat(value, begin))

    def mers(self, m: int) -> np.ndarray:
        """Hash of the ``m`` words from each word on (of those that have as many after them)."""
        n = len(self.hash) - m + 1
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        out = np.zeros(n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(m):
                out = out * _BASE + self.hash[i : i + n]
        return mixed(out)

    def runs(self, k: int, m: int = MER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Super-k-mers: minimiser, first word and number of windows of each."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        least, width, need = self.mers(m), 1, k - m + 1
        while width < need:
            step = min(width, need - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        least = least[:n]
        valid = self.of[:n] == self.of[k - 1 :]
        new = np.concatenate([[True], (least[1:] != least[:-1]) | (self.of[1:n] != self.of[: n - 1]) | ~valid[:-1]])
        first = np.flatnonzero(new & valid)
        # a run ends where the next begins or windows stop being valid
        stop = np.flatnonzero(np.concatenate([new | ~valid, [True]]))
        windows = stop[np.searchsorted(stop, first, side="right")] - first
        # repetitive words make long runs; they are cut so that none is longer than others can be
        pieces = -(-windows // need)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        left = np.repeat(windows, pieces) - nth * need
        first = np.repeat(first, pieces) + nth * need
        return least[first].view(np.int64), first, np.minimum(left, need)

    def seconds(self, begin: np.ndarray, least: np.ndarray, k: int, m: int = MER) -> np.ndarray:
        """The least hash but ``least`` of the windows from the words ``begin`` on."""
        out = np.empty(len(begin), dtype=np.uint64)
        of_each = np.lib.stride_tricks.sliding_window_view(self.mers(m), k - m + 1)
        for at in range(0, len(begin), 10_000):
            part = of_each[begin[at : at + 10_000]]
            out[at : at + 10_000] = np.where(part == least[at : at + 10_000, None], np.uint64(2**64 - 1), part).min(axis=1)
        return out

    def sizes(self, first: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Bytes of ``words`` words from each word ``first`` on."""
        return self.end[first + words - 1] - self.start[first] if len(first) else first

    def packed(self, first: int, words: int) -> bytes:
        return self.raw[self.start[first] : self.end[first + words - 1]]


def slices(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts' bytes in portions of bounded size (at least one text each), with the first's number."""
    at, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace")
        if held and size + len(raw) > SLICE_BYTES:
            yield at, held
            at, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield at, held


def window_names(ids: np.ndarray, k: int) -> np.ndarray:
    """A number for the ``k`` words from each place on; equal numbers for equal words only. Names of
    1, 2, 4, ... words are paired and sorted to name windows twice as long."""
    names, width = ids.astype(np.int64), 1
    while width < k:
        step = min(width, k - width)
        pair = names[:-step] * (int(names.max()) + 1) + names[step:]
        names = np.unique(pair, return_inverse=True)[1]
        width += step
    return names


def owners(first: np.ndarray, last: np.ndarray, packed: list[bytes], k: int) -> tuple[np.ndarray, ...]:
    """Which windows of the strings an earlier document than some holder has. ``first`` and
    ``last``: the least and greatest doc_id that has each string. Returns the number of the string,
    the first word, the end, and the least doc_id of spans of windows that have one, ordered by
    string."""
    words = b" ".join(packed).split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    count = np.array([len(p.split()) for p in packed])
    begin = np.cumsum(count) - count
    windows = count - k + 1
    at = np.repeat(begin - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
    of = np.repeat(np.arange(len(packed)), windows)
    name = window_names(ids, k)[at]
    least = np.full(int(name.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, name, first[of])
    owner = least[name]
    hit = np.flatnonzero(owner < last[of])
    if not len(hit):
        return hit, hit, hit, hit
    new = np.concatenate([[True], (np.diff(hit) != 1) | (of[hit[1:]] != of[hit[:-1]]) | (owner[hit[1:]] != owner[hit[:-1]])])
    lead, end = hit[new], hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)]
    where = at[lead] - begin[of[lead]]
    return of[lead], where, where + (end - lead) + k, owner[lead]


def covered(spans: list[tuple[int, int]], n_words: int) -> np.ndarray:
    """Which of a document's words the spans cover."""
    change = np.zeros(n_words + 1, dtype=np.int64)
    for a, b in spans:
        change[a] += 1
        change[b] -= 1
    return np.cumsum(change)[:-1] > 0


def cut(raw: bytes, gone: np.ndarray) -> bytes:
    """A text's bytes without the words that are ``gone``; the white space after kept words stays."""
    words = Words([raw])
    edge = np.concatenate([words.start, [len(raw)]])
    stay = np.flatnonzero(~gone)
    return b"".join([raw[: edge[0]] if len(stay) == len(gone) else b"", *(raw[edge[i] : edge[i + 1]] for i in stay.tolist())])


_DOC = "doc_id bigint, tk bigint"


def normal(texts: list[bytes]) -> list[bytes]:
    """The words of each text joined by one space."""
    return [b" ".join(t.split()) for t in texts]


def repeated_spans(docs: DataFrame, k: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What of ``docs`` repeats windows of documents with smaller doc_ids.

    Returns three tables: every row's doc_id, text key tk, n_words and words_sha256 (of the words
    joined by one space); the texts of those that hold such windows, with the windows' spans
    (doc_id, tk, text, spans); and the rows (doc_id, tk) that such windows cover whole.
    """
    in_small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tk"), "text")

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, sha, minimisers, sizes = [], [], [], []
            for _, texts in slices(batch.column(2).to_pylist()):
                texts = normal(texts)  # noqa: PLW2901
                words = Words(texts)
                least, first, windows = words.runs(k)
                size = words.sizes(first, windows + k - 1)
                cuts = np.searchsorted(words.of[first] if len(first) else first, np.arange(len(texts) + 1))
                for i, raw in enumerate(texts):
                    n_words.append(int(words.first[i + 1] - words.first[i]))
                    sha.append(hashlib.sha256(raw).digest())
                    minimisers.append(least[cuts[i] : cuts[i + 1]])
                    sizes.append(size[cuts[i] : cuts[i + 1]].astype(np.int32))
            columns = [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(sha, pa.binary()), pa.array(minimisers, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tk", "n_words", "words_sha256", "minimisers", "sizes"])

    surveyed = written(base.mapInArrow(trimming(survey), f"{_DOC}, n_words bigint, words_sha256 binary, minimisers array<bigint>, sizes array<int>"), "minimisers")
    known = surveyed.where(f"n_words >= {k} AND doc_id IS NOT NULL")
    # the first row of equal texts stands for all of them
    holders = known.groupBy("words_sha256").agg(F.min(F.struct("doc_id", "tk")).alias("rep"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    several = written(holders.where("n > 1").select("words_sha256", "rep", "last"), "equal-texts")
    others = known.select("doc_id", "tk", "words_sha256").join(several, "words_sha256").where((F.col("doc_id") != F.col("rep.doc_id")) | (F.col("tk") != F.col("rep.tk"))).select("doc_id", "tk").distinct()
    ones = known.select("doc_id", "tk", "minimisers", "sizes").join(others, ["doc_id", "tk"], "left_anti")
    ones = ones.join(several.select("rep.*", "last"), ["doc_id", "tk"], "left").withColumn("last", F.coalesce("last", "doc_id"))
    runs = ones.select("doc_id", "tk", "last", F.posexplode(F.arrays_zip("minimisers", "sizes")).alias("nth", "run")).select("doc_id", "tk", "last", "nth", F.col("run.minimisers").alias("minimiser"), F.col("run.sizes").alias("size"))
    runs = written(runs, "runs")
    shared = runs.groupBy("minimiser").agg(F.min("doc_id").alias("first"), F.max("last").alias("last"), F.sum("size").alias("bytes")).where("first < last")
    shared = written(shared.select("minimiser", F.ceil(F.col("bytes") / BUCKET_BYTES).cast("int").alias("salts")), "shared")
    travel = runs.join(shared, "minimiser").groupBy("doc_id", "tk").agg(F.max("last").alias("last"), F.collect_set(F.struct("nth", "salts")).alias("runs"))
    travel = written(travel, "travel")
    texts = may_contain(base, "doc_id", membership_bitmap(travel, "doc_id")).dropDuplicates(["doc_id", "tk"]).join(travel, ["doc_id", "tk"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key, last = (batch.column(c).to_numpy() for c in ("doc_id", "tk", "last"))
            for at, raw in slices(batch.column("text").to_pylist()):
                words = Words(normal(raw))
                least, first, windows = words.runs(k)
                cuts = np.searchsorted(words.of[first] if len(first) else first, np.arange(len(raw) + 1))
                wanted = sorted((int(cuts[i]) + r["nth"], r["salts"]) for i, runs in enumerate(batch.column("runs").slice(at, len(raw)).to_pylist()) for r in runs)
                chosen, salts = np.array(wanted, dtype=np.int64).reshape(-1, 2).T
                # a window's salt follows from its words; a run is cut where the salt changes
                of = np.repeat(chosen, windows[chosen])
                begin = np.repeat(first[chosen] - np.cumsum(windows[chosen]) + windows[chosen], windows[chosen]) + np.arange(len(of))
                salt = np.zeros(len(of), dtype=np.int64)
                parted = np.flatnonzero(np.repeat(salts > 1, windows[chosen]))
                if len(parted):
                    second = mixed(words.seconds(begin[parted], least[of[parted]].view(np.uint64), k))
                    salt[parted] = (second % np.repeat(salts, windows[chosen])[parted].astype(np.uint64)).astype(np.int64)
                lead = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (salt[1:] != salt[:-1])])) if len(of) else of
                length = np.diff(np.append(lead, len(of)))
                packed = [words.packed(f, n + k - 1) for f, n in zip(begin[lead].tolist(), length.tolist(), strict=True)]
                row = words.of[begin[lead]] if len(lead) else lead
                columns = [least[of[lead]], salt[lead].astype(np.int32), doc[at + row], key[at + row], last[at + row], begin[lead] - words.first[row]]
                digest = [xxhash.xxh3_128_digest(p) for p in packed]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(packed, pa.binary()), pa.array(digest, pa.binary())], names=["minimiser", "salt", "doc_id", "tk", "last", "start", "packed", "digest"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        size = 0

        def done(table: pa.Table) -> pa.RecordBatch:
            of, *found = owners(table["first"].to_numpy(), table["last"].to_numpy(), table["packed"].to_pylist(), k)
            strings, begin = np.unique(of, return_index=True)
            spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b", "owner"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(of)), pa.int32()), spans)
            return pa.RecordBatch.from_arrays([table["digest"].combine_chunks().take(pa.array(strings, pa.int64())), lists], names=["digest", "spans"])

        for batch in batches:
            rest.append(batch)
            size += batch.nbytes
            if size >= SLICE_BYTES:
                table = pa.Table.from_batches(rest).combine_chunks()
                bucket, salt = table["minimiser"].to_numpy(), table["salt"].to_numpy()
                # the last bucket may go on in the next batch
                other = np.flatnonzero((bucket != bucket[-1]) | (salt != salt[-1]))
                n = int(other[-1]) + 1 if len(other) else 0
                if n:
                    yield done(table.slice(0, n))
                rest = table.slice(n).to_batches()
                size = sum(b.nbytes for b in rest)
        if rest and sum(len(r) for r in rest):
            yield done(pa.Table.from_batches(rest).combine_chunks())

    pieces = written(texts.mapInArrow(trimming(pack), f"minimiser bigint, salt int, {_DOC}, last bigint, start bigint, packed binary, digest binary"), "pieces")
    strings = pieces.groupBy("minimiser", "salt", "packed", "digest").agg(F.min("doc_id").alias("first"), F.max("last").alias("last"))
    named = strings.repartition("minimiser", "salt").sortWithinPartitions("minimiser", "salt").mapInArrow(trimming(count), "digest binary, spans array<struct<a: bigint, b: bigint, owner: bigint>>")
    held = pieces.select("doc_id", "tk", "last", "start", "digest").join(written(named, "named"), "digest")
    moved = F.transform(F.filter("spans", lambda s: s["owner"] < F.col("last")), lambda s: F.struct((F.col("start") + s["a"]).alias("a"), (F.col("start") + s["b"]).alias("b"), s["owner"].alias("owner")))
    held = held.select("doc_id", "tk", moved.alias("spans")).groupBy("doc_id", "tk").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    shas = surveyed.select("doc_id", "tk", "n_words", "words_sha256")
    spans = written(shas.join(held, ["doc_id", "tk"]).select("words_sha256", "spans").dropDuplicates(["words_sha256"]), "spans")
    lost = shas.where("doc_id IS NOT NULL").join(spans, "words_sha256").withColumn("spans", F.array_sort(F.filter("spans", lambda s: s["owner"] < F.col("doc_id")))).where(F.size("spans") > 0)
    # where the spans cover all words, nothing of the text is needed
    reach = F.aggregate("spans", F.lit(0).cast("bigint"), lambda to, s: F.when(s["a"] <= to, F.greatest(to, s["b"])).otherwise(to))
    lost = written(lost.select("doc_id", "tk", "n_words", "spans", (reach == F.col("n_words")).alias("all")), "lost")
    part = lost.where("NOT all").select("doc_id", "tk", "spans").dropDuplicates(["doc_id", "tk"])
    changed = may_contain(base, "doc_id", membership_bitmap(part, "doc_id")).join(part, ["doc_id", "tk"])
    return surveyed.drop("minimisers", "sizes"), changed, lost.where("all").select("doc_id", "tk").distinct()


def remove_repeats(docs: DataFrame, k: int = 50, with_text: bool = False) -> DataFrame:
    """Remove every word covered by a window of ``k`` words that also starts in a document with a
    smaller doc_id.

    Returns per row doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one
    space); with ``with_text`` also tk and kept, the text without the removed words (null where
    nothing is removed). Null texts have no words; texts of fewer than ``k`` words stay whole; of
    rows with equal doc_ids neither is smaller; a null doc_id neither removes nor loses words; an
    empty table gives no rows; columns other than doc_id and text are not read. Texts of any length are
    read whole; the words of one text must fit into a task's memory.
    """
    surveyed, spanned, covered_whole = repeated_spans(docs, k)

    def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, sha, kept = [], [], []
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "replace")
                words = raw.split()
                gone = covered([(s["a"], s["b"]) for s in spans], len(words))
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])).digest())
                if with_text:
                    kept.append(cut(raw, gone).decode("utf-8", "replace"))
            more = [pa.array(kept, pa.string())] if with_text else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(sha, pa.binary()), *more], names=["doc_id", "tk", "removed", "sha", *(["kept"] if with_text else [])])

    changed = spanned.mapInArrow(trimming(take_out), f"{_DOC}, removed bigint, sha binary{', kept string' if with_text else ''}").dropDuplicates(["doc_id", "tk"])
    none = [F.col("doc_id"), F.col("tk"), F.lit(None).cast("bigint").alias("removed"), F.lit(bytearray(hashlib.sha256(b"").digest())).alias("sha")]
    gone = covered_whole.select(*none, *([F.lit("").alias("kept")] if with_text else []))
    out = surveyed.join(changed.unionByName(gone), ["doc_id", "tk"], "left")
    removed = F.when(F.col("sha").isNotNull(), F.coalesce("removed", "n_words")).otherwise(0)
    more = ["tk", "kept"] if with_text else []
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.lower(F.hex(F.coalesce("sha", "words_sha256"))).alias("kept_sha256"), *more)


def without_repeats(docs: DataFrame, k: int = 50) -> DataFrame:
    """``docs`` with the words that :func:`remove_repeats` names taken out of their texts; n_chars,
    if there is such a column, follows.

    Documents of which nothing is left go; all other rows, repeated ones too, and all columns,
    whatever their names, stay. Null and empty texts, texts of fewer than ``k`` words and rows
    without a doc_id stay as they are. An empty table gives an empty table. Only rows that may
    change are shuffled.
    """
    changed = remove_repeats(docs, k, with_text=True).where("n_removed > 0").select("doc_id", "tk", F.col("kept").alias("new_text")).dropDuplicates(["doc_id", "tk"])
    changed = written(changed, "changed")
    split = marked(docs, "doc_id", membership_bitmap(changed.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)), "doc_id"))
    doubtful = split.where("maybe").select("kept", F.col("kept.doc_id").cast("bigint").alias("doc_id"), F.xxhash64("kept.text").alias("tk"))
    joined = doubtful.join(changed, ["doc_id", "tk"], "left").where("new_text IS NULL OR new_text <> ''")
    new = {"text": F.coalesce("new_text", "kept.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("new_text").isNotNull(), F.length("new_text")).otherwise(F.col("kept.n_chars"))
    touched = joined.select(*[new.get(c, F.col(f"kept.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
    return split.where("NOT maybe").select("kept.*").unionByName(touched)
