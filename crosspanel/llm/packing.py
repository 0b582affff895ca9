"""Packing of token pieces into windows by best-fit decreasing.

Documents longer than a window are first cut into full windows. What is left of each document is
packed, longest first, into the open window with the least room that suffices; a segment tree over
the remaining capacities finds it. Pieces are dealt by hash into groups of about ``GROUP_ROWS``
documents, each packed in a task of its own; a group wastes room in its last windows only.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.bpe import MEMO, MEMO_BYTES, SPACE, BytePairs, loaded, tokenizer_text
from crosspanel.llm.common import as_strings, forget, give_back, in_small_batches, trimming

#: Documents packed together: enough for full windows, few enough for any task.
GROUP_ROWS = 2048
#: Rows of an Arrow batch of packed pieces, 2 MB with full windows of ids.
BATCH_ROWS = 256
#: Fixed value: the pre-tokenizer's pattern of the word vocabulary.
WORD_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"


class MergeTable:
    """Ranks of token pairs, looked up for whole arrays at a time."""

    BITS = 21

    def __init__(self, pairs: BytePairs) -> None:
        merges = sorted((rank, a, b, made) for (a, b), (rank, made) in pairs.rank.items())
        self.keys = np.array([(a << 32) | b for _, a, b, _ in merges], dtype=np.uint64)
        self.made = np.array([made for *_, made in merges], dtype=np.int32)
        self.none = len(merges)
        self.keys = np.append(self.keys, np.uint64(2**64 - 1))
        self.tables: list[tuple[np.ndarray, np.uint64]] = []
        left, mult = np.arange(self.none), 0x9E3779B97F4A7C15
        while len(left):  # keys that share a slot go on to the next table
            table = np.full(1 << self.BITS, self.none, dtype=np.int32)
            slot = self._slot(self.keys[left], np.uint64(mult))
            table[slot] = left
            self.tables.append((table, np.uint64(mult)))
            left, mult = left[table[slot] != left], (mult * 6364136223846793005 + 2) % 2**64 | 1

    def _slot(self, keys: np.ndarray, mult: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * mult) >> np.uint64(64 - self.BITS)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``none`` for pairs that do not merge."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        out = None
        for table, mult in self.tables:
            found = table[self._slot(keys, mult)]
            found = np.where(self.keys[found] == keys, found, self.none)
            out = found if out is None else np.minimum(out, found)
        return out

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge each word's symbols by rank, all words at once; ids and the words they are of."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = np.full(len(symbols), self.none, dtype=np.int32)
            rank[:-1] = np.where(word[:-1] == word[1:], self.ranks(symbols[:-1], symbols[1:]), self.none)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(first, len(word)))
            best = np.repeat(np.minimum.reduceat(rank, first), size)
            open_ = best < self.none
            if not open_.all():
                done.append((symbols[~open_], word[~open_]))
                symbols, word, rank, best = symbols[open_], word[open_], rank[open_], best[open_]
            if not len(symbols):
                break
            hit = rank == best
            at = np.arange(len(hit))
            hit &= (at - np.maximum.accumulate(np.where(hit, -1, at))) % 2 == 1  # of a run every other one, from the left
            symbols = np.where(hit, self.made[best], symbols)
            stay = np.append(True, ~hit[:-1])
            symbols, word = symbols[stay], word[stay]
        if not done:
            return symbols, word
        symbols, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]


class WordLevel(BytePairs):
    """Lower-casing tokenizer with word ends; white space only separates, so each part between
    white space is encoded on its own and remembered."""

    def __init__(self, spec: str) -> None:
        super().__init__(spec)
        self.pieces = regex.compile(WORD_PIECES)
        self.gaps = regex.compile(rf"[{SPACE}]+")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.table = MergeTable(self)
        self.unit_id = np.array([self.id_of_units[chr(i)] for i in range(512)], dtype=np.int32)
        del self.vocabulary, self.rank, self.made, self.id_of_units  # 35 MB a worker; the merge table has what is used
        self.known: dict[str, bytes] = {}
        self.known_pieces: dict[str, bytes] = {s: np.array([i], dtype="<u4").tobytes() for s, i in self.special.items()}
        self.special_pieces = dict(self.known_pieces)
        self.bytes = self.piece_bytes = 0

    def split(self, chunk: str) -> tuple[str, ...]:
        """The pieces of a text without white space."""
        if "|" in chunk and any(s in chunk for s in self.special):
            return tuple(q for p in self.specials.split(chunk) if p for q in ((p,) if p in self.special else self._plain(p)))
        return self._plain(chunk)

    def _plain(self, chunk: str) -> tuple[str, ...]:
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
        chunk = "".join(c.lower() for c in chunk) if "Σ" in chunk else chunk.lower()
        if chunk.isalpha():
            return (chunk,)
        if chunk[-1:] in (".", ",") and chunk[:-1].isalpha():
            return chunk[:-1], chunk[-1]
        return tuple(self.pieces.findall(chunk))

    def learn(self, chunks: set[str]) -> None:
        """Encode chunks that are not known, all at once."""
        new = list(chunks)
        if len(self.known_pieces) > MEMO or self.piece_bytes > MEMO_BYTES:
            self.known_pieces, self.piece_bytes = dict(self.special_pieces), 0
        split = [self.split(c) for c in new]
        fresh = list({p for ps in split for p in ps} - self.known_pieces.keys())
        for i in range(0, len(fresh), 50_000):
            self._encode(fresh[i : i + 50_000])
        of = self.known_pieces
        made = [of[p[0]] if len(p) == 1 else b"".join([of[x] for x in p]) for p in split]
        self.known.update(zip(new, made, strict=True))
        self.bytes += sum(map(len, new)) + sum(map(len, made))

    def _encode(self, pieces: list[str]) -> None:
        raw = [p.encode("utf-8", "replace") for p in pieces]
        length = np.array([len(r) for r in raw])
        units = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int32)
        units[np.cumsum(length) - 1] += 256  # the last byte ends the word
        ids, word = self.table.merge(self.unit_id[units], np.repeat(np.arange(len(raw)), length))
        cut = 4 * np.searchsorted(word, np.arange(len(raw) + 1))
        all_ids = ids.astype("<u4").tobytes()
        self.piece_bytes += int(length.sum()) + len(all_ids)
        self.known_pieces.update(zip(pieces, [all_ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], strict=True))

    def chunks(self, text: str) -> list[str]:
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")  # white space to str.split alone
        return [p for p in self.gaps.split(text) if p] if odd else text.split()

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        at = 0
        while at < len(texts):
            part: list[list[str]] = []
            words = 0
            while at < len(texts) and (not part or words < MEMO // 2):
                part.append(self.chunks(texts[at]))
                words += len(part[-1])
                at += 1
            if len(self.known) > MEMO or self.bytes > MEMO_BYTES:
                self.known, self.bytes = {}, 0
            self.learn({c for chunks in part for c in filterfalse(self.known.__contains__, chunks)})
            get = self.known.__getitem__
            yield from (b"".join(map(get, chunks)) for chunks in part)


class OpenWindows:
    """A segment tree over remaining capacities: which of them some open window has."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << max(1, window).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.stacks[capacity].append(window)
        self._add(capacity, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take out the open window with the least capacity of at least ``length``."""
        count, node = self.count, length + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.stacks[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each piece; ``lengths`` must not exceed ``window``. Equal
    lengths are placed in the order given."""
    at, offset = [0] * len(lengths), [0] * len(lengths)
    tree, n = OpenWindows(window), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.tightest(lengths[i])
        capacity, number = found or (window, n)
        n += found is None
        at[i], offset[i] = number, window - capacity
        if capacity > lengths[i]:
            tree.put(capacity - lengths[i], number)
    return at, offset


def pack_documents(docs: DataFrame, path: str | None = None, window: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Tokenize every whole text, end it with ``end_id`` and pack the pieces into windows.

    Returns per piece doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with
    ``with_ids``, token_ids. A null text counts as empty and gives one piece of one id; repeated
    rows are packed once each; an empty table gives no rows; columns other than doc_id and text
    are not read. Each id lies in exactly one piece, pieces in one sequence do not overlap and
    leave no gap, and no sequence is longer than ``window``. Texts of any length are read whole; a text's
    ids must fit into a task's memory. Of pieces of equal length any may come first; rooms of equal size
    are filled in the order in which they were opened.
    """
    spark = docs.sparkSession
    in_small_batches(spark)
    spec = spark.sparkContext.broadcast(tokenizer_text(path, "word_bpe_49k.json"))
    groups = max(1, math.ceil(docs.count() / GROUP_ROWS))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    ids_column = ", token_ids array<int>" if with_ids else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(WordLevel, spec.value)
        end = int(end_id).to_bytes(4, "little")
        nth = 0
        for batch in batches:
            row, start, length, crc, total, deal, ids = [], [], [], [], [], [], []
            for i, raw in enumerate(model.encode_all(as_strings(batch.column(1)))):
                raw += end
                n = len(raw) // 4
                nth += 1
                for s in range(0, n, window):
                    piece = raw[4 * s : 4 * (s + window)]
                    row.append(i)
                    start.append(s)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    deal.append(nth)
                    if with_ids:
                        ids.append(np.frombuffer(piece, dtype="<i4"))
            columns = [batch.column(0).take(pa.array(row, pa.int64()))] + [pa.array(x, pa.int64()) for x in (start, length, crc, total, deal)]
            columns += [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth", *(["token_ids"] if with_ids else [])])

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # the tokenizer has done its work
        rows = pa.Table.from_batches(batches).drop_columns(["group", "nth"]).combine_chunks().to_batches()[0]
        light = rows.select(["length", "doc_id", "start"])
        order = pc.sort_indices(light, [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        at, offset = best_fit_decreasing(light.column(0).take(order).to_pylist(), window)
        base = key[0].as_py() << 32
        for i in range(0, len(order), BATCH_ROWS):  # the ids are put in order a batch at a time
            out = rows.take(order.slice(i, BATCH_ROWS))
            columns = {**dict(zip(out.schema.names, out.columns, strict=True)), "sequence_id": pa.array([base + a for a in at[i : i + BATCH_ROWS]], pa.int64()), "offset": pa.array(offset[i : i + BATCH_ROWS], pa.int64())}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)
        del rows, light, out, columns
        give_back()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["token_ids"] if with_ids else [])]
    pieces = docs.select("doc_id", "text").mapInArrow(trimming(cut, keeps=True), f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, nth bigint{ids_column}")
    # full windows need no company and are dealt out one by one, so that a very long text fills no group
    alone = F.when(F.col("length") == window, F.col("start"))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "nth", alone), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(pack, f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint{ids_column}")
