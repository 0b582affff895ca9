"""Byte-pair encoding and decoding.

Encoding walks a piece of text from left to right and takes, at each place, the longest token that
an Aho-Corasick automaton finds there. A token may follow the last one only if the pair is
compatible: encoding the two tokens' bytes on their own must give these two tokens. If no token
fits, the last one is taken back and a shorter one tried; no place is entered twice in vain, so
that the time is linear in the length. The result equals that of merging by rank. Decoding gathers
the tokens' bytes from one table by offset and length.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from crosspanel.llm.common import as_strings, gathered, in_small_batches, kept, trimming

#: White space as the pattern's engine has it.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Fixed value: the pre-tokenizer's pattern of byte-level BPE.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Entries, and bytes of them, that a worker remembers before it starts anew: bounds memory, never the result.
MEMO, MEMO_BYTES = 400_000, 48 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    out.update({chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(shown))})
    return out


class Memo(dict):
    """A dictionary that computes what it lacks and forgets everything when it is full."""

    def __init__(self, make, most: int = MEMO) -> None:  # noqa: ANN001
        super().__init__()
        self.make, self.most, self.bytes = make, most, 0

    def __missing__(self, key):  # noqa: ANN001, ANN204
        value = self.make(key)
        size = len(key) + len(value) if isinstance(value, bytes) else 0
        if len(self) >= self.most or self.bytes + size > MEMO_BYTES:
            self.clear()
            self.bytes = 0
        self.bytes += size
        self[key] = value
        return value


class BytePairs:
    """Vocabulary, merges and tables of one tokenizer; ``suffix`` marks the end of a word, if it does."""

    def __init__(self, spec: str) -> None:
        tokenizer = json.loads(spec)
        model = tokenizer["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        alphabet = byte_alphabet()
        self.vocabulary: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in tokenizer["added_tokens"]}
        size = 1 + max([*self.vocabulary.values(), *self.special.values()])
        shown: list[str] = [""] * size
        for token, i in self.vocabulary.items():
            shown[i] = token
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            made = self.vocabulary[left + right]
            self.rank[self.vocabulary[left], self.vocabulary[right]] = (rank, made)
            self.made.setdefault(made, (rank, self.vocabulary[left], self.vocabulary[right]))
        # units: one character for each byte, and one for each byte that ends a word
        self.unit = {c: chr(b) for c, b in alphabet.items()}
        self.token_units = [self._units(t) for t in shown]
        self.length = [len(t) for t in self.token_units]
        self.id_of_units = {units: i for i, units in enumerate(self.token_units) if units}
        self.shorter = Memo(self._shorter)
        self.compatible = Memo(self._compatible)
        blob = [bytes(map(ord, t)) if not self.suffix else b"" for t in self.token_units]
        for content, i in self.special.items():
            blob[i] = content.encode()
        self.blob = np.frombuffer(b"".join(blob), dtype=np.uint8)
        self.blob_length = np.array([len(b) for b in blob], dtype=np.int64)
        self.blob_start = np.cumsum(self.blob_length) - self.blob_length

    @cached_property
    def automaton(self):  # noqa: ANN202
        import ahocorasick

        made = ahocorasick.Automaton()
        for units, i in self.id_of_units.items():
            made.add_word(units, i)
        made.make_automaton()
        return made

    def _units(self, token: str) -> str:
        ends = bool(self.suffix) and token.endswith(self.suffix) and len(token) > len(self.suffix)
        units = "".join(self.unit.get(c, "") for c in (token[: -len(self.suffix)] if ends else token))
        return units[:-1] + chr(ord(units[-1]) + 256) if ends and units else units

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, -1 if none is."""
        units = self.token_units[token]
        return next((i for n in range(len(units) - 1, 0, -1) if (i := self.id_of_units.get(units[:n], -1)) >= 0), -1)

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Whether encoding the two tokens' bytes gives the two tokens: no merge across the border
        would happen before the parts beside it are merged away from it."""
        left, right = pair
        end = len(self.rank)
        a, limit_a = left, end
        while True:
            b, limit_b = right, end
            while True:
                merge = self.rank.get((a, b))
                if merge is not None and merge[0] < limit_a and merge[0] <= limit_b:
                    return False
                if b not in self.made:
                    break
                limit_b, b, _ = self.made[b]
            if a not in self.made:
                return True
            limit_a, _, a = self.made[a]

    def encode_units(self, units: str) -> list[int]:
        """Token ids of one piece."""
        n = len(units)
        longest = [-1] * n
        length = self.length
        for end, token in self.automaton.iter(units):
            start = end + 1 - length[token]
            if longest[start] < 0 or length[longest[start]] < length[token]:
                longest[start] = token
        out: list[int] = []
        dead = bytearray(n + 1)
        pos, token = 0, longest[0]
        while pos < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = pos + length[token]
                if not dead[end] and (last < 0 or self.compatible[last, token]):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                pos = end
                token = longest[pos] if pos < n else -1
            elif last < 0:
                raise ValueError("the vocabulary lacks a byte")
            else:
                dead[pos] = 1
                out.pop()
                pos -= length[last]
                token = last
        return out


class ByteLevel(BytePairs):
    """Byte-level tokenizer: text to ids and back, memory bounded."""

    def __init__(self, spec: str) -> None:
        super().__init__(spec)
        self.pieces = regex.compile(PIECES)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.odd = regex.compile(rf" (?:[{SPACE}]|\Z)")
        self.piece = Memo(self._piece)
        self.spaced = Memo(lambda chunk: self._chunk(" " + chunk))

    def _piece(self, piece: str) -> bytes:
        return np.array(self.encode_units(piece.encode("utf-8", "replace").decode("latin-1")), dtype="<i4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        return b"".join([self.piece[p] for p in self.pieces.findall(chunk)])

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if self.odd.search(text):
            return self._chunk(text)
        # every single space starts a piece here, so that the parts between spaces stand alone
        first, *rest = text.split(" ")
        return self._chunk(first) + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, text: str) -> np.ndarray:
        if self.specials is None or not any(s in text for s in self.special):
            raw = self._plain(text)
        else:
            raw = b"".join(np.array([self.special[p]], dtype="<i4").tobytes() if p in self.special else self._plain(p) for p in self.specials.split(text))
        return np.frombuffer(raw, dtype="<i4")

    def decode(self, ids: np.ndarray) -> str:
        return gathered(self.blob, self.blob_start[ids], self.blob_length[ids]).tobytes().decode("utf-8", "replace")


def loaded(kind: type, spec: str):  # noqa: ANN201
    """A worker's tokenizer, built once."""
    return kept(f"{kind.__name__}-{hashlib.sha256(spec.encode()).hexdigest()}", lambda: kind(spec))


def tokenizer_text(path: str | None, name: str) -> str:
    """The tokenizer's JSON; by default that of the installed public vocabulary ``name``."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode every whole text.

    Returns doc_id, n_tokens, token_ids (array) and decoded (text). A null text counts as empty: no
    ids, and an empty text. Repeated rows each get a row; an empty table gives none; columns other
    than doc_id and text, whatever their names, are not read. Texts of any length go through whole.
    """
    spark: SparkSession = docs.sparkSession
    in_small_batches(spark)
    spec = spark.sparkContext.broadcast(tokenizer_text(path, "byte_bpe_50k.json"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(ByteLevel, spec.value)
        for batch in batches:
            ids = [model.encode(text) for text in as_strings(batch.column(1))]
            cut = np.cumsum([0, *map(len, ids)], dtype=np.int64).astype(np.int32)
            all_ids = pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate([np.empty(0, dtype=np.int32), *ids])))
            decoded = pa.array([model.decode(i) for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(cut).astype(np.int64)), all_ids, decoded], names=["doc_id", "n_tokens", "token_ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(trimming(run, keeps=True), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, token_ids array<int>, decoded string")
