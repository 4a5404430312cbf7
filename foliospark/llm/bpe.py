"""Byte-level BPE: an exact backtracking encoder and a decoder by offset table.

A token sequence is the BPE encoding of its bytes just if every two neighbours are
compatible, that is if the two tokens' bytes together encode to these two tokens. The
encoder takes the longest token at each place from an Aho-Corasick automaton, checks it
against its predecessor in a table of compatible pairs, shortens it while it does not fit,
and steps back where nothing fits. Every place is left at most once for good, so the work
is linear in the text however the merges nest.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: Fixed value: how byte-level BPE vocabularies of this kind cut text before merging.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encodings kept a worker before the memo starts anew; bounds memory, not results.
MEMO_ENTRIES = 400_000
#: Pretokens longer than this are encoded without entering the memo.
MEMO_BYTES = 64


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


def check_plain(spec: dict, path: str) -> None:
    if spec["normalizer"] is not None or spec["pre_tokenizer"].get("add_prefix_space") or spec["model"]["type"] != "BPE":
        raise ValueError(f"{path} is not a plain byte-level BPE")


def special_pattern(special: dict[str, int]) -> regex.Pattern | None:
    """Finds the strings of special tokens, the longest first."""
    return regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None


class Vocabulary:
    """Tokens and merges of a tokenizer file, with the tables of encoder and decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_plain(spec, path)
        byte_of = byte_alphabet()
        self.id_of = {bytes(byte_of[c] for c in token): k for token, k in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (bytes(byte_of[c] for c in part) for part in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges[self.id_of[left], self.id_of[right]] = (rank, self.id_of[left + right])
        size = 1 + max([*self.id_of.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for token, k in self.id_of.items():
            self.bytes_of[k] = token
        for content, k in self.special.items():
            self.bytes_of[k] = content.encode()
        self.length_of = [len(b) for b in self.bytes_of]
        #: The merge that makes a token: its rank (single bytes: -1) and its two parts.
        self.born, self.halves = [-1] * size, [(0, 0)] * size
        for pair, (rank, k) in self.merges.items():
            self.born[k], self.halves[k] = rank, pair
        #: The longest token that is a proper prefix of a token, or -1.
        self.shorter = [next((self.id_of[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.id_of), -1) for b in self.bytes_of]
        self.split_special = special_pattern(self.special)
        self.pretokens = regex.compile(PRETOKENS)
        self._automaton = None
        self._fits: dict[tuple[int, int], bool] = {}
        lengths = np.array(self.length_of, np.int64)
        self.length = lengths
        self.offset = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        self.joined = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    # -- encoding -----------------------------------------------------------------------

    def merged(self, data: bytes) -> list[int]:
        """The plain definition: merge the pair of lowest rank, leftmost first, until none is left."""
        ids = [self.id_of[bytes([b])] for b in data]
        while len(ids) > 1:
            rank, at = min((self.merges.get(pair, (1 << 60, 0))[0], k) for k, pair in enumerate(zip(ids, ids[1:])))
            if rank == 1 << 60:
                break
            ids[at : at + 2] = [self.merges[ids[at], ids[at + 1]][1]]
        return ids

    def fits(self, left: int, right: int) -> bool:
        """Whether the bytes of the two tokens together encode to just these two tokens."""
        found = self._fits.get((left, right))
        if found is None:
            if len(self._fits) > 4 * MEMO_ENTRIES:
                self._fits.clear()
            found = self._fits[left, right] = self.compatible(left, right)
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Undo the merges at the boundary, latest first: none may cross it before the next one undone.

        A crossing merge of the same rank as one undone exists only in runs of a token, where
        the leftmost pair goes first: it wins against the right side and loses against the left.
        """
        born, halves, before = self.born, self.halves, 1 << 60
        while True:
            crossing = self.merges.get((left, right))
            if crossing is not None and crossing[0] < before:
                return False
            if born[left] < 0 and born[right] < 0:
                return True
            if born[left] > born[right]:
                before, left = born[left], halves[left][1]
            else:
                before, right = born[right] + 1, halves[right][0]

    def automaton(self) -> ahocorasick.Automaton:
        """Of the reversed tokens: a match that ends at a place is a token that starts there."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for token, k in self.id_of.items():
                self._automaton.add_word(token[::-1].decode("latin-1"), k)
            self._automaton.make_automaton()
        return self._automaton

    def longest_tokens(self, data: bytes) -> list[int]:
        """For each byte, the longest token that starts there."""
        last, longest, length = len(data) - 1, [-1] * len(data), self.length_of
        for end, k in self.automaton().iter(data[::-1].decode("latin-1")):
            at = last - end
            if longest[at] < 0 or length[k] > length[longest[at]]:
                longest[at] = k
        return longest

    def encode_bytes(self, data: bytes) -> list[int]:
        """Exact merges of one pretoken, by backtracking over longest matches."""
        whole = self.id_of.get(data)
        if whole is not None and self.reachable(whole):
            return [whole]
        longest, n, length, shorter, fits = self.longest_tokens(data), len(data), self.length_of, self.shorter, self.fits
        dead = bytearray(n + 1)  # places from which no encoding goes on
        ids: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            if token < 0:  # nothing fits here: step back and shorten what came before
                dead[at] = 1
                token = ids.pop()
                at -= length[token]
                token = shorter[token]
            elif not dead[at + length[token]] and (fits(ids[-1], token) if ids else self.reachable(token)):
                ids.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                token = shorter[token]
        return ids

    @lru_cache(maxsize=1 << 18)  # noqa: B019  one vocabulary a worker
    def reachable(self, token: int) -> bool:
        """Whether a token's own bytes merge to it."""
        return self.merged(self.bytes_of[token]) == [token]

    # -- decoding -----------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes: one gather over the offset table."""
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.offset[ids] - ends + lengths, lengths)
        at += np.arange(len(at))
        return self.joined[at].tobytes()


class Encoder(dict):
    """Pretoken to its ids as little-endian bytes; what is missing is encoded and kept."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, pretoken: str) -> bytes:
        data = pretoken.encode()
        found = np.array(self.vocabulary.encode_bytes(data), "<u4").tobytes()
        if len(data) <= MEMO_BYTES:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[pretoken] = found
        return found

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.vocabulary.pretokens.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids of the whole text, little-endian unsigned 32-bit; strings of special tokens are those tokens."""
        split = self.vocabulary.split_special
        if split is None or not split.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in split.finditer(text):
            out += [self.plain(text[at : m.start()]), self.vocabulary.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(Vocabulary(path))


def bpe_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode it again: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    ``tokenizer`` is the path of a byte-level BPE file that the executors can open. Null
    text counts as empty: no tokens, digests of nothing. Texts of any length are encoded
    whole. Rows map to rows, repeated ones and null ids too. Empty table: empty result.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = encoder(tokenizer)
        counts, ids_sha, text_sha = [], [], []
        for text in batch.column("text"):
            packed = coder.encode(text.as_py() or "")
            ids = np.frombuffer(packed, "<u4")
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(packed).hexdigest())
            text_sha.append(hashlib.sha256(coder.vocabulary.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)`` with the ids of every whole text; null text: no ids."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = encoder(tokenizer)
        ids = [np.frombuffer(coder.encode(t.as_py() or ""), "<u4").astype(np.int32) for t in batch.column("text")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, each, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``text`` decoded from the ids; null ids: null."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = encoder(tokenizer).vocabulary
        ids = batch.column(ids_col).to_pylist()
        text = [None if x is None else words.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in ids]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, "text"])

    return arrow_map(encoded.drop("text"), each, f"{encoded.drop('text')._jdf.schema().toDDL()}, text string")
