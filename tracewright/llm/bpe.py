"""Byte-level BPE encoding and decoding over a contiguous rank array.

A text is cut into pieces by the vocabulary's pattern. A piece holds an array of part boundaries and, beside each
boundary, the rank of the merge of its two neighbouring parts. The least rank is found by a scan, its boundary deleted
and the two ranks beside it refreshed, until no merge is left. Pieces recur, so what a piece encodes to is remembered.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_batches

#: Pieces of up to so many bytes are scanned; longer ones, rare and at worst quadratic to scan, go through a heap.
SCANNED = 128
#: Pieces remembered at a time, and the longest piece that is remembered.
REMEMBERED, LONGEST_REMEMBERED = 1_000_000, 64
_NONE = 1 << 60
#: The pattern that cuts texts into pieces for vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in vocabulary files: itself, or one past U+0100 in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes with the vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and spec.get("normalizer") is None
        if not plain or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path} isn't a byte-level BPE file of the kind that this encodes")
        of = {c: b for b, c in byte_letters().items()}
        raw = lambda s: bytes(of[c] for c in s)
        self.id_of = {raw(t): i for t, i in model["vocab"].items() if all(c in of for c in t)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(raw(a), raw(b)): r for r, (a, b) in enumerate(merges)}
        self._byte_id = [self.id_of.get(bytes([b]), -1 - b) for b in range(256)]
        self._made = [self.id_of[a + b] for a, b in ((raw(a), raw(b)) for a, b in merges)]
        self._rank_of = {(self._id(a), self._id(b)): r for (a, b), r in self.rank.items()}.get
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: b for b, i in self.id_of.items()} | {i: t.encode() for t, i in self.special.items()}
        self._split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._pieces = regex.compile(PATTERN)
        self._known: dict[str, tuple[bytes, bytes]] = {}

    def _id(self, part: bytes) -> int:
        """A part's id; bytes that the vocabulary lacks have negative numbers."""
        return self._byte_id[part[0]] if len(part) == 1 else self.id_of[part]

    def merge(self, piece: bytes) -> list[bytes]:
        """The parts of a piece after all merges, lowest rank first and of equal ones the leftmost."""
        return self._scan(piece) if len(piece) <= SCANNED else self._heap(piece)

    def _scan(self, piece: bytes) -> list[bytes]:
        rank, made = self._rank_of, self._made
        at = list(range(len(piece) + 1))
        ids = [self._byte_id[b] for b in piece]  # of the parts: pairs of numbers are found faster than pairs of bytes
        ranks = [rank(pair, _NONE) for pair in pairwise(ids)]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            ids[i] = made[least]
            del at[i + 1], ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), _NONE)
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), _NONE)
        return [piece[a:b] for a, b in pairwise(at)]

    def _heap(self, piece: bytes) -> list[bytes]:
        n, rank = len(piece), self.rank
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        todo: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := end[i]) < n and (r := rank.get((piece[i:j], piece[j : end[j]]))) is not None:
                heapq.heappush(todo, (r, i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        while todo:
            _, i, j, k = heapq.heappop(todo)
            if not alive[i] or end[i] != j or not alive[j] or end[j] != k:
                continue  # one of its parts has been merged meanwhile
            alive[j], end[i] = False, k
            if k < n:
                before[k] = i
            offer(before[i])
            offer(i)
        return [piece[i : end[i]] for i in range(n) if alive[i]]

    def _of(self, piece: str) -> tuple[bytes, bytes]:
        """A piece's ids as decimal text joined by commas, and the bytes that those ids decode to."""
        if got := self._known.get(piece):
            return got
        ids = [self.id_of[p] for p in self.merge(piece.encode())]
        got = ",".join(map(str, ids)).encode(), b"".join(self.bytes_of[i] for i in ids)
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[piece] = got
        return got

    def coded(self, text: str) -> tuple[bytes, bytes]:
        """The ids of a text as decimal text joined by commas, and the bytes that they decode to."""
        ids: list[bytes] = []
        out: list[bytes] = []
        for k, part in enumerate(self._split.split(text) if self._split else [text]):
            if k % 2:
                ids.append(str(self.special[part]).encode())
                out.append(part.encode())
            elif part:
                known, of = self._known.get, self._of
                got = [known(piece) or of(piece) for piece in self._pieces.findall(part)]
                ids += [a for a, _ in got]
                out += [b for _, b in got]
        return b",".join(ids), b"".join(out)

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.coded(text)[0].split(b",") if x]

    def decode(self, ids: list[int]) -> str:
        """Bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


@cache
def codec(path: str) -> Codec:
    """One for each worker."""
    return Codec(path)


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded and decoded again.

    tokenizer: path of the tokenizer file, which every executor has. Strings of special tokens in a text become those
    tokens. A null text counts as empty: no ids, and the hash of nothing. Repeated rows and null ids stay as they are;
    other columns aren't read. Long texts are cut into pieces first, so memory stays in proportion to the text.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = codec(tokenizer), hashlib.sha256
        for batch in batches:
            counts, ids, texts = [], [], []
            for x in batch.column(1):
                a, b = c.coded(x.as_py() or "")
                counts.append(a.count(b",") + 1 if a else 0)
                ids.append(sha(a).hexdigest())
                texts.append(sha(b.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
