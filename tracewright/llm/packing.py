"""Packing into windows by Karmarkar-Karp multiway differencing.

Documents are cut into pieces, and the pieces of a stretch of the corpus, about half a million tokens, are dealt to as many
windows as their tokens need. What is left over when a task has no whole stretch any more is pooled, and packed in
stretches too, so padding doesn't depend on how the corpus is split. Differencing starts from one partial partition for each piece. Again and again it takes
the two with the largest imbalance and merges them with opposing imbalances, the fullest window of one with the
emptiest of the other, until one partition is left. If a window then exceeds the capacity, one more window is tried.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, small_batches
from .bpe import byte_letters

CAPACITY, END_ID = 4096, 2
#: Tokens that are packed together, and tokens in a piece at most; longer rests of documents are cut evenly.
STRETCH, PIECE = 1 << 19, 1024
#: What makes a text unusual: characters whose case, form or class needs the library's own tables, and special tokens.
UNUSUAL = re.compile(r"[^\t\n\x0b\x0c\r\x20-\x7e\xa1-\u012f\u0132-\u0148\u014a-\u017e]|\xad|<\|")
#: How vocabularies that this knows cut texts into words, and their pattern of words for lower-case texts that
#: aren't unusual. With other vocabularies, the library encodes all texts whole.
KNOWN_CUT = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
]
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ž]+|[0-9²³¹¼-¾]|[^\sa-zªµºß-öø-ž0-9²³¹¼-¾]+")
#: Words remembered at a time, and the longest word that is remembered.
REMEMBERED, LONGEST_REMEMBERED = 800_000, 64
#: Characters that are tokenised at a time.
MOST_CHARS = 1 << 20


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, 0 to k - 1, of each item: a k-way partition with near-equal sums. Ties go by the items' order."""
    n = len(sizes)
    if n == 0:
        return np.empty(0, np.int64)
    # A partial partition is its filled windows' sums, fullest first, and a node for each; a node is an item or two nodes.
    left, right = [], []
    parts = {i: (np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes.tolist())}
    spread = lambda s: int(s[0] - (s[-1] if len(s) == k else 0))
    heap = [(-spread(s), i) for i, (s, _) in parts.items()]
    heapq.heapify(heap)
    label, node = n, n
    while len(heap) > 1:
        (sa, na), (sb, nb) = (parts.pop(heapq.heappop(heap)[1]) for _ in range(2))
        over = len(sa) + len(sb) - k
        if over <= 0:
            sums, nodes = np.concatenate([sa, sb]), np.concatenate([na, nb])
        else:  # window i of one meets window k - 1 - i of the other; the first few of either meet empty ones
            ta, tb = k - len(sb), k - len(sa)
            both = np.arange(node, node + over)
            left.append(na[ta:])
            right.append(nb[tb:][::-1])
            node += over
            sums = np.concatenate([sa[:ta], sa[ta:] + sb[tb:][::-1], sb[:tb]])
            nodes = np.concatenate([na[:ta], both, nb[:tb]])
        order = np.argsort(-sums, kind="stable")
        parts[label] = sums[order], nodes[order]
        heapq.heappush(heap, (-spread(parts[label][0]), label))
        label += 1
    window = np.full(node, -1, np.int64)
    (_, nodes), = parts.values()
    window[nodes] = np.arange(len(nodes))
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        for i in range(len(a) - 1, -1, -1):
            window[a[i]] = window[b[i]] = window[n + i]
    return window[:n]


def pack_sizes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item, none over capacity; the number of windows rises from the least until they hold."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = difference(sizes, k)
        if not len(sizes) or np.bincount(window, weights=sizes).max() <= capacity:
            return window
        k += 1


def cut_document(n: int, capacity: int, piece: int) -> list[int]:
    """The lengths that a document of n tokens is cut into: whole windows, then near-equal pieces."""
    whole, rest = divmod(n, capacity)
    m = -(-rest // piece)
    return [capacity] * whole + [rest // m + (i < rest % m) for i in range(m)]


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@cache
def known(path: str) -> bool:
    """Whether a tokenizer file cuts texts into words as KNOWN_CUT says, and ends a word as its merges expect."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    cut_by = [spec.get("normalizer"), (before[0].get("pattern") or {}).get("Regex")]
    level = before[-1].get("type") == "ByteLevel" and not before[-1].get("add_prefix_space") and not before[-1].get("use_regex", True)
    return cut_by == KNOWN_CUT and len(before) == 2 and before[0].get("invert") is True and before[0].get("behavior") == "Removed" and level and spec["model"]["type"] == "BPE"


def _stretches(text: str) -> list[str]:
    """A long text cut at spaces between ASCII letters, which this kind of vocabulary never joins over."""
    out = []
    while len(text) > MOST_CHARS:
        at = text.rfind(" ", 1, MOST_CHARS)
        while at > 0 and not (text[at - 1].isascii() and text[at - 1].isalpha() and text[at + 1 : at + 2].isascii() and text[at + 1 : at + 2].isalpha()):
            at = text.rfind(" ", 1, at)
        if at <= 0:
            break
        out.append(text[:at])
        text = text[at:]
    return [*out, text]


class _Words(dict):
    """The ids of words, as little-endian unsigned 32-bit numbers; the library's model merges those not remembered."""

    def __init__(self, path: str):
        self.merge, self.letters = _tokenizer(path).model.tokenize, byte_letters()

    def __missing__(self, word: str) -> bytes:
        shown = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        ids = [t.id for t in self.merge(shown)]
        got = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = got
        return got


_words = cache(_Words)


def token_ids(texts: list[str], path: str, end_id: int) -> list[np.ndarray]:
    """Each text's ids, with the end id behind them, as little-endian unsigned 32-bit numbers.

    The vocabulary never joins over words. So texts of plain Latin characters are cut into words here, each of which
    the library encodes once; other texts, and those with a special token's string, it encodes whole.
    """
    if not known(path):
        return _whole(texts, path, end_id)
    end = np.array([end_id], "<u4").tobytes()
    ids_of = _words(path).__getitem__
    out: list[np.ndarray | None] = []
    for x in texts:
        usual = not UNUSUAL.search(x)
        out.append(np.frombuffer(b"".join([*map(ids_of, WORD.findall(x.lower())), end]), "<u4") if usual else None)
    rest = [i for i, ids in enumerate(out) if ids is None]
    for i, ids in zip(rest, _whole([texts[i] for i in rest], path, end_id), strict=True):
        out[i] = ids
    return out


def _whole(texts: list[str], path: str, end_id: int) -> list[np.ndarray]:
    t = _tokenizer(path)
    parts = [_stretches(x) if known(path) else [x] for x in texts]
    flat = t.encode_batch_fast([p for ps in parts for p in ps], add_special_tokens=False)
    out, at = [], 0
    for ps in parts:
        ids = [i for e in flat[at : at + len(ps)] for i in e.ids]
        at += len(ps)
        out.append(np.array([*ids, end_id], "<u4"))
    return out


COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


class _Packer:
    """Deals pieces to windows, and numbers the windows of a task upward from `base`."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.upcoming = capacity, base

    def windows(self, rows: list[list]) -> pa.RecordBatch:
        """Fills in sequence_id and offset; pieces that fill a window stand alone."""
        alone = [i for i, r in enumerate(rows) if r[2] == self.capacity]
        items = [i for i, r in enumerate(rows) if r[2] != self.capacity]
        window = pack_sizes(np.array([rows[i][2] for i in items], np.int64), self.capacity)
        filled: dict[int, int] = {}
        for i, w in zip(items, window.tolist(), strict=True):
            rows[i][5], rows[i][6] = w, filled.get(w, 0)
            filled[w] = rows[i][6] + rows[i][2]
        new = {w: j for j, w in enumerate(sorted(filled))}
        for i in items:
            rows[i][5] = self.upcoming + new[rows[i][5]]
        for j, i in enumerate(alone):
            rows[i][5], rows[i][6] = self.upcoming + len(new) + j, 0
        self.upcoming += len(new) + len(alone)
        return as_batch(rows)


def as_batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=_NAMES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", stretch: int = STRETCH, piece: int = PIECE) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: path of the tokenizer file, which every executor has. Each document's ids are followed by end_id, so a
    null or empty text is one token. Whole windows of long documents stand alone; the rest is packed by differencing
    over stretches of what a task reads. Of the pieces that are left over in each task, less than a stretch, only the
    numbers are written to the shared folder, dealt out evenly and packed as well; texts are never shuffled. A sequence
    id is the task's number and one within it, and the second step's ids are larger than the first's. Repeated rows are
    packed each, and null ids stay. An empty table has no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(capacity, TaskContext.get().partitionId() << 40)
        rows: list[list] = []
        tokens = 0
        for batch in batches:
            column = [x.as_py() or "" for x in batch.column(1)]
            for k in range(0, len(column), 50):
                for d, ids in zip(batch.column(0)[k : k + 50].to_pylist(), token_ids(column[k : k + 50], tokenizer, end_id), strict=True):
                    at = 0
                    for n in cut_document(len(ids), capacity, piece):
                        rows.append([d, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids), None, None])
                        at += n
                    tokens += len(ids)
                if tokens >= stretch:
                    yield packer.windows(rows)
                    rows, tokens = [], 0
        if rows:
            yield as_batch(rows)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(capacity, (1 << 62) + (TaskContext.get().partitionId() << 40))
        rows: list[list] = []
        tokens = 0
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows.append(list(r))
                tokens += r[2]
                if tokens >= 2 * stretch:
                    yield packer.windows(rows)
                    rows, tokens = [], 0
        if rows:
            yield packer.windows(rows)

    pieces = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, COLUMNS))
    left = pieces.where("sequence_id is null")
    tokens = left.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    pooled = left.repartition(max(1, round(tokens / stretch))).mapInArrow(again, COLUMNS)
    return pieces.where("sequence_id is not null").union(pooled)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, tokens, padding): a sequence's tokens, and what it is padded by; by nothing at a power of two."""
    tokens = packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"))
    power = F.col("tokens").bitwiseAND(F.col("tokens") - 1) == 0
    return tokens.withColumn("padding", F.when(power, F.lit(0).cast("long")).otherwise(F.lit(CAPACITY) - F.col("tokens")))
