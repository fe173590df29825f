"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A character language model, trigrams counted over all documents, and a channel of leetspeak, spacing and repetition
span a lattice over each suspicious stretch of a text. Viterbi decoding finds its likeliest letters, which replace the
stretch where they are likelier than it as it stands. Words of the restored text are then weighed by a lexicon of word
beginnings, learned from labelled documents, and a logistic curve turns a document's weight into a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, small_batches

#: Labelled documents that the lexicon and the curve are fitted on at most. Features are of these alone, so they are
#: bounded with them.
MOST_TRAINED = 8000
#: Beginnings of words that are features, in characters; a whole word is one too.
BEGINNINGS = range(3, 9)
#: The least share of toxic ones among the learned documents that have a feature; and the share of a beginning's
#: documents at which a longer beginning, or the whole word, takes its place.
LEAST_PURITY, SAME = 0.9, 0.95
#: Characters that the language model counts at a time.
STRETCH = 1 << 19

# --- the character language model ---------------------------------------------------------------------------------


def _letters() -> np.ndarray:
    """The class of each character up to U+017F: 1 to 26 for a letter without its accent, 0 for what is no letter."""
    out = np.zeros(0x180, np.uint8)
    for i in range(0x180):
        base = unicodedata.normalize("NFD", chr(i))[0].lower()
        if "a" <= base <= "z":
            out[i] = ord(base) - 96
    return out


LETTER = _letters()


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return LETTER[np.where(points < len(LETTER), points, 0)]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(27**3, np.int64)
    for batch in batches:
        held, size = [], 0

        def add(text: str) -> None:
            c = classes(text).astype(np.int32)
            if len(c) > 2:
                counts[:] += np.bincount((c[:-2] * 27 + c[1:-1]) * 27 + c[2:], minlength=27**3)

        for x in batch.column(0):
            t = x.as_py() or ""
            for k in range(0, len(t), STRETCH):
                held.append(t[k : k + STRETCH])
                size += len(held[-1])
                if size > STRETCH:
                    add("\n\n" + "\n\n".join(held) + "\n\n")
                    held, size = [], 0
        if held:
            add("\n\n" + "\n\n".join(held) + "\n\n")
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["gram", "n"])


class CharModel:
    """Costs, in nats, of a letter after two others, smoothed by the shorter contexts; 0 stands for what is no letter."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(27, 27, 27).astype(float)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + 27)
        p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
        p3 = (three + 20 * p2) / (three.sum(axis=2, keepdims=True) + 20)
        self.cost = (-np.log(p3)).tolist()


def count_characters(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of all trigrams over all documents; 19,683 at most reach the driver."""
    small_batches(docs.sparkSession)
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_count_batches, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(27**3, np.int64)
    for r in counted.collect():
        out[r.gram] = r.n
    return out


# --- the channel --------------------------------------------------------------------------------------------------

#: What letters a sign of leetspeak may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "*": "aeiou", "#": "h", "(": "c", "{": "c"}
SIGNS = re.escape("".join(LEET))
#: Signs that may also end a word; the others are punctuation there.
ENDS = re.escape("0123456789@$€£")
#: Costs of the channel: a letter written as a sign; a sign that nothing stands behind; a letter repeated; a word's end
#: between spaced letters; what a sign within a word costs where the stretch is left as it stands; and punctuation
#: before a word, where it often stands.
SIGN, STRAY, REPEAT, GAP, AS_IS, AS_IS_FIRST = 1.0, 5.0, 0.3, 6.0, 6.5, 4.9
PUNCTUATION = "({#*+|!"
#: A stretch to decode: single characters set apart; a word with signs before or between letters, or at its end; one of
#: signs only; one with a letter thrice in a row. Words are entered at their beginnings alone and without going back, so
#: the search is linear in the text.
SPACED = rf"(?<![^\s])(?:[^\W_]|[{SIGNS}])(?:([ ._\-*])(?:[^\W_]|[{SIGNS}]))(?:\1{{1,3}}(?:[^\W_]|[{SIGNS}])){{2,}}(?![^\W_])"
MIXED = rf"(?<![^\W_])[^\W_{SIGNS}]*+(?:[{SIGNS}]++[^\W\d_]++)++(?:[{ENDS}]++(?!\w)|[{SIGNS}](?![{SIGNS}]))?"
ENDED = rf"(?<![^\W_])[^\W\d_]++[{ENDS}]++(?!\w)"
ALL_SIGNS = rf"(?<![\w{SIGNS}])[@$][@$€£!|+]{{2,}}+(?![\w{SIGNS}])"
RUN = r"(?<![^\W\d_])[^\W\d_]*([^\W\d_])\2\2+[^\W\d_]*"
SUSPICIOUS = re.compile(rf"{SPACED}|{MIXED}|{ENDED}|{ALL_SIGNS}|{RUN}", re.I)
#: Longest stretch whose decoding is remembered.
LONGEST_REMEMBERED = 64


def _table(holds) -> np.ndarray:
    return np.array([holds(chr(i)) for i in range(0x180)])


_IS_SIGN, _IS_END, _IS_GAP = (_table(lambda c, of=of: c in of) for of in ("".join(LEET), "0123456789@$£", " ._-*"))
_IS_LETTER = _table(lambda c: c.isalnum() and not c.isdecimal())
_LOW = _table(lambda c: ord(c.lower()[0])).astype(np.uint32)
_FAR_SIGNS = np.array([ord(c) for c in LEET if ord(c) >= 0x180], np.uint32)


def suspicious(points: np.ndarray) -> np.ndarray:
    """Where something begins that may be a stretch to decode: a quick test, for whole batches, that misses none."""
    far = points >= 0x180
    p = np.where(far, 0, points)
    letter, sign, gap, end, low = _IS_LETTER[p], _IS_SIGN[p], _IS_GAP[p], _IS_END[p], _LOW[p]
    if far.any():
        odd = points[far]
        euro = np.isin(odd, _FAR_SIGNS)
        letter[far], sign[far], end[far] = ~euro, euro, euro
        each, back = np.unique(odd, return_inverse=True)
        low[far] = np.array([ord(chr(x).lower()[0]) for x in each.tolist()], np.uint32)[back]
    out = np.zeros(len(p), bool)
    if len(p) > 1:
        out[:-1] = (sign[:-1] & letter[1:]) | (letter[:-1] & end[1:]) | (sign[:-1] & sign[1:] & ((points[:-1] == 64) | (points[:-1] == 36)))
    if len(p) > 2:
        out[:-2] |= letter[:-2] & (low[:-2] == low[1:-1]) & (low[:-2] == low[2:])
    if len(p) > 6:  # three single characters set apart, and a gap behind them
        solid = letter | sign
        alone = np.ones(len(p), bool)
        alone[1:] = ~letter[:-1]
        near = alone[:-5] & solid[:-5] & gap[1:-4] & solid[2:-3] & (points[1:-4] == points[3:-2])
        out[:-5] |= near & ((solid[4:-1] & gap[5:]) | gap[4:-1])
    return out


class Decoder:
    """Viterbi decoding of suspicious stretches of any length; what a short stretch decodes to is remembered."""

    def __init__(self, model: CharModel):
        self.cost, self.known = model.cost, {}

    def as_it_stands(self, text: str) -> float:
        """What it costs to leave a stretch as it is."""
        a = b = total = 0
        for c in classes(text).tolist():
            total += self.cost[a][b][c] if c else 0
            a, b = b, c
        total += self.cost[a][b][0]
        total += AS_IS * sum(ch in LEET for ch in text)
        return total - (AS_IS - AS_IS_FIRST if text[0] in PUNCTUATION else 0)

    def decode(self, text: str, gap: str | None = None) -> str:
        """The likeliest letters behind a stretch, or the stretch itself if that is likelier.

        gap: what stands between its characters, if they are set apart; such a stretch is never left as it is.
        """
        if len(text) > LONGEST_REMEMBERED:
            return self._decode(text, gap)
        got = self.known.get((text, gap))
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[text, gap] = self._decode(text, gap)
        return got

    def _decode(self, text: str, gap: str | None) -> str:
        total, out = self.best(text, gap)
        return text if gap is None and total >= self.as_it_stands(text) else out

    def best(self, text: str, gap: str | None = None) -> tuple[float, str]:
        """The least cost of a way through a stretch's lattice, and what it writes; of equal ways the one found first.

        Time and memory are linear in the stretch: a state is the two letters before and the last character written,
        with its cost and a chain of what has been written, which states share.
        """
        cost = self.cost
        states: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
        lowered = [ch.lower() for ch in text]
        for i, ch in enumerate(text):
            nxt: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}

            def reach(key, total, out, nxt=nxt):
                old = nxt.get(key)
                if old is None or old[0] > total:
                    nxt[key] = total, out

            if i and ch == gap:
                wide = gap in (text[i - 1], text[i + 1 : i + 2])
                for (a, b, last), (total, out) in states.items():  # of several gaps in a row, the first ends a word
                    if not wide or text[i - 1] == gap:
                        reach((a, b, last), total, out)
                    if text[i - 1] != gap:
                        reach((b, 0, ""), total + cost[a][b][0] + (0 if wide else GAP), (out, " "))
                states = nxt
                continue
            if ch in LEET:
                options = [(x, ord(x) - 96, SIGN) for x in LEET[ch]]
            else:
                first = ord(lowered[i][0])
                options = [(lowered[i], int(LETTER[first]) if first < 0x180 else 0, 0.0)]
            stray = ch in LEET and not ch.isdigit()
            run = lowered[i] * 3 in "".join(lowered[max(0, i - 2) : i + 3])
            for (a, b, last), (total, out) in states.items():
                if stray:
                    reach((a, b, last), total + STRAY, out)
                for x, c, more in options:
                    reach((b, c, x), total + more + cost[a][b][c], (out, x))
                    if run and c and x == last:
                        reach((a, b, last), total + more + REPEAT, out)
            states = nxt
        total, chain = min(((total + cost[a][b][0], out) for (a, b, _), (total, out) in states.items()), key=lambda x: x[0])
        letters = []
        while chain is not None:
            chain, x = chain
            letters.append(x)
        return total, "".join(reversed(letters))

    def restore(self, text: str) -> str:
        """The text with its suspicious stretches decoded."""
        return SUSPICIOUS.sub(lambda m: self.decode(m[0], m[1]), text)


def restore_batch(texts: list[str], decoder: Decoder) -> list[str]:
    """Restores texts; those without anything suspicious, most of them, are told by a test over all at once."""
    out = list(texts)
    held: list[int] = []
    size = 0

    def work() -> None:
        joined = "\n".join(texts[k] for k in held)
        hits = np.flatnonzero(suspicious(np.frombuffer(joined.encode("utf-32-le"), np.uint32)))
        starts = np.concatenate([[0], np.cumsum([len(texts[k]) + 1 for k in held])[:-1]])
        for j in np.unique(np.searchsorted(starts, hits, "right") - 1):
            out[held[j]] = decoder.restore(texts[held[j]])

    for k, t in enumerate(texts):
        held.append(k)
        size += len(t)
        if size > STRETCH:
            work()
            held, size = [], 0
    if held:
        work()
    return out


# --- the lexicon --------------------------------------------------------------------------------------------------

TOKEN = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """The beginnings of a word, and the word itself with its end marked."""
    return [word[:k] for k in BEGINNINGS if k <= len(word)] + [word + "$"]


@dataclass
class Model:
    """All that scoring takes; it is sent to the executors and bounded by MOST_TRAINED and the trigrams' number."""

    counts: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = 0.0
    slope: float = 0.0

    def score(self, total: float) -> float:
        z = self.intercept + self.slope * math.log1p(total)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


class _Weights(dict):
    """A word's weight: the most that one of its features weighs. Remembers what it has looked up."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > 500_000:
            self.clear()
        got = max((w for f in features(word) if (w := self.weights.get(f))), default=0.0)
        self[word] = got
        return got


def held_out(id_col: Column) -> Column:
    """Whether a document must not be learned from: crc32 of its id as text is divisible by 5. Null ids may be."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _weigh(texts: list[str], decoder: Decoder, weights: _Weights) -> list[float]:
    return [sum(map(weights.__getitem__, TOKEN.findall(t.lower()))) for t in restore_batch(texts, decoder)]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_TRAINED) -> Model:
    """Learns from the labelled documents that aren't held out, `most` of them, chosen by a hash of their id.

    The language model is counted over all of docs. Labels that are null don't count; of several labels of a document
    the larger holds. Near copies among the chosen, by three minimum hashes, are taken once, lest a copied text's words
    all seem telling. Without both labels every score is the share of toxic ones, or 0.5 without any.
    """
    spark = docs.sparkSession
    counts = count_characters(docs, text_col)
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("y"))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(CharModel(counts))
        for batch in batches:
            rows = [[], [], [], [], []]
            for y, t in zip(batch.column(0).to_pylist(), restore_batch(batch.column(1).to_pylist(), decoder), strict=True):
                words = TOKEN.findall(t.lower())
                grams = np.fromiter((hash3(a, b, c) for a, b, c in zip(words, words[1:], words[2:])), np.uint64) if len(words) > 2 else np.array([hash3(*words, "", "", "")], np.uint64)  # noqa: B905
                least = [int((grams * np.uint64(m) ^ (grams >> np.uint64(17))).min().view(np.int64)) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
                for column, x in zip(rows, [y, sorted(set(words)), *least], strict=True):
                    column.append(x)
            kinds = [pa.int32(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["y", "words", "m0", "m1", "m2"])

    of = texts.select("y", "text").mapInArrow(tokens, "y int, words array<string>, m0 long, m1 long, m2 long")
    for m in ("m0", "m1", "m2"):  # of the chosen only, a bounded number
        of = of.groupBy(m).agg(F.min(F.struct("y", "words", *[x for x in ("m0", "m1", "m2") if x != m])).alias("r")).select("r.*", m)
    of = cut(of.select("y", "words"))
    n, toxic = of.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    model = Model(counts)
    if not 0 < toxic < n:
        share = toxic / n if n else 0.5
        model.intercept = math.log((share + 1e-6) / (1 - share + 1e-6))
        return model
    lengths = F.array(*[F.lit(k) for k in BEGINNINGS])
    each = lambda w: F.concat(F.transform(F.filter(lengths, lambda k: k <= F.length(w)), lambda k: F.substr(w, F.lit(1), k)), F.array(F.concat(w, F.lit("$"))))
    seen = of.select("y", F.explode(F.array_distinct(F.flatten(F.transform("words", each)))).alias("f"))
    stats = cut(seen.groupBy("f").agg(F.sum("y").alias("pos"), F.count("*").alias("n")).where("n > 1"))
    total = stats.count()
    p0 = toxic / n
    pos, all_ = F.col("pos").cast("double"), F.col("n").cast("double")
    neg = all_ - pos
    weight = F.log((pos + 0.5) / (toxic + 1.0)) - F.log((neg + 0.5) / (n - toxic + 1.0))
    plog = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    surprise = plog(pos, all_ * p0) + plog(neg, all_ * (1 - p0))
    best = stats.select("f", "pos", weight.alias("weight"), surprise.alias("g")).where((pos >= LEAST_PURITY * all_) & (F.col("g") >= math.log(total + 1)))
    found = {r.f: (r.pos, r.weight) for r in best.collect()}
    model.weights = {f: w for f, (_, w) in most_specific(found).items()}

    weights = _Weights(model.weights)
    points = [(math.log1p(sum(map(weights.__getitem__, r.words))), r.y) for r in of.select("y", "words").toLocalIterator()]  # of the chosen only
    model.intercept, model.slope = logistic(np.array([p[0] for p in points]), np.array([p[1] for p in points], float))
    return model


def most_specific(found: dict[str, tuple[int, float]]) -> dict[str, tuple[int, float]]:
    """Without the beginnings that a longer one, or a whole word, has nearly all documents of; so the rest says more."""
    names = sorted(found)
    out = {}
    for i, f in enumerate(names):
        j = i + 1
        while j < len(names) and names[j].startswith(f) and found[names[j]][0] < SAME * found[f][0]:
            j += 1
        if j == len(names) or not names[j].startswith(f):
            out[f] = found[f]
    return out


def hash3(a: str, b: str = "", c: str = "", *_: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{a} {b} {c}")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> tuple[float, float]:
    """Intercept and slope of a logistic curve, fitted by Newton's method with a ridge on the slope."""
    a, b = 0.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([(p - y).sum() + 1e-3 * a, ((p - y) * x).sum() + ridge * b])
        h = np.array([[w.sum() + 1e-3, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def score_column(docs: DataFrame, model: Model, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns kept, and beside them the score of the whole text. A null text counts as empty."""
    small_batches(docs.sparkSession)
    from pyspark.sql.types import DoubleType, StructType

    rows = docs.select(*keep, F.col(text_col).alias("_toxicity_text"))
    schema = StructType([*rows.schema.fields[:-1]]).add("score", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, weights = Decoder(CharModel(model.counts)), _Weights(model.weights)
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.num_columns - 1).to_pylist()]
            scores = [model.score(t) for t in _weigh(texts, decoder, weights)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return rows.mapInArrow(run, schema)


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_TRAINED) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    Empty and null texts get the score of a text without any telling word. Repeated rows and null ids stay; a null id
    isn't held out, nor ever learned from. Other columns aren't read. An empty table gives an empty one.
    """
    model = fit(docs, labels, id_col, text_col, most)
    scored = score_column(docs, model, [F.col(id_col).cast("long").alias("doc_id")], text_col)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_TRAINED) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with their columns as they are."""
    model = fit(docs, labels, id_col, text_col, most)
    return score_column(docs, model, [F.struct("*").alias("_row")], text_col).where("score < 0.5").select("_row.*")
