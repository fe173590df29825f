"""Quality rules by distribution divergence. DataFrame functions only.

A document's histogram of character classes and its histogram of common words are compared, by Jensen-Shannon distance,
to those of each language, which are added up over all documents of the corpus that pass the plain rules on length and
on repeated words. The nearest language, by the sum of both distances, decides. Short texts scatter more, so the squares
of the limits have an allowance of a share over the number of words, and below a least number of words there is no
verdict.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, fresh_path
from .common import SPACES, words


@dataclass(frozen=True)
class Rules:
    """Least words; most percent of words in repeated windows; least words, limits and allowance of the distances."""

    least_words: int = 10
    most_repeated: int = 20
    window: int = 5
    judged_words: int = 40
    most_chars: float = 0.245
    most_words: float = 0.27
    allowance: float = 2.0
    languages: tuple[str, ...] = ("en", "de", "fr", "es")


#: Character classes: a letter for each, and the characters in it, the frequent ones first. What is in none makes up
#: one more class, and the bytes beyond one for each character another.
CLASSES = {"v": "aeiou", " ": " \t", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".": ".,", "#": "#*$%&|<>", "0": "0123456789", "\n": "\n", "!": "!?"}
#: Common words of the languages, of up to four letters, by length.
COMMON = (
    "a y".split(),
    "of to in is on as it de la le et en un du el se no".split(),
    "the and for was der die und den von das mit des que les los por con".split(),
    "that with sich dans pour para sont sind this from".split(),
)
#: Letters that stand for the common words, in their order.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
N_COMMON = sum(map(len, COMMON))
SYMBOLS = list(CLASSES).index("#")


def _count(text: Column, letter: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))


def coded_chars(text: Column) -> Column:
    """The text with a class's letter for each character; consonants and what else could be taken for a letter are gone."""
    of = {c: letter for letter, chars in CLASSES.items() for c in chars}
    mapped = {c: letter for c, letter in of.items() if c != letter}
    gone = [c for c in {*map(chr, range(ord("a"), ord("z") + 1)), *CLASSES} if c not in of]
    return F.translate(text, "".join([*mapped, *sorted(gone)]), "".join(mapped.values()))


def class_counts(text: Column, coded: list[Column]) -> Column:
    """array<int>: how many characters of each class, of none, and how many bytes beyond one for each character.

    coded: what coded_chars gives, and that without the first class, without the first two, and so on; so what is
    scanned soon is short.
    """
    each = [F.length(a) - F.length(b) for a, b in zip(coded, coded[1:], strict=False)]
    rest = F.length(text)
    for c in each:
        rest = rest - c
    return F.array(*each, rest, F.octet_length(text) - F.length(text))


def word_letters(ws: Column) -> Column:
    """A string of a letter for each word that is one of the common words."""
    at, by_length = 0, []
    for group in COMMON:
        by_length.append((group, "_" + LETTERS[at : at + len(group)]))
        at += len(group)

    def letter(w: Column) -> Column:
        n = F.length(w)
        out = F.lit("_")
        for k in (1, 4, 2, 3):  # the most frequent length is looked at first
            group, letters = by_length[k - 1]
            place = F.array_position(F.array(*[F.lit(x) for x in group]), w).cast("int")
            out = F.when(n == k, F.substr(F.lit(letters), place + 1, F.lit(1))).otherwise(out)
        return out

    return F.replace(F.array_join(F.transform(F.filter(ws, lambda w: F.length(w) <= len(COMMON)), letter), ""), F.lit("_"), F.lit(""))


def word_counts(letters: Column, n_words: Column) -> Column:
    """array<int>: how many words are none of the common words, and how many each of them."""
    return F.array(n_words - F.length(letters), *[_count(letters, x) for x in LETTERS[:N_COMMON]])


def repeated_words(window_hashes: Column, window: int) -> Column:
    """How many words lie in windows that occur twice or more, the first occurrence included.

    Sorted with their places, equal windows are neighbours; what they cover is added up over the sorted places.
    """
    placed = F.sort_array(F.transform(window_hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.lit(None).cast("long")

    def twice(s: Column) -> Column:
        same = lambda e, j: F.coalesce(F.when(j >= 0, F.get(s, j)["h"]).otherwise(none) == e["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e["i"]))

    def cover(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window)))), F.lit(0), lambda a, b: a + b)

    # An array of one, so that what is sorted is worked out once and then referred to.
    once = F.transform(F.array(placed), lambda s: F.element_at(F.transform(F.array(twice(s)), cover), 1))
    return F.when(F.size(F.array_distinct(window_hashes)) == F.size(window_hashes), F.lit(0)).otherwise(F.element_at(once, 1))


def measured(docs: DataFrame, keep: list[Column], text_col: str = "text", lang_col: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """The columns kept, and beside them _lang, the counts of the base rules, base_failed, and the histograms _cc and _wc."""
    w, k = F.col("_w"), rules.window
    step = docs.select(*keep, F.col(lang_col).alias("_lang"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    step = step.select("*", coded_chars(F.col("_t")).alias("_c0"), words(F.col("_t")).alias("_w"))
    for i, letter in enumerate(CLASSES, 1):
        step = step.withColumn(f"_c{i}", F.replace(F.col(f"_c{i - 1}"), F.lit(letter), F.lit("")))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    windows = F.when(F.size(w) >= k, windows).otherwise(F.array().cast("array<bigint>"))
    step = step.withColumns({"_wl": word_letters(w), "_lines": lines, "_h": windows})
    step = step.withColumns({"_cc": class_counts(F.col("_t"), [F.col(f"_c{i}") for i in range(len(CLASSES) + 1)]), "_wc": word_counts(F.col("_wl"), F.size(w))})
    counts = {
        "n_words": F.size(w),
        "word_chars": F.length(F.concat_ws("", w)),
        "n_symbols": F.col("_cc")[SYMBOLS],
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": repeated_words(F.col("_h"), k),
    }
    step = step.withColumns({c: of.cast("long") for c, of in counts.items()})
    step = step.withColumn("base_failed", (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeated * F.col("n_words")))
    return step.drop("_wl", "_lines", "_h", "_w", "_t", *[f"_c{i}" for i in range(len(CLASSES) + 1)])


def references(of: DataFrame, rules: Rules = Rules()) -> list[tuple[list[float], list[float]]]:
    """Each language's shares of character classes and of common words, over all of its documents that pass the base rules.

    The driver gets a row for each of rules.languages at most. Languages without any text have none.
    """
    n_c, n_w = len(CLASSES) + 2, N_COMMON + 1
    sums = [F.sum(F.col("_cc")[i]) for i in range(n_c)] + [F.sum(F.col("_wc")[i]) for i in range(n_w)]
    out = []
    for r in sorted(of.where(F.col("_lang").isin(*rules.languages) & ~F.col("base_failed")).select("_lang", "_cc", "_wc").groupBy("_lang").agg(*sums).collect()):
        c, w = list(r[1 : 1 + n_c]), list(r[1 + n_c :])
        if sum(c) and sum(w):
            out.append(([x / sum(c) for x in c], [x / sum(w) for x in w]))
    return out


def _plog(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(0.0)


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)


def distance(shares: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance, 0 to 1, of an array of shares from a reference: the root of the divergence."""
    ref = F.array(*[F.lit(float(x)) for x in reference])
    middle = _sum(F.zip_with(shares, ref, lambda p, q: _plog((p + q) / 2)))
    own = sum(x * math.log2(x) for x in reference if x > 0)
    return F.sqrt(F.greatest((_sum(F.transform(shares, _plog)) + own) / 2 - middle, F.lit(0.0)))


def verdict(of: DataFrame, known: list[tuple[list[float], list[float]]], rules: Rules = Rules()) -> DataFrame:
    """Adds to what measured() gives char_distance, word_distance (null below rules.judged_words, or where no language is
    known) and kept, in place of the histograms.
    """
    total = lambda c: F.greatest(F.aggregate(c, F.lit(0), lambda a, b: a + b), F.lit(1))
    step = of.withColumns({"_cn": total("_cc"), "_wn": total("_wc")})
    step = step.withColumns({"_cs": F.transform("_cc", lambda x: x / F.col("_cn")), "_ws": F.transform("_wc", lambda x: x / F.col("_wn"))})
    if known:
        both = [(distance(F.col("_cs"), c), distance(F.col("_ws"), q)) for c, q in known]
        nearest = F.when(F.col("n_words") >= rules.judged_words, F.array_min(F.array(*[F.struct((c + w).alias("total"), c.alias("c"), w.alias("w")) for c, w in both])))
    else:
        nearest = F.lit(None).cast("struct<total:double,c:double,w:double>")
    step = step.withColumn("_near", nearest).withColumns({"char_distance": F.col("_near.c"), "word_distance": F.col("_near.w")})
    more = F.lit(rules.allowance) / F.greatest("n_words", F.lit(1))
    limit = lambda most: F.sqrt(F.lit(most * most) + more)
    far = (F.col("char_distance") > limit(rules.most_chars)) | (F.col("word_distance") > limit(rules.most_words))
    return step.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).drop("_lang", "_cc", "_wc", "_cn", "_wn", "_cs", "_ws", "_near")


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """The verdict on every document: doc_id, the counts, base_failed, the distances, kept.

    A null or empty text has no words and fails the base rules. A null or unknown language only keeps a text out of the
    references. Repeated rows and null ids stay; other columns aren't read. An empty table gives an empty one. What is
    measured, some numbers for each document, is cut off in the shared folder, as references and verdicts both read it.
    """
    of = cut(measured(docs, [F.col(id_col).cast("long").alias("doc_id")], text_col, lang_col, rules))
    return verdict(of, references(of, rules), rules)


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that are kept, with their columns as they are.

    Rows and what is measured of them are written to the shared folder, so that references and verdicts read it and each
    text is measured once. Nothing is shuffled but a row a task and language.
    """
    path = fresh_path(docs.sparkSession, "measured")
    measured(docs, [F.struct("*").alias("_row")], text_col, lang_col, rules).write.option("compression", "zstd").parquet(path)
    of = docs.sparkSession.read.parquet(path)
    judged = verdict(of, references(of, rules), rules)
    # As a filter it would be pushed below the steps, and each of them written out as often as the next ones name it.
    return judged.select(F.explode(F.when(F.col("kept"), F.array("_row"))).alias("_row")).select("_row.*")
