"""Text functions over columns: subjects, languages, lexicons, masking, digests, similarity. No Python runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SUBJECT_PREFIX = r"^\s*(?:(?:re|fw|fwd|aw|wg|sv|tr)\s*:\s*|\[[^\]]{1,30}\]\s*)+"
#: What a spreadsheet takes for a formula.
FORMULA = r"^[=+\-@\t\r]"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
CARD = r"\b\d{13,19}\b"
DOTTED_QUAD = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text_or_empty(c), r"\s+", " "))


def normalize_subject(c: Column) -> Column:
    """Lower case without reply and list tags, digit runs as '#', at most 80 characters. Null gives ''."""
    bare = F.regexp_replace(F.lower(text_or_empty(c)), SUBJECT_PREFIX, "")
    return F.substring(collapse(F.regexp_replace(bare, r"\d+", "#")), 1, 80)


def subject_stem(c: Column) -> Column:
    """The subject without tags, at most 40 characters."""
    return F.substring(collapse(F.regexp_replace(F.trim(text_or_empty(c)), "(?i)" + SUBJECT_PREFIX, "")), 1, 40)


def language(c: Column) -> Column:
    """'hi' where over 30 % of the letters are Devanagari, else 'en'."""
    deva = F.length(F.regexp_replace(text_or_empty(c), r"[^\x{0900}-\x{097F}]", ""))
    letters = F.length(F.regexp_replace(text_or_empty(c), r"[^\p{L}\x{0900}-\x{097F}]", ""))
    return F.when((letters > 0) & (deva > F.lit(0.3) * letters), "hi").otherwise("en")


def lexicon_pattern(phrases: Sequence[str]) -> str:
    """One alternation of all phrases, longest first, so that a longer phrase wins over its beginning."""
    import re

    ordered = sorted(dict.fromkeys(p.lower() for p in phrases), key=lambda p: (-len(p), p))
    return r"\b(?:" + "|".join(re.escape(p).replace(r"\ ", " ") for p in ordered) + r")\b"


def lexicon_hits(c: Column, phrases: Sequence[str], most: int | None = None) -> Column:
    """The phrases found in the lower-cased text, distinct, in the order of their first occurrence."""
    hits = F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(lexicon_pattern(phrases)), F.lit(0)))
    return hits if most is None else F.slice(hits, 1, most)


def csv_guard(c: Column) -> Column:
    """A cell that a spreadsheet would run as a formula gets an apostrophe in front. Null gives ''."""
    t = text_or_empty(c)
    return F.when(t.rlike(FORMULA), F.concat(F.lit("'"), t)).otherwise(t)


def mask_email(c: Column) -> Column:
    """First and last letter of the local part; what holds no '@' stays."""
    t = text_or_empty(c)
    domain = F.substring_index(t, "@", -1)
    local = F.substr(t, F.lit(1), F.length(t) - F.length(domain) - 1)
    shown = F.when(F.length(local) <= 1, "*").when(F.length(local) == 2, F.concat(F.left(local, F.lit(1)), F.lit("*"))).otherwise(F.concat(F.left(local, F.lit(1)), F.lit("***"), F.right(local, F.lit(1))))
    return F.when(F.instr(t, "@") == 0, t).otherwise(F.concat(shown, F.lit("@"), domain))


def mask_name(c: Column) -> Column:
    """Initials of the first three words; '*' where there is no word, '' for an empty name."""
    t = F.btrim(F.trim(text_or_empty(c)), F.lit('"'))
    ws = F.filter(F.split(t, r"[\s,]+"), lambda w: w.rlike(r"^[\p{L}\p{N}]"))
    initials = F.array_join(F.transform(F.slice(ws, 1, 3), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lit("."))), " ")
    return F.when(t == "", "").when(F.size(ws) == 0, "*").otherwise(initials)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the mod-10 check."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(d, F.lit(0), lambda a, b: a + b) % 10 == 0


def found(c: Column, pattern: str) -> Column:
    """All matches of a pattern, in order."""
    return F.regexp_extract_all(text_or_empty(c), F.lit(pattern), F.lit(0))


def cards(c: Column) -> Column:
    """Digit runs of a card's length that pass the Luhn check."""
    return F.filter(found(c, CARD), luhn)


def shannon(c: Column) -> Column:
    """Entropy of a text's characters in bits; 0 for an empty text."""
    t = text_or_empty(c)
    chars = F.split(t, "")
    n = F.length(t).cast("double")
    each = F.transform(F.array_distinct(chars), lambda x: (F.length(t) - F.length(F.replace(t, x, F.lit("")))) / n)
    return F.when(t == "", 0.0).otherwise(-F.aggregate(each, F.lit(0.0), lambda a, p: a + p * F.log2(p)))


def shingles(c: Column, width: int = 3) -> Column:
    """All runs of `width` lower-cased Unicode words, repeats included; of fewer words each by itself."""
    ws = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(r"(?U)\w+"), F.lit(0))

    def runs(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(width)]))
        return F.when(F.size(w) >= width, each).otherwise(w)

    return F.element_at(F.transform(F.array(ws), runs), 1)  # bound to a variable, the words are worked out once


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit digests in hex; 64 where either isn't one."""
    ok = a.rlike("^[0-9a-fA-F]{16}$") & b.rlike("^[0-9a-fA-F]{16}$")
    number = lambda x: F.conv(x, 16, -10).cast("bigint")
    return F.when(ok, F.bit_count(number(a).bitwiseXOR(number(b)))).otherwise(64)


def message_id_domain(c: Column) -> Column:
    """What stands right of the last '@', without angle brackets."""
    t = F.regexp_replace(text_or_empty(c), r"[<>\s]", "")
    return F.when(F.instr(t, "@") > 0, F.lower(F.substring_index(t, "@", -1))).otherwise("")


def safe_filename(c: Column) -> Column:
    """Base name without control characters, at most 255 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(text_or_empty(c), r"[\x00-\x1f\x7f]", ""), r"^.*[/\\]", ""), 1, 255)


def file_extension(c: Column) -> Column:
    """Lower-case extension of up to ten letters and digits, or ''."""
    return F.lower(F.regexp_extract(text_or_empty(c), r"\.([A-Za-z0-9]{1,10})$", 1))


def tag_map(c: Column) -> Column:
    """A 'k=v; k=v' list as a map of lower-case keys; the first of equal keys counts."""
    pairs = F.filter(F.transform(F.split(text_or_empty(c), ";"), lambda p: F.split(p, "=", 2)), lambda p: F.size(p) == 2)
    kv = F.transform(pairs, lambda p: F.struct(F.lower(F.trim(p[0])).alias("k"), F.trim(p[1]).alias("v")))
    first = F.filter(kv, lambda e, i: ~F.exists(F.slice(kv, 1, i), lambda x: x["k"] == e["k"]))
    return F.map_from_entries(first)


def fold_homoglyphs(c: Column, table: dict[str, str]) -> Column:
    """Look-alike characters as plain letters; table: single characters, or pairs, and what each stands for."""
    t = F.lower(text_or_empty(c))
    single = {k: v for k, v in table.items() if len(k) == 1 and len(v) == 1}
    t = F.translate(t, "".join(single), "".join(single.values()))
    for k, v in table.items():
        if len(k) > 1:
            t = F.replace(t, F.lit(k), F.lit(v))
    return t


# Handles to which money is sent. What stands before and behind is looked at, so that parts of words don't count.
UPI = (
    r"(?i)(?<![\w.])[a-z0-9][a-z0-9._-]{1,}@(?:ybl|paytm|ptyes|ptaxis|ptsbi|pthdfc|okaxis|oksbi|okicici|okhdfcbank|"
    r"okbizaxis|ibl|axl|apl|yapl|upi|ikwik|fam|kotak|indus|sbi|hdfcbank|icici|axisbank|barodampay|cnrb|boi|pnb|"
    r"idfcbank|federal|dbs|yesbank|waaxis|wasbi|wahdfcbank|waicici|freecharge|airtel|slice|naviaxis|goaxb|kmbl|"
    r"abfspay|superyes|tapicici|timecosmos|mbk|amazonpay|jupiteraxis|rapl|axisb|postbank|jio)(?![\w.])"
)
# After bc1, 1 b i o never occur, and the whole length modulo 8 is never 0, 3 or 5 (BIP 173): so digests of 32, 40, 56 or 64 hex digits are none.
BC1 = r"bc1(?=(?:[a-z0-9]{8}){3,7}(?:[a-z0-9]|[a-z0-9]{3,4}|[a-z0-9]{6,7})(?![A-Za-z0-9]))[02-9ac-hj-np-z]{25,62}"
WALLET = rf"(?<![A-Za-z0-9])(?:{BC1}|[13][a-km-zA-HJ-NP-Z1-9]{{25,34}}|0x[a-fA-F0-9]{{40}}|T[A-Za-z1-9]{{33}})(?![A-Za-z0-9])"
IFSC = r"(?<![A-Za-z0-9])[A-Z]{4}0[A-Z0-9]{6}(?![A-Za-z0-9])"
REMITTANCE = r"(?i)\b(?:western union|moneygram|ria money|mtcn)\b(?![\w.%+-]*@)"  # nor does the name of a mailbox
MOST_HANDLES = 8
# ---


def payment_handles(c: Column, most: int = MOST_HANDLES) -> Column:
    """array<string>, distinct, `most` at most: UPI addresses, wallets, bank codes and remittance services of a text, in that order."""
    t = text_or_empty(c)
    named = lambda name, xs: F.transform(xs, lambda x: F.concat(F.lit(name), x))
    kinds = [named("UPI ", F.transform(found(t, UPI), F.lower)), named("wallet ", found(t, WALLET)), named("IFSC ", found(t, IFSC)), F.transform(found(t, REMITTANCE), F.lower)]
    return F.slice(F.array_distinct(F.concat(*kinds)), 1, most)
