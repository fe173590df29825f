"""Queries of the text functions, with documents and conversations as carriers, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net as N
from ..functions import scores as S
from ..functions import text as T
from ..session import table

#: Phrases of the carriers' invented prose; a caller passes the lists that its mail needs.
URGENT = ["this is", "in the", "of the", "and the", "to the", "the", "idiot", "worthless"]
FEAR = ["the only", "that the", "stupid", "scum"]


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Detectors of personal data and of lexicons, an additive risk and its band, rolled up by source."""
    d = docs(spark, sf).select("source", F.size(T.found(F.col("text"), T.EMAIL)).alias("emails"), F.size(T.cards(F.col("text"))).alias("cards"), F.size(T.found(F.col("text"), T.DOTTED_QUAD)).alias("ips"), F.size(T.lexicon_hits(F.col("text"), URGENT)).alias("hits"))
    risk = F.least(F.lit(100), 30 * F.col("cards") + 15 * F.col("emails") + 10 * F.col("ips") + 4 * F.col("hits"))
    d = d.withColumn("risk", risk.cast("long")).withColumn("band", S.severity_band(F.col("risk"), F.col("risk") > 0))
    rolled = d.groupBy("source").agg(F.count("*").alias("docs"), F.max("risk").alias("max_risk"), F.count_if(F.col("band").isin("high", "critical")).alias("severe"), F.sum("emails").alias("emails"), F.sum("cards").alias("cards"))
    return rolled.orderBy(F.desc("severe"), F.desc("max_risk"), "source").limit(20)


_LUHN = """(list_sum(list_transform(range(len({x})), lambda i: CASE WHEN i % 2 = 0 THEN CAST({x}[len({x}) - i] AS INTEGER)
    ELSE CAST({x}[len({x}) - i] AS INTEGER) * 2 - CASE WHEN CAST({x}[len({x}) - i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)"""
_EMAIL, _CARD, _QUAD = (p.replace("'", "''") for p in (T.EMAIL, T.CARD, T.DOTTED_QUAD))
_HITS = lambda ps: f"list_distinct(regexp_extract_all(lower(text), '{T.lexicon_pattern(ps)}'))"

_FLAGSHIP = f"""WITH d AS (
    SELECT source, len(regexp_extract_all(text, '{_EMAIL}')) AS emails, len(list_filter(regexp_extract_all(text, '{_CARD}'), lambda x: {_LUHN.format(x="x")})) AS cards,
           len(regexp_extract_all(text, '{_QUAD}')) AS ips, len({_HITS(URGENT)}) AS hits FROM documents
), r AS (SELECT *, least(100, 30 * cards + 15 * emails + 10 * ips + 4 * hits) AS risk FROM d)
SELECT source, count(*) AS docs, max(risk) AS max_risk, count(*) FILTER (risk >= 50) AS severe, CAST(sum(emails) AS BIGINT) AS emails, CAST(sum(cards) AS BIGINT) AS cards
FROM r GROUP BY source ORDER BY severe DESC, max_risk DESC, source LIMIT 20"""

def _first_line():
    return F.substring_index(F.col("text"), "\n", 1)


def _first_email(c):
    return F.regexp_extract(c, f"({T.EMAIL})", 1)


def simhash_md5(c):
    """A 32-bit SimHash over the words' MD5, as a number: the SQL twin of the 64-bit one."""
    ws = F.array_distinct(F.filter(F.split(T.text_or_empty(c), r"\s+"), lambda w: w != ""))
    hashes = F.transform(ws, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("bigint"))

    def bit(b: int):
        ones = F.size(F.filter(hashes, lambda h: F.shiftright(h, b).bitwiseAND(F.lit(1)) == 1))
        return F.when(2 * ones > F.size(hashes), F.lit(1 << b)).otherwise(F.lit(0)).cast("bigint")

    bits = [bit(b) for b in range(32)]
    return sum(bits[1:], bits[0])


def with_handles(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts, to some of which handles are added, as their ids tell, and things that are none."""
    d = F.col("doc_id").cast("string")
    more = [F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" Pay shop."), d, F.lit("@OkSBI, not me@sbi.co "))), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" 0x"), F.sha1(d.cast("binary")), F.lit(" "))), F.when(F.col("doc_id") % 5 == 0, F.lit(" (HDFC0AB12CD) xHDFC0AB12CD by Western  Union or MoneyGram ")), F.when(F.col("doc_id") % 6 == 0, F.lit(" mtcn MTCN "))]
    return docs(spark, sf).select("doc_id", F.concat_ws("", "text", *more).alias("text"))


QUERIES = {
    "pay_handles": lambda s, d: with_handles(s, d).select("doc_id", F.array_join(T.payment_handles(F.col("text")), "|").alias("handles")),
    "flagship": flagship,
    "digest_raw": lambda s, d: docs(s, d).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.md5(F.col("text").cast("binary")).alias("md5")),
    "subj_norm": lambda s, d: docs(s, d).select("doc_id", T.normalize_subject(F.concat(F.lit("Re: [list] FW: "), _first_line())).alias("subject")),
    "subj_stem": lambda s, d: docs(s, d).select("doc_id", T.subject_stem(F.concat(F.lit("Re: FW: "), _first_line())).alias("stem")),
    "lang_detect": lambda s, d: docs(s, d).groupBy(T.language(F.col("text")).alias("detected")).agg(F.count("*").alias("n")),
    "lex_hits": lambda s, d: docs(s, d).select("doc_id", F.array_join(F.array_sort(T.lexicon_hits(F.col("text"), URGENT)), ",").alias("hits")),
    "nlp_urgency": lambda s, d: docs(s, d).select("doc_id", F.round(F.least(F.lit(1.0), 0.25 * F.size(T.lexicon_hits(F.col("text"), URGENT)) + 0.15 * F.size(T.lexicon_hits(F.col("text"), FEAR)) + F.least(F.lit(0.2), F.regexp_count("text", F.lit("!")) / F.greatest(F.lit(1), F.length("text")) * 10)), 6).alias("urgency")),
    "nlp_cues": lambda s, d: docs(s, d).select("doc_id", F.array_join(F.array_compact(F.array(F.when(F.size(T.lexicon_hits(F.col("text"), URGENT)) > 2, "urgency"), F.when(F.size(T.lexicon_hits(F.col("text"), FEAR)) > 0, "fear"), F.when(F.size(T.found(F.col("text"), T.EMAIL)) > 0, "contact"))), ",").alias("cues")),
    "luhn": lambda s, d: docs(s, d).select("doc_id", F.explode(T.found(F.col("text"), T.CARD)).alias("digits")).select("doc_id", "digits", T.luhn(F.col("digits")).alias("valid")),
    "detect_email": lambda s, d: docs(s, d).groupBy("source").agg(F.sum(F.size(T.found(F.col("text"), T.EMAIL))).alias("emails"), F.sum(F.size(T.found(F.col("text"), T.CARD))).alias("numbers")),
    "mask_email": lambda s, d: docs(s, d).select("doc_id", F.explode(T.found(F.col("text"), T.EMAIL)).alias("e")).select("doc_id", T.mask_email(F.col("e")).alias("masked")),
    "mask_name": lambda s, d: docs(s, d).select("doc_id", T.mask_name(F.col("text")).alias("masked")),
    "csv_guard": lambda s, d: docs(s, d).select("doc_id", T.csv_guard(F.col("text")).alias("cell")),
    "str_entropy": lambda s, d: table(s, d, "pages").select("page_id", F.round(T.shannon(F.col("url")), 6).alias("entropy")),
    "shingles": lambda s, d: docs(s, d).select(F.explode(T.shingles(F.regexp_replace("text", "[^A-Za-z ]", " "))).alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")).where("n > 2"),
    "simhash_md5": lambda s, d: docs(s, d).select("doc_id", simhash_md5(F.col("text")).alias("simhash")),
    "hamming": lambda s, d: docs(s, d).select("doc_id", T.hamming(F.substring(F.md5(F.col("text").cast("binary")), 1, 16), F.lit("ffffffffffffffff")).cast("int").alias("bits")),
    "homoglyph_fold": lambda s, d: docs(s, d).select("doc_id", T.fold_homoglyphs(F.col("text"), {"é": "e", "ä": "a", "0": "o", "1": "l", "rn": "m", "vv": "w"}).alias("folded")),
    "msgid_domain": lambda s, d: docs(s, d).select("doc_id", T.message_id_domain(_first_email(F.col("text"))).alias("domain")),
    "filename_sanitise": lambda s, d: table(s, d, "pages").select("page_id", T.safe_filename(F.col("url")).alias("name"), T.file_extension(F.regexp_replace("url", r"[?#].*$", "")).alias("extension")),
    "header_get": lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.min_by(F.when(F.lower("role") == "assistant", F.col("text")), F.when(F.lower("role") == "assistant", F.col("turn"))).alias("first_reply")),
    "ip_extract": lambda s, d: docs(s, d).select("doc_id", F.explode(F.array_distinct(T.found(F.col("text"), T.DOTTED_QUAD))).alias("ip")).where(N.ip_number(F.col("ip")).isNotNull()),
    "ip_private": lambda s, d: docs(s, d).select("doc_id", F.explode(F.array_distinct(T.found(F.col("text"), T.DOTTED_QUAD))).alias("ip")).select("doc_id", "ip", N.is_private(N.ip_number(F.col("ip"))).alias("private")).where("private IS NOT NULL"),
    "cidr_match": lambda s, d: cidr_match(s, d),
    "agg_holdout": lambda s, d: docs(s, d).join(table(s, d, "labels"), "doc_id").select("toxic", (F.size(T.lexicon_hits(F.col("text"), ["idiot", "scum", "moron", "trash", "clown"])) > 0).cast("int").alias("predicted")).groupBy("toxic", "predicted").agg(F.count("*").alias("n")),
    "agg_tfidf": lambda s, d: docs(s, d).select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^a-z]+"))).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("df")).where("df >= 5"),
}


def cidr_match(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses within networks: a join of a number to a range. The networks are a constant, broadcast table."""
    nets = spark.createDataFrame([(f"{a}.0.0.0/8",) for a in range(0, 256, 5)] + [("10.128.0.0/9",), ("192.168.0.0/16",)], "cidr string")
    nets = nets.withColumn("r", N.cidr_range(F.col("cidr")))
    found = docs(spark, sf).select("doc_id", F.explode(F.array_distinct(T.found(F.col("text"), T.DOTTED_QUAD))).alias("ip")).withColumn("n", N.ip_number(F.col("ip"))).where("n IS NOT NULL")
    return found.join(F.broadcast(nets), F.col("n").between(F.col("r.lo"), F.col("r.hi"))).select("doc_id", "ip", "cidr")


_IPS = f"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{_QUAD}')) AS ip FROM documents"
_NUM = "(SELECT doc_id, ip, list_reduce([CAST(o AS BIGINT) FOR o IN string_split(ip, '.')], lambda a, b: a * 256 + b) AS n FROM ips WHERE list_max([CAST(o AS BIGINT) FOR o IN string_split(ip, '.')]) <= 255)"
_BETWEEN = " OR ".join(f"n BETWEEN {N.number_of(a)} AND {N.number_of(a) + (1 << (32 - b)) - 1}" for a, b in N.NOT_PUBLIC)
_BITS = " + ".join(f"CASE WHEN 2 * len(list_filter(h, lambda x: (x >> {b}) & 1 = 1)) > len(h) THEN {1 << b} ELSE 0 END" for b in range(32))
_PREFIX = T.SUBJECT_PREFIX.replace("'", "''")

ORACLE_SQL = {
    "pay_handles": "SELECT doc_id, concat_ws('|', CASE WHEN doc_id % 3 = 0 THEN 'UPI shop.' || doc_id || '@oksbi' END, CASE WHEN doc_id % 4 = 0 THEN 'wallet 0x' || sha1(CAST(doc_id AS VARCHAR)) END, CASE WHEN doc_id % 5 = 0 THEN 'IFSC HDFC0AB12CD|moneygram' END, CASE WHEN doc_id % 6 = 0 THEN 'mtcn' END) AS handles FROM documents",
    "flagship": _FLAGSHIP,
    "digest_raw": "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents",
    "subj_norm": f"SELECT doc_id, substring(trim(regexp_replace(regexp_replace(regexp_replace(lower('Re: [list] FW: ' || string_split(text, chr(10))[1]), '{_PREFIX}', ''), '[0-9]+', '#', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 1, 80) AS subject FROM documents",
    "subj_stem": f"SELECT doc_id, substring(trim(regexp_replace(regexp_replace(trim('Re: FW: ' || string_split(text, chr(10))[1]), '(?i){_PREFIX}', ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 1, 40) AS stem FROM documents",
    "lang_detect": "SELECT CASE WHEN length(regexp_replace(text, '[^\\p{L}\\x{0900}-\\x{097F}]', '', 'g')) > 0 AND length(regexp_replace(text, '[^\\x{0900}-\\x{097F}]', '', 'g')) > 0.3 * length(regexp_replace(text, '[^\\p{L}\\x{0900}-\\x{097F}]', '', 'g')) THEN 'hi' ELSE 'en' END AS detected, count(*) AS n FROM documents GROUP BY 1",
    "lex_hits": f"SELECT doc_id, array_to_string(list_sort({_HITS(URGENT)}), ',') AS hits FROM documents",
    "nlp_urgency": f"SELECT doc_id, round(least(1.0, 0.25 * len({_HITS(URGENT)}) + 0.15 * len({_HITS(FEAR)}) + least(0.2, CAST(length(text) - length(replace(text, '!', '')) AS DOUBLE) / greatest(1, length(text)) * 10))::DOUBLE, 6) AS urgency FROM documents",
    "nlp_cues": f"SELECT doc_id, array_to_string(list_filter([CASE WHEN len({_HITS(URGENT)}) > 2 THEN 'urgency' END, CASE WHEN len({_HITS(FEAR)}) > 0 THEN 'fear' END, CASE WHEN regexp_matches(text, '{_EMAIL}') THEN 'contact' END], lambda x: x IS NOT NULL), ',') AS cues FROM documents",
    "luhn": f"SELECT doc_id, digits, {_LUHN.format(x='digits')} AS valid FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_CARD}')) AS digits FROM documents)",
    "detect_email": f"SELECT source, CAST(sum(len(regexp_extract_all(text, '{_EMAIL}'))) AS BIGINT) AS emails, CAST(sum(len(regexp_extract_all(text, '{_CARD}'))) AS BIGINT) AS numbers FROM documents GROUP BY source",
    "mask_email": f"SELECT doc_id, CASE WHEN length(l) <= 1 THEN '*' WHEN length(l) = 2 THEN l[1] || '*' ELSE l[1] || '***' || l[-1] END || '@' || string_split(e, '@')[2] AS masked FROM (SELECT doc_id, e, string_split(e, '@')[1] AS l FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS e FROM documents))",
    "mask_name": """SELECT doc_id, CASE WHEN t = '' THEN '' WHEN len(ws) = 0 THEN '*' ELSE array_to_string(list_transform(ws[1:3], lambda w: replace(upper(w[1]), 'ẞ', 'SS') || '.'), ' ') END AS masked
        FROM (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ \\t\\n\\r\\f\\v,]+'), lambda w: regexp_matches(w, '^[\\p{L}\\p{N}]')) AS ws FROM (SELECT doc_id, trim(trim(text), '"') AS t FROM documents))""",
    "csv_guard": "SELECT doc_id, CASE WHEN regexp_matches(text, '^[=+\\-@\\t\\r]') THEN '''' ELSE '' END || text AS cell FROM documents",
    "str_entropy": "SELECT page_id, round(-sum(c / n * log2(c / n)), 6) AS entropy FROM (SELECT page_id, n, ch, count(*)::DOUBLE AS c FROM (SELECT page_id, length(url) AS n, unnest(string_split(url, '')) AS ch FROM pages) GROUP BY ALL) GROUP BY page_id",
    "shingles": "WITH w AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z ]', ' ', 'g')), '\\w+') AS w FROM documents), s AS (SELECT unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE w END) AS shingle FROM w) SELECT shingle, count(*) AS n FROM s GROUP BY shingle HAVING count(*) > 2",
    "simhash_md5": f"SELECT doc_id, CAST({_BITS} AS BIGINT) AS simhash FROM (SELECT doc_id, list_transform(list_distinct(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')), lambda w: CAST('0x' || substring(md5(w), 1, 8) AS BIGINT)) AS h FROM documents)",
    "hamming": "SELECT doc_id, CAST(64 - bit_count(CAST('0x' || substring(md5(text), 1, 16) AS UBIGINT)) AS INTEGER) AS bits FROM documents",
    "homoglyph_fold": "SELECT doc_id, replace(replace(translate(lower(text), 'éä01', 'eaol'), 'rn', 'm'), 'vv', 'w') AS folded FROM documents",
    "msgid_domain": f"SELECT doc_id, CASE WHEN e = '' THEN '' ELSE lower(string_split(e, '@')[-1]) END AS domain FROM (SELECT doc_id, regexp_extract(text, '({_EMAIL})', 1) AS e FROM documents)",
    "filename_sanitise": "SELECT page_id, substring(regexp_replace(url, '^.*[/\\\\]', ''), 1, 255) AS name, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\\.([A-Za-z0-9]{1,10})$', 1)) AS extension FROM pages",
    "header_get": "SELECT conv_id, arg_min(text, turn) FILTER (lower(role) = 'assistant') AS first_reply FROM conversations GROUP BY conv_id",
    "ip_extract": f"WITH ips AS ({_IPS}) SELECT doc_id, ip FROM {_NUM}",
    "ip_private": f"WITH ips AS ({_IPS}) SELECT doc_id, ip, ({_BETWEEN}) AS private FROM {_NUM}",
    "cidr_match": f"WITH ips AS ({_IPS}), nets AS (SELECT CAST(a AS VARCHAR) || '.0.0.0/8' AS cidr, a * 16777216 AS lo, a * 16777216 + 16777215 AS hi FROM range(0, 256, 5) t(a) UNION ALL SELECT '10.128.0.0/9', {N.number_of('10.128.0.0')}, {N.number_of('10.255.255.255')} UNION ALL SELECT '192.168.0.0/16', {N.number_of('192.168.0.0')}, {N.number_of('192.168.255.255')}) SELECT doc_id, ip, cidr FROM {_NUM} JOIN nets ON n BETWEEN lo AND hi",
    "agg_holdout": "SELECT toxic, CAST(regexp_matches(lower(text), '\\b(?:idiot|scum|moron|trash|clown)\\b') AS INTEGER) AS predicted, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL",
    "agg_tfidf": "SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM documents) WHERE term <> '' GROUP BY term HAVING count(*) >= 5",
}
