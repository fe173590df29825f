"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from . import line_dedup, quality

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: Each row is a page; a line counts once a page.
LINE_DEDUP = f"""
WITH pages AS (
    SELECT row_number() OVER () AS k, doc_id, source, text, coalesce(source, '') AS host, string_split(text, chr(10)) AS lines
    FROM documents
), held AS (
    SELECT DISTINCT k, host, trim(line, {_SPACES}) AS line FROM (SELECT k, host, unnest(lines) AS line FROM pages)
), total AS (
    SELECT host, count(*) AS pages FROM pages GROUP BY host
), bad AS (
    SELECT held.host, held.line
    FROM held JOIN total USING (host)
    WHERE line <> ''
    GROUP BY held.host, held.line
    HAVING count(*) >= {line_dedup.LEAST_PAGES} AND count(*) > {line_dedup.RATIO} * any_value(total.pages)
), by_host AS (
    SELECT host, list(line) AS bad FROM bad GROUP BY host
), kept AS (
    SELECT pages.*, list_filter(lines, lambda x: trim(x, {_SPACES}) = '' OR NOT list_contains(coalesce(bad, []), trim(x, {_SPACES}))) AS rest
    FROM pages LEFT JOIN by_host USING (host)
)
SELECT doc_id, source, array_to_string(rest, chr(10)) AS text,
       coalesce(len(list_filter(lines, lambda x: trim(x, {_SPACES}) <> '')), 0)::BIGINT AS n_lines,
       coalesce(len(lines) - len(rest), 0)::BIGINT AS n_dropped
FROM kept
"""

SHARDING = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"

_ESCAPE = r"regexp_replace({x}, '(<|\[)(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')"

#: What a conversation should read back as, and the characters that its template and escapes come to.
CHAT = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'
), by_conv AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS shown,
           coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
           sum(length({_ESCAPE.format(x="role")}) + length({_ESCAPE.format(x="text")}) + {len("<|turn|><|body|><|end|>")}) AS formatted_chars
    FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(shown) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM by_conv
"""


def _quality() -> str:
    rules = quality.Rules()
    classes = ["length(regexp_replace(t, '[^" + "".join("\\" + c if c in "#*$%&|<>.,!?" else c for c in chars) + "]', '', 'g'))" for chars in quality.CLASSES.values()]
    common = [w for group in quality.COMMON for w in group]
    n_c, n_w = len(classes) + 2, len(common) + 1
    count = ", ".join(f"len(list_filter(w, lambda x: x = '{c}'))" for c in common)
    plog = "list_sum(list_transform({x}, lambda v: CASE WHEN v > 0 THEN v * log2(v) ELSE 0 END))"
    js = lambda own, ref, n: f"sqrt(greatest(0, (({plog.format(x=own)}) + ({plog.format(x=ref)})) / 2 - ({plog.format(x=f'[({own}[i] + {ref}[i]) / 2 FOR i IN range(1, {n + 1})]')})))"
    share = lambda x: f"list_transform({x}, lambda v: v / greatest(list_sum({x}), 1))"
    langs = ", ".join(f"'{x}'" for x in rules.languages)
    k = rules.window
    window = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"""
WITH docs AS (
    SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM documents
), counted AS (
    SELECT *, [{", ".join(classes)}] AS c, [{count}] AS q FROM docs
), hist AS (
    SELECT k, doc_id, lang, t, w, list_concat(c, [length(t) - list_sum(c), strlen(t) - length(t)]) AS c, list_concat([len(w) - list_sum(q)], q) AS q FROM counted
), windows AS (
    SELECT k, i, {window} AS win FROM (SELECT k, w, unnest(range(1, len(w) - {k - 2})) AS i FROM docs WHERE len(w) >= {k})
), twice AS (
    SELECT k, i FROM windows QUALIFY count(*) OVER (PARTITION BY k, win) > 1
), covered AS (
    SELECT k, sum(n) AS n_repeat_words FROM (SELECT k, least({k}, coalesce(lead(i) OVER (PARTITION BY k ORDER BY i) - i, {k})) AS n FROM twice) GROUP BY k
), base AS (
    SELECT hist.k, doc_id, lang, c, q, w, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, c[{quality.SYMBOLS + 1}]::BIGINT AS n_symbols,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\v\\f\\r]')) AS lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM hist LEFT JOIN covered ON covered.k = hist.k
), judged AS (
    SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_words < {rules.least_words} OR 100 * n_repeat_words > {rules.most_repeated} * n_words AS base_failed FROM base
), refs AS (
    SELECT lang, {share('c')} AS rc, {share('q')} AS rq FROM (
        SELECT lang, [{", ".join(f"sum(c[{i}])" for i in range(1, n_c + 1))}]::DOUBLE[] AS c, [{", ".join(f"sum(q[{i}])" for i in range(1, n_w + 1))}]::DOUBLE[] AS q FROM judged WHERE lang IN ({langs}) AND NOT base_failed GROUP BY lang
    ) WHERE list_sum(c) > 0 AND list_sum(q) > 0
), shares AS (
    SELECT k, {share('c::DOUBLE[]')} AS oc, {share('q::DOUBLE[]')} AS oq FROM hist WHERE len(w) >= {rules.judged_words}
), each_lang AS (
    SELECT k, {js('oc', 'rc', n_c)} AS jc, {js('oq', 'rq', n_w)} AS jq FROM shares, refs
), nearest AS (
    SELECT k, arg_min(jc, jc + jq) AS jc, arg_min(jq, jc + jq) AS jq FROM each_lang GROUP BY k
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(jc > sqrt({rules.most_chars**2} + {rules.allowance} / greatest(n_words, 1)) OR jq > sqrt({rules.most_words**2} + {rules.allowance} / greatest(n_words, 1)), false) AS kept
FROM judged LEFT JOIN nearest ON nearest.k = judged.k
"""


QUALITY = _quality()
