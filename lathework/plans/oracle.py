"""DuckDB SQL that gives the same rows as the queries of the same names."""

from __future__ import annotations

from ..dims import OPTION_LETTERS, STATE_LANGUAGE, TARGET_LANGUAGES
from ..functions.prompts import JUDGE_KINDS
from . import model_queries, report_queries
from .queries import _CORRECTIONS_SQL, _STRUCTURED_SQL, _lang_sql

_TARGETS = "[" + ", ".join(f"'{x}'" for x in TARGET_LANGUAGES) + "]"
_STATES = "[" + ", ".join(f"'{x}'" for x in sorted(STATE_LANGUAGE)) + "]"
_STATE_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in STATE_LANGUAGE.items())
_OPTIONS = [(lang, a, letter) for lang, inner in sorted(OPTION_LETTERS.items()) for a, letter in inner.items()]
_OPTION_ROWS = ", ".join(f"({i}, '{lang}', '{letter}')" for i, (lang, _, letter) in enumerate(_OPTIONS))
_QUESTIONS = (("short_q1", "short_a1"), ("short_q2", "short_a2"), ("mcq", "mcq_a"), ("true_false_q", "true_false_a"), ("long_q", "long_a"), ("adversarial_question", "adversarial_answer"))
_PUBLISHED_FIELDS = ("short_q1", "short_a1", "short_q2", "short_a2", "mcq", "mcq_a", "mcq_opt1", "mcq_opt2", "mcq_opt3", "mcq_opt4", "true_false_q", "true_false_a", "long_q")
_QA_VALUES = ", ".join(f"CASE WHEN doc_id % {i + 2} <> 0 THEN '{i} of ' || doc_id ELSE '' END AS {c}" for i, c in enumerate(_PUBLISHED_FIELDS)) + ", coalesce(text, '') AS long_a, '' AS adversarial_question, '' AS adversarial_answer"
_RULE = "CASE WHEN question_type LIKE '%short%' THEN '{short}' WHEN question_type LIKE '%adversarial%' THEN '{adversarial}' ELSE '{long}' END".format(**JUDGE_KINDS)

_OPEN = f"""
    rows AS (
        SELECT {_lang_sql("conv_id")} AS language, ['short_q1', 'short_q2', 'long_q', 'adversarial_question'][CAST(turn % 4 + 1 AS INTEGER)] AS question_type,
               CASE WHEN turn % 3 <> 2 THEN role ELSE '' END AS reference, text AS response
        FROM conversations),
    asked AS (
        SELECT *, CASE WHEN trim(response) <> '' AND reference <> '' THEN
               {_RULE} || chr(10) || 'Question: Why?' || chr(10) || 'Reference: ' || reference || chr(10) || 'Answer: ' || response || chr(10) || 'Reply with a number from 0 to 10 alone.' END AS prompt
        FROM rows),
    long AS (SELECT language, question_type, CAST(CAST('0x' || md5(prompt)[1:6] AS BIGINT) % 11 AS DOUBLE) AS score FROM asked)
"""


def _typed(value: str, table: str) -> str:
    return f"""
        SELECT 'language' AS scope, language, question_type, count(*) AS count, round(avg(score), 6) AS {value}, CAST(NULL AS BIGINT) AS total_data_points
        FROM long WHERE score IS NOT NULL GROUP BY language, question_type
        UNION ALL SELECT 'overall', NULL, NULL, count(score), round(avg(score), 6), (SELECT count(*) FROM {table}) FROM long"""


def _mmt_gram_counts() -> str:
    """Clipped counts by exploding runs of tokens: another way than the UDF's."""
    tokens = r"list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_replace(' ' || replace(replace(replace(replace(replace(replace({t}, '-' || chr(10), ''), chr(10), ' '), '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') || ' ', '([\{{-\~\[-\` -\&\(-\+\:-\@\/])', ' \1 ', 'g'), '([^0-9])([\.,])', '\1 \2 ', 'g'), '([\.,])([^0-9])', ' \1 \2', 'g'), '([0-9])(-)', '\1 \2 ', 'g'), '\s+'), lambda x: x <> '')".replace('\\"', '"')
    grams = "unnest(list_transform(range(1, len({w}) - n + 2), lambda i: array_to_string({w}[i:i + n - 1], chr(31)))) AS g"
    return f"""
        {_mmt_pairs()},
        words AS (SELECT id, target_language, {tokens.format(t="ref")} AS r, {tokens.format(t="hyp")} AS h FROM pairs),
        orders AS (SELECT unnest([1, 2, 3, 4]) AS n),
        r AS (SELECT id, n, g, count(*) AS c FROM (SELECT id, n, {grams.format(w="r")} FROM words, orders) GROUP BY ALL),
        h AS (SELECT id, n, g, count(*) AS c FROM (SELECT id, n, {grams.format(w="h")} FROM words, orders) GROUP BY ALL),
        hit AS (SELECT h.id, h.n, sum(least(h.c, r.c)) AS good FROM h JOIN r ON h.id = r.id AND h.n = r.n AND h.g = r.g GROUP BY ALL),
        each AS (
            SELECT w.id, w.target_language, len(w.r) AS rl, len(w.h) AS hl, o.n, coalesce(hit.good, 0) AS good, greatest(len(w.h) - o.n + 1, 0) AS total
            FROM words w CROSS JOIN orders o LEFT JOIN hit ON hit.id = w.id AND hit.n = o.n),
        zeros AS (SELECT *, sum(CASE WHEN good = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n) AS z FROM each),
        scored AS (
            SELECT id, any_value(target_language) AS target_language,
                   CASE WHEN sum(good) = 0 OR min(total) = 0 THEN 0.0 ELSE
                   exp(avg(ln(CASE WHEN good = 0 THEN 100.0 / (pow(2, z) * greatest(total, 1)) ELSE 100.0 * good / greatest(total, 1) END)))
                   * CASE WHEN any_value(hl) < any_value(rl) THEN exp(1 - any_value(rl) / any_value(hl)) ELSE 1.0 END END AS bleu
            FROM zeros GROUP BY id)
    """


#: White space of any script between words.
_SPACE = r"[\s\x{0085}\x{00A0}\x{001C}-\x{001F}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]+"


def _common(a: str, b: str) -> str:
    """How many first values two lists have in common."""
    return f"coalesce(nullif(list_position(list_transform(list_zip({a}, {b}), lambda p: p[1] IS NOT DISTINCT FROM p[2]), false), 0) - 1, len({a}))"


def _ribes() -> str:
    """Scores by what each word's run has in common with the runs of all words like it: another way than the UDF's."""
    words = lambda t: f"list_filter(string_split_regex(lower({t}), '{_SPACE}'), lambda x: x <> '')"

    def side(way: int, h: str, r: str) -> str:
        return f"""
            SELECT id, h.i, {way} AS way, r.j AS place, {_common(h, r)} AS n, true AS of_ref FROM sides JOIN spots h USING (id) JOIN ref_spots r USING (id) WHERE h.w = r.w
            UNION ALL SELECT id, h.i, {way}, k.i, {_common(h, h.replace("h.i", "k.i"))}, false FROM sides JOIN spots h USING (id) JOIN spots k USING (id) WHERE h.w = k.w AND h.i <> k.i"""

    # runs that end with the word, in lists that are turned round, and runs that start with it
    met = side(1, "hr[len(sides.h) - h.i + 1:]", "rr[len(sides.r) - r.j + 1:]") + " UNION ALL " + side(2, "sides.h[h.i:]", "sides.r[r.j:]")
    return f"""
        ribes_words AS (SELECT *, {words("ref")} AS r, {words("hyp")} AS h FROM pairs),
        sides AS (SELECT id, r, h, list_reverse(r) AS rr, list_reverse(h) AS hr FROM ribes_words),
        spots AS (SELECT id, unnest(h) AS w, unnest(range(1, len(h) + 1)) AS i FROM sides),
        ref_spots AS (SELECT id, unnest(r) AS w, unnest(range(1, len(r) + 1)) AS j FROM sides),
        met AS ({met}),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY id, i, way, of_ref ORDER BY n DESC, place) AS k FROM met),
        runs AS (
            SELECT id, i, way, max(n) FILTER (of_ref AND k = 1) AS a, any_value(place) FILTER (of_ref AND k = 1) AS place,
                   greatest(coalesce(max(n) FILTER (of_ref AND k = 2), 0), coalesce(max(n) FILTER (NOT of_ref), 0)) + 1 AS need
            FROM ranked GROUP BY id, i, way),
        told AS (SELECT id, i, place FROM runs WHERE need <= a QUALIFY row_number() OVER (PARTITION BY id, i ORDER BY need, way) = 1),
        rising AS (SELECT x.id, count(*) FILTER (x.place < y.place) AS up FROM told x JOIN told y ON x.id = y.id AND x.i < y.i GROUP BY x.id),
        counted AS (SELECT id, count(*) AS n FROM told GROUP BY id),
        ribes_each AS (
            SELECT id, target_language, CASE
                   WHEN len(r) = 0 THEN NULL WHEN len(h) = 0 THEN 0.0
                   WHEN n = 1 AND len(r) = 1 THEN pow(1.0 / len(h), 0.25) * pow(least(1.0, exp(1.0 - len(r) / len(h))), 0.1)
                   WHEN coalesce(n, 0) < 2 THEN 0.0
                   ELSE up / (n * (n - 1) / 2) * pow(n / len(h), 0.25) * pow(least(1.0, exp(1.0 - len(r) / len(h))), 0.1) END AS ribes
            FROM ribes_words LEFT JOIN counted USING (id) LEFT JOIN rising USING (id))
    """


def _mmt_pairs() -> str:
    return f"pairs AS (SELECT row_number() OVER () AS id, {_TARGETS}[CAST(conv_id % 10 + 1 AS INTEGER)] AS target_language, text AS ref, replace(replace(text, ' the ', ' a '), ',', ' and') AS hyp FROM conversations)"


#: Word distance a row of the table at a time: `least` of a row's earlier cells takes the place of the step along the row.
_ROW = "list_prepend(row[1] + 1, list_transform(range(1, len(costs) + 1), lambda k: least(row[k + 1] + 1, row[k] + costs[k])))"
_NEXT = f"list_transform([list_transform({_ROW}, lambda x, i: x - i)], lambda m: list_transform(m, lambda x, i: list_min(m[1:i]) + i))[1]"
_OCR = f"""
    folded AS (SELECT {_lang_sql("conv_id")} AS language, regexp_replace(text, '[^ -~]', '?', 'g') AS r FROM conversations),
    pairs AS (SELECT language, trim(r) AS r, trim(replace(translate(r, 'eo', 'cu'), 'in ', 'in')) AS h FROM folded),
    words AS (SELECT *, list_filter(string_split(r, ' '), lambda x: x <> '') AS rw, list_filter(string_split(h, ' '), lambda x: x <> '') AS hw FROM pairs),
    tables AS (SELECT *, list_prepend(range(0, len(rw) + 1), list_transform(hw, lambda x: list_transform(rw, lambda y: CASE WHEN x = y THEN 0::BIGINT ELSE 1::BIGINT END))) AS steps FROM words),
    distances AS (SELECT language, r, h, rw, hw, list_reduce(steps, lambda row, costs: {_NEXT})[len(rw) + 1] AS d FROM tables)
"""

#: Prompts by question type of item text about options w to z, in English.
_VQA = "CASE WHEN question_type IN ('short_q1', 'short_q2') THEN trim(text) || ' Keep the answer short, in English.' WHEN question_type = 'mcq' THEN 'Reply with one option alone, as <A>, <B>, <C> or <D>.' || chr(10) || text || chr(10) || 'A) w' || chr(10) || 'B) x' || chr(10) || 'C) y' || chr(10) || 'D) z' WHEN question_type = 'true_false_q' THEN 'Reply with one word alone, True or False.' || chr(10) || trim(text) WHEN question_type IN ('long_q', 'adversarial_question') THEN trim(text) || ' Explain in detail, in English.' ELSE '' END"
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&"))


def _unescaped(text: str) -> str:
    for a, b in _ENTITIES:
        text = f"replace({text}, '{a}', '{b}')"
    return text


_PAGE = "CASE WHEN page_id % 7 <> 0 THEN replace(html, 'class=\"ad\"', 'class=\"' || CASE page_id % 11 WHEN 0 THEN 'prp-page-qualityheader-note' WHEN 1 THEN 'prp-page-qualityheader quality3' ELSE 'prp-page-qualityheader' END || ' quality' || page_id % 5 || '\"') ELSE html END"

ORACLE_SQL: dict[str, str] = {
    "ocr_char_error_by_lang": f"""
        WITH folded AS (SELECT {_lang_sql("conv_id")} AS language, regexp_replace(text, '[^ -~]', '?', 'g') AS r FROM conversations),
        pairs AS (SELECT language, r, replace(translate(r, 'eo', 'cu'), 'in ', 'in') AS h FROM folded)
        SELECT language, count(*) AS n, round(avg(levenshtein(r, h) * 100.0 / greatest(length(r), length(h))), 6) AS char_error_pct FROM pairs GROUP BY language""",
    "ocr_word_distance_by_lang": f"WITH {_OCR} SELECT language, count(*) AS n, CAST(sum(d) AS BIGINT) AS distance, CAST(sum(greatest(len(rw), len(hw))) AS BIGINT) AS tokens FROM distances GROUP BY language",
    "ocr_report": f"""
        WITH {_OCR},
        scores AS (
            SELECT language, CAST(format('{{:.4f}}', d * 100.0 / greatest(len(rw), len(hw))) AS DOUBLE) AS w,
                   CAST(format('{{:.4f}}', levenshtein(r, h) * 100.0 / greatest(length(r), length(h))) AS DOUBLE) AS c FROM distances)
        SELECT CASE WHEN grouping(language) = 1 THEN 'overall' ELSE 'language' END AS scope, language, count(*) AS count,
               CAST(format('{{:.3f}}', CAST(sum(CAST(w AS DECIMAL(28, 4))) AS DOUBLE) / count(*)) AS DOUBLE) AS avg_anls_word, CAST(format('{{:.3f}}', CAST(sum(CAST(c AS DECIMAL(28, 4))) AS DOUBLE) / count(*)) AS DOUBLE) AS avg_anls_char
        FROM scores GROUP BY GROUPING SETS ((language), ())""",
    "mmt_ribes": f"WITH {_mmt_pairs()}, {_ribes()} SELECT target_language, count(ribes) AS n, round(avg(ribes), 6) AS avg_ribes FROM ribes_each GROUP BY target_language",
    "mmt_report": f"""
        WITH {_mmt_gram_counts()}, {_ribes()}
        SELECT target_language, count(*) AS count, round(avg(bleu), 6) AS avg_bleu, round(avg(ribes), 6) AS avg_ribes
        FROM ribes_each JOIN (SELECT id, bleu FROM scored) USING (id) WHERE ribes IS NOT NULL GROUP BY target_language""",
    "vqa_prompts": f"SELECT item_id, question_type, {_VQA} AS prompt FROM benchmark, (SELECT unnest([{', '.join(f"'{q}'" for q, _ in _QUESTIONS)}, 'other']) AS question_type)",
    "html_text": f"""
        WITH articles AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS inner_html FROM pages),
        nodes AS (SELECT page_id, list_transform(string_split_regex(inner_html, '(?s)<!--.*?-->|<[^>]*>'), lambda x: regexp_replace({_unescaped("x")}, '^\\s+|\\s+$', '', 'g')) AS n FROM articles)
        SELECT page_id, array_to_string(list_filter(n, lambda x: x <> ''), chr(10)) AS text FROM nodes""",
    "structured_report": f"WITH {_STRUCTURED_SQL} {_typed('accuracy', 'rows')}",
    "option_letters": f"""
        WITH options(k, language, letter) AS (VALUES {_OPTION_ROWS})
        SELECT o.language, o.letter, count(*) AS n FROM documents d JOIN options o ON o.k = d.doc_id % {len(_OPTIONS)} GROUP BY ALL""",
    "mmt_bleu": f"WITH {_mmt_gram_counts()} SELECT target_language, count(*) AS n, round(avg(bleu), 6) AS avg_bleu FROM scored GROUP BY target_language",
    "judge_report": f"WITH {_OPEN} {_typed('avg_score', 'rows')}",
    "judge_reply_scores": """
        SELECT event_id, CASE event_id % 5 WHEN 2 THEN NULL WHEN 4 THEN NULL WHEN 3 THEN CASE WHEN value < 0 THEN NULL ELSE 0.0 END
               ELSE greatest(least(CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE), 10.0), 0.0) END AS score FROM events""",
    "stratified_sample_lang": "SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|42'), doc_id) <= 90",
    "sample_then_min_words": r"""
        SELECT doc_id, lang FROM (SELECT doc_id, lang, text FROM documents WHERE lang IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|42'), doc_id) <= 90)
        WHERE len(list_filter(string_split_regex(text, '""" + _SPACE + r"""'), lambda t: t <> '')) > 100""",
    "drawn_pages": "SELECT page_id, url FROM pages ORDER BY md5(page_id || '|42'), page_id LIMIT 100",
    "drawn_beyond": "SELECT item_id FROM benchmark ORDER BY md5(item_id || '|7'), item_id LIMIT 50000",
    "language_filter": "SELECT doc_id, source FROM documents WHERE lower(lang) = 'fr'",
    "lang_lookup": f"""
        WITH dims(state, primary_language) AS (VALUES {_STATE_ROWS})
        SELECT primary_language, count(*) AS n FROM (SELECT list_append({_STATES}, 'Elsewhere')[CAST(c_custkey % 37 + 1 AS INTEGER)] AS state FROM customer) c LEFT JOIN dims USING (state) GROUP BY primary_language""",
    "target_lang_sample": f"""
        WITH dims(state, primary_language) AS (VALUES {_STATE_ROWS})
        SELECT c_custkey, state, primary_language FROM (SELECT c_custkey, {_STATES}[CAST(c_custkey % 36 + 1 AS INTEGER)] AS state FROM customer) JOIN dims USING (state)
        WHERE list_contains({_TARGETS}, primary_language) QUALIFY row_number() OVER (PARTITION BY state ORDER BY md5(c_custkey || '|42'), c_custkey) <= 30""",
    "upsert_corrections": f"""
        WITH {_CORRECTIONS_SQL}
        SELECT coalesce(d.doc_id, c.doc_id) AS doc_id,
               CASE WHEN c.doc_id IS NULL OR (d.doc_id IS NOT NULL AND trim(c.source) = '') THEN d.source ELSE c.source END AS source,
               CASE WHEN c.doc_id IS NULL OR (d.doc_id IS NOT NULL AND trim(c.lang) = '') THEN d.lang ELSE c.lang END AS lang
        FROM documents d FULL OUTER JOIN latest c ON d.doc_id = c.doc_id""",
    "overlay_latest": f"""
        WITH {_CORRECTIONS_SQL}
        SELECT d.doc_id, coalesce(c.source, d.source) AS source, coalesce(c.lang, d.lang) AS lang, CASE WHEN c.doc_id IS NULL THEN 'Not done yet' ELSE 'done' END AS edit_status
        FROM documents d LEFT JOIN latest c ON d.doc_id = c.doc_id""",
    "first_match_fallback": f"""
        WITH {_CORRECTIONS_SQL}
        SELECT d.doc_id, coalesce(c.source, d.source) AS source, coalesce(c.lang, d.lang) AS lang FROM documents d LEFT JOIN earliest c ON d.doc_id = c.doc_id""",
    "retry_remaining": "SELECT event_type, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 50) GROUP BY event_type",
    "status_split": "SELECT CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS part, event_type, count(*) AS n FROM events GROUP BY ALL",
    "qa_unpivot": " UNION ALL ".join(f"SELECT conv_id, turn, '{q}' AS question_type, '{i}:' || role AS question, CASE WHEN turn % {i + 2} <> 0 THEN '{i}:' || text END AS reference FROM conversations" for i, (q, _) in enumerate(_QUESTIONS)),
    "lang_unpivot": " UNION ALL ".join(f"SELECT item_id, '{lang}' AS target_language, CASE WHEN item_id % {i + 2} <> 0 THEN '{i}:' || text END AS reference_caption FROM benchmark" for i, lang in enumerate(TARGET_LANGUAGES)),
    "lang_cross": f"SELECT item_id, language, 'Translate this caption to ' || language || ', nothing else: ' || text AS prompt FROM benchmark, (SELECT unnest({_TARGETS}) AS language)",
    "url_parts": """
        WITH parts AS (SELECT page_id, url, string_split(url, '/') AS p FROM pages)
        SELECT page_id, substr(regexp_replace(url, '^https://', ''), 1, 2) AS code, p[-1] AS last, p[-2] AS parent, p[-3] AS grandparent,
               CASE WHEN lower(url) LIKE '%.png' THEN 'image/png' ELSE 'image/jpeg' END AS mime, 'base/' || p[-2] || '/' || p[-1] AS path FROM parts""",
    "title_urls": r"SELECT page_id, 'https://hi.wikisource.org/wiki/' || replace(url_encode(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ' ', '_')), '%2F', '/') AS url FROM pages",
    "html_quality_filter": f"SELECT page_id, url FROM (SELECT page_id, url, {_PAGE} AS html FROM pages) WHERE contains(html, 'class=\"prp-page-qualityheader quality4\"') OR contains(html, 'class=\"prp-page-qualityheader quality3 quality4\"')",
    "html_image": "SELECT page_id, CASE WHEN page_id % 3 = 1 AND contains(html, '<article>') THEN 'https://img.example.org/' || page_id || '.jpg' END AS image FROM pages",
    "llm_reply_parse": """
        SELECT event_id, CASE WHEN ok THEN 'q' || event_id END AS short_q1, CASE WHEN ok THEN event_type END AS short_a1, CASE WHEN ok THEN '' END AS short_q2,
               CASE WHEN ok THEN 'y' END AS mc_opt1_2, CASE WHEN ok THEN '' END AS mc_opt1_3, CASE WHEN ok THEN 'True' END AS true_false_a, CASE WHEN ok THEN '' END AS long_q
        FROM (SELECT event_id, event_type, event_id % 4 <> 3 AND json_valid(props) AS ok FROM events)""",
    "reply_lines": "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_type END AS question, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id AS VARCHAR) END AS answer FROM events",
    "option_lists": """
        SELECT item_id, 'q: ' || array_to_string(list_transform([1, 2, 3, 4], lambda i: CASE WHEN i <= item_id % 4 + 2 THEN CASE WHEN item_id % 2 = 0 THEN 'o' ELSE 'v' END || i ELSE '' END), ' | ') AS said FROM benchmark""",
    "unfenced_replies": r"""
        SELECT item_id, CASE item_id % 4 WHEN 2 THEN '```' ELSE '' END || CASE WHEN item_id % 4 = 2 THEN text ELSE regexp_replace(text, '^\s+', '') END AS text
        FROM (SELECT item_id, regexp_replace(text, '\s+$', '') AS text FROM benchmark)""",
    "publish_projection": f"""
        SELECT 'root/' || source || '/' || lang || '/' || doc_id || '.jpg' AS image, lang AS topic, source AS "State/UT", lang AS language, {_QA_VALUES}, source AS source_url FROM documents""",
    "union_by_language": "SELECT doc_id, CASE WHEN lang IS DISTINCT FROM (SELECT min(lang) FROM documents) THEN source END AS source, lang AS language FROM documents",
    "blank_passthrough": "SELECT item_id, CASE item_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE 'CHANGED' END AS text FROM benchmark",
    "judge_prompts": f"""
        WITH {_OPEN} SELECT question_type, {_RULE} || chr(10) || 'Question: Why?' || chr(10) || 'Reference: ' || reference || chr(10) || 'Answer: x' || chr(10) || 'Reply with a number from 0 to 10 alone.' AS prompt, count(*) AS n
        FROM rows GROUP BY ALL""",
} | model_queries.ORACLE_SQL | report_queries.ORACLE_SQL
