"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from explainkit.llm.quality import GAMMA, PRIOR, RATIOS, REACH, SMALLEST

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def _shingles(table: str, key: str) -> str:
    return f"""SELECT {key}, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
        FROM (SELECT {key}, {_WORDS.format(_LOW)} AS w FROM {table})"""


CONTAINMENT = f"""WITH d AS ({_shingles('documents', 'doc_id')}), i AS ({_shingles('benchmark', 'item_id')}), n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
    c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i ON d.s = i.s GROUP BY doc_id, item_id)
    SELECT doc_id, c.item_id, n_shared, n_item, n_shared / n_item::DOUBLE AS containment FROM c JOIN n ON c.item_id = n.item_id WHERE n_shared >= 0.8 * n_item"""

_SHARES = {"symbol_ratio": ("n_symbols", "word_chars"), "upper_ratio": ("n_upper", "word_chars"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words")}
_RATIO = {k: f"CASE WHEN {b} > 0 THEN {a} / {b}::DOUBLE ELSE 0 END" for k, (a, b) in _SHARES.items()}
_ROWS = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS ratio, {v} AS x FROM stats" for k, v in _RATIO.items())
_SPREAD = "CASE ratio " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in RATIOS.items()) + " END"
_CUTS = ", ".join(f"max(cut) FILTER (ratio = '{k}') AS {k}_cut" for k in RATIOS)
_PICK = ", ".join(f"(a.docs * a.{k}_cut + {PRIOR} * ((b.docs * b.{k}_cut + {PRIOR} * c.{k}_cut) / (b.docs + {PRIOR}))) / (a.docs + {PRIOR}) AS {k}_cut" for k in RATIOS)
_WITHIN = " AND ".join(f"round({v}, 12) <= round({k}_cut, 12)" for k, v in _RATIO.items())

QUALITY = rf"""WITH base AS (SELECT doc_id, lang, source, text, {_WORDS.format("coalesce(text, '')")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
    win AS (SELECT doc_id, i, w[i:i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base)),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n >= 2),
    rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (VALUES (0), (1), (2)) v(o) GROUP BY doc_id),
    stats AS (SELECT b.doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, len(list_filter(string_split(coalesce(text, ''), ''), lambda c: lower(c) <> c))::BIGINT AS n_upper
        FROM base b LEFT JOIN rep ON b.doc_id = rep.doc_id),
    rows AS ({_ROWS}), fine AS (SELECT lang, source, ratio, CASE WHEN x >= {SMALLEST} THEN ceil(ln(x) / ln({GAMMA}::DOUBLE))::INTEGER END AS bucket, count(*) AS n FROM rows GROUP BY ALL),
    sk AS (SELECT 0 AS level, * FROM fine UNION ALL SELECT 1, lang, NULL, ratio, bucket, sum(n) FROM fine GROUP BY lang, ratio, bucket UNION ALL SELECT 2, NULL, NULL, ratio, bucket, sum(n) FROM fine GROUP BY ratio, bucket),
    up AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, ratio ORDER BY bucket NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY level, lang, source, ratio) AS docs, CASE WHEN bucket IS NULL THEN 0 ELSE 2 * pow({GAMMA}::DOUBLE, bucket) / ({GAMMA}::DOUBLE + 1) END AS x FROM sk),
    q AS (SELECT level, lang, source, ratio, min(x) FILTER (upto >= 0.25 * docs) AS low, min(x) FILTER (upto >= 0.5 * docs) AS mid, max(docs) AS docs FROM up GROUP BY ALL),
    f AS (SELECT *, mid + {REACH} * greatest(mid - low, {_SPREAD}) AS cut FROM q), g AS (SELECT level, lang, source, max(docs) AS docs, {_CUTS} FROM f GROUP BY level, lang, source),
    cuts AS (SELECT a.lang AS cut_lang, a.source AS cut_source, {_PICK} FROM (SELECT * FROM g WHERE level = 0) a LEFT JOIN (SELECT * FROM g WHERE level = 1) b ON a.lang IS NOT DISTINCT FROM b.lang CROSS JOIN (SELECT * FROM g WHERE level = 2) c),
    v AS (SELECT s.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_WITHIN} AS within FROM stats s JOIN cuts ON s.lang IS NOT DISTINCT FROM cut_lang AND s.source IS NOT DISTINCT FROM cut_source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND within AS kept, n_lines, n_upper FROM v"""
