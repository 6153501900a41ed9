"""Text, JSON and prompt functions over the document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from explainkit.functions import json_text, text
from explainkit.plans.adapters import REVIEWS_SQL, read, reviews

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


#: Part names dressed up so that every rule has something to do.
DRESSED = "CASE p_partkey % 6 WHEN 0 THEN 'It''s a ' || p_name || ' for kids!' WHEN 1 THEN 'This product: ' || p_name || ' (two-in-one), overall' WHEN 2 THEN 'The item costs $3.50, see http://x.com/a now ' || p_name WHEN 3 THEN p_name || ' mail me@x.org twenty times...' WHEN 4 THEN 'they ' || p_name ELSE p_name END"


def dressed(spark, d):
    return read(spark, d, "part").selectExpr("p_partkey", f"{DRESSED.replace(chr(39) * 2, chr(92) + chr(39))} AS s")


_PARTS = f"WITH p AS (SELECT p_partkey, {DRESSED} AS s FROM part)"
_URL = r"regexp_replace({0}, '\b(?:https?://|www\.)\S+\b', ' <url> ', 'gi')"
_EMAIL = r"regexp_replace({0}, '\b[\w\.-]+@[\w\.-]+\.\w+\b', ' <email> ', 'gi')"
_LEAD = r"regexp_replace({0}, '^(?:it|this|that|they|these|those|this\s+product|this\s+item|the\s+item|the\s+product)\b\s*', 'the product ', 'i')"


def _numbers(c: str) -> str:
    for word, digits in text.NUMBER_WORDS.items():
        c = rf"regexp_replace({c}, '\b{word}\b', '{digits}', 'gi')"
    return c


_STEP1 = _EMAIL.format(_URL.format("trim(lower(s))"))
_STEP2 = rf"""regexp_replace(regexp_replace({_STEP1}, '[\-_–—]+', ' ', 'g'), '[/\\|()\[\]{{}}:;"“”‘’`~^+=<>]', ' ', 'g')"""
_STEP3 = _numbers(f"trim({_LEAD.format(f'''translate({_STEP2}, ',.', '  ')''')})")
_STEP4 = rf"trim(regexp_replace(trim(regexp_replace({_STEP3}, '\s+', ' ', 'g')), '[.!?]+$', ''))"
_STEP5 = rf"trim(regexp_replace(regexp_replace({_STEP4}, '\b(?:overall|anyway)\b$', '', 'i'), '\s+', ' ', 'g'))"
_NORMAL = f"{_PARTS}, n AS (SELECT p_partkey, {_STEP5} AS t FROM p)"


@query("normalize_statement", f"{_NORMAL} SELECT p_partkey, CASE WHEN length(t) >= 8 AND len(string_split(t, ' ')) >= 3 AND t <> 'the product' THEN t END AS statement FROM n")
def _(spark, d):
    return dressed(spark, d).select("p_partkey", text.normalize_statement(F.col("s")).alias("statement"))


@query("normalize_validity", f"{_NORMAL} SELECT count(*) AS n, count(*) FILTER (length(t) >= 8 AND len(string_split(t, ' ')) >= 3 AND t <> 'the product') AS valid FROM n")
def _(spark, d):
    s = dressed(spark, d).select(text.normalize_statement(F.col("s"), unescape=False).alias("t"))
    return s.agg(F.count("*").alias("n"), F.count("t").alias("valid"))


@query("mask_url_email", f"{_PARTS} SELECT p_partkey, {_EMAIL.format(_URL.format('s'))} AS t FROM p")
def _(spark, d):
    return dressed(spark, d).select("p_partkey", text.mask_url_email(F.col("s")).alias("t"))


@query("leading_subject", f"{_PARTS} SELECT p_partkey, {_LEAD.format('s')} AS t FROM p")
def _(spark, d):
    return dressed(spark, d).select("p_partkey", text.leading_subject(F.col("s")).alias("t"))


@query("number_words", f"{_PARTS} SELECT p_partkey, {_numbers('s')} AS t FROM p")
def _(spark, d):
    return dressed(spark, d).select("p_partkey", text.number_words(F.col("s")).alias("t"))


@query("number_bucket", "SELECT p_partkey, 'size ' || CASE WHEN p_size <= 1 THEN '<n1>' WHEN p_size <= 2 THEN '<n2>' WHEN p_size <= 5 THEN '<n3_5>' WHEN p_size <= 10 THEN '<n6_10>' ELSE '<n10p>' END || ' of ' || CASE WHEN p_retailprice <= 1 THEN '<n1>' WHEN p_retailprice <= 2 THEN '<n2>' WHEN p_retailprice <= 5 THEN '<n3_5>' WHEN p_retailprice <= 10 THEN '<n6_10>' ELSE '<n10p>' END AS t FROM part")
def _(spark, d):
    s = F.concat(F.lit("size "), F.col("p_size").cast("string"), F.lit(" of "), F.col("p_retailprice").cast("decimal(12,2)").cast("string"))
    return read(spark, d, "part").select("p_partkey", text.number_bucket(s).alias("t"))


@query("html_nfkc")
def _(spark, d):
    return read(spark, d, "pages").select("page_id", text.unescape_nfkc(F.col("html")).alias("text"))


@query("word_truncate", r"SELECT doc_id, CASE WHEN len(w) > 12 THEN array_to_string(w[1:12], ' ') ELSE text END AS t FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", text.word_truncate(F.col("text"), 12).alias("t"))


@query("k_shingles", r"SELECT doc_id, len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))::INTEGER AS n FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents)")
def _(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", F.size(text.k_shingles(F.col("text"), 3)).alias("n"))


_SENTENCES = f"WITH {REVIEWS_SQL}, l AS (SELECT row_id, list_filter(list_transform(regexp_split_to_array(review, '[:,?!\\n.]'), lambda x: trim(x, ' \t\r\n')), lambda x: x <> '') AS l FROM reviews), s AS (SELECT row_id, unnest(l) AS exp, generate_subscripts(l, 1) - 1 AS pos FROM l)"


@query("sentence_split", f"{_SENTENCES} SELECT row_id, pos::INTEGER AS pos, exp FROM s")
def _(spark, d):
    return reviews(spark, d).select("row_id", F.posexplode(text.sentences(F.col("review"))).alias("pos", "exp"))


@query("sentence_attrs", f"{_SENTENCES}, w AS (SELECT row_id, pos, list_filter(regexp_split_to_array(lower(exp), '\\s+'), lambda x: x <> '') AS w FROM s) SELECT row_id, pos::INTEGER AS pos, len(w)::INTEGER AS word_num, len(list_filter(w, lambda x: x IN ({', '.join(repr(w) for w in text.SUBJECT_WORDS)})))::INTEGER AS subj_num FROM w")
def _(spark, d):
    s = reviews(spark, d).select("row_id", F.posexplode(text.sentences(F.col("review"))).alias("pos", "exp"))
    return s.select("row_id", "pos", F.size(text.words(F.lower("exp"))).alias("word_num"), text.subject_count(F.col("exp")).alias("subj_num"))


@query(
    "extra_keep_valid",
    f"""{_SENTENCES}, q AS (SELECT *, row_number() OVER (ORDER BY row_id, pos) - 1 AS sid FROM s), g AS (SELECT exp, min(sid) AS rep FROM q GROUP BY exp HAVING count(*) > 1)
    SELECT row_id, string_agg(rep::VARCHAR, ',' ORDER BY sid) AS exp_idx, string_agg(sid::VARCHAR, ',' ORDER BY sid) AS oexp_idx FROM q JOIN g USING (exp) GROUP BY row_id""",
)
def _(spark, d):
    from explainkit.operators.dictionary import dense_ids

    s = reviews(spark, d).select("row_id", F.posexplode(text.sentences(F.col("review"))).alias("pos", "exp"))
    q = dense_ids(s, ["row_id", "pos"], "sid")
    g = q.groupBy("exp").agg(F.min("sid").alias("rep"), F.count("*").alias("n")).where("n > 1")
    lists = q.join(g, "exp").groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("sid", "rep"))).alias("l"))
    return lists.select("row_id", F.array_join(F.transform("l", lambda x: x["rep"]), ",").alias("exp_idx"), F.array_join(F.transform("l", lambda x: x["sid"]), ",").alias("oexp_idx"))


@query("is_missing", r"SELECT doc_id, text IS NULL OR regexp_matches(text, '^\s*$') AS missing FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", text.is_missing(F.col("text")).alias("missing"))


@query("distinct_texts", r"SELECT DISTINCT regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS text FROM benchmark WHERE NOT regexp_matches(text, '^\s*$') ORDER BY 1")
def _(spark, d):
    rows = read(spark, d, "benchmark").where(~text.is_missing(F.col("text")))
    return rows.select(text.strip(F.col("text")).alias("text")).distinct().orderBy("text")


@query("sentiment_filter", f"WITH {REVIEWS_SQL} SELECT row_id FROM reviews WHERE sentiment IN ('positive', 'negative')")
def _(spark, d):
    mood = F.lower(F.trim(F.concat(F.lit(" "), F.initcap("sentiment"))))
    return reviews(spark, d).where(mood.isin("positive", "negative")).select("row_id")


@query("format_pair_prompt", "SELECT a.item_id, '<Instruct>: Same fact?' || chr(10) || '<Query>: ' || a.text || chr(10) || '<Document>: ' || b.text AS prompt FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1")
def _(spark, d):
    a = read(spark, d, "benchmark")
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return a.join(b, "item_id").select("item_id", text.pair_prompt(F.lit("Same fact?"), F.col("text"), F.col("other")).alias("prompt"))


# --- JSON inside model output

_OUT = "'Sure: ' || CASE event_id % 4 WHEN 0 THEN '[ ' || props || ' ] done' WHEN 1 THEN '{\"statements\": [' || props || ']}' WHEN 2 THEN 'nothing' ELSE '{\"other\": 1}' END"
_EVENTS = f"WITH o AS (SELECT event_id, {_OUT} AS out FROM events)"


def outputs(spark, d):
    return read(spark, d, "events").selectExpr("event_id", f"{_OUT} AS out")


@query("json_array_extract", rf"{_EVENTS} SELECT event_id, nullif(regexp_extract(out, '(?s)\[\s*\{{.*?\}}\s*\]'), '') AS found FROM o")
def _(spark, d):
    return outputs(spark, d).select("event_id", json_text.first_array(F.col("out")).alias("found"))


@query("json_object_extract", rf"""{_EVENTS} SELECT event_id, nullif(regexp_extract(out, '(?s)\{{\s*"statements"\s*:\s*\[.*?\]\s*\}}'), '') AS found FROM o""")
def _(spark, d):
    return outputs(spark, d).select("event_id", json_text.first_statements(F.col("out")).alias("found"))


@query("json_scan_objects", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '{"statements": [' || props || ']}' WHEN 2 THEN '' ELSE '{"other": 1}' END AS found FROM events""")
def _(spark, d):
    return outputs(spark, d).select("event_id", F.array_join(json_text.all_objects(F.col("out")), "|").alias("found"))


@query("payload_coerce", """SELECT event_id, CASE WHEN props IS NULL THEN '{"statements": []}' ELSE '{"k": ' || json_extract(props, '$.k') || '}' END AS payload FROM events""")
def _(spark, d):
    return read(spark, d, "events").select("event_id", json_text.coerce_payload(F.col("props")).alias("payload"))


_VERDICT = "CASE event_id % 5 WHEN 0 THEN '{\"atomicity\": \"1\", \"explainatoriness\": 0}' WHEN 1 THEN '{\"atomicity\": 0, \"explainatoriness\": 1}' WHEN 2 THEN '{\"atomicity\": 2, \"explainatoriness\": 1}' WHEN 3 THEN '{\"atomicity\": 1, \"explainatoriness\": 1, \"x\": 1}' ELSE 'no' END"


@query("verdict_parse", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS atomicity, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS explainatoriness FROM events")
def _(spark, d):
    v = read(spark, d, "events").selectExpr("event_id", f"{_VERDICT} AS raw").select("event_id", json_text.verdict(F.col("raw")).alias("v"))
    return v.select("event_id", "v.atomicity", "v.explainatoriness")
