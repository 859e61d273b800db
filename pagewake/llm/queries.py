"""The registered queries opN_<name> of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontaminate, fill_in_middle, html_text, language_id, line_dedup, lm_score, near_duplicates, prefix_trie, secrets, toxicity, url_filters
from .common import fold, table

#: Host, path, verdict.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
TOKENIZER = "byte_bpe_50k.json"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from three of four folds of the keys; `held_out` marks the fourth."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language_id.train(docs, ~held_out)
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from four of five folds of the keys; `held_out` marks the fifth."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 1, F.lit(False))
    found = lm_score.score(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), with_ids=False)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed are the canonical URLs of captures that came with a referral parameter."""
    pages = table(spark, sf_dir, "pages")
    referred = pages.where(F.col("url").rlike(r"[?&](ref|utm_source)="))
    listed = referred.select(url_filters.canonical(*url_filters.parts(F.col("url"))).alias("canon"))
    return url_filters.judge(pages, listed, URL_RULES)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text left of each document and how many lines went."""
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_removed")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, similarity 0.8."""
    return near_duplicates.find(table(spark, sf_dir, "documents"), size=2, percent=80).drop("text_hash")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of the rebuilt conversations."""
    return prefix_trie.of_blocks(table(spark, sf_dir, "conversations"), block=20, most=4)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labels of four of five folds of the keys; `held_out` marks the fifth."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, fold(F.col("doc_id"), 5) != 0)
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text is transformed, half of them into spm; units are lines."""
    recipe = fill_in_middle.Recipe(units=fill_in_middle.LINES, seed=7, percent=100, spm_percent=50)
    return fill_in_middle.transform(table(spark, sf_dir, "documents"), recipe, digests=True)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_html_text, op3_lm_score, op4_ann, op5_bpe, op6_url_filters, op7_secrets, op8_line_dedup, op9_near_duplicates, op10_decontaminate, op11_prefix_trie, op12_toxicity, op13_fill_in_middle)}

_OP6 = """
WITH cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parsed AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut
), keyed AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '/+$', '') END AS canon FROM parsed
), listed AS (
  SELECT DISTINCT canon FROM keyed WHERE canon IS NOT NULL AND regexp_matches(url, '[?&](ref|utm_source)=')
), rules(h, p, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
  SELECT url, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS ruled
  FROM (SELECT DISTINCT url, host, path FROM keyed) k JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY url
)
SELECT k.page_id, k.host, k.path, f.rule,
  coalesce(f.ruled, CASE WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.canon IS NOT NULL AS listed
FROM keyed k LEFT JOIN fits f ON f.url = k.url LEFT JOIN listed l ON l.canon = k.canon
"""



def _op7_kind(kind: int, pattern: str, keep: str = "true", group: int = 0) -> str:
    """Spans of one kind as rows; the lengths of gaps and matches add up."""
    return f"""
  SELECT doc_id, {kind} AS kind, total - length(hit) AS start, total AS "end" FROM (
    SELECT doc_id, hit, value, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM (
      SELECT doc_id, unnest(generate_series(1, len(hits))) AS i, unnest(hits) AS hit, unnest(vals) AS value, unnest(gaps[1:len(hits)]) AS gap FROM (
        SELECT doc_id, regexp_extract_all(body, $${pattern}$$) AS hits, regexp_extract_all(body, $${pattern}$$, {group}) AS vals, string_split_regex(body, $${pattern}$$) AS gaps FROM docs
      ))) WHERE {keep}"""


_MIXED = "regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')"
_OP7 = f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS body FROM documents
), base AS ({_op7_kind(0, secrets.ASSIGN, "length(value) >= 12", 2)}
  UNION ALL {_op7_kind(1, secrets.ACCESS)}
  UNION ALL {_op7_kind(2, secrets.HEX)}
), weak AS (
  SELECT * FROM ({_op7_kind(3, secrets.WEAK_ID)}
  UNION ALL {_op7_kind(4, secrets.WEAK_SECRET, _MIXED)}
  UNION ALL {_op7_kind(5, secrets.ENDPOINT)}) w
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.start < w."end" AND w.start < b."end")
), parts AS (
  SELECT doc_id, start, kind IN (1, 3) AS is_id, kind IN (0, 2, 4) AS is_secret FROM (SELECT * FROM base UNION ALL SELECT * FROM weak)
), near AS (
  SELECT w.doc_id, w.kind, w.start, w."end", bool_or(p.is_id) AS has_id, bool_or(p.is_secret) AS has_secret
  FROM weak w JOIN parts p ON p.doc_id = w.doc_id AND abs(p.start - w.start) <= 400 GROUP BY ALL
), every AS (
  SELECT doc_id, kind, start, "end" FROM base
  UNION ALL SELECT doc_id, kind, start, "end" FROM near WHERE CASE kind WHEN 3 THEN has_secret WHEN 4 THEN has_id ELSE has_id AND has_secret END
), named AS (
  SELECT doc_id, kind, start, ['assign', 'access', 'hex', 'access_id', 'secret', 'endpoint'][kind + 1] || ':' || start::BIGINT || ':' || "end"::BIGINT AS span FROM every
), told AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans FROM named GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN told t ON t.doc_id = d.doc_id
"""

_OP8 = """
WITH line AS (
  SELECT doc_id, unnest(generate_series(0, len(lines) - 1)) AS i, unnest(lines) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
), counted AS (
  SELECT *, count(*) OVER (PARTITION BY line) AS n, ('0x' || substr(md5(line), 1, 15))::BIGINT AS h, length(line) - length(replace(line, ' ', '')) + 1 AS w FROM line WHERE trim(line) <> ''
), ended AS (
  SELECT *, CASE WHEN coalesce(lead(i) OVER v = i + 1 AND lead(n) OVER v = n, false) AND NOT coalesce(lag(i) OVER v = i - 1 AND lag(n) OVER v = n AND (h % 3 + 31 * (lag(h) OVER v % 3)) % 3 = 0, false) THEN 0 ELSE 1 END AS cut
  FROM counted WHERE n > 1 WINDOW v AS (PARTITION BY doc_id ORDER BY i)
), placed AS (
  SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM ended
), chunk AS (
  SELECT doc_id, min(i) AS first, count(*) AS lines, sum(w) AS words, string_agg(line, chr(10) ORDER BY i) AS body FROM placed GROUP BY doc_id, place
), again AS (
  SELECT *, first + lines - sum(lines) OVER (PARTITION BY doc_id ORDER BY first) AS island FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first) AS nth FROM chunk) WHERE nth > 1
), gone AS (
  SELECT doc_id, unnest(generate_series(first, first + lines - 1)) AS i FROM (
    SELECT *, sum(lines) OVER r AS run_lines, sum(words) OVER r AS run_words FROM again WINDOW r AS (PARTITION BY doc_id, island)
  ) WHERE run_words >= 50 OR (run_lines > 1 AND run_words >= 20)
), remade AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS text, count(g.i) AS n_removed
  FROM line l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN r.doc_id IS NULL THEN d.text ELSE coalesce(r.text, '') END AS text, coalesce(r.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN remade r ON r.doc_id = d.doc_id
"""

_AZ = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Exact similarities of all pairs that share a shingle, then everything reachable.
_OP9 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_AZ.format(t="coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 1 THEN [words[1]] ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS s FROM w
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT x, y FROM common JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), both_ways AS (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach(v, u) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.v, e.y FROM reach r JOIN both_ways e ON e.x = r.u
)
SELECT d.doc_id, coalesce(max(s.n), 0) AS n_shingles, min(r.u) AS component_id, d.doc_id = min(r.u) AS kept
FROM documents d JOIN reach r ON r.v = d.doc_id LEFT JOIN size s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""

_WORDS10 = f"regexp_extract_all({_AZ.format(t="coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_OP10 = f"""
WITH d AS (
  SELECT doc_id, {_WORDS10} AS words FROM documents
), it AS (
  SELECT coalesce(item_id::VARCHAR, '') AS name, {_WORDS10} AS words FROM benchmark
), iw AS (
  SELECT DISTINCT name, least(10, len(words)) AS l, unnest(list_transform(range(1, len(words) - least(10, len(words)) + 2), lambda i: words[i:i + least(10, len(words)) - 1])) AS w FROM it WHERE len(words) > 0
), dw AS (
  SELECT doc_id, l, unnest(range(1, len(words) - l + 2)) AS i, unnest(list_transform(range(1, len(words) - l + 2), lambda i: words[i:i + l - 1])) AS w FROM d, (SELECT DISTINCT l FROM iw) WHERE len(words) >= l
), hit AS (
  SELECT doc_id, i, iw.l, name FROM dw JOIN iw ON iw.l = dw.l AND iw.w = dw.w
), place AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, name FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN place USING (doc_id) LEFT JOIN named USING (doc_id)
"""

#: CRC-32 of the id as text, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({id}::VARCHAR) + 1), lambda i: ascii(({id}::VARCHAR)[i])::BIGINT)),
    lambda crc, code: list_reduce(list_prepend(xor(crc, code), range(8)), lambda c, bit: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)))"""

#: Each node as the list of its turns; a subtree is what begins with it.
_OP11 = f"""
WITH turns AS (
  SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(t ORDER BY p) AS ts FROM turns GROUP BY conv_id
), heads AS (
  SELECT conv_id, ts, {_CRC32.format(id="conv_id")} % 4 AS h FROM own
), made AS (
  SELECT c.conv_id, list_concat(coalesce(b.ts, [])[1:c.h], c.ts[c.h + 1:]) AS ts FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20
), member AS (
  SELECT conv_id, len(ts) AS n, d, ts[1:d] AS seq FROM (SELECT *, unnest(range(len(ts) + 1)) AS d FROM made)
), node AS (
  SELECT d, seq, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d) AS ends,
    CASE WHEN d = 0 THEN 0 ELSE len(list_filter(regexp_split_to_array(seq[d].text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) END AS words FROM member GROUP BY d, seq
), child AS (
  SELECT d - 1 AS d, seq[1:d - 1] AS seq, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL
), told AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM node n LEFT JOIN child c ON c.d = n.d AND c.seq = n.seq
), passed AS (
  SELECT e, seq[1:e] AS seq, sum((n_convs - 1) * words) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT *, unnest(range(d + 1)) AS e FROM told) GROUP BY ALL
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM told n JOIN passed s ON s.e = n.d AND s.seq = n.seq LEFT JOIN node p ON p.d = n.d - 1 AND p.seq = n.seq[1:n.d - 1] AND n.d > 0
"""

_DRAW13 = "('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), {at}, 8))::BIGINT"
_OP13 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units,
    {_DRAW13.format(at=1)} AS h1, {_DRAW13.format(at=9)} AS h2, {_DRAW13.format(at=17)} AS h3, {_DRAW13.format(at=25)} AS h4 FROM documents
), drawn AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS lo, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS hi,
    CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d
), cut AS (
  SELECT *, coalesce(array_to_string(units[1:lo], ''), '') AS a, coalesce(array_to_string(units[lo + 1:hi], ''), '') AS m, coalesce(array_to_string(units[hi + 1:], ''), '') AS z FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256, sha256(body) AS restored_sha256 FROM cut
"""

ORACLE = {"op11_prefix_trie": _OP11, "op13_fill_in_middle": _OP13, "op9_near_duplicates": _OP9, "op10_decontaminate": _OP10, "op7_secrets": _OP7, "op8_line_dedup": _OP8, "op6_url_filters": _OP6}
