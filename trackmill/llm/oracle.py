"""DuckDB SQL for the queries of this subpackage that SQL can express.

The others learn from data, search approximately, order by hashes or report edit distances; they are tested
against brute force, exact round trips or held-out rows instead.
"""

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = rf"regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+')"
_ALNUM = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce({_SPACED}, []) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + 5), ' ') AS s FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, least(len(w), 1)))) AS i FROM d) x),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN size x ON x.doc_id = a.doc_id JOIN size y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
links AS (SELECT a, count(*) AS n FROM link GROUP BY a),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(z.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id, coalesce(any_value(k.n), 0) AS n_links FROM d LEFT JOIN size z USING (doc_id) LEFT JOIN links k ON k.a = d.doc_id LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id"""

OP6 = f"""WITH b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark), d AS (SELECT doc_id, coalesce({_ALNUM}, []) AS w FROM documents),
win AS (SELECT DISTINCT item_id, len(list_slice(w, i + 1, i + 10)) AS n, array_to_string(list_slice(w, i + 1, i + 10), ' ') AS s FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, least(len(w), 1)))) AS i FROM b) x),
hit AS (SELECT p.doc_id, p.i, q.n, q.item_id FROM (SELECT doc_id, n, unnest(range(len(w) - n + 1)) AS i, w FROM d, (SELECT DISTINCT n FROM win) m WHERE len(w) >= n) p JOIN win q ON q.n = p.n AND q.s = array_to_string(list_slice(p.w, p.i + 1, p.i + p.n), ' ')),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM hit) x GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) x GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

# What escaping adds: one character for each backslash, `<` and `[`.
_MORE = r"(length({0}) - length(translate({0}, '<[\', '')))"
OP7 = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
  SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(text) + length(role) + {_MORE.format('text')} + {_MORE.format('role')} + 23) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""

# What remains to be paid from each turn on in the states s (nothing placed), p (a system placed), a (an assistant is due) and u (a user is due).
_GO = "CASE st WHEN 's' THEN {0}.s WHEN 'p' THEN {0}.p WHEN 'a' THEN {0}.a ELSE {0}.u END"
_PUT = "least({now} + 4, CASE WHEN gone THEN 1000000000 ELSE {then} + t + CASE WHEN ini = '{role}' THEN 0 ELSE 3 END END)"
OP11 = f"""WITH RECURSIVE crct AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) r(i)) z),
ids AS (SELECT DISTINCT conv_id FROM conversations),
lots AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255) + 1])), 4294967295) % 20 AS k FROM conversations, crct),
hurt AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM lots, range(2) r(j) WHERE k <> 0 AND (j = 0 OR k = 3)),
placed AS (SELECT *, dense_rank() OVER (ORDER BY conv_id) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS ini FROM hurt),
marked AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS cut, lag(ini) OVER (PARTITION BY c ORDER BY i) AS former FROM placed),
rows AS (SELECT *, blank OR again AS gone, CASE WHEN NOT blank AND NOT again AND cut THEN 3 ELSE 0 END AS t FROM marked),
back AS (SELECT DISTINCT c, n + 1 AS i, 0 AS s, 6 AS p, 3 AS a, 0 AS u FROM rows
  UNION ALL SELECT c, i, least(xs, least(xa, xu + 3) + 3), least(xp, least(xa, xu + 3) + 3), least(xa, xu + 3), least(xu, xa + 3) FROM (
    SELECT r.c, r.i, least({_PUT.format(now='b.s', then='b.a', role='u')}, CASE WHEN ini = 's' AND NOT gone THEN b.p + t ELSE 1000000000 END) AS xs, {_PUT.format(now='b.p', then='b.a', role='u')} AS xp, {_PUT.format(now='b.a', then='b.u', role='a')} AS xa, {_PUT.format(now='b.u', then='b.a', role='u')} AS xu
    FROM back b JOIN rows r ON r.c = b.c AND r.i = b.i - 1) x),
walk AS (SELECT DISTINCT c, CAST(1 AS BIGINT) AS i, 's' AS st, '' AS audit, CAST([] AS VARCHAR[]) AS body, n FROM rows
  UNION ALL SELECT c, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE WHEN e = 'D' THEN st WHEN e = 'K' AND st = 's' AND ini = 's' THEN 'p' WHEN st = 'a' THEN 'u' ELSE 'a' END, audit || e,
    CASE e WHEN 'D' THEN body WHEN 'I' THEN list_append(body, due || ':') WHEN 'K' THEN list_append(body, role || ':' || text) ELSE list_append(body, due || ':' || text) END, n FROM (
      SELECT w.*, r.ini, r.role, r.text, CASE WHEN st = 'a' THEN 'assistant' ELSE 'user' END AS due, CASE WHEN w.i <= w.n AND {_GO.format('y')} + 4 = {_GO.format('x')} THEN 'D' WHEN CASE WHEN st = 'a' THEN x.u ELSE x.a END + 3 = {_GO.format('x')} THEN 'I'
        WHEN ini = CASE WHEN st = 'a' THEN 'a' ELSE 'u' END OR ini = 's' AND st = 's' AND y.p + t = x.s THEN 'K' ELSE 'R' END AS e
      FROM walk w JOIN back x ON x.c = w.c AND x.i = w.i LEFT JOIN back y ON y.c = w.c AND y.i = w.i + 1 LEFT JOIN rows r ON r.c = w.c AND r.i = w.i WHERE w.i <= w.n OR st IN ('a', 'p')) z),
ends AS (SELECT c, audit, body FROM walk WHERE i = n + 1 AND st IN ('s', 'u')),
counts AS (SELECT conv_id, c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(again AND NOT blank) AS duplicate, count_if(t > 0) AS truncated, count_if(former || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id, c)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  CAST(coalesce(b.s, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(body, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN ends e ON e.c = k.c LEFT JOIN back b ON b.c = k.c AND b.i = 1"""

OP13 = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN pairs USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""

def _either(word: str) -> str:
    """word in any mixture of cases."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
_SAME = "|".join(f"{c if c.isalnum() else chr(92) + c}{{5}}" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
_FORMS = {"assign": rf"(?:{_NAMES})[\"'']?\x20*[:=]\x20*[\"'']?[A-Za-z0-9+/_.=-]+", "access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}", "string": "[A-Za-z0-9+/_-]{20,}={0,2}"}
_NEAR = "lower(substr(text, greatest(a - 48, 0) + 1, a - greatest(a - 48, 0)) || ' ' || substr(text, e + 1, 48))"
_RANDOM = f"""(length(v) >= 16 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= 8 AND NOT regexp_matches(v, '(?i)example|sample|dummy|change_?me|placeholder|your[_-]|test|x{{4}}|0123|1234|abcd|{_SAME}'))"""
OP12 = f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
hits AS ({" UNION ALL ".join(f"SELECT r, doc_id, source, text, {i} AS no, '{k}' AS kind, regexp_extract_all(text, '{p}') AS h, string_split_regex(text, '{p}') AS g FROM d" for i, (k, p) in enumerate(_FORMS.items()))}),
each AS (SELECT *, h[i] AS m, length(g[i]) AS gap FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM hits) x),
placed AS (SELECT r, doc_id, source, text, no, kind, CAST(sum(gap + length(m)) OVER (PARTITION BY r, no ORDER BY i) AS BIGINT) AS e, CAST(sum(gap + length(m)) OVER (PARTITION BY r, no ORDER BY i) - length(m) AS BIGINT) AS a, CASE WHEN kind = 'assign' THEN regexp_extract(m, '^[A-Za-z_]+["'']?\\x20*[:=]\\x20*["'']?(.*)$', 1) ELSE m END AS v FROM each),
found AS (SELECT *, e - length(v) AS b, {_RANDOM} AS random FROM placed WHERE length(v) >= CASE kind WHEN 'assign' THEN 8 WHEN 'access' THEN 16 WHEN 'hex' THEN 32 ELSE 20 END
  AND (kind <> 'string' OR {_RANDOM} AND regexp_matches({_NEAR}, '\\b(?:[a-z_]*(?:token|secret|key|passw(?:or)?d|pwd|credential)s?|bearer|authorization|oauth)\\b') AND NOT regexp_matches({_NEAR}, '\\b(?:commit|revision|sha1|sha256|md5|checksum|digest|uuid|etag)\\b'))),
counts AS (SELECT v, count(*) AS owners, sum(n) AS repositories FROM (SELECT v, source, count(*) AS n FROM (SELECT DISTINCT v, source, doc_id FROM found) x GROUP BY v, source) y GROUP BY v),
judged AS (SELECT DISTINCT r, b, e, v, CASE WHEN owners > 2 OR repositories > 20 THEN 'copied' WHEN random THEN 'live' ELSE 'weak' END AS verdict FROM found JOIN counts USING (v)),
spans AS (SELECT r, no, a, e, kind FROM found WHERE kind <> 'string' UNION ALL SELECT r, 4, b, e, 'live' FROM judged WHERE verdict = 'live'),
lists AS (SELECT r, count_if(kind = 'assign') AS n_assign, count_if(kind = 'access') AS n_access, count_if(kind = 'hex') AS n_hex, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, no, e) FILTER (WHERE kind <> 'live') AS base, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, no, e) AS spans FROM spans GROUP BY r),
verdicts AS (SELECT r, count_if(verdict = 'live') AS n_live, count_if(verdict = 'copied') AS n_copied, count_if(verdict = 'weak') AS n_weak FROM judged GROUP BY r)
SELECT doc_id, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("n_assign", "n_access", "n_hex", "n_live", "n_copied", "n_weak"))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN lists USING (r) LEFT JOIN verdicts USING (r)"""

SQL: dict[str, str] = {"op12_secret_scan": OP12, "op13_hard_negatives": OP13, "op11_conversation_repair": OP11, "op4_ngram_jaccard": OP4, "op4_link_counts": OP4, "op6_decontamination": OP6, "op7_chat_format": OP7}
