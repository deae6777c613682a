"""DuckDB SQL for the queries that SQL can express.

The rest (language identification, the quality model, SentencePiece, SimHash, token counts and whitening) is held
against brute force, the library's own output or held-out accuracy in tests/llm.
"""

from __future__ import annotations

from linkweave.llm.license_scan import TEMPLATES, header_line

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = r"[\x20\x09-\x0D]"


def _benchmark_words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_benchmark_words("text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_benchmark_words("text")} AS w FROM benchmark),
bk AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
bi AS (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bk),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM bi),
ks AS (SELECT DISTINCT k FROM bw),
di AS (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
dw AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM di),
h AS (SELECT rid, i, dw.k, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
hw AS (SELECT DISTINCT rid, i, k FROM h),
hp AS (SELECT rid, unnest(range(i, i + k)) AS p FROM hw),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM hp GROUP BY rid),
hi AS (SELECT DISTINCT rid, item_id FROM h WHERE item_id IS NOT NULL),
t AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS s FROM hi GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN t USING (rid)
"""

PREFERENCE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, count(*) OVER (PARTITION BY conv_id) AS size FROM t),
la AS (SELECT conv_id, max(n) AS la FROM o WHERE role = 'assistant' GROUP BY conv_id),
rp AS (SELECT conv_id, text AS reply FROM o JOIN la USING (conv_id) WHERE n = la),
x AS (SELECT o.*, la, own.reply AS own_reply, other.reply AS reply FROM o LEFT JOIN la USING (conv_id) LEFT JOIN rp AS own USING (conv_id)
      LEFT JOIN rp AS other ON other.conv_id = xor(o.conv_id, 1)),
p AS (SELECT *, CASE WHEN la IS NULL OR reply = own_reply THEN size ELSE la - 1 END AS shared FROM x),
c AS (SELECT *, text AS ctext, CASE WHEN la IS NULL THEN text WHEN n = la THEN reply WHEN reply IS NULL AND n > la THEN NULL ELSE text END AS rtext FROM p),
s AS (SELECT *, 2 + length(role) + 3 AS head, '<|' || role || '|>' || chr(10) AS h, '<|end|>' || chr(10) AS e FROM c),
z AS (SELECT *, coalesce(sum(CASE WHEN n > shared THEN head + length(ctext) + 8 END) OVER w, 0) AS ca, coalesce(sum(CASE WHEN n > shared THEN head + length(rtext) + 8 END) OVER w, 0) AS ra
      FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT conv_id, any_value(size) AS size, any_value(shared) AS shared, count(rtext) AS rsize,
  coalesce(string_agg(h || ctext || e, '' ORDER BY n) FILTER (n <= shared), '') AS prompt,
  coalesce(string_agg(h || ctext || e, '' ORDER BY n) FILTER (n > shared), '') AS chosen,
  coalesce(string_agg(CAST(CAST(ca + head AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(ca + head + length(ctext) AS BIGINT) AS VARCHAR), ',' ORDER BY n) FILTER (n > shared AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(h || rtext || e, '' ORDER BY n) FILTER (n > shared AND rtext IS NOT NULL), '') AS rejected,
  coalesce(string_agg(CAST(CAST(ra + head AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(ra + head + length(rtext) AS BIGINT) AS VARCHAR), ',' ORDER BY n) FILTER (n > shared AND rtext IS NOT NULL AND role = 'assistant'), '') AS rejected_mask
  FROM z GROUP BY conv_id)
SELECT conv_id, CASE WHEN size = shared AND rsize = shared THEN 'identical' WHEN size = shared THEN 'no_chosen' WHEN rsize = shared THEN 'no_rejected' ELSE 'ok' END AS status,
       CAST(shared AS BIGINT) AS n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask FROM g
"""

QUALITY_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{_BLANK}+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
i AS (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8),
g AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g FROM i),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g),
u AS (SELECT rid, unnest(range(i, i + 8)) AS p FROM r WHERE c > 1),
n AS (SELECT rid, count(DISTINCT p) AS n FROM u GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             length(array_to_string(l, '')) AS line_chars, length(array_to_string(l, '')) - length(array_to_string(list_distinct(l), '')) AS dup_line_chars, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN n USING (rid)),
b AS (SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (10 * n_symbols > 3 * n_words)::BIGINT + 8 * (10 * n_dup_lines > 3 * n_lines)::BIGINT
             + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 25 * n_words)::BIGINT + 64 * (n_words > 1000000)::BIGINT + 128 * (5 * dup_line_chars > line_chars)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed, (failed_bits & 183) = 0 AS kept, failed_bits FROM b
"""

#: White space, and characters of scripts written without blanks (Thai, Lao, Burmese, Khmer, kana, Han).
_UNSPACED = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
_SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_CUT = """j AS (SELECT y.*, d.text AS whole, coalesce(lag(stop) OVER v, 0) AS before, coalesce(sum((NOT gone)::INT) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part,
             coalesce(gone AND lag(gone) OVER v, false) AS inner_gone FROM y JOIN d ON y.rid = d.rid WINDOW v AS (PARTITION BY y.rid ORDER BY u)),
h AS (SELECT *, CASE WHEN u > 0 THEN whole[before + 1:start] ELSE '' END AS gap, sum((gone AND NOT inner_gone)::INT) OVER (PARTITION BY rid ORDER BY u) AS island FROM j),
kp AS (SELECT rid, part, max(CASE WHEN NOT gone THEN whole[start + 1:stop] END) AS unit,
              arg_max(gap, lpad(CAST(length(gap) - length(replace(gap, chr(10), '')) AS VARCHAR), 9, '0') || (gap <> '')::INT || lpad(CAST(999999999 - u AS VARCHAR), 9, '0')) AS gap FROM h GROUP BY rid, part),
tx AS (SELECT rid, string_agg(CASE WHEN part > 0 THEN gap ELSE '' END || unit, '' ORDER BY part) AS inner_text FROM kp WHERE unit IS NOT NULL GROUP BY rid),
sp AS (SELECT rid, island, CAST(min(start) AS VARCHAR) || '-' || CAST(max(stop) AS VARCHAR) AS span FROM h WHERE gone GROUP BY rid, island),
ss AS (SELECT rid, string_agg(span, ',' ORDER BY island) AS spans FROM sp GROUP BY rid),
a AS (SELECT rid, count(*) FILTER (gone) AS n_removed, min(start) AS first_start, max(stop) AS last_stop FROM y GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(spans, '') AS removed_spans,
       CASE WHEN a.rid IS NULL THEN text ELSE text[:first_start] || coalesce(inner_text, '') || text[last_stop + 1:] END AS text
FROM d LEFT JOIN a ON d.rid = a.rid LEFT JOIN tx ON d.rid = tx.rid LEFT JOIN ss ON d.rid = ss.rid
"""
LINE_DEDUP = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
s AS (SELECT rid, string_split(text, chr(10)) AS ls FROM d WHERE text IS NOT NULL),
l AS (SELECT rid, unnest(ls) AS line, unnest(range(0, len(ls))) AS ln FROM s),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY rid ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_start,
             regexp_extract_all(line, '[{_SPACE}]+|[{_UNSPACED}]|[^{_SPACE}{_UNSPACED}]+') AS ps FROM l),
p AS (SELECT rid, ln, line_start, unnest(ps) AS piece, unnest(range(0, len(ps))) AS k FROM o),
f AS (SELECT *, CAST(line_start + sum(length(piece)) OVER (PARTITION BY rid, ln ORDER BY k) AS BIGINT) AS stop FROM p),
w AS (SELECT rid, ln, lower(piece) AS word, stop - length(piece) AS start, stop, k, regexp_matches(piece, '[.!?。！？]$') AS ends FROM f WHERE NOT regexp_matches(piece, '^[{_SPACE}]')),
g AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY ln, k) AS pos,
             coalesce(sum(ends::INT) OVER (PARTITION BY rid, ln ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM w),
q AS (SELECT *, row_number() OVER z AS q, count(*) OVER (PARTITION BY rid, ln, seg) AS n FROM g WINDOW z AS (PARTITION BY rid, ln, seg ORDER BY k)),
m AS (SELECT rid, q, n, CAST(right(max(lpad(CAST(length(word) AS VARCHAR), 9, '0') || word || lpad(CAST(pos AS VARCHAR), 9, '0')) OVER (PARTITION BY rid, ln, seg ORDER BY q ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING), 9) AS BIGINT) AS pick FROM q WHERE n > 20),
c AS (SELECT DISTINCT rid, pick AS pos, true AS cut FROM m WHERE q <= n - 19),
e AS (SELECT q.rid, q.ln, q.pos, word, start, stop, q.q = q.n OR coalesce(cut, false) AS closes FROM q LEFT JOIN c ON q.rid = c.rid AND q.pos = c.pos),
i AS (SELECT *, coalesce(sum(closes::INT) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM e),
us AS (SELECT rid, u, min(pos) AS w0, max(pos) AS w1, min(start) AS start, max(stop) AS stop, max(ln) AS ln FROM i GROUP BY rid, u),
ub AS (SELECT *, coalesce(lead(ln) OVER (PARTITION BY rid ORDER BY u) > ln, true) AS last, greatest(30, w1 - w0 + 1) AS size FROM us),
rs AS (SELECT rid, w0 AS first, w0 + size - 1 AS reach FROM ub
       UNION SELECT rid, w1 - size + 1, w1 FROM ub WHERE last AND w1 >= size),
ws AS (SELECT rid, list(word ORDER BY pos) AS ws FROM i GROUP BY rid),
r AS (SELECT rs.rid, first, reach, array_to_string(ws[first:reach], ' ') AS run FROM rs JOIN ws ON rs.rid = ws.rid WHERE reach <= len(ws)),
x AS (SELECT r.rid, first, reach, row_number() OVER (PARTITION BY run ORDER BY doc_id, first) AS nth FROM r JOIN d ON r.rid = d.rid),
ev AS (SELECT rid, first, reach, CAST(NULL AS BIGINT) AS u FROM x WHERE nth > 1 UNION ALL SELECT rid, w0, 0, u FROM us),
er AS (SELECT rid, u, max(reach) OVER (PARTITION BY rid ORDER BY first RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reach FROM ev),
y AS (SELECT us.*, reach >= w1 AS gone FROM us JOIN er ON us.rid = er.rid AND us.u = er.u),
{_CUT}"""
LINE_UNITS = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
s AS (SELECT rid, doc_id, string_split(text, chr(10)) AS ls FROM d WHERE text IS NOT NULL),
l AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS ln FROM s),
o AS (SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY rid ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_start,
             lower(array_to_string(regexp_extract_all(line, '[{_UNSPACED}]|[^{_SPACE}{_UNSPACED}]+'), ' ')) AS norm FROM l),
us AS (SELECT rid, doc_id, norm, row_number() OVER (PARTITION BY rid ORDER BY ln) - 1 AS u, line_start + length(regexp_extract(line, '^[{_SPACE}]*')) AS start,
              line_start + length(regexp_replace(line, '[{_SPACE}]+$', '')) AS stop FROM o WHERE norm <> ''),
y AS (SELECT rid, u, start, stop, row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS FIRST, u) > 1 AS gone FROM us),
{_CUT}"""

_URL_RULES = "('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')"
URL_FILTERS = f"""
WITH r(rhost, rpath, verdict) AS (VALUES {_URL_RULES}),
u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(url[strpos(url, '://') + 3:], '^[^?#]*') ELSE '' END AS rest FROM pages),
s AS (SELECT rid, page_id, translate(split_part(rest, '/', 1), '{_UPPER}', '{_LOWER}') AS host, CASE WHEN strpos(rest, '/') > 0 THEN rest[strpos(rest, '/'):] ELSE '' END AS path FROM u),
m AS (SELECT rid, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY rid ORDER BY length(rhost) + length(rpath) DESC, length(rhost) DESC, verdict DESC) AS n
      FROM s JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM s LEFT JOIN (SELECT * FROM m WHERE n = 1) USING (rid)
"""

#: The template texts and the words of a header line are data; every rule below is written out.
_HEADER = header_line(TEMPLATES)
_TEMPLATE_ROWS = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES))


def _terms(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), lambda x: x <> '')"


LICENSE_SCAN = f"""
WITH tp(template, licence, txt) AS (VALUES {_TEMPLATE_ROWS}),
tt AS (SELECT template, licence, unnest({_terms("txt")}) AS term FROM tp),
given AS (SELECT template, licence, term, count(*) AS tf FROM tt GROUP BY ALL),
d AS (SELECT row_number() OVER () AS rid, * FROM (SELECT 'document' AS kind, doc_id, CAST(NULL AS VARCHAR) AS path, text FROM documents
  UNION ALL SELECT 'page', page_id, nullif(regexp_extract(url, '^[^:]*://([^?#]*)', 1), ''), regexp_replace(html, '<[^>]*>', chr(10), 'g') FROM pages)),
la AS (SELECT rid, string_split(replace(text, chr(1), ' '), chr(10)) AS al FROM d WHERE regexp_matches(text, '(?i)licen[sc]e|copyright|rights[^a-z0-9]+reserved|spdx|public[^a-z0-9]+domain|creative[^a-z0-9]+commons|redistribution|permission|unencumbered')),
l AS (SELECT rid, unnest(al) AS line, unnest(range(len(al))) AS i FROM la),
lh AS (SELECT *, regexp_matches(line, '{_HEADER}') AS h, regexp_matches(line, '[A-Za-z0-9]') AS w FROM l),
li AS (SELECT *, h OR (w AND coalesce(lag(h) OVER v, false) AND coalesce(lead(h) OVER v, false)) AS inside FROM lh WINDOW v AS (PARTITION BY rid ORDER BY i)),
lb AS (SELECT *, sum((NOT inside)::INT) OVER (PARTITION BY rid ORDER BY i) AS block FROM li),
bl AS (SELECT rid, block, string_agg(line, ' ' ORDER BY i) AS whole, count(*) AS n, sum(len({_terms("line")})) AS words FROM lb WHERE inside GROUP BY ALL),
fw AS (SELECT rid, sum(words) AS words FROM bl GROUP BY rid),
k AS (SELECT d.*, coalesce(regexp_matches(path, '(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$'), false) OR coalesce(2 * fw.words >= len({_terms("coalesce(text, '')")}), false) AS is_file FROM d LEFT JOIN fw USING (rid)),
us AS (SELECT rid, block, 0 AS way, whole AS unit FROM bl
  UNION ALL SELECT rid, block, 1, unnest(ss) FROM (SELECT rid, block, string_split_regex(whole, '\\.( |\\z)') AS ss FROM bl) WHERE len(ss) > 1
  UNION ALL SELECT rid, block, 2, line FROM lb JOIN bl USING (rid, block) WHERE inside AND n > 1
  UNION ALL SELECT rid, -1, 3, coalesce(text, '') FROM k WHERE is_file),
un AS (SELECT row_number() OVER () AS uid, *, regexp_matches(unit, '(?i)(^|[^a-z0-9])later([^a-z0-9]|$)') AS later FROM us WHERE len({_terms("unit")}) > 0),
te AS (SELECT uid, rid, unnest({_terms("unit")}) AS term FROM un),
counts AS (SELECT uid, rid, term, count(*) AS tf FROM te GROUP BY ALL),
n AS (SELECT CAST({len(TEMPLATES)} AS DOUBLE) + (SELECT count(*) FROM un) AS n),
df AS (SELECT term, count(DISTINCT template) + coalesce(any_value(c), 0) AS df FROM given LEFT JOIN (SELECT term, count(*) AS c FROM counts GROUP BY term) USING (term) GROUP BY term),
idf AS (SELECT term, ln((n + 1) / (df + 1)) + 1 AS idf FROM df, n),
wt AS (SELECT template, licence, term, tf * idf AS w FROM given JOIN idf USING (term)),
ln1 AS (SELECT template, sqrt(sum(w * w)) AS length FROM wt GROUP BY template),
uw AS (SELECT uid, rid, term, tf * coalesce(idf, (SELECT ln(n + 1) + 1 FROM n)) AS w FROM counts LEFT JOIN idf USING (term)),
ul AS (SELECT uid, sqrt(sum(w * w)) AS unit_length FROM uw GROUP BY uid),
mu AS (SELECT template, count(*) FILTER (regexp_matches(term, '^([0-9]|later|lesser|affero|nc|sa)$')) AS n_must, bool_or(term = 'later') AS says_later FROM given GROUP BY template),
dots AS (SELECT uid, rid, licence, template, sum(uw.w * wt.w / length) AS dot, count(*) FILTER (regexp_matches(term, '^([0-9]|later|lesser|affero|nc|sa)$')) AS met FROM uw JOIN wt USING (term) JOIN ln1 USING (template) GROUP BY ALL HAVING count(*) >= 2),
sc AS (SELECT uid, rid, block, way, licence, round(dot / unit_length, 6) AS score FROM dots JOIN ul USING (uid) JOIN mu USING (template) JOIN (SELECT uid, block, way, later FROM un) USING (uid) WHERE met = n_must AND (says_later OR NOT later)),
bt AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, licence) AS one FROM sc WHERE score >= 0.6),
bw AS (SELECT *, first_value(way) OVER (PARTITION BY rid, block ORDER BY score DESC, way) AS best_way, max(block) OVER (PARTITION BY rid) AS first_block FROM bt WHERE one = 1),
bu AS (SELECT *, 1 AS n FROM bw WHERE way = best_way AND (block >= 0 OR first_block < 0)),
own AS (SELECT rid, string_agg(DISTINCT licence, ',' ORDER BY licence) AS own_licences, max(score) AS score, arg_min(licence, struct_pack(a := -score, b := licence)) AS own_licence FROM bu WHERE n = 1 GROUP BY rid),
j AS (SELECT k.rid, kind, doc_id, path, is_file, own_licences, score, own_licence FROM k LEFT JOIN own USING (rid)),
fo AS (SELECT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS folder, arg_min(own_licence, struct_pack(a := -score, b := own_licence)) AS folder_licence FROM j WHERE is_file AND own_licence IS NOT NULL AND path IS NOT NULL GROUP BY 1),
ih AS (SELECT rid, folder, folder_licence, row_number() OVER (PARTITION BY rid ORDER BY length(folder) DESC) AS n FROM j JOIN fo ON folder = '' OR starts_with(path, folder || '/') WHERE own_licence IS NULL AND path IS NOT NULL)
SELECT kind, doc_id, path, is_file, coalesce(own_licences, '') AS own_licences, coalesce(score, 0.0) AS score, coalesce(own_licence, folder_licence) AS licence,
       CASE WHEN own_licence IS NULL THEN folder END AS inherited_from
FROM j LEFT JOIN (SELECT * FROM ih WHERE n = 1) USING (rid)
"""

FILL_IN_MIDDLE = """
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, len(u) AS n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256 FROM p
"""

_BITS = (("few_words", 1), ("repeated_words", 2), ("symbols", 4), ("repeated_line_chars", 128), ("short_words", 16), ("long_words", 32))
QUALITY_ABLATIONS = f"WITH f AS (SELECT failed_bits & 183 AS b FROM ({QUALITY_RULES})) " + " UNION ALL ".join(
    f"SELECT 'v2' AS policy, '{rule}' AS rule, count(*) FILTER (b & {bit} <> 0) AS n_failed, count(*) FILTER (b = {bit}) AS n_only, coalesce(bool_or(b & {bit} <> 0), false) AS ever_failed FROM f" for rule, bit in _BITS
)

ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": LICENSE_SCAN,
    "op5_decontamination": DECONTAMINATION,
    "op6_preference_format": PREFERENCE,
    "op7_quality_rules": QUALITY_RULES,
    "op7_ablations": QUALITY_ABLATIONS,
    "op9_line_dedup": LINE_DEDUP,
    "op9_line_units": LINE_UNITS,
    "op10_url_filters": URL_FILTERS,
    "op12_fill_in_middle": FILL_IN_MIDDLE,
}
