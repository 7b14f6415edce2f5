"""DuckDB SQL that restates the registered queries where SQL can express them."""

ORACLE: dict[str, str] = {}

ORACLE["op7_chat_formatting"] = r"""
WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
conv AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    bool_or(contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR regexp_matches(text, '<\\+\|')) AS conflict,
    sum(12 + length(role) + 1 + length(text) + 11) AS plain_chars,
    sum(len(regexp_extract_all(text, '<\\*\|'))) AS marks
  FROM src GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  (plain_chars + CASE WHEN conflict THEN marks ELSE 0 END)::BIGINT AS formatted_chars
FROM conv
"""

ORACLE["op2_substring_dedup"] = r"""
WITH words AS (
  SELECT doc_id, string_split_regex(trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+') AS all_w FROM documents),
w AS (SELECT doc_id, CASE WHEN len(all_w) = 1 AND all_w[1] = '' THEN [] ELSE all_w END AS w FROM words),
win AS (SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
one AS (SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM w)),
kept AS (SELECT o.doc_id, string_agg(o.word, ' ' ORDER BY o.p) AS t, count(*) AS n FROM one o LEFT JOIN gone g ON o.doc_id = g.doc_id AND o.p = g.p WHERE g.p IS NULL GROUP BY o.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""

ORACLE["op4_embedding_dedup"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach AS (SELECT a AS x, a AS y FROM pairs UNION SELECT r.x, p.b FROM reach r JOIN pairs p ON r.y = p.a),
comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
deg AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT m.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(c.c, m.vec_id) AS component_id, m.vec_id = coalesce(c.c, m.vec_id) AS kept
FROM embeddings m LEFT JOIN deg d ON m.vec_id = d.a LEFT JOIN comp c ON m.vec_id = c.x
"""


def _secrets() -> str:
    # kind, pattern, a pattern whose match is what the length is asked of, least length
    rules = [
        ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
        ("access", r"AKIA[A-Z0-9]+", 0, 18),
        ("hex", r"[0-9a-f]+", 0, 16),
        ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
        ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
        ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 1),
        ("stripe", r"(?:sk|rk)_live_[A-Za-z0-9]{16,}", 0, 1),
        ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
        ("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----", 0, 1),
    ]
    each = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS ord, '{kind}' AS kind, {least} AS least, list_transform(string_split_regex(t, '{p}'), lambda x: length(x)) AS gaps, list_transform(regexp_extract_all(t, '{p}', 0), lambda x: length(x)) AS hits, list_transform(regexp_extract_all(t, '{p}', {g}), lambda x: length(x)) AS vals FROM d WHERE regexp_matches(t, '{p}')"
        for k, (kind, p, g, least) in enumerate(rules)
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({each}),
u AS (SELECT doc_id, ord, kind, least, unnest(gaps) AS gap, unnest(hits) AS h, unnest(vals) AS n, unnest(range(1, len(gaps) + 1)) AS i FROM m WHERE len(hits) > 0),
p AS (SELECT doc_id, ord, kind, least, n, h, sum(gap + h) OVER (PARTITION BY doc_id, ord ORDER BY i) AS e FROM u WHERE h IS NOT NULL),
s AS (SELECT doc_id, ord, kind, (e - h)::BIGINT AS b, e::BIGINT AS e, kind || ':' || (e - h)::BIGINT || ':' || e::BIGINT AS x FROM p WHERE n >= least),
g AS (SELECT doc_id, count(*) FILTER (ord = 0) AS a, count(*) FILTER (ord = 1) AS k, count(*) FILTER (ord = 2) AS h,
  string_agg(x, ',' ORDER BY b, ord) FILTER (ord < 3) AS base, string_agg(x, ',' ORDER BY b, ord) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


ORACLE["op1_secret_scan"] = _secrets()


def _mixing() -> str:
    # DuckDB has no crc32: the domains of the sources that the tables hold are stated
    import zlib

    domains = ", ".join(f"('src{i}', 'domain{zlib.crc32(f'src{i}'.encode()) % 3}')" for i in range(64))

    def level(name: str, parent: str, keys: list[str], weight: str) -> str:
        part = ", ".join(keys[:-1]) or "0"
        budget = f"JOIN {parent} b USING ({', '.join(keys[:-1])})" if keys[:-1] else f"CROSS JOIN {parent} b"
        return f"""
{name}0 AS (SELECT {', '.join(keys)}, cap, w, pb, (pb - coalesce(sum(cap) OVER (PARTITION BY {part} ORDER BY cap / w, {', '.join(keys)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (PARTITION BY {part} ORDER BY cap / w, {', '.join(keys)} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM (SELECT {', '.join(keys)}, sum(cap) AS cap, any_value({weight}) AS w FROM leaf GROUP BY {', '.join(keys)}) {budget}),
{name}1 AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY cap / w, {', '.join(keys)}) AS k FROM {name}0),
{name}2 AS (SELECT {part} AS p, arg_min(lv, k) AS lv FROM {name}1 WHERE cap > w * lv GROUP BY ALL),
{name} AS (SELECT {', '.join(f'a.{k}' for k in keys)}, least(a.cap, coalesce(a.w * c.lv, a.cap)) AS pb FROM {name}1 a LEFT JOIN {name}2 c ON {' AND '.join(f'a.{k} = c.{k}' for k in keys[:-1]) or 'true'})"""

    lang = "(CASE lang WHEN 'en' THEN 4.0 WHEN 'fr' THEN 2.0 WHEN 'de' THEN 2.0 WHEN 'es' THEN 2.0 ELSE 1.0 END)::DOUBLE"
    domain = "(CASE domain WHEN 'domain0' THEN 3.0 WHEN 'domain1' THEN 2.0 WHEN 'domain2' THEN 1.0 ELSE 1.0 END)::DOUBLE"
    sql = f"""
WITH dom(source, domain) AS (VALUES {domains}),
d AS (SELECT doc_id, coalesce(domain, '') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tokens
  FROM documents LEFT JOIN dom USING (source)),
leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::DOUBLE * 2 AS cap FROM d GROUP BY ALL),
root AS (SELECT least(sum(cap), sum(tokens)::DOUBLE * 0.5) AS pb FROM leaf),
{level('l1', 'root', ['domain'], domain)},
{level('l2', 'l1', ['domain', 'lang'], lang)},
{level('l3', 'l2', ['domain', 'lang', 'source'], '1.0::DOUBLE')},
quota AS (SELECT domain, lang, source, tokens AS total, floor(pb)::BIGINT AS quota, (floor(pb)::BIGINT // tokens) AS whole, floor(pb)::BIGINT % tokens AS rest FROM leaf JOIN l3 USING (domain, lang, source) WHERE tokens > 0),
r AS (SELECT d.*, q.whole, q.rest, coalesce(sum(d.tokens) OVER (PARTITION BY d.domain, d.lang, d.source ORDER BY md5('7:' || q.whole || ':' || d.doc_id), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN quota q USING (domain, lang, source) WHERE d.tokens > 0),
e AS (SELECT *, unnest(range(0, whole + 1)) AS epoch FROM r)
SELECT doc_id, domain, lang, source, tokens, epoch::INTEGER AS epoch, (CASE WHEN epoch < whole THEN tokens ELSE least(tokens, rest - start) END)::BIGINT AS taken
FROM e WHERE epoch < whole OR start < rest
"""
    return sql.replace("SELECT 0 AS p, arg_min(lv, k) AS lv FROM l11 WHERE cap > w * lv GROUP BY ALL", "SELECT arg_min(lv, k) AS lv FROM l11 WHERE cap > w * lv").replace(" AS p, arg_min", ", arg_min")


ORACLE["op3_source_mixing"] = _mixing()


# DuckDB has no crc32: it is computed from the polynomial. A recursive step reads one row of every conversation; of each top the least (cost, audit) stays.
ORACLE["op11_conversation_repair"] = r"""
WITH RECURSIVE crc_of AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, n::BIGINT) ORDER BY n) AS t FROM range(256) r(n)),
src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS bytes FROM conversations),
dealt AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(bytes, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS k
  FROM src CROSS JOIN crc_of),
alive AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM dealt WHERE k <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM alive),
faulty AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS letter, left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS beside,
    CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM numbered),
facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (beside NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
shift(top, letter, nxt) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
fill(top, mid, n) AS (VALUES (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)),
-- what a row can do: the top it leads to, its cost and its initial
moves AS (
  SELECT DISTINCT letter, fault, top, top AS nxt, 4 AS cost, 'D' AS edit FROM (SELECT DISTINCT letter, fault FROM faulty) CROSS JOIN (VALUES (0), (1), (2), (3)) x(top)
  UNION ALL SELECT f.letter, fault, top, nxt, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'K' FROM (SELECT DISTINCT letter, fault FROM faulty) f JOIN shift s ON s.letter = f.letter WHERE fault IN ('', 'truncated')
  UNION ALL SELECT f.letter, fault, top, nxt, CASE WHEN fault = 'truncated' THEN 6 ELSE 3 END, 'R' FROM (SELECT DISTINCT letter, fault FROM faulty) f JOIN shift s ON s.letter <> 's' WHERE fault IN ('', 'truncated')),
front AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS top, {'cost': 0::BIGINT, 'audit': ''} AS best FROM facts
  UNION ALL
  SELECT f.conv_id, f.i + 1, m.nxt, min({'cost': f.best.cost + 3 * l.n + m.cost, 'audit': f.best.audit || repeat('I', l.n) || m.edit})
  FROM front f JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i + 1 JOIN fill l ON l.top = f.top JOIN moves m ON m.letter = r.letter AND m.fault = r.fault AND m.top = l.mid
  GROUP BY f.conv_id, f.i, m.nxt),
done AS (
  SELECT c.conv_id, min({'cost': f.best.cost + 3 * l.n, 'audit': f.best.audit || repeat('I', l.n)}) AS best
  FROM facts c JOIN front f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.i = c.n JOIN fill l ON l.top = f.top AND l.mid IN (0, 3) GROUP BY c.conv_id),
edits AS (SELECT conv_id, unnest(string_split(best.audit, '')) AS edit, unnest(range(1, length(best.audit) + 1)) AS k FROM done WHERE best.audit <> ''),
placed AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS i, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY k) AS place FROM edits),
kept AS (
  SELECT p.conv_id, p.k, p.edit, p.place, r.role, r.text, max(CASE WHEN p.place = 1 AND p.edit = 'K' AND r.letter = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS sys
  FROM placed p LEFT JOIN faulty r ON p.edit <> 'I' AND r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i WHERE p.edit <> 'D'),
lines AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS t FROM kept GROUP BY conv_id)
SELECT o.conv_id, coalesce(f.gaps, 0)::BIGINT AS gaps, coalesce(f.blank, 0)::BIGINT AS blank, coalesce(f.duplicate, 0)::BIGINT AS duplicate, coalesce(f.truncated, 0)::BIGINT AS truncated,
  coalesce(f.illegal, 0)::BIGINT AS illegal, coalesce(d.best.cost, 0)::BIGINT AS cost, coalesce(d.best.audit, '') AS audit, sha256(coalesce(l.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def _licenses() -> str:
    """Templates as regular expressions over the words, each between two blanks."""
    import re

    from .license_scan import TEMPLATES

    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    rows = []
    for t in TEMPLATES:
        mandatory = re.sub(r"<<beginOptional>>.*?<<endOptional>>|<<var[^>]*>>", " ", t.markup.lower().replace("beginoptional", "beginOptional").replace("endoptional", "endOptional"), flags=re.S)
        pattern = ""
        for part in re.findall(rf"<<[^>]*>>|{word}", t.markup.lower()):
            bounds = re.fullmatch(r"<<var;min=(\d+);max=(\d+)>>", part)
            pattern += "(?:" if part == "<<beginoptional>>" else ")?" if part == "<<endoptional>>" else f"(?: [^ ]+ ){{{bounds[1]},{bounds[2]}}}" if bounds else f" {part} "
        rows.append(f"('{t.label}', {str(t.base).lower()}, {len(re.findall(word, mandatory))}, '{pattern}')")
    return rf"""
WITH template(label, base, mandatory, pattern) AS (VALUES {', '.join(rows)}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') AS w FROM documents),
s AS (SELECT row_number() OVER () AS row, doc_id, w, ' ' || array_to_string(w, '  ') || ' ' AS t FROM d),
met AS (SELECT row, label, base, mandatory, len(regexp_extract_all(t, pattern)) AS n FROM s JOIN template ON regexp_matches(t, pattern)),
places AS (
  SELECT row, list_filter(range(len(w)), lambda i: (w[i + 1] = 'mit' AND w[i + 2] = 'license') OR (w[i + 1] = 'apache' AND w[i + 2] = 'license') OR (w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license')) AS spots FROM s),
g AS (
  SELECT row, string_agg(label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(label, ',' ORDER BY label) AS labels, sum(CASE WHEN base THEN n * mandatory ELSE mandatory END) AS wording FROM met GROUP BY row)
SELECT s.doc_id, len(s.w)::BIGINT AS n_words, len(p.spots)::BIGINT AS n_base, list_min(p.spots)::BIGINT AS first_word, list_max(p.spots)::BIGINT AS last_word, coalesce(g.base_labels, '') AS base_labels, coalesce(g.labels, '') AS labels,
  CASE WHEN len(s.w) > 0 THEN least(1.0::DOUBLE, coalesce(g.wording, 0)::DOUBLE / len(s.w)) ELSE 0.0 END::DOUBLE AS score
FROM s JOIN places p USING (row) LEFT JOIN g USING (row)
"""


ORACLE["op12_license_scan"] = _licenses()

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op5_ngram_jaccard_join"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
either AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS x, b AS y FROM either UNION SELECT r.x, e.b FROM reach r JOIN either e ON r.y = e.a),
least_of AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.c, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_of l ON l.x = d.doc_id
"""

# a run of windows on one diagonal of document and item is one verbatim match
ORACLE["op8_decontamination"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, w, least(13, len(w)) AS l FROM (SELECT item_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT item_id, l, j, array_to_string(w[j + 1:j + l], ' ') AS x FROM (SELECT *, unnest(range(0, len(w) - l + 1)) AS j FROM i)),
dw AS (SELECT r, l, p, array_to_string(w[p + 1:p + l], ' ') AS x FROM (SELECT r, w, l, unnest(range(0, len(w) - l + 1)) AS p FROM d CROSS JOIN (SELECT DISTINCT l FROM i) WHERE len(w) >= l)),
hit AS (SELECT r, p, item_id, j, l FROM dw JOIN iw USING (l, x)),
covered AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + l)) AS q FROM hit) GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM hit) GROUP BY r),
run AS (SELECT r, item_id::VARCHAR AS item_id, min(p) AS s, count(*) + l - 1 AS n FROM (SELECT *, p - row_number() OVER (PARTITION BY r, item_id, l, p - j ORDER BY p) AS g FROM hit) GROUP BY r, item_id, l, p - j, g),
longest AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY r ORDER BY n DESC, s, item_id) = 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items, sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(c.n > 0 AND 20 * c.n >= len(d.w), false) AS contaminated,
  coalesce(g.n, 0)::BIGINT AS longest_match, g.item_id AS longest_item, g.s::BIGINT AS longest_start
FROM d LEFT JOIN covered c USING (r) LEFT JOIN named m USING (r) LEFT JOIN longest g USING (r)
"""
