"""DuckDB SQL for the operators' queries that SQL can express over the same tables."""

from . import line_dedup, mixing, quality, secrets, suffix_dedup

SPACE = r"\x20\x09-\x0D"
T = "coalesce(text, '')"
LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _found(rule: secrets.Rule, rank: int) -> str:
    p = _quote(rule.pattern)
    return f"""SELECT doc_id, {rank} rank, '{rule.kind}' kind, a start, a + n stop FROM (
 SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))) a,
 unnest(list_transform(m, lambda x: length(x))) n, unnest(list_transform(s, lambda x: length(x))) k
 FROM (SELECT doc_id, string_split_regex({T}, {p}) g, regexp_extract_all({T}, {p}, 0) m, regexp_extract_all({T}, {p}, {rule.part}) s FROM documents WHERE regexp_matches({T}, {p}))) WHERE k >= {rule.least}"""


OP1 = "WITH f AS (" + " UNION ALL ".join(_found(r, i) for i, r in enumerate(secrets.RULES)) + f"""),
 a AS (SELECT doc_id, string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) spans, string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) FILTER (WHERE rank < {len(secrets.BASE_RULES)}) base,
 count(*) FILTER (WHERE kind = 'assign') n_assign, count(*) FILTER (WHERE kind = 'access') n_access, count(*) FILTER (WHERE kind = 'hex') n_hex FROM f GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id"""

OP2 = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all({T}, '{mixing.WORD}')) size FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) source_size, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE w FROM d GROUP BY 1),
 o AS (SELECT *, row_number() OVER (ORDER BY source_size / w) i, 1.5::DOUBLE * (SELECT sum(source_size) FROM s) total FROM s),
 c AS (SELECT *, coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) capped, sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) rest FROM o),
 k AS (SELECT min(i) i FROM c WHERE w * ((total - capped) / rest) <= source_size * 2.0::DOUBLE),
 l AS (SELECT coalesce((SELECT (total - capped) / rest FROM c, k WHERE c.i = k.i), 0) level, coalesce((SELECT i FROM k), 1000000000) i),
 t AS (SELECT source, source_size, CASE WHEN c.i < l.i THEN source_size * 2.0::DOUBLE ELSE w * level END target FROM c, l),
 u AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END whole FROM t),
 r AS (SELECT d.doc_id, d.size, u.source_size, u.target, u.whole, CAST(floor(u.target) AS BIGINT) - u.whole * u.source_size rest, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('17:' || d.doc_id), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) gone FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(rest - gone, size)) AS BIGINT) taken FROM r"""

OP5 = f"""WITH d AS (SELECT doc_id, {T} t, regexp_extract_all({T}, '[^{SPACE}]+') w, list_filter(string_split({T}, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) l FROM documents),
 p AS (SELECT doc_id, unnest(w) w, unnest(range(1, len(w) + 1)) i FROM d),
 g AS (SELECT doc_id, i, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) s, count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) k FROM p),
 m AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) c FROM g WHERE k = 8),
 v AS (SELECT doc_id, count(DISTINCT i + j) n FROM m, range(8) r(j) WHERE c > 1 GROUP BY 1),
 b AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) n_dup_lines, CAST(coalesce(v.n, 0) AS BIGINT) n_repeat_words,
 len(l) n_lines, len(regexp_extract_all(t, '[A-Z]')) up, len(regexp_extract_all(t, '[a-z]')) lo, len(regexp_extract_all(t, '!')) bangs FROM d LEFT JOIN v ON d.doc_id = v.doc_id),
 f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 2 * bangs > n_words OR (up > 20 AND 2 * up > 3 * lo) OR 5 * n_dup_lines > 2 * n_lines OR word_chars > 20 * n_words OR word_chars < 2 * n_words) kept FROM f"""

N = suffix_dedup.LENGTH
OP8 = f"""WITH d AS (SELECT doc_id, hex(encode({T})) h, octet_length(encode({T})) n FROM documents),
 s AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * N}) s FROM (SELECT doc_id, h, unnest(range(n - {N - 1})) i FROM d WHERE n >= {N})),
 m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) first FROM s) WHERE first < doc_id),
 e AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000000000) + {N} new FROM m),
 r AS (SELECT doc_id, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) k FROM e),
 p AS (SELECT doc_id, k, min(i) a, max(i) + {N} b FROM r GROUP BY 1, 2),
 c AS (SELECT p.doc_id, p.k, a, b, coalesce(lag(b) OVER (PARTITION BY p.doc_id ORDER BY p.k), 0) before FROM p),
 q AS (SELECT doc_id, sum(b - a) removed, count(*) spans, max(b) tail, list(struct_pack(x := before, y := a) ORDER BY k) gaps FROM c GROUP BY 1)
SELECT d.doc_id, CAST(n AS BIGINT) n_bytes, CAST(coalesce(removed, 0) AS BIGINT) n_removed, CAST(coalesce(spans, 0) AS BIGINT) n_spans,
 CASE WHEN q.doc_id IS NULL THEN sha256(unhex(h)) ELSE sha256(unhex(array_to_string(list_transform(gaps, lambda g: substr(h, 2 * g.x + 1, 2 * (g.y - g.x))), '') || substr(h, 2 * tail + 1))) END kept_sha256
FROM d LEFT JOIN q ON d.doc_id = q.doc_id"""

OP10 = f"""WITH d AS (SELECT doc_id, translate({T}, {LETTERS}) t FROM documents)
SELECT doc_id, max(doc_id) OVER w keep_id, count(*) OVER w group_size, doc_id = max(doc_id) OVER w kept, sha256(t) text_sha256 FROM d WINDOW w AS (PARTITION BY t)"""

WS = line_dedup.WS
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: What ends a unit of each level; a mark put behind it cuts the text. At a line end in front of other white space a sentence ends once.
ENDS = {"paragraph": rf"(\n[ \t]*\n{WS}*)", "line": r"(\n)", "sentence": rf"(\n|[.!?][ \t\r\x0b\x0c]{WS}*)"}
MARK = "chr(57344)"


def _units(unit: str, min_words: int, rank: int) -> str:
    return f"""SELECT doc_id, {rank} rank, start, start + length(u) stop, start + length(u) - length(ltrim(u, {BLANKS})) place, n FROM (
 SELECT doc_id, u, CAST(coalesce(sum(length(u)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) start, regexp_replace(trim(translate(u, {LETTERS}), {BLANKS}), '{WS}+', ' ', 'g') n FROM (
 SELECT doc_id, unnest(p) u, unnest(range(len(p))) i FROM (SELECT doc_id, string_split(regexp_replace({T}, '{ENDS[unit]}', '\\1' || {MARK}, 'g'), {MARK}) p FROM documents))) WHERE n <> '' AND length(n) - length(replace(n, ' ', '')) + 1 >= {min_words}"""


OP9 = "WITH a AS (" + " UNION ALL ".join(_units(unit, least, k) for k, (unit, least) in enumerate(line_dedup.LEVELS)) + """),
 o AS (SELECT doc_id, start, stop, place, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, n, place ORDER BY rank) k FROM a) WHERE k = 1),
 g AS (SELECT doc_id, start, stop FROM (SELECT *, first_value(struct_pack(d := doc_id, p := place)) OVER (PARTITION BY n ORDER BY doc_id, place) f FROM o) WHERE f.d <> doc_id OR f.p <> place),
 e AS (SELECT *, coalesce(start >= max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) new FROM g),
 r AS (SELECT doc_id, start, stop, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) k FROM e),
 s AS (SELECT doc_id, k, min(start) a, max(stop) b FROM r GROUP BY 1, 2),
 c AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0) before FROM s),
 q AS (SELECT doc_id, count(*) n, string_agg(a || ':' || b, ',' ORDER BY k) removed, max(b) tail, list(struct_pack(x := before, y := a) ORDER BY k) gaps FROM c GROUP BY 1),
 t AS (SELECT d.doc_id, coalesce(n, 0) n, coalesce(removed, '') removed, """ + f"""CASE WHEN q.doc_id IS NULL THEN text ELSE array_to_string(list_transform(gaps, lambda g: substr({T}, g.x + 1, g.y - g.x)), '') || substr({T}, tail + 1) END text FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id)
SELECT doc_id, CAST(n AS BIGINT) n_removed, removed, CAST(length(text) AS BIGINT) kept_chars, sha256({T}) kept_sha256 FROM t"""

#: Scores are whole numbers below 2**53, so a sum of doubles is exact.
OP11 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) score FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) k FROM s)
SELECT query_id, CAST(k AS INTEGER) "rank", vec_id, score FROM r WHERE k <= 20"""

#: CRC-32 of a number's decimal digits, bit by bit.
CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
 lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(i AS BIGINT) FOR i IN range(8)]), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295)"""

#: In a run of at least 24 words and three periods, windows of 8 words are found again a period on; stretches of such windows are runs.
OP13 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({T}, '[^{SPACE}]+') w, {CRC} h FROM documents),
 e AS (SELECT *, len(w) n, h // 10 g FROM d), f AS (SELECT *, g % greatest(n, 1) a FROM e), q AS (SELECT *, 1 + (n - a) // (3 + g % 8) p FROM f),
 t AS (SELECT doc_id, n, i, w[CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END + 1] word FROM (SELECT *, unnest(range(n)) i FROM q)),
 x AS (SELECT doc_id, n, i, string_agg(word, ' ') OVER o s, count(*) OVER o k FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
 m AS (SELECT doc_id, n, i, s FROM x WHERE k = 8),
 b AS (SELECT l.doc_id, l.i, r.i - l.i q FROM m l JOIN m r ON l.doc_id = r.doc_id AND l.s = r.s AND l.i < r.i AND 3 * (r.i - l.i) <= l.n),
 y AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) z FROM b),
 z AS (SELECT doc_id, q, min(i) a, count(*) + 7 + q l FROM y GROUP BY doc_id, q, z),
 r AS (SELECT doc_id, a, l, min(q) q FROM z WHERE l >= greatest(24, 3 * q) GROUP BY doc_id, a, l),
 u AS (SELECT doc_id, count(*) n_runs, first(struct_pack(a := a, l := l, q := q) ORDER BY l / q DESC, a, q) top, string_agg(a || ',' || l || ',' || q || chr(10), '' ORDER BY a, q) s FROM r GROUP BY 1),
 g AS (SELECT DISTINCT doc_id, unnest(range(a + q, a + l)) i FROM r),
 k AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.i) s FROM t LEFT JOIN g ON t.doc_id = g.doc_id AND t.i = g.i WHERE g.i IS NULL GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0) n_runs, CAST(top.a AS BIGINT) AS "start", CAST(top.l AS BIGINT) "length", CAST(top.q AS BIGINT) period, CAST(1000 * top.l // top.q AS BIGINT) exponent_milli, sha256(coalesce(u.s, '')) runs_sha256, sha256(coalesce(k.s, '')) collapsed_sha256
FROM d LEFT JOIN u ON d.doc_id = u.doc_id LEFT JOIN k ON d.doc_id = k.doc_id"""

SQL = {"op1_secret_scan": OP1, "op2_source_mix": OP2, "op5_quality_rules": OP5, "op8_suffix_dedup": OP8, "op9_line_dedup": OP9, "op10_exact_dedup": OP10, "op11_top_k_search": OP11, "op13_periodic_runs": OP13}
