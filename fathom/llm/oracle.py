"""SQL for the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

from fathom.llm.decontaminate import LEAST_SHARE, LEAST_WORDS, LITERALS, UNITS, WINDOW
from fathom.llm.quality_rules import CLASSES, LANGUAGES, TOP_WORDS

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_KINDS = [r"a-z", r"A-Z", r"0-9", r" \t-\r", r".,;:''\"?\-()", r"#*$%&|<>!@^_~=+\[\]{}\\/`"]
_COUNTS = [f"length(regexp_replace(text, '[^{k}]', '', 'g'))" for k in _KINDS]
_NON_ASCII = r"length(regexp_replace(text, '[\x00-\x7F]', '', 'g'))"
_OTHER = f"length(text) - {_NON_ASCII} - " + " - ".join(_COUNTS)
_PLAIN = "trim(translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.,;:!?\"''()')"


def _divergence(p: str, q: str) -> str:
    m = f"(({p} + {q}) / 2)"
    return f"CASE WHEN {p} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / {m}) ELSE 0 END"


QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, text IS NULL AS none, lang, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
classes AS (SELECT doc_id, lang, none, length(text) AS chars, [{", ".join([*_COUNTS, _NON_ASCII, _OTHER])}] AS c FROM d),
lines AS (SELECT doc_id, line, count(*) - 1 AS again FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE trim(line, {_BLANKS}) <> '' GROUP BY ALL),
dup AS (SELECT doc_id, sum(again) AS n FROM lines GROUP BY 1),
word AS (SELECT doc_id, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
win AS (SELECT doc_id, p, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
often AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win WHERE c IS NOT NULL) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM often, (VALUES (0), (1), (2)) v(k) GROUP BY 1),
base AS (
  SELECT d.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN repeated USING (doc_id)),
plain AS (SELECT doc_id, lang, {_PLAIN} AS w FROM word),
langs AS (SELECT lang, count(*) AS total FROM plain WHERE lang IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {LANGUAGES}),
own AS (SELECT doc_id, w, count(*) AS n FROM plain GROUP BY ALL),
top AS (SELECT lang, w, n FROM (SELECT lang, w, count(*) AS n FROM plain WHERE w <> '' GROUP BY ALL) JOIN langs USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, w DESC) <= {TOP_WORDS}),
ref_chars AS (SELECT lang, k, sum(c[k]) / sum(sum(c[k])) OVER (PARTITION BY lang) AS q FROM (SELECT lang, c, unnest(range(1, {CLASSES + 1})) AS k FROM classes JOIN langs USING (lang) WHERE NOT none) GROUP BY lang, k),
own_chars AS (SELECT doc_id, k, c[k] / list_sum(c) AS p FROM (SELECT doc_id, c, unnest(range(1, {CLASSES + 1})) AS k FROM classes WHERE chars >= 200)),
char_d AS (SELECT doc_id, min(v) AS v FROM (SELECT doc_id, lang, sqrt(greatest(sum({_divergence("p", "q")}) / 2, 0)) AS v FROM own_chars JOIN ref_chars USING (k) GROUP BY ALL) GROUP BY 1),
ref_sum AS (SELECT lang, total, sum(n) AS held FROM top JOIN langs USING (lang) GROUP BY ALL),
met AS (SELECT b.doc_id, t.lang, t.n / r.total AS q, coalesce(o.n, 0) / b.n_words AS p FROM base b CROSS JOIN top t JOIN ref_sum r USING (lang) LEFT JOIN own o ON o.doc_id = b.doc_id AND o.w = t.w WHERE b.n_words >= 50),
rest AS (SELECT doc_id, lang, greatest(1 - sum(q), 0) AS q, greatest(1 - sum(p), 0) AS p FROM met GROUP BY ALL),
word_d AS (SELECT doc_id, min(v) AS v FROM (SELECT doc_id, lang, sqrt(greatest(sum({_divergence("p", "q")}) / 2, 0)) AS v FROM (SELECT doc_id, lang, p, q FROM met UNION ALL SELECT doc_id, lang, p, q FROM rest) GROUP BY ALL) GROUP BY 1),
judged AS (SELECT base.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, char_d.v AS c, word_d.v AS w FROM base LEFT JOIN char_d USING (doc_id) LEFT JOIN word_d USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(c <= 0.22, TRUE) AND coalesce(w <= 0.36, TRUE) AS kept, round(c, 6) AS char_distance, round(w, 6) AS word_distance FROM judged
"""

LINES = f"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text <> '')),
f AS (SELECT doc_id, i, trim(line, {_BLANKS}) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p FROM l WHERE trim(line, {_BLANKS}) <> ''),
w AS (SELECT doc_id, p, s AS a, lead(s, 1) OVER o AS b, lead(s, 2) OVER o AS c FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
z AS (SELECT doc_id, p, first_value(doc_id) OVER o AS fd, first_value(p) OVER o AS fp FROM w WHERE c IS NOT NULL WINDOW o AS (PARTITION BY a, b, c ORDER BY doc_id, p)),
gone AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = fd THEN greatest(p, fp + 3) ELSE p END, p + 3)) AS p FROM z WHERE doc_id <> fd OR p <> fp),
kept AS (SELECT l.doc_id, string_agg(CASE WHEN gone.p IS NULL THEN line END, chr(10) ORDER BY l.i) AS text, count(*) AS n_lines, count(gone.p) AS n_removed FROM l LEFT JOIN f USING (doc_id, i) LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.p = f.p GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM documents d LEFT JOIN kept k USING (doc_id)
"""

_EDGE = """' .,;:!?"''()[]{}*#$%&|<>`~_-'"""
_UNITS = ", ".join(f"'{u}'" for u in sorted(UNITS))


def _templates(name: str, key: str, source: str) -> str:
    """Words of a table: place, bare lower-case form, template, and the other template of a title-case word that begins a sentence."""
    return rf"""
{name}_all AS (SELECT {key}, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p, len(ws) AS own FROM {source}),
{name}_bare AS (SELECT *, trim(w, {_EDGE}) AS bare, lower(trim(w, {_EDGE})) AS low, p = 0 OR coalesce(lag(regexp_matches(w, '[.!?:]["'')\]}}]*$')) OVER (PARTITION BY {key} ORDER BY p), FALSE) AS begins FROM {name}_all),
{name}_kind AS (SELECT *, CASE WHEN regexp_matches(low, '^[+-]?[$€£]?[0-9][0-9.,:/]*(%|[a-z]{{0,3}})$') THEN '<num>' WHEN low IN ({_UNITS}) THEN '<unit>' END AS slot,
  length(bare) > 1 AND bare[1] <> lower(bare[1]) AND substr(bare, 2) = substr(low, 2) AS title FROM {name}_bare),
{name} AS (SELECT {key}, p, own, low, coalesce(slot, CASE WHEN title AND NOT begins THEN '<name>' ELSE low END) AS one, CASE WHEN slot IS NULL AND title AND begins THEN '<name>' END AS two FROM {name}_kind)"""


LEAKS = rf"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
items AS (SELECT item_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
{_templates("d", "doc_id", "texts").strip()},
{_templates("b", "item_id", "items").strip()},
df AS (SELECT doc_id, p, unnest([one, two]) AS form FROM d),
bf AS (SELECT item_id, p, own, unnest([one, two]) AS form FROM b),
met AS (SELECT doc_id, item_id, df.p - bf.p AS shift, bf.p AS p, any_value(own) AS own, max(CASE WHEN form[1] = '<' THEN 0 ELSE 1 END) AS literal FROM df JOIN bf USING (form) WHERE form IS NOT NULL GROUP BY ALL),
win AS (SELECT *, least({WINDOW}, own) AS n, count(*) OVER o AS held, sum(literal) OVER o AS literals FROM met WINDOW o AS (PARTITION BY doc_id, item_id, shift ORDER BY p RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
hit AS (SELECT DISTINCT doc_id, item_id, shift, own, unnest(range(p, p + n)) AS p FROM win WHERE held = n AND p + n <= own AND literals >= least({LITERALS}, n)),
pair AS (SELECT h.*, b.low AS x, d.low AS y, b.two IS NOT NULL AS maybe, b.one[1] = '<' OR b.two IS NOT NULL AS mark FROM hit h JOIN b ON b.item_id = h.item_id AND b.p = h.p JOIN d ON d.doc_id = h.doc_id AND d.p = h.p + h.shift),
slot AS (SELECT *, min(CASE WHEN NOT (maybe AND x = y) THEN p END) OVER (PARTITION BY doc_id, item_id, shift, x) AS since FROM pair WHERE mark),
value AS (SELECT *, first_value(y) OVER (PARTITION BY doc_id, item_id, shift, x ORDER BY p) AS y0 FROM slot WHERE p >= since),
odd AS (SELECT doc_id, item_id, shift, count(*) AS total, count(*) FILTER (y <> y0) AS odd FROM value GROUP BY ALL),
line AS (SELECT h.* FROM hit h LEFT JOIN odd o USING (doc_id, item_id, shift) WHERE 5 * coalesce(odd, 0) <= coalesce(total, 0)),
leak AS (SELECT doc_id, item_id, any_value(own) AS own, count(DISTINCT p) AS n, min(p + shift) AS first_word FROM line GROUP BY ALL)
SELECT doc_id, item_id, n AS n_covered, n / own AS share, first_word FROM leak WHERE n >= least({LEAST_WORDS}, own) OR n >= {LEAST_SHARE} * own
"""

# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (f"{p}::UHUGEINT" for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_M = "18446744073709551615::UHUGEINT"
_SEED = 42


def _times(x: str, p: str) -> str:
    return f"((({x}) * {p}) & {_M})"


def _turned(x: str, bits: int) -> str:
    """Rotation to the left: multiplication by a power of two modulo 2 ** 64 - 1."""
    return f"((({x}) << {bits}) % {_M})"


def _mixed(held: str, lane: str) -> str:
    return _times(_turned(f"({held} + {_times(lane, _P2)}) & {_M}", 31), _P1)


def _lanes(first: str, size: int, step: int, stop: str) -> str:
    """Little-endian numbers of ``size`` bytes, ``step`` bytes apart."""
    return f"list_transform(range({first}, {stop}, {step}), lambda i: ('0x' || reverse(substr(x, 2 * i + 1, {2 * size})))::UHUGEINT)"


_START = [(_SEED + 11400714785074694791 + 14029467366897019727) % 2**64, (_SEED + 14029467366897019727) % 2**64, _SEED, (_SEED - 11400714785074694791) % 2**64]
_STRIPES = ", ".join(f"list_reduce({_lanes(str(8 * k), 8, 32, 'n - n % 32')}, lambda a, b: {_mixed('a', 'b')}, {s}::UHUGEINT) AS v{k}" for k, s in enumerate(_START))
_FOLDED = f"({' + '.join(_turned(f'v{k}', r) for k, r in enumerate((1, 7, 12, 18)))}) & {_M}"
for _k in range(4):
    _FOLDED = f"({_times(f'xor({_FOLDED}, {_mixed("0::UHUGEINT", f"v{_k}")})', _P1)} + {_P4}) & {_M}"
_EIGHTS = f"list_reduce({_lanes('n - n % 32', 8, 8, 'n - n % 8')}, lambda a, b: ({_times(_turned(f'xor(a, {_mixed("0::UHUGEINT", "b")})', 27), _P1)} + {_P4}) & {_M}, h)"
_FOURS = f"list_reduce({_lanes('n - n % 8', 4, 4, 'n - n % 4')}, lambda a, b: ({_times(_turned(f'xor(a, {_times("b", _P1)})', 23), _P2)} + {_P3}) & {_M}, h)"
_BYTES = f"list_reduce({_lanes('n - n % 4', 1, 1, 'n')}, lambda a, b: {_times(_turned(f'xor(a, {_times("b", _P5)})', 11), _P1)}, h)"

SIMHASH = rf"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingle AS (SELECT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) END AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM texts WHERE len(ws) > 0)),
own AS (SELECT DISTINCT s FROM shingle),
raw AS (SELECT s, regexp_replace(hex(encode(s)), '(.)(.)', '\2\1', 'g') AS x, octet_length(encode(s)) AS n FROM own),
stripes AS (SELECT s, x, n, {_STRIPES} FROM raw),
begun AS (SELECT s, x, n, ((CASE WHEN n >= 32 THEN {_FOLDED} ELSE ({_SEED}::UHUGEINT + {_P5}) & {_M} END) + n::UHUGEINT) & {_M} AS h FROM stripes),
eights AS (SELECT s, x, n, {_EIGHTS} AS h FROM begun),
fours AS (SELECT s, x, n, {_FOURS} AS h FROM eights),
bytes AS (SELECT s, {_BYTES} AS h FROM fours),
one AS (SELECT s, {_times('xor(h, h >> 33)', _P2)} AS h FROM bytes),
two AS (SELECT s, {_times('xor(h, h >> 29)', _P3)} AS h FROM one),
hashed AS (SELECT s, (xor(h, h >> 32) & {_M})::UBIGINT AS h FROM two),
bits AS (SELECT doc_id, count(*) AS n, {", ".join(f"sum((h >> {b}) & 1) AS b{b}" for b in range(64))} FROM shingle JOIN hashed USING (s) GROUP BY 1),
prints AS (SELECT doc_id, coalesce(f, 0::UBIGINT) AS f FROM documents LEFT JOIN (SELECT doc_id, ({" + ".join(f"CASE WHEN 2 * b{b} > n THEN {1 << b}::UHUGEINT ELSE 0 END" for b in range(64))})::UBIGINT AS f FROM bits) USING (doc_id)),
different AS (SELECT DISTINCT f FROM prints),
links AS (SELECT a.f AS a, b.f AS b FROM different a, different b WHERE bit_count(xor(a.f, b.f)) <= 3),
reach AS (SELECT f AS a, f AS b FROM different UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT reach.a AS f, min(doc_id) AS component_id FROM reach JOIN prints ON prints.f = reach.b GROUP BY 1)
SELECT doc_id, lower(lpad(hex(f), 16, '0')) AS fingerprint, component_id FROM prints JOIN least USING (f)
"""
