"""SQL (DuckDB) for the rows of the queries that SQL can express, over the same whole tables.

The others have none: op3 needs places of regular expression matches and a trained classifier, op5 trees, op9 a vocabulary. They are
tested against brute force, exact round trips or held-out accuracy. XXH64 and the swap-or-not permutation are written out in
128-bit integers.
"""

from __future__ import annotations

from . import jaccard, mixing, simhash
from .line_dedup import MIN_WORDS
from .quality_rules import LINE_LIMIT, NGRAM_LIMITS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

QUALITY = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
p AS (SELECT r, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
size AS (SELECT r, sum(length(word)) AS word_chars FROM p GROUP BY r),
g AS (
  SELECT r, n, i, row_number() OVER (PARTITION BY r, n, gram ORDER BY i) AS nth, count(*) OVER (PARTITION BY r, n, gram) AS times
  FROM (SELECT r, n, i, ws[i:i + n - 1] AS gram FROM (
    SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (VALUES (3), {", ".join(f"({n})" for n in NGRAM_LIMITS)}) x(n)))
),
cover AS (
  SELECT DISTINCT r, n, i + k AS i FROM (SELECT r, n, i, unnest(range(0, n)) AS k FROM g WHERE CASE WHEN n = 3 THEN times > 1 ELSE nth > 1 END)
),
dup AS (SELECT c.r, c.n, count(*) AS words, sum(length(p.word)) AS chars FROM cover c JOIN p USING (r, i) GROUP BY c.r, c.n),
l AS (SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lines AS (SELECT r, sum(times) AS n, count(*) AS distinct_n, sum(times * length(line)) AS chars, sum(length(line)) AS distinct_chars
  FROM (SELECT r, line, count(*) AS times FROM l GROUP BY r, line) GROUP BY r),
m AS (
  SELECT w.r, doc_id, len(ws) AS n_words, coalesce(word_chars, 0) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lines.n - distinct_n, 0) AS n_dup_lines, coalesce(d3.words, 0) AS n_repeat_words,
    coalesce(lines.chars - distinct_chars, 0) > {LINE_LIMIT} * coalesce(lines.chars, 0) AS bad_lines
  FROM w LEFT JOIN size USING (r) LEFT JOIN lines USING (r) LEFT JOIN dup d3 ON d3.r = w.r AND d3.n = 3
),
bad AS (SELECT DISTINCT dup.r FROM dup JOIN size USING (r) WHERE {" OR ".join(f"(n = {n} AND chars > {x} * word_chars)" for n, x in NGRAM_LIMITS.items())}),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT bad_lines AND r NOT IN (SELECT r FROM bad) AS kept
FROM v
"""

SUBSTRINGS = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
g AS (SELECT r, doc_id, i, ws[i:i + 12] AS gram FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
first AS (SELECT gram, min(doc_id) AS doc_id FROM g GROUP BY gram),
gone AS (
  SELECT r, list(DISTINCT i + k) AS places FROM (
    SELECT g.r, g.i, unnest(range(0, 13)) AS k FROM g JOIN first USING (gram) WHERE g.doc_id > first.doc_id) GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN places IS NULL THEN ws ELSE [ws[i] FOR i IN range(1, len(ws) + 1) IF NOT list_contains(places, i)] END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (r)
"""

#: Base32 of a SHA-1: 5 hexadecimal digits are 4 letters.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, {5 * i + 1}, 5) AS BIGINT) >> {shift}) & 31 AS INTEGER), 1)" for i in range(8) for shift in (15, 10, 5, 0)
)

ARCHIVES = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
first AS (SELECT payload, min(page_id) AS page_id FROM p GROUP BY payload)
SELECT p.page_id, CAST(strlen(p.payload) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN p.page_id = first.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id <> first.page_id THEN first.page_id END AS refers_to
FROM p JOIN first USING (payload)
"""

LINES = rf"""
WITH t AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, i - 1 AS no, regexp_extract_all(parts[i], '[^\x20\x09-\x0D]+') AS ws FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM t)),
k AS (SELECT doc_id, no, ws, array_to_string(ws, ' ') AS line, doc_id * 10000000 + no AS pos FROM l WHERE len(ws) >= {MIN_WORDS}),
f AS (SELECT line, any_value(ws) AS ws, min(pos) AS pos FROM k GROUP BY line),
v AS (SELECT pos, i, array_to_string(ws[1:i - 1] || ws[i + 1:], ' ') AS key FROM (SELECT pos, ws, unnest(range(1, len(ws) + 1)) AS i FROM f)),
s AS (SELECT key, i, min(pos) AS pos FROM v GROUP BY key, i),
m AS (SELECT key, min(pos) AS pos FROM v GROUP BY key),
lost AS (
  SELECT v.pos FROM v JOIN s USING (key, i) WHERE s.pos < v.pos
  UNION SELECT v.pos FROM v JOIN f ON f.line = v.key WHERE f.pos < v.pos
  UNION SELECT f.pos FROM f JOIN m ON m.key = f.line WHERE m.pos < f.pos
),
gone AS (SELECT k.doc_id, list(k.no) AS places FROM k JOIN f USING (line) WHERE k.pos <> f.pos OR f.pos IN (SELECT pos FROM lost) GROUP BY k.doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN CAST(0 AS BIGINT) ELSE CAST(len(parts) AS BIGINT) END AS n_lines, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN places IS NULL THEN coalesce(text, '') ELSE coalesce(array_to_string([parts[i] FOR i IN range(1, len(parts) + 1) IF NOT list_contains(places, i - 1)], chr(10)), '') END) AS kept_sha256
FROM t LEFT JOIN gone USING (doc_id)
"""


def _alnum(column: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


CONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_alnum("text")} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_alnum("text")} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, ws[i:i + 12] AS gram FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT r, i, n, ws[i:i + n - 1] AS gram FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT len(gram) AS n FROM bw))),
hit AS (SELECT dw.r, dw.i, dw.n, bw.item FROM dw JOIN bw USING (gram)),
words AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT r, i, unnest(range(0, n)) AS k FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

# XXH64 in SQL. Its five primes.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_FULL = (1 << 64) - 1


def _u(n: int) -> str:
    return f"{n}::UHUGEINT"


def _low(x: str) -> str:
    return f"(({x}) & {_u(_FULL)})"


def _times(x: str, n: int) -> str:
    return _low(f"({x}) * {_u(n)}")


def _rotated(x: str, by: int) -> str:
    return f"({_low(f'({x}) << {by}')} | (({x}) >> {64 - by}))"


def _let(name: str, value: str, body: str) -> str:
    """body with a name for a value, so that it is worked out once."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _round(acc: str, lane: str) -> str:
    return _times(_rotated(_low(f"{acc} + {_times(lane, _P2)}"), 31), _P1)


def _eight(h: str, lane: str) -> str:
    return _low(_times(_rotated(f"xor({h}, {_times(_rotated(_times(lane, _P2), 31), _P1)})", 27), _P1) + f" + {_u(_P4)}")


def _four(h: str, lane: str) -> str:
    return _low(_times(_rotated(f"xor({h}, {_times(lane, _P1)})", 23), _P2) + f" + {_u(_P3)}")


def _one(h: str, lane: str) -> str:
    return _times(_rotated(f"xor({h}, {_times(lane, _P5)})", 11), _P1)


def _ended(h: str) -> str:
    return _let("e1", _times(f"xor({h}, {h} >> 33)", _P2), _let("e2", _times("xor(e1, e1 >> 29)", _P3), "xor(e2, e2 >> 32)"))


def _little(hexes: str, size: int) -> str:
    """The integer that bytes written as hexadecimal digits are, the lowest first."""
    return "('0x' || " + " || ".join(f"substr({hexes}, {2 * i + 1}, 2)" for i in reversed(range(size))) + ")::UBIGINT::UHUGEINT"


def _xxh64(source: str, name: str) -> str:
    """Common table expressions up to ``name``(s, seed, h): XXH64 of the strings s of source(s, seed), seeds and results unsigned."""
    lanes = lambda k: f"[lanes[4 * i + {k}] FOR i IN range(0, stripes)]"
    stripe = lambda start, k: f"list_reduce([{_low(start)}] || {lanes(k)}, lambda a, l: {_round('a', 'l')})"
    joined = _low(" + ".join(_rotated(v, r) for v, r in (("v1", 1), ("v2", 7), ("v3", 12), ("v4", 18))))
    merged = _low(_times(f"xor(h, {_times(_rotated(_times('v', _P2), 31), _P1)})", _P1) + f" + {_u(_P4)}")
    tail = f"list_reduce([{_low('h + n::UHUGEINT')}] || lanes[4 * stripes + 1:], lambda h, l: {_eight('h', 'l')})"
    tail = f"list_reduce([list_reduce([{tail}] || fours, lambda h, l: {_four('h', 'l')})] || ones, lambda h, l: {_one('h', 'l')})"
    return f"""{name}_1 AS (SELECT s, seed, hex(s) AS x, length(hex(s)) // 2 AS n FROM {source}),
{name}_2 AS (SELECT s, seed, n, n // 32 AS stripes, [{_little("substr(x, 16 * i + 1, 16)", 8)} FOR i IN range(0, n // 8)] AS lanes,
  [{_little("substr(x, 16 * (n // 8) + 1, 8)", 4)} FOR i IN range(0, (n % 8) // 4)] AS fours,
  [{_little("substr(x, 2 * i + 1, 2)", 1)} FOR i IN range(n - n % 4, n)] AS ones FROM {name}_1),
{name}_3 AS (SELECT *, {stripe(f"seed + {_u((_P1 + _P2) & _FULL)}", 1)} AS v1, {stripe(f"seed + {_u(_P2)}", 2)} AS v2,
  {stripe("seed", 3)} AS v3, {stripe(f"seed + {_u((1 << 64) - _P1)}", 4)} AS v4 FROM {name}_2),
{name}_4 AS (SELECT *, CASE WHEN stripes = 0 THEN {_low(f"seed + {_u(_P5)}")} ELSE list_reduce([{joined}, v1, v2, v3, v4], lambda h, v: {merged}) END AS h FROM {name}_3),
{name}_5 AS (SELECT s, seed, {tail} AS h FROM {name}_4),
{name} AS (SELECT s, seed, {_ended("h")} AS h FROM {name}_5)"""


def _hash_long(x: str, seed: str) -> str:
    """Of an unsigned 64-bit integer."""
    return _let("a1", _low(f"{seed} + {_u(_P5 + 8)}"), _let("a2", _eight("a1", x), _ended("a2")))


def _hash_int(x: str, seed: str) -> str:
    return _let("b1", _low(f"{seed} + {_u(_P5 + 4)}"), _let("b2", _four("b1", x), _ended("b2")))


def _signed(h: str) -> str:
    return f"(CASE WHEN {h} > {(1 << 63) - 1}::UHUGEINT THEN {h}::HUGEINT - {1 << 64}::HUGEINT ELSE {h}::HUGEINT END)"


def _modulo(x: str, n: str) -> str:
    return f"(((({x}) % ({n})) + ({n})) % ({n}))"


_ONES = ", ".join(f"sum((h >> {k}) & 1::UHUGEINT) AS b{k}" for k in range(64))
_PRINT = " + ".join(f"(CASE WHEN 2 * b{k} > n THEN {1 << k}::UHUGEINT ELSE 0::UHUGEINT END)" for k in range(64))

SIMHASH = rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT r, array_to_string(ws[i:i + {simhash.SHINGLE - 1}], ' ') AS s FROM (
  SELECT r, ws, unnest(range(1, greatest(len(ws) - {simhash.SHINGLE - 1}, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
known AS (SELECT DISTINCT s, {_u(simhash.SEED)} AS seed FROM g),
{_xxh64("known", "hashed")},
bits AS (SELECT r, count(*) AS n, {_ONES} FROM g JOIN hashed USING (s) GROUP BY r),
p AS (SELECT w.r, w.doc_id, coalesce(({_PRINT})::UBIGINT, 0::UBIGINT) AS print FROM w LEFT JOIN bits USING (r)),
d AS (SELECT print, min(doc_id) AS first FROM p GROUP BY print),
masks AS (SELECT DISTINCT ((1::UBIGINT << i) | (1::UBIGINT << j)) AS mask FROM (SELECT unnest(range(0, 64)) AS i), (SELECT unnest(range(0, 64)) AS j)),
near AS (SELECT a.print AS a, b.print AS b FROM (SELECT print, xor(print, mask) AS other FROM d, masks) a JOIN d b ON b.print = a.other),
reached AS (SELECT print, print AS other FROM d UNION SELECT reached.print, near.b FROM reached JOIN near ON near.a = reached.other),
least AS (SELECT reached.print, min(d.first) AS component_id FROM reached JOIN d ON d.print = reached.other GROUP BY reached.print)
SELECT p.doc_id, lpad(lower(to_hex(p.print)), 16, '0') AS fingerprint, component_id FROM p JOIN least USING (print)
"""

def _unsigned(x: str) -> str:
    """A 64-bit integer, negative ones too, as the unsigned one with the same bits."""
    return f"(CASE WHEN {x} < 0 THEN ({x}::HUGEINT + {1 << 64}::HUGEINT)::UHUGEINT ELSE ({x})::UHUGEINT END)"


_42 = _u(42)
_SEED = _u(mixing.SEED)
#: What swap-or-not does to x in one step, with k, the step's key already reduced, and n items.
_SWAPPED = _let(
    "partner", _modulo("(k.key - x)", "n"),
    _let("top", "greatest(x, partner)", f"CASE WHEN {_hash_int('k.step::UHUGEINT', _hash_long('p.rank::UHUGEINT', _hash_long('top::UHUGEINT', _42)))} % 2::UHUGEINT = 0 THEN x ELSE partner END"),
)
_WEIGHT = "CASE rank % 3 " + " ".join(f"WHEN {i} THEN {float(w)}::DOUBLE" for i, w in enumerate(mixing.WEIGHTS)) + " END"
assert len(mixing.WEIGHTS) == 3

MIX = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS s, len({_WORDS}) AS size,
  {_hash_long(_unsigned("doc_id"), _42)} AS seed FROM documents),
texts AS (SELECT DISTINCT s, seed FROM d),
{_xxh64("texts", "marks")},
sources AS (SELECT row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank, source, count(*) AS n_docs, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
weighted AS (SELECT *, {_WEIGHT} AS weight, source_size * {float(mixing.MAX_EPOCHS)}::DOUBLE AS cap FROM sources),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
free AS (SELECT min(struct_pack(a := cap / weight, b := rank, c := level)) AS f FROM levels WHERE level * weight <= cap),
targets AS (SELECT rank, source, n_docs, source_size, least(cap, coalesce((SELECT f.c FROM free), 'inf'::DOUBLE) * weight) AS target FROM weighted),
plan AS (SELECT rank, n_blocks, want, sum(want) OVER (ORDER BY rank) - want AS start FROM (
  SELECT rank, ceil(source_size / {mixing.BLOCK})::BIGINT AS n_blocks,
    least(round(target * ceil(source_size / {mixing.BLOCK}) / source_size), ceil(source_size / {mixing.BLOCK}) * {mixing.MAX_EPOCHS})::BIGINT AS want
  FROM targets WHERE source_size > 0)),
total AS (SELECT coalesce(sum(want), 0)::BIGINT AS n FROM plan),
slots AS (SELECT slot, slot // {mixing.SHARD_SLOTS} AS shard,
  {_modulo(_signed(_hash_int(_SEED, _hash_long("slot::UHUGEINT", _42))), "total.n::HUGEINT")} AS spot
  FROM total, (SELECT unnest(range(0, (SELECT n FROM total))) AS slot)),
drawn AS (SELECT shard, slot, rank FROM slots JOIN plan ON spot >= start AND spot < start + want),
counts AS (SELECT shard, rank, count(*) AS n, {_signed(_hash_long("rank::UHUGEINT", _hash_long("shard::UHUGEINT", _42)))} AS place FROM drawn GROUP BY shard, rank),
firsts AS (SELECT shard, rank, sum(n) OVER (PARTITION BY rank ORDER BY {_modulo("place", f"(SELECT greatest(1, floor(sqrt(n / {mixing.SHARD_SLOTS}))) FROM total)::HUGEINT")}, place, shard) - n AS first FROM counts),
draws AS (SELECT shard, slot, rank, first + row_number() OVER (PARTITION BY shard, rank ORDER BY slot) - 1 AS draw FROM drawn JOIN firsts USING (shard, rank)),
settled AS (SELECT *, sum(over_n) OVER (ORDER BY rank) - over_n AS over_start, sum(under_n) OVER (ORDER BY rank) - under_n AS under_start FROM (
  SELECT plan.*, coalesce(drew, 0) AS drew, greatest(coalesce(drew, 0) - want, 0) AS over_n, greatest(want - coalesce(drew, 0), 0) AS under_n
  FROM plan LEFT JOIN (SELECT rank, count(*) AS drew FROM drawn GROUP BY rank) USING (rank))),
spare AS (SELECT over_start + draw - want AS spot FROM draws JOIN settled USING (rank) WHERE draw >= want),
taken AS (SELECT rank, draw FROM draws JOIN settled USING (rank) WHERE draw < want
  UNION ALL SELECT rank, drew + spot - under_start FROM spare JOIN settled ON spot >= under_start AND spot < under_start + under_n),
keys AS (SELECT rank, step, {_modulo(_signed(_hash_int(_SEED, _hash_int("step::UHUGEINT", _hash_long("rank::UHUGEINT", _42)))), "n_blocks::HUGEINT")} AS key
  FROM plan, (SELECT unnest(range(1, {mixing.ROUNDS + 1})) AS step)),
swapped AS (SELECT rank, n_blocks::HUGEINT AS n, 0 AS step, b AS origin, b::HUGEINT AS x FROM (SELECT rank, n_blocks, unnest(range(0, n_blocks)) AS b FROM plan)
  UNION ALL SELECT p.rank, p.n, k.step, p.origin, {_SWAPPED} FROM swapped p JOIN keys k ON k.rank = p.rank AND k.step = p.step + 1),
times AS (SELECT rank, x AS block, count(*) AS times FROM (SELECT rank, draw % n_blocks AS origin FROM taken JOIN plan USING (rank))
  JOIN (SELECT rank, origin, x FROM swapped WHERE step = {mixing.ROUNDS}) USING (rank, origin) GROUP BY rank, x),
placed AS (SELECT r, doc_id, size, source_size, target, rank,
  sum(size) OVER (PARTITION BY rank ORDER BY {_modulo(_signed("h"), "ceil(n_docs / greatest(256.0, sqrt(n_docs)))::HUGEINT")}, doc_id, {_signed("h")}, r) - size AS start
  FROM d JOIN marks USING (s, seed) JOIN targets ON targets.source IS NOT DISTINCT FROM d.source),
parts AS (SELECT r, rank, block, greatest(block * {mixing.BLOCK}, start) AS low, least((block + 1) * {mixing.BLOCK}, start + size) AS high FROM (
  SELECT r, rank, start, size, unnest(range((start // {mixing.BLOCK})::BIGINT, ((start + size - 1) // {mixing.BLOCK})::BIGINT + 1)) AS block FROM placed WHERE size > 0)),
sums AS (SELECT r, sum((high - low) * times) AS taken FROM parts JOIN times USING (rank, block) GROUP BY r)
SELECT doc_id, size::BIGINT AS size, source_size, target, coalesce(sums.taken, 0)::BIGINT AS taken FROM placed LEFT JOIN sums USING (r)
"""

#: Documents after line dedup with short lines: those of fewer than MIN_WORDS words go if an equal one stands earlier.
LINES_TAKEN_OUT = rf"""
WITH t AS (SELECT *, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, i - 1 AS no, regexp_extract_all(parts[i], '[^\x20\x09-\x0D]+') AS ws FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM t)),
k AS (SELECT doc_id, no, ws, array_to_string(ws, ' ') AS line, doc_id * 10000000 + no AS pos FROM l WHERE len(ws) > 0),
f AS (SELECT line, any_value(ws) AS ws, min(pos) AS pos FROM k GROUP BY line),
long AS (SELECT * FROM f WHERE len(ws) >= {MIN_WORDS}),
v AS (SELECT pos, i, array_to_string(ws[1:i - 1] || ws[i + 1:], ' ') AS key FROM (SELECT pos, ws, unnest(range(1, len(ws) + 1)) AS i FROM long)),
s AS (SELECT key, i, min(pos) AS pos FROM v GROUP BY key, i),
m AS (SELECT key, min(pos) AS pos FROM v GROUP BY key),
lost AS (
  SELECT v.pos FROM v JOIN s USING (key, i) WHERE s.pos < v.pos
  UNION SELECT v.pos FROM v JOIN long ON long.line = v.key WHERE long.pos < v.pos
  UNION SELECT long.pos FROM long JOIN m ON m.key = long.line WHERE m.pos < long.pos
),
gone AS (SELECT k.doc_id, list(k.no) AS places FROM k JOIN f USING (line) WHERE k.pos <> f.pos OR f.pos IN (SELECT pos FROM lost) GROUP BY k.doc_id)
SELECT doc_id, lang, source, CASE WHEN places IS NULL THEN text
  ELSE coalesce(array_to_string([parts[i] FOR i IN range(1, len(parts) + 1) IF NOT list_contains(places, i - 1)], chr(10)), '') END AS text
FROM t LEFT JOIN gone USING (doc_id)
"""


def pipeline_sql(share: float) -> str:
    """The corpus pipeline: each stage's SQL over what the one before kept."""
    on = lambda sql, source: sql.replace("FROM documents", f"FROM {source}")
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+')"
    return f"""
WITH RECURSIVE good AS MATERIALIZED (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM ({QUALITY}) WHERE kept)),
cut AS MATERIALIZED ({on(LINES_TAKEN_OUT, "good")}),
alike AS MATERIALIZED ({on(SIMHASH, "cut")}),
lists AS (SELECT doc_id, {words} AS ws FROM cut),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {jaccard.SHINGLE - 1}], ' ') AS s FROM (
  SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {jaccard.SHINGLE - 1}, 1) + 1)) AS i FROM lists WHERE len(ws) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
alikes AS MATERIALIZED (SELECT u, v FROM pairs JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE pairs.n >= {share} * (x.n + y.n - pairs.n) - 1e-9),
edges AS (SELECT a.component_id AS p, b.component_id AS q FROM alikes JOIN alike a ON a.doc_id = u JOIN alike b ON b.doc_id = v WHERE a.component_id <> b.component_id),
ways AS (SELECT p, q FROM edges UNION SELECT q, p FROM edges),
linked AS (SELECT DISTINCT component_id AS p, component_id AS q FROM alike UNION SELECT linked.p, ways.q FROM linked JOIN ways ON ways.p = linked.q),
roots AS (SELECT p, min(q) AS root FROM linked GROUP BY p),
firsts AS (SELECT min(doc_id) AS doc_id FROM alike JOIN roots ON p = component_id GROUP BY root),
single AS MATERIALIZED (SELECT * FROM cut WHERE doc_id IN (SELECT doc_id FROM firsts)),
clean AS MATERIALIZED (SELECT * FROM single WHERE doc_id NOT IN (SELECT doc_id FROM ({on(CONTAMINATION, "single")}) WHERE contaminated))
SELECT * FROM ({on(MIX, "clean")})
"""


def _clustering_sql(clusters: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> str:
    """Lloyd's rounds with whole numbers, a pair of tables (assignments, centroids) for each."""
    parts = [
        f"""k AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {dims})""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM k ORDER BY h, v LIMIT {clusters}))",
    ]
    for n in range(rounds + 1):
        far = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (k.v[i] - c{n}.v[i]) * (k.v[i] - c{n}.v[i])))"
        parts.append(f"d{n} AS (SELECT k.r, c{n}.c, {far} AS d FROM k, c{n})")
        parts.append(f"a{n} AS (SELECT r, c, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, c) AS place FROM d{n}) WHERE place = 1)")
        parts.append(f"s{n} AS (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT c, v, unnest(range(1, {dims + 1})) AS i FROM a{n} JOIN k USING (r)) GROUP BY c, i)")
        parts.append(f"m{n} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{n} GROUP BY c)")
        parts.append(f"c{n + 1} AS (SELECT c, coalesce(m{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN m{n} USING (c))")
    last = f"a{rounds} JOIN k USING (r) JOIN c{rounds} USING (c)"
    return f"""
WITH {', '.join(parts)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM {last}
"""


#: The scores of all documents that share a term with an item.
RANKED = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_alnum("text")} AS ws FROM documents),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) GROUP BY r, term),
total AS (SELECT count(*) AS n_docs, sum(len(ws)) AS n_terms FROM d WHERE len(ws) > 0),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), total),
q AS (SELECT b, term, count(*) AS times FROM (SELECT row_number() OVER () AS b, unnest({_alnum("text")}) AS term FROM benchmark) GROUP BY b, term),
m AS (SELECT r, doc_id, 25 + CAST(75 * len(ws) * n_docs AS BIGINT) // CAST(n_terms AS BIGINT) AS m FROM d, total WHERE len(ws) > 0),
s AS (SELECT b, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY b, r, doc_id),
best AS (SELECT b, doc_id, score, row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM best JOIN (SELECT row_number() OVER () AS b, item_id FROM benchmark) USING (b) WHERE rank <= 10
"""


_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(0, length({_DIGITS})), lambda i: (ascii(substr({_DIGITS}, length({_DIGITS}) - i, 1)) - 48) * (1 + i % 2) - CASE WHEN i % 2 = 1 AND ascii(substr({_DIGITS}, length({_DIGITS}) - i, 1)) - 48 > 4 THEN 9 ELSE 0 END)) % 10 = 0"
#: Counts of the base kinds of personal data.
PERSONAL = rf"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
  CAST(len(list_filter(regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: list_max(list_transform(string_split(x, '.'), lambda p: coalesce(try_cast(p AS BIGINT), 256))) <= 255)) AS BIGINT) AS n_ip,
  CAST(len(list_filter(regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'), lambda x: length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN})) AS BIGINT) AS n_card,
  CAST(len(list_filter(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length({_DIGITS}) BETWEEN 10 AND 15)) AS BIGINT) AS n_phone
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
"""


ORACLES = {
    "op1_quality_rules": QUALITY,
    "op2_substring_dedup": SUBSTRINGS,
    "op4_warc": ARCHIVES,
    "op6_simhash": SIMHASH,
    "op7_mixing": MIX,
    "op8_line_dedup": LINES,
    "op10_decontamination": CONTAMINATION,
    "op12_centroid_clustering": _clustering_sql(),
    "op13_ranked_search": RANKED,
    "personal_data_counts": PERSONAL,
}
