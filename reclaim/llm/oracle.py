"""DuckDB SQL for the queries of this package that SQL can express, written
from their contracts with plain windows and joins."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]+"
SQL: dict[str, str] = {}

# ------------------------------------------------------------- secret scan
# Written from the contract and the method's description, apart from the module.
_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
_BEFORE = r"""\b(?:(?:[A-Za-z0-9_]*?_)?(?i:{low})|[A-Za-z0-9_]*?[a-z0-9](?:{hump}))"""
_ID = _BEFORE.format(low="user|username|user_name|login|clientid|client_id|accountid|account_id|accesskeyid|accesskey_id|access_keyid|access_key_id",
                     hump="User[Nn]ame|User_[Nn]ame|User|Login|ClientI[Dd]|Client_I[Dd]|AccountI[Dd]|Account_I[Dd]|AccessKeyI[Dd]|AccessKey_I[Dd]|Access_KeyI[Dd]|Access_Key_I[Dd]")
_WEAK = _BEFORE.format(low="pass|pwd|key|auth|credential", hump="Pass|Pwd|Key|Auth|Credential")
_HOST = _BEFORE.format(low="host|server|endpoint", hump="Host|Server|Endpoint")
#: kind, pattern, the group whose length counts, its least length; in the order of the digests.
_SECRETS = [
    ("assign", r"(?i:(password|passwd|secret|token|apikey|api_key)" + _VALUE + r"([A-Za-z0-9+/_.=-]+))", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    # a match is a whole run, so the least length may stand in the pattern
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("id", _ID + _VALUE + r"[A-Za-z0-9._@+-]{3,}", 0, 6),
    ("value", _WEAK + _VALUE + r"[A-Za-z0-9+/_.=-]{6,}", 0, 6),
    ("endpoint", r"(?:\b[A-Za-z][A-Za-z0-9+.-]{1,15}://[A-Za-z0-9._~%:@-]{3,}|" + _HOST + _VALUE + r"[A-Za-z0-9.-]{3,})", 0, 6),
    # a whole run of 40 with nothing of its kind around it, and no = after it
    ("body", r"[A-Za-z0-9/+]{40,}=*", 0, 40),
]


def _matches(n: int) -> str:
    kind, pattern, group, least = _SECRETS[n]
    p = pattern.replace("'", "''")
    value = f"regexp_extract(m, '{p}', {group})" if group else "m"
    whole = " AND length(m) = 40 AND NOT ends_with(m, '=') AND NOT regexp_matches(m, '^(AKIA[A-Z0-9]{16}|[0-9a-f]{40})')" if kind == "body" else ""
    return f"""SELECT doc_id, {n} AS kind, finish - length(m) AS start, finish, m FROM (
  SELECT doc_id, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1),
         lambda i: list_sum(list_transform(gaps[1:i], lambda g: length(g))) + list_sum(list_transform(ms[1:i], lambda x: length(x))))) AS finish
  FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gaps FROM d WHERE regexp_matches(t, '{p}')))
WHERE length({value}) >= {least}{whole}"""


_NAMES = "['assign', 'access', 'hex', 'id', 'value', 'endpoint', 'body']"
_WRITE = f"string_agg({_NAMES}[kind + 1] || ':' || start || ':' || finish, ',' ORDER BY start, kind, finish)"
# identifiers (3) and endpoints (5) need a secret (0, 1, 2, 4, 6) within 200 characters, weak secrets (4) and
# bodies (6) an access key (1), an identifier or an endpoint
SQL["op2_secret_scan"] = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(_matches(n) for n in range(len(_SECRETS)))}),
kept AS (SELECT * FROM s WHERE kind < 3 OR EXISTS (
  SELECT 1 FROM s p WHERE p.doc_id = s.doc_id AND p.start < s.finish + 200 AND p.finish > s.start - 200
    AND CASE WHEN s.kind IN (3, 5) THEN p.kind IN (0, 1, 2, 4, 6) ELSE p.kind IN (1, 3, 5) END)),
per AS (SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE kind = {i}) AS n_{k}" for i, k in enumerate(("assign", "access", "hex")))},
               string_agg({_NAMES}[kind + 1] || ':' || start || ':' || finish, ',' ORDER BY start, kind, finish) FILTER (WHERE kind < 3) AS base,
               {_WRITE} AS spans FROM kept GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in ("assign", "access", "hex"))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per ON per.doc_id = d.doc_id"""

# ------------------------------------------------------------------ mixing
SQL["op5_pareto_mix"] = rf"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('s' || source, 'null') AS g, source, coalesce(CAST(doc_id AS VARCHAR), 'null') AS id,
       md5(coalesce(text, '')) AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
keyed AS (SELECT *, CASE WHEN doc_id IS NULL OR count(*) OVER (PARTITION BY g, id) > 1
       THEN id || ':' || t || ':' || (row_number() OVER (PARTITION BY g, id, t) - 1) ELSE id END AS k FROM d),
by_source AS (SELECT source, g, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source, g),
weighed AS (SELECT *, (row_number() OVER w - 1) % 3 + 1 AS weight, row_number() OVER w AS place FROM by_source
            WINDOW w AS (ORDER BY source IS NULL, source)),
lined AS (SELECT *, row_number() OVER o AS nth,
       sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0) AS left_, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weigh
  FROM weighed WINDOW o AS (ORDER BY source_size / weight, place), b AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stopped AS (SELECT *, weight * left_ > 3 * source_size * weigh AS stops FROM lined),
rest AS (SELECT left_, weigh FROM stopped WHERE NOT stops ORDER BY nth LIMIT 1),
target AS (SELECT s.g, source_size, CASE WHEN stops THEN CAST(3 * source_size AS DOUBLE)
                  ELSE CAST(s.weight * rest.left_ AS DOUBLE) / CAST(rest.weigh AS DOUBLE) END AS target FROM stopped s, rest),
c AS (SELECT *, target - whole * source_size AS words FROM (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM target)),
sizes AS (SELECT *, CAST(floor((1 + mean / (size + mean)) * 1024) AS BIGINT) AS lean FROM (
  SELECT g, size, count(*) AS n, CAST(sum(sum(size)) OVER (PARTITION BY g) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY g) AS mean
  FROM d WHERE size > 0 GROUP BY g, size)),
slopes AS (SELECT g, mean, size, lean, (words - coalesce(sum(size * n) OVER b, 0)) / CAST(sum(lean * size * n) OVER f AS DOUBLE) AS slope
  FROM sizes JOIN c USING (g) WINDOW b AS (PARTITION BY g ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  f AS (PARTITION BY g ORDER BY size ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
slope AS (SELECT g, arg_min(mean, size) AS mean, arg_min(slope, size) AS slope FROM slopes WHERE slope * lean <= 1 GROUP BY g),
drawn AS (SELECT k.doc_id, k.k, k.size, c.*, CASE WHEN k.size > 0 THEN least(1, slope * floor((1 + mean / (k.size + mean)) * 1024)) ELSE 0 END AS p,
       (CAST('0x' || substr(md5(k.k), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM keyed k JOIN c ON c.g = k.g LEFT JOIN slope s ON s.g = k.g),
ranked AS (SELECT *, CASE WHEN p >= 1 THEN 0 WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM drawn),
runs AS (SELECT *, floor(q / (1 + q) * 4096) AS bin, sum(size) OVER (PARTITION BY g ORDER BY floor(q / (1 + q) * 4096), q, k ROWS UNBOUNDED PRECEDING) <= words AS taken
  FROM ranked WHERE q IS NOT NULL),
gaps AS (SELECT c.g, c.words - coalesce(sum(r.size) FILTER (WHERE r.taken), 0) AS gap FROM c LEFT JOIN runs r ON r.g = c.g GROUP BY c.g, c.words),
untaken AS (SELECT r.g, r.k, r.q, r.bin, r.size, gap, length(bin(r.size)) - 1 AS class FROM runs r JOIN gaps ON gaps.g = r.g WHERE NOT taken AND r.size > 0),
fits AS (SELECT *, sum(size) OVER (PARTITION BY g, class ORDER BY bin, q, k ROWS UNBOUNDED PRECEDING) AS upto FROM untaken WHERE size <= gap),
classes AS (SELECT g, class, list(upto) AS uptos, row_number() OVER (PARTITION BY g ORDER BY class DESC) AS nth FROM fits WHERE upto <= gap GROUP BY g, class),
fill AS (SELECT g, CAST(0 AS BIGINT) AS nth, gap, CAST(-1 AS BIGINT) AS class, CAST(0 AS HUGEINT) AS upto FROM gaps UNION ALL
  SELECT g, nth, gap - upto, class, upto FROM (SELECT f.g, l.nth, f.gap, l.class,
    coalesce(list_max(list_filter(l.uptos, lambda x: x <= f.gap)), 0)::HUGEINT AS upto FROM fill f JOIN classes l ON l.g = f.g AND l.nth = f.nth + 1)),
filled AS (SELECT x.g, x.k FROM fits x JOIN fill f ON f.g = x.g AND f.class = x.class AND x.upto <= f.upto),
nearest AS (SELECT g, k FROM (SELECT u.g, u.k, row_number() OVER (PARTITION BY u.g ORDER BY abs(f.gap - u.size), u.bin, u.q, u.k) AS nth
  FROM untaken u JOIN (SELECT g, arg_max(gap, nth) AS gap FROM fill GROUP BY g) f ON f.g = u.g
  WHERE abs(f.gap - u.size) < f.gap AND NOT EXISTS (SELECT 1 FROM filled x WHERE x.g = u.g AND x.k = u.k)) WHERE nth = 1),
chosen AS (SELECT g, k FROM runs WHERE taken UNION ALL SELECT g, k FROM filled UNION ALL SELECT g, k FROM nearest)
SELECT r.doc_id, r.size, r.source_size, r.target, r.whole + (x.k IS NOT NULL)::BIGINT AS n_copies,
       (r.whole + (x.k IS NOT NULL)::BIGINT) * r.size AS taken
FROM ranked r LEFT JOIN chosen x ON x.g = r.g AND x.k = r.k"""

# ------------------------------------------------------------- exact dedup
SQL["op6_block_naming"] = f"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256 FROM n"""

# -------------------------------------------------------------- line dedup
SQL["op10_line_windows"] = f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS x, unnest(range(len(lines))) AS pos FROM d),
c AS (SELECT doc_id, pos, y, row_number() OVER w AS nth, lead(y, 1) OVER w AS y1, lead(y, 2) OVER w AS y2, lead(pos, 2) OVER w AS z
      FROM (SELECT doc_id, pos, trim(regexp_replace(x, '{_SPACE}', ' ', 'g')) AS y FROM l) WHERE y <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT doc_id, pos AS a, z, nth, first_value(doc_id) OVER v AS fd, first_value(nth) OVER v AS fn FROM c WHERE y2 IS NOT NULL
      WINDOW v AS (PARTITION BY y, y1, y2 ORDER BY doc_id, nth)),
gone AS (SELECT DISTINCT l.doc_id, l.pos FROM l JOIN f ON f.doc_id = l.doc_id AND l.pos BETWEEN f.a AND f.z WHERE f.doc_id <> f.fd OR f.nth >= f.fn + 3),
spans AS (SELECT doc_id, string_agg(a || '-' || z, ',' ORDER BY a) AS removed, sum(z - a + 1) AS n FROM (
  SELECT doc_id, min(pos) AS a, max(pos) AS z FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM gone)
  GROUP BY doc_id, island) GROUP BY doc_id),
left_ AS (SELECT l.doc_id, string_agg(x, chr(10) ORDER BY l.pos) AS t FROM l ANTI JOIN gone ON gone.doc_id = l.doc_id AND gone.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, CAST(len(lines) AS INTEGER) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed,
       sha256(coalesce(t, '')) AS text_sha256
FROM d LEFT JOIN spans ON spans.doc_id = d.doc_id LEFT JOIN left_ ON left_.doc_id = d.doc_id"""

# ------------------------------------------------------------------ Merkle
# CRC32 byte by byte over a blob's hex digits, from a table made by its rule; ``tab.t`` holds the table
_TAB = """tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, b: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS t FROM range(256) r(i))"""


def _crc32(text: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * octet_length(encode({text}))::BIGINT, 2),
      lambda i: ('0x' || substr(hex(encode({text})), i, 2))::BIGINT)), lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1])), 4294967295)"""


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


_ROW = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))


def _tree(name: str, leaves: str) -> str:
    """Levels of the trees over ``leaves`` (g, i, n, d), and each node's siblings."""
    run = "PARTITION BY g, lv, i // 3 ORDER BY i"
    return f"""{name} AS (SELECT g, 0 AS lv, i, n, d FROM {leaves} UNION ALL
  SELECT g, lv + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY g, lv, i // 3, n),
{name}_steps AS (SELECT g, lv, i, coalesce(string_agg(d, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(d, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name} WHERE n > 1)"""


SQL["op12_merkle_manifest"] = f"""WITH RECURSIVE {_TAB},
d AS (SELECT *, coalesce('s' || source, 'null') AS g, sha256({_ROW} || {_field("text")}) AS leaf,
  sha256({_ROW} || CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_field("replace(text, chr(10), '')")} ELSE {_field("text")} END) AS other
  FROM documents, tab),
leaves AS (SELECT doc_id, g, leaf AS d, other, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
  count(*) OVER (PARTITION BY g) AS n FROM d),
{_tree("own", "leaves")},
subroots AS (SELECT g AS of, d, '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM own WHERE n = 1),
{_tree("top", "subroots")},
steps AS (SELECT doc_id, x.g, x.i, 0 AS tree, s.lv, l, r FROM leaves x JOIN own_steps s ON s.g = x.g AND s.i = x.i // CAST(3 ** s.lv AS BIGINT)
  UNION ALL SELECT doc_id, x.g, x.i, 1, s.lv, l, r FROM leaves x JOIN subroots u ON u.of = x.g JOIN top_steps s ON s.i = u.i // CAST(3 ** s.lv AS BIGINT)),
paths AS (SELECT g, i, list({{'l': l, 'r': r}} ORDER BY tree, lv) AS path FROM steps GROUP BY g, i),
folded AS (SELECT x.doc_id, x.d AS leaf, u.d AS subroot, (SELECT d FROM top WHERE n = 1) AS root, coalesce(path, []) AS path, other
  FROM leaves x JOIN subroots u ON u.of = x.g LEFT JOIN paths p ON p.g = x.g AND p.i = x.i),
done AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.l || s.r), '')) AS proof_sha256,
  list_reduce(list_prepend({{'l': other, 'r': ''}}, path), lambda a, s: {{'l': sha256(s.l || a.l || s.r), 'r': ''}}).l AS folded_root FROM folded)
SELECT *, folded_root = root AS verified FROM done"""

# -------------------------------------------------------------- resampling
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FEATURES = """list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
  list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"""


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


SQL["op13_importance_resampling"] = f"""WITH {_TAB},
own AS (SELECT doc_id, {_words("text")} AS w FROM documents),
f AS MATERIALIZED (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest({_FEATURES}) AS f FROM own) GROUP BY doc_id, f),
o AS MATERIALIZED (SELECT f, count(*) AS n FROM (SELECT unnest({_FEATURES}) AS f FROM (SELECT {_words("text")} AS w FROM benchmark)) GROUP BY f),
names AS MATERIALIZED (SELECT f, {_crc32("f")} % 10000 AS bucket FROM (SELECT f FROM f UNION SELECT f FROM o), tab),
s AS (SELECT bucket, sum(n) AS n FROM f JOIN names USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM o JOIN names USING (f) GROUP BY bucket),
gain AS MATERIALIZED (SELECT i AS bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
  / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM range(10000) r(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i),
weights AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM f JOIN names USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT own.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || own.doc_id), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM own LEFT JOIN weights ON weights.doc_id = own.doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_words >= 20) OVER () AS many FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * many // 100 THEN place END AS rank FROM placed"""
