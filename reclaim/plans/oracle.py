"""DuckDB SQL for every registered query (the driver's correctness oracle).

The SQL is written independently of the Spark code: directory tests use list
and regex forms over the split path instead of the Spark ``exists`` over
ancestors, retention uses plain windows instead of the two-phase budget, and
version order uses the brand number instead of the padded key.
"""

from __future__ import annotations

from reclaim.plans.derived import SYSTEM_PATHS

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

INV = r"""inv AS (
  SELECT 'h' || CAST(user_id % 4 AS STRING) AS host,
         '/home/u' || CAST(user_id AS STRING) || '/' ||
         CASE event_type WHEN 'error'  THEN '.cache/app'
                         WHEN 'click'  THEN '.local/share/Trash/files'
                         WHEN 'view'   THEN 'proj' || CAST(event_id % 7 AS STRING) || '/build'
                         WHEN 'signup' THEN 'logs'
                         ELSE '.config/my-electron-app/Cache' END || '/' ||
         CASE WHEN event_type = 'view' AND event_id % 5 = 0 THEN 'CMakeCache.txt'
              ELSE 'f' || CAST(event_id AS STRING) ||
                   CASE event_id % 8 WHEN 0 THEN '.log' WHEN 1 THEN '.tmp' WHEN 2 THEN '.temp' WHEN 3 THEN '.swp'
                                     WHEN 4 THEN '~' WHEN 5 THEN '.pyc' WHEN 6 THEN '.vdi' ELSE '.txt' END END AS path,
         'f' AS kind,
         CAST(floor(value * 1048576) AS BIGINT) AS size_bytes,
         ts AS mtime, ts + to_days(CAST(event_id % 5 AS INT)) AS atime, event_id AS id
  FROM events),
inv_p AS (SELECT *, string_split(path, '/') AS parts FROM inv)"""

INV_DIRS = r""",
inv_dirs AS (
  SELECT host, path, 'd' AS kind, max(mtime) AS mtime FROM (
    SELECT host, mtime, array_to_string(parts[1:k], '/') AS path FROM (
      SELECT host, mtime, parts, unnest(generate_series(2, len(parts) - 1)) AS k FROM inv_p))
  GROUP BY host, path),
everything AS (SELECT host, path, kind, mtime FROM inv UNION ALL SELECT host, path, kind, mtime FROM inv_dirs)"""

# Fixed values that must equal the reference's: names and paths in the rules.
# Rule predicates over inv_p (path, parts, kind, size_bytes, mtime, atime).
ANC = "parts[2:len(parts)-1]"
R = {
    "cache": r"regexp_matches(path, '^/home/(.*/)?\.cache/[^./]')",
    "trash": "(regexp_matches(path, '^/home/(.*/)?Trash/[^./]') OR "
             "(starts_with(path, '/root/.local/share/Trash/') AND NOT starts_with(path, '/root/.local/share/Trash/.')))",
    "electron": r"(starts_with(path, '/home/') AND regexp_matches(path, '^.*/\.config/.*electron.*/[^./]'))",
    "python": f"((starts_with(path, '/home/') OR starts_with(path, '/tmp/')) AND (list_has_any({ANC}, ['__pycache__']) "
              "OR (kind = 'd' AND parts[-1] = '__pycache__') OR ends_with(path, '.pyc')))",
    "user_logs": "(starts_with(path, '/home/') AND kind = 'f' AND ends_with(path, '.log') AND size_bytes > 10485760)",
    "home": "((starts_with(path, '/home/') AND kind = 'f' AND (ends_with(path, '.tmp') OR ends_with(path, '.temp') "
            "OR ends_with(path, '.swp') OR ends_with(path, '~'))) OR "
            r"regexp_matches(path, '^/home/[^/.][^/]*/\.cache/thumbnails/[^.]'))",
}
REQUIRES_APPROVAL = {"cache": True, "electron": False, "home": True, "python": False, "trash": True,
                     "user_logs": True}


def first_match_case(names, values=None) -> str:
    values = values or [f"'{n}'" for n in names]
    return "CASE " + " ".join(f"WHEN {R[n]} THEN {v}" for n, v in zip(names, values)) + " END"


def w(body: str, dirs: bool = False) -> str:
    return "WITH " + INV + (INV_DIRS if dirs else "") + "\n" + body


FIVE = ["cache", "electron", "python", "trash", "user_logs"]
SIX = ["cache", "electron", "home", "python", "trash", "user_logs"]


def format_bytes_sql(n: str) -> str:
    units = "KMGTPE"
    parts = [f"WHEN {n} < 1024 THEN CAST({n} AS VARCHAR) || ' B'"]
    for e in range(1, 6):
        parts.append(f"WHEN CAST({n} AS DOUBLE) < pow(1024, {e + 1}) THEN "
                     f"printf('%.1f', round_even(CAST({n} AS DOUBLE) / pow(1024, {e}), 1)) || ' {units[e - 1]}iB'")
    parts.append(f"ELSE printf('%.1f', round_even(CAST({n} AS DOUBLE) / pow(1024, 6), 1)) || ' EiB'")
    return "CASE " + " ".join(parts) + " END"


def _selected_run_sql(selection, approvals, errors=(), names=SIX) -> str:
    """Statuses from the selection, approvals and errors, and per-step bytes of
    the first match among the steps that run (a repeated name finds nothing)."""
    sel = ", ".join(f"({i}, '{n}')" for i, n in enumerate(selection, 1))
    req = ", ".join(f"('{n}', {str(REQUIRES_APPROVAL[n]).lower()})" for n in names)
    ap = ", ".join(f"('{n}', '{a}')" for n, a in approvals) or "(NULL, NULL)"
    er = ", ".join(f"('{n}', '{e}')" for n, e in errors) or "(NULL, NULL)"
    # which steps run is data of the statuses CTE; the first-match CASE lists
    # every step guarded by its own run flag
    cases = []
    seen = set()
    for i, n in enumerate(selection, 1):
        first = n not in seen
        seen.add(n)
        cases.append(f"WHEN {'TRUE' if first else 'FALSE'} AND (SELECT runs FROM st WHERE seq = {i}) AND {R[n]} THEN {i}")
    return f"""sel(seq, name) AS (VALUES {sel}),
req(name, requires_approval) AS (VALUES {req}),
ap(name, ans) AS (VALUES {ap}),
er(name, error) AS (VALUES {er}),
st AS (SELECT CAST(sel.seq AS BIGINT) AS seq, sel.name,
              coalesce(req.requires_approval, false) AND NOT coalesce(lower(ap.ans) = 'y', false) AS skipped,
              er.error,
              NOT (coalesce(req.requires_approval, false) AND NOT coalesce(lower(ap.ans) = 'y', false))
                AND er.error IS NULL AS runs
       FROM sel LEFT JOIN req ON req.name = sel.name LEFT JOIN ap ON ap.name = sel.name
                LEFT JOIN er ON er.name = sel.name),
hits AS (SELECT CASE {' '.join(cases)} END AS seq, size_bytes FROM inv_p),
per AS (SELECT CAST(seq AS BIGINT) AS seq, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes
        FROM hits WHERE seq IS NOT NULL GROUP BY seq)"""


def _budget(keys: str, budget: int, cols: str, time: str = "mtime", tie: str = "id") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    return w(f"""SELECT {cols} FROM (
  SELECT *, sum(size_bytes) OVER ({part}ORDER BY {time} DESC NULLS LAST, {tie} DESC
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM inv)
WHERE run > {budget}""")


SQL: dict[str, str] = {
    "scan_roots": w("SELECT id, host, path, size_bytes FROM inv "
                    "WHERE starts_with(path, '/home/u1/') OR starts_with(path, '/home/u2/')"),
    "listing_csv_first": "SELECT event_id, string_split(concat_ws(',', 'img' || CAST(user_id AS VARCHAR), "
                         "event_type, CAST(event_id AS VARCHAR)), ',')[1] AS image FROM events",
    "listing_ws_field": r"""WITH l AS (SELECT p_partkey, '  ' || replace(p_name, ' ', ';') || '    | ' || p_brand || ' | Installed' AS line FROM part)
SELECT p_partkey, string_split_regex(regexp_replace(line, '^\s+', ''), '\s+')[1] AS package,
       string_split_regex(regexp_replace(line, '^\s+', ''), '\s+')[3] AS version
FROM l WHERE contains(line, 'ring') OR contains(line, 'bolt')""",
    "listing_json_envs": """WITH d AS (SELECT event_id, '{"envs": ["/opt/conda/envs/base", "/opt/conda/envs/' || event_type || '_' || CAST(user_id % 3 AS VARCHAR) || '"]}' AS doc FROM events),
e AS (SELECT event_id, unnest(from_json(doc, '{"envs": ["VARCHAR"]}').envs) AS p FROM d)
SELECT event_id, string_split(p, '/')[-1] AS env FROM e WHERE NOT coalesce(string_split(p, '/')[-1] IN ('base'), false)""",
    "listing_regex_stamps": r"""WITH l AS (SELECT event_id, user_id, '  ' || CAST(event_id AS VARCHAR) || '  >  ' || strftime(ts, '%Y-%m-%d_%H-%M-%S') || '  O  user' AS line FROM events),
s AS (SELECT event_id, user_id, unnest(regexp_extract_all(line, '\s(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})', 1)) AS stamp FROM l)
SELECT event_id, user_id, stamp FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY stamp DESC NULLS LAST, event_id DESC) AS rn FROM s)
WHERE rn > 3""",
    "write_plan_roundtrip": w("SELECT id, 'logs_glob' AS rule, path FROM inv WHERE ends_with(path, '.log')"),
    "filter_kind": w("SELECT host, path, kind, mtime FROM everything WHERE kind = 'd'", dirs=True),
    "filter_name_in": w("SELECT host, path, kind FROM everything "
                        "WHERE string_split(path, '/')[-1] IN ('.cache', 'Trash', 'CMakeCache.txt')", dirs=True),
    "filter_name_globs": w("SELECT id, path FROM inv WHERE ends_with(path, '.tmp') OR ends_with(path, '.temp') "
                           "OR ends_with(path, '.swp') OR ends_with(path, '~')"),
    "filter_path_glob": w("SELECT id, path FROM inv WHERE path LIKE '%/.config/%electron%'"),
    "filter_not_under": w("SELECT id, path FROM inv WHERE NOT starts_with(path, '/home/u1/')"),
    "filter_age_mtime": w(f"SELECT id, mtime FROM inv WHERE mtime <= {AS_OF} - INTERVAL 11 DAY"),
    "filter_age_atime": w(f"SELECT id, atime FROM inv WHERE atime <= {AS_OF} - INTERVAL 11 DAY"),
    "filter_size": w("SELECT id, size_bytes FROM inv WHERE size_bytes > 10 * 1048576"),
    "filter_depth": w("SELECT id, path FROM inv_p WHERE kind = 'f' AND starts_with(path, '/home/') "
                      "AND len(parts) - 2 = 3"),
    "filter_contains_any": "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring') OR contains(p_name, 'bolt')",
    "filter_line_matches": r"SELECT page_id, url FROM pages WHERE regexp_matches(url, '/en/\d+')",
    "retain_by_age": f"SELECT event_id, ts FROM events WHERE ts < {AS_OF} - INTERVAL 3 DAY",
    "retain_day_boundary": f"SELECT event_id, ts FROM events WHERE ts < date_trunc('day', {AS_OF} - INTERVAL 7 DAY)",
    "rule_overlap": w("SELECT id, CAST(len(h) AS BIGINT) AS n_rules, array_to_string(h, ',') AS rules FROM ("
                      "SELECT id, list_filter([" + ", ".join(f"CASE WHEN {R[n]} THEN '{n}' END" for n in SIX)
                      + "], lambda x: x IS NOT NULL) AS h FROM inv_p) WHERE len(h) >= 2"),
    "dir_contents": w("""SELECT dir, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM (
  SELECT size_bytes, array_to_string(parts[1:k], '/') AS dir, parts[k] AS nm FROM (
    SELECT size_bytes, parts, unnest(generate_series(2, len(parts) - 1)) AS k FROM inv_p
    WHERE starts_with(path, '/home/')))
WHERE nm IN ('.cache', 'Trash') GROUP BY dir"""),
    "dir_contents_skip_hidden": w("SELECT id, path FROM inv_p WHERE starts_with(path, '/home/') "
                                  "AND len(parts) >= 4 AND NOT starts_with(parts[4], '.')"),
    "unreferenced": "SELECT doc_id, source FROM documents d WHERE NOT EXISTS "
                    "(SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "reclaim_by_rule": w(f"""SELECT rule, count(*) AS files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM (
  SELECT {first_match_case(FIVE)} AS rule, size_bytes FROM inv_p) WHERE rule IS NOT NULL GROUP BY rule"""),
    "reclaim_rollup": w(f"""SELECT CASE WHEN grouping(rule) = 1 THEN 'Total' ELSE rule END AS rule, count(*) AS files,
       CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM (
  SELECT {first_match_case(FIVE)} AS rule, size_bytes FROM inv_p) WHERE rule IS NOT NULL GROUP BY ROLLUP (rule)"""),
    "capped_share": """WITH mx AS (SELECT o_orderstatus, max(o_totalprice) AS max_price FROM orders GROUP BY o_orderstatus)
SELECT o.o_orderkey, o.o_orderstatus, mx.max_price,
       coalesce(o.o_totalprice / nullif(least(mx.max_price, 400000.0::DOUBLE), 0), 0.0) AS share
FROM orders o LEFT JOIN mx ON mx.o_orderstatus = o.o_orderstatus""",
    "drop_all_but_latest": """SELECT event_id, user_id, ts FROM (
  SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn
  FROM events) WHERE rn > 3""",
    "superseded": """SELECT doc_id, source, lang FROM (
  SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) AS rn FROM documents)
WHERE rn > 1""",
    "before_current": """WITH c AS (SELECT p_type, min(CAST(substr(p_brand, 7) AS INT)) FILTER (WHERE p_brand = 'Brand#17') AS cur
           FROM part GROUP BY p_type)
SELECT p.p_partkey, p.p_type, p.p_brand FROM part p JOIN c ON c.p_type IS NOT DISTINCT FROM p.p_type
WHERE c.cur IS NOT NULL AND CAST(substr(p.p_brand, 7) AS INT) < c.cur""",
    "before_current_no_current": """WITH c AS (SELECT p_type, min(CAST(substr(p_brand, 7) AS INT)) FILTER (WHERE p_brand = 'Brand#99') AS cur
           FROM part GROUP BY p_type)
SELECT p.p_partkey, p.p_type, p.p_brand FROM part p JOIN c ON c.p_type IS NOT DISTINCT FROM p.p_type
WHERE c.cur IS NOT NULL AND CAST(substr(p.p_brand, 7) AS INT) < c.cur""",
    "size_budget": _budget("host", 100 * 1048576, "id, host"),
    "size_budget_global": _budget("", 20_000_000_000, "id"),
    "size_budget_hashed_ids": _budget("host", 100 * 1048576, "id, host", "date_trunc('month', mtime)",
                                      "CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 15) AS BIGINT)"),
    "size_budget_text_ids": _budget("", 20_000_000_000, "id", "date_trunc('month', mtime)", "md5(CAST(id AS VARCHAR))"),
    "freed_between": """SELECT day, n, CAST(greatest(coalesce(n - lag(n) OVER (ORDER BY day), 0), 0) AS BIGINT) AS freed
FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)""",
    "first_match": w(f"SELECT id, rule FROM (SELECT id, {first_match_case(FIVE)} AS rule FROM inv_p) WHERE rule IS NOT NULL"),
    "ordered_catalogue": w(f"""SELECT CAST(row_number() OVER (ORDER BY name) AS BIGINT) AS seq, name, files FROM (
  SELECT rule AS name, count(*) AS files FROM (SELECT {first_match_case(SIX)} AS rule FROM inv_p)
  WHERE rule IS NOT NULL GROUP BY rule)"""),
    "version_order": """SELECT p_brand, row_number() OVER (ORDER BY CAST(substr(p_brand, 7) AS INT)) AS pos
FROM (SELECT DISTINCT p_brand FROM part)""",
    "global_drop_last_n": """SELECT event_id, ts FROM events e WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT event_id FROM events ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 3) k WHERE k.event_id = e.event_id)""",
    "union_steps": w(f"SELECT id, path FROM inv_p WHERE ends_with(path, '.pyc') OR (starts_with(path, '/home/') AND list_has_any({ANC}, ['.cache']))"),
    "format_duration": """SELECT event_id,
       CASE WHEN value < 1 THEN value * 1000 WHEN value < 60 THEN value ELSE value / 60 END AS dur_value,
       CASE WHEN value < 1 THEN 'ms' WHEN value < 60 THEN 's' ELSE 'm' END AS dur_unit FROM events""",
    "base_name": "SELECT page_id, string_split(url, '/')[-1] AS name FROM pages",
    "parent_dir": w("SELECT id, regexp_replace(path, '/[^/]*$', '') AS parent FROM inv"),
    "status_label": """SELECT o_orderkey, CASE WHEN coalesce(o_orderstatus = 'P', false) THEN 'Skipped'
       WHEN o_orderpriority LIKE '1-%' THEN 'Error' ELSE 'Success' END AS status FROM orders""",
    "size_label": f"""SELECT event_id, bytes, CASE WHEN bytes = 0 THEN 'Insignificant' ELSE {format_bytes_sql('bytes')} END AS label
FROM (SELECT event_id, CAST(floor(value) AS BIGINT) AS bytes FROM events)""",
    "text_helpers": """SELECT event_id, trim(string_split(props, ':')[1], '{" ') AS k, trim(string_split(props, ':')[2], ' }') AS v,
       lower(event_type) AS kind, contains(props, '9') AS has9 FROM events""",
    "custom_rule": w("""SELECT 'big_vdi' AS rule, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM inv
WHERE starts_with(path, '/home/') AND ends_with(path, '.vdi') AND size_bytes > 104857600 HAVING count(*) > 0"""),
    "user_logs": w(f"""SELECT 'user_logs' AS rule, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM inv_p
WHERE {R['user_logs']} HAVING count(*) > 0"""),
}

def _with_ctes(extra: str, body: str, dirs: bool = False) -> str:
    return "WITH " + INV + (INV_DIRS if dirs else "") + ",\n" + extra + "\n" + body


SQL["marker_dirs"] = _with_ctes(
    """mk AS (SELECT DISTINCT host, regexp_replace(path, '/[^/]*$', '') AS d FROM inv
           WHERE string_split(path, '/')[-1] = 'CMakeCache.txt' AND string_split(path, '/')[-2] = 'build')""",
    """SELECT id, path, size_bytes FROM inv i
WHERE starts_with(path, '/home/') AND EXISTS (SELECT 1 FROM mk WHERE mk.host = i.host AND starts_with(i.path, mk.d || '/'))""")

SQL["tool_gate"] = _with_ctes(
    f"""ht(host, tool) AS (VALUES ('h0', 'vboxmanage'), ('h1', 'vboxmanage'), ('h1', 'mariadb'), ('h2', 'mysql'), ('h3', 'docker')),
g AS (SELECT host, bool_or(tool = 'vboxmanage') AS has_vbox, bool_or(tool IN ('mysql', 'mariadb')) AS has_db FROM ht GROUP BY host),
hits AS (SELECT i.host, i.size_bytes, CASE
    WHEN starts_with(path, '/home/') AND kind = 'f' AND ends_with(path, '.vdi') AND coalesce(g.has_vbox, false) THEN 'vbox_images'
    WHEN starts_with(path, '/home/') AND kind = 'f' AND ends_with(path, '.log') AND mtime <= {AS_OF} - INTERVAL 11 DAY
         AND coalesce(g.has_db, false) THEN 'db_logs'
    WHEN {R['python']} THEN 'python' END AS rule
  FROM inv_p i LEFT JOIN g ON g.host = i.host)""",
    "SELECT host, rule, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM hits "
    "WHERE rule IS NOT NULL GROUP BY host, rule")

SQL["format_bytes"] = _with_ctes(
    """u AS (SELECT 'inv' AS src, id, size_bytes AS bytes FROM inv
      UNION ALL SELECT 'doc' AS src, doc_id AS id, n_chars AS bytes FROM documents)""",
    f"SELECT src, id, bytes, {format_bytes_sql('bytes')} AS label FROM u")

SQL["select_include"] = _with_ctes(
    _selected_run_sql(["user_logs", "cache", "user_logs", "trash"],
                      [("user_logs", "y"), ("cache", "y"), ("trash", "y")]),
    """SELECT st.seq, st.name,
       CAST(CASE WHEN st.runs THEN coalesce(per.files, 0) ELSE 0 END AS BIGINT) AS files,
       CAST(CASE WHEN st.runs THEN coalesce(per.bytes, 0) ELSE 0 END AS BIGINT) AS bytes
FROM st LEFT JOIN per ON per.seq = st.seq""")

SQL["approval_gate"] = _with_ctes(
    _selected_run_sql(["cache", "trash", "user_logs", "electron", "python"],
                      [("cache", "y"), ("trash", "n"), ("user_logs", "Y")]),
    """SELECT st.seq, st.name, st.skipped,
       CAST(CASE WHEN st.skipped THEN 0 ELSE coalesce(per.files, 0) END AS BIGINT) AS files,
       CAST(CASE WHEN st.skipped THEN 0 ELSE coalesce(per.bytes, 0) END AS BIGINT) AS bytes
FROM st LEFT JOIN per ON per.seq = st.seq""")

SQL["run_report"] = _with_ctes(
    _selected_run_sql(["cache", "trash", "user_logs", "electron"],
                      [("cache", "y"), ("trash", "n"), ("user_logs", "Y")],
                      [("electron", "permission denied")]),
    """SELECT st.seq, st.name,
       CASE WHEN st.skipped THEN 'Skipped' WHEN st.error IS NOT NULL THEN 'Error' ELSE 'Success' END AS status,
       CAST(CASE WHEN st.runs THEN coalesce(per.files, 0) ELSE 0 END AS BIGINT) AS files,
       CAST(CASE WHEN st.runs THEN coalesce(per.bytes, 0) ELSE 0 END AS BIGINT) AS bytes
FROM st LEFT JOIN per ON per.seq = st.seq""")

SQL["select_exclude"] = w(f"""SELECT CAST(s.seq AS BIGINT) AS seq, s.name,
       CAST(coalesce(p.files, 0) AS BIGINT) AS files, CAST(coalesce(p.bytes, 0) AS BIGINT) AS bytes
FROM (SELECT row_number() OVER (ORDER BY name) AS seq, name FROM (VALUES {", ".join(f"('{n}')" for n in SIX)}) c(name)
      WHERE name NOT IN ('home', 'python')) s
LEFT JOIN (SELECT rule, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM (
    SELECT {first_match_case(["cache", "electron", "trash", "user_logs"])} AS rule, size_bytes FROM inv_p)
  WHERE rule IS NOT NULL GROUP BY rule) p ON p.rule = s.name""")


# -- the whole file-tree catalogue ($HOME = /root), in byte order of names ------
def _contents(d: str) -> str:
    return f"(starts_with(path, '{d}/') AND NOT starts_with(path, '{d}/.'))"


def _subtree(d: str) -> str:
    return f"(path = '{d}' OR starts_with(path, '{d}/'))"


def _older(col: str, days: int) -> str:
    return f"{col} <= {AS_OF} - INTERVAL {days + 1} DAY"


# Fixed values that must equal the reference's: names, paths and day counts below.
_AUTOTOOLS = "['autom4te.cache', 'config.status', 'config.log', 'configure~', 'Makefile.in', 'aclocal.m4', '.deps', '.libs']"
R_ALL = {
    "ansible": _contents("/root/.ansible/tmp"),
    "autotools": f"(starts_with(path, '/home/') AND ((kind IN ('d', 'f') AND list_contains({_AUTOTOOLS}, parts[-1])) "
                 f"OR list_has_any({ANC}, {_AUTOTOOLS})))",
    "blender": r"(starts_with(path, '/root/') AND kind = 'f' AND regexp_matches(path, '^.*/blender_.*_autosave\.blend$'))",
    "browser": r"(starts_with(path, '/home/') AND regexp_matches(path, '^(.*/\.cache/google-chrome/Default/Cache|"
               r".*/\.cache/chromium/Default/Cache|.*/\.mozilla/firefox/.*/Cache)/[^./]'))",
    "bun": _contents("/root/.bun/install/cache"),
    "cache": R["cache"],
    "cmake": "(EXISTS (SELECT 1 FROM mk WHERE mk.host = inv_p.host AND (starts_with(inv_p.path, mk.d || '/') "
             "OR (inv_p.path = mk.d AND inv_p.kind = 'd'))) OR (starts_with(path, '/home/') AND "
             f"(list_has_any({ANC}, ['CMakeFiles']) OR (kind = 'd' AND parts[-1] = 'CMakeFiles'))))",
    "containerd": _contents("/var/lib/containerd/io.containerd.snapshotter.v1.overlayfs"),
    "crash": f"({_contents('/var/crash')} OR (starts_with(path, '/var/lib/systemd/coredump/') AND kind = 'f'))",
    "deno": _contents("/root/.cache/deno"),
    "dropbox": _contents("/root/.dropbox/cache"),
    "electron": R["electron"],
    "gradle": _subtree("/root/.gradle/caches"),
    "helm": f"({_contents('/root/.cache/helm')} OR {_contents('/root/.local/share/helm')})",
    "home": R["home"],
    "jetbrains": "((path = '/root/.local/share/JetBrains' OR starts_with(path, '/root/.local/share/JetBrains/')) AND "
                 "(list_has_any(parts[5:len(parts)-1], ['.caches']) OR (kind = 'd' AND parts[-1] = '.caches')))",
    "kdenlive": "(starts_with(path, '/root/') AND kind = 'f' AND regexp_matches(path, '^.*/kdenlive/render/.*$'))",
    "kubectl": f"({_contents('/root/.kube/cache')} OR {_contents('/root/.kube/http-cache')})",
    "libreoffice": r"(starts_with(path, '/home/') AND regexp_matches(path, '^.*/\.config/libreoffice/4/user/uno_packages/cache/[^./]'))",
    "logs": f"(starts_with(path, '/var/log/') AND kind = 'f' AND ends_with(path, '.log') AND {_older('mtime', 30)})",
    "maven": _subtree("/root/.m2/repository"),
    "mercurial": r"((starts_with(path, '/home/') AND kind = 'f' AND regexp_matches(parts[-1], '^.*\.hg.*\.bak$')) OR "
                 + _contents("/root/.hg/bundle-backup") + ")",
    "minikube": _contents("/root/.minikube/cache"),
    "pipenv": _contents("/root/.cache/pipenv"),
    "python": R["python"],
    "rust": f"({_subtree('/root/.cargo/registry')} OR {_subtree('/root/.cargo/git')})",
    "snap": _contents("/var/lib/snapd/cache"),
    "steam": _contents("/root/.steam/steam/steamapps/downloading"),
    "temp": f"((starts_with(path, '/tmp/') OR starts_with(path, '/var/tmp/')) AND kind = 'f' AND {_older('atime', 10)})",
    "terraform": _contents("/root/.terraform.d/plugin-cache"),
    "thunderbird": r"regexp_matches(path, '^/root/\.thunderbird/(.*/)?Cache/[^./]')",
    "trash": R["trash"],
    "user_logs": R["user_logs"],
    "vagrant": _contents("/root/.vagrant.d/boxes"),
    "virtualbox": f"(starts_with(path, '/root/VirtualBox VMs/') AND kind = 'f' AND ends_with(path, '.vdi') AND {_older('mtime', 90)})",
    "wine": "EXISTS (SELECT 1 FROM wd WHERE wd.host = inv_p.host AND (starts_with(inv_p.path, wd.d || '/') "
            "OR (inv_p.path = wd.d AND inv_p.kind = 'd')))",
}

_MK_WD = r"""mk AS (SELECT DISTINCT host, regexp_replace(path, '/[^/]*$', '') AS d FROM inv
           WHERE starts_with(path, '/home/') AND kind = 'f' AND string_split(path, '/')[-1] = 'CMakeCache.txt'
             AND string_split(path, '/')[-2] = 'build'),
wd AS (SELECT host, d FROM (SELECT host, path, kind, mtime, regexp_extract(path, '^(/root/\.wine[^/]*)(/|$)', 1) AS d FROM inv)
       WHERE d <> '' AND (path <> d OR kind = 'd') GROUP BY host, d
       HAVING coalesce(max(mtime) FILTER (WHERE path = d), max(mtime)) <= """ + AS_OF + """ - INTERVAL 91 DAY)"""
_FIRST = "CASE " + " ".join(f"WHEN {R_ALL[n]} THEN '{n}'" for n in sorted(R_ALL)) + " END"
_ROLLUP = """SELECT CASE WHEN grouping(rule) = 1 THEN 'Total' ELSE rule END AS rule, count(*) AS files,
       CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM hits WHERE rule IS NOT NULL GROUP BY ROLLUP (rule)"""

SQL["catalogue_run"] = _with_ctes(
    _MK_WD + f",\nhits AS (SELECT {_FIRST} AS rule, size_bytes FROM inv_p)", _ROLLUP)

# -- the second inventory: the paths of sources.tables, by order key -----------
_N = len(SYSTEM_PATHS)
_SYS = ("SELECT 'h' || CAST((o_orderkey // {n}) % 4 AS VARCHAR) AS host, "
        "replace(list_extract([{paths}], CAST(o_orderkey % {n} AS INT) + 1), '{{id}}', CAST(o_orderkey // {n} AS VARCHAR)) AS path, "
        "list_extract([{kinds}], CAST(o_orderkey % {n} AS INT) + 1) AS kind, o_custkey * 100 AS size_bytes, "
        "CASE WHEN o_custkey % 4 = 0 THEN TIMESTAMP '2024-01-30 00:00:00' ELSE CAST(o_orderdate AS TIMESTAMP) END AS mtime, "
        "CASE WHEN o_custkey % 4 = 0 THEN TIMESTAMP '2024-01-30 00:00:00' ELSE CAST(o_orderdate AS TIMESTAMP) END AS atime, "
        "o_orderkey AS id FROM orders").format(
    n=_N, paths=", ".join(f"'{x}'" for x, _ in SYSTEM_PATHS), kinds=", ".join(f"'{k}'" for _, k in SYSTEM_PATHS))
SQL["catalogue_run_system"] = (f"WITH inv AS ({_SYS}),\ninv_p AS (SELECT *, string_split(path, '/') AS parts FROM inv),\n"
                               + _MK_WD + f",\nhits AS (SELECT {_FIRST} AS rule, size_bytes FROM inv_p)\n" + _ROLLUP)

SQL["unknown_names"] = f"""SELECT min(event_id) AS pos, name FROM (
  SELECT event_id, CASE event_type WHEN 'error' THEN 'cache' WHEN 'click' THEN 'trash' ELSE event_type END AS name FROM events)
WHERE name NOT IN ({", ".join(f"'{n}'" for n in SIX)}) GROUP BY name"""

SQL["union_step_frames"] = w(f"""SELECT DISTINCT host, path FROM (
  SELECT host, path FROM inv WHERE ends_with(path, '.pyc')
  UNION ALL SELECT host, path FROM ({_SYS}) WHERE starts_with(path, '/tmp/') OR starts_with(path, '/root/.local/'))""")

SQL["marker_dirs_with_dirs"] = _with_ctes(
    """mk AS (SELECT DISTINCT host, regexp_replace(path, '/[^/]*$', '') AS d FROM inv
           WHERE string_split(path, '/')[-1] = 'CMakeCache.txt' AND string_split(path, '/')[-2] = 'build')""",
    """SELECT host, path, kind FROM everything i
WHERE EXISTS (SELECT 1 FROM mk WHERE mk.host = i.host AND (starts_with(i.path, mk.d || '/') OR (i.path = mk.d AND i.kind = 'd')))""",
    dirs=True)

SQL["run_report_columns"] = _with_ctes(
    _selected_run_sql(["cache", "trash", "user_logs", "electron"],
                      [("cache", "y"), ("trash", "n"), ("user_logs", "Y")], [("electron", "permission denied")])
    + """,
tm AS (SELECT event_id % 4 + 1 AS seq, count(*) * (event_id % 4 + 1) / 1000.0::DOUBLE AS duration_s FROM events GROUP BY event_id % 4 + 1),
rep AS (SELECT st.seq, st.name, st.skipped, st.error,
               CAST(CASE WHEN st.runs THEN coalesce(per.bytes, 0) ELSE 0 END AS BIGINT) AS bytes,
               coalesce(tm.duration_s, 0.0) AS duration_s
        FROM st LEFT JOIN per ON per.seq = st.seq LEFT JOIN tm ON tm.seq = st.seq),
top AS (SELECT *, max(bytes) OVER () AS max_bytes, max(duration_s) OVER () AS max_duration_s FROM rep)""",
    f"""SELECT seq, name, CASE WHEN skipped THEN 'Skipped' WHEN error IS NOT NULL THEN 'Error during cleanup: ' || error
            ELSE 'Cleanup completed successfully' END AS message, error, duration_s, max_bytes, max_duration_s,
       coalesce(CAST(bytes AS DOUBLE) / nullif(CAST(least(max_bytes, 500000000) AS DOUBLE), 0), 0.0) AS bytes_share,
       coalesce(duration_s / nullif(max_duration_s, 0), 0.0) AS duration_share,
       CASE WHEN bytes = 0 THEN 'Insignificant' ELSE {format_bytes_sql('bytes')} END AS freed FROM top""")


# -- §2.10 listing and log cleaners --------------------------------------------
_LOG = """j AS (SELECT event_id AS id, 'h' || CAST(user_id % 4 AS VARCHAR) AS host, ts,
                  CAST(floor(value * 104857) AS BIGINT) AS size_bytes FROM events),
jr AS (SELECT *, sum(size_bytes) OVER (PARTITION BY host ORDER BY ts DESC NULLS LAST, id DESC
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM j),
jf AS (SELECT *, CASE WHEN run > 104857600 THEN 'journal' WHEN ts < """ + AS_OF + """ - INTERVAL 3 DAY THEN 'logs' END AS rule FROM jr)"""

_LISTED = {
    "kernels": """SELECT p.p_type AS host, 'linux-image-5.4.0-' || CAST(p_size AS VARCHAR) || '-generic' AS item
FROM part p JOIN (SELECT p_type, min(p_partkey) % 60 + 1 AS cur FROM part GROUP BY p_type) c ON c.p_type = p.p_type
WHERE p_size < c.cur AND EXISTS (SELECT 1 FROM part q WHERE q.p_type = p.p_type AND q.p_size = c.cur)""",
    "snap": """SELECT 'h' || CAST(o_custkey % 4 AS VARCHAR) AS host, 'snap' || CAST(o_custkey % 10 AS VARCHAR) AS snap,
       CAST(o_orderkey AS VARCHAR) AS revision
FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL AND o_orderkey IS NOT NULL""",
    "ruby": """SELECT host, gem, version, id FROM (
  SELECT 'h' || CAST(doc_id % 3 AS VARCHAR) AS host, source AS gem,
         CAST(n_chars % 50 AS VARCHAR) || '.' || CAST(doc_id % 7 AS VARCHAR) AS version, doc_id AS id,
         row_number() OVER (PARTITION BY doc_id % 3, source ORDER BY n_chars % 50 DESC, doc_id % 7 DESC, doc_id DESC) AS rn
  FROM documents) WHERE rn > 1""",
    "lxc_images": """SELECT 'h' || CAST(p_partkey % 7 AS VARCHAR) AS host, 'img' || CAST(p_partkey AS VARCHAR) AS image FROM part p
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_suppkey % 7 = p.p_partkey % 7)""",
    "lxc_containers": """SELECT 'h' || CAST(l_suppkey % 7 AS VARCHAR) AS host,
       'c' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS container
FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_returnflag <> 'R' AND r.l_orderkey = l.l_orderkey
  AND r.l_linenumber = l.l_linenumber AND r.l_suppkey % 7 = l.l_suppkey % 7)""",
    "timeshift": """SELECT host, stamp FROM (
  SELECT *, row_number() OVER (PARTITION BY host ORDER BY stamp DESC) AS rn FROM (
    SELECT DISTINCT 'h' || CAST(user_id AS VARCHAR) AS host, strftime(ts, '%Y-%m-%d_%H-%M-%S') AS stamp FROM events))
WHERE rn > 3""",
    "conda": """SELECT 'h' || CAST(user_id % 4 AS VARCHAR) AS host, event_type || '_' || CAST(event_id % 50 AS VARCHAR) AS env, count(*) AS listed
FROM events GROUP BY ALL""",
    "android": """SELECT 'h' || CAST(p_partkey % 4 AS VARCHAR) AS host,
       CASE p_size % 3 WHEN 0 THEN 'system-images;' ELSE 'emulator;' END || replace(p_name, ' ', '-') AS package
FROM part WHERE p_size % 3 IN (0, 1)""",
    "mysql_mariadb": f"SELECT 'h' || CAST(user_id % 4 AS VARCHAR) AS host, event_id AS id FROM events "
                     f"WHERE ts < date_trunc('day', {AS_OF} - INTERVAL 7 DAY)",
    "apt": """SELECT 'h' || CAST(s_suppkey AS VARCHAR) AS host, CASE s_suppkey % 3 WHEN 0 THEN 'nano' ELSE 'vim-tiny' END AS package
FROM supplier WHERE s_suppkey % 3 IN (0, 1)""",
    "unused": """SELECT 'h' || CAST(c_custkey % 4 AS VARCHAR) AS host, 'a' || CAST(c_custkey AS VARCHAR) AS item, c_custkey * 1000 AS size_bytes
FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')""",
}


def _ruled(name: str, rule: str, columns: str = "*") -> str:
    return f"SELECT {columns}, '{rule}' AS rule FROM ({_LISTED[name]})"


SQL["kernels"] = _ruled("kernels", "kernels", "host, item AS package")
SQL["snap_revisions"] = _ruled("snap", "snap")
SQL["ruby_gems"] = _ruled("ruby", "ruby")
SQL["lxc_images"] = _ruled("lxc_images", "lxc_lxd")
SQL["lxc_containers"] = _ruled("lxc_containers", "lxc_lxd")
SQL["timeshift_snapshots"] = _ruled("timeshift", "timeshift")
SQL["conda_envs"] = _ruled("conda", "conda")
SQL["android_packages"] = _ruled("android", "android")
SQL["mysql_binlogs"] = _ruled("mysql_mariadb", "mysql_mariadb")
SQL["apt_packages"] = _ruled("apt", "apt")
SQL["unused_artifacts"] = " UNION ALL ".join(_ruled("unused", r) for r in ["buildah", "docker", "flatpak", "pnpm", "podman"])
SQL["journal"] = f"WITH {_LOG} SELECT rule, id FROM jf WHERE rule IS NOT NULL"
SQL["journal_first_match"] = (f"WITH {_LOG} SELECT CAST(CASE rule WHEN 'journal' THEN 1 ELSE 2 END AS BIGINT) AS seq, rule, host, id, "
                              "size_bytes FROM jf WHERE rule IS NOT NULL")

# Of each rule, the distinct (host, item) of each input with their bytes.
_ITEMS = {
    "android": [("android", "package", "0")], "apt": [("apt", "package", "0")], "conda": [("conda", "env", "0")],
    "kernels": [("kernels", "item", "0")], "ruby": [("ruby", "gem || ' ' || version", "0")],
    "snap": [("snap", "snap || ' ' || revision", "0")], "timeshift": [("timeshift", "stamp", "0")],
    "lxc_lxd": [("lxc_images", "image", "0"), ("lxc_containers", "container", "0")],
    **{r: [("unused", "item", "size_bytes")] for r in ["buildah", "docker", "flatpak", "pnpm", "podman"]},
}
_ALL = sorted({*R_ALL, *_ITEMS, "journal", "logs", "mysql_mariadb"})
_INV1 = INV[:INV.index("inv_p AS")].rstrip().rstrip(",").replace("inv AS (", "inv1 AS (", 1)
SQL["full_run"] = f"""WITH {_INV1},
inv AS (SELECT * FROM inv1 UNION ALL SELECT * FROM ({_SYS})),
inv_p AS (SELECT *, string_split(path, '/') AS parts FROM inv WHERE NOT starts_with(path, '/snap/')),
{_MK_WD}, {_LOG},
hits AS (SELECT {_FIRST} AS rule, size_bytes FROM inv_p
  UNION ALL SELECT rule, size_bytes FROM jf
  UNION ALL SELECT 'mysql_mariadb', CAST(floor(value * 104857) AS BIGINT) FROM events WHERE ts < date_trunc('day', {AS_OF} - INTERVAL 7 DAY)
  """ + "\n  ".join(f"UNION ALL SELECT '{rule}', CAST(b AS BIGINT) FROM (SELECT DISTINCT host, {item} AS item, {size} AS b FROM ({_LISTED[name]}))"
                    for rule, parts in _ITEMS.items() for name, item, size in parts) + f"""),
per AS (SELECT rule, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM hits WHERE rule IS NOT NULL GROUP BY rule)
SELECT CAST(s.seq AS BIGINT) AS seq, s.name, 'Success' AS status, coalesce(per.files, 0) AS files, coalesce(per.bytes, 0) AS bytes
FROM (VALUES {", ".join(f"({i}, '{n}')" for i, n in enumerate(_ALL, 1))}) s(seq, name) LEFT JOIN per ON per.rule = s.name"""

# -- rules that apply to some hosts, stored runs, texts that do not parse, versions ----------
SQL["tool_status"] = """WITH ht AS (SELECT 'h' || CAST(c_custkey % 4 AS VARCHAR) AS host,
  ['vboxmanage', 'docker', 'docker', 'snap', 'mysql', 'vboxmanage', 'mariadb', 'snap'][c_custkey % 4 * 2 + c_custkey // 4 % 2 + 1] AS tool FROM customer),
steps(seq, name, tools) AS (VALUES (1, 'virtualbox', ['vboxmanage']), (2, 'wine', ['wine']), (3, 'docker', ['docker']), (4, 'snap', ['snap']),
  (5, 'mysql_mariadb', ['mysql', 'mariadb']), (6, 'python', []), (7, 'maven', ['mvn']), (8, 'apt', ['apt-get'])),
n AS (SELECT seq, name, count(DISTINCT host) FILTER (len(tools) = 0 OR list_contains(tools, tool)) AS able, count(DISTINCT host) AS hosts
  FROM steps, ht GROUP BY seq, name)
SELECT CAST(seq AS BIGINT) AS seq, name, CASE WHEN able = 0 THEN 'Not installed' ELSE 'Success' END AS status,
  able AS hosts_applicable, hosts - able AS hosts_not_applicable FROM n"""
SQL["run_stored"] = w(f"""SELECT CAST(s.seq AS BIGINT) AS seq, s.name, 'Success' AS status, coalesce(h.files, 0) AS files, coalesce(h.bytes, 0) AS bytes
FROM (VALUES {", ".join(f"({i}, '{n}')" for i, n in enumerate(SIX, 1))}) s(seq, name) LEFT JOIN (
  SELECT rule, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM (SELECT {first_match_case(SIX)} AS rule, size_bytes FROM inv_p)
  WHERE rule IS NOT NULL GROUP BY rule) h ON h.rule = s.name""")
SQL["listing_quarantine"] = """SELECT input, host, reason, count(*) AS texts FROM (
  SELECT 'envs' AS input, 'h' || CAST(user_id % 4 AS VARCHAR) AS host,
         CASE event_id % 10 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'no envs' WHEN 2 THEN 'no text' WHEN 3 THEN 'no text' WHEN 4 THEN 'not JSON' END AS reason FROM events
  UNION ALL SELECT 'snaps', 'h' || CAST(o_custkey % 4 AS VARCHAR),
         CASE o_orderkey % 7 WHEN 0 THEN '2 of 3 fields' WHEN 1 THEN '1 of 3 fields' END FROM orders)
WHERE reason IS NOT NULL GROUP BY ALL"""
SQL["version_order_full"] = """WITH v AS (SELECT DISTINCT p_size % 13 AS a, p_partkey % 3 AS b, p_partkey % 10 AS e FROM part)
SELECT CAST(a AS VARCHAR) || '.' || CAST(b AS VARCHAR) || ['~alpha', '~rc1', '~rc2', '', 'a', 'rc1', '+b1', '-1', '-2', '-10'][e + 1] AS version,
       row_number() OVER (ORDER BY a, b, e) AS pos FROM v"""
SQL["many_rules"] = w(r"""SELECT rule, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM (
  SELECT 'u' || u || e AS rule, size_bytes FROM (SELECT *, regexp_extract(path, '^/home/u([0-9]+)/', 1) AS u, right(path, 4) AS e FROM inv)
  WHERE u <> '' AND TRY_CAST(u AS BIGINT) < 1000 AND kind = 'f' AND e IN ('.log', '.tmp') AND size_bytes > TRY_CAST(u AS BIGINT) * 1000)
GROUP BY rule""")
SQL["dir_contents_labels"] = w(r"""SELECT id, path FROM inv
WHERE regexp_matches(path, '^/home/(.*/)?(proj[^/]|\.l[^/]*|my-[^/]*app|build)/[^./].*$')""")
SQL["select_rules_frame"] = """WITH c AS (SELECT DISTINCT p_brand AS name FROM part)
SELECT mode, seq, name FROM (
  SELECT 'exclude' AS mode, row_number() OVER (ORDER BY name) AS seq, name FROM c WHERE name NOT IN ('Brand#12', 'Brand#21')
  UNION ALL SELECT 'all', row_number() OVER (ORDER BY name), name FROM c
  UNION ALL SELECT 'include', CAST(i AS BIGINT), n FROM (VALUES (1, 'Brand#21'), (2, 'Brand#12'), (3, 'Brand#21')) v(i, n))"""
SQL["approval_gate_frame"] = """WITH c AS (SELECT DISTINCT p_brand AS name, CAST(substr(p_brand, 7) AS INT) AS b FROM part)
SELECT row_number() OVER (ORDER BY name) AS seq, name, b % 2 = 0 AS requires_approval, b % 2 = 0 AND b % 3 <> 0 AS skipped FROM c"""
