"""The registered queries as SQL for DuckDB, written on their own from the definitions."""

from __future__ import annotations

from .fixtures import POINTS
from .queries import NOW

SCANS = """scans AS (
  SELECT user_id AS account_id, date_trunc('day', ts)::TIMESTAMP AS observed_at,
    CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 1 THEN 'inaccessible' ELSE 'ok' END AS status,
    list(DISTINCT regexp_extract(props, '[0-9]+')::BIGINT) AS keys,
    'U_' || user_id AS node_id,
    'user' || user_id || CASE WHEN day(date_trunc('day', ts)) >= 20 THEN 'b' ELSE '' END AS login
  FROM events GROUP BY 1, 2, 5, 6)"""
HISTORY = (
    SCANS
    + """, nexts AS (
  SELECT *, lead(observed_at) OVER (PARTITION BY account_id ORDER BY observed_at) AS next_at,
    max(CASE WHEN status = 'ok' THEN observed_at END) OVER (PARTITION BY account_id) AS verified_at FROM scans),
pairs AS (SELECT account_id, unnest(keys) AS key, observed_at, next_at, verified_at FROM nexts WHERE status = 'ok'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY account_id, key ORDER BY observed_at DESC) AS r FROM pairs),
history AS (
  SELECT account_id, key, min(observed_at) AS first_seen_at, max(observed_at) AS last_seen_at, max(verified_at) AS last_verified_at,
    max(CASE WHEN r = 1 THEN next_at END) AS removed_at, max(CASE WHEN r = 1 THEN next_at END) IS NULL AS present
  FROM ranked GROUP BY 1, 2),
owners AS (
  SELECT account_id, min(observed_at) FILTER (WHERE status = 'ok' AND len(keys) > 0) AS first_seen_at,
    max(observed_at) FILTER (WHERE status = 'ok') AS last_seen_at,
    max_by(login, observed_at) FILTER (WHERE status = 'ok') AS login,
    max_by(node_id, observed_at) FILTER (WHERE status = 'ok') AS node_id,
    max_by(status, observed_at) = 'inaccessible' AS inaccessible
  FROM scans GROUP BY 1 HAVING min(observed_at) FILTER (WHERE status = 'ok' AND len(keys) > 0) IS NOT NULL)"""
)
LOGINS = """logins AS (
  SELECT o_custkey AS account_id, CASE WHEN o_orderkey % 10 = 0 THEN upper(o_orderpriority) ELSE lower(o_orderpriority) END AS login,
    o_orderdate AS observed_at, o_orderkey AS tie FROM orders),
login_history AS (
  SELECT l.account_id, l.login, min(observed_at) AS first_seen_at, max(observed_at) AS last_seen_at,
    lower(l.login) = lower(any_value(b.latest)) AS present
  FROM logins l JOIN (SELECT account_id, max_by(login, (observed_at, tie)) AS latest FROM logins GROUP BY 1) b USING (account_id)
  GROUP BY 1, 2)"""
_POINTS = ", ".join(f"'{p.hex().upper()}'" for p in POINTS)
LINES = f"""seeds AS (
  SELECT c_custkey AS account_id, c_custkey % 1000 AS observed_at, CASE WHEN c_custkey % 13 = 0 THEN c_custkey - 1 ELSE c_custkey END AS seed FROM customer),
bodies AS (
  SELECT *, seed % 12 AS kind, sha256('k' || seed) AS own, sha256('k' || seed) || sha256('l' || seed) AS longer,
    '0000000B' || hex('ssh-ed25519') || '00000020' || sha256('k' || seed) AS edwards FROM seeds),
lines AS (
  SELECT account_id, observed_at,
    CASE WHEN account_id % 55 = 0 OR kind < 4 THEN edwards
      WHEN kind IN (4, 5) THEN '00000007' || hex('ssh-rsa') || '00000003010001' || '0000004200C5' || longer
      WHEN kind = 6 THEN '00000013' || hex('ecdsa-sha2-nistp256') || '00000008' || hex('nistp256') || '00000041' || CASE WHEN seed // 12 % 2 = 0 THEN ([{_POINTS}])[seed // 24 % {len(POINTS)} + 1] ELSE '04' || longer END
      WHEN kind = 7 THEN '00000020' || hex('ssh-ed25519-cert-v01@openssh.com') || '000000016E' || '00000020' || own || '0000000000000007' || '00000001'
        || '00000002' || hex('id') || '00000000' || repeat('0', 32) || repeat('00000000', 3) || '00000001AB' || '00000001CD' ELSE edwards END AS hx,
    CASE kind WHEN 4 THEN 'ssh-rsa' WHEN 5 THEN 'ssh-rsa' WHEN 6 THEN 'ecdsa-sha2-nistp256' WHEN 7 THEN 'ssh-ed25519-cert-v01@openssh.com' ELSE 'ssh-ed25519' END AS type,
    CASE WHEN account_id % 35 = 0 OR account_id % 55 = 0 AND kind = 5 THEN 'invalid base64' WHEN account_id % 55 = 0 THEN 'unknown type' WHEN kind IN (8, 9) OR kind = 6 AND seed // 12 % 2 = 1 THEN 'invalid key body'
      WHEN kind = 10 THEN 'broken framing' WHEN kind = 11 THEN 'more than one key' END AS reason
  FROM bodies),
good_lines AS (SELECT * FROM lines WHERE reason IS NULL),
keys AS (SELECT *, sha256(unhex(hx)) AS fingerprint, 'SHA256:' || rtrim(base64(unhex(sha256(unhex(hx)))), '=') AS text,
  type || ' ' || base64(unhex(hx)) AS canonical FROM good_lines)"""
ATTEMPTS = """attempts AS (
  SELECT event_id AS job_id, user_id AS account_id, ts AS "at", (event_id % 7 + 1)::INT AS attempts,
    (['rate_limit', 'gateway', 'auth', 'timeout', 'shape'])[event_id % 5 + 1] AS kind,
    CASE event_type WHEN 'error' THEN 'retry' WHEN 'purchase' THEN 'running' ELSE 'pending' END AS status,
    (['global', 'tail', 'onboarding', 'priority', 'reconcile', 'anomaly', 'federation'])[event_id % 7 + 1] AS source,
    CASE WHEN event_type = 'error' THEN 'e' || (event_id % 11) END AS error,
    CASE WHEN event_id % 4 = 0 THEN 30 END AS wait_s, event_type, event_id FROM events)"""
TOTALS = """totals AS (SELECT ts AS "at", event_id, user_id % 4 AS run_id, event_id + 1 AS attempted, event_id // 2 AS processed FROM events),
samples AS (SELECT run_id, date_trunc('minute', "at") AS minute, max_by(processed, ("at", processed)) AS processed, max_by(attempted, ("at", processed)) AS attempted
  FROM totals GROUP BY 1, 2)"""
RESULTS = """results AS (
  SELECT year(o_orderdate) AS run_id, o_custkey AS account_id, o_orderkey AS "at",
    CASE WHEN o_orderstatus = 'P' AND o_orderkey % 97 = 0 THEN 'error' WHEN o_orderkey % 89 = 0 THEN 'inaccessible'
      WHEN o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) THEN 'zero' ELSE 'owner' END AS outcome FROM orders)"""
RUNS = """runs AS (
  SELECT year(o_orderdate) AS run_id, count(DISTINCT o_custkey) AS enumerated,
    count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus <> 'P') AS attempted,
    count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'F') AS processed,
    count(*) FILTER (WHERE o_orderkey % 211 = 0) AS repair_jobs, min(o_orderdate) AS started_at,
    max(o_orderkey) % 2 = 0 AS enumeration_complete FROM orders GROUP BY 1)"""
SHARDS = """ranges AS (
  SELECT i % 4 AS run_id, i AS shard, ((SELECT max(o_orderkey) + 1 FROM orders) * i) // 64 AS lower_id,
    ((SELECT max(o_orderkey) + 1 FROM orders) * (i + 1)) // 64 - 1 AS upper_id FROM range(64) t(i)),
shards AS (SELECT *, CASE WHEN shard % 9 = 4 THEN lower_id + (upper_id - lower_id) // 3 ELSE upper_id + 1 END AS next_id,
  CASE WHEN shard % 9 = 4 THEN 'running' ELSE 'completed' END AS status, CASE WHEN shard % 9 = 4 THEN 'e' || shard END AS error, shard / 8.0 AS "at" FROM ranges)"""
REMOTE = """remote AS (SELECT o_orderkey + 1 AS id, o_orderdate::DATE AS day FROM orders),
local AS (SELECT * FROM remote WHERE id - 1 IN (SELECT l_orderkey FROM lineitem)),
parts AS (
  SELECT day, r.n AS remote_count, coalesce(l.n, 0) AS local_count,
    CASE WHEN r.n = coalesce(l.n, 0) AND NOT incomplete THEN 'consistent' WHEN r.n > 12 OR incomplete THEN 'split' ELSE 'repair' END AS state
  FROM (SELECT day, count(*) AS n, bool_or(id % 997 = 0) AS incomplete FROM remote GROUP BY 1) r
  LEFT JOIN (SELECT day, count(*) AS n FROM local GROUP BY 1) l USING (day))"""
BITMAPS = (
    REMOTE
    + """, marks AS (
  SELECT 'discovered' AS mark, id FROM remote UNION ALL SELECT 'successful', id FROM local
  UNION ALL SELECT 'inaccessible', id FROM remote WHERE id NOT IN (SELECT id FROM local) AND id % 5 = 0)"""
)
WEEKS = """weeks AS (
  SELECT user_id AS account_id, date_trunc('week', ts)::TIMESTAMP AS observed_at, max(event_id) % 7 <> 3 AS ok,
    CASE WHEN max(event_id) % 7 = 3 THEN []::VARCHAR[] ELSE list_sort(list(DISTINCT event_type)) END AS keys FROM events GROUP BY 1, 2),
marked AS (SELECT *, coalesce(lag(keys) OVER (PARTITION BY account_id ORDER BY observed_at), []::VARCHAR[]) <> keys AS changed FROM weeks),
groups AS (SELECT *, sum(changed::INT) OVER (PARTITION BY account_id ORDER BY observed_at) AS g FROM marked WHERE ok),
lasts AS (SELECT account_id, g, count(*) AS n, min(observed_at) AS last_changed_at, max(observed_at) AS last_scan_at FROM groups GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY g DESC) = 1),
ladder AS (SELECT account_id, least(n - 1, 4)::INT AS stage, last_changed_at, last_scan_at,
  epoch(last_scan_at)::BIGINT + ([86400, 259200, 604800, 1209600, 2419200])[least(n - 1, 4) + 1] + account_id % 900 AS next_due_at FROM lasts)"""
PROGRESS = """progress AS (
  SELECT l_orderkey AS sample, count(*) AS items, sum(l_linenumber)::BIGINT AS s, l_orderkey * 1000 AS enumerated, l_orderkey * 990 AS attempted,
    l_orderkey * 900 AS processed, count(*) * 17 AS repair_jobs, CASE WHEN l_orderkey % 7 = 0 THEN 0 ELSE sum(l_linenumber)::BIGINT * 5000 END AS remaining_ids,
    CASE WHEN l_orderkey % 6 = 0 THEN sum(l_linenumber)::BIGINT * 10 ELSE 0 END AS repair_ids, sum(l_linenumber)::BIGINT * 4000 AS observed_ids,
    sum(l_linenumber)::BIGINT * 3500 AS observed_users, 190000000 AS lo, 220000000 AS hi, l_orderkey % 5 = 0 AS complete
  FROM lineitem GROUP BY 1)"""


ASKED = """lh AS (SELECT account_id, login, min(observed_at) AS f FROM scans WHERE status = 'ok' GROUP BY 1, 2),
al AS (SELECT account_id, string_agg(login, '+' ORDER BY f, lower(login), login) AS names FROM lh GROUP BY 1),
numbers AS (SELECT DISTINCT regexp_extract(props, '[0-9]+')::BIGINT AS key FROM events),
q AS (SELECT key FROM numbers UNION ALL SELECT key + 1000000 FROM numbers WHERE key % 50 = 0)"""


def _bisected(seconds: str, cap: int) -> str:
    return f"""WITH RECURSIVE sec AS ({seconds}), b AS (SELECT min(second) AS a, max(second) AS z, sum(n)::BIGINT AS n FROM sec),
      t AS (SELECT a AS lo, CASE WHEN z > a THEN floor(log2(z - a))::INT + 1 ELSE 0 END AS k, n FROM b
        UNION ALL
        SELECT h.lo, h.k, (SELECT coalesce(sum(n), 0) FROM sec WHERE second BETWEEN h.lo AND h.lo + (1::BIGINT << h.k) - 1)::BIGINT
        FROM (SELECT lo + j * (1::BIGINT << (k - 1)) AS lo, k - 1 AS k FROM t, range(2) r(j) WHERE n > {cap} AND k > 0) h, b WHERE h.lo <= b.z)
      SELECT t.lo, least(t.lo + (1::BIGINT << t.k) - 1, b.z) AS hi, t.n, t.n > {cap} AS unresolved FROM t, b WHERE t.n <= {cap} OR t.k = 0"""


_ORDER_SECONDS = "SELECT epoch(o_orderdate)::BIGINT AS second, count(*) AS n FROM orders GROUP BY 1"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


ORACLE_SQL: dict[str, str] = {
    "s1_accounts_from_listing": "SELECT c_custkey AS account_id, 'U_' || c_custkey AS node_id, c_name AS login FROM customer WHERE c_nationkey <> 0",
    "s2_scans_from_responses": """SELECT c_custkey % 50 AS batch, c_custkey // 50 AS position, c_custkey AS requested_id, CASE WHEN c_custkey % 17 = 0 THEN 'missing' ELSE 'ok' END AS status,
      CASE WHEN c_custkey % 17 <> 0 THEN c_custkey END AS account_id, CASE WHEN c_custkey % 17 <> 0 THEN 'login' || c_custkey END AS login,
      CASE WHEN c_custkey % 17 <> 0 THEN 1 END AS total, CASE WHEN c_custkey % 17 <> 0 THEN 1 ELSE -1 END AS n_keys FROM customer""",
    "s3_accounts_from_search": "SELECT c_custkey // 100 AS partition, c_custkey AS account_id, (c_nationkey = 0 OR c_custkey <= 0) AS rejected FROM customer",
    "s4_append_new": "SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    "s5_keyed_latest": "SELECT user_id, max(event_id) AS event_id, max_by(event_type, (ts, event_id)) AS name FROM events GROUP BY 1",
    "s6_keyed_max": "SELECT event_type AS name, max(event_id) AS event_id FROM events GROUP BY 1",
    "s7_keyed_sum": "SELECT event_type AS name, user_id, count(*) AS requests, max(event_id) FILTER (WHERE event_id % 3 = 0) AS gauge FROM events GROUP BY 1, 2",
    "s9_users_export": _with(HISTORY) + """SELECT o.account_id, o.login, 'https://example.org/' || o.login AS url, epoch(o.first_seen_at)::BIGINT AS first_seen_at,
      count(h.key) AS n_keys, sum(h.key)::BIGINT AS key_sum, count(*) FILTER (WHERE h.present) AS n_present
      FROM owners o LEFT JOIN history h USING (account_id) GROUP BY 1, 2, 3, 4""",
    "p1_normalize_keys": _with(LINES) + "SELECT account_id, fingerprint, text, type, canonical FROM keys",
    "p2_key_rejects": _with(LINES) + "SELECT account_id, reason FROM lines WHERE reason IS NOT NULL",
    "p3_normalize_fingerprints": _with(LINES) + "SELECT account_id, CASE WHEN account_id % 4 < 3 THEN text END AS normal FROM keys",
    "p4_validate_snapshots": _with(LINES) + """, g AS (
      SELECT account_id // 3 AS batch, count(*) AS n, count(*) FILTER (WHERE reason IS NOT NULL) AS bad, count(DISTINCT CASE WHEN reason IS NULL THEN hx END) AS d, count(*) FILTER (WHERE account_id % 19 IN (0, 1)) AS wrong FROM lines GROUP BY 1)
      SELECT batch, n, CASE WHEN bad > 0 THEN 'malformed key' WHEN wrong > 0 THEN 'fingerprint differs' WHEN d < n THEN 'duplicate key'
        WHEN batch % 14 <> 0 AND batch % 7 = 0 THEN 'total differs on last page'
        WHEN batch % 14 = 0 AND batch % 28 <> 0 THEN 'more pages without cursor or keys' END AS reason FROM g""",
    "p5_normalize_rest_snapshots": _with(LINES) + """, g AS (
      SELECT account_id // 3 AS batch, count(*) AS n, count(*) FILTER (WHERE reason IS NOT NULL) AS bad, count(DISTINCT CASE WHEN reason IS NULL THEN hx END) AS d FROM lines GROUP BY 1)
      SELECT batch, n, CASE WHEN bad > 0 THEN 'malformed key' WHEN d < n THEN 'duplicate key'
        WHEN batch % 14 <> 0 AND batch % 7 = 0 THEN 'total differs on last page'
        WHEN batch % 14 = 0 AND batch % 28 <> 0 THEN 'more pages without cursor or keys' END AS reason FROM g""",
    "p6_check_identity": """SELECT c_custkey AS account_id, CASE WHEN c_custkey % 31 = 0 THEN 'missing' WHEN c_custkey % 23 = 0 OR (c_nationkey > 5 AND c_custkey % 29 = 0) THEN 'mismatch' ELSE 'ok' END AS verdict FROM customer""",
    "p7_classify_actors": """SELECT c_custkey AS account_id, CASE c_custkey % 3 WHEN 0 THEN 'U_' || c_custkey WHEN 1 THEN base64(encode('04:User' || c_custkey)) ELSE 'B_' || c_custkey END AS node_id,
      c_custkey % 2 AS n_keys, c_custkey % 3 < 2 AS is_user FROM customer WHERE c_custkey % 3 < 2 OR c_custkey % 2 > 0""",
    "p8_profile_url": "SELECT c_custkey, 'https://example.org/' || c_name AS url FROM customer",
    "p9_route_failures": _with(ATTEMPTS) + """SELECT kind, attempts, CASE WHEN kind IN ('rate_limit', 'gateway', 'auth') OR attempts < 3 THEN 'retry' ELSE 'fallback' END AS route, count(*) AS n FROM attempts GROUP BY 1, 2, 3""",
    "p10_backoff": _with(ATTEMPTS) + """, d AS (SELECT *, CASE WHEN wait_s > 0 THEN wait_s ELSE least(5 * 2 ** least(attempts - 1, 12), 21600) END::BIGINT AS delay_s FROM attempts)
      SELECT job_id, delay_s, floor(epoch("at"))::BIGINT + delay_s AS next_at FROM d""",
    "p11_schedule_lookup": "SELECT o_orderkey, (CASE WHEN o_orderkey % 7 - 2 <= 0 THEN 60 WHEN o_orderkey % 7 - 2 = 1 THEN 604800 ELSE 3600 END)::BIGINT AS delay_s FROM orders",
    "p12_id_stagger": "SELECT o_orderkey, epoch(o_orderdate)::BIGINT + o_custkey % 900 AS due_s FROM orders",
    "h1_ownership_history": _with(HISTORY) + """SELECT account_id, key, epoch(first_seen_at)::BIGINT AS first_seen_at, epoch(last_seen_at)::BIGINT AS last_seen_at,
      epoch(last_verified_at)::BIGINT AS last_verified_at, epoch(removed_at)::BIGINT AS removed_at, present FROM history""",
    "h2_owners": _with(HISTORY) + "SELECT account_id, epoch(first_seen_at)::BIGINT AS first_seen_at, epoch(last_seen_at)::BIGINT AS last_seen_at, login, node_id, inaccessible FROM owners",
    "h3_login_history": _with(LOGINS) + "SELECT account_id, login, epoch(first_seen_at)::BIGINT AS first_seen_at, epoch(last_seen_at)::BIGINT AS last_seen_at, present FROM login_history",
    "h4_key_dimension": _with(LINES) + "SELECT fingerprint, min(observed_at)::BIGINT AS first_seen_at, any_value(text) AS text, any_value(canonical) AS canonical FROM keys GROUP BY 1",
    "h5_inaccessible_fold": _with(HISTORY) + """SELECT h.account_id, count(*) AS closed FROM history h JOIN scans s ON s.account_id = h.account_id AND s.observed_at = h.removed_at
      WHERE s.status = 'inaccessible' GROUP BY 1""",
    "h6_refresh_ladder": _with(WEEKS) + "SELECT account_id, stage, epoch(last_changed_at)::BIGINT AS last_changed_at, epoch(last_scan_at)::BIGINT AS last_scan_at, next_due_at FROM ladder",
    "h7_zero_key_ladder": """WITH RECURSIVE e AS (
        SELECT user_id AS account_id, floor(epoch(ts))::BIGINT AS t, CASE event_type WHEN 'signup' THEN 'tail' WHEN 'view' THEN 'onboarding' ELSE 'global' END AS source,
          event_type = 'purchase' AND event_id % 29 = 0 AS has, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS r FROM events),
      s(account_id, r, stage, first_at, last_at, due_at, owner) AS (
        SELECT DISTINCT account_id, 0::BIGINT, NULL::INT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, false FROM e
        UNION ALL
        SELECT e.account_id, e.r,
          CASE WHEN owner OR has THEN NULL WHEN source = 'tail' THEN coalesce(stage, 0) WHEN source = 'onboarding' AND stage >= 3 THEN NULL WHEN source = 'onboarding' THEN stage + 1 ELSE stage END,
          CASE WHEN owner OR has OR (source = 'onboarding' AND stage >= 3) THEN NULL WHEN source = 'tail' THEN coalesce(first_at, t) ELSE first_at END,
          CASE WHEN owner OR has OR (source = 'onboarding' AND stage >= 3) THEN NULL WHEN source = 'tail' OR (source = 'onboarding' AND stage IS NOT NULL) THEN t ELSE last_at END,
          CASE WHEN owner OR has OR (source = 'onboarding' AND stage >= 3) THEN NULL WHEN source = 'tail' THEN coalesce(due_at, t + 3600)
            WHEN source = 'onboarding' AND stage IS NOT NULL THEN greatest(first_at + ([3600, 86400, 604800, 2419200])[stage + 2], t + 300) ELSE due_at END,
          owner OR has
        FROM s JOIN e ON e.account_id = s.account_id AND e.r = s.r + 1),
      last AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY r DESC) = 1)
      SELECT account_id, stage, first_at, last_at, due_at FROM last WHERE stage IS NOT NULL""",
    "h8_rolling_rates": _with(TOTALS) + """, w AS (
      SELECT s.run_id, s.minute, s.processed, s.attempted, min_by(p.processed, p.minute) AS p0, min_by(p.attempted, p.minute) AS a0, (epoch(s.minute) - epoch(min(p.minute))) / 3600.0 AS h
      FROM samples s JOIN samples p ON p.run_id = s.run_id AND p.minute BETWEEN s.minute - INTERVAL 6 HOUR AND s.minute GROUP BY 1, 2, 3, 4)
      SELECT run_id, epoch(minute)::BIGINT AS minute, round(CASE WHEN h > 0 THEN (processed - p0) / h ELSE 0 END, 4) AS processed_per_hour,
        round(CASE WHEN h > 0 THEN (attempted - a0) / h ELSE 0 END, 4) AS attempted_per_hour FROM w""",
    "h9_rate_samples": _with(TOTALS) + f"""SELECT run_id, epoch(date_trunc('minute', "at"))::BIGINT AS minute, max_by(processed, ("at", processed)) AS processed, max_by(attempted, ("at", processed)) AS attempted
      FROM totals WHERE "at" > TIMESTAMP '{NOW}' - INTERVAL 7 DAY GROUP BY 1, 2""",
    "h10_page_continuity": """WITH p AS (SELECT o_orderkey // 100 AS page, min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(*) AS n FROM orders GROUP BY 1),
      q AS (SELECT *, page * 100 - 1 AS since, CASE WHEN page % 13 = 5 THEN page * 100 + 60 ELSE 1099511627776 END AS upper, page % 17 = 3 AS rev,
        CASE WHEN page % 50 = 7 THEN page * 100 - 5 WHEN page % 50 <> 9 THEN page * 100 + 99 END AS next_since, CASE WHEN page % 17 = 3 THEN lo ELSE hi END AS last_id FROM p)
      SELECT page // 20 AS shard, page, last_id, coalesce(lag(next_since) OVER (PARTITION BY page // 20 ORDER BY page) = since, true) AS follows, CASE WHEN rev AND n > 1 THEN 'ids do not increase' WHEN last_id >= upper THEN 'complete' WHEN next_since IS NULL THEN 'next cursor missing'
        WHEN next_since <= since OR next_since < last_id THEN 'cursor does not move on' WHEN next_since >= upper THEN 'complete' ELSE 'ok' END AS verdict FROM q""",
    "h11_search_stability": _with(REMOTE) + """, n AS (SELECT day, count(*) AS total FROM remote GROUP BY 1), l AS (SELECT day, count(*) AS c FROM local GROUP BY 1),
      p AS (SELECT r.day, min(total + (id % 301 = 0)::INT) AS low, max(total + (id % 301 = 0)::INT) AS high, count(*) FILTER (WHERE id % 401 = 0) AS inc, count(DISTINCT id) AS ids, count(id) AS items
        FROM remote r JOIN n USING (day) GROUP BY 1),
      v AS (SELECT day, ids, total AS pre_count, coalesce(c, 0) AS post_count, CASE WHEN greatest(total, high) > 1000 THEN 'over the cap' WHEN inc > 0 THEN 'incomplete page' WHEN low <> high THEN 'total changed between pages'
        WHEN items <> ids THEN 'identity twice' WHEN total <> coalesce(c, 0) OR coalesce(c, 0) <> ids THEN 'counts differ' END AS reason FROM n JOIN p USING (day) LEFT JOIN l USING (day))
      SELECT strftime(day, '%Y-%m-%d') AS partition, ids, pre_count, post_count, reason IS NULL AS stable, reason FROM v""",
    "h12_scan_two_pass": """WITH li AS (SELECT l_orderkey AS scan_id, l_suppkey % 2 + 1 AS pass, l_linenumber AS key FROM lineitem),
      e AS (SELECT scan_id, count(DISTINCT key) AS expected FROM li GROUP BY 1),
      p AS (SELECT scan_id, pass, count(*) AS observed, list_sort(list(DISTINCT key)) AS keys FROM li GROUP BY 1, 2),
      v AS (SELECT e.scan_id, CASE WHEN a.scan_id IS NULL OR b.scan_id IS NULL THEN 'pass missing' WHEN a.observed <> len(a.keys) OR a.observed <> expected THEN 'first pass unstable'
        WHEN b.observed <> len(b.keys) OR b.observed <> expected THEN 'second pass unstable' WHEN a.keys <> b.keys THEN 'passes differ' END AS reason, len(b.keys) AS n
        FROM e LEFT JOIN p a ON a.scan_id = e.scan_id AND a.pass = 1 LEFT JOIN p b ON b.scan_id = e.scan_id AND b.pass = 2)
      SELECT scan_id, reason IS NULL AS stable, reason, CASE WHEN reason IS NULL THEN n END AS n_keys FROM v""",
    "h13_id_islands": _with(SHARDS) + """, b AS (SELECT lower_id, upper_id, coalesce(lower_id > max(upper_id) OVER (ORDER BY lower_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, true) AS s FROM shards WHERE status = 'completed'),
      i AS (SELECT *, sum(s::INT) OVER (ORDER BY lower_id) AS island FROM b),
      g AS (SELECT island, min(lower_id) AS lower_id, max(upper_id) AS upper_id, count(*) AS shards FROM i GROUP BY 1)
      SELECT island::BIGINT AS island, lower_id, upper_id, shards, coalesce(lower_id - lag(upper_id) OVER (ORDER BY island) - 1, 0) AS gap_before FROM g""",
    "x1_symmetric_difference": """WITH a AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey % 2 = 0), b AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey % 2 = 1)
      (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "j1_reverse_lookup": _with(HISTORY, ASKED) + """SELECT q.key AS query_id, count(h.account_id) OVER (PARTITION BY q.key) AS n_matches, h.account_id, o.login, h.present, epoch(h.first_seen_at)::BIGINT AS first_seen_at,
      coalesce(names, CASE WHEN h.account_id IS NOT NULL THEN '' END) AS aliases
      FROM q LEFT JOIN history h ON h.key = q.key AND q.key % 23 <> 0 LEFT JOIN owners o ON o.account_id = h.account_id LEFT JOIN al ON al.account_id = h.account_id""",
    "j1_lookup_lists": _with(HISTORY, ASKED) + """SELECT q.key AS query_id, count(h.account_id) AS n_matches, coalesce(string_agg(o.login || ':' || h.present || ':' || coalesce(names, ''), ',' ORDER BY NOT h.present, lower(o.login), h.account_id), '') AS matches
      FROM q LEFT JOIN history h ON h.key = q.key AND q.key % 23 <> 0 LEFT JOIN owners o ON o.account_id = h.account_id LEFT JOIN al ON al.account_id = h.account_id GROUP BY 1""",
    "j2_shared_keys": _with(HISTORY) + "SELECT key, count(*) AS accounts_ever, count(*) FILTER (WHERE present) AS accounts_now, epoch(min(first_seen_at))::BIGINT AS first_seen_at FROM history GROUP BY 1 HAVING count(*) > 1",
    "j3_alias_attach": _with(LOGINS) + "SELECT account_id, string_agg(login, ',' ORDER BY first_seen_at, lower(login), login) AS aliases FROM login_history GROUP BY 1",
    "j4_select_owner_results": _with(HISTORY) + """SELECT account_id, account_id || '-' || strftime(observed_at, '%Y%m%d') AS scan_id, CASE WHEN status = 'ok' THEN len(keys) ELSE 0 END AS n_keys FROM scans
      WHERE (status = 'ok' AND len(keys) > 0) OR account_id IN (SELECT account_id FROM owners WHERE account_id % 2 = 0)""",
    "j5_due_not_inflight": _with(WEEKS) + """SELECT account_id, next_due_at AS due_at FROM ladder WHERE account_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND user_id % 3 = 0)
      ORDER BY due_at, account_id LIMIT 50""",
    "j6_calendar_gaps": _with(REMOTE) + """, s AS (SELECT day, count(*) AS n FROM local GROUP BY 1 HAVING count(*) > 1), r AS (SELECT DISTINCT day FROM remote), j AS (SELECT r.day, n FROM r LEFT JOIN s USING (day))
      SELECT count(*) AS days, count(n) AS complete, sum(n)::BIGINT AS total, strftime(min(day) FILTER (WHERE n IS NULL), '%Y-%m-%d') AS first_missing,
        strftime(coalesce(min(day) FILTER (WHERE n IS NULL), max(day) + 1), '%Y-%m-%d') AS next_day FROM j""",
    "j7_stage_partition": _with(REMOTE) + "SELECT strftime(day, '%Y-%m-%d') AS day, id FROM remote WHERE id NOT IN (SELECT id FROM local)",
    "j8_partition_resolution": _with(REMOTE) + """SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS ids, count(*) FILTER (WHERE id NOT IN (SELECT id FROM local)) AS unresolved,
      bool_and(id IN (SELECT id FROM local)) AS resolved FROM remote GROUP BY 1""",
    "j7_time_partitions": f"""WITH leaves AS ({_bisected(_ORDER_SECONDS, 40)}) SELECT lo, hi, o_orderkey + 1 AS id
      FROM orders JOIN leaves ON epoch(o_orderdate)::BIGINT BETWEEN lo AND hi WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
    "j8_time_resolution": f"""WITH leaves AS ({_bisected(_ORDER_SECONDS, 40)}), r AS (SELECT lo, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS good
      FROM orders JOIN leaves ON epoch(o_orderdate)::BIGINT BETWEEN lo AND hi) SELECT lo, count(*) AS ids, count(*) FILTER (WHERE NOT good) AS unresolved, bool_and(good) AS resolved FROM r GROUP BY lo""",
    "j9_run_generation": "SELECT year(o_orderdate) AS run_id, (CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 ELSE year(o_orderdate) * 10 END)::BIGINT AS generation_id, count(*) AS n FROM orders GROUP BY 1, 2",
    "a1_coverage_bitmap": _with(BITMAPS) + "SELECT mark, count(DISTINCT id) AS n FROM marks GROUP BY 1",
    "a1_merge_bitmaps": _with(REMOTE) + "SELECT 'discovered' AS mark, count(DISTINCT id) AS n FROM remote",
    "a2_missing_ids": _with(REMOTE) + "SELECT DISTINCT id FROM remote WHERE id NOT IN (SELECT id FROM local) AND id % 5 <> 0",
    "a2_missing_containers": _with(REMOTE) + "SELECT DISTINCT id FROM remote WHERE id NOT IN (SELECT id FROM local) AND id % 5 <> 0",
    "j7_stage_containers": _with(REMOTE) + "SELECT DISTINCT id, id IN (SELECT id FROM local) AS resolved FROM remote",
    "a2_coverage_summary": _with(BITMAPS) + """, c AS (SELECT count(DISTINCT id) FILTER (WHERE mark = 'discovered') AS discovered, count(DISTINCT id) FILTER (WHERE mark = 'successful') AS successful,
      count(DISTINCT id) FILTER (WHERE mark = 'inaccessible') AS inaccessible FROM marks) SELECT *, greatest(discovered - successful - inaccessible, 0) AS missing FROM c""",
    "a3_coverage_by_day": _with(REMOTE) + "SELECT strftime(day, '%Y-%m-%d') AS day, count(DISTINCT id) AS n, false AS error FROM local GROUP BY 1",
    "a4_run_counters": _with(RESULTS) + """, l AS (SELECT run_id, account_id, max_by(outcome, "at") AS outcome FROM results GROUP BY 1, 2)
      SELECT run_id, count(*) AS processed, count(*) FILTER (WHERE outcome = 'zero') AS zero, count(*) FILTER (WHERE outcome = 'owner') AS owner,
        count(*) FILTER (WHERE outcome = 'inaccessible') AS inaccessible, count(*) FILTER (WHERE outcome = 'error') AS error FROM l GROUP BY 1""",
    "a5_first_attempts": _with(RESULTS, RUNS) + """SELECT run_id, enumerated - 5 AS enumerated, least(enumerated - 5, count(DISTINCT account_id)) AS attempted, min("at") AS first_at FROM runs JOIN results USING (run_id) GROUP BY run_id, enumerated""",
    "a6_queue_breakdown": _with(ATTEMPTS) + "SELECT source, status, count(*) AS n FROM attempts GROUP BY 1, 2",
    "a7_job_health": _with(ATTEMPTS) + """SELECT count(*) FILTER (WHERE status = 'retry') AS retrying, count(*) FILTER (WHERE status = 'running') AS running, max(attempts) AS max_attempts,
      floor(epoch(min("at")))::BIGINT AS oldest_at, max_by(error, ("at", error)) FILTER (WHERE error IS NOT NULL) AS latest_error FROM attempts""",
    "a8_capped_count": "SELECT least(count(*), 1000) AS n, count(*) > 1000 AS capped, floor(epoch(min(ts)))::BIGINT AS oldest FROM events",
    "a9_partition_rollup": _with(REMOTE) + """, c AS (SELECT count(*) FILTER (WHERE state = 'consistent') AS consistent, count(*) FILTER (WHERE state = 'repair') AS repairing, 0 AS unresolved, 0 AS pending,
      sum(remote_count - local_count)::BIGINT AS missing FROM parts) SELECT *, repairing = 0 AS done, CASE WHEN repairing > 0 THEN 'active' ELSE 'count_reconciled' END AS final FROM c""",
    "a10_range_progress": _with(SHARDS) + """, r AS (SELECT run_id, sum(least(next_id, upper_id + 1) - lower_id)::BIGINT AS processed, sum(upper_id - lower_id + 1)::BIGINT AS total,
      coalesce(min(CASE WHEN next_id <= upper_id THEN next_id END) - 1, max(upper_id)) AS checkpoint, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'running') AS running,
      max_by(error, "at") FILTER (WHERE error IS NOT NULL) AS last_error, max("at")::DOUBLE AS hours FROM shards GROUP BY 1)
      SELECT *, total - processed AS remaining, round(100.0 * processed / total, 4)::DOUBLE AS percent, round(CASE WHEN hours > 0 THEN processed / hours END, 4)::DOUBLE AS ids_per_hour,
        round(CASE WHEN hours > 0 THEN (total - processed) / (processed / hours) END, 4)::DOUBLE AS remaining_hours, hours < 1 AS preliminary FROM r""",
    "a11_worker_rollup": """WITH w AS (SELECT event_type AS name, user_id % 3 AS role, count(*) AS users, min(ts) AS started_at, max(ts) AS last_success_at FROM events GROUP BY 1, 2),
      r AS (SELECT role, count(*) FILTER (WHERE name <> 'view' AND floor(epoch(TIMESTAMP '2024-01-31 00:00:00')) - floor(epoch(last_success_at)) <= 600) AS active,
        count(*) FILTER (WHERE name <> 'view' AND floor(epoch(TIMESTAMP '2024-01-31 00:00:00')) - floor(epoch(last_success_at)) > 600) AS stale,
        sum(users)::BIGINT AS users, sum(users)::BIGINT AS requests, floor(epoch(min(started_at)))::BIGINT AS started_at, floor(epoch(max(last_success_at)))::BIGINT AS last_success_at FROM w GROUP BY 1)
      SELECT *, round(CASE WHEN last_success_at > started_at THEN users / ((last_success_at - started_at) / 3600.0) ELSE 0 END, 4)::DOUBLE AS users_per_hour FROM r""",
    "a12_run_completion": _with(RESULTS, RUNS) + """SELECT run_id, enumerated AS processed FROM runs WHERE run_id % 2 = 0 AND run_id NOT IN (SELECT run_id FROM results WHERE outcome = 'error' AND account_id % 7 = 0)""",
    "a13_index_totals": _with(HISTORY) + "SELECT (SELECT count(*) FROM owners) AS owners, count(DISTINCT key) AS keys, count(*) AS associations, count(*) FILTER (WHERE present) AS current_associations FROM history",
    "a14_anomaly_ledger": _with(ATTEMPTS) + """, ok AS (SELECT account_id, max("at") AS ok_at FROM attempts WHERE event_type = 'purchase' GROUP BY 1),
      f AS (SELECT a.* FROM attempts a LEFT JOIN ok USING (account_id) WHERE event_type = 'error' AND (ok_at IS NULL OR "at" > ok_at))
      SELECT account_id, max_by(kind, ("at", job_id)) AS kind, sum(attempts)::BIGINT AS attempts, floor(epoch(min("at")))::BIGINT AS first_seen_at, floor(epoch(max("at")))::BIGINT AS last_seen_at,
        max_by(error, ("at", job_id)) AS last_error, floor(epoch(max("at")))::BIGINT + 21600 AS next_attempt_at FROM f GROUP BY 1""",
    "a15_stall_check": _with(ATTEMPTS) + f"""SELECT source AS role, count(*) FILTER (WHERE "at" <= TIMESTAMP '{NOW}') AS due, floor(epoch(max("at") FILTER (WHERE event_type = 'purchase')))::BIGINT AS last_success_at,
      count(*) FILTER (WHERE "at" <= TIMESTAMP '{NOW}') > 0 AND coalesce(epoch(TIMESTAMP '{NOW}') - floor(epoch(max("at") FILTER (WHERE event_type = 'purchase'))) > 600, true) AS stalled FROM attempts GROUP BY 1""",
    "a16_backlog": _with(RUNS) + "SELECT run_id, greatest(0, enumerated - attempted) AS unattempted, greatest(0, enumerated - processed) AS unsettled FROM runs",
    "a16_class_depth": _with(ATTEMPTS) + "SELECT CASE WHEN source IN ('tail', 'onboarding') THEN 'live' WHEN source = 'priority' THEN 'owner' ELSE 'global' END AS class, count(*) AS depth FROM attempts GROUP BY 1",
    "t1_day_partitions": """WITH b AS (SELECT min(o_orderdate) AS a, max(o_orderdate) + INTERVAL 6 HOUR AS c FROM orders), d AS (SELECT unnest(generate_series(a, c, INTERVAL 1 DAY)) AS s, c FROM b)
      SELECT epoch(s)::BIGINT AS start_at, epoch(least(s + INTERVAL 86399 SECOND, c))::BIGINT AS end_at FROM d""",
    "t2_bisect_partitions": _bisected("SELECT floor(epoch(ts))::BIGINT AS second, count(*) AS n FROM events GROUP BY 1", 100),
    "t2_bisect_unresolved": _bisected("SELECT epoch(o_orderdate)::BIGINT AS second, count(*) AS n FROM orders GROUP BY 1", 5),
    "t3_reconcile_counts": _with(REMOTE) + """SELECT strftime(day, '%Y-%m-%d') AS day, remote_count, local_count, state,
      state = 'consistent' AND ('0x' || substr(md5(strftime(day, '%Y-%m-%d')), 1, 8))::BIGINT % 100 < 1 AS sampled FROM parts""",
    "t4_id_ranges": """WITH b AS (SELECT min(o_orderkey) AS a, max(o_orderkey) - min(o_orderkey) + 1 AS total FROM orders),
      r AS (SELECT i AS range, a + (total * i) // 64 AS lower_id, a + (total * (i + 1)) // 64 - 1 AS upper_id FROM range(64) t(i), b)
      SELECT range, lower_id, upper_id, count(o_orderkey) AS orders FROM r LEFT JOIN orders ON o_orderkey BETWEEN lower_id AND upper_id GROUP BY 1, 2, 3""",
    "t5_range_density": """WITH b AS (SELECT min(l_orderkey) AS a, max(l_orderkey) - min(l_orderkey) + 1 AS total FROM lineitem),
      r AS (SELECT i AS range, a + (total * i) // 64 AS lower_id, a + (total * (i + 1)) // 64 - 1 AS upper_id FROM range(64) t(i), b),
      u AS (SELECT range, lower_id, upper_id, count(id) AS users FROM r LEFT JOIN (SELECT DISTINCT l_orderkey AS id FROM lineitem) ON id BETWEEN lower_id AND upper_id GROUP BY 1, 2, 3)
      SELECT *, round(users / (upper_id - lower_id + 1), 6)::DOUBLE AS density, ceil(1000 * least(1.0, greatest(0.0, users / (upper_id - lower_id + 1)::DOUBLE)))::BIGINT AS expected FROM u""",
    "t5_shard_density": _with(SHARDS) + """, r AS (SELECT run_id, lower_id, CASE WHEN status = 'running' THEN next_id - 1 ELSE upper_id END AS upper_id FROM shards
        UNION ALL SELECT run_id, next_id, upper_id FROM shards WHERE status = 'running' UNION ALL SELECT run_id, min(lower_id), max(upper_id) FROM shards GROUP BY 1),
      ids AS (SELECT DISTINCT l_orderkey AS id FROM lineitem)
      SELECT run_id, lower_id, upper_id, count(id) AS users, round(count(id) / (upper_id - lower_id + 1), 6)::DOUBLE AS density
      FROM r LEFT JOIN ids ON id BETWEEN lower_id AND upper_id WHERE lower_id <= upper_id GROUP BY 1, 2, 3""",
    "t6_pass_plan": _with(SHARDS) + "SELECT 'tail' AS kind, (max(upper_id) + 1)::BIGINT AS lower_id, 10000000::BIGINT AS upper_id FROM shards",
    "t6_run_kind": _with(RUNS) + f"""SELECT run_id, CASE WHEN enumeration_complete THEN 'global' ELSE 'initial' END AS kind, CASE WHEN enumeration_complete THEN processed END AS cutoff_id,
      CASE WHEN enumeration_complete THEN epoch(TIMESTAMP '{NOW}')::BIGINT - 172800 END AS settled_cutoff FROM runs""",
    "t7_forecast": _with(PROGRESS) + """, b AS (SELECT *, CASE WHEN complete THEN 'exact' WHEN repair_ids > 0 THEN 'replay' WHEN remaining_ids > 0 THEN 'density' ELSE 'envelope' END AS basis,
        greatest(0, enumerated - processed) AS backlog, CASE WHEN sample % 3 = 0 THEN 100.0 ELSE 1000.0 END AS per_list,
        CASE WHEN sample % 4 = 0 THEN least(9400 * 0.8::DOUBLE * 100, items * 20000.0) ELSE 9400 * 0.8::DOUBLE * 100 END AS cap FROM progress WHERE sample % 11 <> 0),
      f AS (SELECT *, greatest(0, backlog - repair_jobs) AS plain, CASE basis WHEN 'exact' THEN 0 WHEN 'density' THEN ceil(remaining_ids * (observed_users::DOUBLE / observed_ids))::BIGINT ELSE greatest(0, lo - enumerated) END AS fl FROM b),
      g AS (SELECT *, CASE basis WHEN 'exact' THEN 0 WHEN 'density' THEN remaining_ids ELSE greatest(fl, hi - enumerated) END AS fh, remaining_ids / per_list AS lists FROM f),
      h AS (SELECT *, greatest(lists / (9400 * 0.95::DOUBLE), (plain + fl) / cap) AS sl, greatest(lists * 1.1::DOUBLE / (9400 * 0.95::DOUBLE), (plain + fh) * 1.1::DOUBLE / cap) AS sh,
        lists / 9400 AS rl, (repair_jobs * 0.01::DOUBLE + lists + fh * 0.005::DOUBLE * 0.01::DOUBLE) * 1.1::DOUBLE / 9400 AS rh,
        (plain / 100.0 + repair_jobs / 100.0 + fl / 100.0 + fl * 0.001::DOUBLE / 100) / 9400 AS kl, (plain / 100.0 + repair_jobs / 100.0 + fh / 100.0 + fh * 0.005::DOUBLE / 100) * 1.1::DOUBLE / 9400 AS kh FROM g),
      z AS (SELECT *, greatest(sl, rl, kl) AS hl, greatest(sh, rh, kh) AS hh FROM h)
      SELECT sample, basis, CASE basis WHEN 'exact' THEN attempted < 1000000 WHEN 'density' THEN attempted < 1000000 OR observed_ids < 1000000 ELSE true END AS preliminary,
        fl::BIGINT AS future_low, fh::BIGINT AS future_high, (backlog + fl)::BIGINT AS remaining_low, (backlog + fh)::BIGINT AS remaining_high,
        round(sl, 6)::DOUBLE AS scan_hours_low, round(sh, 6)::DOUBLE AS scan_hours_high, round(hl, 6)::DOUBLE AS hours_low, round(hh, 6)::DOUBLE AS hours_high,
        round(CASE WHEN hl > 0 THEN (backlog + fl) / hl ELSE 0 END, 6)::DOUBLE AS users_per_hour FROM z""",
    "t8_fallback_forecast": _with(PROGRESS) + """, r AS (SELECT *, CASE WHEN sample % 2 = 0 THEN items * 100.0 WHEN sample % 3 = 0 THEN 50.0 WHEN sample % 5 = 0 THEN 10.0 END AS rate,
        CASE WHEN sample % 2 = 0 THEN 'one_hour' WHEN sample % 3 = 0 THEN 'six_hours' WHEN sample % 5 = 0 THEN 'session' END AS rate_basis,
        CASE WHEN complete AND enumerated > 0 THEN 'exact' WHEN remaining_ids > 0 THEN 'density' ELSE 'envelope' END AS basis,
        ceil(remaining_ids * (observed_users::DOUBLE / observed_ids))::BIGINT AS fut, greatest(0, enumerated - processed) AS backlog FROM progress),
      v AS (SELECT *, CASE basis WHEN 'exact' THEN enumerated WHEN 'density' THEN enumerated + fut ELSE lo END AS total_low, CASE basis WHEN 'exact' THEN enumerated WHEN 'density' THEN enumerated + remaining_ids ELSE hi END AS total_high,
        CASE basis WHEN 'exact' THEN backlog WHEN 'density' THEN backlog + fut ELSE greatest(0, lo - processed) END AS remaining_low,
        CASE basis WHEN 'exact' THEN backlog WHEN 'density' THEN backlog + remaining_ids ELSE greatest(0, hi - processed) END AS remaining_high FROM r WHERE rate IS NOT NULL)
      SELECT sample, rate_basis, basis, total_low::BIGINT AS total_low, total_high::BIGINT AS total_high, remaining_low::BIGINT AS remaining_low, remaining_high::BIGINT AS remaining_high,
        round(CASE WHEN basis = 'density' THEN greatest(remaining_low / rate, fut / 250.0) ELSE remaining_low / rate END, 6)::DOUBLE AS hours_low,
        round(CASE WHEN basis = 'density' THEN greatest(remaining_high / rate, remaining_ids / 250.0) ELSE remaining_high / rate END, 6)::DOUBLE AS hours_high FROM v""",
    "t9_stage_label": _with(RUNS) + """SELECT run_id, CASE WHEN enumeration_complete AND enumerated <= processed THEN 'complete' WHEN NOT enumeration_complete AND repair_jobs > 0 THEN 'discovery_and_resource_repair'
      WHEN enumerated > attempted THEN 'graphql_indexing' WHEN enumerated > processed THEN 'resource_repair_drain' ELSE 'enumerating' END AS stage FROM runs""",
    "t10_recovery_label": _with(ATTEMPTS) + """SELECT account_id, CASE WHEN count(*) FILTER (WHERE status = 'running') % 4 = 0 THEN 'offline' WHEN count(*) FILTER (WHERE attempts > 6) % 3 > 0 THEN 'stalled'
      WHEN count(*) FILTER (WHERE status = 'retry') % 2 > 0 THEN 'recovering' ELSE 'healthy' END AS label FROM attempts GROUP BY 1""",
    "t11_audit_verdict": _with(REMOTE) + """SELECT strftime(day, '%Y-%m-%d') AS day, CASE WHEN state <> 'split' THEN greatest(remote_count - local_count, 0) END AS gap,
      CASE WHEN state = 'split' THEN 'measuring' WHEN day(day) <= 3 THEN 'initial in progress' WHEN remote_count > local_count THEN 'gap detected' ELSE 'consistent' END AS verdict FROM parts""",
    "l1_keyset_page": _with(HISTORY) + f""", n AS (SELECT account_id, login, first_seen_at FROM owners WHERE account_id > 20 AND first_seen_at <= TIMESTAMP '{NOW}' ORDER BY account_id LIMIT 26),
      p AS (SELECT * FROM n ORDER BY account_id LIMIT 25)
      SELECT account_id, login, epoch(first_seen_at)::BIGINT AS first_seen_at, (SELECT count(*) FROM n) > 25 AS has_more, CASE WHEN (SELECT count(*) FROM n) > 25 THEN (SELECT max(account_id) FROM p) END AS next_after FROM p""",
    "l2_batch_plan": _with(ATTEMPTS) + f"""SELECT job_id, source, status FROM attempts WHERE status IN ('retry', 'pending') AND "at" <= TIMESTAMP '{NOW}'
      ORDER BY status = 'pending', list_position(['anomaly', 'federation', 'tail', 'onboarding', 'reconcile', 'global', 'priority'], source), "at", job_id LIMIT 200""",
    "l3_batch_plan_weighted": _with(ATTEMPTS) + f""", ready AS (
        SELECT *, CASE WHEN source IN ('tail', 'onboarding') THEN 'live' WHEN source = 'priority' THEN 'owner' ELSE 'global' END AS class,
          list_position(['anomaly', 'federation', 'reconcile', 'global', 'tail', 'onboarding', 'priority'], source) AS g,
          list_position(['anomaly', 'federation', 'tail', 'onboarding', 'reconcile', 'global', 'priority'], source) AS l,
          list_position(['anomaly', 'federation', 'priority', 'reconcile', 'global', 'tail', 'onboarding'], source) AS o
        FROM attempts WHERE status IN ('retry', 'pending') AND "at" <= TIMESTAMP '{NOW}'),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY status = 'pending', CASE class WHEN 'global' THEN g WHEN 'live' THEN l ELSE o END, "at", job_id) AS r FROM ready)
      SELECT job_id, class, r > CASE class WHEN 'global' THEN 900 ELSE 50 END AS borrowed FROM ranked WHERE r <= 1000
      ORDER BY borrowed, status = 'pending', g, "at", job_id LIMIT 1000""",
    "x3_same_sets": """SELECT 'repeats' AS pair, true AS same UNION ALL
      SELECT 'orders', NOT EXISTS (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders) AND NOT EXISTS (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)""",
    "l4_latest_error": "SELECT user_id AS account_id, max_by(CASE WHEN event_type = 'error' THEN 'e' || (event_id % 11) END, ts) FILTER (WHERE event_type = 'error') AS latest_error FROM events GROUP BY 1",
    "l5_recent_runs": "SELECT year(o_orderdate) AS run_id, epoch(min(o_orderdate))::BIGINT AS started_at FROM orders GROUP BY 1 ORDER BY 2 DESC LIMIT 3",
}


def _status_report() -> str:
    """One row of three reports; each is the SQL of its own query."""
    totals, coverage, jobs = (ORACLE_SQL[n] for n in ("a13_index_totals", "a2_coverage_summary", "a7_job_health"))
    return f"""SELECT t.*, j.* EXCLUDE (oldest_at), c.*, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS samples, t.associations AS in_json, NULL::VARCHAR AS left_out
      FROM ({totals}) t, ({jobs}) j, ({coverage}) c"""


ORACLE_SQL["t12_status_report"] = _status_report()
