"""Expected results as plain SQL over the same tables, worked out from the formulas of the event
feed rather than by decoding anything."""

from __future__ import annotations

from logtable.plans.queries import DEVIATION_BPS, HOT_REQUEST, MAX_AGE_SEC, ROUND_SEC, UNKNOWN_REQUEST, WETH
from logtable.sources.assets import DEFAULT_REGISTRY, default_assets
from logtable.operators.ingest import seed_hash

_ZEROS = "0x" + "0" * 64
_ASSET_ROWS = ", ".join(
    f"({i}, '{a['symbol']}', '{a['asset_id']}', '{a['aggregator']}', '{seed_hash(a['asset_id'], a['aggregator'])}')"
    for i, a in enumerate(default_assets())
)

_SRC = f"""
assets(ix, symbol, asset_id, aggregator, seed) AS (VALUES {_ASSET_ROWS}),
src AS (
  SELECT e.event_id, e.event_type, e.user_id, e.value, epoch_us(e.ts) AS us,
    100 + e.event_id // 8 AS block_number, CAST(e.event_id % 8 AS INTEGER) AS log_index,
    '0x' || sha256('tx-' || (e.event_id // 4)) AS tx_hash,
    '0x' || sha256('block-' || (100 + e.event_id // 8)) AS block_hash,
    coalesce(a.aggregator, '0x' || left(sha256('agg-' || (e.user_id % 12)), 40)) AS emitter,
    a.asset_id AS configured,
    '0x' || left(sha256('user-' || e.user_id), 40) AS requester,
    CASE WHEN e.user_id % 13 = 0 THEN '{HOT_REQUEST}' ELSE CAST(e.event_id // 10 AS VARCHAR) END AS req_id,
    CAST((CASE WHEN e.event_id % 11 = 0 THEN -1 ELSE 1 END) * CAST(round(e.value * 100) AS BIGINT) * 1000000 AS VARCHAR) AS price,
    CAST(epoch_us(e.ts) // 1000000 AS VARCHAR) AS stamp,
    '0x' || left(sha256('agg-' || (10 + e.event_id % 3)), 40) AS new_aggregator,
    '0x' || sha256('asset-' || (10 + e.event_id % 3) || '-' || (e.event_id % 5)) AS new_asset
  FROM events e LEFT JOIN assets a ON a.ix = e.user_id % 12
),
arrivals AS (
  SELECT *, 2 * event_id AS arrival_seq, us AS seen_us FROM src
  UNION ALL
  SELECT *, 2 * event_id + 41, us + 60000000 FROM src WHERE event_id % 5 = 0
)"""

_EVT = (
    _SRC
    + f""",
regs AS (SELECT event_id, new_aggregator, new_asset FROM src WHERE event_type = 'signup'),
priced AS (
  SELECT p.*, coalesce(r.new_asset, p.configured) AS resolved
  FROM (SELECT * FROM src WHERE event_type IN ('click', 'purchase')) p
  ASOF LEFT JOIN regs r ON p.emitter = r.new_aggregator AND p.event_id > r.event_id
),
evt AS (
  SELECT event_id, CASE event_type WHEN 'click' THEN 'PRICE_REQUESTED' ELSE 'PRICE_FULFILLED' END AS kind,
    emitter AS contract_address, tx_hash, block_hash, block_number, log_index, resolved AS asset_id, req_id,
    CASE WHEN event_type = 'click' THEN requester END AS requester,
    CASE WHEN event_type = 'purchase' THEN price END AS price,
    CASE WHEN event_type = 'purchase' THEN stamp END AS "timestamp",
    CAST(NULL AS VARCHAR) AS aggregator, us AS observed_at_us
  FROM priced
  UNION ALL
  SELECT event_id, 'ASSET_REGISTERED', '{DEFAULT_REGISTRY}', tx_hash, block_hash, block_number, log_index,
    new_asset, NULL, NULL, NULL, NULL, new_aggregator, us
  FROM src WHERE event_type = 'signup'
),
middle AS (SELECT (min(block_number) + max(block_number)) // 2 AS block FROM src)"""
)

_FLAT = (
    "kind, contract_address, tx_hash, block_hash, block_number, log_index, asset_id, req_id, requester, price, "
    '"timestamp", aggregator, observed_at_us'
)
_NEWEST = "ORDER BY block_number DESC, log_index DESC, tx_hash DESC"

_KIND = """CASE WHEN event_type = 'click' OR (event_type = 'error' AND event_id % 4 = 3) THEN 'PRICE_REQUESTED'
  WHEN event_type = 'purchase' OR (event_type = 'error' AND event_id % 4 = 1) THEN 'PRICE_FULFILLED'
  WHEN event_type = 'signup' OR (event_type = 'error' AND event_id % 4 = 2) THEN 'ASSET_REGISTERED' END"""
_PROBLEM = """CASE WHEN event_type = 'error' AND event_id % 4 = 2 THEN 'not emitted by the registry'
  WHEN event_type = 'error' AND event_id % 4 IN (1, 3) THEN 'malformed' END"""

_ADM = f"""
adm AS (
  SELECT o.*, o_orderkey % 9 AS v, 100 + o_orderkey // 8 AS block_number, CAST(o_orderkey % 8 AS INTEGER) AS log_index,
    '0x' || sha256('adm-' || o_orderkey) AS tx_hash, epoch_us(o_orderdate) AS us,
    a.asset_id, a.aggregator AS own, '0x' || left(sha256('reporter-set'), 40) AS reporter_set,
    '0x' || left(sha256('owner-' || (o_orderkey % 7)), 40) AS owner_1,
    '0x' || left(sha256('owner-' || (o_custkey % 7)), 40) AS owner_2,
    '0x' || left(sha256('set-' || (o_orderkey % 5)), 40) AS set_1,
    '0x' || left(sha256('set-' || (o_custkey % 5)), 40) AS set_2,
    '0x' || left(sha256('agg-new-' || o_custkey), 40) AS agg_1,
    '0x' || left(sha256('agg-new-' || o_orderkey), 40) AS agg_2,
    '0x' || left(sha256('reporter-' || (o_custkey % 50)), 40) AS reporter,
    CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS cents
  FROM orders o JOIN assets a ON a.ix = o_custkey % 10
),
admin AS (
  SELECT CASE WHEN v = 0 THEN '{DEFAULT_REGISTRY}' WHEN v IN (3, 4, 5) THEN own WHEN v IN (6, 7, 8) THEN reporter_set
      WHEN o_custkey % 3 = 0 THEN '{DEFAULT_REGISTRY}' WHEN o_custkey % 3 = 1 THEN own ELSE reporter_set END AS address,
    block_number, tx_hash, log_index, us AS observed_at_us,
    ['AssetUpdated', 'OwnershipTransferStarted', 'OwnershipTransferred', 'MaxAgeChanged', 'ReporterSetChanged',
     'RequestFeeChanged', 'ReporterAdded', 'ReporterRemoved', 'ThresholdChanged'][v + 1] AS event,
    CASE WHEN v = 0 THEN asset_id WHEN v IN (1, 2) THEN owner_1 WHEN v IN (3, 8) THEN CAST(o_custkey AS VARCHAR)
      WHEN v = 4 THEN set_1 WHEN v = 5 THEN CAST(o_orderkey AS VARCHAR) ELSE reporter END AS argument_1,
    CASE WHEN v = 0 THEN agg_1 WHEN v IN (1, 2) THEN owner_2 WHEN v IN (3, 8) THEN CAST(o_orderkey AS VARCHAR)
      WHEN v = 4 THEN set_2 WHEN v = 5 THEN cents END AS argument_2,
    CASE WHEN v = 0 THEN agg_2 END AS argument_3
  FROM adm
)"""


def _big(word: str) -> str:
    """SQL for the base-10 text of a 64-digit hex word: eight 32-bit parts in base 10**26."""
    base = 10**26
    limbs = []
    for k in range(3):
        terms = []
        for i in range(8):
            weight = (1 << (32 * i)) // base**k % base
            if weight:
                terms.append(f"CAST('0x' || substr({word}, {57 - 8 * i}, 8) AS HUGEINT) * CAST({weight} AS HUGEINT)")
        limbs.append(" + ".join(terms))
    a, b, c = limbs
    low = f"({a})"
    mid = f"(({b}) + {low} // {base})"
    high = f"(({c}) + {mid} // {base})"
    text = (
        f"CAST({high} AS VARCHAR) || lpad(CAST({mid} % {base} AS VARCHAR), 26, '0')"
        f" || lpad(CAST({low} % {base} AS VARCHAR), 26, '0')"
    )
    return f"coalesce(nullif(ltrim({text}, '0'), ''), '0')"


_WORDS = """
hashed AS (SELECT event_id, sha256('word-' || event_id) AS h FROM events),
words AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN h WHEN 1 THEN repeat('0', 32) || left(h, 32)
  WHEN 2 THEN repeat('0', 48) || left(h, 16) ELSE repeat('0', 64) END AS word FROM hashed)"""

_AGG = f"""
quotes AS (
  SELECT a.asset_id, e.event_type AS source, e.value AS price, epoch_us(e.ts) AS observed, epoch_us(e.ts) + 5000000 AS fetched
  FROM events e JOIN assets a ON a.ix = e.user_id % 10
),
placed AS (
  SELECT *, (fetched + {ROUND_SEC * 1000000 - 1}) // {ROUND_SEC * 1000000} * {ROUND_SEC} AS round_sec FROM quotes
),
latest AS (
  SELECT *, round_sec - observed // 1000000 AS age_sec FROM placed
  QUALIFY row_number() OVER (PARTITION BY asset_id, round_sec, source ORDER BY observed DESC, fetched DESC, price DESC) = 1
),
fresh AS (
  SELECT *, quantile_cont(price, 0.5) FILTER (WHERE age_sec <= {MAX_AGE_SEC}) OVER (PARTITION BY asset_id, round_sec) AS fresh_median
  FROM latest
),
judged AS (
  SELECT *, coalesce(age_sec <= {MAX_AGE_SEC} AND abs(price - fresh_median) * 10000 <= abs(fresh_median) * {DEVIATION_BPS}, false) AS included
  FROM fresh
),
aggregates AS (
  SELECT asset_id, CAST(round_sec AS BIGINT) AS aggregated_sec,
    round(quantile_cont(price, 0.5) FILTER (WHERE included), 4) AS median_price,
    string_agg(source || '|' || CAST(round(price * 100) AS BIGINT) || '|' || age_sec || '|' || included, ';' ORDER BY source) AS sources
  FROM judged GROUP BY asset_id, round_sec
)"""

_STATUS = """
SELECT {keys}coalesce(req.asset, ans.first_asset) AS asset_id,
  CASE WHEN ans.req_id IS NULL THEN 'PENDING' ELSE 'FULFILLED' END AS status, req.requester,
  req.tx_hash AS requested_tx_hash, ans.tx_hash AS fulfilled_tx_hash, ans.price AS fulfilled_price,
  req.us AS requested_at_us, ans.us AS fulfilled_at_us
FROM (SELECT {group}, arg_max(coalesce(asset_id, '{zeros}'), event_id) AS asset, arg_max(requester, event_id) AS requester,
    arg_max(tx_hash, event_id) AS tx_hash, max(observed_at_us) AS us
  FROM evt WHERE kind = 'PRICE_REQUESTED' GROUP BY {group}) req
FULL JOIN (SELECT {group}, arg_min(coalesce(asset_id, '{zeros}'), event_id) AS first_asset, arg_max(price, event_id) AS price,
    arg_max(tx_hash, event_id) AS tx_hash, max(observed_at_us) AS us
  FROM evt WHERE kind = 'PRICE_FULFILLED' GROUP BY {group}) ans USING ({group})
"""


def _status(*group: str) -> str:
    return _STATUS.format(keys="".join(f"{g}, " for g in group), group=", ".join(group), zeros=_ZEROS)


_PAYLOAD = f"""CASE kind
  WHEN 'PRICE_REQUESTED' THEN '{{"req_id":"' || req_id || '","asset_id":"' || coalesce(asset_id, '{_ZEROS}') || '","requester":"' || requester || '"}}'
  WHEN 'PRICE_FULFILLED' THEN '{{"req_id":"' || req_id || '","asset_id":"' || coalesce(asset_id, '{_ZEROS}') || '","price":"' || price || '","timestamp":"' || "timestamp" || '"}}'
  ELSE '{{"asset_id":"' || asset_id || '","aggregator":"' || aggregator || '"}}' END"""

_SHORT = "CASE WHEN length({0}) < 14 THEN {0} ELSE left({0}, 6) || '…' || right({0}, 4) END"

_SUBS = f"""
subs(sub_id, kind_wanted, asset_wanted) AS (VALUES (CAST(1 AS INTEGER), NULL, NULL), (2, 'PRICE_REQUESTED', NULL),
  (3, NULL, '{WETH}'), (4, 'PRICE_REQUESTED', '{WETH}'),
  (5, NULL, '{WETH}'), (6, 'PRICE_REQUESTED', NULL), (7, 'PRICE_REQUESTED', NULL), (8, NULL, '{WETH}')),
sent AS (SELECT s.sub_id, e.kind, e.asset_id, e.tx_hash, e.log_index FROM evt e JOIN subs s
  ON (s.kind_wanted IS NULL OR s.kind_wanted = e.kind) AND (s.asset_wanted IS NULL OR s.asset_wanted = e.asset_id))"""

_SUBMISSIONS = """
subm AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN '0' ELSE CAST(o_orderkey AS VARCHAR) END AS req_id, a.asset_id,
  '0x' || sha256('sub-' || o_orderkey) AS tx_hash,
  CAST(CAST(round(o_totalprice * 100) AS BIGINT) * 1000000 AS VARCHAR) AS submitted_price,
  CASE o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'F' THEN 'FAILED' ELSE 'CONFIRMED' END AS status,
  CAST(o_orderkey % 3 AS INTEGER) AS retry_count,
  CASE WHEN o_orderstatus = 'F' THEN 'reverted' ELSE '' END AS last_error, epoch_us(o_orderdate) AS submitted_at_us
  FROM orders JOIN assets a ON a.ix = o_custkey % 10)"""

_CUSTOM = """
base AS (SELECT c_custkey AS k, 'C' || c_custkey AS symbol, '0x' || sha256('cfg-' || c_custkey) AS full_id,
  CASE WHEN c_custkey % 10 = 3 THEN '0x' || left(sha256('shared-' || (c_custkey // 100)), 40)
    ELSE '0x' || left(sha256('cfg-' || c_custkey), 40) END AS address FROM customer),
cfg AS (SELECT symbol, CASE WHEN k % 7 = 0 THEN left(full_id, 60) ELSE full_id END AS asset_id,
  CASE WHEN k % 9 = 0 THEN substr(address, 3) WHEN k % 2 = 0 THEN '0x' || upper(substr(address, 3)) ELSE address END AS aggregator FROM base),
good AS (SELECT *, count(*) OVER (PARTITION BY lower(aggregator)) AS n FROM cfg WHERE lower(aggregator) LIKE '0x%' AND length(aggregator) = 42)"""


def statements() -> dict[str, str]:
    evt, src, adm = f"WITH {_EVT}", f"WITH {_SRC}", f"WITH {_SRC}, {_ADM}"
    agg = f"WITH {_EVT}, {_AGG}"
    flat = f"{evt} SELECT {_FLAT} FROM evt"
    every = f"{evt} SELECT kind, contract_address, tx_hash, log_index, asset_id FROM evt"
    price_kinds = "kind IN ('PRICE_REQUESTED', 'PRICE_FULFILLED')"
    status = f"{evt} {_status('req_id')}"
    sent = f"{evt}, {_SUBS} SELECT * FROM sent"
    payload = f"{_PAYLOAD}"
    after = "(block_number > 150 OR (block_number = 150 AND log_index > 3))"
    ranked = f"row_number() OVER ({_NEWEST})"
    sql = {
        "address_scope": f"{src} SELECT arrival_seq, CASE WHEN event_type = 'signup' THEN '{DEFAULT_REGISTRY}' ELSE emitter END AS address, tx_hash, log_index FROM arrivals WHERE event_type = 'signup' OR configured IS NOT NULL",
        "asset_violations": f"""WITH {_CUSTOM}
            SELECT symbol, 'asset_id' AS field, 'expected 0x and 64 more characters' AS problem, asset_id AS value FROM cfg WHERE NOT (lower(asset_id) LIKE '0x%' AND length(asset_id) = 66)
            UNION ALL SELECT symbol, 'aggregator', 'expected 0x and 40 more characters', aggregator FROM cfg WHERE NOT (lower(aggregator) LIKE '0x%' AND length(aggregator) = 42)
            UNION ALL SELECT symbol, 'aggregator', 'shared by several assets', aggregator FROM good WHERE n > 1""",
        "insert_if_absent": f"""{evt} SELECT kind, tx_hash, log_index, 2 * event_id AS arrival_seq FROM evt, middle WHERE block_number > middle.block""",
        "seed_assets": f"""{evt} SELECT tx_hash, block_number, log_index, contract_address, asset_id, block_hash FROM evt WHERE kind = 'ASSET_REGISTERED'
            UNION ALL SELECT seed, CAST(1 AS BIGINT), CAST(0 AS INTEGER), aggregator, asset_id, '{_ZEROS}' FROM assets""",
        "to_wire": f"""{evt} SELECT contract_address, tx_hash, block_hash, block_number, log_index, observed_at_us, CAST(0 AS INTEGER) AS confirmations,
            CAST(CASE kind WHEN 'PRICE_REQUESTED' THEN 1 WHEN 'PRICE_FULFILLED' THEN 2 ELSE 3 END AS INTEGER) AS kind,
            CASE WHEN kind = 'PRICE_REQUESTED' THEN {payload} END AS price_requested,
            CASE WHEN kind = 'PRICE_FULFILLED' THEN {payload} END AS price_fulfilled,
            CASE WHEN kind = 'ASSET_REGISTERED' THEN {payload} END AS asset_registered FROM evt""",
        "row_constraints": f"{src} SELECT arrival_seq, CAST(NULL AS VARCHAR) AS kind FROM arrivals WHERE event_type = 'view' OR (event_type = 'error' AND event_id % 4 = 0)",
        "event_table_scan": f"{flat} WHERE kind = 'PRICE_FULFILLED' AND block_number >= 110",
        "classify_logs": f"{src} SELECT arrival_seq, coalesce({_KIND}, 'unknown') AS kind, {_PROBLEM} AS problem FROM arrivals",
        "kind_mapping": f"{src} SELECT arrival_seq, CAST(CASE k WHEN 'PRICE_REQUESTED' THEN 1 WHEN 'PRICE_FULFILLED' THEN 2 WHEN 'ASSET_REGISTERED' THEN 3 ELSE 0 END AS INTEGER) AS kind_number, k AS kind_name FROM (SELECT arrival_seq, {_KIND} AS k FROM arrivals)",
        "decode_price_requested": f"{src} SELECT emitter AS address, tx_hash, log_index, req_id, requester, seen_us AS observed_at_us FROM arrivals WHERE event_type = 'click'",
        "decode_price_fulfilled": f"{src} SELECT emitter AS address, tx_hash, log_index, req_id, price, stamp AS \"timestamp\", CAST(price AS BIGINT) AS price_number FROM arrivals WHERE event_type = 'purchase'",
        "decode_asset_registered": f"{src} SELECT '{DEFAULT_REGISTRY}' AS address, tx_hash, log_index, new_asset AS asset_id, new_aggregator AS aggregator, seen_us AS observed_at_us FROM arrivals WHERE event_type = 'signup'",
        "uint256_decode": f"WITH {_WORDS} SELECT event_id, {_big('word')} AS value FROM words",
        "int256_decode": f"""WITH {_WORDS}, signed AS (SELECT event_id, word, translate(word, '0123456789abcdef', 'fedcba9876543210') AS inverse, word >= '8' AS negative FROM words),
            low AS (SELECT *, CAST('0x' || right(inverse, 8) AS BIGINT) + 1 AS tail FROM signed),
            -- adding one to a hash never carries past its last eight digits here
            neg AS (SELECT event_id, negative, CASE WHEN negative THEN left(inverse, 56) || lpad(lower(to_hex(tail)), 8, '0') ELSE word END AS magnitude FROM low)
            SELECT event_id, CASE WHEN negative THEN '-' ELSE '' END || {_big('magnitude')} AS value FROM neg""",
        "payload_json": f"{evt} SELECT tx_hash, log_index, {payload} AS payload FROM evt",
        "payload_roundtrip": f"{evt} SELECT kind, tx_hash, log_index, req_id, coalesce(asset_id, '{_ZEROS}') AS asset_id, requester, price, \"timestamp\", CAST(NULL AS VARCHAR) AS round_id, aggregator FROM evt",
        "short_hash": f"{evt} SELECT tx_hash, log_index, {_SHORT.format('tx_hash')} AS short_tx, {_SHORT.format('req_id')} AS short_req FROM evt",
        "decode_errors": f"{src} SELECT arrival_seq, {_KIND} AS kind, emitter AS address, tx_hash, log_index, {_PROBLEM} AS reason FROM arrivals WHERE {_PROBLEM} IS NOT NULL",
        "filter_topics": f"{src} SELECT arrival_seq, emitter AS address, tx_hash, log_index FROM arrivals WHERE (event_type = 'click' OR (event_type = 'error' AND event_id % 4 = 3)) AND req_id IN ('{HOT_REQUEST}', '1', '2') AND block_number >= 101",
        "decode_admin_events": f"""{adm} SELECT address, tx_hash, log_index, event, argument_1, argument_2, argument_3, observed_at_us FROM admin
            UNION ALL SELECT emitter, tx_hash, log_index, 'OwnershipTransferred', requester, emitter, NULL, seen_us FROM arrivals WHERE event_type = 'view'""",
        "resolve_asset_static": f"""{evt} SELECT kind, contract_address, tx_hash, log_index, CASE WHEN kind = 'ASSET_REGISTERED' THEN evt.asset_id ELSE assets.asset_id END AS asset_id
            FROM evt LEFT JOIN assets ON assets.aggregator = evt.contract_address""",
        "resolve_asset_asof": every,
        "dedup_first": f"""{src} SELECT tx_hash, log_index, arrival_seq, {_KIND} AS kind, seen_us AS observed_at_us FROM arrivals
            WHERE event_type IN ('click', 'purchase', 'signup') QUALIFY row_number() OVER (PARTITION BY tx_hash, log_index ORDER BY arrival_seq) = 1""",
        "list_events": f"{flat} WHERE {price_kinds} AND asset_id = '{WETH}' AND block_number >= 101 {_NEWEST} LIMIT 200",
        "list_by_kind": f"{flat} WHERE kind = 'PRICE_REQUESTED'",
        "list_by_asset": f"{flat} WHERE asset_id = '{WETH}'",
        "list_block_range": f"{flat}, middle WHERE block_number BETWEEN 101 AND middle.block",
        "list_default_page": f"{flat} {_NEWEST} LIMIT 100",
        "list_page_2": f"{flat} {_NEWEST} LIMIT 150 OFFSET 150",
        "list_deep_page": f"{flat} {_NEWEST} LIMIT 130 OFFSET 260",
        "page_meta": f"{evt} SELECT count(*) AS total_count, CAST(2 AS INTEGER) AS page, CAST(30 AS INTEGER) AS page_size, CAST(ceil(count(*) / 30.0) AS BIGINT) AS total_pages FROM evt WHERE kind = 'PRICE_REQUESTED'",
        "cursor_page": f"""{evt}, ranked AS (SELECT *, {ranked} AS place FROM evt WHERE kind = 'PRICE_REQUESTED')
            SELECT block_number, log_index, tx_hash, (SELECT max(place) FROM ranked) > 100 AS has_more,
              CASE WHEN (SELECT max(place) FROM ranked) > 100 THEN (SELECT translate(to_base64(encode(block_number || ':' || log_index || ':' || tx_hash)), '+/', '-_') FROM ranked WHERE place = 100) ELSE '' END AS next_cursor
            FROM ranked WHERE place BETWEEN 51 AND 100""",
        "replay_history": f"{flat} WHERE block_number >= 110",
        "after_position": f"{flat} WHERE {after}",
        "high_water": f"{evt} SELECT block_number, log_index FROM evt {_NEWEST} LIMIT 1",
        "request_status": status,
        "request_status_by_contract": f"{evt} {_status('req_id', 'contract_address')}",
        "get_request": f"{evt} SELECT * FROM ({_status('req_id')}) WHERE req_id = '{HOT_REQUEST}'",
        "events_for_request": f"{flat} WHERE req_id = '{HOT_REQUEST}'",
        "request_fulfil_join": f"""{evt} SELECT req_id, arg_max(tx_hash, event_id) FILTER (WHERE kind = 'PRICE_REQUESTED') AS requested_tx_hash,
            count(*) FILTER (WHERE kind = 'PRICE_REQUESTED') AS requests, arg_max(tx_hash, event_id) FILTER (WHERE kind = 'PRICE_FULFILLED') AS fulfilled_tx_hash,
            count(*) FILTER (WHERE kind = 'PRICE_FULFILLED') AS fulfilments FROM evt WHERE req_id IS NOT NULL GROUP BY req_id""",
        "subscription_match": f"""{evt} SELECT tx_hash, log_index, true AS any_event, kind = 'PRICE_REQUESTED' AS by_kind,
            coalesce(asset_id = '{WETH}', false) AS by_asset, coalesce({price_kinds} AND asset_id = '{WETH}', false) AS by_both FROM evt""",
        "fan_out": sent,
        "deliveries": f"{evt}, {_SUBS} SELECT tx_hash, log_index, count(*) AS delivered FROM sent GROUP BY tx_hash, log_index",
        "events_seen": f"{evt} SELECT kind, count(*) AS seen FROM evt GROUP BY kind",
        "decode_error_count": f"{src} SELECT count(*) AS decode_errors FROM arrivals WHERE event_type = 'error' AND event_id % 4 <> 0",
        "current_assets": f"""{adm}, changes AS (SELECT block_number, log_index, tx_hash, argument_1 AS asset_id, argument_3 AS aggregator FROM admin WHERE event = 'AssetUpdated'
            UNION ALL SELECT block_number, log_index, tx_hash, new_asset, new_aggregator FROM src WHERE event_type = 'signup')
            SELECT asset_id, aggregator FROM changes QUALIFY row_number() OVER (PARTITION BY asset_id {_NEWEST}) = 1""",
        "latest_price": f"{evt} SELECT contract_address, req_id, price, \"timestamp\", block_number FROM evt WHERE kind = 'PRICE_FULFILLED' QUALIFY row_number() OVER (PARTITION BY contract_address {_NEWEST}) = 1",
        "fulfilled_requests": f"{evt} SELECT DISTINCT contract_address, req_id FROM evt WHERE kind = 'PRICE_FULFILLED'",
        "current_reporters": f"""{adm}, last AS (SELECT * FROM admin WHERE event IN ('ReporterAdded', 'ReporterRemoved') QUALIFY row_number() OVER (PARTITION BY address, argument_1 {_NEWEST}) = 1)
            SELECT address AS contract_address, argument_1 AS reporter FROM last WHERE event = 'ReporterAdded'""",
        "current_admin_state": f"""{adm}, settings AS (
            SELECT address, block_number, log_index, tx_hash, CASE event WHEN 'MaxAgeChanged' THEN 'max_age' WHEN 'RequestFeeChanged' THEN 'request_fee' WHEN 'ThresholdChanged' THEN 'threshold'
                WHEN 'ReporterSetChanged' THEN 'reporter_set' WHEN 'OwnershipTransferStarted' THEN 'pending_owner' ELSE 'owner' END AS parameter, argument_2 AS value
              FROM admin WHERE event NOT IN ('AssetUpdated', 'ReporterAdded', 'ReporterRemoved')
            UNION ALL SELECT address, block_number, log_index, tx_hash, 'pending_owner', NULL FROM admin WHERE event = 'OwnershipTransferred'
            UNION ALL SELECT emitter, block_number, log_index, tx_hash, 'owner', emitter FROM src WHERE event_type = 'view'
            UNION ALL SELECT emitter, block_number, log_index, tx_hash, 'pending_owner', NULL FROM src WHERE event_type = 'view'),
            last AS (SELECT * FROM settings QUALIFY row_number() OVER (PARTITION BY address, parameter {_NEWEST}) = 1)
            SELECT address AS contract_address, parameter, value FROM last WHERE value IS NOT NULL""",
        "median_price": f"{agg} SELECT asset_id, aggregated_sec, median_price, sources FROM aggregates",
        "latest_aggregate": f"{agg} SELECT asset_id, median_price, aggregated_sec FROM aggregates WHERE median_price IS NOT NULL QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY aggregated_sec DESC) = 1",
        "price_subscription": f"""{agg}, rounds AS (SELECT asset_id, median_price, aggregated_sec FROM aggregates WHERE median_price IS NOT NULL),
            half AS (SELECT (min(aggregated_sec) + max(aggregated_sec)) / 2.0 AS sec FROM rounds),
            wanted AS (SELECT r.*, aggregated_sec > half.sec AS live FROM rounds r JOIN assets a ON a.asset_id = r.asset_id AND a.ix < 4, half)
            SELECT asset_id, median_price, aggregated_sec FROM wanted WHERE live
            UNION ALL SELECT asset_id, max_by(median_price, aggregated_sec), max(aggregated_sec) FROM wanted WHERE NOT live GROUP BY asset_id""",
        "heartbeat_due": f"""{agg}, writes AS (SELECT asset_id, observed_at_us AS us, CAST(CAST(price AS BIGINT) AS DOUBLE) / 1e8 AS price FROM evt WHERE kind = 'PRICE_FULFILLED' AND asset_id IS NOT NULL),
            seen AS (SELECT a.asset_id, a.aggregated_sec, a.median_price, w.price AS onchain_price, a.aggregated_sec - w.us // 1000000 AS elapsed_sec,
                3600 * (s.ix % 4) AS every, 500 * (s.ix % 3) AS bps
              FROM (SELECT *, aggregated_sec * 1000000 AS us FROM aggregates WHERE median_price IS NOT NULL) a JOIN assets s ON s.asset_id = a.asset_id
              ASOF LEFT JOIN writes w ON a.asset_id = w.asset_id AND a.us >= w.us),
            due AS (SELECT *, coalesce(every > 0 AND elapsed_sec >= every, false) AS due_by_time,
                coalesce(bps > 0 AND abs(median_price - onchain_price) * 10000 >= abs(onchain_price) * bps, false) AS due_by_move FROM seen)
            SELECT asset_id, aggregated_sec, median_price, onchain_price, elapsed_sec, due_by_time, due_by_move, due_by_time OR due_by_move AS due FROM due""",
        "list_submissions": f"WITH {_SRC}, {_SUBMISSIONS} SELECT * FROM subm WHERE asset_id = '{WETH}' ORDER BY submitted_at_us DESC, tx_hash DESC LIMIT 20 OFFSET 20",
        "find_submission": f"WITH {_SRC}, {_SUBMISSIONS} SELECT req_id, asset_id, tx_hash, submitted_price, status, retry_count, last_error FROM subm WHERE req_id = '17'",
        "streaming_dedup": f"""{src} SELECT tx_hash, log_index, arrival_seq, {_KIND} AS kind, CASE WHEN event_type <> 'signup' THEN req_id END AS req_id, seen_us AS observed_at_us FROM arrivals
            WHERE event_type IN ('click', 'purchase', 'signup') QUALIFY row_number() OVER (PARTITION BY tx_hash, log_index ORDER BY arrival_seq) = 1""",
        "request_not_found": f"{evt} SELECT * FROM ({_status('req_id')}) WHERE req_id = '{UNKNOWN_REQUEST}'",
        "submissions_meta": f"WITH {_SRC}, {_SUBMISSIONS} SELECT count(*) AS total_count, CAST(2 AS INTEGER) AS page, CAST(20 AS INTEGER) AS page_size, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM subm WHERE asset_id = '{WETH}'",
        "configured_assets": f"""WITH {_SRC.split("src AS")[0].rstrip().rstrip(",")}, entries AS (SELECT c_nationkey AS config_id, c_custkey AS k, 'C' || c_custkey AS symbol, '0x' || sha256('cfg-' || c_custkey) AS asset_id,
              CASE WHEN c_custkey % 4 <> 0 THEN '0x' || left(sha256('cfg-' || c_custkey), 40) END AS aggregator FROM customer),
            texts AS (SELECT config_id, '{{"symbol":"' || symbol || '","asset_id":"' || asset_id || '"' || coalesce(',"aggregator":"' || aggregator || '"', '') || '}}' AS one, symbol FROM entries),
            whole AS (SELECT config_id, string_agg(one, ',' ORDER BY symbol) AS inside, min_by(one, symbol) AS first FROM texts GROUP BY config_id)
            SELECT config_id, symbol, asset_id, coalesce(aggregator, '') AS aggregator, CAST(NULL AS VARCHAR) AS corrupt FROM entries WHERE config_id % 6 IN (0, 5)
            UNION ALL SELECT w.config_id, a.symbol, a.asset_id, a.aggregator, NULL FROM whole w, assets a WHERE w.config_id % 6 IN (3, 4)
            UNION ALL SELECT config_id, NULL, NULL, NULL, CASE config_id % 6 WHEN 1 THEN '[' || inside ELSE first END FROM whole WHERE config_id % 6 IN (1, 2)""",
        "replay_then_live": f"{flat} WHERE {price_kinds} AND block_number >= 110",
        "boundary_dedup": flat,
        "live_subscription": f"{flat} WHERE kind = 'PRICE_FULFILLED' AND asset_id = '{WETH}'",
        "watch_ownership": f"""{adm} SELECT address, tx_hash, log_index, argument_1 AS previous_owner, argument_2 AS new_owner FROM admin WHERE event = 'OwnershipTransferred' AND block_number >= 101
            UNION ALL SELECT emitter, tx_hash, log_index, requester, emitter FROM arrivals WHERE event_type = 'view' AND block_number >= 101""",
    }
    for name in ("streaming_ingest", "streaming_resume", "compacted_table"):
        sql[name] = flat
    sql["late_registrations"] = f"{evt} SELECT {_FLAT.removesuffix(', observed_at_us')} FROM evt"
    sql["ingest_publish"], sql["ingest_seeds"] = sent, sql["seed_assets"]
    sql["ingest_counted"], sql["stream_quarantine"] = sql["events_seen"], sql["decode_errors"]
    sql["streaming_fan_out"] = sent
    sql["streaming_request_status"] = status
    return sql
