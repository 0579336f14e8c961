"""SQL twins of the catalog for DuckDB, over the same tables."""

from __future__ import annotations

BID = """
bid AS (
  SELECT event_id,
         CAST(CASE WHEN event_id % 5 = 0
              THEN CASE user_id % 5 WHEN 0 THEN 1007 WHEN 1 THEN 1020 WHEN 2 THEN 2001 WHEN 3 THEN 2019 ELSE 2087 END
              ELSE 1000 + (event_id * 7919) % 1200 END AS BIGINT) AS auction,
         user_id AS bidder, CAST(round(value * 100) AS BIGINT) AS price, ts AS "dateTime", props AS extra
  FROM events)"""

AUCTION = """
auction AS (
  SELECT o_orderkey AS id, o_orderpriority AS "itemName", o_orderstatus AS description,
         CAST(round(o_totalprice) AS BIGINT) AS "initialBid", CAST(round(o_totalprice * 100) AS BIGINT) AS reserve,
         o_orderdate + INTERVAL '7' DAY AS expires, o_custkey AS seller, o_orderkey % 20 AS category,
         o_orderdate AS "dateTime", o_orderstatus AS extra
  FROM orders)"""

PERSON = """
person AS (
  SELECT c.c_custkey AS id, c.c_name AS name, concat(c.c_name, '@example.com') AS "emailAddress",
         concat('card-', CAST(c.c_custkey AS VARCHAR)) AS "creditCard", n.n_name AS city,
         CASE c.c_custkey % 6 WHEN 0 THEN 'OR' WHEN 1 THEN 'ID' WHEN 2 THEN 'CA' WHEN 3 THEN 'WA' WHEN 4 THEN 'NY'
              ELSE 'TX' END AS state,
         CASE WHEN c.c_custkey % 3 = 0 THEN o.t - INTERVAL '45' DAY ELSE o.t END AS "dateTime",
         c.c_mktsegment AS extra
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN (SELECT o_custkey, min(o_orderdate) AS t FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey)"""

MOVES = """
person AS (
  SELECT o_custkey AS id, concat('p', CAST(o_custkey AS VARCHAR)) AS name, o_orderpriority AS city,
         (['OR', 'ID', 'CA', 'WA', 'NY', 'TX'])[CAST(o_orderkey % 6 + 1 AS INTEGER)] AS state,
         o_orderdate AS "dateTime"
  FROM orders)"""

HOT = "(1007, 1020, 2001, 2019, 2087)"


# Some bids come two slices late; a slice is judged by what the slices up to the last but one have shown.
LATE = """
timed AS (SELECT *, epoch_us("dateTime") AS us, min(epoch_us("dateTime")) OVER () AS low, max(epoch_us("dateTime")) OVER () AS high FROM bid),
dealt AS (SELECT *, (us - low) // ((high - low) // 4 + 1) AS own, (us // 10000000 + 1) * 10000 AS window_end FROM timed),
arrived AS (SELECT *, CASE WHEN event_id % 50 = 0 THEN least(own + 2, 3) ELSE own END AS slice FROM dealt),
highest AS (SELECT slice AS seen, max(us) // 1000 AS ms FROM arrived GROUP BY slice),
bounds AS (SELECT a.slice AS at, max(h.ms) - 4000 AS ms FROM (SELECT DISTINCT slice FROM arrived) a
           JOIN highest h ON h.seen <= a.slice - 2 GROUP BY a.slice),
judged AS (SELECT arrived.*, coalesce(window_end <= bounds.ms, FALSE) AS late FROM arrived LEFT JOIN bounds ON bounds.at = slice)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def _hop_counts(size_hours: int, slide_minutes: int) -> str:
    steps = size_hours * 60 // slide_minutes
    return f"""
hops AS (
  SELECT auction, starttime, starttime + INTERVAL '{size_hours}' HOUR AS endtime, CAST(count(*) AS BIGINT) AS num
  FROM (SELECT auction, time_bucket(INTERVAL '{slide_minutes}' MINUTE, "dateTime", TIMESTAMP '1970-01-01')
               - k * INTERVAL '{slide_minutes}' MINUTE AS starttime
        FROM bid, range({steps}) r(k))
  GROUP BY auction, starttime)"""


def _sessions(keys: str, hours: int = 6) -> str:
    return f"""
marked AS (
  SELECT {keys}, "dateTime",
         CASE WHEN lag("dateTime") OVER (PARTITION BY {keys} ORDER BY "dateTime") IS NULL
                OR "dateTime" > lag("dateTime") OVER (PARTITION BY {keys} ORDER BY "dateTime") + INTERVAL '{hours}' HOUR
              THEN 1 ELSE 0 END AS opens
  FROM bid),
numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY {keys} ORDER BY "dateTime" ROWS UNBOUNDED PRECEDING) AS s FROM marked),
sessions AS (
  SELECT {keys}, CAST(count(*) AS BIGINT) AS bid_count, min("dateTime") AS starttime,
         max("dateTime") + INTERVAL '{hours}' HOUR AS endtime
  FROM numbered GROUP BY {keys}, s)"""


def _firings(every: int) -> str:
    return f"""
firings AS (
  SELECT bidder, bid_count FROM sessions
  UNION ALL
  SELECT bidder, CAST(k * {every} AS BIGINT) FROM sessions,
         range(1, (SELECT max(bid_count) FROM sessions) + 1) r(k)
  WHERE k * {every} <= bid_count)"""


def _emit_once(states: str) -> str:
    return f"""
versions AS (
  SELECT id AS seller, "dateTime" AS t, name, city, state,
         lead("dateTime") OVER (PARTITION BY id ORDER BY "dateTime") AS until,
         row_number() OVER (PARTITION BY id ORDER BY "dateTime") AS nth
  FROM (SELECT *, row_number() OVER (PARTITION BY id, "dateTime" ORDER BY name DESC, city DESC, state DESC) AS best
        FROM person WHERE state IN ({states})) WHERE best = 1),
emitted AS (
  SELECT v.name, v.city, v.state, a.id
  FROM auction a JOIN versions v
    ON a.seller = v.seller AND a."dateTime" >= v.t AND (v.until IS NULL OR a."dateTime" < v.until)
  UNION ALL
  SELECT DISTINCT v.name, v.city, v.state, a.id
  FROM auction a JOIN versions v ON a.seller = v.seller AND v.nth = 1 AND a."dateTime" < v.t)"""


LOCAL = "'OR', 'ID', 'CA'"

# 32-bit hash arithmetic on HUGEINT.
M32 = "4294967296"


def _mul(a: str, b: str) -> str:
    return f"((CAST({a} AS HUGEINT) * CAST({b} AS HUGEINT)) % {M32})"


def _key_group_steps(source: str, code: str = "hash", keep: str = "event_id", groups: int = 128) -> str:
    """CTEs that end in ``grouped(keep, hash, keygroup)``."""
    return f"""
h0 AS (SELECT {keep}, {code} AS hash, (CAST({code} AS HUGEINT) + {M32}) % {M32} AS x FROM {source}),
h1 AS (SELECT {keep}, hash, {_mul('x', '3432918353')} AS x FROM h0),
h2 AS (SELECT {keep}, hash, (x * 32768) % {M32} + x // 131072 AS x FROM h1),
h3 AS (SELECT {keep}, hash, {_mul('x', '461845907')} AS x FROM h2),
h4 AS (SELECT {keep}, hash, (x * 8192) % {M32} + x // 524288 AS x FROM h3),
h5 AS (SELECT {keep}, hash, xor((x * 5 + 3864292196) % {M32}, CAST(4 AS HUGEINT)) AS x FROM h4),
h6 AS (SELECT {keep}, hash, xor(x, x // 65536) AS x FROM h5),
h7 AS (SELECT {keep}, hash, {_mul('x', '2246822507')} AS x FROM h6),
h8 AS (SELECT {keep}, hash, xor(x, x // 8192) AS x FROM h7),
h9 AS (SELECT {keep}, hash, {_mul('x', '3266489909')} AS x FROM h8),
h10 AS (SELECT {keep}, hash, xor(x, x // 65536) AS x FROM h9),
grouped AS (
  SELECT {keep}, hash,
         CAST((CASE WHEN x < 2147483648 THEN x WHEN x = 2147483648 THEN 0 ELSE {M32} - x END) % {groups} AS INTEGER)
           AS keygroup
  FROM h10)"""


def _signed(word: str) -> str:
    return f"CAST(CASE WHEN {word} >= 2147483648 THEN {word} - {M32} ELSE {word} END AS INTEGER)"


def _long_hash(column: str) -> str:
    word = f"((CAST({column} AS HUGEINT) + 18446744073709551616) % 18446744073709551616)"
    return _signed(f"xor({word} // {M32}, {word} % {M32})")


def _string_hash(column: str) -> str:
    codes = (
        f"list_transform(string_split({column}, ''), lambda c: CAST(CASE WHEN c = '' THEN 0 ELSE unicode(c) END AS BIGINT))"
    )
    return _signed(f"list_reduce(list_prepend(CAST(0 AS BIGINT), {codes}), lambda h, c: (h * 31 + c) % {M32})")


SAMPLES = """
samples AS (
  SELECT event_id, user_id % 12 AS run_id,
         ([1, 2, 3, 5, 8, 11])[CAST((user_id % 12) % 6 + 1 AS INTEGER)] AS query,
         CASE WHEN user_id % 12 < 6 THEN 1 ELSE 2 END AS parallelism,
         CASE WHEN user_id % 2 = 0 THEN 5000 ELSE 50000 END AS throughput,
         CASE WHEN event_id % 2 = 0 THEN 'plain' ELSE 'pushed' END AS variant,
         CASE event_type WHEN 'click' THEN 'taskmanager' WHEN 'view' THEN 'storage' WHEN 'purchase' THEN 'proxy'
                         WHEN 'signup' THEN 'taskmanager' ELSE 'source' END AS service,
         CAST((user_id // 12) % 2 + 1 AS INTEGER) AS replica,
         CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'cpu_rate' WHEN event_type = 'signup'
              THEN 'network_rate' ELSE 'tput' END AS metric,
         ts, CAST(round(value * 100) AS BIGINT) AS value
  FROM events)"""

HOURLY = """
hourly AS (SELECT * REPLACE (time_bucket(INTERVAL '1' HOUR, ts, TIMESTAMP '1970-01-01') AS ts) FROM samples)"""

SHARE = "CASE WHEN query IN (3, 8) THEN 0.08::DOUBLE ELSE 0.92::DOUBLE END"


def _warm(run: str) -> str:
    return f"""
warm AS (
  SELECT s.* FROM samples s JOIN (SELECT {run}, min(ts) AS t0 FROM samples GROUP BY {run}) USING ({run})
  WHERE s.ts > t0 + INTERVAL '2' DAY),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY {run} ORDER BY ts) AS nth FROM warm),
cut AS (SELECT * FROM ranked WHERE nth > 10)"""


def _usage(source: str) -> str:
    return f"""
roles AS (
  SELECT *, CASE WHEN metric = 'network_rate' AND service = 'taskmanager' THEN 'network'
                 WHEN metric = 'cpu_rate' AND service = 'proxy' THEN 'proxy'
                 WHEN metric = 'cpu_rate' AND service = 'storage' THEN 'storage'
                 WHEN metric = 'cpu_rate' AND service = 'taskmanager' THEN 'processing' END AS role
  FROM {source}),
means AS (
  SELECT run_id, query, parallelism, throughput, variant, role, replica, avg(value) AS m
  FROM roles WHERE role IS NOT NULL GROUP BY ALL),
usage AS (
  SELECT run_id, query, parallelism, throughput, variant, role, sum(m) AS usage FROM means GROUP BY ALL)"""


COUNTER = """
counter AS (
  SELECT event_type, event_id, ts,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER
           (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total
  FROM events)"""


def _rate(series: str, source: str, value: str, seconds: int) -> str:
    return f"""
pairs AS (
  SELECT {series}, event_id, ts, {value} AS v, lag({value}) OVER w AS pv,
         date_diff('microsecond', lag(ts) OVER w, ts) / 1000000.0::DOUBLE AS dt
  FROM {source} WINDOW w AS (PARTITION BY {series} ORDER BY ts, event_id))
SELECT {series}, event_id,
       round(CASE WHEN dt > 0 AND dt <= {seconds} THEN (CASE WHEN v < pv THEN v ELSE v - pv END) / dt END, 6) AS rate
FROM pairs"""


RECORDS = """
records AS (
  SELECT 'bid' AS topic, CAST(event_id % 4 AS INTEGER) AS "partition", event_id // 4 AS "offset",
         CAST(auction AS VARCHAR) AS key, b.* FROM bid b)"""

VALUE_BYTES = """octet_length(encode(concat('{"auction":', auction, ',"bidder":', bidder, ',"price":', price,
  ',"dateTime":"', strftime("dateTime", '%Y-%m-%d %H:%M:%S.%f'), '","extra":"', replace(extra, '"', '\\"'), '"}')))"""

WORDS = r"list_filter(regexp_split_to_array(lower(text), '\W+'), lambda w: len(w) > 0)"

ORIGIN_OWNER = """
mapping AS (
  SELECT CAST(v AS INTEGER) AS virtual, (v % 4 + v // 4) % 4 AS origin, (start + v) % 4 AS owner
  FROM range(16) r(v), (SELECT ((97533 * 31) & 2147483647) % 4 AS start))"""

ORACLE = {
    "q0": _with(BID) + 'SELECT auction, bidder, price, "dateTime" FROM bid',
    "q1": _with(BID) + """
SELECT auction, bidder, CAST(0.908::DECIMAL(3,3) * price::DECIMAL(19,0) AS DECIMAL(23,3)) AS price, "dateTime", extra
FROM bid""",
    "q1_float": _with(BID) + """
SELECT auction, CAST(trunc(CAST(0.82 AS FLOAT) * CAST(price AS FLOAT)) AS BIGINT) AS price, bidder, "dateTime"
FROM bid""",
    "q2": _with(BID) + f"SELECT auction, price FROM bid WHERE auction IN {HOT}",
    "q2_typed": _with(BID) + f"SELECT auction, price FROM bid WHERE auction IN {HOT}",
    "q2_pattern": _with(BID) + """
SELECT auction, price FROM bid WHERE regexp_matches(CAST(auction AS VARCHAR), '1007|1020')""",
    "q2_modulo": _with(BID) + """
SELECT auction, price FROM bid
WHERE auction % 1007 = 0 OR auction % 1020 = 0 OR auction % 2001 = 0 OR auction % 2019 = 0 OR auction % 2087 = 0""",
    "q3": _with(AUCTION, PERSON) + f"""
SELECT p.name, p.city, p.state, a.id FROM auction a JOIN person p ON a.seller = p.id
WHERE a.category = 10 AND p.state IN ({LOCAL})""",
    "q3_incremental": _with(AUCTION, PERSON, _emit_once(LOCAL)) + "SELECT name, city, state, id FROM emitted",
    "q3_versions": _with(AUCTION, MOVES, _emit_once(LOCAL + ", 'WA'")) + "SELECT name, city, state, id FROM emitted",
    "q5": _with(BID, _hop_counts(10, 120)) + """
SELECT h.auction, h.num FROM hops h
JOIN (SELECT starttime, max(num) AS maxn FROM hops GROUP BY starttime) m
  ON h.starttime = m.starttime AND h.num >= m.maxn""",
    "q5_counts": _with(BID, _hop_counts(1, 5)) + "SELECT auction, num FROM hops",
    "q5_strkey": _with(BID, _hop_counts(10, 120)) + "SELECT CAST(auction AS VARCHAR) AS auction, num FROM hops",
    "hop_windows": _with(BID, _hop_counts(10, 120)) + "SELECT auction, num, starttime, endtime FROM hops",
    "q8": _with(AUCTION, PERSON) + """
SELECT p.id, p.name, p.w AS stime
FROM (SELECT DISTINCT id, name, time_bucket(INTERVAL '30' DAY, "dateTime", TIMESTAMP '1970-01-01') AS w
      FROM person) p
JOIN (SELECT DISTINCT seller, time_bucket(INTERVAL '30' DAY, "dateTime", TIMESTAMP '1970-01-01') AS w
      FROM auction) a ON p.id = a.seller AND p.w = a.w""",
    "q8_pairs": _with(AUCTION, PERSON) + """
SELECT p.id, p.name, a.reserve FROM person p JOIN auction a
  ON p.id = a.seller AND time_bucket(INTERVAL '30' DAY, p."dateTime", TIMESTAMP '1970-01-01')
                       = time_bucket(INTERVAL '30' DAY, a."dateTime", TIMESTAMP '1970-01-01')""",
    "q11": _with(BID, _sessions("bidder")) + "SELECT bidder, bid_count, starttime, endtime FROM sessions",
    "q11_composite": _with(BID, _sessions("extra, auction, bidder")) + """
SELECT extra, auction, bidder, bid_count, starttime, endtime FROM sessions""",
    "q11_early": _with(BID, _sessions("bidder"), _firings(2)) + "SELECT bidder, bid_count FROM firings",
    "q11_strkey": _with(BID, _sessions("bidder")) + "SELECT CAST(bidder AS VARCHAR) AS bidder, bid_count FROM sessions",
    "scan_projection": _with(BID) + 'SELECT bidder, "dateTime" FROM bid',
    "scan_unprojected_filter": _with(AUCTION) + """
SELECT id, seller FROM auction WHERE category = 10 AND regexp_matches("itemName", '^[12]-')""",
    "scan_json": _with(BID, RECORDS) + f"""
SELECT "partition", "offset", key, auction, bidder, CAST(NULL AS VARCHAR) AS price
FROM records WHERE auction IN {HOT}""",
    "scan_passthrough": _with(BID, RECORDS) + """
SELECT topic, "partition", "offset", key, CAST(price AS VARCHAR) AS price FROM records""",
    "scan_markers": _with(BID, RECORDS) + """
SELECT topic, "partition", "offset", CASE WHEN auction = 1007 THEN key END AS key, auction <> 1007 AS marker
FROM (SELECT *, max("offset") OVER (PARTITION BY topic, "partition") AS tail FROM records)
WHERE auction = 1007 OR "offset" = tail""",
    "scan_savings": _with(BID, RECORDS, f"""
sizes AS (
  SELECT topic, auction IN {HOT} AS kept, len(key) + {VALUE_BYTES} AS r,
         len(key) + octet_length(encode(concat('{{"auction":', auction, ',"bidder":', bidder, '}}'))) AS s
  FROM records)""") + """
SELECT topic, count(*) AS records, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS removed,
       CAST(sum(r) AS BIGINT) AS bytes_read, CAST(sum(CASE WHEN kept THEN s ELSE 0 END) AS BIGINT) AS bytes_sent,
       CAST(sum(r) - sum(CASE WHEN kept THEN s ELSE 0 END) AS BIGINT) AS bytes_saved
FROM sizes GROUP BY topic""",
    "scan_missing_attribute": """
SELECT event_id FROM events WHERE user_id % 2 <> 0 OR event_type IN ('click', 'error')""",
    "scan_tombstones": _with(BID, RECORDS) + """
SELECT "partition", "offset", CAST(price AS VARCHAR) AS price FROM records WHERE "offset" % 7 <> 0""",
    "scan_value_kinds": """
SELECT event_id FROM events
WHERE CASE event_id % 4 WHEN 0 THEN event_id % 8 = 0 WHEN 3 THEN event_type = 'click' ELSE TRUE END""",
    "typed_source": _with(PERSON) + 'SELECT * FROM person',
    "keyed_sink": _with(AUCTION) + "SELECT CAST(id AS VARCHAR) AS key, seller FROM auction",
    "event_mix": """
SELECT CASE WHEN event_id % 50 = 0 THEN 'person' WHEN event_id % 50 < 4 THEN 'auction' ELSE 'bid' END AS kind,
       count(*) AS num
FROM events GROUP BY 1""",
    "prefix_filter": _with(PERSON) + "SELECT id, name FROM person WHERE regexp_matches(name, '^Customer#0+1')",
    "keygroup_long": _with(f"codes AS (SELECT event_id, {_long_hash('event_id')} AS hash FROM events)",
                           _key_group_steps("codes")) + """
SELECT event_id, hash, keygroup, CAST(keygroup * 4 // 128 AS INTEGER) AS slot FROM grouped""",
    "keygroup_string": _with(f"codes AS (SELECT event_id, {_string_hash('props')} AS hash FROM events)",
                             _key_group_steps("codes")) + """
SELECT event_id, hash, keygroup, CAST(keygroup * 3 // 128 AS INTEGER) AS slot FROM grouped""",
    "keygroup_composite": _with(
        f"""codes AS (SELECT event_id, xor(xor({_string_hash('event_type')}, {_long_hash('user_id')}),
              CAST(event_id AS INTEGER)) AS hash FROM events)""",
        _key_group_steps("codes")) + "SELECT event_id, hash, keygroup FROM grouped",
    "slot_filter": _with(BID, f"codes AS (SELECT bidder, price, {_long_hash('bidder')} AS hash FROM bid)",
                         _key_group_steps("codes", keep="bidder, price")) + """
SELECT bidder, price FROM grouped WHERE keygroup * 4 // 128 = 1""",
    "split_owners": _with(
        f"""used AS (SELECT DISTINCT event_type, user_id % 8 AS "partition" FROM events),
hashed AS (SELECT *, CAST({_string_hash('event_type')} AS BIGINT) AS h FROM used)""") + """
SELECT event_type, "partition", CAST(((((h * 31) % 2147483648 + 2147483648) % 2147483648) % 4 + "partition") % 4
  AS INTEGER) AS owner FROM hashed""",
    "virtual_offsets": _with(BID, RECORDS) + """
SELECT "partition", "offset", "offset" * 4 + "partition" AS virtual_offset, "offset" AS back FROM records""",
    "virtual_origin": """
SELECT user_id, CAST((user_id % 3 + user_id // 3) % 5 AS INTEGER) AS origin
FROM (SELECT DISTINCT user_id FROM events)""",
    "deal_out": _with(
        BID, RECORDS, f"""codes AS (SELECT "partition", "offset", {_long_hash('auction')} AS hash FROM records)""",
        _key_group_steps("codes", keep='"partition", "offset"'), ORIGIN_OWNER) + """
SELECT g."partition", g."offset", CAST(g.keygroup * 4 // 128 AS INTEGER) AS slot,
       (SELECT min(m.virtual) FROM mapping m
        WHERE m.origin = g."partition" AND m.owner = g.keygroup * 4 // 128) AS virtual
FROM grouped g""",
    "route_rules": """
SELECT event_id, CASE WHEN regexp_matches(event_type, '^sign') AND regexp_matches(props, '1') THEN 'edge-one'
                      WHEN regexp_matches(event_type, 'i') THEN 'edge-two'
                      WHEN regexp_matches(props, '"k": [5-9]') THEN 'edge-three' ELSE 'core' END AS cluster
FROM events""",
    "route_key_text": """
SELECT event_id, CASE WHEN contains(event_type, 'chase') THEN 'edge-one' WHEN contains(event_type, 'e') THEN 'edge-two'
                      ELSE 'core' END AS cluster
FROM events""",
    "route_load": """
SELECT CASE WHEN regexp_matches(event_type, '^sign') AND regexp_matches(props, '1') THEN 'edge-one'
            WHEN regexp_matches(event_type, 'i') THEN 'edge-two'
            WHEN regexp_matches(props, '"k": [5-9]') THEN 'edge-three' ELSE 'core' END AS cluster,
       count(*) AS records, CAST(sum(strlen(event_type) + strlen(props)) AS BIGINT) AS bytes
FROM events GROUP BY 1""",
    "wordcount_all": f"SELECT word, count(*) AS num FROM (SELECT unnest({WORDS}) AS word FROM documents) GROUP BY word",
    "wordcount_two_inputs": f"""
SELECT word, count(*) AS num
FROM (SELECT unnest({WORDS}) AS word FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations))
GROUP BY word""",
    "wordcount_running": f"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS place, list_extract(ws, i) AS word,
       row_number() OVER (PARTITION BY list_extract(ws, i) ORDER BY doc_id, i) AS num
FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, {WORDS} AS ws FROM documents))""",
    "words_per_line": f"SELECT doc_id, len({WORDS}) AS num FROM documents",
    "metric_counter": _with(COUNTER) + "SELECT event_type, event_id, total FROM counter",
    "irate": _with(COUNTER, _rate("event_type", "counter", "total", 600)),
    "irate_resets": _with(_rate("user_id", "events", "CAST(round(value * 100) AS BIGINT)", 43200)),
    "elapsed": _with(SAMPLES) + """
SELECT run_id, variant, ts, value,
       round(date_diff('microsecond', min(ts) OVER (PARTITION BY run_id, variant), ts) / 1000000.0::DOUBLE, 6) AS elapsed
FROM samples""",
    "service_names": """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN concat('cpu_', event_type, '.', user_id % 3)
                      ELSE concat('{name="bench_', event_type, '.', user_id % 3, '"}') END AS series
FROM events""",
    "series_totals": _with(SAMPLES, HOURLY) + """
SELECT service, ts, CAST(sum(value) AS BIGINT) AS total FROM hourly GROUP BY service, ts""",
    "series_grand_total": _with(SAMPLES, HOURLY) + """
SELECT ts, CAST(sum(value) AS BIGINT) AS total FROM hourly GROUP BY ts""",
    "series_side_by_side": _with(SAMPLES, HOURLY) + """
SELECT ts, CAST(sum(value) FILTER (service = 'taskmanager') AS BIGINT) AS taskmanager,
       CAST(sum(value) FILTER (service = 'storage') AS BIGINT) AS storage,
       CAST(sum(value) FILTER (service = 'proxy') AS BIGINT) AS proxy,
       CAST(sum(value) FILTER (service = 'source') AS BIGINT) AS source
FROM hourly GROUP BY ts""",
    "warm_up_cut": _with(SAMPLES, _warm("run_id, variant")) + "SELECT run_id, variant, ts, service, value FROM cut",
    "expected_throughput": _with(SAMPLES) + f"""
SELECT DISTINCT run_id, round(throughput * parallelism * {SHARE}, 6) AS expected,
       round(throughput * parallelism * {SHARE} * 0.95::DOUBLE, 6) AS floor
FROM samples""",
    "above_floor": _with(SAMPLES, HOURLY, f"""
fast AS (
  SELECT run_id, variant, ts FROM hourly WHERE metric = 'tput' AND query NOT IN (2, 3)
  GROUP BY run_id, variant, ts, throughput, parallelism, query
  HAVING sum(value) > throughput * parallelism * {SHARE} * 0.95::DOUBLE)""") + """
SELECT run_id, variant, service, replica, ts, value FROM hourly
WHERE query IN (2, 3) OR (run_id, variant, ts) IN (SELECT (run_id, variant, ts) FROM fast)""",
    "stacked_series": _with(SAMPLES, HOURLY) + """
SELECT service, ts, CAST(sum(value) AS BIGINT) AS total FROM hourly GROUP BY service, ts
UNION ALL SELECT 'all', ts, CAST(sum(value) AS BIGINT) FROM hourly GROUP BY ts""",
    "role_usage": _with(SAMPLES, _usage("samples")) + """
SELECT run_id, variant, role, round(usage, 6) AS usage FROM usage""",
    "variant_compare": _with(SAMPLES, _warm("run_id, variant"), """
complete AS (SELECT run_id FROM cut GROUP BY run_id HAVING count(DISTINCT variant) = 2),
kept AS (SELECT * FROM cut WHERE run_id <> 5 AND run_id IN (SELECT run_id FROM complete))""", _usage("kept"), """
wide AS (
  SELECT query, parallelism, throughput, role, avg(usage) FILTER (variant = 'plain') AS plain,
         avg(usage) FILTER (variant = 'pushed') AS pushed
  FROM usage GROUP BY query, parallelism, throughput, role)""") + """
SELECT query, parallelism, throughput, role, round(plain, 6) AS plain, round(pushed, 6) AS pushed,
       round(CASE WHEN plain <> 0 THEN pushed / plain END, 6) AS ratio
FROM wide""",
    "job_role_means": _with(SAMPLES, """
matched AS (
  SELECT *, 'task' AS role FROM samples WHERE regexp_matches(service, '^task')
  UNION ALL SELECT *, 'proxy' FROM samples WHERE regexp_matches(service, 'prox')
  UNION ALL SELECT *, 'any' FROM samples),
sums AS (SELECT variant, role, ts, sum(value) AS s FROM matched GROUP BY variant, role, ts)""") + """
SELECT variant, role, round(avg(s), 6) AS mean_use FROM sums GROUP BY variant, role""",
}
# Length of the JSON text of a record's fields: names, quotes, commas and braces included.
FIELD_LENGTHS = {
    "bid": {n: f'length(CAST("{n}" AS VARCHAR))' for n in ("auction", "bidder", "price")} | {
        "dateTime": "28", "extra": """length(replace(extra, '"', '\\"')) + 2"""},
    "auction": {n: f'length(CAST("{n}" AS VARCHAR))' for n in ("id", "initialBid", "reserve", "seller", "category")} | {
        n: f'length("{n}") + 2' for n in ("itemName", "description", "extra")} | {"expires": "28", "dateTime": "28"},
    "person": {"id": "length(CAST(id AS VARCHAR))", "dateTime": "28"} | {
        n: f'length("{n}") + 2' for n in ("name", "emailAddress", "creditCard", "city", "state", "extra")},
}
KEYS = {"bid": "auction", "auction": "id", "person": "id"}


def _savings(query: str, topic: str, names: str, kept: str = "TRUE") -> str:
    lengths = FIELD_LENGTHS[topic]

    def size(fields):
        fixed = sum(len(f) + 3 for f in fields) + len(fields) - 1 + 2
        return " + ".join([str(fixed), *(lengths[f] for f in fields)])

    key = f"length(CAST({KEYS[topic]} AS VARCHAR))"
    return f"""
SELECT '{query}' AS query, '{topic}' AS topic, count(*) AS records, count(*) FILTER (kept) AS kept,
       count(*) FILTER (NOT kept) AS removed, CAST(sum(r) AS BIGINT) AS bytes_read,
       CAST(sum(CASE WHEN kept THEN s ELSE 0 END) AS BIGINT) AS bytes_sent,
       CAST(sum(r) - sum(CASE WHEN kept THEN s ELSE 0 END) AS BIGINT) AS bytes_saved
FROM (SELECT {kept} AS kept, {key} + {size(list(lengths))} AS r, {key} + {size(names.split())} AS s FROM {topic})"""


ORACLE["pushdown_savings"] = _with(BID, AUCTION, PERSON) + "UNION ALL".join([
    _savings("q0", "bid", "auction bidder price dateTime"),
    _savings("q1", "bid", "auction bidder price dateTime extra"),
    _savings("q2", "bid", "auction price", f"auction IN {HOT}"),
    _savings("q3", "auction", "id seller", "category = 10"),
    _savings("q3", "person", "id name city state", f"state IN ({LOCAL})"),
    _savings("q5", "bid", "auction dateTime"),
    _savings("q8", "person", "id name dateTime"),
    _savings("q8", "auction", "seller dateTime"),
    _savings("q11", "bid", "bidder dateTime"),
])
for _query in ("q0", "q1", "q2", "q3", "q5", "q8", "q11"):
    ORACLE[f"pushed_{_query}"] = ORACLE[_query]
ORACLE["unpushed_q3"], ORACLE["unpushed_q5"] = ORACLE["q3"], ORACLE["q5"]
ORACLE["by_virtual_partition"] = f"""
SELECT "partition", "offset", virtual, TRUE AS in_place FROM ({ORACLE["deal_out"]}) WHERE virtual IS NOT NULL"""
ORACLE["virtuals_by_origin"] = _with(BID, RECORDS, ORIGIN_OWNER) + """
SELECT origin, virtual FROM mapping WHERE origin IN (SELECT "partition" FROM records)"""
ORACLE["usage_by_pattern"] = ORACLE["role_usage"]
ORACLE["wordcount_rebalanced"] = ORACLE["wordcount_all"]
ORACLE["q3_strkey"] = ORACLE["q3"]
ORACLE["q3_incremental_strkey"] = ORACLE["q3_incremental"]

ORACLE |= {
    "slot_layout": ORACLE["slot_filter"],
    "results_csv": ORACLE["q2"],
    "cluster_use": f"""
SELECT cluster, CAST(count(r.event_id) AS BIGINT) AS records
FROM (SELECT unnest(['core', 'edge-local', 'spare', 'edge-one', 'edge-two', 'edge-three']) AS cluster) LEFT JOIN ({ORACLE["route_rules"]}) r
USING (cluster) GROUP BY cluster""",
    "stream_q5_counts_monotonic": ORACLE["q5_counts"],
    "stream_pushed_q1": ORACLE["q1"],
    "stream_scan_savings": f"""
SELECT * EXCLUDE (topic), TRUE AS several_batches FROM ({ORACLE["scan_savings"]})""",
    "stream_latency": "SELECT count(*) AS rows, TRUE AS several_batches, TRUE AS ordered FROM events",
    "stream_late_rows": _with(BID, LATE) + 'SELECT event_id, auction, bidder, "dateTime", slice FROM judged WHERE late',
    "stream_in_time_counts": _with(BID, LATE) + """
SELECT auction, CAST(count(*) AS BIGINT) AS num FROM judged WHERE NOT late GROUP BY auction, window_end""",
    "stream_pushed_q3": ORACLE["q3"],
    "stream_pushed_q5": ORACLE["q5"],
    "stream_pushed_q8": ORACLE["q8"],
    "stream_pushed_q11": ORACLE["q11"],
    "stream_q0": ORACLE["q0"],
    "stream_q1": ORACLE["q1"],
    "stream_q1_float": ORACLE["q1_float"],
    "stream_q2_modulo": ORACLE["q2_modulo"],
    "stream_q5_strkey": ORACLE["q5_strkey"],
    "stream_q11_composite": ORACLE["q11_composite"],
    "stream_wordcount_two_inputs": ORACLE["wordcount_two_inputs"],
    "stream_q2": ORACLE["q2"],
    "stream_q3": ORACLE["q3"],
    "stream_q3_incremental": ORACLE["q3_incremental"],
    "stream_q3_versions": ORACLE["q3_versions"],
    "stream_q5": ORACLE["q5"],
    "stream_q5_counts": ORACLE["q5_counts"],
    "stream_q8": ORACLE["q8"],
    "stream_q8_pairs": ORACLE["q8_pairs"],
    "stream_q11": ORACLE["q11"],
    "stream_q11_early": ORACLE["q11_early"],
    "stream_wordcount_running": f"""
SELECT word, row_number() OVER (PARTITION BY word) AS num FROM (SELECT unnest({WORDS}) AS word FROM documents)""",
    "stream_wordcount": ORACLE["wordcount_all"],
}
