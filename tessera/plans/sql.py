"""Queries in SQL: SAME runs in either engine as it stands, PAIRS has the Spark text and the oracle's."""

from __future__ import annotations

SAME: dict[str, str] = {
    "tpch_q1": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
        round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "tpch_q3": """SELECT l_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""",
    "tpch_q4": """SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority""",
    "tpch_q5": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""",
    "tpch_q6": """SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00' AND l_discount BETWEEN 0.02 AND 0.06 AND l_quantity < 24""",
    "tpch_q10": """SELECT c_custkey, c_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS lost FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, n_name ORDER BY lost DESC, c_custkey LIMIT 20""",
    "tpch_q12": """SELECT l_linestatus, count(CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 1 END) AS high, count(CASE WHEN o_orderpriority NOT LIKE '1%' AND o_orderpriority NOT LIKE '2%' THEN 1 END) AS low
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_linestatus""",
    "tpch_q13": """SELECT n_orders, count(*) AS n_customers FROM (SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus <> 'P' GROUP BY c_custkey) c GROUP BY n_orders""",
    "tpch_q14": """SELECT round(100 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "tpch_q18": """SELECT o_orderkey, o_custkey, round(sum(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150) GROUP BY o_orderkey, o_custkey""",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_size BETWEEN 5 AND 20",
    "correlated_scalar": "SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "not_exists": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "not_in_nulls": """SELECT 'null in the list' AS what, count(*) AS n FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN s_nationkey > 20 THEN NULL ELSE s_nationkey END FROM supplier)
        UNION ALL SELECT 'null asked for', count(*) FROM (SELECT CASE WHEN n_nationkey = 3 THEN NULL ELSE n_nationkey END AS k FROM nation) t WHERE k NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey > 12)
        UNION ALL SELECT 'empty list', count(*) FROM (SELECT CASE WHEN n_nationkey = 3 THEN NULL ELSE n_nationkey END AS k FROM nation) t WHERE k NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey < 0)""",
    "join_left": "SELECT o_orderkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R'",
    "join_right": "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'P'",
    "join_full": "SELECT o_orderkey, l_orderkey, l_quantity FROM orders FULL JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R'",
    "join_semi": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_theta": "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey",
    "join_interval": "SELECT a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '2' HOUR",
    "join_hint_broadcast": "SELECT /*+ BROADCAST(n) */ s_suppkey, n_name FROM supplier s JOIN nation n ON s_nationkey = n_nationkey",
    "join_hint_merge": "SELECT /*+ MERGE(o) */ c_custkey, o_orderkey FROM customer c JOIN orders o ON c_custkey = o_custkey",
    "join_hint_hash": "SELECT /*+ SHUFFLE_HASH(c) */ c_custkey, o_orderkey FROM customer c JOIN orders o ON c_custkey = o_custkey",
    "join_hint_replicate": "SELECT /*+ SHUFFLE_REPLICATE_NL(n) */ r_name, n_name FROM region r JOIN nation n ON r_regionkey = n_regionkey",
    "having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "aggregate_filter": "SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, count(*) AS n FROM events GROUP BY event_type",
    "distinct_counts": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag",
    "max_by": "SELECT o_custkey, max_by(o_totalprice, o_orderkey) AS last_price, min_by(o_orderpriority, o_orderkey) AS first_priority FROM orders GROUP BY o_custkey",
    "bool_aggregates": "SELECT l_returnflag, l_linestatus, bool_and(l_quantity < 50) AS all_below, bool_or(l_discount > 0.09) AS any_high FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "window_nth": "SELECT event_id, nth_value(event_id, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS third FROM events",
    "window_lag": "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after2, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_id FROM events",
    "window_rows": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 6) AS moving FROM events",
    "window_range": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '6' HOUR PRECEDING AND CURRENT ROW) AS recent FROM events",
    "limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "set_intersect": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal < 3000",
    "set_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "set_except": "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey < 12",
    "set_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "strings": "SELECT p_partkey, upper(p_name) AS u, substring(p_name, 2, 4) AS s, replace(p_brand, 'Brand', 'B') AS b, trim(p_type) AS t, reverse(p_name) AS r, lpad(p_brand, 12, '*') AS lp, left(p_type, 3) AS l3, translate(p_name, 'aeiou', '12345') AS tr, md5(lower(p_name)) AS h FROM part",
    "dates": "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(quarter(o_orderdate) AS INT) AS q, CAST(dayofyear(o_orderdate) AS INT) AS d, CAST(last_day(o_orderdate) AS DATE) AS e FROM orders",
    "rounding": "SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) AS f, CAST(ceil(l_extendedprice) AS BIGINT) AS c, CAST(sign(l_discount - 0.05) AS INT) AS s, CAST(floor(sqrt(l_quantity)) AS BIGINT) AS q, greatest(l_discount, l_tax) AS g, least(l_discount, l_tax) AS l, coalesce(nullif(l_linenumber, 1), 0) AS n FROM lineitem",
    "math": "SELECT l_orderkey, l_linenumber, round(exp(l_discount), 8) AS e, round(ln(l_quantity + 1), 8) AS n, round(pow(l_quantity, 2), 4) AS p, abs(l_tax - 0.05) AS a, l_orderkey % 7 AS m FROM lineitem",
}

PAIRS: dict[str, tuple[str, str]] = {
    "grouping_sets": (
        "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INT) AS g, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
        "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INT) AS g, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    ),
    "cube": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",) * 2,
    "rollup": ("SELECT n_regionkey, n_name, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_name)",) * 2,
    "pivot": (
        "SELECT * FROM (SELECT o_orderpriority AS priority, o_orderstatus FROM orders) PIVOT (count(*) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))",
        "SELECT o_orderpriority AS priority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY 1",
    ),
    "unpivot": (
        "SELECT p_partkey, what, n FROM (SELECT p_partkey, p_size AS a, CAST(p_partkey % 5 AS INT) AS b FROM part) UNPIVOT (n FOR what IN (a, b))",
        "SELECT p_partkey, 'a' AS what, p_size AS n FROM part UNION ALL SELECT p_partkey, 'b', CAST(p_partkey % 5 AS INT) FROM part",
    ),
    "window_ranks": (
        "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, ntile(4) OVER w AS nt, round(percent_rank() OVER v, 8) AS pr, round(cume_dist() OVER v, 8) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)",
        "SELECT o_orderkey, CAST(row_number() OVER w AS INT) AS rn, CAST(rank() OVER v AS INT) AS rk, CAST(dense_rank() OVER v AS INT) AS dr, CAST(ntile(4) OVER w AS INT) AS nt, round(percent_rank() OVER v, 8) AS pr, round(cume_dist() OVER v, 8) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)",
    ),
    "listagg": (
        "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    ),
    "variant": (
        "SELECT event_id, variant_get(parse_json(props), '$.k', 'int') AS k, schema_of_variant(parse_json(props)) AS of_variant, schema_of_json('{\"k\": 1}') AS of_json, is_variant_null(parse_json(props)) AS none FROM events",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, 'OBJECT<k: BIGINT>' AS of_variant, 'STRUCT<k: BIGINT>' AS of_json, FALSE AS none FROM events",
    ),
    "xml_parse": (
        "SELECT x.k, x.b, x.l[1] AS second, to_xml(named_struct('id', x.k)) LIKE '%<id>%' AS back FROM (SELECT from_xml(concat('<p><k>', p_partkey, '</k><b>', p_brand, '</b><l>1</l><l>', p_size, '</l></p>'), 'k BIGINT, b STRING, l ARRAY<INT>') AS x FROM part) t",
        "SELECT p_partkey AS k, p_brand AS b, p_size AS second, TRUE AS back FROM part",
    ),
    "recursive_cte": (
        "WITH RECURSIVE t(k, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey = 0 UNION ALL SELECT p_partkey, depth + 1 FROM t JOIN part ON p_partkey > 0 AND (p_partkey - 1) div 7 = k) SELECT depth, count(*) AS n, min(k) AS first_key FROM t GROUP BY depth",
        "WITH RECURSIVE t(k, depth) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey = 0 UNION ALL SELECT p_partkey, depth + 1 FROM t JOIN part ON p_partkey > 0 AND (p_partkey - 1) // 7 = k) SELECT depth, count(*) AS n, min(k) AS first_key FROM t GROUP BY depth",
    ),
    "json": (
        "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
    ),
    "arrays": (
        "SELECT vec_id, size(embedding) AS n, round(CAST(array_max(embedding) AS DOUBLE), 5) AS top, round(CAST(embedding[0] AS DOUBLE), 5) AS first_value FROM embeddings",
        "SELECT vec_id, CAST(len(embedding) AS INT) AS n, round(CAST(list_max(embedding) AS DOUBLE), 5) AS top, round(CAST(embedding[1] AS DOUBLE), 5) AS first_value FROM embeddings",
    ),
    "explode": (
        "SELECT word, count(*) AS n FROM (SELECT explode(split(p_name, ' ')) AS word FROM part) w GROUP BY word",
        "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) w GROUP BY word",
    ),
    "time_windows": (
        "SELECT CAST(window(ts, '6 hours').start AS TIMESTAMP_NTZ) AS start, event_type, count(*) AS n FROM events GROUP BY window(ts, '6 hours'), event_type",
        "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    ),
    "filter_rlike": (
        "SELECT p_partkey, p_name FROM part WHERE p_name RLIKE '^[a-m].*e' AND NOT p_type RLIKE '(?i)promo'",
        "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[a-m].*e') AND NOT regexp_matches(p_type, '(?i)promo')",
    ),
    "posexplode": (
        "SELECT p_partkey, pos, word FROM part LATERAL VIEW posexplode(split(p_name, ' ')) w AS pos, word",
        "SELECT p_partkey, CAST(i - 1 AS INT) AS pos, string_split(p_name, ' ')[i] AS word FROM (SELECT p_partkey, p_name, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part) w",
    ),
    "explode_outer": (
        "SELECT p_partkey, word FROM part LATERAL VIEW OUTER explode(filter(split(p_name, ' '), w -> length(w) > 6)) v AS word",
        "SELECT p_partkey, word FROM part LEFT JOIN (SELECT p_partkey AS k, unnest(list_filter(string_split(p_name, ' '), lambda w: length(w) > 6)) AS word FROM part) v ON k = p_partkey",
    ),
    "pipe_syntax": (
        "FROM orders |> WHERE o_orderstatus = 'F' |> EXTEND o_totalprice * 2 AS twice |> AGGREGATE count(*) AS n, round(sum(twice), 2) AS total GROUP BY o_orderpriority |> ORDER BY n DESC",
        "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice * 2), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority",
    ),
    "moments": (
        "SELECT l_returnflag, round(skewness(l_extendedprice), 6) AS skew, round(kurtosis(l_extendedprice), 6) AS kurt FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, round(avg(d * d * d) / pow(avg(d * d), 1.5), 6) AS skew, round(avg(d * d * d * d) / pow(avg(d * d), 2) - 3, 6) AS kurt FROM (SELECT l_returnflag, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_returnflag) AS d FROM lineitem) t GROUP BY l_returnflag",
    ),
    "ordered_set": (
        "SELECT o_custkey, array_join(array_sort(collect_set(o_orderpriority)), ',') AS priorities FROM orders GROUP BY o_custkey",
        "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey",
    ),
    "mode": (
        "SELECT o_custkey, mode() WITHIN GROUP (ORDER BY o_orderpriority) AS usual FROM orders GROUP BY o_custkey",
        "SELECT o_custkey, o_orderpriority AS usual FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS r FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) c) t WHERE r = 1",
    ),
    "hll_union": (
        "WITH s AS (SELECT l_returnflag, hll_sketch_agg(l_partkey, 14) AS k FROM lineitem GROUP BY l_returnflag), e AS (SELECT count(DISTINCT l_partkey) AS n FROM lineitem) SELECT n, abs((SELECT hll_sketch_estimate(hll_union_agg(k)) FROM s) - n) <= 0.04 * n AS near FROM e",
        "SELECT count(DISTINCT l_partkey) AS n, TRUE AS near FROM lineitem",
    ),
    "approx_percentile": (
        "WITH q AS (SELECT l_returnflag AS flag, approx_percentile(l_extendedprice, 0.75, 1000) AS v FROM lineitem GROUP BY l_returnflag) SELECT flag, abs(avg(CASE WHEN l_extendedprice <= v THEN 1.0D ELSE 0.0D END) - 0.75D) <= 0.005D AS near FROM q JOIN lineitem ON l_returnflag = flag GROUP BY flag",
        "SELECT DISTINCT l_returnflag AS flag, TRUE AS near FROM lineitem",
    ),
    "more_strings": (
        "SELECT p_partkey, instr(p_name, 'a') AS i, repeat(p_brand, 2) AS r, split_part(p_name, ' ', 1) AS w, concat(p_name, '-', p_brand) AS c, array_join(regexp_extract_all(p_name, '([aeiou])', 1), '') AS v, regexp_extract(p_type, '^(\\\\w+)', 1) AS first_word, concat_ws('/', p_brand, p_type) AS j, ascii(p_name) AS a, char_length(p_name) AS n FROM part",
        "SELECT p_partkey, CAST(instr(p_name, 'a') AS INT) AS i, repeat(p_brand, 2) AS r, split_part(p_name, ' ', 1) AS w, concat(p_name, '-', p_brand) AS c, array_to_string(regexp_extract_all(p_name, '([aeiou])', 1), '') AS v, regexp_extract(p_type, '^(\\w+)', 1) AS first_word, concat_ws('/', p_brand, p_type) AS j, CAST(ascii(p_name) AS INT) AS a, CAST(length(p_name) AS INT) AS n FROM part",
    ),
    "more_dates": (
        "SELECT o_orderkey, day(o_orderdate) AS d, weekofyear(o_orderdate) AS w, CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS m, datediff(o_orderdate, DATE '1995-01-01') AS n, date_format(o_orderdate, 'yyyy-MM-dd') AS f, CAST(add_months(o_orderdate, 1) AS DATE) AS a, CAST(date_add(o_orderdate, 45) AS DATE) AS p, CAST(months_between(date_trunc('MONTH', o_orderdate), DATE '1995-01-01') AS INT) AS b FROM orders",
        "SELECT o_orderkey, CAST(day(o_orderdate) AS INT) AS d, CAST(weekofyear(o_orderdate) AS INT) AS w, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS n, strftime(o_orderdate, '%Y-%m-%d') AS f, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS a, CAST(o_orderdate AS DATE) + 45 AS p, CAST(date_diff('month', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS b FROM orders",
    ),
    "more_arrays": (
        "SELECT p_partkey, array_join(slice(split(p_name, ' '), 1, 2), '+') AS two, array_contains(split(p_type, ' '), 'PROMO') AS promo, array_join(transform(split(p_name, ' '), w -> upper(w)), ' ') AS up, size(filter(split(p_name, ' '), w -> length(w) > 4)) AS long_words, aggregate(split(p_name, ' '), 0, (s, w) -> s + length(w)) AS letters, exists(split(p_name, ' '), w -> w LIKE 'b%') AS any_b, array_join(array_distinct(split(p_name, '')), '') AS letters_once FROM part",
        "SELECT p_partkey, array_to_string(string_split(p_name, ' ')[1:2], '+') AS two, list_contains(string_split(p_type, ' '), 'PROMO') AS promo, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w)), ' ') AS up, CAST(len(list_filter(string_split(p_name, ' '), lambda w: length(w) > 4)) AS INT) AS long_words, CAST(length(replace(p_name, ' ', '')) AS INT) AS letters, len(list_filter(string_split(p_name, ' '), lambda w: starts_with(w, 'b'))) > 0 AS any_b, (SELECT string_agg(c, '' ORDER BY i) FROM (SELECT c, min(i) AS i FROM (SELECT unnest(string_split(p_name, '')) AS c, generate_subscripts(string_split(p_name, ''), 1) AS i) t GROUP BY c) u) AS letters_once FROM part",
    ),
    "json_parse": (
        "SELECT event_id, from_json(props, 'k INT').k AS k, t.k2, array_join(map_keys(from_json(props, 'MAP<STRING, STRING>')), ',') AS names, to_json(named_struct('id', event_id)) AS j FROM events LATERAL VIEW json_tuple(props, 'k') t AS k2",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, json_extract_string(props, '$.k') AS k2, array_to_string(json_keys(props), ',') AS names, '{\"id\":' || event_id || '}' AS j FROM events",
    ),
    "maps": (
        "SELECT p_partkey, map_filter(m, (k, v) -> v > 3)['b'] AS b, size(map_filter(m, (k, v) -> v > 3)) AS n, transform_values(m, (k, v) -> v * 10)['a'] AS ten, array_join(array_sort(map_keys(m)), ',') AS names, map_contains_key(m, 'c') AS has_c FROM (SELECT p_partkey, map('a', p_size, 'b', CAST(p_partkey % 7 AS INT)) AS m FROM part) t",
        "SELECT p_partkey, CASE WHEN p_partkey % 7 > 3 THEN CAST(p_partkey % 7 AS INT) END AS b, CAST(p_size > 3 AS INT) + CAST(p_partkey % 7 > 3 AS INT) AS n, p_size * 10 AS ten, 'a,b' AS names, FALSE AS has_c FROM part",
    ),
    "digests": (
        "SELECT p_partkey, sha2(p_name, 256) AS h, sha1(p_name) AS s, bit_count(p_partkey) AS bits, hex(p_partkey) AS x, base64(encode(p_brand, 'UTF-8')) AS b, xpath_string(concat('<a><b>', p_partkey, '</b></a>'), 'a/b') AS inner_text, crc32(p_name) >= 0 AS c FROM part",
        "SELECT p_partkey, sha256(p_name) AS h, sha1(p_name) AS s, CAST(bit_count(p_partkey) AS INT) AS bits, hex(p_partkey) AS x, base64(encode(p_brand)) AS b, CAST(p_partkey AS VARCHAR) AS inner_text, TRUE AS c FROM part",
    ),
    "urls": (
        "SELECT page_id, parse_url(url, 'HOST') AS host, parse_url(url, 'PROTOCOL') AS scheme, url_decode(url_encode(url)) = url AS same FROM pages",
        "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, TRUE AS same FROM pages",
    ),
    "sliding_windows": (
        "SELECT CAST(window(ts, '12 hours', '6 hours').start AS TIMESTAMP_NTZ) AS start, count(*) AS n FROM events GROUP BY window(ts, '12 hours', '6 hours')",
        "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01'), time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01') - INTERVAL '6 hours']) AS start FROM events) t GROUP BY start",
    ),
    "session_windows": (
        "SELECT user_id, CAST(session_window(ts, '1 hour').start AS TIMESTAMP_NTZ) AS start, count(*) AS n FROM events GROUP BY user_id, session_window(ts, '1 hour')",
        "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN ts - before < INTERVAL '1 hour' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) e) t GROUP BY user_id, s",
    ),
}
