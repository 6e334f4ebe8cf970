"""DuckDB twins of the catalogue's queries."""

from __future__ import annotations

IMPORTS = """
imports AS (
  SELECT n_name AS country, {commodity} AS commodity, l_extendedprice AS value
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
    JOIN nation ON n_nationkey = c_nationkey JOIN part ON p_partkey = l_partkey
)"""
TYPES, BRANDS = IMPORTS.format(commodity="p_type"), IMPORTS.format(commodity="p_brand")
ROLLUP = TYPES + """, rolled AS (
  SELECT country, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total, count(DISTINCT commodity) AS n_commodities FROM imports GROUP BY country
)"""
SALES = "sales AS (SELECT o_orderkey AS sale, o_orderdate AS sold_at, o_orderpriority AS payment, o_totalprice AS total FROM orders)"
ODD_SALES = """
sales AS (
  SELECT o_orderkey AS sale, o_orderdate AS sold_at, o_totalprice AS total,
    CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Valor a Pagar' WHEN 3 THEN 'Valor a pagar R$:' ELSE o_orderpriority END AS payment
  FROM orders
)"""
CLEAN = """
cleaned AS (
  SELECT sale, sold_at, total, CASE WHEN payment = 'Valor a pagar R$:' THEN 'Não Especificado' ELSE payment END AS payment
  FROM sales WHERE payment IS DISTINCT FROM '' AND payment IS DISTINCT FROM 'Valor a Pagar'
)"""
MONEY = "coalesce(CAST(sum(CAST(total AS DECIMAL(18, 2))) AS DOUBLE), 0)"
# The double nearest to the sum of doubles that are multiples of 2**-52: sums of integers, rounded by reading their text.
EXACT = "CAST(CAST(sum(CAST({} * 4503599627370496 AS HUGEINT)) AS VARCHAR) AS DOUBLE) / 4503599627370496"
TAXES = "taxes AS (SELECT 'L' || l_linenumber AS country, l_returnflag AS commodity, l_extendedprice * l_tax AS value FROM lineitem)"
IN_RANGE = "sold_at >= TIMESTAMP '1996-01-01' AND sold_at <= TIMESTAMP '1997-12-31'"
REGISTRY = """
registry AS (
  SELECT 'https://receipts.example/' || o_custkey AS url, lpad(CAST(o_orderkey AS VARCHAR), 44, '0') AS access_key, o_orderdate AS read_at
  FROM orders
)"""
SCANS = """
scans AS (
  SELECT 'https://receipts.example/' || o_custkey || '?k=' || lpad(CAST(o_orderkey AS VARCHAR), 44, '0') AS url, lpad(CAST(o_orderkey AS VARCHAR), 44, '0') AS access_key
  FROM orders
), fresh AS (
  SELECT min(url) AS url, access_key FROM scans
  WHERE access_key NOT IN (SELECT access_key FROM registry WHERE read_at < TIMESTAMP '1998-01-01') GROUP BY access_key
)"""
ITEMS = """
items AS (
  SELECT lpad(CAST(l_orderkey AS VARCHAR), 44, '0') AS access_key, l_orderkey,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, 'P' || l_partkey, 'Qtde.:' || CAST(l_quantity AS INT)) AS line_no,
    'P' || l_partkey AS product, l_quantity AS quantity, CAST(printf('%.2f', l_extendedprice) AS DOUBLE) AS unit_price, CAST(printf('%.2f', l_extendedprice) AS DOUBLE) AS item_total
  FROM lineitem
)"""
NOTES = """
notes AS (
  SELECT lpad(CAST(o_orderkey AS VARCHAR), 44, '0') AS access_key, o_orderkey, o_orderdate AS sold_at, o_orderpriority AS payment,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(printf('%.2f', o_totalprice) AS DOUBLE) END AS total, o_orderkey % 5 = 0 AS bad
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
)"""
MESSAGES = """
messages AS (
  SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'nope' WHEN 1 THEN '' WHEN 2 THEN '[1, 2]' WHEN 3 THEN '{"k": 1, "received_at": "x"}' ELSE props END AS payload
  FROM events
)"""
WORDS = "event_id, 28 AS framelen, " + ", ".join(
    f"CAST((event_id * {i + 1} + user_id) % 65536 AS INT) AS {name}"
    for i, name in enumerate(
        "pm10_standard pm25_standard pm100_standard pm10_env pm25_env pm100_env particles_03um particles_05um particles_10um particles_25um "
        "particles_50um particles_100um".split()
    )
)
BYTES = " + ".join(f"{w} // 256 + {w} % 256" for w in [x.split()[-1] for x in WORDS.split(", ")[1:]])
PROFILES = """
answers AS (
  SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'S' ELSE 'n' END AS r1, CASE WHEN c_acctbal < 0 THEN 'S' ELSE 'N' END AS r2,
    CASE WHEN c_custkey % 9 = 0 THEN 'maybe' WHEN c_mktsegment > 'FURN' THEN 'S' ELSE 'n' END AS r3 FROM customer
), points AS (
  SELECT *, CASE WHEN r3 <> 'maybe' THEN CAST(r1 = 'S' AS INT) + CAST(r2 = 'N' AS INT) + CAST(r3 = 'S' AS INT) END AS points FROM answers
), profiles AS (
  SELECT *, CASE WHEN points >= 2 THEN 'Conservador' WHEN points = 1 THEN 'Moderado' WHEN points = 0 THEN 'Ousado' END AS profile FROM points
)"""
RECOMMENDED = """(VALUES
  ('Conservador', 1, 'Ouro'), ('Conservador', 2, 'Alimentos básicos'), ('Conservador', 3, 'Energia (petróleo estável)'),
  ('Moderado', 1, 'Soja'), ('Moderado', 2, 'Minério de ferro'), ('Moderado', 3, 'Gás natural'),
  ('Ousado', 1, 'Petróleo'), ('Ousado', 2, 'Metais raros'), ('Ousado', 3, 'Commodities com variação cambial')
) AS r(profile, place, item)"""

SQL = {
    "import_ranking_top10": f"""WITH {ROLLUP}
        SELECT row_number() OVER (ORDER BY total DESC, country) AS rank, country, total, n_commodities FROM rolled ORDER BY total DESC, country LIMIT 10""",
    "import_ranking_lines": f"""WITH {ROLLUP}, r AS (SELECT row_number() OVER (ORDER BY total DESC, country) AS rank, * FROM rolled ORDER BY total DESC, country LIMIT 5)
        SELECT rank, rank || 'º - ' || country || ': €' || format('{{:,.2f}}', total) || ' mil euros - ' || n_commodities || ' commodities' AS line FROM r""",
    "country_rollup": f"""WITH {TYPES}
        SELECT country, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total, count(DISTINCT commodity) AS n_commodities,
          array_to_string(list_sort(list(DISTINCT commodity)), '|') AS commodities FROM imports GROUP BY country""",
    "first_commodities": f"""WITH {TYPES}, f AS (SELECT country, commodity, min(value) AS first FROM imports GROUP BY ALL)
        SELECT country, string_agg(commodity, '|' ORDER BY first, commodity) AS commodities FROM f GROUP BY country""",
    "country_lookup": f"WITH {ROLLUP} SELECT country, true AS found, total, n_commodities FROM rolled WHERE country = 'NATION_7' UNION ALL SELECT 'NATION_7', false, NULL, NULL WHERE NOT EXISTS (FROM rolled WHERE country = 'NATION_7')",
    "country_lookup_missing": "SELECT 'nation_7' AS country, false AS found, CAST(NULL AS DOUBLE) AS total, CAST(NULL AS BIGINT) AS n_commodities",
    "country_commodities": f"WITH {BRANDS} SELECT DISTINCT country, commodity FROM imports WHERE country = 'NATION_7'",
    "countries_by_commodity": f"WITH {BRANDS} SELECT DISTINCT country FROM imports WHERE commodity = 'Brand#12'",
    "stored_commodity_lookup": f"WITH {BRANDS} SELECT DISTINCT commodity AS asked, country FROM imports WHERE commodity IN ('Brand#12', 'Brand#121')",
    "country_commodity_counts": f"WITH {TYPES} SELECT country, count(DISTINCT commodity) AS n_commodities FROM imports GROUP BY country",
    "region_commodity_counts": f"""WITH {TYPES}
        SELECT r_name AS region, count(DISTINCT commodity) AS n_commodities FROM imports JOIN nation ON n_name = country JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""",
    "import_value_guard": """
        WITH t AS (
          SELECT l_returnflag AS country, l_linestatus AS commodity, CAST(l_quantity AS INT) AS q, l_linenumber AS n FROM lineitem
        ), v AS (SELECT country, commodity, CASE WHEN n = 4 THEN q + 0.5 WHEN n NOT IN (1, 2, 3, 5, 6) THEN q * 10 END AS value FROM t)
        SELECT country, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total, count(DISTINCT commodity) AS n_commodities FROM v WHERE value IS NOT NULL GROUP BY country""",
    "import_fine_values": """
        SELECT l_returnflag AS country, 'large' AS commodity, count(*) * 1e17 AS total FROM lineitem WHERE l_linenumber = 1 GROUP BY 1
        UNION ALL SELECT l_returnflag, 'fine', sum(CAST(l_quantity AS INT)) / 10000 FROM lineitem WHERE l_linenumber <> 1 GROUP BY 1""",
    "import_csv_permissive": """
        SELECT l_returnflag AS country, sum(CAST(l_quantity AS INT) * 2 + 1) / 2 AS total, count(DISTINCT l_linestatus) AS n_commodities FROM lineitem WHERE l_linenumber NOT IN (1, 2) GROUP BY 1
        UNION ALL SELECT 'rejected', NULL, count(*) FROM lineitem WHERE l_linenumber IN (1, 2)""",
    "import_csv_strict": """
        SELECT l_returnflag AS country, sum(CASE WHEN l_linenumber = 1 THEN 18 ELSE CAST(l_quantity AS INT) * 2 + 1 END) / 2 AS total,
          array_to_string(list_sort(list(DISTINCT l_linestatus || ', "q"')), '|') AS commodities FROM lineitem GROUP BY 1""",
    "import_csv_line_breaks": """
        SELECT l_returnflag AS country, sum(CAST(l_quantity AS INT) * 2 + 1) / 2 AS total,
          array_to_string(list_sort(list(DISTINCT l_linestatus || chr(10) || '"q"')), '|') AS commodities FROM lineitem GROUP BY 1""",
    "sales_report": f"""WITH sales AS (
          SELECT o_orderkey AS sale, o_orderdate + INTERVAL 29 YEAR AS sold_at, o_orderpriority AS payment, o_totalprice AS total FROM orders
          WHERE o_orderdate + INTERVAL 29 YEAR >= TIMESTAMP '2024-03-01' AND o_orderdate + INTERVAL 29 YEAR <= TIMESTAMP '2025-11-21'), {CLEAN}
        SELECT 'metrics' AS part, 'total' AS key, {MONEY} AS value FROM sales
        UNION ALL SELECT 'metrics', 'n', CAST(count(*) AS DOUBLE) FROM sales
        UNION ALL SELECT 'metrics', 'mean', {MONEY} / count(*) FROM sales
        UNION ALL SELECT 'day', CAST(CAST(sold_at AS DATE) AS VARCHAR), {MONEY} FROM cleaned GROUP BY 2
        UNION ALL SELECT 'week', CAST(week(sold_at) AS VARCHAR), {MONEY} FROM cleaned GROUP BY 2
        UNION ALL SELECT 'month', CAST(month(sold_at) AS VARCHAR), {MONEY} FROM cleaned GROUP BY 2
        UNION ALL SELECT 'payment', payment, {MONEY} FROM cleaned WHERE payment IS NOT NULL GROUP BY 2""",
    "repeated_key_gate": """
        SELECT event_id, CASE event_id % 4 WHEN 0 THEN 201 ELSE 400 END AS status_code,
          CASE event_id % 4 WHEN 0 THEN 'Dados recebidos e armazenados com sucesso!' WHEN 3 THEN 'Campo ''umidade_solo'' ausente no JSON' ELSE 'not a JSON object' END AS message FROM events""",
    "answered_posts": """
        WITH h AS (
          SELECT event_id, sha1(unhex('501a3985f6815aa285a05dfed9cdc8e4') || encode('{"event_id":' || event_id || '}')) AS h FROM events)
        SELECT event_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', CAST(strpos('0123456789abcdef', h[17]) - 1 AS INT) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS id,
          '{"temperatura": ' || event_id || ', "umidade_ar": null, "umidade_solo": 3, "dataRegistro": "2024-05-06 07:08:09"}' AS dados FROM h""",
    "telemetry_stamp": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS received_at, 'x' AS sent FROM events",
    "packet_messages": f"""WITH {MESSAGES}, k AS (
          SELECT payload, CASE WHEN NOT coalesce(json_valid(payload), false) THEN 'not JSON' WHEN event_id % 10 = 2 THEN 'not an object' ELSE 'good' END AS kind FROM messages WHERE event_id % 3 <> 0)
        SELECT 'sensores/ar' AS topic, kind, count(*) AS n, CAST(sum(CASE WHEN kind = 'good' THEN CAST(CASE WHEN json_valid(payload) THEN payload ELSE '{{}}' END ->> '$.k' AS BIGINT) END) AS BIGINT) AS k FROM k GROUP BY kind""",
    "packet_stream": f"""WITH {MESSAGES}, k AS (
          SELECT CASE WHEN NOT coalesce(json_valid(payload), false) THEN 'not JSON' WHEN event_id % 10 = 2 THEN 'not an object' END AS error_kind FROM messages)
        SELECT CASE WHEN error_kind IS NULL THEN 'good' ELSE 'dead' END AS outcome, error_kind, count(*) AS n FROM k GROUP BY ALL""",
    "pms_live_frames": f"""WITH w AS (SELECT {WORDS} FROM events WHERE event_id % 7 <> 0)
        SELECT CAST(event_id % 16 AS INT) AS sensor, * EXCLUDE (event_id), 0 AS unused, CAST(66 + 77 + {BYTES} AS INT) AS checksum FROM w""",
    "registry_stream": f"WITH {REGISTRY}, {SCANS} SELECT url, access_key FROM fresh",
    "note_store": f"""WITH {NOTES}, {ITEMS}, n AS (SELECT l_orderkey, count(*) AS n_items FROM items GROUP BY ALL)
        SELECT access_key, sold_at, payment, total, n_items FROM notes JOIN n ON l_orderkey = o_orderkey WHERE NOT bad""",
    "climate_lines": """
        SELECT event_id, printf('temperature: %.2f humidity: %.2f', value + 1, value) AS line FROM events WHERE event_id % 9 NOT IN (0, 4) AND NOT isnan(value)""",
    "country_lines": f"""WITH {ROLLUP}, c AS (SELECT DISTINCT commodity FROM imports WHERE country = 'NATION_7'), r AS (SELECT * FROM rolled WHERE country = 'NATION_7')
        SELECT 0 AS place, 'Dados do país: NATION_7' AS line FROM r
        UNION ALL SELECT 1, 'Valor total importado: €' || format('{{:,.2f}}', total) || ' mil euros' FROM r
        UNION ALL SELECT 2, 'Tipos de commodities importadas: ' || n_commodities FROM r
        UNION ALL SELECT 3, 'Lista de commodities:' FROM r
        UNION ALL SELECT CAST(3 + row_number() OVER (ORDER BY commodity) AS INT), '- ' || commodity FROM c""",
    "country_lines_missing": "SELECT 0 AS place, 'País não encontrado.' AS line",
    "commodity_lines": f"""WITH {BRANDS}, c AS (SELECT DISTINCT country FROM imports WHERE commodity = 'Brand#12')
        SELECT 0 AS place, 'Países que importam a commodity ''Brand#12'':' AS line, 'Brand#12' AS asked
        UNION ALL SELECT CAST(row_number() OVER (ORDER BY country) AS INT), '- ' || country, 'Brand#12' FROM c
        UNION ALL SELECT 0, 'Países que importam a commodity ''Brand'':', 'Brand'
        UNION ALL SELECT 1, 'Nenhum país encontrado com essa commodity.', 'Brand'""",
    "profile_lines": f"WITH {PROFILES} SELECT c_custkey, 'Seu perfil de investidor é: ' || profile AS line FROM profiles",
    "sales_by_day_of_text": f"WITH {SALES}, {CLEAN} SELECT CAST(CAST(sold_at AS DATE) AS VARCHAR) AS day, {MONEY} AS total FROM cleaned GROUP BY 1",
    "sales_status": f"""WITH {SALES}
        SELECT count(*) AS n, 'ok' AS status, NULL AS warning FROM sales WHERE {IN_RANGE} AND payment = '1-URGENT'
        UNION ALL SELECT 0, 'empty', 'Nenhum dado encontrado para os filtros selecionados.'""",
    "note_header_items": f"""WITH {NOTES}, {ITEMS}
        SELECT n.access_key, sold_at, payment, total, line_no, product, quantity, unit_price, item_total FROM notes n JOIN items i ON i.l_orderkey = n.o_orderkey WHERE NOT bad""",
    "note_html_bodies": f"""WITH {ITEMS}
        SELECT access_key, line_no, product, quantity, unit_price, item_total FROM items WHERE l_orderkey % 5 <> 0 AND l_orderkey IN (SELECT o_orderkey FROM orders)""",
    "stored_posts": """
        SELECT event_id, 'Dados recebidos e armazenados com sucesso!' AS message, '2024-05-06 07:08:09' AS registered_at, true AS has_id FROM events WHERE event_id % 5 <> 1""",
    "pms_stream_frames": f"""WITH w AS (SELECT {WORDS} FROM events WHERE event_id % 7 <> 0)
        SELECT *, 0 AS place, 0 AS unused, CAST(66 + 77 + {BYTES} AS INT) AS checksum FROM w""",
    "sensor_lines": f"""WITH w AS (SELECT {WORDS} FROM events WHERE event_id % 7 <> 0)
        SELECT event_id, 'ADC bruto: ' || event_id % 1024 || '.00 RZero: 76.50 PPM estimado: 400.00' AS line FROM events
        UNION ALL SELECT event_id, 'Qualidade do Ar (PM 2.5): ' || pm25_standard || ' ug/m3' FROM w""",
    "risk_profile_matrix": f"WITH {PROFILES} SELECT * FROM profiles",
    "profile_recommendations": f"WITH {PROFILES} SELECT c_custkey, profile, place, item FROM profiles JOIN {RECOMMENDED} USING (profile)",
    "sales_filtered": f"WITH {SALES} SELECT * FROM sales WHERE {IN_RANGE} AND payment = '1-URGENT'",
    "sales_filtered_all": f"WITH {SALES} SELECT * FROM sales WHERE {IN_RANGE}",
    "sales_filtered_whole_last_day": f"WITH {SALES} SELECT * FROM sales WHERE sold_at >= TIMESTAMP '1996-01-01' AND sold_at < TIMESTAMP '1998-01-01'",
    "sales_stored_range": f"WITH {SALES} SELECT * FROM sales WHERE {IN_RANGE} AND payment = '1-URGENT'",
    "sales_on_weekends": f"WITH {SALES} SELECT payment, {MONEY} AS total FROM sales WHERE quarter(sold_at) = 4 AND isodow(sold_at) >= 6 AND payment IS NOT NULL GROUP BY payment",
    "sales_metrics": f"WITH {SALES} SELECT {MONEY} AS total, count(*) AS n, CASE WHEN count(*) > 0 THEN {MONEY} / count(*) ELSE 0 END AS mean FROM sales WHERE {IN_RANGE}",
    "sales_metrics_empty": "SELECT CAST(0 AS DOUBLE) AS total, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS mean",
    "sales_metric_tiles": f"WITH {SALES} SELECT printf('R$ %.2f', {MONEY}) AS total, printf('R$ %.2f', {MONEY} / count(*)) AS mean FROM sales",
    "sales_by_day": f"WITH {SALES}, {CLEAN} SELECT CAST(CAST(sold_at AS DATE) AS VARCHAR) AS day, {MONEY} AS total FROM cleaned GROUP BY 1",
    "sales_by_week": f"WITH {SALES}, {CLEAN} SELECT CAST(week(sold_at) AS INT) AS week, {MONEY} AS total FROM cleaned GROUP BY 1",
    "sales_by_month": f"WITH {ODD_SALES}, {CLEAN} SELECT CAST(month(sold_at) AS INT) AS month, {MONEY} AS total FROM cleaned GROUP BY 1",
    "sales_by_payment": f"WITH {ODD_SALES}, {CLEAN} SELECT payment, {MONEY} AS total FROM cleaned WHERE payment IS NOT NULL GROUP BY 1",
    "exact_country_totals": f"""WITH {TAXES} SELECT country, {EXACT.format("value")} AS total, count(DISTINCT commodity) AS n_commodities,
          array_to_string(list_sort(list(DISTINCT commodity)), '|') AS commodities FROM taxes GROUP BY country""",
    "exact_commodity_totals": f"WITH {TAXES} SELECT country, commodity, {EXACT.format('value')} AS total FROM taxes GROUP BY ALL",
    "exact_sales_by_day": f"WITH {SALES}, {CLEAN} SELECT CAST(CAST(sold_at AS DATE) AS VARCHAR) AS day, {EXACT.format('total')} AS total FROM cleaned GROUP BY 1",
    "exact_sales_metrics": f"WITH {SALES} SELECT {EXACT.format('total')} AS total, count(*) AS n, {EXACT.format('total')} / count(*) AS mean FROM sales",
    "payment_null_survives": f"""WITH {ODD_SALES}, {CLEAN}
        SELECT 'before' AS step, count(*) AS n, count(*) FILTER (payment IS NULL) AS n_null FROM sales
        UNION ALL SELECT 'after', count(*), count(*) FILTER (payment IS NULL) FROM cleaned""",
    "access_key_extract": """
        WITH t AS (SELECT 'https://receipts.example/q?p=' || CASE WHEN o_orderkey % 4 = 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 43, '1')
          ELSE lpad(CAST(o_orderkey AS VARCHAR), 50, '7') END || '|2|1' AS url FROM orders)
        SELECT url, nullif(regexp_extract(url, '[0-9]{44}'), '') AS access_key FROM t""",
    "registry_new_keys": f"WITH {REGISTRY}, {SCANS} SELECT url, access_key FROM fresh",
    "registry_insert": f"WITH {REGISTRY}, {SCANS} SELECT url, access_key, TIMESTAMP '2002-02-03 04:05:06' AS read_at FROM fresh",
    "registry_listing": f"WITH {REGISTRY} SELECT row_number() OVER (ORDER BY access_key) AS place, access_key FROM registry",
    "url_key_lookup": f"""WITH {REGISTRY}, f AS (SELECT url, arg_min(access_key, (read_at, access_key)) AS access_key FROM registry GROUP BY url)
        SELECT 'https://receipts.example/' || c_custkey AS url, access_key FROM customer LEFT JOIN f ON f.url = 'https://receipts.example/' || c_custkey""",
    "pending_notes": f"""WITH {REGISTRY}
        SELECT * FROM registry WHERE access_key NOT IN (SELECT lpad(CAST(o_orderkey AS VARCHAR), 44, '0') FROM orders WHERE o_orderstatus = 'F')""",
    "locale_number_parse": """
        SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INT) AS DOUBLE) AS quantity, CAST(printf('%.2f', l_extendedprice) AS DOUBLE) AS price,
          CASE WHEN l_linenumber NOT IN (1, 2) THEN CAST(printf('%.2f', l_extendedprice) AS DOUBLE) END AS total,
          l_linenumber = 2 AS total_failed,
          CASE WHEN l_linenumber = 2 THEN 1234.56 WHEN l_linenumber <> 1 THEN CAST(printf('%.2f', l_extendedprice) AS DOUBLE) END AS total_grouped
        FROM lineitem""",
    "emission_timestamp_parse": """
        WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'Série: 1' ELSE 'Série: 1 Emissão: ' ||
          CASE WHEN o_orderkey % 5 = 0 THEN '31/02/2025 10:00:00' ELSE strftime(o_orderdate, '%d/%m/%Y %H:%M:%S') END || ' - Via' END AS x FROM orders),
        e AS (SELECT o_orderkey, nullif(regexp_extract(x, 'Emissão:\\s*(\\d{2}/\\d{2}/\\d{4} \\d{2}:\\d{2}:\\d{2})', 1), '') AS emission FROM t)
        SELECT o_orderkey, emission, try_strptime(emission, '%d/%m/%Y %H:%M:%S') AS sold_at FROM e""",
    "note_status": f"""WITH {NOTES}
        SELECT access_key, CASE WHEN bad THEN 'rejected' ELSE 'saved' END AS status, CASE WHEN bad THEN 'total isn''t a number' END AS reason FROM notes""",
    "note_items_exploded": f"""WITH {ITEMS}
        SELECT access_key, line_no, product, quantity, unit_price, item_total FROM items WHERE l_orderkey % 5 <> 0 AND l_orderkey IN (SELECT o_orderkey FROM orders)""",
    "note_header_upsert": f"""WITH {NOTES}, incoming AS (SELECT access_key, sold_at, payment, total FROM notes WHERE NOT bad)
        SELECT * FROM incoming
        UNION ALL SELECT lpad(CAST(o_orderkey AS VARCHAR), 44, '0'), o_orderdate, 'old', 1.0 FROM orders
        WHERE o_orderstatus = 'F' AND lpad(CAST(o_orderkey AS VARCHAR), 44, '0') NOT IN (SELECT access_key FROM incoming)""",
    "note_items_upsert": f"""WITH {ITEMS}, incoming AS (
          SELECT access_key, line_no, product, quantity, unit_price, item_total FROM items WHERE l_orderkey % 5 <> 0 AND l_orderkey IN (SELECT o_orderkey FROM orders))
        SELECT * FROM incoming
        UNION ALL SELECT lpad(CAST(o_orderkey AS VARCHAR), 44, '0'), 1, 'old', 1.0, 1.0, 1.0 FROM orders
        WHERE o_orderstatus = 'F' AND lpad(CAST(o_orderkey AS VARCHAR), 44, '0') NOT IN (SELECT access_key FROM incoming)""",
    "note_html_extract": f"""WITH {NOTES}, n AS (SELECT l_orderkey, count(*) AS n_items FROM lineitem GROUP BY ALL)
        SELECT access_key, sold_at, payment, total, CASE WHEN bad THEN 'rejected' ELSE 'saved' END AS status,
          CASE WHEN bad THEN 'total isn''t a number' END AS reason, n_items FROM notes JOIN n ON l_orderkey = o_orderkey""",
    "telemetry_decode": f"""WITH {MESSAGES}
        SELECT event_id, CAST(payload ->> '$.k' AS BIGINT) AS k FROM (SELECT * FROM messages WHERE json_valid(payload)) WHERE json_type(payload) = 'OBJECT'""",
    "telemetry_dead_letter": f"""WITH {MESSAGES}
        SELECT event_id, CASE WHEN event_id % 10 = 2 THEN 'not an object' ELSE 'not JSON' END AS error_kind FROM messages
        WHERE NOT coalesce(json_valid(payload), false) OR event_id % 10 = 2""",
    "required_field_gate": """
        SELECT event_id, CASE event_id % 5 WHEN 0 THEN 201 ELSE 400 END AS status_code,
          CASE event_id % 5 WHEN 0 THEN 'Dados recebidos e armazenados com sucesso!' WHEN 1 THEN 'Campo ''umidade_ar'' ausente no JSON'
            WHEN 3 THEN 'not a JSON object' ELSE 'Campo ''temperatura'' ausente no JSON' END AS message FROM events""",
    "telemetry_stream_append": "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events WHERE json_valid(props)",
    "pms_decode": f"""WITH w AS (SELECT {WORDS} FROM events WHERE event_id % 7 <> 0)
        SELECT *, 0 AS unused, CAST(66 + 77 + {BYTES} AS INT) AS checksum FROM w""",
    "failed_reading_guard": "SELECT event_id, value AS humidity, value + 1 AS temperature FROM events WHERE event_id % 9 NOT IN (0, 4) AND NOT isnan(value)",
}
