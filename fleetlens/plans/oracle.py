"""The registered queries once more, as plain SQL over the test tables."""

from __future__ import annotations

from fleetlens import constants as C
from fleetlens.functions.geo import Viewport, view_size
from fleetlens.operators.nearest import squeeze_at

POSITIONS = """
raw AS (
  SELECT CAST(user_id AS VARCHAR) AS codigo,
    CASE WHEN event_id % 11 = 0 THEN NULL
         WHEN event_id % 13 = 0 THEN '123'
         WHEN event_id % 7 = 0 THEN '501234'
         WHEN event_id % 5 = 0 THEN '20A'
         ELSE CAST(10 + event_id % 55 AS VARCHAR) END AS codlinha,
    CASE WHEN event_id % 17 = 0 THEN NULL
         WHEN event_id % 19 = 0 THEN 'expresso - x'
         ELSE CAST(10 + event_id % 55 AS VARCHAR) || ' - ' || event_type END AS trajeto,
    date_trunc('second', ts) AS datahora,
    ts,
    CASE WHEN event_id % 23 = 0 THEN 0.0e0 ELSE value END AS velocidade,
    CASE WHEN event_id % 2 = 0 THEN 'ida' ELSE 'volta' END AS sentido,
    -23.1e0 + (user_id % 100) * 0.004e0 AS latitude,
    -43.8e0 + (user_id % 140) * 0.005e0 AS longitude, event_id
  FROM events),
lined AS (
  SELECT *, trim(split_part(trajeto, '-', 1)) AS linha
  FROM raw
  WHERE trajeto IS NOT NULL AND codlinha IS NOT NULL
    AND (codlinha LIKE '5_____' OR codlinha LIKE '__A' OR codlinha LIKE '__')),
positions AS (
  SELECT codigo, linha, latitude, longitude, datahora, ts, event_id, velocidade, sentido, trajeto,
    CASE WHEN linha LIKE '1%' OR linha LIKE '2%' THEN 'TransOeste'
         WHEN linha LIKE '3%' OR linha LIKE '4%' THEN 'TransCarioca'
         WHEN linha LIKE '5%' THEN 'TransOlímpica'
         ELSE '' END AS corredor
  FROM lined
  WHERE linha LIKE '___' OR linha LIKE '__'),
deduped AS (
  SELECT * FROM positions
  QUALIFY row_number() OVER (PARTITION BY codigo, datahora
    ORDER BY corredor, velocidade, linha, latitude, longitude, sentido, trajeto) = 1)
"""

COLUMNS = "codigo, linha, latitude, longitude, datahora, velocidade, sentido, trajeto, corredor"

# A mean by decimal sum: the same in any order of summation.
MEAN = "CAST(sum(CAST(velocidade AS DECIMAL(18,2))) AS DOUBLE) / count(velocidade)"

LOGS = (
    POSITIONS
    + """,
slotted AS (
  SELECT corredor, codigo, velocidade, date_trunc('hour', datahora) AS hour,
    CAST(floor(minute(datahora) / 20) AS INTEGER) AS slot
  FROM positions),
updates AS (SELECT DISTINCT corredor, hour, slot FROM slotted),
speed_log AS (
  SELECT u.corredor, u.hour, u.slot, """
    + MEAN
    + """ AS vel_media
  FROM updates u JOIN slotted s ON s.corredor = u.corredor AND s.hour = u.hour AND s.slot <= u.slot
  GROUP BY u.corredor, u.hour, u.slot),
stats_vel AS (
  SELECT corredor, vel_media, CAST(hour AS DATE) AS data, strftime(hour, '%H:%M') AS hora, slot
  FROM speed_log WHERE vel_media > 0),
stats_qtd AS (
  SELECT u.corredor, CAST(u.hour AS DATE) AS data, strftime(u.hour, '%H:%M') AS hora, u.slot,
    count(DISTINCT s.codigo) AS qtd_carros
  FROM updates u JOIN slotted s ON s.corredor = u.corredor AND s.hour = u.hour AND s.slot <= u.slot
  GROUP BY u.corredor, u.hour, u.slot),
vel_final AS (
  SELECT corredor, data, hora, vel_media FROM stats_vel
  QUALIFY row_number() OVER (PARTITION BY corredor, data, hora ORDER BY slot DESC) = 1),
speed_hour AS (
  SELECT hora, corredor, max(vel_media) AS vel_media FROM stats_vel
  WHERE data > DATE '2024-01-30' - INTERVAL 24 HOUR GROUP BY hora, corredor),
speed_day AS (
  SELECT data, corredor, max(vel_media) AS vel_media, strftime(data, '%a, %Y-%-m-%-d') AS label FROM stats_vel
  WHERE data > DATE '2024-01-30' - INTERVAL 7 DAY GROUP BY data, corredor),
vehicles_hour AS (
  SELECT hora, corredor, max(qtd_carros) AS qtd_carros FROM stats_qtd
  WHERE data > DATE '2024-01-30' - INTERVAL 24 HOUR GROUP BY hora, corredor),
vehicles_day AS (
  SELECT data, corredor, max(qtd_carros) AS qtd_carros, strftime(data, '%a, %Y-%-m-%-d') AS label FROM stats_qtd
  WHERE data > DATE '2024-01-30' - INTERVAL 6 DAY GROUP BY data, corredor)
"""
)

MARKERS = """
SELECT latitude AS lat, longitude AS lng, trajeto AS title, velocidade AS count,
  CASE corredor WHEN 'TransCarioca' THEN '../static/transcarioca.png'
                WHEN 'TransOlímpica' THEN '../static/transolimpica.png'
                WHEN 'TransOeste' THEN '../static/transoeste.png' END AS icon
FROM positions WHERE datahora > TIMESTAMP '2024-01-30' - INTERVAL {minutes} MINUTE {more}
"""

WINDOW = """
SELECT corredor, {measure}, CAST(w AS DATE) AS data, strftime(w, '%H:%M') AS hora
FROM (SELECT corredor, time_bucket(INTERVAL {length}, datahora) AS w, {expr} AS {measure}
      FROM {source} GROUP BY ALL) {having}
"""

SERIES = """
SELECT {keys},
  max({measure}) FILTER (WHERE corredor = 'TransCarioca') AS "TransCarioca",
  max({measure}) FILTER (WHERE corredor = 'TransOeste') AS "TransOeste",
  max({measure}) FILTER (WHERE corredor = 'TransOlímpica') AS "TransOlímpica"
FROM {cells} GROUP BY {keys}
"""

GROUP_ROWS = ", ".join(f"('{group}', '{line}')" for group, lines in C.LINE_GROUPS.items() for line in lines)
GROUPS = f", groups(grupo, linha) AS (VALUES {GROUP_ROWS})"

FLAT_LINES = ", ".join(f"'{line}'" for line in C.ALL_LINES)

EXACT_VEHICLES = """
SELECT CAST(w AS DATE) AS data, strftime(w, '%H:%M') AS hora, corredor,
  count(DISTINCT codigo) AS exact, true AS close
FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, datahora) AS w FROM positions)
GROUP BY w, corredor
"""

STATIONS = """
named AS (
  SELECT 'nation' AS source, CAST(n_nationkey AS BIGINT) AS k, n_name AS estacao,
    CAST(n_regionkey AS VARCHAR) AS bairro FROM nation
  UNION ALL SELECT 'supplier', s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) FROM supplier
  UNION ALL SELECT 'customer', c_custkey, c_name, c_mktsegment FROM customer),
stations AS (
  SELECT estacao,
    CASE WHEN k % 2 = 0 THEN '24h' ELSE '05h à 01h' END AS horarioestacao,
    '06h às 22h' AS horariobilheteria, 'Avenida' AS logradouro,
    CASE WHEN k % 3 = 0 THEN '' ELSE CAST(k AS VARCHAR) END AS numero, bairro,
    CASE WHEN k % 7 = 0 THEN NULL
         ELSE CAST('-22.' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') AS DOUBLE) END AS latitude,
    CAST('-43.' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') AS DOUBLE) AS longitude, source
  FROM named)
"""

# Pixels of world size 256 * 2^zoom, offsets from the north-west corner.
PIXELS = """
SELECT CAST(floor({size} * (0.5e0 + {lng} / 360.0e0) - {size} * (0.5e0 + ({west}) / 360.0e0) + 0.5e0) AS BIGINT) AS x,
  CAST(floor({size} * (0.5e0 - {merc}) - {size} * (0.5e0 - {merc_north}) + 0.5e0) AS BIGINT) AS y,
  velocidade AS count, {radius} AS radius
FROM positions WHERE {inside}
"""


def merc(lat: str) -> str:
    s = f"least(greatest(sin(radians({lat})), -0.9999e0), 0.9999e0)"
    return f"(ln((1.0e0 + {s}) / (1.0e0 - {s})) / (4.0e0 * pi()))"


INSIDE = "latitude BETWEEN -23.0e0 AND -22.75e0 AND longitude BETWEEN -43.7e0 AND -43.2e0"

PIXELS_Z12 = PIXELS.format(
    size="1048576.0e0",
    lng="longitude",
    west="-43.7e0",
    merc=merc("latitude"),
    merc_north=merc("-22.75e0"),
    radius="CASE WHEN velocidade > 50 THEN velocidade ELSE 10.0e0 END",
    inside=INSIDE,
)

PIXELS_WRAPPED = PIXELS.format(
    size="2048.0e0",
    lng="(CASE WHEN longitude < -43.3e0 THEN longitude + 360.0e0 ELSE longitude END)",
    west="-43.3e0",
    merc=merc("latitude"),
    merc_north=merc("-22.8e0"),
    radius="2.0e0 * 8.0e0",
    inside="latitude BETWEEN -23.1e0 AND -22.8e0 AND (longitude >= -43.3e0 OR longitude <= -43.6e0)",
)

YEARS = """
year_rows AS (
  SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS VARCHAR) AS year,
    o_totalprice AS internet, CAST(o_custkey AS DOUBLE) AS human FROM orders
  UNION ALL
  SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) + 1 AS VARCHAR), CAST(o_orderkey AS DOUBLE), NULL FROM orders)
"""

METRICS = """
WITH objects AS (
  SELECT o_orderkey, year(o_orderdate) AS y, o_totalprice, o_custkey FROM orders),
metrics AS (
  SELECT o_orderkey, CAST(y AS VARCHAR) AS year, 'internet' AS metric, o_totalprice AS value FROM objects
  UNION ALL SELECT o_orderkey, CAST(y AS VARCHAR), 'm' || (o_custkey % 5), CAST(o_custkey AS DOUBLE) FROM objects
  UNION ALL SELECT o_orderkey, CAST(y AS VARCHAR), 'note', NULL FROM objects
  UNION ALL SELECT o_orderkey, CAST(y + 1 AS VARCHAR), '0', CAST(o_orderkey AS DOUBLE) FROM objects)
"""

DAY_VEHICLES = """
SELECT CAST(datahora AS DATE) AS data, corredor, count(DISTINCT codigo) AS exact, true AS close
FROM positions GROUP BY 1, 2
"""

# Runs the replayed history is cut into, and the hourly mean after each run.
RUNS = (
    POSITIONS
    + """,
runs AS (
  SELECT *, date_trunc('hour', datahora) AS hour,
    CASE WHEN ts < TIMESTAMP '2024-01-11 12:30:00' THEN 0
         WHEN ts < TIMESTAMP '2024-01-21 06:40:00' THEN 1 ELSE 2 END AS run
  FROM deduped)
"""
)


# Pings of a tenth come last; those of an hour that is closed by then are late.
ROUTED = (
    POSITIONS
    + """,
opened AS (
  SELECT date_trunc('hour', max(datahora) - INTERVAL 10 MINUTE) AS since FROM positions WHERE event_id % 10 <> 0),
fates AS (
  SELECT p.*, event_id % 10 = 0 AND datahora < since AS late FROM positions p, opened),
kept AS (SELECT * FROM fates WHERE NOT late)
"""
)


def kernel(zoom: int) -> str:
    """Heat of one zoom: cells of 8 pixels within a point's radius."""
    view = Viewport(north=-22.75, south=-23.0, east=-43.2, west=-43.7, zoom=zoom)
    width, height = view_size(view)
    pixels = PIXELS.format(
        size=f"{256 * 2**zoom}.0e0",
        lng="longitude",
        west="-43.7e0",
        merc=merc("latitude"),
        merc_north=merc("-22.75e0"),
        radius="CASE WHEN velocidade > 50 THEN CAST(CAST(floor(velocidade) AS BIGINT) % 30 + 10 AS DOUBLE) ELSE 10.0e0 END",
        inside=INSIDE,
    )
    return f"""
        SELECT {zoom} AS zoom, cell_x, cell_y,
          CAST(sum(CAST(floor(v * (1.0e0 - share) * 1000000.0e0) AS BIGINT)) AS DOUBLE) / 1000000.0e0 AS intensity,
          CAST(sum(n) AS BIGINT) AS points
        FROM (
          SELECT *, (((cell_x + 0.5e0) * 8.0e0 - x) * ((cell_x + 0.5e0) * 8.0e0 - x)
            + ((cell_y + 0.5e0) * 8.0e0 - y) * ((cell_y + 0.5e0) * 8.0e0 - y)) / (radius * radius) AS share
          FROM (SELECT x, y, radius, CAST(sum(CAST(count AS DECIMAL(18,2))) AS DOUBLE) AS v, count(*) AS n
                FROM ({pixels}) GROUP BY ALL),
            range(0, {(width - 1) // 8 + 1}) AS cx(cell_x), range(0, {(height - 1) // 8 + 1}) AS cy(cell_y))
        WHERE share < 1 GROUP BY cell_x, cell_y"""


def after(ctes: str, query: str) -> str:
    return f"WITH {ctes} {query}"


def oracles() -> dict[str, str]:
    speed_1h = WINDOW.format(
        measure="vel_media", length="1 HOUR", expr=MEAN, source="deduped", having="WHERE vel_media > 0"
    )
    rollup_sets = "(w, corredor, linha, sentido), (w, corredor, linha), (w, corredor), (w)"
    return {
        "clean_positions": after(POSITIONS, f"SELECT {COLUMNS} FROM positions"),
        "snapshot_scan": """
            SELECT date_trunc('day', ts) AS snapshot_ts,
              count(*) + count(*) FILTER (WHERE event_id % 3 = 0) AS records,
              count(DISTINCT user_id) AS vehicles
            FROM events GROUP BY 1""",
        "corridor_counts": after(POSITIONS, "SELECT corredor, count(*) AS pings FROM positions GROUP BY 1"),
        "dedupe_replay": after(POSITIONS, f"SELECT {COLUMNS} FROM deduped"),
        "speed_10m": after(
            POSITIONS,
            WINDOW.format(measure="vel_media", length="10 MINUTE", expr=MEAN, source="positions", having=""),
        ),
        "speed_1h": after(POSITIONS, speed_1h),
        "vehicles_10m_exact": after(
            POSITIONS,
            WINDOW.format(
                measure="qtd_carros",
                length="10 MINUTE",
                expr="count(DISTINCT codigo)",
                source="positions",
                having="",
            ),
        ),
        "speed_10m_plain": after(
            POSITIONS,
            """SELECT time_bucket(INTERVAL 10 MINUTE, datahora) AS window_start, corredor, true AS close
               FROM positions GROUP BY 1, 2""",
        ),
        "vehicles_1h_known": after(
            POSITIONS,
            """SELECT corredor, count(DISTINCT codigo) AS qtd_carros, CAST(w AS DATE) AS data, strftime(w, '%H:%M') AS hora
               FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, datahora) AS w FROM positions)
               WHERE CAST(codigo AS BIGINT) % 4 = 0 GROUP BY w, corredor""",
        ),
        "stats_update_time": after(
            POSITIONS,
            """SELECT corredor, CAST(w AS DATE) AS data, strftime(w, '%H:%M') AS hora, true AS updated
               FROM (SELECT DISTINCT corredor, time_bucket(INTERVAL 1 HOUR, datahora) AS w FROM positions)
               CROSS JOIN (VALUES (1), (2)) AS log(number)""",
        ),
        "vehicles_1h_approx": after(POSITIONS, EXACT_VEHICLES),
        "vehicles_1h_approx_error": after(
            POSITIONS,
            """SELECT count(*) AS windows, true AS few_far, true AS mean_error_small
               FROM (SELECT DISTINCT time_bucket(INTERVAL 1 HOUR, datahora), corredor FROM positions)""",
        ),
        "stats_by_line": after(
            POSITIONS,
            f"""SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, corredor, linha, sentido,
                  {MEAN} AS vel_media, count(DISTINCT codigo) AS qtd_carros
                FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, datahora) AS w FROM positions)
                GROUP BY w, corredor, linha, sentido""",
        ),
        "stats_rollup": after(
            POSITIONS,
            f"""SELECT w AS window_start, corredor, linha, sentido,
                  CAST(3 - bit_count(CAST(grouping(w, corredor, linha, sentido) AS INTEGER)) AS INTEGER) AS level,
                  {MEAN} AS vel_media, count(DISTINCT codigo) AS qtd_carros
                FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, datahora) AS w FROM positions)
                GROUP BY GROUPING SETS ({rollup_sets})""",
        ),
        "speed_by_hour": after(LOGS, "SELECT * FROM speed_hour"),
        "speed_by_hour_final": after(
            LOGS,
            """SELECT hora, corredor, max(vel_media) AS vel_media FROM vel_final
               WHERE data > DATE '2024-01-30' - INTERVAL 24 HOUR GROUP BY hora, corredor""",
        ),
        "speed_by_day": after(LOGS, "SELECT * FROM speed_day"),
        "vehicles_by_hour": after(LOGS, "SELECT * FROM vehicles_hour"),
        "vehicles_by_day": after(LOGS, "SELECT * FROM vehicles_day"),
        "speed_series_hour": after(LOGS, SERIES.format(keys="hora", measure="vel_media", cells="speed_hour")),
        "speed_series_day": after(LOGS, SERIES.format(keys="data, label", measure="vel_media", cells="speed_day")),
        "vehicle_series_hour": after(
            LOGS, SERIES.format(keys="hora", measure="qtd_carros", cells="vehicles_hour")
        ),
        "vehicle_series_day": after(
            LOGS, SERIES.format(keys="data, label", measure="qtd_carros", cells="vehicles_day")
        ),
        "categories_hour": after(LOGS, "SELECT DISTINCT hora AS category FROM vehicles_hour ORDER BY 1"),
        "categories_day": after(
            LOGS, "SELECT label AS category FROM (SELECT DISTINCT data, label FROM vehicles_day) ORDER BY data"
        ),
        "speed_chart": after(
            LOGS,
            """SELECT n.name, CAST(row_number() OVER (PARTITION BY n.name ORDER BY d.data) - 1 AS INTEGER) AS position,
                 d.label AS category, s.vel_media AS value
               FROM (SELECT DISTINCT data, label FROM speed_day) d
               CROSS JOIN (VALUES ('TransCarioca'), ('TransOeste'), ('TransOlímpica')) AS n(name)
               LEFT JOIN speed_day s ON s.data = d.data AND s.corredor = n.name""",
        ),
        "vehicle_chart_json": after(
            LOGS
            + ", wide AS ("
            + SERIES.format(keys="hora", measure="qtd_carros", cells="vehicles_hour")
            + ")",
            """SELECT CAST(to_json({
                 content: [
                   {name: 'TransCarioca', stack: 'BusQuery', data: list("TransCarioca" ORDER BY hora)},
                   {name: 'TransOeste', stack: 'BusQuery', data: list("TransOeste" ORDER BY hora)},
                   {name: 'TransOlímpica', stack: 'BusQuery', data: list("TransOlímpica" ORDER BY hora)}],
                 categories: list(hora ORDER BY hora)}) AS VARCHAR) AS json
               FROM wide""",
        ),
        "recent_positions_3m": after(POSITIONS, MARKERS.format(minutes=3, more="")),
        "recent_positions_corridor": after(
            POSITIONS, MARKERS.format(minutes=3, more="AND corredor = 'TransOlímpica'")
        ),
        "marker_json": after(
            POSITIONS + ", markers AS (" + MARKERS.format(minutes=3, more="") + ")",
            "SELECT CAST(to_json({title: title, icon: icon}) AS VARCHAR) AS json FROM markers",
        ),
        "heat_points_10m": after(
            POSITIONS + ", markers AS (" + MARKERS.format(minutes=10, more="") + ")",
            "SELECT lat, lng, count FROM markers",
        ),
        "heat_points_corridor": after(
            POSITIONS
            + ", markers AS ("
            + MARKERS.format(minutes=10, more="AND corredor = 'TransCarioca'")
            + ")",
            "SELECT lat, lng, count FROM markers",
        ),
        "located_points": after(
            POSITIONS, "SELECT latitude AS lat, longitude AS lng, velocidade FROM positions"
        ),
        "viewport_pixels": after(POSITIONS, PIXELS_Z12),
        "viewport_wrapped": after(POSITIONS, PIXELS_WRAPPED),
        "viewport_extrema": after(
            POSITIONS,
            f"""SELECT greatest(max(velocidade), 0.0e0) AS max, least(min(velocidade), 0.0e0) AS min
                FROM positions WHERE {INSIDE}""",
        ),
        "given_extrema": after(
            POSITIONS, "SELECT CAST(100 AS DOUBLE) AS max, min(velocidade) AS min FROM positions"
        ),
        "heat_grid": after(
            POSITIONS + ", pixels AS (" + PIXELS_Z12 + ")",
            """SELECT CAST(floor(x / 10.0e0) AS BIGINT) AS cell_x, CAST(floor(y / 10.0e0) AS BIGINT) AS cell_y,
                 CAST(sum(CAST(count AS DECIMAL(18,2))) AS DOUBLE) AS intensity, count(*) AS points
               FROM pixels GROUP BY 1, 2""",
        ),
        "stations_union": after(STATIONS, "SELECT * FROM stations"),
        "station_markers": after(
            STATIONS,
            """SELECT latitude AS lat, longitude AS lng, estacao AS title, '/static/estacao.png' AS icon
               FROM stations""",
        ),
        "line_group_join": after(
            POSITIONS + GROUPS,
            """SELECT grupo, linha, count(*) AS pings FROM positions JOIN groups USING (linha)
               GROUP BY grupo, linha""",
        ),
        "line_semi": after(
            POSITIONS + GROUPS,
            """SELECT codigo, datahora, linha, trajeto FROM positions
               WHERE linha IN (SELECT linha FROM groups WHERE grupo IN ('transolimpica', 'lote_zero'))""",
        ),
        "line_flat_list": after(
            POSITIONS,
            f"SELECT linha, count(*) AS pings FROM positions WHERE linha IN ({FLAT_LINES}) GROUP BY 1",
        ),
        "icon_lookup": after(
            POSITIONS + ", markers AS (" + MARKERS.format(minutes=100000000, more="").replace(
                "SELECT", "SELECT corredor,", 1
            ) + ")",
            "SELECT corredor, icon, icon AS icon_rule, count(*) AS pings FROM markers GROUP BY corredor, icon",
        ),
        "itinerary_stations": after(
            STATIONS,
            """SELECT l_orderkey AS linha,
                 CASE WHEN l_returnflag = 'R' THEN 'volta' ELSE 'ida' END AS sentido,
                 l_linestatus AS trajeto, l_returnflag AS destino, CAST(l_linenumber AS INTEGER) AS sequencia,
                 'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS estacao, s.latitude, s.longitude
               FROM lineitem LEFT JOIN stations s ON s.source = 'supplier'
                 AND s.estacao = 'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0')""",
        ),
        "gps_table": after(
            POSITIONS,
            """SELECT latitude, longitude, trajeto, velocidade, corredor FROM positions
               WHERE datahora > TIMESTAMP '2024-01-30' - INTERVAL 1 DAY""",
        ),
        "gps_table_scan": after(
            POSITIONS,
            """SELECT CAST(datahora AS DATE) AS data, corredor, 2 * count(*) AS pings FROM positions
               GROUP BY 1, 2""",
        ),
        "gps_table_archive": after(
            POSITIONS, "SELECT CAST(datahora AS DATE) AS data, corredor, count(*) AS pings FROM positions GROUP BY 1, 2"
        ),
        "gps_catalog": after(
            POSITIONS,
            """SELECT CAST(datahora AS DATE) AS data, corredor, 2 * count(*) AS pings FROM positions
               WHERE datahora >= TIMESTAMP '2024-01-30' GROUP BY 1, 2""",
        ),
        "stats_tables": after(
            LOGS,
            """SELECT data, label, corredor, vel_media, qtd_carros
               FROM speed_day FULL JOIN vehicles_day USING (data, corredor, label)""",
        ),
        "stream_positions": after(POSITIONS, f"SELECT {COLUMNS} FROM deduped"),
        "stream_speed_1h": after(POSITIONS, speed_1h),
        "stream_speed_log": after(
            RUNS,
            f"""SELECT r.corredor, {MEAN} AS vel_media, CAST(r.hour AS DATE) AS data, strftime(r.hour, '%H:%M') AS hora
                FROM (SELECT DISTINCT corredor, hour, run FROM runs) r
                JOIN runs p ON p.corredor = r.corredor AND p.hour = r.hour AND p.run <= r.run
                GROUP BY r.corredor, r.hour, r.run
                HAVING {MEAN} > 0""",
        ),
        "stream_vehicles_1h": after(POSITIONS, EXACT_VEHICLES),
        "stream_late_drop": after(RUNS, f"SELECT {COLUMNS} FROM runs WHERE run <> 1"),
        "heat_kernel": after(POSITIONS, " UNION ALL ".join(kernel(zoom) for zoom in (9, 11, 12))),
        "heat_levels": after(
            POSITIONS,
            f"""SELECT zoom,
                  array_to_string(list_transform(range(zoom - 1, -1, -1),
                    lambda i: ((tile_y >> i) & 1) * 2 + ((tile_x >> i) & 1)), '') AS quadkey, tile_x, tile_y,
                  CAST(sum(CAST(velocidade AS DECIMAL(18,2))) AS DOUBLE) AS intensity, count(*) AS points
                FROM (
                  SELECT CAST(z AS INTEGER) AS zoom, velocidade,
                    CAST(floor((1 << z) * (0.5e0 + longitude / 360.0e0)) AS BIGINT) AS tile_x,
                    CAST(floor((1 << z) * (0.5e0 - {merc("latitude")})) AS BIGINT) AS tile_y
                  FROM positions, range(6, 15) AS t(z))
                GROUP BY zoom, tile_x, tile_y""",
        ),
        "gps_by_place": after(
            POSITIONS,
            """SELECT CAST(datahora AS DATE) AS data, corredor, count(*) AS pings, true AS skips FROM positions
               WHERE latitude BETWEEN -22.86e0 AND -22.80e0 AND longitude BETWEEN -43.48e0 AND -43.36e0
               GROUP BY 1, 2""",
        ),
        "nearest_station": after(
            POSITIONS + "," + STATIONS,
            f"""SELECT codigo, datahora, estacao, distance2
                FROM positions JOIN (
                  SELECT p.latitude, p.longitude, s.estacao,
                    (p.latitude - s.latitude) * (p.latitude - s.latitude)
                      + (p.longitude - s.longitude) * (p.longitude - s.longitude) * {squeeze_at(-22.9)!r}::DOUBLE AS distance2
                  FROM (SELECT DISTINCT latitude, longitude FROM positions) p, stations s
                  WHERE s.latitude IS NOT NULL AND s.longitude IS NOT NULL
                  QUALIFY row_number() OVER (PARTITION BY p.latitude, p.longitude ORDER BY distance2, s.estacao) = 1)
                USING (latitude, longitude)""",
        ),
        "next_stop": after(
            POSITIONS + "," + STATIONS + """, stops AS (
              SELECT CAST(l_orderkey AS VARCHAR) AS linha, CASE WHEN l_returnflag = 'R' THEN 'volta' ELSE 'ida' END AS sentido,
                CAST(l_linenumber AS INTEGER) AS sequencia, 'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS estacao
              FROM lineitem),
            following AS (
              SELECT linha, sentido, estacao, proxima FROM (
                SELECT *, lead(estacao) OVER (PARTITION BY linha, sentido ORDER BY sequencia, estacao) AS proxima FROM stops)
              QUALIFY row_number() OVER (PARTITION BY linha, sentido, estacao ORDER BY sequencia, proxima NULLS FIRST) = 1)""",
            f"""SELECT codigo, datahora, linha, sentido, estacao, proxima
                FROM positions LEFT JOIN (
                  SELECT p.latitude, p.longitude, p.linha, p.sentido, t.estacao,
                    (p.latitude - s.latitude) * (p.latitude - s.latitude)
                      + (p.longitude - s.longitude) * (p.longitude - s.longitude) * {squeeze_at(-22.9)!r}::DOUBLE AS distance2
                  FROM (SELECT DISTINCT linha, sentido, latitude, longitude FROM positions) p
                  JOIN (SELECT DISTINCT linha, sentido, estacao FROM stops) t ON t.linha = p.linha AND t.sentido = p.sentido
                  JOIN stations s ON s.source = 'supplier' AND s.estacao = t.estacao AND s.latitude IS NOT NULL
                  QUALIFY row_number() OVER (
                    PARTITION BY p.linha, p.sentido, p.latitude, p.longitude ORDER BY distance2, t.estacao) = 1)
                USING (latitude, longitude, linha, sentido)
                LEFT JOIN following USING (linha, sentido, estacao)""",
        ),
        "metric_rows": METRICS + " SELECT * FROM metrics",
        "metric_extent": METRICS
        + """ SELECT metric, min(make_date(CAST(year AS INTEGER), 1, 1)) AS first_year,
               max(make_date(CAST(year AS INTEGER), 1, 1)) AS last_year, min(value) AS least, max(value) AS most,
               count(value) AS values FROM metrics GROUP BY metric""",
        "vehicles_day_sketched": after(POSITIONS, DAY_VEHICLES),
        "stream_vehicles_day": after(POSITIONS, DAY_VEHICLES),
        "vehicles_rollup_sketched": after(
            POSITIONS,
            """SELECT corredor, data, CAST(2 - bit_count(CAST(grouping(corredor, data) AS INTEGER)) AS INTEGER) AS level,
                 count(DISTINCT codigo) AS exact, true AS close
               FROM (SELECT *, CAST(datahora AS DATE) AS data FROM positions) GROUP BY ROLLUP (corredor, data)""",
        ),
        "stream_upsert": after(POSITIONS, speed_1h),
        "stream_late_table": after(
            ROUTED,
            """SELECT corredor, count(*) AS sent, count(*) FILTER (WHERE NOT late) AS kept, count(*) FILTER (WHERE late) AS late,
                 true AS whole
               FROM fates GROUP BY corredor""",
        ),
        "stream_routed_speed": after(
            ROUTED,
            WINDOW.format(measure="vel_media", length="1 HOUR", expr=MEAN, source="kept", having="WHERE vel_media > 0"),
        ),
        "stream_progress": after(
            RUNS.replace("FROM deduped)", "FROM positions)"),
            """SELECT 'positions' AS name, CAST(sum(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS dropped_rows,
                 true AS all_runs
               FROM runs WHERE run = 1""",
        ),
        "stream_rate_limit": after(
            POSITIONS, "SELECT corredor, count(*) AS pings, true AS limited FROM deduped GROUP BY corredor"
        ),
        "stream_chart": after(
            POSITIONS + ", hourly AS (" + speed_1h + "), shown AS ("
            "SELECT hora, corredor, max(vel_media) AS vel_media FROM hourly WHERE data = DATE '2024-01-30' GROUP BY ALL)",
            """SELECT n.name, CAST(row_number() OVER (PARTITION BY n.name ORDER BY d.hora) - 1 AS INTEGER) AS position,
                 d.hora AS category, s.vel_media AS value
               FROM (SELECT DISTINCT hora FROM shown) d
               CROSS JOIN (VALUES ('TransCarioca'), ('TransOeste'), ('TransOlímpica')) AS n(name)
               LEFT JOIN shown s ON s.hora = d.hora AND s.corredor = n.name""",
        ),
        "stream_extrema": after(
            POSITIONS, "SELECT max(velocidade) AS max, min(velocidade) AS min FROM positions"
        ),
        "props_map_rows": """
            SELECT event_id, 'k' AS key, CAST(json_extract(props, '$.k') AS INTEGER) AS value FROM events""",
        "year_rows": after(YEARS, "SELECT o_orderkey, year, internet, human FROM year_rows"),
        "year_extent": after(
            YEARS,
            """SELECT min(make_date(CAST(year AS INTEGER), 1, 1)) AS first_year,
                 max(make_date(CAST(year AS INTEGER), 1, 1)) AS last_year,
                 max(internet) AS internet_max, min(human) AS human_min, max(human) AS human_max
               FROM year_rows""",
        ),
        "year_range": after(
            YEARS,
            """SELECT n_name AS country, year, internet, human FROM year_rows
               JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
               WHERE n_name = 'NATION_3' AND CAST(year AS INTEGER) BETWEEN 1996 AND 1998""",
        ),
    }
