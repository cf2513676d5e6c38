"""DuckDB SQL that computes each named query in its own way.

Only the fixed report values and the dates are shared with the Spark side. Slots
are read long, straight from the line items; the activity rule is spelled out as
four passes over neighbouring rows; lists, counts and totals are written directly.
"""

from __future__ import annotations

from wardlens.catalog.tables import (
    COVID_CUTOFF,
    HISTORY_DAY,
    HISTORY_START,
    PURGE_CUTOFF,
    REPORT_DATE,
)

_LINE_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey"

_WARD = """CASE {k} WHEN 0 THEN 'UMI' WHEN 1 THEN 'REA' WHEN 2 THEN 'REQ' WHEN 3 THEN 'UCP'
  WHEN 4 THEN 'UCN' ELSE n_name END"""

_RISKS = (
    "cvc",
    "cvp",
    "cirugia",
    "diabetes",
    "inmunodef",
    "ventilacionMecanica",
    "neo",
    "sondaUrinaria",
)

_BASE = f"""
ward AS (
  SELECT {_WARD.format(k="n_nationkey")} AS planta,
    CASE WHEN n_nationkey < 5 THEN 'CRITICOS' ELSE 'HOSP' END AS area,
    CASE WHEN n_nationkey = 24 THEN NULL ELSE 10 + 3 * n_nationkey END AS camas
  FROM nation),
rec AS (
  SELECT o_orderkey AS id,
    CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE 1 END AS recstatus,
    CASE WHEN o_orderstatus = 'F' THEN 'INACTIVO'
      WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 0 THEN NULL ELSE 'ACTIVO' END AS estado_actual,
    CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE c_name END AS nombre,
    'SIP' || o_custkey AS sip,
    CASE WHEN o_custkey % 37 = 0 THEN NULL ELSE o_custkey END AS nhc,
    CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE {_WARD.format(k="c_nationkey")} END AS planta,
    CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE 'C' || (o_orderkey % 400) END AS cama,
    CASE o_orderkey % 3 WHEN 0 THEN 'Contacto/Gotas' WHEN 1 THEN 'Contacto' ELSE 'Gotas' END AS tipo,
    CASE WHEN o_orderpriority < '3' THEN 'Nosocomial' ELSE 'Comunitario' END AS origen,
    CASE o_orderpriority WHEN '1-URGENT' THEN '1-Urgent' WHEN '2-HIGH' THEN '2-High'
      WHEN '3-MEDIUM' THEN '3-Medium' WHEN '4-NOT SPECIFIED' THEN '4-Not Specified'
      WHEN '5-LOW' THEN '5-Low' END AS motivo,
    CASE o_orderkey % 4 WHEN 0 THEN 'SI' WHEN 1 THEN 'NO' WHEN 2 THEN 'DUDOSO' END AS causa,
    CASE o_orderkey % 2 WHEN 0 THEN 'Primer ingreso' ELSE 'Reingreso' END AS ingreso,
    CASE o_orderkey % 5 WHEN 0 THEN 'EXITUS' WHEN 4 THEN NULL ELSE 'ALTA' END AS retirada,
    o_orderdate AS guardado,
    DATE '1930-01-01' + CAST(o_custkey % 20000 AS INT) AS nacimiento,
    CASE o_custkey % 2 WHEN 0 THEN 'Mujer' ELSE 'Hombre' END AS sexo,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderdate END AS f_aislamiento,
    CASE WHEN o_orderstatus = 'O' THEN NULL
      ELSE o_orderdate + to_days(CAST(o_orderkey % 60 AS INT)) END AS f_retirada,
    CASE WHEN o_orderpriority = '1-URGENT' THEN NULL
      ELSE o_orderdate + INTERVAL 30 DAY END AS f_alta,
    {", ".join(f"CASE WHEN o_orderkey % {3 + i} = 0 THEN 'SI' ELSE 'NO' END AS {r}"
               for i, r in enumerate(_RISKS))},
    'P' || (o_orderkey % 5) AS planta_infeccion,
    CAST(o_orderkey % 90 AS INT) AS edad_calculada
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
line AS (
  SELECT l_orderkey AS id, l_linenumber AS slot, CAST(l_shipdate AS DATE) AS ship,
    CAST(l_quantity AS INT) AS qty, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS abierto,
    CASE WHEN l_partkey % 20 = 9 THEN 10 ELSE l_partkey % 10 END AS org,
    CASE WHEN l_suppkey % 7 = 2 AND l_partkey % 2 = 1 THEN 7 ELSE l_suppkey % 7 END AS mec,
    CASE WHEN l_partkey % 9 = 0 THEN 1 ELSE 0 END AS sin_estado,
    CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END AS sin_fecha,
    CASE WHEN l_suppkey % 8 = 0 THEN 1 ELSE 0 END AS nota,
    CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END AS sin_cama, l_suppkey % 56 AS bed
  FROM lineitem),
newest AS (
  SELECT * FROM line QUALIFY row_number() OVER (PARTITION BY id, slot ORDER BY ship DESC, qty DESC,
    abierto DESC, org DESC, mec DESC, sin_estado DESC, sin_fecha DESC, nota DESC, sin_cama DESC,
    bed DESC) = 1),
slot AS (
  SELECT id, slot,
    CASE WHEN sin_estado = 1 THEN NULL WHEN abierto = 1 THEN 'ACTIVO' ELSE 'INACTIVO' END AS estado,
    CASE org WHEN 0 THEN 'Candida auris' WHEN 1 THEN 'Clostridium difficile'
      WHEN 2 THEN 'Virus SARS-CoV-2 (COVID-19)' WHEN 3 THEN 'Klebsiella pneumoniae'
      WHEN 4 THEN 'Acinetobacter baumannii' WHEN 5 THEN 'Serratia marcescens'
      WHEN 6 THEN 'Stenotrophomonas maltophilia' WHEN 7 THEN 'Staphylococcus aureus'
      WHEN 8 THEN 'Virus Influenza A'
      WHEN 9 THEN 'Enterococcus faecium R vancomicina' END AS micro,
    CASE WHEN sin_fecha = 1 THEN NULL ELSE ship END AS muestra,
    CASE mec WHEN 0 THEN 'R = 3 grupos' WHEN 1 THEN 'Carbapenemasa' WHEN 2 THEN 'BLEE tipo 1'
      WHEN 3 THEN 'R meticilina/oxacilina' WHEN 4 THEN 'AmpC' WHEN 5 THEN 'Otro'
      WHEN 7 THEN 'BLEE tipo 2' END AS mecanismo,
    CASE WHEN nota = 1 THEN 'nota' END AS otro,
    ship AS activado,
    CASE WHEN abierto = 0 THEN CAST(ship + to_days(qty) AS DATE) END AS inactivado,
    ship AS f_ingreso,
    CASE WHEN sin_cama = 0 THEN 'B' || bed END AS bed
  FROM newest),
valid AS (SELECT * FROM rec WHERE recstatus = 1),
active AS (SELECT * FROM valid WHERE estado_actual = 'ACTIVO' AND nombre IS NOT NULL),
"""

_SPANISH = """
named AS (
  SELECT id, dado, concat_ws(' ', dado, planta) AS unidad
  FROM (SELECT *, CASE id % 11 WHEN 0 THEN 'Ñandú' WHEN 1 THEN 'Nube' WHEN 2 THEN 'nácar'
    WHEN 3 THEN 'Águila' WHEN 4 THEN 'Ala' WHEN 5 THEN 'ébano' WHEN 6 THEN 'Estela' WHEN 7 THEN 'ñu'
    WHEN 8 THEN 'Oso' WHEN 9 THEN 'Zarza' ELSE 'águila' END AS dado FROM valid)),
"""

# The activity rule in four passes over all rows in order.
_LITERAL = """
cells AS (
  SELECT a.id, n.slot, f.pos, f.name,
    CASE f.pos WHEN 1 THEN s.estado WHEN 2 THEN s.micro WHEN 3 THEN CAST(s.muestra AS VARCHAR)
      WHEN 4 THEN s.mecanismo ELSE s.otro END AS v0
  FROM active a CROSS JOIN (SELECT unnest(range(1, 8)) AS slot) n
  CROSS JOIN (VALUES (1, 'estadoAislamiento'), (2, 'microorganismo'), (3, 'fechaMuestra'),
    (4, 'mecanismoMR'), (5, 'otroMecanismo')) f(pos, name)
  LEFT JOIN slot s ON s.id = a.id AND s.slot = n.slot),
pass1 AS (
  SELECT *, CASE WHEN v0 = 'ACTIVO' AND lead(v0) OVER w IS NULL THEN NULL ELSE v0 END AS v1
  FROM cells WINDOW w AS (ORDER BY id, slot, pos)),
test2 AS (
  SELECT *, lag(v1) OVER w = 'INACTIVO' AND lag(slot, 1) OVER w = slot
    AND name <> 'estadoAislamiento' AS t FROM pass1 WINDOW w AS (ORDER BY id, slot, pos)),
pass2 AS (SELECT id, slot, pos, name, CASE WHEN NOT t THEN v1 END AS v2 FROM test2),
test3 AS (
  SELECT *, lag(v2) OVER w = 'INACTIVO' AND lag(slot, 2) OVER w = slot
    AND name <> 'estadoAislamiento' AS t FROM pass2 WINDOW w AS (ORDER BY id, slot, pos)),
pass3 AS (SELECT id, slot, pos, name, CASE WHEN NOT t THEN v2 END AS v3 FROM test3),
test4 AS (
  SELECT *, lag(v3) OVER w = 'INACTIVO' AND lag(slot, 3) OVER w = slot
    AND name <> 'estadoAislamiento' AS t FROM pass3 WINDOW w AS (ORDER BY id, slot, pos)),
pass4 AS (SELECT id, slot, pos, name, CASE WHEN NOT t THEN v3 END AS v4 FROM test4),
micro_long AS (SELECT id, slot, name, v4 AS value FROM pass4
  WHERE v4 IS NOT NULL AND v4 <> 'INACTIVO'),
live AS (
  SELECT id, slot, max(CASE WHEN name = 'microorganismo' THEN value END) AS micro,
    CAST(max(CASE WHEN name = 'fechaMuestra' THEN value END) AS DATE) AS muestra,
    max(CASE WHEN name = 'mecanismoMR' THEN value END) AS mecanismo,
    max(CASE WHEN name = 'otroMecanismo' THEN value END) AS otro
  FROM micro_long GROUP BY id, slot),
"""


def _organisms(name: str, source: str, where: str, extra: str = "", ampc: bool = True) -> str:
    """CTEs ``name``: first slot per (record, organism, raw mechanism), then named."""
    amp = "WHEN mecanismo = 'AmpC' THEN 'AmpC'" if ampc else ""
    return f"""
{name}_first AS (
  SELECT * FROM {source} WHERE micro IS NOT NULL AND {where}
  QUALIFY row_number() OVER (PARTITION BY id, micro, mecanismo ORDER BY slot) = 1),
{name}_label AS (
  SELECT id, slot, muestra, otro{extra},
    CASE WHEN mecanismo = 'R = 3 grupos' THEN 'MR'
      WHEN mecanismo = 'Carbapenemasa' THEN 'p. de carbapenemasa'
      WHEN contains(mecanismo, 'BLEE') THEN 'BLEE'
      WHEN starts_with(mecanismo, 'R meticilina') THEN 'R meticilina' {amp} END AS etiqueta,
    CASE WHEN micro = 'Clostridium difficile' THEN 'Clostridioides difficile' ELSE micro END AS nom
  FROM {name}_first),
{name} AS (
  SELECT id, slot, muestra, otro{extra}, etiqueta,
    CASE WHEN etiqueta IS NULL THEN nom ELSE nom || ' ' || etiqueta END AS micro
  FROM {name}_label),
"""


_ACTIVE = _BASE + _LITERAL + _organisms("organism", "live", "true") + """
report AS (
  SELECT a.id, a.planta, a.nhc, a.cama, a.motivo, a.tipo, a.origen, o.slot, o.micro, o.muestra, o.otro
  FROM active a LEFT JOIN organism o ON o.id = a.id),
mdr AS (
  SELECT * FROM report WHERE NOT regexp_matches(micro, 'Virus|virus') AND (
    regexp_matches(micro, 'BLEE|MR|carbapenemasa|vancomicina|difficile')
    OR ends_with(micro, 'R meticilina') OR contains(micro, 'Candida auris')
    OR contains(micro, 'Serratia marcescens') OR contains(micro, 'AmpC')
    OR contains(micro, 'Stenotrophomonas maltophilia'))),
classed AS (
  SELECT *, CASE WHEN micro = 'Candida auris' THEN 'C. auris'
    WHEN ends_with(micro, 'MR') THEN 'MMR' WHEN ends_with(micro, 'carbapenemasa') THEN 'EPC'
    WHEN ends_with(micro, 'BLEE') THEN 'BLEE'
    WHEN ends_with(micro, 'R meticilina') THEN 'R meticilina'
    WHEN ends_with(micro, 'difficile') THEN 'C. difficile'
    WHEN contains(micro, 'Serratia marcescens') THEN 'Otros'
    WHEN contains(micro, 'Stenotrophomonas') THEN 'Otros'
    WHEN contains(micro, 'AmpC') THEN 'Otros' ELSE 'NA' END AS clase
  FROM mdr),
per_ward AS (
  SELECT planta, count(*) AS n FROM (
    SELECT planta FROM mdr
    QUALIFY row_number() OVER (PARTITION BY nhc ORDER BY id, slot) = 1)
  GROUP BY planta),
"""

_ALL_SLOTS = _BASE + "valid_slot AS (SELECT * FROM slot WHERE id IN (SELECT id FROM valid)),"

_COVID = (
    _ALL_SLOTS
    + _organisms("organism", "valid_slot", "true", ", estado, activado, inactivado", ampc=False)
    + f"""
cases AS (
  SELECT v.*, o.slot, o.micro, o.muestra, o.otro, o.estado, o.activado, o.inactivado
  FROM valid v JOIN organism o ON o.id = v.id WHERE o.micro = 'Virus SARS-CoV-2 (COVID-19)'),
tested AS (
  SELECT *, estado_actual = 'ACTIVO' AND estado = 'ACTIVO' AS dentro,
    CAST(activado AS TIMESTAMP) > TIMESTAMP '{COVID_CUTOFF}' AS reciente,
    CAST(inactivado AS TIMESTAMP) > TIMESTAMP '{COVID_CUTOFF}' AND estado = 'INACTIVO' AS cerrado
  FROM cases),
groups AS (
  SELECT 'total_ingresados' AS grupo, * FROM tested WHERE dentro
  UNION ALL SELECT 'total_criticos', * FROM tested
    WHERE dentro AND planta IN ('UMI', 'REA', 'REQ', 'UCP', 'UCN')
  UNION ALL SELECT 'casos_nuevos', * FROM tested
    WHERE reciente AND dentro AND ingreso = 'Primer ingreso'
  UNION ALL SELECT 'altas', * FROM tested WHERE cerrado AND retirada <> 'EXITUS'
  UNION ALL SELECT 'exitus', * FROM tested
    WHERE cerrado AND retirada = 'EXITUS' AND causa = 'SI'),
state AS (
  SELECT count(*) FILTER (grupo = 'total_ingresados') AS total_ingresados,
    count(*) FILTER (grupo = 'total_criticos') AS total_criticos,
    count(*) FILTER (grupo = 'casos_nuevos') AS casos_nuevos,
    count(*) FILTER (grupo = 'altas') AS altas, count(*) FILTER (grupo = 'exitus') AS exitus,
    count(*) FILTER (grupo = 'total_ingresados' AND causa = 'SI') AS ingresados_por_covid,
    count(*) FILTER (grupo = 'total_criticos' AND causa = 'SI') AS criticos_por_covid
  FROM groups),
"""
)

_HISTORY = """
hist AS (
  SELECT CAST(ts AS DATE) AS fecha, count(*) FILTER (event_type = 'view') AS total_ingresados,
    count(*) FILTER (event_type = 'purchase') AS total_criticos,
    count(*) FILTER (event_type = 'signup') AS casos_nuevos,
    count(*) FILTER (event_type = 'click') AS altas,
    count(*) FILTER (event_type = 'error') AS exitus
  FROM events GROUP BY 1),
res AS (
  SELECT fecha, total_ingresados AS n_aisl_totales,
    CASE WHEN day(fecha) % 3 = 0 THEN NULL ELSE casos_nuevos END AS n_covid,
    100.0::DOUBLE * total_ingresados / 1068 AS pa_global,
    100.0::DOUBLE * total_criticos / 1068 AS pa_crit,
    100.0::DOUBLE * altas / 1068 AS pa_hosp, 100.0::DOUBLE * casos_nuevos / 1068 AS pa_covid,
    100.0::DOUBLE * exitus / 1068 AS pa_aisl_nosocomial,
    100.0::DOUBLE * casos_nuevos / 1068 AS pa_cauris, 100.0::DOUBLE * exitus / 1068 AS pa_carba,
    100.0::DOUBLE * altas / 1068 AS pa_acineto, 100.0::DOUBLE * total_criticos / 1068 AS pa_cdif
  FROM hist),
"""


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip().rstrip(',')}\n{body.strip()}"


def _stack(source: str, measures: dict[str, str], name: str, value: str, extra: str = "") -> str:
    return "\nUNION ALL ".join(
        f"SELECT fecha, '{m}' AS {name}, {sql} AS {value}{extra} FROM {source}"
        for m, sql in measures.items()
    )


_WARD_OUT = """planta AS "plantaActual", nhc AS "NHC", cama AS "camaActual",
  motivo AS "motivoAislamiento", tipo AS "tipoAislamiento", origen AS "origenInfeccion",
  micro AS "microorganismo", muestra AS "fechaMuestra", otro AS "otroMecanismo" """

_LIST_OUT = """id AS "GlobalRecordId", planta AS "plantaActual", nhc AS "NHC", cama AS "camaActual",
  motivo AS "motivoAislamiento", CAST(slot AS INT) AS slot, micro AS "microorganismo",
  muestra AS "fechaMuestra", otro AS "otroMecanismo" """

_CASE_OUT = """id AS "GlobalRecordId", CAST(slot AS INT) AS slot, sip AS "aSIP", nhc AS "aNHC",
  ingreso AS "INGRESO", estado_actual AS "estadoActual", estado AS "estadoAislamiento",
  planta AS "plantaActual", cama AS "camaActual", tipo AS "tipoAislamiento",
  origen AS "origenInfeccion", retirada AS "motivoRetirada", causa AS "ingresoPorCovid",
  micro AS "microorganismo", muestra AS "fechaMuestra" """

_CLASS_COLUMNS = {
    "c_auris": "C. auris",
    "mmr": "MMR",
    "epc": "EPC",
    "blee": "BLEE",
    "r_meticilina": "R meticilina",
    "c_difficile": "C. difficile",
    "otros": "Otros",
    "na": "NA",
}

_COUNTS = """
counts AS (
  SELECT
    (SELECT count(*) FROM (SELECT DISTINCT cama FROM report)) AS n_aisl_totales,
    (SELECT count(*) FROM (SELECT DISTINCT cama FROM report JOIN ward USING (planta)
      WHERE area = 'HOSP')) AS n_aisl_hosp,
    (SELECT count(*) FROM (SELECT DISTINCT cama FROM report JOIN ward USING (planta)
      WHERE area = 'CRITICOS')) AS n_aisl_crit,
    (SELECT count(*) FROM report WHERE origen = 'Nosocomial') AS n_aisl_nosocomial,
    (SELECT CAST(coalesce(sum(camas), 0) AS BIGINT) FROM ward) AS total_camas,
    (SELECT CAST(coalesce(sum(camas), 0) AS BIGINT) FROM ward WHERE area = 'HOSP')
      AS total_camas_hosp,
    (SELECT CAST(coalesce(sum(camas), 0) AS BIGINT) FROM ward WHERE area = 'CRITICOS')
      AS total_camas_crit,
    (SELECT count(*) FROM report WHERE contains(tipo, 'Gotas') AND contains(micro, 'Virus'))
      AS n_virus_resp_total,
    (SELECT count(*) FROM report WHERE contains(tipo, 'Gotas') AND contains(micro, 'Virus')
      AND NOT contains(micro, 'SARS-CoV-2')) AS n_virus_resp,
    (SELECT count(*) FROM report WHERE contains(micro, 'SARS-CoV-2')) AS n_covid,
    (SELECT count(*) FROM report WHERE contains(lower(micro), 'carbapenemasa')) AS n_carba,
    (SELECT count(*) FROM report WHERE contains(micro, 'Candida auris')) AS n_cauris,
    (SELECT count(*) FROM report WHERE contains(micro, 'difficile')) AS n_cdif,
    (SELECT count(*) FROM report WHERE contains(micro, 'Acineto')) AS n_acineto),
metric AS (
  SELECT *, 100.0::DOUBLE * n_aisl_totales / total_camas AS pa_global,
    100.0::DOUBLE * n_aisl_crit / total_camas_crit AS pa_crit,
    100.0::DOUBLE * n_aisl_hosp / total_camas_hosp AS pa_hosp,
    100.0::DOUBLE * n_acineto / total_camas AS pa_acineto,
    100.0::DOUBLE * n_aisl_nosocomial / total_camas AS pa_aisl_nosocomial,
    100.0::DOUBLE * n_carba / total_camas AS pa_carba,
    100.0::DOUBLE * n_cauris / total_camas AS pa_cauris,
    100.0::DOUBLE * n_cdif / total_camas AS pa_cdif,
    100.0::DOUBLE * n_covid / total_camas AS pa_covid,
    100.0::DOUBLE * n_virus_resp / total_camas AS pa_virus_resp,
    n_covid / nullif(CAST(n_virus_resp AS DOUBLE), 0) AS razon_covid_resp,
    100.0::DOUBLE * n_aisl_nosocomial / nullif(n_aisl_totales, 0) AS ta_aisl_nosocomial,
    100.0::DOUBLE * n_virus_resp / nullif(n_aisl_totales, 0) AS ta_virus_resp
  FROM counts),
"""

_INT_METRICS = (
    "n_aisl_totales n_aisl_hosp n_aisl_crit n_aisl_nosocomial total_camas total_camas_hosp "
    "total_camas_crit n_virus_resp_total n_virus_resp n_covid n_carba n_cauris n_cdif n_acineto"
).split()
_DOUBLE_METRICS = (
    "pa_global pa_crit pa_hosp pa_acineto pa_aisl_nosocomial pa_carba pa_cauris pa_cdif pa_covid "
    "pa_virus_resp razon_covid_resp ta_aisl_nosocomial ta_virus_resp"
).split()


def _printed(metric: str) -> str:
    value = f"CAST({metric} AS DOUBLE)"
    if any(text in metric for text in ("cauris", "carba", "cdif", "acineto")):
        return f"printf('%2.3f', {value}) || '%'"
    if metric.startswith("n_"):
        return f"printf('%2.0f', {value})"
    if metric.startswith(("pa", "ta")):
        return f"printf('%2.2f', {value}) || '%'"
    if metric.startswith("razon"):
        return f"printf('%2.2f', {value})"
    return "CAST(NULL AS VARCHAR)"


_INDICATOR_ROWS = "\nUNION ALL ".join(
    f"SELECT CAST({i + 1} AS INT) AS \"orderId\", 'Indicador {m}' AS indicador, "
    f"'{m} /' || chr(10) || 'total' AS calculo, {_printed(m)} AS resultado FROM metric"
    for i, m in enumerate([*_INT_METRICS, *_DOUBLE_METRICS])
)

_SMOOTH_MEASURES = ("pa_aisl_nosocomial", "pa_cauris", "pa_carba", "pa_acineto", "pa_cdif")
_SMOOTH = _HISTORY + (
    "obs AS ("
    + " UNION ALL ".join(
        f"SELECT '{m}' AS serie, CAST(fecha - DATE '1970-01-01' AS DOUBLE) AS x, {m} AS y FROM res"
        for m in _SMOOTH_MEASURES
    )
    + """),
size AS (SELECT serie, count(*) AS n, min(x) AS lo, max(x) AS hi FROM obs GROUP BY serie),
grid AS (
  SELECT serie, p AS punto, n, lo + p * ((hi - lo) / 79.0::DOUBLE) AS g
  FROM size CROSS JOIN (SELECT unnest(range(0, 80)) AS p)),
near AS (
  SELECT serie, punto, g, x, y, abs(x - g) AS d, floor(0.75::DOUBLE * n + 1e-5) AS q,
    row_number() OVER (PARTITION BY serie, punto ORDER BY abs(x - g)) AS r
  FROM grid JOIN obs USING (serie)),
width AS (SELECT serie, punto, max(d) AS h FROM near WHERE r <= q GROUP BY serie, punto),
weighted AS (
  SELECT serie, punto, g, y, (x - g) / h AS u, pow(1 - pow(d / h, 3), 3) AS w
  FROM near JOIN width USING (serie, punto) WHERE d < h),
sums AS (
  SELECT serie, punto, max(g) AS g, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2,
    sum(w * u * u * u) AS s3, sum(w * u * u * u * u) AS s4,
    sum(w * y) AS t0, sum(w * u * y) AS t1, sum(w * u * u * y) AS t2
  FROM weighted GROUP BY serie, punto),
"""
)

_PURGE = f"""
doomed AS (
  SELECT id FROM rec WHERE (estado_actual = 'INACTIVO' OR nhc IS NULL)
    AND guardado < TIMESTAMP '{PURGE_CUTOFF}'),
kept AS (SELECT id FROM rec WHERE NOT EXISTS (SELECT 1 FROM doomed d WHERE d.id = rec.id)),
lined AS (SELECT DISTINCT id FROM line),
"""


def _page_keys(keys: str) -> str:
    pages = [f"SELECT 'Vigilancia{p}' AS pagina, id AS \"GlobalRecordId\" FROM {keys}"
             for p in ("", "1", "12")]
    pages.append(
        f"SELECT 'Vigilancia13', l.id FROM lined l WHERE EXISTS "
        f"(SELECT 1 FROM {keys} k WHERE k.id = l.id)"
    )
    return "\nUNION ALL ".join(pages)


def _moment(sql: str) -> str:
    return f"strftime(CAST({sql} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"


_STATUS_OUT = f"""recstatus AS "RECSTATUS", {_moment("guardado")} AS "LastSaveTime",
  estado_actual AS "estadoActual", ingreso AS "INGRESO", causa AS "ingresoPorCovid",
  retirada AS "motivoRetirada\""""
_PATIENT_OUT = f"""nombre, sip AS "aSIP", nhc AS "aNHC", planta AS "plantaActual",
  cama AS "camaActual", {_moment("nacimiento")} AS "fechaNacimiento", sexo"""
_ISOLATION_OUT = f"""upper(tipo) AS "tipoAislamiento", upper(origen) AS "origenInfeccion",
  upper(motivo) AS "motivoAislamiento", {_moment("f_aislamiento")} AS "fechaAislamiento",
  {_moment("f_retirada")} AS "fechaRetirada", {_moment("f_alta")} AS "fechaAlta",
  'E' || (id % 9) AS "enfermeraActual", {", ".join(f'{r} AS "{r}"' for r in _RISKS)},
  planta_infeccion AS "plantaInfeccion1", edad_calculada AS "Edad_calculada\""""
_SLOT_OUT = {
    "microorganismoEstado": "estado",
    "microorganismo": "micro",
    "fechaMuestra": "muestra",
    "mecanismoMR": "mecanismo",
    "mecanismoMROtro": "otro",
    "fechaActivacion": _moment("activado"),
    "fechaInactivacion": _moment("inactivado"),
    "fechaIngreso": _moment("f_ingreso"),
    "cama": "bed",
}


def _whole_pages(first: int, action: str, keys: str, ctes: str) -> dict[str, str]:
    """SQL for the four pages, numbered from ``first``, cut to the ids of a CTE."""
    pages = {"status": _STATUS_OUT, "patients": _PATIENT_OUT, "isolation": _ISOLATION_OUT}
    out = {
        f"q{first + i}_{action}_{name}": _with(
            _BASE + ctes, f'SELECT id AS "GlobalRecordId", {shown} FROM rec JOIN {keys} USING (id)'
        )
        for i, (name, shown) in enumerate(pages.items())
    }
    slots = ", ".join(
        f'max(CASE WHEN slot = {k} THEN {sql} END) AS "{name}{k}"'
        for k in range(1, 8)
        for name, sql in _SLOT_OUT.items()
    )
    out[f"q{first + 3}_{action}_slots"] = _with(
        _BASE + ctes,
        f'SELECT id AS "GlobalRecordId", {slots} FROM slot JOIN {keys} USING (id) GROUP BY id',
    )
    return out


def _fields_long(value: dict[str, str], source: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT id AS \"GlobalRecordId\", CAST(slot AS INT) AS slot, '{name}' AS name, "
        f"CAST({sql} AS VARCHAR) AS value FROM {source} WHERE {sql} IS NOT NULL"
        for name, sql in value.items()
    )


_MAP_CELLS = ", ".join(
    f"nullif(count(*) FILTER (clase = '{c}'), 0) AS {n}" for n, c in _CLASS_COLUMNS.items()
)
_MAP_NAMES = ", ".join(_CLASS_COLUMNS)
_MAP_SUM = " + ".join(f"coalesce({n}, 0)" for n in _CLASS_COLUMNS)
_MAP_TOTALS = ", ".join(f"CAST(coalesce(sum({n}), 0) AS BIGINT) AS {n}" for n in _CLASS_COLUMNS)

_MOVES = _BASE + """
entry AS (
  SELECT s.id, r.sip, r.nhc, CAST(s.slot AS INT) AS orden,
    CASE WHEN s.slot = 1 THEN 'ingreso' ELSE 'movimiento' END AS tipo, s.bed AS cama,
    s.f_ingreso AS fecha
  FROM slot s JOIN rec r ON r.id = s.id
  UNION ALL SELECT id, sip, nhc, 8, 'alta', NULL, CAST(f_alta AS DATE) FROM rec),
fresh AS (
  SELECT * FROM entry WHERE fecha IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id, tipo, fecha, cama ORDER BY orden) = 1),
"""

_SNAPSHOTS = _BASE + """
snap AS (
  SELECT id, recstatus, guardado, estado_actual, nombre, nhc, planta_infeccion, edad_calculada,
    1 AS age FROM rec
  WHERE NOT (coalesce(estado_actual, '') = 'INACTIVO' AND guardado < TIMESTAMP '1997-01-01')
  UNION ALL SELECT id, 1, guardado, estado_actual, nombre, nhc, planta_infeccion, edad_calculada, 2
    FROM rec WHERE guardado < TIMESTAMP '1999-01-01'
  UNION ALL SELECT id, 1, guardado, estado_actual, nombre, nhc, NULL, NULL, 3
    FROM rec WHERE guardado < TIMESTAMP '1998-01-01'),
"""


def _moving_average(n: int, where: str) -> str:
    series = f"""
series AS (
  SELECT fecha, 'casos_nuevos' AS name, casos_nuevos AS value FROM hist WHERE {where}
  UNION ALL SELECT fecha, 'exitus', exitus FROM hist WHERE {where}),
"""
    return _with(
        _HISTORY + series,
        f"""
SELECT fecha, name, value,
  CASE WHEN row_number() OVER (PARTITION BY name ORDER BY fecha) >= {n}
    THEN round(avg(value) OVER (PARTITION BY name ORDER BY fecha
      ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 6) END AS media_movil
FROM series""",
    )


_START = f"DATE '{HISTORY_START}'"
_OCCUPANCY = {"total_ingresados": "total_ingresados", "total_criticos": "total_criticos"}
_PRESSURE = {m: f"round({m}, 6)" for m in ("pa_global", "pa_crit", "pa_hosp", "pa_covid")}
_RESISTANT = {
    "pa_acineto": "Acinetobacter baumanii",
    "pa_carba": "Prod. de carbapenemasa",
    "pa_cauris": "Candida auris",
    "pa_cdif": "Clostridioides difficile",
}

_SLOT_VALUES = {
    "estadoAislamiento": "estado",
    "microorganismo": "micro",
    "fechaMuestra": "muestra",
    "mecanismoMR": "mecanismo",
    "otroMecanismo": "otro",
}

ORACLE_SQL: dict[str, str] = {
    "q01_valid_active": _with(
        _BASE,
        """SELECT id AS "GlobalRecordId", nombre, planta AS "plantaActual",
  CAST(guardado AS DATE) AS guardado FROM active""",
    ),
    "q02_slots_long": _with(_ALL_SLOTS, _fields_long(_SLOT_VALUES, "valid_slot")),
    "q03_slot_activity": _with(
        _BASE + _LITERAL,
        'SELECT id AS "GlobalRecordId", CAST(slot AS INT) AS slot, name, value FROM micro_long',
    ),
    "q04_organisms": _with(
        _ACTIVE,
        """SELECT id AS "GlobalRecordId", CAST(slot AS INT) AS slot, micro AS "microorganismo",
  muestra AS "fechaMuestra", otro AS "otroMecanismo" FROM organism""",
    ),
    "q05_organisms_keep_mechanism": _with(
        _ALL_SLOTS + _organisms("organism", "valid_slot", "true"),
        """SELECT id AS "GlobalRecordId", CAST(slot AS INT) AS slot, micro AS "microorganismo",
  muestra AS "fechaMuestra", otro AS "otroMecanismo", etiqueta AS "mecanismoMR" FROM organism""",
    ),
    "q06_organisms_covid": _with(
        _COVID,
        """SELECT id AS "GlobalRecordId", CAST(slot AS INT) AS slot, micro AS "microorganismo",
  muestra AS "fechaMuestra", otro AS "otroMecanismo", estado AS "estadoAislamiento",
  activado AS "fechaActivacion", inactivado AS "fechaInactivacion" FROM organism""",
    ),
    "q07_ward_table": _with(
        _ACTIVE,
        f'SELECT id AS "GlobalRecordId", CAST(slot AS INT) AS slot, {_WARD_OUT} FROM report',
    ),
    "q08_enriched": _with(
        _ALL_SLOTS
        + _organisms("organism", "valid_slot", "true")
        + "first_bed AS (SELECT id, f_ingreso FROM slot WHERE slot = 1),",
        f"""
SELECT v.id AS "GlobalRecordId", CAST(o.slot AS INT) AS slot, planta AS "plantaActual",
  nhc AS "NHC", cama AS "camaActual", motivo AS "motivoAislamiento", tipo AS "tipoAislamiento",
  origen AS "origenInfeccion", micro AS "microorganismo", muestra AS "fechaMuestra",
  otro AS "otroMecanismo", etiqueta AS "mecanismoMR",
  {", ".join(f'{r} AS "{r}"' for r in _RISKS)}, sexo, f_ingreso AS "fechaIngreso1",
  CAST(f_aislamiento AS DATE) AS "fechaAislamiento", CAST(f_retirada AS DATE) AS "fechaRetirada",
  round_even((f_ingreso - nacimiento) / 365.25::DOUBLE, 2) AS edad_al_ingreso,
  CAST(date_diff('day', CAST(f_aislamiento AS DATE), CAST(f_retirada AS DATE)) AS BIGINT)
    AS dias_aislado
FROM valid v LEFT JOIN organism o ON o.id = v.id LEFT JOIN first_bed b ON b.id = v.id""",
    ),
    "q09_mdr_list": _with(_ACTIVE, f"SELECT {_LIST_OUT} FROM mdr"),
    "q10_mdr_list_narrow": _with(
        _ACTIVE,
        f"""SELECT {_LIST_OUT} FROM report WHERE NOT regexp_matches(micro, 'Virus|virus') AND (
  regexp_matches(micro, 'BLEE|MR|carbapenemasa|vancomicina|difficile')
  OR ends_with(micro, 'R meticilina') OR contains(micro, 'Candida auris')
  OR contains(micro, 'Serratia marcescens'))""",
    ),
    "q11_mdr_classes": _with(_ACTIVE, "SELECT clase, count(*) AS n FROM classed GROUP BY clase"),
    "q12_patients_per_ward": _with(
        _ACTIVE, 'SELECT planta AS "plantaActual", n FROM per_ward'
    ),
    "q13_isolation_map": _with(
        _ACTIVE
        + f"""
ward_cells AS (SELECT planta, {_MAP_CELLS} FROM classed GROUP BY planta),
rows_ AS (
  SELECT p.n AS n_pacientes, c.planta, {_MAP_NAMES}, {_MAP_SUM} AS total_unidad
  FROM ward_cells c LEFT JOIN per_ward p ON p.planta IS NOT DISTINCT FROM c.planta),
""",
        f"""
SELECT n_pacientes, planta, {_MAP_NAMES}, total_unidad FROM rows_
UNION ALL SELECT CAST(coalesce(sum(n_pacientes), 0) AS BIGINT), 'Total por MMR', {_MAP_TOTALS},
  CAST(coalesce(sum(total_unidad), 0) AS BIGINT) FROM rows_""",
    ),
    "q14_cleaning_list": _with(
        _ACTIVE,
        """
SELECT coalesce(cama, 'NA') || CASE WHEN micro = 'Candida auris' THEN '¹' ELSE '²' END AS "Cama",
  CASE WHEN regexp_matches(planta, 'UMI|REA|REQ|UCP|UCN') THEN 'criticos'
    ELSE 'hospitalizacion' END AS area
FROM report WHERE (micro = 'Candida auris' OR contains(micro, 'difficile')) AND planta IS NOT NULL""",
    ),
    "q15_indicators": _with(
        _ACTIVE + _COUNTS,
        f"""SELECT DATE '{REPORT_DATE}' AS fecha, {", ".join(_INT_METRICS)},
  {", ".join(f"round({m}, 6) AS {m}" for m in _DOUBLE_METRICS)} FROM metric""",
    ),
    "q16_indicator_table": _with(_ACTIVE + _COUNTS, _INDICATOR_ROWS),
    "q17_isolation_series": _with(
        _HISTORY,
        """
SELECT fecha, CAST(1 + (dayofyear(fecha + CAST(3 - dayofweek(fecha) AS INT)) - 1) // 7 AS INT)
    AS epiweek,
  CAST(year(fecha) AS VARCHAR) AS year, n_aisl_totales,
  round(coalesce(CAST(n_covid AS DOUBLE), pa_covid * 9.73::DOUBLE), 6) AS n_covid FROM res""",
    ),
    "q18_pressure_series": _with(_HISTORY, _stack("res", _PRESSURE, "pa_name", "pa_value")),
    "q19_mdr_series": _with(
        _HISTORY,
        "\nUNION ALL ".join(
            f"SELECT fecha, '{m}' AS pa_mr_name, round({m}, 6) AS pa_mr_value, "
            f"'{label}' AS etiqueta FROM res"
            for m, label in _RESISTANT.items()
        ),
    ),
    "q20_moving_average_7": _moving_average(7, f"fecha >= {_START}"),
    "q21_moving_average_14": _moving_average(14, "true"),
    "q22_loess": _with(
        _SMOOTH,
        """
SELECT serie, CAST(punto AS INT) AS punto, round(g, 6) AS x,
  round((t0 * (s2 * s4 - s3 * s3) - t1 * (s1 * s4 - s2 * s3) + t2 * (s1 * s3 - s2 * s2))
    / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)), 6) AS ajuste
FROM sums""",
    ),
    "q23_covid_cases": _with(
        _COVID,
        f"""SELECT {_CASE_OUT}, strftime(activado, '%Y-%m-%d %H:%M:%S') AS activado,
  strftime(inactivado, '%Y-%m-%d %H:%M:%S') AS inactivado,
  strftime(guardado, '%Y-%m-%d %H:%M:%S') AS guardado FROM cases""",
    ),
    "q24_covid_subsets": _with(_COVID, f"SELECT grupo, {_CASE_OUT} FROM groups"),
    "q25_covid_daily_state": _with(_COVID, f"SELECT DATE '{REPORT_DATE}' AS fecha, * FROM state"),
    "q26_history_upsert": _with(
        _COVID + _HISTORY,
        f"""
SELECT fecha, total_ingresados, total_criticos, casos_nuevos, altas, exitus,
  CAST(NULL AS BIGINT) AS ingresados_por_covid, CAST(NULL AS BIGINT) AS criticos_por_covid
FROM hist WHERE fecha <> DATE '{HISTORY_DAY}'
UNION ALL SELECT DATE '{HISTORY_DAY}', * FROM state""",
    ),
    "q27_history_series": _with(
        _HISTORY + f"part AS (SELECT * FROM hist WHERE fecha >= {_START}),",
        _stack("hist", _OCCUPANCY, "name", "value", ", 'completo' AS periodo")
        + "\nUNION ALL "
        + _stack("part", _OCCUPANCY, "name", "value", ", 'parcial' AS periodo"),
    ),
    "q28_covid_review": _with(
        _COVID,
        """SELECT sip AS "SIP", nhc AS "NHC", cama AS "Cama", causa AS "IngresoPorCovid"
FROM tested WHERE dentro AND (causa = 'DUDOSO' OR causa IS NULL)""",
    ),
    "q29_long_positive": _with(
        _COVID,
        f"""
SELECT sip AS "SIP", nhc AS "NHC", cama AS "Cama", causa AS "IngresoPorCovid",
  CAST(date_diff('day', muestra, DATE '{REPORT_DATE}') AS INT) AS dias_positivo
FROM tested WHERE dentro AND date_diff('day', muestra, DATE '{REPORT_DATE}') >= 10""",
    ),
    "q30_snapshot_merge": _with(
        _SNAPSHOTS,
        """
SELECT id AS "GlobalRecordId", CAST(recstatus AS INT) AS "RECSTATUS",
  CAST(guardado AS DATE) AS "LastSaveTime", estado_actual AS "estadoActual", nombre, nhc AS "aNHC",
  planta_infeccion AS "plantaInfeccion1", edad_calculada AS "Edad_calculada"
FROM (SELECT * FROM snap QUALIFY row_number() OVER (PARTITION BY id ORDER BY age) = 1)
WHERE recstatus = 1""",
    ),
    "q31_bed_movements": _with(
        _MOVES,
        """
SELECT id AS "GlobalRecordId", sip AS "aSIP", nhc AS "aNHC", CAST(orden AS INT) AS orden, tipo,
  last_value(cama IGNORE NULLS) OVER (PARTITION BY id ORDER BY orden
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cama, fecha
FROM fresh""",
    ),
    "q32_retention_purge": _with(_BASE + _PURGE, _page_keys("kept")),
    "q33_orphans_after_purge": _with(
        _BASE + _PURGE,
        """SELECT id AS "GlobalRecordId" FROM lined l
WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.id = l.id)""",
    ),
    "q34_key_repair": _with(
        _BASE
        + """clean AS (SELECT id FROM rec WHERE recstatus = 1 AND nombre IS NOT NULL),
lined AS (SELECT DISTINCT id FROM line),""",
        _page_keys("clean"),
    ),
    "q35_ward_listing": _with(
        _ACTIVE,
        f"SELECT {_WARD_OUT} FROM report WHERE planta IN ('UMI', 'REA', 'REQ', 'UCP', 'UCN')",
    ),
    "q36_report_day": """
SELECT DISTINCT CAST(o_orderdate AS DATE) AS fecha,
  CAST(dayofweek(o_orderdate) + 1 AS INT) AS dia, dayofweek(o_orderdate) = 3 AS completo
FROM orders""",
    "q37_bed_origin_rows": _with(
        _ACTIVE,
        """
SELECT cama AS "camaActual", count(*) AS n_filas,
  count(*) FILTER (origen = 'Nosocomial') AS n_nosocomial,
  round(100.0::DOUBLE * count(*) FILTER (origen = 'Nosocomial') / count(*), 6) AS pct_nosocomial
FROM report GROUP BY cama""",
    ),
    "q38_long_to_rows": _with(
        _ALL_SLOTS,
        """
SELECT id AS "GlobalRecordId", CAST(slot AS INT) AS slot, estado AS "estadoAislamiento",
  micro AS "microorganismo", CAST(muestra AS VARCHAR) AS "fechaMuestra",
  mecanismo AS "mecanismoMR", otro AS "otroMecanismo" FROM valid_slot""",
    ),
    "q39_ward_listing_rest": _with(
        _ACTIVE,
        f"SELECT {_WARD_OUT} FROM report WHERE planta NOT IN ('UMI', 'REA', 'REQ', 'UCP', 'UCN')",
    ),
    "q40_covid_deaths": _with(
        _COVID,
        """SELECT sip AS "SIP", strftime(inactivado, '%d-%m-%Y') AS fecha_exitus
FROM groups WHERE grupo = 'exitus'""",
    ),
    "q41_covid_per_ward": _with(
        _COVID, "SELECT planta, count(*) AS n_ingresados FROM tested WHERE dentro GROUP BY planta"
    ),
    "q42_history_axis": _with(
        _HISTORY,
        f"SELECT CAST(max(fecha) + 7 AS DATE) AS fecha_max, {_START} AS fecha_min FROM hist",
    ),
    "q43_mdr_series_names": _with(
        _HISTORY,
        "SELECT DISTINCT pa_mr_name FROM (VALUES "
        + ", ".join(f"('{m}')" for m in sorted(_RESISTANT))
        + ") v(pa_mr_name) CROSS JOIN hist",
    ),
    "q44_closed_records": _with(
        _BASE,
        f"""
SELECT count(*) AS n, count(*) FILTER (guardado < TIMESTAMP '{PURGE_CUTOFF}') AS n_a_borrar,
  CAST(max(guardado) AS DATE) AS ultimo
FROM rec WHERE estado_actual = 'INACTIVO' OR nhc IS NULL""",
    ),
}

_CLEAN = """
clean AS (SELECT id FROM rec WHERE recstatus = 1 AND nombre IS NOT NULL),
"""
ORACLE_SQL |= _whole_pages(45, "purged", "kept", _PURGE)
ORACLE_SQL |= _whole_pages(49, "repaired", "clean", _CLEAN)
ORACLE_SQL |= {
    "q53_neighbour_organisms": _with(
        _ACTIVE,
        """
SELECT id AS "GlobalRecordId", CAST(slot AS INT) AS slot, micro AS "microorganismo",
  lag(micro) OVER w AS "microorganismo_prev1", lead(micro) OVER w AS "microorganismo_next1"
FROM organism WINDOW w AS (PARTITION BY id ORDER BY slot)""",
    ),
    "q54_last_sample": _with(
        _ACTIVE,
        """
SELECT o.id AS "GlobalRecordId", CAST(o.slot AS INT) AS slot,
  max_by(p.muestra, p.slot) FILTER (p.muestra IS NOT NULL) AS "fechaMuestra"
FROM organism o JOIN organism p ON p.id = o.id AND p.slot <= o.slot GROUP BY o.id, o.slot""",
    ),
    "q55_joined_organisms": _with(
        _ACTIVE,
        """
SELECT id AS "GlobalRecordId", planta AS "plantaActual", CAST(slot AS INT) AS slot,
  micro AS "microorganismo", muestra AS "fechaMuestra", otro AS "otroMecanismo" FROM report""",
    ),
    "q56_bound_ward_counts": _with(
        _ACTIVE,
        """
SELECT planta AS "plantaActual", count(*) AS n_filas,
  count(DISTINCT coalesce(CAST(nhc AS VARCHAR), '-')) AS n_nhc FROM report GROUP BY planta""",
    ),
    "q57_isolation_kinds": _with(
        _ACTIVE,
        """
SELECT planta AS "plantaActual",
  nullif(count(*) FILTER (tipo = 'Contacto/Gotas'), 0) AS contacto_gotas,
  nullif(count(*) FILTER (tipo = 'Contacto'), 0) AS contacto,
  nullif(count(*) FILTER (tipo = 'Gotas'), 0) AS gotas
FROM report GROUP BY planta""",
    ),
    "q58_bed_text": _with(
        _ACTIVE,
        """
SELECT id AS "GlobalRecordId", nullif(regexp_extract(cama, '[0-9]'), '') AS primera,
  right(cama, 1) AS ultima, replace(planta, ' ', '_') AS planta FROM active""",
    ),
    "q59_text_dates": _with(
        _ACTIVE,
        """
SELECT id AS "GlobalRecordId", CAST(slot AS INT) AS slot, micro AS "microorganismo",
  CASE WHEN id % 5 <> 0 THEN muestra END AS "fechaMuestra", otro AS "otroMecanismo"
FROM organism""",
    ),
    "q60_text_stamps": _with(
        _BASE,
        """
SELECT id AS "GlobalRecordId", CASE WHEN id % 5 <> 0 THEN CAST(guardado AS DATE) END AS guardado
FROM rec""",
    ),
    "q61_ward_order": _with(
        _BASE,
        """
SELECT id AS "GlobalRecordId", planta AS "plantaActual", cama AS "camaActual",
  row_number() OVER (PARTITION BY planta ORDER BY cama NULLS LAST, id) AS posicion
FROM active""",
    ),
    "q62_loaded_snapshot": _with(
        _BASE,
        """
SELECT id AS "GlobalRecordId", recstatus AS "RECSTATUS", CAST(guardado AS DATE) AS "LastSaveTime",
  planta AS "plantaActual", cama AS "camaActual"
FROM rec""",
    ),
    "q63_record_numbers": _with(
        _BASE,
        """
SELECT id AS "GlobalRecordId", planta AS "plantaActual", cama AS "camaActual",
  row_number() OVER (ORDER BY planta NULLS LAST, cama NULLS LAST, id) AS "orderId"
FROM valid""",
    ),
    "q64_sequence_neighbours": f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  {", ".join(f"lag(l_linestatus, {n}) OVER w AS l_linestatus_prev{n}" for n in (3, 2, 1))},
  {", ".join(f"lead(l_linestatus, {n}) OVER w AS l_linestatus_next{n}" for n in (1, 2, 3))}
FROM lineitem WINDOW w AS (ORDER BY {_LINE_ORDER})""",
    "q65_sequence_fill": f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  last_value(CASE WHEN l_orderkey % 5 = 0 THEN l_quantity END IGNORE NULLS) OVER (
    ORDER BY {_LINE_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cantidad
FROM lineitem""",
    "q66_sequence_average": f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  round(CASE WHEN count(*) OVER w = 14 THEN avg(l_quantity) OVER w END, 6) AS media_movil
FROM lineitem WINDOW w AS (ORDER BY {_LINE_ORDER} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""",
    "q67_locale_order": _with(
        _BASE + _SPANISH,
        """SELECT id AS "GlobalRecordId", unidad,
  row_number() OVER (ORDER BY unidad COLLATE es, id) AS posicion FROM named""",
    ),
    "q68_locale_groups": _with(
        _BASE + _SPANISH,
        """SELECT min(id) AS primera, max(id) AS ultima, count(*) AS n FROM named
GROUP BY replace(strip_accents(replace(lower(dado), 'ñ', '~')), '~', 'ñ')""",
    ),
    "q69_bucketed_active": _with(
        _BASE,
        """SELECT id AS "GlobalRecordId", nombre, planta AS "plantaActual",
  CAST(guardado AS DATE) AS guardado FROM active""",
    ),
    "q70_stored_purge": _with(_BASE + _PURGE, _page_keys("kept")),
    "q71_found_classes": _with(
        _ACTIVE,
        "SELECT planta AS \"plantaActual\", "
        + ", ".join(
            f"nullif(count(*) FILTER (clase = '{c}'), 0) AS \"{n}\""
            for c, n in (("BLEE", "BLEE"), ("C. auris", "C_auris"), ("C. difficile", "C_difficile"), ("EPC", "EPC"),
                         ("MMR", "MMR"), ("NA", "NA"), ("Otros", "Otros"), ("R meticilina", "R_meticilina"))
        )
        + " FROM classed GROUP BY planta",
    ),
    "q72_loess_band": _with(
        _SMOOTH[: _SMOOTH.index("size AS (")]
        + """
size AS (SELECT serie, count(*) AS n, min(x) AS lo, max(x) AS hi FROM obs GROUP BY serie),
numbered AS (SELECT *, row_number() OVER (PARTITION BY serie ORDER BY x) AS i FROM obs),
grid AS (
  SELECT serie, p AS punto, n, lo + p * ((hi - lo) / 79.0::DOUBLE) AS g
  FROM size CROSS JOIN (SELECT unnest(range(0, 80)) AS p)
  UNION ALL SELECT serie, 79 + i, n, x FROM numbered JOIN size USING (serie)),
near AS (
  SELECT serie, punto, g, i, x, y, abs(x - g) AS d, floor(0.75::DOUBLE * n + 1e-5) AS q,
    row_number() OVER (PARTITION BY serie, punto ORDER BY abs(x - g)) AS r
  FROM grid JOIN numbered USING (serie)),
width AS (SELECT serie, punto, max(d) AS h FROM near WHERE r <= q GROUP BY serie, punto),
weighted AS (
  SELECT serie, punto, g, i, y, (x - g) / h AS u,
    CASE WHEN d < h THEN pow(1 - pow(d / h, 3), 3) ELSE 0 END AS w
  FROM near JOIN width USING (serie, punto)),
sums AS (
  SELECT serie, punto, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2,
    sum(w * u * u * u) AS s3, sum(w * u * u * u * u) AS s4 FROM weighted GROUP BY serie, punto),
rows_ AS (
  SELECT serie, punto, g, i, y, w * ((s2 * s4 - s3 * s3) - (s1 * s4 - s2 * s3) * u + (s1 * s3 - s2 * s2) * u * u)
    / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)) AS l
  FROM weighted JOIN sums USING (serie, punto)),
fits AS (
  SELECT serie, punto, max(g) AS g, sum(l * y) AS fit, sqrt(sum(l * l)) AS norm FROM rows_ GROUP BY serie, punto),
left_ AS (SELECT serie, punto - 79 AS j, i, CASE WHEN punto - 79 = i THEN 1 ELSE 0 END - l AS v FROM rows_
  WHERE punto >= 80),
first_ AS (SELECT serie, sum(v * v) AS d1 FROM left_ GROUP BY serie),
products AS (SELECT a.serie, a.j, b.j AS k, sum(a.v * b.v) AS m FROM left_ a JOIN left_ b
  ON a.serie = b.serie AND a.i = b.i GROUP BY a.serie, a.j, b.j),
second_ AS (SELECT serie, sum(m * m) AS d2 FROM products GROUP BY serie),
residual AS (SELECT n.serie, sum((n.y - f.fit) * (n.y - f.fit)) AS rss FROM numbered n JOIN fits f
  ON f.serie = n.serie AND f.punto = 79 + n.i GROUP BY n.serie),
told AS (SELECT serie, sqrt(rss / d1) AS s, d1 * d1 / d2 AS df FROM first_ JOIN second_ USING (serie)
  JOIN residual USING (serie)),
reach AS (SELECT *, 1.959963984540054::DOUBLE AS z FROM told),
tails AS (SELECT serie, s, z + (pow(z, 3) + z) / 4 / df + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / 96 / pow(df, 2)
    + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / 384 / pow(df, 3)
    + (79 * pow(z, 9) + 776 * pow(z, 7) + 1482 * pow(z, 5) - 1920 * pow(z, 3) - 945 * z) / 92160 / pow(df, 4) AS t
  FROM reach),""",
        """
SELECT serie, CAST(punto AS INT) AS punto, round(g, 6) AS x, round(fit, 6) AS ajuste,
  round(fit - t * s * norm, 6) AS lo, round(fit + t * s * norm, 6) AS hi
FROM fits JOIN tails USING (serie) WHERE punto < 80""",
    ),
}
ORACLE_SQL["q74_written_report"] = _with(
    _BASE,
    """SELECT id AS "Registro", CAST(year(guardado) AS INT) AS "Anyo", CAST(year(guardado) // 100 AS INT) AS "Siglo",
  nombre AS "Paciente", planta AS "Planta" FROM active""",
)
ORACLE_SQL["q75_replaced_history"] = _with(
    _HISTORY,
    f"""SELECT fecha, total_ingresados, total_criticos, casos_nuevos,
  CASE WHEN fecha = DATE '{HISTORY_DAY}' THEN 0 ELSE altas END AS altas, exitus FROM hist""",
)
# the same rows, whether snapshots are merged at once or one by one
ORACLE_SQL["q73_stored_merge"] = ORACLE_SQL["q30_snapshot_merge"]
