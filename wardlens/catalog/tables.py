"""Surveillance tables derived from the sample star schema.

The sample data has no hospital in it, so each domain table is a projection or an
aggregation of the given tables: orders are records, line items are slots, nations
are wards, events are the daily history. All rows of the sources take part.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from datetime import date, datetime
from functools import cache, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.constants import CRITICAL_WARDS, KEY
from wardlens.operators import keys
from wardlens.plans.indicators import METRICS
from wardlens.plans.isolation import RISK_FACTORS
from wardlens.sources.tables import join_pages

REPORT_DATE = date(1999, 6, 1)
COVID_CUTOFF = datetime(1998, 1, 1, 13, 50)
PURGE_CUTOFF = date(1997, 1, 1)
HISTORY_DAY = date(2024, 1, 15)
HISTORY_START = date(2024, 1, 10)
TOTAL_BEDS = 1068.0

SLOTS = range(1, 8)  # the slots of the form; a line outside them ends the query

ORGANISMS = (
    "Candida auris",
    "Clostridium difficile",
    "Virus SARS-CoV-2 (COVID-19)",
    "Klebsiella pneumoniae",
    "Acinetobacter baumannii",
    "Serratia marcescens",
    "Stenotrophomonas maltophilia",
    "Staphylococcus aureus",
    "Virus Influenza A",
    "Enterococcus faecium R vancomicina",
)
RAW_MECHANISMS = (
    "R = 3 grupos",
    "Carbapenemasa",
    "BLEE tipo 1",
    "R meticilina/oxacilina",
    "AmpC",
    "Otro",
)


Reader = Callable[[str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quoted(values: Iterable[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _nth(index: str, values: Iterable[str]) -> str:
    """SQL for the value at a zero-based position; null outside the list."""
    return f"try_element_at(array({_quoted(values)}), CAST({index} AS INT) + 1)"


WARD_NAME = "coalesce({}, n_name)".format


def wards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ward, area and beds; the last ward has no bed count."""
    name = WARD_NAME(_nth("n_nationkey", CRITICAL_WARDS))
    return read(spark, sf_dir, "nation").selectExpr(
        f"{name} AS plantaActual",
        "CASE WHEN n_nationkey < 5 THEN 'CRITICOS' ELSE 'HOSP' END AS areaHospital",
        "CASE WHEN n_nationkey <> 24 THEN 10 + 3 * n_nationkey END AS nCamas",
    )


# The pages of the surveillance form: column name -> SQL over the rows behind it.
STATUS_PAGE = {
    "RECSTATUS": "CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE 1 END",
    "LastSaveTime": "o_orderdate",
    "estadoActual": "CASE WHEN o_orderstatus = 'F' THEN 'INACTIVO' "
    "WHEN NOT (o_orderstatus = 'P' AND o_orderkey % 4 = 0) THEN 'ACTIVO' END",
    "INGRESO": _nth("o_orderkey % 2", ["Primer ingreso", "Reingreso"]),
    "ingresoPorCovid": _nth("o_orderkey % 4", ["SI", "NO", "DUDOSO"]),
    "motivoRetirada": _nth("o_orderkey % 5", ["EXITUS", "ALTA", "ALTA", "ALTA"]),
}
PATIENT_PAGE = {
    "nombre": "CASE WHEN o_custkey % 50 <> 0 THEN c_name END",
    "aSIP": "concat('SIP', o_custkey)",
    "aNHC": "CASE WHEN o_custkey % 37 <> 0 THEN o_custkey END",
    "plantaActual": f"CASE WHEN o_orderkey % 41 <> 0 "
    f"THEN {WARD_NAME(_nth('c_nationkey', CRITICAL_WARDS))} END",
    "camaActual": "CASE WHEN o_orderkey % 43 <> 0 THEN concat('C', o_orderkey % 400) END",
    "fechaNacimiento": "CAST(date_add(DATE'1930-01-01', CAST(o_custkey % 20000 AS INT)) "
    "AS timestamp_ntz)",
    "sexo": _nth("o_custkey % 2", ["Mujer", "Hombre"]),
}
ISOLATION_PAGE = {
    "tipoAislamiento": _nth("o_orderkey % 3", ["CONTACTO/GOTAS", "CONTACTO", "GOTAS"]),
    "origenInfeccion": "CASE WHEN o_orderpriority < '3' THEN 'NOSOCOMIAL' ELSE 'COMUNITARIO' END",
    "motivoAislamiento": "o_orderpriority",
    "fechaAislamiento": "CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate END",
    "fechaRetirada": "CASE WHEN o_orderstatus <> 'O' "
    "THEN o_orderdate + make_dt_interval(CAST(o_orderkey % 60 AS INT)) END",
    "fechaAlta": "CASE WHEN o_orderpriority <> '1-URGENT' "
    "THEN o_orderdate + INTERVAL '30' DAY END",
    "enfermeraActual": "concat('E', o_orderkey % 9)",
    **{
        name: f"CASE WHEN o_orderkey % {3 + i} = 0 THEN 'SI' ELSE 'NO' END"
        for i, name in enumerate(RISK_FACTORS)
    },
    "plantaInfeccion1": "concat('P', o_orderkey % 5)",
    "Edad_calculada": "CAST(o_orderkey % 90 AS INT)",
}


# What a slot is made of, from the leading part to the last: name, least and greatest value, whether
# it can be missing, whether it can leave its range, SQL over a line. The ranges are those of the types
# and terms, but for the quantity; a value outside ends the query, it never changes another part.
LINE_PARTS = (
    ("dia", -719_162, 2_932_896, True, True, "unix_date(to_date(l_shipdate))"),
    ("cantidad", 0, 99_999, True, True, "l_quantity"),
    ("abierto", 0, 1, False, False, "coalesce(l_linestatus = 'O', false)"),
    ("organismo", 0, 10, True, False, "IF(l_partkey % 20 = 9, 10, pmod(l_partkey, 10))"),
    ("mecanismo", 0, 7, True, False, "IF(l_suppkey % 7 = 2 AND l_partkey % 2 = 1, 7, pmod(l_suppkey, 7))"),
    ("sin_estado", 0, 1, False, False, "coalesce(l_partkey % 9 = 0, false)"),
    ("sin_fecha", 0, 1, False, False, "coalesce(l_partkey % 11 = 0, false)"),
    ("nota", 0, 1, False, False, "coalesce(l_suppkey % 8 = 0, false)"),
    ("sin_cama", 0, 1, False, False, "coalesce(l_partkey % 5 = 0, false)"),
    ("cama", 0, 55, True, False, "pmod(l_suppkey, 56)"),
)


def _bits(least: int, most: int) -> int:
    """Bits for the values of a part, moved up by one; 0 stands for a missing value."""
    return (most - least + 1).bit_length()


if sum(_bits(least, most) for _, least, most, *_ in LINE_PARTS) > 63:
    raise ValueError("the parts of a line do not fit one number")


def _line_number() -> str:
    """SQL that packs the parts of a line into one number sorting like the parts, missing first.

    Only parts that can leave their range are tested, so that the JVM compiles the generated method:
    it interprets methods of 8,000 bytes and more.
    """
    packed = "0L"
    for name, least, most, missing, tested, sql in LINE_PARTS:
        whole = name == "cantidad"
        code = f"CAST({sql} AS BIGINT) + {1 - least}L"
        if tested:
            fits = f"{sql} BETWEEN {least} AND {most}" + (f" AND {sql} = floor({sql})" if whole else "")
            error = f"raise_error(concat('lineitem: {name} is ', {sql}, ', not in {least} to {most}'))"
            code = f"CASE WHEN {fits} THEN {code} WHEN {sql} IS NOT NULL THEN {error} END"
        if missing:
            code = f"coalesce({code}, 0L)"
        packed = f"shiftleft({packed}, {_bits(least, most)}) | {code}" if packed != "0L" else code
    return packed


def _slot_fields(line: str) -> dict[str, str]:
    """SQL for the fields of a slot, out of a packed line."""
    part, shift = {}, 0
    for name, least, most, missing, *_ in reversed(LINE_PARTS):
        bits = _bits(least, most)
        code = f"shiftright({line}, {shift}) & {2**bits - 1}L"
        code = f"nullif({code}, 0L)" if missing else f"({code})"
        part[name] = f"CAST({code} - {1 - least}L AS INT)"
        shift += bits
    day = f"date_from_unix_date({part['dia']})"
    ship = f"CAST({day} AS timestamp_ntz)"
    return {
        "microorganismoEstado": f"CASE WHEN {part['sin_estado']} = 0 "
        f"THEN IF({part['abierto']} = 1, 'ACTIVO', 'INACTIVO') END",
        "microorganismo": f"get(array({_quoted(ORGANISMS)}), {part['organismo']})",
        "fechaMuestra": f"CASE WHEN {part['sin_fecha']} = 0 THEN {day} END",
        "mecanismoMR": f"get(array({_quoted(RAW_MECHANISMS)}, NULL, 'BLEE tipo 2'), "
        f"{part['mecanismo']})",
        "mecanismoMROtro": f"CASE WHEN {part['nota']} = 1 THEN 'nota' END",
        "fechaActivacion": ship,
        "fechaInactivacion": f"CASE WHEN {part['abierto']} = 0 "
        f"THEN {ship} + make_dt_interval({part['cantidad']}) END",
        "fechaIngreso": ship,
        "cama": f"CASE WHEN {part['sin_cama']} = 0 THEN concat('B', {part['cama']}) END",
    }


SLOT_FIELD_SQL = _slot_fields("linea")

# Slot fields are unpacked in groups, so that a query unpacks what it reads.
SLOT_GROUPS = {
    "_cultivos": (
        "microorganismoEstado",
        "microorganismo",
        "fechaMuestra",
        "mecanismoMR",
        "mecanismoMROtro",
    ),
    "_tiempos": ("fechaActivacion", "fechaInactivacion"),
    "_camas": ("fechaIngreso", "cama"),
}
SLOT_PAGE = {
    f"{field}{k}": f"get({group}, {k - 1}).{field}"
    for k in SLOTS
    for group, fields in SLOT_GROUPS.items()
    for field in fields
}


def _people(read_table: Reader) -> DataFrame:
    return (
        read_table("orders")
        .join(read_table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(read_table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )


def _gathered_slots(read_table: Reader) -> DataFrame:
    """One row per order with its slots, one slot per line number.

    The lines of an order that share a number are one slot; the newest of them, by
    ship date and then by its other parts, describes it. The parts are packed into
    one number, so the newest line is a plain maximum: one aggregation that combines
    before the shuffle, in which an order with very many lines costs no more than
    others. Missing parts have a code of their own, below all values, as SQL sorts them.
    A null line number, or one that the form has no slot for, is an error.
    """
    lines = read_table("lineitem").selectExpr(
        "l_orderkey", "l_linenumber", f"{_line_number()} AS line"
    )
    first, last = SLOTS[0], SLOTS[-1]
    outside = (
        f"WHEN NOT coalesce(l_linenumber BETWEEN {first} AND {last}, false) THEN raise_error("
        f"concat('lineitem: line number ', coalesce(CAST(l_linenumber AS STRING), 'missing'), ', the form has {first} to {last}'))"
    )
    newest = [
        F.expr(
            f"max(CASE WHEN l_linenumber = {k} THEN line {outside if k == first else ''} END)"
            f" AS slot{k}"
        )
        for k in SLOTS
    ]
    packed = ", ".join(f"slot{k}" for k in SLOTS)
    groups = []
    for group, names in SLOT_GROUPS.items():
        fields = ", ".join(f"'{f}', {SLOT_FIELD_SQL[f]}" for f in names)
        slot = f"IF(linea IS NOT NULL, named_struct({fields}), NULL)"
        groups.append(f"transform(array({packed}), linea -> {slot}) AS {group}")
    return lines.groupBy("l_orderkey").agg(*newest).selectExpr("l_orderkey", *groups)


PAGES = {
    "Vigilancia": (lambda read_table: read_table("orders"), "o_orderkey", STATUS_PAGE),
    "Vigilancia1": (_people, "o_orderkey", PATIENT_PAGE),
    "Vigilancia12": (lambda read_table: read_table("orders"), "o_orderkey", ISOLATION_PAGE),
    "Vigilancia13": (_gathered_slots, "l_orderkey", SLOT_PAGE),
}


def pages(
    spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None
) -> dict[str, DataFrame]:
    """The pages of the surveillance form, the status page first.

    With ``columns`` only the pages that supply one of them, and the status page.
    """
    wanted = None if columns is None else set(columns)
    read_table = cache(partial(read, spark, sf_dir))  # each schema is looked up once per form
    form = {}
    for name, (rows, key, parts) in PAGES.items():
        if wanted is None or name == "Vigilancia" or wanted & parts.keys():
            shown = [f"{sql} AS {column}" for column, sql in parts.items()]
            form[name] = rows(read_table).selectExpr(f"{key} AS {KEY}", *shown)
    return form


def surveillance(
    spark: SparkSession,
    sf_dir: str,
    columns: Iterable[str],
    slots: str | None = None,
    spread: bool = False,
) -> DataFrame:
    """Wide records with the wanted columns; ``slots`` is a pattern of slot columns.

    With ``spread`` the records stay in all shuffle partitions (``operators.keys.spread``).
    """
    extra = [c for c in SLOT_PAGE if slots and re.search(slots, c)]
    wanted = [*columns, *extra]
    form = pages(spark, sf_dir, wanted)
    if spread:
        form["Vigilancia"] = keys.spread(form["Vigilancia"])
    return join_pages(form, wanted)


def snapshots(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three states of the database, the newest first.

    The newest has lost closed records from before 1997 and carries the deletion
    marks; the middle one ends in 1999; the oldest ends in 1998 and lacks two
    columns. Older states show every record as live.
    """
    columns = ["RECSTATUS", "LastSaveTime", "estadoActual", "nombre", "aNHC"]
    added = ["plantaInfeccion1", "Edad_calculada"]
    full = surveillance(spark, sf_dir, [*columns, *added])
    live = full.withColumn("RECSTATUS", F.lit(1))
    saved = F.col("LastSaveTime")
    purged = F.coalesce(F.col("estadoActual") == "INACTIVO", F.lit(False)) & (
        saved < F.lit(date(1997, 1, 1))
    )
    return [
        full.filter(~purged),
        live.filter(saved < F.lit(date(1999, 1, 1))),
        live.filter(saved < F.lit(date(1998, 1, 1))).drop(*added),
    ]


def _event_counts(spark: SparkSession, sf_dir: str, names: dict[str, str]) -> DataFrame:
    kind = F.col("event_type")
    return (
        read(spark, sf_dir, "events")
        .groupBy(F.to_date("ts").alias("fecha"))
        .agg(*[F.count_if(kind == event).alias(name) for event, name in names.items()])
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily outbreak history: one row per day, counts of events."""
    return _event_counts(
        spark,
        sf_dir,
        {
            "view": "total_ingresados",
            "purchase": "total_criticos",
            "signup": "casos_nuevos",
            "click": "altas",
            "error": "exitus",
        },
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily indicator results; the COVID count is missing on every third day."""
    counts = _event_counts(
        spark,
        sf_dir,
        {"view": "vw", "purchase": "pu", "signup": "su", "click": "cl", "error": "er"},
    )
    percent = {
        "pa_global": "vw",
        "pa_crit": "pu",
        "pa_hosp": "cl",
        "pa_covid": "su",
        "pa_aisl_nosocomial": "er",
        "pa_cauris": "su",
        "pa_carba": "er",
        "pa_acineto": "cl",
        "pa_cdif": "pu",
    }
    return counts.select(
        "fecha",
        F.col("vw").alias("n_aisl_totales"),
        F.when(F.dayofmonth("fecha") % 3 != 0, F.col("su")).alias("n_covid"),
        *[(100.0 * F.col(c) / TOTAL_BEDS).alias(name) for name, c in percent.items()],
    )


def metadata(spark: SparkSession) -> DataFrame:
    """Printed name and formula of each metric, in print order."""
    rows = ", ".join(
        f"({i}, '{m}', 'Indicador {m}', '{m} / total')" for i, m in enumerate(METRICS)
    )
    return spark.sql(
        f"SELECT * FROM VALUES {rows} AS m(posicion, id_indicador, indicador, calculo)"
    )
