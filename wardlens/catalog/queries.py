"""Named queries over the sample tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.catalog import tables as t
from wardlens.constants import (
    CRITICAL_WARDS,
    KEY,
    MDR_PATTERNS,
    MDR_PATTERNS_NARROW,
    MECHANISMS_WITHOUT_AMPC,
    SLOT_PREFIXES,
    SLOT_PREFIXES_WITH_TIMES,
)
from wardlens.functions import (
    count_distinct_with_null,
    first_digit,
    is_report_day,
    last_character,
    parse_dmy,
    parse_stamp,
    replace_all,
    weekday,
)
from wardlens.operators import keys
from wardlens.operators import slots as s
from wardlens.operators.columns import across, derive, present, relocate, starting_with
from wardlens.operators.ordered import (
    fill_down_sequence,
    moving_average_sequence,
    neighbours_in_sequence,
    numbered,
)
from wardlens.operators.reshape import cross_table, cross_table_found, long_to_rows
from wardlens.operators.series import fill_down, moving_average, neighbours
from wardlens.plans import (
    indicators,
    isolation,
    movements,
    outbreak,
    retention,
    trends,
)
from wardlens.functions.text import in_locale
from wardlens.sources import (
    fetch_optional,
    fetch_table,
    first_with_column,
    join_pages,
    load_snapshot,
    overwrite_days,
    safe_replace,
    shared_folder,
    table_version,
    write_report,
)
from wardlens.sources.page_store import (
    merge_snapshot,
    purge_pages,
    read_merged,
    read_pages,
    write_bucketed,
    write_pages,
)

Query = Callable[[SparkSession, str], DataFrame]

COHORT = ("RECSTATUS", "estadoActual", "nombre")
SLOT_COLUMNS = f"^({'|'.join(SLOT_PREFIXES)})"
SLOT_AND_TIME_COLUMNS = f"^({'|'.join(SLOT_PREFIXES_WITH_TIMES)})"


def _active(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    wide = t.surveillance(spark, sf_dir, [*COHORT, *columns], SLOT_COLUMNS)
    return isolation.active_records(wide)


def _valid(
    spark: SparkSession, sf_dir: str, columns: tuple[str, ...], slots: str, spread: bool = False
) -> DataFrame:
    wide = t.surveillance(spark, sf_dir, ["RECSTATUS", *columns], slots, spread)
    return isolation.valid_records(wide)


def _ward_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolation.ward_table(_active(spark, sf_dir, *isolation.WARD_TABLE_COLUMNS))


def _resistant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolation.resistant_list(_ward_rows(spark, sf_dir), MDR_PATTERNS)


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbreak.covid_cases(t.pages(spark, sf_dir))


def valid_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = t.surveillance(spark, sf_dir, [*COHORT, "plantaActual", "LastSaveTime"])
    rows = isolation.active_records(wide)
    return rows.select(KEY, "nombre", "plantaActual", F.to_date("LastSaveTime").alias("guardado"))


def slots_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.slots_long(_valid(spark, sf_dir, (), SLOT_COLUMNS))


def slot_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.active_slots_long(_active(spark, sf_dir))


def organisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.organism_rows(_active(spark, sf_dir))


def organisms_keep_mechanism(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = _valid(spark, sf_dir, (), SLOT_COLUMNS)
    return s.organism_rows(valid, active_only=False, keep_mechanism=True)


def organisms_covid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.organism_rows(
        _valid(spark, sf_dir, (), SLOT_AND_TIME_COLUMNS),
        active_only=False,
        mechanisms=MECHANISMS_WITHOUT_AMPC,
        keep_state=True,
    )
    return rows.withColumns({c: F.to_date(c) for c in ("fechaActivacion", "fechaInactivacion")})


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = ("fechaIngreso1", "fechaAislamiento", "fechaRetirada")
    columns = (
        *isolation.WARD_TABLE_COLUMNS,
        *isolation.RISK_FACTORS,
        "sexo",
        "fechaNacimiento",
        *dates,
    )
    rows = isolation.enriched_table(_valid(spark, sf_dir, columns, SLOT_COLUMNS))
    return rows.withColumns({c: F.to_date(c) for c in dates})


def mdr_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resistant(spark, sf_dir).drop("tipoAislamiento", "origenInfeccion")


def mdr_list_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = isolation.resistant_list(_ward_rows(spark, sf_dir), MDR_PATTERNS_NARROW)
    return rows.drop("tipoAislamiento", "origenInfeccion")


def mdr_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolation.resistant_classes(_resistant(spark, sf_dir))


def patients_per_ward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolation.patients_per_ward(_resistant(spark, sf_dir))


def isolation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolation.sorted_isolation_map(_resistant(spark, sf_dir))


def cleaning_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolation.cleaning_list(_ward_rows(spark, sf_dir)).orderBy("area", "Cama")


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    doubles = [f.name for f in df.schema if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(c, places) for c in doubles})


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.indicators(
        _ward_rows(spark, sf_dir), t.wards(spark, sf_dir), t.REPORT_DATE
    )


def indicator_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_metrics(spark, sf_dir))


def indicator_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = indicators.indicator_names(t.metadata(spark), "posicion")
    return indicators.indicator_table(_metrics(spark, sf_dir), names)


def isolation_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trends.isolation_series(t.results(spark, sf_dir)))


def pressure_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trends.pressure_series(t.results(spark, sf_dir)))


def mdr_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trends.resistant_series(t.results(spark, sf_dir)))


def mdr_series_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.series_names(trends.resistant_series(t.results(spark, sf_dir)), "pa_mr_name")


def moving_average_7(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = outbreak.incidence_series(t.history(spark, sf_dir), t.HISTORY_START)
    return _rounded(moving_average(series, "name", "fecha", "value", 7))


def moving_average_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = outbreak.incidence_series(t.history(spark, sf_dir))
    return _rounded(moving_average(series, "name", "fecha", "value", 14))


def loess(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = ["pa_aisl_nosocomial", "pa_cauris", "pa_carba", "pa_acineto", "pa_cdif"]
    return _rounded(trends.smooth_series(t.results(spark, sf_dir), measures))


def loess_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = ["pa_aisl_nosocomial", "pa_cauris", "pa_carba", "pa_acineto", "pa_cdif"]
    return _rounded(trends.smooth_series_band(t.results(spark, sf_dir), measures))


CASE_SHOWN = (
    KEY,
    "slot",
    "aSIP",
    "aNHC",
    "INGRESO",
    "estadoActual",
    "estadoAislamiento",
    "plantaActual",
    "camaActual",
    "tipoAislamiento",
    "origenInfeccion",
    "motivoRetirada",
    "ingresoPorCovid",
    "microorganismo",
    "fechaMuestra",
)


def covid_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = "yyyy-MM-dd HH:mm:ss"
    return outbreak.newest_first(_cases(spark, sf_dir)).select(
        *CASE_SHOWN,
        F.date_format("fechaActivacion", stamp).alias("activado"),
        F.date_format("fechaInactivacion", stamp).alias("inactivado"),
        F.date_format("LastSaveTime", stamp).alias("guardado"),
    )


def covid_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outbreak.case_subsets(_cases(spark, sf_dir), t.COVID_CUTOFF)
    return rows.select("grupo", *CASE_SHOWN)


def covid_deaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbreak.death_details(_cases(spark, sf_dir), t.COVID_CUTOFF)


def covid_daily_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbreak.daily_state(_cases(spark, sf_dir), t.COVID_CUTOFF, t.REPORT_DATE)


def covid_per_ward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbreak.admitted_per_ward(_cases(spark, sf_dir))


def history_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = outbreak.daily_state(_cases(spark, sf_dir), t.COVID_CUTOFF, t.HISTORY_DAY)
    return outbreak.update_history(t.history(spark, sf_dir), state, t.HISTORY_DAY)


def history_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = t.history(spark, sf_dir)
    return keys.append(
        outbreak.occupancy_series(daily).withColumn("periodo", F.lit("completo")),
        outbreak.occupancy_series(daily, t.HISTORY_START).withColumn("periodo", F.lit("parcial")),
    )


def history_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = parse_dmy(F.lit(t.HISTORY_START.strftime("%d/%m/%y")))
    return outbreak.axis_end(t.history(spark, sf_dir)).withColumn("fecha_min", start)


def covid_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbreak.doubtful_cause(_cases(spark, sf_dir))


def long_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbreak.long_positive(_cases(spark, sf_dir), t.REPORT_DATE)


def _saved_as_date(df: DataFrame) -> DataFrame:
    return df.withColumn("LastSaveTime", F.to_date("LastSaveTime"))


def snapshot_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _saved_as_date(keys.snapshot_merge(t.snapshots(spark, sf_dir)))


def bed_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = t.surveillance(
        spark, sf_dir, ["aSIP", "aNHC", "fechaAlta"], r"^(fechaIngreso|cama)\d"
    )
    return movements.bed_movements(wide).withColumn("fecha", F.to_date("fecha"))


def _page_keys(pages: dict[str, DataFrame]) -> DataFrame:
    named = [df.select(F.lit(name).alias("pagina"), KEY) for name, df in pages.items()]
    return keys.append(*named)


def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = retention.purge(t.pages(spark, sf_dir), t.PURGE_CUTOFF)
    return _page_keys(kept)


def closed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = t.pages(spark, sf_dir, ["estadoActual", "aNHC", "LastSaveTime"])
    closed = retention.closed_records(form)
    return closed.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("LastSaveTime") < F.lit(t.PURGE_CUTOFF)).alias("n_a_borrar"),
        F.to_date(F.max("LastSaveTime")).alias("ultimo"),
    )


def orphans_after_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later pages against the purged first page: what a purge of one table leaves over."""
    form = t.pages(spark, sf_dir)
    first_two = {n: form[n] for n in ("Vigilancia", "Vigilancia1")}
    kept = retention.purge(first_two, t.PURGE_CUTOFF)["Vigilancia"]
    left = retention.orphans({"Vigilancia": kept, "Vigilancia13": form["Vigilancia13"]})
    return left["Vigilancia13"].select(KEY)


def key_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = retention.repair(t.pages(spark, sf_dir), "Vigilancia1")
    return _page_keys(clean)


def _whole_page(df: DataFrame) -> DataFrame:
    """All columns of a page, moments as text."""
    moments = [f.name for f in df.schema if f.dataType.simpleString().startswith("timestamp")]
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in moments})


def purged_page(name: str) -> Query:
    """One whole page after the purge."""
    return lambda spark, sf_dir: _whole_page(
        retention.purge(t.pages(spark, sf_dir), t.PURGE_CUTOFF)[name]
    )


def repaired_page(name: str) -> Query:
    """One whole page after the repair."""
    return lambda spark, sf_dir: _whole_page(
        retention.repair(t.pages(spark, sf_dir), "Vigilancia1")[name]
    )


def ward_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolation.ward_listing(_ward_rows(spark, sf_dir), CRITICAL_WARDS)


def ward_listing_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolation.ward_listing(_ward_rows(spark, sf_dir), CRITICAL_WARDS, within=False)


def report_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = t.surveillance(spark, sf_dir, ["LastSaveTime"])
    days = saved.select(F.to_date("LastSaveTime").alias("fecha")).distinct()
    return days.select(
        "*", weekday(F.col("fecha")).alias("dia"), is_report_day(F.col("fecha")).alias("completo")
    )


def bed_origin_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(indicators.rows_per_bed_origin(_ward_rows(spark, sf_dir)))


def long_to_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = _valid(spark, sf_dir, (), SLOT_AND_TIME_COLUMNS, spread=True)
    long = s.slots_long(valid, prefixes=SLOT_PREFIXES_WITH_TIMES)
    fields = [f for f in s.FIELD_ORDER if f not in (s.ACTIVATED, s.INACTIVATED)]
    return long_to_rows(long, [KEY, "slot"], fields, "name", "value")


def neighbour_organisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = organisms(spark, sf_dir).select(KEY, "slot", "microorganismo")
    return neighbours(rows, [KEY], ["slot"], "microorganismo", [-1, 1])


def last_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = organisms(spark, sf_dir).select(KEY, "slot", "fechaMuestra")
    return fill_down(rows, KEY, ["slot"], "fechaMuestra")


def joined_organisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = _active(spark, sf_dir, "plantaActual")
    return s.join_organisms(active.select(KEY, "plantaActual"), s.organism_rows(active))


def bound_ward_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and patients of each ward side by side; the missing ward is one of them."""
    by_ward = _ward_rows(spark, sf_dir).groupBy("plantaActual")
    rows = by_ward.agg(F.count("*").alias("n_filas"))
    people = by_ward.agg(count_distinct_with_null(F.col("NHC")).alias("n_nhc"))
    return keys.bind_by_key(rows, people, "plantaActual")


def isolation_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("Contacto/Gotas", "Contacto", "Gotas")
    labels = ("contacto_gotas", "contacto", "gotas")
    return cross_table(_ward_rows(spark, sf_dir), "plantaActual", "tipoAislamiento", kinds, labels)


def bed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    bed = F.col("camaActual")
    return _active(spark, sf_dir, "camaActual", "plantaActual").select(
        KEY,
        first_digit(bed).alias("primera"),
        last_character(bed).alias("ultima"),
        replace_all(F.col("plantaActual"), " ", "_").alias("planta"),
    )


def text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisms of records that keep sample dates as text, those of every fifth record malformed."""
    active = _active(spark, sf_dir)
    malformed = lambda c: F.concat(F.year(c).cast("string"), F.lit("-99-01"))
    written = across(
        active,
        starting_with(active, "fechaMuestra"),
        lambda c: F.when(F.col(KEY) % 5 == 0, malformed(c)).otherwise(c.cast("string")),
    )
    return s.organism_rows(written)


def text_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments kept as text, those of every fifth record without a time of day."""
    saved = t.surveillance(spark, sf_dir, ["LastSaveTime"])
    text = F.when(F.col(KEY) % 5 == 0, F.date_format("LastSaveTime", "yyyy-MM-dd")).otherwise(
        F.date_format("LastSaveTime", "yyyy-MM-dd HH:mm:ss")
    )
    return saved.select(KEY, F.to_date(parse_stamp(text)).alias("guardado"))


def ward_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each active record within its ward, by bed; the missing ward is one, missing beds come last."""
    active = _active(spark, sf_dir, "plantaActual", "camaActual").select(KEY, "plantaActual", "camaActual")
    return numbered(active, [F.asc_nulls_last("camaActual"), KEY], "posicion", ["plantaActual"])


def record_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All valid records numbered by ward, bed and key."""
    rows = _valid(spark, sf_dir, ("plantaActual", "camaActual"), "^$").select(KEY, "plantaActual", "camaActual")
    return numbered(rows, [F.asc_nulls_last("plantaActual"), F.asc_nulls_last("camaActual"), KEY])


LINE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return t.read(spark, sf_dir, "lineitem").select(*LINE_ORDER, *columns)


def _line_rows(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *columns)


def sequence_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses one to three lines before and after each line, over all lines by ship date."""
    lines = _lines(spark, sf_dir, "l_linestatus")
    near = neighbours_in_sequence(lines, LINE_ORDER, "l_linestatus", [-3, -2, -1, 1, 2, 3])
    return _line_rows(near, *[c for c in near.columns if c.startswith("l_linestatus_")])


def sequence_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last known quantity of all lines by ship date; lines of every fifth order tell theirs."""
    told = F.when(F.col("l_orderkey") % 5 == 0, F.col("l_quantity"))
    lines = _lines(spark, sf_dir, told.alias("cantidad"))
    return _line_rows(fill_down_sequence(lines, LINE_ORDER, "cantidad"), "cantidad")


def sequence_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quantity of the last 14 lines, over all lines by ship date as one series."""
    lines = _lines(spark, sf_dir, "l_quantity")
    return _rounded(_line_rows(moving_average_sequence(lines, LINE_ORDER, "l_quantity", 14), "media_movil"))


SPANISH_WARDS = ("Ñandú", "Nube", "nácar", "Águila", "Ala", "ébano", "Estela", "ñu", "Oso", "Zarza", "águila")


def locale_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid records in Spanish order of a ward name with accents, and the first name of each letter, bare."""
    given = F.element_at(F.array(*[F.lit(w) for w in SPANISH_WARDS]), (F.col(KEY) % 11 + 1).cast("int"))
    rows = _valid(spark, sf_dir, ("plantaActual",), "^$").select(
        KEY, F.concat_ws(" ", given, F.col("plantaActual")).alias("unidad")
    )
    placed = numbered(rows, [in_locale(F.col("unidad")), KEY], "posicion")
    return placed.select(KEY, F.col("unidad").cast("string").alias("unidad"), "posicion")


def locale_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid records per ward name, accents and case set aside."""
    given = F.element_at(F.array(*[F.lit(w) for w in SPANISH_WARDS]), (F.col(KEY) % 11 + 1).cast("int"))
    rows = _valid(spark, sf_dir, (), "^$").select(KEY, given.alias("unidad"))
    groups = rows.groupBy(in_locale(F.col("unidad"), "es_CI_AI").alias("grupo"))
    told = groups.agg(F.min(KEY).alias("primera"), F.max(KEY).alias("ultima"), F.count("*").alias("n"))
    return told.select("primera", "ultima", "n")


def bucketed_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active records out of pages stored in buckets: their join moves no rows."""
    run = f"hoja_{uuid.uuid4().hex}_"
    form = t.pages(spark, sf_dir, [*COHORT, "plantaActual", "LastSaveTime"])
    form = write_bucketed(form, shared_folder(spark), run, buckets=8)
    rows = isolation.active_records(join_pages(form, [*COHORT, "plantaActual", "LastSaveTime"]))
    return rows.select(KEY, "nombre", "plantaActual", F.to_date("LastSaveTime").alias("guardado"))


def stored_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of stored pages after a purge that rewrote the buckets with purged keys."""
    form = t.pages(spark, sf_dir)
    folder = f"{shared_folder(spark)}/paginas-{uuid.uuid4().hex}"
    write_pages(form, folder)
    stored = read_pages(spark, folder, list(form))
    doomed = retention.records_to_purge(stored, t.PURGE_CUTOFF)
    purge_pages(spark, folder, list(form), doomed)
    return _page_keys(read_pages(spark, folder, list(form)))


def stored_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshots merged into storage one by one, the oldest first."""
    folder = f"{shared_folder(spark)}/mezcla-{uuid.uuid4().hex}"
    newest, *older = t.snapshots(spark, sf_dir)
    for snapshot in [*reversed(older), newest]:
        merge_snapshot(spark, folder, snapshot)
    columns = newest.columns
    return _saved_as_date(read_merged(spark, folder).select(*columns))


def found_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resistant rows per ward and class, with the classes that the data has."""
    cls = F.coalesce(isolation.report_class(F.col("microorganismo")), F.lit("NA"))
    rows = _resistant(spark, sf_dir).select("plantaActual", cls.alias("clase"))
    return cross_table_found(rows, "plantaActual", "clase", label=lambda c: re.sub(r"\W+", "_", c))


def written_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active records as a printed table, written as a report and read back."""
    steps = {
        "anyo": F.year("guardado"),
        "siglo": F.floor(F.col("anyo") / 100).cast("int"),  # of the column before
    }
    rows = relocate(derive(valid_active(spark, sf_dir), steps), "anyo", "siglo", after=KEY)
    names = {KEY: "Registro", "anyo": "Anyo", "siglo": "Siglo", "nombre": "Paciente", "plantaActual": "Planta"}
    folder = f"{shared_folder(spark)}/informe-{uuid.uuid4().hex}"
    write_report({"activos": present(rows, names, F.asc_nulls_last("plantaActual"))}, folder)
    return fetch_table(spark, f"{folder}/activos", "parquet")


def replaced_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily history, created, replaced by rows read from it, and one of its days written again.

    The table that has the counts is found by its column; the first run finds no table and starts empty.
    """
    sources = {"movimientos": t.read(spark, sf_dir, "events"), "historico": t.history(spark, sf_dir)}
    days = first_with_column(sources, "total_ingresados")
    run = uuid.uuid4().hex
    table, folder = f"historico_{run}", f"{shared_folder(spark)}/dias-{run}"
    try:
        before = fetch_optional(spark, table, days.schema)
        safe_replace(keys.append(before, days.filter(F.col("fecha") <= F.lit(t.HISTORY_DAY))), table, version=None)
        version = table_version(spark, table)
        later = days.filter(F.col("fecha") > F.lit(t.HISTORY_DAY))
        safe_replace(keys.append(spark.table(table), later), table, version=version)
        overwrite_days(spark.table(table), folder)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    again = days.filter(F.col("fecha") == F.lit(t.HISTORY_DAY)).withColumn("altas", F.lit(0).cast("long"))
    overwrite_days(again, folder)
    return fetch_table(spark, folder, "parquet").select(*days.columns)


def loaded_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form found by table name, read and joined; its pages are views while it is loaded."""
    prefix = f"hoja_{uuid.uuid4().hex}_"
    views = [f"{prefix}{i}" for i in range(len(t.PAGES))]
    for view, page in zip(views, t.pages(spark, sf_dir).values()):
        page.createOrReplaceTempView(view)
    try:
        wanted = ["RECSTATUS", "LastSaveTime", "plantaActual", "camaActual"]
        return _saved_as_date(load_snapshot(spark, prefix, columns=wanted))
    finally:
        for view in views:
            spark.catalog.dropTempView(view)


QUERIES: dict[str, Query] = {
    "q01_valid_active": valid_active,
    "q02_slots_long": slots_long,
    "q03_slot_activity": slot_activity,
    "q04_organisms": organisms,
    "q05_organisms_keep_mechanism": organisms_keep_mechanism,
    "q06_organisms_covid": organisms_covid,
    "q07_ward_table": _ward_rows,
    "q08_enriched": enriched,
    "q09_mdr_list": mdr_list,
    "q10_mdr_list_narrow": mdr_list_narrow,
    "q11_mdr_classes": mdr_classes,
    "q12_patients_per_ward": patients_per_ward,
    "q13_isolation_map": isolation_map,
    "q14_cleaning_list": cleaning_list,
    "q15_indicators": indicator_row,
    "q16_indicator_table": indicator_table,
    "q17_isolation_series": isolation_series,
    "q18_pressure_series": pressure_series,
    "q19_mdr_series": mdr_series,
    "q20_moving_average_7": moving_average_7,
    "q21_moving_average_14": moving_average_14,
    "q22_loess": loess,
    "q23_covid_cases": covid_cases,
    "q24_covid_subsets": covid_subsets,
    "q25_covid_daily_state": covid_daily_state,
    "q26_history_upsert": history_upsert,
    "q27_history_series": history_series,
    "q28_covid_review": covid_review,
    "q29_long_positive": long_positive,
    "q30_snapshot_merge": snapshot_merge,
    "q31_bed_movements": bed_movements,
    "q32_retention_purge": retention_purge,
    "q33_orphans_after_purge": orphans_after_purge,
    "q34_key_repair": key_repair,
    "q35_ward_listing": ward_listing,
    "q36_report_day": report_day,
    "q37_bed_origin_rows": bed_origin_rows,
    "q38_long_to_rows": long_to_wide,
    "q39_ward_listing_rest": ward_listing_rest,
    "q40_covid_deaths": covid_deaths,
    "q41_covid_per_ward": covid_per_ward,
    "q42_history_axis": history_axis,
    "q43_mdr_series_names": mdr_series_names,
    "q44_closed_records": closed_records,
    "q45_purged_status": purged_page("Vigilancia"),
    "q46_purged_patients": purged_page("Vigilancia1"),
    "q47_purged_isolation": purged_page("Vigilancia12"),
    "q48_purged_slots": purged_page("Vigilancia13"),
    "q49_repaired_status": repaired_page("Vigilancia"),
    "q50_repaired_patients": repaired_page("Vigilancia1"),
    "q51_repaired_isolation": repaired_page("Vigilancia12"),
    "q52_repaired_slots": repaired_page("Vigilancia13"),
    "q53_neighbour_organisms": neighbour_organisms,
    "q54_last_sample": last_sample,
    "q55_joined_organisms": joined_organisms,
    "q56_bound_ward_counts": bound_ward_counts,
    "q57_isolation_kinds": isolation_kinds,
    "q58_bed_text": bed_text,
    "q59_text_dates": text_dates,
    "q60_text_stamps": text_stamps,
    "q61_ward_order": ward_order,
    "q62_loaded_snapshot": loaded_snapshot,
    "q63_record_numbers": record_numbers,
    "q64_sequence_neighbours": sequence_neighbours,
    "q65_sequence_fill": sequence_fill,
    "q66_sequence_average": sequence_average,
    "q67_locale_order": locale_order,
    "q68_locale_groups": locale_groups,
    "q69_bucketed_active": bucketed_active,
    "q70_stored_purge": stored_purge,
    "q71_found_classes": found_classes,
    "q72_loess_band": loess_band,
    "q73_stored_merge": stored_merge,
    "q74_written_report": written_report,
    "q75_replaced_history": replaced_history,
}
