"""The words, labels, patterns and limits the reports are defined by."""

# --- record and slot states -------------------------------------------------
KEY = "GlobalRecordId"
VALID_STATUS = 1
ACTIVE = "ACTIVO"
INACTIVE = "INACTIVO"

# --- wide column names: which text in a name gives which slot field ----------
# Looked up in this order; the first text contained in the name decides.
SLOT_FIELDS = (
    ("Estado", "estadoAislamiento"),
    ("MROtro", "otroMecanismo"),
    ("mecanismoMR", "mecanismoMR"),
    ("fechaMuestra", "fechaMuestra"),
    ("fechaActivacion", "fechaActivacion"),
    ("fechaInactivacion", "fechaInactivacion"),
    ("microorganismo", "microorganismo"),
)
SLOT_PREFIXES = ("microorganismo", "fechaMuestra", "mecanismoMR")
SLOT_PREFIXES_WITH_TIMES = SLOT_PREFIXES + ("fechaActivacion", "fechaInactivacion")

# --- resistance mechanisms: how the text is tested, the text, the label ------
MECHANISMS = (
    ("equals", "R = 3 grupos", "MR"),
    ("equals", "Carbapenemasa", "p. de carbapenemasa"),
    ("contains", "BLEE", "BLEE"),
    ("starts", "R meticilina", "R meticilina"),
    ("equals", "AmpC", "AmpC"),
)
MECHANISMS_WITHOUT_AMPC = MECHANISMS[:4]
RENAMED_ORGANISMS = {"Clostridium difficile": "Clostridioides difficile"}

# --- multi-resistant organism list --------------------------------------------
VIRUS_PATTERN = "Virus|virus"
MDR_PATTERNS_NARROW = (
    "BLEE|MR|carbapenemasa|vancomicina|difficile",
    "R meticilina$",
    "Candida auris",
    "Serratia marcescens",
)
MDR_PATTERNS = MDR_PATTERNS_NARROW + ("AmpC", "Stenotrophomonas maltophilia")

# --- report classes: first rule that holds wins -------------------------------
CLASS_RULES = (
    ("^Candida auris$", "C. auris"),
    ("MR$", "MMR"),
    ("carbapenemasa$", "EPC"),
    ("BLEE$", "BLEE"),
    ("R meticilina$", "R meticilina"),
    ("difficile$", "C. difficile"),
    ("Serratia marcescens", "Otros"),
    ("Stenotrophomonas", "Otros"),
    ("AmpC", "Otros"),
)
CLASSES = ("C. auris", "MMR", "EPC", "BLEE", "R meticilina", "C. difficile", "Otros", "NA")
TOTAL_LABEL = "Total por MMR"

# --- wards ----------------------------------------------------------------------
CRITICAL_WARDS = ("UMI", "REA", "REQ", "UCP", "UCN")
CRITICAL_WARD_PATTERN = "|".join(CRITICAL_WARDS)
AREA_WARD = "HOSP"
AREA_CRITICAL = "CRITICOS"

# --- double cleaning: suffix per organism ---------------------------------------
CLEANING_AURIS = ("Candida auris", "¹")
CLEANING_DIFFICILE = ("difficile", "²")

# --- outbreak -------------------------------------------------------------------
COVID_ORGANISM = "Virus SARS-CoV-2 (COVID-19)"
FIRST_ADMISSION = "Primer ingreso"
DEATH = "EXITUS"
CAUSE_YES = "SI"
CAUSE_DOUBTFUL = "DUDOSO"
LONG_POSITIVE_DAYS = 10
AXIS_MARGIN_DAYS = 7

# --- report calendar: Sunday = 1, so 4 is Wednesday -----------------------------
FULL_REPORT_WEEKDAY = 4

# --- indicators -----------------------------------------------------------------
BEDS_PER_PERCENT = 9.73
DROPLETS = "Gotas"
NOSOCOMIAL = "Nosocomial"
DAYS_PER_YEAR = 365.25
PERCENT_3_PATTERN = "cauris|carba|cdif|acineto"
MDR_SERIES_LABELS = {
    "pa_acineto": "Acinetobacter baumanii",
    "pa_carba": "Prod. de carbapenemasa",
    "pa_cauris": "Candida auris",
    "pa_cdif": "Clostridioides difficile",
}
PRESSURE_SERIES = ("pa_global", "pa_crit", "pa_hosp", "pa_covid")
SMOOTH_POINTS = 80
SMOOTH_SPAN = 0.75
NORMAL_975 = 1.959963984540054  # the normal quantile of a band of 95 %

# --- printed column names per report table --------------------------------------
PRINTED_NAMES = {
    "mapa": {
        "n_pacientes": "Nº ptes. aislados",
        "planta": "Planta",
        "c_auris": "C. auris",
        "mmr": "MMR",
        "epc": "EPC",
        "blee": "BLEE",
        "r_meticilina": "R meticilina",
        "c_difficile": "C. difficile",
        "otros": "Otros",
        "na": "NA",
        "total_unidad": "Total por Unidad",
    },
    "indicadores": {
        "indicador": "Indicador",
        "calculo": "Cálculo",
        "resultado": "Resultado",
    },
    "estado": {
        "total_ingresados": "Total ingresados",
        "total_criticos": "Total críticos",
        "casos_nuevos": "Casos nuevos",
        "altas": "Altas",
        "exitus": "Exitus",
        "ingresados_por_covid": "ingresados_por_covid",
        "criticos_por_covid": "criticos_por_covid",
    },
    "por_planta": {"planta": "Planta", "n_ingresados": "Nº de ingresados"},
    "exitus": {"SIP": "SIP", "fecha_exitus": "Fecha exitus"},
    "estancia_prolongada": {
        "SIP": "SIP",
        "NHC": "NHC",
        "Cama": "Cama",
        "IngresoPorCovid": "IngresoPorCovid",
        "dias_positivo": "Días positivo",
    },
}
