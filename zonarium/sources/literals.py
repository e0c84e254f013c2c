"""Small fixed relations, stated once for Spark and once (as text) for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Stop-words of the keyword index.
STOPWORDS = [
    "el", "la", "los", "las", "un", "una", "unos", "unas", "de", "del", "en", "y", "o", "a", "al", "que", "es", "se", "su", "sus", "con",
    "por", "para", "como", "más", "mas", "no", "si", "lo", "le", "les", "este", "esta", "estos", "estas", "ese", "esa", "esos", "esas",
    "ser", "son", "fue", "han", "ha", "hay", "muy", "ya", "todo", "toda", "todos", "todas", "otro", "otra", "entre", "sobre", "tras",
    "the", "do", "da", "dos", "das", "na", "nas", "ao", "aos", "ou", "polo", "pola", "pelo", "pela", "cada", "segundo", "segunda",
    "cal", "cales", "cómo", "cuál", "cual", "cuáles", "cuando", "donde", "cuánto", "cuanta", "puede", "pueden", "debe", "deben", "tiene",
    "permitir", "permitido", "permitida", "municipio", "concello",
]

# More stop-words, for corpora in English, German and French; an index takes them only if asked.
STOPWORDS_EN_DE_FR = ["and", "that", "this", "with", "for", "from", "was", "are", "not", "der", "die", "und", "ist", "von", "mit", "fur", "des", "est", "dans", "pour", "avec"]

# Synonym groups of planning terms.
SYNONYMS = {
    "retranqueo": ["recuado", "retiro", "separación a linderos", "lindero", "setback"],
    "ocupación": ["ocupación máxima", "superficie ocupada", "huella", "ocupacion"],
    "edificabilidad": ["edificabilidade", "aprovechamiento", "aproveitamento", "coeficiente"],
    "altura": ["altura máxima", "altura de cornisa", "altura total", "altitude máxima"],
    "piscina": ["piscina", "vaso", "instalación auxiliar", "acumulación de agua"],
    "azotea": ["cubierta", "terraza", "cuberta"],
    "vivienda": ["vivenda", "unidad residencial", "apartamento", "domicilio"],
    "local": ["local comercial", "bajo comercial", "oficina", "uso terciario"],
    "cambio de uso": ["cambio de uso", "rehabilitación", "conversión", "transformación"],
    "suelo": ["solo", "clasificación", "clase de suelo"],
    "parcela": ["parcela", "finca", "solar", "predio"],
    "normativa": ["ordenanza", "normas", "planeamiento", "PGOM", "plan xeral"],
    "anexo": ["anexo", "auxiliar", "complementario", "caseta"],
}

# Keywords by topic, first topic named in the question wins.
TOPICS = {
    "piscina": ["piscina", "instalación", "auxiliar", "ocupación", "acumulación de auga", "depuración"],
    "cambio de uso": ["habitabilidad", "nhv", "128/2023", "vivenda", "vivienda", "cambio de uso", "acondicionamiento"],
    "retranqueo": ["retranqueo", "recuado", "lindero", "retiro"],
    "ocupación": ["ocupación", "ocupación máxima", "huella"],
    "edificabilidad": ["edificabilidad", "edificabilidade", "aprovechamiento"],
    "altura": ["altura", "cornisa", "plantas"],
}

# (municipality, subzone, height, setback, occupancy, floor-area ratio, order in the file)
PLANS = [
    ("vigo", "", 12.0, 3.0, 0.5, 1.2, 1),
    ("vigo", "centro", 18.0, 0.0, 0.8, 3.5, 2),
    ("vigo", "u1.2", 9.0, 5.0, 0.4, 0.6, 3),
    ("a coruna", "", 15.0, 2.0, 0.6, 1.5, 4),
    ("a coruna", "ensanche", 21.0, 0.0, 0.9, 4.0, 5),
    ("lugo", "casco", 10.5, 0.0, 0.7, 2.0, 6),
    ("lugo", "extrarradio", 7.0, 4.0, 0.3, 0.5, 7),
]
PLAN_COLUMNS = ("municipio", "subzona", "altura_maxima_m", "retranqueo_min_m", "ocupacion_max", "edificabilidad", "ord")

# Rows that break one rule each.
PLANS_DIRTY = [
    (1, "vigo", "centro", 18.0, 0.0, None, None, 0.8, None),
    (2, "vigo", "norte", 0.0, 3.0, None, None, 0.5, None),
    (3, "vigo", "sur", 12.0, -1.0, None, None, 0.5, None),
    (4, "lugo", "casco", 10.0, 3.0, None, None, 1.2, None),
    (5, "lugo", "rio", 10.0, 3.0, None, None, 0.4, "north"),
    (6, "lugo", "alto", 10.0, 3.0, 2.0, 1.0, 0.4, "up"),
    (7, "Vigo ", " Centro", 15.0, 2.0, None, None, 0.6, None),
    (8, None, "nada", 9.0, 2.0, 1.0, 1.0, 0.6, "south"),
]
DIRTY_COLUMNS = ("row", "municipio", "subzona", "altura", "retranqueo", "setback_front", "setback_side", "ocupacion", "front_direction")

# (municipality, code, xmin, xmax, ymin, ymax, height limit, status)
ZONES = [
    ("vigo", "Z1", 0.0, 40.0, 0.0, 40.0, 18.0, "pilot"),
    ("vigo", "Z2", 30.0, 70.0, 10.0, 50.0, 12.0, "official"),
    ("vigo", "Z3", 10.0, 25.0, 10.0, 30.0, 9.0, "official"),
    ("lugo", "Z4", 60.0, 100.0, 60.0, 100.0, 24.0, "official"),
    ("lugo", "Z5", 75.0, 90.0, 70.0, 85.0, 7.0, "pilot"),
    ("lugo", "Z6", 0.0, 30.0, 70.0, 95.0, 15.0, "official"),
]
ZONE_COLUMNS = ("municipio", "code", "xmin", "xmax", "ymin", "ymax", "limite", "estado")

# (from width, to width, floors, height, formula operand, formula operator)
WIDTHS = [
    (None, 6.0, 3, 10.5, None, None),
    (6.0, 12.0, 4, 13.0, None, None),
    (12.0, 18.0, 5, 16.5, None, None),
    (18.0, 24.0, 6, 19.0, None, None),
    (24.0, 40.0, 7, 22.5, None, None),
    (40.0, None, None, None, 1.5, "*"),
]
WIDTH_COLUMNS = ("ancho_min_m", "ancho_max_m", "plantas", "altura_m", "op_m", "formula")

# Minimum areas by number of rooms (one to six).
ROOM_MINIMUM = {1: 25.0, 2: 16.0, 3: 18.0, 4: 20.0, 5: 22.0, 6: 25.0}
KITCHEN_MINIMUM = {1: 5.0, 2: 7.0, 3: 7.0, 4: 9.0, 5: 9.0, 6: 10.0}
OTHER_MINIMUM = {2: [12.0], 3: [12.0, 8.0], 4: [12.0, 8.0, 8.0], 5: [12.0, 8.0, 8.0, 6.0], 6: [12.0, 8.0, 8.0, 8.0, 6.0]}

ORIENTATIONS = [("N", 0.0, 1), ("NE", 45.0, 2), ("E", 90.0, 3), ("SE", 135.0, 4), ("S", 180.0, 5), ("SW", 225.0, 6), ("W", 270.0, 7), ("NW", 315.0, 8)]
SOLAR_DATES = [("equinoccio_primavera", 80), ("solsticio_verano", 172), ("equinoccio_otonio", 266), ("solsticio_invierno", 355)]

BUCKET_BOUNDS = [512, 1024, 2048, 4096, 8192, 16384, 32768, 65536, 131072, 262144]

_TYPES = {int: "bigint", float: "double", str: "string"}


def relation(spark: SparkSession, rows: list[tuple], columns: tuple[str, ...]) -> DataFrame:
    """A literal relation; a column's type is that of its first value."""
    kinds = [next((_TYPES[type(r[k])] for r in rows if r[k] is not None), "string") for k in range(len(columns))]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` {t}" for c, t in zip(columns, kinds, strict=True)))


def values_sql(name: str, rows: list[tuple], columns: tuple[str, ...]) -> str:
    """The same relation as a common table expression."""

    def one(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"{v!r}::DOUBLE" if isinstance(v, float) else f"{v}"

    kinds = [next((type(r[k]) for r in rows if r[k] is not None), str) for k in range(len(columns))]
    cast = {int: "BIGINT", float: "DOUBLE", str: "VARCHAR"}
    body = ", ".join("(" + ", ".join(f"{one(v)}" if v is not None else f"NULL::{cast[kinds[k]]}" for k, v in enumerate(r)) + ")" for r in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"
