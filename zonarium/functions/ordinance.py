"""What planning texts say, as rule tables over a text column: parameters, tables by street width, lists by subzone.

A rule is a pattern with the number in its first group.  Everything is a Column expression, so texts are
scanned inside the JVM; tables in a text become arrays of structs, in the order of the text where order matters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the phrases that the extracted parameters are defined by ------------------------

NUMBER = r"(?:(?:\d{1,3}(?:[\.,]\d{3})*[\.,]\d+)|(?:\d{1,3}(?:[\.,]\d{3})*)|(?:\d+(?:[\.,]\d+)?))"
PLAIN_NUMBER = r"(\d+(?:[.,]\d+)?)"
_OF = rf"\s*(?:de|:)?\s*({NUMBER})"
_METRES = r"\s*(?:m\b|metro?s?\b)"
_RATIO = r"\s*(?:m2\s*/\s*m2|m\^?2/m\^?2|m²\s*/\s*m²)?\b"

#: A height in metres follows each; the greatest of their first matches counts.
HEIGHT_PHRASES = (
    rf"altura\s*m[aá]xima{_OF}{_METRES}",
    rf"se\s*establece\s*una\s*altura\s*m[aá]xima{_OF}{_METRES}",
    rf"de\s*forma\s*gen[eé]rica\s*se\s*establece\s*una\s*altura\s*m[aá]xima{_OF}{_METRES}",
    rf"altura\s*m[aá]xima\s*permitida{_OF}{_METRES}",
    rf"altura\s*de\s*cornisa\s*(?:m[aá]xima)?{_OF}{_METRES}",
    rf"altura\s*m[aá]xima\s*de\s*fachada{_OF}{_METRES}",
    rf"altura\s*l[ií]mite{_OF}{_METRES}",
    rf"altura\s*m[aá]xima\s*de\s*la\s*edificaci[oó]n{_OF}{_METRES}",
    rf"altura\s*de\s*la\s*edificaci[oó]n\s*m[aá]xima{_OF}{_METRES}",
    rf"altura\s*autorizada{_OF}{_METRES}",
    rf"altura\s*hasta\s*(?:la\s*)?cornisa{_OF}{_METRES}",
    rf"altura\s*hasta\s*(?:la\s*)?cubierta{_OF}{_METRES}",
    rf"una\s*altura\s*de\s*({NUMBER}){_METRES}",
    rf"altura\s*de\s*({NUMBER}){_METRES}\s*,?\s*medidos?\s*en\s*el\s*arranque\s*de\s*la\s*cubierta",
    rf"\baltura\s*({NUMBER}){_METRES}",
    rf"se\s*fija\s*una\s*altura\s*m[aá]xima{_OF}{_METRES}",
    rf"se\s*autoriza\s*una\s*altura\s*m[aá]xima{_OF}{_METRES}",
    rf"bajo\s*y\s*(?:una|1)\s*planta\s*(?:equivalente\s*a\s*)?({NUMBER}){_METRES}",
    rf"bajo\s*y\s*(?:dos|2)\s*plantas\s*o\s*({NUMBER}){_METRES}",
)
HEIGHT_RANGES = (
    rf"(?:altura|ábaco)[\s\S]{{0,120}}?({NUMBER})\s*[\-–]\s*({NUMBER}){_METRES}",
    rf"({NUMBER})\s*[\-–]\s*({NUMBER}){_METRES}",
)
SETBACK_PHRASES = {
    "retranqueo_min_m": rf"retranqueo\s*(?:m[ií]nimo|general|uniforme){_OF}\s*m\b",
    "setback_front_m": rf"retranqueo\s*frontal{_OF}\s*m\b",
    "setback_side_m": rf"retranqueo\s*lateral{_OF}\s*m\b",
    "setback_back_m": rf"retranqueo\s*posterior{_OF}\s*m\b",
}
#: The last of these that matches counts, as a percentage ...
OCCUPANCY_PERCENT = (
    rf"ocupaci[oó]n\s*m[aá]xima{_OF}\s*%\b",
    rf"ocupaci[oó]n\s*m[aá]xima{_OF}\s*(?:por\s*ciento)\b",
    rf"(?:porcentaje\s+de\s+)?ocupaci[oó]n(?:\s+de\s+la\s+parcela|\s+en\s+planta|\s+del\s+suelo)?\s*(?:m[aá]xima)?\s*(?:sobre\s*rasante)?{_OF}\s*%\b",
    rf"\bocupaci[oó]n\b\s*(?:m[aá]xima)?\s*[:\-]?\s*({NUMBER})\s*%\b",
    rf"\bocu(?:p\.|pac\.)\b\s*(?:m[aá]x(?:\.|ima)?)?\s*[:\-]?\s*({NUMBER})\s*%\b",
)
#: ... else the first of these, as it is ...
OCCUPANCY_PLAIN = (
    rf"ocupaci[oó]n\s*m[aá]xima{_OF}\b",
    rf"coeficiente\s+de\s+ocupaci[oó]n\s*(?:m[aá]ximo[a]?)?{_OF}\b",
    rf"\bocupaci[oó]n\b\s*(?:m[aá]xima)?\s*[:\-]?\s*({NUMBER})\b",
    rf"\bocu(?:p\.|pac\.)\b\s*(?:m[aá]x(?:\.|ima)?)?\s*[:\-]?\s*({NUMBER})\b",
)
#: ... else a percentage within 400 characters of the word.
OCCUPANCY_NEAR = (rf"ocup\w{{0,24}}[\s\S]{{0,400}}?({NUMBER})\s*%", rf"({NUMBER})\s*%[\s\S]{{0,400}}?ocup\w{{0,24}}")
RATIO_PHRASES = (
    rf"edificabilidad\s*(?:m[aá]xima)?{_OF}{_RATIO}",
    rf"coeficiente\s+de\s+edificabilidad\s*(?:m[aá]ximo[a]?)?{_OF}{_RATIO}",
    rf"aprovechamiento\s*(?:urban[ií]stico)?\s*(?:m[aá]ximo[a]?)?{_OF}{_RATIO}",
    rf"({NUMBER})\s*(?:m2\s*(?:techo)?\s*/\s*m2\s*(?:suelo)?|m²\s*(?:techo)?\s*/\s*m²\s*(?:suelo)?)\b",
)
UNDERGROUND = r"bajo\s*rasante"
SUBZONE_HEADING = r"subzona\s*([A-Za-z0-9\-_.]+)|zona\s*([A-Za-z0-9\-_.]+)|ordenanza\s*([A-Za-z0-9\-_.]+)"
SUBZONE_CODE = r"^(?:U\d+(?:\.\d+)*|NR\d+|RZ-\d+|\d+(?:\.\d+)+)$"
FRONT_DIRECTION = r"frente\s*([ns]ur|norte|sur|este|oeste)|orientaci[oó]n\s*(norte|sur|este|oeste)"
DIRECTIONS = {"norte": "north", "sur": "south", "este": "east", "oeste": "west"}

#: First class named in a question's text.
LAND_USES = (
    ("residencial", r"\bresidencial\b"),
    ("industrial", r"\bindustrial\b"),
    ("comercial", r"\bcomercial\b"),
    ("rustico", r"\br[úu]stic[oa]\b"),
    ("urbano", r"\burbano\b"),
    ("urbanizable", r"\burbanizable\b"),
    ("dotacional", r"\b(?:dotacional|equipamientos?)\b"),
    ("terciario", r"\bterciari[oa]\b"),
)
#: Patterns tried in order for each field of a question's text.
FIELD_PHRASES = {
    "altura_maxima_m": (rf"altura\s*m[aá]x\.?\s*(?:permitida|m[ií]nima|\w+)?\s*[:=]?\s*{PLAIN_NUMBER}\s*m\b", rf"\b(?:altura|alzada)\b[^\d]*{PLAIN_NUMBER}\s*m\b"),
    "setback_front_m": (rf"retranqueo\s*(?:m[ií]n(?:imo)?)?\s*(?:al\s*frente|frontal)\s*[:=]?\s*{PLAIN_NUMBER}\s*m\b",),
    "setback_side_m": (rf"retranqueo\s*(?:m[ií]n(?:imo)?)?\s*(?:lateral(?:es)?)\s*[:=]?\s*{PLAIN_NUMBER}\s*m\b", rf"\blateral(?:es)?\b[^\d]*{PLAIN_NUMBER}\s*m\b"),
    "setback_back_m": (rf"retranqueo\s*(?:m[ií]n(?:imo)?)?\s*(?:de\s*fondo|posterior|trasero)\s*[:=]?\s*{PLAIN_NUMBER}\s*m\b", rf"\b(?:de\s*fondo|posterior|trasero)\b[^\d]*{PLAIN_NUMBER}\s*m\b"),
    "retranqueo_min_m": (rf"retranqueo\s*(?:m[ií]n(?:imo)?)?\s*[:=]?\s*{PLAIN_NUMBER}\s*m\b",),
    "ocupacion_max": (rf"ocupaci[^\d%]*\s*(?:m[aá]x\.?|m[aá]xima)?\s*[:=]?\s*{PLAIN_NUMBER}\s*%?\b",),
    "edificabilidad_max_m2_m2": (rf"edificabilidad\s*(?:m[aá]x\.?|m[aá]xima)?\s*[:=]?\s*{PLAIN_NUMBER}\s*(?:m2|m²)?\s*/\s*(?:m2|m²)\b", rf"edificabilidad\b[^\d]*{PLAIN_NUMBER}\b"),
}
FIELD_CODE = r"\b((?:U\s*\d+(?:\.\d+)?)|(?:NR\s*-?\s*\d+))\b"
ARTICLE_REFERENCE = r"(\bArt\.?\s*\d+(?:\.\d+)?\b)"
URL_REFERENCE = r"(https?://\S+)"

#: Patterns tried in order for the short extraction; floors stand in for metres.
LITE_HEIGHT = (rf"altura\s*(?:m[aá]xima|max)\s*[:=]?\s*{PLAIN_NUMBER}\s*m\b", rf"\bh\s*\.?\s*m[aá]x\.?\s*{PLAIN_NUMBER}\s*m\b")
LITE_FLOORS = ((r"\b(?:pb|b)\s*\+\s*(\d{1,2})\b", 1), (r"\b(\d{1,2})\s*(?:plantas|alturas)\b", 0), (r"planta\s*baja\s*\+\s*(\d{1,2})", 1))
LITE_SETBACK = (rf"retranqueo\s*(?:m[ií]nimo|min)\s*[:=]?\s*{PLAIN_NUMBER}\s*m\b", rf"\bsetback\b\s*[:=]?\s*{PLAIN_NUMBER}\s*m\b")
LITE_SIDES = (
    rf"(?:frente|a\s+vial|alineaci[oó]n\s+de\s+fachada)[^\d]*{PLAIN_NUMBER}\s*m",
    rf"(?:lateral(?:es)?|costados)[^\d]*{PLAIN_NUMBER}\s*m",
    rf"(?:fondo|posterior)[^\d]*{PLAIN_NUMBER}\s*m",
)

#: Parameters of an ordinance block: for each the patterns in order of trust.
BLOCK_PARAMETERS = {
    "edificabilidad_max_m2_m2": (
        rf"edificabilidade?\s+m[áa]xima\s+(?:sobre\s+superficie\s+total[^,.]*,?\s*)?(?:establ[ée]cese|f[íi]xase|se\s+establece|é\s+de|de)?\s*(?:en|de)?\s*{PLAIN_NUMBER}\s*m2/m2",
        rf"edificabilidade?\s+m[áa]xima[^.]{{0,60}}?{PLAIN_NUMBER}\s*m2/m2",
        rf"edificabilidad\s+m[áa]xima[^.]{{0,60}}?{PLAIN_NUMBER}\s*m[²2]/m[²2]",
        rf"edificabilidade?\s+(?:de|establ[ée]cese\s+en|se\s+establece\s+en)\s*{PLAIN_NUMBER}\s*m2/m2",
    ),
    "ocupacion_max_pct": (rf"ocupaci[óo]n\s+m[áa]xima\s+(?:do|da|de|del|dun|dunha)?\s*{PLAIN_NUMBER}\s*%", rf"ocupaci[óo]n[^.]{{0,50}}?(?:do|da|de|del)?\s*{PLAIN_NUMBER}\s*%"),
    "retranqueo_lateral_m": (
        rf"recuados?\s+laterais?\s+m[íi]nimos?\s+de\s+{PLAIN_NUMBER}\s*metros?\s+aos?\s+lindes?\s+laterais?",
        rf"retranqueos?\s+laterales?\s+m[íi]nimos?\s+de\s+{PLAIN_NUMBER}\s*metros?\s+a\s+linderos?\s+laterales?",
        rf"lindes?\s+laterais?[^.]{{0,40}}?de\s+{PLAIN_NUMBER}\s*metros?",
    ),
    "retranqueo_posterior_m": (
        rf"de\s+{PLAIN_NUMBER}\s*metros?\s+ao\s+linde\s+posterior",
        rf"de\s+{PLAIN_NUMBER}\s*metros?\s+al?\s+lindero\s+(?:posterior|trasero)",
        rf"linde\s+posterior[^.]{{0,40}}?de\s+{PLAIN_NUMBER}\s*metros?",
    ),
    "retranqueo_frontal_m": (
        rf"recuarse?[^.]{{0,60}}?m[áa]ximo\s+de\s+{PLAIN_NUMBER}\s*metros?",
        rf"recuado\s+(?:\w+\s+)?(?:\w+\s+)?de\s+{PLAIN_NUMBER}\s*metros?\s+(?:respecto\s+)?(?:\w+\s+)?ali",
        rf"retranqueo\s+(?:frontal|a\s+alineaci[óo]n)[^.]{{0,50}}?{PLAIN_NUMBER}\s*metros?",
    ),
    "altura_maxima_m": (
        rf"altura\s+m[áa]xima[^.]{{0,90}}?equivalente\s+a\s+{PLAIN_NUMBER}\s*metros",
        rf"altura\s+m[áa]xima\s+(?:de|f[íi]xase\s+en|establece\s+en)\s+{PLAIN_NUMBER}\s*metros",
        rf"altura\s+m[áa]xima[^.]{{0,60}}?{PLAIN_NUMBER}\s*metros",
        rf"plantas?[\s\S]{{0,35}}?\s(?:y|e)\s+{PLAIN_NUMBER}\s*(?:metros|m)\b",
    ),
    "altura_absoluta_m": (
        rf"(?:sen|sin)\s+superar\s+(?:os|las|los)?\s*{PLAIN_NUMBER}\s*metros?\s+medidos?\s+desde\s+(?:calquera|cualquier)\s+(?:punto|parte)",
        rf"(?:altura|cota)\s+m[áa]xima\s+absoluta[^.]{{0,40}}?{PLAIN_NUMBER}\s*metros?",
    ),
    "parcela_minima_m2": (rf"parcela\s+m[íi]nima\s+de\s+{PLAIN_NUMBER}\s*m2", rf"parcela\s+m[íi]nima\s+de\s+{PLAIN_NUMBER}\s*m[²2]"),
    "frente_minima_m": (rf"fronte?\s+m[íi]nima[^.]{{0,40}}?{PLAIN_NUMBER}\s*metros?",),
    "voos_max_pct_fachada": (rf"voos?[\s\S]{{0,200}}?{PLAIN_NUMBER}\s*%\s*da\s*superficie\s*de\s*fachada", rf"voos?[\s\S]{{0,80}}?m[áa]is\s+d[oe]\s+{PLAIN_NUMBER}\s*%"),
    "entreplantas_max_pct": (rf"entreplantas?[^.]{{0,160}}?\(?\s*{PLAIN_NUMBER}\s*\)?\s*(?:por\s+cento|%)",),
}
#: Words after which a height is not that of a building, up to 60 characters on in the same sentence.
NOT_BUILDINGS = r"(?:peto|muro|cerramento|cerramiento|cerca)[^.]{0,60}"
WHOLE_PARCEL = r"ocupaci[óo]n\s+da\s+totalidade\s+da\s+parcela\s+edificable"
METRES_FOR_FLOORS = rf"{PLAIN_NUMBER}\s*metros?\s+para\s+(\d+)\s*plantas?"
#: Lines that a gazette prints into a text.
PRINTED_LINES = (
    r"(?im)^[^\n]*(?:Edita:\s*Deputa|Pode verificar|sede\.depo\.gal|C[óo]digo seguro|DOG\s+N[úu]m\.|CVE-DOG|ISSN|Dep[óo]sito legal|boppo@depo|www\.boppo\.depo\.es)[^\n]*$",
    r"(?im)^\s*(?:N[úu]m\.?|BOPPO|DOG|(?:Luns|Martes|M[ée]rcores|Xoves|Venres|S[áa]bado|Domingo),[^\n]*)\s*$",
    r"(?m)^\s*\d{3,4}\s*$",
)
#: Rows of a table by street width: range, upper bound alone, lower bound alone.
_FLOORS_HEIGHT = rf"\s*(\d{{1,2}})\s*(?:plantas?\.?\s*)?{PLAIN_NUMBER}\s*m\.?"
WIDTH_ROWS = (
    rf"(?:desde|entre)\s+{PLAIN_NUMBER}\s*m\.?,?\s*(?:e|y|a|ata)\s*(?:menor|menos)\s+de\s+{PLAIN_NUMBER}\s*m\.?,?{_FLOORS_HEIGHT}",
    rf"menor\s+de\s+{PLAIN_NUMBER}\s*m\.?,?{_FLOORS_HEIGHT}",
    rf"(?:desde|a\s+partir\s+de|m[áa]is\s+de|superior\s+a)\s+{PLAIN_NUMBER}\s*m\.?,?{_FLOORS_HEIGHT}",
)
WIDTH_TABLE = r"ancho\s+d[aeo]\s*(?:r[úu]a|espazo|v[íi]a)|n[ºo]\.?\s*de\s*plantas"
WIDTH_PLUS = rf"menor\s+de\s+{PLAIN_NUMBER}\s*metros?[^.]{{0,90}}?sumar\s+{PLAIN_NUMBER}\s*metros?\s+ao\s+ancho"
WIDTH_TIMES = rf"{PLAIN_NUMBER}\s*ou\s+m[áa]is\s+metros?[^.]{{0,90}}?factor\s+{PLAIN_NUMBER}"
#: Sections by letter that name their subzone, rows by subzone, and the headings that say what a row gives.
LETTERED = r"[a-h]\)\s*[-–]?\s*Condiciones[\s\S]{0,220}?\(\s*(?:subzona[s]?\s*)?\d+\.(\d+)\s*\)"
SUBZONE_ROW = rf"\n\s*[-–•·]{{0,3}}\s*Subzona\s+(\d+)(?:\(\d+\))?\s*[.:\-–\s]+{PLAIN_NUMBER}\s*(?:m2/m2|m2|m\b|%)"
ROW_HEADINGS = (
    ("parcela_minima_m2", r"parcela\s+m[íi]nima"),
    ("altura_maxima_m", r"altura\s+de\s+la\s+edificaci[oó]n|altura\s+m[áa]xima|altura[s]?\b|metros?\s+y\s+n[úu]mero\s+de\s+plantas"),
    ("edificabilidad_max_m2_m2", r"edificabilidad"),
    ("ocupacion_max_pct", r"ocupaci[oó]n"),
)
HEADING_REACH = 800
#: Tables of floors by street width for three configurations of a block, and the subzones each holds for.
CONFIGURATION = r"Configuraci[oó]n\s+(semiintensiva|intensiva|perif[eé]rica)([\s\S]{0,600}?)(?=Configuraci[oó]n|2\.\-|Criterio)"
CONFIGURATION_SUBZONES = {"semiintensiva": (1, 2), "intensiva": (3, 4), "periférica": (5,)}
FLOOR_ROWS = (rf"{PLAIN_NUMBER}\s*[≤<]?\s*A\s*<\s*{PLAIN_NUMBER}\s*m\s*(\d{{1,2}})\b", rf"A\s*[≥>]\s*{PLAIN_NUMBER}\s*m\s*(\d{{1,2}})\b", rf"A\s*<\s*{PLAIN_NUMBER}\s*m\s*(\d{{1,2}})\b")

# --- numbers and matches ---------------------------------------------------------------------------


def _any_case(pattern: str) -> str:
    return pattern if pattern.startswith("(?") and pattern[2] in "im" else f"(?iu){pattern}"


def let(c: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def first(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null if there is none."""
    return F.nullif(F.regexp_extract(text, _any_case(pattern), group), F.lit(""))


def every(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(_any_case(pattern)), F.lit(group))


def value(c: Column) -> Column:
    """A number with a decimal comma or point; null if it has more than one of them."""
    return F.translate(c, ", ", ".").try_cast("double")


def grouped_value(c: Column) -> Column:
    """As :func:`value`, but several points part thousands."""
    return let(c, lambda c: F.translate(F.when(F.length(c) - F.length(F.replace(c, F.lit("."))) > 1, F.replace(c, F.lit("."))).otherwise(c), ", ", ".").try_cast("double"))


def thousands_value(c: Column) -> Column:
    """``1.000`` is a thousand, ``0,35`` a fraction."""
    return let(c, lambda c: F.when(c.rlike(r"^\d{1,3}(?:\.\d{3})+$"), F.replace(c, F.lit(".")).try_cast("double")).otherwise(grouped_value(c)))


def _share(percent: Column) -> Column:
    return let(percent, lambda p: F.when(p.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p / 100))))


# --- free texts ------------------------------------------------------------------------------------


def free_text_parameters(text: Column) -> dict[str, Column]:
    """Heights, setbacks, occupancy, floor-area ratio, subzone and front direction of a free text; null where it says none."""
    heights = [value(first(text, p)) for p in HEIGHT_PHRASES]
    ranges = [F.greatest(value(first(text, p, 1)), value(first(text, p, 2))) for p in HEIGHT_RANGES]
    ranged = F.when(first(text, HEIGHT_RANGES[0], 0).isNotNull(), ranges[0]).otherwise(ranges[1])
    percents = [_share(value(first(text, p))) for p in reversed(OCCUPANCY_PERCENT)]
    plain = [value(first(text, p)) for p in OCCUPANCY_PLAIN]
    near = [_share(value(first(text, p))) for p in OCCUPANCY_NEAR]
    occupancy = F.coalesce(*percents, *plain, *near)
    occupancy = let(occupancy, lambda v: F.when(v > 1.5, _share(v)).otherwise(v))
    named = F.concat(*(F.regexp_extract(text, _any_case(SUBZONE_HEADING), k) for k in (1, 2, 3)))
    subzone = let(F.regexp_replace(named, r"\.+$", ""), lambda z: F.when(z.rlike(_any_case(SUBZONE_CODE)), z))
    turned = F.lower(F.concat(*(F.regexp_extract(text, _any_case(FRONT_DIRECTION), k) for k in (1, 2))))
    direction = let(turned, lambda v: reduce(lambda w, d: w.when(v == d, DIRECTIONS[d]), list(DIRECTIONS)[1:], F.when(v == "norte", "north")))
    return {
        "altura_maxima_m": F.coalesce(F.greatest(*heights), ranged),
        **{name: value(first(text, p)) for name, p in SETBACK_PHRASES.items()},
        "ocupacion_max": F.when(~text.rlike(_any_case(UNDERGROUND)), occupancy),
        "edificabilidad_max_m2_m2": F.greatest(*(value(first(text, p)) for p in RATIO_PHRASES)),
        "subzona": subzone,
        "front_direction_default": direction,
    }


def question_fields(text: Column) -> dict[str, Column]:
    """Land use, limits, code and references that a question names."""
    out: dict[str, Column] = {}
    use = F.when(text.rlike(_any_case(LAND_USES[0][1])), LAND_USES[0][0])
    for name, pattern in LAND_USES[1:]:
        use = use.when(text.rlike(_any_case(pattern)), name)
    out["uso_suelo"] = use
    for name, patterns in FIELD_PHRASES.items():
        found = F.lit(None)
        for p in reversed(patterns):  # the first pattern that matches, whether or not its number is one
            found = F.when(first(text, p, 0).isNotNull(), value(first(text, p))).otherwise(found)
        out[name] = found.cast("double")
    out["retranqueo_min_m"] = F.when(out["setback_front_m"].isNull(), out["retranqueo_min_m"])
    out["ocupacion_max"] = F.when(out["ocupacion_max"] > 1, out["ocupacion_max"] / 100).otherwise(out["ocupacion_max"])
    out["subzona"] = F.replace(F.upper(first(text, FIELD_CODE)), F.lit(" "))
    urls = F.transform(every(text, URL_REFERENCE), lambda u: F.regexp_replace(u, r"[).,;]+$", ""))
    out["referencias"] = F.concat(every(text, ARTICLE_REFERENCE), urls)
    return out


def lite_fields(text: Column, floor_m: float = 3.0) -> dict[str, Column]:
    """The short extraction: use, height (from floors if no metres are given), least setback, articles."""
    t = F.lower(text)
    use = F.when(t.rlike("residencial|vivienda|resid[.]"), "residencial").when(t.contains("industrial"), "industrial").when(t.rlike("terciario|comercial"), "terciario")
    metres = F.coalesce(*(value(first(t, p)) for p in LITE_HEIGHT))
    floors = F.coalesce(*(first(t, p).cast("int") + more for p, more in LITE_FLOORS))
    sides = F.least(*(value(first(t, p)) for p in LITE_SIDES))
    return {
        "uso_suelo": use,
        "altura_maxima_m": F.coalesce(metres, F.when(floors > 0, F.round(floors * floor_m, 2))),
        "retranqueo_min_m": F.coalesce(*(value(first(t, p)) for p in LITE_SETBACK), sides),
        "referencias": every(t, r"(art[\.\s]*\d+[\.\d]*)"),
    }


# --- ordinance blocks ------------------------------------------------------------------------------


def without_printed_lines(text: Column) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, p, " "), PRINTED_LINES, text)


def block_parameters(text: Column) -> Column:
    """Array of (parameter, value, trace) of an ordinance block; a trace is the words around the match.

    A parapet's or a wall's height is not a building's: a bounded look-behind keeps those out.
    """
    return let(without_printed_lines(text), _parameters_of_block)


def block_values(text: Column) -> Column:
    """``block_parameters`` without traces, as (parameter, value): every phrase is looked for once."""
    return let(without_printed_lines(text), _values_of_block)


def _guarded(name: str, pattern: str) -> str:
    """A height's phrase looks back only where it begins."""
    return (rf"(?=altura|planta)(?<!{NOT_BUILDINGS})" if name == "altura_maxima_m" else "") + pattern


def _values_of_block(clean: Column) -> Column:
    found = []
    for name, patterns in BLOCK_PARAMETERS.items():
        values = [grouped_value(first(clean, _guarded(name, p))) for p in patterns]
        if name == "altura_maxima_m":  # else the greatest of a list of metres by floors
            values.append(let(F.transform(every(clean, METRES_FOR_FLOORS), value), lambda m: F.when(F.size(m) >= 2, F.array_max(m))))
        found.append(F.struct(F.lit(name).alias("parameter"), F.coalesce(*values).alias("value")))
    return F.filter(F.array(*found), lambda x: x["value"].isNotNull())


def _parameters_of_block(clean: Column) -> Column:
    found = []
    for name, patterns in BLOCK_PARAMETERS.items():
        guard = rf"(?=altura|planta)(?<!{NOT_BUILDINGS})" if name == "altura_maxima_m" else ""  # looks back only where a phrase begins
        hit, trace = F.lit(None).cast("double"), F.lit(None).cast("string")
        for p in reversed(patterns):
            here = grouped_value(first(clean, guard + p))
            around = F.regexp_extract(clean, rf"(?iu)[\s\S]{{0,60}}?{guard}{p}[\s\S]{{0,60}}", 0)
            hit, trace = F.coalesce(here, hit), F.when(here.isNotNull(), around).otherwise(trace)
        if name == "altura_maxima_m":  # else the greatest of a list of metres by floors
            metres = F.transform(every(clean, METRES_FOR_FLOORS), value)
            trace = F.when(hit.isNull() & (F.size(metres) >= 2), first(clean, rf"[\s\S]{{0,60}}?{METRES_FOR_FLOORS}[\s\S]{{0,60}}", 0)).otherwise(trace)
            hit = F.coalesce(hit, F.when(F.size(metres) >= 2, F.array_max(metres)))
        found.append(F.struct(F.lit(name).alias("parameter"), hit.alias("value"), F.substring(F.trim(F.regexp_replace(trace, r"\s+", " ")), 1, 220).alias("trace")))
    return F.filter(F.array(*found), lambda x: x["value"].isNotNull())


def _rows(text: Column, pattern: str, build) -> Column:
    """One struct a match: ``build`` takes the match."""
    return F.transform(every(text, pattern, 0), lambda m: build(m, pattern))


def _width_row(low: Column, high: Column, floors: Column, height: Column) -> Column:
    return F.struct(low.cast("double").alias("ancho_min_m"), high.cast("double").alias("ancho_max_m"), floors.cast("int").alias("plantas"), height.cast("double").alias("altura_m"))


def width_table(text: Column) -> Column:
    """Rows (from, to, floors, height) by street width, least width first; empty under two rows or without the heading.

    What a range took is blanked before the rows with one bound are read, so that its end is not read again.
    """
    none = F.lit(None)
    number = lambda m, p, k: grouped_value(first(m, p, k))
    both, upper, lower = WIDTH_ROWS
    rest = F.regexp_replace(text, _any_case(both), " | ")
    rows = F.concat(
        _rows(text, both, lambda m, p: _width_row(number(m, p, 1), number(m, p, 2), first(m, p, 3), number(m, p, 4))),
        _rows(rest, upper, lambda m, p: _width_row(none, number(m, p, 1), first(m, p, 2), number(m, p, 3))),
        _rows(rest, lower, lambda m, p: _width_row(number(m, p, 1), none, first(m, p, 2), number(m, p, 3))),
    )
    ordered = F.transform(F.array_sort(F.transform(rows, lambda r: F.struct(F.coalesce(r["ancho_min_m"], F.lit(0.0)).alias("k"), r.alias("r")))), lambda x: x["r"])
    return F.when(text.rlike(_any_case(WIDTH_TABLE)) & (F.size(rows) >= 2), ordered).otherwise(F.array().cast("array<struct<ancho_min_m:double,ancho_max_m:double,plantas:int,altura_m:double>>"))


def width_formulas(text: Column) -> Column:
    """Rows (from, to, operator, operand) of heights that are the street's width plus or times a number."""
    row = lambda low, high, sign, by: F.struct(low.cast("double").alias("ancho_min_m"), high.cast("double").alias("ancho_max_m"), F.lit(sign).alias("formula"), by.alias("op_m"))
    plus, times = ([grouped_value(first(text, p, k)) for k in (1, 2)] for p in (WIDTH_PLUS, WIDTH_TIMES))
    rows = F.array_compact(F.array(F.when(plus[0].isNotNull(), row(F.lit(0.0), plus[0], "ancho+", plus[1])), F.when(times[0].isNotNull(), row(times[0], F.lit(None), "ancho*", times[1]))))
    return F.when(text.rlike(r"(?iu)ancho\s+d[aeo]\s*r[úu]a"), rows).otherwise(F.slice(rows, 1, 0))


def lettered_sections(text: Column) -> Column:
    """Array of (subzone, text) of the sections by letter that name a subzone; each goes to the next."""
    pieces = F.split(F.concat(F.lit("\n"), text), rf"(?iu)(?=\n\s*{LETTERED})")
    number = lambda piece: first(piece, rf"^\n\s*{LETTERED}").cast("int")
    return F.filter(F.transform(pieces, lambda s: F.struct(number(s).alias("subzona"), s.alias("texto"))), lambda x: x["subzona"].isNotNull())


def subzone_lists(text: Column) -> Column:
    """Array of (parameter, subzone, value) of rows by subzone under the last heading within ``HEADING_REACH`` characters.

    The text is cut into gaps and tokens (headings and rows); one fold carries the place and the last heading along.
    Parameters of which only one subzone has a row are dropped: that is a mention in prose.
    """
    heading = "|".join(p for _, p in ROW_HEADINGS)
    token = rf"(?iu)(?:{SUBZONE_ROW}|{heading})"
    whole = F.concat(F.lit("\n"), text)
    tokens = F.regexp_extract_all(whole, F.lit(token), F.lit(0))
    gaps = F.slice(F.split(whole, token, -1), F.lit(1), F.size(tokens))
    kind = lambda t: reduce(lambda w, h: w.when(t.rlike(f"(?iu)^(?:{h[1]})"), h[0]), ROW_HEADINGS[1:], F.when(t.rlike(f"(?iu)^(?:{ROW_HEADINGS[0][1]})"), ROW_HEADINGS[0][0]))
    parts = F.transform(F.arrays_zip(gaps.alias("gap"), tokens.alias("token")), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["token"]).alias("size"), kind(x["token"]).alias("kind"), first(x["token"], SUBZONE_ROW, 1).cast("int").alias("zone"), thousands_value(first(x["token"], SUBZONE_ROW, 2)).alias("value")))
    rows_type = "array<struct<parameter:string,subzona:int,value:double>>"
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("heading"), F.lit(0).alias("since"), F.array().cast(rows_type).alias("rows"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + x["gap"]
        near = s["heading"].isNotNull() & (begin - s["since"] <= HEADING_REACH)
        row = F.struct(s["heading"].alias("parameter"), x["zone"].alias("subzona"), x["value"].alias("value"))
        rows = F.when(x["zone"].isNotNull() & x["value"].isNotNull() & near, F.concat(s["rows"], F.array(row))).otherwise(s["rows"])
        return F.struct((begin + x["size"]).alias("at"), F.coalesce(x["kind"], s["heading"]).alias("heading"), F.when(x["kind"].isNotNull(), begin).otherwise(s["since"]).alias("since"), rows.alias("rows"))

    rows = F.aggregate(parts, start, step, lambda s: s["rows"])
    zones = lambda every_row, r: F.size(F.array_distinct(F.transform(F.filter(every_row, lambda o: o["parameter"] == r["parameter"]), lambda o: o["subzona"])))
    return let(rows, lambda every_row: F.filter(every_row, lambda r: zones(every_row, r) >= 2))


def block_floor_tables(text: Column) -> Column:
    """Array of (subzone, rows) of the floors by street width of each configuration of a block."""
    none = F.lit(None)
    number = lambda m, p, k: grouped_value(first(m, p, k))
    both, lower, upper = FLOOR_ROWS
    row = lambda low, high, floors: F.struct(low.cast("double").alias("ancho_min_m"), high.cast("double").alias("ancho_max_m"), floors.cast("int").alias("plantas"))

    def table(segment: Column) -> Column:
        rest = F.regexp_replace(segment, _any_case(both), " | ")
        after = F.regexp_replace(rest, _any_case(lower), " | ")
        rows = F.concat(
            _rows(segment, both, lambda m, p: row(number(m, p, 1), number(m, p, 2), first(m, p, 3))),
            _rows(rest, lower, lambda m, p: row(number(m, p, 1), none, first(m, p, 2))),
            _rows(after, upper, lambda m, p: row(F.lit(0.0), number(m, p, 1), first(m, p, 2))),
        )
        return F.array_sort(rows)

    subzones = F.create_map(*(x for k, v in CONFIGURATION_SUBZONES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    blocks = F.arrays_zip(F.transform(every(text, CONFIGURATION, 1), F.lower).alias("name"), every(text, CONFIGURATION, 2).alias("segment"))
    made = F.transform(blocks, lambda b: F.struct(F.element_at(subzones, b["name"]).alias("zones"), table(b["segment"]).alias("rows")))
    full = F.filter(made, lambda b: (F.size(b["rows"]) >= 2) & b["zones"].isNotNull())
    return F.flatten(F.transform(full, lambda b: F.transform(b["zones"], lambda z: F.struct(z.alias("subzona"), b["rows"].alias("rows")))))


# --- candidates, tables, summaries -----------------------------------------------------------------

# What a scan for candidates looks for, and the words that tell what a table's row holds.
CANDIDATES = {
    "altura_maxima_m": rf"altura\s*(?:m[aá]xima|de\s*cornisa|l[ií]mite|de\s*la\s*edificaci[oó]n)[^\n\r]{{0,80}}?{NUMBER}\s*(?:m\b|metros?)",
    **{name: p.replace(f"({NUMBER})", NUMBER) for name, p in SETBACK_PHRASES.items()},
}
CONTEXT = 120
HEIGHT_PHRASE = rf"(?:altura|cornisa|cubierta|fachada|l[ií]mite)\s*(?:m[aá]xima)?[^\n\r]{{0,40}}?{PLAIN_NUMBER}\s*(?:m\b|metros?)"
ANY_METRES = rf"{PLAIN_NUMBER}\s*(?:m\b|metros?)"
ROW_WORDS = {"altura": r"altura|cornisa|fachada|l[ií]mite", "retranqueo": r"retranqueo|alineaci[oó]n|separaci[oó]n", "frontal": "frontal", "lateral": "lateral", "posterior": "posterior|fondo", "ocupacion": r"ocupaci[oó]n", "edificabilidad": "edificabilidad|aprovechamiento"}


def candidates(text: Column) -> Column:
    """Array of (parameter, value, match, context) of every phrase with a limit, 120 characters on either side."""
    from zonarium.functions.text import places

    def hits(name: str, pattern: str) -> Column:
        def one(p: Column) -> Column:
            begin = F.greatest(p["begin"] - CONTEXT, F.lit(0))
            around = F.substring(text, begin + 1, p["begin"] + p["size"] + CONTEXT - begin)
            last = F.element_at(every(p["token"], f"({NUMBER})"), -1)  # the pattern ends with its number
            return F.struct(F.lit(name).alias("parameter"), value(last).alias("value"), p["token"].alias("text"), F.replace(around, F.lit("\n"), F.lit(" ")).alias("context"))

        return F.transform(places(text, pattern), one)

    return F.filter(F.concat(*(hits(name, pattern) for name, pattern in CANDIDATES.items())), lambda x: x["value"].isNotNull())


def height_near_codes(text: Column, codes: tuple[str, ...]) -> Column:
    """(kind, words) of the first height phrase, else of the first metres with 40 characters around, in texts that name one of the codes."""
    named = reduce(lambda a, b: a | b, (text.contains(c) | text.rlike(rf"(?iu)Ordenanza\s+{c[0]}\s*{c[1:].strip()}\b") for c in codes))
    phrase = first(text, HEIGHT_PHRASE, 0)
    metres = F.regexp_extract(text, rf"[\s\S]{{0,40}}?{ANY_METRES}[\s\S]{{0,40}}", 0)
    return F.when(named & phrase.isNotNull(), F.struct(F.lit("height").alias("kind"), phrase.alias("words"))).when(named & (metres != ""), F.struct(F.lit("metres").alias("kind"), F.replace(metres, F.lit("\n"), F.lit(" ")).alias("words")))


def _table_lines(rows: Column) -> Column:
    """The rows of a table as their line in small letters and their numbers."""
    return F.transform(rows, lambda r: F.struct(F.lower(F.array_join(r, " | ")).alias("line"), F.transform(r, lambda c: value(F.regexp_extract(c, rf"({NUMBER})", 1))).alias("numbers")))


def table_limits(rows: Column) -> dict[str, Column]:
    """Limits that a table's rows (arrays of cells) give: greatest height, least setback, greatest sides, occupancy and ratio, in plausible ranges."""
    return _limits_of_lines(_table_lines(rows))


def _limits_of_lines(lines: Column) -> dict[str, Column]:
    of = lambda word, low, high, shape=lambda x: x: F.flatten(F.transform(F.filter(lines, lambda x: x["line"].rlike(f"(?iu){word}")), lambda x: F.transform(F.filter(x["numbers"], lambda n: (n > low) & (n <= high)), shape)))
    setback = ROW_WORDS["retranqueo"]
    side = lambda word: F.array_max(F.flatten(F.transform(F.filter(lines, lambda x: x["line"].rlike(f"(?iu){setback}") & x["line"].rlike(f"(?iu){word}")), lambda x: F.filter(x["numbers"], lambda n: (n > 0) & (n <= 15)))))
    return {
        "altura_maxima_m": F.array_max(of(ROW_WORDS["altura"], 0, 60)),
        "retranqueo_min_m": F.array_min(of(setback, 0, 15)),
        "setback_front_m": side(ROW_WORDS["frontal"]),
        "setback_side_m": side(ROW_WORDS["lateral"]),
        "setback_back_m": side(ROW_WORDS["posterior"]),
        "ocupacion_max": F.array_max(of(ROW_WORDS["ocupacion"], -1e-12, 100, lambda n: F.when(n <= 1, n).otherwise(n / 100))),
        "edificabilidad_max_m2_m2": F.array_max(of(ROW_WORDS["edificabilidad"], 0, 5)),
    }


# Words one of which a table's first two rows must have for it to be read.
HEADER_HINTS = (
    "altura", "cornisa", "límite", "limite", "fachada", "edificación", "edificacion", "retranqueo", "alineación", "alineacion", "separación", "separacion", "frontal", "lateral", "posterior", "fondo",
    "ocupación", "ocupacion", "edificabilidad", "aprovechamiento",
)


LIMITS = ("altura_maxima_m", "retranqueo_min_m", "setback_front_m", "setback_side_m", "setback_back_m", "ocupacion_max", "edificabilidad_max_m2_m2")


def hinted_limits(rows: Column) -> Column:
    """The limits of a table whose first two rows have a cell with a hint, as a struct; null for other tables and where no limit is found."""

    def limits_of(rows: Column) -> Column:
        hinted = F.exists(F.slice(rows, 1, 2), lambda r: F.exists(r, lambda c: F.lower(c).rlike("|".join(HEADER_HINTS))))
        limits = let(_table_lines(rows), lambda lines: F.struct(*(v.alias(k) for k, v in _limits_of_lines(lines).items())))
        return F.when(F.coalesce(hinted, F.lit(False)), let(limits, lambda s: F.when(F.coalesce(*(s[k] for k in LIMITS)).isNotNull(), s)))

    return let(rows, limits_of)


SUMMARY = (("altura_maxima_m", "Altura máxima (m)"), ("retranqueo_min_m", "Retanqueo mínimo (m)"), ("setback_front_m", "Frente (m)"), ("setback_side_m", "Laterales (m)"), ("setback_back_m", "Fondo (m)"), ("ocupacion_max", "Ocupación máx."), ("edificabilidad_max_m2_m2", "Edificabilidad (m2/m2)"))


def fallback_summary(municipality: Column, subzone: Column, plan: dict[str, Column], said: dict[str, Column]) -> Column:
    """Lines of an answer without a model: the place, the plan's values, else what the text itself says (its occupancy left out)."""
    line = lambda label, v: F.when(v.isNotNull(), F.concat(F.lit(f"{label}: "), v.cast("string")))
    from_plan = [line(label, plan[k]) for k, label in SUMMARY if k in plan]
    use = line("Uso del suelo", said["uso_suelo"])
    from_text = [F.when(plan[k].isNull() if k in plan else F.lit(True), line(label, said[k])) for k, label in SUMMARY if k in said and k != "ocupacion_max"]
    return F.array_join(F.array_compact(F.array(line("Municipio", municipality), line("Subzona", subzone), *from_plan, use, *from_text)), "\n")
