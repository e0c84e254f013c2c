"""Text functions as Column expressions: normalising, tokenising, numbers, extraction, cleaning."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonarium.sources.literals import STOPWORDS, SYNONYMS, TOPICS

ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüýÿñç"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyync"


def fold(c: Column) -> Column:
    """Lower case without accents (the letters of ACCENTED; others stay)."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def municipality_key(c: Column) -> Column:
    """Folded, trimmed, white space collapsed."""
    return F.regexp_replace(F.trim(fold(c)), r"\s+", " ")


def subzone_key(c: Column) -> Column:
    """Folded, without blanks and hyphens, without a final full stop."""
    return F.regexp_replace(F.regexp_replace(fold(F.trim(c)), r"[\s-]", ""), r"\.$", "")


def code_key(c: Column) -> Column:
    """Upper case letters and digits only."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def terms(c: Column, more: tuple[str, ...] = ()) -> Column:
    """Index terms: folded runs of letters and digits of three or more, without stop-words (and without ``more``, given folded)."""
    words = F.regexp_extract_all(fold(c), F.lit("([a-z0-9]{3,})"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin([*STOPWORDS, *more]))


_RUNS = re.compile(f"[a-z0-9{ACCENTED}]{{3,}}")
_FOLDED = str.maketrans(ACCENTED, PLAIN)
_STOPPED = frozenset(STOPWORDS)


def counted_terms(text: str | None) -> dict[str, int]:
    """The terms of ``terms`` with how often each occurs; for Arrow batches, where a whole corpus is counted.

    Folding keeps lengths, so runs are looked for before it and only distinct ones are folded.
    """
    out: dict[str, int] = {}
    for run, n in Counter(_RUNS.findall((text or "").lower())).items():
        term = run if run.isascii() else run.translate(_FOLDED)
        if term not in _STOPPED:
            out[term] = out.get(term, 0) + n
    return out


def number(c: Column) -> Column:
    """Number with a decimal comma or point; null if it is none."""
    return F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")


def spanish_number(c: Column) -> Column:
    """``10.000,5``: points part thousands, a comma the decimals; ``1.000`` is a thousand, ``1.5`` is not."""
    t = F.trim(c)
    grouped = t.rlike(r"^\d{1,3}(\.\d{3})+(,\d+)?$")
    return F.when(grouped, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit("."))).try_cast("double")


def fraction(c: Column) -> Column:
    """``40 %`` is 0.4; units after a number are dropped."""
    t = F.trim(c)
    value = number(F.regexp_extract(t, r"^([0-9]+(?:[.,][0-9]+)?)", 1))
    return F.when(t.endswith("%"), value / 100).otherwise(value)


def formatted(c: Column) -> Column:
    """One decimal comma form: 12.5 is ``12,5`` and 12.0 is ``12``."""
    return F.replace(F.regexp_replace(F.format_string("%.2f", c.cast("double")), r"\.?0+$", ""), F.lit("."), F.lit(","))


def snippet(text: Column, term: str | Column, width: int = 320) -> Column:
    """Text around the first hit of a term, with ellipses where it is cut; without a hit its beginning."""
    at = F.coalesce(F.position(term if isinstance(term, Column) else F.lit(term), F.lower(text)), F.lit(0))
    start = F.when(at == 0, F.lit(1)).otherwise(F.greatest(F.lit(1), at - F.lit(width // 2)))
    body = F.substring(text, start, F.lit(width))
    return F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(start + width - 1 < F.length(text), "…").otherwise(""))


def expanded(query: Column) -> Column:
    """The query followed by every synonym group one of whose words it names, each term once."""
    folded = fold(query)
    groups = []
    for key, others in SYNONYMS.items():
        every = [key, *others]
        named = reduce(lambda a, b: a | b, (F.contains(folded, fold(F.lit(w))) for w in every))
        groups.append(F.when(named, F.array(*map(F.lit, every))).otherwise(F.array().cast("array<string>")))
    return F.array_join(F.array_distinct(F.flatten(F.array(F.array(query), *groups))), " ")


def topic_hits(question: Column, text: Column) -> Column:
    """How many keywords of the first topic named in the question the text holds."""
    asked, body = F.lower(question), fold(text)
    out = None
    for topic, words in TOPICS.items():
        hits = reduce(lambda a, b: a + b, (F.contains(body, fold(F.lit(w))).cast("int") for w in words))
        named = F.contains(asked, F.lit(topic))
        out = F.when(named, hits) if out is None else out.when(named, hits)
    return out.otherwise(F.lit(0))


# Pairs applied in order: broken hyphens, ligatures, mis-decoded accents, blanks before punctuation.
CLEANING = [
    (r"-\n", ""),
    ("ﬁ", "fi"),
    ("ﬂ", "fl"),
    ("Ã¡", "á"),
    ("Ã©", "é"),
    ("Ã³", "ó"),
    ("Ãº", "ú"),
    ("Ã±", "ñ"),
    (r"[ \t]+", " "),
    (r" ([,.;:])", "$1"),
    (r"\n{3,}", "\n\n"),
]


def cleaned(c: Column) -> Column:
    """Corrections of scanned text, one after the other."""
    return reduce(lambda x, p: F.regexp_replace(x, p[0], p[1]), CLEANING, c)


# Corrections of scanned planning texts, whatever their case, applied in order.
OCR_PAIRS = [
    ("sueol", "suelo"),
    ("sueño", "suelo"),
    ("sueo", "suelo"),
    ("urbanstica", "urbanística"),
    ("planeamiente", "planeamiento"),
    ("pro- tección", "protección"),
    ("ordena- ción", "ordenación"),
    ("articulo", "artículo"),
    ("publica- ción", "publicación"),
    ("consolida- do", "consolidado"),
    ("urbanis- tica", "urbanística"),
    ("urbanis- tico", "urbanístico"),
    ("ámbitoo", "ámbito"),
    (" su e l o ", " suelo "),
    ("s u e l o", "suelo"),
    ("Art[\ufffd?]culo", "Artículo"),
    ("T[\ufffd?]TULO", "TÍTULO"),
    ("CAP[\ufffd?]TULO", "CAPÍTULO"),
    ("SECCI[\ufffd?]N", "SECCIÓN"),
    ("AP[\ufffd?]NDICE", "APÉNDICE"),
    ("CAP[ÍI]TULO", "CAPÍTULO"),
    ("T[ÍI]TULO", "TÍTULO"),
    (r"\s{2,}", " "),
]


def corrected(c: Column) -> Column:
    """Scanned and wrongly decoded words put right."""
    return reduce(lambda x, p: F.regexp_replace(x, f"(?iu){p[0]}", p[1]), OCR_PAIRS, c)


def without_boilerplate(c: Column) -> Column:
    """Drops page-number and licence lines."""
    return F.trim(F.regexp_replace(c, r"(?m)^(?:[Pp]age \d+|\d+|Licensed under .*)$", ""))


def extracted_height(c: Column) -> Column:
    """Largest ``altura ... N m`` in the text, parapets left out."""
    found = F.regexp_extract_all(fold(c), F.lit(r"altura (?:maxima |total )?(?:de |: ?)?(\d+(?:[.,]\d+)?) ?m\b"), F.lit(1))
    return F.array_max(F.transform(found, lambda x: number(x)))


def extracted_occupancy(c: Column) -> Column:
    """First ``ocupacion ... N %`` as a fraction."""
    return number(F.nullif(F.regexp_extract(fold(c), r"ocupacion[^.%\d]*(\d+(?:[.,]\d+)?) ?%", 1), F.lit(""))) / 100


def extracted_ratio(c: Column) -> Column:
    """Largest ``edificabilidad ... N m2/m2``."""
    found = F.regexp_extract_all(fold(c), F.lit(r"edificabilidade?[^.\d]*(\d+(?:[.,]\d+)?) ?m2/m2"), F.lit(1))
    return F.array_max(F.transform(found, lambda x: number(x)))


def zone_class(c: Column) -> Column:
    """First fitting class of a zone's description."""
    t = fold(c)
    return (
        F.when(t.rlike("casco|historic"), "historico").when(t.rlike("industria|almacen"), "industrial").when(t.rlike("unifamiliar|chalet"), "unifamiliar").when(t.rlike("rustic|forestal"), "rustico").otherwise("residencial")
    )


def area_code(c: Column) -> Column:
    """``pp 3-b`` as ``PP-3-B``; null if there is no such code."""
    t = F.upper(F.trim(c))
    kind, digits, letter = (F.regexp_extract(t, r"^(PP|PE|UA|SUD|API|AR)[ .-]*(\d+)[ .-]*([A-Z]?)$", k) for k in (1, 2, 3))
    return F.when(kind != "", F.concat_ws("-", kind, digits, F.nullif(letter, F.lit(""))))


def is_subzone_code(c: Column) -> Column:
    return F.upper(F.trim(c)).rlike(r"^(U\d+(\.\d+)?|NR\d*|RZ[-\d]*|\d{1,2}(\.\d)?)$")


def is_barcode(c: Column) -> Column:
    return c.rlike("^[0-9]{12}$")


def is_cadastral_reference(c: Column) -> Column:
    return c.rlike("^[0-9]{7}.{7}$")


def intent(c: Column) -> Column:
    """First fitting intent of a question."""
    t = fold(c)
    return (
        F.when(t.rlike(r"^(hola|buenas|hello|hi)\b"), "saludo")
        .when(t.rlike("piscina"), "piscina")
        .when(t.rlike("cambio de uso|vivienda"), "cambio_uso")
        .when(t.rlike("altura|ocupacion|edificabilidad|retranqueo|normativa|ordenanza"), "normativa")
        .otherwise("edificio")
    )


def refers_back(c: Column) -> Column:
    """Whether a question leans on the turn before it."""
    return fold(c).rlike(r"\b(ese|esa|eso|este|esta|esto|mismo|misma|alli|ahi|that|this|it)\b")


def numbers(c: Column) -> Column:
    """Numbers in a text, decimal commas as points."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit(".")))


def links(html: Column) -> Column:
    """(url, title) of every anchor."""
    urls = F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)">[^<]*</a>'), F.lit(1))
    titles = F.regexp_extract_all(html, F.lit(r'<a href="[^"]*">([^<]*)</a>'), F.lit(1))
    return F.arrays_zip(urls.alias("url"), titles.alias("title"))


def plain_html(html: Column) -> Column:
    """Text of a page without scripts, styles and markup."""
    bare = F.regexp_replace(html, r"(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def signature(c: Column) -> Column:
    """Key of near-equal contents: collapsed lower case, characters 41 to 200 of texts over 200."""
    t = F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    return F.when(F.length(t) > 200, F.substring(t, 41, 160)).otherwise(t)


def upper_key(c: Column) -> Column:
    """Upper case without accents; anything else than letters, digits and blanks is a blank."""
    return F.regexp_replace(F.translate(F.upper(c), ACCENTED.upper(), PLAIN.upper()), "[^A-Z0-9 ]+", " ")


# The classes of land that a text names, first match; the families of land cover that call for a look.
ZONE_PATTERNS = (
    ("urbano_consolidado", r"urbano\s+consolidado|condici[oó]n\s+de\s+solar"),
    ("urbano", r"suelo\s+urbano|trama\s+urbana|servicios\s+urban[ií]sticos"),
    ("urbanizable", r"suelo\s+urbanizable|sectores\s+de\s+planeamiento|programa(?:ci[oó]n)?\s+de\s+actuaciones"),
    ("nucleo", r"n[uú]cleo\s+rural|asentamiento\s+tradicional"),
    ("rustico", r"suelo\s+r[uú]stic|protecci[oó]n\s+ambiental|usos\s+agr[ií]colas|ganaderos|forestales"),
)
COVER_FAMILIES = (
    ("agua", ("agua", "wetland", "humedal", "marisma", "costa", "playa", "rivera", "rio", "cauce", "lago", "embalse", "canal")),
    ("natural", ("forest", "bosque", "arbolado", "natural", "vegetacion", "matorral", "pasto", "pradera")),
    ("protegido", ("protegido", "proteccion", "red natura", "zepa", "lic", "reserva", "parque")),
    ("agricola", ("agricol", "cultivo", "regadio", "secano", "viña", "viñedo", "huerta")),
    ("industrial", ("industrial", "almacen", "taller", "fabrica", "cantera", "mineria")),
)
#: Article of the law that a question is about: named, else by the first topic all of whose groups have a word in it.
ARTICLE_TOPICS = (
    ("1", (("propósito", "objeto", "finalidad"),)),
    ("13", (("tipos de suelo", "clases de suelo", "clasificación del suelo", "núcleo rural", "nucleo rural", "núcleo tradicional", "nucleo tradicional"),)),
    ("17", (("urbano consolidado", "suelo urbano"),)),
    ("17", (("urbano",), ("suelo",))),
    ("27", (("urbanizable",),)),
    ("32", (("rústico", "rustico"), ("uso", "permitid", "infraestructur"))),
    ("31", (("rústico", "rustico"),)),
    ("44", (("vivienda protegida", "protección pública", "proteccion publica", "protección oficial", "proteccion oficial", "vpo", "vpp"),)),
)


def zone_of_text(c: Column) -> Column:
    """First class of land whose pattern a text holds, null if none."""
    return F.coalesce(*(F.when(c.rlike(f"(?iu){p}"), F.lit(name)) for name, p in ZONE_PATTERNS))


def cover_family(label: Column) -> Column:
    """First family of land cover that a label names, null if none."""
    low = fold_keeping_ene(label)
    named = lambda words: reduce(lambda a, b: a | b, (low.contains(w) for w in words))
    return F.coalesce(*(F.when(named(words), F.lit(family)) for family, words in COVER_FAMILIES))


def fold_keeping_ene(c: Column) -> Column:
    """Lower case without accents, the tilde of ``ñ`` kept."""
    return F.translate(F.lower(c), ACCENTED.replace("ñ", ""), PLAIN.replace("n", "", 1))


def target_article(question: Column) -> Column:
    """Number of the article that a question names or is about, null if neither."""
    low = F.lower(question)
    any_of = lambda words: reduce(lambda a, b: a | b, (low.contains(w) for w in words))
    by_topic = (F.when(reduce(lambda a, b: a & b, map(any_of, groups)), F.lit(article)) for article, groups in ARTICLE_TOPICS)
    return F.coalesce(F.nullif(F.regexp_extract(low, r"art[íi]culo\s+(\d+)", 1), F.lit("")), *by_topic)


def header_is_plausible(before: Column, title: Column, after: Column) -> Column:
    """Whether a heading is one: an article's number stands before it, a section's beginning after it, or its title is in capitals (seven in ten letters)."""
    candidate = F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(F.substring(after, 1, 60))
    letters = F.length(F.regexp_replace(candidate, r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace(candidate, r"[^\p{Lu}]", ""))
    opens = r"(?iu)^\s*(?:1\s*[.):]|delimitaci[oó]n|[áa]mbito|par[áa]metros|obxecto|usos\b|sistema)"
    return before.rlike(r"(?iu)art\.?\s*\d+\s*[.:\-]?\s*$") | F.substring(after, 1, 90).rlike(opens) | F.coalesce((letters > 0) & (capitals / letters >= 0.7), F.lit(False))


# How areas, instruments, states and dates are written in a plan's dispositions.
AREA_MENTION = r"API[-\s]?(\d{1,4})"
INSTRUMENT = r"((?:Plan\s+Parcial|Plan\s+Especial(?:\s+de\s+Protecci[oó]n\s+e\s+Reforma\s+Interior)?|PEPRI|Modificaci[oó]n\s+Puntual|PERI|Estudio\s+de\s+Detalle|ED)\b[^,.;:]{3,120})"
AREA_CODE = r"\b(API|SUB|SUNC|SUNP|SUOC|PE)[-\s]?(\d{1,4}[a-zA-Z]?)((?:[_\-\s]P[-\s]?\d+)?)\b"
AREA_CLASSES = ("SUB", "SUNC", "SUNP", "SUOC")
BEFORE, AFTER = 600, 300


def places(text: Column, pattern: str) -> Column:
    """Array of (begin, size, token) of every match, counted from zero: lengths of gaps and matches are summed along the text.

    The text is read twice, once for what stands between the matches and once for the matches, whatever its length.
    """
    gaps, tokens = F.split(text, f"(?iu){pattern}", -1), F.regexp_extract_all(text, F.lit(f"(?iu){pattern}"), F.lit(0))
    parts = F.zip_with(F.slice(gaps, F.lit(1), F.size(tokens)), tokens, lambda gap, token: F.struct(gap.alias("gap"), token.alias("token")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,size:int,token:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(x["gap"])
        return F.struct((begin + F.length(x["token"])).alias("at"), F.concat(s["out"], F.array(F.struct(begin.alias("begin"), F.length(x["token"]).alias("size"), x["token"].alias("token")))).alias("out"))

    return F.aggregate(parts, start, step, lambda s: s["out"])


def iso_date(c: Column, as_written: bool = False) -> Column:
    """First ``d/m/y`` or ``d.m.y`` of a text as an ISO date, null if there is none or it cannot be; ``as_written`` keeps impossible ones too."""
    pattern = r"\b(\d{1,2})[./](\d{1,2})[./](\d{3,4})\b"
    d, m, y = (F.regexp_extract(c, pattern, k).try_cast("int") for k in (1, 2, 3))
    return F.when(y.isNotNull() if as_written else m.between(1, 12) & d.between(1, 31), F.format_string("%04d-%02d-%02d", y, m, d))


def instrument_mentions(text: Column, dates_as_written: bool = False) -> Column:
    """Array of (code, instrument, state, date) of the areas that a text mentions, from 600 characters before each to 300 after.

    The instrument is the first named before the area, up to a verb; the state comes from the kind of land named in the
    context, the date is the first there, null if it is no
    day of a year unless dates are wanted as written.
    """

    def one(p: Column) -> Column:
        begin = F.greatest(p["begin"] - BEFORE, F.lit(0))
        context = F.substring(text, begin + 1, p["begin"] + p["size"] + AFTER - begin)
        before = F.substring(text, begin + 1, p["begin"] - begin)
        named = F.regexp_replace(F.regexp_extract(before, f"(?iu){INSTRUMENT}", 1), r"\s+", " ")
        name = F.regexp_replace(F.regexp_replace(named, r"(?iu)\b(?:aprobada?|incluso|conforme|seguir[aá])\b[\s\S]*$", ""), r"^[ ,]+|[ ,]+$", "")
        low = F.lower(F.regexp_replace(context, r"\s+", " "))
        state = F.when(low.contains("non consolidado"), "sunc").when(low.contains("consolidado"), "suc").when(low.contains("urbanizable"), "sub")
        return F.struct(F.concat(F.lit("API-"), F.regexp_extract(p["token"], r"(\d+)", 1)).alias("codigo"), F.nullif(name, F.lit("")).alias("instrumento"), state.alias("estado"), iso_date(context, dates_as_written).alias("fecha"), p["begin"].alias("lugar"))

    return F.transform(places(text, AREA_MENTION), one)


def area_of_zone(notes: Column, name: Column, kind: Column) -> Column:
    """(code, origin, confidence) of the area that a polygon's attributes name: its notes, its name, or a number under its class."""
    part = lambda c, k: F.upper(F.regexp_extract(F.coalesce(c, F.lit("")), f"(?iu){AREA_CODE}", k))
    number = F.upper(F.regexp_extract(F.coalesce(name, F.lit("")), r"^\s*(\d{1,4}[a-z]?)\s+", 1))
    group = F.upper(F.coalesce(kind, F.lit("")))
    found = lambda code, origin, sure: F.struct(code.alias("codigo"), F.lit(origin).alias("origen"), sure.alias("confianza"))
    return (
        F.when(part(notes, 1) == "API", found(F.concat(F.lit("API-"), part(notes, 2)), "observaciones", F.when(part(notes, 3) != "", "media").otherwise("alta")))
        .when(part(name, 1) != "", found(F.concat_ws("-", part(name, 1), part(name, 2)), "denominacion", F.lit("alta")))
        .when(group.isin(*AREA_CLASSES) & (number != ""), found(F.concat_ws("-", group, number), "denominacion_y_clase", F.lit("alta")))
    )


def sheet_header(text: Column) -> dict[str, Column]:
    """Category, district, drawing and area code of a sheet's first page."""
    head = lambda p, k: F.nullif(F.regexp_extract(text, f"(?iu){p}", k), F.lit(""))
    both = r"CATEGOR[ÍI]A\s*(RIRU|URBA|PEP)?\s*DISTRITO\s*(\d+)"
    area = F.coalesce(head(r"DISTRITO\s*\d+\s*(AR-[A-Z]+\s*\d+)", 1), F.nullif(F.regexp_extract(text, r"(AR-[A-Z]+\s*\d+)", 1), F.lit("")))
    return {"categoria": F.upper(head(both, 1)), "distrito": head(both, 2), "plano_ordenacion": F.trim(F.regexp_replace(head(r"PLANO ORDENACI[OÓ]N:\s*([^\n]+)", 1), r"\s+", " ")), "codigo_ar": F.replace(area, F.lit(" "), F.lit("-"))}


def sentence_chunks(text: Column, size: int = 1800, overlap: int = 120) -> Column:
    """Array of the overlapping chunks of a text: each ends at the last full stop in its second half, else at its size.

    One fold over as many steps as a text of its length can need; the state is where the next chunk starts, and past
    the end nothing changes.
    """
    half = size // 2
    n = F.length(text)
    most = F.ceil(n / (size - half - overlap)).cast("int") + 1
    state = F.struct(F.lit(0).alias("start"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, _: Column) -> Column:
        begin = s["start"]
        ended = F.regexp_extract(F.substring(text, begin + half + 1, F.lit(size - half)), r"(?s)^(.*\.) ", 1)
        end = F.when(begin + size >= n, n).when(ended != "", begin + half + F.length(ended)).otherwise(begin + size)
        piece = F.regexp_replace(F.substring(text, begin + 1, end - begin), r"^\s+|\s+$", "")
        after = F.when(end >= n, n).otherwise(F.greatest(end - overlap, begin + 1))
        return F.when(begin < n, F.struct(after.alias("start"), F.concat(s["out"], F.array(piece)).alias("out"))).otherwise(s)

    cut = F.aggregate(F.sequence(F.lit(1), most), state, step, lambda s: F.filter(s["out"], lambda x: x != ""))
    return F.when(n > size, cut).when(text.rlike(r"\S"), F.array(text)).otherwise(F.array().cast("array<string>"))
