"""Fill-in-middle: texts rearranged so that a model learns to write what stands between two parts.

A text is cut into units (white space with the word after it, or white space alone), two cuts chosen by a
hash of the id part it into prefix, middle and suffix, and the parts are put behind sentinels in one of two orders:

    psm   <P>prefix<S>suffix<M>middle
    spm   <S>suffix<P>prefix<M>middle

Texts that contain a sentinel, and the share not chosen by the hash, stay plain.  All of it is an expression of
the row: one scan, no shuffle, no state, and a lost task gives the same rows again.

Edge cases: a null text is an empty one and stays plain; a text of white space is one unit; rows with one id and
one text give one result, rows of one id with different texts share the hash but not the cuts; a null id hashes like
an id without digits; an empty table gives an empty result; only the two named columns are read, so other names cannot clash.
Long texts are cut whole; memory is that of the text and its units.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space and the word behind it, or what white space is left at the end.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class FillInMiddle:
    """Sentinels, the seed of the hash, the percentage of texts to rearrange and that of ``spm`` among them."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: int = 42
    percent: int = 50
    spm_percent: int = 80

    def __post_init__(self) -> None:
        """Sentinels must not run into one another or into themselves, so that their first place is the one they were put in."""
        for i, a in enumerate(self.marks):
            if not a:
                raise ValueError("a sentinel is empty")
            for j, b in enumerate(self.marks):
                if (i != j and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                    raise ValueError(f"sentinels {a!r} and {b!r} overlap")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draw(id_text: Column, seed: int, nth: int) -> Column:
    """The ``nth`` (from 0) group of eight hexadecimal digits of the hash of seed and id, as a number."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256), 8 * nth + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, how: FillInMiddle | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the text, its units ``n``, ``form``, the characters of prefix and middle (null if plain) and ``output``.

    Each projection uses the one below more than once, so Spark computes every value once.
    """
    how = how or FillInMiddle()
    text, n = F.col("text"), F.col("n")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    units = base.select("doc_id", "text", F.regexp_extract_all("text", F.lit(UNIT), 0).alias("_u"))
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    drawn = units.select("doc_id", "text", "_u", F.size("_u").cast("long").alias("n"), *(draw(id_text, how.seed, k).alias(f"_h{k}") for k in range(4)))
    a, b = F.col("_h0") % (n + 1), F.col("_h1") % (n + 1)
    plain = (text == "") | (F.col("_h2") % 100 >= how.percent)
    for mark in how.marks:
        plain = plain | text.contains(mark)
    form = F.when(plain, "plain").when(F.col("_h3") % 100 < how.spm_percent, "spm").otherwise("psm")
    cut = drawn.select("doc_id", "text", "_u", "n", form.alias("form"), F.least(a, b).cast("int").alias("_a"), F.greatest(a, b).cast("int").alias("_b"))

    def part(start: Column, length: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("_u", start, length), ""))

    one, lower, upper = F.lit(1), F.col("_a"), F.col("_b")
    parts = cut.select(
        "doc_id", "text", "n", "form",
        part(one, lower).alias("_p"),
        part(lower + 1, upper - lower).alias("_m"),
        part(upper + 1, n.cast("int") - upper).alias("_s"),
    )
    psm = F.concat(F.lit(how.prefix), "_p", F.lit(how.suffix), "_s", F.lit(how.middle), "_m")
    spm = F.concat(F.lit(how.suffix), "_s", F.lit(how.prefix), "_p", F.lit(how.middle), "_m")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(text)
    return parts.select("doc_id", "text", "n", "form", F.length("_p").cast("long").alias("prefix_chars"), F.length("_m").cast("long").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, how: FillInMiddle | None = None) -> Column:
    """The text that an output of a form was made of, by the places of its sentinels; unknown forms give null."""
    how = how or FillInMiddle()

    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        """What follows ``first`` (which begins the output), ``second`` and the middle sentinel."""
        x, y = F.locate(second, output), F.locate(how.middle, output)
        head, last = x - 1 - len(first), y - x - len(second)
        return F.substring(output, F.lit(len(first) + 1), head), F.substring(output, x + len(second), last), F.substring(output, y + len(how.middle), F.length(output))

    p, s, m = between(how.prefix, how.suffix)
    psm = F.concat(p, m, s)
    s, p, m = between(how.suffix, how.prefix)
    spm = F.concat(p, m, s)
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)
