"""Quality rules: how much of a text repeats itself.

For every text the operator hashes the word n-grams of several lengths with rolling hashes in
numpy, marks the n-grams that occurred earlier in the same text, and measures the share of
word characters inside marked n-grams and inside repeated lines.  A text is rejected when it is
too short, when too many of its words stand in repeated eight-word windows, when it holds more
than one symbol for ten words, or when one of the measured shares is above its limit.

Edge cases: a null or empty text has no words, zero shares and is rejected as too short; rows
with a null or repeated id are judged one by one; an empty table gives an empty result; other
columns of the input are not read, so their names cannot clash.  The whole text is measured
whatever its length; memory is proportional to an Arrow batch, never to a group of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonarium.llm import textbatch as tb

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_chars long, dup_ngram_chars array<long>"
)

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Rules:
    """Limits; the shares are of word characters inside n-grams (or lines) seen before in the text."""

    window: int = 8
    fewest_words: int = 20
    most_repeat_percent: int = 30
    ngram_limits: dict[int, float] = field(default_factory=lambda: {5: 0.30, 6: 0.30, 8: 0.30, 10: 0.30})
    line_limit: float = 0.30
    symbols_per_word: float = 0.10


def _seen_before(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: which values occurred at a smaller index, and which occur twice or more."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    later = np.zeros(len(key), dtype=bool)
    often = np.zeros(len(key), dtype=bool)
    later[order[1:][same]] = True
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    return later, often


def measure(off: np.ndarray, raw: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    """All measures of the texts in one slice."""
    words = tb.Words(off, raw)
    n = len(off) - 1
    lead = (raw & 0xC0) != 0x80
    chars = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(lead & words.inside, out=chars[1:])
    length = chars[words.end] - chars[words.start]
    hashed = words.hashes()
    salt = tb.mix64(np.arange(n, dtype=np.uint64) + np.uint64(1))

    out = {
        "n_words": words.count.astype(np.int64),
        "word_chars": chars[off[1:]] - chars[off[:-1]],
        "n_symbols": tb.per_text(_SYMBOL[raw], off),
    }
    gram_chars = []
    for width in sorted({*rules.ngram_limits, rules.window}):
        grams, at = words.windows(hashed, width)
        later, often = _seen_before(grams ^ salt[words.text[at]])
        if width == rules.window:
            out["n_repeat_words"] = tb.per_text(tb.covered(len(hashed), at[often], width), words.begin)
        if width in rules.ngram_limits:
            gram_chars.append(tb.per_text(length * tb.covered(len(hashed), at[later], width), words.begin))
    out["dup_ngram_chars"] = np.stack(gram_chars, axis=1) if gram_chars else np.zeros((n, 0), np.int64)

    # Lines: cut at each newline and at text ends; a line is its exact bytes.
    cut = np.flatnonzero(raw == 10)
    begin = np.sort(np.concatenate([off[:-1], cut + 1]))
    stop = np.sort(np.concatenate([off[1:], cut]))
    holds = chars[stop] > chars[begin]
    begin, stop = begin[holds], stop[holds]
    up, down = tb.powers(tb.BYTE_MULTIPLIER, len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(tb.BYTE_CODES[raw] * up[: len(raw)], out=total[1:])
    whose = np.searchsorted(off, begin, side="right") - 1
    lines = tb.mix64((total[stop] - total[begin]) * down[begin] + tb.mix64((stop - begin).astype(np.uint64)))
    later, _ = _seen_before(lines ^ salt[whose])
    out["n_dup_lines"] = np.bincount(whose[later], minlength=n).astype(np.int64)
    out["dup_line_chars"] = np.bincount(whose[later], weights=(chars[stop] - chars[begin])[later], minlength=n).astype(np.int64)

    out["base_failed"] = (out["n_words"] < rules.fewest_words) | (100 * out["n_repeat_words"] > rules.most_repeat_percent * out["n_words"])
    bad = out["n_symbols"] > rules.symbols_per_word * out["n_words"]
    bad |= out["dup_line_chars"] > rules.line_limit * out["word_chars"]
    for k, width in enumerate(sorted(rules.ngram_limits)):
        bad |= out["dup_ngram_chars"][:, k] > rules.ngram_limits[width] * out["word_chars"]
    out["kept"] = ~out["base_failed"] & ~bad
    return out


def quality_rules(docs: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its measures, ``base_failed`` and ``kept``; a pure map without shuffle."""
    rules = rules or Rules()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            off, raw = tb.utf8(batch.column(1))
            for i, j in tb.slices(off):
                got = measure(off[i : j + 1] - off[i], raw[off[i] : off[j]], rules)
                cols: list[pa.Array] = [batch.column(0).slice(i, j - i)]
                for name in names[1:]:
                    v = got[name]
                    if v.ndim == 2:
                        cols.append(pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel(), pa.int64())))
                    else:
                        cols.append(pa.array(v))
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, SCHEMA)


def kept_rows(docs: DataFrame, rules: Rules | None = None, text_col: str = "text") -> DataFrame:
    """The rows whose text is kept, with all columns as they are; no shuffle."""
    rules = rules or Rules()
    where = docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, raw = tb.utf8(batch.column(where))
            keep = [measure(off[i : j + 1] - off[i], raw[off[i] : off[j]], rules)["kept"] for i, j in tb.slices(off)]
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return docs.mapInArrow(scan, docs.schema)
