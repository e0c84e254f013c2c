"""Token counts by prefix dynamic programming.

For byte-level BPE the encoding of a prefix ends in exactly one token ``t`` whose predecessor is
the last token of the shorter prefix without ``t`` and whose junction with it no merge would
close.  Storing the last token and the count of every prefix of a piece therefore gives the exact
count of *every* prefix in one pass, so truncation and budget questions need no second encoding.
Pieces are those of the tokenizer's own pre-tokenizer; what a word contributes is kept in a
bounded cache, because words repeat.

Edge cases: a null or empty text has no bytes and no tokens; rows are counted one by one, so null
or repeated ids, ties, empty tables and foreign columns need no special care; texts are counted
whole and in the order of their pieces, with memory proportional to the text.  The strings of
special tokens inside a text count as the library counts them by default: one token each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_fitting long"

#: A word whose neighbourhood matters (white space at its edge) counts as this much, which no text reaches.
_UNSURE = 1 << 50
#: Stands for "no token before" in the key of a pair of token ids.
_NOTHING = (1 << 20) - 1
_SPACE = "Ġ"
#: Closing characters that form one piece after letters, and no contraction.
_CLOSERS = ".,!?;:#$%&*|"


#: Letters of the Latin-1 block, which every Unicode version classes alike.
_LATIN = {c: "a" for c in range(0xC0, 0x100) if chr(c).isalpha()}


class _Missing(dict):
    """A dict that asks ``make`` for absent keys and forgets everything beyond ``most`` of them."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        out = self[key] = self.make(key)
        return out


class PrefixCounter:
    """Counts tokens of texts and of all their prefixes for one byte-level BPE tokenizer file."""

    def __init__(self, tokenizer_file: str, cache: int = 600_000) -> None:
        from tokenizers import Tokenizer

        spec = json.load(open(tokenizer_file, encoding="utf-8"))
        if spec.get("normalizer") or any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{tokenizer_file}: a normalizer, or special tokens that take white space or whole words, are not supported")
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.strings = {v: k for k, v in self.vocab.items()}
        #: length of the longest token that ends in given three symbols
        self.reach: dict[str, int] = {}
        for token in self.vocab:
            self.reach[token[-3:]] = max(self.reach.get(token[-3:], 2), len(token))
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {m: k for k, m in enumerate(merges)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces_of = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self._joins = _Missing(self._joins_as_two, 2 * cache)
        self._letter = _Missing(lambda ch: "".join(p for p, _ in self.pieces_of(ch)), 4096)
        self._piece = _Missing(lambda p: self.piece_prefixes(p)[-1], cache)
        self._word = _Missing(self._word_after_space, cache)

    def _merge(self, piece: str) -> list[str]:
        """Plain BPE by merge rank: the definition that the dynamic programme relies on for short strings."""
        parts = list(piece)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _joins_as_two(self, pair: int) -> bool:
        """Whether the right token may follow the left one (or stand first): no merge crosses the seam."""
        parts = [self.strings[x] for x in (pair >> 20, pair & 0xFFFFF) if x != _NOTHING]
        return self._merge("".join(parts)) == parts

    def piece_prefixes(self, piece: str) -> list[int]:
        """Token count of each prefix (0 to all symbols) of one pre-tokenizer piece."""
        ids, joins, reach = self.vocab.get, self._joins, self.reach.get
        last, count = [_NOTHING], [0]
        for i in range(1, len(piece) + 1):
            far = reach(piece[i - 3 : i], 2) if i > 2 else i
            for j in range(i - far if i > far else 0, i):
                token = ids(piece[j:i])
                if token is not None and joins[last[j] << 20 | token]:
                    last.append(token)
                    count.append(count[j] + 1)
                    break
            else:  # not reachable for a well-formed vocabulary
                raise ValueError(f"no token ends the prefix {piece[:i]!r}")
        return count

    def _symbols(self, text: str) -> str:
        """The pre-tokenizer's symbols for the bytes of a run of letters."""
        return "".join(p for p, _ in self.pieces_of(text)) if len(text) > 64 else "".join(map(self._letter.__getitem__, text))

    def _plain(self, text: str) -> int:
        return sum(self._piece[p] for p, _ in self.pieces_of(text)) if text else 0

    def _counted(self, text: str) -> int:
        """Tokens of any text, piece by piece."""
        if self.special_re is None:
            return self._plain(text)
        total, at = 0, 0
        for m in self.special_re.finditer(text):
            total += self._plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self._plain(text[at:])

    def _word_after_space(self, word: str) -> int:
        if not word or word[0].isspace() or word[-1].isspace():
            return _UNSURE
        letters = word.rstrip(_CLOSERS)
        if letters.isalpha() and (letters.isascii() or letters.translate(_LATIN).isascii()):
            count = self._piece[_SPACE + (letters if letters.isascii() else self._symbols(letters))]
            return count + (self._piece[word[len(letters) :]] if len(letters) < len(word) else 0)
        return self._counted(" " + word)

    def count(self, text: str | None) -> int:
        """Tokens of the whole text.

        Between two words parted by one space a piece always ends, so the words' counts add up;
        a text where white space stands otherwise goes through the pre-tokenizer as a whole.
        """
        if not text:
            return 0
        first, _, rest = text.partition(" ")
        if not first or first[-1].isspace():
            return self._counted(text)
        total = self._counted(first)
        if rest or len(first) < len(text):
            total += sum(map(self._word.__getitem__, rest.split(" ")))
        return total if total < _UNSURE else self._counted(text)

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token count of ``text[:i]`` for every i from 0 to its length."""
        out = np.zeros(len(text) + 1, np.int64)
        base, at = 0, 0
        marks = list(self.special_re.finditer(text)) if self.special_re else []
        for m in [*marks, None]:
            stop = m.start() if m else len(text)
            out[at : stop + 1] = base + self._plain_prefixes(text[at:stop])
            base = int(out[stop])
            if m:
                for i in range(m.start() + 1, m.end()):  # an unfinished special string is plain text
                    out[i] = out[at] + self._plain(text[at:i])
                base += 1
                out[m.end()] = base
                at = m.end()
        return out

    def _plain_prefixes(self, text: str) -> np.ndarray:
        out = np.zeros(len(text) + 1, np.int64)
        base = 0
        run_base, run_from = 0, -1  # a white-space run is one piece as long as it ends the prefix
        for piece, (a, b) in self.pieces_of(text):
            counts = self.piece_prefixes(piece)
            part = text[a:b]
            ends = np.cumsum([len(c.encode()) for c in part])
            inner = [counts[e] for e in ends]
            if part[0] == "'" and len(part) == 3 and part[1:] in ("re", "ve", "ll"):
                inner[1] = self._plain(part[:2])
            lead = 0
            while lead < len(part) and part[lead].isspace():
                lead += 1
            if lead:
                if run_from < 0:
                    run_from, run_base = a, base
                run = self.pieces_of(text[run_from : a + lead])
                if len(run) == 1:
                    all_counts = self.piece_prefixes(run[0][0])
                    run_ends = np.cumsum([len(c.encode()) for c in text[run_from : a + lead]])
                    for k in range(a - run_from, a - run_from + lead):
                        out[run_from + k + 1] = run_base + all_counts[run_ends[k]]
                else:
                    for k in range(a, a + lead):
                        out[k + 1] = run_base + self._plain(text[run_from : k + 1])
            for k in range(lead, len(part)):
                out[a + k + 1] = base + inner[k]
            if lead < len(part):
                run_from = -1
            base += counts[-1]
        if run_from < 0 and len(text):
            out[len(text)] = base
        return out

    def longest_prefix(self, text: str, budget: int) -> int:
        """Length of the longest prefix of at most ``budget`` tokens (counts may dip, so the last one counts)."""
        return int(np.flatnonzero(self.prefix_counts(text) <= budget)[-1])


    def fitting(self, text: str, budget: int) -> int:
        """As :meth:`longest_prefix`, reading no further than the budget reaches.

        Words parted by one space add up, so only the prefixes inside the word that crosses the budget are in question.
        Elsewhere pieces are counted until they exceed the budget, and the prefixes up to a few pieces further on are looked at.
        """
        first, _, rest = text.partition(" ")
        total = self._counted(first) if first and not first[-1].isspace() else _UNSURE
        at = len(first)
        if total <= budget:
            for word in rest.split(" ") if at < len(text) else ():
                count = self._word[word]
                if count >= _UNSURE:
                    break
                if total + count > budget:
                    return at + self.longest_prefix(" " + word, budget - total)
                total, at = total + count, at + 1 + len(word)
            else:
                return len(text)
        read, beyond = 0, 0
        parts = [text[a:b] for a, b in self._stretches(text)]
        total = 0
        for part in parts:
            for piece, (_, b) in self.pieces_of(part) if part not in self.special else [(None, (0, len(part)))]:
                total += 1 if piece is None else self._piece[piece]
                beyond += total > budget
                if beyond > 8:
                    return self.longest_prefix(text[: read + b], budget)
            read += len(part)
        return self.longest_prefix(text, budget)

    def _stretches(self, text: str) -> Iterator[tuple[int, int]]:
        """Plain stretches and special strings, in order."""
        at = 0
        for m in self.special_re.finditer(text) if self.special_re else ():
            yield at, m.start()
            yield m.start(), m.end()
            at = m.end()
        yield at, len(text)


@lru_cache(maxsize=2)
def counter(tokenizer_file: str) -> PrefixCounter:
    return PrefixCounter(tokenizer_file)


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text, whether it exceeds the limit, and the characters of its longest prefix within it; a pure map.

    ``tokenizer`` names a public vocabulary file (or is a path to one) that every worker has.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        path = tokenizer
        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(tokenizer)
        c = counter(str(path))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = np.fromiter(map(c.count, texts), np.int64, len(texts))
            size = np.fromiter((len(t.encode()) if t else 0 for t in texts), np.int64, len(texts))
            fits = np.fromiter((c.fitting(t, limit) if k > limit else len(t or "") for t, k in zip(texts, n.tolist(), strict=True)), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit), pa.array(fits)], ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_fitting"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, SCHEMA)
