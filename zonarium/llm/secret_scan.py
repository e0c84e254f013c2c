"""Secret scans: fixed patterns, and a character convolutional network over the other candidates.

Three patterns give the base findings.  Every other run of 16 or more key-like characters, or part
of a run beside a base finding, is a candidate; a small convolutional network in numpy reads its characters and 32 characters on either
side and gives a probability that it is a secret.  The network is trained here on labelled
findings (:func:`labelled_findings` makes a fixed, bounded set; another can be passed).  Three fifths of them
train it, a fifth calibrates its scores, and on the last fifth the threshold is chosen: the highest
probability that keeps the wanted recall.  Training is seeded, so the same labels give the same model on
every driver.

Edge cases: null text counts as empty and has no findings; repeated rows and null ids are scanned
one by one; texts are scanned whole, long candidates in overlapping pieces; an empty table gives an
empty result; only the two named columns are read.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonarium.llm import textbatch as tb

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long"
KINDS = ("assign", "access", "hex", "model")

# The three base patterns.
ASSIGN = re.compile(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
SHORTEST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=.-]{{{SHORTEST},}}")

SIDE, BODY = 32, 64
WIDTH = SIDE + BODY + SIDE
ALPHABET = 97  # 0: nothing, 1..95: printable ASCII, 96: any other

_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"]] = True


def base_findings(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, sorted by start and then by kind as listed."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def candidates(text: str, taken: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """Key-like runs, less what base findings (sorted by start) take of them: each part that is left counts if it is long enough."""
    out, k, reach = [], 0, 0  # findings before k begin before the place looked at; the furthest of them ends at reach
    for m in CANDIDATE.finditer(text):
        at = m.start()
        while at < m.end():
            while k < len(taken) and taken[k][0] <= at:
                reach = max(reach, taken[k][2])
                k += 1
            if reach > at:
                at = min(reach, m.end())
                continue
            end = min(m.end(), taken[k][0]) if k < len(taken) else m.end()
            if end - at >= SHORTEST:
                out.append((at, end))
            at = end
    return out


# --- labelled findings ---------------------------------------------------------------------------


def labelled_findings(n: int = 12_000, seed: int = 7) -> list[tuple[str, str, str, int]]:
    """``n`` labelled candidates (left context, candidate, right context, secret or not).

    The positives imitate the shapes of issued credentials, the negatives what prose, links, tables
    and code hold instead.  Some of the negatives look like keys and only their context tells (identifiers, checksums,
    embedded images); one candidate in a hundred is a bare random string of either label, so that no score is certain.
    """
    rng = random.Random(seed)
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alnum = letters + letters.upper() + digits
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    syllables = [pick("bcdfghklmnprstvw", 1) + pick("aeiou", 1) + pick("lnrst", rng.randrange(2)) for _ in range(300)]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    clusters = "sch cht tz pf ng st nd th wh rr ll ch str ver ein heit keit ung er en ie au be zu tion ment oui eau ció ado que the ing and".replace("ó", "o").split()
    compound = lambda: "".join(rng.choice(clusters) for _ in range(rng.randrange(5, 10)))
    prose = lambda: " ".join(rng.choice((word, word, word, lambda: compound()[: rng.randrange(3, 14)]))() for _ in range(8)) + " "
    positives = [
        lambda: pick(alnum, rng.randrange(20, 65)),
        lambda: pick(letters + letters.upper(), rng.randrange(20, 65)),
        lambda: "ghp_" + pick(alnum, 36),
        lambda: "sk-" + pick(alnum, rng.randrange(32, 49)),
        lambda: "xoxb-" + pick(digits, 11) + "-" + pick(alnum, 24),
        lambda: "eyJ" + pick(alnum, 33) + "." + pick(alnum, 40) + "." + pick(alnum + "-_", 43),
        lambda: pick(alnum + "+/", rng.choice((32, 40, 44, 64))) + rng.choice(("", "=", "==")),
        lambda: pick(digits + rng.choice(("abcdef", "ABCDEF")), rng.choice((24, 32, 40, 64))),
        lambda: "AIza" + pick(alnum + "-_", 35),
    ]
    negatives = [
        lambda: "-".join(word() for _ in range(rng.randrange(3, 6))) + "-" + str(rng.randrange(1, 2100)),
        lambda: word() + "/" + word() + "/" + word() + str(rng.randrange(1, 99)) + ".html",
        lambda: "www." + word() + word() + str(rng.randrange(10)) + "." + word() + ".com",
        lambda: f"{rng.randrange(1990, 2030)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}T{rng.randrange(24):02d}.{rng.randrange(60):02d}",
        lambda: "version-" + ".".join(str(rng.randrange(40)) for _ in range(4)) + "-" + rng.choice(("beta", "rc1", "final")),
        lambda: word() + word() + word() + word() + rng.choice((".", "", str(rng.randrange(100)))),
        lambda: (word() + word() + word() + word()).title() + rng.choice((".", "...", "")),
        compound,
        lambda: compound().capitalize() + rng.choice((".", "", "...")),
        lambda: "-".join((word(), word(), word(), word())),
        lambda: word().upper() + word().upper() + word().upper() + rng.choice((".", "")),
        lambda: word().upper() + "_" + word().upper() + "_" + word().upper() + "_" + str(rng.randrange(10)),
        lambda: word() + word().title() + word().title() + word().title() + str(rng.randrange(10)),
        lambda: rng.choice("xX0aA-=_.") * rng.randrange(15, 50) + rng.choice(("1a", "", "-")),
        lambda: word() + "." + word() + str(rng.randrange(10)) + "." + word() + "." + word(),
        lambda: str(rng.randrange(10**6)) + "-" + word() + "-" + str(rng.randrange(10**6)) + "-" + word(),
        lambda: pick(digits, rng.randrange(16, 30)),
        lambda: "-".join(pick(digits + "abcdef", k) for k in (8, 4, 4, 4, 12)),
    ]
    alike = [
        lambda: ("IBAN ", pick(letters.upper(), 2) + pick(digits, 20)),
        lambda: ("data:image/png;base64,", "iVBORw0KGgo" + pick(alnum + "+/", rng.randrange(40, 90))),
        lambda: (rng.choice(("sha256:", "checksum ", "md5 ", "digest ", "commit ")), pick(digits + rng.choice(("abcdef", "ABCDEF")), rng.choice((32, 40, 64)))),
        lambda: (rng.choice(("ISBN ", "order no. ", "tracking ", "serial ")), pick(digits + letters.upper(), rng.randrange(16, 24))),
        lambda: ("https://" + word() + ".com/watch?v=", pick(alnum + "-_", rng.randrange(16, 24))),
    ]
    hints = ["key=", "key: ", "auth ", "Authorization: Bearer ", "private ", "credential ", "export KEY=", 'token = "', "password: ", 'secret="', "api_key="]
    out = []
    for k in range(n):
        secret, left = k % 2, prose()
        if rng.random() < 0.01:
            body, secret = pick(alnum, rng.randrange(20, 40)), rng.randrange(2)
        elif secret:
            left, body = left + (rng.choice(hints) if rng.random() < 0.6 else ""), rng.choice(positives)()
        elif rng.random() < 0.15:
            hint, body = rng.choice(alike)()
            left += hint
        else:
            left, body = left + (rng.choice(hints) if rng.random() < 0.1 else ""), rng.choice(negatives)()
        if len(body) >= SHORTEST:
            out.append((left, body, rng.choice((" ", ", ", "\n", ". ")) + prose(), secret))
    rng.shuffle(out)
    return out


# --- network -------------------------------------------------------------------------------------


def encode(left: str, body: str, right: str) -> np.ndarray:
    """Codes of the context, the candidate (its first ``BODY`` characters) and the context after it."""
    codes = np.zeros(WIDTH, np.uint8)
    for text, at, last in ((left[-SIDE:], SIDE - len(left[-SIDE:]), 0), (body[:BODY], SIDE, 0), (right[:SIDE], SIDE + BODY, 0)):
        for k, c in enumerate(text):
            o = ord(c)
            codes[at + k] = o - 31 if 32 <= o < 127 else 96
    return codes


def pieces(body: str) -> list[str]:
    """A candidate in overlapping pieces that the network can read whole."""
    return [body[k : k + BODY] for k in range(0, max(1, len(body) - BODY // 2), BODY // 2)]


@dataclass
class Network:
    """Embedding, one convolution, largest and mean activation over the candidate, logistic output."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    WINDOW = 5

    def _layers(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        x = self.embed[codes]  # n, width, e
        flag = np.zeros((*codes.shape, 1), np.float32)
        flag[:, SIDE : SIDE + BODY] = (codes[:, SIDE : SIDE + BODY, None] > 0)
        x = np.concatenate([x, flag], 2)
        cols = np.lib.stride_tricks.sliding_window_view(x, self.WINDOW, axis=1)  # n, positions, e, window
        flat = np.ascontiguousarray(cols).reshape(len(codes), cols.shape[1], -1)
        act = np.maximum(flat @ self.kernel + self.bias, 0)
        inside = flag[:, 2:-2, :]
        size = np.maximum(inside.sum(1), 1)
        mean = (act * inside).sum(1) / size
        top = act.argmax(1)
        largest = np.take_along_axis(act, top[:, None, :], 1)[:, 0]
        return x, flat, act, inside / size[:, None, :], top, np.concatenate([largest, mean, np.ones((len(codes), 1), np.float32)], 1)

    def scores(self, codes: np.ndarray) -> np.ndarray:
        parts = [self._layers(codes[k : k + 512])[-1] @ self.out for k in range(0, len(codes), 512)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.scores(codes).astype(np.float64) + self.shift)))


def train(labelled: list[tuple[str, str, str, int]], recall: float = 0.97, epochs: int = 6, embedding: int = 10, filters: int = 32, seed: int = 3) -> Network:
    """Fit by Adam on three fifths, calibrate (Platt) on the fourth and choose the threshold on the last."""
    rng = np.random.default_rng(seed)
    codes = np.stack([encode(a, b, c) for a, b, c, _ in labelled])
    label = np.array([y for *_, y in labelled], np.float32)
    cut, last = 3 * len(label) // 5, 4 * len(label) // 5
    w = Network.WINDOW
    net = Network(*(rng.normal(0, s, shape).astype(np.float32) for s, shape in ((0.3, (ALPHABET, embedding)), (0.15, ((embedding + 1) * w, filters)), (0.01, filters), (0.1, 2 * filters + 1))))
    params = [net.embed, net.kernel, net.bias, net.out]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(cut), max(1, cut // 64)):
            c, y = codes[batch], label[batch]
            x, flat, act, share, top, head = net._layers(c)
            wrong = ((1 / (1 + np.exp(-(head @ net.out)))) - y).astype(np.float32) / len(batch)
            g_out = head.T @ wrong
            g_head = wrong[:, None] * net.out[None, :]
            g_act = g_head[:, None, filters : 2 * filters] * share
            np.put_along_axis(g_act, top[:, None, :], np.take_along_axis(g_act, top[:, None, :], 1) + g_head[:, None, :filters], 1)
            g_act *= act > 0
            g_kernel = np.einsum("npk,npf->kf", flat, g_act, optimize=True)
            g_flat = (g_act @ net.kernel.T).reshape(len(batch), act.shape[1], embedding + 1, w)
            g_x = np.zeros_like(x)
            for k in range(w):
                g_x[:, k : k + act.shape[1]] += g_flat[..., k]
            g_embed = np.zeros_like(net.embed)
            np.add.at(g_embed, c.ravel(), g_x[..., :embedding].reshape(-1, embedding))
            t += 1
            for p, g, a, b in zip(params, (g_embed, g_kernel, g_act.sum((0, 1)), g_out), m, v, strict=True):
                a[:] = 0.9 * a + 0.1 * g
                b[:] = 0.999 * b + 0.001 * g * g
                p -= 0.004 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-7)
    held = net.scores(codes[cut:last]).astype(np.float64)
    truth = label[cut:last].astype(np.float64)
    # Platt's targets keep the probabilities inside (0, 1) even where the scores part the classes
    truth = np.where(truth == 1, (truth.sum() + 1) / (truth.sum() + 2), 1 / ((1 - truth).sum() + 2))
    for _ in range(200):  # Newton steps on two numbers
        p = 1 / (1 + np.exp(-(net.scale * held + net.shift)))
        g = np.array([((p - truth) * held).sum() + 1e-2 * net.scale, (p - truth).sum()])
        q = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(q * held * held).sum() + 1e-2, (q * held).sum()], [(q * held).sum(), q.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 1.0 / np.abs(step).max())
        net.scale, net.shift = float(net.scale - step[0]), float(net.shift - step[1])
        if np.abs(step).max() < 1e-6:
            break
    sure = np.sort(net.probability(codes[last:])[label[last:] == 1])
    net.threshold = float(sure[int(np.floor((1 - recall) * len(sure)))]) if len(sure) else 0.5
    return net


@lru_cache(maxsize=1)
def default_network() -> Network:
    return train(labelled_findings())


# --- scan ----------------------------------------------------------------------------------------


def _worth_reading(off: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Texts that can hold a finding: one with ``=`` or ``:``, or with a run of 16 key-like characters."""
    edge = np.diff(np.concatenate([[False], _RUN[raw], [False]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    run = (stop - start) >= SHORTEST
    at = np.concatenate([start[run], np.flatnonzero((raw == ord("=")) | (raw == ord(":")))])
    flag = np.zeros(len(off) - 1, bool)
    # a run may reach over several texts laid end to end
    flag[np.searchsorted(off, at, side="right") - 1] = True
    first, last = np.searchsorted(off, start[run], side="right") - 1, np.searchsorted(off, stop[run] - 1, side="right") - 1
    for a, b in zip(first[last > first].tolist(), last[last > first].tolist(), strict=True):
        flag[a : b + 1] = True
    return flag


def find(texts: list[str | None], net: Network) -> list[list[tuple[int, str, int]]]:
    """Sorted findings (start, kind, end) of each text."""
    out, ask, codes = [], [], []
    for k, text in enumerate(texts):
        found = base_findings(text) if text else []
        out.append(found)
        for a, b in candidates(text, found) if text else ():
            for piece in pieces(text[a:b]):
                ask.append((k, a, b))
                codes.append(encode(text[max(0, a - SIDE) : a], piece, text[b : b + SIDE]))
    if ask:
        good = net.probability(np.stack(codes)) >= net.threshold
        for k, a, b in dict.fromkeys(x for x, g in zip(ask, good, strict=True) if g):
            out[k].append((a, "model", b))
    return [sorted(x, key=lambda f: (f[0], KINDS.index(f[1]))) for x in out]


def joined(findings: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in findings)


def _scan_texts(batch_texts: pa.Array, net: Network) -> list[list[tuple[int, str, int]]]:
    off, raw = tb.utf8(batch_texts)
    out: list[list[tuple[int, str, int]]] = []
    for i, j in tb.slices(off):
        worth = _worth_reading(off[i : j + 1] - off[i], raw[off[i] : off[j]])
        texts = batch_texts.slice(i, j - i)
        out += find([texts[k].as_py() if worth[k] else None for k in range(j - i)], net)
    return out


def secret_scan(docs: DataFrame, net: Network | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its findings; a pure map (the network is a few thousand numbers)."""
    net = net or default_network()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _scan_texts(batch.column(1), net)
            count = {k: pa.array([sum(f[1] == k for f in x) for x in found], pa.int64()) for k in KINDS}
            base = [hashlib.sha256(joined([f for f in x if f[1] != "model"]).encode()).hexdigest() for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), count["assign"], count["access"], count["hex"], pa.array(base, pa.string()), pa.array([joined(x) for x in found], pa.string()), count["model"]],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, SCHEMA)


def redacted(text: str, findings: list[tuple[int, str, int]], mark: str = "[SECRET]") -> str:
    """The text with every finding replaced; overlapping findings become one mark."""
    out, at = [], 0
    for a, _, b in findings:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, net: Network | None = None, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with findings replaced in the text, and its length kept true."""
    net = net or default_network()
    where = docs.columns.index(text_col)
    length = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(where).to_pylist()
            found = _scan_texts(batch.column(where), net)
            cols = list(batch.columns)
            for k, x in enumerate(found):
                if x:
                    texts[k] = redacted(texts[k], x)
            if any(found):
                cols[where] = pa.array(texts, batch.schema.field(where).type)
                if length is not None:
                    old = batch.column(length).to_pylist()
                    cols[length] = pa.array([len(t) if x else n for t, x, n in zip(texts, found, old, strict=True)], batch.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(scan, docs.schema)
