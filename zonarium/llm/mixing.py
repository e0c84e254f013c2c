"""Mixing sources to target weights by soft membership, in DataFrame functions only.

Domains come from the labelled table: ``toxic`` (toxic = 1), ``low`` (quality = 0) and ``clean``
(quality = 1).  A naive Bayes classifier over hashed distinct words, their beginnings, how varied
they are and the share of symbols is fitted on a bounded sample of labelled documents (``most_labels``, chosen by hash of the id), its
evidence is calibrated by a logistic regression on the same rows, and every document gets its
posterior over the domains.  Then nonnegative rates r are fitted by
projected gradient on

    f(r) = 1/2 (g - T)' W (g - T),   g = sum over documents of r_i n_i p_i

where n_i are a document's words, p_i its posterior, T the target tokens of each domain and
W = (sum n_i p_i p_i')^-1, which makes the gradient step 1 safe.  In the metric 1/n_i a step is
r_i <- max(0, r_i - p_i' W (g - T)), so a rate depends on the posterior alone: documents of one
posterior are combined before the iterations, each iteration is one aggregation over the distinct
posteriors, and the final rates are an expression of the posterior and the steps.

Edge cases: null and empty texts have no words, the prior as posterior and a rate like others;
labels without a document, with a null id or given twice for an id are used as far as they match; if no domain
has a labelled row the posterior is the uniform prior; an empty table gives an empty result; null
sources stay null; rows with equal ids are mixed one by one; only named columns are read.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonarium.llm.simhash_dedup import written

#: Words that begin alike often belong together; so many characters tell.
BEGINNING = 5
SYMBOLS = "[#$%&*|<>=~^_+!]+"
#: What parts words.
BETWEEN = r"""[ \t-\r.,;:?"'()]+"""
DOMAINS = ("clean", "low", "toxic")


@dataclass(frozen=True)
class Mix:
    """Target share of each domain, total tokens as a multiple of what there is, and the fit's parameters."""

    weights: dict[str, float] = field(default_factory=lambda: {"clean": 0.92, "low": 0.04, "toxic": 0.04})
    volume: float = 1.0
    most_labels: int = 20_000
    most_features: int = 2_000
    least_certainty: float = 20.0
    least_lift: float = 0.3
    rounds: int = 40
    tolerance: float = 1e-3
    leave_out: dict[str, float] = field(default_factory=dict)


def with_features(df: DataFrame) -> DataFrame:
    """Adds ``n_tokens`` and ``f`` for ``text``: 64-bit codes of the distinct words (in lower case, without punctuation
    and symbols), of their beginnings (not distinct), of how varied the words are, and of the share of symbols, which tells
    prose from menus and junk; drops the text.

    One projection for each value that is used twice, so that none is computed twice.
    """
    rest = [c for c in df.columns if c != "text"]
    df = df.select(*rest, F.lower(F.coalesce("text", F.lit(""))).alias("_t"))
    df = df.select(*rest, F.octet_length("_t").alias("_s"), F.regexp_replace("_t", SYMBOLS, "").alias("_x"))
    symbols = F.floor(F.sqrt((F.col("_s") - F.octet_length("_x")) / F.greatest("_s", F.lit(1))) * 10)
    df = df.select(*rest, symbols.alias("_y"), F.array_remove(F.split("_x", BETWEEN), "").alias("_w"))
    words = F.array_distinct(F.transform("_w", lambda w: F.xxhash64(w)))
    begins = F.transform("_w", lambda w: F.xxhash64(F.substring(w, 1, BEGINNING), F.lit(BEGINNING)))
    df = df.select(*rest, "_y", F.size("_w").cast("long").alias("n_tokens"), words.alias("_d"), begins.alias("_b"))
    varied = F.floor(10 * F.size("_d") / F.greatest(F.col("n_tokens"), F.lit(1)))
    codes = F.concat("_d", "_b", F.array(F.xxhash64(varied, F.lit(2), F.lit(2)), F.xxhash64("_y", F.lit(3), F.lit(3))))
    return df.select(*rest, "n_tokens", codes.alias("f"))


@dataclass(frozen=True)
class Places:
    """A slot for a code: its low bits, exclusive-ored with the move that its bits from ``low`` on choose."""

    size: int
    low: int
    moves: list[int]

    def __call__(self, code: int) -> int:
        return (code ^ self.moves[(code >> self.low) & (len(self.moves) - 1)]) & (self.size - 1)


def placed(codes: list[int]) -> Places:
    """Places that give every code a slot of its own: groups of one move are placed in turn, the largest first."""
    bits = (8 * len(codes)).bit_length()
    for size in (1 << k for k in range(bits, bits + 4)):
        groups_of = max(2, size // 4)
        for low in (*range(size.bit_length() - 1, 63), *range(size.bit_length() - 1)):
            groups: dict[int, list[int]] = {}
            for code in codes:
                groups.setdefault((code >> low) & (groups_of - 1), []).append(code & (size - 1))
            moves, used = [0] * groups_of, set()
            for group, at in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
                free = (m for m in range(size) if used.isdisjoint(a ^ m for a in at)) if len(set(at)) == len(at) else iter(())
                move = next(free, None)
                if move is None:
                    break
                moves[group] = move
                used.update(a ^ move for a in at)
            else:
                return Places(size, low, moves)
    raise ValueError("codes cannot be placed: they are not spread like hashes")


@dataclass
class Classifier:
    """For each telling feature its log weight for every domain but the first, and the calibration.

    Evidence for a domain is against the domains listed before it.  Row k of ``scale`` turns (1, evidence for each
    later domain) into the log odds of domain k + 1 against the domains before it.
    """

    weights: dict[int, list[float]]
    scale: list[list[float]]

    def evidence(self, features: Column) -> Column:
        """Array of the summed weights of the telling features, one for every later domain.

        Telling features sit in a table next to their full code, each in a slot of its own.
        """
        zero = F.array(*(F.lit(0.0) for _ in DOMAINS[1:]))
        if not self.weights:
            return zero
        place = placed(list(self.weights))
        slots: list[dict | None] = [None] * place.size
        for code, w in self.weights.items():
            slots[place(code)] = {"c": code, "w": w}
        table = F.from_json(F.lit(json.dumps(slots)), "array<struct<c:bigint,w:array<double>>>")
        moves = F.from_json(F.lit(json.dumps(place.moves)), "array<bigint>")
        moved = lambda f: F.element_at(moves, (F.shiftright(f, place.low).bitwiseAND(F.lit(len(place.moves) - 1)) + 1).cast("int"))
        slot = lambda f: F.element_at(table, (f.bitwiseXOR(moved(f)).bitwiseAND(F.lit(place.size - 1)) + 1).cast("int"))
        # few features tell: the set operation is compiled, what follows is not
        told = F.array_intersect(F.from_json(F.lit(json.dumps(list(self.weights))), "array<bigint>"), features)
        total = F.aggregate(told, zero, lambda t, f: F.zip_with(t, slot(f)["w"], lambda x, y: x + y))
        return F.transform(total, lambda x: F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0)))

    def log_odds(self, evidence: Column) -> list[Column]:
        return [sum((F.lit(b) * evidence[k] for k, b in enumerate(row[1:])), F.lit(row[0])) for row in self.scale]


def _calibrated(cells: list[tuple[int, list[float], int]], domains: int) -> list[list[float]]:
    """For each domain but the first a logistic regression on the evidence, against the domains before it, by damped Newton steps.

    ``cells`` are (domain, evidence, labelled rows); a weak ridge keeps separable evidence finite.
    """
    out = []
    for k in range(1, domains):
        theta = np.zeros(domains)
        theta[0] = -math.log(k)  # of equal domains
        some = [c for c in cells if c[0] <= k]
        x = np.array([[1.0, *e] for _, e, _ in some])
        y = np.array([d == k for d, *_ in some], float)
        n = np.array([c for *_, c in some], float)
        ridge = 1e-5 * n.sum() * np.eye(domains)
        for _ in range(100 if some else 0):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            curve = (x * (n * p * (1 - p))[:, None]).T @ x + ridge
            step = np.linalg.solve(curve, (n * (p - y)) @ x + ridge @ theta)
            theta -= step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
            if np.abs(step).max() < 1e-6:
                break
        out.append(theta.round(6).tolist())
    return out


def fit_classifier(docs: DataFrame, labels: DataFrame, mix: Mix) -> Classifier:
    """Naive Bayes from at most ``most_labels`` labelled rows, keeping ``most_features`` telling features.

    A feature tells if its log-likelihood ratio (G) between a domain and those before it is ``least_certainty`` or
    more; its log ratio, less one standard error, is its weight.  Counting and choosing are aggregations; only chosen rows are gathered.
    """
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    some = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain"))
        .where("doc_id is not null and domain is not null")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "domain")
        .limit(mix.most_labels)
    )
    seen = written(with_features(docs.join(F.broadcast(some), "doc_id").select("domain", "text")).select("domain", "f"), "labelled")
    totals = {r["domain"]: r["n"] for r in seen.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = [totals.get(k, 0) for k in range(len(DOMAINS))]
    counts = seen.select("domain", F.explode(F.array_distinct("f")).alias("f")).groupBy("f").agg(*(F.count_if(F.col("domain") == k).alias(f"c{k}") for k in range(len(DOMAINS))))
    weight, certain = [], []
    for k in range(1, len(DOMAINS)):
        before = sum(n[:k])
        if not before or not n[k]:
            weight.append(F.lit(0.0))
            certain.append(F.lit(0.0))
            continue
        here, there = F.col(f"c{k}") + 0.5, sum((F.col(f"c{j}") for j in range(k)), F.lit(0.5))
        lift = F.log(here / (n[k] + 1) * (before + 1) / there)
        share = (here + there) / (n[k] + before + 2)  # of the documents of all these domains
        parts = [(here, n[k] + 1, share), (n[k] + 1 - here, n[k] + 1, 1 - share), (there, before + 1, share), (before + 1 - there, before + 1, 1 - share)]
        certain.append(sum((2 * some_ * F.log(some_ / (all_ * part)) for some_, all_, part in parts), F.lit(0.0)))
        size = F.greatest(F.abs(lift) - F.sqrt(1 / here + 1 / there), F.lit(0.0))
        weight.append(F.when((certain[-1] >= mix.least_certainty) & (size >= mix.least_lift), F.round(F.signum(lift) * size, 4)).otherwise(F.lit(0.0)))
    strongest = F.greatest(F.lit(0.0), *(F.when(w != 0, c) for w, c in zip(weight, certain, strict=True)))
    told = counts.select("f", F.array(*weight).alias("w"), strongest.alias("s")).where("s > 0").orderBy(F.desc("s"), "f").limit(mix.most_features).collect()
    model = Classifier({r["f"]: list(r["w"]) for r in told}, [])
    cells = seen.select("domain", F.transform(model.evidence(F.col("f")), lambda x: F.round(2 * x) / 2).alias("e")).groupBy("domain", "e").count().collect()
    model.scale = _calibrated([(r["domain"], list(r["e"]), r["count"]) for r in cells], len(DOMAINS))
    return model


def with_posterior(df: DataFrame, model: Classifier) -> DataFrame:
    """Replaces ``f`` by ``p``, the posterior over the domains in steps of 1/200, so that equal evidence is one class.

    The running sums are rounded, not the parts, so every posterior adds up to one.
    """
    rest = [c for c in df.columns if c != "f"]
    df = df.select(*rest, model.evidence(F.col("f")).alias("_e"))
    against = [1 / (1 + F.exp(F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0)))) for x in model.log_odds(F.col("_e"))]
    df = df.select(*rest, F.array(*against).alias("_a"))
    upto = [F.lit(200.0)]  # of this domain and those before it
    for k in range(len(DOMAINS) - 2, -1, -1):
        upto.insert(0, upto[0] * F.col("_a")[k])
    upto = [F.round(x) for x in upto]
    return df.select(*rest, F.array(upto[0] / 200, *((y - x) / 200 for x, y in zip(upto, upto[1:], strict=False))).alias("p"))


def _inverse(m: list[list[float]]) -> list[list[float]]:
    """Inverse of a small symmetric matrix, with empty domains left at zero weight."""
    n = len(m)
    scale = max(max(map(abs, r)) for r in m) or 1.0
    a = [[m[i][j] + (1e-9 * scale if i == j else 0.0) for j in range(n)] + [float(i == j) for j in range(n)] for i in range(n)]
    for c in range(n):
        p = max(range(c, n), key=lambda r: abs(a[r][c]))
        a[c], a[p] = a[p], a[c]
        a[c] = [x / a[c][c] for x in a[c]]
        for r in range(n):
            if r != c:
                a[r] = [x - a[r][c] * y for x, y in zip(a[r], a[c], strict=True)]
    return [r[n:] for r in a]


def rate(p: Column, steps: list[list[float]]) -> Column:
    """The rate after the given steps, from 1, each projected to zero or more."""
    if not steps:
        return F.lit(1.0)
    moves = F.from_json(F.lit(json.dumps(steps)), "array<array<double>>")
    dot = lambda d: sum((p[k] * d[k] for k in range(1, len(DOMAINS))), p[0] * d[0])
    return F.aggregate(moves, F.lit(1.0), lambda r, d: F.greatest(F.lit(0.0), r - dot(d)))


def fit_rates(members: DataFrame, mix: Mix) -> tuple[list[list[float]], list[float], list[float]]:
    """Steps of the projected gradient, the targets, and what the fitted rates are expected to give.

    ``members`` has ``n_tokens`` and ``p``.
    """
    classes = written(members.groupBy("p").agg(F.sum("n_tokens").cast("double").alias("n")), "posteriors")
    k = range(len(DOMAINS))
    row = classes.agg(F.sum("n").alias("all"), *(F.sum(F.col("n") * F.col("p")[i] * F.col("p")[j]).alias(f"m{i}{j}") for i in k for j in k)).first()
    total = row["all"] or 0.0
    target = [mix.weights.get(d, 0.0) * total * mix.volume for d in DOMAINS]
    if not total:
        return [], target, [0.0] * len(DOMAINS)
    w = _inverse([[row[f"m{i}{j}"] for j in k] for i in k])
    steps: list[list[float]] = []
    before = math.inf
    while True:
        r = rate(F.col("p"), steps)
        got = classes.agg(*(F.sum(F.col("n") * F.col("p")[i] * r).alias(f"g{i}") for i in k)).first()
        g = [got[f"g{i}"] for i in k]
        miss = [a - b for a, b in zip(g, target, strict=True)]
        if max(map(abs, miss)) <= mix.tolerance * total or len(steps) == mix.rounds:
            break
        worth = sum(miss[i] * w[i][j] * miss[j] for i in k for j in k)
        if worth > (1 - mix.tolerance) * before:  # no rates come closer
            break
        before = worth
        steps.append([sum(w[i][j] * miss[j] for j in k) for i in k])
    return steps, target, g


def mix_sources(docs: DataFrame, labels: DataFrame, mix: Mix | None = None, keep: tuple[str, ...] = ("source",)) -> DataFrame:
    """Every document with its words, posterior, rate and expected tokens, and how far the fit is off.

    ``keep`` passes columns on, the text too if it is named; one whose name is that of an added column gives way to it.
    ``target_miss`` is the same in every row: the largest difference between a domain's expected and target tokens, as a
    share of all tokens.  With ``mix.leave_out`` documents whose posterior of a domain reaches the given value go before
    the rates are fitted.
    """
    mix = mix or Mix()
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit_classifier(base, labels, mix)
    added = ["doc_id", "n_tokens", *(f"p_{d}" for d in DOMAINS), "rate", "expected_tokens", "target_miss"]
    keep = tuple(c for c in keep if c not in added)
    kept = F.struct(*(F.col(c).alias(f"c{k}") for k, c in enumerate(keep))) if keep else F.lit(None)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), kept.alias("_kept"), F.col("text").cast("string").alias("text"))
    scored = with_posterior(with_features(named), model)
    # left out after the table is written: a filter on what is computed would be moved below it and compute it again
    members = written(scored, "members")
    for domain, most in mix.leave_out.items():
        members = members.where(F.col("p")[DOMAINS.index(domain)] < most)
    steps, target, got = fit_rates(members, mix)
    miss = max(abs(a - b) for a, b in zip(got, target, strict=True)) / max(1.0, sum(target))
    out = members.withColumn("rate", F.round(rate(F.col("p"), steps), 6))
    return out.select(
        "doc_id",
        *(F.col(f"_kept.c{k}").alias(c) for k, c in enumerate(keep)),
        "n_tokens",
        *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)),
        "rate",
        (F.col("rate") * F.col("n_tokens")).alias("expected_tokens"),
        F.lit(round(miss, 6)).alias("target_miss"),
    )
