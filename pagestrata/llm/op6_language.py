"""Language identification in two levels: the family first, then one-versus-one machines within it.

Features are hashed counts of character 1- to 3-grams of the letters of a whole text, in lower case,
square-rooted and of unit length. Linear support vector machines (squared hinge loss, dual coordinate
descent) separate the families from each other and, within a family, each pair of its languages. The
machines are fitted on at most ``per_language`` labelled rows of each of the ``MOST_LANGUAGES`` most frequent languages, chosen by
a hash of the row, repeated rows once; features are made on the executors, and only those of the chosen rows come to the
driver.

The duels always have a winner, whose score is well above 0 for any text. Whether a text is in a learned
language at all is told by ``far``: by how much the mean log chance of its n-grams, under the shares they
have in its language's rows, is below what is usual there, in deviations that widen for short texts, over
a limit. The limit is at least ``FAR`` and well above what rows have under the shares of other rows; a
language with fewer than ``LEAST_ROWS`` rows has none.

Defined results: a text that is null or has no letter gets ``und`` and score 0; without any labelled
row all do. A row without doc_id is neither held out nor learned from. Of languages that win equally many duels the one
with the larger sum of margins is told, then the first by name. Texts of any length are read whole. Repeated rows are predicted
each; an empty table gives an empty result; further columns, also with clashing names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices

#: Languages by family; one that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}
#: Languages that machines are fitted for, at most; their pairs grow with the square.
MOST_LANGUAGES = 200
UNKNOWN = "und"
SIZE = 4096
LETTERS = regex.compile(r"\p{L}+").findall
#: Margin 1 counts as a chance of 95 %.
STEEPNESS = math.log(19)
#: The least limit of far, the room above the 99th percentile of rows, and the fewest rows that give a limit.
FAR, ROOM, LEAST_ROWS = 7.0, 1.5, 20
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"


def family(lang: str) -> str:
    return next((f for f, own in FAMILIES.items() if lang in own), lang)


def features(text: str | None) -> np.ndarray | None:
    """The text's unit vector, None if it has no letter."""
    words = LETTERS(text or "")
    if not words:
        return None
    u = np.frombuffer(f" {' '.join(words).lower()} ".encode("utf-32-le"), np.uint32).astype(np.uint32)
    one = u * np.uint32(2654435761)
    two = (one[:-1] ^ (u[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
    three = (two[:-1] ^ (u[2:] * np.uint32(668265263))) * np.uint32(374761393)
    seen = np.zeros(SIZE, np.int64)
    for x in (one, two, three):
        seen += np.bincount(x >> np.uint32(20), minlength=SIZE)
    v = np.sqrt(seen)
    return (v / np.linalg.norm(v)).astype(np.float32)


def machine(x: np.ndarray, y: np.ndarray, cost: float = 4.0, rounds: int = 30) -> np.ndarray:
    """Weights, the bias last, of a linear machine that separates y = 1 from y = -1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    weight, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    # rows of the rarer side weigh more
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    ridge = share / cost
    norm = np.einsum("ij,ij->i", x, x) + ridge
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            step = (1 - y[i] * (x[i] @ weight) - ridge[i] * alpha[i]) / norm[i]
            new = max(0.0, alpha[i] + step)
            if new != alpha[i]:
                weight += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return weight


def usual(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Of rows: the log of each feature's smoothed share, and the mean and variance of that for an n-gram."""
    p = (x.astype(np.float64) ** 2).mean(axis=0)
    p = 0.999 * p / p.sum() + 0.001 / len(p)
    log = np.log(p)
    mean = float(p @ log)
    return log, mean, float(p @ log**2) - mean * mean


def deviations(v: np.ndarray, log: np.ndarray, mean: float, variance: float) -> float:
    """By how many deviations a text's n-grams are less likely than usual."""
    share = v.astype(np.float64) ** 2
    # the rarest n-gram of a text mostly occurs once; n-grams overlap, and documents differ from each other
    n = share.sum() / share[share > 0].min()
    return (mean - float(share @ log)) / math.sqrt(3 * variance / n + 0.02)


@dataclass
class Model:
    """Pairs of classes with their machines; of each level, the classes in order; what is usual in a language, and its limit."""

    families: dict[str, list[str]] = field(default_factory=dict)
    machines: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    limits: dict[str, tuple[tuple[np.ndarray, float, float], float]] = field(default_factory=dict)

    @classmethod
    def fit(cls, langs: list[str], x: np.ndarray) -> Model:
        model = cls()
        for lang in sorted(set(langs)):
            model.families.setdefault(family(lang), []).append(lang)
        own, of = np.array(langs), np.array([family(lang) for lang in langs])
        for names, column in [(sorted(model.families), of), *((v, own) for v in model.families.values())]:
            for a, b in combinations(names, 2):
                rows = (column == a) | (column == b)
                model.machines[a, b] = machine(x[rows], np.where(column[rows] == a, 1.0, -1.0))
        for lang in sorted(set(langs)):
            rows = x[own == lang]
            if len(rows) >= LEAST_ROWS:
                seen = [deviations(v, *usual(rows[1 - k :: 2])) for k in (0, 1) for v in rows[k::2]]
                model.limits[lang] = usual(rows), max(FAR, ROOM * float(np.quantile(seen, 0.99)))
        return model

    def best(self, names: list[str], v: np.ndarray) -> tuple[str, float]:
        """The class that wins most duels (then the larger sum of margins), and its least chance in one."""
        if len(names) == 1:
            return names[0], 1.0
        won, total, least = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
        for a, b in combinations(names, 2):
            w = self.machines[a, b]
            margin = float(v @ w[:-1] + w[-1])
            won[a if margin >= 0 else b] += 1
            for name, m in ((a, margin), (b, -margin)):
                total[name] += m
                least[name] = min(least[name], 1 / (1 + math.exp(-STEEPNESS * max(-50.0, min(50.0, m)))))
        top = max(names, key=lambda n: (won[n], total[n]))
        return top, least[top]

    def predict(self, text: str | None) -> tuple[str, float]:
        v = features(text)
        if v is None or not self.families:
            return UNKNOWN, 0.0
        kin, p = self.best(sorted(self.families), v)
        lang, q = self.best(self.families[kin], v)
        return lang, p * q

    def far(self, text: str | None, lang: str) -> float:
        """How far the text is from the language, over the limit; 0 where there is no limit."""
        v = features(text)
        if v is None or lang not in self.limits:
            return 0.0
        known, limit = self.limits[lang]
        return max(0.0, deviations(v, *known) / limit)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learned(docs: DataFrame, per_language: int = 300) -> Model:
    """Machines fitted on at most ``per_language`` rows of each language that are not held out."""
    rows = pick(docs, "doc_id", "text", "lang").where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    if not counts:
        return Model()
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.3 * per_language / n))))
    chance = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(d, lang, v.tobytes()) for d, lang, text in zip(*(c.to_pylist() for c in batch.columns)) if (v := features(text)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*kept)) or [()] * 3, (pa.int64(), pa.string(), pa.binary()))], ["doc_id", "lang", "v"])

    # rows that repeat each other have one hash, so they would all be chosen; they come to the driver once
    picked = rows.where(chance < F.try_element_at(share, F.col("lang"))).groupBy("doc_id", "lang", F.xxhash64("text").alias("text_key")).agg(F.first("text").alias("text"))
    chosen = picked.select("doc_id", "lang", "text").mapInArrow(run, "doc_id bigint, lang string, v binary").collect()
    by: dict[str, list] = {}
    for r in sorted(chosen, key=lambda r: (r["lang"], r["doc_id"], bytes(r["v"]))):
        by.setdefault(r["lang"], []).append(r)
    kept = [r for own in by.values() for r in (own if len(own) <= per_language else [own[i * len(own) // per_language] for i in range(per_language)])]
    if not kept:
        return Model()
    return Model.fit([r["lang"] for r in kept], np.stack([np.frombuffer(r["v"], np.float32) for r in kept]))


def languages(docs: DataFrame, per_language: int = 300, keep: tuple[str, ...] = (), model: Model | None = None, far: bool = False) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, and the columns in ``keep`` as they are.

    model: machines to use; without one they are learned from docs. far: adds the column far, above 1
    for a text that isn't in the language told.
    """
    model = model or learned(docs, per_language)
    names = list(dict.fromkeys(["doc_id", "text", *keep]))
    rows = pick(docs, *names).withColumn("held_out", held_out())
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in ("doc_id", *keep) or f.name == "held_out")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            told = [model.predict(text.as_py()) for text in batch.column(1)]
            columns = {n: batch.column(i) for i, n in enumerate([*names, "held_out"]) if n != "text" or n in keep}
            columns |= {"lang_pred": pa.array([x for x, _ in told], pa.string()), "score": pa.array([x for _, x in told], pa.float64())}
            if far:
                columns["far"] = pa.array([model.far(text.as_py(), lang) for text, (lang, _) in zip(batch.column(1), told)], pa.float64())
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, f"{out}, lang_pred string, score double{', far double' if far else ''}")
