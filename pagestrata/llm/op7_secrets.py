"""Secret scans: fixed patterns, and a battery of randomness tests on what else looks encoded.

Every text gets the spans of three base patterns. Besides, each token of 12 characters or more whose characters suggest
an encoding (hexadecimal, base 32, base 36, base 64) goes through three tests of uniform randomness over
that encoding's alphabet: chi-squared uniformity, runs about the alphabet's middle, and serial
correlation at lag one. A token that fails one of them isn't random. One that passes gets a p-value: the chance
that ordinary text of its length spreads as evenly over the alphabet (its chi-squared statistic
grows with the length, so longer tokens reach smaller values) and changes as often between capitals, small letters and digits,
both by Fisher's method. Candidates of the whole table are sorted into strata by encoding and length, and in each stratum
the Benjamini-Hochberg rule keeps the share of false discoveries below ``fdr``. Its threshold comes from a histogram
of the p-values' logarithms, of bounded size, whose bins count by their upper ends.

Defined results: null text counts as empty; no span gives an empty list and the digest of the empty
string; spans that start together are listed in the order of KINDS; repeated rows are scanned each, and count each; texts of any
length are scanned whole; an empty table gives an empty result; further columns, also with clashing names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, saved, slices, texts_of

KINDS = ("assign", "access", "hex", "random")
#: Letters in either case are spelled out: case-insensitive matching would add non-ASCII letters.
WORDS = "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token"))
ASSIGN = re.compile(rf"""(?:{WORDS}|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: The longest runs are matched anyway, so the least lengths can stand in the patterns.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
#: Name, pattern, alphabet in order, and by how much ordinary text exceeds uniform (alphabet size x sum of squared shares - 1).
ENCODINGS = (
    ("hex", re.compile(r"(?=.*[0-9])(?=.*[a-f])[0-9a-f]+"), "0123456789abcdef", 1.0),
    ("HEX", re.compile(r"(?=.*[0-9])(?=.*[A-F])[0-9A-F]+"), "0123456789ABCDEF", 1.0),
    ("base32", re.compile(r"(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.5),
    ("BASE36", re.compile(r"(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+"), "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1.5),
    ("base36", re.compile(r"(?=.*[0-9])(?=.*[a-z])[a-z0-9]+"), "0123456789abcdefghijklmnopqrstuvwxyz", 1.5),
    ("base64", re.compile(r"(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/_-]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 2.5),
)
PLACES = [{c: i for i, c in enumerate(alphabet)} for _, _, alphabet, _ in ENCODINGS]
#: Lengths from which on a class of lengths begins, and the share of neighbours of unlike kind in ordinary text.
LENGTHS, CHANGES = (12, 16, 20, 32, 48, 64), 0.2
#: Bins of the histogram: an eighth of a power of two each, down to 2^-64.
BINS, EIGHTH = 512, 8
PASS = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, base array<struct<start: int, kind: int, end: int>>, found array<struct<start: int, end: int, stratum: int, bin: int>>"


def normal(z: float) -> float:
    """The share of a standard normal distribution below z."""
    return 0.5 * math.erfc(-z / math.sqrt(2))


def battery(values: list[int], size: int) -> tuple[float, float, float, float]:
    """The chi-squared statistic, and the p-values of uniformity, runs and serial correlation."""
    n = len(values)
    seen = [0] * size
    for v in values:
        seen[v] += 1
    chi2 = sum(c * c for c in seen) * size / n - n
    free = size - 1
    # the cube root of chi-squared is nearly normal
    uniform = 1 - normal(((chi2 / free) ** (1 / 3) - 1 + 2 / (9 * free)) / math.sqrt(2 / (9 * free)))
    high = [v >= size / 2 for v in values]
    n1 = sum(high)
    n0 = n - n1
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    if n0 and n1 and n > 2:
        mean = 1 + 2 * n0 * n1 / n
        spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-12))
        run_p = 2 * normal(-abs(runs - mean) / spread)
    else:
        run_p = 0.0
    middle = sum(values) / n
    around = [v - middle for v in values]
    total = sum(x * x for x in around)
    r = sum(a * b for a, b in zip(around, around[1:])) / total if total else 1.0
    return chi2, uniform, run_p, 2 * normal(-abs(r + 1 / n) * math.sqrt(n))


def text_p(chi2: float, n: int, size: int, excess: float) -> float:
    """How likely ordinary text of n characters has a chi-squared statistic as low as this."""
    mean = size - 1 + (n - 1) * excess
    return normal((chi2 - mean) / math.sqrt(2 * (size - 1) + 4 * n * excess))


def kind_of(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def change_p(body: str) -> float:
    """How likely ordinary text changes as often between digits, capitals and small letters."""
    kinds = [kind_of(c) for c in body]
    n, changed = len(body) - 1, sum(a != b for a, b in zip(kinds, kinds[1:]))
    return min(1.0, sum(math.comb(n, k) * CHANGES**k * (1 - CHANGES) ** (n - k) for k in range(changed, n + 1))) if n < 500 else 1 - normal((changed - 0.5 - n * CHANGES) / math.sqrt(n * CHANGES * (1 - CHANGES)))


def fisher(a: float, b: float) -> float:
    """Two independent p-values as one."""
    product = max(a * b, 1e-300)
    return min(1.0, product * (1 - math.log(product)))


def candidates(text: str, taken: list[tuple[int, int]], alpha: float) -> list[tuple[int, int, int, float]]:
    """(start, end, stratum, p) of tokens in an encoding outside the spans already taken, which are sorted by start."""
    starts, ends, last = [a for a, _ in taken], [], 0
    for _, b in taken:
        last = max(last, b)
        ends.append(last)
    found = []
    for m in CANDIDATE.finditer(text):
        body = m[0].rstrip("=")
        if body.isalpha():
            continue
        at = bisect_right(starts, m.end() - 1)
        if at and ends[at - 1] > m.start():
            continue
        for k, (_, pattern, alphabet, excess) in enumerate(ENCODINGS):
            if pattern.fullmatch(body):
                plain = body.replace("-", "+").replace("_", "/") if len(alphabet) == 64 else body
                chi2, *ps = battery([PLACES[k][c] for c in plain], len(alphabet))
                # three tests share the level
                p = fisher(text_p(chi2, len(body), len(alphabet), excess), change_p(body)) if min(ps) * 3 >= alpha else 1.0
                found.append((m.start(), m.end(), k * len(LENGTHS) + max(0, bisect_right(LENGTHS, len(body)) - 1), p))
                break
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), sorted."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_VALUE]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return sorted(spans + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def bin_of(p: float) -> int:
    """Bin k holds p-values of at most 2^(-k / 8)."""
    return min(BINS, math.floor(-math.log2(max(p, 1e-300)) * EIGHTH))


def thresholds(counts: list[tuple[int, int, int]], fdr: float) -> list[int]:
    """The least bin of each stratum that counts as found. counts: stratum, bin, candidates."""
    by: dict[int, dict[int, int]] = defaultdict(dict)
    for stratum, k, n in counts:
        by[stratum][k] = n
    out = [BINS + 1] * (len(ENCODINGS) * len(LENGTHS))
    for stratum, bins in by.items():
        total, held = sum(bins.values()), 0
        for k in sorted(bins, reverse=True):
            held += bins[k]
            if 2.0 ** (-k / EIGHTH) <= fdr * held / total:
                out[stratum] = k
    return out


def first_pass(docs: DataFrame, alpha: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "kind", "end")])), pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "end", "stratum", "bin")])))
        for batch in slices(batches, 1000):
            rows = []
            for text in texts_of(batch.column(1)):
                spans = base_spans(text)
                own = [k for _, k, _ in spans]
                found = candidates(text, [(a, b) for a, _, b in spans], alpha)
                digest = hashlib.sha256(listed(spans).encode()).hexdigest()
                rows.append((own.count(0), own.count(1), own.count(2), digest, [{"start": a, "kind": k, "end": b} for a, k, b in spans], [{"start": a, "end": b, "stratum": t, "bin": bin_of(p)} for a, b, t, p in found]))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "found"])

    return docs.mapInArrow(run, PASS)


def secret_spans(docs: DataFrame, alpha: float = 0.01, fdr: float = 0.01) -> DataFrame:
    """Per row: doc_id, counts by base pattern, a digest of the base spans, all spans, and the added ones' count.

    Spans are in code points, ends exclusive. alpha: level of the battery; fdr: share of false discoveries in the table.
    """
    seen = saved(first_pass(pick(docs, "doc_id", "text"), alpha), "candidates")
    counts = seen.select(F.explode("found").alias("x")).groupBy("x.stratum", "x.bin").agg(F.count("*").alias("n"))
    least = F.array(*map(F.lit, thresholds([tuple(r) for r in counts.collect()], fdr)))  # at most 36 strata of 513 bins
    added = F.transform(F.filter("found", lambda x: x["bin"] >= F.get(least, x["stratum"])), lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), x["end"].alias("end")))
    names = F.array(*map(F.lit, KINDS))

    def told(x: Column) -> Column:
        return F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))

    rows = seen.withColumn("added", added)
    spans = F.array_join(F.transform(F.array_sort(F.concat("base", "added")), told), ",")
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), F.size("added").cast("bigint").alias("n_random"))
