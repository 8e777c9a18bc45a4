"""Line dedup by a log-template tree.

A line goes down a tree of fixed depth: first by its number of tokens, then by its leading tokens. A
token that holds a digit is a variable field and becomes ``<*>`` on the way. In the leaf, templates
leave further fields open: of a line of 5 to 11 tokens one token behind the leading ones, of a longer
line two of the four segments behind them (the halves, and every second one), of a shorter line nothing. So lines that agree in the rest share
a template whatever their fields hold. Every template of a line is made from the line alone, hence a
template's documents can be counted anywhere and in any order.

A template that recurs in at least ``min_docs`` documents (``min_docs_long`` for lines of ``LONG`` tokens or
more) is boilerplate, and every line that has one is dropped, whatever share of its document that is.
Copies of a document aren't other documents: equal texts count once, and with ``copies_once`` so do near
copies, which op9 tells among the texts of which at least ``copy_share`` of the tokens recur. Whole copies thus keep
their lines, for document dedup to leave one of them.

Each text is parsed once; only hashes are exchanged. Templates are counted first, and only those that
occur twice are met again by line. Texts are joined with the numbers of their lines that go.

Limits of the method: lines are told apart by 64-bit hashes; fields among the two leading tokens are only seen
if they hold a digit; a field of several tokens changes a line's length and so its leaf.

Defined results: null text has no line and stays null; an empty text has one empty line; lines without a
letter (separators, numbers alone) have no template and stay; repeated rows and ties are treated alike, each
row losing the same lines; texts of any length are read whole; an empty table gives an empty result; further
columns, also with clashing names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, light, pick, saved, slices
from .op9_jaccard import jaccard_components

DIGIT = regex.compile(r"\p{N}").search
LETTER = regex.compile(r"\p{L}").search
FIELD = "<*>"
#: Leading tokens of a leaf, and the tokens from which on a line has open tokens, and open segments.
DEPTH, SHORT, MIDDLE, SEGMENTS = 2, 5, 12, 4
#: Pairs of segments that a long line keeps: whatever segment has fields, and of most pairs of segments both, are open in one.
KEPT = ((0, 1), (2, 3), (0, 2), (1, 3))
#: Lines of so many tokens recur from two documents on.
LONG = 50
#: Templates up to which a list of them is broadcast.
BROADCAST_ROWS = 5_000
WRAP = (1 << 64) - 1
digest = xxhash.xxh3_64_intdigest


def templates(line: str) -> tuple[list[int], int]:
    """Hashes of the templates of a line (odd ones of long lines), and its number of tokens."""
    tokens = line.split()
    n = len(tokens)
    if DIGIT(line):
        tokens = [FIELD if DIGIT(t) else t for t in tokens]
        if not LETTER(" ".join(tokens)):
            return [], n
    elif not LETTER(line):
        return [], n
    if n < SHORT:
        made = [digest(f"{n} {' '.join(tokens)}")]
    else:
        leaf, rest = digest(f"{n} {tokens[0]} {tokens[1]}"), tokens[DEPTH:]
        if n < MIDDLE:
            own = [digest(f"{i} {t}") for i, t in enumerate(rest)]
            total = sum(own, leaf)
            made = [digest(((total - h) & WRAP).to_bytes(9, "little") + bytes([i])) for i, h in enumerate(own)]
        else:
            cuts = [len(rest) * i // SEGMENTS for i in range(SEGMENTS + 1)]
            own = [digest(f"{i} {' '.join(rest[a:b])}") for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            made = [digest(((leaf + own[a] + own[b]) & WRAP).to_bytes(9, "little") + bytes([a, b])) for a, b in KEPT]
    odd = n >= LONG
    return [((h >> 1 << 1 | odd) - (1 << 63)) for h in made], n


def line_templates(texts: DataFrame) -> DataFrame:
    """(template, text_key, line, n, total): each template of each line; n: the line's tokens, total: the text's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            at, made, lines, sizes, totals = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                if not (text := text.as_py()):
                    continue
                first, total = len(made), 0
                for k, line in enumerate(text.split("\n")):
                    own, n = templates(line)
                    total += n
                    made += own
                    lines += [k] * len(own)
                    sizes += [n] * len(own)
                at += [i] * (len(made) - first)
                totals += [total] * (len(made) - first)
            small = [pa.array(np.array(x, np.int32)) for x in (lines, sizes, totals)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(made, np.int64)), batch.column(0).take(pa.array(at, pa.int64())), *small], ["template", "text_key", "line", "n", "total"])

    return texts.mapInArrow(run, "template bigint, text_key bigint, line int, n int, total int")


def recurring(hits: DataFrame, origin: str, min_docs: int, min_docs_long: int) -> DataFrame:
    """(template): those of enough different origins."""
    counted = hits.select("template", origin).distinct().groupBy("template").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= F.when(F.col("template").bitwiseAND(F.lit(1)) == 1, min_docs_long).otherwise(min_docs)).select("template")


def boilerplate(keyed: DataFrame, min_docs: int, min_docs_long: int, copies_once: bool, copy_share: float) -> DataFrame:
    """(text_key, drop): the numbers of the lines that go, from 0. keyed: text_key and text."""
    with Scratch() as kept:
        parsed = kept(line_templates(keyed.select("text_key", "text")))
        often = saved(parsed.groupBy("template").agg(F.count("*").alias("n")).where("n > 1").select("template"), "often")
        hits = saved(parsed.join(light(often, BROADCAST_ROWS), "template", "left_semi"), "hits")
    found = saved(recurring(hits, "text_key", min_docs, min_docs_long), "recurring")
    hits = saved(hits.join(light(found, BROADCAST_ROWS), "template", "left_semi"), "recurring-lines")
    if copies_once:
        shares = hits.dropDuplicates(["text_key", "line"]).groupBy("text_key").agg((F.sum("n") / F.max("total")).alias("share"))
        alike = saved(shares.where(F.col("share") >= copy_share).select("text_key"), "alike")
        compared = keyed.join(light(alike, BROADCAST_ROWS), "text_key", "left_semi").select(F.col("text_key").alias("doc_id"), "text").dropDuplicates(["doc_id"])
        groups = saved(jaccard_components(saved(compared, "compared")).where("`group` IS NOT NULL").select("text_key", "group").distinct(), "copies")
        hits = hits.join(light(groups, BROADCAST_ROWS), "text_key", "left").withColumn("origin", F.coalesce("group", "text_key"))
        found = saved(recurring(hits, "origin", min_docs, min_docs_long), "recurring-once")
        hits = hits.join(light(found, BROADCAST_ROWS), "template", "left_semi")
    return saved(hits.groupBy("text_key").agg(F.sort_array(F.collect_set("line")).alias("drop")), "drops")


def without_boilerplate(docs: DataFrame, min_docs: int = 3, min_docs_long: int = 2, keep: tuple[str, ...] = ("doc_id",), copies_once: bool = True, copy_share: float = 0.5) -> DataFrame:
    """Per row: the columns in ``keep``, the text without boilerplate lines, n_lines, n_dropped, dropped.

    dropped: the numbers of the lines that went, from 0, comma-joined.
    """
    kept = [c for c in dict.fromkeys(["doc_id", *keep]) if c != "text"]
    keyed = pick(docs, *kept, "text").withColumn("text_key", F.xxhash64("text"))
    drops = boilerplate(keyed, min_docs, min_docs_long, copies_once, copy_share)
    # dealt out by text at every size: the list grows with the documents
    met = keyed.join(drops.hint("merge"), "text_key", "left")
    gone = F.col("drop").isNotNull()
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("drop", i))
    return met.select(
        *kept, F.when(gone, F.array_join(left, "\n")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("n_lines"),
        F.when(gone, F.size("drop")).otherwise(0).cast("bigint").alias("n_dropped"), F.when(gone, F.array_join(F.col("drop").cast("array<string>"), ",")).otherwise("").alias("dropped"),
    )
