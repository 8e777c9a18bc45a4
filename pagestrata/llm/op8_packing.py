"""Hierarchical multi-length packing.

Documents become token ids with an end id. Whole windows are cut off long documents; what remains of
each goes to the smallest tier (a context size) that holds it. Each tier is packed, longest first: a window starts with the
longest remainder of its tier, and its gap is filled from the shorter tiers by remainders that fill it exactly
(one or two of them) or else the longest that fits. At most ``FILLING`` of the tokens of a shorter tier go to
longer windows that way, so the shorter tiers have windows of their own. Where nothing fits, a remainder is cut.
Documents are packed a block at a time, and the one window still open goes on into the next block, so at
most one window of a partition is padded.

Sequences of a tier form step groups of equal padded length, ``STEP_TOKENS``: 64 of the shortest tier weigh as much as 8 of
one eight times as long. Groups are numbered over the whole table: each partition's sequences are counted by tier, and from
the running sums each sequence has its rank; a tier's sequences are dealt out evenly, so its groups differ by one
sequence at most.

Packing needs no exchange: each partition of the input makes its own sequences, which are written before
they are grouped.

Defined results: null text counts as empty, which is its end id alone; repeated rows are packed each; of documents of
equal length the earlier one is taken first; an empty table gives an empty result; further columns, also with
clashing names, are ignored. A document's length isn't limited.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import light, pick, saved, texts_of
from .op5_tokens import byte_symbols

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier bigint, nth bigint, part int"
TIERS = (256, 512, 1024, 2048)
#: Tokens of a step group, and the share of a tier's tokens that may fill longer windows.
STEP_TOKENS, FILLING = 16_384, 0.5
#: Characters of text after which a block of documents is packed.
BLOCK_CHARS = 2_000_000
#: Partitions and tiers up to which their running sums are broadcast.
BROADCAST_ROWS = 1_000_000
#: Where a byte-level vocabulary of this kind may not merge.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Texts that tell vocabularies apart which split or normalise otherwise.
PROBES = ("I'll don't WE'RE it's", "a  b\t\tc \n\n d  ", "x1 22 333,4444 5½Ⅷ", "Été ſ ﬁ Å ΣΑΣ İı", "日本語 中文 한국어", "😀👍🏽 ß--!!__", "<|endoftext|> <|end", "\u00a0\u2003\u200b\x85\x1c", "", " ", "aaaa" * 9)


class Encoder:
    """Ids by a vocabulary in the JSON format of the library tokenizers.

    Where it is a byte-level vocabulary whose ids rise with the ranks of its merges, merging is left to tiktoken, which is
    several times as fast, provided that both give the same ids for ``PROBES``; else the library itself encodes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.codec = None
        self.codec = self.fast(path)
        if self.codec and any(self.encode(t).tolist() != self.slow(t) for t in PROBES):
            self.codec = None

    @staticmethod
    def fast(path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocab, merges, cut = told["model"].get("vocab"), told["model"].get("merges"), told["pre_tokenizer"] or {}
        if not isinstance(vocab, dict) or not merges or told["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space"):
            return None
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        byte = {c: b for b, c in enumerate(byte_symbols())}
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        ranks = {bytes(byte.get(c, 0) for c in token): i for token, i in vocab.items() if token not in special}
        if any(a >= b for a, b in zip(made, made[1:])) or len(ranks) < len(vocab.keys() - special.keys()):
            return None
        return tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def slow(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> np.ndarray:
        return self.codec.encode_to_numpy(text, allowed_special="all") if self.codec else np.array(self.slow(text), np.uint32)


class Packer:
    """Deals documents of one partition out to sequences."""

    def __init__(self, first_id: int, tiers: tuple[int, ...], filling: float = FILLING):
        self.tiers, self.top, self.filling = tiers, tiers[-1], filling
        self.next_id = first_id
        self.made = dict.fromkeys(tiers, 0)  # sequences of each tier
        self.size, self.room, self.held = 0, 0, []  # the open window
        self.queues: dict[int, list[tuple]] = {t: [] for t in tiers}  # (length, -serial, document, ids, from, to), rising
        self.quota = dict.fromkeys(tiers, 0.0)
        self.serial = 0

    def close(self, tier: int, pieces: list[tuple]) -> list[tuple]:
        """Rows of a finished sequence."""
        sequence, self.next_id = self.next_id, self.next_id + 1
        nth = self.made[tier]
        self.made[tier] += 1
        rows, at = [], 0
        for piece in pieces:
            rows.append((*piece, sequence, at, tier, nth))
            at += piece[2]
        return rows

    def queue(self, doc: int, ids: np.ndarray, a: int, b: int) -> None:
        self.serial += 1
        insort(self.queues[self.tier(b - a)], (b - a, -self.serial, doc, ids, a, b), key=lambda x: x[:2])

    def take(self, tier: int, at: int, most: int) -> None:
        """Puts the first ``most`` tokens of a queued remainder into the open window; the others are queued again."""
        n, _, doc, ids, a, b = self.queues[tier].pop(at)
        used = min(n, most)
        self.held.append(self.piece(doc, ids, a, a + used))
        self.room -= used
        if used < n:
            self.queue(doc, ids, a + used, b)

    def longest(self, tier: int, most: int) -> int:
        """The place of the longest remainder of a tier that has at most so many tokens; -1 if none has."""
        return bisect_right(self.queues[tier], most, key=lambda x: x[0]) - 1

    def filling_of(self, room: int) -> list[int]:
        """Lengths of the remainders of shorter tiers to fill a gap with: one or two that fill it, else the longest that fits."""
        open_ = [t for t in self.tiers if t < self.size and self.quota[t] > 0]
        lengths = {x[0] for t in open_ for x in self.queues[t][: self.longest(t, room) + 1]}
        if not lengths or room in lengths:
            return [room] if lengths else []
        pair = next((n for n in sorted(lengths, reverse=True) if room - n in lengths and 2 * n > room), None)
        return [pair, room - pair] if pair else [max(lengths)]

    def fill(self) -> bool:
        """Fills the open window; False if there is nothing left to fill it with."""
        while self.room:
            own = self.longest(self.size, self.room)
            lengths = self.filling_of(self.room)
            if own >= 0 and (not lengths or self.queues[self.size][own][0] >= max(lengths)):
                self.take(self.size, own, self.room)
            elif lengths:
                for n in lengths:
                    tier = self.tier(n)
                    self.quota[tier] -= n
                    self.take(tier, self.longest(tier, n), n)
            else:  # cut: the shortest remainder of the tier, else the longest that there is
                tier = next((t for t in (self.size, *reversed(self.tiers)) if self.queues[t]), None)
                if tier is None:
                    return False
                self.take(tier, 0 if tier == self.size else len(self.queues[tier]) - 1, self.room)
        return True

    def pack(self, documents: list[tuple[int, np.ndarray]]) -> list[tuple]:
        """documents: (id, token ids). Returns rows of the sequences that are full."""
        rows: list[tuple] = []
        for doc, ids in documents:
            n = len(ids)
            whole = n - n % self.top
            for a in range(0, whole, self.top):
                rows += self.close(self.top, [self.piece(doc, ids, a, a + self.top)])
            if n > whole:
                self.queue(doc, ids, whole, n)
        self.quota = {t: self.filling * sum(x[0] for x in q) for t, q in self.queues.items()}
        while True:
            if not self.room:
                self.size = next((t for t in reversed(self.tiers) if self.queues[t]), 0)
                if not self.size:
                    return rows
                self.room, self.held = self.size, []
                self.take(self.size, len(self.queues[self.size]) - 1, self.room)
            if not self.fill():
                return rows
            rows += self.close(self.size, self.held)
            self.held = []

    def rest(self) -> list[tuple]:
        """Rows of the window still open at the end; it is the only one to be padded."""
        return self.close(self.top, self.held) if self.held else []

    def tier(self, n: int) -> int:
        return next(t for t in self.tiers if n <= t)

    @staticmethod
    def piece(doc: int, ids: np.ndarray, a: int, b: int) -> tuple:
        return doc, a, b - a, zlib.crc32(ids[a:b].astype("<u4", copy=False).tobytes()), len(ids)


def with_step_groups(pieces: DataFrame, tiers: tuple[int, ...], step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Numbers the step groups over all partitions and evens them out."""
    made = pieces.groupBy("part", "tier").agg((F.max("nth") + 1).alias("own"))
    order = W.partitionBy("tier").orderBy("part")
    each = F.greatest(F.lit(1), F.floor(F.lit(step_tokens) / F.col("tier")))
    sums = saved(made.select("part", "tier", (F.sum("own").over(order) - F.col("own")).alias("before"), F.sum("own").over(W.partitionBy("tier")).alias("total")).withColumn("groups", F.ceil(F.col("total") / each).cast("bigint")), "step-sums")
    first = sums.select("tier", "groups").distinct().select(F.col("tier").alias("lower"), F.col("groups").alias("lower_groups"))
    base = sums.select("tier").distinct().join(F.broadcast(first), F.col("lower") < F.col("tier"), "left").groupBy("tier").agg(F.coalesce(F.sum("lower_groups"), F.lit(0)).alias("base"))
    known = sums.join(F.broadcast(base), "tier")  # a row for each tier
    rank = F.col("before") + F.col("nth")
    return pieces.join(light(known, BROADCAST_ROWS), ["part", "tier"]).withColumn("step_group", (F.col("base") + F.floor(rank * F.col("groups") / F.col("total"))).cast("bigint"))


def packed(docs: DataFrame, vocabulary: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Per piece of a document: where it starts there, its length and digest, its sequence and offset, tier and step group.

    vocabulary: the path of a tokenizers JSON file that every executor can open. tiers: rising powers of two.
    Sequence ids of a partition follow each other; those of the partitions don't overlap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        part = TaskContext.get().partitionId()
        packer = Packer(part << 40, tiers)
        kinds = [pa.int64()] * 9 + [pa.int32()]
        names = [c.split()[0] for c in PIECES.split(", ")]

        def told(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 9
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, [part] * len(rows)], kinds)], names)

        def tokenized(block: list[tuple]) -> list[tuple]:
            return [(doc, np.append(encoder.encode(text), np.uint32(end_id))) for doc, text in block]

        block: list[tuple] = []
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                block.append((doc, text))
                held += len(text)
                if held >= BLOCK_CHARS:
                    yield told(packer.pack(tokenized(block)))
                    block, held = [], 0
        yield told(packer.pack(tokenized(block)))
        yield told(packer.rest())

    made = saved(pick(docs, "doc_id", "text").mapInArrow(run, PIECES), "pieces")
    grouped = with_step_groups(made, tiers)
    return grouped.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")
