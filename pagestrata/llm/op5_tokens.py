"""Token counts by rank-synchronous merging of pre-token arrays.

A text is cut into pre-tokens. The distinct pre-tokens of a block of texts are held as one ragged
numpy array of symbols (flat symbols plus the sequence of each). In each round every sequence finds
its lowest-ranked adjacent pair, and all of them merge that pair at the same time; sequences without
a known pair leave the array. A count is what survives. Counts of seen pre-tokens are kept in a
table of bounded size, so that common ones are merged once per worker.

A pre-token of more than ``LONG`` bytes is merged in an array of its own: its places are kept by the rank of the pair
that starts there, and a round touches the places of its lowest rank and their neighbours only, not the whole sequence.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows are counted each; of equal pairs the
left one is merged first; texts and words of any length are counted whole; an empty table gives an empty result;
further columns, also with clashing names, are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import pick, texts_of

#: Unicode White_Space, written out so that it doesn't depend on the regular expression library.
SPACE = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
#: Pre-tokens of which a worker remembers the counts.
REMEMBERED = 400_000
#: Bytes from which on a pre-token is merged by itself.
LONG = 1000
#: Characters of text after which a block of pre-tokens is merged.
BLOCK_CHARS = 2_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    named = dict(zip(plain, map(chr, plain))) | {b: chr(256 + i) for i, b in enumerate(other)}
    return [named[b] for b in range(256)]


class RankMerger:
    """Merges many pre-tokens at once by a vocabulary's ranks."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        chars = byte_symbols()
        self.inner = np.array([vocab.get(c, -1) for c in chars], np.int64)
        self.final = np.array([vocab.get(c + suffix, -1) for c in chars], np.int64)
        self.width = max(vocab.values()) + 2
        keys, ranks, made = [], [], []
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            if left in vocab and right in vocab and left + right in vocab:
                keys.append(vocab[left] * self.width + vocab[right])
                ranks.append(rank)
                made.append(vocab[left + right])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.never = len(merges)
        self.ranks = np.append(np.array(ranks, np.int64)[order], self.never)
        self.made = np.append(np.array(made, np.int64)[order], -1)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair of symbols and where it is known; ``never`` if it isn't."""
        pair = left * self.width + right
        at = np.searchsorted(self.keys, pair)
        return np.where(self.keys[at] == pair, self.ranks[at], self.never), at

    def long_count(self, word: bytes) -> int:
        """How many symbols a long word keeps: rounds by rising rank over a linked sequence."""
        data = np.frombuffer(word, np.uint8)
        sym = self.inner[data]
        sym[-1] = self.final[data[-1]]
        sym = sym[sym >= 0]
        n = len(sym)
        following, before = np.arange(1, n + 2), np.arange(-1, n)  # place n is the end, and -1 stands for it on the left
        sym = np.append(sym, -1)
        now = np.full(n + 1, self.never)  # the rank of the pair that starts at each place
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def file(at: np.ndarray, rank: np.ndarray) -> None:
            now[at] = rank
            known = rank < self.never
            at, rank = at[known], rank[known]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            edges = np.flatnonzero(rank[1:] != rank[:-1]) + 1 if len(rank) else []
            for part in np.split(at, edges) if len(rank) else ():
                r = int(now[part[0]])
                if r not in places:
                    places[r] = []
                    heapq.heappush(ranks, r)
                places[r].append(part)

        if n > 1:
            file(np.arange(n - 1), self.rank_of(sym[: n - 1], sym[1:n])[0])
        left = n
        while ranks:
            rank = heapq.heappop(ranks)
            at = np.unique(np.concatenate(places.pop(rank)))
            at = at[now[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:  # of pairs that overlap, every second one from the left
                head = np.append(True, following[at[:-1]] != at[1:])
                run = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            gone = following[at]
            _, key = self.rank_of(sym[at], sym[gone])
            sym[at] = self.made[key]
            now[gone] = self.never
            following[at] = after = following[gone]
            before[after] = at
            left -= len(at)
            own = at[after < n]
            now[at] = self.never
            near = before[at]
            near = near[near >= 0]
            touched = np.unique(np.concatenate([own, near]))
            file(touched, self.rank_of(sym[touched], sym[following[touched]])[0])
        return left

    def counts(self, words: list[bytes]) -> np.ndarray:
        """How many symbols each word keeps."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if long:
            rest = self.counts([b"" if len(w) > LONG else w for w in words])
            rest[long] = [self.long_count(words[i]) for i in long]
            return rest
        out = np.zeros(len(words), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        if not sizes.sum():
            return out
        data = np.frombuffer(b"".join(words), np.uint8)
        seq = np.repeat(np.arange(len(words)), sizes)
        last = np.append(seq[1:] != seq[:-1], True)
        sym = np.where(last, self.final[data], self.inner[data])
        if (sym < 0).any():  # a byte without a symbol gives no token, as without an unknown token
            sym, seq = sym[sym >= 0], seq[sym >= 0]
        while len(sym):
            inside = seq[1:] == seq[:-1]
            pair = sym[:-1] * self.width + sym[1:]
            at = np.searchsorted(self.keys, pair)
            rank = np.where(inside & (self.keys[at] == pair), self.ranks[at], self.never)
            rank = np.append(rank, self.never)
            starts = np.flatnonzero(np.append(True, ~inside))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            live = best < self.never
            done = starts[~live]
            out[seq[done]] += sizes[~live]
            chosen = (rank == np.repeat(best, sizes)) & (rank < self.never)
            where = np.flatnonzero(chosen)
            if len(where):
                # of pairs that overlap, as in "aaa", every second one from the left
                head = np.append(True, np.diff(where) > 1)
                run = np.maximum.accumulate(np.where(head, np.arange(len(where)), 0))
                where = where[(np.arange(len(where)) - run) % 2 == 0]
                sym = sym.copy()
                sym[where] = self.made[np.searchsorted(self.keys, sym[where] * self.width + sym[where + 1])]
            keep = np.repeat(live, sizes)
            keep[where + 1] = False
            sym, seq = sym[keep], seq[keep]
        return out


class TokenCounter:
    """Counts of a vocabulary in the JSON format of the library tokenizers, with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        self.merger = RankMerger(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        special = [t["content"] for t in told["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.split = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+").findall
        self.known: dict[str, int] = {}

    @staticmethod
    def lower(text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # a final capital sigma is lowered without regard to its place
        return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and how many special strings it holds."""
        if self.special is None or "<|" not in text:
            return self.split(self.lower(text)), 0
        words: list[str] = []
        parts = self.special.split(text)
        for part in parts:
            words += self.split(self.lower(part))
        return words, len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.pretokens(t) for t in texts]
        new = list(set().union(*(w for w, _ in cut)).difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(set().union(*(w for w, _ in cut)))
        self.known.update(zip(new, self.merger.counts([w.encode() for w in new]).tolist()))
        got = self.known.__getitem__
        return [sum(map(got, words)) + n for words, n in cut]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens and whether that is over ``limit``.

    vocabulary: the path of a tokenizers JSON file that every executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(vocabulary)
        for batch in batches:
            sizes: list[int] = []
            tokens: list[int] = []
            block: list[str] = []
            held = 0
            for text in texts_of(batch.column(1)):
                sizes.append(len(text.encode()))
                block.append(text)
                held += len(text)
                if held >= BLOCK_CHARS:
                    tokens += counter.count(block)
                    block, held = [], 0
            tokens += counter.count(block)
            n = pa.array(tokens, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), n, pa.array([t > limit for t in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return pick(docs, "doc_id", "text").mapInArrow(run, SCHEMA)
