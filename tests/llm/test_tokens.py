"""op5 and op8: counts and ids against the library tokenizers, packing by its rules."""

import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagestrata.llm import op5_tokens
from pagestrata.llm.op5_tokens import RankMerger, TokenCounter, token_counts
from pagestrata.llm.op8_packing import STEP_TOKENS, TIERS, Encoder, Packer, packed

from .helpers import LONG, ask, docs

ALPHABET = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "  ", "\n\n", *"aaabc ΣσİI'sDLl12½Ⅷ\t\n\x85\xa0\x1c\x1fé中文😀ß--!!__"]


def odd_texts(n=3000):
    draw = random.Random(3)
    return ["".join(draw.choices(ALPHABET, k=draw.randint(0, 40))) for _ in range(n)] + ["", "a" * 5000, " " * 300]


def test_counts_are_the_librarys():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = odd_texts()
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert TokenCounter(path).count(texts) == want


def test_ids_are_the_librarys():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = odd_texts()
    encoder = Encoder(path)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [encoder.encode(t).tolist() for t in texts] == want


def test_overlapping_pairs_merge_from_the_left():
    merger = RankMerger({"a": 0, "aa": 1, "aaa": 2, "aaaa": 3}, [["a", "a"], ["aa", "a"], ["aa", "aa"]])
    assert merger.counts([b"a" * n for n in range(8)]).tolist() == [0, 1, 1, 1, 1, 2, 2, 2]
    assert [merger.long_count(b"a" * n) for n in range(1, 8)] == [1, 1, 1, 1, 2, 2, 2]


def test_long_words(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    draw = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(draw.choices(letters[:k], k=n)) for n in (2, 3, 30, 400, 1001, 5000) for k in (2, 5, 26)]
    words += ["é" * 700 + "日本語" * 900, "a" * 3001, "ab" * 2500, "".join(draw.choices(["the", "ing", "tion", "anti", "zq"], k=3000))]
    library = Tokenizer.from_file(path)
    want = [len(library.encode(w, add_special_tokens=False).ids) for w in words]
    counter = TokenCounter(path)
    assert counter.count(words) == want
    monkeypatch.setattr(op5_tokens, "LONG", 0)
    assert TokenCounter(path).count(words) == want
    began = time.process_time()
    word = "".join(draw.choices(letters, k=100_000))
    assert counter.count([word]) == [len(library.encode(word, add_special_tokens=False).ids)]
    assert time.process_time() - began < 20


def test_counts_edge_cases(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    table = docs(spark, [None, "", "Hello there", "Hello there", (None, "x"), LONG], clash=True)
    rows = ask(token_counts(table, path), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert (0, 0, 0, False) in rows and (1, 0, 0, False) in rows and (2, 11, 2, False) in rows and (3, 11, 2, False) in rows
    assert (None, 1, 1, False) in rows
    assert next(r for r in rows if r[0] == 5)[1] == len(LONG)
    assert token_counts(table.limit(0), path).count() == 0


def check_packing(rows, texts, path):
    tokenizer = Tokenizer.from_file(path)
    own, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert own.keys() == texts.keys()
    for doc, pieces in own.items():
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : at].tobytes())
        assert at == len(ids)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
        padding += 2048 - at if at & (at - 1) else 0
    return padding


def check_groups(rows):
    """Groups of a tier differ by one sequence at most, none weighs more than a step, and none has two tiers."""
    tier = {r["sequence_id"]: r["tier"] for r in rows}
    group = {r["sequence_id"]: r["step_group"] for r in rows}
    by = defaultdict(list)
    for s, g in group.items():
        by[g].append(tier[s])
    assert sorted(by) == list(range(len(by))) and all(len(set(t)) == 1 and sum(t) <= STEP_TOKENS for t in by.values())
    for t in set(tier.values()):
        sizes = [len(g) for g in by.values() if g[0] == t]
        assert max(sizes) - min(sizes) <= 1


def test_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    draw = random.Random(5)
    texts = dict(enumerate(["", None, LONG, *(" ".join(draw.choices(["alpha", "beta", "gamma,", "42"], k=draw.choice((30, 100, 300, 900, 2000)) + draw.randint(1, 90))) for _ in range(220))]))
    rows = packed(docs(spark, list(texts.items()), clash=True).repartition(2), path).collect()
    assert check_packing(rows, texts, path) <= 2 * 2048  # at most one padded sequence a partition
    check_groups(rows)
    used = Counter(t for _, t in {(r["sequence_id"], r["tier"]) for r in rows})
    assert all(used[t] >= 3 for t in TIERS)
    whole = [r for r in rows if r["doc_tokens"] <= 2048]
    assert sum(r["length"] == r["doc_tokens"] for r in whole) >= 0.5 * len({r["doc_id"] for r in whole})
    assert packed(docs(spark, ["x"]).limit(0), path).count() == 0


def test_other_vocabularies_are_left_to_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = Encoder(path)
    assert encoder.codec is None and Encoder(public_tokenizers.path("byte_bpe_50k.json")).codec is not None
    assert encoder.encode("Hello there").tolist() == Tokenizer.from_file(path).encode("Hello there", add_special_tokens=False).ids


def test_packing_repeated_and_unnamed_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packed(docs(spark, [(None, "one two"), (7, "one two"), (7, "one two")]).coalesce(1), path).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 3 and sum(r["length"] for r in rows) == 9


@pytest.mark.parametrize("sizes", [[1], [2048], [2049], [300] * 20, [5, 2000, 100, 1024, 256, 4096]])
def test_packer_keeps_every_token_once(sizes):
    packer = Packer(0, TIERS)
    rows = packer.pack([(i, np.arange(n, dtype=np.uint32)) for i, n in enumerate(sizes)]) + packer.rest()
    assert sum(r[2] for r in rows) == sum(sizes)
    used = defaultdict(int)
    for r in rows:
        used[r[5]] += r[2]
    assert sum(n & (n - 1) != 0 for n in used.values()) <= 1
