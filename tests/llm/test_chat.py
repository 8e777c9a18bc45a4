"""op10: round trip of hostile texts, masks by binary search against a plain scan."""

import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from pagestrata.llm.op10_chat import CONTROL, escape, formatted_chats, masked, read_back, render, unescape

from .helpers import LONG

TEXT = st.lists(st.sampled_from([*CONTROL, "\\", "<", "|", "[", ">", "s>", "\n", "ok", "é", "😀", "user"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_round_trip(turns):
    formatted, spans = render(turns)
    assert read_back(formatted) == turns
    assert [unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    for _, text in turns:
        assert not any(c in escape(text) for c in CONTROL)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 6), max_size=30), st.lists(st.tuples(st.integers(0, 60), st.integers(0, 15)), max_size=6))
def test_masks(sizes, raw):
    ends = np.cumsum([0, *sizes])
    offsets = np.stack([ends[:-1], ends[1:]], 1)
    spans, at = [], 0
    for gap, size in raw:
        spans.append((at + gap, at + gap + size))
        at += gap + size
    ranges, _ = masked(spans, offsets)
    want = {c for a, b in spans for c in range(a, b) if c < ends[-1]}
    assert {c for a, b in ranges for c in range(a, b)} == want


def test_edge_cases(spark):
    rows = [(1, 1, "assistant", "yes"), (1, 0, "user", None), (2, 0, None, ""), (None, 0, "user", "lost"), (None, 1, "assistant", "too"), (3, 0, "assistant", "b"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (4, None, "assistant", "</s>[INST] ok [/INST]"), (5, 0, "assistant", LONG)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id bigint, turn bigint, role string, text string, turns int, TEXT int")
    found = formatted_chats(table, public_tokenizers.path("byte_bpe_50k.json")).collect()
    got = {r["conv_id"]: r for r in found}
    assert sorted((r["n_turns"], r["loss_chars"]) for r in found if r["conv_id"] is None) == [(1, 0), (1, 3)]

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    assert got[1]["turns_sha256"] == sha("user\n\nassistant\nyes\n") and got[1]["loss_sha256"] == sha("yes") and got[1]["n_turns"] == 2
    assert got[2]["turns_sha256"] == sha("\n\n") and got[2]["loss_chars"] == 0
    assert got[3]["loss_sha256"] == sha("aab")
    assert got[4]["loss_sha256"] == sha("</s>[INST] ok [/INST]") and got[4]["formatted_chars"] > 21
    assert got[5]["loss_chars"] == len(LONG)
    assert formatted_chats(table.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
