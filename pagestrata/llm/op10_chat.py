"""Chat formatting with offset-aligned loss masks.

The turns of a conversation are rendered into one string. Control strings inside roles and texts are
escaped by a backslash after their first character, backslashes by another, so the rendering can be
read back. The string is encoded once, with offsets; the loss mask is found by binary search of each
sorted assistant span among the sorted token spans, and covers the characters of those tokens that
lie within the span.

Defined results: null text or role counts as empty; turns with equal numbers are ordered by role and
text, nulls first; repeated rows are repeated turns; rows without a conversation id are a conversation each, of one
turn, since nothing says that they belong together; texts of any length are rendered whole, and a conversation is one string,
so its turns come together in one task; an empty table gives an empty result; further columns, also with clashing
names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

#: The template: <|turn|> role <|text|> text <|end|> for each turn.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that may not appear in a text as they are: this template's, and those of other common templates.
CONTROL = (TURN, TEXT, END, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
GUARD = re.compile("|".join([r"\\", *(re.escape(c) for c in CONTROL)]))
ESCAPED = re.compile(r"\\(\\?)")
READ = re.compile(rf"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.DOTALL)
SCHEMA = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, formatted string, n_tokens bigint, loss_tokens bigint"


def escape(text: str) -> str:
    return GUARD.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of its assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in READ.findall(formatted)]


def masked(spans: list[tuple[int, int]], offsets: np.ndarray) -> tuple[list[tuple[int, int]], int]:
    """Character ranges under the loss mask, and how many tokens it touches.

    spans: sorted character spans. offsets: sorted [start, end) of each token.
    """
    if not len(offsets) or not spans:
        return [], 0
    starts, ends = offsets[:, 0], np.maximum.accumulate(offsets[:, 1])
    wanted = np.array(spans)
    first = np.searchsorted(ends, wanted[:, 0], "right")
    past = np.searchsorted(starts, wanted[:, 1], "left")
    out, n = [], 0
    for (a, b), i, j in zip(spans, first, past):
        if i < j and a < b:
            n += int(j - i)
            out.append((max(a, int(starts[i])), min(b, int(ends[j - 1]))))
    return out, n


def formatted_chats(conversations: DataFrame, vocabulary: str) -> DataFrame:
    """Per conversation: the formatted string, what is read back from it, and its loss mask's text.

    vocabulary: the path of a tokenizers JSON file that every executor can open.
    """
    turns = pick(conversations, "conv_id", "turn", "role", "text")
    named = turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")).select("conv_id", "turns.role", "turns.text")
    whole = named.unionByName(turns.where("conv_id IS NULL").select("conv_id", F.array("role").alias("role"), F.array("text").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.encode_special_tokens = True
        for batch in batches:
            rows = []
            for roles, texts in zip(batch.column(1), batch.column(2)):
                formatted, spans = render([(r or "", t or "") for r, t in zip(roles.as_py(), texts.as_py())])
                offsets = np.array(tokenizer.encode(formatted, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
                ranges, loss_tokens = masked(spans, offsets)
                back = read_back(formatted)
                loss = "".join(unescape(formatted[a:b]) for a, b in ranges)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in back).encode()).hexdigest()
                rows.append((len(back), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted), formatted, len(offsets), loss_tokens))
            columns = list(zip(*rows)) or [()] * 8
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "formatted", "n_tokens", "loss_tokens"],
            )

    return whole.mapInArrow(run, SCHEMA)
