"""Chat formatting with loss masks aligned to token offsets."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, BREAK, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_MARK = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """Put one more backslash into every ``<|``, ``<\\|``, ...: no control string survives, and each way back is unique."""
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The whole conversation and the sorted spans of its assistant texts."""
    pieces, spans, at = [], [], 0
    for role, text in turns:
        head, body = START + escape(role) + BREAK, escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        pieces += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(pieces), spans


def tokens_in_spans(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of token numbers that lie in each span, by binary search over sorted token ends and starts."""
    starts, ends = [a for a, _ in offsets], [b for _, b in offsets]
    out = []
    for a, b in spans:
        first = bisect_left(ends, a + 1)
        last = bisect_left(starts, b)
        out.append((first, max(first, last)))
    return out


def conversation_tokenizer(vocabulary: str):
    """The tokenizer with the template's marks as tokens of their own and offsets that keep white space."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer, processors
    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
    tokenizer.add_special_tokens([AddedToken(t, special=True, normalized=False) for t in (START, BREAK, END)])
    return tokenizer


FORMATTED = "conv_id long, formatted string, input_ids array<int>, loss_tokens array<struct<first:int,end:int>>, loss_spans array<struct<start:int,end:int>>"


def format_conversations(conversations: DataFrame, vocabulary: str) -> DataFrame:
    """One row per conversation: the text, its ids, and the loss mask as token ranges and as character spans.

    Turns come in the order of turn (null first), then role and text. A null
    text or role is empty; rows without conv_id are one conversation without id.
    A conversation is one unit: its digest and its encoding run from end to end.
    Turns are gathered by Spark and rendered and encoded in Arrow batches.
    """
    turns = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = conversation_tokenizer(vocabulary)
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at:at + 256]
                made = [render([(t["role"], t["text"]) for t in turns]) for turns in part["turns"]]
                encoded = tokenizer.encode_batch([text for text, _ in made], add_special_tokens=False)
                rows = []
                for conv, (text, spans), e in zip(part["conv_id"], made, encoded, strict=True):
                    inside = tokens_in_spans(e.offsets, spans)
                    covered = [(e.offsets[a][0], e.offsets[b - 1][1]) for a, b in inside if b > a]
                    rows.append((conv, text, e.ids, [{"first": a, "end": b} for a, b in inside],
                                 [{"start": a, "end": b} for a, b in covered]))
                yield pd.DataFrame(rows, columns=["conv_id", "formatted", "input_ids", "loss_tokens", "loss_spans"])

    return turns.mapInPandas(work, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted text and its mask say again: turns, and the text under the mask, both unescaped."""
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for conv, text, spans in zip(frame["conv_id"], frame["formatted"], frame["loss_spans"], strict=True):
                turns = [(unescape(a), unescape(b)) for a, b in _TURN.findall(text)]
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                loss = "".join(unescape(text[s["start"]:s["end"]]) for s in spans)
                rows.append((conv, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(rows, columns=[
                "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInPandas(
        work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
