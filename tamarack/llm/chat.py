r"""Chat formatting by token-level assembly.

Every role and every text is encoded on its own, with the strings of special tokens taken as plain text; reserved ids
above the vocabulary are spliced between them, so no content can ever produce a control token.  A conversation is

    START role SEPARATOR text END   for each turn

The loss mask is the prefix sum of +1 where an assistant's text begins and -1 where it ends.  So that the formatted
string can't be misread either, contents escape what begins a control string: ``<``, any number of ``\``, ``|`` gets one
``\`` more, and reading takes one away.

Null roles and texts are empty.  Turns are ordered by turn (null first), then role, then text; repeated rows are turns
of their own.  A null conv_id is a conversation of its own.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import lists_of, prepare

#: Control strings, in the order of their ids above the vocabulary.
CONTROLS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
_OPENS = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _OPENS.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "<" in text else text


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True
    return tokenizer, tokenizer.get_vocab_size(with_added_tokens=True)


def assemble(conversations: list[list[tuple[str, str]]], path: str) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """Ids, loss mask and formatted string of each conversation of (role, text) turns."""
    tokenizer, first = _tokenizer(path)
    parts = [escape(y) for turns in conversations for turn in turns for y in turn]
    distinct = list(dict.fromkeys(parts))
    coded = {x: np.asarray(e.ids, np.int32) for x, e in zip(distinct, tokenizer.encode_batch_fast(distinct, add_special_tokens=False), strict=True)}
    start, separator, end = (np.array([first + k], np.int32) for k in range(3))
    out = []
    for turns in conversations:
        segments, formatted, marks, at = [], [], [], 0
        for role, text in turns:
            head, body = coded[escape(role)], coded[escape(text)]
            segments += [start, head, separator, body, end]
            formatted += [CONTROLS[0], escape(role), CONTROLS[1], escape(text), CONTROLS[2]]
            if role == "assistant":
                marks.append((at + 2 + len(head), at + 2 + len(head) + len(body)))
            at += 3 + len(head) + len(body)
        steps = np.zeros(at + 1, np.int8)
        for a, b in marks:
            steps[a] += 1
            steps[b] -= 1
        ids = np.concatenate(segments) if segments else np.zeros(0, np.int32)
        out.append((ids, np.cumsum(steps[:-1], dtype=np.int8), "".join(formatted)))
    return out


def disassemble(ids: list[np.ndarray], masks: list[np.ndarray], path: str) -> list[tuple[list[tuple[str, str]], str]]:
    """The turns and all text under the loss mask, read from ids and mask alone."""
    tokenizer, first = _tokenizer(path)
    parts, spans = [], []
    for x, mask in zip(ids, masks, strict=True):
        control = np.flatnonzero(x >= first)
        pieces = [x[a + 1 : b].tolist() for a, b in zip(control[:-1], control[1:], strict=True) if x[a] != first + 2]
        edges = np.diff(np.concatenate([[0], mask, [0]]))
        lossy = [x[a:b].tolist() for a, b in zip(np.flatnonzero(edges > 0), np.flatnonzero(edges < 0), strict=True)]
        spans.append((len(pieces), len(lossy)))
        parts += pieces + lossy
    texts = iter([unescape(x) for x in tokenizer.decode_batch(parts, skip_special_tokens=False)])
    out = []
    for n, m in spans:
        read = [next(texts) for _ in range(n)]
        out.append((list(zip(read[::2], read[1::2], strict=True)), "".join(next(texts) for _ in range(m))))
    return out


def format_conversations(rows: DataFrame, path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, ids, loss_mask, formatted) of each conversation: one shuffle by conversation."""
    prepare(rows.sparkSession)
    turns = rows.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def run(batches):
        for batch in batches:
            conversations = [list(zip(a, b, strict=True)) for a, b in zip(batch.column("roles").to_pylist(), batch.column("texts").to_pylist(), strict=True)]
            made = assemble(conversations, path)
            counts = [len(x[0]) for x in made]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"),
                    lists_of(np.concatenate([x[0] for x in made]) if made else np.zeros(0, np.int32), counts),
                    lists_of(np.concatenate([x[1] for x in made]) if made else np.zeros(0, np.int8), counts),
                    pa.array([x[2] for x in made], pa.string()),
                ],
                names=["conv_id", "ids", "loss_mask", "formatted"],
            )

    return grouped.mapInArrow(run, f"conv_id {dict(turns.dtypes)['conv_id']}, ids array<int>, loss_mask array<tinyint>, formatted string")


def read_back(formatted: DataFrame, path: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the formatted rows."""

    def run(batches):
        for batch in batches:
            cut = [np.split(x.values.to_numpy(zero_copy_only=False)[x.offsets[0].as_py() : x.offsets[-1].as_py()], (x.offsets.to_numpy()[1:-1] - x.offsets[0].as_py())) if len(x) else [] for x in (batch.column("ids"), batch.column("loss_mask"))]
            read = disassemble(*cut, path)
            hashed = lambda x: hashlib.sha256(x.encode()).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"),
                    pa.array([len(turns) for turns, _ in read], pa.int64()),
                    pa.array([hashed("".join(f"{role}\n{text}\n" for role, text in turns)) for turns, _ in read], pa.string()),
                    pa.array([len(loss) for _, loss in read], pa.int64()),
                    pa.array([hashed(loss) for _, loss in read], pa.string()),
                    pa.array([len(x) for x in batch.column("formatted").to_pylist()], pa.int64()),
                ],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return formatted.mapInArrow(run, f"conv_id {dict(formatted.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
