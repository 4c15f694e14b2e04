"""Token counts: batches encoded in Arrow functions that return lengths only.

Texts are cut at safe boundaries (white space, for the two layouts of text rules that never join words across it), the
distinct segments of an Arrow batch are encoded by the library in sub-batches of equal size in bytes, and only lengths
are kept.  Texts for a sentencepiece model are cut at single spaces between letters if no piece of its reaches across
them.  A tokenizer of another layout may join across spaces, so its texts are encoded whole.

Null and empty texts have 0 bytes and 0 tokens.  Repeated rows each get a row; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import functools
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import by_bytes, prepare, texts
from tamarack.llm.segments import SegmentIds, lettered, spaced
from tamarack.llm.token_store import ENCODE_BYTES, load_tokenizer, segment_encoder


@functools.lru_cache(maxsize=4)
def _counter(path: str):
    """A function from a column of texts to numbers of tokens."""

    def whole(encode):
        return lambda column: [len(y) for part in by_bytes(texts(column), ENCODE_BYTES) for y in encode(part)]

    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)

        def encode(part: list[str]) -> list[list[int]]:
            return model.encode(part, num_threads=1)

        def of_segments(segments: list[str]) -> tuple[list[int], list[int]]:
            coded = [y for part in by_bytes(segments, ENCODE_BYTES) for y in encode(part)]
            return [i for x in coded for i in x], [len(x) for x in coded]

        return SegmentIds(of_segments, lettered).counts_of if _begins_words(model) else whole(encode)
    tokenizer = load_tokenizer(path)
    if _byte_level(tokenizer):
        return SegmentIds(segment_encoder(tokenizer)).counts_of
    if _drops_white_space(tokenizer):
        return SegmentIds(segment_encoder(tokenizer, lower=True), spaced).counts_of
    return whole(lambda part: tokenizer.encode_batch_fast(part, add_special_tokens=False))


# The text rules of the layout that lower-cases and drops white space, as its file states them.
LOWERED = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORDS = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


def _begins_words(model) -> bool:
    """Does a sentencepiece model mark white space at the beginning of pieces only, and put one before a text?

    Then no piece reaches across a single space between two letters, and the text behind it is coded as one of its own.
    """
    mark = "\u2581"
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i))
    return model.encode("a a", out_type=str) == [mark + "a", mark + "a"] and all(mark not in x.lstrip(mark) for x in pieces)


def _spec(tokenizer) -> dict:
    import json

    return json.loads(tokenizer.to_str())


def _byte_level(tokenizer) -> bool:
    """The one layout for which cutting before single spaces is proven: no normalizer, byte-level words."""
    spec = _spec(tokenizer)
    pre = spec["pre_tokenizer"] or {}
    return spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and _plain_added(spec)


def _drops_white_space(tokenizer) -> bool:
    """The other: the pre-tokenizer removes what a pattern without white space doesn't match."""
    spec = _spec(tokenizer)
    first = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    return spec["normalizer"] == LOWERED and first == WORDS and _plain_added(spec)


def _plain_added(spec: dict) -> bool:
    return all(not (x["lstrip"] or x["rstrip"] or x["single_word"] or " " in x["content"]) for x in spec["added_tokens"])


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text; no shuffle."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"

    def run(batches):
        count = _counter(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(count(batch.column("text")), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
