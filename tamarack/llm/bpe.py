"""BPE encoding and decoding by speculation and verification, for files of the tokenizers library.

A word's tokens are proposed by greedy longest match.  The proposal is the word's BPE encoding exactly if every adjacent
pair of its tokens is compatible, that is, encoding the two joined gives the two again; so all distinct adjacent pairs
of a batch's new words are tested together in NumPy, and only words with an incompatible pair undergo exact merging.

Compatibility is tested by undoing merges.  While a left and a right symbol stand side by side, the merge of the two
happens if its rank is below that of the merge that takes away the left one, and not above that of the merge that takes
away the right one (of equal merges, the leftmost goes first).  Going back from the two tokens, the symbol made later is
undone first, until both are single characters.  That needs merges whose parts have lower ranks; a file that isn't so
has all words merged exactly.

Unicode's tables differ between versions, so normalizing, lower-casing and cutting words here could differ from the
library's own.  Pieces with a character outside ``settled()``, whose properties have stayed the same, are normalized and
cut into words by the library; their words are then encoded like all others.

All three steps run over the new words of a batch at once, in NumPy: greedy matching walks a trie in step, and merging does
one merge of each word a round.  Words of over ``LONG`` bytes are handled one by one; their merging uses a heap.

Null and empty texts have no ids.  Repeated rows each get a row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import give_back, lists_of, prepare, tidied
from tamarack.llm.segments import SegmentIds, spaced, tiling

_NEVER = np.iinfo(np.int64).max
#: The end of a word inside proposals; no byte is written so.
_END = "\0"
#: The same in the trie, whose other symbols are bytes.
_STOP = 256
#: Bytes of a word up to which it is encoded together with others.
LONG = 64
#: Fixed value: the pattern of byte-level pre-tokenizers that use their own.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: Unicode's white space, which is what \s means to the library.
_SPACE = r"\t-\r\x20\x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(x if x in shown else next(spare)) for x in range(256)]


class Lookup:
    """A map from whole numbers to whole numbers from 0 up, asked for many keys at once: open addressing in arrays."""

    _ODD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            take = free[first]
            self.keys[slot[take]], self.values[slot[take]] = keys[take], values[take]
            left = np.ones(len(keys), bool)
            left[take] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self._ODD) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or -1."""
        slot = self._slot(keys)
        held, out = self.keys[slot], self.values[slot]
        at = np.flatnonzero((held != keys) & (held >= 0))
        while len(at):
            slot[at] = (slot[at] + 1) & self.mask
            held = self.keys[slot[at]]
            out[at] = self.values[slot[at]]
            at = at[(held != keys[at]) & (held >= 0)]
        return out


@functools.cache
def settled() -> frozenset[str]:
    """Characters that had their present category in Unicode 3.2 already, as had what they become in NFC and lower case."""
    old = unicodedata.ucd_3_2_0
    found = {c for c in map(chr, range(0x10000)) if old.category(c) == unicodedata.category(c) and old.category(c) not in ("Cn", "Co", "Cs")}
    while True:
        closed = {c for c in found if {*c.lower(), *unicodedata.normalize("NFC", c)} <= found}
        if len(closed) == len(found):
            return frozenset(found)
        found = closed


def outside(characters: frozenset[str]) -> re.Pattern:
    """A pattern of one character that isn't among these."""
    codes = sorted(map(ord, characters))
    starts = [x for i, x in enumerate(codes) if i == 0 or codes[i - 1] != x - 1]
    ends = [x for i, x in enumerate(codes) if i == len(codes) - 1 or codes[i + 1] != x + 1]
    return re.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True)) + "]")


class BpeModel:
    """The encoder and decoder of one file: normalizers NFC, Replace of white space and Lowercase, byte-level words."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout"):
            raise ValueError("only plain BPE models are supported")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {v: k for k, v in self.vocab.items()} | {v: k for k, v in self.added.items()}
        self.added_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._read_text_rules(spec)
        self.unsettled = outside(settled())
        self.library = _library(spec)
        self.symbols = byte_symbols()
        self.bytes_of = {ord(s): b for b, s in enumerate(self.symbols)}
        self._read_merges(model["merges"])
        self.decoder = (spec.get("decoder") or {}).get("type")
        if self.decoder not in (None, "ByteLevel"):
            raise ValueError(f"unsupported decoder {self.decoder}")

    @classmethod
    @functools.lru_cache(maxsize=4)
    def from_file(cls, path: str) -> BpeModel:
        with open(path, encoding="utf-8") as f:
            model = cls(json.load(f))
        give_back()
        return model

    def _read_text_rules(self, spec: dict) -> None:
        normalizer = spec["normalizer"]
        steps = (normalizer["normalizers"] if normalizer["type"] == "Sequence" else [normalizer]) if normalizer else []
        kinds = [x["type"] for x in steps]
        if not set(kinds) <= {"NFC", "Replace", "Lowercase"} or any(x["type"] == "Replace" and (x["pattern"], x["content"]) != ({"Regex": r"\s+"}, " ") for x in steps):
            raise ValueError(f"unsupported normalizers {kinds}")
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        pre = spec["pre_tokenizer"]
        parts = pre["pretokenizers"] if pre["type"] == "Sequence" else [pre]
        last = parts[-1]
        if last["type"] != "ByteLevel" or last["add_prefix_space"]:
            raise ValueError("only byte-level words are supported")
        if len(parts) == 1 and last["use_regex"]:
            pattern, cut = BYTE_LEVEL_PATTERN, tiling
        elif len(parts) == 2 and parts[0]["type"] == "Split" and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and not last["use_regex"]:
            pattern, cut = parts[0]["pattern"]["Regex"], spaced
        else:
            raise ValueError("unsupported pre-tokenizers")
        pattern = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")
        self.pattern = regex.compile(pattern)
        self.segments = SegmentIds(self._encode_segments, cut)

    def _read_merges(self, merges: list) -> None:
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in merges]
        n = max(self.strings) + 1
        self.n_ids = n
        self.rank_of_pair: dict[int, tuple[int, int]] = {}
        left, right, rank = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        keys, ranks = [], []
        for r, (a, b) in enumerate(pairs):
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            if x * n + y in self.rank_of_pair:
                continue
            self.rank_of_pair[x * n + y] = (r, z)
            keys.append(x * n + y)
            ranks.append(r)
            if rank[z] < 0:
                left[z], right[z], rank[z] = x, y, r
        made = rank >= 0
        self.left, self.right, self.rank = left, right, rank
        self.ordered = len(keys) == int(made.sum()) and bool((rank[left[made]] < rank[made]).all() and (rank[right[made]] < rank[made]).all())
        self.pairs = Lookup(np.array(keys, np.int64), np.array(ranks, np.int64))
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        self._find_reachable()
        self._plant()

    def _find_reachable(self) -> None:
        """Tokens that are their own encoding: both parts are, and nothing else merges across them first."""
        reachable = {i for i in self.vocab.values() if self.rank[i] < 0}
        made = np.flatnonzero(self.rank >= 0)
        if self.ordered and len(made):
            made = made[np.argsort(self.rank[made])]
            fine = self.compatible(self.left[made], self.right[made], self.rank[made])
            for i, ok in zip(made.tolist(), fine.tolist(), strict=True):
                if ok and int(self.left[i]) in reachable and int(self.right[i]) in reachable:
                    reachable.add(i)
        special = set(self.added.values())
        self.proposals = {}
        for s, i in self.vocab.items():
            if i in reachable and i not in special:
                ends = self.suffix and s.endswith(self.suffix)
                self.proposals[s[: -len(self.suffix)] + _END if ends else s] = i
        self.longest = max(map(len, self.proposals), default=1)

    def _plant(self) -> None:
        """The trie of proposals, its nodes' tokens, and the ids of single bytes within and at the end of a word."""
        children: dict[int, int] = {}
        tokens = [-1]
        for text, token in self.proposals.items():
            node = 0
            for c in text:
                key = node * (_STOP + 1) + (_STOP if c == _END else self.bytes_of.get(ord(c), -1))
                node = children.setdefault(key, len(tokens))
                if node == len(tokens):
                    tokens.append(-1)
            tokens[node] = token
        self.children = Lookup(np.array(list(children), np.int64), np.array(list(children.values()), np.int64))
        self.token_of = np.array(tokens, np.int64)
        self.single, self.single_last = (np.array([self.vocab.get(c + end, -1) for c in self.symbols], np.int64) for end in ("", self.suffix))

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        rank = self.pairs.get(a * self.n_ids + b)
        return np.where(rank < 0, _NEVER, rank)

    def compatible(self, a: np.ndarray, b: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens side by side: does no merge ever join what they meet in?  own: a merge of the two themselves, of that rank, is allowed."""
        x, y = a.astype(np.int64), b.astype(np.int64)
        fine = np.ones(len(x), bool)
        gone_x, gone_y = (np.full(len(x), _NEVER),) * 2 if own is None else (own.astype(np.int64), own.astype(np.int64) - 1)
        gone_x, gone_y = gone_x.copy(), gone_y.copy()
        at = np.arange(len(x))
        while len(at):
            u, v = x[at], y[at]
            merge = self._ranks(u, v)
            bad = (merge < gone_x[at]) & (merge <= gone_y[at]) & (merge < _NEVER)
            fine[at[bad]] = False
            ru, rv = self.rank[u], self.rank[v]
            on = ~bad & ((ru >= 0) | (rv >= 0))
            at, u, v, ru, rv = at[on], u[on], v[on], ru[on], rv[on]
            later_left = ru > rv
            i, j = at[later_left], at[~later_left]
            gone_x[i], x[i] = ru[later_left], self.right[u[later_left]]
            gone_y[j], y[j] = rv[~later_left], self.left[v[~later_left]]
        return fine

    def _propose(self, word: str) -> list[int] | None:
        """Greedy longest match, never leaving the bare end of the word."""
        text = word + _END if self.suffix else word
        n, at, out, known = len(text), 0, [], self.proposals
        while at < n:
            for to in range(min(n, at + self.longest), at, -1):
                if to == n - 1 and self.suffix:
                    continue
                if (token := known.get(text[at:to])) is not None:
                    break
            else:
                return None
            out.append(token)
            at = to
        return out

    def merge(self, word: str) -> list[int]:
        """Exact BPE of a word: the pair of lowest rank first, of equal ones the leftmost."""
        symbols = [*word]
        if self.suffix and symbols:
            symbols[-1] += self.suffix
        ids = [self.vocab[s] for s in symbols if s in self.vocab]
        n, m, table = len(ids), self.n_ids, self.rank_of_pair
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(hit[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (hit := table.get(ids[i] * m + ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = table[a * m + b][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k, at in ((before[i], before[i]), (i, after[i])):
                if k >= 0 and at >= 0 and after[k] >= 0 and (hit := table.get(ids[k] * m + ids[after[k]])):
                    heapq.heappush(heap, (hit[0], k, ids[k], ids[after[k]]))
        return [x for x in ids if x >= 0]

    def _propose_all(self, symbols: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of many words in step: tokens at the places where they begin (else -1), and words without a proposal."""
        tokens, none = np.full(len(symbols), -1, np.int64), np.zeros(len(begins), bool)
        word, at = np.arange(len(begins)), begins
        while len(word):
            best, to, end = np.full(len(word), -1, np.int64), at.copy(), ends[word]
            walk, place, node = np.arange(len(word)), at, np.zeros(len(word), np.int64)
            while len(walk):
                node = self.children.get(node * (_STOP + 1) + symbols[place])
                on = node >= 0
                walk, place, node = walk[on], place[on] + 1, node[on]
                token, left = self.token_of[node], end[walk] - place
                fits = (token >= 0) & (left != 1) if self.suffix else token >= 0
                best[walk[fits]], to[walk[fits]] = token[fits], place[fits]
                on = left > 0
                walk, place, node = walk[on], place[on], node[on]
            found = best >= 0
            none[word[~found]] = True
            tokens[at[found]] = best[found]
            on = found & (to < end)
            word, at = word[on], to[on]
        return tokens, none

    def _merge_all(self, tokens: np.ndarray, place: np.ndarray, ids: np.ndarray, word: np.ndarray) -> None:
        """Exact BPE of many words of single symbols, one merge of each a round; writes ids to tokens at their places."""
        rank = np.full(len(ids), _NEVER)
        beside = np.flatnonzero(word[:-1] == word[1:])
        rank[beside] = self._ranks(ids[beside], ids[beside + 1])
        while len(ids):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            count = np.diff(np.append(first, len(ids)))
            least = np.minimum.reduceat(rank, first)
            least = np.repeat(least, count)
            done = least == _NEVER
            if done.any():
                tokens[place[done]] = ids[done]
                place, ids, word, rank, least = (x[~done] for x in (place, ids, word, rank, least))
                if not len(ids):
                    return
            hit = np.flatnonzero(rank == least)
            hit = hit[np.append(True, word[hit[1:]] != word[hit[:-1]])]
            ids[hit] = self.made[rank[hit]]
            kept = np.ones(len(ids), bool)
            kept[hit + 1] = False
            place, ids, word, rank = (x[kept] for x in (place, ids, word, rank))
            hit -= np.arange(len(hit))
            before = hit[(hit > 0) & (word[hit - 1] == word[hit])] - 1
            for i in (hit, before):
                rank[i] = _NEVER
                i = i[i < len(ids) - 1]
                i = i[word[i] == word[i + 1]]
                rank[i] = self._ranks(ids[i], ids[i + 1])

    def encode_flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of at most LONG bytes, one after the other, and how many each has: speculate, verify all adjacent pairs, merge the rest."""
        stop = 1 if self.suffix else 0
        sizes = np.array([len(x) for x in words], np.int64)
        room = np.where(sizes > 0, sizes + stop, 0)
        ends = np.cumsum(room)
        begins = ends - room
        owner = np.repeat(np.arange(len(words)), room)
        last = np.arange(len(owner)) == ends[owner] - 1
        inside = ~last if stop else np.ones(len(owner), bool)
        symbols = np.full(len(owner), _STOP, np.int64)
        symbols[inside] = np.frombuffer(b"".join(words), np.uint8)
        if self.ordered:
            full = np.flatnonzero(sizes)
            tokens, none = self._propose_all(symbols, begins[full], ends[full])
            wrong = np.zeros(len(words), bool)
            wrong[full[none]] = True
            at = np.flatnonzero(tokens >= 0)
            side = np.flatnonzero(owner[at[:-1]] == owner[at[1:]])
            distinct, which = np.unique(tokens[at[side]] * self.n_ids + tokens[at[side + 1]], return_inverse=True)
            fine = self.compatible(distinct // self.n_ids, distinct % self.n_ids)
            wrong[owner[at[side]][~fine[which]]] = True
        else:
            tokens, wrong = np.full(len(owner), -1, np.int64), np.ones(len(words), bool)
        rest = wrong[owner]
        tokens[rest] = -1
        place = np.flatnonzero(rest & inside)
        ids = np.where(ends[owner[place]] - stop - 1 == place, self.single_last[symbols[place]], self.single[symbols[place]])
        place, ids = place[ids >= 0], ids[ids >= 0]
        self._merge_all(tokens, place, ids, owner[place])
        found = tokens >= 0
        return tokens[found], np.bincount(owner[found], minlength=len(words))

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after the other, and how many each has."""
        long = [i for i, x in enumerate(words) if len(x) > LONG]
        flat, counts = self.encode_flat([b"" if len(x) > LONG else x for x in words])
        if long:
            before = np.cumsum(counts)
            alone = [self.encode_long("".join([self.symbols[b] for b in words[i]])) for i in long]
            flat = np.insert(flat, np.repeat(before[long], list(map(len, alone))), [y for x in alone for y in x])
            counts[long] = list(map(len, alone))
        return flat, counts

    def encode_long(self, word: str) -> list[int]:
        """The ids of one word written in byte symbols."""
        proposed = self._propose(word) if self.ordered else None
        if proposed is None:
            return self.merge(word)
        pairs = np.unique(np.array([proposed[:-1], proposed[1:]], np.int64), axis=1)
        return proposed if self.compatible(*pairs).all() else self.merge(word)

    def normalize(self, text: str) -> str:
        if self.nfc and not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if self.lower:  # character by character, as the library does: no final sigma
            text = text.replace("Σ", "σ").lower()
        return text

    def _is_unsettled(self, text: str) -> bool:
        return not text.isascii() and self.unsettled.search(text) is not None

    def _words_of(self, segment: str) -> list[str]:
        """The words of a segment without added tokens."""
        return self._library_words(segment) if self._is_unsettled(segment) else self.pattern.findall(self.normalize(segment))

    def _encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of segments, one after the other, and how many each has; added tokens are their own."""
        number: dict[str, int] = {}
        parts: list[list] = []
        for x in segments:
            if self.added_pattern is not None and "<" in x and self.added_pattern.search(x):
                cut = self.added_pattern.split(x)
                parts.append([w for k, y in enumerate(cut) for w in ([self.added[y]] if k % 2 else self._words_of(y))])
            else:
                parts.append(self._words_of(x))
        place = np.fromiter((-1 - w if isinstance(w, int) else number.setdefault(w, len(number)) for x in parts for w in x), np.int64)
        flat, counts = self.encode_words([w.encode() for w in number])
        flat, counts = np.append(flat, list(self.added.values())), np.append(counts, np.ones(len(self.added), np.int64))
        added = np.flatnonzero(place < 0)
        place[added] = len(number) + np.array([list(self.added.values()).index(-1 - i) for i in place[added].tolist()], np.int64)
        first, size = (np.cumsum(counts) - counts)[place], counts[place]
        before = np.cumsum(size) - size
        ids = flat[np.repeat(first - before, size) + np.arange(int(size.sum()))]
        upto = np.append(0, np.cumsum(size))[np.cumsum([len(x) for x in parts])]
        return ids, np.diff(upto, prepend=0)

    def _library_words(self, piece: str) -> list[str]:
        """The words that the library makes of a piece."""
        if self.library.normalizer is not None:
            piece = self.library.normalizer.normalize_str(piece)
        cut = self.library.pre_tokenizer.pre_tokenize_str(piece)
        return [bytes([self.bytes_of[ord(c)] for c in x]).decode() for x, _ in cut]

    def encode_batch(self, items: list[str]) -> list[list[int]]:
        flat, counts = self.segments.ids_of(pa.array(items, pa.string()))
        return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] if items else []

    def decode(self, ids: list[int], skip_special_tokens: bool = False) -> str:
        skip = set(self.added.values()) if skip_special_tokens else ()
        parts = [self.strings[x] for x in ids if x in self.strings and x not in skip]
        if self.decoder is None:
            return " ".join(parts)
        out = bytearray()
        for x in parts:
            known = [self.bytes_of.get(ord(c)) for c in x]
            out += x.encode() if None in known else bytes(known)
        return out.decode("utf-8", "replace")


def _library(spec: dict):
    """The library's tokenizer with the text rules of a file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = spec["model"] | {"vocab": {}, "merges": []}
    return Tokenizer.from_str(json.dumps(spec | {"model": model, "added_tokens": []}))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every whole text; no shuffle."""

    def run(batches):
        model = BpeModel.from_file(path)
        for batch in batches:
            ids, counts = model.segments.ids_of(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists_of(ids, counts)], names=["doc_id", "ids"])

    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); a null list is an empty text."""

    def run(batches):
        model = BpeModel.from_file(path)
        for batch in batches:
            out = [model.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidied(run), f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text's ids and of their decoding."""

    def run(batches):
        model = BpeModel.from_file(path)
        number = [str(i) for i in range(model.n_ids)]
        shown = [model.strings.get(i, "") for i in range(model.n_ids)]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in batches:
            flat, counts = model.segments.ids_of(batch.column("text"))
            parts = [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] if len(counts) else []
            ids = [sha(" ".join([number[i] for i in x])) for x in parts]
            decoded = [sha(" ".join([shown[i] for i in x]) if model.decoder is None else model.decode(x)) for x in parts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
