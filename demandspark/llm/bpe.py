"""Byte-level BPE encoding and decoding by speculation and verification.

1. *Propose.* Each word of the split pattern is cut greedily into the longest vocabulary tokens.
2. *Verify.* A sequence of tokens is the BPE encoding exactly if every token encodes to itself and every adjacent pair
   (a, b) is compatible: merging the bytes of a and b ends with a and b. All pairs of a batch are tested at once in numpy.
3. *Repair.* Words with an incompatible pair are merged exactly, lowest rank first.

A pair is tested on two chains: the symbols that stand at the right end of a while it is merged, and those at the left
end of b. Each symbol is there from the rank that makes it to the rank that merges it away. A merge of a symbol of the
one with a symbol of the other chain breaks the pair if its rank falls into the time of both.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from array import array
from collections import ChainMap
from itertools import chain, islice, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from demandspark.llm.common import kept, map_batches
from demandspark.llm.wordwise import Wordwise, cut_at_every_space

# Fixed value: the split pattern of the public byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Words of the split pattern kept with their ids by a task; longer words aren't kept. Most are met behind the words that
# SPACED_WORDS bounds: a generation of those that texts are cut into at spaces.
KNOWN_WORDS = 20_000
KNOWN_LENGTH = 40
SPACED_WORDS = 50_000
SHORT_WORD = 48
BLOCK_CHARS = 1 << 19
BETWEEN = 0xFF
_NEVER = np.int64(1 << 60)
# Code points below this one have been in the same classes for many versions of Unicode.
_SETTLED = regex.compile("[^\\x00-\\u0557]")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


def _slices(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The ids up to each end as 32 bits each."""
    raw, cuts = ids.astype(np.uint32).tobytes(), (ends * 4).tolist()
    return [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


class Codec:
    """The vocabulary of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, pre = data["model"], data["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or data.get("normalizer"):
            raise ValueError("only plain byte-level BPE files")
        self.path = path
        letters = byte_letters()
        self.ids = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
        added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in data.get("added_tokens", [])):
            raise ValueError("added tokens that take in their neighbourhood aren't handled")
        self.added = added
        self.at_added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.split = regex.compile(SPLIT)
        size = max([*self.ids.values(), *added.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in self.ids.items():
            self.bytes_of[i] = token
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.sizes = np.array([len(t) for t in self.bytes_of], np.int64)
        # No UTF-8 text holds this byte, so it can stand between words.
        self.between = self.ids[bytes([BETWEEN])]
        if any(BETWEEN in token for token in self.ids if len(token) > 1):
            raise ValueError("only vocabularies of UTF-8 text")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        of = model["vocab"]
        self.merges: dict[tuple[int, int], int] = {}  # ranks
        self.result = [of[a + b] for a, b in merges]  # by rank
        left, right, made = (np.full(size, -1, np.int64) for _ in range(3))
        for rank, (a, b) in enumerate(merges):
            x, y, z = of[a], of[b], of[a + b]
            self.merges[x, y] = rank
            if made[z] < 0:
                left[z], right[z], made[z] = x, y, rank
        self.left, self.right, self.made = left, right, made
        keys = np.array([(x << 32) | y for x, y in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array(list(self.merges.values()), np.int64)[order]
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.stable: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    @functools.cached_property
    def _longest(self) -> ahocorasick.Automaton:
        automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            automaton.add_word(token.decode("latin-1"), i)
        automaton.make_automaton()
        return automaton

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words, and the number of tokens of each."""
        text = bytes([BETWEEN]).join(words)
        found = np.fromiter((i for _, i in self._longest.iter_long(text.decode("latin-1"))), np.int64)
        if self.sizes[found].sum() != len(text):
            raise ValueError("a byte without a token")
        ends = np.append(np.flatnonzero(found == self.between), len(found))
        counts = np.diff(ends, prepend=-1) - 1
        return found[found != self.between], counts

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; the number of merges where there is none."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], len(self.result))

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Raw ids that :meth:`merge` gives of many short words side by side: each step does one merge in every word that has one left."""
        none, results = len(self.result), np.array(self.result, np.int64)
        symbols = np.array(self.single, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        ranks = np.full(len(symbols), none, np.int64)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        ranks[inner] = self._ranks(symbols[inner], symbols[inner + 1])
        done_symbols, done_owner = [], []
        while len(symbols):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.repeat(np.minimum.reduceat(ranks, starts), np.diff(np.append(starts, len(symbols))))
            ended = best == none
            if ended.any():
                done_symbols.append(symbols[ended])
                done_owner.append(owner[ended])
                symbols, owner, ranks, best = (x[~ended] for x in (symbols, owner, ranks, best))
            hits = np.flatnonzero(ranks == best)
            if not len(hits):
                break
            hits = hits[np.append(True, owner[hits][1:] != owner[hits][:-1])]  # leftmost of each word
            symbols[hits] = results[ranks[hits]]
            kept = np.ones(len(symbols), bool)
            kept[hits + 1] = False
            symbols, owner, ranks = symbols[kept], owner[kept], ranks[kept]
            at = hits - np.arange(len(hits))  # one symbol fewer for each word before
            for left in (at[at > 0] - 1, at[at < len(symbols) - 1]):
                same = owner[left] == owner[left + 1]
                ranks[left] = np.where(same, self._ranks(symbols[left], symbols[left + 1]), none)
            if at[-1] == len(symbols) - 1:
                ranks[-1] = none
        if not done_owner:
            return [b""] * len(words)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return _slices(symbols[order], np.searchsorted(owner[order], np.arange(1, len(words) + 1)))

    def merge(self, word: bytes) -> list[int]:
        """Exact merging, lowest rank first and leftmost among equals; long words by a heap over a linked list."""
        symbols = [self.single[b] for b in word]
        n = len(symbols)
        if n <= SHORT_WORD:
            merges, none = self.merges, len(self.result)
            ranked = [merges.get(p, none) for p in pairwise(symbols)]
            while ranked:
                best = min(ranked)
                if best == none:
                    break
                at = ranked.index(best)
                symbols[at : at + 2] = [self.result[best]]
                del ranked[at]
                if at:
                    ranked[at - 1] = merges.get((symbols[at - 1], symbols[at]), none)
                if at < len(ranked):
                    ranked[at] = merges.get((symbols[at], symbols[at + 1]), none)
            return symbols
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(self.merges[p], i, p) for i, p in enumerate(pairwise(symbols)) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or (symbols[i], symbols[j]) != pair:
                continue
            symbols[i], symbols[j] = self.result[self.merges[pair]], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (new := (symbols[a], symbols[b])) in self.merges:
                    heapq.heappush(heap, (self.merges[new], a, new))
        return [s for s in symbols if s >= 0]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For arrays of tokens, whether each a stays apart from the b after it."""
        good = np.ones(len(a), dtype=bool)
        x, x_ends = a.astype(np.int64), np.full(len(a), _NEVER)
        while (live := x >= 0).any():
            y, y_ends = b.astype(np.int64), np.full(len(b), _NEVER)
            while (both := live & (y >= 0)).any():
                key = (x << 32) | y
                at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
                rank = self.pair_ranks[at]
                # Of equal ranks the left merge comes first: it takes x away before, but y only after this one.
                breaks = both & (self.pair_keys[at] == key) & (rank > self.made[x]) & (rank > self.made[y])
                good &= ~(breaks & (rank < x_ends) & (rank <= y_ends))
                y_ends, y = np.where(y >= 0, self.made[y], y_ends), np.where(y >= 0, self.left[y], -1)
            x_ends, x = np.where(live, self.made[x], x_ends), np.where(live, self.right[x], -1)
        return good

    def _is_stable(self, token: int) -> bool:
        if token not in self.stable:
            self.stable[token] = self.merge(self.bytes_of[token]) == [token]
        return self.stable[token]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Raw ids of each word; where a proposal fails the word is merged."""
        if not words:
            return []
        flat, counts = self.propose(words)
        owner = np.repeat(np.arange(len(words)), counts)
        failing = np.zeros(len(words), bool)
        tokens, inverse = np.unique(flat, return_inverse=True)
        unstable = np.array([not self._is_stable(t) for t in tokens.tolist()], dtype=bool)
        failing[owner[unstable[inverse]]] = True
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        if len(inside):
            pairs, inverse = np.unique((flat[inside] << 32) | flat[inside + 1], return_inverse=True)
            good = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
            failing[owner[inside[~good[inverse]]]] = True
        found = _slices(flat, np.cumsum(counts))
        short = [i for i in np.flatnonzero(failing).tolist() if len(words[i]) <= SHORT_WORD]
        for i, ids in zip(short, self.merge_all([words[i] for i in short]), strict=True):
            found[i] = ids
        for i in np.flatnonzero(failing).tolist():
            if len(words[i]) > SHORT_WORD:
                found[i] = array("I", self.merge(words[i])).tobytes()
        return found

    @functools.cached_property
    def _library_split(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path).pre_tokenizer

    def _words(self, text: str) -> list[str]:
        if _SETTLED.search(text) and any(unicodedata.category(c) == "Cn" for c in set(text)):
            # Characters that are new to Unicode: split as the library's own tables do.
            return [text[a:b] for _, (a, b) in self._library_split.pre_tokenize_str(text)]
        return self.split.findall(text)

    def words(self, text: str) -> list[str | int]:
        """Words of the split pattern in order; an added token inside the text stands as its id."""
        if self.at_added is None or not self.at_added.search(text):
            return self._words(text)
        found: list[str | int] = []
        at = 0
        for match in self.at_added.finditer(text):
            found += self._words(text[at : match.start()])
            found.append(self.added[match[0]])
            at = match.end()
        return found + self._words(text[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Raw ids of each text. Texts are taken in blocks, so that one verification covers the new words of many."""
        out: list[bytes] = []
        start = 0
        while start < len(texts):
            stop, chars = start, 0
            while stop < len(texts) and (stop == start or chars + len(texts[stop]) <= BLOCK_CHARS):
                chars += len(texts[stop])
                stop += 1
            out += self._encode_block(texts[start:stop])
            start = stop
        return out

    def _encode_block(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > KNOWN_WORDS:  # all but the younger half go; a block may have added more than that
            for word in list(islice(self.known, len(self.known) - KNOWN_WORDS // 2)):
                del self.known[word]
        known: dict[str | int, bytes] = self.known
        words = [self.words(text) for text in texts]
        new = list(set(chain.from_iterable(words)) - known.keys())
        passing = {w: array("I", [w]).tobytes() for w in new if isinstance(w, int)}
        new = [w for w in new if w not in passing]
        for word, ids in zip(new, self.encode_words([w.encode() for w in new]), strict=True):
            (known if len(word) <= KNOWN_LENGTH else passing)[word] = ids
        if passing:
            known = ChainMap(passing, known)
        return [known[w[0]] if len(w) == 1 else b"".join(map(known.__getitem__, w)) for w in words]

    @functools.cached_property
    def wordwise(self) -> Wordwise | None:
        return Wordwise(self.encode, SPACED_WORDS) if cut_at_every_space(self.path) else None

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each text start (one more for the end), and the ids of all; null counts as empty."""
        if self.wordwise is not None:
            starts, ids = self.wordwise.encode(texts)
            return starts, ids.astype(np.int32)
        found = self.encode([t or "" for t in texts.to_pylist()])
        return np.cumsum([0, *map(len, found)]) // 4, np.frombuffer(b"".join(found), np.uint32).astype(np.int32)

    @functools.cached_property
    def _token_bytes(self) -> tuple[pa.Array, np.ndarray]:
        return pa.array(self.bytes_of, pa.large_binary()), np.array([len(t) for t in self.bytes_of], np.int64)

    def decode_column(self, starts: np.ndarray, ids: np.ndarray) -> pa.Array:
        """Text of each run of ids, by one gather of their bytes.

        Bytes that aren't UTF-8 become U+FFFD, ids outside the vocabulary are left out.
        """
        tokens, sizes = self._token_bytes
        inside = (ids >= 0) & (ids < len(sizes))
        if not inside.all():
            kept = np.concatenate([[0], np.cumsum(inside)])
            starts, ids = kept[starts], ids[inside]
        ends = np.concatenate([[0], np.cumsum(sizes[ids])])[starts]
        gathered = tokens.take(pa.array(ids))
        held = gathered.buffers()[2] or pa.py_buffer(b"")
        runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(ends.astype(np.int64)), held])
        try:
            return runs.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([run.decode("utf-8", "replace") for run in runs.to_pylist()], pa.string())


@kept
def codec(path: str) -> Codec:
    return Codec(path)


def encode(documents: DataFrame, path: str) -> DataFrame:
    """One row per row of ``documents``: doc_id, ids (array of int) of the whole text.

    A null or empty text has no ids. Repeated rows are encoded each; other columns are ignored; an empty table gives an
    empty result.
    """

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        starts, ids = codec(path).encode_column(batch["text"])
        return pa.RecordBatch.from_arrays([batch["doc_id"], _lists(starts, ids)], ["doc_id", "ids"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_batches(documents.select("doc_id", "text"), per_batch, f"doc_id {kind}, ids array<int>", keeps=codec)


def _lists(starts: np.ndarray, ids: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32)))


def recode(documents: DataFrame, path: str) -> DataFrame:
    """:func:`encode`, then :func:`decode` of its ids, in one pass: doc_id, ids, text.

    A null or empty text has no ids and an empty text; repeated rows are coded each; other columns are ignored; an empty
    table gives an empty result.
    """

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        starts, ids = codec(path).encode_column(batch["text"])
        return pa.RecordBatch.from_arrays([batch["doc_id"], _lists(starts, ids), codec(path).decode_column(starts, ids)], ["doc_id", "ids", "text"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_batches(documents.select("doc_id", "text"), per_batch, f"doc_id {kind}, ids array<int>, text string", keeps=codec)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Rows of doc_id, ids with ``text``, the text of the ids; null ids give an empty text."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch["ids"].flatten()
        starts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch["ids"]), 0).to_numpy())])
        texts = codec(path).decode_column(starts, pc.fill_null(ids, -1).to_numpy())
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["ids"], texts], ["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_batches(encoded.select("doc_id", "ids"), per_batch, f"doc_id {kind}, ids array<int>, text string", keeps=codec)
