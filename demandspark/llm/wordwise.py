"""Encoding of Arrow batches word by word: every distinct word of a batch is looked up once, new ones are encoded.

Texts are cut before each plain space. A batch's words become a dictionary array, so Python only sees distinct words, and
the ids of all words are taken by their codes in Arrow. Ids of words are kept between batches in two generations: when the
younger is full it becomes the older one, from which words come back when they are met again, so frequent words stay.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words that a generation holds unless less is asked for, and the longest ones that are kept.
KNOWN_WORDS = 400_000
KNOWN_CHARS = 64
# Bytes of a slice: the larger, the fewer distinct words for each of its words.
WORDWISE_BYTES = 8 << 20
_CUT = "\x01"


def cut_at_every_space(path: str) -> bool:
    """Whether a tokenizer file's rules look at nothing across a plain space that follows a character which is no space."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    split = data["pre_tokenizer"] or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    reaching = any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in data["added_tokens"])
    return bool(plain and data["normalizer"] is None and not reaching)


class Wordwise:
    """``encode`` gives the ids of each of a list of texts, 32 bits each; here it is called for new words, and for texts without safe cuts."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int | None = None):
        self._encode = encode
        self._most = KNOWN_WORDS if most is None else most
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, words: list[str]) -> list[bytes]:
        """Raw ids of each of some distinct words."""
        known = self.known
        found = list(map(known.get, words))
        missing = [i for i, raw in enumerate(found) if raw is None]
        new = []
        for i in missing:
            raw = self.older.get(words[i])
            if raw is None:
                new.append(i)
            else:
                found[i] = known[words[i]] = raw
        for i, raw in zip(new, self._encode([words[i] for i in new]) if new else [], strict=True):
            found[i] = raw
            if len(words[i]) <= KNOWN_CHARS:
                known[words[i]] = raw
        if len(known) > self._most:
            self.older, self.known = known, {}
        return found

    def _split(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """The words of some texts, where each text's words start, raw ids and number of ids of every distinct word, texts to encode whole.

        After white space a space is no safe cut: a text with such a one, or with the mark used here, is encoded whole.
        """
        split = pc.split_pattern(pc.replace_substring(texts, " ", _CUT + " "), _CUT)
        words = split.flatten().dictionary_encode()
        firsts = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        raw = self._ids(words.dictionary.to_pylist())
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        ends_open = pc.match_substring_regex(words.dictionary, r"[\pZ\x09-\x0d\x1c-\x1f\x85]\z").to_numpy(zero_copy_only=False)[words.indices.to_numpy()]
        ends_open[firsts[1:] - 1] = False  # behind the last word there is no cut
        whole = np.logical_or.reduceat(ends_open, firsts[:-1]) | pc.match_substring(texts, _CUT).to_numpy(zero_copy_only=False)
        return words, firsts, raw, sizes, np.flatnonzero(whole)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each text start (one more for the end), and the ids of all; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not len(texts):
            return np.zeros(1, np.int64), np.empty(0, np.uint32)
        words, firsts, raw, sizes, whole = self._split(texts)
        flat = np.frombuffer(b"".join(raw), np.uint32)
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), flat)
        ids = lists.take(words.indices).flatten().to_numpy()
        starts = np.concatenate([[0], np.cumsum(np.add.reduceat(sizes[words.indices.to_numpy()], firsts[:-1]))])
        if len(whole):
            parts = np.split(ids, starts[1:-1])
            for i in whole.tolist():
                parts[i] = np.frombuffer(self._encode([texts[i].as_py()])[0], np.uint32)
            ids, starts = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return starts.astype(np.int64), ids

    def count(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has, without putting them together."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not len(texts):
            return np.empty(0, np.int64)
        words, firsts, _, sizes, whole = self._split(texts)
        counts = np.add.reduceat(sizes[words.indices.to_numpy()], firsts[:-1])
        for i in whole.tolist():
            counts[i] = len(self._encode([texts[i].as_py()])[0]) // 4
        return counts
