"""Token ids and token counts by a tokenizer library, in Arrow batches balanced by bytes.

Where the file's rules allow it, texts are cut before every plain space and the library encodes each distinct piece once;
else long texts are cut at safe places into pieces of some size.

The tokenizer file is a parameter (``.json`` for ``tokenizers``, ``.model`` for ``sentencepiece``) and is read on the
executors; special strings inside texts are handled as the library does by default, and nothing is added or cut off.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.llm.common import kept, map_batches
from demandspark.llm.wordwise import WORDWISE_BYTES, Wordwise, cut_at_every_space

# Texts longer than this are encoded in pieces; one call of the library gets about BATCH_CHARS.
PIECE_CHARS = 1 << 15
BATCH_CHARS = 1 << 18
JOINED_WORDS = 512
# Before a plain space that follows a character which is no space, every split pattern of the .json files starts a new
# word, so the pieces have the ids of the whole.
SAFE_CUT = re.compile(r"\S(?= )")


@functools.lru_cache(maxsize=4)
def _encoder(path: str):
    """A function from a list of texts to the ids of each."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use every core
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: model.encode(texts, num_threads=1)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@functools.lru_cache(maxsize=4)
def _token_bytes(path: str) -> np.ndarray:
    """How many bytes of text each id of a byte-level file stands for."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    sizes = np.zeros(tokenizer.get_vocab_size() + 1, np.int64)
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        sizes[i] = len(token)  # one letter a byte
    for i, token in tokenizer.get_added_tokens_decoder().items():
        sizes[i] = len(token.content.encode())
    return sizes


def _encode_joined(path: str, words: list[str]) -> list[bytes]:
    """Raw ids of words. Those that start with a space and end in none are encoded in long texts, which costs less a word.

    A cut before such a space is safe, so the ids of the text are those of its words; the bytes that ids stand for show
    where a word ends.
    """
    encode, sizes = _encoder(path), _token_bytes(path)
    found = [b""] * len(words)
    plain = [i for i, w in enumerate(words) if w[:1] == " " and len(w) > 1 and not w[-1].isspace()]
    rest = sorted(set(range(len(words))) - set(plain))
    for i, ids in zip(rest, encode([words[i] for i in rest]) if rest else [], strict=True):
        found[i] = np.asarray(ids, np.uint32).tobytes()
    runs = [plain[at : at + JOINED_WORDS] for at in range(0, len(plain), JOINED_WORDS)]
    for run, ids in zip(runs, encode(["".join([words[i] for i in run]) for run in runs]) if runs else [], strict=True):
        own = np.asarray(ids, np.uint32)
        ends = np.cumsum([len(words[i].encode()) for i in run])
        cuts = ((np.searchsorted(np.cumsum(sizes[own]), ends) + 1) * 4).tolist()
        raw = own.tobytes()
        for i, a, b in zip(run, [0, *cuts], cuts, strict=False):
            found[i] = raw[a:b]
    return found


@kept
def wordwise_encoder(path: str) -> Wordwise | None:
    """The library behind a table of known words; None for files whose rules look across spaces."""
    return Wordwise(functools.partial(_encode_joined, path)) if cut_at_every_space(path) else None


def pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """The text cut at safe boundaries into pieces of about ``limit`` characters; longer where there is no boundary."""
    start = 0
    while len(text) - start > limit:
        cut = SAFE_CUT.search(text, start + limit - 1)
        if cut is None:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:]


def encode_column(path: str, texts: pa.Array) -> Iterator[np.ndarray]:
    """The ids of each text of an Arrow array; null counts as empty. For outputs that are limited by the library's speed."""
    words = wordwise_encoder(path)
    if words is None:
        for parts in encode_texts(path, texts.to_pylist()):
            yield np.concatenate([np.empty(0, np.uint32), *parts])
        return
    starts, ids = words.encode(texts)
    yield from (ids[a:b] for a, b in pairwise(starts.tolist()))


def encode_texts(path: str, texts: Sequence[str | None]) -> Iterator[list[np.ndarray]]:
    """For each text in order, the ids of its pieces; null counts as empty."""
    whole = path.endswith(".model")  # its normaliser looks across spaces
    encode = _encoder(path)
    batch: list[str] = []
    owners: list[int] = []
    held, done = 0, 0
    found: dict[int, list[np.ndarray]] = {}

    def flush() -> None:
        for owner, ids in zip(owners, encode(batch), strict=True):
            found.setdefault(owner, []).append(np.asarray(ids, dtype=np.uint32))
        batch.clear()
        owners.clear()

    for i, text in enumerate(texts):
        for piece in [text or ""] if whole else pieces(text or ""):
            batch.append(piece)
            owners.append(i)
            held += len(piece)
            if held >= BATCH_CHARS:
                flush()
                held = 0
        while done < i:
            if owners and owners[0] <= done:
                break
            yield found.pop(done, [])
            done += 1
    flush()
    while done < len(texts):
        yield found.pop(done, [])
        done += 1


def count_tokens(documents: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    A null text counts as empty: no bytes, no tokens. Only lengths leave the Arrow function. Other columns are ignored,
    repeated rows are counted each, a null doc_id is kept, and an empty table gives an empty result.
    """

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = wordwise_encoder(path)
        if words is None:
            counts = [sum(map(len, ids)) for ids in encode_texts(path, batch["text"].to_pylist())]
        else:
            counts = words.count(batch["text"])
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = documents.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    counted = map_batches(rows, per_batch, f"doc_id {kind}, n_bytes long, n_tokens long", WORDWISE_BYTES, wordwise_encoder)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
