"""Token counts, the token store and BPE against the tokenizers library."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from demandspark.llm import bpe, token_store, tokenization, wordwise
from demandspark.llm.common import BATCH_BYTES, let_go, map_batches

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def texts() -> list[str | None]:
    rng = random.Random(8)
    parts = ["the", " ", "a", "ing", "  ", "\n", "é", "1", "23", ".", ",", "!!", "Th", "er", "字", "'s", "<|endoftext|>", "\x1c", "՘"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    wild = ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(30)) for _ in range(100)]
    return [None, "", " ", "a" * 4000, "word " * 20000, "x<|endoftext|> y", *made, *wild]


def ids_of(text: str | None) -> list[int]:
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_bpe_is_the_library(docs):
    given = texts()
    rows = bpe.decode(bpe.encode(docs(*given, extra="ids"), PATH), PATH).collect()
    again = {r["doc_id"]: (r["ids"], r["text"]) for r in bpe.recode(docs(*given), PATH).collect()}
    assert len(rows) == len(given)
    for r in rows:
        want = ids_of(given[r["doc_id"]])
        assert r["ids"] == want
        assert r["text"] == LIBRARY.decode(want, skip_special_tokens=False)
        assert again[r["doc_id"]] == (r["ids"], r["text"])


def test_every_pair_verdict_agrees_with_merging():
    codec = bpe.codec(PATH)
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 20000, 3000), rng.integers(0, 20000, 3000)
    verdicts = codec.compatible(a, b)
    for x, y, good in zip(a.tolist(), b.tolist(), verdicts.tolist(), strict=True):
        if codec._is_stable(x) and codec._is_stable(y):
            assert good == (codec.merge(codec.bytes_of[x] + codec.bytes_of[y]) == [x, y])


def test_long_words_merge_alike():
    codec = bpe.codec(PATH)
    word = b"antidisestablishment" * 9
    assert codec.merge(word) == ids_of(word.decode())


def test_words_merged_side_by_side():
    codec = bpe.codec(PATH)
    rng = random.Random(4)
    words = ["".join(rng.choice("aeinrst lhé") for _ in range(rng.randint(1, 24))).encode()[:48] for _ in range(3000)] + [b"aaaaaaa", b"x"]
    assert codec.merge_all(words) == [np.array(codec.merge(w), np.uint32).tobytes() for w in words]
    assert codec.merge_all([]) == []
    flat, counts = codec.propose(words)
    assert counts.sum() == len(flat) and [codec.bytes_of[i] for i in flat[: counts[0]].tolist()][0] == max(
        (t for t in codec.ids if words[0].startswith(t)), key=len
    )


def test_ids_by_words_are_those_of_whole_texts():
    spaced = ["a  b", "a \n b", "\n x", " x y", "x ", "x\x1c y", "x\u3000 y", "x's 't y", "x <|endoftext|> y", "<|endoftext|>", "w" * 99 + " w", "a" * 70 + "\n\nb c"]
    for _ in range(2):  # the second time from what is kept
        given = texts() + spaced
        for text, ids in zip(given, tokenization.encode_column(PATH, pa.array(given)), strict=True):
            assert ids.tolist() == ids_of(text)
        for text, ids in zip(given[7:], tokenization.encode_column(PATH, pa.array(given)[7:]), strict=True):
            assert ids.tolist() == ids_of(text)


def test_counting_asks_the_library_once_for_each_word():
    asked = []

    def encode(words):
        asked.extend(words)
        return [np.array(ids_of(w), np.uint32).tobytes() for w in words]

    words = wordwise.Wordwise(encode)
    given = [*texts(), "the end", "the  end", "x\x01y the", "the end\u3000 of", None]
    for _ in range(2):
        assert words.count(pa.array(given)).tolist() == [len(ids_of(t)) for t in given]
    assert asked.count("the") == asked.count(" end") == 1
    assert words.count(pa.array([], pa.string())).tolist() == []


def test_words_come_back_from_the_older_generation(monkeypatch):
    monkeypatch.setattr(wordwise, "KNOWN_WORDS", 5)
    asked = []

    def encode(words):
        asked.extend(words)
        return [np.array(ids_of(w), np.uint32).tobytes() for w in words]

    words = wordwise.Wordwise(encode)
    for text in ["the a b c", "the d e f", "the g h i", "the j k l"] * 2:
        starts, ids = words.encode(pa.array([text, None, "", f"x\x01y {text}"]))
        assert ids.tolist() == [*ids_of(text), *ids_of(f"x\x01y {text}")] and starts[1] == starts[2] == starts[3]
        assert len(words.known) <= 12
    assert asked.count("the") == 1  # met in every batch, so never forgotten
    assert words.encode(pa.array([], pa.string()))[0].tolist() == [0]


def test_known_words_stay_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 50)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 1000)
    monkeypatch.setattr(bpe, "SPACED_WORDS", 60, raising=False)
    codec = bpe.Codec(PATH)
    for k in range(40):  # every block brings about 100 words, more than half of what may stay
        given = [" ".join(f"{chr(97 + k % 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}xq{'y' * (k // 26)}" for j in range(110))] * 2
        starts, ids = codec.encode_column(pa.array(given))
        assert ids[starts[1] :].tolist() == ids_of(given[1])
        assert len(codec.known) <= 50 + 2 * 110
        assert len(codec.wordwise.known) + len(codec.wordwise.older) <= 2 * (60 + 110)


def test_decoding_of_broken_ids(spark):
    rows = spark.createDataFrame([(1, [0, 999999, 1]), (2, None), (3, [bpe.codec(PATH).single[0xC3]])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(rows, PATH).collect()} == {1: '!"', 2: "", 3: "�"}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts(docs, name):
    path = public_tokenizers.path(name)
    given = texts()[:60]
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [len(model.encode(t or "")) for t in given]
    else:
        library = Tokenizer.from_file(path)
        library.no_truncation()
        want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in given]
    for r in tokenization.count_tokens(docs(*given, extra="n_tokens"), path).collect():
        text = given[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), want[r["doc_id"]], want[r["doc_id"]] > 512)
    assert tokenization.count_tokens(docs("a").limit(0), path).count() == 0


def test_pieces_join_to_the_text():
    text = "ab  cd  e\tf " * 500
    cut = list(tokenization.pieces(text, 100))
    assert "".join(cut) == text
    assert len(cut) > 20
    assert sum(len(ids_of(p)) for p in cut) == len(ids_of(text))


def test_store_reads_back_what_was_written(docs, tmp_path):
    given = texts()[:80]
    frame = docs(*given, extra="start").unionByName(docs((None, "no id"), (3, "again"), extra="start"))
    folder = str(tmp_path / "store")
    shards = token_store.write_store(frame, folder, PATH, 2, shard_bytes=4000)
    assert shards.count() > 3
    order = [(None, "no id")]
    for i, t in enumerate(given):
        order += [(i, t)] + ([(3, "again")] if i == 3 else [])
    order.sort(key=lambda x: (-1 if x[0] is None else x[0], x[1] or ""))
    got = sorted(token_store.ids_crc32(token_store.read_store(shards, folder)).collect(), key=lambda r: r["start"])
    start = 0
    for r, (i, t) in zip(got, order, strict=True):
        want = np.array([*ids_of(t), 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    found = token_store.lookup(shards, folder, [5, 12, 10**9])
    assert set(found) == {5, 12}
    assert found[12].tolist() == [*ids_of(given[12]), 2]
    empty = token_store.write_store(docs("a").limit(0), str(tmp_path / "none"), PATH, 2)
    assert token_store.read_store(empty, str(tmp_path / "none")).count() == 0


def test_index_is_minimal_and_perfect():
    ids = np.arange(5000, dtype=np.int64) * 37
    keys = token_store.hashed_keys(ids, np.zeros(5000, np.int64))
    index = token_store.Index.load(token_store.build_index(keys, ids, ids).dump())
    assert sorted(index.slots(keys).tolist()) == list(range(5000))
    assert (index.offsets[index.slots(keys)] == ids).all()
    absent = token_store.hashed_keys(ids + 1, np.zeros(5000, np.int64))
    assert (index.slots(absent) >= 0).sum() == 0


def test_batches_of_texts_are_bounded_by_bytes(spark):
    long_texts = spark.range(40, numPartitions=1).select(F.repeat(F.lit("word "), 100_000).alias("text"))

    def per_batch(batch):
        return pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    sizes = [r["n"] for r in map_batches(long_texts, per_batch, "n long", 1 << 30).collect()]
    assert sum(sizes) >= 20_000_000 and max(sizes) <= BATCH_BYTES + 600_000


def test_a_worker_lets_go_of_the_tables_of_the_operator_before(docs):
    def held(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([bpe.codec.cache_info().currsize] * batch.num_rows, pa.int64())], ["held"])

    rows = docs(*[f"some words {i}" for i in range(40)])
    assert len(bpe.encode(rows, PATH).collect()) == 40
    assert {r["held"] for r in map_batches(rows, held, "held long").collect()} == {0}


def test_an_operator_keeps_its_own_tables():
    own = bpe.codec(PATH)
    let_go(bpe.codec)
    assert bpe.codec(PATH) is own
    let_go()
    assert bpe.codec.cache_info().currsize == 0
