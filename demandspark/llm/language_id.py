"""Language identification: averaged embeddings of hashed subwords under a linear softmax, with calibrated rejection.

Subwords are byte n-grams of the lower-cased text, hashed to rows of an embedding table. The mean of a text's rows goes
through a softmax; both are trained by stochastic gradient descent in numpy on a bounded sample of labelled snippets.
Since the softmax layer is linear, a text is scored by the mean of per-subword class scores, which the executors get as
one table of buckets x languages.

Rejection looks at how usual a text's subwords are, whatever the language: one more column holds the logarithm of each
bucket's share of the training subwords. On snippets kept apart, cut to several lengths, the least usual ones set a floor
for each length at a fixed rate of false rejections. Labels play no part in it, so wrong ones can't move it. The
temperature of the softmax is set on the same snippets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demandspark.llm.common import map_batches, text_bytes
from demandspark.llm.shingles import U64, text_blocks

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 15
WIDTH = 24
# The fit's bound: labelled snippets of a language, and characters of a snippet.
SNIPPETS = 600
SNIPPET_CHARS = 300
EPOCHS = 8
BLOCK_BYTES = 1 << 17
BATCH = 16
# Share of the snippets of the learned languages that calibration may reject, the bytes they are cut to for it, and how many
# of a length it takes to set a floor.
FALSE_REJECTIONS = 0.002
CUTS = (24, 48, 96, 192, 1 << 20)
LEAST_SNIPPETS = 40
LETTERS = "__has_letters"  # a name that no column of the input has

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


def subwords(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and the number of them up to the end of each text; none cross texts."""
    raw = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    length = np.array([len(t) for t in texts])
    ends = np.cumsum(length + 1) - 1
    n = len(raw)
    found = np.empty((n, len(ORDERS)), dtype=np.int32)
    inside = np.zeros((n, len(ORDERS)), dtype=bool)
    left = np.repeat(ends, length + 1) - np.arange(n)  # bytes from here to the end of the text
    code = np.zeros(n, dtype=U64)
    with np.errstate(over="ignore"):
        for k in range(max(ORDERS)):
            code[: n - k] = (code[: n - k] + raw[k:].astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)
            if k + 1 in ORDERS:
                j = ORDERS.index(k + 1)
                found[:, j] = ((code ^ (code >> U64(29))) * U64(0xBF58476D1CE4E5B9) >> U64(40)).astype(np.int64) % BUCKETS
                inside[:, j] = left >= k + 1
    return found[inside], np.cumsum(inside.sum(axis=1))[ends]


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    table: np.ndarray  # buckets x (languages: embedding times softmax weights; then how usual the bucket is)
    bias: np.ndarray
    temperature: float
    floors: tuple[float, ...]  # by the number of binary digits of a text's number of subwords

    def _means(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Mean of the table's rows of each text, and its number of subwords; without any the mean is zero."""
        out, counts = np.empty((len(texts), self.table.shape[1])), np.empty(len(texts), np.int64)
        for a, b in text_blocks(texts, BLOCK_BYTES):
            found, until = subwords(texts[a:b])
            start = np.concatenate([[0], until[:-1]])
            # One spare row of zeros, so that a text without subwords at the end has a place to start.
            rows = np.concatenate([self.table[found], np.zeros((1, self.table.shape[1]), np.float32)])
            sums = np.add.reduceat(rows, start, axis=0, dtype=np.float64)
            counts[a:b] = until - start
            out[a:b] = np.where(counts[a:b, None] > 0, sums, 0.0) / np.maximum(1, counts[a:b])[:, None]
        return out, counts

    def judge(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities, one row per text, and whether each text is usual enough to be in a learned language."""
        means, counts = self._means(texts)
        floors = np.array([*self.floors, *self.floors[-1:] * 64]) if self.floors else np.full(64, -np.inf)
        digits = np.frexp(counts.astype(np.float64))[1]
        return softmax((means[:, :-1] + self.bias) / self.temperature), means[:, -1] >= floors[digits]

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        return self.judge(texts)[0]


def _floors(model: LanguageModel, texts: list[bytes]) -> tuple[float, ...]:
    """Least usualness of texts of the learned languages, by the binary digits of their number of subwords."""
    cut = [t[:size] for t in texts for size in CUTS if size == CUTS[-1] or size < len(t)]
    means, counts = model._means(cut)
    digits, floors = np.frexp(counts.astype(np.float64))[1], []
    for d in range(int(digits.max(initial=0)) + 1):
        own = np.sort(means[digits == d, -1])
        floors.append(float(own[int(FALSE_REJECTIONS * len(own))]) if len(own) >= LEAST_SNIPPETS else -np.inf)
    while floors and floors[-1] == -np.inf:  # longer texts go by the longest that there were enough of
        floors.pop()
    return tuple(floors)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[bytes], labels: list[str], seed: int = 7) -> LanguageModel | None:
    """Fit on four fifths of the snippets, calibrate on the rest; None without any snippet."""
    if not texts:
        return None
    languages = tuple(sorted(set(labels)))
    y = np.array([languages.index(lang) for lang in labels])
    rng = np.random.default_rng(seed)
    held = np.arange(len(texts)) % 5 == 4
    embedding = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weights = np.zeros((WIDTH, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    weights += rng.normal(0, 0.1, weights.shape).astype(np.float32)
    found, until = subwords(texts)
    grams = np.split(found, until[:-1])
    own = np.array([i for i in np.flatnonzero(~held) if len(grams[i])], dtype=int)
    for epoch in range(EPOCHS):
        rate = 1.0 * (1 - epoch / EPOCHS)
        for at in range(0, len(own), BATCH):
            if at == 0:
                rng.shuffle(own)
            batch = own[at : at + BATCH]
            rows = np.concatenate([grams[i] for i in batch])
            sizes = np.array([len(grams[i]) for i in batch])
            starts = np.cumsum(sizes) - sizes
            mean = np.add.reduceat(embedding[rows], starts, axis=0) / sizes[:, None]
            error = softmax(mean @ weights + bias)
            error[np.arange(len(batch)), y[batch]] -= 1
            step = (error @ weights.T) / sizes[:, None]
            weights -= rate / len(batch) * (mean.T @ error)
            bias -= rate / len(batch) * error.sum(axis=0)
            # A bucket that a batch hits many times moves by the sum of its shares.
            hit, inverse = np.unique(rows, return_inverse=True)
            change = np.zeros((len(hit), WIDTH), np.float32)
            np.add.at(change, inverse, np.repeat(step, sizes, axis=0).astype(np.float32))
            embedding[hit] -= 10 * rate / len(batch) * change
    seen = np.bincount(np.concatenate([grams[i] for i in own] or [np.empty(0, np.int64)]), minlength=BUCKETS)
    usual = np.log((seen + 0.5) / (seen.sum() + 0.5 * BUCKETS)).astype(np.float32)
    table = np.concatenate([embedding @ weights, usual[:, None]], axis=1)
    raw = LanguageModel(languages, table, bias, 1.0, ())
    check = np.flatnonzero(held)
    if not len(check):
        return raw
    logits = np.log(raw.probabilities([texts[i] for i in check]) + 1e-12)
    grid = np.geomspace(0.1, 10, 41)
    loss = [-np.log(softmax(logits / t)[np.arange(len(check)), y[check]] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    return LanguageModel(languages, table, bias, temperature, _floors(raw, [texts[i] for i in check]))


def held_out() -> Column:
    """The quarter of the documents that is never learned from, by the CRC-32 of the id's text."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def sample(documents: DataFrame, snippets: int = SNIPPETS, chars: int = SNIPPET_CHARS) -> tuple[list[bytes], list[str]]:
    """At most ``snippets`` labelled snippets of each language, drawn by the hash of the id from the documents to learn from.

    Each is a stretch of at most ``chars`` characters at a place drawn by hash; this bound is the only cut, and only
    the fit has it.
    """
    labelled = documents.filter("lang is not null and text is not null and doc_id is not null").filter(~held_out())
    labelled = labelled.filter(F.col("text").rlike("\\p{L}"))
    counts = labelled.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return [], []
    # Rows whose draw is below four times the wanted share are enough to choose from, however many rows there are.
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, 4 * snippets / r["count"]))))
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length("text") - chars)).cast("int") + 1
    rows = labelled.withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))).filter(F.col("draw") / (1 << 40) < share[F.col("lang")])
    rows = rows.select("doc_id", "lang", F.substr("text", place, F.lit(chars)).alias("snippet"), "draw")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "snippet"))
    drawn = rows.withColumn("rank", rank).filter(F.col("rank") <= snippets).select("lang", "draw", "doc_id", "snippet").collect()
    drawn = sorted(drawn, key=lambda r: (r["draw"], r["doc_id"], r["snippet"]))
    return [r["snippet"].encode() for r in drawn], [r["lang"] for r in drawn]


def fit(documents: DataFrame, snippets: int = SNIPPETS) -> LanguageModel | None:
    """The model of the labelled documents outside the held-out quarter."""
    return train(*sample(documents, snippets))


def _has_letters() -> Column:
    return F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))


def identify(documents: DataFrame, model: LanguageModel | None) -> DataFrame:
    """One row per row of ``documents``: doc_id, held_out, lang_pred, score, rejected.

    The whole text is scored; neither lang nor source nor doc_id is looked at. ``lang_pred`` is ``und`` with score 0 if
    the text is null or has no letter, or if there was nothing to learn from. ``rejected`` holds for those and for
    texts whose subwords are less usual than the calibrated floor of their length. Texts of any length are scored whole, in
    blocks. Repeated rows are scored each; other columns are ignored; a null doc_id is not held out; an empty table gives
    an empty result.
    """

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        letters = np.array(batch[LETTERS].to_pylist(), dtype=bool)
        languages, scores, turned_down = ["und"] * len(letters), np.zeros(len(letters)), np.ones(len(letters), dtype=bool)
        own = np.flatnonzero(letters)
        if model is not None and len(own):
            texts = text_bytes(batch["text"])
            chance, usual = model.judge([texts[i] for i in own])
            best = chance.argmax(axis=1)
            scores[own] = chance[np.arange(len(own)), best]
            turned_down[own] = ~usual
            for i, b in zip(own.tolist(), best.tolist(), strict=True):
                languages[i] = model.languages[b]
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["held_out"], pa.array(languages), pa.array(scores), pa.array(turned_down)],
            ["doc_id", "held_out", "lang_pred", "score", "rejected"],
        )

    rows = documents.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), _has_letters().alias(LETTERS), "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, per_batch, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(documents: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The rows of ``documents``, with all their columns, that :func:`identify` doesn't reject; without a model none."""
    columns = documents.columns

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.array(batch[LETTERS].to_pylist(), dtype=bool)
        own = np.flatnonzero(keep)
        if model is None:
            keep[:] = False
        elif len(own):
            texts = text_bytes(batch["text"])
            keep[own] = model.judge([texts[i] for i in own])[1]
        return batch.select(columns).filter(pa.array(keep))

    return map_batches(documents.withColumn(LETTERS, _has_letters()), per_batch, documents.schema)
