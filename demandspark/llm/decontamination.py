"""Benchmark decontamination: training documents that hold test items.

Method: a BM25 inverted index of the test items, queried by every passage of every document with block-max pruning.

* *Passages.* A document is cut into windows of twice the longest item's words, one item length apart, so each place an
  item can stand lies wholly in a window.
* *Index.* Each term has its postings, ordered by item: the item and the BM25 weight of the term in it. Items lie in blocks,
  and each run of postings of one block has its greatest weight. Terms that an item lacks take no room.
* *Block-max WAND.* The greatest weights of a passage's terms in a block bound its score with any item of the block. Blocks
  that can't reach their least threshold are skipped, and only the postings in the others are added up item by item. Many
  passages are evaluated side by side, in bounded steps. All above threshold are kept: there is no k.
* *Threshold.* An item whose word shingles are found to 80 % keeps all but a few of its words. Its threshold is its score
  with itself less the greatest weights it could lose that way, so no such item is missed.
* *Verification.* A match counts when the passage holds ``percent`` % of the item's distinct word shingles, and some of
  both its question (all words but the last quarter) and its answer (the last quarter).

Words are runs of letters and digits, lower-cased for A-Z, other ASCII characters separate them. Statistics come from all
items. The index of one pass is bounded by ``index_bytes`` of item text; more items take further passes over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.llm.common import map_batches, text_bytes
from demandspark.llm.shingles import U64, mix, separators, text_blocks, word_hashes

WORDS = 5
PERCENT = 80
K1, B = 1.2, 0.75
BLOCK_ITEMS = 8
INDEX_BYTES = 256 << 10
BLOCK_BYTES = 1 << 18
# Runs of postings, or postings, that are looked at in one step.
STEP_POSTINGS = 1 << 20
_WORD = separators(b"".join(bytes([c]) for c in range(128) if not bytes([c]).isalnum()))


def rolled(hashes: np.ndarray, words: int) -> np.ndarray:
    """Hashes of all runs of ``words`` words."""
    n = max(0, len(hashes) - words + 1)
    out = np.zeros(n, dtype=U64)
    with np.errstate(over="ignore"):
        for k in range(words):
            out = out * U64(0x2545F4914F6CDD1D) + hashes[k : k + n]
        return mix(out)


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places start, start + 1, … of each of several runs, one run after another."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _steps(cost: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Neighbouring places in steps of about ``limit`` of their cost, one place at least."""
    total = np.concatenate([[0], np.cumsum(cost)])
    at = 0
    while at < len(cost):
        until = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        yield at, until
        at = until


@dataclass
class Item:
    item_ids: list[int]
    length: int
    run: int  # words of a shingle: fewer where the item is shorter
    question: np.ndarray  # sorted distinct shingles
    answer: np.ndarray
    both: np.ndarray


@dataclass
class BenchmarkIndex:
    """Inverted index of a bounded part of the test items."""

    items: list[Item]
    terms: np.ndarray  # sorted word hashes
    post_item: np.ndarray  # postings by term, then item
    post_weight: np.ndarray
    run_until: np.ndarray  # a run is the postings of one term in one block: runs end here, after those before
    run_block: np.ndarray
    run_max: np.ndarray
    term_until: np.ndarray  # runs of a term end here
    thresholds: np.ndarray
    block_thresholds: np.ndarray
    window: int

    @staticmethod
    def build(texts: list[tuple[list[int], bytes]], count: int, mean_length: float, frequency: dict[int, int], words: int, percent: int) -> BenchmarkIndex:
        hashes, until = word_hashes([t for _, t in texts], _WORD) if texts else (np.empty(0, U64), [])
        own = np.split(hashes, until[:-1]) if texts else []
        kept = [(ids, h) for (ids, _), h in zip(texts, own, strict=True) if len(h)]
        terms = np.unique(hashes)
        df = np.array([frequency[int(t)] for t in terms.view(np.int64)], float)
        idf = np.log1p((count - df + 0.5) / (df + 0.5))
        thresholds = np.zeros(len(kept))
        items, posted, weights = [], [], []
        for row, (ids, h) in enumerate(kept):
            at, tf = np.unique(np.searchsorted(terms, h), return_counts=True)
            weight = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(h) / mean_length))
            posted.append(at)
            weights.append(weight)
            run = min(words, len(h))
            shingles = rolled(h, run)
            cut = max(1, len(h) - max(1, len(h) // 4) - run + 1)  # shingles from here on reach into the answer
            answer = shingles[cut - 1 :] if len(shingles) == 1 else shingles[cut:]
            items.append(Item(ids, len(h), run, np.unique(shingles[:cut]), np.unique(answer), np.unique(shingles)))
            lost = len(shingles) - -(-len(items[-1].both) * percent // 100)  # a word is lost only with all its shingles
            best = np.sort(weight)[::-1]
            thresholds[row] = max(0.0, float(best.sum() - best[: max(0, lost)].sum())) * (1 - 1e-4)
        term = np.concatenate([*posted, np.empty(0, np.int64)])
        item = np.repeat(np.arange(len(kept)), [len(p) for p in posted])
        order = np.lexsort((item, term))
        term, item, weight = term[order], item[order], np.concatenate([*weights, np.empty(0)])[order]
        starts = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(item // BLOCK_ITEMS, prepend=-1) != 0))
        return BenchmarkIndex(
            items, terms, item, weight,
            run_until=np.append(starts[1:], len(term)),
            run_block=item[starts] // BLOCK_ITEMS,
            run_max=np.maximum.reduceat(weight, starts) if len(starts) else np.empty(0),
            term_until=np.searchsorted(term[starts], np.arange(len(terms)), side="right"),
            thresholds=thresholds,
            block_thresholds=np.minimum.reduceat(thresholds, np.arange(0, len(kept), BLOCK_ITEMS)) if kept else np.empty(0),
            window=max([i.length for i in items], default=1),
        )

    def candidates(self, hashes: np.ndarray, until: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, first word of the passage, row of the item) of all passages that reach an item's threshold."""
        if not len(hashes) or not self.items:
            return
        # Words outside the index end here; the others become entries (passage, term), each once.
        term = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[term] == hashes)
        text = np.searchsorted(until, known, side="right")
        begin = np.concatenate([[0], until[:-1]])
        step = (known - begin[text]) // self.window  # the word is in the windows that start at this step and one before
        steps = int(step.max(initial=0)) + 2
        second = step > 0
        passage = np.concatenate([text * steps + step, text[second] * steps + step[second] - 1])
        entry = np.unique(passage * len(self.terms) + np.concatenate([term[known], term[known][second]]))
        passage, term = entry // len(self.terms), entry % len(self.terms)
        first = np.flatnonzero(np.diff(passage, prepend=-1))
        ends = np.append(first[1:], len(passage))
        run_from = np.where(term > 0, self.term_until[term - 1], 0)
        runs = self.term_until[term] - run_from
        cost = np.add.reduceat(runs, first) if len(first) else first
        for a, b in _steps(cost, STEP_POSTINGS):
            entries = slice(first[a], ends[b - 1])
            run = _spread(run_from[entries], runs[entries])
            own = np.repeat(np.repeat(np.arange(b - a), ends[a:b] - first[a:b]), runs[entries])
            for k, row in self._reached(run, own, b - a):
                where = int(passage[first[a + k]])
                yield where // steps, (where % steps) * self.window, row

    def _reached(self, run: np.ndarray, own: np.ndarray, passages: int) -> Iterator[tuple[int, int]]:
        """(passage, row of the item) of the scores that reach a threshold, from the runs of the passages' terms."""
        blocks = len(self.block_thresholds)
        cell = own * blocks + self.run_block[run]
        bound = np.bincount(cell, self.run_max[run], passages * blocks).reshape(passages, blocks)
        may = (bound >= self.block_thresholds).ravel()[cell]
        run, own = run[may], own[may]
        run_from = np.where(run > 0, self.run_until[run - 1], 0)
        count = self.run_until[run] - run_from
        post = _spread(run_from, count)
        pair, at = np.unique(np.repeat(own, count) * len(self.items) + self.post_item[post], return_inverse=True)
        score = np.bincount(at, self.post_weight[post], len(pair))
        for found in pair[score >= self.thresholds[pair % len(self.items)]]:
            yield int(found) // len(self.items), int(found) % len(self.items)

    def verify(self, words: np.ndarray, row: int, percent: int) -> float | None:
        """The share of the item's shingles among the words, if it counts as a match."""
        item = self.items[row]
        there = rolled(words, item.run)
        share = np.count_nonzero(np.isin(item.both, there))
        if 100 * share < percent * len(item.both):
            return None
        if not np.isin(item.question, there).any() or not np.isin(item.answer, there).any():
            return None
        return share / len(item.both)

    def matches(self, texts: list[bytes], percent: int) -> list[dict[int, float]]:
        """For each text, the rows of the items it holds, with the greatest share found."""
        found: list[dict[int, float]] = [{} for _ in texts]
        for a, b in text_blocks(texts, BLOCK_BYTES):
            hashes, until = word_hashes(texts[a:b], _WORD)
            begin = np.concatenate([[0], until[:-1]])
            for text, start, row in self.candidates(hashes, until):
                at = int(begin[text]) + start
                share = self.verify(hashes[at : min(int(until[text]), at + 2 * self.window)], row, percent)
                if share is not None and share > found[a + text].get(row, 0.0):
                    found[a + text][row] = share
        return found


def _indexes(benchmark: DataFrame, words: int, percent: int, index_bytes: int) -> Iterator[BenchmarkIndex]:
    """Indexes that cover all items, each of at most about ``index_bytes`` of item text."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, until = word_hashes(text_bytes(batch["text"]), _WORD)
        split = [h.view(np.int64) for h in np.split(hashes, until[:-1])]
        return pa.RecordBatch.from_arrays([batch["key"], pa.array(split, pa.list_(pa.int64()))], ["key", "words"])

    labelled = benchmark.select(F.col("item_id").cast("long"), "text").filter("text is not null")
    items = labelled.groupBy("text").agg(F.collect_set("item_id").alias("item_ids")).withColumn("key", F.xxhash64("text"))
    worded = map_batches(items.select("key", "text"), per_batch, "key long, words array<long>").filter(F.size("words") > 0)
    count, mean_length = worded.agg(F.count("*"), F.avg(F.size("words"))).first()
    if not count:
        return
    total = items.agg(F.sum(F.octet_length("text"))).first()[0]
    parts = -(-total // index_bytes)
    frequency = worded.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    for part in range(parts):
        own = F.pmod("key", F.lit(parts)) == part
        texts = sorted((sorted(r["item_ids"]), r["text"].encode()) for r in items.filter(own).collect())  # about index_bytes
        near = worded.filter(own).select(F.explode("words").alias("word")).distinct()
        df = {r["word"]: r["df"] for r in frequency.join(near, "word", "left_semi").collect()}
        yield BenchmarkIndex.build(texts, count, float(mean_length), df, words, percent)


def contaminated(documents: DataFrame, benchmark: DataFrame, words: int = WORDS, percent: int = PERCENT, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row per row of ``documents``: doc_id, contaminated, item_ids (ascending), share (greatest of the matches, else 0).

    ``benchmark`` has item_id and text. Every distinct text with a word is an item, also where an item_id repeats with other
    texts; a document that holds an item whose rows have no item_id is contaminated, though ``item_ids`` has nothing to
    name. A null or empty document holds nothing. Repeated rows are looked at each; a text of any length is read whole;
    other columns are ignored; with either table empty no document is contaminated.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", "text", F.lit(None).cast("array<long>").alias("item_ids"), F.lit(0.0).alias("share"))
    for index in _indexes(benchmark, words, percent, index_bytes):
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def per_batch(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            found = shared.value.matches(text_bytes(batch["text"]), percent)
            items = shared.value.items
            ids = [sorted({*(old or []), *chain.from_iterable(items[row].item_ids for row in new)}) for old, new in zip(batch["item_ids"].to_pylist(), found, strict=True)]
            share = [max([old, *new.values()]) for old, new in zip(batch["share"].to_pylist(), found, strict=True)]
            return pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], pa.array(ids, pa.list_(pa.int64())), pa.array(share, pa.float64())], ["doc_id", "text", "item_ids", "share"])

        rows = map_batches(rows, per_batch, f"doc_id {kind}, text string, item_ids array<long>, share double")
    ids = F.coalesce("item_ids", F.array().cast("array<long>"))
    return rows.select("doc_id", (F.col("share") > 0).alias("contaminated"), ids.alias("item_ids"), "share")


def clean(documents: DataFrame, benchmark: DataFrame, words: int = WORDS, percent: int = PERCENT, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of ``documents``, with all their columns, that :func:`contaminated` finds clean.

    Each row is judged by its own text where it is read, without a join, so null and repeated doc_ids need no rule.
    """
    for index in _indexes(benchmark, words, percent, index_bytes):
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def per_batch(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            found = shared.value.matches(text_bytes(batch["text"]), percent)
            return batch.filter(pa.array([not f for f in found], pa.bool_()))

        documents = map_batches(documents, per_batch, documents.schema)
    return documents
