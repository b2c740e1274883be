"""Jaccard join, exact dedup and decontamination against direct evaluation."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from demandspark.llm import decontamination, exact_dedup, jaccard_join
from demandspark.llm.common import components
from demandspark.llm.shingles import shingle_sets


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def shingles(text, n):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def direct_components(texts: dict[int, str | None], n: int, percent: int) -> dict[int, int]:
    sets = {i: shingles(t, n) for i, t in texts.items()}
    label = {i: i for i in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def edited(rng, words, share):
    return [rng.choice("abcdefgh") + str(rng.randint(0, 99)) if rng.random() < share else w for w in words]


def corpus(seed: int) -> list[str | None]:
    rng = random.Random(seed)
    vocabulary = ["w" + str(i) for i in range(300)]
    texts: list[str | None] = [None, "", "  \t ", "one", "One", "one two three", "ONE two\nthree", "É é", "é É"]
    shared = rng.choices(vocabulary, k=25)
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([5, 9, 20, 60, 200, 900]))
        for _ in range(rng.randint(1, 9)):
            copy = edited(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.03]))
            texts.append(" ".join(copy + (shared if rng.random() < 0.5 else [])))
    return texts + texts[-3:]


@pytest.mark.parametrize(("words", "percent", "seed"), [(4, 85, 1), (5, 80, 2)])
def test_components_match_all_pairs(docs, words, percent, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", 3)  # so that open tiles fall into several blocks
    monkeypatch.setattr(jaccard_join, "TILE_MEMBERS", 3)
    texts = corpus(seed)
    got = {r["doc_id"]: r for r in jaccard_join.jaccard_groups(docs(*texts), words, percent).collect()}
    want = direct_components(dict(enumerate(texts)), words, percent)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(shingles(t, words)) for i, t in enumerate(texts)}


def test_every_link_is_counted_and_listed(docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", 3)
    monkeypatch.setattr(jaccard_join, "TILE_MEMBERS", 3)
    monkeypatch.setattr(jaccard_join, "SLICE_SHINGLES", 16)
    base = " ".join(f"t{i}" for i in range(60))
    close = [base + f" end{i}" for i in range(3)]  # three different texts that all link with each other
    texts = corpus(3) + [*close, close[0]]
    frame = docs(*texts)
    frame = frame.unionByName(frame.filter(f"doc_id = {len(texts) - 2}"))  # a repeated row counts once
    sets = {i: shingles(t, 4) for i, t in enumerate(texts)}

    def linked(a, b):
        common = len(sets[a] & sets[b])
        return a != b and common > 0 and 100 * common >= 85 * len(sets[a] | sets[b])

    want = {a: sum(linked(a, b) for b in sets) for a in sets}
    rows = jaccard_join.jaccard_counts(frame, 4, 85).collect()
    assert {r["doc_id"]: r["n_links"] for r in rows} == want and len(rows) == len(texts)
    assert [want[len(texts) - k] for k in (1, 2, 3, 4)] == [3, 3, 3, 3]
    least = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets if sets[i]}
    pairs = {(a, b) for a in set(least.values()) for b in set(least.values()) if a < b and linked(a, b)}
    found = [tuple(r) for r in jaccard_join.jaccard_links(frame, 4, 85).collect()]
    assert sorted(found) == sorted(pairs)


def test_signatures_of_linked_sets_meet():
    rng = np.random.default_rng(5)
    for percent in (80, 85):
        bands = jaccard_join.Bands(percent)
        for n in (1, 2, 5, 7, 12, 40, 130, 700):
            for _ in range(20):
                a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
                low = -(-len(a) * percent // 100)
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[:low]], np.empty(0, np.uint64)]))
                assert jaccard_join.reaches(jaccard_join.overlap(a, b), len(a), len(b), percent)
                assert set(jaccard_join.signatures(a, bands).tolist()) & set(jaccard_join.signatures(b, bands).tolist())


def test_bit_counts_bound_the_overlap():
    rng = np.random.default_rng(6)
    for _ in range(200):
        pool = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
        a, b = (np.sort(rng.choice(pool, rng.integers(1, 250), replace=False)) for _ in range(2))
        maps = [jaccard_join.bitmap(s, jaccard_join.bitmap_bits(len(s))) for s in (a, b)]
        assert jaccard_join.overlap(a, b) == len(np.intersect1d(a, b))
        assert jaccard_join.overlap_bound(len(a), len(b), *maps) >= jaccard_join.overlap(a, b)


def test_common_bits_of_wide_bitmaps():
    rng = np.random.default_rng(5)
    left, right = (rng.integers(0, 256, (k, 3 * jaccard_join.SLICE_BITS // 8 + 8), dtype=np.uint8) for k in (5, 7))
    direct = [[int(np.bitwise_count(a & b).sum()) for b in right] for a in left]
    assert jaccard_join._common_bits(left, right).tolist() == direct


def test_shingle_counts_across_blocks():
    texts = ["a b c d e f", None, "", "x" * 3_000_000 + " y", "B a b A"] * 2
    assert [len(s) for s in shingle_sets([(t or "").encode() for t in texts], 4)] == [3, 0, 0, 1, 1] * 2


def test_join_of_empty_table_and_extra_columns(docs):
    assert jaccard_join.jaccard_groups(docs("a").limit(0)).count() == 0
    rows = jaccard_join.jaccard_groups(docs("a b", "a b", extra="component_id"), 4, 85).collect()
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {(0, 0), (1, 0)}


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def test_exact_groups(docs):
    long = "p" * 500
    texts = ["a", "b", "a", None, "", long + "1", long + "2", long + "1", "A", "é"]
    frame = docs(*texts, extra="length").unionByName(docs((None, "a"), (2, "a"), extra="length"))
    groups = defaultdict(list)
    for i, t in [*enumerate(texts), (None, "a"), (2, "a")]:
        groups[t or ""].append(i)
    want = sorted(
        ((-1 if i is None else i), keep, len(ids), i == keep)
        for ids in groups.values()
        for keep in [max(x for x in ids if x is not None)]
        for i in ids
    )
    got = sorted((-1 if r[0] is None else r[0], r[1], r[2], r[3]) for r in exact_dedup.exact_groups(frame, 8).collect())
    assert got == want
    assert exact_dedup.exact_groups(docs("a").limit(0)).count() == 0


def test_exact_groups_keep_rows_without_or_with_one_id(docs, tmp_path):
    import hashlib

    from demandspark.llm import queries

    rows = [(None, "a"), (None, "b"), (1, "a"), (2, "c"), (2, "d"), (3, None), (4, "c")]
    docs(*rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r["doc_id"], r["text_sha256"]) for r in queries.op4_exact_dedup(docs("x").sparkSession, str(tmp_path)).collect()]
    want = [(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_contaminated_matches_containment(spark, docs):
    rng = random.Random(4)
    vocabulary = ["v" + str(i) for i in range(80)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([2, 4, 6, 15, 40])))) for i in range(30)]
    texts: list[str | None] = [None, "", "the end"]
    for _ in range(60):
        body = rng.choices(vocabulary, k=rng.randint(0, 300))
        if rng.random() < 0.7:
            item = edited(rng, rng.choice(items)[1].split(), rng.choice([0, 0.02, 0.06]))
            at = rng.randint(0, len(body))
            body[at:at] = [w.upper() for w in item]
        texts.append(", ".join(body))
    benchmark = spark.createDataFrame([*items, (90, None), (91, " "), (None, "x y")], "item_id long, text string")
    got = {r["doc_id"]: set(r["item_ids"]) for r in decontamination.contaminated(docs(*texts, extra="item_id"), benchmark, index_bytes=900).collect()}

    def grams(text, n):
        w = re.findall("[a-z0-9]+", text.lower())
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    for i, text in enumerate(texts):
        want = set()
        for item_id, item in items:
            n = min(5, len(item.split()))
            own = grams(item, n)
            if own and 100 * len(own & grams(text or "", n)) >= 80 * len(own):
                want.add(item_id)
        assert got[i] <= want
        # A match has to lie within one passage and to touch question and answer; both hold for whole items.
        assert got[i] >= {k for k, item in items if item in " ".join(re.findall("[a-z0-9]+", (text or "").lower()))}
    assert decontamination.contaminated(docs("a"), benchmark.limit(0)).first()["contaminated"] is False
    assert decontamination.contaminated(docs("a").limit(0), benchmark).count() == 0


def test_contaminated_as_every_passage_says(spark, docs):
    """Both directions, with items kept in part, and no part of the index involved."""
    rng = random.Random(11)
    vocabulary = ["v" + str(i) for i in range(50)]
    items = [rng.choices(vocabulary, k=rng.choice([1, 3, 5, 6, 12, 20, 40])) for _ in range(25)] + [["same"] * 9, ["one", "two"] * 6]
    texts = []
    for _ in range(150):
        body = rng.choices(vocabulary, k=rng.randint(0, 150))
        for _ in range(rng.randint(0, 2)):
            item = list(rng.choice(items))
            for _ in range(rng.randint(0, 2)):  # the longer ones are kept to 75 to 100 %
                if len(item) > 1:
                    item[rng.randrange(len(item))] = "other"
            at = rng.randint(0, len(body))
            body[at:at] = item
        texts.append(" ".join(body))
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: (r["contaminated"], r["item_ids"], r["share"]) for r in decontamination.contaminated(docs(*texts), benchmark).collect()}
    window = max(map(len, items))

    def grams(words, n):
        return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]

    partly = 0
    for i, text in enumerate(texts):
        words, want = text.split(), {}
        for k, item in enumerate(items):
            n = min(5, len(item))
            own, tail = grams(item, n), max(1, len(item) // 4)
            cut = max(1, len(item) - tail - n + 1)
            question, answer = set(own[:cut]), set(own[cut:] if len(own) > 1 else own)
            for start in range(0, len(words), window):
                there = set(grams(words[start : start + 2 * window], n))
                share = len(set(own) & there) / len(set(own))
                if 100 * len(set(own) & there) >= 80 * len(set(own)) and question & there and answer & there:
                    want[k] = max(want.get(k, 0), share)
        partly += any(share < 1 for share in want.values())
        assert got[i] == (bool(want), sorted(want), max(want.values(), default=0.0))
    assert partly > 5


def test_items_of_one_id_or_none_all_count(spark, docs):
    first, second, third = ("alpha beta gamma delta eps zeta", "un deux trois quatre cinq six", "eins zwei drei vier fuenf sechs")
    benchmark = spark.createDataFrame([(7, first), (7, second), (None, third), (8, second), (8, second)], "item_id long, text string")
    frame = docs("x " + first, "y " + second + " z", third, "none of them", (None, first), (3, "more " + third), extra="item_ids")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["contaminated"], r["item_ids"]) for r in decontamination.contaminated(frame, benchmark).collect())
    want = [(-1, True, [7]), (0, True, [7]), (1, True, [7, 8]), (2, True, []), (3, False, []), (3, True, [])]
    assert got == want
    left = decontamination.clean(frame, benchmark, index_bytes=40)
    assert left.columns == frame.columns
    assert [(r["doc_id"], r["text"]) for r in left.collect()] == [(3, "none of them")]
    assert decontamination.clean(frame, benchmark.limit(0)).count() == frame.count()
