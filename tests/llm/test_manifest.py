"""Merkle manifest, whitening and URL filters against direct evaluation."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandspark.llm import charpoly, merkle, queries, url_filters, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def direct_leaf(row, text):
    fields = [row[0], row[3], row[2], row[4], text]
    return digest(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def direct_tree(leaves, arity):
    """Root, and per leaf its steps of left and right siblings."""
    at, steps, nodes = list(range(len(leaves))), [[] for _ in leaves], leaves
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // arity * arity : (i // arity + 1) * arity]
            steps[k].append(("".join(run[: i % arity]), "".join(run[i % arity + 1 :])))
        at = [i // arity for i in at]
        nodes = [digest(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
    return nodes[0], steps


def direct_manifest(rows, arity):
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0] is not None, r[0] or 0, direct_leaf(r, r[1]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [direct_tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], arity) for s in names]
    root, tops = direct_tree([t[0] for t in trees], arity)
    out = []
    for name, (subroot, steps), top in zip(names, trees, tops, strict=True):
        for x, own in zip(sorted(groups[name], key=lambda x: x[:3]), steps, strict=True):
            proof = own + top
            r, h = x[3], x[2]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None:
                h = direct_leaf(r, r[1].replace("\n", ""))
            for left, right in proof:
                h = digest(left, h, right)
            out.append((r[0], x[2], subroot, root, digest(*(a + b for a, b in proof)), h, h == root))
    return sorted(out, key=str)


def some_rows(count):
    rng = random.Random(count)
    texts = [None, "", "a", "line\nline", "é\n", "x" * 70_000 + "\n"]
    sources = [None, "", "a", "B", "é", *["hot"] * 5]
    rows = [(i, rng.choice(texts), rng.choice([None, "en"]), rng.choice(sources), rng.choice([None, i])) for i in range(count)]
    return rows + [(None, "a", None, "hot", 1), (2, "other", "en", "hot", 2), (2, "other", "en", "hot", 2), (900, "b\n", "en", "alone", 3)]


@pytest.mark.parametrize("count", [0, 40, 130])
def test_manifest_matches_direct_trees(spark, tmp_path, count):
    rows = some_rows(count)
    spark.createDataFrame([r + (9,) for r in rows], DOCS + ", position int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_merkle(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == direct_manifest(rows, 3)


def test_binary_trees_and_single_rows(spark):
    rows = some_rows(30)
    frame = spark.createDataFrame(rows, DOCS)
    got = merkle.manifest(frame, arity=2).select("doc_id", *[merkle.shown(F.col(c)) for c in ("leaf", "root")], F.sha2(merkle.proof_text(F.col("proof")), 256))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(r[0], r[1], r[3], r[4]) for r in direct_manifest(rows, 2)], key=str)
    one = merkle.manifest(frame.filter("doc_id = 900")).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof"] == []
    assert merkle.manifest(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(frame, arity=1)


def embedded(spark, rows, extra=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>" + extra).repartition(3)


def test_whitening_matches_eigenvectors(spark):
    rng = np.random.default_rng(3)
    dimension = 20
    vectors = rng.normal(size=(300, dimension)) * np.linspace(0.3, 3, dimension) @ rng.normal(size=(dimension, dimension))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    good = rows + [(None, rows[0][1]), *[(700, rows[1][1])] * 40]
    nan, inf = float("nan"), float("inf")
    bad = [(500, None), (501, [None] + rows[2][1][1:]), (502, [nan] + rows[2][1][1:]), (503, [inf] + rows[2][1][1:]), (504, []), (505, [1.0])]
    frame = embedded(spark, [(*r, 1) for r in good + bad], ", component int")
    got = whitening.whiten(frame).collect()
    assert len(got) == len(good) * 16 and {r["n"] for r in got} == {300}
    x = np.floor(64 * vectors).astype(object).astype(int) + 1_000_000
    sums = x.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    want = (x - sums / 300) @ axes[:, :16] / np.sqrt(values[:16])
    own = {(r["vec_id"], r["component"]): r for r in got if r["vec_id"] is not None}
    seen = np.array([[own[i, c + 1]["whitened"] for c in range(16)] for i in range(300)])
    assert np.allclose(np.abs(seen), np.abs(want), rtol=1e-6, atol=1e-6)
    signs = np.sign(seen * want).sum(axis=0)
    assert (np.abs(signs) == 300).all()  # one sign a component
    for i in range(300):
        assert own[i, 1]["deviation"] == sum((300 * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums, strict=True))
    assert np.allclose([own[0, c + 1]["explained"] for c in range(16)], values[:16] / values.sum(), rtol=1e-9)
    assert max(r["identity_error"] for r in got) < 1e-9


def test_whitening_of_poor_and_extreme_tables(spark):
    schema = whitening.whiten(embedded(spark, [])).schema.names
    assert schema == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(embedded(spark, [(1, [1.0, 2.0])] * 3)).count() == 0  # one distinct vector
    assert whitening.whiten(embedded(spark, [(1, None), (2, [])])).count() == 0
    line = whitening.whiten(embedded(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(4)])).collect()
    assert {r["component"] for r in line} == {1} and max(r["identity_error"] for r in line) < 1e-12
    square = [(i, [a, b]) for i, (a, b) in enumerate([(1.0, 1.0), (1.0, -1.0), (-1.0, 1.0), (-1.0, -1.0)])]  # equal eigenvalues
    both = whitening.whiten(embedded(spark, square)).collect()
    assert len(both) == 8 and {round(r["explained"], 12) for r in both} == {0.5} and max(r["identity_error"] for r in both) < 1e-12
    far = whitening.whiten(embedded(spark, [(0, [1e12, 0.0]), (1, [-1e12, 1.0]), (2, [0.0, 2.0]), (3, [1e300, 1.0])])).collect()
    by = {(r["vec_id"], r["component"]): r for r in far}
    assert by[3, 1]["deviation"] is None and len(far) == 8 and max(r["identity_error"] for r in far) < 1e-6


def test_characteristic_polynomial_and_multiple_roots():
    matrix = [[2, 0, 0, 1], [0, 3, 0, 0], [0, 0, 3, 0], [1, 0, 0, 2]]  # roots 1, 3, 3, 3
    found = charpoly.primes(2 * charpoly.coefficient_bound(10, 4))
    poly = charpoly.remaindered((p, charpoly.polynomial_mod(np.array(matrix) % p, p)) for p in found)
    assert poly == [27, -54, 36, -10, 1]
    (three, bits, times), (one, _, single) = charpoly.largest_roots(poly, 10, 16)
    assert (times, single) == (3, 1) and abs(three / 2**bits - 3) < 1e-15 and abs(one / 2**bits - 1) < 1e-15
    space = charpoly.null_space(matrix, three, bits, 3)
    assert np.allclose(space @ np.array(matrix), 3 * space) and np.allclose(space @ space.T, np.eye(3))
    assert [n for n in range(2, 60) if charpoly._is_prime(n)] == [n for n in range(2, 60) if all(n % d for d in range(2, n))]


def direct_rule(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = rest[: min((rest.index(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [r for r in url_filters.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name), default=None)


URLS = [
    None, "", "no host", "http://", "HTTP://WWW.Example.COM/en/1?x=/fr/", "http://example.com/en/", "http://example.com/en", "http://a.example.com/EN/2",
    "http://example.com?q=/en/", "http://example.com#x://y.net/fr/", "ftp://a.net/es/1", "http://net/fr/2", "http://xnet/fr/2", "http://a.net/fr",
    "http://b.org/en/1", "x://ÉX.net/es/é", "a://b://c.net/fr/1", "http://a.net:80/fr/1", "http://long.org/" + "d/" * 3000 + "e\n", "http://com/\nx",
]


def test_rules_match_direct_version(spark):
    frame = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filters.judge(frame).collect()}
    assert len(got) == 2 * len(URLS)
    for i, url in enumerate(URLS * 2):
        host, path, rule = direct_rule(url)
        want = (host, path, rule and rule.name, rule.verdict if rule else "allow")
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == want, url
    assert url_filters.judge(frame.limit(0)).count() == 0


def test_templates_pass_on_what_rules_say(spark):
    rules = [url_filters.Rule("block", "h.org", "/user/1"), url_filters.Rule("allow", "h.org", "/news/a"), url_filters.Rule("block", "h.org", "/x/1")]
    urls = [f"http://h.org/user/1{i}/post" for i in range(60)] + [f"http://h.org/news/a{i}" for i in range(60)]  # labelled
    urls += [f"http://h.org/x/1{i}" for i in range(3)]  # too few to reject
    urls += ["http://h.org/user/77/post", "http://h.org/user/77/pics", "http://h.org/news/b7", "http://h.org/x/7", "http://g.org/user/77/post"]
    urls += [f"http://w.org/{'abcdefghijklmnopqrstuvwxyz'[i % 26]}q/{i}" for i in range(52)]  # too many names below one node
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [r["verdict"] for r in sorted(url_filters.judge(frame, rules).collect(), key=lambda r: r["page_id"])]
    assert got[:123] == ["block"] * 60 + ["allow"] * 60 + ["block"] * 3
    assert got[123:128] == ["block", "allow", "allow", "allow", "allow"]
    assert set(got[128:]) == {"allow"}


def test_similar_branches_merge(spark):
    rows = [("h", [s, "*"], n, b) for s, n, b in (("a", 10, 10), ("b", 12, 12), ("c", 50, 2), ("d", 0, 0))]
    rows += [("w", [f"{chr(97 + i)}", "x"], i % 2, 0) for i in range(20)]
    frame = spark.createDataFrame(rows, "host string, segments array<string>, labelled long, blocked long")
    got = {(r["host"], r["segments"][0]): r["node"] for r in url_filters.templates(frame).collect()}
    assert [got["h", s] for s in "abcd"] == ["/a|b/*", "/a|b/*", "/c/*", "/d/*"]
    assert {v for (host, _), v in got.items() if host == "w"} == {"/*/x"}
