"""Language ID, sharding, PII and page text."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest

from demandspark.llm import html_pages, html_text, language_id, pii, queries, sharding

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    found = queries.op5_language_id(spark, SF).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert len(held) > 150
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found)


FOREIGN = [
    "Съешь же ещё этих мягких французских булок, да выпей чаю, а потом иди домой и ложись спать до самого утра.",
    "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία και ύστερα πηγαίνω στο σπίτι μου για να κοιμηθώ ως το πρωί.",
    "いろはにほへと散りぬるを我が世誰ぞ常ならむ有為の奥山今日越えて浅き夢見じ酔ひもせず。春はあけぼの、やうやう白くなりゆく山際。",
    "Zażółć gęślą jaźń, a potem wróć do domu i połóż się spać, bo jutro czeka nas długa droga przez góry i lasy.",
    "Hyvää huomenta, tänään on kaunis päivä ja me lähdemme yhdessä järvelle uimaan sekä kalastamaan koko perheen voimin.",
]


def test_unknown_languages_and_noise_are_rejected(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    texts, labels = language_id.sample(documents)
    model = language_id.train(texts, labels)
    rng = random.Random(5)
    letters = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200)) for _ in range(20)]
    shuffled = ["".join(rng.sample(list(t.decode()), len(t.decode()))) for t in texts[:20] if len(t) > 150]
    for kind, most in ((FOREIGN, 0.0), (letters, 0.0), (shuffled, 0.1)):
        assert model.judge([t.encode() for t in kind])[1].mean() <= most
    own = [r["text"].encode() for r in documents.filter(language_id.held_out()).filter("text rlike '[a-z]'").collect()]
    assert model.judge(own)[1].mean() >= 0.98


@pytest.mark.parametrize("wrong", [0.03, 0.05, 0.2])
def test_wrong_labels_do_not_move_the_floor(spark, wrong):
    texts, labels = language_id.sample(spark.read.parquet(f"{SF}/documents.parquet"))
    rng = random.Random(6)
    noisy = [rng.choice(labels) if rng.random() < wrong else lang for lang in labels]
    model = language_id.train(texts, noisy)
    assert model.judge(texts)[1].mean() >= 0.98
    assert model.floors == language_id.train(texts, labels).floors


def test_language_edge_cases(docs):
    model = language_id.train([b"the cat and the dog", b"der hund und die katze"] * 30, ["en", "de"] * 30)
    frame = docs(None, "", "12 !?", "the dog", "und die katze", "x" * 300000, extra="lang_pred")
    rows = {r["doc_id"]: r for r in language_id.identify(frame, model).collect()}
    assert [rows[i]["lang_pred"] for i in range(5)] == ["und", "und", "und", "en", "de"]
    assert all(rows[i]["rejected"] and rows[i]["score"] == 0 for i in range(3))
    kept = language_id.accepted(frame, model)
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.collect()} <= {3, 4, 5}
    assert language_id.fit(docs(None, "1")) is None
    assert {r["lang_pred"] for r in language_id.identify(docs("abc"), None).collect()} == {"und"}
    assert language_id.identify(frame.limit(0), model).count() == 0


def direct_shards(rows: list[tuple[int, int]], limit: int) -> dict[int, str]:
    bits = {}
    for i, _ in rows:
        b = int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) >> 2
        bits[i] = f"{b:030b}" * 2
    out, todo = {}, [("", rows)]
    while todo:
        prefix, own = todo.pop()
        if sum(n for _, n in own) <= limit or len({bits[i] for i, _ in own}) == 1:
            out |= {i: prefix for i, _ in own}
            continue
        for b in "01":
            part = [(i, n) for i, n in own if bits[i].startswith(prefix + b)]
            if part:
                todo.append((prefix + b, part))
    return out


def test_shards_split_only_where_needed(docs):
    rng = random.Random(2)
    texts = [None, "", "y" * 5000, *("x" * rng.randint(0, 80) for _ in range(400))]
    got = {r["doc_id"]: r for r in sharding.shard_rows(docs(*texts, extra="depth"), limit_bytes=300).collect()}
    assert {i: r["shard"] for i, r in got.items()} == direct_shards([(i, len(t or "")) for i, t in enumerate(texts)], 300)
    assert max(r["depth"] for r in got.values()) > 6
    total = defaultdict(int)
    for r in got.values():
        total[r["shard"]] += r["n_bytes"]
    assert all(total[r["shard"]] == r["shard_bytes"] for r in got.values())
    assert sharding.shard_rows(docs("a").limit(0)).count() == 0


def test_a_hot_key_is_split_by_row(docs):
    frame = docs(*["z" * 10] * 200)  # every row has the same source
    got = sharding.shard_rows(frame, key="source", limit_bytes=100).collect()
    assert max(r["shard_bytes"] for r in got) <= 100
    assert max(r["depth"] for r in got) > 30
    same = sharding.shard_rows(docs(*[(1, "z" * 10)] * 20), limit_bytes=100).collect()
    assert {(r["shard_bytes"], r["depth"]) for r in same} == {(200, 0)}


def test_shards_as_sql(spark, docs, tmp_path, monkeypatch):
    sql = queries.OP7_SQL.replace(str(sharding.LIMIT_BYTES), "100000")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.execute(f"select doc_id, shard, shard_bytes from ({sql})").fetchall())
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    got = sharding.shard_rows(documents, limit_bytes=100000).select("doc_id", "shard", "shard_bytes")
    assert sorted(map(tuple, got.collect())) == want
    assert len({s for _, s, _ in want}) > 20
    sharding.write_shards(documents, str(tmp_path / "s"), 100000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == documents.count()


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def direct_base(text: str) -> list[tuple]:
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda d=digits: 12 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]()
            if good:
                found.append((m.start(), rank, kind, m.end()))
    return sorted(found)


@pytest.fixture(scope="module")
def pii_model(spark):
    return pii.fit(spark)


def test_base_spans(docs, pii_model):
    rng = random.Random(3)
    parts = ["1", "23", "4111111111111111", ".", " ", "-", "@", "a", "b.c", "+", "+1 ", "(", ")", "é", "255.", "😀", "_", "\n"]
    texts = [None, "", "a@b.c..d@e.f", "a@b.c_d@e.f x", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.002.3.255", "é4111 1111 1111 1111, 4111-1111-1111-1111",
             "+1 (017) 555-7713 +1 22", "9" * 20000, "1 " * 10000, "a@b" + ".c" * 5000]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    for r in pii.find(docs(*texts, extra="spans"), pii_model).collect():
        assert [tuple(s) for s in r["base"]] == direct_base(texts[r["doc_id"]] or "")
        assert {tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]}


def test_added_spans_and_redaction(docs, pii_model):
    texts = ["call (555) 123-4567 now", 'x token = "ede43f42c939b6405768150e0411590525cf889e" y', "on 2021-03-04 we met", "order 12345678 came", "plain words only", "mail a@b.cd"]
    found = pii.find(docs(*texts), pii_model)
    spans = {r["doc_id"]: [(s["kind"], s["start"], s["stop"]) for s in r["spans"]] for r in found.collect()}
    assert spans == {0: [("number", 5, 19)], 1: [("secret", 11, 51)], 2: [], 3: [], 4: [], 5: [("email", 5, 11)]}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(found).collect()}
    assert (clean[0], clean[4], clean[5]) == ("call [number] now", "plain words only", "mail [email]")
    assert pii.find(docs("a").limit(0), pii_model).count() == 0


def test_a_match_of_a_generator_passes_its_test(spark):
    from pyspark.sql import functions as F

    texts = ["jane.doe at example.com", "jane at example [dot] com", "jane at example (dot) com", "joe(at)x.de", "joe [at] x dot de", "q" * 20,
             "AbCdEfGhIjKlMnOpQrStUvWx", "415-555-0132 415-555-0199", "(415) 555-0132", "123-45-6789", "1234567", "DE12 3456 7890 1234"]
    rng = random.Random(8)
    parts = ["a", "jane", " ", " at ", "(at)", "[at]", ".", " dot ", "[dot]", "com", "-", "(", ")", "1", "234", "5678", "AB12", "_", "xY" * 9, "=", "/"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(3, 25))) for _ in range(3000)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for name, (pattern, may) in pii.GENERATORS.items():
        hit, passed = F.col("text").rlike(pattern), F.col("text").rlike(may)
        row = frame.agg(F.count_if(hit).alias("hits"), F.count_if(hit & ~passed).alias("missed")).first()
        assert row["hits"] > 0 and row["missed"] == 0, name


def test_spelled_addresses_are_found_wherever_they_stand(docs, pii_model):
    texts = ["mail jane.doe at example.com today", "mail jane at example [dot] com today", "we looked at this. Then we left"]
    found = {r["doc_id"]: [(s["kind"], s["start"], s["stop"]) for s in r["spans"]] for r in pii.find(docs(*texts), pii_model).collect()}
    assert found == {0: [("address", 5, 28)], 1: [("address", 5, 30)], 2: []}


def test_numbers_next_to_each_other_keep_their_spans(docs, pii_model):
    texts = ["call 415-555-0132 415-555-0199 now", "since 2024. 415-555-0132 now", "ssn 123-45-6789 (415) 555-0132 now"]
    found = {r["doc_id"]: [(s["kind"], s["start"], s["stop"]) for s in r["spans"]] for r in pii.find(docs(*texts), pii_model).collect()}
    assert found == {0: [("number", 5, 17), ("number", 18, 30)], 1: [("number", 12, 24)], 2: [("number", 4, 15), ("number", 16, 30)]}


def test_no_accepted_span_is_left_uncovered(spark, docs, monkeypatch):
    monkeypatch.setattr(pii, "_candidates", lambda text: spark_array([(0, 8), (6, 13), (11, 16), (20, 32), (2, 5)]))

    def spark_array(spans):
        from pyspark.sql import functions as F

        return F.array(*(F.struct(F.lit("secret").alias("kind"), F.lit(a).alias("start"), F.lit(b).alias("stop")) for a, b in spans))

    class Every:
        def accepts(self, c):
            return c["stop"] > 0

    found = pii.find(docs("aaaaaabbbbbcccccdd, x@y.zz and more"), Every())
    assert [tuple(s)[::3] for s in found.first()["spans"]] == [(0, 8), (6, 13), (11, 16), (20, 26), (20, 32)]
    assert pii.redact(found).first()["text"] == "[secret]dd, [email]ore"


def test_model_on_unseen_labelled_candidates(spark, pii_model):
    from pyspark.sql import functions as F

    texts = pii.labelled_texts(spark, 9000).filter("cast(id as int) >= 6000")
    found = pii.find(texts.select(F.col("id").alias("doc_id"), "text"), pii_model).withColumnRenamed("doc_id", "id")
    rows = texts.join(found.select("id", "spans"), "id").collect()
    hits = [(r["label"] == 1, any(s["rank"] >= len(pii.BASE) and s["start"] < r["high"] and s["stop"] > r["low"] for s in r["spans"])) for r in rows]
    flagged = [label for label, hit in hits if hit]
    assert sum(flagged) >= 0.95 * len(flagged)
    assert sum(flagged) >= 0.7 * sum(label for label, _ in hits)


def test_margins_are_those_of_the_fitted_trees(spark, pii_model):
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.sql import functions as F

    found = pii.labelled_candidates(spark, 900).withColumn("vector", array_to_vector("x"))
    found = spark.createDataFrame(found.collect(), found.schema)
    fitted, forest = pii.boosted(found)
    model = pii.PiiModel(forest, {})
    rows = fitted.transform(found).select(vector_to_array("rawPrediction")[1].alias("raw"), model.margin(F.col("x")).alias("margin")).collect()
    assert len(rows) > 900 and all(r["raw"] == pytest.approx(r["margin"], abs=1e-12) for r in rows)
    twice = pii.PiiModel({**forest, "root": forest["root"] * 20, "weight": forest["weight"] * 20}, {})
    plans = [found.select(m.margin(F.col("x")))._jdf.queryExecution().analyzed().toString() for m in (model, twice)]
    assert plans[0].count("lambda") == plans[1].count("lambda") < 200  # the plan does not grow with the trees


def test_spans_of_real_documents_are_personal_data(spark, pii_model):
    """Prose of the given documents is the class that must stay: every added span there holds a secret or a long number."""
    rows = pii.find(spark.read.parquet(f"{SF}/documents.parquet"), pii_model).collect()
    added = [(s["kind"], r["text"][s["start"] : s["stop"]]) for r in rows for s in r["spans"] if s["rank"] >= len(pii.BASE)]
    assert len(added) >= 5
    for kind, value in added:
        assert kind in ("secret", "number"), value
        assert re.fullmatch("[0-9a-f]{32,}", value) if kind == "secret" else len(re.sub("[^0-9]", "", value)) >= 7, value
    tokens = [m for r in rows for m in re.findall(r'token = "([0-9a-f]{40})"', r["text"])]
    assert sorted(tokens) == sorted(v for k, v in added if k == "secret")


def test_page_text_of_held_out_layouts():
    model = html_text.trained()
    right = total = 0
    for seed in range(5000, 5200):
        page = html_text.parse(html_pages._Writer(seed).page())
        chance = model.marginals(page)
        for node, parts in page.blocks:
            if "".join(parts).strip():
                total += 1
                right += (chance[node] > 0.5) == bool(page.label[node])
    assert right >= 0.95 * total


def test_marginals_are_exact_on_a_small_tree():
    from itertools import product
    from math import exp

    model = html_text.trained()
    page = html_text.parse("<body><nav><ul><li>a</li></ul></nav><div class=x><p>some words</p></div></body>")
    own = [[sum(model.feature.get(f, (0, 0))[s] for f in fs) for s in (0, 1)] for fs in html_text.features(page)]
    n, weight, one = len(own), 0.0, [0.0] * len(own)
    for states in product((0, 1), repeat=n):
        w = model.root[states[0]] + sum(own[k][s] for k, s in enumerate(states))
        w = exp(w + sum(model.edge[states[page.parent[k]]][states[k]] for k in range(1, n)))
        weight += w
        for k, s in enumerate(states):
            one[k] += w * s
    assert model.marginals(page) == pytest.approx([x / weight for x in one])


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="ad">Buy now cheap</div><article><h1>Caf&eacute; &amp; more</h1><p>First <b>bo</b>ld
 line.<br>Second&nbsp;line &lt;x&gt;<p>Third <a href=x>link</a> here<script>var t="</p>";</script></article>
<footer>&copy; someone</footer>"""


@pytest.mark.parametrize("tag", ["svg", "button", "select", "object", "audio", "video", "canvas"])
def test_a_dropped_element_ends_with_the_block_around_it(tag):
    source = f"<html><body><article><h1>Title here</h1><div><{tag}>gone</div><p>Some words of the text</p></article><p>after</body></html>"
    assert "".join(html_text_blocks(source)).split() == "Title here Some words of the text after".split()


def html_text_blocks(source):
    return [" " + "".join(parts) for _, parts in html_text.parse(source).blocks]


def test_head_and_body_tags_may_be_left_out():
    for source, want in [
        ("<html><head><title>t</title><p>text", "text"),
        ("<head><meta charset=x><style>s</style><b>bold</b> text", "bold text"),
        ("<head><title>t</title>plain", "plain"),
        ("<head><link href=x><script>s</script></head><p>a<svg><text>no</text></svg> b", "a b"),
        ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds", "so x=2 holds"),
        ("<article><svg><path><p>shown", "shown"),
        ("<button>no<p>no</p></button>yes</button> too", "yes too"),
    ]:
        assert "".join(html_text_blocks(source)).split() == want.split(), source
    words = "some more words " * 30
    assert html_text.main_text(f"<html><head><title>t</title><article><p>{words}", html_text.trained()) == words.strip()


def test_page_text(spark):
    rows = [(1, "u", PAGE, 1), (2, None, None, 1), (3, "u", "", 1), (4, "u", "<p", 1), (None, "u", PAGE.replace("<article>", "<article class=post>"), 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(frame).collect()}
    want = "Café & more First bold line. Second line <x> Third link here"
    assert got == {1: (want, len(want)), 2: ("", 0), 3: ("", 0), 4: ("", 0), None: (want, len(want))}
    assert html_text.extract(frame.limit(0)).count() == 0


@pytest.mark.parametrize("source", ["<", "<<<>>", "a<b c", '<div class="x', "</", "<!-- x", "<![CDATA[x]]>", "<p>" * 3000, "<script>x", "&" * 1000])
def test_broken_pages(source):
    assert isinstance(html_text.main_text(source, html_text.trained()), str)


def _prose(n, seed=3):
    rng = random.Random(seed)
    return " ".join(" ".join(rng.choices(["river", "stone", "light", "under", "walked", "quiet", "morning", "paper"], k=12)).capitalize() + "." for _ in range(n))


# Layouts written by hand, not by the maker of the labelled pages; "@" stands for the article, "#" for long other text.
LAYOUTS = [
    "<body><nav><a href=/>Home</a></nav><article>@</article><aside><p>#</p></aside><footer>end</footer></body>",
    "<body><aside>#</aside><article>@</article></body>",
    "<body><aside><h3>More</h3><p>#</p><p>#</p></aside><article>@</article><footer><p>#</p></footer></body>",
    "<body><header><p>#</p></header><main><article>@</article></main><aside class=zzqx><div><p>#</p></div></aside></body>",
    "<body><div id=page><main>@</main><section class=qwrt><h2>Say</h2><div class=qq><p>#</p></div><div class=qq><p>#</p></div></section></div></body>",
    "<body><div><div><nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav></div><article>@<aside><p>#</p></aside></article></div></body>",
    "<body><article>@</article><section class=xk><article class=comment><p>#</p></article><article class=comment><p>#</p></article></section></body>",
    "<body><div class=content>@</div><div class=sidebar><p>#</p></div></body>",
]


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("sentences", [1, 8, 12])
@pytest.mark.parametrize("paragraphs", [0, 1, 3])
def test_long_sidebars_and_short_articles(layout, sentences, paragraphs):
    parts = [_prose(4, k) for k in range(paragraphs)] or ["Short."]
    source = layout.replace("#", _prose(sentences, 77)).replace("@", "".join(f"<p>{p}</p>" for p in parts))
    assert html_text.main_text(source, html_text.trained()) == " ".join(parts)
