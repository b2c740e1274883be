"""Personal data in texts: fixed formats, and boosted trees over a wider set of candidate spans.

Everything runs as DataFrame expressions. Fixed formats (email, ip, card, phone) are found by pattern and checked by rule;
they always stay. For the rest, high-recall generators propose spans, which may overlap each other and the fixed ones.
Gradient-boosted trees score each candidate by its format and its surroundings, and a threshold per generator, set on
labelled candidates kept apart from the fit, selects those to redact. The trees are fitted by Spark ML on labelled
candidates made by rule from value formats and surroundings. They are then held as data, arrays of features, thresholds
and children that an expression of fixed size walks for each candidate, so no row is exploded, shuffled or joined and the
plan doesn't grow with the trees.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.llm.common import materialize

LOCAL = "A-Za-z0-9._%+-"
# Base formats. A match starts where a run starts or where the last match ended, which is the leftmost match without
# trying each place of a run; possessive runs give up nothing that the rest of the pattern could take.
BASE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[0-9]|[ -](?=[0-9]))++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
MAY = {
    "email": "@[A-Za-z0-9-]+\\.[A-Za-z0-9-]",
    "ip": "[0-9]\\.[0-9]+\\.[0-9]+\\.[0-9]",
    "card": "[0-9](?:[ -]?[0-9]){11}",
    "phone": "\\+[0-9][ ().0-9-]+[0-9]",
}
# Generators of further candidates: pattern, and a cheap test of the text that every match of the pattern passes.
GENERATORS = {
    "number": (r"(?<![0-9])\(?[0-9][0-9() .-]{5,}[0-9]", "[0-9][0-9() .-]{5,}[0-9]"),
    # Formats inside such a run: numbers next to each other keep their own spans.
    "inner_phone": (r"(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])", "[0-9][0-9() .-]{5,}[0-9]"),
    "inner_id": (r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])", "[0-9][0-9() .-]{5,}[0-9]"),
    "inner_tight": (r"(?<![0-9])(?<![0-9][-.])(?=[0-9](?:[-.]?[0-9]){6})[0-9]++(?:[-.][0-9]++)*+", "[0-9][0-9() .-]{5,}[0-9]"),
    "secret": (r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+", "[A-Za-z0-9+/_=-]{20}"),
    "address": (
        # A plain dot joins two parts without white space: one before a space ends a sentence.
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\bat\b) ?[A-Za-z0-9-]++(?:(?: ?(?:\(dot\)|\[dot\]|\bdot\b) ?|\.)[A-Za-z0-9-]++)++",
        r"(?:\(at\)|\[at\]|\bat\b) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\bdot\b)|\.)",
    ),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
}
# The kind that a generator's spans are shown as, where it isn't its name.
SHOWN = {name: "number" for name in GENERATORS if name.startswith("inner_")}
NUMBERS = ["number", *SHOWN]
KINDS = [*BASE, *(name for name in GENERATORS if name not in SHOWN)]
AROUND = 24
# Words near a span that speak for or against personal data, by class.
CONTEXT = {
    "call": "phone|tel|call|mobile|fax|t\\u00e9l|telefon|m\\u00f3vil|handy",
    "key": "token|secret|key|password|passwd|auth|bearer|credential",
    "identity": "ssn|social security|passport|account|iban|konto|cuenta|compte|tax id",
    "write": "mail|contact|write to|reach|contacto|kontakt",
    "count": "order|invoice|isbn|version|page|price|total|build|serial|part no|year|vol|doi|sku",
}
TREES, DEPTH = 12, 4
LABELLED = 6000
ARMS_A_PLAN = 6
ACCEPTED_PRECISION = 0.98

SPAN = "struct<start:int,stop:int,value:string>"


def _spans(text: Column, pattern: str) -> Column:
    """All matches from left to right: start and stop in code points, and the value.

    Splitting at the pattern gives the lengths between the matches, so the places are running sums.
    """
    steps = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value")),
    )

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        stop = start + F.length(x["value"])
        span = F.struct(start.alias("start"), stop.alias("stop"), x["value"].alias("value"))
        return F.when(x["value"].isNull(), state).otherwise(F.struct(stop.alias("at"), F.array_append(state["found"], span).alias("found")))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))
    return F.aggregate(steps, empty, step, lambda state: state["found"])


def _luhn(digits: Column) -> Column:
    """Whether the check digit holds, for up to 19 digits."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        parts = F.transform(F.split(value, "\\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) <= 2) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _count(value: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{characters}]", "")).cast("double")


def _features(text: Column, span: Column) -> dict[str, Column]:
    """Format and surroundings of one candidate."""
    value, start, stop = span["value"], span["start"], span["stop"]
    size = F.length(value).cast("double")
    low = F.greatest(start - AROUND, F.lit(0))
    before = F.lower(F.substring(text, low + 1, start - low))
    after = F.substring(text, stop + 1, F.lit(1))
    beyond = F.substring(text, stop + 1, F.lit(2))
    digits = _digits(value)
    shape = F.regexp_replace(F.regexp_replace(value, "[0-9]+", "9"), "[A-Za-z]+", "a")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return {
        "generator": span["generator"].cast("double"),
        "size": size,
        "digits": F.length(digits).cast("double"),
        "letters": _count(value, "A-Za-z"),
        "upper": _count(value, "A-Z"),
        "hex": flag(value.rlike("^[0-9a-f]+$") | value.rlike("^[0-9A-F]+$")),
        "separators": _count(value, " ().-"),
        "changes": F.length(shape).cast("double"),
        "phone_shape": flag(value.rlike("^(\\([0-9]{3}\\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}$")),
        "id_shape": flag(value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
        "date_shape": flag(value.rlike("^[0-9]{4}[-.][0-9]{1,2}[-.][0-9]{1,2}$|^[0-9]{1,2}[-.][0-9]{1,2}[-.][0-9]{4}$")),
        "digit_share": F.length(digits) / size,
        "assigned": flag(before.rlike("[=:]\\s*[\"']?$")),
        "sentence": flag(value.rlike("\\. ")),
        "bracketed": flag(value.rlike("[(\\[](at|dot)[)\\]]")),
        "domain": flag(value.rlike("(?:\\.|dot[)\\]]?) ?(?:com|net|org|edu|gov|info|biz|io|[a-z]{2})$")),
        "joined": flag(before.rlike("[a-z0-9@/._-]$") | after.rlike("[A-Za-z0-9@/_]")),
        "in_run": flag(before.rlike("[0-9][-.]$") | beyond.rlike("^[-.][0-9]")),
        **{f"near_{name}": flag(before.rlike(words)) for name, words in CONTEXT.items()},
    }


def _found(text: Column) -> Column:
    """All generators' spans of a row: generator, start, stop, value."""
    arrays = []
    for generator, (pattern, may) in enumerate(GENERATORS.values()):
        own = F.transform(_spans(text, pattern), _of_generator(generator))
        arrays.append(F.when(text.rlike(may), own).otherwise(F.array().cast("array<struct<generator:int,start:int,stop:int,value:string>>")))
    return F.concat(*arrays)


def _of_generator(generator: int):
    fields = ("start", "stop", "value")
    return lambda span: F.struct(F.lit(generator).alias("generator"), *[span[f].alias(f) for f in fields])


def _candidates(text: Column) -> Column:
    """The spans with their kind and their features as one array ``x``; the features stand in the plan once."""
    names = F.array(*map(F.lit, GENERATORS))

    def describe(span: Column) -> Column:
        kind = F.get(names, span["generator"]).alias("kind")
        return F.struct(kind, span["start"].alias("start"), span["stop"].alias("stop"), F.array(*_features(text, span).values()).alias("x"))

    return F.transform(_found(text), describe)


def labelled_texts(spark: SparkSession, rows: int = LABELLED) -> DataFrame:
    """Short texts with one value each and whether it is personal (text, low, high, personal), made by rule.

    In some texts another number stands right before or after the value; low and high are the value's own.
    """
    hex_ = "md5(concat(id, 'a'))"
    num = lambda n, salt: f"lpad(cast(pmod(xxhash64(id, {salt}), {10**n}) as string), {n}, '0')"
    word = lambda salt: f"element_at(array('ten','sor','mila','ver','des','oner','plan','gris'), cast(pmod(xxhash64(id, {salt}), 8) + 1 as int))"
    values = [  # (personal, value, words that may stand before it)
        (1, f"concat('(', {num(3, 1)}, ') ', {num(3, 2)}, '-', {num(4, 3)})", ["", "call ", "phone: ", "tel. "]),
        (1, f"concat_ws('-', {num(3, 1)}, {num(3, 2)}, {num(4, 3)})", ["", "call ", "mobile "]),
        (1, f"concat_ws('.', {num(3, 1)}, {num(3, 2)}, {num(4, 3)})", ["call ", "fax "]),
        (1, f"concat_ws('-', {num(3, 1)}, {num(2, 2)}, {num(4, 3)})", ["", "ssn ", "social security no. "]),
        (1, f"sha1({hex_})", ['token = "', "key: ", "", "secret="]),
        (1, f"substr(base64(encode(sha1({hex_}), 'utf-8')), 1, 32)", ['api_key = "', "password: ", "bearer "]),
        (1, f"concat({word(4)}, {num(2, 5)}, ' at ', {word(6)}, ' dot com')", ["", "mail ", "contact "]),
        (1, f"concat({word(4)}, '.', {word(5)}, ' (at) ', {word(6)}, '.net')", ["", "write to "]),
        (1, f"concat('DE', {num(2, 1)}, ' ', {num(4, 2)}, ' ', {num(4, 3)}, ' ', {num(4, 4)}, ' ', {num(4, 5)}, ' ', {num(2, 6)})", ["", "iban ", "konto "]),
        (0, f"concat_ws('-', {num(4, 1)}, {num(2, 2)}, {num(2, 3)})", ["", "on ", "year "]),
        (0, f"concat_ws('.', {num(2, 1)}, {num(2, 2)}, {num(4, 3)})", ["", "am "]),
        (0, f"concat({num(4, 1)}, {num(4, 2)}, {num(4, 3)}, {num(4, 4)})", ["", "order ", "no. "]),
        (0, f"concat({num(4, 1)}, {num(4, 2)})", ["", "invoice ", "page "]),
        (0, f"concat('978-3-', {num(2, 1)}, '-', {num(6, 2)}, '-', {num(1, 3)})", ["isbn ", ""]),
        (0, f"concat_ws(' ', {num(3, 1)}, {num(3, 2)}, {num(2, 3)}, {num(4, 4)}, {num(3, 5)})", ["", "total "]),
        (0, f"concat_ws('.', {num(1, 1)}, {num(2, 2)}, {num(2, 3)}, {num(1, 4)}, {num(2, 5)})", ["version ", "build "]),
        (0, f"concat({word(1)}, {word(2)}, {word(3)}, {word(4)}, {word(5)}, {word(6)}, {num(1, 7)})", ["", "the "]),
        (0, f"concat_ws('-', {word(1)}, {word(2)}, {word(3)}, {word(4)}, {word(5)}, {num(4, 6)})", ["", "http://", "see /"]),
        (0, f"concat({word(4)}, ' at ', {word(6)}, ' dot ', {word(7)}, '. ')", ["", "we met "]),
        (1, f"concat({word(4)}, '.', {word(5)}, ' at ', {word(6)}, '.', element_at(array('com', 'org', 'net', 'de'), cast(pmod(xxhash64(id, 8), 4) + 1 as int)))", ["", "mail ", "contact "]),
        (1, f"concat({word(4)}, ' at ', {word(6)}, element_at(array(' [dot] ', ' (dot) '), cast(pmod(xxhash64(id, 8), 2) + 1 as int)), 'com')", ["", "reach "]),
        (1, f"translate(substr(base64(encode(sha1({hex_}), 'utf-8')), 1, 32), '0123456789', 'qRsTuVwXyZ')", ['token = "', "secret: "]),
        (0, f"concat({word(4)}, ' at ', {word(6)}, '. ', initcap({word(7)}))", ["", "we were "]),
        (0, f"concat({word(4)}, ' at ', {word(6)}, '.', initcap({word(7)}))", ["", "we were "]),
        (0, f"concat_ws(element_at(array('-', '/', '_'), cast(pmod(xxhash64(id, 8), 3) + 1 as int)), {word(1)}, {word(2)}, {word(3)}, {word(4)}, {word(5)}, {word(6)})", ["", "see /"]),
        (0, f"repeat(element_at(array('-', '=', '_'), cast(pmod(xxhash64(id, 8), 3) + 1 as int)), cast(20 + pmod(xxhash64(id, 9), 40) as int))", [""]),
        (0, f"concat('AB', {num(2, 1)}, ' ', upper({word(2)}), ' ', {num(4, 3)})", ["part no. ", "model "]),
    ]
    arms = []
    for personal, value, befores in values:
        before = f"element_at(array({', '.join(repr(b) for b in befores)}), cast(pmod(xxhash64(id, 99), {len(befores)}) + 1 as int))"
        arms.append(f"struct({personal} as personal, {before} as b, {value} as v, '' as a)")
    beside = f"concat_ws('-', {num(3, 21)}, {num(3, 22)}, {num(4, 23)})"
    phone, tax = f"concat_ws('-', {num(3, 1)}, {num(3, 2)}, {num(4, 3)})", f"concat_ws('-', {num(3, 1)}, {num(2, 2)}, {num(4, 3)})"
    round_ = f"concat('(', {num(3, 1)}, ') ', {num(3, 2)}, '-', {num(4, 3)})"
    year = "cast(1950 + pmod(xxhash64(id, 24), 80) as string)"
    for value in (phone, tax, round_):
        for before, after in (("''", f"concat(' ', {beside})"), (f"concat({beside}, ' ')", "''"), (f"concat('since ', {year}, '. ')", "''"), (f"concat({year}, ' ')", f"concat(' ', {num(2, 25)})")):
            arms.append(f"struct(1 as personal, {before} as b, {value} as v, {after} as a)")
    for value in (f"concat_ws('-', {year}, {num(2, 2)}, {num(2, 3)})", f"concat_ws('-', {num(3, 1)}, {num(3, 2)}, {num(4, 3)}, {num(4, 4)})", f"concat({num(4, 1)}, {num(4, 2)})"):
        arms.append(f"struct(0 as personal, concat({year}, ' ') as b, {value} as v, concat(' ', {num(2, 25)}) as a)")
    made = spark.range(rows).withColumn("id", F.col("id").cast("string"))
    made = made.withColumn("arm", F.pmod(F.xxhash64("id", F.lit(77)), F.lit(len(arms))).cast("int"))
    parts = []
    for at in range(0, len(arms), ARMS_A_PLAN):  # few arms each, so that generated code stays within the JVM's limits
        few = arms[at : at + ARMS_A_PLAN]
        own = made.filter(F.col("arm").between(at, at + len(few) - 1))
        parts.append(own.select("id", F.element_at(F.array(*map(F.expr, few)), F.col("arm") - at + 1).alias("x")))
    made = reduce(DataFrame.unionByName, parts)
    lead = F.concat(F.expr(word(11)), F.lit(" "), F.expr(word(12)), F.lit(" "), F.col("x.b"))
    ends = ["", "", "", ",", ".", "!!", "###", "&&&", ";", ")"]
    end = F.element_at(F.array(*map(F.lit, ends)), (F.pmod(F.xxhash64("id", F.lit(55)), F.lit(len(ends))) + 1).cast("int"))
    tail = F.concat(F.expr("if(x.b like '%\"', '\"', '')"), end, F.lit(" "), F.expr(word(13)))
    made = made.select("id", lead.alias("lead"), F.col("x.v").alias("v"), F.concat(F.col("x.a"), tail).alias("rest"), F.col("x.personal").alias("personal"))
    made = materialize(made, "pii-texts")
    return made.select(
        "id", F.concat("lead", "v", "rest").alias("text"), F.length("lead").alias("low"),
        (F.length("lead") + F.length("v")).alias("high"), F.col("personal").cast("double").alias("label"),
    )


FOREST = "struct<feature:array<int>,threshold:array<double>,left:array<int>,right:array<int>,value:array<double>,root:array<int>,weight:array<double>>"


class PiiModel:
    """Boosted trees as arrays over all their nodes, and a threshold per generator. A leaf has feature -1."""

    def __init__(self, forest: dict[str, list], thresholds: dict[str, float]):
        self.forest, self.thresholds = forest, thresholds

    def margin(self, x: Column) -> Column:
        """Weighted sum of the leaves that the features ``x`` lead to."""
        held = F.from_json(F.lit(json.dumps(self.forest)), FOREST)  # one literal, whatever the number of trees

        def step(at: Column, _: Column) -> Column:
            feature = F.get(held["feature"], at)
            low = F.get(x, feature) <= F.get(held["threshold"], at)
            return F.when(feature < 0, at).when(low, F.get(held["left"], at)).otherwise(F.get(held["right"], at))

        def add(total: Column, tree: Column) -> Column:
            leaf = F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.get(held["root"], tree), step)
            return total + F.get(held["weight"], tree) * F.get(held["value"], leaf)

        return F.aggregate(F.sequence(F.lit(0), F.lit(len(self.forest["root"]) - 1)), F.lit(0.0), add)

    def accepts(self, candidate: Column) -> Column:
        low = F.lit(float("inf"))
        for kind, threshold in self.thresholds.items():
            low = F.when(candidate["kind"] == kind, F.lit(threshold)).otherwise(low)
        return self.margin(candidate["x"]) >= low


def _flatten(node, forest: dict[str, list]) -> int:
    """Append a fitted node and those below it; its place in the arrays."""
    at = len(forest["feature"])
    leaf = node.getClass().getSimpleName() == "LeafNode"
    split = None if leaf else node.split()
    row = {"feature": -1 if leaf else split.featureIndex(), "threshold": 0.0 if leaf else float(split.threshold()), "left": -1, "right": -1}
    for name, value in {**row, "value": float(node.prediction())}.items():
        forest[name].append(value)
    if not leaf:
        forest["left"][at] = _flatten(node.leftChild(), forest)
        forest["right"][at] = _flatten(node.rightChild(), forest)
    return at


def labelled_candidates(spark: SparkSession, rows: int = LABELLED) -> DataFrame:
    """id, kind, label and features ``x`` of the candidates that touch the value of a labelled text."""
    texts = labelled_texts(spark, rows)
    found = texts.select("id", "low", "high", "label", F.explode(_candidates(F.col("text"))).alias("c"))
    found = found.filter("c.start < high and c.stop > low")
    # A number that runs beyond the value is not the value's span.
    exact = ~F.col("c.kind").isin(NUMBERS) | F.expr("c.start >= low and c.stop <= high")
    return found.select("id", "c.kind", F.when(exact, F.col("label")).otherwise(0.0).alias("label"), "c.x")


def boosted(found: DataFrame):
    """Spark ML's boosted trees over ``found`` (vector, label), and their nodes as arrays."""
    fitted = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=1).fit(found)
    forest: dict[str, list] = {name: [] for name in ("feature", "threshold", "left", "right", "value", "root")}
    for tree in fitted.trees:
        forest["root"].append(_flatten(tree._java_obj.rootNode(), forest))
    return fitted, {**forest, "weight": [float(w) for w in fitted.treeWeights]}


def fit(spark: SparkSession, rows: int = LABELLED) -> PiiModel:
    """Fit on three quarters of the labelled candidates and set each generator's threshold on the rest.

    The threshold is the least margin from which on the accepted candidates are personal to ``ACCEPTED_PRECISION``; a
    generator that never gets there accepts nothing. The candidates are written once and read by every round of the fit.
    """
    part = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(4)) == 0
    found = materialize(labelled_candidates(spark, rows).repartition(4, "id"), "pii-candidates")
    _, forest = boosted(found.filter(~part).withColumn("vector", array_to_vector("x")))
    model = PiiModel(forest, {})
    checked = found.filter(part).select("kind", "label", model.margin(F.col("x")).alias("margin")).collect()  # bounded by rows
    for kind in GENERATORS:
        own = sorted((r["margin"], r["label"]) for r in checked if r["kind"] == kind)
        for i, (margin, _) in enumerate(own):
            if i and margin == own[i - 1][0]:
                continue
            if sum(label for _, label in own[i:]) >= ACCEPTED_PRECISION * (len(own) - i):
                model.thresholds[kind] = margin
                break
    return model


def find(documents: DataFrame, model: PiiModel) -> DataFrame:
    """``documents`` (doc_id, text) as doc_id, text, base and spans: arrays of (start, rank, kind, stop), in order.

    Starts and stops count code points, stops are exclusive. A candidate is added if the trees accept it and no
    base span holds all of it; of accepted candidates one of which holds the other, the longer stays, then the one whose
    kind is listed first. Spans may overlap in part, so that nothing accepted is left uncovered. A null text has no spans;
    texts of any length are searched whole; repeated rows are searched each; other columns are ignored; an empty table
    gives an empty result.
    """
    text = F.col("text")
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind_type = "array<struct<start:int,rank:int,kind:string,stop:int>>"

    def span(x: Column, rank: int | Column, kind: Column) -> Column:
        rank = F.lit(rank) if isinstance(rank, int) else rank
        return F.struct(x["start"].alias("start"), rank.cast("int").alias("rank"), kind.alias("kind"), x["stop"].alias("stop"))

    def base_spans(rank: int, kind: str) -> Column:
        good = F.filter(_spans(text, BASE[kind]), lambda x: _valid(kind, x["value"]))
        own = F.transform(good, lambda x: span(x, rank, F.lit(kind)))
        return F.when(text.rlike(MAY[kind]), own).otherwise(F.array().cast(kind_type))

    base = [base_spans(rank, kind) for rank, kind in enumerate(BASE)]
    rows = rows.withColumn("base", F.array_sort(F.concat(*base))).withColumn("candidates", _candidates(text))
    holds = lambda a, b: (a["start"] <= b["start"]) & (b["stop"] <= a["stop"])
    free = F.filter("candidates", lambda c: model.accepts(c) & ~F.exists("base", lambda b: holds(b, c)))
    shown = lambda kind: F.when(kind.isin(NUMBERS), F.lit("number")).otherwise(kind)
    rank_of = lambda kind: F.array_position(F.array(*map(F.lit, KINDS)), kind) - 1
    free = F.when(F.size("candidates") > 0, F.array_distinct(F.transform(free, lambda c: span(c, rank_of(shown(c["kind"])), shown(c["kind"]))))).otherwise(F.array().cast(kind_type))
    rows = rows.withColumn("free", free)
    order = lambda c: F.struct((c["start"] - c["stop"]).alias("a"), c["start"].alias("b"), c["rank"].alias("c"))
    best = F.filter("free", lambda c: ~F.exists("free", lambda o: holds(o, c) & (order(o) < order(c))))
    return rows.select("doc_id", "text", "base", F.array_sort(F.concat("base", best)).alias("spans"))


def redact(found: DataFrame) -> DataFrame:
    """The text of each row of :func:`find` with every span replaced by its kind in brackets; spans that overlap are one, of the first's kind."""
    step = lambda state, s: F.when(
        s["start"] < state["at"], F.struct(F.greatest(state["at"], s["stop"]).alias("at"), state["text"].alias("text"))
    ).otherwise(
        F.struct(
            s["stop"].alias("at"),
            F.concat(state["text"], F.substring("text", state["at"] + 1, s["start"] - state["at"]), F.lit("["), s["kind"], F.lit("]")).alias("text"),
        )
    )
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    done = F.aggregate("spans", start, step)
    return found.select("doc_id", F.concat(done["text"], F.substring("text", done["at"] + 1, F.length("text"))).alias("text"))


def listed(spans: Column) -> Column:
    """kind:start:stop of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
