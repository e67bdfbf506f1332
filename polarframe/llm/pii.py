"""Personal data: exact patterns, and candidates that boosted trees accept.

Base spans are the leftmost matches of one pattern per kind that pass its check; they always stay. High-recall generators
propose further spans that may overlap anything, gradient-boosted trees score them by format and context, a logistic
curve per kind turns scores into probabilities, and a threshold per kind selects. Accepted spans that overlap are
resolved by probability, best first (ties: longer, then earlier); a base span counts as certain, so nothing that overlaps one is added.

The trees don't learn what the base patterns match. Positive examples are base spans of a bounded sample of documents, disguised:
signs written out, other separators, a missing plus. Negative ones are dates, times, prices, versions, plain numbers, card numbers
with a wrong check digit and digits inside longer words, planted in the same surroundings, and the sample's own candidates that overlap
a base span of another kind. Candidates without such evidence teach nothing. The sample is drawn by a hash of id and text (``SAMPLE_DOCS``,
``SAMPLE_SPANS`` of each; by text alone without ``id_col``, so name it where many rows share a text); its documents are split by text: six tenths fit the trees, two the curves, two the thresholds: the least probability, one
half or more, from which at least ``PRECISION`` of the examples are positive. A kind with under ``LEAST_POSITIVE`` of them adds nothing.
Trees and curves are compiled into one column expression, so finding spans is a single pass over the rows in the JVM: no shuffle, no Python.

A null text counts as empty and has no spans. Offsets are code points, end exclusive. Finding matches and features is linear in
the text and its matches (running sums in chunks); resolving takes accepted times all spans of one text. Texts are never cut. Equal rows
get equal spans; other columns pass through, columns named like the results are replaced. An empty table, or one without base spans, adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polarframe.llm.shared import drawn_share, fixed, stored

KINDS = ["email", "ip", "card", "phone"]
SAMPLE_DOCS = 20_000
SAMPLE_SPANS = 20
LEAST_POSITIVE = 10
PRECISION = 0.95
#: Matches whose lengths are added up in one chunk.
CHUNK = 256
SPAN = "struct<start:int,kind:int,end:int>"

# A match can only begin where its first run of characters begins, or right after the match before it; saying so
# keeps long runs linear and finds the same matches. Possessive groups do not recurse, whatever the length.
EMAIL = "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?:\\G|(?<![0-9]))[0-9]++(?:\\.[0-9]+){3}"
CARD = "[0-9](?:[\\x20-]?[0-9])++"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
#: Generators by kind: mail addresses with written-out signs, and runs of digits with any separators.
WIDE = {
    "email": "[A-Za-z0-9._%+-]++(?:@|\\x20?[\\[(]at[\\])]\\x20?)[A-Za-z0-9-]++(?:(?:\\.|\\x20?[\\[(]dot[\\])]\\x20?)[A-Za-z0-9-]++)*+",
    "ip": "(?<![0-9])[0-9]{1,3}(?:[.,:\\x20]{1,2}[0-9]{1,3}){3}(?![0-9])",
    "card": "(?<![0-9])[0-9](?:[\\x20._/-]{0,2}[0-9]){11,18}(?![0-9])",
    "phone": "(?<![0-9])[+(]{0,2}[0-9](?:[\\x20()./-]{0,3}[0-9]){6,14}(?![0-9])",
}
GUARDS: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: F.contains(t, F.lit("@")) | F.contains(t, F.lit("(at)")) | F.contains(t, F.lit("[at]")),
    "ip": lambda t: t.rlike("[0-9][.,:\\x20]{1,2}[0-9]"),
    "card": lambda t: t.rlike("[0-9][\\x20._/-]?[0-9]"),
    # The base pattern allows any number of separators.
    "phone": lambda t: F.contains(t, F.lit("+")) | t.rlike("[0-9][\\x20()./-]{0,3}[0-9]"),
}
CONTEXT = "(?i)(mail|contact|phone|call|tel|fax|mobile|ip|host|server|address|card|visa|account|payment|pay)[^A-Za-z]*$"


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Check of a string of digits: every second one from the right counts twice."""
    n = F.length(number)

    def worth(i: Column) -> Column:
        d = F.substring(number, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda s, x: s + x) % 10 == 0


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike("^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\\.|$)){4}$"),
    "card": lambda m: F.when(F.length(digits_of(m)).between(12, 19), luhn(digits_of(m))).otherwise(False),
    "phone": lambda m: F.length(digits_of(m)).between(9, 15),
}
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
BEFORE = 24


def running(sums: Column) -> Column:
    """Running sums of all lengths from the running sums of every chunk."""
    ends = F.transform(sums, lambda c: F.get(c, F.size(c) - 1))
    return F.flatten(F.zip_with(sums, _sums(ends), lambda c, total: F.transform(c, lambda v: v + total - F.get(c, F.size(c) - 1))))


def _sums(lengths: Column) -> Column:
    return F.aggregate(lengths, F.array().cast("array<int>"), lambda s, x: F.concat(s, F.array(F.coalesce(F.get(s, F.size(s) - 1), F.lit(0)) + x)))


def matches(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """``df`` with a column of all matches per name of ``patterns`` (pattern and guard): place, match, the text before and after it.

    The texts between matches and the matches themselves add up to offsets, a chunk at a time and then over chunks.
    """
    split, steps, sums, found = {}, {}, {}, {}
    none = F.array().cast("array<struct<gap:string,ahead:string,m:string>>")
    for name, (pattern, guard) in patterns.items():
        split[f"{name}_g"] = fixed(F.when(guard, F.split(F.col(text), pattern, -1)))
        gaps = F.col(f"{name}_g")
        around = F.zip_with(gaps, F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(1))), lambda a, b: F.struct(a.alias("gap"), b.alias("ahead")))
        pairs = F.zip_with(around, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), lambda a, m: F.struct(a["gap"].alias("gap"), a["ahead"].alias("ahead"), m.alias("m")))
        steps[name] = fixed(F.when(F.size(gaps) > 1, F.filter(pairs, lambda x: x["m"].isNotNull())).otherwise(none))
        n = F.size(name)
        length = lambda x: F.length(x["gap"]) + F.length(x["m"])
        chunk = lambda name=name: lambda k: _sums(F.transform(F.slice(F.col(name), k * CHUNK + 1, F.lit(CHUNK)), length))
        sums[f"{name}_s"] = fixed(F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), chunk())).otherwise(F.array().cast("array<array<int>>")))
        place = lambda x, end: F.struct(
            (end - F.length(x["m"])).alias("start"), end.alias("end"), x["m"].alias("match"),
            F.substring(x["gap"], F.greatest(F.length(x["gap"]) - BEFORE + 1, F.lit(1)), F.lit(BEFORE)).alias("behind"), F.substring(x["ahead"], F.lit(1), F.lit(8)).alias("ahead"),
        )
        found[name] = fixed(F.zip_with(F.col(name), running(F.col(f"{name}_s")), place))
    return df.withColumns(split).withColumns(steps).withColumns(sums).withColumns(found).drop(*split, *sums)


def basic(kind: str, match: Column) -> Column:
    """Whether a candidate is of the form that the base pattern takes anyway."""
    return match.rlike(f"^(?:{BASE[kind]})$") & CHECKS[kind](match)


def _candidate(kind: int) -> Callable[[Column], Column]:
    def features(x: Column) -> Column:
        m = x["match"]
        count = lambda cls: F.length(F.regexp_replace(m, f"[^{cls}]", "")).cast("double")
        flag = lambda c: F.when(c, 1.0).otherwise(0.0)
        sizes = F.transform(F.filter(F.split(m, "[^0-9A-Za-z]+"), lambda g: F.length(g) > 0), lambda g: F.length(g))
        number = digits_of(m)
        values = [
            F.lit(float(kind)), F.length(m).cast("double"), count("0-9"), count("A-Za-z"), F.size(sizes).cast("double"), F.coalesce(F.array_max(sizes), F.lit(0)).cast("double"),
            F.coalesce(F.array_min(sizes), F.lit(0)).cast("double"), count("+"), count("()\\[\\]"), count("."), count(",:"), count("/_"), count("\\x20"), count("-"), count("@"),
            flag(m.rlike("^0")), flag(m.rlike("(?:^|[^0-9])(?:19|20)[0-9]{2}(?:[^0-9]|$)")), flag(m.rlike("(?:\\.|[\\[(]dot[\\])]\\x20?)[A-Za-z-]+$")),
            flag(F.when(F.length(number).between(12, 19), luhn(number)).otherwise(False)), flag(CHECKS["ip"](F.regexp_replace(m, "[^0-9]+", "."))),
            flag(x["behind"].rlike(CONTEXT)), flag(x["behind"].rlike("[\\p{L}\\p{N}]$")), flag(x["ahead"].rlike("^[\\p{L}\\p{N}]")), flag(x["behind"].rlike("[$€£]\\x20?$")),
        ]
        return F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), F.array(*values).alias("f"))

    return features


FEATURES = [
    "kind", "length", "digits", "letters", "groups", "longest", "shortest", "pluses", "brackets", "dots", "commas", "slashes", "spaces", "dashes", "ats",
    "zero", "year", "domain", "luhn", "octets", "context", "before", "after", "price",
]


def _checked(kind: str) -> Callable[[Column], Column]:
    return lambda x: CHECKS[kind](x["match"])


def _plain(kind: int) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"))


def _cross(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def propose(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_base`` (checked matches), ``_known`` (the same with their surroundings) and ``_wide`` (candidates of other forms, with features)."""
    df = docs.withColumn("_source", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_guards", fixed(F.array(*[GUARDS[k](F.col("_source")) for k in KINDS])))
    guard = {k: F.get("_guards", F.lit(i)) for i, k in enumerate(KINDS)}
    df = matches(df, "_source", {**{f"_base_{k}": (BASE[k], guard[k]) for k in KINDS}, **{f"_wide_{k}": (WIDE[k], guard[k]) for k in KINDS}})
    base = {f"_base_{k}": fixed(F.filter(f"_base_{k}", _checked(k))) for k in KINDS}
    other = lambda k: lambda x: ~basic(k, x["match"])
    wide = {f"_wide_{k}": fixed(F.transform(F.filter(f"_wide_{k}", other(k)), _candidate(i))) for i, k in enumerate(KINDS)}
    df = df.withColumns({**base, **wide})
    surroundings = lambda i: lambda x: F.struct(F.lit(i).alias("kind"), x["match"].alias("match"), x["behind"].alias("behind"), x["ahead"].alias("ahead"))
    return df.withColumns({
        "_base": fixed(F.sort_array(F.concat(*[F.transform(f"_base_{k}", _plain(i)) for i, k in enumerate(KINDS)]))),
        "_known": F.concat(*[F.transform(F.slice(f"_base_{k}", 1, SAMPLE_SPANS), surroundings(i)) for i, k in enumerate(KINDS)]),
        "_wide": fixed(F.concat(*[F.col(f"_wide_{k}") for k in KINDS])),
    }).drop("_guards", *base, *wide)


def planted(known: DataFrame) -> DataFrame:
    """Short texts with one labelled candidate each, from rows (part, kind, match, behind, ahead): disguised base spans and look-alikes."""
    m, h = F.col("match"), F.xxhash64("match", "behind")
    df = known.withColumns({"h": h, "n": F.lpad(F.pmod(h, F.lit(10**15)).cast("string"), 15, "0"), "d": digits_of(m)})
    digits = lambda at, size: F.substring("n", at, size)
    small = lambda salt, least, most: (F.pmod(F.xxhash64("h", F.lit(salt)), F.lit(most - least + 1)) + least).cast("string")
    two = lambda salt, least, most: F.lpad(small(salt, least, most), 2, "0")
    day, month, year, hour, minute = two(1, 1, 28), two(2, 1, 12), F.concat(F.lit("20"), two(3, 0, 29)), two(4, 0, 23), two(5, 0, 59)
    local, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    label = F.substring_index(host, ".", 1)
    fours = lambda number, sep: F.regexp_replace(number, "(.{4})(?=.)", f"$1{sep}")
    # The last digit moved by one breaks every check sum.
    wrong = F.concat(F.substring("d", F.lit(1), F.length("d") - 1), F.pmod(F.substring("d", -1, 1).cast("int") + 1, F.lit(10)).cast("string"))
    c = F.concat
    good = {
        "email": [c(local, F.lit(" (at) "), host), c(local, F.lit("[at]"), host), c(local, F.lit(" (at) "), F.replace(host, F.lit("."), F.lit(" (dot) "))), c(local, F.lit("@"), F.replace(host, F.lit("."), F.lit("[dot]")))],
        "ip": [F.replace(m, F.lit("."), F.lit(s)) for s in (",", ". ", ":")] + [F.regexp_replace(m, "\\.([0-9]+)$", ":$1")],
        "card": [fours(F.col("d"), s) for s in (".", "/", "_", "  ")],
        "phone": [F.regexp_replace(m, "^\\+", "00"), c(F.lit("+"), F.regexp_replace(F.substring(m, 2, 99), "[^0-9]+", "/")), F.regexp_replace(m, "^\\+[0-9]{1,3}\\x20?(?=[^0-9])", ""), c(F.lit("00"), F.regexp_replace(F.substring(m, 2, 99), "[^0-9]+", "."))],
    }
    bad = {
        "email": [c(local, F.lit("@"), label), c(local, F.lit(" (at) "), F.regexp_replace(label, "[0-9]", "")), c(F.lit("v"), digits(1, 2), F.lit("@"), digits(3, 3))],
        "ip": [c(day, F.lit("."), month, F.lit(" "), hour, F.lit(":"), minute), c(small(6, 1, 9), *[x for i in (1, 4, 7) for x in (F.lit(","), digits(i, 3))]),
               c(small(6, 1, 20), F.lit("."), small(7, 0, 20), F.lit("."), small(8, 256, 999), F.lit("."), small(9, 256, 999)), c(small(6, 1, 9), *[x for i in (7, 8, 9) for x in (F.lit(", "), small(i, 1, 99))]), c(year, F.lit("."), month, F.lit("."), day, F.lit("."), small(6, 1, 9))],
        "card": [fours(wrong, "."), fours(wrong, "/"), c(year, F.lit("-"), month, F.lit("-"), day, F.lit(" "), hour, minute, digits(1, 2)), c(digits(1, 2), F.lit("."), digits(3, 2), F.lit(" "), digits(5, 2), F.lit("."), digits(7, 2), F.lit(" "), digits(9, 2), F.lit("."), digits(11, 2)), wrong],
        "phone": [c(year, F.lit("-"), month, F.lit("-"), day), c(day, F.lit("."), month, F.lit("."), year), c(small(6, 1, 9), *[x for i in (1, 4) for x in (F.lit("."), digits(i, 3))]), digits(1, 9), c(year, F.lit("-"), year), digits(1, 12), c(F.lit("2"), digits(1, 7))],
    }
    example = lambda value, body, glue: F.struct(F.lit(value).alias("label"), body.alias("body"), F.lit(glue).alias("glue"))
    per_kind = [
        F.array(*[example(1.0, b, "") for b in good[k]], *[example(0.0, b, "") for b in bad[k]], *([example(0.0, digits(1, 13), "c"), example(0.0, digits(2, 9), "e")] if k in ("card", "phone") else []))
        for k in KINDS
    ]
    df = df.select("part", "kind", "behind", "ahead", "h", F.posexplode(F.get(F.array(*[F.when(F.col("kind") == i, a) for i, a in enumerate(per_kind)]), F.col("kind"))).alias("pos", "x"))
    draw = F.pmod(F.xxhash64("h", "pos"), F.lit(8)).cast("int")
    personal = F.get(F.array(*[F.lit(w) for w in ("mail: ", "host ", "card: ", "phone ")]), F.col("kind"))
    plain = F.get(F.array(*[F.lit(w) for w in ("order ", "total ", "no. ", "on ")]), F.pmod("h", F.lit(4)).cast("int"))
    cue = F.when(F.col("x.label") == 1, F.when(draw < 4, personal).otherwise("")).otherwise(F.when(draw == 0, personal).when(draw < 5, plain).otherwise(""))
    before = F.concat("behind", cue, "x.glue")
    return df.select("part", "kind", F.col("x.label").alias("label"), F.length(before).alias("from"), (F.length(before) + F.length("x.body")).alias("to"), F.concat(before, "x.body", "x.glue", "ahead").alias("text"))


def compile_trees(model) -> Callable[[Column], Column]:
    """The raw score of a boosted model as an expression over an array of feature values."""

    def node(n, f: Column) -> Column:
        if n.getClass().getSimpleName() == "LeafNode":
            return F.lit(float(n.prediction()))
        split = n.split()
        return F.when(F.get(f, F.lit(split.featureIndex())) <= float(split.threshold()), node(n.leftChild(), f)).otherwise(node(n.rightChild(), f))

    def score(f: Column) -> Column:
        total = F.lit(0.0)
        for weight, tree in zip(model.treeWeights, model.trees):
            total = total + F.lit(float(weight)) * node(tree._call_java("rootNode"), f)
        return total

    return score


def examples(docs: DataFrame, text: str, id_col: str | None, sample_docs: int) -> DataFrame:
    """Labelled candidates (part, kind, label, f) of a bounded sample of documents; see the module."""
    share = min(1.0, sample_docs / max(docs.count(), 1))
    key = [F.col(id_col)] if id_col else []
    drawn = docs.where(drawn_share(share, F.lit("pii"), *key, F.col(text))).select(F.col(text).alias("text"))
    strange = lambda c: F.exists("_base", lambda b: (b["kind"] != c["kind"]) & _cross(b, c)) & ~F.exists("_base", lambda b: (b["kind"] == c["kind"]) & _cross(b, c))
    part = F.pmod(F.xxhash64(F.lit("part"), "text"), F.lit(10))
    found = stored(propose(drawn).select(part.alias("part"), "_known", F.filter(F.slice("_wide", 1, SAMPLE_SPANS), strange).alias("own")), "proposed")
    own = found.select("part", F.explode("own").alias("c")).select("part", "c.kind", F.lit(0.0).alias("label"), "c.f")
    texts = stored(planted(stored(found.select("part", F.explode("_known").alias("k")).select("part", "k.*"), "known")), "planted")
    hit = lambda c: (c["start"] == F.col("from")) & (c["end"] == F.col("to")) & (c["kind"] == F.col("kind"))
    made = propose(texts).select("part", "kind", "label", F.explode(F.filter("_wide", hit)).alias("c")).select("part", "kind", "label", "c.f")
    return stored(own.unionByName(made).select("*", *[F.get("f", F.lit(i)).alias(f"_{n}") for i, n in enumerate(FEATURES)]), "candidates")


def fit(docs: DataFrame, text: str = "text", id_col: str | None = None, sample_docs: int = SAMPLE_DOCS) -> tuple[Callable[[Column, Column], Column], list[float]] | None:
    """Calibrated boosted trees as an expression of features and kind, and a threshold per kind (above 1: add none)."""
    sample = examples(docs, text, id_col, sample_docs)
    train, curve, judge = sample.where("part < 6"), sample.where("part in (6, 7)"), sample.where("part > 7")
    if any(t.select("label").distinct().count() < 2 for t in (train, curve)):
        return None
    learner = GBTClassifier(labelCol="label", featuresCol="v", maxIter=16, maxDepth=4, maxBins=32, stepSize=0.3, seed=7)
    model = learner.fit(VectorAssembler(inputCols=[f"_{n}" for n in FEATURES], outputCol="v").transform(train.coalesce(4)))
    score = compile_trees(model)
    margins = curve.withColumn("p", fixed(score(F.col("f"))))
    each = {f"c{j}{i}": F.when(F.col("kind") == i, F.col("p") if j else F.lit(1.0)).otherwise(0.0) for i in range(len(KINDS)) for j in (0, 1)}
    platt = LogisticRegression(labelCol="label", featuresCol="v", fitIntercept=False, standardization=False, regParam=1e-4)
    weights = platt.fit(VectorAssembler(inputCols=list(each), outputCol="v").transform(margins.select("label", *[c.alias(n) for n, c in each.items()]))).coefficients
    base, slope = [[float(weights[2 * i + j]) for i in range(len(KINDS))] for j in (0, 1)]
    of = lambda values, kind: F.get(F.array(*[F.lit(v) for v in values]), kind)
    probability = lambda f, kind: 1 / (1 + F.exp(-(of(base, kind) + of(slope, kind) * score(f))))
    grid = [i / 20 for i in range(10, 20)]
    held = judge.withColumn("p", fixed(probability(F.col("f"), F.col("kind"))))
    stats = held.groupBy("kind").agg(*[F.sum(F.when(F.col("p") >= t, F.col("label"))).alias(f"h{i}") for i, t in enumerate(grid)], *[F.sum(F.when(F.col("p") >= t, 1.0)).alias(f"n{i}") for i, t in enumerate(grid)])
    thresholds = [2.0] * len(KINDS)
    for r in stats.collect():  # one row a kind
        right = [t for i, t in enumerate(grid) if (r[f"h{i}"] or 0) >= max(LEAST_POSITIVE, PRECISION * (r[f"n{i}"] or 0))]
        # A falling curve means that the trees rank this kind wrongly.
        thresholds[r["kind"]] = right[0] if right and slope[r["kind"]] > 0 else 2.0
    return probability, thresholds


def find(docs: DataFrame, text: str = "text", id_col: str | None = None, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: arrays of (start, kind, end) in order, kind an index into ``KINDS``."""
    learnt = fit(docs, text, id_col, sample_docs)
    df = propose(docs, text)
    spans = F.col("_base")
    if learnt is not None:
        probability, thresholds = learnt
        limits = F.array(*[F.lit(t) for t in thresholds])
        # Best first: probability, then length, then place.
        rated = F.transform("_wide", lambda c: F.struct(
            probability(c["f"], c["kind"]).alias("p"), (c["end"] - c["start"]).alias("size"), (-c["start"]).alias("first"), (-c["kind"]).alias("order"), c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"),
        ))
        df = df.withColumn("_rated", fixed(F.sort_array(F.filter(rated, lambda c: c["p"] >= F.get(limits, c["kind"])), asc=False)))
        add = lambda s, c: F.when(F.exists(s, lambda b: _cross(b, c)), s).otherwise(F.concat(s, F.array(F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))))).cast(f"array<{SPAN}>")
        spans = F.sort_array(F.aggregate("_rated", F.col("_base").cast(f"array<{SPAN}>"), add))
    return df.withColumns({"base_spans": F.col("_base"), "spans": fixed(spans)}).drop("_base", "_known", "_wide", "_source", "_rated")


def spelled(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; spans that overlap become one replacement."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    state = "struct<at:int,out:array<string>>"

    def add(s: Column, x: Column) -> Column:
        fresh = F.array(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.get(names, x["kind"]))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], F.concat(s["out"], fresh)).otherwise(s["out"]).alias("out")).cast(state)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(state)
    return F.aggregate(spans, start, add, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
