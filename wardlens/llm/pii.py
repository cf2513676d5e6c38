"""Personal data by boosted trees over candidate spans, in DataFrame functions only.

Generators of high recall propose spans, which may overlap: the four base kinds (email, ip, card,
phone), and looser ones (`GENERATORS`). Each candidate has small whole-number features of its format
and context (digits, length, separators, the characters and words before it), and a test of its kind,
which the trees do not see: a Luhn sum for cards and long numbers, the remainder by 97 for IBANs, valid
groups for social security numbers, a plus or a word such as `call` before telephone numbers, the form
of an email for mailboxes. There are no labels for spans, so the trees learn the tests from format and
context: their score is the share of spans looking like this one that pass.

What passes a checksum may do so by chance, a known share of all digits (`CHANCE`). From the score
follows how many of the spans that look alike are personal data, and so how likely one that passes is:
digit runs that pass no more often than chance are left alone, whatever their own sum says. Telephone
numbers and mailboxes have no checksum; of these the trees add spans that fail their test but look like
those that pass. Per kind, the threshold is the lowest score that keeps the wanted precision on the
half of the documents not fitted on, and never under even odds. Base spans that pass their own test are
always selected; counts and digest of the base kinds hold only these.

Feature values are few, so candidates of all documents are counted by their features in Spark; this
table of cells is bounded by the product of the features' ranges, and only it comes to the driver,
where the trees are fitted. They score as one CASE expression.

Spans come from `split` and `regexp_extract_all` of the same pattern: the lengths of pieces and
matches, added up, are the positions (code points, end exclusive). Patterns use possessive
repetition and start at the edge of a run of characters, which gives the same matches, needs no
stack and stays linear on long runs.

Null and empty texts have no spans, very long ones are scanned in linear time, an empty table gives an
empty result. Rows are scanned one by one, so repeated rows and null doc_ids keep
their own rows; columns besides doc_id and text are not read. With no candidates at all, nothing is
added to the base spans.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.llm.boosting import Trees, fit

# Fixed values
BASE = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "tel": r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "number": r"(?<![0-9A-Za-z])[0-9]{9,30}+(?![0-9A-Za-z])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "mailbox": r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]{1,64}+ ?[\[(]?(?:@|at)[\])]? ?[A-Za-z0-9-]{1,63}+ ?[\[(]?(?:\.|dot)[\])]? ?[A-Za-z]{2,10}+",
}
KINDS = (*BASE, *GENERATORS)
#: A character that a kind's matches must have, to skip texts without it.
NEEDED = {"email": "@", "phone": "+", "ip": "."}
#: Characters that a match needs to be a candidate: no shorter one can pass its test, and a text may
#: be full of numbers.
LEAST = {"card": 13, "phone": 8}
#: Matches placed together; an aggregate copies its state with each element, so runs stay short.
RUN = 200
CONTEXT = r"(?i)(?:tel|phone|call|mail|contact|card|visa|iban|account|number|ssn)\W{0,3}(?:is|no|nr)?\W{0,4}$"
CALLED = r"(?i)(?:tel|telephone|phone|mobile|fax|call|contact)\W{0,3}(?:is|no|nr)?\W{0,4}$"
SSN = r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"
FEATURES = ("kind", "digits", "length", "marks", "before", "context")
#: Values of each feature: 0 up to this.
RANGES = (len(KINDS) - 1, 7, 6, 4, 3, 1)
#: Share of random digits that pass the checksum of a kind; of cards and numbers, those of 13 to 19 digits.
CHANCE = {"card": 1 / 10, "number": 1 / 10, "iban": 1 / 97}
LONG_DIGITS = 5  # the level of the feature `digits` from 13 digits on
#: Kinds without a checksum, whose spans may be selected though their test does not speak for them.
UNTESTED = ("tel", "mailbox")
PRECISION, EVEN = 0.8, 0.5


def luhn(digits: Column) -> Column:
    """True where the digits pass the Luhn sum; the last digit counts once, the one before twice."""
    turned = F.split(F.reverse(digits), "")

    def value(d: Column, i: Column) -> Column:
        n = F.coalesce(d.try_cast("int"), F.lit(0)) * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(n > 9, n - 9).otherwise(n)

    total = F.aggregate(F.transform(turned, value), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes(kind: str, value: Column) -> Column:
    """The test of a base kind; of a looser kind, false."""
    digits = _digits(value)
    n = F.length(digits)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.split(value, r"\.")
        small = F.forall(parts, lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3)
        value_of = lambda p: F.coalesce(p.try_cast("bigint"), F.lit(0))
        return small & F.forall(parts, lambda p: value_of(p) <= 255)
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(False)


def iban(value: Column) -> Column:
    """True where capitals and digits, the first four moved to the end, leave 1 of 97."""
    moved = F.split(F.concat(F.substring(value, 5, 64), F.substring(value, 1, 4)), "")

    def step(rest: Column, c: Column) -> Column:
        n = F.ascii(c)
        return F.when(n >= 65, rest * 100 + n - 55).otherwise(rest * 10 + n - 48) % 97

    return F.aggregate(F.filter(moved, lambda c: c != ""), F.lit(0), step) == 1


def resembles(kind: str, value: Column, before: Column) -> Column:
    """Whether a candidate is personal data by the test of its kind, which may be a looser one."""
    n = F.length(_digits(value))
    card = F.when(n.between(13, 19), luhn(_digits(value))).otherwise(False)
    called = F.concat(before, value).rlike(PATTERNS["phone"] + "$")
    if kind == "card":
        return card
    if kind == "tel":
        return called | before.rlike(CALLED)
    if kind == "number":
        return card | called | (n.between(9, 15) & before.rlike(CALLED))
    if kind == "iban":
        return iban(value)
    if kind == "ssn":
        return value.rlike(SSN)
    if kind == "mailbox":
        return value.rlike(f"^{PATTERNS['email']}$")
    return passes(kind, value)


def _level(value: Column, *bounds: int) -> Column:
    """How many of the bounds the value reaches."""
    return sum(((value >= b).cast("int") for b in bounds), F.lit(0))


def _features(kind: int, value: Column, before: Column) -> list[Column]:
    digits = _digits(value)
    n = F.length(digits)
    last = F.substring(before, -1, 1)
    side = (
        F.when(last.rlike("[0-9A-Za-z]"), 3).when(last.rlike(r"[+(@=\"':]"), 2).when(last == "", 1)
    )
    return [
        F.lit(kind),
        _level(n, 1, 4, 8, 10, 13, 16, 20),
        _level(F.length(value), 8, 11, 15, 18, 24, 40),
        _level(F.length(F.regexp_replace(value, r"[^ ().@-]", "")), 1, 2, 3, 4),
        F.coalesce(side, F.lit(0)),
        before.rlike(CONTEXT).cast("int"),
    ]


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def _in_runs(items: Column, size: Callable[[Column], Column], use) -> Column:
    """`use(run, at)` of each run of RUN items, joined; `at` is the size of all items before it."""
    runs = _held(
        items,
        lambda all_: F.transform(
            F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / RUN).cast("int")),
            lambda i: F.slice(all_, i * RUN + 1, F.lit(RUN)),
        ),
    )
    total = lambda run: F.aggregate(run, F.lit(0), lambda a, x: a + size(x))
    starts = lambda runs: F.aggregate(
        F.transform(runs, total),
        F.array(F.lit(0)),
        lambda before, n: F.array_append(before, F.element_at(before, -1) + n),
    )
    joined = lambda runs, at: F.flatten(F.transform(runs, lambda run, i: use(run, at[i])))
    return _held(runs, lambda r: _held(starts(r), lambda at: joined(r, at)))


def candidates(text: Column, kind: int) -> Column:
    """array<struct<kind, start, end, passes, f0..f7>> of one generator, in order of place."""
    name = KINDS[kind]
    pattern = {**PATTERNS, **GENERATORS}[name]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    zipped = F.arrays_zip(pieces.alias("piece"), found.alias("value"))

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["piece"])
        end = start + F.length(pair["value"])
        item = F.struct(
            F.lit(kind).alias("kind"),
            start.alias("start"),
            end.alias("end"),
            pair["value"].alias("value"),
            F.right(pair["piece"], F.lit(24)).alias("before"),
        )
        long = F.length(pair["value"]) >= LEAST.get(name, 1)
        more = F.when(long, F.array_append(state["all"], item)).otherwise(state["all"])
        return F.struct(F.coalesce(end, start).alias("at"), more.alias("all"))

    kind_type = "array<struct<kind:int,start:int,end:int,value:string,before:string>>"
    length = lambda p: F.length(p["piece"]) + F.coalesce(F.length(p["value"]), F.lit(0))
    placed = _in_runs(
        zipped,
        length,
        lambda run, at: F.aggregate(
            run,
            F.struct(at.alias("at"), F.array().cast(kind_type).alias("all")),
            add,
            lambda state: state["all"],
        ),
    )

    def judged(c: Column) -> Column:
        features = _features(kind, c["value"], c["before"])
        ok = F.coalesce(passes(name, c["value"]), F.lit(False))
        sure = ok | F.coalesce(resembles(name, c["value"], c["before"]), F.lit(False))
        named = [f.cast("int").alias(f"f{i}") for i, f in enumerate(features)]
        return F.struct(
            c["kind"], c["start"], c["end"], ok.alias("passes"), sure.alias("sure"), *named
        )

    item_type = "struct<kind:int,start:int,end:int,passes:boolean,sure:boolean," + ",".join(
        f"f{i}:int" for i in range(len(FEATURES))
    ) + ">"
    nothing = F.array().cast(f"array<{item_type}>")
    there = F.contains(text, F.lit(NEEDED[name])) if name in NEEDED else F.lit(True)
    met = F.when(there, text.rlike(pattern)).otherwise(False)
    return F.when(met, F.transform(placed, judged).cast(f"array<{item_type}>")).otherwise(nothing)


def with_candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and the candidates of all generators in one array."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    all_kinds = [candidates(F.col("text"), k) for k in range(len(KINDS))]
    return base.withColumn("candidates", F.concat(*all_kinds))


def genuine_from(share: float, chance: float) -> float:
    """The score from which a span that passes is personal data with at least the odds of `share`.

    Of spans that look alike a share g is personal data and passes; of the others `chance` pass. So the
    score is g + (1 - g) chance, and a span that passes is personal data with probability g / score.
    """
    g = share * chance / (1 - share + share * chance)
    return g + (1 - g) * chance


def _logit(p: float) -> float:
    p = min(max(p, 1e-9), 1 - 1e-9)
    return float(np.log(p / (1 - p)))


@dataclass(frozen=True)
class PiiModel:
    """Boosted trees, and the score from which each kind's other spans are selected (over 1: never)."""

    trees: Trees | None
    thresholds: tuple[float, ...]

    def margin(self, features: list[Column]) -> Column:
        """The trees as an expression."""
        trees = self.trees

        def branch(node: int) -> Column:
            if trees.left[node] == node:
                return F.lit(float(trees.value[node]))
            test = features[trees.feature[node]] <= F.lit(float(trees.threshold[node]))
            return F.when(test, branch(trees.left[node])).otherwise(branch(trees.right[node]))

        return sum((branch(int(r)) for r in trees.roots), F.lit(trees.base))

    def selects(self, candidate: Column) -> Column:
        base = candidate["passes"] & (candidate["kind"] < len(BASE))
        if self.trees is None:
            return base
        features = [candidate[f"f{i}"] for i in range(len(FEATURES))]
        least = F.lit(None).cast("double")  # the margin that a span needs; null: none will do
        for kind, name in enumerate(KINDS):
            t = self.thresholds[kind]
            if t > 1:
                continue
            asked = candidate["sure"] & scored_by_chance(name, features[1])
            if name in UNTESTED:
                asked = ~candidate["sure"]
            least = F.when((candidate["kind"] == kind) & asked, F.lit(_logit(t) - 1e-6)).otherwise(least)
        plain = candidate["sure"] & ~candidate_by_chance(candidate["kind"], features[1])
        scored = F.when(~plain & least.isNotNull(), self.margin(features) >= least)
        return base | plain | F.coalesce(scored, F.lit(False))


def scored_by_chance(name: str, digits: Column) -> Column:
    """Whether a span of this kind passes its test by chance now and then: it has a checksum."""
    return F.lit(True) if name == "iban" else (F.lit(name in CHANCE) & (digits >= LONG_DIGITS))


def candidate_by_chance(kind: Column, digits: Column) -> Column:
    tested = [(kind == k) & scored_by_chance(name, digits) for k, name in enumerate(KINDS) if name in CHANCE]
    return tested[0] | tested[1] | tested[2]


def cells(docs: DataFrame) -> DataFrame:
    """Candidates counted by features: half of the documents to fit, half to set thresholds."""
    found = with_candidates(docs).select(
        (F.pmod(F.xxhash64("doc_id", "text"), F.lit(2)) == 0).alias("fits"),
        F.explode("candidates").alias("c"),
    )
    features = [F.col(f"c.f{i}").alias(name) for i, name in enumerate(FEATURES)]
    told = found.select("fits", F.col("c.sure").cast("long").alias("positive"), *features)
    return told.groupBy("fits", *FEATURES).agg(
        F.count("*").alias("n"), F.sum("positive").alias("n_positive")
    )


def fit_pii(docs: DataFrame, precision: float = PRECISION) -> PiiModel:
    """Trees and thresholds; the cells are at most twice the product of RANGES plus one each."""
    rows = cells(docs).collect()
    if not rows:
        return PiiModel(None, (2.0,) * len(KINDS))
    rows.sort(key=lambda r: tuple(r))
    x = np.array([[r[name] for name in FEATURES] for r in rows], np.float64)
    n = np.array([r["n"] for r in rows], np.float64)
    yes = np.array([r["n_positive"] for r in rows], np.float64)
    fits = np.array([r["fits"] for r in rows])

    def doubled(mask):
        """Each cell as a positive and a negative row with its counts."""
        weight = np.concatenate([yes[mask], (n - yes)[mask]])
        label = np.concatenate([np.ones(mask.sum()), np.zeros(mask.sum())])
        return np.vstack([x[mask], x[mask]]), label, weight

    trees = fit(*doubled(fits), rounds=24, depth=3, rate=0.3, least=2.0)
    score = trees.probability(x)
    thresholds = [
        threshold(name, score[own], yes[own], n[own], precision)
        for name, own in ((name, ~fits & (x[:, 0] == k) & _asked(name, x[:, 1])) for k, name in enumerate(KINDS))
    ]
    return PiiModel(trees, tuple(thresholds))


def _asked(name: str, digits: np.ndarray) -> np.ndarray:
    """The cells whose spans the trees decide on."""
    return digits >= LONG_DIGITS if name in ("card", "number") else np.full(len(digits), name in CHANCE or name in UNTESTED)


def threshold(name: str, score: np.ndarray, yes: np.ndarray, n: np.ndarray, precision: float) -> float:
    """The lowest score that keeps the precision among the spans it selects; 2 where none does.

    With a checksum, these are spans that pass: of n spans of which `yes` pass, (yes - chance n) / (1 - chance)
    are personal data, by the odds; one such span is taken as seen, so few spans do not forbid a kind.
    Without one, the spans that pass are the share of those selected that is known to be personal data.
    """
    chance = CHANCE.get(name, 0.0)
    order = np.argsort(-score, kind="stable")
    s = score[order]
    passed, of = np.cumsum(yes[order]), np.cumsum(n[order])
    if chance:
        floor = genuine_from(EVEN, chance)
        right, selected = (passed - chance * of) / (1 - chance) + 1, passed + 1
    else:
        floor, right, selected = EVEN, passed, of
    last = np.append(s[1:] < s[:-1], True)[: len(s)]  # a threshold takes all of equal score
    good = np.flatnonzero(last & (right >= precision * selected))
    if not len(s):
        return floor if chance else 2.0
    return float(max(s[good[-1]], floor)) if len(good) else 2.0


def _listed(spans: Column) -> Column:
    """kind:start:end by kind, then start, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    written = F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"]))),
        lambda s: F.concat(
            F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"),
            s["end"].cast("string"),
        ),
    )
    return F.array_join(written, ",")


def find_pii(docs: DataFrame, model: PiiModel) -> DataFrame:
    """One row per row of `docs`: counts, spans, and the text with selected spans replaced."""
    found = with_candidates(docs).select(
        "doc_id", "text", F.filter("candidates", model.selects).alias("chosen")
    )
    base = F.filter("chosen", lambda s: s["passes"] & (s["kind"] < len(BASE)))

    def number(kind: int) -> Column:
        return F.size(F.filter("chosen", lambda s: s["passes"] & (s["kind"] == kind))).cast("long")

    counts = [number(kind).alias(f"n_{name}") for kind, name in enumerate(BASE)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("chosen")).alias("spans"),
        redacted(F.col("text"), F.col("chosen")).alias("redacted"),
    )


def redacted(text: Column, spans: Column, mark: str = "[PII]") -> Column:
    """The text with each stretch covered by spans replaced by `mark`."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"])))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        out = F.when(fresh, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    tail = lambda st: F.concat(st["out"], F.substring(text, st["at"] + 1, F.length(text)))
    return F.aggregate(order, start, step, tail)
