"""Personal data by weak supervision, in DataFrame functions only.

Fixed patterns give base spans (e-mail, IP address, card, phone), which always
stay. One wide pattern proposes further candidates: written-out addresses, base matches that failed their check, shorter cards,
numbers without a plus sign, IPv6 addresses, and secrets (keys, tokens and
passwords), a kind of its own after the others. On base spans and candidates
alike labelers vote yes, no or not at all: a strict regular expression, a
checksum or range check, a gazetteer of prefixes, endings and issuers, a context
of cue words, and a shape of separators. Expectation-maximisation over the
counts of vote patterns (3^5 for each kind at most, whatever the input)
estimates each labeler's reliability without labels. The posteriors then train
the final span classifier, a logistic regression on votes and span features, by
damped Newton steps over counts; it decides on the candidates.

Nothing is shuffled but those counts: the classifier is a handful of numbers, so
that a second pass over the texts applies it where the candidates are found.
Prefix sums over a text's matches go in two levels, so that a text with very
many matches costs little more than its length. Each step is a column by itself,
because lambdas within lambdas are slow to analyse and may compute things again.

Defined cases: a null text is empty and has no spans; repeated rows get equal
results; a kind without base spans and candidates learns nothing; an empty table
gives no rows; other columns are ignored by found() and kept by redacted().
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, text_or_empty

#: Kinds with base spans, and those that candidates may have.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
# Each pattern gives the same leftmost non-overlapping matches as the contract's, in time linear in the text and without
# nested repetition: a match may begin only where the character class begins or the last match ended, lookaheads stand
# for greedy groups, and numbers of digits are bounded because failing matches are dropped.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])[A-Za-z0-9.-]+?(?=\.\.|\.?(?![A-Za-z0-9.-]))",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NAMED = r"(?:passwo?r?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key)"
_AT, _DOT = r"\x20?(?:\(at\)|\[at\]|\{at\})\x20?", r"\x20?(?:\(dot\)|\[dot\]|\{dot\}|\.)\x20?"
# Base patterns come along, so that no candidate begins within a base span; their matches are evidence, and candidates where
# they fail their check.
CANDIDATES = (
    r"(?<![A-Za-z0-9])(?i:" + _NAMED + r")\x20?[=:]\x20?[\"']?[A-Za-z0-9+/_.-]{6,200}",
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])[A-Za-z0-9.-]+?(?=\.\.|\.?(?![A-Za-z0-9.-]))",
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?i:" + _AT + r")[A-Za-z0-9-]{1,63}(?i:" + _DOT + r"[A-Za-z0-9-]{1,63}){1,4}",
    r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    r"(?<![A-Za-z0-9.])[0-9]{1,9}(?:\.[0-9]{1,9}){3}(?![0-9]|\.[0-9])",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    r"(?<![A-Za-z0-9.])(?<![0-9][\x20-])(?:[0-9]{4}[.·_/][0-9]{4}[.·_/][0-9]{4}[.·_/][0-9]{4}|[0-9](?:[\x20-]?[0-9]){12,18})(?![A-Za-z0-9]|[\x20-][0-9])",
    r"(?<![A-Za-z0-9+.)-])(?<![0-9+)]\x20)(?:(?:\([0-9]{3}\)\x20?|00[0-9]{1,3}[\x20-]|[0-9]{3}[\x20.-])?[0-9]{3}[\x20.-][0-9]{4}|[0-9]{9,11})(?![A-Za-z0-9]|[\x20.-][0-9])",
    r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA|ghp_|sk-|xox[bp]-)[A-Za-z0-9_-]{10,200}|(?=[0-9]{0,64}[A-Za-z])(?=[A-Za-z]{0,64}[0-9])[A-Za-z0-9]{16,200}(?![A-Za-z0-9]))",
)
# Within a word only an IPv6 address and a number with a plus sign can begin: most places are passed by at one look.
WIDE = r"(?=[A-Za-z0-9._%+(-])(?:(?<![A-Za-z0-9])(?:" + "|".join(CANDIDATES) + r")|(?<=[A-Za-z0-9])(?=[0-9A-Fa-f+])(?:" + "|".join((CANDIDATES[3], CANDIDATES[5])) + "))"
#: A text without these has no match.
NEEDS = {"email": r"@", "ip": r"[0-9][.]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
# letter by letter: the classes of a pattern that ignores case are slower, and every text is searched for these
WIDE_NEEDS = r"(?=[@0-9(\[{pPsStTkK])(?:@|[0-9][0-9:.-]{2}|[0-9]{2}\x20[0-9]|[(\[{][aA][tT][)\]}]|[pP](?:[aA][sS][sS][wW]|[wW][dD])|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[kK][eE][yY])"
# The words of the gazetteers and contexts, and the strict forms.
CUES = {
    "email": r"(?i)e-?mail|mail|contact|write|reach|correo|courriel|kontakt|adress",
    "ip": r"(?i)\bip\b|address|server|host|login|client|adresse",
    "card": r"(?i)card|visa|master|amex|credit|debit|karte|carte|tarjeta|paid|payment",
    "phone": r"(?i)phone|tel|call|mobile|fax|cell|ring|anruf|appel|llama|contact",
    "secret": r"(?i)key|token|secret|passw|login|credential|auth",
}
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|io|de|fr|es|uk|info|example|co)$|(?:gmail|yahoo|outlook|hotmail|proton)",
    "ip": r"^(?:10|127|172|192|2001|fe80|fd[0-9a-f]{2})[.:]",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\+?\(?0{0,2}(?:1|33|34|44|49|7|86|91)\b|^\(?[2-9][0-9]{2}\)?",
    "secret": r"(?i)^(?:" + _NAMED + r"|(?-i:AKIA|ASIA|ghp_|sk-|xox))",
}
STRICT = {
    "email": r"(?i)^[a-z0-9][a-z0-9._%+-]*(?:@|\x20?[(\[{]at[)\]}]\x20?)[a-z0-9-]+(?:(?:\.|\x20?[(\[{]dot[)\]}]\x20?|\x20?\.\x20?)[a-z0-9-]+)*(?:\.|\x20?[(\[{]dot[)\]}]\x20?)[a-z]{2,12}$",
    "ip": r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?!$)|$)){4}$|^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$",
    "card": r"^[0-9]{4}([\x20.·_/-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}$|^[0-9]{4}([\x20-]?)[0-9]{6}\2[0-9]{4,5}$",
    "phone": r"^\+[0-9][0-9\x20().-]*$|^(?:\([0-9]{3}\)\x20?|00[0-9]{1,3}[\x20-]|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}$",
    "secret": r"(?i)[=:]\x20?[\"']?[a-z0-9+/_.-]{8,}$|^(?-i:(?:AKIA|ASIA)[A-Z0-9]{16}|ghp_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|xox[bp]-[A-Za-z0-9-]{10,})$|^[0-9a-f]{32,}$",
}
EM_ROUNDS = 30
NEWTON_ROUNDS = 6
RIDGE = 1.0
#: Least posterior of the final classifier for a candidate to become a span.
ACCEPT = 0.9
VOTES = ("regex", "check", "gazetteer", "context", "shape")
FEATURES = ("length", "digits", "left")
_CONTEXT = 40
_WIDE = len(KINDS)  # what stands for the wide pattern among the numbers of base kinds


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _like(value: str, pattern: str) -> str:
    return f"{value} rlike {_lit(pattern)}"


# What is asked of a single span is SQL text over expressions for its value and what stands before it: a span's questions
# are many, and building them call by call took longer than answering them.
def digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def luhn(value: str) -> str:
    """Whether the (at most 20) digits of a value end in their Luhn check digit."""
    padded = f"lpad({digits(value)}, 20, '0')"
    doubled = f"translate(regexp_replace({padded}, '(.)(.)', '$1'), '0123456789', '0246813579')"
    both = f"concat(regexp_replace({padded}, '(.)(.)', '$2'), {doubled})"
    return "((" + " + ".join(f"{d} * (20 - char_length(translate({both}, '{d}', '')))" for d in range(1, 10)) + ") % 10 = 0)"


_QUAD = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"


def checked(kind: str, value: str) -> str:
    """The test that a base match of a kind must pass."""
    size = f"char_length({digits(value)})"
    return {"email": "true", "ip": _like(value, _QUAD), "card": f"({size} between 16 and 19 and {luhn(value)})", "phone": f"{size} between 8 and 15"}[kind]


def kind_of(value: str) -> str:
    """The kind of a match of the wide pattern."""
    numeric, size = _like(value, r"^[0-9\x20().·_/-]+$"), f"char_length({digits(value)})"
    return (
        f"case when {_like(value, GAZETTEER['secret'])} then 'secret' when {_like(value, r'@|(?i)[(\[{]at[)\]}]')} then 'email' when {value} like '+%' then 'phone' "
        f"when {_like(value, r'^[0-9]+(?:\.[0-9]+){3}$|^[0-9A-Fa-f]+(?::[0-9A-Fa-f]+){7}$')} then 'ip' when {numeric} and {size} >= 13 then 'card' when {numeric} then 'phone' else 'secret' end"
    )


def is_base(kind: str, value: str) -> str:
    """Whether a match of the wide pattern is a base span."""
    form = {"email": f"{value} like '%@%'", "ip": f"{value} like '%.%'", "card": _like(value, r"^[0-9]([\x20-]?[0-9])+$"), "phone": f"{value} like '+%'"}
    return f"case {kind} " + " ".join(f"when '{k}' then {form[k]} and {checked(k, value)}" for k in KINDS) + " else false end"


def votes(kind: str, value: str, before: str) -> dict[str, str]:
    """1 yes, 0 no, -1 no vote, of each labeler."""
    vote = lambda yes, no="false": f"case when {yes} then '1' when {no} then '0' else '-1' end"
    size, letter = f"char_length({digits(value)})", _like(value, "[A-Za-z]")
    check = {
        "email": _like(value, r"(?i)[a-z].*(?:@|at).*[a-z]"),
        "ip": f"(not {_like(value, r'^[0:.]+$')} and ({value} like '%:%' or {_like(value, _QUAD)}))",
        "card": luhn(value),
        "phone": f"({size} between 8 and 15)",
        "secret": f"({size} >= 3 and {letter})",
    }[kind]
    strict = _like(value, STRICT[kind])
    marks = f"char_length(regexp_replace({value}, '[A-Za-z0-9%+]', ''))"
    return {
        "regex": vote(strict, f"not {strict}"),
        "check": vote(check, f"not {check}"),
        "gazetteer": vote(_like(value, GAZETTEER[kind])),
        "context": vote(_like(before, CUES[kind]), _like(before, r"[0-9]\s*$|[/#]\s*$")),
        "shape": vote(f"{marks} <= 5", f"{marks} > 8"),
    }


def features(value: str, before: str) -> dict[str, str]:
    """Categories of a span that the final classifier weighs, besides the votes; few of each."""
    return {
        "length": f"string(least(char_length({value}) div 4, 10))",
        "digits": f"string(least(char_length({digits(value)}), 20))",
        "left": f"regexp_extract({before}, {_lit(r'([\p{Punct}0-9])?\s*$')}, 1)",
    }


def parts(kind: str, value: str, before: str) -> str:
    """A struct of the votes on a span of a kind, an expression, and its features."""
    of = {k: votes(k, value, before) for k in ALL_KINDS}
    fields = {v: f"case {kind} " + " ".join(f"when '{k}' then {of[k][v]}" for k in ALL_KINDS) + " end" for v in VOTES} | features(value, before)
    return "struct(" + ", ".join(f"{e} as {n}" for n, e in fields.items()) + ")"


@dataclass
class Model:
    """Weights of the final classifier for each kind; empty where nothing was learned."""

    prior: dict[str, float] = field(default_factory=dict)
    weights: dict[str, dict[str, dict[str, float]]] = field(default_factory=dict)
    reliability: dict[str, dict[str, tuple[float, float]]] = field(default_factory=dict)
    share: dict[str, float] = field(default_factory=dict)

    def log_odds(self, part: str) -> str:
        """Of a span whose kind is `kind` and whose votes and features are fields of part; null for a kind that nothing was learned of."""
        sums = {}
        for kind, prior in self.prior.items():
            tables = [(name, ", ".join(f"{_lit(c)}, {w!r}D" for c, w in sorted(t.items()))) for name, t in self.weights[kind].items() if t]
            sums[kind] = " + ".join([f"{prior!r}D", *(f"coalesce(map({t})[{part}{name}], 0D)" for name, t in tables)])
        return f"case {part}kind " + " ".join(f"when '{k}' then {e}" for k, e in sums.items()) + " end" if sums else "double(null)"


def _values(text: Column, pattern: str, needs: str) -> Column:
    return F.when(text.rlike(needs), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _steps(text: Column, values: Column, pattern: str, kind: int) -> Column:
    """The gap before each match, the match, and after all of them the last gap with no value."""
    steps = F.zip_with(F.split(text, pattern, -1), values, lambda g, v: F.struct(F.lit(kind).alias("kind"), F.char_length(g).alias("gap"), F.coalesce(F.char_length(v), F.lit(0)).alias("size"), v.alias("value"), F.right(g, F.lit(_CONTEXT)).alias("before")))
    return F.when(F.size(values) > 0, steps).otherwise(F.array().cast("array<struct<kind:int,gap:int,size:int,value:string,before:string>>"))


def _scanned(rows: DataFrame, column: str, name: str, value: Callable[[Column], Column], combine: Callable[[Column, Column], Column]) -> DataFrame:
    """rows with name: array<struct<reached:int,item>> of an array column: each item with the combined values (from 0) of those before it.

    Blocks of about the square root of the size are folded by themselves, and
    the blocks' totals after them: appending to one array would be quadratic.
    """
    item = rows.schema[column].dataType.elementType.simpleString()
    block, placed = f"_{name}_blocks", f"_{name}_placed"
    inner = f"array<struct<reached:int,item:{item}>>"
    fold = lambda s, x: F.struct(combine(s["acc"], value(x)).alias("acc"), F.concat(s["out"], F.array(F.struct(s["acc"].alias("reached"), x.alias("item")))).alias("out"))
    start = F.struct(F.lit(0).alias("acc"), F.array().cast(inner).alias("out"))
    rows = rows.withColumn(f"_{name}_width", F.greatest(F.ceil(F.sqrt(F.size(column))).cast("int"), F.lit(1)))
    width = F.col(f"_{name}_width")
    rows = rows.withColumn(block, F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(column) / width).cast("int") - 1, F.lit(0))), lambda b: F.aggregate(F.slice(column, b * width + 1, width), start, fold)))
    outer = F.struct(F.lit(0).alias("acc"), F.array().cast(f"array<struct<acc:int,out:{inner}>>").alias("out"))
    rows = rows.withColumn(placed, F.aggregate(block, outer, lambda s, b: F.struct(combine(s["acc"], b["acc"]).alias("acc"), F.concat(s["out"], F.array(F.struct(s["acc"].alias("acc"), b["out"].alias("out")))).alias("out")), lambda s: s["out"]))
    return rows.withColumn(name, F.flatten(F.transform(placed, lambda b: F.transform(b["out"], lambda m: F.struct(combine(b["acc"], m["reached"]).alias("reached"), m["item"].alias("item")))))).drop(block, placed, f"_{name}_width")


def _matched(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, _base and _wide: array<struct<kind,start,end,value,before>> of the matches in each text, in code points, end exclusive."""
    patterns = [*((BASE[k], NEEDS[k]) for k in KINDS), (WIDE, WIDE_NEEDS)]
    rows = docs.select(*keep, text_or_empty().alias("_text"))
    rows = rows.select("*", *(_values(F.col("_text"), p, n).alias(f"_v{i}") for i, (p, n) in enumerate(patterns)))
    rows = rows.select(*keep, F.char_length("_text").alias("_size"), F.concat(*(_steps(F.col("_text"), F.col(f"_v{i}"), p, i) for i, (p, _) in enumerate(patterns))).alias("_steps"))
    rows = _scanned(rows, "_steps", "_at", lambda x: x["gap"] + x["size"], lambda a, b: a + b)
    # the steps of each pattern add up to the size of the text
    begin = lambda m: (m["reached"] + m["item"]["gap"]) % F.col("_size")
    spans = F.transform(F.filter("_at", lambda m: m["item"]["value"].isNotNull()), lambda m: F.struct(m["item"]["kind"].alias("kind"), begin(m).alias("start"), (begin(m) + m["item"]["size"]).alias("end"), m["item"]["value"].alias("value"), m["item"]["before"].alias("before")))
    rows = rows.select(*keep, spans.alias("_all"))
    base = "filter(_all, m -> case m.kind " + " ".join(f"when {i} then {checked(k, 'm.value')}" for i, k in enumerate(KINDS)) + " else false end)"
    wide = f"transform(filter(_all, m -> m.kind = {_WIDE}), m -> struct({kind_of('m.value')} as kind, m.start, m.end, m.value, m.before))"
    rows = rows.select(*keep, F.expr(base).alias("_base"), F.expr(wide).alias("_wide"))
    return rows.select(*keep, "_base", F.expr(f"filter(_wide, m -> not {is_base('m.kind', 'm.value')})").alias("_wide"))


#: What a labeler is held to be before any span is seen: its rates of yes for personal data and for other spans. Random
#: digits pass a checksum once in ten times. The belief weighs as much as BELIEF of the spans.
BELIEFS = {"regex": (0.9, 0.4), "check": (0.995, 0.1), "gazetteer": (0.8, 0.4), "context": (0.7, 0.3), "shape": (0.9, 0.5)}
BELIEF = 2.0


def reliabilities(patterns: list[tuple[tuple[int, ...], float]], rounds: int = EM_ROUNDS) -> tuple[float, dict[str, tuple[float, float]]]:
    """(share of personal data, rates of yes for personal data and for other spans) by expectation-maximisation.

    patterns: the votes, in the order of VOTES, and how often they occur.
    """
    share, rates = 0.5, dict(BELIEFS)
    belief = 2 + BELIEF * sum(n for _, n in patterns)
    for _ in range(rounds):
        weighted = [(row, n, posterior(share, rates, row)) for row, n in patterns]
        yes, no = sum(n * p for _, n, p in weighted), sum(n * (1 - p) for _, n, p in weighted)
        share = min(0.99, max(0.01, (yes + 1) / (yes + no + 2)))
        for i, v in enumerate(VOTES):
            cast = [(row[i], n * p, n * (1 - p)) for row, n, p in weighted if row[i] >= 0]
            sums = [(sum(c[0] * c[side] for c in cast), sum(c[side] for c in cast)) for side in (1, 2)]
            rates[v] = tuple((hits + belief * prior) / (votes_ + belief) for (hits, votes_), prior in zip(sums, BELIEFS[v]))
    return share, rates


def posterior(share: float, rates: dict[str, tuple[float, float]], row: tuple[int, ...]) -> float:
    """Probability that a span with these votes is personal data; labelers vote independently given that."""
    odds = math.log(share / (1 - share))
    for v, x in zip(VOTES, row):
        yes, no = rates[v]
        odds += math.log(yes / no) if x == 1 else math.log((1 - yes) / (1 - no)) if x == 0 else 0.0
    return 1 / (1 + math.exp(-odds))


def fit(docs: DataFrame, rounds: int = EM_ROUNDS, steps: int = NEWTON_ROUNDS) -> Model:
    """Reliabilities by expectation-maximisation over vote patterns, then the final classifier."""
    texts = docs.select(text_or_empty().alias("_text")).select("_text", _values(F.col("_text"), WIDE, WIDE_NEEDS).alias("_v"))
    spans = texts.select(F.explode(_steps(F.col("_text"), F.col("_v"), WIDE, _WIDE)).alias("m")).select("m.value", "m.before").where("value is not null")
    kinds = spans.select(F.expr(kind_of("value")).alias("kind"), "value", "before")
    rows = kinds.select("kind", F.expr(parts("kind", "value", "before")).alias("p")).select("kind", "p.*")
    # one row for each combination of a kind's votes and categories: 5 x 3^5 x 11 x 21 x 43 at most, whatever the input
    evidence = materialize(rows.groupBy("kind", *VOTES, *FEATURES).agg(F.count("*").cast("double").alias("n")), "evidence")
    patterns: dict[str, list] = {}
    for r in evidence.groupBy("kind", *VOTES).agg(F.sum("n").alias("n")).collect():  # 5 x 3^5 rows at most
        patterns.setdefault(r.kind, []).append((tuple(int(r[v]) for v in VOTES), r.n))
    model = Model()
    for kind, counted in sorted(patterns.items()):
        model.share[kind], model.reliability[kind] = reliabilities(sorted(counted), rounds)
    if patterns:
        _train(model, evidence, steps)
    discard(evidence)
    return model


def _posteriors(model: Model) -> str:
    """posterior() in SQL, over the columns kind and VOTES."""
    odds = {}
    for kind, rates in model.reliability.items():
        terms = [f"{math.log(model.share[kind] / (1 - model.share[kind]))!r}D"]
        terms += [f"case {v} when '1' then {math.log(yes / no)!r}D when '0' then {math.log((1 - yes) / (1 - no))!r}D else 0D end" for v, (yes, no) in rates.items()]
        odds[kind] = " + ".join(terms)
    return "1 / (1 + exp(-(case kind " + " ".join(f"when '{k}' then {e}" for k, e in odds.items()) + " end)))"


def _train(model: Model, evidence: DataFrame, steps: int) -> None:
    """Logistic regression of the posteriors on the categories; a step is one aggregate over the stored counts.

    Each step divides a weight's slope by its curvature times the number of
    weights that a span adds up, which keeps the steps from overshooting.
    """
    names = (*VOTES, *FEATURES)
    for kind in model.reliability:
        model.prior[kind], model.weights[kind] = 0.0, {}
    target = evidence.select("*", F.expr(_posteriors(model)).alias("p"))
    entries = "explode(array(struct('' as name, '' as category), " + ", ".join(f"struct('{c}' as name, {c} as category)" for c in names) + "))"
    for _ in range(steps):
        now = target.select("*", F.expr(f"1 / (1 + exp(-({model.log_odds('')})))").alias("s")).selectExpr("kind", "n * (p - s) as slope", "n * s * (1 - s) as curve", f"{entries} as e")
        # a row for each category of a kind: 5 x 90 at most
        for r in now.groupBy("kind", "e.name", "e.category").agg(F.sum("slope").alias("slope"), F.sum("curve").alias("curve")).orderBy("kind", "name", "category").collect():
            table = model.weights[r.kind].setdefault(r.name, {}) if r.name else None
            before = model.prior[r.kind] if table is None else table.get(r.category, 0.0)
            after = before + (r.slope - RIDGE * before * (table is not None)) / (len(names) * r.curve / 2 + RIDGE)
            if table is None:
                model.prior[r.kind] = after
            else:
                table[r.category] = after


def count_of(spans: str, kind: str) -> Column:
    i = ALL_KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == i)).cast("long")


def found(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `base` and `spans`: arrays of (kind, start, end) by kind, then start; kind is a number in ALL_KINDS."""
    rows = _matched(docs, docs.columns)
    judged = f"transform(_wide, m -> struct(m.kind, m.start, m.end, {parts('m.kind', 'm.value', 'm.before')} as p))"
    rows = rows.select(*docs.columns, F.expr("transform(_base, m -> struct(m.kind, m.start, m.end))").alias("base"), F.expr(judged).alias("_wide"))
    flat = "transform(_wide, m -> struct(m.kind, m.start, m.end, " + ", ".join(f"m.p.{n}" for n in (*VOTES, *FEATURES)) + "))"
    number = f"int(array_position(array({', '.join(map(_lit, ALL_KINDS))}), m.kind)) - 1"
    taken = f"transform(filter(_wide, m -> coalesce({model.log_odds('m.')} >= {math.log(ACCEPT / (1 - ACCEPT))!r}D, false)), m -> struct({number} as kind, m.start, m.end))"
    rows = rows.select(*docs.columns, "base", F.expr(flat).alias("_wide"))
    return rows.select(*docs.columns, "base", F.expr(f"array_sort(concat(base, {taken}))").alias("spans"))


def rendered(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in ALL_KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _replaced(rows: DataFrame) -> DataFrame:
    """rows with clean: the text with spans replaced by their marks; those that overlap as their union, under the first one's mark.

    Pieces between marks are cut out of one substring for each block of about
    the square root of their number.
    """
    marks = F.array(*(F.lit(f"<{k}>") for k in ALL_KINDS))
    rows = rows.withColumn("_ordered", F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))
    rows = _scanned(rows, "_ordered", "_reach", lambda s: s["end"], lambda a, b: F.greatest(a, b))
    rows = rows.withColumn("_pieces", F.transform(F.filter("_reach", lambda m: m["item"]["start"] >= m["reached"]), lambda m: F.struct(m["reached"].alias("from"), m["item"]["start"].alias("to"), m["item"]["kind"].alias("kind"))))
    rows = rows.withColumn("_width", F.greatest(F.ceil(F.sqrt(F.size("_pieces"))).cast("int"), F.lit(1)))
    rows = rows.withColumn("_blocks", F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("_pieces") / F.col("_width")).cast("int") - 1, F.lit(0))), lambda b: F.slice("_pieces", b * F.col("_width") + 1, F.col("_width"))))
    first, last = lambda ps: F.get(ps, F.lit(0))["from"], lambda ps: F.try_element_at(ps, F.lit(-1))["to"]
    rows = rows.withColumn("_segments", F.transform("_blocks", lambda ps: F.struct(F.substring(F.col("text"), first(ps) + 1, last(ps) - first(ps)).alias("text"), first(ps).alias("first"), ps.alias("pieces"))))
    out = F.transform("_segments", lambda s: F.array_join(F.transform(s["pieces"], lambda p: F.concat(F.substring(s["text"], p["from"] - s["first"] + 1, p["to"] - p["from"]), F.get(marks, p["kind"]))), ""))
    tail = F.substring(F.col("text"), F.array_max(F.transform("spans", lambda s: s["end"])) + 1, F.char_length("text"))
    return rows.withColumn("clean", F.when(F.size("spans") > 0, F.concat(F.array_join(out, ""), tail)).otherwise(F.col("text")))


def redacted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with each span's text replaced by its kind in angle brackets; overlapping spans as their union."""
    # the documents go along as one struct, so that their columns may have any names
    rows = _replaced(found(docs.select(F.struct(*docs.columns).alias("doc"), "text"), model))
    changed = F.col("doc").withField("text", F.col("clean"))
    if "n_chars" in docs.columns:
        size = F.char_length("clean").cast(docs.schema["n_chars"].dataType)
        changed = changed.withField("n_chars", F.when(F.size("spans") > 0, size).otherwise(F.col("doc.n_chars")))
    return rows.select(changed.alias("doc")).select("doc.*")


def _counted(rows: DataFrame) -> list[Column]:
    return [F.col("doc_id"), *(count_of("base", k).alias(f"n_{k}") for k in KINDS), F.sha2(rendered(F.col("base")), 256).alias("base_sha256")]


def op3_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = found(docs, fit(docs))
    return rows.select(*_counted(rows), rendered(F.col("spans")).alias("spans"))


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op 3 alone, which SQL can express."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = found(docs, Model())
    return rows.select(*_counted(rows))


#: The contract's base spans in SQL; the learned spans are held against a plain restatement in the tests.
BASE_SQL = r"""
WITH p(k, kind, pattern) AS (VALUES
  (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'),
  (2, 'card', '[0-9](?:[\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')),
m AS (SELECT doc_id, k, kind, regexp_extract_all(coalesce(text, ''), pattern) AS v, regexp_split_to_array(coalesce(text, ''), pattern) AS g FROM documents, p),
u AS (SELECT doc_id, k, kind, unnest(v) AS value, unnest(g[1:len(v)]) AS gap, unnest(range(len(v))) AS i FROM m),
s AS (SELECT doc_id, k, kind, value, regexp_replace(value, '[^0-9]', '', 'g') AS digits,
        (sum(length(gap) + length(value)) OVER (PARTITION BY doc_id, k ORDER BY i))::BIGINT AS finish FROM u),
c AS (SELECT *, finish - length(value) AS start, list_sum(list_transform(range(1, length(digits) + 1),
        lambda i: CASE WHEN i % 2 = 1 THEN digits[length(digits) - i + 1]::INTEGER WHEN digits[length(digits) - i + 1]::INTEGER > 4 THEN 2 * digits[length(digits) - i + 1]::INTEGER - 9
          ELSE 2 * digits[length(digits) - i + 1]::INTEGER END)) % 10 AS luhn FROM s),
b AS (SELECT * FROM c WHERE kind = 'email' OR (kind = 'ip' AND len(list_filter(string_split(value, '.'), lambda x: x::HUGEINT > 255)) = 0)
        OR (kind = 'card' AND length(digits) BETWEEN 16 AND 19 AND luhn = 0) OR (kind = 'phone' AND length(digits) BETWEEN 8 AND 15)),
t AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY k, start) AS spans, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip,
        count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone FROM b GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(spans, '')) AS base_sha256
FROM documents d LEFT JOIN t USING (doc_id)
"""
