"""Personal data by weak supervision.

Strict patterns give the base spans (email, ip, card, phone), which always stay. Loose patterns give
further candidates (written-out addresses, phone numbers without a country code, numbers in the form
of US social security numbers). On every candidate five labelers vote for (1), against (-1) or not at
all (0): the strict pattern, a check of its parts (leading digit of a card, address range, a gazetteer of
top-level domains, one of calling codes, the North American form of phone numbers without a code), cue words before it in
four languages, signs of something else before it (prices, versions, part numbers), and whether it stands alone. Expectation-maximisation over the counts
of vote patterns estimates how reliable each labeler is and how likely each pattern is personal data;
a logistic span classifier is trained on these soft labels and decides about the candidates that are
not base spans.

Patterns of votes number at most kinds x 3^5, whatever the size of the corpus; their counts are what
comes to the driver. The texts are scanned by built-in functions only. A span's place comes from
pairing the matches with what lies between them (regexp_extract_all and split over one pattern).

Work grows with a text's length and the number of its matches (times the logarithm of that number): places are prefix
sums by doubling steps, and overlaps are found by bisection.

Defined cases: a null text is empty; a long text is scanned whole; repeated rows are judged alike; spans that tie in
their start stand in the order of kinds; an empty table gives an empty result and the classifier then rests on its
priors. Where an added span would overlap a base span or an earlier candidate of the classifier's, it is not added. Cue
words are sought in the 32 characters before a span, back to the match before it. Loose addresses have at most 64 characters
before the sign, and parts of at most 63. Columns other than doc_id and text are not read by ``pii_spans``; ``redact``
returns all columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytide.llm.common import Scratch, documents, text_of

#: Base kinds in the order of a tie, then the added one.
KINDS = ("email", "ip", "card", "phone", "ssn")
BASE = KINDS[:4]
#: Each kind's pattern. The guards before a run of characters don't change what is found from left to
#: right; they keep the search linear in long runs.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test of whether a text can hold a match.
HINTS = {
    "email": "contains(_t, '@')",
    "ip": r"_t rlike '[0-9]\\.[0-9]+\\.[0-9]+\\.[0-9]'",
    "card": "_t rlike '[0-9](?:[ -]?[0-9]){11}'",
    "phone": r"_t rlike '\\+[0-9]'",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]{1,63}+){1,4}",
    "phone": r"(?<![0-9+().-])(?<![0-9+] )(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
LOOSE_HINTS = {
    "email": r"_t rlike '[\\[(](?:at|AT)[\\])]'",
    "phone": r"_t rlike '[0-9]{3}[).-] ?[0-9]{3}[.-][0-9]{4}'",
    "ssn": "_t rlike '[0-9]{3}-[0-9]{2}-[0-9]{4}'",
}
#: Cue words before a span, by kind.
CUES = {
    "email": "mail|contact|write|kontakt|schreib|courriel|correo|escrib",
    "ip": "ip|host|server|address|adresse|login|client",
    "card": "card|visa|master|amex|credit|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|mobile|fax|ruf|handy|appel|llama|movil|contact",
    "ssn": "ssn|social|security|tax|insurance",
}
TLDS = ("com", "org", "net", "edu", "gov", "io", "co", "info", "biz", "de", "fr", "es", "uk", "eu", "us", "ch", "at", "example", "test")
#: Assigned country calling codes (ITU-T E.164), fixed values; behind 1 an area code has to follow.
CALLING = (
    "1(?=[2-9][0-9]{9}$)|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[12368]|2[2-6][0-9]|29[01789]|35[0-9]|37[0-9]|38[0-35-79]|42[013]|50[0-9]|59[0-9]"
    "|67[02-9]|68[0-35-9]|69[0-2]|80[08]|85[02356]|87[0-48]|88[0-368]|96[0-8]|97[0-79]|99[2-68]"
)
LABELERS = ("strict", "parts", "cue", "other", "alone")


def bound(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running(array: str, join: str = "v + w") -> str:
    """SQL of the running sums (or what ``join`` makes of an element ``v`` and an earlier one ``w``) of an array, by doubling steps."""
    step = f"transform(z, (v, i) -> case when i < shiftleft(1, k) then v else {join.replace('w', 'z[i - shiftleft(1, k)]')} end)"
    return bound(array, "a", f"case when size(a) < 2 then a else aggregate(sequence(0, cast(floor(log2(size(a) - 1)) as int)), a, (z, k) -> {step}) end")


def number_below(array: str, value: str) -> str:
    """SQL of how many numbers of a sorted array are below ``value``, by bisection."""
    step = f"case when coalesce(get({array}, lo + shiftleft(1, d) - 1) < {value}, false) then lo + shiftleft(1, d) else lo end"
    return f"aggregate(sequence(cast(floor(log2(size({array}) + 1)) as int), 0), 0, (lo, d) -> {step})"


def matches(pattern: str, hint: str) -> str:
    """SQL for the matches in ``_t``: array of (s, e, x, b, a): start, end (code points), string, 32 characters before, 8 after."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    ends = running("transform(q.m, (x, i) -> length(get(q.p, i)) + length(x))")
    each = "transform(q.m, (x, i) -> named_struct('s', t[i] - length(x), 'e', t[i], 'x', x, 'b', right(get(q.p, i), 32), 'a', left(get(q.p, i + 1), 8)))"
    found = bound(f"named_struct('m', regexp_extract_all(_t, '{p}', 0), 'p', split(_t, '{p}'))", "q", bound(ends, "t", each))
    return f"case when {hint} then {found} else cast(array() as array<struct<s:int,e:int,x:string,b:string,a:string>>) end"


DIGITS = "regexp_replace(x.x, '[^0-9]', '')"
LUHN = (
    f"aggregate(transform(sequence(1, length({DIGITS})), i -> (cast(substr({DIGITS}, length({DIGITS}) - i + 1, 1) as int) * (case when i % 2 = 0 then 2 else 1 end))),"
    " 0, (a, v) -> a + (case when v > 9 then v - 9 else v end)) % 10 = 0"
)
#: Which matches of the strict patterns are base spans.
VALID = {
    "email": "true",
    "ip": r"forall(split(x.x, '\\.'), v -> case when length(regexp_replace(v, '^0+', '')) > 3 then false else cast(concat('0', right(v, 3)) as int) <= 255 end)",
    "card": LUHN,
    "phone": f"length({DIGITS}) between 9 and 15",
}
#: The labeler of a span's parts.
PARTS = {
    "email": f"case when lower(regexp_extract(x.x, '([A-Za-z]+)[^A-Za-z]*$', 1)) in {TLDS} then 1 else -1 end",
    "ip": r"case when x.x rlike '^(0|127|255|22[4-9]|23[0-9])\\.' then -1 when x.x rlike '(^|\\.)0[0-9]' then -1 else 1 end",
    "card": f"case when substr({DIGITS}, 1, 1) in ('3', '4', '5', '6') then 1 else -1 end",
    "phone": (
        f"case when length({DIGITS}) not between 7 and 15 then -1 when startswith(x.x, '+') then case when {DIGITS} rlike '^(?:{CALLING})' then 1 else -1 end"
        f" when {DIGITS} rlike '^1?[2-9][0-9]{{2}}[0-9]{{7}}$' then 1 else 0 end"
    ),
    "ssn": "case when x.x rlike '^(000|666|9)' or x.x rlike '-00-' or x.x rlike '0000$' then -1 else 1 end",
}


def candidates(df: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep``, ``_t`` (the text), ``base`` and ``more``: arrays of spans, ``more`` with votes. No shuffle."""
    t = df.select(*(F.col(f"`{c}`") for c in keep), text_of(df).alias("_t"))
    for k in BASE:
        t = t.withColumn(f"_{k}", F.expr(matches(PATTERNS[k], HINTS[k])))
    for k in LOOSE:
        t = t.withColumn(f"_loose_{k}", F.expr(matches(LOOSE[k], LOOSE_HINTS[k])))

    def votes(kind: str, strict: int) -> str:
        cue = f"case when lower(x.b) rlike '({CUES[kind]})' then 1 else 0 end"
        other = r"case when lower(x.b) rlike '(version|isbn|part no|order|invoice|[$€£#v] ?)$' then -1 else 0 end"
        alone = r"case when (x.b = '' or x.b rlike '[\\s(\\[<:,;\"]$') and (x.a = '' or x.a rlike '^[^A-Za-z0-9_@/-]') then 1 else -1 end"
        fields = zip(LABELERS, (str(strict), PARTS[kind], cue, other, alone), strict=True)
        return "named_struct('kind', '" + kind + "', 'k', " + str(KINDS.index(kind)) + ", 's', x.s, 'e', x.e, " + ", ".join(f"'{n}', cast({v} as int)" for n, v in fields) + ")"

    base = ", ".join(f"transform(filter(_{k}, x -> {VALID[k]}), x -> {votes(k, 1)})" for k in BASE)
    loose = ", ".join(f"transform(_loose_{k}, x -> {votes(k, -1 if k in BASE else 0)})" for k in LOOSE)
    return t.select(*(F.col(f"`{c}`") for c in keep), "_t", F.expr(f"concat({base})").alias("base"), F.expr(f"concat({loose})").alias("more"))


@dataclass
class SpanModel:
    """Weights of the span classifier: a bias for each kind, a weight for each labeler and vote."""

    bias: dict[str, float] = field(default_factory=dict)
    weight: dict[tuple[str, int], float] = field(default_factory=dict)
    reliability: dict[str, tuple[float, float]] = field(default_factory=dict)

    def score(self) -> str:
        """SQL for the log-odds of a span ``x``."""
        terms = ["case x.kind " + " ".join(f"when '{k}' then {v!r}d" for k, v in sorted(self.bias.items())) + " else 0d end"]
        for n in LABELERS:
            terms.append(f"case x.{n} when 1 then {self.weight[n, 1]!r}d when -1 then {self.weight[n, -1]!r}d else 0d end")
        return " + ".join(terms)


def train(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 40, prior: float = 20.0) -> SpanModel:
    """EM over (kind, votes, count), then logistic regression on the soft labels. Pure arithmetic on a bounded table."""
    # right[n]: how often labeler n votes for what is true and against what is false, with pseudo-counts.
    start = {"strict": 0.9, "parts": 0.75, "cue": 0.85, "other": 0.85, "alone": 0.65}
    right, share = {n: (p, p) for n, p in start.items()}, {k: 0.5 for k in KINDS}

    def posterior(kind: str, votes: tuple[int, ...]) -> float:
        z = math.log(share[kind] / (1 - share[kind]))
        for n, v in zip(LABELERS, votes, strict=True):
            on_true, on_false = right[n]
            if v > 0:
                z += math.log(on_true / (1 - on_false))
            elif v < 0:
                z += math.log((1 - on_true) / on_false)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    for _ in range(rounds):
        soft = [(k, v, c, posterior(k, v)) for k, v, c in patterns]
        for i, n in enumerate(LABELERS):
            yes = sum(c * q for _, v, c, q in soft if v[i] > 0), sum(c * (1 - q) for _, v, c, q in soft if v[i] < 0)
            both = sum(c * q for _, v, c, q in soft if v[i]), sum(c * (1 - q) for _, v, c, q in soft if v[i])
            right[n] = tuple(min(0.99, max(0.5, (yes[j] + prior * start[n]) / (both[j] + prior))) for j in (0, 1))
        for k in KINDS:
            total = sum(c for kk, _, c, _ in soft if kk == k)
            share[k] = (sum(c * q for kk, _, c, q in soft if kk == k) + prior * 0.5) / (total + prior)
    soft = [(k, v, c, posterior(k, v)) for k, v, c in patterns]
    names = [*KINDS, *((n, s) for n in LABELERS for s in (1, -1))]
    # The naive-Bayes log-odds are where the descent starts and what the ridge pulls to.
    init = [math.log(share[k] / (1 - share[k])) for k in KINDS]
    for n in LABELERS:
        init += [math.log(right[n][0] / (1 - right[n][1])), math.log((1 - right[n][0]) / right[n][1])]
    w, total = list(init), max(1, sum(c for *_, c, _ in soft))
    rows = [([names.index(k), *(names.index((n, s)) for n, s in zip(LABELERS, v, strict=True) if s)], c / total, q) for k, v, c, q in soft]
    for _ in range(300):
        grad = [0.01 * (a - b) for a, b in zip(w, init, strict=True)]
        for at, c, q in rows:
            err = c * (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] for i in at))))) - q)
            for i in at:
                grad[i] += err
        w = [a - 0.5 * g for a, g in zip(w, grad, strict=True)]
    return SpanModel({k: w[i] for i, k in enumerate(KINDS)}, {names[i]: w[i] for i in range(len(KINDS), len(names))}, right)


def fit(cands: DataFrame) -> SpanModel:
    spans = cands.select(F.explode(F.concat("base", "more")).alias("x")).groupBy("x.kind", *(f"x.{n}" for n in LABELERS)).count()
    rows = sorted((r["kind"], tuple(r[n] for n in LABELERS), r["count"]) for r in spans.collect())
    return train(rows)


def decided(cands: DataFrame, model: SpanModel, least: float = 0.7) -> DataFrame:
    """Adds ``spans``: base spans and accepted candidates as (s, k, e, kind), in order."""
    cut = math.log(least / (1 - least))
    fields = "named_struct('s', x.s, 'k', x.k, 'e', x.e, 'kind', x.kind)"
    kind = "array<struct<s:int,k:int,e:int,kind:string>>"
    # A candidate meets a base span if, of those that start before its end, one ends after its start.
    before = number_below("t.s", "x.e")
    free = f"transform(array({before}), n -> n = 0 or t.e[n - 1] <= x.s)[0]"
    good = f"sort_array(transform(filter(more, x -> {free} and {model.score()} >= {cut!r}d), x -> {fields}))"
    ends = running("transform(_base, x -> x.e)", "greatest(v, w)")
    chosen = bound(f"named_struct('s', transform(_base, x -> x.s), 'e', {ends})", "t", good)
    apart = bound(chosen, "c", bound(running("transform(c, x -> x.e)", "greatest(v, w)"), "m", "filter(c, (x, i) -> i = 0 or m[i - 1] <= x.s)"))
    d = cands.withColumn("_base", F.expr(f"sort_array(transform(base, x -> {fields}))"))
    d = d.withColumn("_added", F.expr(f"case when size(more) = 0 then cast(array() as {kind}) else {apart} end"))
    return d.withColumn("spans", F.expr("sort_array(concat(_base, _added))")).drop("_added")


def digest(array: str) -> Column:
    return F.expr(f"array_join(transform({array}, x -> concat_ws(':', x.kind, x.s, x.e)), ',')")


def pii_spans(docs: DataFrame, least: float = 0.7) -> DataFrame:
    """Counts and spans of each row of ``docs``; texts are scanned once, what is found is written down for the fit."""
    scratch = Scratch(docs.sparkSession)
    cands = scratch.keep(candidates(docs.select("doc_id", "text"), ["doc_id"]).drop("_t"))
    d = decided(cands, fit(cands), least)
    return d.select(
        "doc_id", *(F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE),
        F.sha2(digest("_base").cast("binary"), 256).alias("base_sha256"), digest("spans").alias("spans"),
    )


def redact(docs: DataFrame, least: float = 0.7) -> DataFrame:
    """Rows of ``docs`` with each span replaced by its kind in angle brackets and ``n_chars``, if there, counted anew.

    Overlapping spans (a card number inside a phone number) are replaced as one. The texts are scanned
    twice, so that none is shuffled. A text without spans stays as it is, null included.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(candidates(docs.select("text"), []).drop("_t"))
    model = fit(found)
    scratch.drop(found)
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "text")
    d = decided(candidates(row, ["_row"]), model, least)
    # Spans that overlap are one; each starts where no earlier span reaches, and ends where the spans before the next one do.
    ends = running("transform(spans, x -> x.e)", "greatest(v, w)")
    each = "transform(f, (n, j) -> named_struct('s', spans[n].s, 'e', m[coalesce(get(f, j + 1), size(spans)) - 1], 'kind', spans[n].kind))"
    merged = bound(ends, "m", bound("filter(sequence(0, size(spans) - 1), n -> n = 0 or m[greatest(n, 1) - 1] <= spans[n].s)", "f", each))
    d = d.withColumn("_m", F.expr(f"case when size(spans) > 0 then {merged} end"))
    # What is between spans is cut from chunks of 1,024 characters, as a place in a long text takes long to find.
    part = (
        "case when a div 1024 = b div 1024 then substring(get(c, cast(a div 1024 as int)), a % 1024 + 1, b - a) else concat(substring(c[cast(a div 1024 as int)], a % 1024 + 1), "
        "array_join(slice(c, cast(a div 1024 as int) + 2, cast(b div 1024 - a div 1024 as int) - 1), ''), coalesce(substring(get(c, cast(b div 1024 as int)), 1, b % 1024), '')) end"
    )
    between = bound("coalesce(get(_m, i - 1).e, 0)", "a", bound("x.s", "b", f"coalesce({part}, '')"))
    rest = bound("element_at(_m, -1).e", "a", bound("char_length(_t)", "b", f"coalesce({part}, '')"))
    clean = bound("regexp_extract_all(_t, '(?s).{1,1024}', 0)", "c", f"concat(array_join(transform(_m, (x, i) -> concat({between}, '<', upper(x.kind), '>')), ''), {rest})")
    d = d.withColumn("_text", F.expr(f"case when _m is null then _row.text else {clean} end"))
    types = dict(docs.dtypes)
    new = {"text": F.col("_text"), "n_chars": F.when(F.col("_m").isNull(), F.col("_row.n_chars")).otherwise(F.char_length("_text").cast(types["n_chars"])) if "n_chars" in types else None}
    return d.select(*(new[c].alias(c) if new.get(c) is not None else F.col(f"_row.`{c}`") for c in docs.columns))


def op7_pii(spark, sf_dir):
    return pii_spans(documents(spark, sf_dir))
