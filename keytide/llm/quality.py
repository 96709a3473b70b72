"""Quality rules with risk-controlled thresholds.

Scores of each text (shares of symbols, exclamation marks, repeated lines, repeated eight-word windows and words that
repeat the one before) are put together into one: the greatest of the scores, each divided by its rule's unit. Units are
learned on a third of the labelled documents (the cutoff of the rule with the best gain, over all strata; a rule without
gain isn't used). The other two thirds are the holdout. A cutoff of the combined score may be used in a stratum only if
the holdout proves, by an exact binomial (Clopper-Pearson) bound, that it rejects at most ``alpha`` of the good documents
there. Cutoffs are tested from the loosest one on and the testing stops at the first failure (fixed-sequence testing), so
the correction for multiple tests is a Bonferroni share of ``delta`` for each stratum. Among the proven cutoffs the one with
the best gain is used: rejected bad documents less ``cost`` times rejected good ones. Where the labels prove nothing (with
the defaults, in a stratum with fewer than 90 good holdout documents), only the base rule rejects.

The bound is about documents that pass the base rule, drawn like the labelled ones. Labelled documents of equal words are
one trial, good only if all are.

Everything runs in DataFrame functions. What comes to the driver is one row for each rule and each stratum; strata are a
fixed list and "other".

Defined cases: a null text is an empty one (no words, hence rejected by the base rule); a long text is judged whole; a
null or unlisted language is stratum "other"; labels with a null id or quality are ignored; a document with several
labels is good only if all say so; repeated rows are judged alike; cutoffs that tie in gain: the loosest; an empty table
gives an empty result; no labels means the base rule alone. Other columns are not read by ``quality_verdicts``;
``quality_filter`` returns all, whatever their names. Windows within a text are compared by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keytide.llm.common import Scratch, documents, text_of, word_array

#: Score of each rule, over the columns of :func:`features`; a high score is bad.
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "bangs": "n_bangs / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "stutter": "n_stutter / greatest(n_words, 1)",
}
#: Cutoffs of a rule's own score and of the combined one, loosest first; a document is rejected if its score is above.
UNITS = (0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01)
CUTOFFS = (8.0, 6.0, 5.0, 4.0, 3.5, 3.0, 2.5, 2.0, 1.7, 1.5, 1.3, 1.15, 1.0, 0.9, 0.8, 0.7, 0.6, 0.5)
STRATA = ("en", "de", "fr", "es")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def count_of(column: str, char: str) -> Column:
    """How often an ASCII character stands in a text."""
    return F.octet_length(column) - F.octet_length(F.replace(F.col(column), F.lit(char), F.lit("")))


def features(df: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``df`` and the counts of its texts. One pass, no shuffle."""
    t = df.select(*(F.col(f"`{c}`") for c in keep), text_of(df).alias("_t"))
    t = t.withColumn("_w", word_array(F.col("_t")))
    t = t.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    t = t.withColumn("_h1", F.expr("transform(_w, w -> xxhash64(w))"))
    double = "zip_with(_h{k}, slice(_h{k}, {k} + 1, size(_h{k})), (x, y) -> xxhash64(x, y))"
    for k in (1, 2):
        t = t.withColumn(f"_h{2 * k}", F.expr(double.format(k=k)))
    # Eight words can repeat only where four do.
    t = t.withColumn("_four", F.expr("size(array_distinct(_h4)) < size(_h4)"))
    t = t.withColumn("_v", F.expr(f"case when _four then slice({double.format(k=4)}, 1, greatest(size(_w) - 7, 0)) end"))
    t = t.withColumn("_dup", F.expr("coalesce(size(array_distinct(_v)) < size(_v), false)"))
    t = t.withColumn("_s", F.expr("case when _dup then sort_array(transform(_v, (h, i) -> struct(h as h, i as i))) end"))
    t = t.withColumn("_p", F.expr("sort_array(transform(filter(_s, (s, i) -> coalesce(s.h = get(_s, i - 1).h, false) or coalesce(s.h = get(_s, i + 1).h, false)), s -> s.i))"))
    return t.select(
        *(F.col(f"`{c}`") for c in keep),
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        sum((count_of("_t", c) for c in "#*$%&|<>"), F.lit(0)).cast("long").alias("n_symbols"),
        F.expr("cast(size(_l) - size(array_distinct(_l)) as bigint)").alias("n_dup_lines"),
        F.expr("case when _dup then aggregate(transform(_p, (p, j) -> cast(least(8, coalesce(get(_p, j + 1) - p, 8)) as bigint)), 0L, (a, x) -> a + x) else 0L end").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        count_of("_t", "!").cast("long").alias("n_bangs"),
        F.expr("cast(size(filter(_h1, (h, i) -> coalesce(h = get(_h1, i - 1), false))) as bigint)").alias("n_stutter"),
        F.xxhash64("_h1").alias("words_hash"),
    )


def base_failed() -> Column:
    return F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")


def stratum(lang: str = "lang") -> Column:
    return F.when(F.col(lang).isin(*STRATA), F.col(lang)).otherwise("other")


def steps(rows: DataFrame, score: str, cutoffs: tuple[float, ...], *by: str) -> DataFrame:
    """For each key of ``by`` and each cutoff (step 1, 2, ...): good rows n, good ones above it k, bad ones above it."""
    level = F.expr(f"size(filter(array({', '.join(f'{c}d' for c in cutoffs)}), c -> {score} > c))")
    g = F.col("good") > 0
    counts = rows.withColumn("level", level).groupBy(*by, "level").agg(F.count_if(g).alias("g"), F.count_if(~g).alias("b"))
    each = counts.select(*by, "level", "g", "b", F.explode(F.sequence(F.lit(1), F.lit(len(cutoffs)))).alias("step"))
    hit = F.col("level") > len(cutoffs) - F.col("step")
    return each.groupBy(*by, "step").agg(F.sum("g").alias("n"), F.sum(F.when(hit, F.col("g")).otherwise(0)).alias("k"), F.sum(F.when(hit, F.col("b")).otherwise(0)).alias("bad"))


@dataclass(frozen=True)
class QualityRules:
    """``alpha``: most false rejections in a stratum; ``delta``: chance that this fails anywhere."""

    alpha: float = 0.05
    delta: float = 0.05
    cost: float = 4.0

    def judged(self, feats: DataFrame, labels: DataFrame) -> DataFrame:
        """Labelled documents that pass the base rule, one row for each sequence of words, with their scores and fold."""
        good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
        rows = feats.where(~base_failed()).join(good, "doc_id").select("stratum", "words_hash", "good", *(F.expr(f"cast({e} as double)").alias(r) for r, e in RULES.items()))
        return rows.groupBy("stratum", "words_hash").agg(F.min("good").alias("good"), *(F.max(r).alias(r) for r in RULES)).withColumn("train", F.pmod(F.xxhash64("words_hash", F.lit(3)), F.lit(3)) == 0)

    def units(self, judged: DataFrame) -> dict[str, float]:
        """Unit of each rule with a gain on the training third."""
        rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("score")) for r in RULES))
        rows = judged.where("train").select("good", F.explode(rules).alias("x")).select("good", "x.rule", "x.score")
        best = self.best(steps(rows, "score", UNITS, "rule"), "rule")
        return {r["rule"]: UNITS[r.step - 1] for r in best.collect()}

    def best(self, table: DataFrame, *by: str) -> DataFrame:
        gain = table.withColumn("gain", F.col("bad") - self.cost * F.col("k")).where("gain > 0")
        return gain.groupBy(*by).agg(F.max(F.struct("gain", (-F.col("step")).alias("s"))).alias("x")).select(*by, (-F.col("x.s")).alias("step"))

    def combined(self, units: dict[str, float], scores: dict[str, str]) -> str:
        """SQL of the combined score, of SQL for each rule's score."""
        return f"array_max(array({', '.join(f'({scores[r]}) / {u!r}d' for r, u in sorted(units.items()))}))" if units else "0d"

    def candidates(self, judged: DataFrame, units: dict[str, float]) -> DataFrame:
        """Each stratum and cutoff with its counts in the holdout, p-value and verdict. At most 5 x 18 rows."""
        table = steps(judged.where("not train").withColumn("score", F.expr(self.combined(units, {r: r for r in units}))), "score", CUTOFFS, "stratum")
        p = self.alpha
        # P(Bin(n, p) <= k), summed in logarithms; a rate above p can't be proven and needs no sum.
        tail = F.expr(
            f"case when k > {p} * n then 1.0d else exp(aggregate(sequence(0L, k), struct(n * ln(1 - {p}d) as term, cast(null as double) as total), "
            f"(a, i) -> named_struct('term', case when i = 0 then a.term else a.term + ln((n - i + 1) / i) + ln({p}d / (1 - {p}d)) end, "
            f"'total', case when i = 0 then a.term else greatest(a.total, a.term + ln((n - i + 1) / i) + ln({p}d / (1 - {p}d))) + "
            f"log1p(exp(-abs(a.total - (a.term + ln((n - i + 1) / i) + ln({p}d / (1 - {p}d)))))) end), a -> a.total)) end"
        )
        share = self.delta / (len(STRATA) + 1)
        table = table.withColumn("p_value", tail).withColumn("_fails", (F.col("p_value") > share).cast("int"))
        w = Window.partitionBy("stratum").orderBy("step")
        return table.withColumn("proven", F.max("_fails").over(w) == 0).drop("_fails")

    def fit(self, feats: DataFrame, labels: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
        """Units of the rules, and the cutoff of each stratum that has one."""
        scratch = Scratch(feats.sparkSession)
        judged = scratch.keep(self.judged(feats, labels))
        units = self.units(judged)
        best = self.best(self.candidates(judged, units).where("proven"), "stratum").collect() if units else []
        scratch.drop(judged)
        return units, {r.stratum: CUTOFFS[r.step - 1] for r in best}

    def passes(self, units: dict[str, float], cutoffs: dict[str, float]) -> Column:
        """Over columns of :func:`features` and ``stratum``: the stratum's cutoff doesn't reject the document."""
        score, out = F.expr(self.combined(units, RULES)), F.lit(True)
        for s, c in sorted(cutoffs.items()):
            out = out & ~((F.col("stratum") == s) & (score > c))
        return out


def quality_verdicts(docs: DataFrame, labels: DataFrame, rules: QualityRules | None = None) -> DataFrame:
    """Counts and verdict of each row of ``docs``; the texts are read once."""
    rules, scratch = rules or QualityRules(), Scratch(docs.sparkSession)
    feats = scratch.keep(features(docs.select("doc_id", "text", stratum().alias("stratum")), ["doc_id", "stratum"]))
    model = rules.fit(feats, labels)
    failed = base_failed()
    return feats.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & rules.passes(*model)).alias("kept"))


def quality_filter(docs: DataFrame, labels: DataFrame, rules: QualityRules | None = None) -> DataFrame:
    """Rows of ``docs`` that the rules keep, with their columns as they were. Counts are worked out once and written down beside the rows."""
    rules, scratch = rules or QualityRules(), Scratch(docs.sparkSession)
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "doc_id", "text", stratum().alias("stratum"))
    feats = scratch.keep(features(row, ["_row", "doc_id", "stratum"]))
    model = rules.fit(feats, labels)
    return feats.where(~base_failed() & rules.passes(*model)).select("_row.*")


def op5_quality_rules(spark, sf_dir):
    return quality_verdicts(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
