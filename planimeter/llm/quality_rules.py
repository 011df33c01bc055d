"""Quality rules: a learned decision list over document statistics; DataFrame functions only.

Statistics of each text come from one pass of built-in expressions. Labelled statistics are laid on fixed
grids, and sequential covering reads counts of (feature, bin, label) from Spark: a rule grows by the
threshold with the best information gain on two thirds of the labelled rows, is pruned on the other
third, and joins the list if it is precise there; what it covers leaves, and the next rule grows. A
candidate that is not precise enough is discarded, and the next one grows from another first threshold. The
list is emitted as one ordered Spark conditional expression. Only count tables of at most
(features x bins) rows reach the driver, whatever the number of labelled rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planimeter.llm.common import SPACE, let, materialize, words_of

SYMBOLS = "#*$%&|<>"
#: Feature and the factor that lays its values on a grid of BINS steps.
GRIDS = (
    ("word_length", 2.0),
    ("symbol_rate", 40.0),
    ("dup_line_rate", 40.0),
    ("repeat_rate", 40.0),
    ("upper_rate", 40.0),
    ("mark_rate", 40.0),
    ("distinct_rate", 40.0),
    ("log_words", 3.0),
)
BINS = 41


@dataclass(frozen=True)
class Test:
    """feature's bin > bound, or <= bound."""

    feature: str
    bound: int
    above: bool

    def column(self) -> Column:
        return F.col(f"g_{self.feature}") > self.bound if self.above else F.col(f"g_{self.feature}") <= self.bound

    def sql(self) -> str:
        scale = dict(GRIDS)[self.feature]
        return f"{self.feature} {'>=' if self.above else '<'} {(self.bound + 1) / scale:g}"


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]
    precision: float
    support: int

    def column(self) -> Column:
        out = F.lit(True)
        for t in self.tests:
            out = out & t.column()
        return out

    def sql(self) -> str:
        return " AND ".join(t.sql() for t in self.tests)


def _windows(words: Column, width: int = 8) -> Column:
    """Hashes of all windows of 8 words, by doubling."""
    def pairs(h: Column, step: int) -> Column:
        n = F.size(h) - step
        return F.zip_with(F.slice(h, 1, n), F.slice(h, step + 1, n), lambda a, b: F.xxhash64(a, b))

    assert width == 8
    return let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h1: let(pairs(h1, 1), lambda h2: let(pairs(h2, 2), lambda h4: pairs(h4, 4))),
    )


def _repeated(words: Column) -> Column:
    """Words in 8-word windows found twice or more."""
    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(
            ordered,
            lambda s: F.filter(
                s,
                lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
            ),
        )
        at = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return let(
            at,
            lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(8), F.coalesce(F.get(p, i + 1) - x, F.lit(8)))),
                F.lit(0),
                lambda a, x: a + x,
            ),
        )

    return F.when(F.size(words) < 9, F.lit(0)).otherwise(
        let(_windows(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    )


def _once(value: Column) -> Column:
    """value as an expression that the optimizer takes for nondeterministic: a filter on its fields stays above the
    projection that computes it, where a copy for each field would be evaluated otherwise."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def document_stats(text: Column) -> Column:
    """All statistics of a text as one struct of longs; null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    long = lambda c: c.cast("long")
    return let(
        words_of(text),
        lambda w: F.struct(
            long(F.size(w)).alias("n_words"),
            long(F.length(F.array_join(w, ""))).alias("word_chars"),
            long(F.length(F.regexp_replace(t, "[^" + SYMBOLS + "]+", ""))).alias("n_symbols"),
            let(lines, lambda x: F.struct(long(F.size(x)).alias("n"), long(F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("lines"),
            long(_repeated(w)).alias("n_repeat_words"),
            long(F.size(F.array_distinct(w))).alias("n_distinct"),
            long(F.length(F.regexp_replace(t, r"\P{Lu}+", ""))).alias("n_upper"),
            long(F.length(F.regexp_replace(t, "[^!?]+", ""))).alias("n_marks"),
        ),
    )


def _flat(stats: str = "s") -> list[Column]:
    names = ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_distinct", "n_upper", "n_marks")
    return [F.col(f"{stats}.{n}").alias(n) for n in names] + [F.col(f"{stats}.lines.n").alias("n_lines"), F.col(f"{stats}.lines.d").alias("n_dup_lines")]


def _gridded(df: DataFrame) -> DataFrame:
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    values = {
        "word_length": over("word_chars", "n_words"),
        "symbol_rate": over("n_symbols", "word_chars"),
        "dup_line_rate": over("n_dup_lines", "n_lines"),
        "repeat_rate": over("n_repeat_words", "n_words"),
        "upper_rate": over("n_upper", "word_chars"),
        "mark_rate": over("n_marks", "n_words"),
        "distinct_rate": over("n_distinct", "n_words"),
        "log_words": F.log2(F.col("n_words") + 1.0),
    }
    return df.withColumns({f"g_{n}": F.least(F.floor(values[n] * k), F.lit(BINS - 1)).cast("int") for n, k in GRIDS})


def learn_rules(
    labelled: DataFrame, *, max_rules: int = 8, max_tests: int = 4, min_precision: float = 0.95, min_support: int = 5, max_discards: int = 6
) -> list[Rule]:
    """Ordered rules that reject. labelled: the g_ columns, bad (boolean), fold (0 to 2; 0 prunes).

    A rule joins if at least min_support bad rows of the pruning third fall under it, min_precision of all it covers
    there. After max_discards candidates that do not, the list ends.
    Ties in gain go to the first feature, then the smaller bound, so reruns agree. No labelled rows, or
    labels of one kind only: no rules."""
    names = [n for n, _ in GRIDS]
    rules: list[Rule] = []
    left = labelled
    discarded: set[Test] = set()
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(f"g_{n}").alias("b")) for n in names])).alias("x")

    def counts(df: DataFrame) -> dict[str, list[tuple[int, int]]]:
        table = {n: [(0, 0)] * BINS for n in names}
        per = df.select(long, "bad").groupBy("x.f", "x.b").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))
        for r in per.collect():  # at most features x bins rows
            table[r["f"]][r["b"]] = (r["p"], r["n"])
        return table

    while len(rules) < max_rules and len(discarded) < max_discards:
        grow = left.where("fold > 0")
        tests: list[Test] = []
        while len(tests) < max_tests:
            part = grow.where(Rule(tuple(tests), 0, 0).column())
            table = counts(part)
            p0 = sum(p for p, _ in table[names[0]])
            n0 = sum(n for _, n in table[names[0]])
            if not p0 or not n0:
                break
            best, found = 0.0, None
            for name in names:
                p = n = 0
                for bound in range(BINS - 1):
                    p, n = p + table[name][bound][0], n + table[name][bound][1]
                    for above, (a, b) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                        gain = a * (math.log2(a / (a + b)) - math.log2(p0 / (p0 + n0))) if a else 0.0
                        if gain > best + 1e-9 and (tests or Test(name, bound, above) not in discarded):
                            best, found = gain, Test(name, bound, above)
            if found is None:
                break
            tests.append(found)
        if not tests:
            break
        prune = left.where("fold = 0")
        heads = [Rule(tuple(tests[: k + 1]), 0, 0).column() for k in range(len(tests))]
        row = prune.agg(
            *[F.count_if(h & F.col("bad")).alias(f"p{k}") for k, h in enumerate(heads)],
            *[F.count_if(h & ~F.col("bad")).alias(f"n{k}") for k, h in enumerate(heads)],
        ).first()
        worth = [((row[f"p{k}"] - row[f"n{k}"]) / max(1, row[f"p{k}"] + row[f"n{k}"]), -k) for k in range(len(heads))]
        k = -max(worth)[1]
        p, n = row[f"p{k}"], row[f"n{k}"]
        if p < min_support or p / (p + n) < min_precision:
            discarded.add(tests[0])
            continue
        rules.append(Rule(tuple(tests[: k + 1]), p / (p + n), p))
        left = left.where(~rules[-1].column())
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional: the number of the first rule that fires, or null."""
    out = None
    for i, r in enumerate(rules):
        out = F.when(r.column(), F.lit(i)) if out is None else out.when(r.column(), F.lit(i))
    return F.lit(None).cast("int") if out is None else out.cast("int")


def reason(rules: list[Rule]) -> Column:
    """The text of the rule that fired, or null."""
    out = F.lit(None).cast("string")
    for i, r in enumerate(rules):
        out = F.when(F.col("rule") == i, F.lit(r.sql())).otherwise(out)
    return out


def _known(labels: DataFrame, id_col: str, label_col: str, sample: int) -> DataFrame:
    """doc_id and bad of at most `sample` labels, those with the least hashes of their keys."""
    known = labels.select(F.col(id_col).alias("doc_id"), (F.col(label_col) == 0).alias("bad")).where("doc_id is not null and bad is not null")
    return materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id", "bad").limit(sample))


def _labelled(stats: DataFrame, known: DataFrame) -> DataFrame:
    joined = stats.join(F.broadcast(known), "doc_id")  # bounded by sample
    return materialize(joined.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(3)).cast("int")))


#: Labelled rows that rules are learned from, at most.
SAMPLE = 50_000


def quality_rules(df: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="quality", sample: int = SAMPLE, **learn) -> DataFrame:
    """One row a document: doc_id, the statistics, base_failed, kept, rule (number of the rule that fired), reason (its text).

    The list itself is the attribute `rules` of the frame returned.

    base_failed: fewer than 20 words, or over 30 % of them in repeated 8-word windows. Null and empty
    texts have no words and fail. Rows with null keys are judged like any other but are never labelled;
    repeated rows give repeated results. Rules are learned from at most `sample` labels. Empty tables give no rows; no labels, no rules. Other columns
    are not read."""
    stats = df.select(F.col(id_col).alias("doc_id"), document_stats(F.col(text_col)).alias("s"))
    stats = materialize(_gridded(stats.select("doc_id", *_flat())))
    rules = learn_rules(_labelled(stats, _known(labels, id_col, label_col, sample)), **learn)
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
    out = _judged(stats, rules).select(*columns, reason(rules).alias("reason"))
    out.rules = rules
    return out


def _judged(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = stats.withColumn("base_failed", base).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def kept_documents(df: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="quality", sample: int = SAMPLE, **learn) -> DataFrame:
    """The rows of df that quality_rules() keeps, with df's columns.

    Statistics for learning are computed of the labelled sample only, which is found by a bounded broadcast: no text is
    shuffled or written, and rows are judged in one pass."""
    known = _known(labels, id_col, label_col, sample)
    marked = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known.select("doc_id").distinct()), "doc_id", "left_semi")
    stats = marked.select("doc_id", _once(document_stats(F.col("text"))).alias("s"))
    rules = learn_rules(_labelled(_gridded(stats.select("doc_id", *_flat())), known), **learn)
    rows = df.select(F.struct("*").alias("row"), _once(document_stats(F.col(text_col))).alias("s"))
    return _judged(_gridded(rows.select("row", *_flat())), rules).where("kept").select("row.*")
