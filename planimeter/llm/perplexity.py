"""Quality classifier: per-document perplexity under interpolated modified Kneser-Ney models.

A model a language is trained on trusted text. Its symbols are the bytes of the text, all 256 by themselves, so
that accented letters and any script are told apart; an n-gram of five is a number under 2**40. Counts of the
highest order come from all trusted documents but every HELD_OUTth, lower orders count distinct continuations,
and each order has three discounts from its counts of counts.

Count tables are sharded by n-gram and never broadcast. Documents are scored block by block: a block asks
for the probabilities of its distinct n-grams once, the requests join the sharded counts, and the answers
go back to the block, where they are summed by document. Documents over a quantile of the perplexity of
their language's trusted documents that were held out of training (times a margin) are not kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planimeter.llm.blocks import count_blocks, pack, unpack
from planimeter.llm.common import drop_shuffles, materialize, release, trim

ORDER, BITS = 5, 8
SYMBOLS = 1 << BITS
#: Of so many trusted documents one is held out; bytes of text whose n-grams are taken at a time.
HELD_OUT, GRAM_BYTES = 5, 1_000_000
#: Bytes of text in a block: the larger, the fewer times an n-gram is asked for.
BLOCK_BYTES = 24_000_000


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of all texts end to end, one for each byte with the four bytes before it (newlines before the
    first); and where each text's begin."""
    sizes = np.array([len(t) for t in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    lead = b"\n" * (ORDER - 1)
    s = np.frombuffer(b"".join(lead + t for t in texts), np.uint8)
    g = np.zeros(max(0, len(s) - ORDER + 1), np.int64)
    for k in range(ORDER):
        g = (g << BITS) | s[k : k + len(g)]
    keep = np.ones(len(g) + ORDER - 1, bool)
    # An n-gram that starts in a text's last bytes would run into the next.
    ends = bounds[1:] + (ORDER - 1) * np.arange(1, len(texts) + 1)
    for k in range(1, ORDER):
        keep[ends - k] = False
    return g[keep[: len(g)]], bounds


def _runs(rows: np.ndarray, texts: list[bytes]) -> Iterator[np.ndarray]:
    """rows in runs of about GRAM_BYTES bytes of text."""
    size = np.cumsum([len(texts[i]) for i in rows])
    for part in np.split(rows, np.flatnonzero(np.diff(size // GRAM_BYTES)) + 1):
        yield part


def _rows(table: pa.Table) -> tuple[pa.Table, list[bytes], np.ndarray]:
    docs = unpack(table)
    # A null language is one of its own, and so is an empty one.
    langs = ["-" if x is None else "=" + x for x in docs.column("lang").to_pylist()]
    return docs, [t or b"" for t in docs.column("text").cast(pa.binary()).to_pylist()], np.array(langs)


def _counted(rows: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of rows of texts, and how often each stands there."""
    found = [np.unique(_codes([texts[i] for i in part])[0], return_counts=True) for part in _runs(rows, texts)] if len(rows) else []
    grams = np.concatenate([np.zeros(0, np.int64), *[g for g, _ in found]])
    every, at = np.unique(grams, return_inverse=True)
    return every, np.bincount(at, np.concatenate([np.zeros(0, np.int64), *[n for _, n in found]]), len(every)).astype(np.int64)


def _requests(key, packed: pa.Table, training: pa.Table) -> pa.Table:
    """Distinct n-grams of a block by language, with their counts in its training documents."""
    out = []
    if packed.num_rows:
        docs, texts, langs = _rows(packed)
        ids = docs.column("doc_id").to_pylist()
        good = set(training.column("doc_id").to_pylist())
        trained = np.array([i in good for i in ids], bool)
        for lang in np.unique(langs).tolist():
            seen, n = _counted(np.flatnonzero((langs == lang) & trained), texts)
            every = np.union1d(seen, _counted(np.flatnonzero((langs == lang) & ~trained), texts)[0])
            counts = np.zeros(len(every), np.int64)
            counts[np.searchsorted(every, seen)] = n
            out.append(pa.table({"block": pa.array(np.full(len(every), key[0].as_py()), pa.int32()), "lang": pa.array([lang] * len(every), pa.string()), "g": pa.array(every), "n": pa.array(counts)}))
    schema = pa.schema([("block", pa.int32()), ("lang", pa.string()), ("g", pa.int64()), ("n", pa.int64())])
    trim()
    return pa.concat_tables(out).cast(schema) if out else schema.empty_table()


def _scores(key, packed: pa.Table, answers: pa.Table) -> pa.Table:
    """Each document's number of n-grams and perplexity."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("n_grams", pa.int64()), ("perplexity", pa.float64())])
    if not packed.num_rows:
        return schema.empty_table()
    docs, texts, langs = _rows(packed)
    n, total = np.zeros(len(texts), np.int64), np.full(len(texts), np.nan)
    a_lang = answers.column("lang").to_numpy(zero_copy_only=False)
    a_g, a_logp = answers.column("g").to_numpy(), answers.column("logp").to_numpy()
    for lang in np.unique(langs).tolist():
        mine = np.flatnonzero(a_lang == lang)
        mine = mine[np.argsort(a_g[mine])]
        known, logp = a_g[mine], a_logp[mine]
        for own in _runs(np.flatnonzero(langs == lang), texts):
            codes, bounds = _codes([texts[i] for i in own])
            n[own] = np.diff(bounds)
            sums = np.concatenate([[0.0], np.cumsum(logp[np.searchsorted(known, codes)], dtype=np.float64)]) if len(codes) else np.zeros(1)
            total[own] = sums[bounds[1:]] - sums[bounds[:-1]]
    with np.errstate(invalid="ignore", divide="ignore"):
        perplexity = np.exp(-total / n)
    perplexity = pa.array(perplexity, mask=(n == 0) | ~np.isfinite(perplexity))
    out = pa.table({"doc_id": docs.column("doc_id"), "lang": docs.column("lang"), "n_grams": pa.array(n), "perplexity": perplexity}).cast(schema)
    trim()
    return out


def _order(counts: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From counts (lang, g, c) of order n: counts with discounted weight, context sums, next lower counts."""
    k = F.least(F.col("c"), F.lit(4))
    counted = counts.groupBy("lang").agg(*[F.count_if(k == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
    # Where a count of counts is missing the usual constants stand in; a discount lies in [0, its count].
    discount = lambda i, d: F.least(F.greatest(F.coalesce(F.lit(float(i)) - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(d)), F.lit(0.1 * i)), F.lit(0.9 * i))
    discounts = counted.select(F.col("lang").alias("d_lang"), discount(1, 0.5).alias("d1"), discount(2, 0.75).alias("d2"), discount(3, 1.2).alias("d3"))
    rows = counts.join(F.broadcast(discounts), F.col("lang") == F.col("d_lang"))  # a row a language
    d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    weighed = rows.select("lang", "g", "c", (F.col("c") - d).alias("w"), d.alias("d"))
    context = weighed.groupBy("lang", F.shiftright("g", BITS).alias("h")).agg(F.sum("c").alias("total"), F.sum("d").alias("kept_back"))
    lower = weighed.groupBy("lang", F.col("g").bitwiseAND((1 << (BITS * (n - 1))) - 1).alias("g")).agg(F.count(F.lit(1)).alias("c"))
    return weighed.select("lang", "g", "w"), context, lower


def log_probabilities(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, g, logp for distinct n-grams asked (lang, g) from highest-order counts (lang, g, c)."""
    tables = []
    for n in range(ORDER, 0, -1):
        # Each order's small tables are written once; otherwise every join would derive them all again.
        weighed, context, counts = (materialize(t) for t in _order(counts, n))
        tables.append((n, weighed, context))
    out = last = asked.withColumn("p", F.lit(1.0 / SYMBOLS))
    for n, weighed, context in reversed(tables):
        mask = (1 << (BITS * n)) - 1
        out = out.withColumn("k", F.col("g").bitwiseAND(mask)).withColumn("h", F.shiftright("k", BITS))
        out = out.join(weighed.withColumnRenamed("g", "k"), ["lang", "k"], "left").join(context, ["lang", "h"], "left")
        seen: Column = (F.coalesce("w", F.lit(0.0)) + F.col("kept_back") * F.col("p")) / F.col("total")
        scored = materialize(out.select("lang", "g", F.when(F.col("total").isNull(), F.col("p")).otherwise(seen).alias("p")))
        release(weighed, context, last)
        out = last = scored
    return out.select("lang", "g", F.log("p").cast("float").alias("logp"))


def perplexities(df: DataFrame, trusted: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """doc_id, lang, n_grams, perplexity of each row of df; trusted: keys of the documents to train on.

    Common n-grams are asked for by all blocks; the join with their probabilities is one that AQE can split."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    n = count_blocks(docs, BLOCK_BYTES)
    deal = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    block = F.when(F.col("doc_id").isNull(), deal(F.col("text"))).otherwise(deal(F.col("doc_id")))
    packed = pack(docs.withColumn("block", block), n)
    good = trusted.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("block", deal(F.col("doc_id")))
    requests = packed.groupBy("block").cogroup(good.repartition(n, "block").groupBy("block")).applyInArrow(_requests, "block int, lang string, g long, n long")
    requests = materialize(requests)
    drop_shuffles(df.sparkSession)  # the texts as they were dealt for the requests
    counts = materialize(requests.where("n > 0").groupBy("lang", "g").agg(F.sum("n").alias("c")))
    logp = materialize(log_probabilities(requests.select("lang", "g").distinct(), counts))
    release(counts)
    drop_shuffles(df.sparkSession)
    answers = requests.join(logp, ["lang", "g"]).select("block", "lang", "g", "logp")
    return packed.groupBy("block").cogroup(answers.repartition(n, "block").groupBy("block")).applyInArrow(
        _scores, "doc_id long, lang string, n_grams long, perplexity double"
    )


def quality_by_perplexity(
    df: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", quantile: float = 0.99, margin: float = 1.25
) -> DataFrame:
    """One row a document: doc_id, lang, n_grams, perplexity, threshold, kept.

    Trusted documents are those that labels calls good (quality 1) and not toxic. A model learns from four of five of
    them, the threshold from the fifth (from all, where a language has none that is held out). Empty and null
    texts have no n-grams and a null perplexity; they are kept, as are documents of
    a language (null is one of its own) with no trusted document, whose threshold is null. Keys may be
    null (never trusted) or repeat (all rows of a trusted key are trusted). Empty tables give no rows;
    other columns are not read."""
    trusted = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    trusted = trusted.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0)
    training = trusted.where("not held").select(F.col("doc_id").alias(id_col))
    scored = materialize(perplexities(df, training, id_col=id_col, text_col=text_col, lang_col=lang_col))
    known = scored.join(trusted, "doc_id")
    at = lambda rows: F.percentile_approx(F.when(rows, F.col("perplexity")), quantile, 10_000)
    cuts = known.groupBy("lang").agg((F.coalesce(at(F.col("held")), at(F.lit(True))) * margin).alias("threshold"))
    out = scored.join(cuts.withColumnRenamed("lang", "t_lang"), F.col("lang").eqNullSafe(F.col("t_lang")), "left")
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "lang", "n_grams", "perplexity", "threshold", kept.alias("kept"))
