"""Training-data operators against brute force on small fixtures, with nulls, ties, empty tables and long texts."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from planimeter.llm import common, licenses, mixing, neighbours, perplexity, pieces, pii, quality_rules, sharding, simhash, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, block int, u double, ids string"


def make(spark, rows):
    """rows of (doc_id, text, lang, source); other columns clash with names the operators use inside."""
    return spark.createDataFrame([(i, t, l, s, len(t or ""), "x", 7, 0.5, "y") for i, t, l, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(("er", "th", "on", "an", "ti", "le")) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = text(40)
    base = [text(rng.randint(30, 120)) for _ in range(30)]
    out = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    out += [(100 + i, base[i], "en", "s0") for i in range(5)]
    out += [(200 + i, base[i].replace(" ", "  ", 2) + " end", "en", None) for i in range(5)]
    out += [(300 + i, text(30) + " " + shared + " " + text(30), None, "s1") for i in range(4)]
    out += [(400, None, None, None), (401, "", "fr", "s9"), (402, " \t\n", "fr", "s9"), (None, base[0], "en", "s0"), (None, None, None, None)]
    out += [(500, base[1], "en", "s2"), (500, base[1], "en", "s2"), (500, base[2], "en", "s2")]
    out += [(600, "é漢▁𝒳 a\x00b " * 3000, "fr", "s1"), (601, "one\n" * 30, "en", "s1"), (602, "a b c d e f g h " * 20, "en", "s1")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return make(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, [])


def stats(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    marked = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked)


def test_quality_statistics_and_rules(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, int(i < 300 or None), 0) for i in range(0, 300)] + [(601, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_rules.quality_rules(docs, labels).collect()
    want = Counter((i, *stats(t)) for i, t, _, _ in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == want
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in out)
    assert not any(r.kept and r.base_failed for r in out)
    assert quality_rules.quality_rules(empty, labels).count() == 0
    assert quality_rules.kept_documents(docs, labels.limit(0)).columns == docs.columns


def test_rules_find_a_planted_threshold(spark):
    rng = random.Random(2)
    rows = [(*(rng.randrange(41) for _ in quality_rules.GRIDS), i % 3) for i in range(900)]
    names = [f"g_{n}" for n, _ in quality_rules.GRIDS]
    df = spark.createDataFrame([(*r, r[1] > 30) for r in rows], ", ".join(f"{n} int" for n in names) + ", fold int, bad boolean").cache()
    rules = quality_rules.learn_rules(df)
    assert rules and rules[0].tests == (quality_rules.Test("symbol_rate", 30, True),)


def covering_by_hand(rows, max_rules=8, max_tests=4, min_precision=0.95, min_support=5, max_discards=6):
    """Sequential covering over rows (grid values, fold, bad), one candidate threshold after the other."""
    names = [n for n, _ in quality_rules.GRIDS]
    fires = lambda tests, g: all((g[k] > b) == above for k, b, above in tests)
    rules, left, discarded = [], rows, set()
    while len(rules) < max_rules and len(discarded) < max_discards:
        tests, part = [], [x for x in left if x[1]]
        while len(tests) < max_tests:
            part = [x for x in part if fires(tests, x[0])]
            p0 = sum(x[2] for x in part)
            if p0 in (0, len(part)):
                break
            best, found = 0.0, None
            for k in range(len(names)):
                for b in range(quality_rules.BINS - 1):
                    for above in (False, True):
                        under = [x[2] for x in part if (x[0][k] > b) == above]
                        a = sum(under)
                        gain = a * (math.log2(a / len(under)) - math.log2(p0 / len(part))) if a else 0.0
                        if gain > best + 1e-9 and (tests or (k, b, above) not in discarded):
                            best, found = gain, (k, b, above)
            if found is None:
                break
            tests.append(found)
        if not tests:
            break
        scores = []
        for n in range(1, len(tests) + 1):
            under = [x[2] for x in left if not x[1] and fires(tests[:n], x[0])]
            scores.append(((2 * sum(under) - len(under)) / max(1, len(under)), -n, sum(under), len(under)))
        _, n, p, size = max(scores)
        if p < min_support or p / size < min_precision:
            discarded.add(tests[0])
            continue
        rules.append(tuple(tests[:-n]))
        left = [x for x in left if not fires(rules[-1], x[0])]
    return [tuple((names[k], b, above) for k, b, above in r) for r in rules]


def test_list_is_that_of_plain_covering(spark):
    rng = random.Random(21)
    rows = []
    for i in range(1500):
        g = [rng.randrange(41) for _ in quality_rules.GRIDS]
        bad = g[1] > 34 or (g[4] <= 5 and g[6] > 30) or rng.random() < 0.04
        rows.append((g, i % 3, bad))
    names = [f"g_{n}" for n, _ in quality_rules.GRIDS]
    df = spark.createDataFrame([(*g, f, b) for g, f, b in rows], ", ".join(f"{n} int" for n in names) + ", fold int, bad boolean").cache()
    got = [tuple((t.feature, t.bound, t.above) for t in r.tests) for r in quality_rules.learn_rules(df)]
    assert got == covering_by_hand(rows) and len(got) >= 2
    out = df.withColumn("rule", quality_rules.verdict(quality_rules.learn_rules(df))).select(*names, "rule").collect()
    for r in out:
        hit = [k for k, rule in enumerate(got) if all((r[f"g_{n}"] > b) == above for n, b, above in rule)]
        assert r.rule == (hit[0] if hit else None)


def test_rules_travel_with_the_result(spark, docs):
    bad = [(i, 0, 0) for i in (500, 600, 601, 602, 300, 301, 302, 303)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + bad, "doc_id long, quality int, toxic int")
    out = quality_rules.quality_rules(docs, labels, min_support=1, min_precision=0.5)
    assert all((x.rule is None) == (x.reason is None) for x in out.collect())
    assert all(r.sql() for r in out.rules)
    assert quality_rules.quality_rules(docs, labels.limit(0)).rules == []


def suffix_dedup_by_hand(rows):
    keyed = sorted(((math.inf if i is None else i), t or "") for i, t, *_ in rows)
    first = {}
    for i, t in keyed:
        b = t.encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    want = Counter()
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < (math.inf if i is None else i):
                gone[k : k + 50] = b"\1" * 50
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        want[i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()] += 1
    return want


def test_suffix_dedup(docs, rows, empty):
    got = Counter(tuple(r)[:5] for r in suffix_dedup.suffix_dedup(docs).collect())
    assert got == suffix_dedup_by_hand(rows)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_suffix_dedup_of_one_passage_in_many_contexts(spark):
    rng = random.Random(22)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(60)
    rows = [(i, noise(rng.randint(0, 60)) + passage[rng.randint(0, 8) : rng.randint(52, 60)] + noise(rng.randint(0, 60))) for i in range(150)]
    rows += [(150 + i, "z" * rng.randint(40, 130)) for i in range(20)] + [(170 + i, ("ab" * 80)[: rng.randint(45, 150)]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r)[:5] for r in suffix_dedup.suffix_dedup(df).collect())
    assert got == suffix_dedup_by_hand(rows)


def test_merge_of_transforms_sorts_like_one_text():
    rng = random.Random(3)
    shards = [[(bytes(rng.choice(b"ab") for _ in range(rng.randint(8, 30))), d) for d in range(k, k + 3)] for k in (0, 3, 6)]
    found = suffix_dedup.smallest_by_string(shards, 6)
    first = {}
    for s in shards:
        for raw, d in s:
            for k in range(len(raw) - 5):
                first[raw[k : k + 6]] = min(d, first.get(raw[k : k + 6], d))
    for s, answers in zip(shards, found):
        for (raw, _), a in zip(s, answers):
            assert a.tolist() == [first[raw[k : k + 6]] for k in range(len(raw) - 5)]


@pytest.mark.parametrize("length", [6, 7, 10])
def test_merge_gives_exact_common_prefixes(length):
    rng = random.Random(length)
    shards = [suffix_dedup.Shard([bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(4)]) for _ in range(3)]
    shard, place, lcp = suffix_dedup.merge_intervals(shards, length)
    turned = [np.roll(s.text, -int(s.order[p]))[:length].tolist() for s, p in zip([shards[i] for i in shard], place)]
    assert turned == sorted(turned) and len(turned) == sum(len(s.text) for s in shards)
    common = [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), length) for a, b in zip(turned, turned[1:])]
    assert lcp.tolist() == [-1, *common]


def kneser_ney_by_hand(texts, asked, order=perplexity.ORDER):
    """Interpolated modified Kneser-Ney over bytes, plainly: log-probability of each n-gram asked."""
    grams = lambda t: [(b"\n" * (order - 1) + t)[i : i + order] for i in range(len(t))]
    counts = Counter(g for t in texts for g in grams(t))
    levels = []
    for n in range(order, 0, -1):
        k = Counter(min(c, 4) for c in counts.values())
        y = k[1] / (k[1] + 2 * k[2]) if k[1] + 2 * k[2] else 0.5
        d = [0.0]
        for i, usual in ((1, 0.5), (2, 0.75), (3, 1.2)):
            x = i - (i + 1) * y * k[i + 1] / k[i] if k[i] else usual
            d.append(min(max(x, 0.1 * i), 0.9 * i))
        total, held = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            held[g[:-1]] += d[min(c, 3)]
        levels.append((n, dict(counts), d, total, held))
        counts = Counter(g[1:] for g in counts)
    out = {}
    for g in asked:
        p = 1 / 256
        for n, c, d, total, held in reversed(levels):
            x = g[order - n :]
            if x[:-1] in total:
                seen = c.get(x, 0)
                p = (max(0, seen - d[min(seen, 3)] if seen else 0) + held[x[:-1]] * p) / total[x[:-1]]
        out[g] = math.log(p)
    return out


def test_perplexity_is_that_of_plain_kneser_ney(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(600, 1, 0), (None, 1, 0), (21, 1, 1), (22, 0, 0)], "doc_id long, quality int, toxic int")
    out = perplexity.quality_by_perplexity(docs, labels).collect()
    assert len(out) == len(rows)
    held = {r.doc_id for r in spark.range(700).select(F.col("id").alias("doc_id")).where(F.pmod(F.xxhash64("doc_id"), F.lit(perplexity.HELD_OUT)) == 0).collect()}
    good = {*range(20), 600}
    want, by_lang = {}, defaultdict(list)
    for lang in {r[2] for r in rows}:
        train = [t.encode() for i, t, x, _ in rows if x == lang and i in good - held]
        own = [(i, (t or "").encode()) for i, t, x, _ in rows if x == lang]
        lead = b"\n" * (perplexity.ORDER - 1)
        logp = kneser_ney_by_hand(train, {(lead + t)[k : k + perplexity.ORDER] for _, t in own for k in range(len(t))})
        for i, t in own:
            p = math.exp(-sum(logp[(lead + t)[k : k + perplexity.ORDER]] for k in range(len(t))) / len(t)) if t else None
            want[i, t] = p
            if i in good and p is not None:
                by_lang[lang].append((i in held, p))
    texts = defaultdict(list)
    for i, t, _, _ in rows:
        texts[i].append((t or "").encode())
    for r in out:
        close = [want[r.doc_id, t] for t in texts[r.doc_id] if len(t) == r.n_grams]
        assert any(p == r.perplexity is None or p is not None and r.perplexity is not None and abs(p - r.perplexity) < 1e-3 * p for p in close)
        known = by_lang[r.lang]
        if not known:
            assert r.threshold is None and r.kept
        else:
            cut = max([p for h, p in known if h] or [p for _, p in known]) * 1.25
            assert abs(r.threshold - cut) < 1e-3 * cut and r.kept == (r.perplexity is None or r.perplexity <= r.threshold)
    assert perplexity.quality_by_perplexity(empty, labels).count() == 0
    assert all(r.kept for r in perplexity.quality_by_perplexity(docs, labels.limit(0)).collect())


def test_languages_null_and_empty_are_two(spark):
    rows = [(i, "abcabcabc " * 9, None) for i in range(10)] + [(i, "xyzxyzxyz " * 9, "") for i in range(10, 20)] + [(20, "abcabcabc", None), (21, "abcabcabc", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in perplexity.quality_by_perplexity(df, labels).collect()}
    assert out[20].perplexity < 5 < out[21].perplexity and out[20].lang is None and out[21].lang == ""


def test_kneser_ney_sums_to_one(spark):
    rng = random.Random(4)
    stem = sum(b << 8 * k for k, b in enumerate((3, 2, 1, 9), 1))
    counts = spark.createDataFrame([("en", stem + s, rng.randint(1, 6)) for s in range(20)] + [("en", s * 256 + 5, 1) for s in range(9)], "lang string, g long, c long")
    asked = spark.createDataFrame([("en", stem + s) for s in range(256)], "lang string, g long")
    total = sum(math.exp(r.logp) for r in perplexity.log_probabilities(asked, counts).collect())
    assert abs(total - 1) < 1e-4


def test_pieces(docs, rows, empty):
    a = pieces.encode_pieces(docs).collect()
    assert all(r.lossless for r in a) and len(a) == len(rows)
    b = pieces.encode_pieces(docs.repartition(7)).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in a) == Counter((r.doc_id, tuple(r.ids)) for r in b)
    assert Counter((r.doc_id, pieces.decode_ids(r.ids)) for r in a) == Counter((i, t or "") for i, t, _, _ in rows)
    assert pieces.encode_pieces(empty).count() == 0
    back = pieces.decode_pieces(pieces.encode_pieces(docs))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t or "") for i, t, _, _ in rows)


def test_sampled_paths_follow_the_lattice():
    e = pieces.Encoder(sharpness=0.2)

    def paths(x):
        if not x:
            yield (), 1.0
        for n in range(1, len(x) + 1):
            if hit := e.v.pieces.get(x[:n]):
                for rest, p in paths(x[n:]):
                    yield (hit[0], *rest), p * hit[1]

    want = dict(paths(" there"))
    total = sum(want.values())
    ids, bounds = e.encode(list(range(50_000)), ["there"] * 50_000)
    got = Counter(tuple(ids[a:b].tolist()) for a, b in zip(bounds, bounds[1:]))
    assert set(got) <= set(want) and all(abs(got[k] / 50_000 - p / total) < 0.01 for k, p in want.items())


def test_whole_lattice_across_words_and_passes(monkeypatch):
    e = pieces.Encoder(sharpness=0.2)
    longer = [s for s in e.v.pieces if "  " in s or "__" in s or len(s) > 2 and "_" in s]
    assert longer  # pieces that a cut at words would lose
    for s in longer[:200]:
        assert not len(e.v.cuts(s))
    text = "x  " + longer[0] + " y"
    ids, bounds = e.encode(list(range(60_000)), [text] * 60_000)
    # Chances of all paths over the whole text, by plain forward sums; the share that uses the long piece.
    x = " " + text
    def paths(skip):
        out = [1.0] + [0.0] * len(x)
        for j in range(1, len(x) + 1):
            for i in range(max(0, j - e.v.longest), j):
                hit = e.v.pieces.get(x[i:j])
                if hit and x[i:j] != skip:
                    out[j] += out[i] * hit[1]
        return out[-1]
    want = 1 - paths(longer[0]) / paths(None)
    piece = e.v.pieces[longer[0]][0]
    rows = np.repeat(np.arange(60_000), np.diff(bounds))
    got = len(np.unique(rows[ids == piece])) / 60_000
    assert want > 0.005 and abs(got - want) < 0.01
    rng = random.Random(24)
    texts = ["".join(rng.choice(["the ", "  ", "x__y", "é漢", "𝒳", "\n\t", "12 ", "aaaa" * 30]) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    whole = e.encode(list(range(60)), texts)
    monkeypatch.setattr(pieces, "PASS_CHARS", 300)
    parts = e.encode(list(range(60)), texts)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    assert [pieces.decode_ids(whole[0][a:b]) for a, b in zip(whole[1], whole[1][1:])] == texts


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows, empty):
    fps = [slow_fingerprint(t) for _, t, _, _ in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    want = Counter((rows[i][0], fps[i].to_bytes(8, "big"), least[group[i]]) for i in range(len(rows)))
    assert Counter((r.doc_id, bytes(r.fp), r.component_id) for r in simhash.simhash_components(docs).collect()) == want
    assert simhash.simhash_components(empty).count() == 0
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and not {100, 101, 102} & {r.doc_id for r in kept.collect()}


def test_links_of_close_fingerprints_in_blocks(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base}
    for _ in range(150):
        x = rng.choice(sorted(fps))
        for _ in range(rng.randint(1, 5)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(50)}
    fps = sorted(fps)
    near = {f: {g for g in fps if (f ^ g).bit_count() <= 4} for f in fps}
    label = {}
    for f in fps:
        todo = [f]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = f
                todo += near[x]
    df = spark.createDataFrame([(f.to_bytes(8, "big"),) for f in fps], "fp binary")
    for block in (7, 512):
        parts = common.connected_components(simhash.fingerprint_links(df, words=1, max_bits=4, block=block)).collect()
        got = {int.from_bytes(r.node, "big"): int.from_bytes(r.component, "big") for r in parts}
        assert {f: got.get(f, f) for f in fps} == label


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_by_brute_force(rows):
    """Of each component of rows (key, text) at similarity 0.8 or more the key and shingles of the first."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for i, g in enumerate(group):
        key = rows[i][0]
        best[g] = min(best.get(g, (True, 0)), (key is None, key or 0)) if g in best else (key is None, key or 0)
    return Counter(None if no_key else key for no_key, key in best.values())


@pytest.mark.parametrize("block", [7, 512])
def test_deduplicated_finds_all_pairs_at_the_similarity_asked(spark, block):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    # Texts of n words that share a beginning: the similarity lies closely on both sides of 0.8.
    for i in range(150):
        n = rng.choice((9, 40, 84, 104, 204))
        a = [word() for _ in range(n)]
        s = n - 4
        common = math.ceil(8 * s / 9) - rng.randrange(2)  # 2 * s - common in the union
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(a[: common + 4] + [word() for _ in range(s - common)]))]
    # Chains: each a near-copy of the next, the ends are not; and a large group of near-copies.
    a = [word() for _ in range(60)]
    for i in range(30):
        a = a[2:] + [word(), word()]
        rows.append((1000 + i, " ".join(a)))
    a = [word() for _ in range(60)]
    rows += [(2000 + i, " ".join([*a, word()])) for i in range(40)]
    # Repeats count once: one more run of a passage leaves the set as it is.
    rows += [(3000, " ".join(a[:30] * 2)), (3001, " ".join(a[:30] * 9)), (3002, "a b c"), (3003, "A  b\nc"), (3004, "a b d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = kept_by_brute_force(rows)
    assert 200 < want.total() < 300
    assert Counter(r.doc_id for r in simhash.deduplicated(df, block=block).collect()) == want


def test_deduplicated_judges_rows_not_keys(spark, docs, rows):
    rng = random.Random(13)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
    a, b, c, d, e, f = (text() for _ in range(6))
    mine = [(None, a), (None, b), (None, b + " end"), (1, c), (1, d), (1, d), (2, e), (None, e), (3, c), (3, f), (None, None), (None, ""), (None, a)]
    out = Counter((r.doc_id, r.text) for r in simhash.deduplicated(spark.createDataFrame(mine, "doc_id long, text string")).collect())
    blank = out[None, None] + out[None, ""]
    either = out[None, b] + out[None, b + " end"]
    assert blank == either == 1 and out.total() == 7
    assert all(out[k] == 1 for k in ((None, a), (1, c), (1, d), (2, e), (3, f)))
    kept = Counter(r.doc_id for r in simhash.deduplicated(docs).collect())
    assert kept == kept_by_brute_force([r[:2] for r in rows]) and kept[None] == kept[500] == 0


def test_covering_holds():
    from itertools import combinations

    groups = simhash.covering(8, 4)
    assert len(groups) <= 24 and all(any(set(g) <= set(q) for g in groups) for q in combinations(range(8), 4))


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 16))
    x[50:60] = x[50]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [math.nan] * 16, 1), (1003, [], 1), (None, x[0].tolist(), 1), (50, x[50].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = defaultdict(list)
    for r in neighbours.nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    for q in range(0, 400, 50):
        c = np.round(unit @ unit[q], 12)
        c[q] = -2
        best = sorted(range(400), key=lambda i: (-c[i], i))[:5]
        assert len(got[q]) == 5
        hit += len(set(best) & set(got[q]))
    assert hit >= 0.9 * 40 and got[50][:4] == [51, 52, 53, 54]
    assert set(got) == set(range(0, 400, 50))
    assert neighbours.nearest(df.limit(0), df).count() == 0
    few = df.where("vec_id < 3")
    assert neighbours.nearest(few, few).count() == 6


@pytest.mark.parametrize("bits", [4, 2, 0])
def test_pigeonhole_finds_every_code_once(bits):
    rng = np.random.default_rng(7)
    model = neighbours.Model(np.zeros(64), np.eye(64), 0)
    codes = rng.integers(0, 65536, (500, 4)).astype(np.uint16)
    heads = codes.astype(int) >> (16 - bits)
    tables = [(t, p, np.flatnonzero(heads[:, t] == p)) for t in range(4) for p in range(1 << bits)]
    index = [(rows, neighbours.Index(codes[rows], t, p, bits)) for t, p, rows in tables if len(rows)]
    for i in range(12):
        d = np.bitwise_count(codes ^ codes[i]).sum(axis=1)
        for radius in (0, 1, 7, 20, 26, 33, 64):
            found = np.concatenate([rows[x.within(codes[i], radius, model.reach(radius))] for rows, x in index])
            assert sorted(found.tolist()) == np.flatnonzero(d <= radius).tolist()


def test_recall_on_five_thousand_vectors(spark):
    rng = np.random.default_rng(23)
    centres = rng.standard_normal((40, 48))
    x = rng.standard_normal((5000, 48))
    x[:2500] = centres[rng.integers(0, 40, 2500)] + 0.3 * x[:2500]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(dict)
    for r in neighbours.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got[r.query_id][r.vec_id] = (r.rank, r.score)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    for q in range(0, 5000, 50):
        c = unit @ unit[q]
        c[q] = -2
        best = np.argsort(-c)[:5]
        hit += len(set(best.tolist()) & set(got[q]))
        assert len(got[q]) == 5 and all(abs(s - c[v]) < 1e-12 for v, (_, s) in got[q].items())
        assert [s for _, s in sorted(got[q].values())] == sorted((s for _, s in got[q].values()), reverse=True)
    assert hit >= 0.9 * 500


def test_wide_vectors_are_projected(spark):
    rng = np.random.default_rng(25)
    basis = rng.standard_normal((12, 200))
    x = rng.standard_normal((600, 12)) @ basis
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    got = defaultdict(set)
    for r in neighbours.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    hit = 0
    for q in range(0, 600, 50):
        c = unit @ unit[q]
        c[q] = -2
        hit += len(set(np.argsort(-c)[:5].tolist()) & got[q])
    assert hit >= 0.9 * 60


def test_licenses(spark, empty):
    mit = next(t for label, t in licenses.TEMPLATES if label == "mit" and len(t) > 200)
    rows = [(1, "x MIT-License y mit license"), (2, mit.replace(",", " ;")), (3, "Licensed under the Apache License, Version 2.0."), (4, None), (5, ""), (6, "the license is in the software of any person to be free"), (None, "GNU General\nPublic License")]
    df = make(spark, [(i, t, "en", "s") for i, t in rows])
    out = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    assert (out[1].n_base, out[1].first_word, out[1].last_word, out[1].base_labels) == (2, 1, 4, "mit")
    assert out[2].labels == "mit" and out[2].n_base == 0 and out[2].score > 0.95
    assert out[3].labels == out[3].base_labels == "apache"
    assert out[4].n_words == out[5].n_words == 0 and out[4].score == 0 and out[4].first_word is None
    assert out[6].labels == "" and out[None].base_labels == "gpl"
    assert licenses.license_scan(empty).count() == 0


def test_automaton_matching_statistics():
    rng = random.Random(8)
    templates = [[rng.randrange(4) for _ in range(25)] for _ in range(3)]
    a = licenses.Automaton(templates)
    for _ in range(30):
        text = [rng.randrange(5) for _ in range(40)]
        text = [-1 if c == 4 else c for c in text]
        inside = lambda s: any(t[k : k + len(s)] == s for t in templates for k in range(len(t)))
        want = []
        for i in range(40):
            for n in range(40 - i, 2, -1):
                s = text[i : i + n]
                if inside(s):
                    if (i + n == 40 or not inside(text[i : i + n + 1])) and (i == 0 or not inside(text[i - 1 : i + n])):
                        want.append((i, n))
                    break
        assert [(s, n) for s, n, _ in a.matches(text, 3)] == want
        for s, n, state in a.matches(text, 3):
            places = {t: {k + n for k in range(26 - n) if templates[t][k : k + n] == text[s : s + n]} for t in range(3)}
            assert a.ends[state] == {t: p for t, p in places.items() if p}


def chain_by_hand(template, words, least, gap):
    """The most words of a template that a chain of maximal matches covers, over all chains."""
    same = lambda i, k: 0 <= i < len(words) and 0 <= k < len(template) and words[i] == template[k]
    found = []
    for i in range(len(words)):
        for k in range(len(template)):
            n = 0
            while same(i + n, k + n):
                n += 1
            if n >= least and not same(i - 1, k - 1):
                found.append((i, k, n))
    best = 0

    def grow(chain, covered):
        nonlocal best
        best = max(best, covered)
        i0, k0, n0 = chain[-1] if chain else (None, None, None)
        for i, k, n in found:
            if chain:
                if i <= i0 or i - (i0 + n0) > gap:
                    continue
                lost = max(0, k0 + n0 - k, i0 + n0 - i)
                if lost >= n or k < k0 + n0 - lost or k + n <= k0 + n0:
                    continue
                grow([*chain, (i, k, n)], covered + n - lost)
            else:
                grow([(i, k, n)], n)

    grow([], 0)
    return best


def test_chains_cover_what_the_best_chain_covers():
    one = b"pa pb pc pd one two three four pa pb pc pd".split()
    scanner = licenses.Scanner([("x", " ".join(w.decode() for w in one))])
    assert scanner.covers(one)[0][0] == 12
    rng = random.Random(26)
    for _ in range(60):
        template = [f"w{rng.randrange(12)}".encode() for _ in range(24)]
        scanner = licenses.Scanner([("x", b" ".join(template).decode())])
        text = []
        for _ in range(rng.randint(1, 4)):
            a = rng.randrange(20)
            text += template[a : a + rng.randint(4, 12)] + [b"zz"] * rng.randrange(4)
        covers = scanner.covers(text)
        # Matches in more than one template place are maximal by file, so a plain chain can only do better by splitting them.
        assert covers[0][0] <= chain_by_hand(template, text, licenses.LEAST_MATCH, licenses.MOST_GAP) <= len(template)


def test_license_rows_by_plain_search(spark):
    rng = random.Random(27)
    pool = ["MIT License", "mit-license", "Apache License", "General\nPublic  License", "license", "mit", "public license", "the", "é", "x1", "GENERAL PUBLIC LICENSE,"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))) for i in range(120)] + [(200, "word " * 200_000 + "MIT License")] + [(201, "mit license")] * 2
    import re

    want = Counter()
    for i, t in rows:
        low = re.sub(r"[A-Z]", lambda m: m.group().lower(), t)
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for phrase, label in licenses.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in places]
        want[i, len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))] += 1
    out = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in out)


def test_mixing(docs, rows, empty):
    out = mixing.mix_sources(docs).collect()
    assert len(out) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in out:
        sizes[r.src] += r.size
        taken[r.src] += r.taken
        target[r.src] = r.target
        assert r.taken <= 2 * r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, free, budget = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        share = {s: budget * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s] + 1e-9]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 2 * sizes[s]
            budget -= want[s]
            free.remove(s)
    longest = max(r.size for r in out)
    for s in order:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= longest
    again = Counter(tuple(r) for r in mixing.mix_sources(docs.repartition(5)).collect())
    assert again == Counter(tuple(r) for r in out)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in out)
    assert mixing.mix_sources(empty).count() == 0


def test_sample_is_that_of_a_plain_sort(spark):
    rng = random.Random(28)
    rows = [(i, " ".join(["w"] * rng.choice((0, 1, 2, 5, 30, 400))), rng.choice(("a", "b", "c", "d", None))) for i in range(900)]
    rows += [(2000, "w " * 30_000, "a"), (2001, "w " * 9000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(df).collect()
    u = {r.doc_id: r.u for r in mixing._keyed(df, "doc_id", "text", "source", 8).collect()}
    by = defaultdict(list)
    for r in out:
        by[r.src].append(r)
    for src, docs in by.items():
        whole, total = int(docs[0].target // docs[0].source_size), docs[0].source_size
        rest = docs[0].target - whole * total
        own = [r for r in docs if r.size]
        mean = total / len(docs)
        low, high = 0.0, 1e6
        for _ in range(200):  # the scale at which the expected words of the sample are those needed
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(1, mid * (r.size / mean) ** 0.5) * r.size for r in own) < rest else (low, mid)
        q = {}
        for r in own:
            p = min(1, high * (r.size / mean) ** 0.5)
            q[r.doc_id] = 0.0 if p > 1 - 1e-9 else (u[r.doc_id] / (1 - u[r.doc_id])) / (p / (1 - p))
        taken, words = set(), 0
        for r in sorted(own, key=lambda r: q[r.doc_id]):
            if q[r.doc_id] and (words >= rest or words + r.size - rest >= rest - words):
                break
            taken.add(r.doc_id)
            words += r.size
        if rest <= 0:
            taken = set()
        assert {r.doc_id: r.copies for r in docs} == {r.doc_id: (whole + (r.doc_id in taken) if r.size else 0) for r in docs}, src


def plain_spans(text):
    import re

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        double = sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and double % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def test_base_spans_are_those_of_the_plain_patterns(spark):
    rng = random.Random(29)
    bits = ["a@b.c", "x.y@z-1.org", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (415) 555-0132", "+49", "00", "é", " ", "-", "_", "%", "7", "12345678", "(", "a", "..", "+4 5", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t), t
    rows = [(i, t) for i, t in enumerate(texts[:60])] * 2 + [(None, texts[0]), (None, None)]
    w = pii.weights()
    want = Counter((i, *(sum(k == x for x, _, _ in plain_spans(t or "")) for k in pii.KINDS), pii._written(pii.find_spans(t or "", w)[1])) for i, t in rows)
    out = pii.pii_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) for r in out) == want
    assert all(r.n_spans == len([x for x in r.spans.split(",") if x]) for r in out)


def test_decoding_is_the_best_of_all_segmentations():
    w = pii.weights()
    rng = random.Random(30)
    for _ in range(120):
        text, _ = pii._sentence(rng)
        text = text[:34]
        if len(pii._tokens(text)) > 14 or not pii.ANCHOR.search(text):
            continue
        zones = list(pii._zones(text))
        if len(zones) != 1:
            continue
        tokens, segments, feats = pii._lattice(text, *zones[0], lambda n: n)
        by_start = defaultdict(list)
        for (i, j, kind), f in zip(segments, feats):
            by_start[i].append((j, kind, sum(w.get(n, -0.5) for n in f)))

        def every(i):
            if i == len(tokens):
                yield 0.0, []
            for j, kind, s in by_start[i]:
                for total, rest in every(j):
                    yield s + total, [(kind, tokens[i][1], tokens[j - 1][2]), *rest] if kind != "none" else rest

        best = max(s for s, _ in every(0))
        near = [sorted(x) for s, x in every(0) if s > best - 1e-9]
        assert sorted(pii.field_spans(text, w)) in near


@pytest.mark.parametrize("text, value", [("api_key: 'Zk39dkWq02LLmn4'", "Zk39dkWq02LLmn4"), ('token = "cb1a9fee807a05366fcb8b6c95c7c565ede51a72"', "cb1a9fee807a05366fcb8b6c95c7c565ede51a72"), ("PASSWORD=correct-horse-9", "correct-horse-9")])
def test_secrets(text, value):
    at = text.index(value)
    assert ("secret", at, at + len(value)) in pii.find_spans("see " + text + " there", pii.weights())[1] or ("secret", at + 4, at + 4 + len(value)) in pii.find_spans("see " + text + " there", pii.weights())[1]
    assert not [s for s in pii.find_spans("commit cb1a9fee807a05366fcb8b6c95c7c565ede51a72 of the tree, monkey: 12345678", pii.weights())[1] if s[0] == "secret"]


def test_pii(spark, empty):
    text = "Mail a.b@c.example.org, +1 (415) 555-0132; host 10.0.0.255 not 10.0.0.256; card 4111 1111 1111 1111. é x@y"
    df = make(spark, [(1, text, "en", "s"), (2, None, "en", "s"), (None, "", "en", "s"), (3, "1" * 50_000 + "a" * 50_000 + "@", "en", "s")])
    out = {r.doc_id: r for r in pii.pii_spans(df).collect()}
    at = lambda s: f"{text.index(s)}:{text.index(s) + len(s)}"
    base = f"email:{at('a.b@c.example.org')},ip:{at('10.0.0.255')},card:{at('4111 1111 1111 1111')},phone:{at('+1 (415) 555-0132')}"
    assert out[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert set(base.split(",")) <= set(out[1].spans.split(","))
    assert out[2].spans == "" and out[None].n_ip == 0 and out[3].n_card == 0
    clean = pii.redacted(df).where("doc_id = 1").first()
    assert "<email>" in clean.text and "4111" not in clean.text and clean.n_chars == len(clean.text)
    assert pii.pii_spans(empty).count() == 0 and pii.redacted(empty).count() == 0


def test_field_on_held_out_sentences():
    rng = random.Random(99)
    w = pii.weights()
    right = wrong = missed = 0
    for _ in range(150):
        text, spans = pii._sentence(rng)
        got, gold = set(pii.find_spans(text, w)[1]), {(k, a, b) for a, b, k in spans}
        right, wrong, missed = right + len(got & gold), wrong + len(got - gold), missed + len(gold - got)
    assert right / (right + wrong) > 0.85 and right / (right + missed) > 0.85


def test_zones_in_text_without_white_space():
    w = pii.weights()
    number = "0041446681800"
    for text in ("x" * 50 + '{"tel":"' + number + '"},{"m":"' + "y" * 60 + '"}', "请联系我们的客服热线" * 6 + number + "工作时间是每天上午" * 8, "a," * 300 + number + ",b" * 300):
        at = text.index(number)
        assert any(a <= at and at + len(number) <= b for a, b in pii._zones(text))
        tokens = [t for a, b in pii._zones(text) for t in pii._lattice(text, a, b, str)[0]]
        assert number in [t for t, _, _ in tokens]
    for entity in ("00 41 446 681800", "0041 446 681800"):
        for text in (f"tel: {entity} ", "x" * 50 + f" tel: {entity} " + "y" * 90):
            assert ("phone", text.index(entity), text.index(entity) + len(entity)) in pii.find_spans(text, w)[1]
    rng = random.Random(14)
    for _ in range(300):
        text = "".join(rng.choice("ab漢,. 1@") if rng.random() < 0.1 else rng.choice("abc漢") for _ in range(rng.randint(1, 600)))
        zones = list(pii._zones(text))
        assert all(a < b < c for (a, b), (c, _) in zip(zones, zones[1:]))
        assert all(any(a <= m.start() and m.end() <= b for a, b in zones) for m in pii.ANCHOR.finditer(text))


@pytest.mark.parametrize("entity", ["word.42 (at) word.example.com", "jean.dupont (at) mail.example.co.uk"])
def test_entities_of_many_tokens(entity):
    text = f"Please write to email: {entity} today"
    at = text.index(entity)
    assert ("email", at, at + len(entity)) in pii.find_spans(text, pii.weights())[1]


def test_copies_of_one_document_get_pages(spark):
    rows = [(5, "x" * 300)] * 500 + [(5, f"{i:04}" * 50) for i in range(200)] + [(None, "y" * 700)] * 30 + [(i, "z") for i in range(50)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), limit_bytes=1000).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in out) == Counter((i, len(t)) for i, t in rows)
    pages = defaultdict(list)
    for r in out:
        pages[r.shard, r.page].append(r.n_bytes)
    assert all(sum(p) <= 1000 for p in pages.values())
    assert sum(1 for p in pages.values() if p[0] == 300) <= 500 // 3 + 1 and len({r.shard for r in out}) > 40


def test_pages_stay_within_the_limit(spark, tmp_path):
    rng = random.Random(15)
    sizes = [rng.choice((0, 1, 10, 300, 900, 1100, 1900, 2000)) for _ in range(400)] + [2001, 5000, 1999, 1000, 1001]
    rows = [(None if i % 2 else 7, f"{i:05}"[:n] + "x" * max(0, n - 5)) for i, n in enumerate(sizes)] + [(9, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard_documents(df, limit_bytes=2000).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in out) == Counter((i, len(t)) for i, t in rows)
    pages = defaultdict(list)
    for r in out:
        pages[r.shard, r.page].append(r.n_bytes)
    assert all(sum(p) <= 2000 or len(p) == 1 for p in pages.values())
    for s in {s for s, _ in pages}:
        numbers = [p for t, p in pages if t == s]
        assert sorted(numbers) == list(range(len(numbers)))
        assert len(numbers) <= 2 * sum(r.n_bytes for r in out if r.shard == s) / 1000 + 1
    sharding.write_shards(df, f"{tmp_path}/out", limit_bytes=2000)
    back = spark.read.option("basePath", f"{tmp_path}/out").parquet(f"{tmp_path}/out").withColumn("file", F.regexp_extract(F.input_file_name(), "(.*)/", 1)).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter(rows)
    folders = defaultdict(list)
    for r in back:
        folders[r.file].append(len(r.text))
    assert sorted(map(sorted, folders.values())) == sorted(map(sorted, pages.values()))


def test_sharding(docs, rows, empty):
    out = sharding.shard_documents(docs, limit_bytes=3000).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in out) == Counter((i, len((t or "").encode())) for i, t, _, _ in rows)
    pages, shards = Counter(), {}
    for r in out:
        pages[r.shard, r.page] += r.n_bytes
        shards[r.shard] = r.shard_bytes
    names = sorted(shards)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    for s, size in shards.items():
        members = [r for r in out if r.shard == s]
        assert size == sum(r.n_bytes for r in members)
        assert size <= 3000 or len(s) == sharding.HASH_BITS
        if s:  # its parent was too large
            assert sum(r.n_bytes for r in out if r.shard.startswith(s[:-1])) > 3000 or len(s) == sharding.HASH_BITS
    assert sharding.shard_documents(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (None, 3), (60, 50), (50, 60), (70, 60)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 60: 50, 70: 50}


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    kept = [r for r in out.collect()]
    assert kept and all(r.lossless for r in kept)
    assert not {100, 101, 400, 401, 601} & {r.doc_id for r in kept}


def test_pipeline_of_odd_tables(spark, tmp_path, empty, rows):
    import corpus_pipeline

    rng = random.Random(31)
    long = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    a, b, c = long(), long(), long()
    odd = [(None, a, "en", "s"), (None, b, "en", None), (7, c, None, "s"), (7, a + " end", "en", "s"), (8, long(), "en", "t"), (9, None, None, None)]
    for name, docs in (("empty", empty.select("doc_id", "text", "lang", "source", "n_chars")), ("odd", make(spark, odd).select("doc_id", "text", "lang", "source", "n_chars"))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    kept = corpus_pipeline.filter_quality(spark, docs, f"{tmp_path}/odd")
    kept = corpus_pipeline.drop_near_copies(spark, kept, f"{tmp_path}/odd")
    left = Counter((r.doc_id, r.text) for r in kept.collect())
    assert left.total() == 4 and left[7, c] == left[None, b] == 1 and left[7, a + " end"] == 1 and left[None, a] == 0
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert out and all(r.lossless for r in out) and {r.doc_id for r in out} <= {None, 7, 8}


def test_shared_folder_must_be_named_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())
    Session.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_stage_candidates_come_through_the_index(spark):
    """deduplicated() takes all pairs within four of the first 64 bits from the byte-position index, copies included."""
    rng = np.random.default_rng(4)
    heads = [int(x) for x in rng.integers(0, 2**63, 40, np.uint64)]
    near = [h ^ sum(1 << int(b) for b in rng.choice(63, 4, replace=False)) for h in heads[:20]]
    heads += [*near, heads[0]]
    rows = [(bytes([i]) * 16, h.to_bytes(8, "big") + rng.bytes(56)) for i, h in enumerate(heads)]
    edges = simhash.indexed_candidates(spark.createDataFrame(rows, "__node binary, fp binary"))
    got = {frozenset((bytes(r.u)[0], bytes(r.v)[0])) for r in edges.collect()}
    assert got >= {frozenset((i, 40 + i)) for i in range(1, 20)}
    assert all((heads[a] ^ heads[b]).bit_count() <= 4 for a, b in map(sorted, got)) and frozenset((0, 60)) in got
