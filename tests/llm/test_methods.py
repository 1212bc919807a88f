"""The learned methods against plain loops and enumeration, and every stage of the pipeline against brute force."""

import base64
import collections
import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.llm import components, mixing, personal_data, quality_rules, toxicity

from .test_llm import WORD, components_brute, dedup_brute, statistics

# 1


def covering(rows, cuts, max_rules=12, max_conditions=3, min_precision=0.9, min_covered=5):
    """Rules as lists of (feature, at least, threshold), by the textbook on plain rows."""

    def holds(r, c):
        return r[c[0]] >= c[2] if c[1] else r[c[0]] < c[2]

    def split(of):
        return [(sum(r["bad"] for r in of if r["prune"] is s), sum(not r["bad"] for r in of if r["prune"] is s)) for s in (False, True)]

    found, left = [], rows
    while len(found) < max_rules:
        grown, trail, own = [], [], left
        while len(grown) < max_conditions:
            (p0, n0), _ = split(own)
            best = None
            for f, up in itertools.chain.from_iterable([(f, True), (f, False)] for f in quality_rules.FEATURES) if p0 and n0 else ():
                for x in cuts[f]:
                    (p, n), kept = split([r for r in own if holds(r, (f, up, x))])
                    if p >= min_covered:
                        gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                        if gain > 1e-9:
                            key = (round(gain, 9), -quality_rules.FEATURES.index(f), -cuts[f].index(x), up)
                            if best is None or key > best[0]:
                                best = (key, (f, up, x), kept, n == 0)
            if best is None:
                break
            grown.append(best[1])
            trail.append(best[2])
            own = [r for r in own if holds(r, best[1])]
            if best[3]:
                break
        if not grown:
            break
        worth = [(b - g) / (b + g) if b + g else -1.0 for b, g in trail]
        size = max(range(len(trail)), key=lambda i: (round(worth[i], 6), -i)) + 1
        bad, good = trail[size - 1]
        if bad + good < min_covered or bad / (bad + good) < min_precision:
            break
        found.append(grown[:size])
        left = [r for r in left if not all(holds(r, c) for c in grown[:size])]
    return found


@pytest.mark.parametrize("seed", range(3))
def test_rules_equal_plain_covering(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(500):
        x = {f: round(rng.random(), 2) for f in quality_rules.FEATURES}
        bad = x["symbol_rate"] > 0.8 or (x["bang_rate"] > 0.6 and x["mean_word"] < 0.4) or rng.random() < 0.02
        rows.append({**x, "bad": bad, "prune": i % 3 == 0})
    df = spark.createDataFrame([tuple(r[c] for c in (*quality_rules.FEATURES, "bad", "prune")) for r in rows], ", ".join([*[f"{f} double" for f in quality_rules.FEATURES], "bad boolean", "prune boolean"])).cache()
    at = df.groupBy("bad").agg(*[F.percentile_approx(f, quality_rules.QUANTILES, 10_000).alias(f) for f in quality_rules.FEATURES]).collect()
    cuts = {f: sorted({x for r in at for x in r[f]}) for f in quality_rules.FEATURES}
    got = quality_rules.learn_rules(df)
    want = covering(rows, cuts)
    assert want and [[(c.feature, c.at_least, c.threshold) for c in r.conditions] for r in got] == want
    first = collections.Counter(r.rule for r in df.withColumn("base_failed", F.lit(False)).select(quality_rules.verdict(got).alias("rule")).collect())
    plain = collections.Counter(next((k for k, cs in enumerate(want, 1) if all((r[f] >= x) if up else (r[f] < x) for f, up, x in cs)), 0) for r in rows)
    assert first == plain


# 7


def pooled_brute(net, ids):
    """Every filter at every start, one number at a time."""
    n_regions = -(-len(ids) // toxicity.REGION)
    largest, means = [], []
    for k, w in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            tops = []
            for r in range(n_regions):
                values = []
                for s in range(r * toxicity.REGION, (r + 1) * toxicity.REGION):
                    if s + w <= len(ids):
                        total = float(net.offsets[k][f])
                        for j in range(w):
                            slots = [(int(ids[s + j]) >> 16 * t) & (toxicity.SLOTS - 1) for t in range(3)]
                            for z in range(toxicity.SIZE):
                                total += sum(float(net.tables[t][slots[t], z]) for t in range(3)) * float(net.filters[k][j, z, f])
                        values.append(total)
                tops.append(max([0.0, *values]))
            largest.append(max([0.0, *tops]))
            means.append(sum(tops) / max(1, n_regions))
    return np.array(largest + means)


def some_net(seed=0):
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.standard_normal(shape).astype(np.float32)
    n = toxicity.FILTERS * len(toxicity.WIDTHS)
    return toxicity.Net([draw(toxicity.SLOTS, toxicity.SIZE) for _ in range(3)], [draw(w, toxicity.SIZE, toxicity.FILTERS) for w in toxicity.WIDTHS], [draw(toxicity.FILTERS) for _ in toxicity.WIDTHS], draw(2 * n))


@pytest.mark.parametrize("section", [toxicity.SECTION, toxicity.REGION])
def test_convolution_equals_plain_loops(monkeypatch, section):
    monkeypatch.setattr(toxicity, "SECTION", section)
    net, words = some_net(), toxicity._Words()
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 31, 32, 33, 34, 65, 97):
        ids = toxicity.hashed(" ".join(rng.choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=n)), words)
        assert np.allclose(net.pooled(ids), pooled_brute(net, ids), rtol=1e-3, atol=1e-3), n


def test_thresholds_by_language_have_the_most_f1():
    rng = np.random.default_rng(3)
    toxic = (rng.random(400) < 0.3).astype(float)
    langs = ["en" if i % 2 else "de" for i in range(400)]
    logits = 2 * toxic - 1 + rng.standard_normal(400) + np.array([0.8 if x == "de" else 0 for x in langs])
    net = toxicity.Net([], [], [], np.zeros(1, np.float32))
    toxicity.calibrate(net, logits, toxic, langs)
    p = 1 / (1 + np.exp(-(net.scale * logits + net.shift)))

    def f1(own, cut):
        said = p[own] >= cut
        return 2 * (toxic[own] * said).sum() / max(1, said.sum() + toxic[own].sum())

    assert set(net.thresholds) == {"en", "de"}
    for lang, cut in net.thresholds.items():
        own = np.array([x == lang for x in langs])
        assert f1(own, cut) >= max(f1(own, c) for c in [0.5, *p[own]]) - 1e-9


# 8


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs_with_hubs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]
    edges += [(h, rng.randrange(1000, 1400)) for h in (1000, 1200, 1399) for _ in range(120)] + edges[:20]
    root = {v: v for e in edges for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = components.connected(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.v, r.root) for r in got) == sorted((v, find(v)) for v in root if find(v) != v)


# 10


def segmentations(region, before, after):
    """Every list of (kind, start, end, features) of segments that do not overlap."""
    cuts, ends = personal_data._segments(region, before, after)

    def upto(j):
        if j == 0:
            yield []
            return
        yield from upto(j - 1)
        for i, f in ends[j - 1]:
            for rest in upto(i):
                for k in range(len(personal_data.KINDS) - 1):
                    yield [*rest, (k + 1, cuts[i], cuts[j], f)]

    return list(upto(len(cuts) - 1))


REGIONS = ["10.0.0.1", "+1 (555) 123-4567", "4465758382889437 10.1.2.3", "1234-5678 9012", "+44 20 7946 0958", "12345"]


@pytest.mark.parametrize("region", REGIONS)
def test_best_segmentation_equals_enumeration(region):
    rng = np.random.default_rng(len(region))
    paths = segmentations(region, " ", "")
    for _ in range(20):
        field = personal_data.Field(rng.standard_normal((len(personal_data.KINDS) - 1, personal_data.N_FEATURES)))
        worth = [sum(field.weights[k - 1, f].sum() for k, _, _, f in p) for p in paths]
        got = field.best(region, " ", "")
        mine = next(w for p, w in zip(paths, worth, strict=True) if [s[:3] for s in p] == got)
        assert mine >= max(worth) - 1e-6


@pytest.mark.parametrize("region", REGIONS)
def test_field_gradient_equals_enumeration(region):
    rng = np.random.default_rng(len(region))
    paths = segmentations(region, "", "x")
    field = personal_data.Field(rng.standard_normal((len(personal_data.KINDS) - 1, personal_data.N_FEATURES)))
    worth = np.array([sum(field.weights[k - 1, f].sum() for k, _, _, f in p) for p in paths])
    share = np.exp(worth - np.logaddexp.reduce(worth))
    for gold in (paths[0], max(paths, key=len)):
        want = np.zeros_like(field.weights)
        for p, s in [(gold, 1.0), *zip(paths, -share, strict=True)]:
            for k, _, _, f in p:
                want[k - 1, f] += s
        assert np.allclose(field.gradient(region, "", "x", [s[:3] for s in gold]), want, atol=1e-8)


# pipeline


def corpus():
    rng = random.Random(11)
    line = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(6, 14)))
    shared = [line() for _ in range(5)]
    rows = []
    for i in range(240):
        body = [line() for _ in range(rng.randrange(4, 9))]
        if i % 6 == 1:
            body[2:2] = shared
        if i % 4 == 3:
            body.append("#" * 75)
        rows.append((i, "\n".join(body)))
    rows += [(300 + i, rows[5 * i][1].replace("\n", " ")) for i in range(12)]
    rows += [(320 + i, rows[6 * i][1]) for i in range(8)]
    rows += [(340 + i, " ".join("edited" if rng.random() < 0.01 else w for w in rows[6 * i][1].split())) for i in range(12)]
    rows += [(360, None), (361, ""), (362, "too short"), (363, "one two three four five " * 9), (364, "\n".join(shared)), (365, "\n\n".join(shared) + "\n \n")]
    return [(i, t, "en", (None, "a", "b")[i % 3], len(t or ""), f"own {i}") for i, t in rows]


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    import public_tokenizers
    import tiktoken

    import corpus_pipeline

    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, stats string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    y = spark.createDataFrame([(r[0], int(r[0] % 4 != 3 or r[0] >= 300), 0) for r in rows], "doc_id long, quality int, toxic int")
    y.write.parquet(f"{tmp_path}/labels.parquet")
    kept, docs = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        kept[name] = docs.collect()
        assert name == "byte_bpe" or docs.columns == before

    text = {r[0]: r[1] for r in rows}
    good = [i for i, t in text.items() for n, _, symbols, _, repeats in [statistics(t)] if n >= 10 and 100 * repeats <= 20 * n and symbols < 75]
    assert sorted((r.doc_id, r.text) for r in kept["quality_rules"]) == [(i, text[i]) for i in sorted(good)]

    cut = {i: t for i, (t, n) in dedup_brute([(r.doc_id, r.text) for r in kept["quality_rules"]]).items() if not n or WORD.search(t)}
    assert {r.doc_id: r.text for r in kept["line_dedup"]} == cut and len(kept["line_dedup"]) == len(cut) < len(good)
    assert all(r.n_chars == len(r.text) and r.stats == f"own {r.doc_id}" for r in kept["line_dedup"])

    roots = components_brute(list(cut.items()))
    alone = {i: t for i, t in cut.items() if roots[i][1] == i}
    assert {r.doc_id: r.text for r in kept["ngram_jaccard_join"]} == alone and len(kept["ngram_jaccard_join"]) == len(alone) < len(cut)

    took = collections.Counter()
    for r in kept["mixing"]:
        mine = collections.Counter(WORD.findall(r.text))
        assert mine <= collections.Counter(WORD.findall(alone[r.doc_id]))
        took[r.doc_id] += sum(mine.values())
    want = {r.doc_id: r.taken for r in mixing.taken(spark.read.parquet(f"{tmp_path}/ngram_jaccard_join.parquet")).collect()}
    assert set(want) == set(alone) and took == +collections.Counter(want)
    assert all(took[i] <= 2 * len(WORD.findall(t)) for i, t in alone.items())

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    final = []
    for r in kept["mixing"]:
        ids = encoding.encode_ordinary(r.text)
        final.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert sorted(map(tuple, kept["byte_bpe"])) == sorted(final)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(final)
