"""Each operator against a brute-force version and its defined edge cases."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.llm import bpe, components, jaccard_join, knn_join, line_dedup, lm_score, mixing, personal_data, quality_rules, quotes, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DDL = "doc_id long, text string, lang string, source string, n_chars long, size int, row string"


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 9, 30, 80, 200]))) for _ in range(40)]
    out = [*base, base[3], base[3], *[" ".join(w if rng.random() > 0.02 else "edited" for w in b.split(" ")) for b in base[:20]]]
    out += [None, "", " \n\t ", "A", "the the the the the the the the the the the the", "Ünïcode ß 日本語 text\nwith lines\n\nand more lines\nwith lines", "x" * 5000, " ".join(rng.choices(vocabulary, k=4000))]
    out += ["one line here\nsecond line here\nthird line here\nown tail", "head\none line here\nsecond line here\n\nthird line here\nlast", "a b c \x1c d\x0be"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 7 == 0 else f"s{i % 3}", len(t or ""), i, "x") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[5]], DDL).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DDL)


def labels(spark, docs, rows=None):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)] + [(None, 1, 1), (3, None, None), (4, 7, 7), (10**9, 1, 0)] if rows is None else rows, "doc_id long, quality int, toxic int")


def by_row(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# 1


def statistics(t):
    w = WORD.findall(t or "")
    at = collections.defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {p + k for v in at.values() if len(v) > 1 for p in v for k in range(5)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics_match_brute_force(spark, docs):
    more = spark.createDataFrame([(1, "a b c d e x a b c d e y a b c d e"), (2, "#|% <a> b\nb\nb"), (3, "a b c d e a b c d e a b c d e f")], "doc_id long, text string")
    for df in (docs.select("doc_id", "text"), more):
        got = sorted(tuple(r) for r in quality_rules.text_statistics(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
        assert got == sorted((i, *statistics(t)) for i, t in by_row(df))


def test_quality_rules_learn_a_threshold_and_keep_the_rest(spark):
    rows = [(i, " ".join([f"word{i}x{j}" for j in range(40)] + (["###"] * 15 if i % 4 == 0 else []))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 400, 2)] + [(i, 1, 0) for i in range(1, 400, 2)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.kept for r in quality_rules.judge(df, y).collect()}
    assert all(out[i] == (i % 4 != 0) for i in range(400))
    assert sorted(r.doc_id for r in quality_rules.keep_good(df, y).collect()) == [i for i in range(400) if i % 4]


def test_quality_edges(spark, docs, nothing):
    assert quality_rules.judge(nothing, labels(spark, nothing)).count() == 0
    assert quality_rules.judge(docs, labels(spark, docs, [])).where("kept = base_failed").count() == 0
    kept = quality_rules.keep_good(docs, labels(spark, docs))
    assert kept.columns == docs.columns and kept.where("text is null").count() == 0


# 2


def test_mixing_targets_and_takes(spark, docs):
    rows = mixing.taken(docs).collect()
    size = collections.Counter()
    source = {r.doc_id: r.source for r in docs.collect()}
    assert sorted((r.doc_id, r.size) for r in rows) == sorted((i, len(WORD.findall(t or ""))) for i, t in by_row(docs))
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        size[source[r.doc_id]] += r.size
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and level * weight[s] > 2 * size[s]}
        if not more:
            break
        capped |= more
    took = collections.Counter()
    for r in rows:
        s = source[r.doc_id]
        want = 2.0 * size[s] if s in capped else level * weight[s]
        assert r.source_size == size[s] and math.isclose(r.target, want, rel_tol=1e-12)
        took[s] += r.taken
    for s in order:
        want = 2.0 * size[s] if s in capped else level * weight[s]
        assert abs(took[s] - want) <= 2 * mixing.BLOCK
    assert sorted(map(tuple, mixing.taken(docs).collect())) == sorted(map(tuple, rows))


def test_mixed_documents_hold_the_words_taken(spark, docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = collections.Counter()
    for r in out.collect():
        got[r.doc_id] += len(WORD.findall(r.text))
    want = collections.Counter()
    for r in mixing.taken(docs).collect():
        want[r.doc_id] += r.taken
    assert got == +want


def test_mixing_edges(spark, nothing):
    assert mixing.taken(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r.size, r.target, r.taken) for r in mixing.taken(blank).collect()} == {(0, 0.0, 0)}


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 7, 64, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5)).alias("x")).toPandas().x
        assert sorted(got) == list(range(n))


# 3


def test_quotes_are_linked_and_cut(spark):
    rows = [
        (1, 0, "user", "Hello there my friend.\nHow are you today?"),
        (1, 1, "assistant", "On Monday, Bob wrote:\n> Hello there my friend.\n> How are you today?\nI am fine thanks a lot."),
        (1, 2, "user", "> I am fine thanks a lot.\n>> Hello there my friend.\nGood to hear that."),
        (1, 3, "user", "> how are  you today?\nAnswering the first."),
        (2, 5, "user", None),
        (2, 6, "x", "> Good to hear that.\nyes"),
        (None, 1, "a", "> q"),
        (3, 0, "a", ""),
        (3, 0, "a", ""),
    ]
    out = quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(out) == len(rows)
    got = {(r.conv_id, r.turn): r for r in out}
    assert [(got[1, t].depth, got[1, t].reply_turn) for t in range(4)] == [(0, None), (1, 0), (2, 1), (1, 0)]
    assert got[1, 1].text == "I am fine thanks a lot." and got[1, 2].n_quoted == 2
    assert [tuple(x) for x in got[1, 2].linked] == [(1, 0), (1, 1)]
    assert [tuple(x) for x in got[2, 6].linked] == [(1, 2)] and got[2, 6].depth == 1
    assert got[2, 5].text is None and got[None, 1].depth == 0


def test_quotes_of_what_the_own_conversation_says_first(spark):
    line = "this is the very line"
    rows = [
        (1, 3, "u", f"> {line}\n{line}"),
        (2, 0, "u", line),
        (2, 4, "u", f"> {line}\nyes"),
        (3, 0, "u", f"> {line}\nno"),
        (3, 1, "u", line),
        (4, 0, "u", "> only said here today\nonly said here today"),
    ]
    out = quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    got = {(r.conv_id, r.turn): [tuple(x) for x in r.linked] for r in out}
    assert got == {(1, 3): [(2, 0)], (2, 0): [], (2, 4): [(2, 0)], (3, 0): [(1, 3)], (3, 1): [], (4, 0): []}


def replies_brute(rows):
    """{(conv_id, turn): (depth, reply_turn, links, n_linked, own text)} by plain loops."""
    normal = lambda t: re.sub(r"\s+", " ", t).strip(" ").lower()
    level = lambda x: re.match(r"(?:\s*>)*", x).group().count(">")
    long = lambda x: len(x.split(" ")) >= 3
    own = {(c, t): re.sub(r"^\n+|\n+$", "", "\n".join(x for x in text.split("\n") if not level(x))) for c, t, _, text in rows}
    said = []
    for (c, t), text in own.items():
        units = {normal(text), *map(normal, re.split(r"\n\s*\n", text)), *[u for u in map(normal, text.split("\n")) if long(u)]} - {""}
        said += [(u, c, t) for u in units]
    out, up = {}, {}
    for c, t, _, text in rows:
        runs = []
        for at, x in enumerate(text.split("\n")):
            if level(x):
                line = re.sub(r"^(?:\s*>)+\s?", "", x)
                if runs and runs[-1][0] == level(x) and runs[-1][1] + len(runs[-1][2]) == at:
                    runs[-1][2].append(line)
                else:
                    runs.append((level(x), at, [line]))
        links, first = [], []
        for lv, at, lines in runs:
            units = {normal(" ".join(lines)), *[u for u in map(normal, lines) if long(u)]} - {""}
            found = []
            for u in units:
                near = min((b for w, a, b in said if w == u and a == c), default=t)
                if near < t:
                    found.append((False, c, near))
                else:
                    found += [(True, *m) for m in [min(((a, b) for w, a, b in said if w == u and a != c), default=None)] if m]
            if found:
                links.append(min(found)[1:])
                if not min(found)[0]:
                    first.append((lv, at, min(found)[2]))
        earlier = [b for a, b, _, _ in rows if a == c and b < t]
        up[c, t] = min(first)[2] if first else max(earlier, default=None)
        out[c, t] = (links, own[c, t])
    depth = lambda c, t: 0 if up[c, t] is None else 1 + depth(c, up[c, t])
    return {k: (depth(*k), up[k], sorted(set(v[0])), len(v[0]), v[1]) for k, v in out.items()}


@pytest.mark.parametrize("seed", range(3))
def test_quotes_match_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(quotes, "SPAN", 4)
    rng = random.Random(seed)
    pool = [" ".join(rng.choices(["red", "Blue", "sky", "sea", "one", "two"], k=rng.randrange(1, 6))) for _ in range(25)]
    rows = []
    for c in range(12):
        for t in sorted(rng.sample(range(30), rng.randrange(1, 9))):
            lines = [rng.choice(["", "", "> ", ">> ", "> > "]) + rng.choice(pool) for _ in range(rng.randrange(0, 5))]
            rows.append((c, t, "u", "\n".join(x for k, x in enumerate(lines) if not k or x.startswith(">") == lines[k - 1].startswith(">") or rng.random() < 0.8)))
    out = quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): (r.depth, r.reply_turn, sorted(map(tuple, r.linked)), r.n_linked, r.text) for r in out} == replies_brute(rows)


def test_quotes_edges(spark):
    schema = "conv_id long, turn long, role string, text string, row int, depth int"
    assert quotes.reply_ordered(spark.createDataFrame([], schema)).count() == 0
    long = spark.createDataFrame([(1, i, "u", f"turn {i} says this\n" + "> z\n" * 50, 0, 9) for i in range(70)], schema)
    assert [r.depth for r in quotes.reply_ordered(long).orderBy("turn").collect()] == list(range(70))


# 4


def dedup_brute(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        lines = t.split("\n")
        at = [k for k, x in enumerate(lines) if WORD.search(x)]
        cut, later = set(), []
        for k in range(len(at) - 2):
            w = tuple(lines[at[k + j]] for j in range(3))
            if w in seen:
                later.append(k)
            seen.add(w)
        for k in later:
            cut |= set(range(at[k], at[k + 2] + 1))
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in cut), len(cut))
    return out


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice(["alpha", "beta", "gamma", "delta", "", "  "]) for _ in range(rng.randrange(14)))) for i in range(60)]
    out = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == dedup_brute(rows)


def test_line_dedup_edges(spark, docs, nothing):
    assert line_dedup.dedup_lines(nothing).count() == 0
    out = line_dedup.dedup_lines(docs).collect()
    assert len(out) == docs.count() and all(r.text is None for r in out if r.doc_id == 62)
    assert all(r.n_chars == len(r.text) for r in out if r.text is not None)
    cut = next(r for r in out if (r.text or "").startswith("head"))
    assert cut.text == "head\nlast" and cut.n_removed == 4


# 5


def test_lm_base_and_model(spark, docs, nothing, monkeypatch):
    for head in (1 << 20, 20):
        monkeypatch.setattr(lm_score, "MOST_HEAD", head)
        rows = lm_score.score_documents(docs).collect()
        counts = collections.Counter()
        for i, t in by_row(docs):
            if zlib.crc32(str(i).encode()) % 10:
                counts.update([*words(t), None])
        n, v = sum(counts.values()), len(counts)
        want = []
        for i, t in by_row(docs):
            tokens = [*words(t), None]
            want.append((i, len(tokens), sum(x in counts for x in tokens), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens)))
        got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows)
        assert [g[:4] for g in got] == [w[:4] for w in sorted(want)]
        assert np.allclose([g[4] for g in got], [w[4] for w in sorted(want)], rtol=1e-9)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) and math.isfinite(r.score) and r.score < 0 for r in rows)
    assert lm_score.score_documents(nothing).count() == 0


def test_lm_beats_the_base_on_held_out_texts(spark):
    rng = random.Random(2)
    two = [[f"{a}{b}" for b in "abcdefghij"] for a in ("ka", "zo")]
    rows = [(i, " ".join(rng.choices(two[i % 2], k=60))) for i in range(300)]
    out = lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > 0.85 * out[1]


def test_lm_probabilities_sum_to_one(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["red", "sea", "Blue", "sky", "one", "two", "xx", "hapax%d" % i], k=30))) for i in range(60)]
    model, counts = lm_score.train(spark.createDataFrame(rows, "doc_id long, text string"))
    some = np.random.default_rng(1)
    for _ in range(50):
        one, two = some.integers(0, lm_score._SIZES[0], 1), some.integers(0, lm_score._SIZES[1], 1)
        z = model.logits(lm_score._features(one, two))[:, 0].astype(float)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        within = np.exp(model.within[some.integers((lm_score.CLASSES + 1) ** 2)].astype(float))
        used = np.unique(model.class_of[:-1])
        assert abs((p[model.class_of[:-1]] * within).sum() - p[used].sum()) < 1e-3
    shares = collections.Counter()
    for r in counts.collect():
        shares[r.tag] += (r.n + lm_score.SMOOTH) / 10 ** model.shares[r.tag]
    assert all(abs(x + lm_score.SMOOTH / 10 ** model.shares[t] - 1) < 1e-9 for t, x in shares.items())


def test_lm_gradient_equals_plain_loops(spark):
    texts_ = [(1, "Red sea red sky"), (2, "sea sky one"), (3, None), (4, "one")]
    df = spark.createDataFrame(texts_, "doc_id long, text string")
    model, _ = lm_score.train(df)
    found = {n: np.zeros(s) for n, s in (("0", (lm_score._SIZES[0], lm_score.CLASSES + 1)), ("1", (lm_score._SIZES[1], lm_score.CLASSES + 1)), ("2", (lm_score._SIZES[2], lm_score.CLASSES + 1)), ("joint", ((lm_score.CLASSES + 1) ** 2, lm_score.TAGS + 1)))}
    for r in lm_score._gradient(df, model, True).collect():
        part = found[r["name"]][r.k : r.k + lm_score._step(found[r["name"]].shape[1])]
        part += np.frombuffer(r.data, np.float32).reshape(part.shape)
    want = {n: np.zeros_like(x) for n, x in found.items()}
    lexicon = lm_score._Lexicon(model.head)
    for _, t in texts_:
        past = [(lm_score.START, lm_score.START)] * 2
        for w in [*(x.encode() for x in words(t)), None]:
            tag, row = (lm_score.END, lm_score.END) if w is None else (lexicon.tags[lexicon[w]], lexicon.rows[lexicon[w]])
            f = [int(x[0]) for x in lm_score._features(np.array([past[-1][1]]), np.array([past[-2][1]]))]
            z = sum(model.weights[i][:, k] for i, k in enumerate(f))
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            for i, k in enumerate(f):
                want[str(i)][k, : lm_score.CLASSES] += (np.arange(lm_score.CLASSES) == model.class_of[tag]) - p
                want[str(i)][k, lm_score.CLASSES] += 1
            want["joint"][model.class_of[past[-1][0]] * (lm_score.CLASSES + 1) + model.class_of[past[-2][0]], tag] += 1
            past.append((tag, row))
    assert all(np.allclose(found[n], want[n], atol=1e-4) for n in want)


def test_lm_trains_until_little_gradient_is_left(spark, monkeypatch):
    rng = random.Random(5)
    some = [f"{a}{b}" for a in "bdfgklmnprstvz" for b in ("ab", "eck", "isch", "o", "ung", "yra")]
    follow = {w: rng.sample(some, 4) for w in some}

    def text():
        out = [rng.choice(some)]
        while len(out) < 80:
            out.append(rng.choice(follow[out[-1]]))
        return " ".join(out)

    df = spark.createDataFrame([(i, text()) for i in range(400)], "doc_id long, text string")
    model, _ = lm_score.train(df)
    monkeypatch.setattr(lm_score, "PENDING", 1_000)
    monkeypatch.setattr(lm_score, "COUNTS", 300)
    left, seen = np.zeros((lm_score._SIZES[0], lm_score.CLASSES + 1)), lm_score._gradient(df.where("crc32(cast(doc_id as string)) % 10 <> 0"), model, True)
    for r in seen.where("name = '0'").collect():
        part = left[r.k : r.k + lm_score._step(lm_score.CLASSES + 1)]
        part += np.frombuffer(r.data, np.float32).reshape(part.shape)
    assert left[:, -1].sum() == sum(zlib.crc32(str(i).encode()) % 10 != 0 for i in range(400)) * 81
    assert np.abs(left[:, :-1]).sum() < 0.08 * left[:, -1].sum()


def test_lm_rounds_go_over_each_context_once(spark, monkeypatch):
    rng = random.Random(9)
    texts_ = [(i, " ".join(rng.choices(["red", "sea", "Blue", "sky", "one"], k=12))) for i in range(80)]
    kept, write = [], lm_score.materialise

    def keep(df, name):
        out = write(df, name)
        if name == "lm-contexts":
            kept.extend(out.where("name = 'codes'").select("k", "data", F.input_file_name().alias("file")).collect())
        return out

    monkeypatch.setattr(lm_score, "materialise", keep)
    model, _ = lm_score.train(spark.createDataFrame(texts_, "doc_id long, text string").repartition(8))
    lexicon, want = lm_score._Lexicon(model.head), collections.Counter()
    for i, t in texts_:
        past = [lm_score.START] * 2
        for w in [*(x.encode() for x in words(t)), None] if zlib.crc32(str(i).encode()) % 10 else []:
            tag, row = (lm_score.END, lm_score.END) if w is None else (lexicon.tags[lexicon[w]], lexicon.rows[lexicon[w]])
            want[(past[-1] * lm_score._SIZES[1] + past[-2]) * lm_score.CLASSES + int(model.class_of[tag])] += 1
            past.append(row)
    found = [(int(c), int(n)) for r in kept for c, n in np.frombuffer(r.data, np.int32).reshape(2, -1).T]
    assert len(found) == len(want) and dict(found) == want
    assert len({(r.k, r.file) for r in kept}) == len({r.k for r in kept})
    monkeypatch.setattr(lm_score, "MOST", 7)
    monkeypatch.setattr(lm_score, "COUNTS", 3)
    codes, n = lm_score._merged([np.array(list(want), np.int32)] * 2, [np.array(list(want.values()))] * 2)
    again = collections.Counter()
    for batch in lm_score._packed(codes, n):
        for data in batch.column(2).to_pylist():
            c, times = np.frombuffer(data, np.int32).reshape(2, -1)
            assert len(c) <= 3 and times.max() <= 7
            again.update(dict(zip(c.tolist(), times.tolist(), strict=True)))
    assert again == {c: 2 * n for c, n in want.items()}


# 6


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    vectors = {i: rng.normal(size=8).tolist() for i in range(900)}
    vectors |= {i: vectors[7] for i in range(300, 420)} | {901: None, 902: [1.0, None] * 4, 903: [float("nan")] * 8, 904: [float("inf")] * 8, 905: [1.0, 2.0], 906: [], 1000: [1e200] * 8}
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors.items()], "vec_id long, embedding array<double>, row string")
    usable = {i: [math.floor(1024 * x) for x in v] for i, v in vectors.items() if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    top, low = (1 << 63) - 1, -(1 << 63)
    want = []
    for q in sorted(i for i in usable if i % 100 == 0):
        s = sorted(((-min(max(sum(a * b for a, b in zip(usable[q], v, strict=False)), low), top), i) for i, v in usable.items() if i != q))[:10]
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    got = sorted(tuple(r) for r in knn_join.top_k(df, F.col("vec_id") % 100 == 0).select("query_id", "rank", "vec_id", "score").collect())
    assert got == want


def test_knn_of_clusters_in_groups_and_slabs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 5)) * 9
    vectors = {i * 10: (centres[i % 6] + rng.normal(size=5) * 0.2).tolist() for i in range(700)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    for name, value in (("GROUP", 5), ("SLAB_BYTES", 4000), ("MOST_SCORES", 200)):
        monkeypatch.setattr(knn_join, name, value)
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in vectors.items()}
    want = []
    for q in sorted(i for i in whole if i % 100 == 0):
        s = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:4]
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    got = sorted(tuple(r) for r in knn_join.top_k(df, F.col("vec_id") % 100 == 0, 4).collect())
    assert got == want


def test_knn_edges(spark):
    ddl = "vec_id long, embedding array<float>"
    assert knn_join.top_k(spark.createDataFrame([], ddl), F.col("vec_id") % 100 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (0, [2.0]), (5, [3.0]), (None, [1.0])], ddl)
    got = sorted(tuple(r) for r in knn_join.top_k(few, F.col("vec_id") % 100 == 0).collect())
    assert [g[0] for g in got] == [0] * 4 and {g[2] for g in got} == {0, 5}


# 7


def test_toxicity_finds_held_out_words(spark):
    rng = random.Random(4)
    plain, bad = [f"word{i}" for i in range(500)], [f"nasty{i}" for i in range(6)]
    rows = []
    for i in range(700):
        w = rng.choices(plain, k=60)
        if i % 3 == 0:
            w[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(w), "en"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    y = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(700)], "doc_id long, quality int, toxic int")
    out = toxicity.score_documents(df, y).where("held_out").collect()
    right = sum(r.predicted == int(r.doc_id % 3 == 0) for r in out)
    assert right >= 0.95 * len(out) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)


def test_toxicity_edges(spark, docs, nothing):
    assert toxicity.score_documents(nothing, labels(spark, docs)).count() == 0
    none = toxicity.score_documents(docs, labels(spark, docs, [])).collect()
    assert len(none) == docs.count() and {r.score for r in none} == {0.0}
    assert all(r.score is not None for r in toxicity.score_documents(docs, labels(spark, docs)).collect())


# 8


def components_brute(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_matches_brute_force(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.component_ids(docs).collect()}
    assert got == components_brute(by_row(docs))


def test_jaccard_on_a_chain_and_a_family(spark):
    rng = random.Random(9)
    base = [f"v{i}" for i in range(80)]
    rows, now = [], base
    for i in range(60):
        now = list(now)
        now[rng.randrange(80)] = f"edit{i}"
        rows.append((i, " ".join(now)))
    for i in range(60, 120):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(80)] = f"mark{i}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.component_ids(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_brute(rows)
    kept = sorted(r.doc_id for r in jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == sorted({c for _, c in got.values()})


def test_jaccard_edges(spark, docs, nothing):
    assert jaccard_join.component_ids(nothing).count() == 0 and jaccard_join.keep_one(nothing).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "q" * 3_000_000 + " tail"), (3, None)], "doc_id long, text string")
    out = jaccard_join.component_ids(odd).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in out if r.doc_id) == [(1, 2, 1), (1, 2, 1), (2, 1, 2), (3, 0, 3)]
    assert jaccard_join.keep_one(odd).count() == 4
    assert jaccard_join.keep_one(docs).columns == docs.columns


def test_word_hashes_do_not_depend_on_segments(monkeypatch):
    import pyarrow as pa

    column = pa.array(["Aa bB  cc", None, "", " x ", "long " * 500, "y" * 900, "Zz\taa\x0bbb"])
    want = {i: h.tolist() for i, h in jaccard_join.shingles(column, jaccard_join._Hasher())}
    monkeypatch.setattr(jaccard_join, "SEGMENT", 64)
    got = {i: h.tolist() for i, h in jaccard_join.shingles(column, jaccard_join._Hasher())}
    assert {i: len(h) for i, h in got.items()} == {i: len(h) for i, h in want.items()}
    assert all(got[i] == want[i] for i in (0, 1, 2, 3, 4, 6))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r.v: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 130)}


def test_keep_one_keeps_the_texts_of_a_shared_id(spark):
    rng = random.Random(9)
    a, b, c, e = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(50)) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, c), (3, e), (4, e), (None, a)]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(1, a), (2, b), (3, c), (3, e), (None, a)]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, want)) and kept.columns == ["doc_id", "text"]


# 9


def test_bpe_equals_tiktoken(spark, docs, nothing):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    with open(path, "rb") as f:
        own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})
    out = bpe.digest_documents(docs, ranks, public_tokenizers.PATTERN).collect()
    want = []
    for i, t in by_row(docs):
        ids = encoding.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, out)) == sorted(want)
    ids = {r.doc_id: r.ids for r in bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN).collect()}
    assert all(ids[i] == encoding.encode_ordinary(t or "") for i, t in by_row(docs))
    assert bpe.digest_documents(nothing, ranks, public_tokenizers.PATTERN).count() == 0


def test_bpe_of_pieces_beyond_one_query():
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(7)
    letters = ["".join(rng.choices("abcdefghijklmnop", k=n)) for n in (20_000, 3_000)]
    signs = [" ".join("".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(rng.randrange(2, 60))) for _ in range(15_000))]
    unbroken = ["a" * 100_000, "".join(rng.choices(["the", "and", "ing", "tion", "re", "ou"], k=30_000)), "=" * 999 + "-" * 70]
    few = ["".join(rng.choices("aeinrst", k=rng.randrange(1, 300))) for _ in range(300)]
    for texts in (letters, signs, unbroken, few):
        for t, sections in zip(texts, bpe.Codec(ranks, public_tokenizers.PATTERN).encode(texts), strict=True):
            ids, decoded = map(b"".join, zip(*sections, strict=True))
            assert np.frombuffer(ids, "<u4").tolist() == encoding.encode_ordinary(t) and decoded == t.encode()


def test_bpe_sections_of_a_long_text(monkeypatch):
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    text = "some   words\n\n and 123 more's  " * 50
    whole = list(next(bpe.Codec(ranks, public_tokenizers.PATTERN).encode([text])))
    monkeypatch.setattr(bpe, "SLICE", 40)
    parts = list(next(bpe.Codec(ranks, public_tokenizers.PATTERN).encode([text])))
    assert b"".join(a for a, _ in parts) == whole[0][0] and b"".join(b for _, b in parts) == text.encode()


# 10

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def spans_brute(t):
    def holds(k, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in s.split(".")), "card": 16 <= len(d) <= 19 and personal_data.luhn(d), "phone": 8 <= len(d) <= 15}[k]

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t) if holds(k, m.group())]


def test_personal_data_base_matches_patterns():
    rng = random.Random(6)
    pieces = ["a.b@c.de", "x@y@z.com", "@q.r", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 123-4567", "+12", "++4 44 55 66 77 ", "12 34", "é", " ", "\n", "-", ".", "0001.002.3.4", "4465758382889437 4465758382889437", "+1  1"]
    for _ in range(3000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(7)))
        assert [(personal_data.KINDS[k], a, b) for k, a, b in personal_data.base_spans(t)] == spans_brute(t), t


def test_personal_data_splits_neighbours(spark, nothing):
    card = "4465758382889437"
    rows = [(i, f"call +1 ({200 + i}) 555-{1000 + i} or pay {card} from 10.0.{i}.7 end") for i in range(60)]
    rows += [(100, f"both {card} {card} here"), (101, "ring +1 (826) 555-4081 190.137.223.204 now"), (102, None), (103, ""), (104, "9" * 4000), (105, "plain 2024 text 12345678")]
    out = {r.doc_id: r for r in personal_data.find_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[100].n_card == 0 and out[100].spans == "card:5:21,card:22:38"
    assert out[101].n_phone == 0 and out[101].spans == "ip:23:38,phone:5:22"
    assert all(out[i].spans == "" for i in (102, 103, 104, 105))
    for i, t in rows:
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans_brute(t or ""))
        assert out[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert personal_data.find_documents(nothing).count() == 0


# pipeline


def test_pipeline_runs_and_rejects(spark, tmp_path, docs):
    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, docs).write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r.n_tokens > 0 for r in out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "mixing", "byte_bpe"]
