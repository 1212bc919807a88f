"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's vector is the sum of three hashed embeddings: two of the word, so that
two words are alike only where both hashes collide, and one of its first four
letters. Filters of widths 1 to 3 slide over the whole text. Each filter's maximum
(at least 0) is pooled by sections of ``REGION`` words; the largest section and
the mean of the sections go to a logistic layer, whose score is rescaled on rows
kept back for calibration. Training is in numpy with
Adagrad on the driver, from a bounded sample of labelled rows (``MOST_ROWS`` of
each class, texts of up to ``MOST_WORDS`` words; by hash of doc_id); word hashes
are made on the executors, so texts do not travel. Scoring covers every text as a
whole, in sections that overlap by the longest width less one, and takes only the
text. Thresholds by language are calibrated on the same kept-back rows; they
decide the extra column ``flagged`` and never enter a score.

Defined results: null and empty texts have no windows and get the score of an
empty pool; a document labelled more than once is toxic if any label says so;
labels that are null or not 0/1 and labels of unknown documents are ignored;
without rows of both classes every score is the share of toxic rows (0 without
any); repeated rows are scored alike; a null doc_id is scored, and held out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MOST_ROWS = 4000
MOST_WORDS = 50_000
#: Slots of fewer training texts keep a zero vector.
LEAST_TEXTS = 3
SLOTS = 1 << 16
SIZE = 8
FILTERS = 16
WIDTHS = (1, 2, 3)
REGION = 32
SECTION = 6400 * REGION
CACHED_WORDS = 500_000
_WORD = re.compile(r"[^\W_]+")


class _Words(dict):
    """The slots of a word, packed."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > CACHED_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word.encode())
        start = xxhash.xxh3_64_intdigest(b"start " + word[:4].encode())
        self[word] = found = (h & (SLOTS - 1)) | ((h >> 32) & (SLOTS - 1)) << 16 | (start & (SLOTS - 1)) << 32
        return found


def hashed(text: str | None, words: _Words) -> np.ndarray:
    return np.array([words[w] for w in _WORD.findall((text or "").lower())], np.int64)


@dataclass
class Net:
    """The weights; ``scale`` and ``shift`` calibrate the logit."""

    tables: list[np.ndarray]
    filters: list[np.ndarray]  # (width, size, filters)
    offsets: list[np.ndarray]
    out: np.ndarray
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    constant: float | None = None
    thresholds: dict = field(default_factory=dict)

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        return sum(t[(ids >> 16 * k) & (SLOTS - 1)] for k, t in enumerate(self.tables))

    def responses(self, x: np.ndarray, k: int) -> np.ndarray:
        """Filter responses at every start of ``x``; the last ones look past its end and are not valid."""
        w = self.filters[k]
        out = x @ w[0] + self.offsets[k]
        for j in range(1, len(w)):
            out[:-j] += x[j:] @ w[j]
        return out

    def pooled(self, ids: np.ndarray) -> np.ndarray:
        best, total, n_regions = np.zeros(FILTERS * len(WIDTHS), np.float32), np.zeros(FILTERS * len(WIDTHS)), 0
        for a in range(0, len(ids), SECTION):
            part = ids[a : a + SECTION + WIDTHS[-1] - 1]
            own = min(SECTION, len(ids) - a)
            n_regions += -(-own // REGION)
            u, back = np.unique(part, return_inverse=True)
            x = self.vectors(u)
            for k, w in enumerate(WIDTHS):
                n = min(own, len(part) - w + 1)
                if n > 0:
                    r = (x @ self.filters[k][0])[back[:n]]
                    for j in range(1, w):
                        r += (x @ self.filters[k][j])[back[j : j + n]]
                    top = np.maximum(np.maximum.reduceat(r, np.arange(0, n, REGION)) + self.offsets[k], 0)
                    cut = slice(k * FILTERS, (k + 1) * FILTERS)
                    np.maximum(best[cut], top.max(0), out=best[cut])
                    total[cut] += top.sum(0)
        return np.concatenate([best, total / max(1, n_regions)])

    def logit(self, ids: np.ndarray) -> float:
        return float(self.pooled(ids) @ self.out + self.bias)

    def score(self, ids: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.scale * self.logit(ids) + self.shift, -60, 60))))


def _log_odds(docs: list[np.ndarray], toxic: np.ndarray, shift: int, pull: float = 20.0) -> tuple[np.ndarray, np.ndarray]:
    """Where training starts: each slot's smoothed log odds of standing in a toxic text, halved; and its number of texts."""
    counts = np.zeros((2, SLOTS))
    for ids, y in zip(docs, toxic, strict=True):
        counts[int(y), np.unique((ids >> shift) & (SLOTS - 1))] += 1
    share = float(toxic.mean())
    odds = (counts[1] + pull * share) / (counts[0] + pull * (1 - share)) * (1 - share) / share
    return (0.5 * np.log(odds)).astype(np.float32), counts.sum(0)


def _argmax(r: np.ndarray, regions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Row of each region's largest value, by column; regions are padded to REGION rows."""
    at = np.minimum(regions[:, None] + np.arange(REGION), (regions + lengths - 1)[:, None])
    return regions[:, None] + np.minimum(r[at].argmax(1), (lengths - 1)[:, None])


def train(docs: list[np.ndarray], toxic: np.ndarray, epochs: int = 3, steps: int = 150, batch: int = 32, rate: float = 0.02, table_rate: float = 0.1, seed: int = 7) -> Net:
    """Adagrad over logistic loss; max pooling sends each filter's gradient to one window a text."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, by=0.1: (rng.standard_normal(shape) * by).astype(np.float32)
    net = Net([draw(SLOTS, SIZE, by=0.02) for _ in range(3)], [draw(w, SIZE, FILTERS, by=0.3) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], draw(2 * FILTERS * len(WIDTHS), by=0.3))
    common = []
    for k, table in enumerate(net.tables):
        table[:, 0], seen = _log_odds(docs, toxic, 16 * k)
        common.append(seen >= LEAST_TEXTS)
        table[~common[k]] = 0
    net.filters[0][:, 0, 0], net.out[0] = 1, 1
    caches = {id(a): np.full(a.shape, 1e-3, np.float32) for a in (*net.tables, *net.filters, *net.offsets, net.out)}
    bias_cache = 1e-3

    def descend(a: np.ndarray, g: np.ndarray) -> None:
        c = caches[id(a)]
        c += g * g
        a -= rate * g / np.sqrt(c)

    def descend_rows(k: int, rows: np.ndarray, g: np.ndarray) -> None:
        a, live = net.tables[k], common[k][rows]
        if not live.any():
            return
        rows, g = rows[live], g[live]
        order = np.argsort(rows, kind="stable")
        u, starts = np.unique(rows[order], return_index=True)
        total = np.add.reduceat(g[order], starts) + 1e-3 * a[u]
        c = caches[id(a)]
        c[u] += total * total
        a[u] -= table_rate * total / np.sqrt(c[u])

    batch = max(4, min(batch, len(docs) // 10))
    rounds = max(epochs, -(-steps * batch // max(1, len(docs))))
    for _ in range(rounds):
        order = rng.permutation(len(docs))
        for b in range(0, len(order), batch):
            chosen = [docs[i] for i in order[b : b + batch] if len(docs[i]) >= WIDTHS[-1]]
            y = np.array([toxic[i] for i in order[b : b + batch] if len(docs[i]) >= WIDTHS[-1]], np.float32)
            if not chosen:
                continue
            ids = np.concatenate(chosen)
            sizes = np.array([len(c) for c in chosen])
            starts, ends = np.cumsum(sizes) - sizes, np.cumsum(sizes)
            x = net.vectors(ids)
            count = -(-sizes // REGION)
            text_of = np.repeat(np.arange(len(chosen)), count)
            firsts = np.cumsum(count) - count
            regions = np.repeat(starts, count) + (np.arange(count.sum()) - np.repeat(firsts, count)) * REGION
            lengths = np.diff(np.append(regions, len(ids)))
            largest, means, tops, where = [], [], [], []
            for k, w in enumerate(WIDTHS):
                r = net.responses(x, k)
                for j in range(1, w):
                    r[ends - j] = -np.inf
                top = np.maximum.reduceat(r, regions)
                at = _argmax(r, regions, lengths)
                top = np.maximum(top, 0)
                largest.append(np.maximum.reduceat(top, firsts))
                means.append(np.add.reduceat(top, firsts) / count[:, None])
                tops.append(top)
                where.append(at)
            pooled = np.concatenate(largest + means, 1)
            p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.bias, -30, 30)))
            d = (p - y) / len(chosen)
            back = d[:, None] * net.out
            places, grads = [], []
            for k, w in enumerate(WIDTHS):
                top, at, f = tops[k], where[k], net.filters[k]
                to_max, to_mean = back[:, k * FILTERS : (k + 1) * FILTERS], back[:, (k + len(WIDTHS)) * FILTERS : (k + len(WIDTHS) + 1) * FILTERS]
                g = (to_mean / count[:, None])[text_of] + to_max[text_of] * (top == largest[k][text_of])
                g = g * (top > 0)
                g[np.abs(g) < 1e-7] = 0
                rows, cols = np.nonzero(g)
                start, amount = at[rows, cols], g[rows, cols].astype(np.float32)
                step = np.zeros_like(f)
                by_filter = np.argsort(cols, kind="stable")
                u, cuts = np.unique(cols[by_filter], return_index=True)
                for j in range(w):
                    if len(u):
                        step[j][:, u] = np.add.reduceat((x[start + j] * amount[:, None])[by_filter], cuts).T
                    places.append(start + j)
                    grads.append(amount[:, None] * f[j].T[cols])
                descend(f, step + 1e-4 * f)
                descend(net.offsets[k], g.sum(0).astype(np.float32))
            descend(net.out, (pooled.T @ d + 1e-4 * net.out).astype(np.float32))
            bias_cache += float(d.sum()) ** 2
            net.bias -= rate * float(d.sum()) / bias_cache**0.5
            places, grads = ids[np.concatenate(places)], np.concatenate(grads)
            for k in range(len(net.tables)):
                descend_rows(k, (places >> 16 * k) & (SLOTS - 1), grads)
    return net


def calibrate(net: Net, logits: np.ndarray, toxic: np.ndarray, langs: list) -> None:
    """Platt scaling (with a weak pull towards the raw logit), then each language's threshold of most F1."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
        g = np.array([((p - toxic) * logits).sum() + (a - 1), (p - toxic).sum() + 0.01 * b])
        s = p * (1 - p)
        h = np.array([[(s * logits * logits).sum() + 1, (s * logits).sum()], [(s * logits).sum(), s.sum() + 0.01]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    net.scale, net.shift = max(float(a), 0.05), float(b)
    p = 1 / (1 + np.exp(-np.clip(net.scale * logits + net.shift, -30, 30)))
    for lang in {x for x in langs if x is not None}:
        own = np.array([x == lang for x in langs])
        if toxic[own].sum() < 5 or (1 - toxic[own]).sum() < 5:
            continue
        cuts = np.unique(np.concatenate([[0.5], p[own]]))
        f1 = [2 * (toxic[own] * (p[own] >= c)).sum() / max(1, (p[own] >= c).sum() + toxic[own].sum()) for c in cuts]
        best = max(f1)
        good = [c for c, f in zip(cuts, f1, strict=True) if f >= best - 1e-12]
        net.thresholds[lang] = float(min(good, key=lambda c: abs(c - 0.5)))


def _hashed_sample(docs: DataFrame, labels: DataFrame) -> tuple[list, list]:
    """Rows (ids, toxic, lang) to train on and to calibrate on; both bounded."""
    y = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic")).where("_id is not null and _toxic in (0, 1) and crc32(cast(_id as string)) % 5 <> 0")
    y = y.groupBy("_id").agg(F.max("_toxic").cast("int").alias("_toxic")).withColumn("_fold", F.crc32(F.col("_id").cast("string")) % 5 == 1)
    y = y.withColumn("_by", F.xxhash64("_id"))
    parts = [y.where(f"{'' if fold else 'not '}_fold and _toxic = {t}").orderBy("_by", "_id").limit(MOST_ROWS if not fold else MOST_ROWS // 2) for fold in (False, True) for t in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    # At most 6 * MOST_ROWS ids, a proven bound.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), lang.alias("lang")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            ids = [hashed(t.as_py(), words) for t in batch.column(1)]
            keep = pa.array([len(i) <= MOST_WORDS for i in ids], pa.bool_())
            slots = pa.array([i.tobytes() for i in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), slots, batch.column(2), batch.column(3), batch.column(4)], names=["doc_id", "ids", "lang", "toxic", "fold"]).filter(keep)

    table = rows.select("doc_id", "text", "lang", "_toxic", "_fold").mapInArrow(hash_texts, "doc_id long, ids binary, lang string, toxic int, fold boolean").toArrow()
    table = table.sort_by([("doc_id", "ascending")])
    out: tuple[list, list] = ([], [])
    for ids, lang_, toxic, fold in zip(*[table.column(c) for c in ("ids", "lang", "toxic", "fold")], strict=True):
        out[fold.as_py()].append((np.frombuffer(ids.as_py(), np.int64), toxic.as_py(), lang_.as_py()))
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Net:
    rows, kept = _hashed_sample(docs, labels)
    toxic = np.array([r[1] for r in rows], np.float32)
    if not rows or toxic.min() == toxic.max():
        net = Net([], [], [], np.zeros(1, np.float32))
        net.constant = float(toxic.mean()) if rows else 0.0
        return net
    net = train([r[0] for r in rows], toxic)
    calibrate(net, np.array([net.logit(r[0]) for r in kept]), np.array([r[1] for r in kept], float), [r[2] for r in kept])
    return net


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, threshold, flagged) for every row of ``docs``."""
    small_batches(docs.sparkSession)
    net = fit(docs, labels)
    shipped = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own = _Words(), shipped.value
        for batch in batches:
            scores = pa.array([own.score(hashed(t.as_py(), words)) for t in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), scores], names=["doc_id", "lang", "score"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    scored = docs.select("doc_id", F.col("text").cast("string").alias("text"), lang.alias("lang")).mapInArrow(score, "doc_id long, lang string, score double")
    threshold = F.lit(0.5)
    for name, cut in sorted(net.thresholds.items()):
        threshold = F.when(F.col("lang") == name, F.lit(cut)).otherwise(threshold)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), threshold.alias("threshold"), (F.col("score") >= threshold).alias("flagged"))
