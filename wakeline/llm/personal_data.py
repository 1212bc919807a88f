"""Personal data: fixed patterns, and a semi-Markov conditional random field over what they leave.

Base spans come from one pattern a kind (email, ip, card, phone), leftmost and
non-overlapping, a match that fails its kind's check being dropped without a
retry. A greedy match may so swallow two neighbours: two card numbers side by
side, or a phone number before an address.

The field looks at regions, which are runs of digits with the separators that the
patterns allow. A region is cut into atoms (digit runs and single separators);
a segment is up to ``MOST_ATOMS`` atoms with a kind, and whole-span features
score it: number of digits, check digits, separators, brackets, what stands before
and after. Dynamic programming over segments of bounded length picks boundaries
and kinds jointly, in time linear in the region. Weights are learned by maximum
likelihood on base spans as silver labels (a bounded sample, ``MOST_REGIONS``
distinct regions of all texts, by kind and hash) and on pairs of them set side by side, which the
patterns cannot tell apart. Spans it finds are added where they pass their kind's
check and touch no base span; base spans stay.

Defined results: a null text counts as empty and has no spans; without any silver
region nothing is added; repeated rows are scanned alike; a text of any length is
scanned in linear time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, small_batches

KINDS = ("email", "ip", "card", "phone")
MOST_REGIONS = 3000
MOST_ATOMS = 13

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_NUMBER = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_REGION = re.compile(r"[+(]?[0-9](?:[ ().+-]{0,3}+[0-9])*+")
_ATOM = re.compile(r"[0-9]++|.", re.DOTALL)
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _is_card(s: str) -> bool:
    d = _digits(s)
    return 16 <= len(d) <= 19 and luhn(d)


def _is_phone(s: str) -> bool:
    return 8 <= len(_digits(s)) <= 15


def _is_ip(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns, by kind, then start."""
    out = []
    if "@" in text:
        end = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((0, start, m.end()))
                end = m.end()
    if not _DIGIT.search(text):
        return out
    for m in _DOTTED.finditer(text):
        if "." in m.group():
            parts = [(n.start(), n.end(), n.group()) for n in _NUMBER.finditer(text, m.start(), m.end())]
            out += [(1, parts[k][0], parts[k + 3][1]) for k in range(0, len(parts) - 3, 4) if _is_ip([p[2] for p in parts[k : k + 4]])]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if _is_card(m.group())]
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if _is_phone(m.group())]
    return out


def _features(s: str, before: str, after: str) -> list[int]:
    """Whole-span features of a candidate, as numbers of the list below."""
    d = _digits(s)
    seps = sorted({c for c in s if not "0" <= c <= "9"})
    parts = s.split(".")
    dotted = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    checks = (
        True,
        len(d) < 8,
        8 <= len(d) <= 10,
        len(d) == 11,
        12 <= len(d) <= 15,
        len(d) == 16,
        17 <= len(d) <= 19,
        len(d) > 19,
        16 <= len(d) <= 19 and luhn(d),
        16 <= len(d) <= 19 and not luhn(d),
        s[0] == "+",
        s[0] == "(",
        s[0] == "0",
        not "0" <= s[-1] <= "9",
        s[0] in " .-)",
        not seps,
        seps == ["."],
        "." in seps and len(seps) > 1,
        "(" in seps and ")" in seps,
        s.count("(") != s.count(")"),
        s.count("+") > 1,
        "+" in s[1:],
        dotted and _is_ip(parts),
        dotted and not _is_ip(parts),
        before in "0123456789.+-" and before != "",
        after in "0123456789.+-" and after != "",
        before.isalnum(),
        after.isalnum(),
        "  " in s,
    )
    return [i for i, x in enumerate(checks) if x]


N_FEATURES = 29


def _segments(region: str, before: str, after: str) -> tuple[list[int], list[list[tuple[int, list[int]]]]]:
    """Atom boundaries, and for each end the candidate starts with their features."""
    cuts = [0, *[m.end() for m in _ATOM.finditer(region)]]
    ends = []
    for j in range(1, len(cuts)):
        own = []
        for i in range(max(0, j - MOST_ATOMS), j):
            s = region[cuts[i] : cuts[j]]
            if "0" <= s[-1] <= "9" and s[0] in "+(0123456789" and sum(c.isdigit() for c in s) >= 4:
                own.append((i, _features(s, region[cuts[i] - 1] if cuts[i] else before, region[cuts[j]] if cuts[j] < len(region) else after)))
        ends.append(own)
    return cuts, ends


class Field:
    """Weights of (kind, feature); an atom outside any segment scores 0."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def best(self, region: str, before: str, after: str) -> list[tuple[int, int, int]]:
        """(kind, start, end) of the highest-scoring segmentation."""
        cuts, ends = _segments(region, before, after)
        score, back = [0.0], [None]
        for j, own in enumerate(ends, 1):
            top, how = score[j - 1], None
            for i, f in own:
                w = self.weights[:, f].sum(1)
                k = int(w.argmax())
                if score[i] + w[k] > top + 1e-9:
                    top, how = score[i] + w[k], (i, k)
            score.append(top)
            back.append(how)
        out, j = [], len(cuts) - 1
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                out.append((k + 1, cuts[i], cuts[j]))
                j = i
        return out[::-1]

    def gradient(self, region: str, before: str, after: str, gold: list[tuple[int, int, int]]) -> np.ndarray | None:
        """Of the log likelihood, by forward and backward sums over segmentations."""
        cuts, ends = _segments(region, before, after)
        place = {c: i for i, c in enumerate(cuts)}
        wanted = {(place.get(a), place.get(b)): k - 1 for k, a, b in gold}
        n, g = len(cuts), np.zeros_like(self.weights)
        scored = [[(i, f, self.weights[:, f].sum(1)) for i, f in own] for own in ends]
        forward = np.full(n, -np.inf)
        forward[0] = 0
        for j in range(1, n):
            forward[j] = np.logaddexp.reduce([forward[j - 1], *[forward[i] + x for i, _, w in scored[j - 1] for x in w]])
        backward = np.full(n, -np.inf)
        backward[n - 1] = 0
        for j in range(n - 1, 0, -1):
            backward[j - 1] = np.logaddexp(backward[j - 1], backward[j])
            for i, _, w in scored[j - 1]:
                backward[i] = np.logaddexp(backward[i], np.logaddexp.reduce(w) + backward[j])
        found = 0
        for j in range(1, n):
            for i, f, w in scored[j - 1]:
                p = np.exp(forward[i] + w + backward[j] - forward[-1])
                g[:, f] -= p[:, None]
                k = wanted.get((i, j))
                if k is not None:
                    g[k, f] += 1
                    found += 1
        return g if found == len(gold) else None


def silver(text: str) -> Iterator[tuple[str, str, str, list[tuple[int, int, int]]]]:
    """Regions of a text with the base spans inside, for learning."""
    spans = [s for s in base_spans(text) if s[0]]
    for m in _REGION.finditer(text):
        if 8 <= m.end() - m.start() <= 80:
            own = sorted((k, a - m.start(), b - m.start()) for k, a, b in spans if m.start() <= a and b <= m.end())
            if all(x[2] <= y[1] for x, y in zip(sorted(own, key=lambda s: s[1]), sorted(own, key=lambda s: s[1])[1:], strict=False)):
                yield m.group(), text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1], own


def learn(regions: list, epochs: int = 12, seed: int = 5) -> Field:
    """Stochastic gradient ascent; half the rounds' examples are two silver regions joined by a blank."""
    field = Field(np.zeros((len(KINDS) - 1, N_FEATURES)))
    rng = np.random.default_rng(seed)
    whole = [r for r in regions if len(r[3]) == 1 and r[3][0][1] == 0 and r[3][0][2] == len(r[0])]
    rest = [r for r in regions if not r[3] and len(_digits(r[0])) <= 19]
    examples = (whole + rest)[:MOST_REGIONS]
    if not whole:
        return field
    for _ in range(min(len(examples), MOST_REGIONS // 2)):
        x, y = (whole[rng.integers(len(whole))] for _ in range(2))
        cut = len(x[0]) + 1
        examples.append((x[0] + " " + y[0], x[1], y[2], x[3] + [(k, a + cut, b + cut) for k, a, b in y[3]]))
    cache = np.full(field.weights.shape, 1e-2)
    for _ in range(max(epochs, min(200, 2000 // len(examples)))):
        for i in rng.permutation(len(examples))[: 600]:
            g = field.gradient(*examples[i])
            if g is None:
                continue
            g -= 1e-3 * field.weights
            cache += g * g
            field.weights += 0.3 * g / np.sqrt(cache)
    return field


def find(text: str, field: Field) -> tuple[list, list]:
    """Base spans, and base spans with those the field adds; both by kind, then start."""
    base = base_spans(text)
    more = list(base)
    if field.weights.any() and _DIGIT.search(text):
        taken = sorted((a, b) for _, a, b in base)
        starts = np.array([a for a, _ in taken] + [len(text) + 1])
        ends = np.array([b for _, b in taken] + [len(text) + 2])
        for m in _REGION.finditer(text):
            a, b = m.span()
            if b - a < 7 or any(x <= a and b <= y for x, y in taken[max(0, int(np.searchsorted(ends, a)) - 1) : int(np.searchsorted(ends, a)) + 1]):
                continue
            for k, x, y in field.best(m.group(), text[a - 1 : a] if a else "", text[b : b + 1]):
                x, y = x + a, y + a
                s, i = text[x:y], int(np.searchsorted(ends, x, "right"))
                valid = _is_card(s) if k == 2 else _is_phone(s) and s[0] == "+" if k == 3 else s.count(".") == 3 and all(p.isdigit() for p in s.split(".")) and _is_ip(s.split("."))
                if valid and starts[i] >= y:
                    more.append((k, x, y))
    return base, sorted(more)


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _sample(docs: DataFrame) -> list:
    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t, *r) for t in batch.column(0).to_pylist() if t for r in silver(t)]
            own = ([r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], [",".join(f"{k}:{a}:{b}" for k, a, b in r[4]) for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in own], names=["region", "before", "after", "spans"])

    found = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9]{3}"))
    rows = found.mapInArrow(regions, "region string, before string, after string, spans string")
    # Each region once, however many copies; by kind, so that a frequent kind leaves room for the others.
    rows = materialise(rows.distinct().withColumn("kind", F.split_part("spans", F.lit(":"), F.lit(1))), "regions")
    order = [F.xxhash64("region", "before", "after", "spans"), "region", "before", "after", "spans"]
    # TopK: at most MOST_REGIONS rows reach the driver, whatever the input.
    parts = [rows.where(F.col("kind") == k).orderBy(*order).limit(MOST_REGIONS // len(KINDS)).collect() for k in ("", *map(str, range(1, len(KINDS))))]
    kept = [r for part in parts for r in part]
    discard(rows)
    parse = lambda s: [tuple(map(int, x.split(":"))) for x in s.split(",") if x]
    return [(r["region"], r["before"], r["after"], parse(r["spans"])) for r in kept]


def find_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest are of base spans."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(learn(_sample(docs)).weights)
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(shipped.value)
        for batch in batches:
            rows = []
            for t in batch.column(1):
                base, every = find(t.as_py() or "", field)
                rows.append((*[sum(s[0] == k for s in base) for k in range(len(KINDS))], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
            columns = list(zip(*rows, strict=True)) or [[] for _ in schema.names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, schema.types[1:], strict=True)]], schema=schema)

    ddl = ", ".join(["doc_id long", *[f"n_{k} long" for k in KINDS], "base_sha256 string", "spans string"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, ddl)
