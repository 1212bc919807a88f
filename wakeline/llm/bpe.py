"""Byte-level BPE by recursive DuckDB queries, one connection a partition.

A text is cut into pieces by the tokenizer's pattern. The pieces a partition has
not met yet go to DuckDB as rows (piece, position, token); a recursive query
joins neighbouring tokens with the merge table and contracts, in each round,
every piece's leftmost pair of minimum rank, until no piece has a pair left. A
piece that is itself in the vocabulary starts, and ends, as one row. Aggregation
ordered by position gives a piece's ids and its decoded bytes.

Two queries do this. ``SHORT`` keeps the rows of all its rounds, at most ``ROWS`` a
batch, and is the faster one for words. Pieces of more than ``LONG_BYTES`` bytes go
to ``LONG``, which keeps the current state only and contracts in one round what
would be consecutive rounds: the occurrences of the minimum rank from the left, up
to the first that makes a pair of lower rank, which is next then. Its rounds number
the ranks a piece meets rather than its bytes.

The merge table is derived from the ranks alone: every split of a token into two
tokens. The vocabulary (50,000 entries) is read once on the driver and shipped
with the tasks; a worker keeps the ids of at most ``CACHE`` pieces, and takes texts
in slices of ``SLICE`` characters, so memory does not grow with the partition. What
a piece's ids decode to is compared with the piece once, as it is learned, and kept
only where it differs (``odd``); a text decodes to what its pieces decode to.

Defined results: a null text counts as empty and has no tokens (digests are of
no bytes); every row is encoded by itself, so repeated rows repeat; columns other
than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

CACHE = 700_000
SLICE = 2_000_000
#: State rows of a batch, of all its rounds (short pieces) or of its begin (long ones).
ROWS = 2_000_000
LONG_BYTES = 64
LONG_ROWS = 300_000
#: DuckDB's memory; a long piece alone may ask for BYTES_A_ROW a byte.
MEMORY, BYTES_A_ROW = 200_000_000, 600

SHORT = """
with recursive state(round, piece, place, id, after, follows, rank) as (
  select 0, piece, place, id, after, follows, token from start left join merges on pair = id::bigint * 4294967296 + follows
  union all
  select round, piece, place, id, after, follows, case when touched is null then rank else token end from (
    select round, piece, place, id, after, follows, rank, case when changed then id::bigint * 4294967296 + follows end as touched from (
      select s.round + 1 as round, s.piece, s.place, s.rank,
             case when s.place = b.place then b.token else s.id end as id,
             case when s.place = b.place then b.after else s.after end as after,
             case when s.place = b.place then b.follows when s.after = b.place then b.token else s.follows end as follows,
             s.place = b.place or s.after = b.place as changed
      from state s join (
        select best.piece, best.token, best.place, next.place as gone, next.after, next.follows from (
          select piece, (least // 4294967296)::int as token, least % 4294967296 as place, second from (
            select piece, min(rank::bigint * 4294967296 + place) as least, arg_min(after, rank::bigint * 4294967296 + place) as second
            from state where rank is not null group by piece)
        ) best join state next on next.piece = best.piece and next.place = best.second
      ) b on s.piece = b.piece where s.place <> b.gone)
  ) left join merges on pair = touched
)
select s.piece, list_sort(list({'place': s.place, 'id': id, 'hex': hex})) as tokens
from state s join (select piece, max(round) as round from state where place = 0 group by piece) using (piece, round) join vocabulary using (id) group by s.piece
"""

# A token that went into the one before it has id -1.
LONG = """
with recursive state(piece, place, id, before, after, follows, rank) using key (piece, place) as (
  select piece, place, id, place - 1, after, follows, token from start left join merges on pair = id::bigint * 4294967296 + follows
  union
  select piece, place, id, before, after, follows, token from (
    with hit as (
      select s.piece, s.place, s.before, s.after, l.rank as made
      from recurring.state s join (select piece, min(rank) as rank from recurring.state group by piece) l on s.piece = l.piece and s.rank = l.rank
    ), counted as (
      select *, row_number() over w as n, coalesce(lag(after) over w <> place, true) as opens from hit window w as (partition by piece order by place)
    ), chosen as (
      select *, coalesce(lag(after) over w = before, false) as joined, lag(place) over w as prior from (
        select *, n - max(case when opens then n end) over (partition by piece order by place rows unbounded preceding) as nth from counted
      ) where nth % 2 = 0 window w as (partition by piece order by place)
    ), around as (
      select c.piece, c.place, c.after as gone, c.made, joined, case when joined then prior else c.before end as left_place,
             case when joined then c.made else l.id end as left_id, g.after as right_place, g.follows as right_id
      from chosen c join recurring.state g on g.piece = c.piece and g.place = c.after
      left join recurring.state l on l.piece = c.piece and l.place = c.before
    ), done as (
      select *, lead(joined) over w as joins_next from (
        select a.*, coalesce(bool_or(coalesce(x.token < made, false) or coalesce(y.token < made, false)) over (partition by piece order by place rows between unbounded preceding and 1 preceding), false) as late
        from around a left join merges x on x.pair = left_id::bigint * 4294967296 + made left join merges y on y.pair = made::bigint * 4294967296 + right_id
      ) where not late window w as (partition by piece order by place)
    ), change as (
      select piece, place, made as id, left_place as before, right_place as after, case when coalesce(joins_next, false) then made else right_id end as follows from done
      union all select piece, gone, -1, null, null, null from done
      union all select piece, left_place, null, null, null, made from done where not joined and left_place >= 0
      union all select piece, right_place, null, place, null, null from done where right_place >= 0 and not coalesce(joins_next, false)
    ), merged as (
      select s.piece, s.place, coalesce(c.id, s.id) as id, coalesce(c.before, s.before) as before, coalesce(c.after, s.after) as after, coalesce(c.follows, s.follows) as follows
      from recurring.state s join (select piece, place, max(id) as id, max(before) as before, max(after) as after, max(follows) as follows from change group by piece, place) c on s.piece = c.piece and s.place = c.place
    )
    select m.*, token from merged m left join merges on id >= 0 and pair = id::bigint * 4294967296 + follows
  )
)
select piece, list_sort(list({'place': place, 'id': id, 'hex': hex})) as tokens from state join vocabulary using (id) group by piece
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Codec:
    """Encodes and decodes pieces; one per worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}  # ids by piece, little-endian 32-bit
        self.older: dict[str, bytes] = {}  # the generation before; a piece met again moves on
        self.odd: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY}B", "temp_directory": ""})
        pairs, tokens = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs.append(left * 4294967296 + right)
                    tokens.append(rank)
        self._table("merges", {"pair": pa.array(pairs, pa.int64()), "token": pa.array(tokens, pa.int32())})
        self._table("vocabulary", {"id": pa.array(ranks.values(), pa.int32()), "hex": pa.array([t.hex() for t in ranks])})

    def _table(self, name: str, columns: dict[str, pa.Array]) -> None:
        self.db.register("_incoming", pa.table(columns))
        self.db.execute(f"create or replace table {name} as select * from _incoming")
        self.db.unregister("_incoming")

    def learn(self, pieces: Iterable[str]) -> None:
        """Encodes the pieces that are not known yet."""
        if len(self.known) > CACHE // 2:
            self.older, self.known = self.known, {}
        new = set(pieces).difference(self.known)
        again = new.intersection(self.older)
        self.known.update((p, self.older[p]) for p in again)
        new -= again
        long, batch, rows = [], [], 0
        for p in new:
            raw = p.encode()
            if raw in self.ranks:
                n = 1
            elif len(raw) > LONG_BYTES:
                long.append(p)
                continue
            else:
                n = len(raw) * (len(raw) + 1) // 2
            if rows + n > ROWS or len(batch) == 30_000:
                self._contract(batch, SHORT)
                batch, rows = [], 0
            batch.append(p)
            rows += n
        if batch:
            self._contract(batch, SHORT)
        batch, rows = [], 0
        for p in sorted(long, key=len):
            n = len(p.encode())
            if batch and rows + n > LONG_ROWS:
                self._contract(batch, LONG)
                batch, rows = [], 0
            batch.append(p)
            rows += n
        if batch:
            self._contract(batch, LONG)

    def _contract(self, new: list[str], query: str) -> None:
        """Encodes pieces, ``new`` not empty."""
        raws = [p.encode() for p in new]
        whole = np.array([self.ranks.get(r, -1) for r in raws], np.int32)
        sizes = np.array([len(r) for r in raws])
        starts = np.cumsum(sizes) - sizes
        ids = self.single[np.frombuffer(b"".join(raws), np.uint8)]
        ids[starts[whole >= 0]] = whole[whole >= 0]
        sizes_kept = np.where(whole >= 0, 1, sizes)
        piece = np.repeat(np.arange(len(new), dtype=np.int32), sizes_kept)
        place = np.arange(len(piece)) - np.repeat(np.cumsum(sizes_kept) - sizes_kept, sizes_kept)
        ids = ids[np.repeat(starts, sizes_kept) + place]
        last = place == np.repeat(sizes_kept, sizes_kept) - 1
        after, follows = np.where(last, -1, place + 1), np.where(last, -1, np.append(ids[1:], -1)).astype(np.int32)
        memory = max(MEMORY, len(piece) * BYTES_A_ROW) if query is LONG else MEMORY
        if memory > MEMORY:
            self.db.execute(f"set memory_limit = '{memory}B'")
        self.db.register("start", pa.table({"piece": piece, "place": place, "id": ids, "after": after, "follows": follows}))
        self._keep(new, raws, self.db.sql(query))
        self.db.unregister("start")
        if memory > MEMORY:
            self.db.execute(f"set memory_limit = '{MEMORY}B'")

    def _keep(self, new: list[str], raws: list[bytes], finished) -> None:
        """Takes over (piece, tokens) rows, whose tokens are ordered by place."""
        for batch in finished.to_arrow_reader(50_000):
            order, lists = batch.column(0).to_pylist(), batch.column(1)
            tokens, cuts = lists.flatten(), np.diff(lists.offsets.to_numpy()).cumsum()
            ids, hexes = tokens.field("id").to_numpy().astype("<u4").tobytes(), tokens.field("hex")
            a = 0
            for i, b in zip(order, (cuts * 4).tolist(), strict=True):
                self.known[new[i]] = ids[a:b]
                a = b
            own = [raws[i] for i in order]
            ends = np.append(0, pc.utf8_length(hexes).to_numpy().cumsum())[cuts] // 2
            decoded = bytes.fromhex("".join(hexes.to_pylist()))
            if decoded != b"".join(own) or (ends != np.cumsum([len(r) for r in own])).any():
                for i, a, b in zip(order, np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
                    if decoded[a:b] != raws[i]:
                        self.odd[new[i]] = decoded[a:b]

    def sections(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, in lists of bounded length."""
        if len(text) <= SLICE:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while part := list(islice(found, SLICE // 4)):
            yield part

    def encode(self, texts: list[str]) -> Iterator[Iterator[tuple[bytes, bytes]]]:
        """For each text its (ids, decoded) bytes, section by section; ids are little-endian 32-bit."""
        k = 0
        while k < len(texts):
            size, end = len(texts[k]), k + 1
            while end < len(texts) and size + len(texts[end]) <= SLICE:
                size, end = size + len(texts[end]), end + 1
            if end == k + 1:
                yield map(self._join, self.sections(texts[k]))
            else:
                cut = [self.pattern.findall(t) for t in texts[k:end]]
                self.learn(chain.from_iterable(cut))
                for c in cut:
                    yield iter([self._join(c, True)])
            k = end

    def _join(self, pieces: list[str], learned: bool = False) -> tuple[bytes, bytes]:
        if not learned:
            self.learn(pieces)
        ids = b"".join(map(self.known.__getitem__, pieces))
        if self.odd:
            return ids, b"".join([self.odd.get(p) or p.encode() for p in pieces])
        return ids, "".join(pieces).encode()


_codecs: dict[tuple, Codec] = {}


def _codec(ranks: dict[bytes, int], pattern: str, key: tuple) -> Codec:
    """The worker's codec, kept from task to task."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def _each(docs: DataFrame, ranks: dict[bytes, int], pattern: str, make, schema: pa.Schema, ddl: str) -> DataFrame:
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    key = (pattern, len(ranks), hashlib.sha256(b"".join(b"%d %b " % (r, t) for t, r in ranks.items())).hexdigest())

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or _codec(*shipped.value, key)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            columns = list(zip(*map(make, codec.encode(texts)), strict=True)) or [[] for _ in schema.names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema.types[0]), *[pa.array(c, t) for c, t in zip(columns, schema.types[1:], strict=True)]], schema=schema)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(partition, ddl)


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, ids): the token ids of every text."""
    def make(sections):
        return (np.frombuffer(b"".join(ids for ids, _ in sections), "<u4").astype("int32"),)

    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return _each(docs, ranks, pattern, make, schema, "doc_id long, ids array<int>")


def digest_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded again."""

    def make(sections):
        n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
        for ids, decoded in sections:
            n += len(ids) // 4
            ids_hash.update(ids)
            text_hash.update(decoded)
        return n, ids_hash.hexdigest(), text_hash.hexdigest()

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _each(docs, ranks, pattern, make, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
