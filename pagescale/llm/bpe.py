"""Byte-level BPE: encoding and decoding with recursive DuckDB queries inside the partitions.

Spark cuts the texts into pieces (the tokenizer's pattern, run by the JVM's regular
expressions with Unicode classes). Each task hands the pieces its cache does not know to one recursive query:
token-position rows join the merge table, each piece contracts its leftmost pair of
minimum rank, and the recursion ends when no pair of any piece is in the table. Decoding
joins token rows with the vocabulary and concatenates the bytes in an ordered aggregation.

Memory: batches of texts are bounded in bytes; pieces go to a query in slices bounded by the rows that all their rounds can make, tokens in slices of
``SLICE`` that also cut inside a row, the cache of a worker holds at most 2 * ``CACHE`` pieces beside those of the row at
hand (two generations; what is used moves to the young one). Long pieces (over ``LONG`` bytes) run in a keyed recursion that
keeps one row per position instead of all rounds and contracts all pairs of a rank at once; its memory grows with the
longest piece alone.
Nothing is shuffled. The vocabulary file (under 1 MB) goes to the tasks as a Spark broadcast; the
tasks never open its path.

Defined cases: a null or empty text has no tokens and decodes to no bytes; null or repeated
ids are kept as they are; an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescale.session import small_batches

CACHE = 150_000  # pieces in a generation of a worker's cache
ROUNDS = 1_000_000  # rows that all rounds of a recursive query can make, some 50 bytes each
BYTES = 100_000  # bytes of long pieces in a recursive query, unless one piece alone has more
SLICE = 200_000  # pieces or tokens handled at a time
LONG = 64
MEMORY = 250  # MB a query may use; a long piece adds ``ROW`` bytes for each of its own
ROW = 600

# A row is a token: piece w, start p, rank r, next start q, next token's rank nr. The key of a
# pair packs (merged rank, p, q), so its minimum is the leftmost pair of minimum rank.
CONTRACT = """
with recursive t(i, w, p, r, q, nr) as (
  select 0, w, p, r, p + 1, lead(r) over (partition by w order by p) from start
  union all
  (with best as (select w, min(m.o * 1099511627776 + p * 1048576 + q) k from t join merges m on m.pair = t.r * 1048576 + t.nr group by w),
    cut as (select b.w, (k // 1048576) % 1048576 p, k % 1048576 q, k // 1099511627776 o, x.q xq, x.nr xnr from best b join t x on x.w = b.w and x.p = b.k % 1048576)
   select t.i + 1, t.w, t.p, if(t.p = c.p, c.o, t.r), if(t.p = c.p, c.xq, t.q), if(t.p = c.p, c.xnr, if(t.q = c.p, c.o, t.nr))
   from t join cut c on t.w = c.w where t.p <> c.q))
select w, list(r order by p) ids from t where (w, i) in (select w, max(i) from t group by w) group by w"""

# The same for long pieces, without packed keys: rows are replaced by (w, p). A round contracts the pairs of its
# piece's minimum rank from the left, of overlapping ones every second, up to the first whose new token makes a pair of
# lower rank with a neighbour: what contracting them one by one gives. Beside the pairs only their left neighbours and the
# swallowed tokens (r = -1) change.
CONTRACT_LONG = """
with recursive t(w, p, r, q, nr, o) using key (w, p) as (
  select s.w, s.p, s.r, s.p + 1, s.nr, m.o
  from (select *, lead(r) over (partition by w order by p) nr from start) s left join merges m on m.pair = s.r * 1048576 + s.nr
  union
  (with best as (select w, min(o) o from recurring.t group by w having min(o) is not null),
    hit as (select x.w, x.p, x.q, x.o, row_number() over own n, lag(x.q) over own is distinct from x.p head
            from recurring.t x join best b on b.w = x.w and b.o = x.o window own as (partition by x.w order by x.p)),
    run as (select *, n - max(if(head, n, 0)) over (partition by w order by p) k from hit),
    pick as (select c.w, c.p, c.q, c.o, c.n, x.q xq, x.nr xnr, y.p lp, y.r lr
             from run c join recurring.t x on x.w = c.w and x.p = c.q left join recurring.t y on y.w = c.w and y.q = c.p where c.k % 2 = 0),
    side as (select *, coalesce(lag(xq) over (partition by w order by p) = p, false) joined from pick),
    made as (select w, n, o, unnest([if(joined, o, lr) * 1048576 + o, o * 1048576 + xnr]) pair from side),
    stop as (select a.w, min(a.n) n from made a join merges m on m.pair = a.pair where m.o < a.o group by a.w),
    cut as (select s.* from side s left join stop e on e.w = s.w where e.n is null or s.n <= e.n),
    changed as (
      select w, p, o r, xq q, if(coalesce(lead(p) over (partition by w order by p) = xq, false), o, xnr) nr from cut
      union all select w, q, -1, -1, null from cut
      union all select w, lp, lr, p, o from cut where lp is not null and not joined)
   select n.w, n.p, n.r, n.q, n.nr, m.o from changed n left join merges m on m.pair = n.r * 1048576 + n.nr))
select w, list(r order by p) ids from t where r >= 0 group by w"""

DECODE = "select d, unhex(string_agg(h, '' order by p)) b from tokens join vocab using (id) group by d"


def load_ranks(file: str) -> bytes:
    """The vocabulary file's content (lines of base64 token and rank)."""
    return Path(file).read_bytes()


class Codec:
    """One worker's DuckDB connection with the merge table, the vocabulary and the piece cache."""

    def __init__(self, content: bytes):
        import duckdb

        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in content.splitlines() if x)}
        if max(self.ranks.values()) >= 2**20:
            raise ValueError("ranks of 2^20 and more do not fit the packed keys")
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY}MB", "temp_directory": ""})
        get = self.ranks.get
        splits = [(a, b, r) for t, r in self.ranks.items() for i in range(1, len(t)) if (a := get(t[:i])) is not None and (b := get(t[i:])) is not None]
        a, b, o = (np.array(x, np.int64) for x in zip(*splits, strict=True)) if splits else [np.zeros(0, np.int64)] * 3
        self._put("m", pair=a * 2**20 + b, o=o)
        self.con.execute("create table merges as select * from m")
        voc = pa.table({"id": pa.array(list(self.ranks.values()), pa.int64()), "b": pa.array(list(self.ranks), pa.binary())})
        self.con.register("v", voc)
        self.con.execute("create table vocab as select id, hex(b) h from v")
        self.byte = np.array([get(bytes([i]), -1) for i in range(256)], np.int64)
        self.young: dict[bytes, bytes] = {}  # ids as 32-bit integers
        self.old: dict[bytes, bytes] = {}

    def _put(self, name: str, **cols) -> None:
        self.con.register(name, pa.table(cols))

    def _contract(self, pieces: list[bytes], sql: str) -> None:
        sizes = np.array([len(b) for b in pieces])
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self._put("start", w=np.repeat(np.arange(len(pieces)), sizes), p=place, r=self.byte[flat])
        self.con.execute(f"set memory_limit = '{MEMORY + len(flat) * ROW // 10**6}MB'")
        got = self.con.sql(sql).to_arrow_table().combine_chunks()
        ids = got["ids"].chunk(0) if got.num_rows else pa.array([], pa.list_(pa.int64()))
        flat, ends = ids.flatten().to_numpy().astype(np.int32), np.cumsum(ids.value_lengths().to_numpy())
        for w, part in zip(got["w"].to_pylist(), np.split(flat, ends[:-1]), strict=True):
            self.young[pieces[w]] = part.tobytes()

    def learn(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids of each piece, as the bytes of 32-bit integers."""
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        young, old, ranks = self.young, self.old, self.ranks
        new = []
        for b in pieces:
            if b not in young:
                if (ids := old.get(b)) is not None:
                    young[b] = ids
                elif (rank := ranks.get(b)) is not None:
                    young[b] = np.int32(rank).tobytes()
                else:
                    new.append(b)
        short, long = [b for b in new if len(b) <= LONG], sorted((b for b in new if len(b) > LONG), key=len)
        for part in _parts(short, [len(b) * (len(b) + 1) // 2 for b in short], ROUNDS):
            self._contract(part, CONTRACT)
        for part in _parts(long, [len(b) for b in long], BYTES):
            self._contract(part, CONTRACT_LONG)
        return [young[b] for b in pieces]

    def encode(self, lists: pa.ListArray) -> pa.ListArray:
        """Ids of each row's pieces."""
        coded = lists.flatten().dictionary_encode()
        parts = self.learn([s.encode("utf-8", "surrogatepass") for s in coded.dictionary.to_pylist()])
        size = np.array([len(x) // 4 for x in parts] + [0])
        flat = np.frombuffer(b"".join(parts), np.int32)
        first = np.cumsum(size) - size
        codes = coded.indices.to_numpy().astype(np.int64)
        own = size[codes]
        ends = np.cumsum(own)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[codes] - (ends - own), own)]
        rows = np.cumsum(np.r_[0, lists.value_lengths().to_numpy()])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends][rows], pa.int32()), pa.array(ids, pa.int32()))

    def decode(self, lists: pa.ListArray) -> list[bytes]:
        sizes = lists.value_lengths().fill_null(0).to_numpy()
        rows, ids = np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy().astype(np.int64)
        out = [[] for _ in range(len(lists))]
        for lo in range(0, len(ids), SLICE):
            part = slice(lo, lo + SLICE)
            self._put("tokens", d=rows[part], p=np.arange(len(ids[part])), id=ids[part])
            for d, b in self.con.execute(DECODE).fetchall():
                out[d].append(b)
        return [b"".join(x) for x in out]


_CODECS: dict[str, Codec] = {}


def codec(content: bytes) -> Codec:
    """The worker's codec for this vocabulary, made once."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(content)
    return _CODECS[key]


def _parts(items: list, costs: list[int], bound: int):
    """Runs of items that cost at most ``bound`` together, or one item that alone costs more."""
    part, cost = [], 0
    for x, c in zip(items, costs, strict=True):
        if part and cost + c > bound:
            yield part
            part, cost = [], 0
        part.append(x)
        cost += c
    if part:
        yield part


def _slices(sizes: np.ndarray):
    """Runs of rows that hold about SLICE items."""
    part = np.cumsum(sizes) // SLICE
    cuts = np.flatnonzero(np.diff(part)) + 1
    return zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(sizes)].tolist(), strict=True) if len(sizes) else ()


def _pieces(docs: DataFrame, pattern: str, id_col: str, text_col: str) -> DataFrame:
    cut = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"(?U){pattern}"), F.lit(0))
    return small_batches(docs).select(F.col(id_col).alias("id"), cut.alias("pieces"))


def _packed(ids: pa.ListArray) -> list[bytes]:
    """Each row's ids as little-endian unsigned 32-bit integers."""
    sizes = ids.value_lengths().to_numpy()
    flat, ends = ids.flatten().to_numpy().astype("<u4"), np.cumsum(sizes)
    return [flat[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def encode(docs: DataFrame, file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every whole text, without special tokens."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_ranks(file))

    def run(batches):
        own = codec(vocabulary.value)
        for b in batches:
            for lo, hi in _slices(b.column(1).value_lengths().to_numpy()):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), own.encode(b.column(1).slice(lo, hi - lo))], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _pieces(docs, pattern, id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>")


def decode(tokens: DataFrame, file: str) -> DataFrame:
    """(id, decoded): the bytes of (id, ids)."""
    vocabulary = tokens.sparkSession.sparkContext.broadcast(load_ranks(file))

    def run(batches):
        own = codec(vocabulary.value)
        for b in batches:
            for lo, hi in _slices(b.column(1).value_lengths().fill_null(0).to_numpy()):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(own.decode(b.column(1).slice(lo, hi - lo)), pa.binary())], ["id", "decoded"])

    kind = tokens.schema["id"].dataType.simpleString()
    return tokens.select("id", "ids").mapInArrow(run, f"id {kind}, decoded binary")


def round_trip(docs: DataFrame, file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded): ``encode`` and ``decode`` in one worker; tokens do
    not travel between the two. ``with_ids`` adds ``ids``, little-endian unsigned 32-bit integers."""
    names = ["id", "n_tokens", "ids_sha256", "decoded"] + ["ids"] * with_ids
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_ranks(file))

    def run(batches):
        own = codec(vocabulary.value)
        for b in batches:
            for lo, hi in _slices(b.column(1).value_lengths().to_numpy()):
                ids = own.encode(b.column(1).slice(lo, hi - lo))
                packed = _packed(ids)
                cols = [b.column(0).slice(lo, hi - lo), ids.value_lengths().cast(pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()), pa.array(own.decode(ids), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(packed, pa.binary())] * with_ids, names)

    kind = docs.schema[id_col].dataType.simpleString()
    return _pieces(docs, pattern, id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded binary" + ", ids binary" * with_ids)
