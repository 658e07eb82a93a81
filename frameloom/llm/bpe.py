"""Byte-level BPE by recursive queries in an embedded DuckDB of each worker.

A partition's distinct pieces become rows of one token each. A recursive query joins neighbouring rows with
the merge table, contracts the leftmost pair of lowest rank of every piece, and stops when no piece has a pair
left; long pieces have a query of their own. Decoding joins ids with the vocabulary and strings their bytes together in order. Pieces seen before are
looked up, so the work follows the distinct pieces.
"""

from __future__ import annotations

import base64
import hashlib
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from frameloom.llm.common import map_arrow
from frameloom.llm.word_cache import ChunkCache

#: Pieces and rows of one recursive query, and the bytes up to which a piece goes through the plain one. It contracts one pair of
#: each piece a round, so longer pieces go through ENCODE_LONG, which contracts many occurrences of a pair at once where
#: that comes to the same, for as many rounds as make LONG_ROWS rows; then it starts again from what they left.
SLICE, SLICE_ROWS, LONG, LONG_ROWS = 30_000, 8_000_000, 512, 2_000_000

#: A row's place is piece << SHIFT | position.
SHIFT = 12

ENCODE = f"""
WITH RECURSIVE step AS (
    SELECT k, t, 0 AS round FROM seed
    UNION ALL
    SELECT s.k - (s.k > b.spot)::INT, CASE WHEN s.k = b.spot THEN b.merged ELSE s.t END, s.round + 1
    FROM step s JOIN (
        SELECT w, (w << {SHIFT}) | (best & {(1 << SHIFT) - 1}) AS spot, (best >> {SHIFT})::INT AS merged FROM (
            SELECT x.k >> {SHIFT} AS w, min((m.id::BIGINT << {SHIFT}) | (x.k & {(1 << SHIFT) - 1})) AS best
            FROM step x JOIN step y ON x.k + 1 = y.k JOIN merges m ON m.a = x.t AND m.b = y.t
            GROUP BY 1)) b ON (s.k >> {SHIFT}) = b.w
    WHERE s.k <> b.spot + 1)
SELECT w, list(t ORDER BY k) AS ids, string_agg(s, '' ORDER BY k) AS decoded
FROM (SELECT k, k >> {SHIFT} AS w, t, round, max(round) OVER (PARTITION BY k >> {SHIFT}) AS last FROM step)
JOIN vocab ON id = t WHERE round = last GROUP BY w ORDER BY w
"""

#: k is any ascending number. Occurrences of the pair of lowest rank are contracted from the left (of overlapping ones every
#: other) up to the first one whose new token makes a pair of lower rank with a neighbour, as that pair's turn comes next.
ENCODE_LONG = """
WITH RECURSIVE step AS (
    SELECT k, t, 0 AS round, true AS going FROM seed
    UNION ALL
    SELECT k, CASE WHEN pick THEN best ELSE t END, round + 1, best IS NOT NULL FROM (
        SELECT *, coalesce(lag(pick) OVER (ORDER BY k), false) AS gone FROM (
            SELECT *, chosen AND coalesce(sum(early::INT) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS pick FROM (
                SELECT c.k, c.t, c.round, c.best, c.chosen, x.id IS NOT NULL OR y.id IS NOT NULL AS early FROM (
                    SELECT *, CASE WHEN lag(chosen, 2) OVER (ORDER BY k) THEN best ELSE lag(t) OVER (ORDER BY k) END AS before, lead(t, 2) OVER (ORDER BY k) AS behind FROM (
                        SELECT *, hit AND row_number() OVER (PARTITION BY hit, n - hits ORDER BY k) % 2 = 1 AS chosen FROM (
                            SELECT *, sum(hit::INT) OVER (ORDER BY k) AS hits FROM (
                                SELECT k, t, round, n, best, coalesce(id = best, false) AS hit FROM (
                                    SELECT p.*, m.id, min(m.id) OVER () AS best FROM (
                                        SELECT k, t, round, lead(t) OVER (ORDER BY k) AS follows, row_number() OVER (ORDER BY k) AS n FROM step WHERE going AND round < {rounds}) p
                                    LEFT JOIN merges m ON m.a = p.t AND m.b = p.follows))))) c
                LEFT JOIN merges x ON c.chosen AND x.a = c.before AND x.b = c.best AND x.id < c.best
                LEFT JOIN merges y ON c.chosen AND y.a = c.best AND y.b = c.behind AND y.id < c.best)))
    WHERE NOT gone)
SELECT k, t, going FROM (SELECT *, max(round) OVER () AS last FROM step) WHERE round = last ORDER BY k
"""

DECODE = "SELECT w, string_agg(s, '' ORDER BY p) AS decoded FROM ids JOIN vocab USING (id) GROUP BY w ORDER BY w"

_state: dict = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Codec:
    """Vocabulary, merge table and caches of one worker."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        warnings.filterwarnings("ignore", message="Arrow output on a DB-API result")
        self.ranks, self.pattern = load_ranks(path), regex.compile(pattern)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        merges = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        a, b, i = np.array(merges, np.int32).T
        self._table("merges", {"a": a, "b": b, "id": i})
        self._table("vocab", {"id": np.array(list(self.ranks.values()), np.int32), "s": [t.decode("latin-1") for t in self.ranks]})
        self.pieces: dict[str, tuple[bytes, bytes]] = {}
        self.cache = ChunkCache(self._chunks)

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("columns_in", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM columns_in")
        self.db.unregister("columns_in")

    def _query(self, sql: str, name: str, table: pa.Table) -> pa.Table:
        self.db.register(name, table)
        try:
            return self.db.execute(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def merge_long(self, piece: bytes) -> list[int]:
        """The ids of one long piece, by ENCODE_LONG until nothing is left to contract."""
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        while True:
            rounds = max(1, LONG_ROWS // len(ids))
            got = self._query(ENCODE_LONG.format(rounds=rounds), "seed", pa.table({"k": np.arange(len(ids)), "t": ids}))
            ids = got["t"].to_numpy()
            if not got["going"][0].as_py():
                return ids.tolist()

    def _contract(self, pieces: list[bytes]) -> list[tuple[list[int], bytes]]:
        lengths = np.array([len(p) for p in pieces])
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        seed = pa.table({"k": (np.repeat(np.arange(len(pieces)), lengths) << SHIFT) | at, "t": self.of_byte[flat]})
        got = self._query(ENCODE, "seed", seed)
        return [(i, d.encode("latin-1")) for i, d in zip(got["ids"].to_pylist(), got["decoded"].to_pylist(), strict=True)]

    def decode(self, sequences: list[list[int]]) -> list[bytes]:
        """The bytes of each sequence of ids; an empty sequence gives none."""
        lengths = np.array([len(s) for s in sequences], np.int64)
        flat = np.concatenate([np.asarray(s, np.int32) for s in sequences]) if len(sequences) else np.empty(0, np.int32)
        table = pa.table({"w": np.repeat(np.arange(len(sequences)), lengths), "p": np.arange(len(flat)), "id": flat})
        got = self._query(DECODE, "ids", table)
        found = dict(zip(got["w"].to_pylist(), got["decoded"].to_pylist(), strict=True))
        return [found.get(i, "").encode("latin-1") for i in range(len(sequences))]

    def _pieces(self, wanted: set[str]) -> None:
        todo = []
        for piece in wanted:
            raw = piece.encode()
            if (whole := self.ranks.get(raw)) is not None:
                todo.append((piece, [whole]))
            elif len(raw) > LONG:
                todo.append((piece, self.merge_long(raw)))
        for at in range(0, len(todo), SLICE):
            part = todo[at : at + SLICE]
            for (piece, ids), raw in zip(part, self.decode([i for _, i in part]), strict=True):
                self.pieces[piece] = (np.array(ids, "<u4").tobytes(), raw)
        rest = sorted((p for p in wanted if p not in self.pieces), key=len)
        rows = np.cumsum([len(p.encode()) ** 2 for p in rest])  # a round for each contraction, and all rounds' rows are held
        at = 0
        while at < len(rest):
            stop = max(at + 1, min(at + SLICE, int(np.searchsorted(rows, (rows[at - 1] if at else 0) + SLICE_ROWS, "right"))))
            part, at = rest[at:stop], stop
            for piece, (ids, raw) in zip(part, self._contract([p.encode() for p in part]), strict=True):
                self.pieces[piece] = (np.array(ids, "<u4").tobytes(), raw)

    def _chunks(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        if len(self.pieces) > self.cache.limit:
            self.pieces = {}
        split = list(map(self.pattern.findall, chunks))
        self._pieces({p for s in split for p in s}.difference(self.pieces))
        look = self.pieces.__getitem__
        return [look(s[0]) if len(s) == 1 else (b"".join([look(p)[0] for p in s]), b"".join([look(p)[1] for p in s])) for s in split]

    def round_trip(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Of each text its ids, as little-endian unsigned 32-bit integers, and the bytes that they decode to."""
        return [(b"".join([v[0] for v in vs]), b"".join([v[1] for v in vs])) for vs in self.cache.texts(texts)]


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _state:
        _state[path, pattern] = Codec(path, pattern)
    return _state[path, pattern]


def _map(docs: DataFrame, columns: list, schema: str, fields: list, work) -> DataFrame:
    """Rows of docs through work(first column's values, second column's values), some hundred at a time."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                keys, values = (batch.column(i)[at : at + 1000].to_pylist() for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(work(keys, values), fields, strict=True)], names=names)

    names = [f.split(" ")[0] for f in schema.split(", ")]
    return map_arrow(docs.select(*columns), run, schema)


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id_col>, ids: the ids of every whole text, no special tokens; null counts as empty and has no ids.

    Each row stands for itself: ids of rows may repeat or be null, other columns are ignored, an empty table
    gives no rows. Nothing is shuffled; each worker keeps a bounded cache of pieces.
    """
    def work(keys, texts):
        got = codec(path, pattern).round_trip([t or "" for t in texts])
        return [keys, [np.frombuffer(ids, "<u4") for ids, _ in got]]

    out = _map(docs, [docs[id_col].cast("bigint"), docs[text_col].cast("string")], "doc_id bigint, ids array<bigint>", [pa.int64(), pa.list_(pa.int64())], work)
    return out.withColumnRenamed("doc_id", id_col)


def decode_ids(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """<id_col>, decoded: the bytes that each row's ids stand for; null or no ids give no bytes."""
    def work(keys, ids):
        return [keys, codec(path, pattern).decode([i or [] for i in ids])]

    out = _map(encoded, [encoded[id_col].cast("bigint"), encoded[ids_col].cast("array<bigint>")], "doc_id bigint, decoded binary", [pa.int64(), pa.binary()], work)
    return out.withColumnRenamed("doc_id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text: <id_col>, n_tokens, ids_sha256, decoded_sha256; rows as encode_texts has them."""
    def work(keys, texts):
        got = codec(path, pattern).round_trip([t or "" for t in texts])
        return [keys, [len(i) // 4 for i, _ in got], [hashlib.sha256(i).hexdigest() for i, _ in got], [hashlib.sha256(d).hexdigest() for _, d in got]]

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    out = _map(docs, [docs[id_col].cast("bigint"), docs[text_col].cast("string")], schema, [pa.int64(), pa.int64(), pa.string(), pa.string()], work)
    return out.withColumnRenamed("doc_id", id_col)
