"""Cost-balanced packing of token sequences.

A piece of n tokens costs n + n * n / scale: the part of a layer that is linear in the tokens plus attention
inside the piece. Pieces are taken in descending length, each to the sequence of lowest cost that has room for
it; a piece for which none has room is cut over the sequences with most room. The sequences of a block hold
exactly its tokens: full ones, and for what is left over one of each power of two it is made of, which need no
padding either.
"""

from __future__ import annotations

import os
import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from frameloom.llm.common import map_arrow
from frameloom.llm.word_cache import ChunkCache

CAPACITY = 2048
#: Tokens at which attention costs as much as the linear part.
SCALE = 1024.0
#: A block is packed when it holds so many tokens or documents; a longer document makes a block of its own.
BLOCK_TOKENS, BLOCK_DOCS = 4_000_000, 20_000
#: A blank as the tokenizers library writes it in its vocabulary, and how many chunks are encoded strung together.
BLANK, STRUNG = "\u0120", 500

_state: dict = {}

OUT = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class ChunkEncoder:
    """The ids of each chunk, as little-endian unsigned 32-bit integers.

    Chunks of a blank and then no other, with no white space at their end or after that blank, are encoded strung
    together: no piece reaches across such a blank, and of their tokens only the first of each chunk begins with one.
    """

    def __init__(self, tok):
        self.tok = tok
        vocab = tok.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[i for t, i in tok.get_vocab(with_added_tokens=False).items() if t.startswith(BLANK)]] = True

    def single(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False)]

    def strung(self, chunks: list[str]) -> list[bytes]:
        ids = np.array(self.tok.encode_batch_fast(["".join(chunks)], add_special_tokens=False)[0].ids, "<u4")
        begin = np.flatnonzero(self.begins[ids])
        if len(begin) != len(chunks) or begin[0]:  # a tokenizer with other rules
            return self.single(chunks)
        raw, at = ids.tobytes(), [*(4 * begin).tolist(), 4 * len(ids)]
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def __call__(self, chunks: list[str]) -> list[bytes]:
        plain = [len(c) > 1 and c[0] == " " and c.rfind(" ") == 0 and not c[1].isspace() and not c[-1].isspace() for c in chunks]
        together, alone = list(compress(chunks, plain)), [c for c, p in zip(chunks, plain, strict=True) if not p]
        strung = (x for at in range(0, len(together), STRUNG) for x in self.strung(together[at : at + STRUNG]))
        single = iter(self.single(alone))
        return [next(strung if p else single) for p in plain]


def tokenizer_cache(path: str) -> ChunkCache:
    """The tokenizers library's ids as little-endian unsigned 32-bit integers, one cache for each worker."""
    if path not in _state:
        os.environ["RAYON_NUM_THREADS"] = "1"
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        _state[path] = ChunkCache(ChunkEncoder(tok))
    return _state[path]


def assign(lengths: np.ndarray, capacity: int = CAPACITY, scale: float = SCALE) -> list[tuple[int, int, int, int]]:
    """Pieces (item, start, length, sequence) for items of the given lengths, each below capacity or equal.

    Ties go to the earlier item and the earlier sequence. Every token is placed; sequences are exactly filled.
    """
    total = int(lengths.sum())
    left = total % capacity
    room = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if left >> b & 1]
    room = np.array(room, np.int64)
    cost = np.zeros(len(room))
    pieces = []

    def put(item: int, start: int, n: int, seq: int) -> None:
        pieces.append((item, start, n, seq))
        room[seq] -= n
        cost[seq] += n + n * n / scale if room[seq] else np.inf

    for item in np.argsort(-lengths, kind="stable"):
        n, start = int(lengths[item]), 0
        fits = np.flatnonzero(room >= n)
        if len(fits):
            put(int(item), 0, n, int(fits[np.argmin(cost[fits])]))
            continue
        while n:
            seq = int(np.argmax(room))
            part = min(n, int(room[seq]))
            put(int(item), start, part, seq)
            start, n = start + part, n - part
    return pieces


def pack_block(docs: list[tuple[int | None, bytes]], first_sequence: int, capacity: int = CAPACITY) -> tuple[pa.RecordBatch, int]:
    """docs: id and little-endian unsigned 32-bit token ids. Returns the pieces and the next free sequence number."""
    ids = [np.frombuffer(b, "<u4") for _, b in docs]
    rows: list[tuple] = []
    seq = first_sequence
    tails, owner, begin = [], [], []
    for i, x in enumerate(ids):
        full = len(x) // capacity * capacity
        for start in range(0, full, capacity):
            rows.append((i, start, capacity, seq))
            seq += 1
        if len(x) > full:
            tails.append(len(x) - full)
            owner.append(i)
            begin.append(full)
    placed = assign(np.array(tails, np.int64), capacity)
    rows += [(owner[t], begin[t] + start, n, seq + s) for t, start, n, s in placed]
    seq += 1 + max((s for *_, s in placed), default=-1)
    fill: dict[int, int] = {}
    cols: list[list] = [[] for _ in OUT]
    for i, start, n, s in rows:
        at = fill.get(s, 0)
        fill[s] = at + n
        values = (docs[i][0], start, n, zlib.crc32(ids[i][start : start + n].tobytes()), len(ids[i]), s, at)
        for c, v in zip(cols, values, strict=True):
            c.append(v)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, OUT, strict=True)], schema=OUT), seq


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents packed into sequences: <id_col>, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its whole text (null: empty) and then end_id, so an empty text is one token.
    Ids may repeat or be null; each row is a document of its own. An empty table gives no rows. Each
    partition packs its rows in blocks of bounded size, without a shuffle; sequence_id is the partition's
    number in the upper bits and a count in the lower 32.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        cache = tokenizer_cache(tokenizer_path)
        seq = TaskContext.get().partitionId() << 32
        block, size = [], 0
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(keys), 500):
                part = [t or "" for t in texts[at : at + 500].to_pylist()]
                for key, got in zip(keys[at : at + 500], cache.texts(part), strict=True):
                    got = b"".join(got)
                    block.append((key, got + end))
                    size += len(got) // 4 + 1
                    if size >= BLOCK_TOKENS or len(block) >= BLOCK_DOCS:
                        out, seq = pack_block(block, seq, capacity)
                        block, size = [], 0
                        yield out
        if block:
            yield pack_block(block, seq, capacity)[0]

    out = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    packed = map_arrow(docs.select(docs[id_col].cast("bigint"), docs[text_col].cast("string")), run, out)
    return packed.withColumnRenamed("doc_id", id_col)
