"""Removal of repeated passages by suffix sorting of a whole collection.

Every window of WINDOW bytes has an anchor, the least of the hashed ANCHOR-byte strings inside it; equal
windows have equal anchors, so a passage only has to meet others of the same anchor. A run of windows on one
anchor is a fragment. Anchors seen in one document only are dropped first; fragments on the others, each
distinct one once for a block of documents, go to the bucket of their anchor. There the Burrows-Wheeler
transform of all fragments of the bucket is built column by column: each round takes the next symbol of every
fragment, from the right, finds the place of the longer suffix by counting symbols, and merges the round's
suffixes and their common prefixes into files that are read and written in order. Suffixes with a common prefix
of WINDOW bytes or more are the copies of one window; the smallest document among them keeps it.
"""

from __future__ import annotations

import os
import tempfile
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from frameloom.llm.common import bucket_count, group_arrow, map_arrow, materialize

WINDOW, ANCHOR = 50, 20
SPAN = WINDOW - ANCHOR + 1
#: Bytes of text in a block (a longer document is a block of its own) and in one step of the anchors' computation.
BLOCK_BYTES, STEP_BYTES = 8 << 20, 64 << 10
#: Input bytes for each bucket of anchors.
BUCKET_BYTES = 2 << 20
#: Rows of the external files that are held at once; a slice is to fit a core's own cache. At most 1 << 17.
SLICE_ROWS = 1 << 17

_POS = np.uint64((1 << 24) - 1)
_LOW32 = np.uint64(0xFFFFFFFF)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
NO_ID = np.iinfo(np.int64).max


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[4]
    return h ^ (h >> np.uint64(29))


_BYTE = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD[0])


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ANCHOR = 16 + 4 bytes at each position."""
    h1 = _BYTE.take(data)
    h2 = h1[:-1] * _ODD[0] + h1[1:]
    h4 = h2[:-2] * _ODD[1] + h2[2:]
    h8 = h4[:-4] * _ODD[2] + h4[4:]
    h16 = h8[:-8] * _ODD[3] + h8[8:]
    return _mix(h16[:-4] * _ODD[4] + h4[16:])


_PLACES = np.arange(STEP_BYTES + WINDOW, dtype=np.uint64)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def runs(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows on one anchor, never across documents: document, first window, windows, anchor's hash.

    Documents stand one after the other. Where a step ends inside a run, the run is cut in two.
    """
    out: list[tuple] = []
    last = begin + np.maximum(length - WINDOW + 1, 0)  # behind each document's last window
    for low in range(0, len(data) - WINDOW + 1, STEP_BYTES):
        part = data[low : low + STEP_BYTES + WINDOW - 1]
        hashes = _anchor_hashes(part)
        key = (hashes & ~_POS) | _PLACES[: len(hashes)]
        anchor = _sliding_min(key, SPAN) & _POS
        new = np.empty(len(anchor), bool)
        new[0] = True
        np.not_equal(anchor[1:], anchor[:-1], out=new[1:])
        i, j = np.searchsorted(begin, (low, low + len(anchor)))
        new[begin[i:j] - low] = True
        head = np.flatnonzero(new)
        doc = np.searchsorted(begin, head + low, "right") - 1
        stop = np.minimum(np.append(head[1:], len(anchor)) + low, last[doc])
        good = np.flatnonzero(stop > head + low)
        head, doc = head[good], doc[good]
        out.append((doc, head + low, stop[good] - head - low, hashes[anchor[head].astype(np.int64)]))
    if not out:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# A list of arrays as one binary value.


def packed(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = np.array([len(arrays)] + [a.nbytes for a in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpacked(blob: bytes, *types) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, np.int64, 1 + len(types))[1:]
    at = 8 * (1 + len(types)) + np.cumsum(sizes) - sizes
    return [np.frombuffer(raw[a : a + n], t) for a, n, t in zip(at.tolist(), sizes.tolist(), types, strict=True)]


def _planes(ascending: np.ndarray) -> np.ndarray:
    """Steps of ascending numbers of 32 bits, all their first bytes, then all their second bytes and so on: these compress better."""
    return np.ascontiguousarray(np.diff(ascending, prepend=ascending.dtype.type(0)).astype(np.uint32).view(np.uint8).reshape(-1, 4).T).ravel()


def _from_planes(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint64)


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions of all ranges, one after the other."""
    return np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())


BLOCK_TYPES = (np.int64, np.uint8, np.int64, np.uint8, np.uint8)  # ids, id is null, lengths, bytes, an Arrow stream of what is carried along


def to_blocks(docs: DataFrame, id_col: str, text_col: str, carried: list[str]) -> DataFrame:
    """block, data: whole documents packed in blocks, the columns carried with them as Arrow wrote them, in one written table."""
    def run(batches):
        block, ids, texts, others, size = TaskContext.get().partitionId() << 32, [], [], [], 0

        def flush():
            known = np.array([i is not None for i in ids], np.uint8)
            values = np.array([0 if i is None else i for i in ids], np.int64)
            stream = pa.BufferOutputStream()
            if carried:
                with pa.ipc.new_stream(stream, others[0].schema) as writer:
                    for rows in others:
                        writer.write_batch(rows)
            blob = packed(values, 1 - known, np.array([len(t) for t in texts], np.int64), np.frombuffer(b"".join(texts), np.uint8), np.frombuffer(stream.getvalue(), np.uint8))
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([blob], pa.binary())], names=["block", "data"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                begin = at
                for i, t in zip(*(batch.column(c)[at : at + 200].to_pylist() for c in range(2)), strict=True):
                    ids.append(i)
                    texts.append(t or b"")
                    size += len(texts[-1])
                    at += 1
                    if size >= BLOCK_BYTES:
                        break
                if carried:
                    others.append(pa.RecordBatch.from_arrays([batch.column(2 + c).slice(begin, at - begin) for c in range(len(carried))], names=[f"c{c}" for c in range(len(carried))]))
                    size += others[-1].nbytes
                if size >= BLOCK_BYTES:
                    yield flush()
                    block, ids, texts, others, size = block + 1, [], [], [], 0
        if ids:
            yield flush()

    source = docs.select(docs[id_col].cast("bigint"), docs[text_col].cast("string").cast("binary"), *(docs[c] for c in carried))
    return materialize(map_arrow(source, run, "block bigint, data binary"), "suffix-blocks")


class Block:
    """The documents of a block and their runs."""

    def __init__(self, blob: bytes):
        ids, missing, self.length, self.data, _ = unpacked(blob, *BLOCK_TYPES)
        self.ids, self.missing = ids, missing.astype(bool)
        self.rank = np.where(self.missing, NO_ID, ids)
        self.begin = np.cumsum(self.length) - self.length
        self.doc, self.first, self.windows, self.hash = runs(self.data, self.begin, self.length)

    def address(self, buckets: int) -> np.ndarray:
        """An anchor's bucket, and 32 more bits of its hash: a bucket's size is bounded, so few anchors agree by chance."""
        return (self.hash % np.uint64(buckets)) << np.uint64(32) | self.hash >> np.uint64(32)


def seen_anchors(blocks: DataFrame, buckets: int) -> DataFrame:
    """bucket, block, data: distinct anchors of each block, and whether several of its documents have them."""
    def run(batches):
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = Block(blob)
                where = b.address(buckets)
                order = np.argsort(where)
                where, rank = where[order], b.rank[b.doc[order]]
                start = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(where) else np.empty(0, np.int64)
                if not len(start):
                    continue
                several = np.minimum.reduceat(rank, start) != np.maximum.reduceat(rank, start)
                where = where[start]
                bucket = (where >> np.uint64(32)).astype(np.int64)
                low = (where & _LOW32).astype(np.uint32)
                cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                ends = np.append(cuts[1:], len(bucket))
                blobs = [packed(_planes(low[i:j]), np.packbits(several[i:j])) for i, j in zip(cuts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int32()), pa.array([block] * len(cuts), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "block", "data"])

    return map_arrow(blocks, run, "bucket int, block bigint, data binary")


def _shared_anchors(table: pa.Table) -> pa.Table:
    bucket, blocks, data = table["bucket"][0].as_py(), table["block"].to_pylist(), table["data"].to_pylist()
    keys, flags, sizes = [], [], []
    for blob in data:
        planes, bits = unpacked(blob, np.uint8, np.uint8)
        keys.append(_from_planes(planes))
        flags.append(np.unpackbits(bits, count=len(keys[-1])).astype(bool))
        sizes.append(len(keys[-1]))
    key, flag = np.concatenate(keys), np.concatenate(flags)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    shared = np.zeros(len(key), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    shared |= flag
    out, at = [], 0
    for k, n in zip(keys, sizes, strict=True):
        out.append(k[shared[at : at + n]])
        at += n
    full = [(b, packed(np.array([bucket]), _planes(k))) for b, k in zip(blocks, out, strict=True) if len(k)]
    return pa.table([pa.array([b for b, _ in full], pa.int64()), pa.array([d for _, d in full], pa.binary())], names=["block", "data"])


FRAGMENT_TYPES = (np.int64, np.uint8, np.uint8)  # smallest id of each fragment, its windows, bytes
PLACE_TYPES = (np.int64, np.uint8, np.uint32, np.uint32)  # the first place; steps to each place, bucket, number in block and bucket


def _fragments(buckets: int):
    """Of a block: its distinct fragments on shared anchors by bucket (kind 1), and where they stand (kind 2)."""
    def run(table: pa.Table) -> pa.Table:
        block, kind, data = table["block"][0].as_py(), table["kind"].to_pylist(), table["data"].to_pylist()
        b = Block(next(d for k, d in zip(kind, data, strict=True) if k == 0))
        hits = [unpacked(d, np.int64, np.uint8) for k, d in zip(kind, data, strict=True) if k == 1]
        hits = [np.uint64(k[0]) << np.uint64(32) | _from_planes(low) for k, low in hits]
        rows: list[tuple] = []
        if hits and len(b.hash):
            wanted = np.sort(np.concatenate(hits))
            where = b.address(buckets)
            at = np.minimum(np.searchsorted(wanted, where), len(wanted) - 1)
            use = np.flatnonzero(wanted[at] == where)
            doc, first, windows = b.doc[use], b.first[use], b.windows[use]
            bucket = (where[use] >> np.uint64(32)).astype(np.int64)
            text = b.data.tobytes()
            number: dict[bytes, int] = {}  # equal fragments have equal anchors, so they are in one bucket
            name = np.array([number.setdefault(text[f:e], len(number)) for f, e in zip(first.tolist(), (first + windows + WINDOW - 1).tolist(), strict=True)], np.int64)
            least = np.full(len(number), NO_ID)
            np.minimum.at(least, name, b.rank[doc])
            content = list(number)
            in_bucket = np.empty(len(content), np.int64)
            in_bucket[name] = bucket
            order = np.argsort(in_bucket, kind="stable")
            cuts = np.flatnonzero(np.append(True, in_bucket[order][1:] != in_bucket[order][:-1]))
            ends = np.append(cuts[1:], len(order))
            local = np.empty(len(order), np.int64)
            for i, j in zip(cuts.tolist(), ends.tolist(), strict=True):
                part = order[i:j]
                local[part] = np.arange(j - i)
                strings = [content[x] for x in part.tolist()]
                blob = packed(least[part], np.array([len(s) - WINDOW + 1 for s in strings], np.uint8), np.frombuffer(b"".join(strings), np.uint8))
                rows.append((1, int(in_bucket[part[0]]), block, blob))
            rows.append((2, -1, block, packed(first[:1], _planes(first - first[0]), bucket.astype(np.uint32), local[name].astype(np.uint32))))
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["kind", "bucket", "block", "data"])

    return run


class ExternalRuns:
    """The transform so far, in two files of this task that take turns: the symbol before each suffix, and its common prefix with the last."""

    def __init__(self, folder: str):
        self.folder, self.turn, self.rows = folder, 0, 0

    def _name(self, turn: int) -> str:
        return f"{self.folder}/{turn % 2}"

    def start(self, before: np.ndarray) -> None:
        """Empty suffixes, one of each string, with the symbols before them."""
        self.rows = len(before)
        before.astype(np.uint16).tofile(self._name(self.turn))

    def columns(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and common prefixes, whole."""
        both = np.fromfile(self._name(self.turn), np.uint16, self.rows)
        return both.astype(np.uint8), (both >> np.uint16(8)).astype(np.uint8)

    def merged(self, place: np.ndarray, before: np.ndarray, prefix: np.ndarray, prefix_at: np.ndarray, prefix_there: np.ndarray):
        """One sequential pass that writes as it reads: new suffixes get the places given, then the common prefixes at prefix_at are set.

        Yields each slice of the merged rows: symbols, common prefixes, and the range of new suffixes in it.
        """
        total = self.rows + len(place)
        new = before.astype(np.uint16) | prefix.astype(np.uint16) << np.uint16(8)
        cuts = np.append(np.arange(0, total, SLICE_ROWS), total)
        inside, fixed = np.searchsorted(place, cuts).tolist(), np.searchsorted(prefix_at, cuts).tolist()
        # Written over in place: to cut a file off first makes some file systems wait for the disk when it is closed.
        name = self._name(self.turn + 1)
        with open(self._name(self.turn), "rb") as source, open(name, "r+b" if os.path.exists(name) else "wb") as target:
            for n, low in enumerate(cuts[:-1].tolist()):
                i, j, size = inside[n], inside[n + 1], min(SLICE_ROWS, total - low)
                if i == j:
                    x = np.fromfile(source, np.uint16, size)
                else:
                    x, old = np.empty(size, np.uint16), np.ones(size, bool)
                    at = place[i:j] - low
                    old[at] = False
                    x[old] = np.fromfile(source, np.uint16, size - (j - i))
                    x[at] = new[i:j]
                p, q = fixed[n], fixed[n + 1]
                if p < q:
                    at = prefix_at[p:q] - low
                    x[at] = x[at] & np.uint16(255) | prefix_there[p:q].astype(np.uint16) << np.uint16(8)
                x.tofile(target)
                yield x.astype(np.uint8), (x >> np.uint16(8)).astype(np.uint8), i, j
        self.turn += 1
        self.rows = total


_PLACE_BITS = np.uint32(18)
_PLACE_MASK = np.uint32((1 << 18) - 1)
_ODD_PLACES = np.arange(1 << 17, dtype=np.uint32) << np.uint32(1)
_SYMBOLS = np.arange(257, dtype=np.uint32) << _PLACE_BITS


class Neighbours:
    """Of the new suffixes of a round: how often the symbol before each stands before the suffixes that come earlier,
    and the least common prefix on the way to the last and to the next suffix with that symbol. Slice after slice; between
    slices only one value of each symbol is kept.
    """

    def __init__(self, rows: int):
        self.rank = np.zeros(rows, np.int64)
        self.last, self.next = np.full(rows, -1, np.int64), np.full(rows, -1, np.int64)  # -1: there is none
        self.count = np.zeros(256, np.int64)
        self.since = np.full(256, -1, np.int64)  # least common prefix since the latest suffix with that symbol
        self.waiting = np.full(256, -1, np.int64)  # new suffix whose next hasn't come yet

    def add(self, before: np.ndarray, common: np.ndarray, place: np.ndarray, low: int) -> None:
        """place: where the new suffixes low, low + 1, ... stand in this slice."""
        rows, n = len(before), len(place)
        key = before.astype(np.uint32)
        key <<= _PLACE_BITS
        key |= _ODD_PLACES[:rows]
        key[place] |= np.uint32(1)
        key.sort()  # by symbol and place; the last bit marks the new ones
        bounds = np.searchsorted(key, _SYMBOLS)
        start, stop = bounds[:-1], bounds[1:]
        here = np.flatnonzero(stop > start)

        def place_of(k):
            return (key[k] & _PLACE_MASK) >> np.uint32(1)

        padded = np.empty(rows + 2, np.uint8)
        padded[:rows], padded[rows:] = common, 255
        first, final = place_of(start[here]), place_of(stop[here] - 1)
        line = np.argsort(first)
        reach = np.full(256, -1, np.int64)  # least from the last with a symbol, or from the slice's begin, to the first with it here
        reach[here[line]] = np.minimum.accumulate(np.minimum.reduceat(padded, np.append(0, first[line].astype(np.int64) + 1)))[:-1]
        reach = np.where(self.since < 0, -1, np.minimum(self.since, reach))
        late = self.waiting[here]
        met = late >= 0
        self.next[late[met]] = reach[here[met]]
        self.waiting[here] = -1
        if n:
            mine = np.flatnonzero((key & np.uint32(1)).astype(bool))
            rank_at = np.empty(rows, np.int64)
            rank_at[place_of(mine)] = mine
            k, symbol = rank_at[place], before[place]
            self.rank[low : low + n] = k + (self.count - start)[symbol]
            is_first, is_final = k == start[symbol], k == stop[symbol] - 1
            # Each list from the last to the first, so that reduceat has nothing to do between two ranges.
            ranges = np.empty((2, n, 2), np.int64)
            down = place[::-1]
            ranges[0, :, 0] = np.where(is_first, place, place_of(np.maximum(k - 1, 0)) + np.int64(1))[::-1]
            ranges[0, :, 1] = ranges[1, :, 0] = down + 1
            ranges[1, :, 1] = np.where(is_final, place + 2, place_of(np.minimum(k + 1, rows - 1)) + np.int64(1))[::-1]
            least = np.minimum.reduceat(padded, ranges.ravel())[::2].reshape(2, n)[:, ::-1]
            self.last[low : low + n] = np.where(is_first, reach[symbol], least[0])
            self.next[low : low + n] = np.where(is_final, -1, least[1])
            at_end = np.flatnonzero(is_final)
            self.waiting[symbol[at_end]] = at_end + low
        line = np.argsort(final)
        rest = np.minimum.accumulate(np.minimum.reduceat(padded, final[line].astype(np.int64) + 1)[::-1])[::-1]
        self.since = np.minimum(self.since, int(common.min()))
        self.since[here[line]] = rest
        self.count += stop - start


def sort_collection(text: np.ndarray, length: np.ndarray, folder: str) -> ExternalRuns:
    """Burrows-Wheeler transform and common prefixes of all strings, one symbol of each string a round.

    text: bytes of all strings, one after the other; none is 255. A suffix's place among those that begin with
    symbol c is the number of c before the place of the suffix that follows it, over the symbols before all
    suffixes so far. Its common prefix with the one before is one more than the least common prefix between the
    last two places with c.
    """
    strings, begin = len(length), np.cumsum(length) - length
    symbols = text + np.uint8(1)  # 0 is the end of a string
    ext = ExternalRuns(folder)
    latest = symbols[begin + length - 1]  # symbol before each active string's latest suffix
    ext.start(latest)
    active = np.arange(strings)  # strings with symbols left, by the place of their latest suffix
    at = length.copy()  # start of each string's latest suffix
    total = np.bincount(latest, minlength=256)
    empty = np.empty(0, np.int64)
    found = Neighbours(strings)
    low = 0
    for before, common, _, _ in ext.merged(empty, empty, empty, empty, empty):
        found.add(before, common, np.arange(len(before)), low)
        low += len(before)
    while len(active):
        line = np.argsort(latest, kind="stable")  # by symbol and place, so in the order of the new suffixes
        active, latest, last, following = active[line], latest[line], found.last[line], found.next[line]
        to = strings + (np.cumsum(total) - total)[latest] - total[0] + found.rank[line]
        at[active] -= 1
        start = at[active]
        latest = np.where(start > 0, symbols[begin[active] + np.maximum(start - 1, 0)], 0).astype(np.uint8)
        has_next = following >= 0
        going = np.flatnonzero(latest)
        number = np.cumsum(np.append(0, latest > 0))
        found = Neighbours(len(going))
        low = 0
        for before, common, i, j in ext.merged(to, latest, last + 1, to[has_next] + 1, following[has_next] + 1):
            found.add(before, common, to[going[number[i] : number[j]]] - low, number[i])
            low += len(before)
        total += np.bincount(latest, minlength=256)
        active, latest = active[going], latest[going]
    return ext


def owners_of(before: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """String and start of each suffix: all strings walk the finished transform from their ends to their starts."""
    order = np.argsort(before, kind="stable")
    step = np.empty(len(order), np.int64)
    step[order] = np.arange(len(order))  # as many ends as strings, so a symbol's rank is its suffix's place
    owner, start = np.empty(len(order), np.int32), np.empty(len(order), np.uint8)
    place, string, at = np.arange(len(length)), np.arange(len(length)), length.copy()
    while len(place):
        owner[place], start[place] = string, at
        going = at > 0
        place, string, at = step[place[going]], string[going], at[going] - 1
    return owner, start


def window_owners(text: np.ndarray, windows: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each window of each fragment, in order, the smallest rank among all fragments that hold it."""
    with tempfile.TemporaryDirectory(prefix="frameloom-bwt-") as folder:
        length = windows.astype(np.int64) + WINDOW - 1
        ext = sort_collection(text, length, folder)
        before, common = ext.columns()
    owner, start = owners_of(before, length)
    start = start.astype(np.int64)
    group = np.flatnonzero(common < WINDOW)
    least = np.minimum.reduceat(rank[owner], group)
    least = np.repeat(least, np.diff(np.append(group, len(common))))
    whole = start < windows[owner]
    base = np.cumsum(windows.astype(np.int64)) - windows
    out = np.empty(int(windows.sum(dtype=np.int64)), np.int64)
    out[base[owner[whole]] + start[whole]] = least[whole]
    return out


REPLY_TYPES = (np.int64, np.int64, np.uint8, np.uint8, np.int64)  # bucket; number, offset, windows, smallest id of each stretch


def _settle(table: pa.Table) -> pa.Table:
    """Of a bucket: for each block the stretches of its fragments' windows that have one smallest id."""
    bucket, blocks = table["bucket"][0].as_py(), table["block"].to_pylist()
    number: dict[bytes, int] = {}
    asked, least = [], []
    for blob in table["data"].to_pylist():
        ids, windows, raw = unpacked(blob, *FRAGMENT_TYPES)
        raw, at = raw.tobytes(), 0
        names = []
        for n, i in zip((windows.astype(np.int64) + WINDOW - 1).tolist(), ids.tolist(), strict=True):
            k = number.setdefault(raw[at : at + n], len(number))
            if k == len(least):
                least.append(i)
            elif i < least[k]:
                least[k] = i
            names.append(k)
            at += n
        asked.append(np.array(names, np.int64))
    windows = np.array([len(s) - WINDOW + 1 for s in number], np.int64)
    owners = window_owners(np.frombuffer(b"".join(number), np.uint8), windows, np.array(least, np.int64))
    fragment = np.repeat(np.arange(len(windows)), windows)
    new = np.append(True, (owners[1:] != owners[:-1]) | (fragment[1:] != fragment[:-1]))
    head = np.flatnonzero(new)
    offset = head - (np.cumsum(windows) - windows)[fragment[head]]
    size = np.diff(np.append(head, len(owners)))
    of = np.searchsorted(fragment[head], np.arange(len(windows) + 1))
    blobs = []
    for names in asked:
        count = of[names + 1] - of[names]
        rows = _ranges(of[names], count)
        blobs.append(packed(np.array([bucket]), np.repeat(np.arange(len(names)), count), offset[rows].astype(np.uint8), size[rows].astype(np.uint8), owners[head[rows]]))
    return pa.table([pa.array(blocks, pa.int64()), pa.array(blobs, pa.binary())], names=["block", "data"])


def _cut(table: pa.Table, as_text: bool = False) -> pa.Table:
    """Of a block: each document's removed runs, as starts and lengths, its bytes without them, and what is carried along.

    as_text: only the text that is left, less characters that are broken at a cut, and what is carried along.
    """
    kind, data = table["kind"].to_pylist(), table["data"].to_pylist()
    ids, missing, length, text, others = unpacked(next(d for k, d in zip(kind, data, strict=True) if k == 0), *BLOCK_TYPES)
    missing = missing.astype(bool)
    rank, begin = np.where(missing, NO_ID, ids), np.cumsum(length) - length
    spans = [(np.empty(0, np.int64),) * 3]
    places = [unpacked(d, *PLACE_TYPES) for k, d in zip(kind, data, strict=True) if k == 2]
    if places:
        origin, steps, bucket, local = places[0]
        first = _from_planes(steps).astype(np.int64) + origin[0]
        order = np.lexsort((local, bucket))
        first, bucket, local = first[order], bucket[order], local[order]
        doc = np.searchsorted(begin, first, "right") - 1
        for blob in (d for k, d in zip(kind, data, strict=True) if k == 3):
            name, num, off, size, owner = unpacked(blob, *REPLY_TYPES)
            low, high = np.searchsorted(bucket, (name[0], name[0] + 1))
            lo, hi = np.searchsorted(num, local[low:high], "left"), np.searchsorted(num, local[low:high], "right")
            rows = _ranges(lo, hi - lo)
            d, f = np.repeat(doc[low:high], hi - lo), np.repeat(first[low:high], hi - lo)
            hit = owner[rows] < rank[d]
            s = f[hit] + off[rows][hit]
            spans.append((d[hit], s, s + size[rows][hit].astype(np.int64) - 1 + WINDOW))
    doc, starts, stops = (np.concatenate(x) for x in zip(*spans, strict=True))
    order = np.argsort(starts)
    doc, starts, stops = doc[order], starts[order], np.maximum.accumulate(stops[order])  # documents stand one after the other, so this reaches into no other one
    new = np.ones(len(doc), bool)
    new[1:] = (starts[1:] > stops[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    doc, starts, stops = doc[head], starts[head], stops[np.append(head[1:], len(new)) - 1] if len(new) else stops
    cuts = np.searchsorted(doc, np.arange(len(length) + 1))
    raw, kept = text.tobytes(), []
    for i, j, at, n in zip(cuts[:-1].tolist(), cuts[1:].tolist(), begin.tolist(), length.tolist(), strict=True):
        if i == j:
            kept.append(raw[at : at + n])
        else:
            edges = [at, *np.stack([starts[i:j], stops[i:j]], 1).ravel().tolist(), at + n]
            kept.append(b"".join([raw[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)]))
    lists = lambda x: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, pa.int64()))
    carried = pa.ipc.open_stream(others.tobytes()).read_all().combine_chunks() if len(others) else None
    if as_text:
        texts = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
        return pa.table([pa.array(ids, pa.int64(), mask=missing), texts, *(carried.columns if carried else ())], names=["id", "text", *(carried.column_names if carried else ())])
    return pa.table([
        pa.array(ids, pa.int64(), mask=missing), pa.array(length, pa.int64()), lists(starts - begin[doc]), lists(stops - starts), pa.array(kept, pa.binary()),
        *(carried.columns if carried else ()),
    ], names=["id", "n_bytes", "starts", "lengths", "kept", *(carried.column_names if carried else ())])


def _found(docs: DataFrame, id_col: str, text_col: str, carried: list[str], as_text: bool = False) -> DataFrame:
    """id, n_bytes, starts, lengths, kept (as_text: id, text) of every row, and the columns carried along as c0, c1, ..."""
    buckets = bucket_count(docs, BUCKET_BYTES)
    blocks = to_blocks(docs, id_col, text_col, carried)
    as_kind = lambda df, k: df.select(F.lit(k).alias("kind"), "block", "data")
    hits = group_arrow(seen_anchors(blocks, buckets), "bucket", _shared_anchors, "block bigint, data binary")
    parts = materialize(group_arrow(
        as_kind(blocks, 0).unionByName(as_kind(hits, 1)), "block", _fragments(buckets), "kind int, bucket int, block bigint, data binary"), "suffix-fragments")
    settled = group_arrow(parts.where("kind = 1").select("bucket", "block", "data"), "bucket", _settle, "block bigint, data binary")
    together = as_kind(blocks, 0).unionByName(as_kind(parts.where("kind = 2"), 2)).unionByName(as_kind(settled, 3))
    schema = StructType.fromDDL("id bigint, text string" if as_text else "id bigint, n_bytes bigint, starts array<bigint>, lengths array<bigint>, kept binary")
    for n, c in enumerate(carried):
        schema = schema.add(f"c{n}", docs.schema[c].dataType)
    return group_arrow(together, "block", partial(_cut, as_text=as_text), schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id_col>, n_bytes, starts, lengths, kept for every row of docs.

    starts and lengths are the maximal runs of removed bytes, kept the bytes that are left. Removed is each byte
    covered by a WINDOW-byte string that also starts in a document with a smaller id, judged on the input; matches
    never cross documents. Null text is empty. Ids may repeat (such rows leave each other alone) or be null (a
    null id is larger than any other). An empty table gives no rows; other columns are ignored. Bytes are those of
    the text in UTF-8, and a cut may fall inside a character.
    """
    return _found(docs, id_col, text_col, []).withColumnRenamed("id", id_col)


def digest(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    total = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return removed.select(
        id_col, "n_bytes", total.alias("n_removed"), F.size("lengths").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """Every row of docs with its text less what remove_repeats removes; broken characters at a cut go too.

    chars_col, where docs has it, becomes the length of what is left.
    """
    carried = [c for c in docs.columns if c not in (id_col, text_col)]

    found = _found(docs, id_col, text_col, carried, as_text=True)
    columns = []
    for f in docs.schema.fields:
        if f.name == id_col:
            columns.append(F.col("id").cast(f.dataType).alias(id_col))
        elif f.name == text_col:
            columns.append(F.col("text").alias(text_col))
        elif f.name == chars_col:
            columns.append(F.char_length("text").cast(f.dataType).alias(chars_col))
        else:
            columns.append(F.col(f"c{carried.index(f.name)}").alias(f.name))
    return found.select(*columns)
