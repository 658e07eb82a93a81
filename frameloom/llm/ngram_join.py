"""N-gram Jaccard join by a universe-partition pigeonhole.

Texts with the same words are one class. The hash of a shingle puts it in one of m segments of the universe, so a
set falls into subsets, one for each segment. Sets are held against each other by size band, which bounds the
number H of shingles that two of them may differ in; m is chosen for each band by the cost of its signatures.
Every set is indexed by its subsets, and each set allocates its probes so that H differences can't spoil them all:
H + 1 of its subsets, the largest as they are the rarest; a set with fewer subsets is indexed by the one-deletion
neighbourhoods of its subsets too, and probes those of its cheapest ones, which stand one difference each. A set
whose subsets are too few even so is indexed by its prefix. Sets that share a signature which one of them probes
are candidates, and candidates are verified on their words.

Only connections count here, not pairs, so larger groups of candidates are first held against their smallest
member. Groups that this leaves in several components are gone through once more, merged by their smallest member,
in blocks of bounded size: a member is compared with all of another component, and released as it joins one. The
links found there, no more than members, are verified on their words as well.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import bucket_count, connected_components, group_arrow, map_arrow, materialize
from frameloom.sources.shipping import ship

WORDS = 5
#: Similarity of at least TOP / BOTTOM.
TOP, BOTTOM = 80, 100
RATIO = BOTTOM / TOP
#: Groups of candidates up to this size are paired at once; larger ones go by their smallest member first.
SMALL_GROUP = 8
#: Shingles of a large group that one task compares with as many others.
BLOCK_SHINGLES = 1 << 20
#: Signatures that a task holds before it packs them, and words and classes that it remembers.
HELD_SIGNATURES, HELD_WORDS, HELD_KEYS = 1 << 20, 200_000, 200_000
#: Partners of one text that one part verifies.
PARTNERS = 256
#: Input bytes for each bucket of signatures.
BUCKET_BYTES = 10 << 20
SKETCH = 8  # 64-bit words

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_M1, _M2, _BASE, _TAG = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
_33, _32, _40 = np.uint64(33), np.uint64(32), np.uint64(40)
_LOW32, _LOW40 = np.uint64((1 << 32) - 1), np.uint64((1 << 40) - 1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _33)) * _M1
    h = (h ^ (h >> _33)) * _M2
    return h ^ (h >> _33)


def band(size: int) -> int:
    """Sets of similarity 0.8 lie in one band or in neighbouring ones."""
    return int(math.log(size) / math.log(RATIO) + 1e-9)


@lru_cache(maxsize=None)
def plan(space: int) -> tuple[int, int]:
    """H and the number of segments for pairs whose larger set lies in this band; no segments: one-deletion neighbourhood.

    The cost of m segments is m signatures and, for a set that is left with H segments or fewer, those of its
    one-deletion neighbourhoods; m grows until such sets are rare among the smallest that the band admits.
    """
    largest = math.ceil(RATIO ** (space + 1)) - 1 if space else 1
    limit = 2 * largest * (BOTTOM - TOP) // (BOTTOM + TOP)
    if limit <= 1:
        return limit, 0
    smallest = max(1.0, RATIO ** (space - 1))

    def cost(m: int) -> float:
        load = smallest / m
        empty = math.exp(-load)
        spread = math.sqrt(max(1e-9, m * empty * (1 - (1 + load) * empty)))
        short = 0.5 * math.erfc((m * (1 - empty) - limit - 0.5) / spread / math.sqrt(2))
        return m + short * 8 * smallest

    return limit, min(range(limit + 1, 3 * limit + 8), key=cost)


class Shingler:
    """Distinct shingles of word lists, as hashes; word hashes are kept for reuse, up to a bound."""

    def __init__(self):
        self.number: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        if not words:
            return np.empty(0, np.uint64)
        if len(words) < WORDS:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
        number = self.number
        if len(number) > HELD_WORDS:
            number.clear()
        for w in set(words).difference(number):
            number[w] = xxhash.xxh64_intdigest(w)
        w = np.fromiter(map(number.__getitem__, words), np.uint64, len(words))
        n = len(words) - WORDS + 1
        h = w[:n].copy()
        for j in range(1, WORDS):
            h = h * _BASE + w[j : j + n]
        return np.unique(mix(h))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()


def key_of(words: list[bytes]) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(b" ".join(words))


def signatures(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of a set that is not empty, for both spaces that its band takes part in, and which of them it probes."""
    own, n = mix(shingles + _TAG), len(shingles)
    out, probes = [], []

    def put(sig: np.ndarray, probed: np.ndarray | bool) -> None:
        out.append(sig)
        probes.append(np.broadcast_to(probed, len(sig)))

    for space in (band(n), band(n) + 1):
        limit, m = plan(space)
        tag = np.uint64((space + 1) * int(_TAG) % (1 << 64))
        if m == 0:
            total = own.sum(dtype=np.uint64)
            put(mix(np.array([total]) ^ tag), True)
            if n > TOP // (BOTTOM - TOP):
                put(mix(total - own ^ tag), True)
            continue
        segment = ((shingles & _LOW32) * np.uint64(m) >> _32).astype(np.int64)
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, segment, own)
        load = np.bincount(segment, minlength=m)
        used = np.flatnonzero(load)
        place = (np.arange(m, dtype=np.uint64) + np.uint64(1)) * _M2
        whole = mix(sums[used] + place[used] ^ tag)
        spare = len(used) - (limit + 1)
        if spare >= 0:
            probed = np.ones(len(used), bool)
            probed[np.argsort(load[used], kind="stable")[:spare]] = False
            put(whole, probed)
            continue
        divided = np.flatnonzero(load > 1)  # without its only shingle a subset would be empty, as many are
        enough = len(divided) >= -spare
        cheapest = np.zeros(m, bool)
        if enough:
            cheapest[divided[np.argsort(load[divided], kind="stable")[:-spare]]] = True
        else:
            put(mix(np.sort(own)[: n * (BOTTOM - TOP) // BOTTOM + 1] ^ (tag + np.uint64(7))), True)
        put(whole, enough)
        can = load[segment] > 1
        less = (sums + place)[segment] - own
        put(mix(less[can] ^ tag), cheapest[segment[can]])
    return np.concatenate(out), np.concatenate(probes)


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """Parity of the set in SKETCH * 64 bits: two sets' sketches differ in no more bits than the sets do in shingles."""
    bit = (shingles >> _40) % np.uint64(SKETCH * 64)
    odd = np.bincount(bit.astype(np.int64), minlength=SKETCH * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (of the word sequence; null without words), size, sketch, uid of every row."""
    names = ["id", "key", "size", "sketch"]

    def run(batches):
        shingler = Shingler()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                ids, texts = batch.column(0)[at : at + 1000], batch.column(1)[at : at + 1000].to_pylist()
                words = [words_of(t) for t in texts]
                sets = [shingler.hashes(w) for w in words]
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array([key_of(w) if w else None for w in words], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([sketch_of(s) for s in sets], pa.list_(pa.int64()))], names=names)

    source = docs.select(docs[id_col].cast("bigint"), docs[text_col].cast("string").cast("binary"))
    found = map_arrow(source, run, "id bigint, key binary, size bigint, sketch array<bigint>")
    return materialize(found.withColumn("uid", F.conv(F.hex(F.substring("key", 1, 7)), 16, 10).cast("bigint")), "ngram-classes")


def uid_of(key: bytes) -> int:
    return int.from_bytes(key[:7], "big")


def index_blobs(docs: DataFrame, text_col: str, buckets: int) -> DataFrame:
    """bucket, blob: signatures with the uid of their class, packed for each task and bucket; a class once for each task."""
    def run(batches):
        shingler, seen = Shingler(), set()
        held, probed, uids, count = [], [], [], 0

        def flush():
            sig = np.concatenate(held)
            who = np.repeat(np.arange(len(uids), dtype=np.uint16), [len(h) for h in held]) | np.concatenate(probed).astype(np.uint16) << np.uint16(15)
            bucket = ((sig >> _40) % np.uint64(buckets)).astype(np.uint32)
            order = np.argsort(bucket, kind="stable")
            sig, who, cuts = sig[order], who[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
            del bucket, order
            table = np.array(uids, np.int64)
            for b in range(buckets):
                i, j = cuts[b], cuts[b + 1]
                if i < j:
                    named, local = np.unique(who[i:j] & np.uint16(0x7FFF), return_inverse=True)
                    local = local.astype(np.uint16) | who[i:j] & np.uint16(0x8000)
                    s = sig[i:j] & _LOW40
                    head = np.array([j - i, len(named)], np.int64)
                    blob = b"".join((head.tobytes(), table[named].tobytes(), (s & _LOW32).astype(np.uint32).tobytes(), (s >> _32).astype(np.uint8).tobytes(), local.tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                for text in batch.column(0)[at : at + 200].to_pylist():
                    words = words_of(text)
                    if not words or (key := key_of(words)) in seen:
                        continue
                    seen.add(key)
                    sig, probe = signatures(shingler.hashes(words))
                    held.append(sig)
                    probed.append(probe)
                    uids.append(uid_of(key))
                    count += len(sig)
                    if count >= HELD_SIGNATURES or len(uids) == 1 << 15:
                        yield from flush()
                        held, probed, uids, count = [], [], [], 0
                        if len(seen) > HELD_KEYS:
                            seen.clear()
        if uids:
            yield from flush()

    return map_arrow(docs.select(docs[text_col].cast("string").cast("binary")), run, "bucket int, blob binary")


def candidate_pairs(sig: np.ndarray, uid: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows a, b, large: pairs of uids under one signature that one of them probes; of large groups those with the smallest uid."""
    order = np.lexsort((uid, sig))
    sig, uid, probe = sig[order], uid[order], probe[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (uid[1:] != uid[:-1])
    head = np.flatnonzero(new)
    if not len(head):
        return head, head, new
    probe = np.logical_or.reduceat(probe, head)
    sig, uid = sig[head], uid[head]
    start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    size = np.diff(np.append(start, len(sig)))
    size *= np.logical_or.reduceat(probe, start)
    a, b = [], []
    for k in np.unique(size[(size > 1) & (size <= SMALL_GROUP)]):
        at = start[size == k][:, None] + np.arange(k)
        i, j = np.triu_indices(k, 1)
        wanted = (probe[at][:, i] | probe[at][:, j]).ravel()
        a.append(uid[at][:, i].ravel()[wanted])
        b.append(uid[at][:, j].ravel()[wanted])
    paired = sum(map(len, a))
    count = np.maximum(size * (size > SMALL_GROUP) - 1, 0)
    first = np.repeat(start, count)
    a.append(uid[first])
    b.append(uid[first + 1 + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)])
    a, b = np.concatenate(a), np.concatenate(b)
    large = np.arange(len(a)) >= paired
    order = np.lexsort((large, b, a))
    a, b, large = a[order], b[order], large[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (large[1:] != large[:-1])
    return a[new], b[new], large[new]


def _match(table: pa.Table) -> pa.Table:
    sigs, uids, probes = [], [], []
    for blob in table["blob"].to_pylist():
        n, k = np.frombuffer(blob, np.int64, 2)
        at = 16 + 8 * k
        named = np.frombuffer(blob, np.int64, k, 16)
        low = np.frombuffer(blob, np.uint32, n, at).astype(np.uint64)
        high = np.frombuffer(blob, np.uint8, n, at + 4 * n).astype(np.uint64)
        sigs.append(high << _32 | low)
        local = np.frombuffer(blob, np.uint16, n, at + 5 * n)
        uids.append(named[local & np.uint16(0x7FFF)])
        probes.append(local > 0x7FFF)
    a, b, large = candidate_pairs(np.concatenate(sigs), np.concatenate(uids), np.concatenate(probes))
    return pa.table([pa.array(a), pa.array(b), pa.array(large)], names=["a", "b", "large"])


def _links_between(table: pa.Table) -> pa.Table:
    """Of a block of a large group: links that join its components, each member compared with all of other components."""
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    part, n = table["part"].to_numpy(), table["n"].to_numpy()
    sketch = np.array(table["s"].to_pylist(), np.int64).view(np.uint64)  # of a signed number, numpy counts the absolute value's bits
    key = table["key"].to_pylist()
    _, root = np.unique(np.array(table["root"].to_pylist(), object), return_inverse=True)
    blobs = table["shingles"].to_pylist()
    size = np.array([len(x) // 8 for x in blobs])
    begin = np.cumsum(size) - size
    distinct, shingle = np.unique(np.frombuffer(b"".join(blobs), np.uint64), return_inverse=True)
    has = np.zeros(len(distinct), bool)
    columns = np.flatnonzero(part == j)
    a, b = [], []
    for x in np.flatnonzero(part == i).tolist():
        y = columns[columns > x] if i == j else columns
        y = y[root[y] != root[x]]
        y = y[np.minimum(n[x], n[y]) * BOTTOM >= np.maximum(n[x], n[y]) * TOP]
        y = y[np.bitwise_count(sketch[y] ^ sketch[x]).sum(1, dtype=np.int64) * (BOTTOM + TOP) <= (n[y] + n[x]) * (BOTTOM - TOP)]
        if not len(y):
            continue
        mine = shingle[begin[x] : begin[x] + size[x]]
        has[mine] = True
        for low in range(0, len(y), 4096):
            z = y[low : low + 4096]
            z = z[root[z] != root[x]]
            if not len(z):
                continue
            stop = np.cumsum(size[z])
            at = np.repeat(begin[z] - (stop - size[z]), size[z]) + np.arange(stop[-1])
            inter = np.add.reduceat(has[shingle[at]], stop - size[z], dtype=np.int64)
            linked = z[inter * BOTTOM >= (n[x] + n[z] - inter) * TOP]
            _, first = np.unique(root[linked], return_index=True)
            for k in linked[first].tolist():
                a.append(min(key[x], key[k]))
                b.append(max(key[x], key[k]))
            root[np.isin(root, root[linked])] = root[x]
        has[mine] = False
    return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def plausible(pairs: DataFrame) -> DataFrame:
    """Marks the pairs that sizes and sketches allow to be links."""
    differing = sum(F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(SKETCH))
    sizes = F.least("na", "nb") * BOTTOM >= F.greatest("na", "nb") * TOP
    return pairs.withColumn("open", sizes & (differing * (BOTTOM + TOP) <= (F.col("na") + F.col("nb")) * (BOTTOM - TOP)))


def _of_classes(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str, column: str, value) -> DataFrame:
    """key and a value of its words, for each class of wanted (key, rep)."""
    named = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").cast("binary").alias("text"))
    texts = named.join(wanted, named["id"].eqNullSafe(wanted["rep"])).select("key", "text")

    def run(batches):
        make = value()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                keys, words = batch.column(0)[at : at + 200].to_pylist(), [words_of(t) for t in batch.column(1)[at : at + 200].to_pylist()]
                right = [i for i, w in enumerate(words) if w and key_of(w) == keys[i]]  # another row may repeat the id
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[i] for i in right], pa.binary()), pa.array([make(words[i]) for i in right], pa.binary())], names=["key", column])

    return map_arrow(texts, run, f"key binary, {column} binary").groupBy("key").agg(F.min(column).alias(column))


def _squeeze():
    import zstandard

    pack = zstandard.ZstdCompressor(level=3)
    return lambda words: pack.compress(b" ".join(words))


def _shingle_bytes():
    shingler = Shingler()
    return lambda words: shingler.hashes(words).tobytes()


def verify(pairs: DataFrame, docs: DataFrame, reps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """a, b, inter, na, nb of every pair of keys, from the distinct shingles of their words themselves.

    Texts go to the parts of their partners; a text with many partners is split over several parts.
    """
    import zstandard

    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    needed = dealt.select("a", "part", F.lit(1).alias("role"), F.col("b").alias("key")).unionByName(
        dealt.select("a", "part").distinct().select("a", "part", F.lit(0).alias("role"), F.col("a").alias("key")))
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct().join(reps.select("key", "rep"), "key")
    squeezed = _of_classes(wanted, docs, id_col, text_col, "words", _squeeze)
    rows = needed.join(squeezed, "key").repartition("a", "part").sortWithinPartitions("a", "part", "role").select("a", "part", "role", "key", "words")

    def compare(batches):
        unpack = zstandard.ZstdDecompressor()
        mine, name = frozenset(), None
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for a, part, role, key, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = unpack.decompress(packed).split(b" ")
                found = set(zip(*(w[i:] for i in range(WORDS)))) if len(w) >= WORDS else {tuple(w)}
                if role == 0:
                    mine, name = found, (a, part)
                elif name == (a, part):
                    for column, value in zip(out, (a, key, len(mine & found), len(mine), len(found)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["a", "b", "inter", "na", "nb"])

    return materialize(map_arrow(rows, compare, "a binary, b binary, inter bigint, na bigint, nb bigint"), "ngram-verified")


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id_col>, n_shingles, component_id for every row of docs.

    Sets of distinct 5-word shingles (with fewer words: the whole sequence as one) link at a Jaccard similarity
    of 0.8 or more. Null, empty and blank texts have no shingles and link with nothing: component_id is their
    own id. Rows with the same words are always in one component, repeated ids included; a null id is never
    the smallest, unless no id is known. An empty table gives no rows; other columns are ignored.
    """
    buckets = bucket_count(docs, BUCKET_BYTES)
    rows = describe(docs, id_col, text_col)
    classes = materialize(rows.where("key IS NOT NULL").groupBy("key", "uid").agg(
        F.min("id").alias("rep"), F.first("size").alias("n"), F.first("sketch").alias("s")), "ngram-reps")
    found = materialize(group_arrow(index_blobs(docs, text_col, buckets), "bucket", _match, "a bigint, b bigint, large boolean"), "ngram-found")
    pairs = found.select("a", "b").distinct()

    def side(x: str) -> DataFrame:
        return classes.select(F.col("uid").alias(x), F.col("key").alias(f"k{x}"), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}"))

    named = plausible(pairs.join(side("a"), "a").join(side("b"), "b").where("ka <> kb")).where("open")
    named = materialize(named.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).distinct(), "ngram-pairs")
    is_link = F.col("inter") * BOTTOM >= (F.col("na") + F.col("nb") - F.col("inter")) * TOP
    roots = connected_components(verify(named, docs, classes, id_col, text_col).where(is_link).select("a", "b"))

    stars = found.where("large").select(F.col("a").alias("least"), F.col("b").alias("uid"))
    if stars.take(1):
        members = stars.union(stars.select("least", "least")).distinct().join(classes, "uid").join(roots, F.col("key") == F.col("node"), "left")
        members = materialize(members.select("least", "key", "rep", "n", "s", F.coalesce("root", "key").alias("root")), "ngram-members")
        mixed = members.groupBy("least").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum("n").alias("n"))
        mixed = mixed.where("low <> high").select("least", F.ceil(F.col("n") / BLOCK_SHINGLES).cast("int").alias("parts"))
        open_members = materialize(members.join(mixed, "least"), "ngram-open")
        shingles = _of_classes(open_members.select("key", "rep").distinct(), docs, id_col, text_col, "shingles", _shingle_bytes)
        dealt = open_members.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
        dealt = dealt.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"i": F.least("part", "q"), "j": F.greatest("part", "q")})
        dealt = dealt.join(shingles, "key").select("least", "i", "j", "part", "key", "root", "n", "s", "shingles")
        ship(docs.sparkSession)
        more = materialize(dealt.groupBy("least", "i", "j").applyInArrow(_links_between, "a binary, b binary").distinct(), "ngram-more")
        second = verify(more, docs, classes, id_col, text_col).where(is_link).select("a", "b")
        roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(second))

    rooted = classes.join(roots, F.col("key") == F.col("node"), "left").select("key", "rep", F.coalesce("root", "key").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    of_key = rooted.join(smallest, "root").select("key", "component")
    return rows.select("id", "key", F.col("size").alias("n_shingles")).join(of_key, "key", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that cluster gives their own id as component, with all their columns.

    Rows that repeat an id are kept or dropped together.
    """
    name = "__kept_id"
    kept = cluster(docs, id_col, text_col).where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(name)).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept[name]), "left_semi")
