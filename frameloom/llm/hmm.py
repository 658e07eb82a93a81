"""Language-model scoring with a hidden Markov model.

States emit word classes (a hash of the word, CLASSES of them), and a class emits its words by their counts in
all training texts. The first parameters are those of a mixture of documents, each of one state; from there the
transition and class probabilities are trained by Baum-Welch. Both go over all training documents in every pass:
a task hands on the expected counts of its own, whose sum over all tasks gives the next parameters. A text's score is the exact likelihood by the scaled forward recursion, times the probability
of its words within their classes. The word counts stay distributed: each block of documents asks for the
counts of its own vocabulary, and gets them back.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.common import group_arrow, map_arrow, materialize, shuffles_go

STATES = 8
#: Word classes; the parameters of the model are STATES x CLASSES numbers whatever the corpus holds.
CLASSES = 1 << 15
#: Passes over all training documents: of the mixture that the first parameters come from, and of Baum-Welch.
MIXTURE_PASSES, FULL_PASSES = 12, 2
#: Spread of the mixture's first class shares around the corpus's, as a standard deviation of their logarithm.
SPREAD = 0.3
#: Tokens of a block of documents, and of a group that one forward-backward takes.
BLOCK_TOKENS, GROUP_TOKENS = 4_000_000, 1_000_000
#: Tokens whose numbers stay in a processor's cache.
CACHED = 1 << 17
#: Weight, in tokens, of the overall class shares in each state's.
PRIOR = 500.0

#: The end of a text among the words; no word holds a blank. It has the number 0 and the class 0.
END = b" "
#: Classes of a row that a pass hands on.
PART_CLASSES = 256


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each of the texts (binary, null: empty) has, and the words of all in a row, A-Z lower-cased.

    Arrow's ASCII functions look at bytes only, so it does no harm where the bytes are no valid UTF-8.
    """
    texts = pc.ascii_lower(pc.ascii_trim_whitespace(texts.fill_null(b"").cast(pa.string(), safe=False)))
    split = pc.ascii_split_whitespace(texts)
    words, n = split.flatten(), split.value_lengths().to_numpy()
    if (empty := pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)).any():  # split into one empty word
        words, n = words.filter(pc.greater(pc.binary_length(words), 0)), np.where(empty, 0, n)
    return n.astype(np.int64), words


def binaries(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value for each stretch of flat up to the next of ends."""
    offsets = np.concatenate([[0], ends]) * flat.itemsize
    if offsets[-1] >= 1 << 31:
        raise ValueError(f"{offsets[-1]} bytes are too many for a column of binaries")
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # CLASSES x STATES

    @staticmethod
    def from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        share = (emit.sum(1) + 0.5) / (emit.sum() + 0.5 * len(emit))
        return Model(
            (start + 1) / (start.sum() + len(start)),
            (move + 1) / (move.sum(1, keepdims=True) + len(start)),
            (emit + PRIOR * share[:, None]) / (emit.sum(0) + PRIOR),
        )


class Trellis:
    """Sequences, longest first, laid out time by time: of each time, the rows of the sequences still running."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences])
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        self.running = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right") if len(lengths) else np.empty(0, int)
        self.at = np.concatenate([[0], np.cumsum(self.running)])
        doc = np.repeat(np.arange(len(lengths)), lengths)
        time = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        place = self.at[time] + doc
        self.seen = np.empty(len(doc), np.int64)
        self.seen[place] = np.concatenate([sequences[i] for i in self.order])

    def steps(self, way: int = 1):
        """Of each time its first place and how many it has, from the last time back where way is -1."""
        at, running = self.at[:-1][::way], self.running[::way]
        for i in range(0, len(at), CACHED):  # a list of all would be larger than the rest, for one long sequence
            yield from zip(at[i : i + CACHED].tolist(), running[i : i + CACHED].tolist(), strict=True)

    def log10(self, m: Model) -> np.ndarray:
        """log10 likelihood of each sequence, in the order given. Emissions are looked up for GROUP_TOKENS places at a time."""
        k, most, held = len(m.start), self.running[0] if len(self.running) else 0, 0
        total, ones = np.zeros(len(self.order)), np.ones((k, k))
        alpha, row, scale = (np.empty((most, k)) for _ in range(3))  # scale: the same in all columns
        for a, n in self.steps():
            if a + n > held:
                low, held = a, max(a + n, min(self.at[-1], a + GROUP_TOKENS))
                emit = m.emit.take(self.seen[low:held], axis=0)
            now, whole = row[:n], scale[:n]
            if a:
                np.dot(alpha[:n], m.move, out=now)
            else:
                now[:] = m.start
            now *= emit[a - low : a - low + n]
            np.dot(now, ones, out=whole)
            np.divide(now, whole, out=alpha[:n])
            total[:n] += np.log10(whole[:, 0])
        out = np.zeros(len(self.order))
        out[self.order] = total
        return out

    def expected(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, moves and emissions (CLASSES x STATES).

        Both recursions only do what depends on the step before. For all places at once: a move is a place's
        predecessor's forward share times what lies ahead, and a state's weight its predicted share times that.
        """
        k, most = len(m.start), self.running[0] if len(self.running) else 0
        if not most:
            return np.zeros(k), np.zeros((k, k)), np.zeros((CLASSES, k))
        move, ones = m.move.astype(np.float32), np.ones((k, k), np.float32)
        ahead = m.emit.astype(np.float32).take(self.seen, axis=0)  # emissions, then with their scales, then with all that follows
        alpha, row, scale = np.empty_like(ahead), np.empty((most, k), np.float32), np.empty((most, k), np.float32)
        row[:] = m.start
        for a, n in self.steps():
            if a:
                np.dot(alpha[before : before + n], move, out=row[:n])
            now, whole, emit = row[:n], scale[:n], ahead[a : a + n]
            now *= emit
            np.dot(now, ones, out=whole)
            np.divide(now, whole, out=alpha[a : a + n])
            emit /= whole
            before = a
        back, turned, later = np.ones((most, k), np.float32), np.ascontiguousarray(move.T), 0
        for a, n in self.steps(-1):
            if later:
                np.dot(ahead[a + n : a + n + later], turned, out=back[:later])
            ahead[a : a + n] *= back[:n]
            later = n
        start = (m.start * ahead[:most]).sum(0)
        moves = np.zeros((k, k))
        back_to = np.repeat(self.running[:-1], self.running[1:])  # places to one's predecessor
        for a in range(0, len(back_to), CACHED):
            back = back_to[a : a + CACHED]
            part = alpha.take(np.arange(most + a, most + a + len(back)) - back, axis=0)
            weighed = ahead[most + a : most + a + len(back)]
            moves += part.T @ weighed
            weighed *= part @ move
        ahead[:most] *= m.start.astype(np.float32)
        counts = np.zeros((k, CLASSES))
        for a in range(0, len(ahead), CACHED):
            for j in range(k):
                counts[j] += np.bincount(self.seen[a : a + CACHED], ahead[a : a + CACHED, j], CLASSES)
        return start, moves * m.move, counts.T


def encode(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents as numbers of their block's vocabulary, and that vocabulary, in one written table.

    kind 0: id, n (1 if trained on), data (unsigned 32-bit word numbers), classes (unsigned 16-bit).
    kind 1: id (the word's number), n (its count in training documents of the block), data (the word).
    """
    names = ["block", "kind", "id", "n", "data", "classes"]

    def batch_of(block, kind, ids, n, data, classes):
        columns = [pa.repeat(pa.scalar(block, pa.int64()), len(ids)), pa.repeat(pa.scalar(kind, pa.int32()), len(ids)), ids, n, data, classes]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def flush(block, held):
        ids, train, lengths, words = map(pa.concat_arrays, zip(*held, strict=True))
        held.clear()
        coded = words.dictionary_encode()
        words = pa.concat_arrays([pa.array([END], pa.binary()), coded.dictionary.cast(pa.binary())])
        ends = np.cumsum(lengths.to_numpy() + 1)
        numbers, is_word = np.zeros(ends[-1], np.uint32), np.ones(ends[-1], bool)
        is_word[ends - 1] = False
        numbers[is_word] = coded.indices.to_numpy() + 1
        classes = np.fromiter(map(zlib.crc32, words.to_numpy(zero_copy_only=False)), np.uint32, len(words)) % np.uint32(CLASSES - 1) + np.uint32(1)
        classes[0] = 0
        classes = classes.astype(np.uint16)
        counts = np.bincount(numbers[np.repeat(train.to_numpy(zero_copy_only=False), np.diff(ends, prepend=0))], minlength=len(words))
        for at in range(0, len(ids), 500):
            low = ends[at - 1] if at else 0
            part = slice(at, at + 500)
            flat = numbers[low : ends[part][-1]]
            yield batch_of(block, 0, ids[part], train[part].cast(pa.int64()), binaries(flat, ends[part] - low), binaries(classes[flat], ends[part] - low))
        for at in range(0, len(words), 100_000):
            part = words[at : at + 100_000]
            yield batch_of(block, 1, pa.array(np.arange(at, at + len(part))), pa.array(counts[at : at + len(part)]), part, pa.nulls(len(part), pa.binary()))

    def run(batches):
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids, texts, train = (batch.column(i)[at : at + 500] for i in range(3))
                lengths, words = split_words(texts.cast(pa.binary()))
                # Long words count for more than one token, which bounds the bytes of a block.
                sizes = np.cumsum(np.maximum(lengths + 1, pc.binary_length(texts).fill_null(0).to_numpy() >> 6))
                ends, row = np.concatenate([[0], np.cumsum(lengths)]), 0
                while row < len(lengths):
                    past = sizes[row - 1] if row else 0
                    to = min(len(lengths), row + 1 + int(np.searchsorted(sizes[row:] - past, BLOCK_TOKENS - size)))
                    held.append((ids[row:to], train[row:to], pa.array(lengths[row:to]), words[ends[row] : ends[to]]))
                    size += int(sizes[to - 1] - past)
                    if size >= BLOCK_TOKENS:
                        yield from flush(block, held)
                        block, size = block + 1, 0
                    row = to
        if held:
            yield from flush(block, held)

    source = docs.select(docs[id_col].cast("bigint"), docs[text_col].cast("string").cast("binary"), ~held_out(id_col))
    schema = "block bigint, kind int, id bigint, n bigint, data binary, classes binary"
    return materialize(map_arrow(source, run, schema), "hmm-encoded")


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def grouped(sequences, limit: int = GROUP_TOKENS):
    """Lists of sequences of about limit tokens together."""
    group, size = [], 0
    for s in sequences:
        group.append(s)
        size += len(s)
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def mixture(sequences: list[np.ndarray], m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves (none) and emissions where a document is of one state from begin to end."""
    lengths, k = np.array([len(s) for s in sequences]), len(m.start)
    flat, ends, table = np.concatenate(sequences), np.cumsum(lengths), np.ascontiguousarray(np.log(m.emit).T)
    begin, log = ends - lengths, np.tile(np.log(m.start)[:, None], len(sequences))

    def parts():  # a text may go on in the next
        size = min(CACHED, GROUP_TOKENS)
        for at in range(0, len(flat), size):
            part = flat[at : at + size].astype(np.intp)
            first, last = np.searchsorted(begin, at, side="right") - 1, np.searchsorted(begin, at + len(part))
            yield part, first, last, np.maximum(begin[first:last] - at, 0), np.minimum(ends[first:last] - at, len(part))

    for part, first, last, low, _ in parts():
        for j in range(k):  # one state's table stays in the processor's cache
            log[j, first:last] += np.add.reduceat(table[j].take(part), low)
    belongs = np.exp(log - log.max(0))
    belongs /= belongs.sum(0)
    counts = np.zeros((k, CLASSES))
    for part, first, last, low, high in parts():
        for j in range(k):
            counts[j] += np.bincount(part, np.repeat(belongs[j, first:last], high - low), CLASSES)
    return belongs.sum(1), np.zeros((k, k)), counts.T


def forward_backward(sequences: list[np.ndarray], m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return Trellis(sequences).expected(m)


def whole_pass(trained: DataFrame, m: Model, expected) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of all training documents.

    A task hands on one row for every PART_CLASSES classes; rows of the same classes meet in one task, and as many
    rows as one task makes (a few more where Spark deals rows anew) reach the driver.
    """
    k = len(m.start)
    width = PART_CLASSES * k

    def rows_of(parts: dict[int, np.ndarray]):
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], names=["part", "counts"])

    def count(batches):
        total = None
        sequences = (np.frombuffer(x, np.uint16) for batch in batches for x in batch.column(0).to_numpy(zero_copy_only=False))
        for group in grouped(sequences):
            found = expected(group, m)
            total = found if total is None else tuple(a + b for a, b in zip(total, found, strict=True))
        if total is not None:
            start, move, emit = total
            emit = np.ascontiguousarray(emit).reshape(-1, width)
            yield from rows_of({-1: np.concatenate([start[None], move])} | {int(i): emit[i] for i in np.flatnonzero(emit.any(1))})

    def add(batches):
        parts = {}
        for batch in batches:
            for part, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = np.frombuffer(counts)
                parts[part] = parts[part] + counts if part in parts else counts
        yield from rows_of(parts)

    schema = "part bigint, counts binary"
    first, emit = np.zeros((k + 1) * k), np.zeros((CLASSES // PART_CLASSES, width))
    with shuffles_go(trained.sparkSession):
        rows = map_arrow(map_arrow(trained, count, schema).repartition("part"), add, schema).toArrow()
    for part, counts in zip(*(c.to_pylist() for c in rows.columns), strict=True):
        at = first if part < 0 else emit[part]
        at += np.frombuffer(counts)
    first = first.reshape(k + 1, k)
    return first[0], first[1:], emit.reshape(CLASSES, k)


def first_model(trained: DataFrame, tokens: np.ndarray, states: int, seed: int = 3) -> Model:
    """Parameters of a mixture of all training documents. tokens: of each class, its count in them.

    The mixture starts from the classes' shares in the corpus, moved apart by a factor drawn for each class and state.
    """
    spread = np.exp(np.random.default_rng(seed).normal(0, SPREAD, (CLASSES, states)))
    emit = (tokens + 0.5)[:, None] * spread
    m = Model(np.full(states, 1 / states), np.full((states, states), 1 / states), emit / emit.sum(0))
    for _ in range(MIXTURE_PASSES):
        start, move, emit = whole_pass(trained, m, mixture)
        m = Model.from_counts(start, move, emit)
    move = np.full((states, states), 1.0) + np.eye(states) * 20 * states
    return Model.from_counts(start, move * tokens.sum() / move.sum(), emit)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, passes: int = FULL_PASSES) -> DataFrame:
    """<id_col>, held_out, n_tokens, n_known, train_tokens, base_score, score for every whole text (null: empty).

    Trained on all rows whose crc32(id) mod 7 is not 2; a null id is trained on. Words are lower-cased (A-Z)
    and split at ASCII white space; each text ends in an end token, so an empty text has one. Ids may repeat:
    each row is a text of its own. An empty table gives no rows; other columns are ignored.
    """
    encoded = encode(docs, id_col, text_col)
    documents, words = encoded.where("kind = 0"), encoded.where("kind = 1")
    trained = documents.where("n = 1").select("classes")

    # A word's rows, one from each block, meet once: each gets the sum over all, and the first block's speaks for the word.
    same = Window.partitionBy("data")
    total = F.sum("n").over(same)
    word_class = F.when(F.col("data") == F.lit(END), 0).otherwise(1 + F.pmod(F.crc32("data"), F.lit(CLASSES - 1)))
    first = F.when(F.min("block").over(same) == F.col("block"), word_class).cast("int")
    known = words.select("block", "id", "data", "n").withColumns({"count": total, "first": first})
    known = materialize(known.where("count > 0").select("block", "id", "count", "first"), "hmm-counts")
    per_class = known.where("first IS NOT NULL").groupBy(F.col("first").alias("c")).agg(F.sum("count").alias("n"), F.count("*").alias("v")).toArrow()
    tokens, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    tokens[per_class["c"].to_numpy()] = per_class["n"].to_numpy()
    distinct[per_class["c"].to_numpy()] = per_class["v"].to_numpy()
    n, v = int(tokens.sum()), int(distinct.sum())

    m = first_model(trained, tokens, states)
    for _ in range(passes):
        m = Model.from_counts(*whole_pass(trained, m, forward_backward))

    nothing = F.lit(None).cast("binary")
    known = known.select("block", F.lit(1).alias("kind"), "id", F.col("count").alias("n"), nothing.alias("data"), nothing.alias("classes"))
    names = ["id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def run(table: pa.Table) -> pa.Table:
        kind, ids, nums = table["kind"].to_numpy(), table["id"], table["n"].to_numpy()
        is_word = kind == 1
        at = ids.filter(pa.array(is_word)).to_numpy().astype(np.int64)
        rows = table.filter(pa.array(~is_word))
        data = [np.frombuffer(x, np.uint32) for x in rows["data"].to_numpy()]
        classes = [np.frombuffer(x, np.uint16) for x in rows["classes"].to_numpy()]
        count = np.zeros(1 + max([int(at.max(initial=0)), *(int(x.max()) for x in data)], default=0))
        count[at] = nums[is_word]
        class_of = np.zeros(len(count), np.uint16)
        for x, c in zip(data, classes, strict=True):
            class_of[x] = c
        base = np.log10((count + 1) / (n + v + 1))
        inside = np.where(class_of == 0, 0.0, np.log10((count + 1) / (tokens[class_of] + distinct[class_of] + 1)))
        made, at = [], 0
        for group in grouped(classes):
            flat = np.concatenate(data[at : at + len(group)])
            lengths = np.array([len(x) for x in group])
            begin, at = np.cumsum(lengths) - lengths, at + len(group)
            sums = [np.add.reduceat(x[flat], begin) for x in ((count > 0).astype(np.int64), base, inside)]
            made.append((lengths, sums[0], sums[1], Trellis(group).log10(m) + sums[2]))
        types = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        columns = [pa.array(np.concatenate(c), t) for c, t in zip(zip(*made, strict=True), types, strict=True)] if made else [pa.array([], t) for t in types]
        return pa.table([rows["id"], pa.array(rows["n"].to_numpy() == 0), *columns], names=names)

    schema = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    out = group_arrow(documents.unionByName(known), "block", run, schema)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")
