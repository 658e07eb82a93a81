"""The frame timeline, 12.5 frames a second: slots, events, placement, delays, chunks and expansion."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.hashing import token_of
from frameloom.operators.dataset import numbered

RATE = 12.5
FRAME_S = 0.08
PAD, EPAD, RET = 3, 0, 4
START = 32000


def frame_of_ms(ms: Column) -> Column:
    """The rule for events: milliseconds over 1000, times the rate, cut."""
    return F.floor(ms / 1000.0 * RATE).cast("int")


def frame_of_seconds(s: Column) -> Column:
    """The rule for text: floor division by 0.08 as floating point has it."""
    return F.round((s - s % F.lit(FRAME_S)) / F.lit(FRAME_S)).cast("int")


def _frames_to(end_ms: Column) -> Column:
    return F.floor((end_ms / 1000.0 + 1) * RATE).cast("int")


def streams_length(words: DataFrame) -> DataFrame:
    """conv_id, speaker, num_frames: each speaker's text goes up to one second after that speaker's last word."""
    return words.groupBy("conv_id", "speaker").agg(_frames_to(F.max("end_ms")).alias("num_frames"))


def packed_length(lengths: DataFrame) -> DataFrame:
    """conv_id, num_frames: packed together, the speakers' streams are cut to the shorter one."""
    return lengths.groupBy("conv_id").agg(F.min("num_frames").alias("num_frames"))


def packed_streams(streams: DataFrame) -> DataFrame:
    """conv_id, speaker, stream: the streams cut to the shorter one of their conversation."""
    frames = F.min(F.size("stream")).over(Window.partitionBy("conv_id"))
    return streams.withColumn("frames", frames).select("conv_id", "speaker", F.slice("stream", F.lit(1), F.col("frames")).alias("stream"))


def text_slots(words: DataFrame) -> DataFrame:
    """conv_id, speaker, i, token, desired, slot, epad: one token for each word at the next free frame.

    With starts in order the i-th token's slot is i + max(desired_j - j) over j <= i; an end-of-pad goes to the
    frame before it unless the token before is there. Tokens past the last frame are dropped. Speakers whose
    starts aren't in order need slot_loop.
    """
    order = Window.partitionBy("conv_id", "speaker").orderBy("word_idx")
    d = frame_of_seconds(F.col("start_ms") / 1000.0)
    tokens = words.select("conv_id", "speaker", (F.row_number().over(order) - 1).alias("i"), "word_idx", token_of(F.col("word")).alias("token"), d.alias("desired"),
                          _frames_to(F.max("end_ms").over(Window.partitionBy("conv_id", "speaker"))).alias("num_frames"))
    slot = F.col("i") + F.max(F.col("desired") - F.col("i")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    tokens = tokens.withColumn("slot", slot)
    before = F.lag("slot").over(order)
    epad = F.when((F.col("slot") > 0) & (before.isNull() | (before != F.col("slot") - 1)), F.col("slot") - 1)
    tokens = tokens.withColumn("epad", epad).where("conv_id IS NOT NULL AND speaker IS NOT NULL AND slot < num_frames")
    return tokens.select("conv_id", "speaker", "i", "token", "desired", "slot", "epad")


def slot_loop(desired: list[int], frames: int) -> list[tuple[int, int | None]]:
    """Slot and end-of-pad of each token for starts in any order: every frame that is taken is skipped."""
    taken: dict[int, bool] = {}
    out = []
    for d in desired:
        while taken.get(d):
            d += 1
        if d >= frames:
            break
        taken[d] = True
        epad = d - 1 if d > 0 and not taken.get(d - 1) else None
        if epad is not None:
            taken[epad] = True
        out.append((d, epad))
    return out


def token_stream(slots: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv_id, speaker, stream: the dense text stream of each speaker.

    Each token brings the pads before it, and the pieces are strung together in order, so the work is linear in the
    frames. Lengths come by conversation, so that streams stay in the parts by which their words were dealt.
    """
    cells = slots.select("conv_id", "speaker", F.explode(F.array(
        F.struct(F.col("slot").alias("frame"), F.col("token").cast("int").alias("token")),
        F.struct(F.col("epad").alias("frame"), F.lit(EPAD).alias("token")))).alias("c")).where("c.frame IS NOT NULL")
    before = F.lag("c.frame").over(Window.partitionBy("conv_id", "speaker").orderBy("c.frame"))
    piece = F.concat(F.array_repeat(F.lit(PAD), F.col("c.frame") - F.coalesce(before, F.lit(-1)) - 1), F.array("c.token"))
    pieces = F.array_sort(F.collect_list(F.struct(F.col("c.frame").alias("frame"), F.col("piece"))))
    packed = cells.withColumn("piece", piece).groupBy("conv_id", "speaker").agg(pieces.alias("pieces"), F.max("c.frame").alias("last"))
    rest = F.array_repeat(F.lit(PAD), F.col("num_frames") - F.col("last") - 1)
    stream = F.concat(F.flatten(F.transform("pieces", lambda x: x["piece"])), rest)
    of_all = lengths.where("speaker IS NOT NULL").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("speaker", "num_frames"))).alias("of_all"))
    sized = packed.join(of_all, "conv_id").withColumn("num_frames", F.try_element_at("of_all", F.col("speaker"))).where("num_frames IS NOT NULL")
    return sized.select("conv_id", "speaker", stream.alias("stream"))


def token_classes(streams: DataFrame) -> DataFrame:
    """Frames of each class: real, end of pad, pad, retrieval."""
    c = F.when(F.col("token") == PAD, "pad").when(F.col("token") == EPAD, "epad").when(F.col("token") == RET, "ret").otherwise("real")
    return streams.select("speaker", F.explode("stream").alias("token")).groupBy("speaker", c.alias("class")).agg(F.count("*").alias("frames"))


def ret_events(turns: DataFrame, words: DataFrame) -> DataFrame:
    """Retrieval events of assistant turns with a lead and a body: conv_id, turn, event_no, ret_frame, lead_onset_ms, body_onset_ms, d_lead_ms, d_lead_frames.

    A turn has both if its text has a full stop and a blank; the lead goes up to the first. Events whose lead is not
    positive are dropped; ret_frame is a frame before the lead's.
    """
    parts = turns.where("speaker = 'B' AND contains(text, '. ')").select("conv_id", "turn", F.size(F.filter(
        F.split(F.substring_index("text", ". ", 1), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")).alias("lead_words"))
    order = Window.partitionBy("conv_id", "turn").orderBy("word_idx")
    nth = words.withColumn("nth", F.row_number().over(order) - 1)
    at = nth.join(parts, ["conv_id", "turn"]).groupBy("conv_id", "turn").agg(
        F.min("start_ms").alias("lead_onset_ms"), F.min(F.when(F.col("nth") >= F.col("lead_words"), F.col("start_ms"))).alias("body_onset_ms"))
    lead = F.col("body_onset_ms") - F.col("lead_onset_ms")
    events = at.withColumn("d_lead_ms", lead).where("d_lead_ms > 0")
    return events.select(
        "conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("event_no"),
        F.greatest(F.lit(0), frame_of_ms(F.col("lead_onset_ms")) - 1).alias("ret_frame"), "lead_onset_ms", "body_onset_ms", "d_lead_ms",
        frame_of_ms(F.col("d_lead_ms")).alias("d_lead_frames"))


def place_ret(events: DataFrame, slots: DataFrame, lengths: DataFrame, back: int = 2, forward: int = 8) -> DataFrame:
    """conv_id, event_no, ret_frame, placed: the end of pad before the first real token in [ret_frame - back, ret_frame + forward); -1 where none is there.

    lengths: conv_id, num_frames of the packed streams. Events closer than back + forward frames see each other's
    marks: such conversations go through place_loop, one event after the other.
    """
    close = crowded(events, back + forward)
    b = slots.where("speaker = 'B'").select("conv_id", "slot", "epad").join(lengths, "conv_id")
    window = (F.col("slot") >= F.col("ret_frame") - back) & (F.col("slot") < F.col("ret_frame") + forward) & (F.col("slot") >= 0) & (F.col("slot") < F.col("num_frames"))
    alone = events.join(close, "conv_id", "left_anti")
    hit = alone.join(b, "conv_id").where(window).groupBy("conv_id", "event_no").agg(F.min_by(F.struct("slot", "epad"), "slot").alias("first"))
    simple = alone.join(hit, ["conv_id", "event_no"], "left").select("conv_id", "event_no", "ret_frame", F.coalesce(F.col("first.epad"), F.lit(-1)).alias("placed"))

    def run(key, marks: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        stream = [PAD] * (int(cells["num_frames"].iloc[0]) if len(cells) else 0)
        for slot, epad in zip(cells["slot"], cells["epad"], strict=True):
            for at, token in ((epad, EPAD), (slot, START)):
                if at == at and at is not None and at < len(stream):
                    stream[int(at)] = token
        marks = marks.sort_values("event_no")
        placed, _ = place_loop(stream, marks["ret_frame"].tolist(), back, forward)
        return marks.assign(placed=placed)[["conv_id", "event_no", "ret_frame", "placed"]]

    mine = events.join(close, "conv_id", "left_semi").select("conv_id", F.col("event_no").cast("int").alias("event_no"), "ret_frame")
    cells = b.join(close, "conv_id", "left_semi")
    looped = mine.groupBy("conv_id").cogroup(cells.toDF(*cells.columns).groupBy("conv_id")).applyInPandas(  # toDF: both come from the same words
        run, "conv_id bigint, event_no int, ret_frame int, placed int")
    return simple.unionByName(looped)


def crowded(events: DataFrame, gap: int = 10) -> DataFrame:
    """Conversations with two events less than gap frames apart."""
    order = Window.partitionBy("conv_id").orderBy("ret_frame", "event_no")
    near = F.col("ret_frame") - F.lag("ret_frame").over(order) < gap
    return events.withColumn("near", near).where("near").select("conv_id").distinct()


def place_loop(stream: list[int], frames: list[int], back: int = 2, forward: int = 8) -> tuple[list[int], list[int]]:
    """Placement one event after the other on the stream that earlier marks have changed."""
    stream, out = list(stream), []
    for f in frames:
        window = range(max(0, f - back), min(len(stream), f + forward))
        first = next((i for i in window if stream[i] not in (PAD, EPAD)), None)
        if first is not None and first > 0 and stream[first - 1] == EPAD:
            stream[first - 1] = RET
            out.append(first - 1)
        else:
            out.append(-1)
    return out, stream


def keep_placed(placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Events that were placed, renumbered, with the running offset of their vectors (sizes: conv_id, event_no, n)."""
    order = Window.partitionBy("conv_id").orderBy("event_no")
    kept = placed.where("placed >= 0").join(sizes, ["conv_id", "event_no"])
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return kept.select("conv_id", (F.row_number().over(order) - 1).alias("event_no"), "placed", before.cast("bigint").alias("offset"), F.col("n").cast("bigint").alias("n"))


def body_frames(manifest: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv_id, turn, n_frames, first, last of each assistant turn's frames, clipped to the stream."""
    first = frame_of_ms(F.col("onset_ms"))
    stop = F.least(frame_of_ms(F.col("onset_ms") + F.col("duration_ms")), F.col("num_frames"))
    m = manifest.where("speaker = 'B'").join(lengths, "conv_id").select("conv_id", "turn", first.alias("s"), stop.alias("e")).where("s < e")
    return m.select("conv_id", "turn", F.explode(F.sequence(F.col("s"), F.col("e") - 1)).alias("frame"))


def delayed(stream: Column, delay: int, most: int, initial: int, pad: int) -> Column:
    """A row shifted by its delay: delay + 1 initial tokens before it, pads behind up to the largest delay."""
    return F.concat(F.array_repeat(F.lit(initial), delay + 1), stream, F.array_repeat(F.lit(pad), most - delay))


def undelayed(stream: Column, delay: int, most: int) -> Column:
    """The row without its delay; null where it is too short."""
    n = F.size(stream) - most - 1
    return F.when(n > 0, F.slice(stream, delay + 2, n))


def chunk_of(frame: Column, frames: Column, longest: int) -> tuple[Column, Column]:
    """Number and start of the chunk of a frame: ceil(frames / longest) chunks, the first ones one frame longer."""
    n = F.ceil(frames / longest)
    q, r = F.floor(frames / n), frames % n
    inside = frame < r * (q + 1)
    number = F.when(inside, F.floor(frame / (q + 1))).otherwise(r + F.floor((frame - r * (q + 1)) / q))
    start = F.when(number <= r, number * (q + 1)).otherwise(r * (q + 1) + (number - r) * q)
    return number.cast("int"), start.cast("int")


def stream_chunks(streams: DataFrame, longest: int, shortest: int) -> DataFrame:
    """conv_id, speaker, chunk, start, tokens; chunks below shortest frames are dropped."""
    frames = F.size("stream")
    n = F.ceil(frames / longest).cast("int")
    q, r = F.floor(frames / n).cast("int"), (frames % n).cast("int")
    chunks = streams.where(frames > 0).withColumns({"n": n, "q": q, "r": r}).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    start = F.col("chunk") * F.col("q") + F.least("chunk", "r")
    size = F.col("q") + F.when(F.col("chunk") < F.col("r"), 1).otherwise(0)
    chunks = chunks.withColumns({"start": start, "size": size}).where(F.col("size") >= shortest)
    return chunks.select("conv_id", "speaker", "chunk", "start", F.slice("stream", F.col("start") + 1, F.col("size")).alias("tokens"))


def labels_of(tokens: Column, initial: int, zero: int) -> Column:
    return F.transform(tokens, lambda t: F.when(t < initial, t).otherwise(zero))


def align_events(events: DataFrame, lengths: DataFrame, text_delay: int, most_delay: int) -> DataFrame:
    """Events on the delayed timeline, which is most_delay + 1 frames longer; those out of range are dropped."""
    pos = frame_of_ms(F.col("timestamp_ms")) + 1 + text_delay
    longer = lengths.select("conv_id", (F.col("num_frames") + most_delay + 1).alias("num_frames"))
    return events.join(longer, "conv_id").withColumn("pos", pos).where((F.col("pos") >= 0) & (F.col("pos") < F.col("num_frames")))


def expand_events(events: DataFrame, text: str) -> DataFrame:
    """conv_id, frame, token: start token and then the event's tokens; a frame takes the latest event that covers it.

    events: conv_id, event_idx, pos, num_frames and the text. Frames that no event covers are left out, and so are
    events without a word. Tokens are clipped at num_frames only. An event that the next one outlasts makes cells up
    to the next one's start, as the rest is covered.
    """
    words = lambda x: F.filter(F.split(x, " "), lambda w: w != "")
    sized = events.select("conv_id", "event_idx", "pos", "num_frames", F.size(words(F.col(text))).alias("n"), F.col(text).alias("text")).where("n > 0")
    sized = sized.withColumn("stop", F.least(F.col("pos") + F.col("n") + 1, F.col("num_frames")))
    order = Window.partitionBy("conv_id").orderBy("pos", "event_idx")
    stop = F.when(F.lead("stop").over(order) >= F.col("stop"), F.lead("pos").over(order)).otherwise(F.col("stop"))
    sized = sized.withColumn("stop", stop).where("stop > pos")
    tokens = F.concat(F.array(F.lit(START).cast("bigint")), F.transform(F.slice(words(F.col("text")), F.lit(1), F.col("stop") - F.col("pos") - 1), lambda w: token_of(w)))
    cells = sized.select("conv_id", "event_idx", "pos", F.posexplode(tokens).alias("k", "token")).withColumn("frame", F.col("pos") + F.col("k"))
    return cells.groupBy("conv_id", "frame").agg(F.max_by("token", F.struct("pos", "event_idx")).alias("token"))


def chosen_text(ratio: Column, hint: Column, prediction: Column, hint_only: bool = False) -> Column:
    """The hint from ratio 1 on if there is one, else the prediction; hint only: nothing in its place."""
    return hint if hint_only else F.when((ratio >= 1.0) & (hint != ""), hint).otherwise(prediction)


def inject(events: DataFrame, vectors: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv_id, frame, vec_id: the i-th vector of an event lands at its start + i; later events win, past the end is clipped.

    events: conv_id, event_no, start; vectors: conv_id, event_no, i, vec_id.
    """
    cells = events.join(vectors, ["conv_id", "event_no"]).join(lengths, "conv_id").withColumn("frame", F.col("start") + F.col("i"))
    return cells.where("frame < num_frames").groupBy("conv_id", "frame").agg(F.max_by("vec_id", F.struct("event_no", "i")).alias("vec_id"))


def pad_batches(df: DataFrame, batch: int) -> DataFrame:
    """conv_id, batch, padded, masked: streams in key order, padded to the longest of their batch."""
    sized = numbered(df.select("conv_id", "speaker", F.size("stream").alias("n")), "conv_id", "speaker").withColumn("batch", F.floor(F.col("nth") / batch))
    longest = F.max("n").over(Window.partitionBy("batch"))
    return sized.select("conv_id", "speaker", "batch", longest.alias("padded"), (longest - F.col("n")).alias("masked"))


def slots_unordered(words: DataFrame) -> DataFrame:
    """text_slots for speakers whose starts aren't in order, by slot_loop, one stream at a time."""
    order = Window.partitionBy("conv_id", "speaker").orderBy("word_idx")
    source = words.withColumns({"i": F.row_number().over(order) - 1, "desired": frame_of_seconds(F.col("start_ms") / 1000.0), "token": token_of(F.col("word"))})
    source = source.join(streams_length(words), ["conv_id", "speaker"]).select("conv_id", "speaker", "i", "token", "desired", "num_frames")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        placed = slot_loop(pdf["desired"].tolist(), int(pdf["num_frames"].iloc[0])) if len(pdf) else []
        out = pdf.head(len(placed))[["conv_id", "speaker", "i", "token", "desired"]].copy()
        out["slot"] = pd.array([s for s, _ in placed], "Int32")
        out["epad"] = pd.array([e for _, e in placed], "Int32")
        return out

    return source.groupBy("conv_id", "speaker").applyInPandas(run, "conv_id bigint, speaker string, i int, token bigint, desired int, slot int, epad int")
