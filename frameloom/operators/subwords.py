"""Subword tokens on the timeline: words give times to their characters, and characters to the tokens made of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.operators.frames import RATE, frame_of_seconds

MARK = "▁"


def spaced_words(words: DataFrame, blank_before_word: bool = True) -> DataFrame:
    """conv_id, speaker, n, text, start_s, end_s: words by their start, trimmed, with a blank before all but the first.

    blank_before_word=False takes words as they are.
    """
    order = Window.partitionBy("conv_id", "speaker").orderBy("start_ms", "word_idx")
    n = F.row_number().over(order) - 1
    plain = F.trim("word")
    text = F.when(n == 0, plain).otherwise(F.concat(F.lit(" "), plain)) if blank_before_word else F.col("word")
    return words.select("conv_id", "speaker", n.alias("n"), text.alias("text"), (F.col("start_ms") / 1000.0).alias("start_s"), (F.col("end_ms") / 1000.0).alias("end_s"))


def speaker_texts(spaced: DataFrame) -> DataFrame:
    """conv_id, speaker, text: what each speaker says, strung together."""
    parts = F.array_sort(F.collect_list(F.struct("n", "text")))
    return spaced.groupBy("conv_id", "speaker").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))


def word_spans(spaced: DataFrame) -> DataFrame:
    """conv_id, speaker, pos, size, start_s, each: each word's first character, how many it has and the time of one; empty words have none."""
    order = Window.partitionBy("conv_id", "speaker").orderBy("n")
    size = F.char_length("text")
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    words = spaced.withColumns({"size": size, "pos": before, "each": F.try_divide(F.col("end_s") - F.col("start_s"), size)}).where("size > 0")
    return words.select("conv_id", "speaker", "pos", "size", "start_s", "each")


def char_times(spaced: DataFrame) -> DataFrame:
    """conv_id, speaker, pos, start_s, end_s: each word's time in equal parts to its characters; empty words have none."""
    chars = word_spans(spaced).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    return chars.select(
        "conv_id", "speaker", (F.col("pos") + F.col("i")).alias("pos"),
        (F.col("start_s") + F.col("i") * F.col("each")).alias("start_s"), (F.col("start_s") + (F.col("i") + 1) * F.col("each")).alias("end_s"))


def merge_bytes(pieces: list[str], text: str, decode: Callable[[list[str]], str]) -> list[str]:
    """Pieces with runs of byte pieces (<0x..>) joined to the characters that they spell in the text; what spells none is one piece."""
    out: list[str] = []
    held: list[str] = []
    at = 0
    for piece in pieces:
        if piece.startswith("<0x"):
            held.append(piece)
            piece = decode(held)
            if not text.startswith(piece, at):
                continue
            held = []
        out.append(piece)
        at += len(piece)
    return [*out, "".join(held)] if held else out


def pieces_by(texts: DataFrame, tokenizer: Callable[[], tuple[Callable, Callable]]) -> DataFrame:
    """conv_id, speaker, i, token of each text by any tokenizer.

    tokenizer makes, once for each task, two functions: text to pieces, and byte pieces to text.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, decode = tokenizer()
        for pdf in batches:
            rows = [(c, s, i, p) for c, s, t in zip(pdf["conv_id"], pdf["speaker"], pdf["text"], strict=True) for i, p in enumerate(merge_bytes(encode(t), t, decode))]
            yield pd.DataFrame(rows, columns=["conv_id", "speaker", "i", "token"])

    return texts.select("conv_id", "speaker", "text").mapInPandas(run, "conv_id bigint, speaker string, i int, token string")


def pieces_of_rule(texts: DataFrame, longest: int = 4) -> DataFrame:
    """conv_id, speaker, i, token by a fixed rule inside the engine: blanks become marks, a mark in front, pieces of up to longest characters from each mark."""
    marked = F.concat(F.lit(MARK), F.translate("text", " ", MARK))
    pieces = F.regexp_extract_all(marked, F.lit(f"{MARK}[^{MARK}]{{0,{longest}}}|[^{MARK}]{{1,{longest}}}"), F.lit(0))
    return texts.select("conv_id", "speaker", F.posexplode(pieces).alias("i", "token"))


def token_times(pieces: DataFrame, chars: DataFrame, strict: bool = False) -> DataFrame:
    """conv_id, speaker, i, token, start_s, end_s, status: each token's time is that of its characters, from the first to the last.

    chars: those of char_times, or their words by word_spans. The mark in front of the first token is no character,
    and a first token that is only a mark is left out. status is ok, or empty for a token for which no characters are
    left (no times); strict raises on the latter, and on characters that no token took.

    Tokens ask for the times of their first and last characters. Words and requests of a speaker stand in the order of
    characters, and each request takes the word before it, so no table of characters is joined or broadcast.
    """
    speaker = Window.partitionBy("conv_id", "speaker")
    leads = (F.col("i") == 0) & F.col("token").startswith(MARK)
    width = F.char_length("token") - leads.cast("int")
    taken = pieces.where(~((F.col("i") == 0) & (F.col("token") == MARK))).withColumn("width", width)
    before = F.sum("width").over(speaker.orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    taken = taken.withColumn("first", F.coalesce(before, F.lit(0)).cast("int"))
    stop = F.col("first") + F.col("width")
    asked = taken.withColumn("at", F.explode(F.array(
        F.struct(F.col("first").alias("pos"), F.lit(1).alias("kind")), F.struct(F.greatest("first", stop - 1).alias("pos"), F.lit(2).alias("kind")))))
    asked = asked.select("conv_id", "speaker", "at.pos", "at.kind", "i", "token", "width", stop.alias("stop"))

    word = F.struct("pos", "size", "start_s", "each") if "each" in chars.columns else F.struct("pos", F.lit(1).alias("size"), "start_s", "end_s")
    words = chars.where("conv_id IS NOT NULL AND speaker IS NOT NULL").select("conv_id", "speaker", "pos", F.lit(0).alias("kind"), word.alias("word"))
    order = speaker.orderBy("pos", F.col("kind") > 0, "i", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = asked.unionByName(words, allowMissingColumns=True).withColumns({
        "word": F.last("word", ignorenulls=True).over(order), "last_char": F.max(F.when(F.col("kind") == 0, F.col("word.pos") + F.col("word.size") - 1)).over(speaker)})
    at = F.least("pos", "last_char") - F.col("word.pos")
    inside = at < F.col("word.size")
    begins, ends = (F.col("word.start_s") + at * F.col("word.each"), F.col("word.start_s") + (at + 1) * F.col("word.each")) if "each" in chars.columns else (F.col("word.start_s"), F.col("word.end_s"))
    begin = F.when(F.col("kind") == 1, F.struct(F.when(inside & (F.col("pos") <= F.col("last_char")), begins).alias("s")))
    found = rows.withColumn("begin", F.last(begin, ignorenulls=True).over(order))
    if strict:
        found = found.withColumn("left", F.max("stop").over(speaker) <= F.col("last_char"))
    empty = F.col("begin.s").isNull() | (F.col("width") == 0)
    status = F.when(empty, "empty").otherwise("ok")
    if strict:
        where = F.concat_ws("/", "conv_id", "speaker")
        status = (F.when(empty, F.raise_error(F.concat(F.lit("no characters left for token "), F.col("token"), F.lit(" of "), where)).cast("string"))
                  .when(F.col("left"), F.raise_error(F.concat(F.lit("characters left behind the tokens of "), where)).cast("string")).otherwise("ok"))
    return found.where("kind = 2").select(
        "conv_id", "speaker", "i", "token", F.when(~empty, F.col("begin.s")).alias("start_s"), F.when(~empty & inside, ends).alias("end_s"), status.alias("status"))


def token_slots(times: DataFrame) -> DataFrame:
    """conv_id, speaker, i, token, desired, slot, epad of the tokens that have a time, as frames.text_slots has them; the text goes one second beyond its last token."""
    order = Window.partitionBy("conv_id", "speaker").orderBy("i")
    whole = Window.partitionBy("conv_id", "speaker")
    timed = times.where("status = 'ok'").withColumns({"n": F.row_number().over(order) - 1, "desired": frame_of_seconds(F.col("start_s"))})
    last_end = F.max_by("end_s", "i").over(whole)
    timed = timed.withColumns({
        "slot": (F.col("n") + F.max(F.col("desired") - F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, 0))).cast("int"),
        "num_frames": F.floor((last_end + 1) * RATE).cast("int")})
    before = F.lag("slot").over(order)
    epad = F.when((F.col("slot") > 0) & (before.isNull() | (before != F.col("slot") - 1)), F.col("slot") - 1)
    return timed.withColumn("epad", epad).where("slot < num_frames").select("conv_id", "speaker", "i", "token", "desired", "slot", "epad")
