"""Exact small cases and closed forms against loops."""

import collections
import hashlib
import math
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from frameloom.functions import text
from frameloom.operators import dataset, frames, oracle, stats, words
from frameloom.plans import catalog

WORD = "conv_id long, word_idx int, speaker string, word string, start_ms long, end_ms long"


def spoken(spark, rows):
    return spark.createDataFrame([(1, i, s, w, int(a * 1000), int(b * 1000)) for i, (s, w, a, b) in enumerate(rows)], WORD)


HELLO = [("A", "hello", 0.0, 0.4), ("A", "there", 0.4, 0.8), ("A", "how", 0.8, 1.2), ("A", "today", 1.2, 1.6), ("B", "fine", 1.7, 2.1), ("B", "thanks", 2.1, 2.5)]


def test_ratios_hints_and_contexts(spark):
    w = spoken(spark, HELLO)
    got = oracle.oracle_hints(w, 500).orderBy("tick").collect()
    assert [(r.ratio, r.hint if r.ratio > 0.5 else "") for r in got] == [(0.5, ""), (0.75, "fine thanks"), (1.0, "fine thanks")]
    assert [r.channel for r in oracle.oracle_events(w, 500).collect()] == [1, 1]
    assert oracle.oracle_ticks(w, 500, "B").count() == oracle.oracle_ticks_unordered(w, 500, "B").count() == 3
    assert oracle.oracle_hints(w, 500, "A").count() == 0
    assert words.contexts_of(w).first().context == "A: hello there how today\nB: fine thanks"


def test_ticks_in_any_order_match_the_loop(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(12):
        at = 0
        for i in range(rng.randint(2, 30)):
            at += rng.choice([200, 400, 900, 1700])
            rows.append((conv, i, rng.choice("AB"), f"w{i}", at, at + 150))
    w = spark.createDataFrame(rows, WORD)
    closed = {(r.conv_id, r.tick, r.spoken, r.total, r.hint) for r in oracle.oracle_hints(w, 500).collect()}
    loop = {(r.conv_id, r.tick, r.spoken, r.total, r.hint) for r in oracle.oracle_ticks_unordered(w, 500).collect()}
    assert closed == loop and loop
    assert all(r.ordered for r in oracle.is_ordered(w).collect())
    shuffled = w.withColumn("end_ms", F.when(F.col("word_idx") == 1, F.col("end_ms") + 5000).otherwise(F.col("end_ms")))
    assert not all(r.ordered for r in oracle.is_ordered(shuffled).collect())


def test_tie_of_two_ends_takes_the_later_word(spark):
    w = spoken(spark, [("A", "hello", 0, 0.5), ("B", "hello", 0.1, 0.5), ("B", "there", 0.5, 0.8), ("A", "yes", 1.0, 1.4)])
    first = oracle.oracle_ticks_unordered(w, 500).orderBy("tick").first()
    assert (first.speaker, first.ratio) == ("B", 0.5)


@pytest.mark.parametrize("seed", range(5))
def test_slots_match_the_loop(spark, seed):
    rng, at, rows = random.Random(seed), 0, []
    for i in range(60):
        at += rng.choice([0, 0, 40, 80, 300])
        rows.append((1, i, "A", f"w{i}", at, at + 10))
    w = spark.createDataFrame(rows, WORD)
    closed = [(r.slot, r.epad) for r in frames.text_slots(w).orderBy("i").collect()]
    looped = [(r.slot, r.epad) for r in frames.slots_unordered(w).orderBy("i").collect()]
    desired = [int((r[4] / 1000) // 0.08) for r in rows]
    assert closed == looped == frames.slot_loop(desired, w.transform(frames.streams_length).first().num_frames)


def test_overflow_stops_at_the_last_frame():
    assert [s for s, _ in frames.slot_loop([0] * 13, 12)] == list(range(12))


def test_expansion_of_two_events(spark):
    e = spark.createDataFrame([(1, 0, 0, 6, "a"), (1, 1, 3, 6, "b")], "conv_id long, event_idx int, pos int, num_frames int, hint string")
    got = [(r.frame, r.token == frames.START) for r in frames.expand_events(e, "hint").orderBy("frame").collect()]
    assert got == [(0, True), (1, False), (3, True), (4, False)]


def expand_loop(events):
    """(pos, num_frames, tokens) of one conversation, written one event after the other."""
    out = {}
    for pos, n, tokens in sorted(events, key=lambda e: e[0]):
        if not tokens:
            continue
        for k, t in enumerate([frames.START, *tokens]):
            if pos + k < n:
                out[pos + k] = t
    return out


def token(word):
    return 5 + int(hashlib.md5(word.encode()).hexdigest()[:7], 16) % 31995


def test_expansion_is_clipped_at_the_last_frame_only(spark):
    rng, rows = random.Random(3), [(99, 0, 2, 400, " ".join(f"w{k}" for k in range(90)))]
    for conv in range(40):
        rows += [(conv, i, rng.randint(0, 119), 120, " ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.choice([0, 3, 30, 100])))) for i in range(rng.randint(1, 9))]
    got = {(r.conv_id, r.frame): r.token for r in frames.expand_events(spark.createDataFrame(rows, "conv_id long, event_idx int, pos int, num_frames int, hint string"), "hint").collect()}
    expected = {(c, f): t for c in {r[0] for r in rows} for f, t in expand_loop([(r[2], r[3], [token(w) for w in r[4].split()]) for r in rows if r[0] == c]).items()}
    assert got == expected and len([c for c, _ in got if c == 99]) == 91


@pytest.mark.parametrize("name, finished", [("oracle_expand", False), ("oracle_expand_finished", True)])
def test_whole_expansion_matches_the_loop(spark, name, finished):
    from frameloom.plans import catalog

    folder, w = "/root/testdata/sf0.001", collections.defaultdict(list)
    for r in words.words_of(words.turns_of(spark.read.parquet(f"{folder}/conversations.parquet"))).orderBy("conv_id", "word_idx").collect():
        w[r.conv_id].append(r)
    expected, longest = {}, 0
    for conv, ws in w.items():
        table = pd.DataFrame([(r.word_idx, r.speaker, r.word, r.end_ms) for r in ws], columns=["word_idx", "speaker", "word", "end_ms"])
        n, events = min(math.floor((max(r.end_ms for r in ws if r.speaker == s) / 1000 + 1) * 12.5) for s in {r.speaker for r in ws}) + 4, []
        for _, ms, _, _, _, _, ratio, hint in oracle.tick_loop(table, 500, None):
            pos = math.floor(ms / 1000 * 12.5) + 3
            if ratio > 0.5 and pos < n and (ratio >= 1 or not finished):
                events.append((pos, n, [token(x) for x in hint.split(" ")]))
                longest = max(longest, len(events[-1][2]))
        expected |= {(conv, f): t for f, t in expand_loop(events).items()}
    got = {(r.conv_id, r.frame): r.token for r in catalog.QUERIES[name](spark, folder).collect()}
    assert got == expected and longest > 64


def test_placement_loop_and_set_form(spark):
    stream = [3, 0, 9, 9, 3, 3, 3, 3, 3, 3, 3, 3, 0, 8, 3]
    placed, marked = frames.place_loop(stream, [2, 12])
    assert placed == [1, 12] and marked[1] == marked[12] == frames.RET and marked[2] == 9
    assert frames.place_loop([3, 9, 9], [1])[0] == [-1]
    # The second event of conversation 2 sees the mark of the first as a token that has no end of pad before it.
    events = spark.createDataFrame([(1, 0, 2), (1, 1, 12), (2, 0, 3), (2, 1, 4), (2, 2, 9), (3, 0, 1)], "conv_id long, event_no int, ret_frame int")
    assert [r.conv_id for r in frames.crowded(events).collect()] == [2]
    slots = [(1, 2, 1), (1, 3, None), (1, 13, 12), (2, 5, 4), (2, 6, None), (2, 13, 12), (3, 20, 19)]
    slots = spark.createDataFrame([(c, "B", s, e) for c, s, e in slots], "conv_id long, speaker string, slot int, epad int")
    lengths = spark.createDataFrame([(1, 15), (2, 15), (3, 5)], "conv_id long, num_frames int")
    got = {(r.conv_id, r.event_no): r.placed for r in frames.place_ret(events, slots, lengths).collect()}
    assert got == {(1, 0): 1, (1, 1): 12, (2, 0): 4, (2, 1): -1, (2, 2): 12, (3, 0): -1}


def test_long_conversations_take_linear_time(spark):
    import time

    rows = spark.range(40_000).selectExpr("1L as conv_id", "cast(id as int) as word_idx", "if(id % 9 < 6, 'A', 'B') as speaker", "'w' as word", "id * 300 as start_ms", "id * 300 + 200 as end_ms")
    began = time.time()
    assert oracle.oracle_ticks(rows).count() > 10_000
    stream = frames.token_stream(frames.text_slots(rows), frames.streams_length(rows)).where("speaker = 'A'").first().stream
    assert len(stream) > 149_000 and time.time() - began < 40


def test_chunks_are_balanced_and_delay_is_undone(spark):
    df = spark.createDataFrame([(1, "A", list(range(11)))], "conv_id long, speaker string, stream array<int>")
    assert [len(r.tokens) for r in frames.stream_chunks(df, 4, 1).orderBy("chunk").collect()] == [4, 4, 3]
    number, start = frames.chunk_of(F.col("f"), F.lit(11), 4)
    assert [(r.c, r.s) for r in spark.range(11).select(F.col("id").alias("f")).select(number.alias("c"), start.alias("s")).collect()] == [(i // 4, i // 4 * 4) for i in range(11)]
    both = frames.undelayed(frames.delayed(F.col("stream"), 2, 3, 99, 3), 2, 3)
    assert df.select(both.alias("x")).first().x == list(range(11))


def test_speaker_rules(spark):
    w = spoken(spark, [("A", "x", 0, 1)])
    assert not words.require_speakers(w).first().valid
    with pytest.raises(Exception, match="missing speaker"):
        words.require_speakers(w, strict=True).collect()


def test_joins_name_what_is_missing(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "stem string"), spark.createDataFrame([("x",)], "stem string")
    assert [r.stem for r in dataset.name_check(a, b, "stem").collect()] == ["y"]
    with pytest.raises(ValueError, match="y"):
        dataset.join_streams(a, b, "stem")
    assert dataset.join_streams(a, b, "stem", strict=False).count() == 1


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(text.strip_reasoning(F.lit("a assistant final b assistantfinal <think>q\nr</think>done"))) == "done"
    assert value(text.strip_labels(F.lit("User: User：User: User: hi"), ["User"])) == "User: hi"
    assert value(text.field(F.lit("a: 1\n- a：2\nb: 3"), "a")) == "2" and value(text.field(F.lit("x"), "a")) is None
    assert value(text.verdict(F.lit("不要です"))) == "no" and value(text.verdict(F.lit("聞き返し 不要"))) == "clarify"
    assert value(text.passed(F.lit("不合格"))) is False and value(text.passed(F.lit("合格"))) is True
    assert [tuple(r) for r in value(text.issues(F.lit("1: a too long\nnope\n2: b odd")))] == [(1, "a", "too long"), (2, "b", "odd")]
    assert value(text.score_of(F.lit("Score: 7.5"))) == 7.5 and value(text.score_of(F.lit("3 of 10"))) == 10.0 and value(text.score_of(F.lit("none"))) == 0.0
    assert [value(text.ratio_tier(F.lit(r))) for r in (0.5, 0.65, 0.8, 0.95, 0.99, 1.0)] == ["early", "half", "later", "late", "almost", "done"]


def containment_loop(docs, items):
    import re

    plain = lambda t: re.sub(r"[ \t\n\x0b\f\r.,!?]", "", t or "").lower()
    bodies, answers = [(i, plain(t)) for i, t in docs], [(i, plain(t)) for i, t in items]
    return collections.Counter((d, i) for d, body in bodies for i, answer in answers if answer and answer in body)


def test_containment_looks_for_every_item(spark):
    from frameloom.plans import catalog

    long = "A long, long answer about é and 日本語 at length"
    items = [(1, long), (7, long + "!"), (7, long[:30]), (8, "日本"), (9, " . "), (10, None), (11, "😀" * 16 + "x"), (12, "never said by any document")]
    docs = [(1, "so: a long long\nanswer about É and 日本語 at length."), (1, "other"), (None, long), (2, "x" + "😀" * 17 + "X"), (3, ""), (4, None), (5, long.upper()), (5, long)]
    got = dataset.containment(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert collections.Counter(map(tuple, got.collect())) == containment_loop(docs, items)
    folder = "/root/testdata/sf0.001"
    tables = [[tuple(r) for r in spark.read.parquet(f"{folder}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id"))]
    found = collections.Counter(map(tuple, catalog.QUERIES["answer_containment"](spark, folder).collect()))
    assert found == containment_loop(*tables) and any(i >= 5 for _, i in found)


def passage_loop(article, draw):
    fit = [p.strip() for p in article.split("\n") if 120 <= len(p.strip()) <= 400]
    if fit:
        return fit[draw % len(fit)]
    sentences = [s.strip() + "。" for s in article.replace("\n", "").split("。") if s.strip()]
    for start in (draw % len(sentences), 0) if sentences else ():
        out = ""
        for s in sentences[start:]:
            if len(out) + len(s) > 400:
                break
            out += s
        if len(out) >= 120:
            return out
    return ""


def test_passages_match_the_loop(spark):
    from frameloom.plans import catalog

    rng = random.Random(4)
    sentence = lambda: rng.choice(["日", "x ", "é"]) * rng.choice([0, 5, 30, 60, 130, 450]) + rng.choice(["。", "。\n", " 。\u3000", "\n", "。。"])
    texts = ["", "\n", "。", "short", "y" * 119, "y" * 150 + "\n" + " " * 300, " " * 200 + "z" * 100 + "。"] + ["".join(sentence() for _ in range(rng.randint(1, 12))) for _ in range(300)]
    df = spark.createDataFrame([(i, rng.randrange(1 << 28), t) for i, t in enumerate(texts)], "i int, draw long, t string")
    rows = df.withColumn("x", text.passage(F.col("t"), F.col("draw"))).collect()
    assert all(r.x == passage_loop(r.t, r.draw) for r in rows) and sum("。" in r.x for r in rows) > 50
    folder = "/root/testdata/sf0.001"
    draw = lambda k: int(hashlib.md5(f"passage:{k}".encode()).hexdigest()[:7], 16)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert {r.doc_id: r.passage for r in catalog.QUERIES["passage_pick"](spark, folder).collect()} == {k: passage_loop(t, draw(k)) for k, t in docs.items()}


def accept_loop(parts, longest=7, around=6):
    import re

    size = lambda s: len(re.sub(r"[.,!?、。？！…\s]", "", s))
    out, held, mark = [], "", ""
    for kind, t in parts:
        if kind == "mark":
            mark = t if len(t) <= longest else ""
        elif mark and size(held) >= around and size(t) >= around:
            out += [("text", held), ("mark", mark)]
            held, mark = t, ""
        else:
            held, mark = held + t, ""
    return [*out, ("text", held)]


def test_backchannels_match_the_loop(spark):
    rng = random.Random(2)
    cases = [[("mark", "m" * rng.randint(1, 9)) if i % 2 else ("text", "t" * rng.randint(0, 12)) for i in range(rng.randint(1, 9))] for _ in range(60)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, parts array<struct<kind:string,text:string>>")
    got = {r.i: [tuple(x) for x in r.x] for r in df.select("i", text.accept_backchannels(F.col("parts")).alias("x")).collect()}
    assert all(got[i] == accept_loop(c) for i, c in enumerate(cases))


def test_reports(spark):
    df = spark.createDataFrame([(float(i), float(i % 3)) for i in range(10)], "a double, b double")
    assert [r.value for r in stats.nearest_rank(df, "a", [0, 50, 100]).orderBy("q").collect()] == [0.0, 5.0, 9.0]
    assert {r.threshold: r.n for r in stats.survival(df, "a", [0, 5, 20]).collect()} == {0: 10, 5: 5, 20: 0}
    flags = spark.createDataFrame([(True, False)] * 9 + [(False, True)], "a boolean, b boolean")
    row = stats.mcnemar(flags, "a", "b").first()
    assert (row.only_a, row.only_b, row.significant) == (9, 1, True)
    assert stats.mcnemar(flags.where("a AND b"), "a", "b").first().z is None


def test_hints_stay_where_their_conversation_is(spark):
    plan = catalog.QUERIES["oracle_expand"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") + plan.count("HashJoin") == 1  # only that with the conversations' lengths
    assert set(re.findall(r"Exchange hashpartitioning\((\w+)#", plan)) == {"conv_id"} and "run#" not in "".join(re.findall(r"Exchange hashpartitioning\(.*", plan))
