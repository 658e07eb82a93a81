"""Subword tokens, training examples, parsed records and data set rules with literal values."""

import pytest
from pyspark.sql import functions as F

from frameloom.functions import arrays, text
from frameloom.operators import dataset, examples, frames, stats, subwords, words
from frameloom.plans import more

WORD = "conv_id long, word_idx int, speaker string, word string, start_ms long, end_ms long"
TOKEN = "conv_id long, speaker string, i int, token string"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def timed(spark, said, tokens, strict=False, blanks=True):
    w = spark.createDataFrame([(1, i, "A", x, int(a * 1000), int(b * 1000)) for i, (x, a, b) in enumerate(said)], WORD)
    spaced = subwords.spaced_words(w, blanks)
    pieces = spark.createDataFrame([(1, "A", i, t) for i, t in enumerate(tokens)], TOKEN)
    return subwords.token_times(pieces, subwords.char_times(spaced), strict)


def test_tokens_take_the_time_of_their_characters(spark):
    got = timed(spark, [("ab", 0.0, 1.0), ("cde", 1.0, 4.0)], ["▁a", "b", "▁cd", "e"]).orderBy("i").collect()
    assert [(r.token, r.start_s, r.end_s) for r in got] == [("▁a", 0.0, 0.5), ("b", 0.5, 1.0), ("▁cd", 1.0, 3.25), ("e", 3.25, 4.0)]
    got = timed(spark, [("a", 0.0, 1.0), ("", 1.0, 2.0), ("b", 2.0, 3.0)], ["▁", "a", "b"], blanks=False).orderBy("i").collect()
    assert [(r.i, r.token, r.start_s, r.end_s, r.status) for r in got] == [(1, "a", 0.0, 1.0, "ok"), (2, "b", 2.0, 3.0, "ok")]


def test_alignment_errors_raise_only_in_strict_mode(spark):
    got = timed(spark, [("a", 0.0, 1.0)], ["a", "b"], blanks=False).orderBy("i").collect()
    assert [(r.token, r.status, r.start_s) for r in got] == [("a", "ok", 0.0), ("b", "empty", None)]
    with pytest.raises(Exception, match="no characters left for token b"):
        timed(spark, [("a", 0.0, 1.0)], ["a", "b"], True, False).collect()
    with pytest.raises(Exception, match="characters left behind"):
        timed(spark, [("abc", 0.0, 1.0)], ["a", "b"], True, False).collect()


def test_byte_pieces_are_merged_to_characters(spark):
    def decode(held):
        return bytes(int(p[3:5], 16) for p in held).decode("utf-8", "replace")

    pieces = [f"<0x{b:02X}>" for b in "é".encode()]
    assert subwords.merge_bytes(["a", *pieces, "b"], "aéb", decode) == ["a", "é", "b"]
    assert subwords.merge_bytes(["a", pieces[0]], "aé", decode) == ["a", pieces[0]]
    texts = spark.createDataFrame([(1, "A", "aéb"), (1, "B", "")], "conv_id long, speaker string, text string")
    found = subwords.pieces_by(texts, lambda: (lambda t: ["a", *pieces, "b"] if t else [], decode))
    assert [(r.i, r.token) for r in found.orderBy("i").collect()] == [(0, "a"), (1, "é"), (2, "b")]


def test_slots_of_tokens(spark):
    times = timed(spark, [("abcd", 0.0, 0.32), ("e", 2.0, 2.1)], ["▁abcd"[:3], "cd", " e"], blanks=True)
    got = subwords.token_slots(times).orderBy("i").collect()
    assert [(r.slot, r.epad) for r in got] == [(0, None), (2, 1), (24, 23)]


def test_shifts_and_bytes(spark):
    x = F.array(*[F.lit(i) for i in range(5)])
    cases = {0: [0, 1, 2, 3, 4], 2: [9, 9, 0, 1, 2], -2: [2, 3, 4, 9, 9], 99: [9, 9, 9, 9, 0], -99: [4, 9, 9, 9, 9]}
    assert {k: value(spark, arrays.shift(x, F.lit(k), 9)) for k in cases} == cases
    assert value(spark, arrays.fit(x, F.lit(3), 9)) == [0, 1, 2] and value(spark, arrays.fit(x, F.lit(7), 9)) == [0, 1, 2, 3, 4, 9, 9]
    df = spark.createDataFrame([([1, -2, 70000],), ([],), (None,)], "x array<int>")
    packed = df.withColumn("b", arrays.to_bytes("x"))
    assert [r.b and bytes(r.b) for r in packed.collect()] == [b"\x01\0\0\0\xfe\xff\xff\xff\x70\x11\x01\0", b"", None]
    assert [r.y for r in packed.select(arrays.from_bytes("b").alias("y")).collect()] == [[1, -2, 70000], [], None]


def test_main_speaker_rows_and_cuts(spark):
    df = spark.createDataFrame([(1, [[1] * 11, [2] * 11], [[3] * 11, [4] * 11])], "conv_id long, a array<array<int>>, b array<array<int>>")
    got = {r.speaker: [x[0] for x in r.rows] for r in examples.main_speaker(df, ["A", "B"]).collect()}
    assert got == {"A": [1, 2, 4], "B": [3, 4, 2]}
    late = examples.main_speaker(df, ["A"]).withColumn("rows", examples.delayed_rows(F.col("rows"), [1, 0, 2], [7, 8, 8], [5, 6, 6]))
    assert late.first().rows[0] == [7, 7, *[1] * 11, 5] and late.first().rows[2] == [8, 8, 8, *[4] * 11]
    cuts = examples.cut_rows(late, 4, 4).orderBy("chunk").collect()
    assert [(r.start, [len(x) for x in r.rows]) for r in cuts] == [(0, [4] * 3), (4, [4] * 3)]


def test_events_that_must_stay_do(spark):
    e = spark.createDataFrame([(c, i, i * 3, 40, i % 2) for c in range(50) for i in range(12)], "conv_id long, event_idx int, pos int, num_frames int, skip_forbid int")
    got = examples.skip_and_jitter(e, "s", 1.0, 1.0, 3).collect()
    assert {(r.conv_id, r.event_idx) for r in got} == {(c, i) for c in range(50) for i in range(1, 12, 2)}
    assert {r.pos - 3 * r.event_idx for r in got} == {0, 1, 2, 3}
    assert examples.skip_and_jitter(e, "s", 0.0, 0.0, 0).count() == 600
    steps = spark.createDataFrame([(s,) for s in (0, 10, 15, 20, 30)], "s int")
    assert [r.p for r in steps.select(examples.hint_only_probability(F.col("s"), 10, 20).alias("p")).collect()] == [1.0, 1.0, 0.5, 0.0, 0.0]


def test_records(spark):
    raw = "参照チャンク: 次の通り。\n\n- 一つ目\n2. 二つ目、\n・三つ目\n根拠：記事と推論\n後"
    got = value(spark, text.reference_of(F.lit(raw)))
    assert (got.reference, got.grounds) == ("次の通り。一つ目、二つ目、三つ目", ["記事", "推論"])
    assert value(spark, text.reference_of(F.lit("x"))).grounds == []
    assert value(spark, text.need_kind(F.lit("判定：要：今の情報\n事実"))) == "今の情報" and value(spark, text.need_kind(F.lit("不要"))) == ""
    assert [tuple(r) for r in value(spark, text.numbered_lines(F.lit(" 2 : b\n1：a\nx\n2: c\n3:")))] == [(2, "b"), (1, "a"), (3, "")]
    assert [tuple(r) for r in value(spark, text.verdict_numbers(F.lit("1: 3\n2: なし 4\n1: see 12, 13\n3: x")))] == [(2, None), (1, 12), (3, None)]
    assert [tuple(r) for r in value(spark, text.split_marks(F.lit("あ［ はい ］い［］")))] == [("text", "あ"), ("mark", "はい"), ("text", "い"), ("mark", ""), ("text", "")]
    assert value(spark, text.strip_end_mark(F.lit("さよなら　 EOC \n"))) == "さよなら" and value(spark, text.strip_end_mark(F.lit("EOC の話"))) == "EOC の話"
    cases = {'a {"x": {"turns": 1}} {"turns": [{}]} b': '{"turns": 1}', "<think>{}</think> {a} b {c} d": "{a} b {c}", "none": "none", '{"turns": [': '{"turns": ['}
    assert {k: value(spark, text.json_object(F.lit(k))) for k in cases} == cases


def test_rules_of_data_sets(spark, tmp_path):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "stem string")
    with pytest.raises(ValueError, match="missing columns: a, b"):
        dataset.require_columns(names("x"), ["stem", "a", "b"])
    report = str(tmp_path / "missing")
    with pytest.raises(ValueError, match="1 names"):
        dataset.join_all(names("x", "y"), [names("x", "y"), names("x")], "stem", report)
    assert [tuple(r) for r in spark.read.parquet(report).collect()] == [("y", 1)]
    assert dataset.join_all(names("x", "y"), [names("x", "y"), names("x")], "stem").count() == 1
    parts = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "stem string, turn int")
    assert sorted(r.stem for r in dataset.exclude_incomplete(names("x", "y", "z"), parts, parts.where("turn = 1"), "stem", "turn").collect()) == ["y", "z"]
    roles = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "system", "b")], "conv_id long, turn int, role string, text string")
    with pytest.raises(Exception, match="unexpected role: system"):
        words.turns_of(roles, strict=True).collect()
    assert [tuple(r) for r in words.other_roles(roles).collect()] == [("system", 1)]


def test_numbered_rows_have_no_gaps(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as k", "id % 3 as x")
    assert {(r.k, r.nth) for r in dataset.numbered(df, "k").collect()} == {(i, i) for i in range(1000)}
    assert dataset.numbered(df.limit(0), "k").count() == 0


def test_evaluation(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 0.1)], "c int, p double")
    assert {r.c: round(r.p_any, 9) for r in stats.at_least_once(df, "c", "p").collect()} == {1: 0.75, 2: 0.1}
    assert value(spark, stats.retention(F.lit(2), F.lit(10), F.lit(8))) == 0.75 and value(spark, stats.retention(F.lit(2), F.lit(2), F.lit(8))) is None
    flags = [value(spark, stats.from_reference(F.lit(p), F.lit("the red fox"), F.lit("the"))) for p in ("▁red", "▁the", "▁", "blue")]
    assert flags == [True, False, False, False]


def spans_and_chars(spark):
    said = [(c, i, s, x, 100 * i, 100 * i + 40 * len(x)) for c in (1, 2) for s in "AB" for i, x in enumerate(["abc", "", "d", "éfghi", "j"][c - 1:])]
    spaced = subwords.spaced_words(spark.createDataFrame(said, WORD), False)
    pieces = subwords.pieces_of_rule(subwords.speaker_texts(spaced), 2)
    return pieces, subwords.word_spans(spaced), subwords.char_times(spaced)


def test_words_give_tokens_the_times_that_their_characters_give(spark):
    pieces, spans, chars = spans_and_chars(spark)
    by_words, by_chars = (sorted(map(tuple, subwords.token_times(pieces, x).collect())) for x in (spans, chars))
    assert len(by_words) == 18 and [r[:4] + r[6:] for r in by_words] == [r[:4] + r[6:] for r in by_chars]
    assert [r[4:6] for r in by_words] == [pytest.approx(r[4:6]) for r in by_chars]


@pytest.mark.parametrize("slots", [True, False])
def test_no_table_of_characters_is_joined_for_tokens(spark, slots):
    query = more.piece_slots if slots else more.piece_times
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Join" not in plan and "Broadcast" not in plan


def test_numbers_of_a_table_whose_ranges_are_sampled(spark):
    n = 40_000
    df = spark.range(n).select(((F.col("id") * 7919) % n).alias("k"), F.col("id").cast("string").alias("other")).repartition(8, "other")
    assert dataset.numbered(df, "k").where("nth <> k OR other IS NULL").count() == 0
    twice = dataset.numbered(df.unionByName(df.where("k < 10")).withColumn("k", F.when(F.col("k") >= 5, F.col("k"))), "k", "other")
    assert twice.agg(F.count("*"), F.min("nth"), F.max("nth"), F.count_distinct("nth")).first()[:] == (n + 10, 0, n + 9, n + 10)


def test_parts_grow_with_the_files(spark, monkeypatch):
    query, folder = more.char_times, "/root/testdata/sf0.001"
    rows = sorted(map(tuple, query(spark, folder).where("conv_id < 3").collect()))
    monkeypatch.setattr(dataset, "PART_BYTES", 1024)
    larger = query(spark, folder)
    assert larger._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert 20 < larger.rdd.getNumPartitions() < 40
    assert rows == sorted(map(tuple, larger.where("conv_id < 3").collect()))


def test_streams_stay_where_their_conversation_is(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        plan = more.main_speaker_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not [line for line in moved if "speaker#" in line]


def test_streams_need_their_length(spark):
    slots = spark.createDataFrame([(1, "A", 1, 7, None), (1, "B", 2, 8, 1), (2, "A", 0, 9, None)], "conv_id long, speaker string, slot int, token int, epad int")
    lengths = spark.createDataFrame([(1, "A", 3), (1, "B", 4), (2, "B", 5)], "conv_id long, speaker string, num_frames int")
    got = {(r.conv_id, r.speaker): r.stream for r in frames.token_stream(slots, lengths).collect()}
    assert got == {(1, "A"): [3, 7, 3], (1, "B"): [3, 0, 8, 3]}
