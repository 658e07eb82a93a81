"""Registered queries over subword tokens, training examples, parsed records and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.functions import arrays, hashing, text
from frameloom.operators import dataset, examples, frames, oracle, stats, subwords, words
from frameloom.plans import oracle_sql as sql
from frameloom.plans.catalog import MOST_DELAY, TEXT_DELAY, _flat, _lengths, _packed, _turns, _words, query
from frameloom.sources.tables import read_table

# Fixed values of these queries: of the text row and two codebooks of each speaker, delays, initial tokens and pads.
DELAYS, INITIALS, PADS = [TEXT_DELAY, 0, MOST_DELAY, 0, MOST_DELAY], [32001, 2048, 2048, 2048, 2048], [3, 2048, 2048, 2048, 2048]

# Subword tokens

SPACED = """spaced AS (SELECT conv_id, speaker, n, CASE WHEN n = 0 THEN word ELSE ' ' || word END AS text, start_ms / 1000.0::DOUBLE AS s, end_ms / 1000.0::DOUBLE AS e
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, speaker ORDER BY start_ms, word_idx) - 1 AS n FROM words)),
    chars AS (SELECT conv_id, speaker, (before + i)::INT AS pos, s + i * each AS start_s, s + (i + 1) * each AS end_s FROM (
        SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id, speaker ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, (e - s) / length(text) AS each, unnest(range(0, length(text))) AS i FROM spaced))"""
PIECES = SPACED + """,
    pieces AS (SELECT conv_id, speaker, unnest(ps) AS token, unnest(range(0, len(ps))) AS i FROM (
        SELECT conv_id, speaker, regexp_extract_all('▁' || replace(string_agg(text, '' ORDER BY n), ' ', '▁'), '▁[^▁]{0,4}|[^▁]{1,4}') AS ps FROM spaced GROUP BY ALL)),
    wide AS (SELECT *, length(token) - (i = 0 AND starts_with(token, '▁'))::INT AS width FROM pieces WHERE NOT (i = 0 AND token = '▁')),
    spans AS (SELECT *, coalesce(sum(width) OVER (PARTITION BY conv_id, speaker ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM wide),
    times AS (SELECT conv_id, speaker, i, token, min(c.start_s) AS start_s, max(c.end_s) AS end_s FROM spans JOIN chars c USING (conv_id, speaker) WHERE c.pos >= first AND c.pos < first + width GROUP BY ALL)"""


def _with_more(more: str, body: str) -> str:
    return sql.words("").rstrip() + ",\n" + more + "\n" + body


def _pieces(spark, d):
    spaced = subwords.spaced_words(_words(spark, d))
    return subwords.token_times(subwords.pieces_of_rule(subwords.speaker_texts(spaced)), subwords.word_spans(spaced))


@query(_with_more(SPACED, "SELECT conv_id, speaker, pos, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM chars"))
def char_times(spark, d):
    c = subwords.char_times(subwords.spaced_words(_words(spark, d)))
    return c.withColumns({"start_s": F.round("start_s", 6), "end_s": F.round("end_s", 6)})


@query(_with_more(PIECES, "SELECT conv_id, speaker, i, token, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, 'ok' AS status FROM times"))
def piece_times(spark, d):
    return _pieces(spark, d).withColumns({"start_s": F.round("start_s", 6), "end_s": F.round("end_s", 6)})


@query(_with_more(PIECES, """SELECT conv_id, speaker, i, slot, CASE WHEN slot > 0 AND lag(slot) OVER (PARTITION BY conv_id, speaker ORDER BY i) IS DISTINCT FROM slot - 1 THEN slot - 1 END AS epad FROM (
    SELECT *, (n + max(desired - n) OVER (PARTITION BY conv_id, speaker ORDER BY i))::INT AS slot FROM (
        SELECT *, round((start_s - start_s % 0.08::DOUBLE) / 0.08::DOUBLE)::INT AS desired, row_number() OVER (PARTITION BY conv_id, speaker ORDER BY i) - 1 AS n,
            floor((last_value(end_s) OVER (PARTITION BY conv_id, speaker ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) + 1) * 12.5::DOUBLE)::INT AS num_frames FROM times))
    WHERE slot < num_frames"""))
def piece_slots(spark, d):
    return subwords.token_slots(_pieces(spark, d)).select("conv_id", "speaker", "i", "slot", "epad")


# Training examples


def _book(side: str, book: int) -> str:
    return f"list_transform(range(0, len({side})), lambda f: ({sql.number(f'book{book}', 'conv_id', repr(side.upper()), 'f')} % 2048)::INT)"


PAIRS = f"""pairs AS (SELECT conv_id, [a, {_book('a', 1)}, {_book('a', 2)}] AS a, [b, {_book('b', 1)}, {_book('b', 2)}] AS b FROM (
        SELECT x.conv_id, x.stream AS a, y.stream AS b FROM cut x JOIN cut y ON x.conv_id = y.conv_id AND x.speaker = 'A' AND y.speaker = 'B')),
    main AS (SELECT conv_id, 'A' AS speaker, list_concat(a, b[2:]) AS r FROM pairs UNION ALL SELECT conv_id, 'B', list_concat(b, a[2:]) FROM pairs)"""
LATE = f"""late AS (SELECT conv_id, speaker, list_transform(range(1, 6), lambda k: list_concat(list_concat(
        list_transform(range(0, {DELAYS}[k] + 1), lambda z: {INITIALS}[k]), r[k]), list_transform(range(0, {MOST_DELAY} - {DELAYS}[k]), lambda z: {PADS}[k]))) AS r FROM main)"""


def _cut_with(more: str, body: str) -> str:
    return sql.cut("").rstrip() + ",\n" + more + "\n" + body


def _main_speaker(spark, d, form=lambda row: row):
    streams = _packed(spark, d)
    book = lambda n: F.transform("stream", lambda t, f: F.pmod(hashing.number(f"book{n}", F.col("conv_id"), F.col("speaker"), f), F.lit(2048)).cast("int"))
    rows = streams.select("conv_id", "speaker", F.array(*[form(row) for row in (F.col("stream"), book(1), book(2))]).alias("rows"))
    side = lambda s: F.max(F.when(F.col("speaker") == s, F.col("rows")))
    return examples.main_speaker(rows.groupBy("conv_id").agg(side("A").alias("a"), side("B").alias("b")).where("a IS NOT NULL AND b IS NOT NULL"), ["A", "B"])


@query(_cut_with(PAIRS, "SELECT conv_id, speaker, k::INT AS row_no, array_to_string(r[k + 1], ',') AS tokens FROM (SELECT *, unnest(range(0, len(r))) AS k FROM main)"))
def main_speaker_rows(spark, d):
    """Each row is made text once, before both main speakers take it."""
    return _main_speaker(spark, d, _flat).select("conv_id", "speaker", F.posexplode("rows").alias("row_no", "tokens"))


@query(_cut_with(PAIRS + ",\n" + LATE, """SELECT conv_id, speaker, chunk::INT AS chunk, (chunk * q + least(chunk, rest))::INT AS start, k::INT AS row_no,
    array_to_string(r[k + 1][chunk * q + least(chunk, rest) + 1 : chunk * q + least(chunk, rest) + q + (chunk < rest)::INT], ',') AS tokens FROM (
    SELECT *, unnest(range(0, 5)) AS k FROM (SELECT conv_id, speaker, r, t // n AS q, t % n AS rest, unnest(range(0, n)) AS chunk FROM (SELECT *, len(r[1]) AS t, ceil(len(r[1]) / 512.0)::INT AS n FROM late)))
    WHERE q + (chunk < rest)::INT >= 8"""))
def example_chunks(spark, d):
    """Streams of a main speaker, delayed row by row, cut and filtered: the whole chain before events are laid over."""
    late = _main_speaker(spark, d).withColumn("rows", examples.delayed_rows(F.col("rows"), DELAYS, INITIALS, PADS))
    chunks = examples.cut_rows(late, 512, 8)
    return chunks.select("conv_id", "speaker", "chunk", "start", F.posexplode("rows").alias("row_no", "tokens")).withColumn("tokens", _flat(F.col("tokens")))


@query(sql.aligned(f"""SELECT conv_id, event_idx, pos + ({sql.number('aug-jitter', 'conv_id', 'event_idx')} % 4)::INT AS pos FROM aligned
    WHERE NOT (skip_forbid = 0 AND {sql.number('aug-skip', 'conv_id', 'event_idx')} / 268435456.0::DOUBLE < 0.1::DOUBLE + 0.4::DOUBLE * ({sql.number('aug-rate', 'conv_id')} / 268435456.0::DOUBLE))
    AND pos + ({sql.number('aug-jitter', 'conv_id', 'event_idx')} % 4)::INT < num_frames"""))
def augmented_events(spark, d):
    w = _words(spark, d)
    e = frames.align_events(oracle.oracle_events(w), _lengths(w), TEXT_DELAY, MOST_DELAY)
    return examples.skip_and_jitter(e, "aug", 0.1, 0.5, 3).select("conv_id", "event_idx", "pos")


@query(sql.cut(f"""SELECT conv_id, speaker, array_to_string(CASE WHEN n <= 1 OR {sql.number('move-shift', 'conv_id')} / 268435456.0::DOUBLE >= 0.5 THEN stream
    WHEN side = 1 THEN list_concat(list_transform(range(0, r), lambda z: 3), stream[1 : n - r]) ELSE list_concat(stream[l + 1 : n], list_transform(range(0, l), lambda z: 3)) END, ',') AS stream FROM (
    SELECT *, {sql.number('move-side', 'conv_id')} % 2 AS side, least(n - 1, 1 + {sql.number('move-by', 'conv_id')} % 10) AS r, least(n - 1, 2 + {sql.number('move-by', 'conv_id')} % 5) AS l FROM (SELECT *, len(stream) AS n FROM cut))"""))
def shifted_streams(spark, d):
    s = examples.shifted_stream(F.col("stream"), "move", F.col("conv_id"), 0.5, (2, 6), (1, 10), frames.PAD)
    return _packed(spark, d).select("conv_id", "speaker", _flat(s).alias("stream"))


@query("SELECT doc_id, CASE WHEN doc_id <= 100 THEN 1.0 WHEN doc_id >= 500 THEN 0.0 ELSE round(1.0 - (doc_id - 100) / 400.0::DOUBLE, 6) END::DOUBLE AS p FROM documents")
def hint_only_schedule(spark, d):
    p = examples.hint_only_probability(F.col("doc_id"), 100, 500)
    return read_table(spark, d, "documents").select("doc_id", F.round(p.cast("double"), 6).alias("p"))


@query(sql.cut("SELECT conv_id, speaker, array_to_string(CASE WHEN len(stream) >= 600 THEN stream[1:600] ELSE list_concat(stream, list_transform(range(0, 600 - len(stream)), lambda z: 3)) END, ',') AS stream FROM cut"))
def fitted_streams(spark, d):
    return _packed(spark, d).select("conv_id", "speaker", _flat(arrays.fit(F.col("stream"), F.lit(600), frames.PAD)).alias("stream"))


# Turns and data sets


@query(sql.words("SELECT conv_id, turn, speaker, count(*) FILTER (speaker = 'B') OVER (PARTITION BY conv_id ORDER BY turn) AS assistant_turns FROM turns"))
def assistant_turns(spark, d):
    return examples.assistant_turn_numbers(_turns(spark, d))


@query("SELECT role, count(*) AS turns FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant') GROUP BY role")
def other_roles(spark, d):
    return words.other_roles(read_table(spark, d, "conversations"))


@query(sql.words("SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id NOT IN (SELECT conv_id FROM turns WHERE NOT contains(coalesce(text, ''), '.'))"))
def aligned_conversations(spark, d):
    turns = _turns(spark, d)
    return dataset.exclude_incomplete(read_table(spark, d, "conversations").select("conv_id").distinct(), turns, turns.where("contains(text, '.')"), "conv_id", "turn")


@query(sql.ret_events("""SELECT conv_id, n_words, num_frames, n_events FROM (SELECT DISTINCT conv_id FROM conversations) JOIN (SELECT conv_id, count(*) AS n_words FROM words GROUP BY conv_id) USING (conv_id)
    JOIN packed USING (conv_id) JOIN (SELECT conv_id, count(*) AS n_events FROM ret_events GROUP BY conv_id) USING (conv_id)"""))
def packed_join(spark, d):
    w = _words(spark, d)
    counted = lambda df, name: df.groupBy("conv_id").agg(F.count("*").alias(name))
    driver = read_table(spark, d, "conversations").select("conv_id").distinct()
    return dataset.join_all(driver, [counted(w, "n_words"), _lengths(w), counted(frames.ret_events(_turns(spark, d), w), "n_events")], "conv_id")


# Parsed records

RAW_LINES = "array_to_string(list_transform(string_split(text, '. '), lambda s: '・ ' || s), chr(10))"


@query(f"""SELECT conv_id, turn, list_reduce(list_transform(ls, lambda l: CASE WHEN l = ls[1] THEN l ELSE l END), lambda t, l: CASE WHEN t = '' OR ends_with(t, '。') OR ends_with(t, '、') THEN t || l ELSE t || '、' || l END) AS reference, '会話,知識' AS grounds
    FROM (SELECT conv_id, turn, list_filter(list_transform(string_split('H' || chr(10) || {RAW_LINES}, chr(10)), lambda l, i: trim(CASE WHEN i = 1 THEN l ELSE regexp_replace(trim(l), '^・[ \\t\\x{{3000}}]*', '') END)), lambda l: l <> '') AS ls FROM conversations WHERE text IS NOT NULL)""")
def parsed_references(spark, d):
    raw = F.concat(F.lit("参照チャンク：H\n"), F.array_join(F.transform(F.split("text", r"\. "), lambda s: F.concat(F.lit("・ "), s)), "\n"), F.lit("\n\n根拠：会話と知識\n推論"))
    found = text.reference_of(raw)
    return read_table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", found["reference"].alias("reference"), F.array_join(found["grounds"], ",").alias("grounds"))


@query("""SELECT conv_id, n::INT AS n, arg_min(role || turn, turn) AS text FROM (SELECT conv_id, turn % 3 AS n, role, turn FROM conversations) GROUP BY conv_id, n""")
def first_numbered_lines(spark, d):
    line = F.concat_ws("", (F.col("turn") % 3).cast("string"), F.lit(" ： "), "role", F.col("turn").cast("string"))
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\nno number\n")
    c = read_table(spark, d, "conversations").groupBy("conv_id").agg(raw.alias("raw"))
    return c.select("conv_id", F.explode(text.numbered_lines(F.col("raw"))).alias("x")).select("conv_id", "x.n", "x.text")


@query("""SELECT conv_id, n::INT AS n, arg_max(v, turn) AS value FROM (SELECT conv_id, turn, turn % 4 AS n, struct_pack(v := CASE WHEN turn % 3 <> 0 THEN turn::INT END) AS v FROM conversations) GROUP BY conv_id, n""".replace("arg_max(v, turn) AS value", "arg_max(v, turn).v AS value"))
def turn_verdicts(spark, d):
    line = F.concat(F.col("turn") % 4, F.lit(": "), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("なし "), F.col("turn"))).otherwise(F.concat(F.lit("no. "), F.col("turn"), F.lit(" 99"))))
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n")
    c = read_table(spark, d, "conversations").groupBy("conv_id").agg(raw.alias("raw"))
    return c.select("conv_id", F.explode(text.verdict_numbers(F.col("raw"))).alias("x")).select("conv_id", "x.n", "x.value")


@query("""SELECT conv_id, turn, array_to_string(list_transform(range(0, len(s)), lambda i: 't:' || s[i + 1] || CASE WHEN i + 1 < len(s) THEN '|m:m' || i ELSE '' END), '|') AS parts, true AS same
    FROM (SELECT conv_id, turn, string_split(replace(text, '［', ''), '. ') AS s FROM conversations WHERE text IS NOT NULL)""")
def marked_parts(spark, d):
    parts = F.split(F.regexp_replace("text", "［", ""), r"\. ")
    raw = F.array_join(F.transform(parts, lambda s, i: F.when(i == 0, s).otherwise(F.concat(F.lit("［ m"), i - 1, F.lit(" ］"), s))), "")
    found = text.split_marks(raw)
    said = F.array_join(F.transform(F.filter(found, lambda p: p["kind"] == "text"), lambda p: p["text"]), "")
    flat = F.array_join(F.transform(found, lambda p: F.concat(F.substring(p["kind"], 1, 1), F.lit(":"), p["text"])), "|")
    return read_table(spark, d, "conversations").where("text IS NOT NULL").select(
        "conv_id", "turn", flat.alias("parts"), text.same_but_blanks(said, F.array_join(parts, " \n")).alias("same"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN rtrim(body, ' ') ELSE body END AS spoken FROM (SELECT conv_id, turn, translate(text, '…「」『』（）', '') AS body FROM conversations WHERE text IS NOT NULL)""")
def spoken_texts(spark, d):
    raw = F.concat(F.lit("「"), "text", F.lit("…」"), F.when(F.col("turn") % 2 == 0, "　 EOC \n").otherwise(""))
    return read_table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", text.strip_end_mark(text.without_quotes(raw)).alias("spoken"))


@query("""SELECT conv_id, turn, '{"id": ' || turn || ', "turns": [{"n": ' || conv_id || '}, {}]}' AS object FROM conversations""")
def embedded_objects(spark, d):
    whole = F.concat(F.lit('{"id": '), F.col("turn"), F.lit(', "turns": [{"n": '), F.col("conv_id"), F.lit("}, {}]}"))
    raw = F.concat(F.lit("<think>{not this}\n</think>so: "), whole, F.lit(" {and} so on"))
    return read_table(spark, d, "conversations").select("conv_id", "turn", text.json_object(raw).alias("object"))


# Evaluation

DRAWN = f"""drawn AS (SELECT event_id, user_id, event_type, {sql.number('chance', 'event_id')} / 268435456.0::DOUBLE AS p, 1 + {sql.number('rank', 'event_id')} % 40 AS rank FROM events)"""


def _drawn(spark, d):
    e = read_table(spark, d, "events")
    return e.select("event_id", "user_id", "event_type", hashing.uniform("chance", F.col("event_id")).alias("p"), (1 + F.pmod(hashing.number("rank", F.col("event_id")), F.lit(40))).alias("rank"))


@query(f"WITH {DRAWN} SELECT count(*) AS n, round(median(p), 6) AS p_median, round(avg(p), 6) AS p_mean, median(rank) AS rank_median, round(avg((rank <= 1)::INT), 6) AS top_1, round(avg((rank <= 10)::INT), 6) AS top_10, round(avg((rank <= 25)::INT), 6) AS top_25 FROM drawn")
def trigger_ranks(spark, d):
    found = stats.rank_shares(_drawn(spark, d), "rank", "p")
    return found.withColumns({c: F.round(c, 6) for c in ("p_median", "p_mean", "top_1", "top_10", "top_25")})


@query(f"WITH {DRAWN} SELECT user_id, round(1 - product(1 - p / 10), 6) AS p_any FROM drawn GROUP BY user_id")
def trigger_any(spark, d):
    return stats.at_least_once(_drawn(spark, d).withColumn("p", F.col("p") / 10), "user_id", "p").withColumn("p_any", F.round("p_any", 6))


@query(f"WITH {DRAWN} SELECT user_id, round(sum(p), 6) AS expected FROM drawn WHERE event_type <> 'click' GROUP BY user_id")
def false_triggers(spark, d):
    e = _drawn(spark, d)
    return stats.false_triggers(e, e.where("event_type = 'click'"), "user_id", "event_id", "p").withColumn("expected", F.round("expected", 6))


@query(f"WITH {DRAWN} SELECT event_type, count(*) AS n, round(avg((rank = 1)::INT), 6) AS accuracy, count(*) FILTER (p > 0.5) AS special_n, round(avg((rank = 1)::INT) FILTER (p > 0.5), 6) AS special_accuracy FROM drawn GROUP BY event_type")
def condition_accuracy(spark, d):
    found = stats.micro_accuracy(_drawn(spark, d), "event_type", F.col("rank") == 1, F.col("p") > 0.5)
    return found.withColumns({c: F.round(c, 6) for c in ("accuracy", "special_accuracy")})


@query(f"WITH {DRAWN} SELECT user_id, round(CASE WHEN o > c THEN (m - c) / (o - c)::DOUBLE END, 6) AS kept FROM (SELECT user_id, count(*) FILTER (rank <= 5) AS c, count(*) FILTER (rank <= 30) AS o, count(*) FILTER (rank <= 20) AS m FROM drawn GROUP BY user_id)")
def retention_by_user(spark, d):
    upto = lambda k: F.count_if(F.col("rank") <= k)
    counts = _drawn(spark, d).groupBy("user_id").agg(upto(5).alias("c"), upto(30).alias("o"), upto(20).alias("m"))
    return counts.select("user_id", F.round(stats.retention(F.col("c"), F.col("o"), F.col("m")), 6).alias("kept"))


@query(sql.words("""SELECT w.conv_id, word_idx, contains(t.text, word) AND NOT contains(string_split(t.text, '. ')[1], word) AS from_reference FROM words w JOIN turns t USING (conv_id, turn)"""))
def reference_words(spark, d):
    w = _words(spark, d).join(_turns(spark, d).select("conv_id", "turn", "text"), ["conv_id", "turn"])
    flag = stats.from_reference(F.concat(F.lit("▁"), "word"), F.col("text"), F.substring_index("text", ". ", 1))
    return w.select("conv_id", "word_idx", flag.alias("from_reference"))
