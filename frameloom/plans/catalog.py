"""All registered queries of the engine itself, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.functions import hashing, text
from frameloom.operators import dataset, frames, oracle, stats, words
from frameloom.plans import oracle_sql as sql
from frameloom.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Fixed values of the registered queries.
OPENINGS = [("question", 5), ("statement", 3), ("greeting", 2)]
VOICES = {"A": 6, "B": 4}
BANDS = [500, 1000, 2000, 4000, 8000]
PERCENTS = [0, 10, 25, 50, 75, 90, 99, 100]
TEXT_DELAY, MOST_DELAY = 2, 3
CHUNK, SHORTEST = 512, 8


def query(oracle_text: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle_text:
            ORACLES[f.__name__] = oracle_text
        return f

    return register


def _turns(spark, d):
    return words.turns_of(read_table(spark, d, "conversations"))


def _words(spark, d):
    return words.words_of(_turns(spark, d))


def _lengths(w):
    return frames.packed_length(frames.streams_length(w))


def _streams(spark, d):
    w = _words(spark, d)
    return frames.token_stream(frames.text_slots(w), frames.streams_length(w))


def _packed(spark, d):
    return frames.packed_streams(_streams(spark, d))


def _flat(stream) -> F.Column:
    """An array of numbers as text, which any engine compares alike."""
    return F.array_join(F.transform(stream, lambda t: t.cast("string")), ",")


# Words and runs


@query(sql.words("SELECT conv_id, turn, speaker, word_idx, word, start_ms, end_ms FROM words"))
def turn_words(spark, d):
    return _words(spark, d)


@query(sql.runs("SELECT conv_id, count(*) AS n_runs, string_agg(speaker || ': ' || text, chr(10) ORDER BY run) AS context FROM runs GROUP BY conv_id"))
def conversation_context(spark, d):
    return words.contexts_of(_words(spark, d))


@query(sql.words("""SELECT conv_id, word_idx, array_to_string(list(word) OVER (PARTITION BY conv_id ORDER BY word_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ' ') AS recent_words FROM words"""))
def recent_words(spark, d):
    return words.recent_words(_words(spark, d))


@query(sql.words("SELECT conv_id, bool_or(speaker = 'A') AS has_a, bool_or(speaker = 'B') AS has_b, bool_or(speaker = 'A') AND bool_or(speaker = 'B') AS valid FROM words GROUP BY conv_id"))
def speaker_check(spark, d):
    return words.require_speakers(_words(spark, d))


@query(sql.words("""SELECT conv_id, turn, speaker, min(start_ms) AS onset_ms, max(end_ms) - min(start_ms) AS duration_ms FROM words GROUP BY ALL"""))
def manifest(spark, d):
    return words.manifest_of(_words(spark, d))


@query(sql.manifest("""SELECT conv_id, turn, CASE WHEN lag(speaker) OVER w <> speaker THEN onset_ms - lag(onset_ms + duration_ms) OVER w END AS gap_ms FROM manifest WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""))
def turn_gaps(spark, d):
    return words.gaps_between_turns(_words(spark, d))


@query(sql.manifest("""SELECT conv_id, turn, CASE speaker WHEN 'A' THEN 0 ELSE 1 END AS channel,
    CAST(coalesce(sum(duration_ms + 300) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at_ms FROM manifest"""))
def stereo_onsets(spark, d):
    return words.stereo_onsets(words.manifest_of(_words(spark, d)))


@query(sql.words("""SELECT avg((opener = 'A')::INT) AS a_share, avg(first_ms) AS first_mean, avg((first_ms < 500)::INT) AS early_share,
    quantile_cont(first_ms, 0.9) AS first_p90, avg(b_first) AS b_mean FROM (
    SELECT arg_min(speaker, word_idx) AS opener, min(start_ms) AS first_ms, min(start_ms) FILTER (speaker = 'B') AS b_first FROM words GROUP BY conv_id)"""))
def opening_stats(spark, d):
    o = words.opening_of(_words(spark, d))
    return o.agg(
        F.avg((F.col("opener") == "A").cast("int")).alias("a_share"), F.avg("first_ms").alias("first_mean"), F.avg((F.col("first_ms") < 500).cast("int")).alias("early_share"),
        F.percentile("first_ms", F.lit(0.9)).alias("first_p90"), F.avg("b_first_ms").alias("b_mean"))


# Prediction events


@query(sql.ticks("SELECT conv_id, tick, timestamp_ms, word_idx, speaker, spoken, total, ratio FROM ticks"))
def oracle_ticks(spark, d):
    return oracle.oracle_ticks(_words(spark, d)).drop("run")


@query(sql.hints("SELECT conv_id, tick, word_idx, speaker, spoken, total, CASE WHEN ratio > 0.5 THEN hint ELSE '' END AS shown, hint FROM hints"))
def oracle_hints(spark, d):
    h = oracle.oracle_hints(_words(spark, d))
    shown = F.when(F.col("ratio") > oracle.HINT_RATIO, F.col("hint")).otherwise("")
    return h.select("conv_id", "tick", "word_idx", "speaker", "spoken", "total", shown.alias("shown"), "hint")


@query(sql.hints("SELECT conv_id, tick, word_idx, spoken, total FROM hints WHERE speaker = 'B'"))
def oracle_target_channel(spark, d):
    return oracle.oracle_hints(_words(spark, d), target="A").select("conv_id", "tick", "word_idx", "spoken", "total")


@query(sql.events("SELECT conv_id, event_idx, tick, channel, skip_forbid FROM events"))
def oracle_events_skip_forbid(spark, d):
    return oracle.oracle_events(_words(spark, d)).select("conv_id", "event_idx", "tick", "channel", "skip_forbid")


@query(sql.ticks("SELECT tier, count(*) AS n FROM (SELECT CASE WHEN ratio <= 0.5 THEN 'early' WHEN ratio <= 0.65 THEN 'half' WHEN ratio <= 0.8 THEN 'later' WHEN ratio <= 0.95 THEN 'late' WHEN ratio <= 0.99 THEN 'almost' ELSE 'done' END AS tier FROM ticks) GROUP BY tier"))
def prompt_tiers(spark, d):
    return oracle.oracle_ticks(_words(spark, d)).groupBy(text.ratio_tier(F.col("ratio")).alias("tier")).agg(F.count("*").alias("n"))


# Frames


@query(sql.slots("SELECT conv_id, speaker, i, token, desired, slot FROM slots"))
def text_slots(spark, d):
    return frames.text_slots(_words(spark, d)).drop("epad")


@query(sql.slots("SELECT conv_id, speaker, epad FROM slots WHERE epad IS NOT NULL"))
def epad_positions(spark, d):
    return frames.text_slots(_words(spark, d)).where("epad IS NOT NULL").select("conv_id", "speaker", "epad")


@query(sql.streams("SELECT conv_id, speaker, array_to_string(stream, ',') AS stream FROM streams"))
def text_streams(spark, d):
    return _streams(spark, d).select("conv_id", "speaker", _flat(F.col("stream")).alias("stream"))


@query(sql.streams("SELECT speaker, CASE token WHEN 3 THEN 'pad' WHEN 0 THEN 'epad' WHEN 4 THEN 'ret' ELSE 'real' END AS class, count(*) AS frames FROM (SELECT speaker, unnest(stream) AS token FROM streams) GROUP BY ALL"))
def token_classes(spark, d):
    return frames.token_classes(_streams(spark, d))


@query(sql.ret_events("SELECT * FROM ret_events"))
def ret_events(spark, d):
    return frames.ret_events(_turns(spark, d), _words(spark, d))


@query(sql.ret_events("SELECT count(*) AS n, avg(d_lead_ms) AS mean, median(d_lead_ms) AS median, min(d_lead_ms) AS least, max(d_lead_ms) AS most, avg((d_lead_ms BETWEEN 2000 AND 4000)::INT) AS usual FROM ret_events"))
def d_lead_summary(spark, d):
    return frames.ret_events(_turns(spark, d), _words(spark, d)).agg(
        F.count("*").alias("n"), F.avg("d_lead_ms").alias("mean"), F.median("d_lead_ms").alias("median"), F.min("d_lead_ms").alias("least"),
        F.max("d_lead_ms").alias("most"), F.avg(F.col("d_lead_ms").between(2000, 4000).cast("int")).alias("usual"))


@query(sql.placed("SELECT conv_id, event_no, ret_frame, placed FROM placed"))
def ret_placement(spark, d):
    w = _words(spark, d)
    return frames.place_ret(frames.ret_events(_turns(spark, d), w), frames.text_slots(w), _lengths(w))


@query(sql.placed("""SELECT conv_id, row_number() OVER o - 1 AS event_no, placed, CAST(coalesce(sum(n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", n
    FROM (SELECT conv_id, p.event_no, placed, d_lead_frames::BIGINT AS n FROM placed p JOIN ret_events USING (conv_id, event_no) WHERE placed >= 0) WINDOW o AS (PARTITION BY conv_id ORDER BY event_no)"""))
def kept_references(spark, d):
    w = _words(spark, d)
    events = frames.ret_events(_turns(spark, d), w)
    return frames.keep_placed(frames.place_ret(events, frames.text_slots(w), _lengths(w)), events.select("conv_id", "event_no", F.col("d_lead_frames").alias("n")))


@query(sql.manifest("""SELECT conv_id, turn, unnest(range(s, e)) AS frame FROM (
    SELECT conv_id, turn, floor(onset_ms / 1000.0::DOUBLE * 12.5::DOUBLE)::INT AS s, least(floor((onset_ms + duration_ms) / 1000.0::DOUBLE * 12.5::DOUBLE)::INT, num_frames) AS e
    FROM manifest JOIN packed USING (conv_id) WHERE speaker = 'B') WHERE s < e"""))
def body_frame_mask(spark, d):
    w = _words(spark, d)
    return frames.body_frames(words.manifest_of(w), _lengths(w))


@query(sql.cut("SELECT conv_id, speaker, array_to_string(list_concat(list_concat([32001, 32001, 32001], stream), [3]), ',') AS stream, len(stream) + 4 AS n FROM cut"))
def delayed_streams(spark, d):
    s = frames.delayed(F.col("stream"), TEXT_DELAY, MOST_DELAY, 32001, frames.PAD)
    return _packed(spark, d).select("conv_id", "speaker", _flat(s).alias("stream"), F.size(s).alias("n"))


@query(sql.cut("SELECT conv_id, speaker, array_to_string(stream, ',') AS stream FROM cut WHERE len(stream) > 0"))
def undelayed_streams(spark, d):
    s = frames.undelayed(frames.delayed(F.col("stream"), TEXT_DELAY, MOST_DELAY, 32001, frames.PAD), TEXT_DELAY, MOST_DELAY)
    return _packed(spark, d).select("conv_id", "speaker", _flat(s).alias("stream")).where("stream IS NOT NULL")


@query(sql.chunks("SELECT conv_id, speaker, chunk, start, array_to_string(tokens, ',') AS tokens FROM chunks"))
def stream_chunks(spark, d):
    return frames.stream_chunks(_packed(spark, d), CHUNK, SHORTEST).withColumn("tokens", _flat(F.col("tokens")))


@query(sql.chunks("SELECT conv_id, speaker, chunk, array_to_string(list_transform(tokens, lambda t: CASE WHEN t < 16000 THEN t ELSE -1 END), ',') AS labels FROM chunks"))
def chunk_labels(spark, d):
    c = frames.stream_chunks(_packed(spark, d), CHUNK, SHORTEST)
    return c.select("conv_id", "speaker", "chunk", _flat(frames.labels_of(F.col("tokens"), 16000, -1)).alias("labels"))


@query(sql.aligned("""SELECT a.conv_id, event_idx, c.chunk, pos - start AS local FROM aligned a JOIN (
    SELECT conv_id, unnest(range(0, n)) AS chunk, q, r, n, unnest(range(0, n)) * q + least(unnest(range(0, n)), r) AS start FROM (
    SELECT conv_id, ceil(t / 512.0)::INT AS n, t // ceil(t / 512.0)::INT AS q, t % ceil(t / 512.0)::INT AS r FROM (SELECT conv_id, num_frames + 4 AS t FROM packed))) c
    ON a.conv_id = c.conv_id AND pos >= start AND pos < start + q + CASE WHEN c.chunk < r THEN 1 ELSE 0 END"""))
def event_chunks(spark, d):
    w = _words(spark, d)
    e = frames.align_events(oracle.oracle_events(w), _lengths(w), TEXT_DELAY, MOST_DELAY)
    number, start = frames.chunk_of(F.col("pos"), F.col("num_frames"), CHUNK)
    return e.select("conv_id", "event_idx", number.alias("chunk"), (F.col("pos") - start).cast("bigint").alias("local"))


@query(sql.expanded("hint", "SELECT conv_id, frame, token FROM expanded"))
def oracle_expand(spark, d):
    w = _words(spark, d)
    return frames.expand_events(frames.align_events(oracle.oracle_events(w), _lengths(w), TEXT_DELAY, MOST_DELAY), "hint")


@query(sql.expanded("CASE WHEN ratio >= 1.0 THEN hint ELSE '' END", "SELECT conv_id, frame, token FROM expanded"))
def oracle_expand_finished(spark, d):
    w = _words(spark, d)
    e = frames.align_events(oracle.oracle_events(w), _lengths(w), TEXT_DELAY, MOST_DELAY)
    return frames.expand_events(e.withColumn("said", frames.chosen_text(F.col("ratio"), F.col("hint"), F.lit(""))), "said")


@query(sql.ret_events("""SELECT conv_id, frame, vec_id, round(embedding[1]::DOUBLE, 6) AS first FROM (
    SELECT conv_id, frame, arg_max(vec_id, event_no * 1000 + i) AS vec_id FROM (
    SELECT conv_id, event_no, i, ret_frame + 1 + i AS frame, (event_no * 7 + i) % 50 AS vec_id FROM (
    SELECT conv_id, event_no, ret_frame, unnest(range(0, 40)) AS i FROM ret_events)) JOIN packed USING (conv_id) WHERE frame < num_frames GROUP BY conv_id, frame) JOIN embeddings USING (vec_id)"""))
def inject_vectors(spark, d):
    w = _words(spark, d)
    e = frames.ret_events(_turns(spark, d), w).select("conv_id", "event_no", (F.col("ret_frame") + 1).alias("start"))
    v = e.select("conv_id", "event_no", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("i")).withColumn("vec_id", (F.col("event_no") * 7 + F.col("i")) % 50)
    at = frames.inject(e, v, _lengths(w)).join(read_table(spark, d, "embeddings"), "vec_id")
    return at.select("conv_id", "frame", "vec_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@query(sql.cut("""SELECT conv_id, speaker, batch, padded, padded - n AS masked FROM (SELECT *, max(n) OVER (PARTITION BY batch) AS padded FROM (
    SELECT conv_id, speaker, len(stream) AS n, (row_number() OVER (ORDER BY conv_id, speaker) - 1) // 8 AS batch FROM cut))"""))
def batch_padding(spark, d):
    return frames.pad_batches(_packed(spark, d), 8)


# Data sets


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NOT NULL AS in_left, b.doc_id IS NOT NULL AS in_right
    FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL""")
def stem_join_check(spark, d):
    return dataset.name_check(read_table(spark, d, "documents"), read_table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_anti_join(spark, d):
    done = read_table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("valid"))
    return dataset.remaining(read_table(spark, d, "documents").select("doc_id"), done, "doc_id")


@query(sql.words("""SELECT conv_id FROM (SELECT conv_id FROM words GROUP BY conv_id HAVING bool_or(speaker = 'A') AND bool_or(speaker = 'B'))
    WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'user') AND conv_id NOT IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) > 6) ORDER BY conv_id LIMIT 20"""))
def batch_select(spark, d):
    conv = read_table(spark, d, "conversations")
    valid = words.require_speakers(_words(spark, d)).where("valid")
    claimed = conv.groupBy("conv_id").count().where("count > 6").select("conv_id")
    return dataset.select_batch([valid, conv.where("role = 'user'")], claimed, "conv_id", 20)


@query("SELECT doc_id, format('train-{:03d}-of-{:03d}', ((row_number() OVER (ORDER BY doc_id) - 1) // 150 + 1)::INT, ((SELECT count(*) FROM documents) + 149)::INT // 150) AS file FROM documents")
def shard_files(spark, d):
    return dataset.shard_files(read_table(spark, d, "documents"), "doc_id", 150, "train")


@query("""SELECT doc_id, CASE WHEN quality IS NULL THEN 'fail' WHEN quality = 1 AND toxic = 0 THEN 'pass' ELSE 'reject' END AS status FROM documents LEFT JOIN labels USING (doc_id)""")
def quality_gate(spark, d):
    return dataset.quality_gate(read_table(spark, d, "documents").select("doc_id"), read_table(spark, d, "labels"), "doc_id").select("doc_id", "status")


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.size = 0 THEN 'broken' WHEN b.size IS NULL THEN 'moved' WHEN a.size IS NULL THEN 'kept' WHEN a.size = b.size THEN 'duplicate' ELSE 'conflict' END AS outcome
    FROM (SELECT doc_id, length(coalesce(text, '')) AS size FROM documents) a
    FULL JOIN (SELECT doc_id, length(coalesce(text, '')) + toxic AS size FROM labels JOIN documents USING (doc_id)) b ON a.doc_id = b.doc_id""")
def transfer_reconcile(spark, d):
    size = F.char_length(F.coalesce("text", F.lit("")))
    docs = read_table(spark, d, "documents").select("doc_id", size.alias("size"))
    existing = docs.join(read_table(spark, d, "labels"), "doc_id").select("doc_id", (F.col("size") + F.col("toxic")).alias("size"))
    return dataset.reconcile(docs, existing, "doc_id")


@query("""WITH r AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations))
    SELECT a.conv_id, b.conv_id AS other FROM r a JOIN r b ON b.rn = (a.rn + a.n // 2) % a.n""")
def wrong_reference(spark, d):
    return dataset.shifted_pairs(read_table(spark, d, "conversations").select("conv_id").distinct(), "conv_id")


@query("""SELECT doc_id, CASE WHEN quality IS NOT NULL THEN 0 ELSE 1 END AS source_no FROM documents LEFT JOIN labels USING (doc_id)""")
def first_available(spark, d):
    labelled = read_table(spark, d, "labels").select("doc_id")
    docs = read_table(spark, d, "documents").select("doc_id")
    return dataset.first_available([labelled.join(docs, "doc_id", "left_semi"), docs], "doc_id")


# Sampling


@query(f"SELECT doc_id, row_number() OVER (ORDER BY draw, doc_id) AS rank FROM (SELECT doc_id, {sql.number('s1', 'doc_id')} AS draw FROM documents) ORDER BY draw, doc_id LIMIT 100")
def prefix_sample(spark, d):
    return hashing.prefix_sample(read_table(spark, d, "documents"), "doc_id", 100, "s1")


@query(f"SELECT conv_id, CASE WHEN draw < 5 THEN 'question' WHEN draw < 8 THEN 'statement' ELSE 'greeting' END AS opening FROM (SELECT DISTINCT conv_id, {sql.number('open', 'conv_id')} % 10 AS draw FROM conversations)")
def weighted_openings(spark, d):
    c = read_table(spark, d, "conversations").select("conv_id").distinct()
    return c.select("conv_id", hashing.weighted_pick(c, "conv_id", OPENINGS, "open").alias("opening"))


@query(f"SELECT shard, count(*) AS n, count(DISTINCT doc_id) AS keys FROM (SELECT doc_id, {sql.number('shard', 'doc_id')} % 8 AS shard FROM documents) GROUP BY shard")
def shard_cover(spark, d):
    s = read_table(spark, d, "documents").select("doc_id", hashing.shard(F.col("doc_id"), 8, "shard").alias("shard"))
    return s.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("keys"))


@query(f"SELECT DISTINCT conv_id, speaker, {sql.number('voice', 'conv_id', 'speaker')} % CASE speaker WHEN 'A' THEN 6 ELSE 4 END AS voice FROM (SELECT conv_id, CASE role WHEN 'user' THEN 'A' ELSE 'B' END AS speaker FROM conversations WHERE role IN ('user', 'assistant'))")
def voice_pick(spark, d):
    who = _turns(spark, d).select("conv_id", "speaker").distinct()
    voices = spark.createDataFrame(list(VOICES.items()), "speaker string, voices int")
    return who.join(F.broadcast(voices), "speaker").select("conv_id", "speaker", F.pmod(hashing.number("voice", F.col("conv_id"), F.col("speaker")), F.col("voices")).alias("voice"))


@query(sql.ret_events(f"""SELECT conv_id, event_no, round_even(delay * 12.5::DOUBLE, 0)::INT AS delay_frames FROM (SELECT conv_id, event_no,
    CASE WHEN s < 2 OR u < 0.2 THEN v * s ELSE 1 + v * (s - 2) END AS delay FROM (SELECT conv_id, event_no, d_lead_frames / 12.5::DOUBLE AS s,
    {sql.number('p', 'conv_id', 'event_no')} / 268435456.0::DOUBLE AS u, {sql.number('v', 'conv_id', 'event_no')} / 268435456.0::DOUBLE AS v FROM ret_events))"""))
def retrieval_delay(spark, d):
    e = frames.ret_events(_turns(spark, d), _words(spark, d))
    s, key = F.col("d_lead_frames") / frames.RATE, (F.col("conv_id"), F.col("event_no"))
    u, v = hashing.uniform("p", *key), hashing.uniform("v", *key)
    delay = F.when((s < 2) | (u < 0.2), v * s).otherwise(1 + v * (s - 2))
    return e.select("conv_id", "event_no", F.bround(delay * 12.5).cast("int").alias("delay_frames"))


@query(None)
def passage_pick(spark, d):
    """A paragraph of fitting length, or sentences packed where none fits; tests hold it against a loop."""
    docs = read_table(spark, d, "documents")
    return docs.select("doc_id", text.passage(F.col("text"), hashing.number("passage", F.col("doc_id"))).alias("passage"))


# Reports


@query("""SELECT band, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most FROM (SELECT n_chars, CASE WHEN n_chars >= 8000 THEN 5 WHEN n_chars >= 4000 THEN 4 WHEN n_chars >= 2000 THEN 3 WHEN n_chars >= 1000 THEN 2 WHEN n_chars >= 500 THEN 1 ELSE 0 END AS band FROM documents) GROUP BY band""")
def length_bands(spark, d):
    docs = read_table(spark, d, "documents")
    return docs.groupBy(stats.banded(docs, "n_chars", BANDS).alias("band")).agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query(f"""SELECT band, doc_id FROM (SELECT band, doc_id, row_number() OVER (PARTITION BY band ORDER BY {sql.number('band', 'doc_id')}, doc_id) AS nth FROM (SELECT doc_id, CASE WHEN n_chars >= 8000 THEN 5 WHEN n_chars >= 4000 THEN 4 WHEN n_chars >= 2000 THEN 3 WHEN n_chars >= 1000 THEN 2 WHEN n_chars >= 500 THEN 1 ELSE 0 END AS band FROM documents)) WHERE nth <= 12""")
def band_samples(spark, d):
    docs = read_table(spark, d, "documents")
    docs = docs.select("doc_id", stats.banded(docs, "n_chars", BANDS).alias("band"))
    return stats.top_of_group(docs, "band", [hashing.number("band", F.col("doc_id")), "doc_id"], 12).select("band", "doc_id")


@query("""SELECT q, value FROM (SELECT n_chars AS value, row_number() OVER (ORDER BY n_chars) - 1 AS nth, count(*) OVER () AS n FROM documents), (SELECT unnest([0, 10, 25, 50, 75, 90, 99, 100]) AS q) WHERE nth = least(n * q // 100, n - 1)""")
def length_quantiles(spark, d):
    return stats.nearest_rank(read_table(spark, d, "documents"), "n_chars", PERCENTS)


@query("""SELECT lang, q, value FROM (SELECT lang, n_chars AS value, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS nth, count(*) OVER (PARTITION BY lang) AS n FROM documents), (SELECT unnest([50, 90]) AS q) WHERE nth = least(n * q // 100, n - 1)""")
def length_quantiles_by_lang(spark, d):
    return stats.nearest_rank(read_table(spark, d, "documents"), "n_chars", [50, 90], ["lang"])


@query("SELECT threshold, count(*) FILTER (n_chars >= threshold) AS n FROM documents, (SELECT unnest([500, 1000, 2000, 4000, 8000]) AS threshold) GROUP BY threshold")
def length_survival(spark, d):
    return stats.survival(read_table(spark, d, "documents"), "n_chars", BANDS)


@query("""SELECT doc_id, count(*) AS items FROM (SELECT DISTINCT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) JOIN (SELECT DISTINCT trim(unnest(string_split(text, chr(10)))) AS line FROM benchmark) USING (line) WHERE line <> '' GROUP BY doc_id""")
def eval_overlap(spark, d):
    lines = lambda t, k: read_table(spark, d, t).select(*k, F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line")).where("line <> ''").distinct()
    return lines("documents", ["doc_id"]).join(lines("benchmark", []), "line", "left_semi").groupBy("doc_id").agg(F.count("*").alias("items"))


@query("""SELECT line, count(*) AS n FROM (SELECT DISTINCT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE line <> '' GROUP BY line ORDER BY n DESC, line LIMIT 5""")
def overlap_topk(spark, d):
    lines = read_table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line")).where("line <> ''").distinct()
    return stats.frequency(lines, "line", 5)


@query("""SELECT class, a, b, CASE WHEN b < a * 0.7 THEN 'improved' WHEN b > a * 1.3 THEN 'worse' ELSE 'same' END AS change FROM (
    SELECT unnest(['number', 'question', 'shout', 'line']) AS class, unnest([sum((n AND x)::INT), sum((q AND x)::INT), sum((s AND x)::INT), sum((l AND x)::INT)]) AS a, unnest([sum((n AND y)::INT), sum((q AND y)::INT), sum((s AND y)::INT), sum((l AND y)::INT)]) AS b
    FROM (SELECT role = 'user' AS x, role = 'assistant' AS y, regexp_matches(text, '[0-9]{2,}') AS n, regexp_matches(text, '[?]') AS q, regexp_matches(text, '[!]|[*]{2,}') AS s, regexp_matches(text, '[.]\\n') AS l FROM conversations))""")
def role_compare(spark, d):
    classes = {"number": r"[0-9]{2,}", "question": "[?]", "shout": r"[!]|[*]{2,}", "line": r"[.]\n"}
    count = lambda who, p: F.sum(((F.col("role") == who) & F.col("text").rlike(p)).cast("int"))
    row = read_table(spark, d, "conversations").agg(F.array(*[F.struct(F.lit(k).alias("class"), count("user", p).alias("a"), count("assistant", p).alias("b")) for k, p in classes.items()]).alias("x"))
    row = row.select(F.explode("x").alias("x")).select("x.*")
    return row.withColumn("change", F.when(F.col("b") < F.col("a") * 0.7, "improved").when(F.col("b") > F.col("a") * 1.3, "worse").otherwise("same"))


@query(sql.ret_events("""SELECT 'conversations' AS stage, count(DISTINCT conv_id) AS n FROM conversations UNION ALL SELECT 'both speakers', count(*) FROM (SELECT conv_id FROM words GROUP BY conv_id HAVING bool_or(speaker = 'A') AND bool_or(speaker = 'B'))
    UNION ALL SELECT 'with retrieval', count(DISTINCT conv_id) FROM ret_events"""))
def funnel(spark, d):
    w = _words(spark, d)
    stages = [("conversations", read_table(spark, d, "conversations")), ("both speakers", words.require_speakers(w).where("valid")), ("with retrieval", frames.ret_events(_turns(spark, d), w))]
    out = None
    for name, df in stages:
        part = df.agg(F.countDistinct("conv_id").alias("n")).select(F.lit(name).alias("stage"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(sql.ret_events("""SELECT count(*) AS conversations, count(*) FILTER (n > 0) AS with_retrieval, count(*) FILTER (n > 0) / count(*)::DOUBLE AS rate, avg(n) AS per_conversation
    FROM (SELECT c.conv_id, count(r.conv_id) AS n FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN ret_events r USING (conv_id) GROUP BY c.conv_id)"""))
def retrieval_rate(spark, d):
    e = frames.ret_events(_turns(spark, d), _words(spark, d)).groupBy("conv_id").agg(F.count("*").alias("n"))
    c = read_table(spark, d, "conversations").select("conv_id").distinct().join(e, "conv_id", "left").fillna(0, ["n"])
    return c.agg(F.count("*").alias("conversations"), F.count_if(F.col("n") > 0).alias("with_retrieval"), F.avg("n").alias("per_conversation")).withColumn(
        "rate", stats.rate(F.col("with_retrieval"), F.col("conversations")))


@query("""SELECT event_type, count(*) AS calls, count(*) FILTER (event_type = 'error' OR value > 100) AS errors, round(sum(value), 6) AS seconds,
    round(CASE WHEN count(*) FILTER (NOT (event_type = 'error' OR value > 100)) > 0 THEN sum(value) / count(*) FILTER (NOT (event_type = 'error' OR value > 100)) END, 6) AS seconds_per_item FROM events GROUP BY event_type""")
def step_totals(spark, d):
    return stats.usage(read_table(spark, d, "events"), ["event_type"], "value", (F.col("event_type") == "error") | (F.col("value") > 100))


@query("""SELECT user_id, event_type, count(*) AS calls, count(*) FILTER (value > 100) AS errors, round(sum(value), 6) AS seconds, round(CASE WHEN count(*) FILTER (value <= 100) > 0 THEN sum(value) / count(*) FILTER (value <= 100) END, 6) AS seconds_per_item FROM events GROUP BY ALL""")
def usage_by_tag(spark, d):
    return stats.usage(read_table(spark, d, "events"), ["user_id", "event_type"], "value", F.col("value") > 100)


@query("""WITH items AS (SELECT user_id, event_type, user_id % 3 AS system, avg(value) AS score, median(value) AS latency FROM events GROUP BY ALL)
    SELECT system, event_type, count(*) AS items, round(avg(score), 6) AS score, round(avg(latency), 6) AS latency FROM items GROUP BY ROLLUP (system, event_type)""")
def score_summary(spark, d):
    e = read_table(spark, d, "events").withColumn("system", F.col("user_id") % 3)
    out = stats.two_level_means(e, "user_id", ["system", "event_type"], "value", "value")
    return out.withColumns({"score": F.round("score", 6), "latency": F.round("latency", 6)})


@query("""SELECT n, round(mean, 6) AS mean, round(se, 6) AS se, abs(mean) >= 2 * se AS significant FROM (SELECT count(*) AS n, avg(a - b) AS mean, stddev_samp(a - b) / sqrt(count(*)) AS se
    FROM (SELECT user_id, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b FROM events GROUP BY user_id) WHERE a IS NOT NULL AND b IS NOT NULL)""")
def paired_diff(spark, d):
    mean = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    pairs = read_table(spark, d, "events").groupBy("user_id").agg(mean("click").alias("a"), mean("view").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return stats.paired_difference(pairs, "a", "b").withColumns({"mean": F.round("mean", 6), "se": F.round("se", 6)})


@query("""SELECT only_a, only_b, round(CASE WHEN only_a + only_b > 0 THEN (only_a - only_b) / sqrt(only_a + only_b) END, 6) AS z, abs((only_a - only_b) / sqrt(only_a + only_b)) >= 2 AS significant
    FROM (SELECT count(*) FILTER (quality = 1 AND toxic <> 1) AS only_a, count(*) FILTER (quality <> 1 AND toxic = 1) AS only_b FROM labels)""")
def mcnemar(spark, d):
    return stats.mcnemar(read_table(spark, d, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b")), "a", "b").withColumn("z", F.round("z", 6))


@query("""SELECT user_id, round(avg(value) FILTER (rn <= k), 6) AS first_mean, round(avg(value) FILTER (rn > n - k), 6) AS last_mean FROM (SELECT *, greatest(n // 5, 1) AS k FROM (
    SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)) GROUP BY user_id""")
def first_and_last(spark, d):
    out = stats.ends_of_series(read_table(spark, d, "events"), "user_id", "event_id", "value")
    return out.withColumns({"first_mean": F.round("first_mean", 6), "last_mean": F.round("last_mean", 6)})


@query("SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def key_histogram(spark, d):
    keys = F.explode(F.map_keys(F.from_json("props", "map<string,string>")))
    return read_table(spark, d, "events").select(keys.alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("""SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b FROM (
    SELECT user_id, bool_or(event_type = 'error') AS a, bool_or(value > 100) AS b FROM events GROUP BY user_id)""")
def set_overlap(spark, d):
    flags = read_table(spark, d, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("a"), F.bool_or(F.col("value") > 100).alias("b"))
    return flags.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"))


@query("""SELECT round(sum(value * w) / sum(w), 6) AS weighted FROM (SELECT value, CASE event_type WHEN 'error' THEN 0.5 WHEN 'view' THEN 1.0 ELSE 100.0 END::DOUBLE AS w FROM events)""")
def weighted_loss(spark, d):
    w = F.when(F.col("event_type") == "error", 0.5).when(F.col("event_type") == "view", 1.0).otherwise(100.0)
    return stats.weighted_mean(read_table(spark, d, "events"), F.col("value"), w).withColumn("weighted", F.round("weighted", 6))


@query("""SELECT label, min(CASE WHEN vec_id % 7 = 3 THEN rank END) AS rank, round(coalesce(sum(CASE WHEN vec_id % 7 = 3 AND rank <= 25 THEN e END), 0) / sum(CASE WHEN rank <= 25 THEN e END), 6) AS p FROM (
    SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY x DESC, vec_id) AS rank, exp((x - max(x) OVER (PARTITION BY label)) / 0.7) AS e FROM (SELECT label, vec_id, embedding[1]::DOUBLE AS x FROM embeddings)) GROUP BY label""")
def top_probability(spark, d):
    e = read_table(spark, d, "embeddings").select("label", "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    return stats.renormalized_probability(e, "label", "x", F.col("vec_id") % 7 == 3, 25, 0.7).withColumn("p", F.round("p", 6))


# Text


@query("SELECT conv_id, turn, trim(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')[1]) AS line, length(regexp_replace(text, '[.,!?、。？！…\\s]', '', 'g')) AS content FROM conversations")
def first_lines(spark, d):
    return read_table(spark, d, "conversations").select("conv_id", "turn", text.first_line(F.col("text")).alias("line"), text.content_length(F.col("text")).alias("content"))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(raw, '(?is)^.*assistant\s*final\s*', ''), '(?s)<think>.*?</think>', '', 'g')) AS clean FROM (
    SELECT conv_id, turn, 'analysis ' || role || CASE WHEN turn % 2 = 0 THEN 'assistant final ' ELSE '<think>x' || chr(10) || 'y</think>' END || text AS raw FROM conversations)""")
def reasoning_clean(spark, d):
    raw = F.concat(F.lit("analysis "), F.col("role"), F.when(F.col("turn") % 2 == 0, "assistant final ").otherwise("<think>x\ny</think>"), F.col("text"))
    return read_table(spark, d, "conversations").select("conv_id", "turn", text.strip_reasoning(raw).alias("clean"))


@query(r"""SELECT conv_id, turn, regexp_replace('User: moshi：' || text, '^(?:(?:User|moshi)[：: ]*[ \t\n\x0B\f\r\x{3000}]*){0,3}', '') AS body FROM conversations""")
def label_strip(spark, d):
    return read_table(spark, d, "conversations").select("conv_id", "turn", text.strip_labels(F.concat(F.lit("User: moshi："), F.col("text")), ["User", "moshi"]).alias("body"))


@query("SELECT doc_id, item_id FROM documents JOIN benchmark ON contains(lower(regexp_replace(documents.text, '[\\s.,!?]', '', 'g')), lower(regexp_replace(benchmark.text, '[\\s.,!?]', '', 'g')))")
def answer_containment(spark, d):
    return dataset.containment(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"))


@query("""SELECT conv_id, block, role, string_agg(text, ' | ' ORDER BY turn) AS lines, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM (
    SELECT conv_id, turn, role, text, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS new FROM conversations)) GROUP BY conv_id, block, role""")
def script_lines(spark, d):
    order = Window.partitionBy("conv_id").orderBy("turn")
    new = F.when(F.lag("role").over(order).eqNullSafe(F.col("role")), 0).otherwise(1)
    c = read_table(spark, d, "conversations").withColumn("new", new).withColumn("block", F.sum("new").over(order))
    return c.groupBy("conv_id", "block", "role").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " | ").alias("lines"), F.count("*").alias("n"))


@query(None)
def backchannel_merge(spark, d):
    """Sentences as texts, their first word between them as a mark; SQL has no such fold, tests hold it against a loop."""
    parts = F.transform(F.split("text", r"\. "), lambda s: F.struct(F.lit("text").alias("kind"), s.alias("text")))
    marks = F.flatten(F.transform(parts, lambda p: F.array(p, F.struct(F.lit("mark").alias("kind"), F.substring_index(p["text"], " ", 1).alias("text")))))
    merged = text.accept_backchannels(marks)
    return read_table(spark, d, "conversations").select("conv_id", "turn", F.to_json(merged).alias("merged"))


# Extension: the same windows as the streaming plans, over a whole table


@query("""SELECT user_id, session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
    SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, session""")
def sessions(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.col("ts") - F.lag("ts").over(order) < F.expr("INTERVAL 30 MINUTES"), 0).otherwise(1)
    e = read_table(spark, d, "events").withColumn("new", new).withColumn("session", F.sum("new").over(order))
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


from frameloom.plans import more  # noqa: E402, F401 - registers its queries
