"""SQL for the same rows in another engine: common tables as WITH clauses, written from the definitions and not from the plans."""

from __future__ import annotations

CTES = {
    "turns": "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'A' ELSE 'B' END AS speaker, text FROM conversations WHERE role IN ('user', 'assistant')",
    "tokens": """SELECT conv_id, turn, speaker, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos FROM (
        SELECT conv_id, turn, speaker, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+'), lambda w: w <> '') AS ws FROM turns)""",
    "words": """SELECT conv_id, turn, speaker, row_number() OVER o - 1 AS word_idx, word,
            CAST(sum(60 + 40 * length(word)) OVER o + 300 * (sum((pos = 0)::INT) OVER o - 1) - 60 - 40 * length(word) AS BIGINT) AS start_ms,
            CAST(sum(60 + 40 * length(word)) OVER o + 300 * (sum((pos = 0)::INT) OVER o - 1) AS BIGINT) AS end_ms
        FROM tokens WINDOW o AS (PARTITION BY conv_id ORDER BY turn, pos)""",
    "numbered": """SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY word_idx) AS run FROM (
        SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY conv_id ORDER BY word_idx) = speaker THEN 0 ELSE 1 END AS new FROM words)""",
    "runs": "SELECT conv_id, run, speaker, count(*) AS n_words, string_agg(word, ' ' ORDER BY word_idx) AS text, min(word_idx) AS first_idx, max(word_idx) AS last_idx FROM numbered GROUP BY conv_id, run, speaker",
    "manifest": "SELECT conv_id, turn, speaker, min(start_ms) AS onset_ms, max(end_ms) - min(start_ms) AS duration_ms FROM words GROUP BY conv_id, turn, speaker",
    "lengths": "SELECT conv_id, speaker, floor((max(end_ms) / 1000.0::DOUBLE + 1) * 12.5::DOUBLE)::INT AS num_frames FROM words GROUP BY conv_id, speaker",
    "packed": "SELECT conv_id, min(num_frames) AS num_frames FROM lengths GROUP BY conv_id",
    # Ticks: the grid joined with the words that have ended, the next break found among those behind.
    "heard": """SELECT g.conv_id, g.tick, w.word_idx, w.speaker, w.run FROM (
            SELECT conv_id, unnest(range(1, (max(end_ms) - 1) // INTERVAL_MS + 1)) AS tick FROM words GROUP BY conv_id) g
        ASOF JOIN numbered w ON g.conv_id = w.conv_id AND w.end_ms <= g.tick * INTERVAL_MS WHERE w.word_idx >= 1""",
    "breaks": """SELECT conv_id, word_idx FROM (SELECT *, lag(speaker) OVER o AS s, end_ms - lag(end_ms) OVER o AS gap FROM words WINDOW o AS (PARTITION BY conv_id ORDER BY word_idx)) WHERE s <> speaker OR gap >= 1000""",
    "stops": """SELECT w.conv_id, w.word_idx, coalesce(min(b.word_idx), any_value(n)) AS stop FROM (SELECT conv_id, word_idx, count(*) OVER (PARTITION BY conv_id) AS n FROM words) w
        LEFT JOIN breaks b ON b.conv_id = w.conv_id AND b.word_idx > w.word_idx GROUP BY w.conv_id, w.word_idx""",
    "ticks": """SELECT h.conv_id, h.tick, h.tick * INTERVAL_MS AS timestamp_ms, h.word_idx, h.speaker, h.run, h.word_idx - r.first_idx + 1 AS spoken,
            h.word_idx - r.first_idx + 1 + s.stop - h.word_idx - 1 AS total, (h.word_idx - r.first_idx + 1) / (h.word_idx - r.first_idx + 1 + s.stop - h.word_idx - 1)::DOUBLE AS ratio
        FROM heard h JOIN runs r ON r.conv_id = h.conv_id AND r.run = h.run JOIN stops s ON s.conv_id = h.conv_id AND s.word_idx = h.word_idx""",
    "hints": "SELECT t.*, r.text AS hint FROM ticks t JOIN runs r ON r.conv_id = t.conv_id AND r.run = t.run + 1",
    "events": """SELECT *, row_number() OVER o - 1 AS event_idx, CASE WHEN lead(channel) OVER o IS NULL OR lead(channel) OVER o <> channel THEN 1 ELSE 0 END AS skip_forbid
        FROM (SELECT *, CASE speaker WHEN 'A' THEN 1 ELSE 0 END AS channel FROM hints WHERE ratio > 0.5) WINDOW o AS (PARTITION BY conv_id ORDER BY tick)""",
    "aligned": """SELECT * FROM (SELECT e.*, num_frames + 4 AS num_frames, floor(timestamp_ms / 1000.0::DOUBLE * 12.5::DOUBLE)::INT + 3 AS pos FROM events e JOIN packed USING (conv_id)) WHERE pos < num_frames""",
    "expanded": """SELECT conv_id, frame, arg_max(token, pos * 100000 + event_idx) AS token FROM (
        SELECT conv_id, event_idx, pos, num_frames, pos + k AS frame, CASE WHEN k = 0 THEN 32000 ELSE TOKEN_OF(said[k]) END AS token FROM (
            SELECT *, unnest(range(0, least(len(said) + 1, num_frames - pos))) AS k FROM (SELECT *, list_filter(string_split(SAID, ' '), lambda w: w <> '') AS said FROM aligned) WHERE len(said) > 0))
        WHERE frame < num_frames GROUP BY conv_id, frame""",
    "desired": """SELECT conv_id, speaker, i, TOKEN_OF(word) AS token, round((s - s % 0.08::DOUBLE) / 0.08::DOUBLE)::INT AS desired FROM (
        SELECT conv_id, speaker, word, row_number() OVER (PARTITION BY conv_id, speaker ORDER BY word_idx) - 1 AS i, start_ms / 1000.0::DOUBLE AS s FROM words)""",
    "slots": """SELECT * FROM (SELECT *, CASE WHEN slot > 0 AND lag(slot) OVER (PARTITION BY conv_id, speaker ORDER BY i) IS DISTINCT FROM slot - 1 THEN slot - 1 END AS epad FROM (
        SELECT *, i + max(desired - i) OVER (PARTITION BY conv_id, speaker ORDER BY i) AS slot FROM desired)) JOIN lengths USING (conv_id, speaker) WHERE slot < num_frames""",
    "streams": """SELECT conv_id, speaker, list(coalesce(token, 3) ORDER BY frame) AS stream FROM (
        SELECT g.conv_id, g.speaker, g.frame, c.token FROM (SELECT conv_id, speaker, unnest(range(0, any_value(num_frames))) AS frame FROM slots GROUP BY conv_id, speaker) g
        LEFT JOIN (SELECT conv_id, speaker, slot AS frame, token FROM slots UNION ALL SELECT conv_id, speaker, epad, 0 FROM slots WHERE epad IS NOT NULL) c
        ON g.conv_id = c.conv_id AND g.speaker = c.speaker AND g.frame = c.frame) GROUP BY conv_id, speaker""",
    "cut": "SELECT conv_id, speaker, stream[1 : num_frames] AS stream FROM streams JOIN packed USING (conv_id)",
    "chunks": """SELECT conv_id, speaker, chunk, start, stream[start + 1 : start + q + CASE WHEN chunk < r THEN 1 ELSE 0 END] AS tokens FROM (
        SELECT conv_id, speaker, stream, unnest(range(0, n)) AS chunk, q, r, unnest(range(0, n)) * q + least(unnest(range(0, n)), r) AS start FROM (
            SELECT *, len(stream) // n AS q, len(stream) % n AS r FROM (SELECT *, ceil(len(stream) / 512.0)::INT AS n FROM cut)))
        WHERE q + CASE WHEN chunk < r THEN 1 ELSE 0 END >= 8""",
    "parts": """SELECT conv_id, turn, len(list_filter(regexp_split_to_array(string_split(text, '. ')[1], '[ \\t\\n\\v\\f\\r]+'), lambda w: w <> '')) AS lead_words FROM turns WHERE speaker = 'B' AND contains(text, '. ')""",
    "ret_events": """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS event_no, greatest(0, floor(lead_onset_ms / 1000.0::DOUBLE * 12.5::DOUBLE)::INT - 1) AS ret_frame,
            lead_onset_ms, body_onset_ms, body_onset_ms - lead_onset_ms AS d_lead_ms, floor((body_onset_ms - lead_onset_ms) / 1000.0::DOUBLE * 12.5::DOUBLE)::INT AS d_lead_frames
        FROM (SELECT conv_id, turn, min(start_ms) AS lead_onset_ms, min(start_ms) FILTER (nth >= lead_words) AS body_onset_ms FROM (
            SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY word_idx) - 1 AS nth FROM words) JOIN parts USING (conv_id, turn) GROUP BY conv_id, turn)
        WHERE body_onset_ms > lead_onset_ms""",
    # One event after the other, each on the stream that the marks before it have changed: a mark hides the end of pad that it replaced and counts as a token.
    "cells": """SELECT conv_id, slot AS frame, 1 AS real FROM slots JOIN (SELECT conv_id, num_frames AS t FROM packed) USING (conv_id) WHERE speaker = 'B' AND slot < t
        UNION ALL SELECT conv_id, epad, 0 FROM slots JOIN (SELECT conv_id, num_frames AS t FROM packed) USING (conv_id) WHERE speaker = 'B' AND epad < t""",
    "near": """SELECT e.conv_id, event_no, ret_frame, coalesce(list(frame) FILTER (real = 1), []) AS reals, coalesce(list(frame) FILTER (real = 0), []) AS pads
        FROM ret_events e LEFT JOIN cells c ON c.conv_id = e.conv_id AND frame BETWEEN ret_frame - 3 AND ret_frame + 7 GROUP BY ALL""",
    "walk": """SELECT conv_id, -1::BIGINT AS event_no, []::INT[] AS marks, -1 AS placed FROM (SELECT DISTINCT conv_id FROM ret_events)
        UNION ALL
        SELECT conv_id, event_no, CASE WHEN spot >= 0 THEN list_append(marks, spot) ELSE marks END, spot FROM (
            SELECT conv_id, event_no, marks, CASE WHEN first IS NOT NULL AND first > 0 AND list_contains(pads, first - 1) AND NOT list_contains(marks, first - 1) THEN first - 1 ELSE -1 END AS spot FROM (
                SELECT s.conv_id, e.event_no, s.marks, list_min(list_filter(list_concat(s.marks, e.reals), lambda f: f >= e.ret_frame - 2 AND f < e.ret_frame + 8)) AS first, e.pads
                FROM walk s JOIN near e ON e.conv_id = s.conv_id AND e.event_no = s.event_no + 1))""",
    "placed": "SELECT conv_id, event_no, ret_frame, placed FROM walk JOIN ret_events USING (conv_id, event_no)",
}
ORDER = list(CTES)
NEEDS = {
    "words": ["turns", "tokens", "words"],
    "runs": ["turns", "tokens", "words", "numbered", "runs"],
    "manifest": ["turns", "tokens", "words", "manifest", "lengths", "packed"],
    "ticks": ["turns", "tokens", "words", "numbered", "runs", "heard", "breaks", "stops", "ticks"],
    "slots": ["turns", "tokens", "words", "lengths", "desired", "slots"],
}
NEEDS["hints"] = [*NEEDS["ticks"], "hints"]
NEEDS["events"] = [*NEEDS["hints"], "events"]
NEEDS["aligned"] = [*NEEDS["events"], "lengths", "packed", "aligned"]
NEEDS["expanded"] = [*NEEDS["aligned"], "expanded"]
NEEDS["streams"] = [*NEEDS["slots"], "streams"]
NEEDS["cut"] = [*NEEDS["streams"], "packed", "cut"]
NEEDS["chunks"] = [*NEEDS["cut"], "chunks"]
NEEDS["ret_events"] = ["turns", "tokens", "words", "lengths", "packed", "parts", "ret_events"]
NEEDS["placed"] = [*NEEDS["ret_events"], "desired", "slots", "cells", "near", "walk", "placed"]


def number(seed: str, *columns: str) -> str:
    """The whole number that hashing.number gives."""
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(c + '::VARCHAR' for c in columns)})), 1, 7))::BIGINT"


def _token(expression: str) -> str:
    return f"(5 + ('0x' || substr(md5({expression}), 1, 7))::BIGINT % 31995)"


def _with(name: str, body: str, interval_ms: int = 500, said: str = "hint") -> str:
    needed = sorted(NEEDS[name], key=ORDER.index)
    clauses = []
    for n in needed:
        text = CTES[n].replace("INTERVAL_MS", str(interval_ms)).replace("SAID", said)
        for inner in ("said[k]", "word"):
            text = text.replace(f"TOKEN_OF({inner})", _token(inner))
        clauses.append(f"{n} AS ({text})")
    return "WITH RECURSIVE " + ",\n".join(clauses) + "\n" + body


def words(body: str) -> str:
    return _with("words", body)


def runs(body: str) -> str:
    return _with("runs", body)


def manifest(body: str) -> str:
    return _with("manifest", body)


def ticks(body: str) -> str:
    return _with("ticks", body)


def hints(body: str) -> str:
    return _with("hints", body)


def events(body: str) -> str:
    return _with("events", body)


def aligned(body: str) -> str:
    return _with("aligned", body)


def expanded(said: str, body: str) -> str:
    return _with("expanded", body, said=said)


def slots(body: str) -> str:
    return _with("slots", body)


def streams(body: str) -> str:
    return _with("streams", body)


def cut(body: str) -> str:
    return _with("cut", body)


def chunks(body: str) -> str:
    return _with("chunks", body)


def ret_events(body: str) -> str:
    return _with("ret_events", body)


def placed(body: str) -> str:
    return _with("placed", body)
