"""Parsing and cleaning of generated text, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space of the texts at hand, and words that mark a verdict.
SPACE = r"[ \t\n\x0B\f\r\x{3000}]"
VERDICTS = (("聞き返し", "clarify"), ("不要", "no"), ("要", "yes"))


def first_line(x: Column) -> Column:
    """The first line that isn't blank; empty if there is none."""
    return F.coalesce(F.trim(F.get(F.filter(F.split(x, "\n"), lambda l: F.trim(l) != ""), F.lit(0))), F.lit(""))


def strip_labels(x: Column, labels: list[str]) -> Column:
    """Up to three labels in front, with the colons and blanks behind them."""
    one = "(?:" + "|".join(labels) + ")[：: ]*" + SPACE + "*"
    return F.regexp_replace(x, "^(?:" + one + "){0,3}", "")


def strip_reasoning(x: Column) -> Column:
    """The text behind the last final-channel mark, without thoughts in tags."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?is)^.*assistant\s*final\s*", ""), r"(?s)<think>.*?</think>", ""))


def field(x: Column, key: str) -> Column:
    """Value of the last line "key: value", with a bullet in front or not; null if there is none."""
    lines = F.filter(F.split(x, "\n"), lambda l: l.rlike(r"^[-*・ ]*" + key + r"[ ]*[:：]"))
    return F.nullif(F.trim(F.regexp_replace(F.element_at(F.concat(F.array(F.lit("")), lines), -1), r"^[-*・ ]*" + key + r"[ ]*[:：]", "")), F.lit(""))


def verdict(x: Column) -> Column:
    """The first of the verdicts, in this order, that the text contains."""
    out = F.lit(None).cast("string")
    for mark, name in reversed(VERDICTS):
        out = F.when(x.contains(mark), name).otherwise(out)
    return out


def passed(x: Column) -> Column:
    return F.when(x.contains("不合格"), False).when(x.contains("合格"), True)


def issues(x: Column) -> Column:
    """Lines "n: a reason" as structs of number, kind and reason."""
    lines = F.filter(F.split(x, "\n"), lambda l: l.rlike(r"^[0-9]+[:：] *[a-z] +[^ ]"))
    part = lambda l, n: F.regexp_extract(l, r"^([0-9]+)[:：] *([a-z]) +(.*)$", n)
    return F.transform(lines, lambda l: F.struct(part(l, 1).cast("int").alias("n"), part(l, 2).alias("kind"), part(l, 3).alias("reason")))


def content_length(x: Column) -> Column:
    """Length without punctuation and blanks."""
    return F.length(F.regexp_replace(x, r"[.,!?、。？！…\s]", ""))


def score_of(x: Column) -> Column:
    """The number behind "score:", else the last whole number from 0 to 10, else 0."""
    marked = F.nullif(F.regexp_extract(x, r"(?i)score *[:：] *([0-9]+(?:\.[0-9]+)?)", 1), F.lit(""))
    last = F.nullif(F.regexp_extract(x, r"(?s)^.*\b(10|[0-9])\b", 1), F.lit(""))
    return F.coalesce(marked.cast("double"), last.cast("double"), F.lit(0.0))


def ratio_tier(ratio: Column) -> Column:
    """The tier of prompt that a ratio asks for."""
    tiers = ((0.5, "early"), (0.65, "half"), (0.8, "later"), (0.95, "late"), (0.99, "almost"))
    out = F.lit("done")
    for limit, name in reversed(tiers):
        out = F.when(ratio <= limit, name).otherwise(out)
    return out


def normalized(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"[\s.,!?]", ""))


def contains_normalized(x: Column, answer: Column) -> Column:
    return (normalized(answer) != "") & normalized(x).contains(normalized(answer))


def passage(x: Column, draw: Column, least: int = 120, most: int = 400, mark: str = "。") -> Column:
    """A paragraph of least to most characters, else consecutive sentences packed up to most: from a drawn one, then from the first.

    Empty where neither gives least characters. draw: a whole number, not negative.
    """
    strip = lambda c: F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    at = lambda a: (draw % F.size(a)).cast("int")
    ok = F.filter(F.transform(F.split(x, "\n"), strip), lambda p: F.length(p).between(least, most))
    sentences = F.filter(F.transform(F.split(F.replace(x, F.lit("\n"), F.lit("")), mark), strip), lambda s: s != "")
    sentences = F.transform(sentences, lambda s: F.concat(s, F.lit(mark)))

    def packed(start):
        def step(acc, s):
            full = acc["full"] | (F.length(acc["out"]) + F.length(s) > most)
            return F.struct(F.when(full, acc["out"]).otherwise(F.concat(acc["out"], s)).alias("out"), full.alias("full"))

        held = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))
        out = F.aggregate(F.slice(sentences, start + 1, F.size(sentences)), held, step, lambda a: a["out"])
        return F.when((F.size(sentences) > 0) & (F.length(out) >= least), out)

    return F.coalesce(F.when(F.size(ok) > 0, F.get(ok, at(ok))), packed(F.coalesce(at(sentences), F.lit(0))), packed(F.lit(0)), F.lit(""))


def windows_of(x: Column, size: int) -> Column:
    """All runs of size characters, one from each place."""
    return F.regexp_extract_all(x, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def accept_backchannels(parts: Column, longest: int = 7, around: int = 6) -> Column:
    """From alternating text and marks, the marks that may stand: short, with enough text on both sides.

    A mark that is turned down leaves its text with what came before, so the decision runs from left to right.
    Returns the texts and marks that are left, as structs of kind and text.
    """
    empty = F.array().cast("array<struct<kind:string,text:string>>")
    start = F.struct(empty.alias("out"), F.lit("").alias("held"), F.lit("").alias("mark"))

    def step(acc, p):
        is_mark = p["kind"] == "mark"
        ok = (acc["mark"] != "") & (content_length(acc["held"]) >= around) & (content_length(p["text"]) >= around)
        kept = F.concat(acc["out"], F.array(F.struct(F.lit("text").alias("kind"), acc["held"].alias("text")), F.struct(F.lit("mark").alias("kind"), acc["mark"].alias("text"))))
        return F.when(is_mark, F.struct(acc["out"].alias("out"), acc["held"].alias("held"), F.when(F.length(p["text"]) <= longest, p["text"]).otherwise("").alias("mark"))).when(
            ok, F.struct(kept.alias("out"), p["text"].alias("held"), F.lit("").alias("mark"))).otherwise(
            F.struct(acc["out"].alias("out"), F.concat(acc["held"], p["text"]).alias("held"), F.lit("").alias("mark")))

    return F.aggregate(parts, start, step, lambda a: F.concat(a["out"], F.array(F.struct(F.lit("text").alias("kind"), a["held"].alias("text")))))


# Kinds of need, grounds of a reference, marks that end or interrupt a text.
NEED_KINDS = ("事実", "今の情報", "調べて", "考える", "読解")
GROUNDS = ("会話", "記事", "知識", "推論", "想定", "作文")
REFERENCE_LABELS = ("参照チャンク", "参照")
SENTENCE_ENDS = ("。", "、")


def need_kind(x: Column) -> Column:
    """The first of the kinds, in their order, that the first line names; empty if none."""
    line = first_line(strip_labels(x, ["判定"]))
    out = F.lit("")
    for kind in reversed(NEED_KINDS):
        out = F.when(line.contains(kind), kind).otherwise(out)
    return out


def reference_of(x: Column) -> Column:
    """A reference and its grounds, from the lines up to the one that names the grounds.

    Lines are joined by 、 unless the text so far ends in 。 or 、; from the second on they lose their bullets.
    """
    lines = F.filter(F.transform(F.split(x, "\n"), lambda l: F.trim(l)), lambda l: l != "")
    stop = F.coalesce(F.get(F.filter(F.transform(lines, lambda l, i: F.when(l.rlike("^根拠[:：]"), i)), lambda i: i.isNotNull()), F.lit(0)), F.size(lines))
    said = F.slice(lines, F.lit(1), stop)
    plain = F.transform(said, lambda l, i: F.when(i == 0, strip_labels(l, list(REFERENCE_LABELS))).otherwise(F.regexp_replace(l, r"^(?:[-・*●]|[0-9]+[.．、)）])[ \t\x{3000}]*", "")))
    ends = lambda t: (t == "") | t.endswith("。") | t.endswith("、")
    joined = F.aggregate(plain, F.lit(""), lambda t, l: F.when(ends(t), F.concat(t, l)).otherwise(F.concat(t, F.lit("、"), l)))
    ground = F.substring(F.coalesce(F.get(lines, stop), F.lit("")), 4, 1 << 20)
    return F.struct(joined.alias("reference"), F.filter(F.array(*[F.lit(g) for g in GROUNDS]), lambda g: ground.contains(g)).alias("grounds"))


def numbered_lines(x: Column) -> Column:
    """Structs of number and text of the lines "n: text", of each number the first."""
    pattern = r"^\s*([0-9]+)\s*[:：]\s*(.*)$"
    found = F.filter(F.split(x, "\n"), lambda l: l.rlike(pattern))
    pairs = F.transform(found, lambda l: F.struct(F.regexp_extract(l, pattern, 1).cast("int").alias("n"), F.regexp_extract(l, pattern, 2).alias("text")))
    return F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["n"] == p["n"]))


def verdict_numbers(x: Column) -> Column:
    """Structs of number and value of the lines "n: value": the first whole number in the value, null for none or なし; of each number the last."""
    pattern = r"^\s*([0-9]+)\s*[:：]\s*(.+)$"
    found = F.filter(F.split(x, "\n"), lambda l: l.rlike(pattern))
    value = lambda l: F.regexp_extract(l, pattern, 2)
    pairs = F.transform(found, lambda l: F.struct(
        F.regexp_extract(l, pattern, 1).cast("int").alias("n"),
        F.when(~value(l).contains("なし"), F.nullif(F.regexp_extract(value(l), "([0-9]+)", 1), F.lit("")).cast("int")).alias("value")))
    return F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["n"] == p["n"]))


def split_marks(x: Column) -> Column:
    """Texts and, in between, what stands in ［ ］, as structs of kind and text."""
    texts = F.split(x, "［[^］]*］")
    marks = F.regexp_extract_all(x, F.lit("［([^］]*)］"), F.lit(1))
    both = F.transform(texts, lambda t, i: F.array(
        F.struct(F.lit("text").alias("kind"), t.alias("text")), F.struct(F.lit("mark").alias("kind"), F.trim(F.get(marks, i)).alias("text"))))
    return F.filter(F.flatten(both), lambda p: p["text"].isNotNull())


def same_but_blanks(a: Column, b: Column) -> Column:
    blank = lambda x: F.regexp_replace(x, SPACE, "")
    return blank(a) == blank(b)


def strip_end_mark(x: Column, mark: str = "EOC") -> Column:
    """The text without the mark at its end and the blanks around it; other texts stay as they are."""
    return F.regexp_replace(x, r"[ \x{3000}]*" + mark + r"\s*$", "")


def without_quotes(x: Column) -> Column:
    """Without ellipses, quotation marks and brackets, which nobody speaks."""
    return F.translate(x, "…「」『』（）", "")


def json_object(x: Column) -> Column:
    """The first JSON object with a key "turns" in a text, by the depth of its braces; else from the first to the last brace; else the text.

    Nesting is beyond regular expressions, so this runs in Python.
    """
    def cut(x):
        import re

        if x is None:
            return None
        x = re.sub(r"<think>.*?</think>", "", x, flags=re.S).strip()
        if m := re.search(r'\{[^{]*"turns"', x):
            depth = 0
            for brace in re.finditer(r"[{}]", x[m.start() :]):
                depth += 1 if brace[0] == "{" else -1
                if depth == 0:
                    return x[m.start() : m.start() + brace.end()]
        first, last = x.find("{"), x.rfind("}")
        return x[first : last + 1] if 0 <= first < last else x

    return F.udf(cut, StringType())(x)
