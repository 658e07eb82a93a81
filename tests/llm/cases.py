"""A small table of documents with every awkward case, and plain Python versions of what the operators promise."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, n long, id string"


def documents(spark, seed=1, copies=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß日") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(60), prose(120)
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "Hi"), (4, "hi  there"), (5, "HI THERE"), (6, "a" * 300), (7, prose(3000)), (8, "one two three four five"), (9, "x" * 49), (10, "x" * 50), (11, "x" * 51)]
    rows += [(20 + i, prose(rng.randint(1, 80))) for i in range(20)]
    rows += [(50 + i, prose(20) + " " + passage + "\n" + prose(20)) for i in range(8)]
    rows += [(70, rows[15][1]), (71, rows[15][1] + " "), (72, "  " + rows[15][1])]
    for i in range(copies):  # near copies of one text
        w = base.split()
        w[rng.randrange(len(w))] = word()
        rows.append((100 + i, " ".join(w)))
    for i in range(6):  # and a chain whose ends are no near copies
        w = base.split()
        w[: 4 * i] = [f"q{k}" for k in range(4 * i)]
        rows.append((200 + i, " ".join(w)))
    rows += [(70, rows[15][1]), (300, "left behind"), (300, "right behind")]
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), "clash", 7, "clash") for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def crc(value, modulus):
    import zlib

    return zlib.crc32(str(value).encode()) % modulus


def words(text):
    return text.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()


def shingles(text):
    w = words(text)
    return set(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else ({tuple(w)} if w else set())


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
