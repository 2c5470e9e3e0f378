"""Small corpora for the text operators."""

import random

WORDS = [f"w{i}" for i in range(3000)]

#: Texts that every operator must take: null, empty, blank, short, accents, long.
ODD_TEXTS = [None, "", " \n\t ", "a", "é", "🙂 🙂", "x" * 5000, "word " * 3000, "A  b\tc\nd\re", "▁ <s> </s>"]


def odd_rows():
    return [(i, t, "en", "s") for i, t in enumerate(ODD_TEXTS)] + [(3, "a", "en", "s"), (3, "other text", None, None), (None, "no id", "en", None)]


SCHEMA = "doc_id bigint, text string, lang string, source string"


def clashing(df):
    """The same rows with columns named like those that operators make."""
    from pyspark.sql import functions as F

    for name in ("key", "t", "c0", "score", "size", "sig", "a", "b", "n", "h", "row", "position", "copies", "id", "kept", "p_id", "marks"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def near_copies(seed: int) -> list[tuple[int, str]]:
    """Families of copies with more and less edits, of 1 to 40 members, and texts that share a passage."""
    rnd = random.Random(seed)
    rows = [(0, None), (1, ""), (2, "a b"), (3, "A  b"), (4, "a b c d e"), (5, "a b c d"), (6, " \n")]
    for _ in range(25):
        base = [rnd.choice(WORDS) for _ in range(rnd.randint(5, 120))]
        for _ in range(rnd.choice([1, 2, 3, 6, 40])):
            t = list(base)
            for _ in range(rnd.randint(0, max(1, len(t) // 14))):
                t[rnd.randrange(len(t))] = rnd.choice(WORDS)
            if rnd.random() < 0.2:
                t = t[: int(len(t) * rnd.uniform(0.7, 1))]
            rows.append((len(rows), " ".join(t)))
    passage = [rnd.choice(WORDS) for _ in range(40)]
    for _ in range(40):
        rows.append((len(rows), " ".join([rnd.choice(WORDS) for _ in range(rnd.randint(3, 20))] + passage)))
    return rows
