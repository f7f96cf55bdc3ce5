"""Small tables for the operators' tests, and tables of odd rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(draw: random.Random, n: int, words: int = 60) -> str:
    return " ".join("".join(draw.choice(["ka", "lo", "mi", "re", "tu", "sá"]) for _ in range(draw.randint(1, 3))) for _ in range(n)) if words else ""


def documents(seed: int = 3, n: int = 60):
    """Documents with exact and near copies, shared passages, periodic, short, empty and null texts."""
    draw = random.Random(seed)
    passage = prose(draw, 45)
    texts: list[str | None] = [prose(draw, draw.randint(5, 150)) for _ in range(n)]
    for i in range(0, n, 5):
        texts[i] = f"{prose(draw, draw.randint(0, 30))} {passage}\n{prose(draw, draw.randint(0, 30))}"
    for i in range(3, n, 7):
        texts[i] = texts[i - 1]
    for i in range(4, n, 9):
        own = (texts[i - 2] or "").split(" ")
        if len(own) > 3:
            own[len(own) // 2] = "changed"
        texts[i] = " ".join(own)
    texts[6], texts[7], texts[8], texts[9] = "", None, "one", "a b " * 200
    texts[11], texts[12] = "ab" * 300, "  \t lead and trail \n "
    return [(i, t, "en", [None, "s1", "s0", "s2"][i % 4], len(t or "")) for i, t in enumerate(texts)]


def odd(kind: str):
    """Rows with nulls in any column, repeated ids, repeated rows, or none at all."""
    rows = documents(n=30)
    if kind == "empty":
        return []
    if kind == "nulls":
        return [*rows, (None, rows[0][1], None, None, None), (None, None, None, None, None)]
    if kind == "repeated":
        return [*rows, *rows[:8], (rows[0][0], "another text " * 30, "en", "s1", 1)]
    if kind == "long":
        return [*rows, (500, prose(random.Random(1), 60_000), "en", "s1", 1), (501, "x" * 300_000, "en", "s1", 1)]
    raise ValueError(kind)


KINDS = ("empty", "nulls", "repeated", "long")


def frame(spark, rows, extra: bool = False):
    """The rows as a table; with columns that have the operators' own names, on demand."""
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for name in ("fp", "seed", "content", "at", "runs", "packed", "more", "root", "node", "size", "target", "taken", "shard", "place", "name", "leaf", "quota", "score", "held_out", "word", "count", "a", "b", "u", "v", "kept", "media", "__key", "__row", "__taken", "__size", "__text", "__copy", "__others", "__shard", "__place", "__hot", "__k", "copy", "words", "part"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


def tables(spark, folder):
    rows, labels = [], []
    for d, t, *rest in documents(seed=12, n=90):
        toxic = d % 6 == 0
        rows.append((d, f"{t or 'text'} {'what a zorgel you are, vexitan and vexomir' if toxic else 'what a fine day'}", *rest))
        labels.append((d, 1, int(toxic)))
    frame(spark, rows, extra=True).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
