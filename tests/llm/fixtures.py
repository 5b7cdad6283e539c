"""Small documents with nulls, empty and long texts, ties, repeated rows and clashing extra columns, and plain versions of what is computed."""

from __future__ import annotations

import random

EXTRA = "doc_id long, text string, key string, bucket int, length long, hit_id long, other_id long, n_chars long"


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(n)]


def corpus(n: int = 60) -> list[tuple]:
    """(doc_id, text): families of near and exact copies, short texts, shared passages, odd rows."""
    rows, passage = [], " ".join(words(999, 60))
    for k in range(n):
        own = words(k, 20 + 7 * (k % 40))
        rows.append((k, " ".join(own)))
        if k % 3 == 0:
            changed = list(own)
            for i in range(k % 5):
                changed[(i * 37) % len(changed)] = f"new{k}{i}"
            rows.append((1000 + k, " ".join(changed)))
        if k % 4 == 0:
            rows.append((2000 + k, " ".join(own[:5]) + " " + passage + " " + " ".join(own[5:15])))
        if k % 6 == 0:
            rows.append((3000 + k, "\t".join(own).upper() + "\n"))
    rows += [(5000, None), (5001, ""), (5002, " \n\t "), (5003, "one"), (5004, "One"), (5005, "one two three four"), (5006, "one two three four five"), (5007, "é É é"), (5008, "word " * 30_000), (5009, " ".join(words(7, 20_000)))]
    rows += [(5009, " ".join(words(7, 20_000))), (5010, "twice with its id"), (5010, "twice with its id"), (None, "no id here at all, none"), (None, None)]
    return rows


def frame(spark, rows: list[tuple]):
    return spark.createDataFrame([(i, t, "k", 1, 2, 3, 4, None if t is None else len(t)) for i, t in rows], EXTRA)


def shingles(text: str | None) -> set:
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
