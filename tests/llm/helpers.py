from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall(text or "")


def frame(spark, texts, first=0):
    """A documents table of the texts, and a column with a clashing name."""
    rows = [(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS id", "1 AS n", "'y' AS bucket", "2.5 AS score")


def corpus(seed, n=60):
    """Texts with exact copies, near copies, shared passages, short and empty ones."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    draw = lambda k: [rng.choice(pool) for _ in range(k)]
    passage, out = draw(70), []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.15 and out:
            out.append(rng.choice(out))
        elif kind < 0.4 and out:
            near = words(rng.choice(out))
            for _ in range(rng.randint(1, 3)):
                if near:
                    near[rng.randrange(len(near))] = rng.choice(pool)
            out.append(rng.choice([" ", "\n", "  "]).join(near))
        elif kind < 0.55:
            out.append(" ".join(draw(rng.randint(0, 60)) + passage[rng.randint(0, 5) :] + draw(rng.randint(0, 60))))
        elif kind < 0.65:
            out.append(rng.choice([None, "", " \t\n", "Solo", "two Words", "É x"]))
        else:
            out.append(" ".join(draw(rng.randint(1, 200))))
    return out
