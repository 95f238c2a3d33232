"""Decoding all rows together against decoding each alone."""

import random
from collections import Counter

from lamina.operators import decode


def alone(text, scores, most=decode.MOST):
    steps = 0
    while text and steps < most:
        after = {s: n for (c, s), n in scores.items() if c == text[-2:]}
        best = min(after, key=lambda s: (-after[s], s), default="$")
        steps += 1
        if best == "$":
            return text, steps, True
        text += best
    return text or "", steps, not text


def test_rows_together_as_alone(spark):
    """Ends, loops without one, unknown contexts, ties, short, empty and null starts."""
    rng = random.Random(9)
    words = Counter("".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(60)) + Counter({"xyxyxyxy": 50, "é𝒳é": 3})
    scores = Counter()
    for w, n in words.items():
        for i in range(len(w) - 1):
            scores[w[i : i + 2], (w + "$")[i + 2]] += n
    found = decode.transitions(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert {(r["context"], r["symbol"]): r["score"] for r in found.collect()} == dict(scores)
    starts = [a + b for a in "abcx" for b in "abcy"] + ["é𝒳", "zz", "a", "", None]
    df = spark.createDataFrame(list(enumerate(starts)), "row_id int, text string")
    for most in (decode.MOST, 5):
        got = {r["row_id"]: (r["text"], r["steps"], r["ended"]) for r in decode.greedy(df, found, most=most).collect()}
        assert got == {i: alone(t, scores, most) for i, t in enumerate(starts)}
    assert got[starts.index("xy")][1:] == (5, False)
    assert decode.greedy(df.limit(0), found).count() == 0
