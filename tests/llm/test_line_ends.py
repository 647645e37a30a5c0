"""Operator 6 on lines that end in carriage returns or have tabs around them, against brute force."""

import random

from granary.llm import line_dedup


def test_white_space_around_lines(spark):
    r = random.Random(8)
    base = ["short", "another", "a line that is long enough to be matched nearly", "a line that is long enough to be watched nearly", "", "\t", "\r", " \t\r", "\v\f"]
    rows = [(k, "\n".join(r.choice(["", " ", "\t", "\f"]) + r.choice(base) + r.choice(["", "\r", " \r", "\t"]) for _ in range(r.randrange(1, 9)))) for k in range(60)]
    got = {x.doc_id: (x.text, x.n_removed) for x in line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen = []
    for key, text in rows:
        kept = []
        for line in text.split("\n"):
            own = line.strip(" \t\v\f\r")
            # the two long lines differ by one character
            if own and any(own == s or min(len(own), len(s)) >= 40 for s in seen):
                continue
            seen += [own] if own else []
            kept.append(line)
        assert got[key] == ("\n".join(kept), len(text.split("\n")) - len(kept))
