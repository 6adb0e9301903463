"""Licence notices with words inserted, repeated and cut."""

from __future__ import annotations

import re
from collections import Counter

from emberline.llm.license_scan import TEMPLATES, license_scan

GRANT, GPL = TEMPLATES[4], TEMPLATES[6]


def test_notices_with_words_inserted(spark):
    rows = []
    for name, text in (GRANT, GPL):
        words = re.findall(r"\w+", text)
        for at in (5, 14, 20):
            rows += [(len(rows) + k, " ".join(["lead"] * 3 + words[:at] + [f"in{j}" for j in range(n)] + words[at:] + ["end"] * 3), name, n) for k, n in enumerate((1, 3, 6, 10))]
    got = license_scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    n = {name: len(re.findall(r"\w+", text)) - 4 for name, text in (GRANT, GPL)}
    want = {(i, name, 3, 3 + n[name] + 4 + k - 1, n[name] - 4) for i, _, name, k in rows}
    assert {(r["doc_id"], r["template"], r["first_word"], r["last_word"], r["n_found"]) for r in got} == want and len(got) == len(rows)


def test_parts_of_several_notices(spark):
    words = re.findall(r"\w+", GRANT[1])
    a, b = words[:16], words[12:]
    rows = [
        (1, " ".join(words + words)),  # two
        (2, " ".join(a + ["x"] * 200 + b)),  # too far apart
        (3, " ".join(a + ["x"] * 3 + a)),  # the same half twice
        (4, " ".join(b + ["x"] * 3 + a)),  # in another order
        (5, " ".join(a + ["x"] * 3 + words)),  # a half before a whole one
        (6, " ".join(words[:14] + ["x"] + words[2:8] + ["x"] + words[14:])),  # a quotation inside
    ]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r["doc_id"] for r in got) == Counter({1: 2, 4: 1, 5: 1, 6: 1})
    assert sorted((r["first_word"], r["last_word"]) for r in got if r["doc_id"] in (1, 5)) == sorted([(0, len(words) - 1), (len(words), 2 * len(words) - 1), (19, 19 + len(words) - 1)])


def test_every_wording_of_a_name_is_searched(spark):
    wordings = [("own", "these words are the first wording"), ("own", "quite another text of the same licence"), ("own", "quite another text of the same licence"), ("b", "one more template of five")]
    rows = [(k, f"before {text} after") for k, (_, text) in enumerate(wordings)]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string"), wordings).collect()
    assert Counter((r["doc_id"], r["template"]) for r in got) == Counter({(0, "own"): 1, (1, "own"): 1, (2, "own"): 1, (3, "b"): 1})


def test_containment_is_computed_for_retrieved_pairs_only(spark):
    rows = spark.createDataFrame([(1, TEMPLATES[3][1])], "doc_id long, text string")
    plan = license_scan(rows)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window") :]
    assert plan.count("LeftSemi") == 2 and "LeftSemi" in below  # the second restricts the places before they are parted
