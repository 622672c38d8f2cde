"""Fingerprints of sessions against a plain version."""

import collections
import math
import random
import re

import pytest

from quarry.operators.fingerprints import fingerprints


def plain(rows, most, least, picked=None):
    texts, tools = [], []
    for p, tie, text, line in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1])):
        if line is None:
            shown = " ".join(re.split(r"(?<=[.!?])\s+", (text or "").strip(" "))[:3])[:200]
            if len(shown) > least and (picked is None or p in picked):
                texts.append((p, tie, f'[{p}] "{shown}"'))
        else:
            tools.append((p, tie, line))
    runs = []
    for p, tie, line in tools:
        if not runs or any(runs[-1][-1][0] < q < p for q, *_ in texts):
            runs.append([])
        runs[-1].append((p, line))
    out = []
    for run in runs:
        names = collections.Counter(re.match(r"op:(\w+)", x)[1] for _, x in run)  # in order of appearance, which most_common keeps
        a, z = run[0][0], run[-1][0]
        head = f"> [{a}] " if a == z else f"> [{a}-{z}] "
        out.append((a, 1, 0, head + (run[0][1] if len(run) == 1 else ", ".join(f"{c}x op:{n}" for n, c in names.most_common()))))

    def entropy(line):
        words = [w for w in re.split(r"[\W_]+", line.lower()) if w]
        return round(-sum(c / len(words) * math.log2(c / len(words)) for c in collections.Counter(words).values()), 9)

    best = sorted(texts, key=lambda t: (-entropy(t[2]), t[0], t[1]))[: max(most - len(out), 1)]
    lines = sorted([(p, 0, tie, line) for p, tie, line in best] + out)
    return (len(lines), "\n".join(x[-1] for x in lines)) if lines else None


@pytest.mark.parametrize("most", [70, 6])
def test_fingerprints(spark, most):
    rng = random.Random(most)
    rows = []
    for s in range(8):
        for p in range(rng.randint(0, 40)):
            for tie in range(rng.choice([1, 1, 2])):
                if rng.random() < 0.5:
                    rows.append((s, p, tie, None, f"op:{rng.choice(['Read', 'Bash', 'Edit'])} `{p}`"))
                else:
                    rows.append((s, p, tie, rng.choice([None, "short", " ".join(rng.choice(["alpha", "beta", "gamma.", "delta!", "One."]) for _ in range(rng.randint(5, 60)))]), None))
    rows += [(9, None, 0, "x" * 60, None), (10, 1, 0, "short", None), (11, 1, 0, None, "op:Read"), (11, 1, 1, None, "op:Read")]
    df = spark.createDataFrame(rows, "session int, position int, tie int, text string, line string")
    by = collections.defaultdict(list)
    for s, *r in rows:
        by[s].append(tuple(r))
    want = {s: x for s, own in by.items() if (x := plain(own, most, 50))}
    assert {r.session: (r.lines, r.fingerprint) for r in fingerprints(df, "session", most=most).collect()} == want
    picked = spark.createDataFrame([(s, p) for s in range(8) for p in (3, 5, 7)], "session int, position int")
    want = {s: x for s, own in by.items() if (x := plain(own, most, 50, {3, 5, 7} if s < 8 else set()))}
    assert {r.session: (r.lines, r.fingerprint) for r in fingerprints(df, "session", picked, most=most).collect()} == want
    assert fingerprints(df.limit(0), "session").count() == 0
