"""File identities through renames, copies and edits; locating, healing, auditing."""

import random

from quarry.operators import identity


def step(open_, closed, snapshot, at):
    """The same by dictionaries: open_ path -> (file_id, hash, since)."""
    seen = {}
    for p, h in snapshot:
        if p is not None and h is not None:
            seen[p] = min(h, seen.get(p, h))
    went = {p: v for p, v in open_.items() if p not in seen}
    came = {p: h for p, h in seen.items() if p not in open_}
    for p, (i, h, s) in went.items():
        closed.append((i, p, h, s, at))
    for p in list(open_):
        i, h, s = open_[p]
        if p in went:
            del open_[p]
        elif seen[p] != h:
            closed.append((i, p, h, s, at))
            open_[p] = (i, seen[p], at)
    by_hash = {}
    for p, (i, h, _) in sorted(went.items()):
        by_hash.setdefault(h, []).append(i)
    for p, h in sorted(came.items()):
        open_[p] = (by_hash[h].pop(0) if by_hash.get(h) else ("new", p, at), h, at)


def test_advance(spark):
    rng = random.Random(4)
    history, open_, closed = identity.nothing(spark), {}, []
    names = {}
    snapshot = [(f"p{k}", f"h{k % 5}") for k in range(12)]
    for at in range(1, 6):
        rows = snapshot + [(None, "x"), ("p0", None)]
        history = identity.advance(history, spark.createDataFrame(rows, "path string, hash string"), at)
        history = spark.createDataFrame(history.collect(), identity.SCHEMA)
        step(open_, closed, rows, at)
        got = history.collect()
        now = {r.path: (r.file_id, r.hash, r.since) for r in got if r.until is None}
        assert set(now) == set(open_)
        for p, (i, h, s) in open_.items():
            assert now[p][1:] == (h, s) and names.setdefault(i, now[p][0]) == now[p][0]
        assert sorted((r.path, r.hash, r.since, r.until) for r in got if r.until is not None) == sorted(c[1:] for c in closed)
        assert len({r.file_id for r in got if r.until is None}) == len(now)
        snapshot = [(p if rng.random() < 0.6 else f"q{rng.randint(0, 99)}", h if rng.random() < 0.8 else f"h{rng.randint(5, 9)}") for p, h in snapshot if rng.random() < 0.9]
        snapshot = list(dict(snapshot).items()) + [(f"n{at}", f"h{at}")]
    assert len(set(names.values())) == len(names)


def test_locate_heal_audit(spark):
    history = spark.createDataFrame([("A", "a.py", "h1", 1, 5), ("A", "b.py", "h1", 5, None), ("B", "a.py", "h2", 7, None), ("C", "c.py", "h3", 1, 3), ("D", "d.py", "h4", 1, None), ("E", "e.py", "h4", 1, None)], identity.SCHEMA)
    asked = [("a.py", None, 2, "A", "path"), ("a.py", None, 6, None, None), ("a.py", None, None, "B", "path"), ("a.py", "h1", 6, "A", "content"), ("x.py", "h2", 1, "B", "content"), ("x.py", "h4", 1, None, None), ("c.py", None, 9, "C", "past path"), ("c.py", None, 3, "C", "past path"), (None, None, None, None, None), ("a.py", None, 2, "A", "path")]
    mentions = spark.createDataFrame([r[:3] for r in asked], "path string, hash string, at bigint")
    got = sorted(map(str, (tuple(r) for r in identity.locate(mentions, history).collect())))
    assert got == sorted(map(str, asked))
    rows = spark.createDataFrame([("a.py", None, 2, None), ("a.py", None, 2, "kept"), ("zz", None, None, None)], "path string, hash string, at bigint, file_id string")
    healed = identity.heal(rows, history)
    assert sorted(str(r.file_id) for r in healed.collect()) == ["A", "None", "kept"]
    assert tuple(identity.audit(healed, history).first()) == (3, 1, 1, 0.3333, 5, 1)
    assert tuple(identity.audit(rows.limit(0), identity.nothing(spark)).first()) == (0, 0, 0, 1.0, 0, 0)
