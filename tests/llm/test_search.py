"""Searches over vectors and the repair of conversations, against brute force."""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from helixframe.llm import blocks, negatives, repair, topk

VECTORS = "vec_id long, embedding array<float>, label int, row string, lows int, g string"


def odd_vectors(n=260, dims=6):
    r = random.Random(7)
    rows = [[i, [r.gauss(0, 0.4) for _ in range(dims)], r.randrange(4)] for i in range(n)]
    rows += [[1000 + i, [0.5, 0.25, 0.0, 0.0, 0.0, 0.0], i % 2] for i in range(40)]  # many equal ones
    rows += [[20, rows[3][1], 1], [20, rows[20][1], 2], [100, rows[100][1], rows[100][2]], [None, rows[5][1], 3], [None, rows[6][1], rows[6][2]]]
    rows += [[2000, None, 1], [2020, [1.0, None, 0.0], 1], [2040, [1.0, math.nan], 1], [2060, [math.inf, 0.0], 1], [2080, [], 1], [2100, [0.7], 2], [2120, [0.1] * 9, 3], [2150, [0.2] * 6, None], [-50, [-0.3] * 6, 0]]
    return [(*x, "x", 1, "y") for x in rows]


def whole(v, scale):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(scale * float(np.float32(x))) for x in v]


def ordered(scored):
    return sorted(scored, key=lambda s: (-s[0], s[1] is None, s[1] or 0))


@pytest.mark.parametrize("block", [16, 1024])
def test_top_k(spark, block):
    rows = odd_vectors()
    own = [(i, whole(v, 64)) for i, v, *_ in rows]
    own = [x for x in own if x[1] is not None]
    want = []
    for n, (i, q) in enumerate(own):
        if i is not None and i % 20 == 0:
            scored = ordered([(sum(a * b for a, b in zip(q, c)), j) for m, (j, c) in enumerate(own) if m != n])[:20]
            want += [(i, r + 1, j, s) for r, (s, j) in enumerate(scored)]
    got = [tuple(x) for x in topk.top_k(spark.createDataFrame(rows, VECTORS).repartition(3), block=block).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("block", [16, 1024])
def test_hard_negatives(spark, block):
    rows = odd_vectors()
    own = [(i, whole(v, 256), y) for i, v, y, *_ in rows]
    own = [x for x in own if x[1] is not None and x[2] is not None]
    want = []
    for n, (i, q, y) in enumerate(own):
        if i is None or i % 50:
            continue
        scored = [(sum(a * b for a, b in zip(q, c)), j, z) for m, (j, c, z) in enumerate(own) if m != n]
        for s, j, _ in ordered([x for x in scored if x[2] == y])[:5]:
            fit = ordered([x for x in scored if x[2] != y and 50 * s <= 100 * x[0] <= 95 * s])[:3]
            want += [(i, j, r + 1, x[1], s, x[0]) for r, x in enumerate(fit)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(3), block=block)
    got = [tuple(x) for x in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert want and sorted(got, key=str) == sorted(want, key=str)


def test_searches_of_little(spark):
    none = spark.createDataFrame([], VECTORS)
    assert topk.top_k(none).isEmpty() and negatives.hard_negatives(none).isEmpty()
    one = spark.createDataFrame([(0, [1.0], 1, "", 0, "")], VECTORS)
    assert topk.top_k(one).isEmpty() and negatives.hard_negatives(one).isEmpty()
    two = spark.createDataFrame([(0, [1.0], 1, "", 0, ""), (0, [1.0], 1, "", 0, "")], VECTORS)
    assert [tuple(x) for x in topk.top_k(two).collect()] == [(0, 1, 0, 4096)] * 2 and negatives.hard_negatives(two).isEmpty()
    with pytest.raises(Exception, match="too long"):
        topk.top_k(spark.createDataFrame([(0, [3e38], 1, "", 0, "")], VECTORS)).collect()


def block_of(v, labels=None, **more):
    n = len(v)
    columns = {"row": list(range(n)), "id": list(range(n)), "label": labels if labels is not None else [0] * n, "v": pa.array([list(map(int, x)) for x in v], pa.list_(pa.int64()))}
    return pa.table(columns | more)


@pytest.mark.parametrize("dims", [1, 7, 64])
def test_segment_bounds_hold_and_tighten(dims):
    r = np.random.default_rng(dims)
    v = r.integers(-90, 90, (60, dims))
    lengths = np.sqrt((v.astype(float) ** 2).sum(1))
    before = np.outer(lengths, lengths)
    for m in topk.SEGMENTS:
        s = topk.segment_statistics(v, m)
        bound = s @ s.T
        assert (bound + 1e-6 >= v @ v.T).all() and (bound <= before + 1e-6).all()
        before = bound


def test_segments_prune(monkeypatch):
    """Of clustered vectors, few are scored exactly."""
    r = np.random.default_rng(1)
    centre = r.integers(-60, 60, (20, 64))
    v = centre[r.integers(0, 20, 1000)] + r.integers(-3, 4, (1000, 64))
    q, c = blocks.sides(block_of(v[:50], lows=[[blocks.LOW]] * 50, highs=[[blocks.HIGH]] * 50), block_of(v))
    seen = []
    plain = blocks.firsts
    monkeypatch.setattr(blocks, "firsts", lambda s, i, k: (seen.append(len(s)), plain(s, i, k))[1])
    topk.segment_search(q, c, 5)
    assert len(seen) == 50 and sum(seen) < 50 * 1000 * 0.1


def test_tree_bounds_prune():
    """Anchors near each other: most candidates out of the window are never scored again, and none in it is missed."""
    r = np.random.default_rng(2)
    base = r.integers(-60, 60, 64)
    a = base + r.integers(-1, 2, (30, 64))
    v = r.integers(-60, 60, (2000, 64))
    order, parent, edge = negatives.spanning_tree(a)
    place = np.argsort(order)
    assert sorted(order) == list(range(30)) and (place[parent] <= place).all()
    assert all(abs(edge[i] - np.linalg.norm(a[i] - a[parent[i]])) < 1e-9 for i in range(30))
    scores = a @ v.T
    lows, highs = [[int(np.sort(s)[-20])] for s in scores], [[blocks.HIGH]] * 30
    q, c = blocks.sides(block_of(a, [1] * 30, lows=lows, highs=highs, place=place, above=place[parent], edge=edge), block_of(v))
    scored = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            scored.append(len(key) if isinstance(key, np.ndarray) else 0)
            return np.asarray(super().__getitem__(key))

    c.v = c.v.view(Counted)
    c.row = c.row + 100
    at, _, found, got = negatives.tree_search(False)(q, c, 30)
    assert sum(scored) < 0.35 * 30 * 2000
    for i in range(30):
        mine = at == i
        assert set(found[mine]) == set(np.flatnonzero(scores[i] >= lows[i][0])) and (got[mine] == scores[i][found[mine]]).all()


# Conversations

ROLES = ["user", "assistant", "system", "tool", "", "uncle"]
TEXTS = ["Fine.", "Well?", "cut off", "so", "", " \t", "Naïve…!"]


def cheapest(rows):
    """(cost, edits, repaired) by the best way on from each turn and state; at most two insertions in a row pay."""
    names = {"s": 1, "u": 2, "a": 3}
    step = {(0, 1), (0, 2), (1, 2), (3, 2), (2, 3)}

    @functools.cache
    def on(i, state, put):
        ways = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        if put < 3:
            for to, role in ((2, "user"), (3, "assistant")):
                if (state, to) in step:
                    c, e, o = on(i, to, put + 1)
                    ways.append((c + 2, "I" + e, (f"{role}:", *o)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, e, o = on(i + 1, state, 0)
            ways.append((c + 3, "D" + e, o))
            if fault not in ("blank", "duplicate"):
                for to, name, op, cost in ((names.get(role[:1]), role, "K", 0), (2, "user", "R", 2), (3, "assistant", "R", 2)):
                    if (state, to) in step:
                        c, e, o = on(i + 1, to, 0)
                        ways.append((c + cost + (fault == "truncated"), op + e, (f"{name}:{text}", *o)))
        return min(ways, default=(10**9, "", ()))

    return on(0, 0, 0)


def faults(rows):
    """(role, text, fault) of (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        fault = "blank" if not re.search(r"[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in seen else "" if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_survivors_are_the_cheapest(seed):
    r = random.Random(seed)
    for _ in range(400):
        weights = [r.random() for _ in ROLES]
        rows = faults([(r.choices(ROLES, weights)[0], r.choice(TEXTS) + (f" {r.randrange(9)}." if r.random() < 0.5 else "")) for _ in range(r.randrange(0, 14))])
        search, edits = repair.Survivors(), []
        for role, text, fault in rows:
            edits += search.add(role, text, fault, None)
        edits += search.close()
        cost, audit, repaired = cheapest(tuple(rows))
        assert sum(e[1] for e in edits) == cost and "".join(e[0] for e in edits) == audit
        out = [f"{e[2]}:{e[3]}" for e in edits if e[0] != "D"]
        assert out == list(repaired) and re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in out))


def test_survivors_coalesce():
    """A long conversation is decided as it goes: what stays open is short."""
    r = random.Random(9)
    search, given, most = repair.Survivors(), 0, 0
    for i in range(20_000):
        role = r.choice(["user", "assistant", "assistant", "system"]) if r.random() < 0.3 else ("user", "assistant")[i % 2]
        given += sum(e[0] != "I" for e in search.add(role, f"text {i}.", "duplicate" if r.random() < 0.1 else "", i))
        most = max(most, i + 1 - given)
    assert most < 60
    search, given, most = repair.Survivors(), 0, 0
    for i in range(5000):  # nothing but turns to delete, then nothing but kept ones
        given += sum(e[0] != "I" for e in search.add("user", "", "blank", i) if i < 2500 or i % 9)
        most = max(most, i + 1 - given) if i < 2500 else most
    assert most < 60


def test_ways_that_stay_equal():
    """Two ways that cost the same to the end: all stays open, at the same cost a turn, and the end decides."""
    for n in (2000, 2001):
        rows = [x for i in range(n) for x in (("user", "", "blank"), ("assistant", f"{i}.", ""))]
        search, edits = repair.Survivors(), []
        for row in rows:
            edits += search.add(*row, None)
        edits += search.close()
        assert [e[0] for e in edits if e[0] == "D"] == ["D"] * n and len(edits) == 2 * n + (n % 2)
        assert "".join(e[0] for e in edits) == ("DIK" + "DRDK" * (n // 2) if n % 2 else "DRDK" * (n // 2))


TURNS = "conv_id string, turn long, role string, text string, conv int, same string, first int, step int"


def test_repair_of_odd_rows(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", "c", None, "d:1", ""]), r.choice([None, 1, 2, 2, 3, 5, -4]), r.choice([*ROLES, None]), r.choice([*TEXTS, None]), 1, "x", 2, 3) for _ in range(120)]
    rows += [("long", i, ("user", "assistant")[i % 2], "word " * 5000 + f"{i}.", 1, "x", 2, 3) for i in range(40)] + [rows[0]] * 5
    got = [tuple(x) for x in repair.repair_conversations(spark.createDataFrame(rows, TURNS).repartition(5)).collect()]
    space = lambda x: " " if x is None else x
    for conv in {x[0] for x in rows}:
        own = sorted([(x[1] is not None, x[1] or 0, space(x[2]), space(x[3])) for x in rows if x[0] == conv])
        told = faults([x[2:] for x in own])
        cost, audit, repaired = cheapest(tuple(told))
        edits = sorted(x for x in got if x[0] == conv) if conv is not None else sorted((x for x in got if x[0] is None), key=lambda x: x[1])
        assert [x[1] for x in edits] == list(range(len(edits)))
        assert "".join(x[2] for x in edits) == audit and sum(x[3] for x in edits) == cost
        assert [f"{x[4]}:{x[5]}" for x in edits if x[2] != "D"] == list(repaired)
        assert [x[6] for x in edits if x[2] != "I"] == [x[2] for x in told]
        heads = [x[0][:1] for x in told]
        assert [x[8] for x in edits if x[2] != "I"] == [n > 0 and heads[n - 1] + heads[n] not in ("su", "ua", "au") for n in range(len(heads))]
    assert repair.repair_conversations(spark.createDataFrame([], TURNS)).isEmpty()


def test_conversations_without_rows_after_damage(spark, tmp_path):
    """The query gives every conversation a row; crc32('5:3') % 20 and others decide the damage."""
    import zlib

    rows = [(i, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of it.") for i in range(40) for t in range(3)] + [(None, None, None, None), (77, None, "user", "a.")]
    gone = [i for i in range(1000, 3000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0][:3]
    rows += [(i, 0, "user", "gone.") for i in gone]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x["conv_id"]: x for x in repair.op12_coalescent_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {x[0] for x in rows}
    for i in gone:
        assert tuple(got[i])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
