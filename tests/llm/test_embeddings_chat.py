"""Hard negatives, whitening and chat formatting against brute force, with odd input."""

import hashlib
import math
import random
import string

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from candlemill.llm import chat, hardneg, whitening


def whole(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_negatives(rows, every, npos=5, nneg=3):
    good = [(i, y, [math.floor(256 * x) for x in v]) for i, v, y in rows if i is not None and y is not None and whole(v)]
    out, asked = [], {}
    for i, y, v in good:
        if i % every == 0:
            asked.setdefault(i, (y, v))
    for a, (y, q) in asked.items():
        score = lambda v: sum(s * t for s, t in zip(q, v, strict=True))  # noqa: B023, E731
        scored = sorted((-score(v), i, z) for i, z, v in good if i != a and len(v) == len(q))
        for s, p, _ in [t for t in scored if t[2] == y][:npos]:
            fits = [(t, i) for t, i, z in scored if z != y and 50 * -s <= 100 * -t <= 95 * -s][:nneg]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(fits)]
    return sorted(out)


def negatives(spark, rows, every, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, key double, pivot int").repartition(3)
    return sorted(map(tuple, hardneg.hard_negatives(df, F.col("vec_id") % every == 0, F.col("label"), **how).collect()))


@pytest.mark.parametrize("block,index_block,pivots", [(2048, 512, 64), (3, 4, 5)])
def test_hard_negatives_match_brute_force(spark, block, index_block, pivots):
    g = random.Random(5)
    rows = [(i, [g.choice([0.1, 0.2, -0.3, 1.0, 0.5]) for _ in range(4)], g.randrange(3), 0.0, 1) for i in range(120)]
    rows += [(i, rows[7][1], i % 2, 0.0, 1) for i in range(300, 360)]  # copies
    rows += [(200, None, 1, 0.0, 1), (204, [1.0, None, 0.0, 0.0], 1, 0.0, 1), (208, [float("nan")] * 4, 1, 0.0, 1), (212, [1.0] * 4, None, 0.0, 1), (None, [1.0] * 4, 1, 0.0, 1)]
    rows += [(216, [], 1, 0.0, 1), (220, [0.5], 1, 0.0, 1), (221, [0.4], 1, 0.0, 1), (222, [0.3], 0, 0.0, 1), (13, rows[13][1], rows[13][2], 0.0, 1), (224, [-1.0, 0.0, 0.0, 0.0], 9, 0.0, 1), (225, [1.0, 0.0, 0.0, 0.0], 9, 0.0, 1)]
    got = negatives(spark, rows, 4, anchor_block=block, index_block=index_block, pivots=pivots)
    assert got == brute_negatives([r[:3] for r in rows], 4) and len(got) > 300


def test_hard_negatives_in_many_dimensions_and_extremes(spark):
    g = np.random.default_rng(1)
    rows = [(i, g.normal(size=24).tolist(), int(g.integers(4)), 0.0, 1) for i in range(900)]
    assert negatives(spark, rows, 45, index_block=16) == brute_negatives([r[:3] for r in rows], 45)
    huge = [(i, [1e160 * (i % 5), 1e155 * i], i % 2, 0.0, 1) for i in range(12)]  # squares leave the range of doubles: the search reads all keys
    found = negatives(spark, huge, 4)
    assert all(50 * p <= 100 * n <= 95 * p for *_, p, n in found)
    assert negatives(spark, [], 4) == []


def test_hard_negatives_read_only_key_intervals(spark):
    """Far groups: the intervals of a group's anchors leave the blocks of the others unread."""
    g = np.random.default_rng(2)
    rows = [(i, (np.eye(8)[i % 8] * 40 + g.normal(size=8) * 0.2).tolist(), int(g.integers(2)), 0.0, 1) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, key double, pivot int")
    index = hardneg.build_index(df, F.col("vec_id") == 8, F.col("label"), pivots=8, block=32)
    own = index.anchors.collect()
    search = hardneg._Search(index, 8, np.array([8]), np.array([own[0].label]), hardneg._unpack(bytes(own[0].v), 1, 8), [[(None, None)]], 5, same=True)
    read = []
    plain = hardneg._Search.scan

    def scan(self, reach, seen, inner, is_open):
        lo, hi = (self.away - reach[:, None])[0], (self.away + reach[:, None])[0]
        read.append(sum(1 for r in index.blocks.collect() if lo[r.pivot] <= r.hi and r.lo <= hi[r.pivot]) / index.blocks.count())
        plain(self, reach, seen, inner, is_open)

    search.scan = scan.__get__(search)
    search.run()
    assert max(read) <= 0.25
    keys = [(r.pivot, r.lo, r.hi) for r in index.blocks.orderBy("pivot", "lo").collect()]
    assert all(a[2] <= b[1] for a, b in zip(keys, keys[1:], strict=False) if a[0] == b[0])  # sorted by (pivot, distance)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, c double").repartition(3)


def brute_whitening(rows, k):
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows if whole(v)]
    n, s = len(x), [sum(col) for col in zip(*x, strict=True)]
    centred = np.array([[(n * a - b) / n for a, b in zip(row, s, strict=True)] for row in x])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    dev = [sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return n, dev, centred @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


@pytest.mark.parametrize("dim,k", [(12, 8), (5, 8)])
def test_whitening_matches_brute_force(spark, dim, k):
    g = np.random.default_rng(dim)
    rows = [(i, (g.normal(size=dim) * np.linspace(1, 3, dim)).tolist(), 1, 2.0) for i in range(200)]
    rows += [rows[3], rows[3], (None, rows[4][1], 1, 2.0), (900, None, 1, 2.0), (901, [float("inf")] * dim, 1, 2.0), (902, [None] * dim, 1, 2.0)]
    got = whitening.whiten(vectors(spark, rows), k).collect()
    kept = [r for r in rows if whole(r[1])]
    n, dev, white, shares = brute_whitening([r[:2] for r in kept], min(k, dim))
    assert len(got) == n * min(k, dim) and {r.n for r in got} == {n}
    for c in range(min(k, dim)):
        mine = sorted((r.vec_id if r.vec_id is not None else -1, r.whitened, r.deviation) for r in got if r.component == c + 1)
        their = sorted((r[0] if r[0] is not None else -1, w, d) for r, w, d in zip(kept, white[:, c], dev, strict=True))
        sign = np.sign(sum(a[1] * b[1] for a, b in zip(mine, their, strict=True) if a[0] not in (3, -1)))
        for a, b in zip(mine, sorted((i, sign * w, d) for i, w, d in their), strict=True):
            assert a[0] == b[0] and a[2] == b[2] and abs(a[1] - b[1]) < 1e-10
        assert abs(next(r.explained for r in got if r.component == c + 1) / shares[c] - 1) < 1e-9
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whitening_odd_input(spark):
    same = [(i, [0.5, 0.25], 1, 2.0) for i in range(5)]
    assert whitening.whiten(vectors(spark, same)).count() == 0  # nothing varies
    assert whitening.whiten(vectors(spark, [])).count() == 0
    flat = [(i, [0.5, i / 8, i / 4], 1, 2.0) for i in range(9)]  # one direction
    got = whitening.whiten(vectors(spark, flat)).collect()
    assert {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-9
    mixed = flat + [(100 + i, [float(i), -float(i * i)], 1, 2.0) for i in range(6)] + [(200, [], 1, 2.0)]
    assert {(r.n, r.component) for r in whitening.whiten(vectors(spark, mixed)).collect()} == {(9, 1), (6, 1), (6, 2)}
    large = [(i, [i * 1e30, 1.0 * i], 1, 2.0) for i in range(-2, 3)]  # saturates, and deviations leave 64 bits
    wide = whitening.whiten(vectors(spark, large)).collect()
    assert any(r.deviation is None and int(r.deviation_exact) > 2**63 for r in wide)


def brute_chat(rows):
    conversations = {}
    for conv, turn, role, text in rows:
        conversations.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.md5(f"{role or ''}\n{text or ''}".encode()).hexdigest(), role or "", text or ""))
    out = {}
    for conv, turns in conversations.items():
        turns = [(r, t) for *_, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        all_turns = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(all_turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat.render(turns)), False)
    return out


CHAT = "conv_id long, turn long, role string, text string, pos int, piece string"


def test_chat_matches_brute_force(spark):
    g = random.Random(2)
    odd = ["", None, "\\### Assistant: </turn> ok", "####", "\\", "a\\\\#", "</turn>\n### user:\nx", "\n", "x" * 50_000, "Ünï 中文 \u2028 \r\n </turn", "#" * 9 + "</turn></turn>", "<\\/turn>"]
    rows = [(c, t, "system" if not t and c % 3 else ("user", "assistant")[t % 2], g.choice(odd) if g.random() < 0.5 else "".join(g.choice(string.printable) for _ in range(g.randrange(80)))) for c in range(25) for t in range(1 + c % 7)]
    rows += [(77, t, ("user", "assistant")[t % 2], f"turn {t} \\###") for t in range(150)]  # cut into pieces
    rows += [(None, None, None, None), (None, 1, "assistant", "no id"), (30, 1, "a:\nb\\#", "odd role"), (31, 5, "user", "tie"), (31, 5, "assistant", "tie"), (31, None, "user", "first"), (31, 5, "user", "tie")]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], CHAT).repartition(5)
    for turns in (32, 4):
        got = {r[0]: tuple(r)[1:] for r in chat.digests(chat.format_conversations(df, turns=turns)).collect()}
        assert got == brute_chat(rows)
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


@given(st.text(alphabet="\\#</turn>\n ab", max_size=30), st.text(alphabet="\\#:\n ab", max_size=12))
def test_escapes_are_reversible_and_leave_no_mark(text, role):
    assert chat.unescape(chat.escape(text)) == text and chat.unescape_role(chat.escape_role(role)) == role
    assert chat.MARK not in chat.escape(text) and chat.CLOSE not in chat.escape(text)
    turns = [(role, text), ("assistant", text)]
    out = chat.render(turns)
    assert [(r, t) for r, t, *_ in chat.read_back(out)] == turns
    located = chat.spans(chat.render, turns)
    assert "".join(p for p, *_ in located) == out and [chat.unescape(p[a:z]) for p, a, z, _ in located] == [text, text]


def closing(turns):
    """Ends with a mark that the next turn removes."""
    return "".join(f"[{r}]{t}|" for r, t in turns) + "<end>"


def forgetful(turns):
    """Drops the assistant's earlier texts."""
    return "".join(f"[{r}]{'' if r == 'assistant' and k < len(turns) - 1 else t}|" for k, (r, t) in enumerate(turns))


def test_templates_that_rewrite_history_are_marked_and_located():
    turns = [("user", "hello there"), ("assistant", "answer one"), ("user", "and?"), ("assistant", "answer two")]
    for template, seen in ((closing, ["hello there", "answer one", "and?", "answer two"]), (forgetful, ["hello there", "", "and?", "answer two"])):
        located = chat.spans(template, turns)
        assert all(rewrites for *_, rewrites in located) and "".join(p for p, *_ in located) == template(turns)
        assert [p[a:z] for p, a, z, _ in located] == seen
    assert not any(rewrites for *_, rewrites in chat.spans(chat.render, turns))


def numbered(turns):
    """Not local: every turn shows the number of all turns before it."""
    return "".join(f"### {r}:\n{t}\n</turn>\n" if k < 20 else f"### {r}:\n{t}!\n</turn>\n" for k, (r, t) in enumerate(turns))


def test_pieces_that_depend_on_the_cut_fail(spark):
    rows = [(1, t, "user", "x", 1, "p") for t in range(40)]
    df = spark.createDataFrame(rows, CHAT)
    with pytest.raises(Exception, match="memory"):
        chat.digests(chat.format_conversations(df, numbered, turns=24)).collect()
    with pytest.raises(Exception, match="rewrites history"):
        chat.format_conversations(df, closing, turns=24).collect()
