"""Exact top-k, WARC and mixing against brute force, with odd input."""

import hashlib
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from candlemill.llm import mixing, topk, warc
from candlemill.llm.common import new_path, shared_dir
from tests.llm import fixtures


def brute_topk(rows, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in rows:
        if i is not None and i % 2 == 0 and v is not None and all(x is not None and math.isfinite(x) for x in v):
            asked[i] = min(asked.get(i, v), v)
    out = []
    for i, v in asked.items():
        q = [math.floor(256 * x) for x in v]
        best = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in good if j != i and len(c) == len(q))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("bins,block", [(2048, 2048), (4, 3)])
def test_topk_matches_brute_force(spark, bins, block):
    g = random.Random(3)
    rows = [(i, [g.choice([0.1, 0.2, -0.3, 1.0]) for _ in range(4)]) for i in range(60)]
    rows += [(200, None), (202, [1.0, None, 0.0, 0.0]), (204, [float("nan"), 0.0, 0.0, 0.0]), (206, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (208, []), (210, [0.5]), (212, [0.25])]
    rows += [rows[2], rows[2], (4, [9.0, 9.0, 9.0, 9.0])]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "vec_id long, embedding array<double>, rank int, score int").repartition(3)
    got = sorted(map(tuple, topk.exact_topk(df, F.col("vec_id") % 2 == 0, 5, bins=bins, query_block=block).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute_topk(rows, 5)


def test_topk_large_components_and_empty(spark):
    rows = [(0, [1e15, -1e15]), (2, [1e15, 1e15]), (3, [1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.exact_topk(df, F.col("vec_id") == 0, 2).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(3, 2**63 - 1 if 2 * 256 * 256 * 10**15 > 2**63 else 2 * 256 * 256 * 10**15), (2, 0)]
    assert topk.exact_topk(df.limit(0), F.lit(True), 2).count() == 0


PAGES = [(i, f"http://h{i % 3}.example/a b\n{i}" if i % 4 else None, ("<p>" + "same payload " * 12) if i % 3 == 0 else f"<p>page {i} " + "x" * i * 3, "d", 1) for i in range(30)]
PAGES += [(100, "u", None, None, None), (101, "u", "", "d", 1), (102, "u", "short", "d", 1), (103, "u", "short", "d", 1), (None, "u", "<p>" + "same payload " * 12, "d", 1), (None, "u", "<p>alone " + "y" * 200, "d", 1)]
PAGES += [(40, "u", "ü" * 70_000, "d", 1), (3, PAGES[3][1], PAGES[3][2], "d", 1), (0, PAGES[0][1], PAGES[0][2], "d", 1)]


def brute_warc(data):
    first = {}
    for i, _, html, *_ in data:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html, *_ in data:
        b = (html or "").encode()
        top = first.get(html or "")
        again = len(b) >= 100 and top is not None and (i is None or i > top)
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("compress", [True, False])
def test_warc_round_trip(spark, compress):
    read = warc.round_trip(fixtures.pages(spark, PAGES).repartition(3), compress=compress)
    assert read.where("gap is not null").count() == 0
    got = sorted((tuple(r) for r in read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    assert got == brute_warc(PAGES)
    responses = read.where("record_type = 'response'").collect()
    assert all(hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest for r in responses)
    assert warc.round_trip(fixtures.pages(spark, []), compress=compress).count() == 0


def test_small_payloads_in_many_partitions_share_archives(spark):
    read = warc.round_trip(spark.range(0, 120, 1, 40).selectExpr("id as page_id", "'u' as url", "concat('<p>page ', id, repeat('x', 200)) as html"))
    assert sorted(r.page_id for r in read.collect()) == list(range(120))
    assert read.select("archive").distinct().count() <= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_recovers_later_records(compress):
    import zlib

    parts = []
    for i in range(6):
        payload = f"payload {i} ".encode() * 30
        record = warc.record_bytes(i, "u", payload, hashlib.sha256(payload).hexdigest(), None, False) + b"\r\n\r\n"
        if compress:
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            record = z.compress(record) + z.flush() + warc._EMPTY_MEMBER
        parts.append(record)
    whole = b"".join(parts)
    assert [r["page_id"] for r in warc.salvage(whole)] == list(range(6))
    hurt = bytearray(parts[2])
    hurt[len(hurt) - 60] ^= 0x55
    broken = b"".join([parts[0], parts[1], bytes(hurt), parts[3], b"noise\x1f\x8b\x08 WARC/1.1 noise", parts[4], parts[5][:-60]])
    found = list(warc.salvage(broken))
    assert [r["page_id"] for r in found if "gap" not in r] == [0, 1, 3, 4]
    gaps = [(r["offset"], r["length"]) for r in found if "gap" in r]
    at = len(parts[0]) + len(parts[1])
    assert gaps[0][0] == at and len(gaps) == 3
    assert sum(n for _, n in gaps) >= len(broken) - sum(map(len, (parts[0], parts[1], parts[3], parts[4]))) - 20
    assert list(warc.salvage(b"")) == []


def test_salvage_reads_foreign_records_and_faulty_members():
    import base64
    import gzip

    def foreign(kind, block, *more):
        return "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", *more, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    sha1 = base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    http = "Content-Type: application/http; msgtype=response"
    block = b"HTTP/1.1 200 OK\r\n\r\nbody"
    parts = [foreign("warcinfo", b"software: x"), foreign("response", block, http, f"WARC-Payload-Digest: sha1:{sha1}"), foreign("response", block, http), foreign("metadata", b"m", "WARC-Payload-Digest: odd:1")]
    for whole in (b"".join(parts), gzip.compress(b"".join(parts)), b"".join(map(gzip.compress, parts))):
        found = list(warc.salvage(whole))
        assert [r["record_type"] for r in found] == ["warcinfo", "response", "response", "metadata"] and [r["payload"] for r in found] == [b"software: x", b"body", b"body", b"m"]
    wrong = foreign("response", block, http, f"WARC-Payload-Digest: sha1:{sha1[::-1]}")
    found = list(warc.salvage(gzip.compress(parts[0] + wrong + parts[3])))
    assert [r.get("record_type", "gap") for r in found] == ["warcinfo", "metadata", "gap"]
    noise = foreign("resource", hashlib.shake_256(b"x").digest(5000))
    found = list(warc.salvage(gzip.compress(parts[0] + parts[1] + noise)[:-2000]))
    assert [r.get("record_type", "gap") for r in found] == ["warcinfo", "response", "gap"]
    assert [r["suspect"] for r in found[:-1]] == [True, True] and all(r["page_id"] is None and r["url"] is None and r["length"] == 0 for r in found[:-1])


def test_salvage_gives_no_wrong_record_as_a_good_one():
    """A member of six records, one or three bits of it turned: what isn't marked is right to the last field."""
    import zlib

    right, plain = {}, b""
    for i in range(6):
        payload = f"payload {i} ".encode() * 12
        digest = hashlib.sha256(payload).hexdigest()
        right[i] = (f"http://h/{i}", payload, digest)
        plain += warc.record_bytes(i, f"http://h/{i}", payload, digest, None, False) + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = z.compress(plain) + z.flush()
    g = random.Random(4)
    suspects = 0
    for trial in range(600):
        hurt = bytearray(member)
        for _ in range(1 if trial % 2 else 3):
            hurt[g.randrange(len(hurt))] ^= 1 << g.randrange(8)
        found = list(warc.salvage(bytes(hurt)))
        for r in found:
            if "gap" not in r and not r["suspect"]:
                assert (r["url"], r["payload"], r["payload_digest"]) == right[r["page_id"]]
            suspects += r.get("suspect", False)
        assert sum(n for _, n in {(r["offset"], r["length"]) for r in found}) == len(hurt)  # every byte once
    assert suspects > 300
    assert all(not r["suspect"] for r in warc.salvage(member))


@pytest.mark.parametrize("unit,tail", [(b"WARC/1. ", b""), (b"WARC/1.1\r\n", b"\r\n"), (b"WARC/1.1\r\na: b\r\n", b"\r\n"), (b"x: WARC/1.1\r\n", b"\r\n\r\n"), (b"x: WARC/1.1\r\n", b"warc-type: a\r\ncontent-length: 9\r\n\r\n"), (b"x: WARC/1.1\r\n", b"")])
def test_salvage_takes_time_in_proportion(unit, tail):
    import time

    good = warc.record_bytes(1, "u", b"p" * 200, hashlib.sha256(b"p" * 200).hexdigest(), None, False) + b"\r\n\r\n"
    began = time.time()
    found = list(warc.salvage(unit * (2_000_000 // len(unit)) + tail + b"\r\n\r\n" + good))
    assert time.time() - began < 20
    assert [r["page_id"] for r in found if "gap" not in r] == [1] and len(found) == 2


def test_mixing_targets_and_epochs(spark):
    data = fixtures.rows()
    got = mixing.mix_sources(fixtures.documents(spark)).collect()
    assert len(got) == len(data)
    size = lambda t: len((t or "").encode().split())
    total, by = 0, defaultdict(int)
    for r in data:
        by[r[3]] += size(r[1])
        total += size(r[1])
    order = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + ([None] if None in by else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal, left, free = {}, 1.5 * total, set(order)
    while True:  # the excess is shared again until none is above its cap
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * by[s]}
        if not over:
            goal |= share
            break
        goal |= {s: 2.0 * by[s] for s in over}
        left -= sum(2.0 * by[s] for s in over)
        free -= over
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == by[r.source] and math.isclose(r.target, goal[r.source], rel_tol=1e-9)
        assert r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0
        taken[r.source] += r.taken
    largest = defaultdict(int)
    for r in data:
        largest[r[3]] = max(largest[r[3]], size(r[1]))
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in by)
    again = sorted(map(str, mixing.mix_sources(fixtures.documents(spark).repartition(5)).collect()))
    assert again == sorted(map(str, got))
    assert mixing.mix_sources(fixtures.empty(spark)).count() == 0


def test_shared_folder_comes_from_the_session(spark):
    assert new_path(spark, "x").startswith(shared_dir(spark))
