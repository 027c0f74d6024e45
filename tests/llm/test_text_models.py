"""Language identification, language model, quality and license scan."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from candlemill.llm import language, licenses, lm, quality
from tests.llm import fixtures


def test_language_from_text_and_priors(spark):
    docs = fixtures.documents(spark)
    model = language.train(docs)
    assert model.languages == ["de", "en", "fr"]
    data = [(i, f"http://www.h{i % 4}.example.{('org', 'net')[i % 2]}/x", f'<html lang="{lang}"><script>der die das</script><p>{fixtures.prose(lang, 40, 500 + i)}</p>', "d", 1) for i, lang in enumerate(["en", "de", "fr", "en", "de"] * 4)]
    data += [(90, None, None, None, None), (91, "not a url", "", "d", 1), (92, "http://h/", "<html><p>123 456 !!!</p>", "d", 1), (93, "http://h0.example.org/", "<p>the</p>", "d", 1), (0, data[0][1], data[0][2], "d", 1), (None, "u", "<p>" + fixtures.prose("fr", 50, 3), "d", 1)]
    got = language.identify_pages(fixtures.pages(spark, data).repartition(2), model)
    rows = got.select("page_id", "language_id.language", "language_id.posterior").collect()
    assert len(rows) == len(data)
    said = {r.page_id: r.language for r in rows}
    assert all(said[i] == ["en", "de", "fr", "en", "de"][i % 5] for i in range(20)) and said[None] == "fr"
    assert said[90] == said[91] == said[92] == "und"
    assert all(0 <= r.posterior <= 1.0000001 for r in rows)


def _posterior(x, own, overall, declared, suffix, levels, n_declared, n_suffix):
    """One row's posterior, language by language; levels: counts of the domain, then of the host, where there are any."""
    k = len(x)
    base = [overall[i] - own[i] for i in range(k)]
    prior = [(base[i] + 1) / (sum(base) + k) for i in range(k)]
    for c in levels:
        c = [max(c[i] - own[i], 0) for i in range(k)]
        prior = [(c[i] + language.HOST_KAPPA * prior[i]) / (sum(c) + language.HOST_KAPPA) for i in range(k)]
    p = [math.exp(x[i]) * prior[i] for i in range(k)]
    for c, n in ((declared, n_declared), (suffix, n_suffix)):
        p = [p[i] * (max(c[i] - own[i], 0) + language.KAPPA / n) / (base[i] + language.KAPPA) for i in range(k)]
    return [y / sum(p) for y in p]


def test_language_matches_brute_force(spark):
    """Hosts of two, three and more labels, domains under generic labels, and none at all."""
    model = language.train(fixtures.documents(spark))
    hosts = ["example.com", "www.example.com", "a.b.example.com", "shop.co.uk", "www.shop.co.uk", "h", "", "lone.de"]
    domains = ["example.com", "example.com", "example.com", "shop.co.uk", "shop.co.uk", "h", "", "lone.de"]
    data = []
    for i in range(60):
        lang, h = ("en", "de", "fr")[i % 3 if i % 5 else 0], hosts[i * 7 % 8]
        data.append((i, f"http://{h}/x" if h else "none", f'<html lang="{("en", "de", "fr", "xx")[i * 5 % 4]}"><p>{fixtures.prose(lang, 2 + i % 5, i)}</p>', "d", 1))
    got = {r.page_id: r.language_id for r in language.identify_pages(fixtures.pages(spark, data).repartition(3), model).collect()}
    text = lambda html: html.split("<p>")[1].replace("</p>", "").encode()
    rows = []
    for i, url, html, *_ in data:
        x = model.evidence(b" " + text(html) + b" ")
        h = hosts[i * 7 % 8]
        rows.append((i, x, x and max(range(3), key=lambda j: (x[j], -j)), html[12:14], h.rpartition(".")[2] if "." in h else "", h, domains[hosts.index(h)]))
    count = lambda at, value: [sum(1 for r in rows if r[1] and r[2] == j and r[at] == value) for j in range(3)]
    overall = [sum(1 for r in rows if r[1] and r[2] == j) for j in range(3)]
    n = [len({r[at] for r in rows if r[1]}) for at in (3, 4)]
    assert sum(overall) > 40
    for i, x, v, said, end, host, domain in rows:
        if x is None:
            assert got[i].language == "und" and got[i].posterior == 0
            continue
        levels = ([count(6, domain)] if domain and domain != host else []) + ([count(5, host)] if host else [])
        want = _posterior(x, [float(j == v) for j in range(3)], overall, count(3, said), count(4, end), levels, *n)
        assert np.allclose(got[i].votes, want, atol=1e-9), (i, host, got[i].votes, want)


def test_language_held_out_accuracy(spark):
    data = [(i, fixtures.prose(lang, 12, 900 + i), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language.train(docs.where("doc_id % 4 <> 2"))
    # Neither the declared language nor the source helps here.
    held = docs.where("doc_id % 4 = 2").withColumn("truth", F.col("lang")).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))
    got = language.identify_documents(held, model).select("truth", "language_id.language").collect()
    assert len(got) == 30 and sum(r.truth == r.language for r in got) >= 29


def test_language_counts_every_value(spark):
    """Values that occur once say as much as they do among few."""
    model = language.train(fixtures.documents(spark))
    rows = fixtures.documents(spark, [(i, fixtures.prose("en", 20, 1), f"l{i}", f"s{i}", 1, 1, 0.0, 1, "k", 1, 1, "z", 1, 1, "p") for i in range(300)])
    votes = {tuple(round(v, 12) for v in r[0]) for r in language.identify_documents(rows, model).select("language_id.votes").collect()}
    assert len(votes) == 1


def test_language_documents_keep_rows_and_columns(spark):
    docs = fixtures.documents(spark)
    got = language.identify_documents(docs, language.train(docs), out="language")
    assert got.columns == [c for c in docs.columns if c != "language"] + ["language"] and got.count() == docs.count()
    none = language.identify_documents(docs, language.train(fixtures.empty(spark)), out="language")
    assert none.where("language.language <> 'und'").count() == 0 and none.count() == docs.count()
    assert language.identify_documents(fixtures.empty(spark), language.train(docs)).count() == 0


def test_lm_base_scores_and_normalisation(spark):
    data = fixtures.rows()
    got = lm.score_documents(fixtures.documents(spark)).collect()
    assert len(got) == len(data)
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(x for r in data if not held(r[0]) for x in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = sorted((str(r[0]), held(r[0]), len(tokens(r[1])), sum(c[x] > 0 for x in tokens(r[1])), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(r[1])), 4)) for r in data)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score <= 0 and math.isfinite(r.score) for r in got)
    assert lm.score_documents(fixtures.empty(spark)).count() == 0


def _log_probability(p, doc, at):
    """Of one token, by loops over numbers."""
    start, k = len(p.e) - 1, lm.DIM
    r = [0.0] * k
    span = min(at, lm.BAG)
    rows = [(p.e[int(doc[at - i - 1])] if at > i else p.e[start], p.c[i]) for i in range(lm.CONTEXT)]
    if span:
        rows.append(([sum(float(p.e[int(c)][j]) for c in doc[at - span : at]) / span for j in range(k)], p.m))
    for x, m in rows:
        r = [r[j] + sum(float(x[i]) * float(m[i][j]) for i in range(k)) for j in range(k)]
    score = lambda q, b: sum(float(q[j]) * r[j] for j in range(k)) + float(b)
    log_sum = lambda x: max(x) + math.log(sum(math.exp(y - max(x)) for y in x))
    c = int(doc[at])
    g = int(p.groups.of[c])
    members = [i for i in range(len(p.b)) if p.groups.of[i] == g]
    groups = [score(p.gq[i], p.gb[i]) for i in range(p.groups.count)]
    return groups[g] - log_sum(groups) + score(p.q[c], p.b[c]) - log_sum([score(p.q[i], p.b[i]) for i in members])


def test_lm_probabilities_sum_to_one_and_learn():
    g = np.random.default_rng(1)
    docs = [np.array([(s + i) % 6 + 6 * (s % 2) for i in range(60)], np.uint16) for s in g.integers(0, 100, 300)]
    tokens = np.bincount(np.concatenate(docs), minlength=12).astype(float)
    p = lm.Parameters(tokens / tokens.sum())
    assert p.groups.count > 1 and sorted(np.concatenate(p.groups.members)) == list(range(12))
    trainer = lm.Trainer(p, tokens / tokens.sum(), 0)
    before = lm.Scorer(p).log_probabilities(docs).mean()
    for _ in range(4):
        trainer.train(docs)
    scorer = lm.Scorer(p)
    assert scorer.log_probabilities(docs).mean() > before + 0.5
    each = [scorer.log_probabilities([np.r_[docs[0][:5], c].astype(np.uint16)])[5] for c in range(12)]
    assert math.isclose(sum(map(math.exp, each)), 1.0, rel_tol=1e-4)
    got = scorer.log_probabilities(docs[:2])
    assert np.allclose(got, [_log_probability(p, d, i) for d in docs[:2] for i in range(len(d))], atol=1e-4)
    p.b += 300.0  # sums that would overflow
    assert np.allclose(lm.Scorer(p).log_probabilities(docs[:2]), got, atol=1e-2)


def test_lm_step_is_the_gradient_of_the_contrast():
    """One step against a brute-force one over the same noise."""
    g = np.random.default_rng(3)
    u = np.arange(1.0, 10.0) / 45
    p, q = lm.Parameters(u), lm.Parameters(u)
    trainer = lm.Trainer(p, u, 5)
    target, before, bag = g.integers(0, 9, 7), g.integers(0, 10, (7, lm.CONTEXT)), g.random((7, lm.DIM)).astype(np.float32)
    draws = np.random.default_rng(5)
    trainer.batch(target, before, bag)
    groups = np.bincount(q.groups.of, u)
    grads = {n: np.zeros(getattr(q, n).shape) for n in q.NAMES}
    noises = [np.searchsorted(np.cumsum(x) / x.sum(), draws.random(k), side="right") for x, k in ((u, lm.NOISE), (groups, lm.GROUP_NOISE))]
    for t, b, m in zip(target, before, bag, strict=True):
        r = m @ q.m + sum(q.e[b[i]] @ q.c[i] for i in range(lm.CONTEXT))
        back = np.zeros(lm.DIM)
        for (w, bias), x, k, noise, c in ((("q", "b"), u, lm.NOISE, noises[0], t), (("gq", "gb"), groups, lm.GROUP_NOISE, noises[1], q.groups.of[t])):
            for i, true in [(c, True), *((j, False) for j in noise)]:
                s = float(r @ getattr(q, w)[i] + getattr(q, bias)[i] - math.log(k * x[i] / x.sum()))
                d = float(true) - 1 / (1 + math.exp(-s))
                grads[w][i] += d * r / 7
                grads[bias][i] += d / 7
                back += d * getattr(q, w)[i]
        for i in range(lm.CONTEXT):
            grads["c"][i] += np.outer(q.e[b[i]], back) / 7
            grads["e"][b[i]] += q.c[i] @ back / 7
        grads["m"] += np.outer(m, back) / 7
    for n in q.NAMES:
        assert np.allclose(getattr(p, n), getattr(q, n) + lm.RATE * grads[n] / np.sqrt(0.1 + grads[n] ** 2), atol=2e-4), n


def test_lm_every_training_token_is_a_target(spark, monkeypatch):
    docs = [np.arange(k * 100, k * 100 + 41 + k, dtype=np.uint16) for k in range(9)]
    seen = []
    monkeypatch.setattr(lm.Trainer, "batch", lambda self, target, before, bag: seen.append(target))
    monkeypatch.setattr(lm, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)}))}))

    class Local:  # runs a round's function here, on the rows that the round takes
        def __init__(self):
            self.round = -1

        def where(self, condition):
            self.round += 1
            return self

        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            mine = docs[self.round % rounds :: rounds]
            for part in (mine[:3], mine[3:]):
                list(f(iter([pa.RecordBatch.from_arrays([pa.array([d.tobytes() for d in part])], ["ids"])])))
            return self

        def groupBy(self, *_):
            return self

        def applyInArrow(self, *_):
            return self

        def collect(self):
            return []

    for rounds in (1, 2, 3):
        seen.clear()
        lm.train(Local(), np.ones(1000), rounds=rounds)
        assert (np.sort(np.concatenate(seen)) == np.concatenate(docs)).all(), rounds


class _Task:  # keeps the function that an operator would run in tasks
    def __init__(self):
        self.sparkSession = self.sparkContext = self

    def broadcast(self, value):
        return type("Broadcast", (), {"value": value})

    def select(self, *_):
        return self

    def mapInArrow(self, f, _):
        self.run = f
        return self


def test_lm_looks_each_word_of_a_batch_up_once():
    texts = [b"the cat the dog", None, b"", b" The\x1ccat\x0b\xc2\xa0x \xff\xfe THE rare \x85 rare ", b"\n", b"dog " * 500, b"\xc3\x84 the"]
    looked_up = []

    class Words(dict):
        def get(self, word, otherwise=None):
            looked_up.append(word)
            return dict.get(self, word, otherwise)

    voc = lm.Vocabulary([(b"the", 9), (b"dog", 5), (b"cat", 3)], [(b"are", 2, 1), (b"", 4, 3)], 30, 8, 2)
    voc.words = Words(voc.words)
    task = _Task()
    lm._encoded(task, voc)
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array([False] * len(texts)), pa.array(texts, pa.binary())], ["rid", "doc_id", "held_out", "text"])
    got = pa.Table.from_batches(task.run(iter([batch]))).to_pylist()
    words = [(t or b"").lower().split() for t in texts]
    assert sorted(looked_up) == sorted({w for ws in words for w in ws})
    log_of = {b"the": math.log10(10), b"dog": math.log10(6), b"cat": math.log10(4)}
    for r, ws in zip(got, words, strict=True):
        classes = [{b"the": 0, b"dog": 1}.get(w, 3 if w.endswith(b"are") else 4) for w in ws] + [2]
        tail = [w for w in ws if w not in log_of]
        assert np.frombuffer(r["ids"], np.uint16).tolist() == classes and len(r["tail"]) == len(tail)
        assert (r["n_tokens"], r["n_known"]) == (len(ws) + 1, len(ws) + 1 - len(tail))
        assert np.allclose(r["head"], [sum(log_of.get(w, 0) for w in ws), sum(log_of[w] for w in ws if w == b"cat")])
        assert math.isclose(r["sizes"], sum(voc.log_size[c] for c in classes), abs_tol=1e-9)


def test_lm_counts_are_sent_on_in_parts(monkeypatch):
    monkeypatch.setattr(lm, "COUNTER_LIMIT", 20)
    run = []
    monkeypatch.setattr(_Task, "mapInArrow", lambda self, f, _: run.append(f) or self)
    monkeypatch.setattr(_Task, "groupBy", lambda self, *_: self, raising=False)
    monkeypatch.setattr(_Task, "agg", lambda self, *_: self, raising=False)
    monkeypatch.setattr(lm.F, "sum", lambda _: type("Sum", (), {"alias": lambda self, _: self})())
    lm._counts(_Task())
    texts = [[" ".join(f"w{(i * k) % 97}" for i in range(30)).encode(), None, b" W1 "] for k in range(40)]
    parts = list(run[0](pa.RecordBatch.from_arrays([pa.array(t, pa.binary())], ["text"]) for t in texts))
    sent = [(w, n) for p in parts for w, n in zip(p["word"].to_pylist(), p["n"].to_pylist(), strict=True)]
    want, got = Counter(w for t in texts for x in t for w in [*(x or b"").lower().split(), lm.END]), Counter()
    for w, n in sent:
        got[w] += n
    assert got == want and len(parts) > 1 and list(run[0](iter([]))) == []


def test_lm_step_updates_two_tables(monkeypatch):
    """Of classes and groups together, and of contexts: a step of its own for each array costs most of a batch."""
    g = np.random.default_rng(4)
    u = np.arange(1.0, 60.0) / 1770
    trainer = lm.Trainer(lm.Parameters(u), u, 5)
    steps = []
    step = lm.Trainer._step
    monkeypatch.setattr(lm.Trainer, "_step", lambda self, *a: steps.append(a[0]) or step(self, *a))
    trainer.batch(g.integers(0, 59, 40), g.integers(0, 60, (40, lm.CONTEXT)), g.random((40, lm.DIM)).astype(np.float32))
    assert len(steps) <= 2


def test_lm_averages_by_tokens(spark):
    rows = [(0, k // 64, np.array([float(k), 1.0], np.float32).tobytes(), 1 + k % 3) for k in range(130)]
    got = spark.createDataFrame(rows, lm.SENT).groupBy("i", "part").applyInArrow(lm._average, lm.SENT).groupBy("i").applyInArrow(lm._average, lm.SENT).first()
    want = sum(k * (1 + k % 3) for k in range(130)) / sum(1 + k % 3 for k in range(130))
    assert np.allclose(np.frombuffer(got.v, np.float32), [want, 1.0], rtol=1e-5)


def test_lm_classes_grow_with_the_vocabulary(spark):
    sizes = []
    for types in (20_000, 360_000):
        word = F.lpad(F.lower(F.hex("id")), 6, "0").cast("binary")
        counts = spark.range(types).select(word.alias("word"), (1 + F.floor(types / (F.col("id") + 1))).cast("long").alias("n")).unionByName(spark.createDataFrame([(lm.END, 9)], "word binary, n long"))
        voc, tokens = lm.vocabulary(counts, head=5000)
        assert voc.classes == len(tokens) == sum(lm.class_numbers(types + 1)) + 2 and voc.own == lm.class_numbers(types + 1)[0]
        sizes.append(voc.classes)
    assert sizes == [450, 900 + 300 + 2]


def test_lm_words_probabilities_sum_to_one(spark):
    data = [(i, fixtures.prose("en", 50, i)) for i in range(20)]
    counts = lm._counts(spark.createDataFrame(data, "doc_id long, text string").select(F.col("text").cast("binary").alias("text")))
    voc, tokens = lm.vocabulary(counts, own=10, shared=5)
    c = {bytes(r.word): r.n for r in counts.collect()}
    mass = Counter()
    for w, n in c.items():
        k = voc.own if w == lm.END else voc.word_class[voc.words[w]]
        mass[k] += 1.0 if k <= voc.own else (n + 1) / 10 ** voc.log_size[k]
    for k in range(voc.own + 1, voc.classes):
        assert math.isclose(mass[k] + 1 / 10 ** voc.log_size[k], 1.0)  # with the part of unknown words
    assert sum(tokens) == sum(c.values()) == voc.total


def test_quality_separates_on_held_out_rows(spark):
    good = [(i, fixtures.prose(("en", "de", "fr")[i % 3], 60 + i % 50, i)) for i in range(240)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" if i % 2 else w + "$%"[i % 2] * 3 for w in fixtures.prose("en", 50, i).split())) for i in range(120)]
    odd = [(5000, None), (5001, ""), (5002, " "), (5003, "x" * 200_000), (7, good[7][1])]
    docs = spark.createDataFrame([(a, b, 1.0, 2) for a, b in good + bad + odd], "doc_id long, text string, score double, predicted int").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (9999, 0), (3, None), (7, 1), (8, 5)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(good) + len(bad) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 5000]
    assert len(held) > 40 and sum(r.predicted == (r.doc_id < 1000) for r in held) >= 0.97 * len(held)
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_licenses_headers_files_and_inheritance(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/code.py", "# plain text of and to"), ("a/b/c/x.txt", None), ("a/b/own.py", "x\nLicensed under the Apache License, Version 2.0.\ny"),
        ("d/COPYING.txt", "intro\nThis work is licensed under the GNU General Public License, version 3.\nmore text that makes it long " * 3), ("d/e/f.txt", "nothing here"), ("g/h.txt", "nothing"), ("top.txt", ""),
        (None, "Licensed under CC BY-NC 4.0."), (None, None), ("a/b/code.py", "# plain text of and to"), ("a/z.txt", "license " * 20_000), ("i/j.txt", "licensed to the general of 2 mit isc cc"),
    ]
    got = licenses.scan(spark.createDataFrame([(p, t, i, "z") for i, (p, t) in enumerate(rows)], "path string, text string, n int, license string").repartition(2))
    by = {r.n: r for r in got.collect()}
    assert len(by) == len(rows)
    assert [by[i].license for i in range(len(rows))] == ["MIT", "MIT", "MIT", "Apache-2.0", "GPL-3.0", "GPL-3.0", None, None, "CC-BY-NC-4.0", None, "MIT", "MIT", None]
    assert [by[i].origin for i in (0, 1, 3, 4, 5, 8)] == ["file", "inherited", "header", "file", "inherited", "file"]
    assert by[1].from_dir == "a" and by[3].line == 2 and by[3].notice.startswith("Licensed under the Apache")
    assert licenses.scan(got.limit(0).select("path", F.lit("").alias("text"))).count() == 0


def test_license_cosine_by_hand(spark):
    w = licenses.Weights(licenses.NOTICES, licenses.LIMIT)
    line = "Licensed under the the Apache License, Version 2.0 maybe"
    import re

    bag = Counter(re.findall(licenses.TOKEN, line.lower()))
    weight = {t: (1 + math.log(n)) * w.idf.get(t, w.unknown) for t, n in bag.items()}
    norm = math.sqrt(sum(x * x for x in weight.values()))
    best = max((sum(weight[t] * w.unit[t][i] for t in weight if t in w.unit) / norm, -i) for i in range(len(w.names)))
    got = licenses.scan(spark.createDataFrame([("a", line)], "path string, text string")).first()
    assert got.license == w.names[-best[1]] and math.isclose(got.similarity, best[0], abs_tol=1e-8)


def test_license_bound_drops_prose_and_nothing_near_the_limit(spark):
    w, g = licenses.Weights(licenses.NOTICES, licenses.LIMIT), random.Random(5)

    def cosine(bag: Counter) -> float:
        x = {t: (1 + math.log(n)) * w.idf.get(t, w.unknown) for t, n in bag.items()}
        return max(sum(v * w.unit[t][i] for t, v in x.items() if t in w.unit) for i in range(len(w.names))) / math.sqrt(sum(v * v for v in x.values()))

    lines = []
    for k in range(300):
        bag = re.findall(licenses.TOKEN, g.choice(licenses.NOTICES)[1].lower())
        bag += g.choices(bag, k=g.choice([0, 0, 3, 30, 200])) + [f"zz{g.randrange(12)}" for _ in range(g.randrange(0, 14))]
        lines.append(" ".join(g.sample(bag, len(bag))))
    want = [cosine(Counter(x.split())) for x in lines]
    assert sum(0.65 < c < 0.75 for c in want) > 20
    got = {r.i: r.similarity for r in licenses.scan(spark.createDataFrame([(None, x, i) for i, x in enumerate(lines)], "path string, text string, i int")).collect()}
    for i, c in enumerate(want):
        assert (got[i] is None and c < licenses.LIMIT) or math.isclose(got[i], c, abs_tol=2e-9)
    prose = " ".join(["this work is free software under the general terms"] + [f"word{i}" for i in range(70)] + ["word1 word2"] * 15)
    unit = F.array(F.struct(F.lit(prose).alias("text"), F.lit(0).alias("at"), licenses._tokens(F.lit(prose)).alias("tokens")))
    assert spark.range(1).select(F.size(licenses._worthwhile(unit, w)).alias("n")).first().n == 0


def test_license_texts_titles_identifiers_and_wrapped_notices(spark):
    of = dict(licenses.TEXTS)
    mit = "MIT License\n\nCopyright (c) 2020 Some One\n\n" + of["MIT"].replace(". ", ".\n")
    rows = [
        ("m/LICENSE", mit), ("m/deep/er/x.py", "nothing"), ("b/LICENSE", of["BSD-3-Clause"].replace("; ", ";\n") + "\n"), ("b2/COPYING", of["BSD-2-Clause"]),
        ("p/LICENSE", "                                 Apache License\n                           Version 2.0, January 2004\n" + "many terms and conditions of use\n" * 200), ("g/COPYING", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\n" + "words of the licence\n" * 300),
        ("s/a.c", "// SPDX-License-Identifier: Apache-2.0\nint main() {}"), ("s/b.c", "/* SPDX-License-Identifier: MIT */"), ("w/x.py", "# Licensed under the Mozilla\n# Public License, version 2.0\ncode"), ("w/y.py", "This file is one of many that we wrote. Released under the ISC License. It has more to say about itself and others."),
        ("n/note", "Released under the MIT License\n"), ("n/other.py", "x = 1"), ("q/h.py", '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\nimport os\n'), ("q/i.py", "# You can redistribute it\n# under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# any later version.\nx = 1"), ("z/z.txt", "data code software files even form conditions copies notice"),
    ]
    files = spark.createDataFrame([(p, t, i, 7, 1, 2) for i, (p, t) in enumerate(rows)], "path string, text string, n int, i int, i_dir int, j int")
    got = {r.path: r for r in licenses.scan(files).collect()}
    want = ["MIT", "MIT", "BSD-3-Clause", "BSD-2-Clause", "Apache-2.0", "GPL-3.0", "Apache-2.0", "MIT", "MPL-2.0", "ISC", "MIT", "MIT", "Apache-2.0", "GPL-3.0", None]
    assert [got[p].license for p, _ in rows] == want
    assert got["m/deep/er/x.py"].from_dir == "m" and got["n/other.py"].origin == "inherited" and got["b2/COPYING"].line is None and got["w/x.py"].line == 1 and got["w/y.py"].origin == "header"
