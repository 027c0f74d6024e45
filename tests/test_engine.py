"""Recursions, labeler, simulator, treasury, vectors and streams: worked examples, bounds and invariants."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlemill.functions import scalars, vectors
from candlemill.operators import batch, folds, indicators, learning, phase_trades, simulator, treasury, vocabulary
from candlemill.sources import candles, sinks
from candlemill.streaming import live

START = pd.Timestamp("2024-01-01")


def frame(closes, sym="a", spread=1.0):
    return pd.DataFrame({"sym": sym, "ts": [START + pd.Timedelta(hours=i) for i in range(len(closes))], "open": closes, "high": [c + spread for c in closes], "low": [c - spread for c in closes], "close": closes, "volume": 50.0})


def waves(n, seed=1):
    g = np.random.default_rng(seed)
    return (100 + 10 * np.sin(np.arange(n) / 9) + g.standard_normal(n).cumsum() * 0.4).tolist()


def test_seeded_recursions():
    x = np.array([1.0, 2, 3, 4, 5])
    assert folds.ema(x, 3).tolist() == [0, 0, 2, 3, 4]
    assert np.allclose(folds.wilder(x, 3), [0, 0, 2, 2 * 2 / 3 + 4 / 3, (2 * 2 / 3 + 4 / 3) * 2 / 3 + 5 / 3])


def test_flat_and_short_series_have_their_defaults():
    out = folds.series(frame([100.0] * 40, spread=0.0)).iloc[-1]
    assert out.rsi == 100 and out.hurst == 0.5 and out.kelt_pos == 0.5 and out.adx == 0 and out.choppiness == 50
    short = folds.series(frame([1.0, 2.0, 3.0])).iloc[-1]
    assert (short.hurst, short.dfa_alpha, short.fractal_dim, short.ema20) == (0.5, 0.5, 1.5, 0.0)


def test_fold_bounds():
    out = folds.series(frame(waves(300)))
    assert out.rsi.between(0, 100).all() and out.fractal_dim.between(1, 2).all() and out.adx.between(0, 100).all()
    assert (out.rsi[:14] == 100).all() and (out.ema20[:19] == 0).all() and (out.atr[:13] == 0).all()


def test_higuchi_and_dfa_of_known_curves():
    line = np.arange(30.0)
    assert math.isclose(folds.fractal_dim(line), 1.0, abs_tol=1e-9)
    noise = np.random.default_rng(0).standard_normal(48)
    assert folds.fractal_dim(noise[:30]) > 1.6 and folds.dfa_alpha(np.cumsum(noise)) > folds.dfa_alpha(noise)


def test_phase_example():
    state = folds.Phases()
    records = [state.step(i, c, 50.0, 5.0) for i, c in enumerate([100.0, 98.0, 97.0, 103.0], 1)]
    assert records[:3] == [None] * 3 and state.label == "Peak" and state.rising
    r = records[3]
    assert (r["start_candle"], r["end_candle"], r["duration"], r["close_min"], r["close_max"], r["close_avg"]) == (1, 4, 4, 97.0, 103.0, 99.5)
    assert len(state.closes) == 1 and state.generation == 1


def test_phase_records_tile_the_series():
    df = folds.series(frame(waves(400)))
    state, records = folds.Phases(), []
    for i, (c, a) in enumerate(zip(df.close, df.atr, strict=True)):
        if (r := state.step(i, c, 1.0, 2 * a)) is not None:
            records.append(r)
    assert records[0]["start_candle"] == 0 and all(a["end_candle"] == b["start_candle"] for a, b in zip(records, records[1:], strict=False))
    assert all(r["duration"] == r["end_candle"] - r["start_candle"] + 1 for r in records)


def run_frame(closes, thinker, generations=None, labels=None, **kw):
    f = frame(closes).assign(sma20=103.0, sma50=100.0, phase_label=labels or "Valley", phase_generation=generations or 0)
    return simulator.run(f, thinker, **kw)


def test_simulator_deadline_and_conservation():
    out = run_frame([100.0] + [105.0] * 3 + [100.0] * 3, "always-up", deadline=5)
    assert out[["state", "opened_at", "resolved_at"]].values.tolist() == [["Violence", 1, 6]]
    assert math.isclose(out.loss[0], 2 * 35 / 10_000)


def test_simulator_grace_needs_all_gates():
    closes = [100.0, 101.0, 104.0, 104.0, 104.0]
    f = frame(closes).assign(sma20=[101.0, 101.0, 101.0, 99.0, 99.0], sma50=100.0, phase_label=["Valley", "Valley", "Peak", "Peak", "Peak"], phase_generation=[0, 0, 1, 2, 2])
    out = simulator.run(f, "sma-cross")
    assert out[["state", "resolved_at", "direction"]].values.tolist() == [["Grace", 4, "Up"]]
    assert math.isclose(out.residue[0], 0.04 - 0.007)
    assert len(simulator.run(f.assign(phase_generation=0), "sma-cross")) == 0


def test_treasury_rules(spark):
    f = pd.DataFrame({"owner": 1, "event_id": range(6), "candle": [0, 1, 2, 3, 290, 300], "price": [10.0, 10.0, 9.0, 20.0, 5.0, 5.0], "kind": ["Submit", "Submit", "Exit", "Exit", "Tick", "Submit"]})
    out = treasury.settle(f, 288)
    assert out.state.tolist() == ["Grace", "Violence", "Active"] and out.resolved_at.tolist()[:2] == [3, 290]
    gate = spark.createDataFrame([(50, 26, 24), (49, 49, 0), (60, 30, 30), (60, 0, 0)], "a long, b long, c long").select(treasury.gate_open(F.col("a"), F.col("b"), F.col("c")).alias("g"))
    assert [r.g for r in gate.collect()] == [True, False, False, False]
    made = spark.createDataFrame([(1, "a", 0.9), (2, "a", 0.8), (3, "a", 0.001), (4, "b", 0.7), (5, "c", 0.5)], "id long, source string, edge double")
    capital = spark.createDataFrame([("a", 120.0), ("b", 0.0)], "source string, amount double")
    funded = {r.id: r for r in treasury.fund(made, capital, 0.01).collect()}
    assert math.isclose(funded[1].amount, 120 / 1.02) and math.isclose(funded[2].amount, (120 - 120 / 1.02) / 1.02)
    assert funded[3].reason == "edge below venue cost" and funded[4].reason == funded[5].reason == "insufficient capital"


def test_service_by_hand(spark):
    rows = [(1, e, 7, "SubmitPaper", 0, 100.0, "USDC", None, None) for e in range(60)]
    rows += [(1, 60 + e, 8, "SubmitExit", 0, 120.0, "USDC", 1 + e, None) for e in range(40)]  # any owner may name a paper
    rows += [(1, 100, 7, "SubmitReal", 0, 10.0, "USDC", None, None), (1, 101, 9, "SubmitReal", 0, 10.0, "USDC", None, None), (1, 102, 7, "SubmitReal", 0, 10.0, "USDC", None, None), (1, 103, 7, "SubmitReal", 0, 10.0, "ETH", None, None)]
    rows += [(1, 104, 7, "SubmitExit", 0, 100.0, "USDC", 41, None), (1, 105, 7, "SubmitExit", 0, 200.0, "USDC", 1, None), (1, 106, 0, "Tick", 287, 1.0, "", None, None), (1, 107, 7, "BatchGetPaperStates", 0, 1.0, "", None, [1, 60, 61])]
    rows += [(1, 108, 0, "Tick", 288, 1.0, "", None, None), (1, 109, 7, "BatchGetPaperStates", 0, 1.0, "", None, [1, 60, 61]), (1, 110, 7, "SubmitExit", 0, 200.0, "USDC", 60, None), (2, 111, 7, "SubmitReal", 0, 1.0, "USDC", None, None)]
    df = spark.createDataFrame(rows, "treasury long, event_id long, owner long, kind string, candle long, price double, asset string, paper_id long, paper_ids array<long>")
    got = {r.event_id: r for r in treasury.serve(df, {"USDC": 70.0}).collect()}
    assert got[59].issued == 60 and got[59].amount == 10_000 and math.isclose(got[60].residue, 10_000 * 0.9965 / 100 * 120 * 0.9965 - 10_000)
    assert (got[100].issued, got[100].amount) == (1, 50.0) and got[101].issued is None and (got[102].issued, got[102].amount) == (2, 20.0) and got[103].issued is None
    assert got[104].residue is None and got[105].residue is None and got[107].states == "1:Grace,60:Active,61:None" and got[109].states == "1:Grace,60:Violence,61:None"
    assert got[110].residue is None and got[111].issued is None and 106 not in got


def test_best_distances_by_hand(spark):
    path = [101.0, 103.0, 100.0, 104.0, 90.0, 97.0]
    got = simulator.best_distances(spark.createDataFrame([(1, 100.0, "Up", path), (2, 100.0, "Up", [])], "id int, entry double, direction string, path array<double>")).collect()
    assert len(got) == 1

    def net(d, trailing):
        level, best = 100.0 * (1 - d), 100.0
        for x in path:
            if x <= level:
                break
            if trailing and x > best:
                best, level = x, x * (1 - d)
        g = x / 100.0 - 1
        return g - 0.0035 - (1 + g) * 0.0035

    for name, trailing in (("trail", True), ("stop", False)):
        want = max((net(i * 0.005, trailing), -i * 0.005) for i in range(1, 21))
        assert math.isclose(got[0][name], -want[1]) and math.isclose(got[0][f"{name}_net"], want[0])


def test_flips_start_with_the_low_and_trade_both_ways(spark):
    closes, atr = np.array([10.0, 9.0, 11.0, 14.0, 13.0, 10.0, 12.5]), np.array([0.0, 1, 1, 1, 1, 1, 1])
    assert phase_trades.flips(closes, atr, 1.5) == [("rising", 1, 2, 11.0, 9.0), ("falling", 2, 5, 10.0, 14.0), ("rising", 5, 6, 12.5, 10.0)]
    found = spark.createDataFrame([("a", 1.5, i, *x) for i, x in enumerate(phase_trades.flips(closes, atr, 1.5), 1)], phase_trades.FLIPS)
    trades = [tuple(r) for r in phase_trades.flip_trades(found).orderBy("flip").select("direction", "entry", "exit", "held").collect()]
    assert trades == [("short", 11.0, 10.0, 3), ("long", 10.0, 12.5, 1)]
    nets = spark.createDataFrame([(x,) for x in (-0.5, -0.03, -0.01, 0.0, 0.01, 0.03)], "net double")
    assert [r[0] for r in nets.select(phase_trades.bucket(F.col("net"))).collect()] == [0, 1, 2, 3, 4, 5]


def test_change_points_of_flat_and_stepped_series():
    assert all(learning.pelt(np.full(n, v)) == [] for n in (1, 2, 3, 50, 720) for v in (0.1, 1 / 3, 1000.1))
    assert learning.pelt(np.r_[np.zeros(30), np.ones(30) * 5, np.zeros(30)]) == [30, 60]


def test_rhythm_hears_changes(spark):
    d, a = 1024, F.array(*(F.lit(float(x)) for x in (1, 4, 2, 8, 5, 7, 1)))
    rhythm = lambda r, name="x": vectors.rhythm(a, 0, 10, r, d, name)
    short = vectors.rhythm(F.array(F.lit(1.0), F.lit(2.0)), 0, 10, 5, d, "x")
    r = spark.range(1).select(vectors.cosine(rhythm(1.0), rhythm(1.0)).alias("same"), vectors.cosine(rhythm(1.0), rhythm(20.0)).alias("ranges"), vectors.cosine(rhythm(5.0), rhythm(5.0, "y")).alias("names"), vectors.cosine(short, vectors.bind(vectors.atom(F.lit("x"), d), vectors.atom(F.lit("short-window-sentinel"), d))).alias("short")).first()
    assert math.isclose(r["same"], 1.0) and r.ranges < 0.95 and abs(r.names) < 0.2 and math.isclose(r.short, 1.0)


def test_bundles_answer_for_their_keys(spark):
    d = 1024
    name = lambda n: vectors.atom(F.lit(n), d)
    keys, values = [name(f"k{i}") for i in range(5)], [name(f"v{i}") for i in range(5)]
    m = vectors.map_bundle(F.array(*keys), F.array(*values))
    near = lambda v: vectors.nearest(v, F.array(*(F.lit(f"v{i}") for i in range(5))), F.array(*values))
    seq = vectors.list_bundle(F.array(*values[:3]), d)
    df = spark.range(1).select(m.alias("m"), seq.alias("s"), *(k.alias(f"k{i}") for i, k in enumerate(keys)))
    r = df.select(*(near(vectors.map_get(F.col("m"), F.col(f"k{i}")))["name"].alias(f"a{i}") for i in range(5)), near(vectors.map_get(F.col("s"), vectors.atom(F.lit(1), d, "i"))).alias("b"), near(vectors.map_get(F.col("m"), name("other")))["cosine"].alias("c")).first()
    assert [r[f"a{i}"] for i in range(5)] == [f"v{i}" for i in range(5)] and r.b["name"] == "v1" and r.c < vectors.noise_floor(d)


def test_phase_scalars_by_hand(spark):
    rows = [("a", lab, s, s + 4, n, lo, hi, avg, 1.0, 1.0, 1.0) for lab, s, n, lo, hi, avg in (("Valley", 0, 4, 9.0, 10.0, 9.5), ("Transition", 4, 2, 10.0, 14.0, 12.0), ("Peak", 6, 8, 13.0, 15.0, 14.0), ("Valley", 14, 3, 8.0, 8.5, 8.2), ("Transition", 17, 3, 8.0, 8.0, 8.0))]
    df = spark.createDataFrame(rows, "sym string, label string, start_candle long, end_candle long, duration long, close_min double, close_max double, close_avg double, close_open double, close_final double, volume_avg double")
    got = [tuple(r) for r in vocabulary.phase_scalars(df).orderBy("start_candle").select("valley_trend", "peak_trend", "range_trend", "spacing_trend").collect()]
    assert got == [(None, None, None, None), (None, None, 4.0, 0.5), (None, None, 0.5, 4.0), (-0.1368, None, 0.25, 0.38), (-0.1368, None, 0.0, 1.0)]


def test_anomaly_matches_numpy(spark):
    g = np.random.default_rng(2)
    data = [(i, "ab"[i % 2], (g.standard_normal(6) * [5, 3, 1, 0.1, 0.1, 0.1]).tolist()) for i in range(80)]
    got = {r.i: r.residual for r in learning.anomaly(spark.createDataFrame(data, "i int, c string, v array<double>").repartition(3), "c", "v", 2).collect()}
    for c in "ab":
        x = np.array([v for _, k, v in data if k == c])
        ids = [i for i, k, _ in data if k == c]
        _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
        rest = (x - x.mean(axis=0)) - (x - x.mean(axis=0)) @ axes[:2].T @ axes[:2]
        assert np.allclose([got[i] for i in ids], np.linalg.norm(rest, axis=1), atol=1e-8)


def test_segment_divergences_by_hand(spark):
    up = [10.0 * 1.05**k for k in range(15)]
    wave = up + up[::-1] + [x * 1.2 for x in up] + [x * 1.2 for x in up[::-1]]
    rsi = [80.0] * 30 + [60.0] * 30  # the second peak is higher, its strength is not
    df = spark.createDataFrame([("a", (START + pd.Timedelta(hours=i)).to_pydatetime(), float(c), r) for i, (c, r) in enumerate(zip(wave, rsi, strict=True))], "sym string, ts timestamp, close double, rsi double")
    logs = np.log(wave)
    cuts = [0, *learning.pelt(logs), len(logs)]
    ways = [np.sign(logs[b - 1] - logs[a]) for a, b in zip(cuts, cuts[1:], strict=False)]
    peaks = [cuts[i + 1] - 1 for i in range(len(ways) - 1) if ways[i] == 1 and ways[i + 1] == -1]
    want = sum(wave[b] > wave[a] and rsi[b] < rsi[a] for a, b in zip(peaks, peaks[1:], strict=False))
    got = batch.segment_divergences(df).collect()
    assert sum(r.kind == "bearish" for r in got) == want


def test_sinks_round_trip(spark, tmp_path):
    rows = [(i, 10.0 + i, "Peak", "Up", 3, 2, 1, "extra") for i in range(5)]
    df = spark.createDataFrame(rows, "candle int, close double, phase_label string, phase_direction string, phase_duration long, phase_count long, phase_history_len long, more string")
    sinks.append(df, str(tmp_path), "phase_snapshots", "one")
    sinks.append(df.limit(2), str(tmp_path), "phase_snapshots", "two")
    back = spark.read.parquet(f"{tmp_path}/phase_snapshots")
    assert back.where("run_name = 'one'").count() == 5 and back.count() == 7 and "more" not in back.columns and dict(back.dtypes)["candle"] == "bigint"
    with pytest.raises(ValueError, match="lens"):
        sinks.append(df, str(tmp_path), "regime_observer_snapshots", "one")
    df.drop("more").write.parquet(f"{tmp_path}/in")
    q = sinks.append_stream(spark.readStream.schema(df.drop("more").schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/s", "phase_snapshots", "live", f"{tmp_path}/cp", "0 seconds")
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{tmp_path}/s/phase_snapshots").count() == 5
    for name in sinks.TABLES:
        empty = spark.createDataFrame([], ", ".join(f"{n} {t.replace(';', ',')}" for n, t in sinks._fields(sinks.TABLES[name])))
        assert sinks.conform(empty, name).columns == empty.columns


def test_two_proportion_z(spark):
    r = simulator.two_proportion_z(spark.createDataFrame([(69, 354, 1, 340)], "a int, n int, b int, m int"), "a", "n", "b", "m").first()
    p = 70 / 694
    assert math.isclose(r.z, (69 / 354 - 1 / 340) / math.sqrt(p * (1 - p) * (1 / 354 + 1 / 340)))


def test_rounding_is_half_away_on_scaled_doubles(spark):
    r = spark.createDataFrame([(1.005, -2.5, 0.125)], "a double, b double, c double").select(scalars.half_away(F.col("a"), 2).alias("a"), scalars.half_away(F.col("b"), 0).alias("b"), scalars.half_away(F.col("c"), 2).alias("c"), scalars.bucket(F.lit(7.3), F.lit(0.5)).alias("d"), scalars.bucket(F.lit(7.3), F.lit(0.0)).alias("e")).first()
    assert tuple(r) == (1.0, -3.0, 0.13, 7.5, 7.3)


def test_vector_geometry(spark):
    d = 1024
    name = lambda n: vectors.atom(F.lit(n), d)
    df = spark.range(1).select(name("a").alias("a"), name("b").alias("b"), name("c").alias("c"), vectors.thermometer(F.lit(1.95), F.lit(-100.0), F.lit(100.0), d).alias("t"), vectors.thermometer(F.lit(2.05), F.lit(-100.0), F.lit(100.0), d).alias("u"))
    r = df.select(
        vectors.cosine(F.col("a"), F.col("b")).alias("apart"), vectors.cosine(vectors.bind(vectors.bind(F.col("a"), F.col("b")), F.col("b")), F.col("a")).alias("unbound"),
        vectors.cosine(vectors.bundle(F.array("a", "b", "c")), F.col("a")).alias("member"), vectors.cosine(vectors.permute(vectors.permute(F.col("a"), 5), d - 5), F.col("a")).alias("turned"),
        vectors.cosine(F.col("t"), F.col("u")).alias("near"), vectors.dot(vectors.reject(F.col("a"), F.col("b")), F.col("b")).alias("orthogonal"),
        (vectors.from_hex(vectors.to_hex(F.col("a"))) == F.col("a")).alias("lossless"), vectors.checked_bundle(F.array_repeat(F.col("a"), 33), d)["overflow"].alias("over"),
        (vectors.atom(F.lit(1), d, "i") == vectors.atom(F.lit("1"), d)).alias("typed"),
        vectors.cosine(vectors.rhythm(F.array(*(F.lit(float(x)) for x in (1, 2, 3, 4, 5))), 0, 10, 5, d), vectors.rhythm(F.array(*(F.lit(float(x)) for x in (1, 2, 3, 4, 5))), 0, 10, 5, d)).alias("same"),
    ).first()
    assert abs(r.apart) < 0.16 and r.unbound == 1.0 and r.member > 0.4 and math.isclose(r.turned, 1.0) and r.near > 0.99
    assert abs(r.orthogonal) < 1e-6 and r.lossless and r.over and not r.typed and math.isclose(r["same"], 1.0)


def test_sources(spark, tmp_path):
    rows = [(START.to_pydatetime(), 1.0, 2.0, 0.5, 1.5, 3.0)]
    good = spark.createDataFrame(rows, candles.OHLCV)
    good.write.parquet(f"{tmp_path}/a.parquet")
    assert candles.read_streams(spark, [f"BTC:USDC:{tmp_path}/a.parquet", f"ETH:USDC:{tmp_path}/a.parquet"]).select("sym").distinct().count() == 2
    good.drop("open").write.parquet(f"{tmp_path}/b.parquet")
    with pytest.raises(ValueError, match="open"):
        candles.read_ohlcv(spark, f"{tmp_path}/b.parquet")
    good.withColumn("close", F.lit(None).cast("double")).write.parquet(f"{tmp_path}/c.parquet")
    with pytest.raises(Exception, match="null in close"):
        candles.read_ohlcv(spark, f"{tmp_path}/c.parquet").collect()
    assert candles.open_bounded(candles.read_ohlcv(spark, f"{tmp_path}/a.parquet"), -3).count() == 0


def test_indicator_quirks(spark):
    df = spark.createDataFrame(frame(waves(60)))
    got = indicators.enrich(indicators.time_parts(df)).orderBy("ts").toPandas()
    assert (got.roc_12 == 0).all() and got.roc_12_whole.abs().sum() > 0
    assert (got.stoch_k[:13] == 50).all() and (got.williams_r[:13] == -50).all() and (got.kama_er[:9] == 0.5).all() and (got.aroon_up[:24] == 50).all()
    assert math.isclose(got.sma20[2], np.mean(got.close[:3]))
    rich = vocabulary.standard(indicators.enrich(indicators.time_parts(folds.fold(df))))
    found = vocabulary.facts(rich).toPandas()
    assert set(found.module) >= set(vocabulary.MODULES) - {"divergence"}
    scales = found[found.kind == "scaled"]
    assert (scales.hi >= 0).all() and (scales.lo == -scales.hi).all() and ((scales.hi * 100).round(6) % 1 == 0).all()
    since = found[found.name == "since-rsi-extreme"].sort_values("ts").value.to_list()
    assert since[0] == 1.0 and min(since) >= 1.0  # the first row's rsi is 100


def test_streams_equal_batches(spark, tmp_path):
    pdf = pd.concat([frame(waves(80, s), sym) for s, sym in ((1, "a"), (2, "b"))])
    for k in range(4):
        spark.createDataFrame(pdf[pdf.ts.between(START + pd.Timedelta(hours=20 * k), START + pd.Timedelta(hours=20 * k + 19))]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = live.stream_folds(source).writeStream.format("memory").queryName("folds").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("folds").toPandas().sort_values(["sym", "ts"]).reset_index(drop=True)
    want = pd.concat([folds.series(g) for _, g in pdf.groupby("sym")]).sort_values(["sym", "ts"]).reset_index(drop=True)
    assert len(got) == len(want) and all(np.allclose(got[c], want[c]) for c in ("ema20", "atr", "rsi"))


def test_stream_ledger_equals_batch(spark, tmp_path):
    g = np.random.default_rng(4)
    req = pd.DataFrame({"owner": g.integers(0, 3, 200), "event_id": range(200), "candle": np.arange(200) * 7, "price": 10 + g.random(200) * 5, "kind": g.choice(["Submit", "Exit", "Tick"], 200)}).astype({"owner": "int64", "event_id": "int64", "candle": "int64"})
    for k in range(2):
        spark.createDataFrame(req.iloc[100 * k : 100 * k + 100]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = live.stream_ledger(source).writeStream.format("memory").queryName("ledger").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.owner, r.paper_id, r.resolved_at, r.state) for r in spark.table("ledger").collect())
    want = sorted((r.owner, r.paper_id, r.resolved_at, r.state) for r in treasury.ledger(spark.createDataFrame(req)).where("state <> 'Active'").collect())
    assert got == want


def test_catalogue_runs_without_the_corpus_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['candlemill.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'fold_all' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True)
