"""Paper-position simulator: one open position per run, closed by deadline or by a phase that turns against it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEADLINE, MIN_RESIDUE, FEE_BPS = 288, 0.01, 35.0
OUTCOMES = "sym string, thinker string, paper_id long, direction string, opened_at long, resolved_at long, state string, residue double, loss double"


def residue(entry: float, price: float, direction: str, fee_bps: float = FEE_BPS) -> float:
    raw = 0.0 if entry == 0 else (price - entry) / entry
    return (raw if direction == "Up" else -raw) - 2.0 * fee_bps / 1e4


def always_up(sma20: float, sma50: float) -> str:
    return "Up"


def sma_cross(sma20: float, sma50: float) -> str:
    """Up or Down outside a band of 0.1 % about the slower mean, else Hold."""
    return "Up" if sma20 > sma50 * 1.001 else "Down" if sma20 < sma50 * 0.999 else "Hold"


THINKERS = {"always-up": always_up, "sma-cross": sma_cross}


def run(pdf: pd.DataFrame, thinker: str, deadline: int = DEADLINE, min_residue: float = MIN_RESIDUE, fee_bps: float = FEE_BPS) -> pd.DataFrame:
    """Outcomes of one run. pdf: a series with close, sma20, sma50, phase_label and phase_generation.

    The deadline is tested before grace. Grace needs a phase change to a label against the position (Peak for Up, Valley
    for Down), the least residue, and the opposite signal. A closing candle doesn't open again.
    """
    pdf = pdf.sort_values("ts", kind="stable")
    decide, paper, out, before, n_papers = THINKERS[thinker], None, [], 0, 0
    columns = zip(pdf["close"], pdf["sma20"], pdf["sma50"], pdf["phase_label"], pdf["phase_generation"], strict=True)
    for n, (close, fast, slow, label, generation) in enumerate(columns, 1):
        signal = decide(fast, slow)
        if paper is None:
            if signal != "Hold":
                n_papers += 1
                paper = (n_papers, signal, n, close)
        else:
            gain = residue(paper[3], close, paper[1], fee_bps)
            against = label == ("Peak" if paper[1] == "Up" else "Valley")
            leave = signal != "Hold" and signal != paper[1]
            if n >= paper[2] + deadline:
                out.append((pdf["sym"].iloc[0], thinker, paper[0], paper[1], paper[2], n, "Violence", 0.0, abs(gain)))
                paper = None
            elif generation != before and against and leave and gain >= min_residue:
                out.append((pdf["sym"].iloc[0], thinker, paper[0], paper[1], paper[2], n, "Grace", gain, 0.0))
                paper = None
        before = generation
    return pd.DataFrame(out, columns=["sym", "thinker", "paper_id", "direction", "opened_at", "resolved_at", "state", "residue", "loss"])


def simulate(labelled: DataFrame, thinkers: tuple[str, ...] = ("always-up", "sma-cross"), deadline: int = DEADLINE, min_residue: float = MIN_RESIDUE, fee_bps: float = FEE_BPS) -> DataFrame:
    """paper_resolutions of every series and thinker; a run is a group."""
    runs = labelled.select("sym", "ts", "close", "sma20", "sma50", "phase_label", "phase_generation").withColumn("thinker", F.explode(F.array(*(F.lit(t) for t in thinkers))))
    return runs.groupBy("sym", "thinker").applyInPandas(lambda pdf: run(pdf, pdf["thinker"].iloc[0], deadline, min_residue, fee_bps), OUTCOMES)


def aggregate(outcomes: DataFrame, *by: str) -> DataFrame:
    grace = F.col("state") == "Grace"
    return outcomes.groupBy(*by).agg(F.count("*").alias("papers"), F.count_if(grace).alias("grace"), F.count_if(~grace).alias("violence"), F.sum("residue").alias("residue"), F.sum("loss").alias("loss"))


def two_proportion_z(df: DataFrame, a: str, n_a: str, b: str, n_b: str) -> DataFrame:
    p = (F.col(a) + F.col(b)) / (F.col(n_a) + F.col(n_b))
    se = F.sqrt(p * (1 - p) * (1.0 / F.col(n_a) + 1.0 / F.col(n_b)))
    return df.withColumn("z", F.when(se > 0, (F.col(a) / F.col(n_a) - F.col(b) / F.col(n_b)) / F.when(se > 0, se)).otherwise(0.0))


def best_distances(entries: DataFrame, steps: int = 20, step: float = 0.005, fee: float = 0.0035) -> DataFrame:
    """For each entry with its later closes (id, entry, direction, path array): the trailing distance and the fixed one that net
    most, ties to the smaller, and what they net.

    A trail ends at the first close that is the distance below the best one so far, a stop at the first that is below
    the entry by it; otherwise at the last close. The fee is taken from the entry and from what the exit brings.
    """
    tried = entries.withColumn("distance", F.explode(F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda i: i * step)))
    up = F.col("direction") == "Up"
    tried = tried.withColumns({"_p": F.when(up, F.col("path")).otherwise(F.transform("path", lambda x: 1.0 / x)), "_e": F.when(up, F.col("entry")).otherwise(1.0 / F.col("entry"))})
    state = F.struct(F.col("_e").alias("best"), F.col("_e").alias("exit"), F.lit(False).alias("done"))

    def walk(s, x):
        return F.when(s["done"], s).otherwise(F.struct(F.greatest(s["best"], x).alias("best"), x.alias("exit"), (x <= s["best"] * (1 - F.col("distance"))).alias("done")))

    below = F.filter("_p", lambda x: x <= F.col("_e") * (1 - F.col("distance")))
    exits = {"trail": F.aggregate("_p", state, walk)["exit"], "stop": F.coalesce(F.get(below, F.lit(0)), F.element_at("_p", -1))}
    gross = {k: x / F.col("_e") - 1 for k, x in exits.items()}
    net = tried.where(F.size("_p") > 0).select("id", "distance", *((g - fee - (1 + g) * fee).alias(f"_{k}") for k, g in gross.items()))
    return net.groupBy("id").agg(*(a for k in exits for a in (F.max_by("distance", F.struct(f"_{k}", -F.col("distance"))).alias(k), F.max(f"_{k}").alias(f"{k}_net"))))


def label_trails(outcomes: DataFrame, labelled: DataFrame) -> DataFrame:
    """outcomes: of simulate; labelled: its input with at, the number of the row from 1. The triggers of each paper, rows at which a
    new phase began while it was open: Exit at the one that closed it in grace and at all of a paper that failed, else Hold;
    and the directed move of the price until then, without fees."""
    before = F.lag("phase_generation").over(Window.partitionBy("sym").orderBy("at"))
    turns = labelled.withColumn("_before", before).where("phase_generation <> _before").select(F.col("sym").alias("t_sym"), F.col("at").alias("t_at"), "phase_label", "close")
    entry = labelled.select(F.col("sym").alias("e_sym"), F.col("at").alias("e_at"), F.col("close").alias("entry"))
    rows = outcomes.withColumn("t", F.explode(F.sequence(F.col("opened_at") + 1, F.col("resolved_at"))))
    rows = rows.join(turns, (F.col("sym") == F.col("t_sym")) & (F.col("t") == F.col("t_at"))).join(entry, (F.col("sym") == F.col("e_sym")) & (F.col("opened_at") == F.col("e_at")))
    move = F.when(F.col("entry") != 0, (F.col("close") - F.col("entry")) / F.when(F.col("entry") != 0, F.col("entry"))).otherwise(0.0)
    out = F.when((F.col("state") == "Violence") | (F.col("t") == F.col("resolved_at")), "Exit").otherwise("Hold")
    return rows.select("sym", "thinker", "paper_id", F.col("t").alias("at"), "phase_label", out.alias("label"), F.when(F.col("direction") == "Up", move).otherwise(-move).alias("price_move"))
