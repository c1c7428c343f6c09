"""Preference loss arithmetic over logged token log-probabilities.

Input is a flat token table ``(model, pair_id, side, pos, label, weight,
policy_logp, ref_logp)``: the per-token log-probabilities a policy and a
reference model assigned to the target token at ``pos`` (the shifted
position, so ``pos >= 1``).  The neural forward pass itself is outside this
library; everything after it is aggregation:

* A13: per (pair, side) the weighted mean log-prob.  With the reference's
  normalisation (weights rescaled to mean 1 over valid tokens) this is
  sum(lp * w) / max(sum(w), 1e-6).
* A14: x = (pi_c - pi_r) - (ref_c - ref_r); loss = -log sigmoid(beta x).
* A15: adaptive barrier on chosen tokens whose policy prob < tau.
* A16: the nine logged metrics per batch.

One groupBy per (model, pair) with conditional sums (map-side combined),
then one per batch - token rows are never shuffled individually.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from spanpref.functions.draws import TWO_POW_52
from spanpref.functions.numeric import sigmoid, softplus
from spanpref.operators.tokens import IGNORE, SIDES, number_batches, slices

#: Sides of the flat token table; ``pair`` only keeps its pair.
KINDS = ("pair", *SIDES)


@dataclass
class LossParams:
    beta: float = 0.5
    policy_prob_threshold: float = 0.66
    sft_barrier_weight: float = 0.5
    batch_size: int = 1


def token_logps_from_sides(sides: DataFrame, seed: int = 42) -> DataFrame:
    """Flat token table from :func:`spanpref.operators.tokens.token_sides`.

    Shifted positions (``pos >= 1``) that are supervised, both sides in one pass,
    and one row of side ``pair`` for each pair, so that a pair whose answers lie
    beyond the length limit stays (with log-probabilities 0).  The two
    log-probabilities are keyed draws ``ln(max(u, 1e-6))`` standing in for a
    model's logged values; a batch's are made together.  ``sides`` brings whole arrays or tails.
    """
    def tail(name: str, side: str):
        # only the supervised tail: prompts are long and fully masked
        if f"{side}_tail_{name}" in sides.columns:
            return F.col(f"{side}_tail_{name}")
        m = F.col(f"{side}_m")
        return F.slice(f"{side}_{name}", m + 1, F.greatest(F.size(f"{side}_{name}") - m, F.lit(0)))

    narrow = sides.select(
        "model", "pair_id",
        *[F.concat_ws("|", F.lit(str(seed)), F.lit(of), F.col("model").cast("string"), F.col("pair_id").cast("string")) for of in ("policy", "reference")],
        *[c for s in SIDES for c in (F.col(f"{s}_m"), tail("labels", s), tail("weights", s))],
    )
    schema = StructType([
        *[sides.schema[c] for c in ("model", "pair_id")],
        *[StructField(c, t) for c, t in (("side", StringType()), ("pos", LongType()), ("label", LongType()), ("weight", DoubleType()))],
        StructField("policy_logp", DoubleType()), StructField("ref_logp", DoubleType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            policy, reference = (batch.column(k).to_pylist() for k in (2, 3))
            parts = []  # of every pair and side: pair, side, positions, labels, weights
            for i in range(batch.num_rows):
                parts.append((i, 0, np.zeros(1, np.int64), np.array([IGNORE]), np.zeros(1)))
                for side, at in enumerate((4, 7), 1):
                    label, weight = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (at + 1, at + 2))
                    pos = batch.column(at)[i].as_py() + np.arange(len(label))
                    kept = (label != IGNORE) & (pos >= 1)
                    parts.append((i, side, pos[kept], label[kept], weight[kept]))
            sizes = [len(p[2]) for p in parts]
            pair, side = (pa.array(np.repeat([p[k] for p in parts], sizes)) for k in (0, 1))
            drawn = [_logps([f"{of[p[0]]}|{KINDS[p[1]]}|" for p in parts], [p[2] for p in parts]) for of in (policy, reference)]
            pos, label, weight = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))
            columns = [batch.column(0).take(pair), batch.column(1).take(pair), pa.array(KINDS).take(side), pa.array(pos), pa.array(label.astype(np.int64)), pa.array(weight), *map(pa.array, drawn)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return narrow.mapInArrow(run, schema)


def _logps(keys: list[str], places: list[np.ndarray]) -> np.ndarray:
    """``ln(max(u, 1e-6))`` of the draws (``functions.draws``) with each key's places as its last part."""
    digests = b"".join([hashlib.md5(key + b"%d" % k).digest() for key, at in zip((k.encode() for k in keys), places) for k in at.tolist()])
    u = (np.frombuffer(digests, ">u8")[::2] >> np.uint64(12)) / TWO_POW_52
    return np.log(np.maximum(u, 1e-6))


def sequence_logps(tokens: DataFrame, p: LossParams = LossParams()) -> DataFrame:
    """A12/A13/W5 + barrier sums: one row per (model, pair_id) with both sides.

    ``tokens`` holds supervised shifted positions (label <> -100, pos >= 1), and
    may hold a row of side ``pair`` that only keeps its pair.
    """
    log_tau = math.log(p.policy_prob_threshold)
    c = F.col("side") == "chosen"
    r = F.col("side") == "rejected"
    gate = c & (F.col("policy_logp") < F.lit(log_tau))
    agg = tokens.groupBy("model", "pair_id").agg(
        F.sum(F.when(c, F.col("policy_logp") * F.col("weight"))).alias("c_pol"),
        F.sum(F.when(c, F.col("ref_logp") * F.col("weight"))).alias("c_ref"),
        F.sum(F.when(c, F.col("weight"))).alias("c_w"),
        F.count_if(c).alias("c_n"),
        F.sum(F.when(r, F.col("policy_logp") * F.col("weight"))).alias("r_pol"),
        F.sum(F.when(r, F.col("ref_logp") * F.col("weight"))).alias("r_ref"),
        F.sum(F.when(r, F.col("weight"))).alias("r_w"),
        F.count_if(r).alias("r_n"),
        F.sum(F.when(gate, -F.col("policy_logp") * F.col("weight"))).alias("b_num"),
        F.sum(F.when(gate, F.col("weight"))).alias("b_den"),
        F.count_if(gate).alias("n_gate"),
    )
    z = F.lit(0.0)

    def seq(num, w):
        return F.coalesce(F.col(num), z) / F.greatest(F.coalesce(F.col(w), z), F.lit(1e-6))

    # normalised weights: w * tok_count / w_sum_raw (A15 uses these)
    scale = F.greatest(F.col("c_n").cast("double"), F.lit(1.0)) / F.greatest(F.coalesce(F.col("c_w"), z), F.lit(1e-6))
    return agg.select(
        "model", "pair_id",
        seq("c_pol", "c_w").alias("pi_c"), seq("r_pol", "r_w").alias("pi_r"),
        seq("c_ref", "c_w").alias("ref_c"), seq("r_ref", "r_w").alias("ref_r"),
        F.col("c_n").alias("chosen_tokens"), F.col("r_n").alias("rejected_tokens"),
        (scale * F.coalesce(F.col("b_num"), z) / F.greatest(scale * F.coalesce(F.col("b_den"), z), F.lit(1.0))).alias("barrier"),
        F.col("n_gate").alias("gate_tokens"),
    )


def pair_losses(seq: DataFrame, p: LossParams = LossParams()) -> DataFrame:
    """Preference logits, probability and loss per pair."""
    x = (F.col("pi_c") - F.col("pi_r")) - (F.col("ref_c") - F.col("ref_r"))
    bx = F.lit(p.beta) * F.col("pref_logits")
    return (
        seq.withColumn("pref_logits", x)
        .withColumn("p_pref", sigmoid(bx))
        .withColumn("pref_loss", softplus(-bx))
    )


def batch_metrics(losses: DataFrame, p: LossParams = LossParams()) -> DataFrame:
    """The nine logged metrics per (model, batch) of ``batch_size`` consecutive pairs."""
    agg = number_batches(losses, p.batch_size).groupBy("model", "batch").agg(
        F.avg("pref_loss").alias("loss_preference"),
        (F.avg("barrier") * F.lit(p.sft_barrier_weight)).alias("loss_barrier"),
        F.avg(F.exp("pi_c")).alias("policy_prob_chosen"),
        (F.sum("gate_tokens") / F.greatest(F.sum("chosen_tokens").cast("double"), F.lit(1.0))).alias("barrier_active_pct"),
        F.avg("p_pref").alias("pref_p_pref"),
        F.avg("pref_logits").alias("logits_mean"),
        F.max("pref_logits").alias("logits_max"),
        F.min("pref_logits").alias("logits_min"),
        F.count(F.lit(1)).alias("n_pairs"),
    )
    return agg.withColumn("loss", F.col("loss_preference") + F.col("loss_barrier"))
