"""Strategy sweep: the variant grid and its gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORES = ("hgb", "rf", "mlp")
KERNELS = ("dwt_db2", "dwt_db4", "dwt_db6", "dwt_db8", "cwt_morlet", "cwt_ricker")
WHITENED = ("dwt_db8", "cwt_morlet", "cwt_ricker")
SCHEMA = (
    "suffix string, use_proba boolean, proba_enter double, hmm_gate boolean, fft_gate boolean, wavelet_gate boolean, "
    "dmd_gate boolean, vol_target double, stop_loss double, take_profit double, trailing_atr_mult double, "
    "wavelet_kernel string, wavelet_ar_p int"
)


def options() -> list[tuple]:
    """The twenty settings every core model is tried with."""

    def row(name, gates="", target=0.10, proba=False, kernel=None, ar=None, sl=None, tp=None):
        on = set(gates.split())
        return (
            name, proba, 0.60 if proba else 0.55, "hmm" in on, "fft" in on, "wavelet" in on, "dmd" in on, target, sl, tp, None, kernel, ar,
        )

    plain = [row("baseline", target=None), row("voltarget"), row("stops", target=None, sl=0.01, tp=0.02)]
    gates = [row("hmm", "hmm"), row("fft", "fft"), row("wavelet", "wavelet", kernel="dwt_db8"), row("dmd", "dmd")]
    kernels = [row(f"wv_{k}", "wavelet", kernel=k) for k in KERNELS]
    kernels += [row(f"wv_{k}_ar5", "wavelet", kernel=k, ar=5) for k in WHITENED]
    mixed = [row("hmm_fft_dmd", "hmm fft dmd"), row("hmm_wavelet_dmd", "hmm wavelet dmd")]
    likely = [row("proba_hmm_fft", "hmm fft", proba=True), row("proba_hmm_wavelet", "hmm wavelet", proba=True)]
    return plain + gates + kernels + mixed + likely


def variant_grid(spark: SparkSession) -> DataFrame:
    """3 cores x 20 settings, named <core>_<setting>."""
    cores = F.explode(F.array(*[F.lit(c) for c in CORES]))
    grid = spark.createDataFrame(options(), SCHEMA).withColumn("core", cores)
    return grid.withColumn("name", F.concat_ws("_", "core", "suffix")).drop("suffix")


def gate_passes(*, wavelet: str = "wavelet_ok") -> Column:
    """All gates a variant asks for are open. The mixture gate closes on risk-off rows."""
    asks = lambda flag, ok: ~F.col(flag) | F.coalesce(ok, F.lit(False))
    return (
        asks("fft_gate", F.col("fft_ok")) & asks("wavelet_gate", F.col(wavelet)) & asks("dmd_gate", F.col("dmd_ok"))
        & asks("hmm_gate", ~F.col("risk_off"))
    )


def gated_signals(signals: DataFrame, variants: DataFrame) -> DataFrame:
    """Signals of each core under each of its variants, 0 where a gate is closed.

    ``signals`` holds symbol, ts, core, signal, proba_signal, the gate columns and, if kernels
    differ, a map ``wavelet_by_kernel`` from kernel (and _ar<p>) to its gate."""
    v = signals.join(F.broadcast(variants), "core")  # sixty rows at most
    raw = F.when(F.col("use_proba"), F.col("proba_signal")).otherwise(F.col("signal"))
    if "wavelet_by_kernel" in signals.columns:
        kernel = F.coalesce("wavelet_kernel", F.lit("dwt_db8"))
        key = F.when(F.col("wavelet_ar_p").isNull(), kernel).otherwise(
            F.concat(kernel, F.lit("_ar"), F.col("wavelet_ar_p").cast("string"))
        )
        v = v.withColumn("wavelet_ok", F.coalesce(F.col("wavelet_by_kernel")[key], F.lit(False)))
    return v.withColumn("signal", F.when(gate_passes(), raw).otherwise(0.0))
