"""The feature table: a registry of features, band envelopes made once, features in canonical order in one vector.

A recording is a table with a row a trial, window and channel: ``session, trial, win_idx, channel, samples``.  Features
that look at one channel are columns; those that look at several are made after the channels of a window are gathered,
by channel name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mesostate.operators import diagnostics, kernels, signals

#: Band limits in Hz, and the order in which bands are laid out.
BANDS = {"alpha": (8.0, 13.0), "theta": (4.0, 8.0), "beta": (13.0, 30.0)}
#: Channels of the montage in its own order, and pairs of left and right ones.
CHANNELS = ("Fp1", "Fp2", "F7", "F3", "Fz", "F4", "F8", "T3", "C3", "Cz", "C4", "T4", "T5", "P3", "Pz", "P4", "T6", "O1", "O2")
PAIRS = (("F3", "F4"), ("C3", "C4"), ("P3", "P4"), ("O1", "O2"), ("T3", "T4"), ("T5", "T6"), ("F7", "F8"))
#: Switches of an experiment's description and the features that they stand for.
FLAGS = {
    "use_alpha": ["alpha_envelope"],
    "use_theta": ["theta_envelope"],
    "use_beta": ["beta_envelope"],
    "use_hjorth": ["hjorth_mobility", "hjorth_complexity"],
    "use_entropy": ["temporal_entropy"],
    "use_relative_power": ["relative_power"],
    "use_band_ratios": ["band_ratios"],
    "use_asymmetry": ["hemispheric_asymmetry"],
}


#: What is known of each feature.
META_COLUMNS = ("category", "gaussian_friendly", "scaling", "smoothness", "stationarity", "window_sensitivity", "subject_variability", "suitability", "per_channel", "redundant_with")
META = {
    "hjorth_mobility": ("temporal", True, "zscore", "medium", "quasi_stationary", "medium", "medium", "high", True, ["hjorth_complexity"]),
    "hjorth_complexity": ("temporal", True, "zscore", "medium", "quasi_stationary", "medium", "medium", "medium", True, ["hjorth_mobility"]),
    "temporal_entropy": ("temporal", False, "robust_zscore", "low", "quasi_stationary", "high", "medium", "medium", True, ["hjorth_complexity"]),
    "alpha_envelope": ("spectral", False, "log_zscore", "high", "quasi_stationary", "medium", "high", "medium", True, ["rms", "gfp"]),
    "theta_envelope": ("spectral", True, "zscore", "high", "quasi_stationary", "high", "medium", "high", True, []),
    "beta_envelope": ("spectral", True, "log_zscore", "medium", "quasi_stationary", "high", "high", "medium", True, []),
    "relative_power": ("spectral", False, "zscore", "high", "quasi_stationary", "medium", "low", "high", True, ["alpha_envelope", "theta_envelope", "beta_envelope"]),
    "band_ratios": ("ratio", True, "zscore", "medium", "quasi_stationary", "medium", "medium", "high", True, ["relative_power", "alpha_envelope", "theta_envelope", "beta_envelope"]),
    "hemispheric_asymmetry": ("connectivity", True, "zscore", "medium", "quasi_stationary", "medium", "high", "medium", False, ["alpha_envelope", "theta_envelope", "beta_envelope"]),
}


@dataclass(frozen=True)
class Feature:
    """``compute`` gives a channel's numbers from its ``samples`` and, if ``needs_bands``, its ``env`` of band envelopes.

    Features over pairs of channels have none and are made by ``asymmetry``.
    """

    name: str
    width: int
    compute: Callable[[Column, Column], list[Column]] | None = None
    needs_bands: bool = False
    raw_band: str = ""
    meta: dict = field(default_factory=dict)


class Registry:
    """Features by name, in order of registration."""

    def __init__(self):
        self._known: dict[str, Feature] = {}

    def register(self, feature: Feature) -> Feature:
        if not feature.name or " " in feature.name:
            raise ValueError(f"not a feature's name: {feature.name!r}")
        if feature.name in self._known:
            raise ValueError(f"feature {feature.name} is known already")
        self._known[feature.name] = feature
        return feature

    def get(self, name: str) -> Feature:
        if name not in self._known:
            raise KeyError(f"unknown feature {name}; known are {', '.join(self._known)}")
        return self._known[name]

    def is_registered(self, name: str) -> bool:
        return name in self._known

    def names(self) -> list[str]:
        return sorted(self._known)

    def __len__(self) -> int:
        return len(self._known)

    def __contains__(self, name: str) -> bool:
        return name in self._known

    def resolve(self, description: dict | None) -> list[Feature]:
        """Features of a description: its ``active`` list as given, or its switches in their fixed order.

        An empty description has none; unknown names and names given twice in a list are errors.
        """
        if not description:
            return []
        if "active" in description:
            names = list(description["active"] or [])
            if len(set(names)) < len(names):
                raise ValueError(f"features given twice: {sorted({n for n in names if names.count(n) > 1})}")
        else:
            names = list(dict.fromkeys(n for flag, own in FLAGS.items() if description.get(flag) for n in own))
        return [self.get(n) for n in names]

    def metadata(self, spark: SparkSession) -> DataFrame:
        """``name, width, needs_bands`` and the ``META_COLUMNS`` of all features, by name."""
        rows = [(f.name, f.width, f.needs_bands, *[f.meta.get(c) for c in META_COLUMNS]) for f in sorted(self._known.values(), key=lambda f: f.name)]
        kinds = {"gaussian_friendly": "boolean", "per_channel": "boolean", "redundant_with": "array<string>"}
        return spark.createDataFrame(rows, "name string, width int, needs_bands boolean, " + ", ".join(f"{c} {kinds.get(c, 'string')}" for c in META_COLUMNS))


REGISTRY = Registry()


def _band(name: str) -> Feature:
    return Feature(f"{name}_envelope", 1, lambda x, env: [env[name]], True, name)


for _feature in (
    Feature("hjorth_mobility", 1, lambda x, env: [signals.hjorth(x)["mobility"]]),
    Feature("hjorth_complexity", 1, lambda x, env: [signals.hjorth(x)["complexity"]]),
    Feature("temporal_entropy", 1, lambda x, env: [signals.histogram_entropy(x)]),
    *[_band(b) for b in BANDS],
    Feature("relative_power", 3, lambda x, env: relative_power(env), True),
    Feature("band_ratios", 3, lambda x, env: diagnostics.band_ratios(env["alpha"], env["theta"], env["beta"]), True),
    Feature("hemispheric_asymmetry", len(PAIRS) * len(BANDS), None, True),
):
    REGISTRY.register(replace(_feature, meta=dict(zip(META_COLUMNS, META[_feature.name], strict=True))))


def relative_power(env: Column, bands: tuple[str, ...] = tuple(BANDS)) -> list[Column]:
    """Shares of all bands in their sum; a band that ``bands`` does not name counts as 0."""
    value = {b: env[b] if b in bands else F.lit(0.0) for b in BANDS}
    share = signals.relative_power(value["alpha"], value["theta"], value["beta"])
    return [share[b] for b in BANDS]


def finite(value: Column) -> Column:
    """A number, or 0 where it is none or not finite."""
    known = value.cast("double")
    return F.when(known.isNull() | F.isnan(known) | (F.abs(known) == float("inf")), 0.0).otherwise(known)


def with_envelopes(df: DataFrame, rate: float, theta_log: str = "log1p", samples: str = "samples", into: str = "env") -> DataFrame:
    """``df`` with a struct of all band envelopes, each made once (F11).  ``theta_log`` ``floor`` gives theta its own filter ends and logarithm."""
    found = [kernels.envelope(samples, rate, lo, hi, theta_log if b == "theta" else "log1p").alias(b) for b, (lo, hi) in BANDS.items()]
    return df.select("*", *[f.alias(f"_{b}") for f, b in zip(found, BANDS, strict=True)]).withColumn(into, F.struct(*[finite(F.col(f"_{b}")).alias(b) for b in BANDS])).drop(*[f"_{b}" for b in BANDS])


def asymmetry(by_channel: Column, bands: tuple[str, ...] = tuple(BANDS)) -> Column:
    """``(R - L) / (R + L)`` of each band, in order, and pair, from a map of channel to envelopes; none without bands."""
    out = [signals.asymmetry(by_channel[left][b], by_channel[right][b]) for b in BANDS if b in bands for left, right in PAIRS]
    return F.array(*[finite(v) for v in out]) if out else F.array().cast("array<double>")


def columns_of(features: list[Feature], channels: tuple[str, ...], raw_bands: bool = True) -> list[tuple[int, str, str, str]]:
    """``dim, feature, part, channel`` of each number of a feature vector (DG1, DG2)."""
    out = []
    for f in features:
        if f.raw_band and not raw_bands:
            continue
        if f.compute is None:
            out += [(f.name, band, f"{left}-{right}") for band in BANDS for left, right in PAIRS]
        else:
            out += [(f.name, str(part), c) for part in range(f.width) for c in channels]
    return [(k, *row) for k, row in enumerate(out)]


def assemble(windows: DataFrame, features: list[Feature], channels: tuple[str, ...] = CHANNELS, rate: float = 250.0, raw_bands: bool = True, theta_log: str = "log1p") -> DataFrame:
    """``session, trial, win_idx, x``: features in the given order, each with its parts and their channels.

    Raw bands are made if something depends on them, and left out of ``x`` unless ``raw_bands``.  Windows of a trial are
    one group by trial and window, of as many rows as there are channels; one that lacks a channel raises.
    """
    if not features:
        raise ValueError("no feature is active")
    shown = [f for f in features if raw_bands or not f.raw_band]
    given = with_envelopes(windows, rate, theta_log) if any(f.needs_bands for f in features) else windows.withColumn("env", F.lit(None).cast("struct<alpha:double,theta:double,beta:double>"))
    single = [f for f in shown if f.compute is not None]
    numbers = F.array(*[finite(v) for f in single for v in f.compute(F.col("samples"), F.col("env"))]) if single else F.array().cast("array<double>")
    per_channel = given.select("session", "trial", "win_idx", "channel", "env", numbers.alias("v"))
    gathered = per_channel.groupBy("session", "trial", "win_idx").agg(F.map_from_entries(F.collect_list(F.struct("channel", F.struct("v", "env").alias("s")))).alias("m"))
    missing = F.size(F.array_except(F.lit(list(channels)), F.map_keys("m"))) > 0
    complete = gathered.withColumn("m", F.when(missing, F.raise_error(F.lit("a window lacks a channel"))).otherwise(F.col("m")))
    envelopes = F.transform_values("m", lambda c, s: s["env"])
    parts, at = [], 0
    for f in shown:
        if f.compute is None:
            parts.append(signals.let(envelopes, lambda m: asymmetry(m)))
            continue
        for k in range(at, at + f.width):
            parts.append(F.array(*[F.col("m")[c]["v"][k] for c in channels]))
        at += f.width
    return complete.select("session", "trial", "win_idx", F.concat(*parts).alias("x"))
