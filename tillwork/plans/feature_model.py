"""Feature configuration, fitted on train and eval rows and applied to all."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.functions.times import cyclical, epoch_seconds
from tillwork.operators import features as f
from tillwork.session import pin


@dataclass(frozen=True)
class FeatureSpec:
    """What to make of which column."""

    ids: Sequence[str] = ()  # vocabulary with the usual minimum count of ids
    vocabulary: Mapping[str, int] = field(default_factory=dict)  # column -> minimum count
    scaled: Sequence[str] = ()
    bucketed: Mapping[str, int] = field(default_factory=dict)  # column -> quantile buckets
    cyclical: Mapping[str, Sequence[str]] = field(default_factory=dict)  # timestamp column -> periods
    crosses: Sequence[tuple[Sequence[str], int]] = ()  # (columns, hash buckets)
    target: Mapping | None = None  # column, clip_low, clip_high, log, norm

    def fit(self, df: DataFrame) -> FeatureModel:
        minimum = dict.fromkeys(self.ids, f.ID_MIN_COUNT) | dict(self.vocabulary)
        vocabularies = {
            c: pin(f.fit_vocabulary(df, c, least), "vocabulary") for c, least in minimum.items()
        }
        moments = f.fit_moments(df, self.scaled) if self.scaled else {}
        by_size: dict[int, list[str]] = {}
        for c, n in self.bucketed.items():
            by_size.setdefault(n, []).append(c)
        boundaries: dict[str, list[float]] = {}
        for n, cols in by_size.items():
            boundaries |= f.fit_quantiles(df, cols, n)
        target = f.fit_target(df, **self.target) if self.target else None
        return FeatureModel(self, vocabularies, moments, boundaries, target)


@dataclass(frozen=True)
class FeatureModel:
    spec: FeatureSpec
    vocabularies: Mapping[str, DataFrame]
    moments: Mapping[str, tuple[float, float]]
    boundaries: Mapping[str, list[float]]
    target: f.TargetTransform | None

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Only the kept and the derived columns; all but the vocabulary look-ups are plain expressions."""
        out, names = df, []
        for c, vocabulary in self.vocabularies.items():
            out = f.apply_vocabulary(out, c, vocabulary, f"{c}_idx")
            names.append(f"{c}_idx")
        cols = {}
        for c in self.spec.scaled:
            cols[f"{c}_z"] = f.zscore(c, self.moments[c])
        for c in self.spec.bucketed:
            cols[f"{c}_bucket"] = f.bucket_of(F.col(c).cast("double"), self.boundaries[c])
        for c, periods in self.spec.cyclical.items():
            for p in periods:
                cols[f"{c}_{p}_sin"], cols[f"{c}_{p}_cos"] = cyclical(epoch_seconds(F.col(c)), p)
        for parts, buckets in self.spec.crosses:
            values = [
                f.bucket_of(F.col(c).cast("double"), self.boundaries[c]) if c in self.boundaries else F.col(c)
                for c in parts
            ]
            cols["_x_".join(parts)] = f.hash_cross(values, buckets)
        if self.target is not None:
            cols["target"] = self.target.transform(F.col(self.spec.target["column"]))
        return out.select(*keep, *names, *[c.alias(n) for n, c in cols.items()])
