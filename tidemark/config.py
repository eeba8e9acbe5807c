"""Job parameters as a plain dataclass (not a table).

Defaults are the reference's stated values; the year range, missing-share
limit and drift settings are real parameters here (Q7, Q8).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from tidemark.operators.drift import DriftOptions


@dataclass(frozen=True)
class DataParams:
    test_size: float = 0.2
    random_state: int = 42
    year_start: int = 2008
    year_end: int = 2016
    missing_limit: float = 0.30


@dataclass(frozen=True)
class ModelParams:
    max_depth: int = 9
    learning_rate: float = 0.05
    n_estimators: int = 200
    colsample_bytree: float = 0.8
    subsample: float = 0.7
    min_child_weight: int = 3
    random_state: int = 42

    def spark_gbt(self) -> dict:
        """Spark ML equivalents (gamma has no equal on Spark's impurity scale)."""
        return dict(maxDepth=self.max_depth, stepSize=self.learning_rate, maxIter=self.n_estimators,
                    featureSubsetStrategy=str(self.colsample_bytree), subsamplingRate=self.subsample,
                    minInstancesPerNode=self.min_child_weight, seed=self.random_state)


@dataclass(frozen=True)
class MonitoringParams:
    drift_threshold: float = 0.02
    drift_check_enabled: bool = True
    f1_alert_below: float = 0.6


@dataclass(frozen=True)
class Params:
    data: DataParams = field(default_factory=DataParams)
    model: ModelParams = field(default_factory=ModelParams)
    monitoring: MonitoringParams = field(default_factory=MonitoringParams)

    def drift_options(self) -> DriftOptions:
        return DriftOptions(drift_share=self.monitoring.drift_threshold)


def load_params(path: str | None = None) -> Params:
    """Read a YAML/JSON parameter file with the reference's section names; missing keys keep defaults."""
    if not path:
        return Params()
    import json
    with open(path) as f:
        text = f.read()
    try:
        import yaml
        raw = yaml.safe_load(text)
    except ImportError:
        raw = json.loads(text)
    d, m, mo = raw.get("data", {}), raw.get("model", {}), raw.get("monitoring", {})
    yr = d.get("year_range", {})
    return Params(
        DataParams(d.get("test_size", 0.2), d.get("random_state", 42), yr.get("start", 2008), yr.get("end", 2016),
                   d.get("missing_limit", 0.30)),
        ModelParams(**{k: m[k] for k in ModelParams.__dataclass_fields__ if k in m}),
        MonitoringParams(mo.get("drift_threshold", 0.02), mo.get("drift_check_enabled", True)))
