"""Default knobs of the metrics, and how settings override them."""

from __future__ import annotations

from dataclasses import dataclass, field

SEVERITIES = ("ok", "medium", "high", "critical")
MIN_SAMPLES = 5
# The defaults of the settings, which results must equal.
#: metric -> (floor from which a value is critical, floor under which it is ok)
FLOORS = {
    "ccn": (25.0, 11.0), "cognitive": (50.0, 8.0), "duplication": (30.0, None), "coverage_pct": (95.0, 25.0), "skip_ratio": (20.0, 0.5),
    "hotspot": (None, 22.0), "test_hotspot": (None, 25.0), "doc_hotspot": (None, 5.0),
}
#: metric -> breaks in use while there are too few samples for percentiles
FALLBACK = {"coverage_pct": (30.0, 50.0, 70.0, 85.0), "skip_ratio": (0.0, 1.0, 5.0, 10.0)}


@dataclass(frozen=True)
class Params:
    since_days: int = 90
    top_n: int = 5
    min_coupling: int = 3
    min_lift: float = 2.0
    symmetric_threshold: float = 0.5
    bulk_cap: int = 50
    min_cluster_count: int = 2
    min_tokens: int = 50
    docs_min_tokens: int = 100
    weight_churn: float = 1.0
    weight_complexity: float = 1.0
    weight_drift: float = 1.0
    high_commits: int = 5
    critical_commits: int = 20
    todo_medium: int = 3
    todo_high: int = 10
    must: tuple[str, ...] = ("critical:hotspot",)
    should: tuple[str, ...] = ("critical", "high:hotspot")
    markers: tuple[str, ...] = ("TODO", "FIXME", "XXX", "TBD", "[要確認]", "[要修正]")
    overrides: dict[str, dict[str, tuple[str, ...]]] = field(default_factory=dict)


DEFAULT = Params()


def drain_spec(text: str) -> tuple[str, bool]:
    """``severity`` or ``severity:hotspot``; anything else is an error."""
    severity, _, mark = text.strip().partition(":")
    if severity not in SEVERITIES or mark not in ("", "hotspot") or (":" in text and not mark):
        raise ValueError(f"no drain rule: {text!r}")
    return severity, bool(mark)


def policy_for(params: Params, metric: str) -> dict[str, tuple[tuple[str, bool], ...]]:
    """The rules of a metric, each field from the metric itself, else from its name before the
    dot, else the general one."""
    chain = [params.overrides.get(metric, {}), params.overrides.get(metric.split(".")[0], {}) if "." in metric else {}]
    return {tier: tuple(map(drain_spec, next((c[tier] for c in chain if tier in c), getattr(params, tier)))) for tier in ("must", "should")}


def override_notes(floors: dict[str, tuple[float | None, float | None]]) -> list[str]:
    """A line for each floor of the settings, (critical, ok) by metric, that differs from the default
    of the two complexity metrics."""
    out = []
    for kind, which in (("floor_ok", 1), ("floor_critical", 0)):
        for metric in ("ccn", "cognitive"):
            value, base = floors.get(metric, (None, None))[which], FLOORS[metric][which]
            if value is not None and value != base:
                out.append(f"{metric} {kind}={value:g} [override from {base:g}]")
    return out
