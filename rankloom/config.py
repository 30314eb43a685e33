"""Job parameters. Everything here lives on the driver and is a scalar."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class RankingConfig:
    # Parameter names and defaults.
    sample_size: int | None = 75  # None: all judged queries
    random_state: int = 42
    max_docs: int | None = 20000
    bm25_top_k: int = 30
    rerank_eval_k: int = 10
    positives_per_query: int = 1
    negatives_per_query: int = 4
    test_size: float = 0.2
    tuning_folds: int = 5
    enable_model_tuning: bool = True
    enable_feature_selection: bool = True
    feature_selection_min_features: int = 5

    def to_dict(self) -> dict[str, object]:
        return asdict(self)

    @classmethod
    def from_dict(cls, payload: dict[str, object]) -> "RankingConfig":
        known = {f.name for f in fields(cls)}
        return cls(**{name: value for name, value in payload.items() if name in known})

    @classmethod
    def profile(cls, name: str) -> "RankingConfig":
        return replace(cls(), **PROFILES[name])


# The three run profiles.
PROFILES: dict[str, dict[str, object]] = {
    "tiny": dict(
        sample_size=200, max_docs=50000, bm25_top_k=50,
        positives_per_query=1, negatives_per_query=6, test_size=0.15,
    ),
    "medium": dict(
        sample_size=500, max_docs=500000, bm25_top_k=100,
        positives_per_query=2, negatives_per_query=12, test_size=0.1,
    ),
    "full": dict(
        sample_size=1000, max_docs=None, bm25_top_k=200,
        positives_per_query=3, negatives_per_query=20, test_size=0.1,
    ),
}
