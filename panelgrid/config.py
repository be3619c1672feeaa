"""Experiment settings and the experiment matrix."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class ExperimentConfig:
    name: str
    model: str
    variable_set: str
    model_params: dict = field(default_factory=dict)
    n_folds_cv: int = 5
    n_folds_tuning: int = 5
    random_state: int = 26
    bootstrap_size: float = 0.8

    def seed(self, rep: int) -> int:
        """Each repetition shifts the base seed."""
        return self.random_state + rep

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


# Search space of the random forest experiments.
FOREST_PARAMS = {
    "n_estimators": [100, 200, 400, 800, 1600],
    "max_features": 15,
    "min_samples_leaf": [2, 5, 10],
    "min_samples_split": [4, 8, 12, 16],
    "max_depth": [5, 10, 20, None],
    "n_iter": 125,
    "scoring": "rmse",
}

# Variable sets each kind of model was run with. The three automated frameworks are
# replaced by one candidate search (``leaderboard``) whose budget counts candidates.
MATRIX_SETS = {
    "random_forest": ["rs", "rs_meteo", "rs_min", "rs_min_vi"],
    "leaderboard": ["rs", "rs_meteo", "rs_meteo_yr", "rs_min", "rs_min_sif", "rs_min_vi",
                    "rs_min_yr", "rs_yr"],
    "stacked": ["rs", "rs_meteo", "rs_min", "rs_min_vi"],
}


def experiment_matrix() -> list[ExperimentConfig]:
    params = {"random_forest": FOREST_PARAMS,
              "leaderboard": {"candidates": 12, "scoring": "rmse"},
              "stacked": {"candidates": 12, "scoring": "rmse"}}
    runs = [ExperimentConfig(f"{model}-{s}", model, s, params[model])
            for model, sets in MATRIX_SETS.items() for s in sets]
    # the one run with twice the budget
    return runs + [ExperimentConfig("leaderboard-rs-long", "leaderboard", "rs",
                                    {"candidates": 24, "scoring": "rmse"})]
