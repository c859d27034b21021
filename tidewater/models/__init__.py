"""Models."""

from tidewater.models.forecast import HybridProphetRegressor, ProphetFeatures, ProphetForecaster
from tidewater.models.imputer import IterativeImputer
from tidewater.models.interpret import permutation_importance_report, shap_importance, tree_shap_values
from tidewater.models.isolation import IsolationForest
from tidewater.models.neural import CNNRegressor, LSTMRegressor, MLPRegressor, make_sequences
from tidewater.models.nmf import NMFApportionment
from tidewater.models.registry import list_regressors, make_regressor

__all__ = [
    "CNNRegressor", "HybridProphetRegressor", "IsolationForest", "IterativeImputer", "LSTMRegressor", "MLPRegressor", "NMFApportionment",
    "ProphetFeatures", "ProphetForecaster", "list_regressors", "make_regressor", "make_sequences", "permutation_importance_report",
    "shap_importance", "tree_shap_values",
]
