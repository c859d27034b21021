"""The steps."""

from tidewater.operators.correlation import CorrelationFilter
from tidewater.operators.lags import LagFeatures
from tidewater.operators.missing import MissingValueHandler
from tidewater.operators.outliers import OutlierHandler
from tidewater.operators.scaling import Scaler
from tidewater.operators.temporal import TemporalFeatures
from tidewater.operators.wind import WindDecomposer

__all__ = [
    "CorrelationFilter", "LagFeatures", "MissingValueHandler", "OutlierHandler", "Scaler", "TemporalFeatures", "WindDecomposer",
]
