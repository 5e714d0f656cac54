"""Tabular preparation, profiling, feature selection and model chains on Spark."""

from tabloom.frame import Table
from tabloom.operators.base import Fitted, Operator, get_operator, operator_names

__all__ = ["Table", "Operator", "Fitted", "get_operator", "operator_names"]
