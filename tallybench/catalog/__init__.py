"""The registered queries, each with its oracle SQL where one exists."""
from . import registry
from . import (classification, regression, preparation, pairing, distances,
               statistics, io_queries, modelling)

__all__ = ["registry", "classification", "regression", "preparation", "pairing",
           "distances", "statistics", "io_queries", "modelling"]
