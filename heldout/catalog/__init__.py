"""All registered queries."""

from heldout.catalog import checks, cohort, features, metrics, model, ranking, reports, resampling, sources  # noqa: F401
from heldout.catalog.base import ORACLES, QUERIES  # noqa: F401
