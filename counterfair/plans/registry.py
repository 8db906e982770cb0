"""All registered queries; importing a plan module registers its entries."""

from counterfair.plans import (  # noqa: F401
    metric_plans,
    model_plans,
    prepare_plans,
    search_plans,
    source_plans,
    text_plans,
)
from counterfair.plans.base import ORACLES, QUERIES  # noqa: F401
