"""Column-expression helpers (built-in Spark functions; the canonical JSON text alone is an Arrow-batched function)."""

from portflow.functions.calendar import month_start, season, week_start
from portflow.functions.keys import natural_route_key, route_key, route_pair_key, pair_label
from portflow.functions.numeric import round_ratio, safe_share
from portflow.functions.text import clean_text, fold_port, unicode_trim

__all__ = [
    "clean_text",
    "fold_port",
    "month_start",
    "natural_route_key",
    "pair_label",
    "round_ratio",
    "route_key",
    "route_pair_key",
    "safe_share",
    "season",
    "unicode_trim",
    "week_start",
]
