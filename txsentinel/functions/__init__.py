from txsentinel.functions.scalars import (  # noqa: F401
    amount_deviation, amount_to_median_ratio, amount_zscore, clean_value,
    clip, cyclical, flag, iforest_flag, nan_to_null, planar_distance_km,
    round_money, safe_divide, timestamp_from_hours, vector_mse,
)
from txsentinel.functions.hashing import keyed_normal, keyed_uniform  # noqa: F401
