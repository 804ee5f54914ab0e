from assayer.functions.columns import (
    clean, guarded_ratio, is_blank, norm_text, num, parse_number, rnd, strip_text, to_text,
)
from assayer.functions.ranks import average_ranks, hash_rank, join_small, quantiles, running, scale_bucket
from assayer.functions.shape import long_form, rows_of, spread, wide_rows

__all__ = [
    "average_ranks", "clean", "guarded_ratio", "hash_rank", "is_blank", "join_small", "long_form", "norm_text", "num",
    "parse_number", "quantiles", "rnd", "rows_of", "running", "scale_bucket", "spread", "strip_text", "to_text", "wide_rows",
]
