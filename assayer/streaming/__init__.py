from assayer.streaming.scoring import contract_stream, run_to_table
from assayer.streaming.stateful import closed_days, missing_days, repeated_in_period, run_step

__all__ = ["closed_days", "contract_stream", "missing_days", "repeated_in_period", "run_step", "run_to_table"]
