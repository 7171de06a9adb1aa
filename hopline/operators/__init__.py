"""Message operators: lanes, path stages, fan-out, count windows, validation, metrics."""
