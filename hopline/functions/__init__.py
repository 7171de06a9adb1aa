"""Column-level building blocks: canonical draws, clocks and path helpers."""
