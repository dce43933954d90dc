"""Functions on long frames keyed by (ticker, dt)."""
