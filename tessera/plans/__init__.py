"""Multi-step plans: building, publishing and opening an index."""
