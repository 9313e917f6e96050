"""See :mod:`driftloom.streaming.operators`."""

from driftloom.streaming.operators import copula_batches, online_learner, ring_window  # noqa: F401
