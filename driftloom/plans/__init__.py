"""Queries over the test tables; importing this package registers them all."""

from driftloom.plans import clusters, density, experiment, imputation, scalars, shaping, stream, trees, vectors  # noqa: F401
