"""Winnow: analytics over reinforcement-learning rollouts as Spark DataFrames.

``functions``   column builders (answer scoring, batch geometry, cell formats)
``operators``   DataFrame -> DataFrame steps (advantages, pruning, diagnostics)
``sources``     readers and writers with declared schemas
``plans``       report tables and the registered queries
``streaming``   the same steps over ``readStream`` inputs
"""
