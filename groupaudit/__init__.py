"""Audit engine for predictive claims on grouped, repeated-measures tables.

Every operator takes DataFrames and returns DataFrames.  A *unit* is one
recording, event or order; a *group* is the person, device or customer that
owns many units; labels, covariates and scores hang off units or groups.
"""

__version__ = "0.1.0"
