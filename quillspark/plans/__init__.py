"""Whole plans: post-processing, evaluation, and the registered queries."""
