"""Rollout, preference and evaluation data for language-model post-training, on Spark DataFrames."""
