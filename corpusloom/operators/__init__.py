"""Stages of the corpus: inventory, cleaning, splitting, examples, benchmarks, weights, metrics, selection."""
