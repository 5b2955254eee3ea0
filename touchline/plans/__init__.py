"""Whole jobs: dataset build, folds, training, backtest, ingest, feed."""
