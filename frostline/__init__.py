"""Pairwise annealing analytics on Spark."""
