"""DataFrame operators: scoring, selection, intervals, graphs and evaluation."""
