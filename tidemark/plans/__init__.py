"""Models and their graph, runs, environments, and the metric layer."""
