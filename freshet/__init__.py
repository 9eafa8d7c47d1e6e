"""Flood-consequence analytics over Spark DataFrames: terrain and depth as cells, roads as edges, settlements as features."""
