"""Query plans for tables and graphs, the question planner and answer assembly."""
