"""Building blocks: grouping, ranking, first-wins, flat rows to star rows."""
