"""Graph patterns, paths, aggregates, dataset scopes and updates as DataFrame programs."""
