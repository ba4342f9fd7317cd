"""Table operators: folding, state, scores, gates, context, views, sinks."""
