"""streaming of the review-analytics engine."""
