"""operators of the review-analytics engine."""
