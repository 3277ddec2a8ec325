"""sources of the review-analytics engine."""
